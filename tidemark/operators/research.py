"""Outcome attachment, cohorts, exact summaries and paging over decision runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import LOCAL_ZONE, first_reason, plain_decimal, reasons_where
from tidemark.operators.pit import instant
from tidemark.operators.scan import prefix_scan

# Fixed values.
COHORTS = ("DATA_BLOCKED", "INELIGIBLE", "NOT_EVALUATED", "NONE", "WATCH", "CONFIRMED", "FAILED")
PARTITIONS = {
    "NONE": ("NONE",),
    "MARKET_TREND": ("POSITIVE", "NEUTRAL", "NEGATIVE", "UNKNOWN"),
    "MARKET_VOLATILITY": ("NORMAL", "ELEVATED", "UNKNOWN"),
    "HELD_CONTEXT": ("HELD", "NOT_HELD", "NO_PORTFOLIO_CONTEXT"),
    "MEMBERSHIP": ("CONFIGURED", "OUTSIDE_CONFIGURED", "MEMBERSHIP_UNKNOWN"),
}
ROW = ("run_id", "instrument_id")


def select_runs(runs: DataFrame, capture_from, capture_to, cutoff, portfolio: str | None = None, zone: str = LOCAL_ZONE) -> DataFrame:
    """Runs captured on the local civil dates and known at the cutoff. The dates become instant
    literals, so the comparison is on the bare column and reaches the scan."""
    start = F.to_utc_timestamp(F.lit(capture_from).cast("timestamp"), zone)
    stop = F.to_utc_timestamp(F.date_add(F.lit(capture_to).cast("date"), 1).cast("timestamp"), zone)
    at = instant(cutoff)
    chosen = runs.where(
        (F.col("captured_at") >= start) & (F.col("captured_at") < stop) & (F.col("captured_at") <= at)
        & (F.col("knowledge_cutoff") <= at) & (F.col("recorded_at") <= at)
    )
    return chosen.where(F.col("portfolio_id").eqNullSafe(F.lit(portfolio))) if portfolio != "*" else chosen


def attach_outcomes(rows: DataFrame, outcomes: DataFrame, horizon: int, cutoff) -> DataFrame:
    """Left join whose clocks sit in the condition: a row whose outcome is not yet visible survives without it."""
    at = instant(cutoff)
    # Restricting the right side first is the same as a condition in ON, and it is pushed to the scan.
    seen = outcomes.where((F.col("horizon_sessions") == horizon) & (F.col("outcome_known_at") <= at) & (F.col("recorded_at") <= at))
    return rows.join(seen.select(*ROW, "state", "outcome_reason", "price_return_pct", "horizon_date"), list(ROW), "left")


def cohort() -> Column:
    return first_reason(
        (F.col("eligibility") == "DATA_BLOCKED", "DATA_BLOCKED"), (F.col("eligibility") == "INELIGIBLE", "INELIGIBLE"),
        (~F.col("setup_evaluated"), "NOT_EVALUATED"), (F.col("setup") == "NONE", "NONE"), (F.col("setup") == "WATCH", "WATCH"),
        (F.col("setup") == "CONFIRMED", "CONFIRMED"), otherwise="FAILED",
    )


def partition_of(grouping: str) -> Column:
    if grouping == "NONE":
        return F.lit("NONE")
    if grouping in ("MARKET_TREND", "MARKET_VOLATILITY"):
        return F.col(grouping.lower())
    if grouping == "HELD_CONTEXT":
        return F.when(F.col("portfolio_id").isNull(), F.lit("NO_PORTFOLIO_CONTEXT")).when(F.col("held"), F.lit("HELD")).otherwise(F.lit("NOT_HELD"))
    if grouping == "MEMBERSHIP":
        return F.when(F.col("configured"), F.lit("CONFIGURED")).when(
            F.col("universe_snapshot_id").isNull(), F.lit("MEMBERSHIP_UNKNOWN")).otherwise(F.lit("OUTSIDE_CONFIGURED"))
    raise ValueError("RESEARCH_QUERY_INVALID")


def research_cells(rows: DataFrame, runs: DataFrame, grouping: str) -> DataFrame:
    """Rows with their run's context, cohort and partition."""
    header = runs.select("run_id", "portfolio_id", "target_session", "universe_snapshot_id", "market_trend", "market_volatility", "policy_id")
    return rows.join(header, "run_id").withColumn("cohort", cohort()).withColumn("partition", partition_of(grouping))


def exact_median(values: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean of the two middle values per group, exact. Equal values collapse into counts map-side and
    positions come from a two-level running count, so no group is sorted in one task."""
    counted = values.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__k"))
    block = F.floor(F.col(value)).cast("long")
    placed = prefix_scan(counted, by, [value], block, {"__upto": ("sum", F.col("__k"))}, inclusive=True)
    total = counted.groupBy(*by).agg(F.sum("__k").alias("__n"))
    matched = None
    for key in by:
        test = F.col(f"p.{key}").eqNullSafe(F.col(f"t.{key}"))
        matched = test if matched is None else matched & test
    x = placed.alias("p").join(total.alias("t"), matched if matched is not None else F.lit(True))
    low, high = F.floor((F.col("__n") + 1) / 2), F.floor((F.col("__n") + 2) / 2)
    below = F.col("__upto") - F.col("__k")
    covers = lambda pos: ((below < pos) & (pos <= F.col("__upto"))).cast("int")
    weight = covers(low) + covers(high)
    return x.where(weight > 0).groupBy(*[F.col(f"p.{k}").alias(k) for k in by]).agg(
        (F.sum(F.col(value).cast("decimal(28,8)") * weight) / 2).cast("double").alias("median"))


def research_summary(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """N, A, T (anchor, data, basis), R, U, P, Z, M and the return metrics per group; null when empty."""
    s, v = F.col("state"), F.col("price_return_pct")
    available = s == "AVAILABLE"
    counts = cells.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(available).alias("a"), F.count_if(s == "ANCHOR_UNAVAILABLE").alias("t_anchor"),
        F.count_if(s == "DATA_UNAVAILABLE").alias("t_data"), F.count_if(s == "BASIS_UNCERTAIN").alias("t_basis"),
        F.count_if(available & (v > 0)).alias("p"), F.count_if(available & (v == 0)).alias("z"), F.count_if(available & (v < 0)).alias("m"),
        F.sum(F.when(available, v)).alias("__sum"), F.min(F.when(available, v)).alias("minimum"), F.max(F.when(available, v)).alias("maximum"),
    )
    middle = exact_median(cells.where(available), by, "price_return_pct")
    x = counts.join(middle, list(by), "left")
    t = F.col("t_anchor") + F.col("t_data") + F.col("t_basis")
    return x.select(
        *by, "n", "a", t.alias("t"), (F.col("a") + t).alias("r"), (F.col("n") - F.col("a") - t).alias("u"), "t_anchor", "t_data", "t_basis", "p", "z", "m",
        "median", (F.col("__sum").cast("double") / F.nullif(F.col("a"), F.lit(0))).alias("mean"),
        F.col("minimum").cast("double").alias("minimum"), F.col("maximum").cast("double").alias("maximum"),
        F.when(F.col("a") > 0, 100.0 * F.col("p") / F.col("a")).alias("positive_percent"), (100.0 * F.col("a") / F.col("n")).alias("coverage_percent"),
    )


def research_grid(cells: DataFrame, grouping: str) -> DataFrame:
    """Counts of every cohort and partition, empty ones included, and the grand total."""
    spark = cells.sparkSession
    grid = spark.createDataFrame([(c, p) for c in COHORTS for p in PARTITIONS[grouping]], "cohort string, partition string")
    sums = cells.groupingSets([["cohort", "partition"], []], "cohort", "partition").agg(
        F.count("*").alias("n"), F.count_if(F.col("state") == "AVAILABLE").alias("a"), F.grouping("cohort").alias("__total"))
    total = sums.where("__total = 1").select(F.lit("ALL").alias("cohort"), F.lit("ALL").alias("partition"), "n", "a")
    filled = F.broadcast(grid).join(sums.where("__total = 0"), ["cohort", "partition"], "left")  # at most 28 grid rows
    return filled.select("cohort", "partition", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("a", F.lit(0)).alias("a")).unionByName(total)


def research_diversity(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Distinct runs, instruments, sessions and episodes, and the repeats beyond them."""
    episode = F.when(F.col("episode_id").isNotNull(), F.struct("policy_id", "instrument_id", "episode_id"))
    dated = F.when(F.col("target_session").isNotNull(), F.struct("instrument_id", "target_session"))
    x = cells.groupBy(*by).agg(
        F.count("*").alias("n"), F.countDistinct("run_id").alias("runs"), F.countDistinct("instrument_id").alias("instruments"),
        F.countDistinct("target_session").alias("target_sessions"), F.count_if(F.col("target_session").isNull()).alias("null_target"),
        F.count("episode_id").alias("episode_linked"), F.countDistinct(episode).alias("episode_keys"), F.countDistinct(dated).alias("__dated"))
    return x.select(
        *by, "runs", "instruments", "target_sessions", "null_target", "episode_linked", (F.col("n") - F.col("episode_linked")).alias("no_episode"),
        "episode_keys", (F.col("episode_linked") - F.col("episode_keys")).alias("extra_episode_captures"),
        (F.col("n") - F.col("null_target") - F.col("__dated")).alias("additional_session_captures"))


def research_warnings(summary: DataFrame, diversity: DataFrame, by: Sequence[str]) -> DataFrame:
    """Warning codes of each group, the sample-size one with its count."""
    x = summary.join(diversity, list(by))
    a, n = F.col("a"), F.col("n")
    sample = (
        F.when(n == 0, F.lit("NO_OBSERVATIONS")).when(a == 0, F.lit("NO_AVAILABLE_OUTCOMES")).when(a < 5, F.lit("VERY_SMALL_SAMPLE"))
        .when(a < 20, F.lit("SMALL_SAMPLE")).when(a < 30, F.lit("LIMITED_SAMPLE")).otherwise(F.lit("DESCRIPTIVE_SAMPLE"))
    )
    tail = reasons_where(
        (F.col("extra_episode_captures") > 0, "REPEATED_EPISODES"), (F.col("u") > 0, "UNRESOLVED"), (a < n, "SELECTIVE_AVAILABILITY"))
    return x.select(*by, F.concat(F.array(F.lit("PROSPECTIVE_OBSERVATIONS"), F.lit("DEPENDENCE"), F.lit("PRICE_ONLY"), sample), tail).alias("warnings"),
                    plain_decimal(F.round("coverage_percent", 6).cast("decimal(20,6)")).alias("coverage_text"))


def research_base(runs: DataFrame, rows: DataFrame, keep: Column) -> DataFrame:
    """Base accounting of the selected runs: declared counts, kept and filtered rows, empty runs."""
    actual = rows.groupBy("run_id").agg(F.count("*").alias("__rows"), F.count_if(keep).alias("__kept"))
    x = runs.select("run_id", "row_count").join(actual, "run_id", "left").select(
        "run_id", "row_count", F.coalesce("__rows", F.lit(0)).alias("rows"), F.coalesce("__kept", F.lit(0)).alias("kept"))
    return x.agg(
        F.count("*").alias("runs"), F.sum("rows").alias("observations"), F.sum(F.col("rows") - F.col("kept")).alias("filtered_out"),
        F.count_if(F.col("row_count") == 0).alias("empty_runs"), F.count_if(F.col("row_count") != F.col("rows")).alias("count_mismatches"))


def capture_cadence(cells: DataFrame) -> DataFrame:
    """How often each row's session and episode were captured, as joins on aggregated counts."""
    session = cells.groupBy("instrument_id", "target_session").agg(F.count("*").alias("session_captures"))
    episode = cells.where("episode_id is not null").groupBy("instrument_id", "episode_id").agg(F.count("*").alias("episode_captures"))
    same = (F.col("c.instrument_id") == F.col("s.instrument_id")) & F.col("c.target_session").eqNullSafe(F.col("s.target_session"))
    x = cells.alias("c").join(session.alias("s"), same).select("c.*", "session_captures")
    return x.join(episode, ["instrument_id", "episode_id"], "left")


def outcome_summary(cells: DataFrame) -> DataFrame:
    """Available, terminally unavailable and unresolved outcomes per run and horizon."""
    terminal = F.col("state").isin("ANCHOR_UNAVAILABLE", "DATA_UNAVAILABLE", "BASIS_UNCERTAIN")
    available = F.col("state") == "AVAILABLE"
    return cells.groupBy("run_id", "horizon_sessions").agg(
        F.count("*").alias("cells"), F.count_if(available).alias("available"), F.count_if(terminal).alias("terminal_unavailable"),
        F.count_if(F.coalesce(~available & ~terminal, F.lit(True))).alias("unresolved"))


def page_after(df: DataFrame, key: tuple | None, limit: int, columns: Sequence[str] = ("captured_at", "run_id", "instrument_id")) -> DataFrame:
    """Rows after a key in lexicographic order, one page; a keyset page never scans what it skipped."""
    if key is not None:
        after, equal = F.lit(False), F.lit(True)
        for name, value in zip(columns, key):
            literal = F.lit(value).cast(df.schema[name].dataType)
            after = after | (equal & (F.col(name) > literal))
            equal = equal & (F.col(name) == literal)
        # A plain bound on the leading column reaches the scan.
        lead = F.lit(key[0]).cast(df.schema[columns[0]].dataType)
        df = df.where(F.col(columns[0]) >= lead).where(after)
    return df.orderBy(*columns).limit(limit)


def list_runs(runs: DataFrame, limit: int, after: tuple | None = None, rows: DataFrame | None = None, instrument: str | None = None) -> DataFrame:
    """Newest runs first, optionally only those holding an instrument."""
    if instrument is not None:
        runs = runs.join(rows.where(F.col("instrument_id") == instrument).select("run_id").distinct(), "run_id", "left_semi")
    if after is not None:
        at = instant(after[0])
        runs = runs.where((F.col("captured_at") < at) | ((F.col("captured_at") == at) & (F.col("run_id") < after[1])))
    return runs.orderBy(F.desc("captured_at"), F.desc("run_id")).limit(limit)
