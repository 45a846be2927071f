"""Data health over canonical bars: coverage, gaps, anomalies, session-over-session delta."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import reasons_where
from tidemark.operators.calendar import weekend

# Fixed values.
QUALITY = ("UNKNOWN", "VALID", "REJECTED", "DEGRADED", "STALE")


def flat() -> Column:
    return (F.col("open") == F.col("high")) & (F.col("high") == F.col("low")) & (F.col("low") == F.col("close"))


def _counts() -> list[Column]:
    return [
        *[F.count_if(F.col("quality") == q).alias(f"q_{q.lower()}") for q in QUALITY],
        F.count_if(flat()).alias("flat"), F.count_if(F.col("volume") == 0).alias("zero_volume"),
    ]


def session_health(bars: DataFrame, panel: int) -> DataFrame:
    """Per session: rows, instruments, coverage gap against the expected panel, quality and anomaly counts."""
    # Two steps keep the distinct count map-side combinable however large one session is.
    per_instrument = bars.groupBy("session_date", "instrument_id").agg(F.count("*").alias("__n"), *_counts())
    names = [f"q_{q.lower()}" for q in QUALITY] + ["flat", "zero_volume"]
    out = per_instrument.groupBy("session_date").agg(
        F.sum("__n").alias("bars"), F.count("*").alias("instruments"), *[F.sum(n).alias(n) for n in names]
    )
    return out.withColumn("coverage_gap", F.greatest(F.lit(0), F.lit(panel) - F.col("instruments")))


def calendar_gaps(bars: DataFrame, holidays: DataFrame) -> DataFrame:
    """Weekdays strictly between the first and last session that no bar covers, marked when a cited holiday."""
    sessions = bars.select("session_date").distinct()
    span = sessions.agg(F.min("session_date").alias("a"), F.max("session_date").alias("b"))
    days = span.where("b > a").select(F.explode(F.sequence("a", "b")).alias("session_date")).where(~weekend())
    named = holidays.select(F.col("holiday_date").alias("session_date"), "holiday_name", "kind")
    return days.join(sessions, "session_date", "left_anti").join(named, "session_date", "left").withColumn(
        "known_holiday", F.col("holiday_name").isNotNull()
    )


def anomalies(bars: DataFrame) -> DataFrame:
    kinds = reasons_where((flat(), "FLAT_OHLC"), (F.col("volume") == 0, "ZERO_VOLUME"))
    return bars.select("session_date", "instrument_id", "quality", F.explode(kinds).alias("observation"))


def health_report(bars: DataFrame, panel: int) -> DataFrame:
    """One-row roll-up; duplicates or an unknown quality make it fail closed."""
    duplicated = bars.groupBy("instrument_id", "session_date").agg(F.count("*").alias("n")).agg(
        F.count_if(F.col("n") > 1).alias("__dup"))
    total = bars.agg(
        F.max("session_date").alias("last_session"), *_counts(), F.count("*").alias("bars"),
        F.count_if(~F.col("quality").isin(*QUALITY)).alias("__odd"),
        F.max(F.col("quality") != "VALID").alias("degraded"),
    )
    return total.crossJoin(duplicated).select(  # one row each
        F.when(F.col("__dup") > 0, F.lit("DATA_HEALTH_DUPLICATE_CANONICAL_ROW"))
        .when(F.col("__odd") > 0, F.lit("DATA_HEALTH_QUALITY_STATUS_UNKNOWN")).otherwise(F.lit("OK")).alias("verdict"),
        "last_session", F.lit(panel).alias("expected_panel"), "bars", "degraded",
        *[f"q_{q.lower()}" for q in QUALITY], "flat", "zero_volume",
    )


def session_delta(bars: DataFrame, since=None) -> DataFrame:
    """Close change between the two newest sessions; a missing side stays explicit and is never divided."""
    newest = bars.select("session_date").distinct().orderBy(F.desc("session_date")).limit(2)
    pair = newest.agg(F.max("session_date").alias("new_session"), F.min("session_date").alias("previous_session"))
    pair = F.broadcast(pair.where("new_session > previous_session"))  # at most one row
    sides = bars.select("instrument_id", "session_date", "close").join(newest, "session_date", "left_semi").crossJoin(pair)
    both = sides.groupBy("instrument_id", "new_session", "previous_session").agg(
        F.max(F.when(F.col("session_date") == F.col("previous_session"), F.col("close"))).alias("previous_close"),
        F.max(F.when(F.col("session_date") == F.col("new_session"), F.col("close"))).alias("new_close"),
    )
    has_old, has_new = F.col("previous_close").isNotNull(), F.col("new_close").isNotNull()
    change = F.col("new_close") - F.col("previous_close")
    out = both.select(
        "instrument_id",
        F.when(has_old & has_new, F.lit("COMPARED")).otherwise(F.lit("MISSING")).alias("status"),
        F.when(has_old, F.col("previous_session")).alias("previous_session"), "previous_close",
        F.when(has_new, F.col("new_session")).alias("new_session"), "new_close", change.alias("change"),
        (F.try_divide(change.cast("double"), F.col("previous_close").cast("double")) * 100).alias("change_percent"),
        F.when(has_old & has_new & (F.col("previous_close") == 0), F.lit("PREVIOUS_CLOSE_ZERO"))
        .when(~has_new, F.lit("MISSING_NEW_SESSION")).when(~has_old, F.lit("MISSING_PREVIOUS_SESSION")).alias("reason"),
        F.when(has_old & ~has_new, F.lit("PREVIOUS_ONLY")).when(has_new & ~has_old, F.lit("NEW_ONLY")).alias("present_in"),
    )
    return out
