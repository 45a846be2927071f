"""Calendar-continuous runs and the thirteen technical features over them.

A bars table holds one row per (instrument, session), so an instrument's window is as long as the
exchange calendar; many revisions of one bar are reduced by ``bars_as_of`` before they get here.
Everything below is one hash shuffle by instrument, then window expressions in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import DECIMAL_LIMIT, first_reason
from tidemark.functions.smoothing import smoothing_stages
from tidemark.operators.calendar import CLOSED, weekend

# Feature name -> sessions it needs.
MINIMUM_SESSIONS = {
    "changePercent": 2, "ema20": 20, "ema50": 50, "atr14": 15, "atrPercent": 15, "priorHigh20": 21, "priorLow20": 21,
    "distanceToHighPercent": 21, "volumeRatio20": 21, "dailyValueProxyIdr": 1, "monetaryLiquidity20Idr": 21,
    "rs20Pp": 21, "rs60Pp": 61,
}
NOT_FOR_INDEX = ("volumeRatio20", "dailyValueProxyIdr", "monetaryLiquidity20Idr", "rs20Pp", "rs60Pp")
RUN = ["instrument_id", "run_id"]


def session_ordinals(calendar: DataFrame) -> DataFrame:
    """Ordinal of each civil day among the days that are not closed. One row per day, so one small task."""
    reason = F.col("reason") if "reason" in calendar.columns else F.lit(None).cast("string")
    days = calendar.select("session_date", F.col("status").alias("__status"), reason.alias("__reason"))
    is_open = ~(F.col("__status").isin(*CLOSED) & F.col("__reason").isNull())
    return days.where(is_open).select(
        "session_date",
        F.row_number().over(Window.orderBy("session_date")).alias("ordinal"),
        ((F.col("__status") == "ObservedTrading") & F.col("__reason").isNull()).alias("confirmed"),
    )


def runs(bars: DataFrame, calendar: DataFrame, through=None) -> DataFrame:
    """Bars on confirmed sessions with run_id and pos; a session without a bar, or an unconfirmed
    weekday, starts a new run, a closed day does not."""
    days = session_ordinals(calendar).where("confirmed").drop("confirmed")
    if through is not None:
        bars = bars.where(F.col("session_date") <= F.lit(through).cast("date"))
    placed = bars.join(days, "session_date")
    own = Window.partitionBy("instrument_id").orderBy("session_date")
    islands = placed.withColumn("run_id", F.col("ordinal") - F.row_number().over(own))
    return islands.withColumn("pos", F.row_number().over(Window.partitionBy(*RUN).orderBy("session_date")))


def last_runs(bars: DataFrame, calendar: DataFrame, through=None) -> DataFrame:
    """Last non-empty run per instrument, even when later sessions reset it."""
    placed = runs(bars, calendar, through)
    return placed.withColumn("__last", F.max("run_id").over(Window.partitionBy("instrument_id"))).where(
        F.col("run_id") == F.col("__last")
    ).drop("__last")


def personal_runs(bars: DataFrame, closures: DataFrame, calendar: DataFrame, through, window_days: int = 366) -> DataFrame:
    """Run that touches ``through``: weekends and cited closures are skipped, any other missing weekday
    ends it. ``calendar`` supplies the civil days."""
    limit = F.lit(through).cast("date")
    days = calendar.select("session_date").where(
        ~weekend() & (F.col("session_date") <= limit) & (F.col("session_date") > F.date_sub(limit, window_days))
    ).join(closures.select(F.col("holiday_date").alias("session_date")), "session_date", "left_anti").withColumn(
        "status", F.lit("ObservedTrading")
    )
    last_day = days.agg(F.max("session_date").alias("__edge"))
    placed = runs(bars, days)
    tail = Window.partitionBy(*RUN)
    return placed.crossJoin(F.broadcast(last_day)).withColumn(  # one row
        "__end", F.max("session_date").over(tail)
    ).where(F.col("__end") == F.col("__edge")).drop("__end", "__edge")


def pilot_runs(bars: DataFrame, proofs: DataFrame, through=None) -> tuple[DataFrame, DataFrame]:
    """Run ending at the last observed session with positive volume throughout, and a status per instrument."""
    days = proofs if through is None else proofs.where(F.col("session_date") <= F.lit(through).cast("date"))
    observed = days.where(F.col("status") == "ObservedTrading").agg(F.max("session_date").alias("__edge"))
    own = bars if through is None else bars.where(F.col("session_date") <= F.lit(through).cast("date"))
    edge = F.broadcast(observed)  # one row
    placed = runs(own.where("volume > 0"), days).crossJoin(edge).where(F.col("session_date") <= F.col("__edge"))
    tail = Window.partitionBy(*RUN)
    current = placed.withColumn("__end", F.max("session_date").over(tail)).where(F.col("__end") == F.col("__edge")).drop("__end", "__edge")
    sized = current.groupBy("instrument_id").agg(F.count("*").alias("sessions"), F.max("session_date").alias("__market"))
    status = own.groupBy("instrument_id").agg(F.max("session_date").alias("__own")).join(sized, "instrument_id", "left").crossJoin(edge).select(
        "instrument_id",
        F.coalesce("__market", "__own").alias("market_date"),
        F.when(F.col("__edge").isNull(), F.lit("SESSION_UNCONFIRMED"))
        .when(F.col("sessions") >= 50, F.lit("AVAILABLE_PILOT")).when(F.col("sessions").isNotNull(), F.lit("WARMUP"))
        .when(F.col("__own") < F.col("__edge"), F.lit("STALE")).otherwise(F.lit("UNKNOWN")).alias("status"),
        F.coalesce("sessions", F.lit(0)).alias("sessions"),
    )
    return current, status


def align_benchmark(run: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Benchmark close and volume on the same dates; an absent date stays absent."""
    side = benchmark.select("session_date", F.col("close").cast("double").alias("b_close"), F.col("volume").alias("b_volume"))
    return run.join(side, "session_date", "left")


def _state(minimum: int, value: Column, reason: Column | None = None) -> Column:
    short = F.col("pos") < minimum
    known = F.lit(None).cast("string") if reason is None else reason
    unusable = value.isNull() | F.isnan(value) | (F.abs(value) > F.lit(DECIMAL_LIMIT))
    why = F.when(short, F.lit("INSUFFICIENT_SESSIONS")).when(known.isNotNull(), known).when(unusable, F.lit("NUMERIC_OUT_OF_RANGE"))
    return F.struct(
        F.when(short, F.lit("WARMUP")).when(why.isNotNull(), F.lit("UNAVAILABLE")).otherwise(F.lit("AVAILABLE")).alias("availability"),
        F.when(why.isNull(), value).alias("value"),
        why.alias("reason"),
    )


def feature_values(run: DataFrame) -> DataFrame:
    """Raw values at every row of every run; ``run`` comes from a runs function and align_benchmark."""
    w = Window.partitionBy(*RUN).orderBy("pos")
    base = run
    for price in ("high", "low", "close"):
        base = base.withColumn(f"__{price}", F.col(price).cast("double"))
    if "b_close" not in run.columns:
        base = base.withColumn("b_close", F.lit(None).cast("double")).withColumn("b_volume", F.lit(None).cast("long"))
    prior = w.rowsBetween(-20, -1)
    volume, money = F.col("volume").cast("double"), F.col("__close") * F.col("volume").cast("double")
    previous = F.lag("__close").over(w)
    first = {
        "__previous": previous,
        "__tr": F.when(F.col("pos") > 1, F.greatest(F.col("__high") - F.col("__low"), F.abs(F.col("__high") - previous), F.abs(F.col("__low") - previous))),
        "v_priorHigh20": F.max("__high").over(prior),
        "v_priorLow20": F.min("__low").over(prior),
        "__volume_mean": F.avg(volume).over(prior),
        "v_monetaryLiquidity20Idr": F.avg(money).over(prior),
        "v_dailyValueProxyIdr": money,
        **{f"__close_{n}": F.lag("__close", n).over(w) for n in (20, 60)},
        **{f"__b_{n}": F.lag("b_close", n).over(w) for n in (20, 60)},
        **{f"__aligned_{n}": F.count("b_close").over(w.rowsBetween(-n, 0)) for n in (20, 60)},
        "__traded": F.count(F.when(F.col("b_volume") > 0, 1)).over(w.rowsBetween(-20, 0)),
    }
    marks = [c for c in ("volume_unit", "volume_basis", "market_segment") if c in run.columns]
    if marks:
        kind, window = F.struct(*marks), w.rowsBetween(-20, 0)
        first["__one_basis"] = F.min(kind).over(window) == F.max(kind).over(window)
    if "volume_cleared" in run.columns:
        first["__all_cleared"] = F.min(F.col("volume_cleared").cast("int")).over(w.rowsBetween(-20, 0)) == 1
    plans = {
        "ema20": smoothing_stages("ema20", F.col("__close"), F.col("pos"), 20, 2 / 21, RUN, "pos"),
        "ema50": smoothing_stages("ema50", F.col("__close"), F.col("pos"), 50, 2 / 51, RUN, "pos"),
        "atr14": smoothing_stages("atr14", F.col("__tr"), F.col("pos") - 1, 14, 1 / 14, RUN, "pos"),
    }
    out = base.withColumns(first)
    for stage in range(4):
        out = out.withColumns({k: v for stages, _ in plans.values() for k, v in stages[stage].items()})
    out = out.withColumns({f"v_{name}": value for name, (_, value) in plans.items()})
    ratio = lambda a, b: F.try_divide(F.col(a), F.col(b))
    return out.withColumns({
        "v_changePercent": 100 * (ratio("__close", "__previous") - 1),
        "v_atrPercent": 100 * F.try_divide(F.col("v_atr14"), F.col("__close")),
        "v_distanceToHighPercent": 100 * (F.try_divide(F.col("__close"), F.col("v_priorHigh20")) - 1),
        "v_volumeRatio20": F.try_divide(volume, F.col("__volume_mean")),
        **{f"v_rs{n}Pp": 100 * ((ratio("__close", f"__close_{n}") - 1) - (ratio("b_close", f"__b_{n}") - 1)) for n in (20, 60)},
        "v_relativePerformance20": F.when(
            F.col("__traded") == 21, F.try_divide(ratio("__close", "__close_20"), ratio("b_close", "__b_20")) - 1),
    })


def features(run: DataFrame, index: Column | None = None, volume_reason: Column | None = None, latest: bool = False) -> DataFrame:
    """Thirteen state structs (availability, value, reason) at every row of every run, or the last row only."""
    values = feature_values(run)
    index = F.lit(False) if index is None else index
    unverified = F.lit("VOLUME_BASIS_UNVERIFIED")
    window = F.lit(None).cast("string") if volume_reason is None else volume_reason
    if "__one_basis" in values.columns:
        window = F.coalesce(window, F.when(~F.col("__one_basis"), unverified))
    current = F.lit(None).cast("string") if volume_reason is None else volume_reason
    if "__all_cleared" in values.columns:
        window = F.coalesce(window, F.when(~F.col("__all_cleared"), unverified))
        current = F.coalesce(current, F.when(~F.col("volume_cleared"), unverified))
    reasons = {
        "volumeRatio20": window, "monetaryLiquidity20Idr": window, "dailyValueProxyIdr": current,
        **{f"rs{n}Pp": F.when(F.col(f"__aligned_{n}") < n + 1, F.lit("BENCHMARK_MISSING")) for n in (20, 60)},
    }
    na = F.struct(F.lit("UNAVAILABLE").alias("availability"), F.lit(None).cast("double").alias("value"), F.lit("NOT_APPLICABLE_TO_INDEX").alias("reason"))

    def column(name: str, minimum: int) -> Column:
        state = _state(minimum, F.col(f"v_{name}"), reasons.get(name))
        return F.when(index, na).otherwise(state) if name in NOT_FOR_INDEX else state

    if latest:
        tail = Window.partitionBy("instrument_id")
        values = values.withColumn("__newest", F.max("session_date").over(tail)).where(F.col("session_date") == F.col("__newest"))
    return values.select(
        "instrument_id", "session_date", "run_id", F.col("pos").alias("sessions"), F.col("__close").alias("close"), "volume",
        *[column(name, minimum).alias(name) for name, minimum in MINIMUM_SESSIONS.items()],
    )


def trend(close: Column, ema20: Column, ema50: Column) -> Column:
    return first_reason(
        (close.isNull() | ema20.isNull() | ema50.isNull(), "UNKNOWN"),
        ((close > ema20) & (ema20 > ema50), "POSITIVE"), ((close < ema20) & (ema20 < ema50), "NEGATIVE"),
        otherwise="NEUTRAL",
    )


def volatility(atr_percent: Column) -> Column:
    return first_reason((atr_percent.isNull(), "UNKNOWN"), (atr_percent >= 2, "ELEVATED"), otherwise="NORMAL")


def clearance_history(days: DataFrame) -> DataFrame:
    """Per-day price clearance: a closed day is bridged unless it breaks; a known break or an
    unresolved day clears the run. ``days`` has instrument_id, session_date, closed, broken, cleared."""
    w = Window.partitionBy("instrument_id").orderBy("session_date").rowsBetween(Window.unboundedPreceding, 0)
    resets = F.col("broken") | (~F.col("closed") & ~F.col("cleared"))
    parts = days.withColumn("clear_run", F.sum(resets.cast("long")).over(w))
    run = Window.partitionBy("instrument_id", "clear_run").orderBy("session_date").rowsBetween(Window.unboundedPreceding, 0)
    counts = ~resets & ~F.col("closed")
    return parts.withColumn("cleared_sessions", F.sum(counts.cast("long")).over(run)).withColumn(
        "state", first_reason((F.col("broken"), "KNOWN_BREAK"), (resets, "UNRESOLVED"), otherwise="CLEARED")
    )
