"""Exchange-day evidence, session gates and per-instrument day verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import LOCAL_ZONE, first_reason, independent_reference, local_date
from tidemark.operators.pit import instant, latest_or_conflict
from tidemark.operators.scan import asof_lookup

# Fixed values.
CLOSED = ("Weekend", "AnnouncedClosed", "ExceptionalClosure")
SAFE_CUTOFF = "19:00"


def weekend(day: str = "session_date") -> Column:
    return F.weekday(day) >= 5


def classify(day: str, status: Column) -> Column:
    """Explicit evidence wins; without it a weekend is closed and anything else unknown."""
    return F.coalesce(status, F.when(weekend(day), F.lit("Weekend")).otherwise(F.lit("Unknown")))


def classify_days(dates: DataFrame, proofs: DataFrame, day: str = "session_date") -> DataFrame:
    known = proofs.select(F.col(day), F.col("status").alias("__status"))
    return dates.join(known, day, "left").withColumn("day_status", classify(day, F.col("__status"))).drop("__status")


def gate_reason(day: str, at: Column, cutoff_time: str = SAFE_CUTOFF, zone: str = LOCAL_ZONE) -> Column:
    """Nine ordered verdicts over the proof columns status, reference, known_at, completed_at."""
    local = F.from_utc_timestamp(at, zone)
    today, d = F.to_date(local), F.col(day)
    absent = F.col("status").isNull()
    usable = independent_reference("reference") & (F.col("known_at") <= at)
    completed = F.col("completed_at")
    incomplete = completed.isNull() | (completed > F.col("known_at")) | (local_date(completed, zone) != d)
    return first_reason(
        (d > today, "FUTURE_DATE"),
        ((d == today) & (F.date_format(local, "HH:mm") < cutoff_time), "SAFE_EOD_CUTOFF_NOT_REACHED"),
        (absent & weekend(day), "CLOSED_BY_CALENDAR"),
        (absent, "SESSION_PROOF_REQUIRED"),
        (~usable, "INDEPENDENT_ALREADY_KNOWN_PROOF_REQUIRED"),
        (F.col("status").isin(*CLOSED[1:]), "KNOWN_CLOSED"),
        (F.col("status") != "ObservedTrading", "SESSION_PROOF_REQUIRED"),
        (d < today, "ELIGIBLE_PRIOR_COMPLETED_SESSION"),
        (incomplete, "COMPLETED_SESSION_EVIDENCE_REQUIRED"),
        otherwise="ELIGIBLE_SAME_DAY_COMPLETED_SESSION",
    )


def session_gate(days: DataFrame, proofs: DataFrame, at, cutoff_time: str = SAFE_CUTOFF, zone: str = LOCAL_ZONE) -> DataFrame:
    """Completed-session verdict of each day; ``proofs`` holds at most one proof per day."""
    joined = days.join(proofs, "session_date", "left")
    return joined.select(*days.columns, gate_reason("session_date", instant(at), cutoff_time, zone).alias("gate"))


def resolve_sessions(dates: DataFrame, proofs: DataFrame, through, cutoff) -> DataFrame:
    """Status and reason of each day from the proofs known at the cutoff."""
    limit = F.lit(through).cast("date")
    latest = latest_or_conflict(
        proofs.where(F.col("session_date") <= limit), ["session_date"], "known_at",
        ["status", "completed_at"], "SESSION_CONFLICT", cutoff, ["reference"],
    ).withColumnRenamed("reason", "__conflict")
    joined = dates.join(latest, "session_date", "left")
    gate = gate_reason("session_date", instant(cutoff))
    passed = gate.startswith("ELIGIBLE_") | (gate == "KNOWN_CLOSED")
    plain = classify("session_date", F.col("status"))
    conflict, after, absent = F.col("__conflict").isNotNull(), F.col("session_date") > limit, F.col("status").isNull()
    return joined.select(
        *dates.columns,
        F.when(conflict | after, F.lit("Unknown")).when(absent | passed, plain).otherwise(F.lit("Unknown")).alias("day_status"),
        F.when(conflict, F.col("__conflict")).when(after, F.lit("AFTER_THROUGH"))
        .when(absent & (plain == "Unknown"), F.lit("SESSION_UNCONFIRMED"))
        .when(~absent & ~passed, gate).alias("reason"),
        F.when(~conflict, F.col("completed_at")).alias("completed_at"),
    )


def collection_eligibility(days: DataFrame, proofs: DataFrame, holidays: DataFrame, now, allow_unproven: bool = False,
                           cutoff_time: str = SAFE_CUTOFF, zone: str = LOCAL_ZONE) -> DataFrame:
    """Whether a session may be collected; equal in spirit to the gate, over all raw proofs of a day."""
    at = instant(now)
    per_day = proofs.groupBy("session_date").agg(
        F.count("*").alias("__proofs"), F.min("status").alias("status"), F.min("reference").alias("reference"),
        F.min("known_at").alias("known_at"), F.min("completed_at").alias("completed_at"),
    )
    joined = days.join(per_day, "session_date", "left").join(
        holidays.select(F.col("holiday_date").alias("session_date"), F.lit(True).alias("__holiday")), "session_date", "left"
    )
    local = F.from_utc_timestamp(at, zone)
    d, none = F.col("session_date"), F.col("__proofs").isNull()
    gate = gate_reason("session_date", at, cutoff_time, zone)
    early = gate.isin("FUTURE_DATE", "SAFE_EOD_CUTOFF_NOT_REACHED", "CLOSED_BY_CALENDAR")
    holiday = F.coalesce("__holiday", F.lit(False))
    opened = F.lit(allow_unproven) & none
    reason = (
        F.when(early, gate)
        .when(opened & holiday, F.lit("CITED_HOLIDAY"))
        .when(opened, F.lit("ELIGIBLE_UNPROVEN_PERSONAL"))
        .when(F.col("__proofs") > 1, F.lit("CONFLICTING_SESSION_PROOF"))
        .otherwise(gate)
    )
    independent = independent_reference("reference") & (F.col("known_at") <= at) & (F.col("__proofs") == 1)
    # A usable proof names the day's state even when the clock refuses collection.
    proof = (
        F.when(gate == "CLOSED_BY_CALENDAR", F.lit("KNOWN_CLOSED"))
        .when(reason == "ELIGIBLE_UNPROVEN_PERSONAL", F.lit("UNPROVEN_PERSONAL"))
        .when(independent & (F.col("status") == "ObservedTrading"), F.lit("KNOWN_OPEN"))
        .when(independent & F.col("status").isin(*CLOSED[1:]), F.lit("KNOWN_CLOSED"))
        .otherwise(F.lit("UNKNOWN_SESSION"))
    )
    return joined.select(*days.columns, proof.alias("session_proof"), reason.startswith("ELIGIBLE_").alias("eligible"), reason.alias("reason"))


def latest_trading_day(dates: DataFrame, calendar: DataFrame, holidays: DataFrame, day: str = "as_of") -> DataFrame:
    """Most recent weekday strictly before each date that is not a cited holiday."""
    open_days = calendar.select("session_date").where(~weekend()).join(
        holidays.select(F.col("holiday_date").alias("session_date")), "session_date", "left_anti"
    ).select(F.lit(1).alias("__one"), F.col("session_date").alias("latest_trading_day"))
    probes = dates.select(*dates.columns, F.lit(1).alias("__one"), F.date_sub(day, 1).alias("__before"))
    return asof_lookup(probes, open_days, ["__one"], "__before", "latest_trading_day", [], block="year").drop("__one", "__before")


def pending_sessions(latest: DataFrame, gates: DataFrame, today) -> DataFrame:
    """Per key: how many eligible sessions lie strictly between its newest session and today, and the
    first day after it that is not known closed. ``gates`` is one calendar table, one row per day."""
    limit = F.lit(today).cast("date")
    upto = Window.orderBy("session_date").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.orderBy("session_date").rowsBetween(1, Window.unboundedFollowing)
    # The calendar has one row per civil day, so this single ordered pass stays small.
    before_today = gates.where(F.col("session_date") < limit).select(
        F.col("session_date").alias("latest_session"),
        F.sum(F.col("eligible").cast("long")).over(upto).alias("__upto"),
        F.min(F.when(F.col("session_proof") != "KNOWN_CLOSED", F.col("session_date"))).over(after).alias("next_candidate"),
    )
    total = gates.where(F.col("session_date") < limit).agg(F.sum(F.col("eligible").cast("long")).alias("__all"))
    return latest.join(before_today, "latest_session", "left").crossJoin(F.broadcast(total)).select(  # one row
        *latest.columns, (F.col("__all") - F.col("__upto")).alias("pending"), "next_candidate"
    )


def boundary_of(listed: Column, delisted: Column, day: Column) -> Column:
    return first_reason(
        (day < listed, "PRE_LISTING"), (day > delisted, "POST_DELISTING"), (listed.isNull(), "UNKNOWN_BOUNDARY"),
        otherwise="EXPECTED_SESSION",
    )


def boundaries_as_of(boundaries: DataFrame, cutoff) -> DataFrame:
    """Listing dates per instrument; only VERIFIED evidence supplies dates, contradictions supply none."""
    latest = latest_or_conflict(
        boundaries, ["instrument_id"], "known_at", ["status", "listed_from", "delisted_at", "first_trading_date", "retrieved_at"],
        "BOUNDARY_CONFLICT", cutoff,
    )
    verified = F.col("status") == "VERIFIED"
    return latest.select(
        "instrument_id", F.col("status").alias("boundary_status"), "retrieved_at",
        F.when(verified, F.col("listed_from")).alias("listed_on"),
        F.when(verified, F.col("delisted_at")).alias("delisted_on"), F.col("reason").alias("boundary_reason"),
    )


def boundary_state(rows: DataFrame, boundaries: DataFrame, cutoff) -> DataFrame:
    known = boundaries_as_of(boundaries, cutoff)
    state = boundary_of(F.col("listed_on"), F.col("delisted_on"), F.col("session_date"))
    return rows.join(known.select("instrument_id", "listed_on", "delisted_on", "boundary_reason"), "instrument_id", "left").withColumn(
        "boundary_state", F.coalesce("boundary_reason", state)
    ).drop("boundary_reason")


def classify_availability(grid: DataFrame, bars: DataFrame) -> DataFrame:
    """Boundary first, then session status, then presence of a provider row.

    ``grid`` carries listed_on, delisted_on and session_status (Trading, Holiday, Suspension, NoTrade).
    """
    present = bars.select("instrument_id", "session_date").distinct().withColumn("__row", F.lit(True))
    joined = grid.join(present, ["instrument_id", "session_date"], "left")
    boundary = boundary_of(F.col("listed_on"), F.col("delisted_on"), F.col("session_date"))
    trading = F.col("session_status") == "Trading"
    return joined.withColumn(
        "availability",
        first_reason(
            (boundary == "PRE_LISTING", "PreListing"), (boundary == "POST_DELISTING", "PostDelisting"),
            (F.col("session_status") == "Holiday", "Holiday"), (F.col("session_status") == "Suspension", "Suspension"),
            (F.col("session_status") == "NoTrade", "NoTrade"), (trading & F.col("__row"), "Available"),
            (trading & F.col("listed_on").isNull(), "Unknown"), (trading, "MissingProviderRow"), otherwise="Unknown",
        ),
    ).drop("__row")


def observation_verdict(grid: DataFrame, bars: DataFrame, proofs: DataFrame, instrument_proofs: DataFrame, at, benchmark: str | None = None) -> DataFrame:
    """Verdict and reason per (instrument, date). ``grid`` carries listed_on, delisted_on, source_error."""
    now = instant(at)
    own = F.col("instrument_id").eqNullSafe(F.lit(benchmark))
    rows = bars.select("instrument_id", "session_date", F.col("volume").alias("__volume"), F.col("market_segment").alias("__segment"))
    day = proofs.select("session_date", F.col("status").alias("__status"), F.col("reference").alias("__ref"), F.col("known_at").alias("__known"))
    special = instrument_proofs.where(F.col("known_at") <= now).select(
        "instrument_id", "session_date", F.col("status").alias("__special"))
    joined = grid.join(rows, ["instrument_id", "session_date"], "left").join(day, "session_date", "left").join(
        special, ["instrument_id", "session_date"], "left")
    boundary = boundary_of(F.col("listed_on"), F.col("delisted_on"), F.col("session_date"))
    status, absent = F.col("__status"), F.col("__status").isNull()
    no_row, unlisted = F.col("__volume").isNull(), F.col("listed_on").isNull()
    verdict = first_reason(
        (boundary == "PRE_LISTING", "PRE_LISTING"), (boundary == "POST_DELISTING", "POST_DELISTING"),
        (absent & weekend(), "CLOSED"),
        (absent | (F.col("__known") > now) | (F.trim("__ref") == ""), "SESSION_UNCONFIRMED"),
        (status.isin(*CLOSED[1:]), "CLOSED"), (status != "ObservedTrading", "SESSION_UNCONFIRMED"),
        (~own & (F.col("__special") == "Suspension"), "SUSPENDED"), (~own & (F.col("__special") == "NoTrade"), "NO_TRADE"),
        (F.col("source_error"), "SOURCE_ERROR"), (no_row & unlisted, "UNKNOWN"), (no_row, "MISSING"),
        ((F.col("__volume") == 0) & ~own, "UNKNOWN"), otherwise="AVAILABLE",
    )
    v = F.col("verdict")
    reason = first_reason(
        ((v == "CLOSED") & absent, "CLOSED_BY_CALENDAR"),
        ((v == "UNKNOWN") & no_row, "Listing boundary unknown."),
        (v == "UNKNOWN", "Zero volume does not establish tradable/no-trade/suspension status."),
        ((v == "AVAILABLE") & own, "Index price observation; volume/tradability not applicable."),
        ((v == "AVAILABLE") & (F.col("__segment") == "UNKNOWN"), "Market segment unresolved; pilot evidence only."),
    )
    return joined.withColumn("verdict", verdict).select(*grid.columns, "verdict", reason.alias("verdict_reason"))
