"""Point-in-time selection: what was known at a cutoff about dates up to a limit."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage, shared
from tidemark.operators.scan import asof_lookup, ordered_fold, prefix_scan

BAR_KEYS = ("instrument_id", "session_date")
CLOCKS = ("known_at", "fetched_at", "retrieved_at", "session_known_at")


def instant(value: datetime | str) -> Column:
    return F.lit(value).cast("timestamp")


def visible(df: DataFrame, cutoff, clocks: Sequence[str] = CLOCKS) -> Column:
    """Every clock the table has must be at or before the cutoff; an absent optional clock passes.

    Clocks stay bare columns so the comparisons reach the Parquet scan.
    """
    at = instant(cutoff)
    test = F.col(clocks[0]) <= at
    for clock in clocks[1:]:
        if clock in df.columns:
            test = test & (F.col(clock).isNull() | (F.col(clock) <= at))
    return test


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Row with the greatest order tuple per key, as an aggregate so map tasks shrink hot keys first."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return picked.select(*keys, "__row.*").select(*df.columns)


def bars_as_of(revisions: DataFrame, cutoff, through: date | str | None = None, ids: DataFrame | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """Latest revision of each bar visible at the cutoff; known_at decides, then revision number.

    ``keep`` names the columns wanted besides keys, known_at and revision_number; the aggregate carries no others.
    """
    seen = revisions.where(visible(revisions, cutoff))
    if through is not None:
        seen = seen.where(F.col("session_date") <= F.lit(through).cast("date"))
    if ids is not None:
        seen = seen.join(ids, "instrument_id", "left_semi")
    if keep is not None:
        seen = seen.select(*dict.fromkeys((*BAR_KEYS, "known_at", "revision_number", *keep)))
    return latest_by(seen, BAR_KEYS, ("known_at", "revision_number"))


def bars_as_of_many(revisions: DataFrame, cutoffs: DataFrame, cutoff: str = "cutoff") -> DataFrame:
    """As-of bars at every cutoff of a table.

    Each revision is assigned to the first cutoff that can see it, revisions sharing that cutoff are
    reduced to one per bar map-side, and the survivor is carried forward over later cutoffs. The
    work is one reduction over the revisions plus the output itself.
    """
    known = F.greatest("known_at", *[c for c in CLOCKS[1:] if c in revisions.columns])
    stops = cutoffs.select(F.col(cutoff).cast("timestamp").alias("__cut")).distinct()
    # Ordinal of a cutoff and of the first cutoff at or after each distinct visibility instant,
    # from one sorted pass over the instants (not over the revisions).
    ordered = stops.select(
        "__cut", F.row_number().over(Window.orderBy("__cut")).cast("int").alias("__n")
    )
    instants = revisions.select(known.alias("__known")).distinct()
    first = asof_lookup(
        instants.select(F.lit(1).alias("__one"), (-F.unix_micros(F.col("__known").cast("timestamp"))).alias("__neg"), F.timestamp_micros(-F.unix_micros(F.col("__known").cast("timestamp"))).alias("__probe_at"), "__known"),
        ordered.select(F.lit(1).alias("__one"), F.timestamp_micros(-F.unix_micros("__cut")).alias("__fact_at"), "__n"),
        ["__one"], "__probe_at", "__fact_at", ["__n"], block="year",
    ).select("__known", "__n")
    total = ordered.agg(F.max("__n").alias("__last"))
    tagged = revisions.withColumn("__known", known).join(first, "__known").where(F.col("__n").isNotNull()).drop("__known")
    reduced = latest_by(tagged, (*BAR_KEYS, "__n"), ("known_at", "revision_number"))
    # At most one row per bar and cutoff from here on. A row that does not improve on the earlier
    # ones is never the answer; each remaining row holds until the next one takes over.
    order = Window.partitionBy(*BAR_KEYS).orderBy("__n")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rank = F.struct("known_at", "revision_number")
    improving = reduced.withColumn("__prior", F.max(rank).over(before)).where(
        F.col("__prior").isNull() | (rank > F.col("__prior"))
    )
    held = improving.drop("__prior").withColumn("__next", F.lead("__n").over(order)).crossJoin(F.broadcast(total))  # one row
    spread = held.withColumn(
        "__n", F.explode(F.sequence(F.col("__n"), F.coalesce(F.col("__next") - 1, F.col("__last"))))
    )
    return spread.join(ordered, "__n").select(F.col("__cut").alias(cutoff), *revisions.columns)


def knowledge_intervals(revisions: DataFrame) -> DataFrame:
    """Validity of each revision in knowledge time: [known_at, next_known_at)."""
    ahead = prefix_scan(
        revisions.withColumn("__back", -F.unix_micros(F.col("known_at").cast("timestamp"))).withColumn("__rback", -F.col("revision_number")),
        BAR_KEYS, ("__back", "__rback"), -F.unix_date(F.trunc(F.to_date("known_at"), "month")),
        {"next_known_at": ("last", F.col("known_at"))},
    )
    return ahead.drop("__back", "__rback")


def revision_history(revisions: DataFrame) -> DataFrame:
    """Every revision with the instant its bar was first seen."""
    first = revisions.groupBy(*BAR_KEYS).agg(F.min("known_at").alias("first_seen_at"))
    return revisions.join(first, list(BAR_KEYS))


#: Revisions up to which a bar is folded in one task; bars with more are folded in segments.
LONG = 1_000_000
NO_NUMBER = -(2**63)


def append_revisions(existing: DataFrame, batch: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Disposition of every batch row against the last accepted revision of its bar: bar keys, arrival, disposition, new_revision_number.

    Equal content is DUPLICATE_IGNORED, an older fetch is STALE_EVIDENCE_IGNORED, knowledge older
    than the accepted revision is KNOWLEDGE_REGRESSED, anything else takes the next number. Rows of
    a bar are taken in (known_at, arrival) order; ``arrival`` is a non-negative long.

    The comparison base depends on earlier decisions, so this is a fold. A bar of ordinary length is shuffled
    once, what is stored with what arrives, and streams through a task; long bars are cut into segments.
    """
    counts = existing.select("instrument_id").unionByName(batch.select("instrument_id")).groupBy("instrument_id").agg(F.count("*").alias("__n"))
    busy = counts.where(F.col("__n") > LONG).select("instrument_id")
    if busy.isEmpty():
        return _append_short(existing, batch, arrival)
    bars = existing.select(*BAR_KEYS).unionByName(batch.select(*BAR_KEYS)).join(F.broadcast(busy), "instrument_id", "left_semi")
    long = F.broadcast(cut_lineage(bars.groupBy(*BAR_KEYS).agg(F.count("*").alias("__n")).where(F.col("__n") > LONG).select(*BAR_KEYS)))  # at most one a million rows
    part = lambda how: [df.join(long, list(BAR_KEYS), how) for df in (existing, batch)]
    return _append_short(*part("left_anti"), arrival).unionByName(_append_long(*part("left_semi"), arrival))


def _append_short(existing: DataFrame, batch: DataFrame, arrival: str) -> DataFrame:
    """The fold in one pass over each partition: stored rows by revision number, then arriving ones."""
    digest = F.col("content_hash")
    # Contents are only compared: a digest travels as its 32 bytes, other text as it is, told apart by the first byte.
    content = F.when(digest.rlike("^[0-9a-f]{64}$"), F.concat(F.unhex(F.lit("01")), F.unhex(digest))).otherwise(F.concat(F.unhex(F.lit("00")), F.encode(digest, "utf-8"))).alias("content")
    facts = [content, *[F.unix_micros(F.col(c).cast("timestamp")).alias(c) for c in ("fetched_at", "known_at")]]
    stored = existing.select(*BAR_KEYS, F.lit(-1).cast("long").alias("arrival"), *facts, F.coalesce(F.col("revision_number").cast("long"), F.lit(NO_NUMBER)).alias("stored"), F.lit(False).alias("new"))
    arriving = batch.select(*BAR_KEYS, F.col(arrival).cast("long").alias("arrival"), *facts, F.lit(NO_NUMBER).alias("stored"), F.lit(True).alias("new"))
    out = "instrument_id string, session_date date, arrival long, disposition string, new_revision_number long"

    def step(state, row):
        *bar, arrived, digest, fetched, known, number, new = row
        if not new:
            return (digest, fetched, known, 0 if number == NO_NUMBER else number), (*bar, arrived, None, None)
        if state is not None:
            if digest == state[0]:
                return state, (*bar, arrived, "DUPLICATE_IGNORED", None)
            if fetched < state[1]:
                return state, (*bar, arrived, "STALE_EVIDENCE_IGNORED", None)
            if known < state[2]:
                return state, (*bar, arrived, "KNOWLEDGE_REGRESSED", None)
        number = 1 if state is None else state[3] + 1
        return (digest, fetched, known, number), (*bar, arrived, "INSERTED" if number == 1 else "REVISION_APPENDED", number)

    rows = stored.unionByName(arriving)
    return ordered_fold(rows, BAR_KEYS, ("new", "stored", "known_at", "arrival"), out, lambda key: None, step).where("disposition IS NOT NULL")


def _append_long(existing: DataFrame, batch: DataFrame, arrival: str) -> DataFrame:
    """The fold of bars with very many revisions, in many independent pieces.

    A row fetched no earlier than everything before it is never stale; two such neighbours with different content mean the
    second is accepted whatever came before. Those rows open a new segment.
    """
    facts = ["content_hash", "fetched_at", "known_at"]
    stored = latest_by(existing.select(*BAR_KEYS, *facts, "revision_number"), BAR_KEYS, ("revision_number",)).select(
        *BAR_KEYS, F.lit(-1).cast("long").alias("arrival"), *facts, F.col("revision_number").cast("long").alias("stored")
    )
    arriving = batch.select(
        *BAR_KEYS, F.col(arrival).cast("long").alias("arrival"), *facts, F.lit(-1).cast("long").alias("stored")
    )
    rows = stored.unionByName(arriving).withColumn(
        "__at", F.when(F.col("arrival") < 0, F.lit("1900-01-01").cast("timestamp")).otherwise(F.col("known_at"))
    )
    order, block = ("__at", "arrival"), F.trunc(F.to_date("__at"), "month")
    scanned = prefix_scan(
        rows, BAR_KEYS, order, block,
        {
            "__top_f": ("max", F.col("fetched_at")),
            "__top_k": ("max", F.col("known_at")),
            "__prev": ("last", F.struct("content_hash", "fetched_at")),
        },
    )
    certain = (
        (F.col("__prev.fetched_at") == F.col("__top_f"))
        & (F.col("fetched_at") >= F.col("__top_f"))
        & (F.col("known_at") >= F.col("__top_k"))
        & (F.col("__prev.content_hash") != F.col("content_hash"))
    )
    marked = shared(scanned.withColumn("__sync", F.coalesce(certain, F.lit(False))).drop("__top_f", "__top_k", "__prev"))
    cut = prefix_scan(
        marked, BAR_KEYS, order, block, {"__segment": ("sum", F.col("__sync").cast("long"))}, inclusive=True
    )
    layout = (*BAR_KEYS, "arrival", *facts, "stored", "__at", "__sync", "__segment")
    out = (
        "instrument_id string, session_date date, arrival long, content_hash string, fetched_at timestamp, "
        "known_at timestamp, stored long, __at timestamp, verdict string"
    )

    def step(state, row):
        *head, _stored, at, sync, _segment = row
        arrived, digest, fetched, known = head[2:6]
        if arrived < 0:
            return (digest, fetched, known), (*head, _stored, at, "STORED")
        if state is None or sync:
            verdict = "ACCEPTED"
        elif digest == state[0]:
            verdict = "DUPLICATE_IGNORED"
        elif fetched < state[1]:
            verdict = "STALE_EVIDENCE_IGNORED"
        elif known < state[2]:
            verdict = "KNOWLEDGE_REGRESSED"
        else:
            verdict = "ACCEPTED"
        return ((digest, fetched, known) if verdict == "ACCEPTED" else state), (*head, _stored, at, verdict)

    folded = shared(ordered_fold(cut.select(*layout), [*BAR_KEYS, "__segment"], order, out, lambda key: None, step))
    accepted = F.col("verdict") == "ACCEPTED"
    numbered = prefix_scan(
        folded, BAR_KEYS, order, block,
        {
            "__accepted": ("sum", accepted.cast("long")),
            "__base": ("last", F.when(F.col("arrival") < 0, F.col("stored"))),
        },
        inclusive=True,
    ).where(F.col("arrival") >= 0)
    number = F.coalesce("__base", F.lit(0)) + F.col("__accepted")
    return numbered.select(
        *BAR_KEYS, "arrival",
        F.when(accepted & (number == 1), F.lit("INSERTED"))
        .when(accepted, F.lit("REVISION_APPENDED")).otherwise(F.col("verdict")).alias("disposition"),
        F.when(accepted, number).alias("new_revision_number"),
    )


def latest_or_conflict(
    df: DataFrame, keys: Sequence[str], clock: str, content: Sequence[str], reason: str, cutoff=None, keep: Sequence[str] = ()
) -> DataFrame:
    """Content known latest per key; different contents at that same instant select nothing.

    Contents are reduced per (key, clock, content) first, so repeated evidence shrinks map-side.
    """
    seen = df if cutoff is None else df.where(F.col(clock) <= instant(cutoff))
    keep = [c for c in keep if c not in content]
    latest = seen.groupBy(*keys).agg(F.max(clock).alias(clock))
    body = F.struct(*content)
    top = seen.join(latest, [*keys, clock]).groupBy(*keys, clock).agg(
        F.min(body).alias("__low"), F.max(body).alias("__high"), *[F.min(c).alias(c) for c in keep]
    )
    conflict = ~F.col("__low").eqNullSafe(F.col("__high"))
    return top.select(
        *keys, clock,
        *[F.when(~conflict, F.col(f"__low.{c}")).alias(c) for c in content],
        *[F.when(~conflict, F.col(c)).alias(c) for c in keep],
        F.when(conflict, F.lit(reason)).alias("reason"),
    )


def select_references(df: DataFrame, keys: Sequence[str], cutoff, date_column: str | None = None, anchor=None, through=None, ids: DataFrame | None = None) -> DataFrame:
    """Distinct evidence rows at the latest visible instant per key, inside the requested dates and ids."""
    seen = df.where(F.col("known_at") <= instant(cutoff))
    if date_column is not None:
        seen = seen.where(F.col(date_column).between(F.lit(anchor).cast("date"), F.lit(through).cast("date")))
    if ids is not None:
        seen = seen.join(ids, "instrument_id", "left_semi")
    seen = seen.distinct()
    latest = seen.groupBy(*keys).agg(F.max("known_at").alias("known_at"))
    return seen.join(latest, [*keys, "known_at"]).select(*df.columns)


def interval_conflicts(facts: DataFrame, keys: Sequence[str], start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Keys with any overlap between inclusive intervals (an open end overlaps everything after it)."""
    ordered = facts.withColumn("__end", F.coalesce(F.col(end), F.lit(date(9999, 12, 31)))).withColumn(
        "__tie", F.xxhash64(F.struct(*facts.columns))
    )
    scanned = prefix_scan(
        ordered, keys, (start, "__end", "__tie"), F.trunc(start, "month"), {"__reach": ("max", F.col("__end"))}
    )
    return scanned.where(F.col("__reach") >= F.col(start)).select(*keys).distinct()


def interval_lookup(facts: DataFrame, dates: DataFrame, keys: Sequence[str], day: str, payload: Sequence[str], start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Fact covering each date; any overlap within the key refuses it, no cover is reported as missing."""
    broken = interval_conflicts(facts, keys, start, end).withColumn("__broken", F.lit(True))
    clean = facts.join(broken.drop("__broken"), list(keys), "left_anti").select(*keys, start, end, *payload)
    hit = asof_lookup(dates, clean, keys, day, start, [end, *payload])
    covered = F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(end) >= F.col(day)))
    known = hit.join(broken, list(keys), "left")
    return known.select(
        *dates.columns,
        *[F.when(covered, F.col(c)).alias(c) for c in payload],
        F.when(F.col("__broken"), F.lit("REFERENCE_INTERVAL_CONFLICT"))
        .when(~covered, F.lit("REFERENCE_INTERVAL_MISSING")).alias("reason"),
    )


def resolve_symbols(instruments: DataFrame, history: DataFrame, listings: DataFrame, through) -> DataFrame:
    """Effective symbol per instrument with its source: history, listing evidence, issuer name."""
    on = F.lit(through).cast("date")
    effective = history.where((F.col("valid_from") <= on) & (F.col("valid_to").isNull() | (F.col("valid_to") >= on)))
    picked = effective.groupBy("instrument_id").agg(F.max_by("symbol", "valid_from").alias("__symbol"))
    joined = instruments.select("instrument_id").join(picked, "instrument_id", "left").join(listings, "instrument_id", "left")
    return joined.select(
        "instrument_id",
        F.coalesce("__symbol", "listing_symbol", "issuer_name").alias("symbol"),
        F.when(F.col("__symbol").isNotNull(), F.lit("REGISTRY_HISTORY"))
        .when(F.col("listing_symbol").isNotNull(), F.lit("RETAINED_LISTING"))
        .otherwise(F.lit("UNAVAILABLE")).alias("symbol_source"),
    )


def resolve_instruments(rows: DataFrame, history: DataFrame, symbol: str = "symbol", day: str = "trade_date") -> DataFrame:
    """Instrument a symbol denotes on a date: RESOLVED when exactly one, else UNKNOWN or AMBIGUOUS.

    Covering intervals are counted by a running sum of openings minus closings per symbol, and the
    running sum of instrument numbers names the one left open when the count is one. No
    (row, interval) pair is formed, however many intervals share a symbol.
    """
    numbered = history.select("symbol", "instrument_id", "valid_from", "valid_to").distinct().withColumn(
        "__id", F.xxhash64("symbol", "instrument_id").cast("decimal(38,0)")
    )
    opened = numbered.select("symbol", F.col("valid_from").alias("__at"), F.lit(1).alias("__n"), "__id")
    closed = numbered.where("valid_to is not null").select(
        "symbol", F.date_add("valid_to", 1).alias("__at"), F.lit(-1).alias("__n"), (-F.col("__id")).alias("__id")
    )
    # One row per symbol and day of change: its net effect.
    changes = opened.unionByName(closed).groupBy("symbol", "__at").agg(
        F.sum("__n").alias("__n"), F.sum("__id").cast("decimal(38,0)").alias("__id")
    )
    standing = prefix_scan(
        changes, ["symbol"], ["__at"], F.trunc("__at", "month"),
        {"__open": ("sum", F.col("__n")), "__sum": ("sum", F.col("__id"))}, inclusive=True,
    ).select("symbol", "__at", "__open", "__sum")
    # Many rows share a (symbol, day): look each pair up once.
    pairs = rows.select(F.col(symbol).alias("symbol"), F.col(day).alias("__day")).distinct()
    hit = asof_lookup(pairs, standing, ["symbol"], "__day", "__at", ["__open", "__sum"])
    names = numbered.select("symbol", F.col("__id").alias("__sum"), "instrument_id").distinct()
    named = hit.join(names.withColumnRenamed("symbol", "__s"), (F.col("symbol") == F.col("__s")) & (F.col("__open") == 1) & (hit["__sum"] == names["__sum"]), "left")
    count = F.coalesce("__open", F.lit(0)).cast("long")
    resolved = named.select(
        F.col("symbol").alias(symbol), F.col("__day").alias(day), "instrument_id",
        count.alias("matches"),
        F.when(count == 0, F.lit("UNKNOWN")).when(count == 1, F.lit("RESOLVED")).otherwise(F.lit("AMBIGUOUS")).alias("resolution"),
    )
    return rows.join(resolved, [symbol, day], "left")


def symbol_overlaps(history: DataFrame) -> DataFrame:
    """History rows that begin while an earlier row of the same symbol is still effective."""
    ordered = history.withColumn("__end", F.coalesce("valid_to", F.lit(date(9999, 12, 31))))
    scanned = prefix_scan(
        ordered, ["symbol"], ("valid_from", "__end", "instrument_id"), F.trunc("valid_from", "month"),
        {"earlier_reach": ("max", F.col("__end"))},
    )
    return scanned.where(F.col("earlier_reach") >= F.col("valid_from")).drop("__end")
