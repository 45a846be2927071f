"""Bar validation and admission, price and volume basis, registry search and history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import decimal_state, is_sha256, reasons_where
from tidemark.operators.pit import bars_as_of, interval_conflicts, latest_by


def validate_bars(df: DataFrame) -> DataFrame:
    """Adds ``violations``, the bar invariants that fail, in order."""
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    meta = [m for m in ("volume_unit", "volume_basis", "market_segment") if m in df.columns]
    checks = [
        (F.least(o, h, low, c) <= 0, "NON_POSITIVE_PRICE"),
        ((h < o) | (h < c) | (h < low), "HIGH_NOT_HIGHEST"),
        ((low > o) | (low > c), "LOW_NOT_LOWEST"),
        (F.col("volume") < 0, "NEGATIVE_VOLUME"),
    ]
    if "adjusted_close" in df.columns:
        checks.append((F.col("adjusted_close") <= 0, "NON_POSITIVE_ADJUSTED_CLOSE"))
    for m in meta:
        checks.append((F.col(m).isNull() | (F.trim(m) == ""), f"BLANK_{m.upper()}"))
    return df.withColumn("violations", reasons_where(*checks))


def admit_bars(df: DataFrame) -> DataFrame:
    """Adds ``reason`` (null when admitted) for stored bars whose prices are kept as text."""
    prices = ("open", "high", "low", "close")
    text = (*prices, "adjusted_close")
    # Text checks become columns first, so each price is parsed once.
    x = df.withColumns({f"__s_{c}": F.when(F.col(c).isNotNull() | F.lit(c != "adjusted_close"), decimal_state(c)) for c in text})
    # A text that is no number is told by its state; casting it would cost an exception each.
    x = x.withColumns({f"__n_{c}": F.when(F.col(f"__s_{c}") == "OK", F.col(c).try_cast("double")) for c in text})
    x = x.withColumn("__number", F.coalesce(*[F.nullif(F.col(f"__s_{c}"), F.lit("OK")) for c in text]))
    number = F.col("__number")
    o, h, low, c = (F.col(f"__n_{p}") for p in prices)
    broken = (
        (F.least(o, h, low, c) <= 0) | (h < o) | (h < c) | (h < low) | (low > o) | (low > c) | (F.col("volume") < 0)
        | F.coalesce(F.col("__n_adjusted_close") <= 0, F.lit(False))
        | (F.trim("volume_unit") == "") | (F.trim("volume_basis") == "") | (F.trim("market_segment") == "")
    )
    unproven = (
        F.col("retrieved_at").isNull() | F.col("session_known_at").isNull()
        | F.col("session_reference").isNull() | (F.trim("session_reference") == "")
        | (F.col("fetched_at") > F.col("retrieved_at")) | (F.col("retrieved_at") > F.col("known_at"))
        | (F.col("session_known_at") > F.col("known_at")) | (F.col("revision_number") <= 0)
    )
    reason = (
        F.when(~F.col("quality").isin("VALID", "DEGRADED", "STALE"), F.lit("CANONICAL_QUALITY_UNAVAILABLE"))
        .when(unproven, F.lit("CANONICAL_PROVENANCE_UNAVAILABLE"))
        .when(number.isNotNull(), number)
        .when(broken | ~is_sha256("content_hash"), F.lit("CANONICAL_INVALID"))
    )
    return x.select(*df.columns, reason.alias("reason"))


def _with_intervals(bars: DataFrame, families: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Adds what covers each bar, for each tag a table of intervals and the fields wanted of it.

    Bars and the intervals of all tables are dealt by instrument once and scanned in the order of their days. An
    instrument has one bar a session, so what is scanned in one piece is as long as the calendar.
    """
    merged = bars.withColumns({"__at": F.col("session_date"), "__side": F.lit(1)})
    for tag, (table, fields) in families.items():
        facts = table.where("instrument_id IS NOT NULL").select("instrument_id", "valid_from", "valid_to", *fields)
        broken = interval_conflicts(facts, ["instrument_id"])
        clean = facts.join(broken, "instrument_id", "left_anti")
        fact = F.struct("valid_from", "valid_to", *fields)
        merged = merged.unionByName(
            clean.select("instrument_id", F.col("valid_from").alias("__at"), F.lit(0).alias("__side"), fact.alias(f"__{tag}")), allowMissingColumns=True)
        # A conflict stands before all days of its instrument.
        merged = merged.unionByName(
            broken.select("instrument_id", F.lit(None).cast("date").alias("__at"), F.lit(-1).alias("__side"), F.lit(True).alias(f"__{tag}_broken")), allowMissingColumns=True)
    upto = Window.partitionBy("instrument_id").orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(c, ignorenulls=True).over(upto).alias(c)
    x = merged.select(*bars.columns, "__side", *[last(c) for tag in families for c in (f"__{tag}", f"__{tag}_broken")]).where("__side = 1")
    out = []
    for tag, (_, fields) in families.items():
        hit, day = F.col(f"__{tag}"), F.col("session_date")
        covered = F.coalesce((hit["valid_from"] <= day) & (hit["valid_to"].isNull() | (hit["valid_to"] >= day)), F.lit(False))
        out += [F.when(covered, hit["valid_from"]).alias(f"{tag}_interval_from"), *[F.when(covered, hit[c]).alias(f"{tag}_{c}") for c in fields]]
        out.append(F.when(F.col(f"__{tag}_broken"), F.lit("REFERENCE_INTERVAL_CONFLICT")).when(~covered, F.lit("REFERENCE_INTERVAL_MISSING")).alias(f"{tag}_reason"))
    return x.select(*bars.columns, *out)


def _listed(df: DataFrame, listed: DataFrame, tag: str) -> DataFrame:
    """Marks bars whose content hash the covering interval lists; hashes are rows, not one big array."""
    names = listed.select(
        "instrument_id", F.col("valid_from").alias(f"{tag}_interval_from"), "content_hash", F.lit(True).alias(f"{tag}_listed")
    ).distinct()
    return df.join(names, ["instrument_id", f"{tag}_interval_from", "content_hash"], "left")


def clear_price_basis(bars: DataFrame, prices: DataFrame, identities: DataFrame, listed: DataFrame) -> DataFrame:
    """Adds ``price_reason``: null when the covering price interval clears the bar. ``bars`` are admitted bars."""
    x = _with_intervals(bars, {"identity": (identities, ["classification", "currency"]), "price": (prices, ["source_id", "convention", "continuity", "event_coverage"])})
    index = F.col("identity_classification") == "INDEX"
    cleared = (
        (F.col("price_continuity") == "RAW_AS_TRADED")
        & F.when(index, F.col("price_event_coverage").isin("CLEARED", "NOT_APPLICABLE")).otherwise(F.col("price_event_coverage") == "CLEARED")
        & (index | ((F.col("identity_currency") == "IDR") & (F.col("volume") > 0)))
        & (F.col("price_source_id") == F.col("source_id"))
        & (F.col("price_convention") == F.when(index, F.lit("INDEX_LEVEL")).otherwise(F.lit("STOCK_RAW")))
        & F.col("reason").isNull()
    )
    typed = F.col("identity_classification").isin("ORDINARY", "INDEX")
    why = (
        F.when(F.col("identity_reason").isNotNull(), F.col("identity_reason"))
        .when(~typed, F.lit("IDENTITY_UNVERIFIED"))
        .when(F.col("price_reason").isNotNull(), F.col("price_reason"))
        .when(~F.coalesce(cleared, F.lit(False)), F.lit("PRICE_BASIS_UNVERIFIED"))
    )
    # What else decides is settled first, so that the join carries two columns of it.
    x = _listed(x.select(*bars.columns, "price_interval_from", why.alias("__why")), listed, "price")
    return x.select(*bars.columns, F.when(F.col("__why").isNotNull(), F.col("__why")).when(F.col("price_listed").isNull(), F.lit("PRICE_BASIS_UNVERIFIED")).alias("price_reason"))


def clear_volume_basis(bars: DataFrame, volumes: DataFrame, identities: DataFrame, listed: DataFrame) -> DataFrame:
    """Adds ``volume_reason``: null when the covering volume interval clears the bar."""
    fields = ["source_id", "unit", "basis", "raw_price_compatible", "currency", "market_segment"]
    # "span" keeps the interval's unit and basis apart from the bar's own.
    x = _with_intervals(bars, {"identity": (identities, ["classification", "currency"]), "span": (volumes, fields)})
    cleared = (
        F.col("identity_reason").isNull() & (F.col("identity_classification") == "ORDINARY") & (F.col("identity_currency") == "IDR")
        & (F.col("span_currency") == "IDR") & F.col("span_raw_price_compatible")
        & F.col("span_unit").isin("SHARES", "SHARE_COUNT_CORROBORATED")
        & (F.col("span_basis") != "UNKNOWN") & (F.col("span_market_segment") != "UNKNOWN")
        & (F.col("span_source_id") == F.col("source_id")) & (F.col("span_unit") == F.col("volume_unit"))
        & (F.col("span_basis") == F.col("volume_basis")) & (F.col("span_market_segment") == F.col("market_segment"))
        & (F.col("volume") > 0) & F.col("reason").isNull()
    )
    why = F.when(F.col("span_reason").isNotNull(), F.col("span_reason")).when(
        ~F.coalesce(cleared, F.lit(False)), F.lit("VOLUME_BASIS_UNVERIFIED"))
    x = _listed(x.select(*bars.columns, "span_interval_from", why.alias("__why")), listed, "span")
    return x.select(*bars.columns, F.when(F.col("__why").isNotNull(), F.col("__why")).when(F.col("span_listed").isNull(), F.lit("VOLUME_BASIS_UNVERIFIED")).alias("volume_reason"))


def search_instruments(instruments: DataFrame, bars: DataFrame, text: str) -> DataFrame:
    """Case-insensitive substring match on symbol or issuer, with each match's newest visible bar.

    ``instruments`` has instrument_id, symbol, issuer_name; ``bars`` are as-of bars.
    """
    needle = text.strip().lower()
    hit = F.lower("symbol").contains(needle) | F.lower("issuer_name").contains(needle)
    found = instruments.where(hit)
    newest = bars.join(found.select("instrument_id"), "instrument_id", "left_semi").groupBy("instrument_id").agg(
        F.max("session_date").alias("market_date"), F.max_by("close", "session_date").alias("close")
    )
    return found.join(newest, "instrument_id", "left")


def stock_history(revisions: DataFrame, through, cutoff, limit: int, keep: Sequence[str] | None = None) -> DataFrame:
    """Last ``limit`` visible sessions per instrument, oldest first, invalid rows kept with their reason.

    Bars are judged where they are read; of the other columns only those in ``keep`` (all unless given) are shuffled.
    """
    seen = bars_as_of(admit_bars(revisions), cutoff, through, keep=None if keep is None else (*keep, "reason"))
    newest = Window.partitionBy("instrument_id").orderBy(F.desc("session_date"))
    kept = seen.withColumn("__rank", F.row_number().over(newest)).where(F.col("__rank") <= limit)
    forward = Window.partitionBy("instrument_id").orderBy("session_date")
    return kept.withColumn("position", F.row_number().over(forward)).drop("__rank")


def latest_market_state(instruments: DataFrame, revisions: DataFrame, through, cutoff) -> DataFrame:
    """Newest visible bar per instrument at or before ``through``; instruments without one stay, with nulls."""
    seen = revisions.where(F.col("session_date") <= F.lit(through).cast("date"))
    best = latest_by(
        bars_as_of(seen, cutoff), ("instrument_id",), ("session_date",)
    ).withColumnRenamed("session_date", "market_date")
    return instruments.join(best, "instrument_id", "left")


def fetch_retained(links: DataFrame, revisions: DataFrame) -> DataFrame:
    """Exactly the linked revisions; a link without its row is INPUT_NOT_AVAILABLE."""
    keys = ["instrument_id", "session_date", "revision_number"]
    stored = revisions.select(*keys, "content_hash", "close").withColumn("__found", F.lit(True))
    joined = links.join(stored, keys, "left")
    return joined.withColumn("state", F.when(F.col("__found"), F.lit("RETAINED")).otherwise(F.lit("INPUT_NOT_AVAILABLE"))).drop("__found")
