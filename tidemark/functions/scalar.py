"""Column functions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
LOCAL_ZONE = "Asia/Jakarta"
PROVIDER_HOST = "eodhd.com"
EPISODE_POLICY = "screener-v0.1.0"
DECIMAL_LIMIT = 79228162514264337593543950335.0  # largest 96-bit decimal


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def normalize_symbol(value) -> Column:
    """Trimmed upper-case symbol, or null when it is not 1..32 of A-Z 0-9 . - _"""
    text = F.upper(F.trim(_c(value)))
    return F.when(text.rlike(r"^[A-Z0-9._-]{1,32}$"), text)


def local_date(at, zone: str = LOCAL_ZONE) -> Column:
    return F.to_date(F.from_utc_timestamp(_c(at), zone))


def end_of_local_day(at, zone: str = LOCAL_ZONE) -> Column:
    """First instant after the local civil day of ``at``."""
    return F.to_utc_timestamp(F.date_add(local_date(at, zone), 1).cast("timestamp"), zone)


def local_day_start(day, zone: str = LOCAL_ZONE) -> Column:
    return F.to_utc_timestamp(_c(day).cast("timestamp"), zone)


def uuid_from_hex(digest) -> Column:
    """First 16 bytes of a hex digest as a GUID, bytes in order."""
    h = F.lower(_c(digest))
    return F.concat_ws("-", *[F.substring(h, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def uuid_from_hex_mixed(digest) -> Column:
    """First 16 bytes as a GUID whose first three fields are little-endian."""
    h = F.lower(_c(digest))

    def flipped(first: int, count: int) -> Column:
        return F.concat(*[F.substring(h, first + 2 * i, 2) for i in reversed(range(count))])

    return F.concat_ws("-", flipped(1, 4), flipped(9, 2), flipped(13, 2), F.substring(h, 17, 4), F.substring(h, 21, 12))


def uuid_from_text(text) -> Column:
    return uuid_from_hex(F.sha2(_c(text), 256))


def plain_decimal(value) -> Column:
    """Decimal text without trailing zeros or a dangling point."""
    text = _c(value).cast("string")
    return F.when(F.instr(text, ".") > 0, F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))).otherwise(text)


def percent_change(after, before) -> Column:
    """100 * (after / before - 1); null on a zero base or a result beyond the decimal range."""
    value = F.lit(100.0) * (F.try_divide(_c(after).cast("double"), _c(before).cast("double")) - F.lit(1.0))
    return F.when(F.abs(value) <= F.lit(DECIMAL_LIMIT), value)


def canonical_reasons(reasons) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(_c(reasons))))


def reasons_where(*pairs: tuple[Column, str]) -> Column:
    """Array of the reason codes whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(test, F.lit(code)) for test, code in pairs]))


def first_reason(*pairs: tuple[Column, str], otherwise: str | None = None) -> Column:
    """First code whose condition holds."""
    chain = None
    for test, code in pairs:
        chain = F.when(test, F.lit(code)) if chain is None else chain.when(test, F.lit(code))
    return chain.otherwise(F.lit(otherwise))


def availability_counts(states: Column) -> Column:
    """Counts of AVAILABLE, WARMUP and UNAVAILABLE over a map of feature states."""
    values = F.map_values(states)

    def count(kind: str) -> Column:
        return F.size(F.filter(values, lambda s: s["availability"] == kind))

    return F.struct(
        count("AVAILABLE").alias("available"), count("WARMUP").alias("warmup"), count("UNAVAILABLE").alias("unavailable")
    )


def non_available(states: Column) -> Column:
    return F.map_filter(states, lambda _, s: s["availability"] != "AVAILABLE")


def episode_key(instrument, started, policy: str = EPISODE_POLICY) -> Column:
    return F.concat_ws("/", F.lit(policy), F.lower(_c(instrument)), F.date_format(_c(started), "yyyy-MM-dd"))


def valid_episode_key(key, policy: str = EPISODE_POLICY, first: str | None = None, last: str | None = None) -> Column:
    """policy/id/date with the expected policy, a lower-case GUID and a real date inside the bounds."""
    parts = F.split(_c(key), "/")
    day = F.try_to_date(F.get(parts, F.lit(2)), "yyyy-MM-dd")
    ok = (
        (F.length(_c(key)) <= 128)
        & (F.size(parts) == 3)
        & (F.get(parts, F.lit(0)) == policy)
        & F.get(parts, F.lit(1)).rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
        & (F.get(parts, F.lit(1)) != "00000000-0000-0000-0000-000000000000")
        & day.isNotNull()
        & (F.date_format(day, "yyyy-MM-dd") == F.get(parts, F.lit(2)))
    )
    if first is not None:
        ok = ok & (day >= F.lit(first).cast("date"))
    if last is not None:
        ok = ok & (day <= F.lit(last).cast("date"))
    return F.coalesce(ok, F.lit(False))


def series_id(source, reference) -> Column:
    return F.concat_ws("\x1f", _c(source), _c(reference))


def independent_reference(reference, provider: str = PROVIDER_HOST) -> Column:
    """An https address with a host, no user info, and not the price provider's own host."""
    url = _c(reference)
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.coalesce(
        (F.try_parse_url(url, F.lit("PROTOCOL")) == "https")
        & (F.length(host) > 0)
        & F.try_parse_url(url, F.lit("USERINFO")).isNull()
        & (host != provider)
        & ~host.endswith("." + provider),
        F.lit(False),
    )


def _significant(text) -> Column:
    t = _c(text)
    return F.struct(
        F.ltrim(F.regexp_extract(t, r"^[+-]?([0-9]*)", 1), F.lit("0")).alias("whole"),
        F.rtrim(F.regexp_extract(t, r"\.([0-9]*)$", 1), F.lit("0")).alias("fraction"),
    )


def decimal_state(text) -> Column:
    """OK, CANONICAL_INVALID (not a decimal) or NUMERIC_OUT_OF_RANGE (not exactly representable)."""
    t = _c(text)
    parts = _significant(t)
    fraction, digits = parts["fraction"], F.concat(parts["whole"], parts["fraction"])
    limit = "79228162514264337593543950335"
    shape = t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$")
    fits = (F.length(fraction) <= 28) & (
        (F.length(digits) < len(limit)) | ((F.length(digits) == len(limit)) & (digits <= limit))
    )
    # A text of 28 characters has at most 28 digits, which always fit.
    return F.when(t.isNull() | ~shape, F.lit("CANONICAL_INVALID")).when(F.length(t) <= 28, F.lit("OK")).when(~fits, F.lit("NUMERIC_OUT_OF_RANGE")).otherwise(F.lit("OK"))


def is_sha256(value) -> Column:
    text = _c(value)
    # Digits are listed, not given as ranges: Java looks such a class up in a table.
    return F.coalesce((F.length(text) == 64) & ~text.rlike("[^0123456789abcdef]"), F.lit(False))


def unique_keys(body) -> Column:
    """Whether a text is JSON in which no object names a key twice."""
    return F.try_parse_json(_c(body)).isNotNull()


def closed_object(body, keys: tuple[str, ...]) -> Column:
    """Whether a text is a JSON object without repeated keys whose own keys are all among ``keys``."""
    known = F.array(*[F.lit(k) for k in keys]) if keys else F.array().cast("array<string>")
    return unique_keys(body) & F.coalesce(F.size(F.array_except(F.json_object_keys(_c(body)), known)) == 0, F.lit(False))
