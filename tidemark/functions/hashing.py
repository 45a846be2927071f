"""Content digests: bar hash, canonical JSON text in two flavours, row digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalar import plain_decimal

# Instants under these names are rendered as UTC with seven fraction digits.
CLOCK_NAMES = ("knownAt", "retrievedAt", "publishedAt", "completedAt", "known_at", "retrieved_at")
# Characters the reference encoder writes as \\uXXXX besides everything beyond ASCII.
ESCAPED = {'"': "22", "&": "26", "'": "27", "+": "2B", "<": "3C", ">": "3E", "`": "60"}
# Characters that are escaped though they print, each listed: Java looks such a class up in a table, but walks a chain for ranges.
MARKED = r"""["&'+<>`\\]"""
UNPRINTED = r"[^\x20-\x7e]"


def bar_content_hash(df: DataFrame | None = None) -> Column:
    """Digest of the ten content fields of a bar, numbers without trailing zeros."""
    def number(name: str) -> Column:
        text = F.col(name).cast("string")
        whole = F.regexp_replace(F.regexp_replace(text, r"^\+", ""), r"^(-?)0+(?=\d)", "$1")
        # Only a sign or a zero in front can be dropped; other texts are spared the two expressions.
        return plain_decimal(F.when(F.substring(text, 1, 1).isin("+", "-", "0"), whole).otherwise(text))

    parts = [
        F.date_format("session_date", "yyyy-MM-dd"), *[number(c) for c in ("open", "high", "low", "close")],
        F.col("volume").cast("string"), number("adjusted_close"), *[F.col(c) for c in ("volume_unit", "volume_basis", "market_segment")],
    ]
    return F.sha2(F.to_json(F.array(*parts)), 256)


def verify_content_hash(df: DataFrame) -> DataFrame:
    return df.withColumn("hash_matches", F.coalesce(bar_content_hash() == F.col("content_hash"), F.lit(False)))


def json_string(text: Column) -> Column:
    """A JSON string literal; quotes, markup and non-ASCII characters are \\u escapes."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control, escape in (("\n", r"\n"), ("\r", r"\r"), ("\t", r"\t"), ("\b", r"\b"), ("\f", r"\f")):
        out = F.replace(out, F.lit(control), F.lit(escape))
    for char, code in ESCAPED.items():
        out = F.replace(out, F.lit(char), F.lit(rf"\u00{code}"))
    unit = lambda number: F.concat(F.lit("\\u"), F.lpad(F.hex(number), 4, "0"))

    def escape(ch: Column) -> Column:
        point = F.ascii(ch).cast("long")
        astral = point - 0x10000
        pair = F.concat(unit(F.lit(0xD800) + F.floor(astral / 1024)), unit(F.lit(0xDC00) + astral % 1024))
        return F.when(point.between(32, 126), ch).when(point < 0x10000, unit(point)).otherwise(pair)

    spelled = F.array_join(F.transform(F.split(out, ""), escape), "")
    return F.concat(F.lit('"'), F.when(~(text.rlike(MARKED) | text.rlike(UNPRINTED)), text).when(~out.rlike(UNPRINTED), out).otherwise(spelled), F.lit('"'))


def clock_text(at: Column) -> Column:
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("0+00:00"))


def canonical_json(value: Column, dtype: T.DataType, arrays: str = "set", name: str = "", omit: tuple[str, ...] = ()) -> Column:
    """Canonical JSON text of a column: member names in ordinal order; ``set`` also orders array
    elements by their own text, ``ordered`` keeps them. Built from the schema when the plan is built."""
    if isinstance(dtype, T.StructType):
        parts = []
        for field in sorted(dtype.fields, key=lambda f: f.name):
            if field.name in omit:
                continue
            body = canonical_json(value[field.name], field.dataType, arrays, field.name)
            parts.append(F.concat(F.lit(f'"{field.name}":'), body))
        text = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    elif isinstance(dtype, T.ArrayType):
        each = F.transform(value, lambda x: canonical_json(x, dtype.elementType, arrays))
        text = F.concat(F.lit("["), F.array_join(F.array_sort(each) if arrays == "set" else each, ","), F.lit("]"))
    elif isinstance(dtype, T.StringType):
        text = json_string(value)
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        text = F.concat(F.lit('"'), clock_text(value), F.lit('"'))
    elif isinstance(dtype, T.DateType):
        text = F.concat(F.lit('"'), F.date_format(value, "yyyy-MM-dd"), F.lit('"'))
    elif isinstance(dtype, T.DecimalType):
        text = plain_decimal(value)
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit("null"))


def canonical_hash(df: DataFrame, column: str, arrays: str = "set", omit: tuple[str, ...] = ()) -> Column:
    return F.sha2(canonical_json(F.col(column), df.schema[column].dataType, arrays, omit=omit), 256)


def personal_row_digest() -> Column:
    """Digest of a personal bar: date|SYMBOL|open|high|low|close|adjusted_close|volume."""
    return F.sha2(
        F.concat_ws("|", F.date_format("session_date", "yyyy-MM-dd"), F.upper(F.trim("symbol")),
                    *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("open", "high", "low", "close", "adjusted_close")],
                    F.col("volume").cast("string")), 256)


def set_digest(member: Column) -> Column:
    """Aggregate: order-free digest of a group's members. Sums the four 64-bit quarters of each member's
    digest, so map tasks combine partial sums and no member list is ever built."""
    slices = [F.sum(F.conv(F.substring(F.sha2(member, 256), 1 + 16 * i, 16), 16, 10).cast("decimal(38,0)")) for i in range(4)]
    return F.sha2(F.concat_ws(":", F.count("*").cast("string"), *[s.cast("string") for s in slices]), 256)
