"""Driver tables mapped to domain tables.

One text per table serves both engines: ``{{table}}`` names an input, ``ISODOW(x)`` and
``DAYS(later, earlier)`` are the two calls whose spelling differs.
"""

from __future__ import annotations

import re
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

TEXT: dict[str, str] = {}

# One row per line with a whole-number quantity; seq orders lines and is unique in practice.
TEXT["trades"] = """
SELECT ((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 100 + CAST(l_quantity AS BIGINT) AS seq,
       l_orderkey AS order_key, l_linenumber AS line, l_partkey AS part_key, l_suppkey AS supp_key,
       CAST(l_shipdate AS DATE) AS session_date, l_returnflag AS flag, l_linestatus AS status,
       CAST(l_extendedprice / l_quantity AS DECIMAL(20,8)) AS px, CAST(l_quantity AS BIGINT) AS qty,
       CAST(l_discount * 100 AS INTEGER) AS disc, CAST(l_tax * 100 AS INTEGER) AS tax
FROM {{lineitem}}"""

_BAR = """min_by(px, seq) AS open, max(px) AS high, min(px) AS low, max_by(px, seq) AS close,
       CAST(sum(qty) AS BIGINT) AS volume"""

TEXT["bars_dense"] = f"""
SELECT flag AS instrument_id, session_date, {_BAR} FROM {{{{trades}}}} GROUP BY flag, session_date"""
TEXT["bars_mixed"] = f"""
SELECT concat(flag, status) AS instrument_id, session_date, {_BAR}
FROM {{{{trades}}}} GROUP BY concat(flag, status), session_date"""
TEXT["bars_sparse"] = f"""
SELECT p_brand AS instrument_id, session_date, {_BAR}
FROM {{{{trades}}}} t JOIN {{{{part}}}} p ON t.part_key = p.p_partkey GROUP BY p_brand, session_date"""
TEXT["bars_weekly"] = f"""
SELECT p_brand AS instrument_id, CAST(date_trunc('week', session_date) AS DATE) AS session_date, {_BAR}
FROM {{{{trades}}}} t JOIN {{{{part}}}} p ON t.part_key = p.p_partkey
GROUP BY p_brand, CAST(date_trunc('week', session_date) AS DATE)"""
TEXT["benchmark_daily"] = f"""
SELECT 'ALL' AS instrument_id, session_date, {_BAR} FROM {{{{trades}}}}
WHERE flag = 'A' AND status = 'O' GROUP BY session_date"""
TEXT["benchmark_weekly"] = f"""
SELECT 'ALL' AS instrument_id, CAST(date_trunc('week', session_date) AS DATE) AS session_date, {_BAR}
FROM {{{{trades}}}} GROUP BY CAST(date_trunc('week', session_date) AS DATE)"""

# Session evidence for weekdays that shipped something: mostly observed trading, some closures,
# some late knowledge, some equal-instant contradictions, some references to the price provider.
TEXT["proofs"] = """
WITH d AS (SELECT DISTINCT session_date, DAYS(session_date, DATE '1970-01-01') AS n FROM {{trades}}
           WHERE ISODOW(session_date) <= 5),
 p AS (SELECT session_date, n, CASE WHEN n % 29 = 0 THEN 'AnnouncedClosed' WHEN n % 31 = 0 THEN 'ExceptionalClosure'
                                    ELSE 'ObservedTrading' END AS status, 0 AS extra FROM d
       UNION ALL SELECT session_date, n, 'ExceptionalClosure', 1 FROM d WHERE n % 97 = 0)
SELECT session_date, status,
       CASE WHEN n % 53 = 0 THEN concat('https://api.eodhd.com/calendar/', CAST(n AS VARCHAR(10)))
            WHEN n % 59 = 0 THEN concat('http://exchange.example/day/', CAST(n AS VARCHAR(10)))
            ELSE concat('https://exchange.example/day/', CAST(n AS VARCHAR(10))) END AS reference,
       CAST(session_date + CAST(n % 5 AS INTEGER) AS TIMESTAMP) + INTERVAL '20' HOUR AS known_at,
       CASE WHEN n % 7 = 0 THEN NULL ELSE CAST(session_date AS TIMESTAMP) + INTERVAL '10' HOUR END AS completed_at
FROM p"""

# Civil calendar over the data's span, with the clean status of each day.
TEXT["calendar"] = """
SELECT session_date, CASE WHEN ISODOW(session_date) > 5 THEN 'Weekend'
       WHEN DAYS(session_date, DATE '1970-01-01') % 29 = 0 THEN 'AnnouncedClosed'
       WHEN DAYS(session_date, DATE '1970-01-01') % 457 = 0 THEN 'Unknown' ELSE 'ObservedTrading' END AS status
FROM (SELECT DISTINCT session_date FROM {{trades}}) d"""
TEXT["calendar_weekly"] = """
SELECT DISTINCT CAST(date_trunc('week', session_date) AS DATE) AS session_date, 'ObservedTrading' AS status FROM {{trades}}"""
TEXT["holidays"] = """
SELECT session_date AS holiday_date, concat('Holiday ', CAST(session_date AS VARCHAR(10))) AS holiday_name, 'NATIONAL' AS kind
FROM (SELECT DISTINCT session_date FROM {{trades}}) d
WHERE DAYS(session_date, DATE '1970-01-01') % 23 = 0 AND ISODOW(session_date) <= 5"""

# Revisions of weekly bars per supplier, in arrival order (revision_number is the arrival key).
TEXT["revisions"] = """
SELECT concat('S', CAST(supp_key AS VARCHAR(12))) AS instrument_id,
       CAST(date_trunc('week', session_date) AS DATE) AS session_date, seq AS revision_number,
       CAST(session_date + line AS TIMESTAMP) + INTERVAL '15' HOUR AS known_at,
       CAST(session_date + CAST(part_key % 3 AS INTEGER) AS TIMESTAMP) + INTERVAL '11' HOUR AS fetched_at,
       CASE WHEN part_key % 11 = 0 THEN NULL ELSE CAST(session_date + CAST(part_key % 4 AS INTEGER) AS TIMESTAMP) + INTERVAL '12' HOUR END AS retrieved_at,
       CASE WHEN part_key % 13 = 0 THEN NULL ELSE CAST(session_date AS TIMESTAMP) + INTERVAL '14' HOUR END AS session_known_at,
       CASE WHEN part_key % 13 = 0 THEN NULL ELSE 'https://exchange.example/session' END AS session_reference,
       CASE WHEN flag = 'N' THEN 'alpha' ELSE 'beta' END AS source_id,
       concat(md5(concat(CAST(qty AS VARCHAR(12)), flag)), md5(concat(flag, status))) AS content_hash,
       CASE WHEN disc = 0 THEN 'DEGRADED' WHEN disc = 1 THEN 'STALE' WHEN disc = 2 THEN 'REJECTED' WHEN disc = 3 THEN 'UNKNOWN' ELSE 'VALID' END AS quality,
       CAST(px AS VARCHAR(40)) AS open, CAST(px + CAST(tax AS DECIMAL(4,0)) - 1 AS VARCHAR(40)) AS high,
       CAST(px - 2 AS VARCHAR(40)) AS low, CAST(px AS VARCHAR(40)) AS close,
       CASE WHEN disc = 10 THEN 0 ELSE qty END AS volume,
       CASE WHEN tax = 4 THEN '1.12345678901234567890123456789' WHEN tax = 5 THEN 'n/a' WHEN tax = 6 THEN CAST(px AS VARCHAR(40)) ELSE NULL END AS adjusted_close,
       CASE WHEN status = 'O' THEN 'SHARES' ELSE 'LOTS' END AS volume_unit, 'RAW_AS_TRADED' AS volume_basis,
       CASE WHEN flag = 'A' THEN 'REGULAR' ELSE 'UNKNOWN' END AS market_segment
FROM {{trades}}"""

# Symbol intervals: an instrument carries a brand as symbol from a day derived from its size.
TEXT["symbol_history"] = """
SELECT concat('P', CAST(p_partkey AS VARCHAR(12))) AS instrument_id, p_brand AS symbol,
       DATE '1995-01-01' + CAST(p_partkey % 2400 AS INTEGER) AS valid_from,
       CASE WHEN p_size % 10 = 0 THEN NULL ELSE DATE '1995-01-01' + CAST(p_partkey % 2400 + p_size * 2 AS INTEGER) END AS valid_to
FROM {{part}}"""
TEXT["symbol_rows"] = """
SELECT seq AS row_id, session_date AS trade_date, p_brand AS symbol
FROM {{trades}} t JOIN {{part}} p ON t.part_key = p.p_partkey"""
TEXT["listings"] = """
SELECT concat('P', CAST(p_partkey AS VARCHAR(12))) AS instrument_id, p_name AS issuer_name,
       CASE WHEN p_size % 3 = 0 THEN concat('L', CAST(p_partkey AS VARCHAR(12))) ELSE NULL END AS listing_symbol
FROM {{part}}"""

# Listing-boundary evidence per brand, several knowledge instants, some contradictory.
TEXT["boundaries"] = """
SELECT instrument_id, status, listed_from, delisted_at, first_trading_date, known_at, retrieved_at, reference, issuer_name
FROM (SELECT DISTINCT p_brand AS instrument_id,
       CASE WHEN p_size % 5 = 0 THEN 'PARTIAL' WHEN p_size % 11 = 0 THEN 'UNKNOWN' ELSE 'VERIFIED' END AS status,
       CASE WHEN p_size % 7 = 0 THEN NULL ELSE DATE '1995-03-01' + CAST(p_size % 6 * 60 AS INTEGER) END AS listed_from,
       CASE WHEN p_size % 4 = 0 THEN DATE '2000-01-01' + CAST(p_size AS INTEGER) ELSE NULL END AS delisted_at,
       CAST(NULL AS DATE) AS first_trading_date,
       CAST(DATE '1996-01-01' + CAST(p_size % 9 * 120 AS INTEGER) AS TIMESTAMP) AS known_at,
       CASE WHEN p_size % 8 = 0 THEN NULL ELSE CAST(DATE '1995-12-01' AS TIMESTAMP) END AS retrieved_at,
       'https://registry.example/listing' AS reference, p_type AS issuer_name FROM {{part}}) b"""

TABLE_PATTERN = re.compile(r"\{\{(\w+)\}\}")


def _inner(text: str, start: int) -> tuple[list[str], int]:
    """Splits the comma-separated arguments of the call whose opening bracket is at start."""
    depth, args, begin = 0, [], start + 1
    for i in range(start, len(text)):
        if text[i] == "(":
            depth += 1
        elif text[i] == ")":
            depth -= 1
            if depth == 0:
                args.append(text[begin:i].strip())
                return args, i + 1
        elif text[i] == "," and depth == 1:
            args.append(text[begin:i].strip())
            begin = i + 1
    raise ValueError("unbalanced call")


SPELLING = {
    "spark": {"ISODOW": "(weekday({0}) + 1)", "DAYS": "datediff({0}, {1})"},
    "duckdb": {"ISODOW": "isodow({0})", "DAYS": "date_diff('day', {1}, {0})"},
}


def spell(text: str, engine: str) -> str:
    for call, form in SPELLING[engine].items():
        while (found := re.search(rf"\b{call}\(", text)) is not None:
            args, end = _inner(text, found.end() - 1)
            text = text[: found.start()] + form.format(*args) + text[end:]
    return text


def table(spark: SparkSession, sf_dir: str, name: str, **given: DataFrame) -> DataFrame:
    """A driver table or a derived domain table; ``given`` tables stand for those of their name."""
    if name in given:
        return given[name]
    if name in DRIVER_TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = TEXT[name]
    # sql() drops the views it makes of its inputs, and all that is persisted and reads what a dropped view shows is planned anew, or no
    # longer persisted; so each view shows its table through a filter of its own that is always true.
    inputs = {n: table(spark, sf_dir, n, **given).where(F.lit(uuid4().hex).isNotNull()) for n in sorted(set(TABLE_PATTERN.findall(text)))}
    # Braces that are not table names are literal text to the formatter.
    marked = TABLE_PATTERN.sub("\x00\\1\x01", spell(text, "spark")).replace("{", "{{").replace("}", "}}")
    return spark.sql(marked.replace("\x00", "{").replace("\x01", "}"), **inputs)


def numbered(df: DataFrame, key: str) -> DataFrame:
    """``key`` as a struct of itself (id) and of its occurrence (n), so that rows that share a key stay apart.

    Occurrences follow the rows' whole content; rows that tie in it are equal, so every evaluation numbers alike.
    """
    occurrence = F.row_number().over(Window.partitionBy(key).orderBy(*[c for c in df.columns if c != key]))
    return df.withColumn("__n", occurrence).withColumn(key, F.struct(F.col(key).alias("id"), F.col("__n").alias("n"))).drop("__n")


def _needed(text: str, found: dict[str, str]) -> None:
    for name in sorted(set(TABLE_PATTERN.findall(text))):
        if name not in DRIVER_TABLES and name not in found:
            _needed(TEXT[name], found)
            found[name] = TEXT[name]


def oracle_with(sql: str) -> str:
    """Prefixes the query with the derived tables it names, as common table expressions."""
    found: dict[str, str] = {}
    _needed(sql, found)
    flat = TABLE_PATTERN.sub(r"\1", sql).strip()
    if not found:
        return spell(flat, "duckdb")
    parts = [f"{n} AS MATERIALIZED ({TABLE_PATTERN.sub(r'\1', t).strip()})" for n, t in found.items()]
    body = ",\n".join(parts)
    match = re.match(r"WITH\s+(RECURSIVE\s+)?", flat, re.IGNORECASE)
    if match:
        return spell(f"WITH {match.group(1) or ''}{body},\n{flat[match.end():]}", "duckdb")
    return spell(f"WITH {body}\n{flat}", "duckdb")
