"""Point-in-time bars, references, symbols."""

from pyspark.sql import functions as F

from tidemark.functions import hashing
from tidemark.operators import admission as ad
from tidemark.operators import pit
from tidemark.plans.adapters import TEXT, table
from tidemark.plans.registry import query

CUTOFF = "2000-06-30 12:00:00"
VISIBLE = """known_at <= TIMESTAMP '2000-06-30 12:00:00' AND fetched_at <= TIMESTAMP '2000-06-30 12:00:00'
 AND (retrieved_at IS NULL OR retrieved_at <= TIMESTAMP '2000-06-30 12:00:00')
 AND (session_known_at IS NULL OR session_known_at <= TIMESTAMP '2000-06-30 12:00:00')"""
BAR = ("instrument_id", "session_date", "revision_number", "known_at", "content_hash", "close", "volume")


APPEND_FOLD = """
WITH RECURSIVE rows AS (
  SELECT instrument_id, session_date, CAST(-1 AS BIGINT) AS arrival, arg_max(content_hash, revision_number) AS content_hash,
         arg_max(fetched_at, revision_number) AS fetched_at, arg_max(known_at, revision_number) AS known_at, max(revision_number) AS stored
  FROM {{revisions}} WHERE known_at < TIMESTAMP '1999-01-01' GROUP BY 1, 2
  UNION ALL
  SELECT instrument_id, session_date, revision_number, content_hash, fetched_at, known_at, 0
  FROM {{revisions}} WHERE known_at >= TIMESTAMP '1999-01-01'),
 seqd AS (SELECT *, row_number() OVER (PARTITION BY instrument_id, session_date
            ORDER BY arrival >= 0, known_at, arrival) AS rn FROM rows),
 fold AS (
  SELECT instrument_id, session_date, rn, arrival, content_hash AS h, fetched_at AS f, known_at AS k,
         CASE WHEN arrival < 0 THEN stored ELSE 1 END AS n,
         CASE WHEN arrival < 0 THEN 'STORED' ELSE 'INSERTED' END AS disposition FROM seqd WHERE rn = 1
  UNION ALL
  SELECT s.instrument_id, s.session_date, s.rn, s.arrival,
         CASE WHEN s.content_hash <> f.h AND s.fetched_at >= f.f AND s.known_at >= f.k THEN s.content_hash ELSE f.h END,
         CASE WHEN s.content_hash <> f.h AND s.fetched_at >= f.f AND s.known_at >= f.k THEN s.fetched_at ELSE f.f END,
         CASE WHEN s.content_hash <> f.h AND s.fetched_at >= f.f AND s.known_at >= f.k THEN s.known_at ELSE f.k END,
         CASE WHEN s.content_hash <> f.h AND s.fetched_at >= f.f AND s.known_at >= f.k THEN f.n + 1 ELSE f.n END,
         CASE WHEN s.content_hash = f.h THEN 'DUPLICATE_IGNORED' WHEN s.fetched_at < f.f THEN 'STALE_EVIDENCE_IGNORED'
              WHEN s.known_at < f.k THEN 'KNOWLEDGE_REGRESSED' ELSE 'REVISION_APPENDED' END
  FROM fold f JOIN seqd s ON s.instrument_id = f.instrument_id AND s.session_date = f.session_date AND s.rn = f.rn + 1)"""


@query("pit1_append_revisions", APPEND_FOLD + """
SELECT instrument_id, session_date, arrival, disposition,
       CASE WHEN disposition IN ('INSERTED', 'REVISION_APPENDED') THEN n END AS new_revision_number FROM fold WHERE arrival >= 0""")
def _pit1(spark, sf):
    r = table(spark, sf, "revisions")
    edge = F.lit("1999-01-01").cast("timestamp")
    batch = r.where(F.col("known_at") >= edge).withColumnRenamed("revision_number", "arrival")
    return pit.append_revisions(r.where(F.col("known_at") < edge), batch).select(
        "instrument_id", "session_date", "arrival", "disposition", "new_revision_number")


@query("pit2_bars_as_of", f"""
SELECT instrument_id, session_date, revision_number, known_at, content_hash, close, volume FROM (
 SELECT *, row_number() OVER (PARTITION BY instrument_id, session_date ORDER BY known_at DESC, revision_number DESC) AS rn
 FROM {{{{revisions}}}} WHERE {VISIBLE} AND session_date <= DATE '2000-05-31') WHERE rn = 1""")
def _pit2(spark, sf):
    return pit.bars_as_of(table(spark, sf, "revisions").select(*BAR, "fetched_at", "retrieved_at", "session_known_at"), CUTOFF, "2000-05-31").select(*BAR)


@query("pit3_bars_as_of_many", """
WITH c AS (SELECT DISTINCT CAST(date_trunc('year', session_date) AS TIMESTAMP) + INTERVAL '180' DAY AS cutoff FROM {{trades}}),
 r AS (SELECT *, greatest(known_at, fetched_at, coalesce(retrieved_at, known_at), coalesce(session_known_at, known_at)) AS seen FROM {{revisions}})
SELECT cutoff, instrument_id, session_date, revision_number, close FROM (
 SELECT c.cutoff, r.instrument_id, r.session_date, r.revision_number, r.close,
        row_number() OVER (PARTITION BY c.cutoff, r.instrument_id, r.session_date ORDER BY r.known_at DESC, r.revision_number DESC) AS rn
 FROM c JOIN r ON r.seen <= c.cutoff) WHERE rn = 1""")
def _pit3(spark, sf):
    stops = table(spark, sf, "trades").select((F.date_trunc("year", "session_date") + F.expr("interval 180 day")).alias("cutoff")).distinct()
    r = table(spark, sf, "revisions").select(*BAR, "fetched_at", "retrieved_at", "session_known_at")
    return pit.bars_as_of_many(r, stops).select("cutoff", "instrument_id", "session_date", "revision_number", "close")


@query("pit3_knowledge_intervals", """
SELECT instrument_id, session_date, revision_number, known_at,
       lead(known_at) OVER (PARTITION BY instrument_id, session_date ORDER BY known_at, revision_number) AS next_known_at FROM {{revisions}}""")
def _pit3b(spark, sf):
    r = table(spark, sf, "revisions").select("instrument_id", "session_date", "revision_number", "known_at")
    return pit.knowledge_intervals(r)


@query("pit4_revision_history", """
SELECT instrument_id, session_date, revision_number, known_at,
       min(known_at) OVER (PARTITION BY instrument_id, session_date) AS first_seen_at FROM {{revisions}}""")
def _pit4(spark, sf):
    r = table(spark, sf, "revisions").select("instrument_id", "session_date", "revision_number", "known_at")
    return pit.revision_history(r)


@query("pit5_latest_or_conflict", """
WITH v AS (SELECT * FROM {{proofs}} WHERE known_at <= TIMESTAMP '2000-06-30 12:00:00'),
 t AS (SELECT *, rank() OVER (PARTITION BY session_date ORDER BY known_at DESC) AS rk FROM v),
 g AS (SELECT session_date, max(known_at) AS known_at, count(DISTINCT status || '/' || coalesce(CAST(completed_at AS VARCHAR), '-')) AS n,
              min(status) AS status, min(completed_at) AS completed_at, min(reference) AS reference FROM t WHERE rk = 1 GROUP BY session_date)
SELECT session_date, known_at, CASE WHEN n = 1 THEN status END AS status, CASE WHEN n = 1 THEN completed_at END AS completed_at,
       CASE WHEN n = 1 THEN reference END AS reference, CASE WHEN n > 1 THEN 'SESSION_CONFLICT' END AS reason FROM g""")
def _pit5(spark, sf):
    return pit.latest_or_conflict(table(spark, sf, "proofs"), ["session_date"], "known_at", ["status", "completed_at"], "SESSION_CONFLICT", CUTOFF, ["reference"])


@query("pit6_select_references", """
WITH b AS (SELECT DISTINCT * FROM {{boundaries}} WHERE known_at <= TIMESTAMP '1998-06-30' AND instrument_id IN (SELECT DISTINCT instrument_id FROM {{bars_sparse}})),
 p AS (SELECT DISTINCT * FROM {{proofs}} WHERE known_at <= TIMESTAMP '2000-06-30 12:00:00' AND session_date BETWEEN DATE '1996-01-01' AND DATE '2000-05-31')
SELECT 'BOUNDARY' AS family, instrument_id AS item, known_at, status FROM (SELECT *, rank() OVER (PARTITION BY instrument_id ORDER BY known_at DESC) AS rk FROM b) WHERE rk = 1
UNION ALL
SELECT 'SESSION', CAST(session_date AS VARCHAR), known_at, status FROM (SELECT *, rank() OVER (PARTITION BY session_date ORDER BY known_at DESC) AS rk FROM p) WHERE rk = 1""")
def _pit6(spark, sf):
    ids = table(spark, sf, "bars_sparse").select("instrument_id").distinct()
    b = pit.select_references(table(spark, sf, "boundaries"), ["instrument_id"], "1998-06-30", ids=ids)
    p = pit.select_references(table(spark, sf, "proofs"), ["session_date"], CUTOFF, "session_date", "1996-01-01", "2000-05-31")
    return b.select(F.lit("BOUNDARY").alias("family"), F.col("instrument_id").alias("item"), "known_at", "status").unionByName(
        p.select(F.lit("SESSION").alias("family"), F.col("session_date").cast("string").alias("item"), "known_at", "status"))


@query("pit7_interval_lookup", """
WITH f AS (SELECT concat('C', CAST(CAST(substr(instrument_id, 2) AS BIGINT) % 97 AS VARCHAR)) AS instrument_id, symbol, valid_from, valid_to, instrument_id AS part FROM {{symbol_history}}),
 e AS (SELECT *, max(coalesce(valid_to, DATE '9999-12-31')) OVER (PARTITION BY instrument_id ORDER BY valid_from, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM f),
 broken AS (SELECT DISTINCT instrument_id FROM e WHERE reach >= valid_from),
 d AS (SELECT concat('C', CAST(part_key % 97 AS VARCHAR)) AS instrument_id, session_date FROM {{trades}} GROUP BY ALL)
SELECT d.instrument_id, d.session_date, CASE WHEN b.instrument_id IS NULL THEN f.symbol END AS symbol,
       CASE WHEN b.instrument_id IS NOT NULL THEN 'REFERENCE_INTERVAL_CONFLICT' WHEN f.symbol IS NULL THEN 'REFERENCE_INTERVAL_MISSING' END AS reason
FROM d LEFT JOIN broken b USING (instrument_id)
LEFT JOIN f ON f.instrument_id = d.instrument_id AND b.instrument_id IS NULL AND d.session_date BETWEEN f.valid_from AND coalesce(f.valid_to, DATE '9999-12-31')""")
def _pit7(spark, sf):
    group = lambda c: F.concat(F.lit("C"), (c % 97).cast("string"))
    h = table(spark, sf, "symbol_history")
    facts = h.select(group(F.substring("instrument_id", 2, 20).cast("long")).alias("instrument_id"), "symbol", "valid_from", "valid_to", F.col("instrument_id").alias("part"))
    dates = table(spark, sf, "trades").select(group(F.col("part_key")).alias("instrument_id"), "session_date").distinct()
    return pit.interval_lookup(facts, dates, ["instrument_id"], "session_date", ["symbol"])


@query("pit8_resolve_symbols", """
WITH h AS (SELECT instrument_id, arg_max(symbol, valid_from) AS symbol FROM {{symbol_history}}
  WHERE valid_from <= DATE '1998-01-15' AND (valid_to IS NULL OR valid_to >= DATE '1998-01-15') GROUP BY 1)
SELECT l.instrument_id, coalesce(h.symbol, l.listing_symbol, l.issuer_name) AS symbol,
  CASE WHEN h.symbol IS NOT NULL THEN 'REGISTRY_HISTORY' WHEN l.listing_symbol IS NOT NULL THEN 'RETAINED_LISTING' ELSE 'UNAVAILABLE' END AS symbol_source
FROM {{listings}} l LEFT JOIN h USING (instrument_id)""")
def _pit8(spark, sf):
    l = table(spark, sf, "listings")
    return pit.resolve_symbols(l, table(spark, sf, "symbol_history"), l, "1998-01-15")


@query("pit9_resolve_instruments", """
WITH p AS (SELECT DISTINCT symbol, trade_date FROM {{symbol_rows}}),
 m AS (SELECT p.symbol, p.trade_date, count(h.instrument_id) AS n, min(h.instrument_id) AS instrument_id
  FROM p LEFT JOIN {{symbol_history}} h ON h.symbol = p.symbol AND p.trade_date BETWEEN h.valid_from AND coalesce(h.valid_to, DATE '9999-12-31') GROUP BY ALL)
SELECT r.row_id, r.symbol, r.trade_date, m.n AS matches, CASE WHEN m.n = 1 THEN m.instrument_id END AS instrument_id,
  CASE m.n WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'RESOLVED' ELSE 'AMBIGUOUS' END AS resolution FROM {{symbol_rows}} r JOIN m USING (symbol, trade_date)""")
def _pit9(spark, sf):
    return pit.resolve_instruments(table(spark, sf, "symbol_rows"), table(spark, sf, "symbol_history"))


@query("pit10_symbol_overlaps", """
SELECT * FROM (SELECT instrument_id, symbol, valid_from, valid_to, max(coalesce(valid_to, DATE '9999-12-31')) OVER (PARTITION BY symbol
  ORDER BY valid_from, coalesce(valid_to, DATE '9999-12-31'), instrument_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier_reach FROM {{symbol_history}}) WHERE earlier_reach >= valid_from""")
def _pit10(spark, sf):
    return pit.symbol_overlaps(table(spark, sf, "symbol_history"))


TEXT["identities"] = """
SELECT concat('S', CAST(s_suppkey AS VARCHAR(12))) AS instrument_id, s_name AS symbol, DATE '1995-01-01' AS valid_from, DATE '1998-12-31' AS valid_to,
 CASE WHEN s_nationkey = 1 THEN 'INDEX' WHEN s_nationkey = 2 THEN 'UNSUPPORTED' WHEN s_nationkey = 3 THEN 'UNKNOWN' ELSE 'ORDINARY' END AS classification,
 CASE WHEN s_nationkey = 4 THEN 'OTHER' ELSE 'IDR' END AS currency, CASE WHEN s_nationkey = 5 THEN 'UNKNOWN' WHEN s_nationkey = 6 THEN 'ACCELERATION' ELSE 'MAIN' END AS board FROM {{supplier}}
UNION ALL SELECT concat('S', CAST(s_suppkey AS VARCHAR(12))), concat('New', s_name), CASE WHEN s_nationkey = 7 THEN DATE '1998-06-01' ELSE DATE '1999-01-01' END, NULL,
 CASE WHEN s_nationkey = 1 THEN 'INDEX' ELSE 'ORDINARY' END, 'IDR', 'DEVELOPMENT' FROM {{supplier}} WHERE s_nationkey <> 8"""
TEXT["years"] = "SELECT DISTINCT CAST(date_trunc('year', session_date) AS DATE) AS y FROM {{trades}}"
TEXT["price_intervals"] = """
SELECT concat('S', CAST(s_suppkey AS VARCHAR(12))) AS instrument_id, y AS valid_from, y + 350 AS valid_to,
 CASE WHEN (s_nationkey + year(y)) % 3 = 0 THEN 'alpha' ELSE 'beta' END AS source_id, CASE WHEN s_nationkey = 1 THEN 'INDEX_LEVEL' WHEN s_nationkey = 9 THEN 'UNKNOWN' ELSE 'STOCK_RAW' END AS convention,
 CASE WHEN (s_suppkey + year(y)) % 7 = 0 THEN 'UNKNOWN' ELSE 'RAW_AS_TRADED' END AS continuity,
 CASE WHEN (s_suppkey + year(y)) % 5 = 0 THEN 'UNRESOLVED' WHEN s_nationkey = 1 THEN 'NOT_APPLICABLE' ELSE 'CLEARED' END AS event_coverage FROM {{supplier}} CROSS JOIN {{years}}"""
TEXT["volume_intervals"] = """
SELECT concat('S', CAST(s_suppkey AS VARCHAR(12))) AS instrument_id, y AS valid_from, y + 360 AS valid_to, CASE WHEN (s_nationkey + year(y)) % 3 = 0 THEN 'alpha' ELSE 'beta' END AS source_id,
 CASE WHEN year(y) % 4 = 0 THEN 'LOTS' ELSE 'SHARES' END AS unit, 'RAW_AS_TRADED' AS basis, s_nationkey <> 10 AS raw_price_compatible, 'IDR' AS currency, 'REGULAR' AS market_segment
FROM {{supplier}} CROSS JOIN {{years}}"""
TEXT["listed_hashes"] = "SELECT DISTINCT instrument_id, CAST(date_trunc('year', session_date) AS DATE) AS valid_from, content_hash FROM {{revisions}} WHERE volume > 5"

PLAIN = r"'^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$'"


def decimal_sql(c: str) -> str:
    frac, whole = f"rtrim(regexp_extract({c}, '\\.([0-9]*)$', 1), '0')", f"ltrim(regexp_extract({c}, '^[+-]?([0-9]*)', 1), '0')"
    return f"""CASE WHEN {c} IS NULL OR NOT regexp_matches({c}, {PLAIN}) THEN 'CANONICAL_INVALID'
 WHEN length({frac}) > 28 OR length({whole} || {frac}) > 29 OR (length({whole} || {frac}) = 29 AND {whole} || {frac} > '79228162514264337593543950335') THEN 'NUMERIC_OUT_OF_RANGE' ELSE 'OK' END"""


TEXT["admitted"] = f"""
WITH d AS (SELECT *, {decimal_sql('open')} AS so, {decimal_sql('high')} AS sh, {decimal_sql('low')} AS sl, {decimal_sql('close')} AS sc,
  CASE WHEN adjusted_close IS NOT NULL THEN {decimal_sql('adjusted_close')} END AS sa, TRY_CAST(open AS DOUBLE) AS o, TRY_CAST(high AS DOUBLE) AS h, TRY_CAST(low AS DOUBLE) AS l, TRY_CAST(close AS DOUBLE) AS c FROM {{{{revisions}}}})
SELECT *, CASE WHEN quality NOT IN ('VALID', 'DEGRADED', 'STALE') THEN 'CANONICAL_QUALITY_UNAVAILABLE'
 WHEN retrieved_at IS NULL OR session_known_at IS NULL OR session_reference IS NULL OR fetched_at > retrieved_at OR retrieved_at > known_at OR session_known_at > known_at THEN 'CANONICAL_PROVENANCE_UNAVAILABLE'
 WHEN so <> 'OK' THEN so WHEN sh <> 'OK' THEN sh WHEN sl <> 'OK' THEN sl WHEN sc <> 'OK' THEN sc WHEN sa <> 'OK' THEN sa
 WHEN least(o, h, l, c) <= 0 OR h < o OR h < c OR h < l OR l > o OR l > c OR volume < 0 THEN 'CANONICAL_INVALID' END AS reason FROM d"""


@query("prj1_validate_bars", """
SELECT instrument_id, session_date, revision_number, concat_ws(',', CASE WHEN least(open, high, low, close) <= 0 THEN 'NON_POSITIVE_PRICE' END,
 CASE WHEN high < open OR high < close OR high < low THEN 'HIGH_NOT_HIGHEST' END, CASE WHEN low > open OR low > close THEN 'LOW_NOT_LOWEST' END,
 CASE WHEN volume < 0 THEN 'NEGATIVE_VOLUME' END, CASE WHEN adjusted_close <= 0 THEN 'NON_POSITIVE_ADJUSTED_CLOSE' END,
 CASE WHEN trim(volume_unit) = '' THEN 'BLANK_VOLUME_UNIT' END) AS violations
FROM (SELECT instrument_id, session_date, revision_number, CAST(open AS DOUBLE) - 400 AS open, CAST(high AS DOUBLE) - 400 AS high, CAST(low AS DOUBLE) - 400 AS low, CAST(close AS DOUBLE) - 400 AS close,
 volume - 3 AS volume, TRY_CAST(adjusted_close AS DOUBLE) - 2 AS adjusted_close, CASE WHEN volume_unit = 'LOTS' THEN ' ' ELSE volume_unit END AS volume_unit, volume_basis, market_segment FROM {{revisions}})""")
def _prj1(spark, sf):
    r = table(spark, sf, "revisions")
    shifted = r.select("instrument_id", "session_date", "revision_number", *[(F.col(c).cast("double") - 400).alias(c) for c in ("open", "high", "low", "close")],
                       (F.col("volume") - 3).alias("volume"), (F.col("adjusted_close").try_cast("double") - 2).alias("adjusted_close"),
                       F.when(F.col("volume_unit") == "LOTS", " ").otherwise(F.col("volume_unit")).alias("volume_unit"), "volume_basis", "market_segment")
    return ad.validate_bars(shifted).select("instrument_id", "session_date", "revision_number", F.array_join("violations", ",").alias("violations"))


@query("prj2_admit_bars", "SELECT instrument_id, session_date, revision_number, reason FROM {{admitted}}")
def _prj2(spark, sf):
    return ad.admit_bars(table(spark, sf, "revisions")).select("instrument_id", "session_date", "revision_number", "reason")


def number_sql(c: str) -> str:
    return f"CASE WHEN instr({c}, '.') > 0 THEN rtrim(rtrim({c}, '0'), '.') ELSE {c} END"


@query("prj3_verify_content_hash", f"""
WITH h AS (SELECT *, sha256('["' || strftime(session_date, '%Y-%m-%d') || '","' || {number_sql('open')} || '","' || {number_sql('high')} || '","' || {number_sql('low')} || '","' || {number_sql('close')} || '","' || volume || '",' ||
  coalesce('"' || {number_sql('adjusted_close')} || '"', 'null') || ',"' || volume_unit || '","' || volume_basis || '","' || market_segment || '"]') AS digest FROM {{{{revisions}}}})
SELECT instrument_id, session_date, revision_number, digest, digest = CASE WHEN volume > 25 THEN digest ELSE content_hash END AS hash_matches FROM h""")
def _prj3(spark, sf):
    r = table(spark, sf, "revisions").withColumn("digest", hashing.bar_content_hash())
    stored = r.withColumn("content_hash", F.when(F.col("volume") > 25, F.col("digest")).otherwise(F.col("content_hash")))
    return hashing.verify_content_hash(stored).select("instrument_id", "session_date", "revision_number", "digest", "hash_matches")


@query("prj4_canonical_hash", """
WITH g AS (SELECT instrument_id, known_at, '[' || array_to_string(list_sort(list('{"hash":"' || content_hash || '","session":"' || strftime(session_date, '%Y-%m-%d') || '","volume":' || volume || '}')), ',') || ']' AS as_set,
   '[' || array_to_string(list('{"hash":"' || content_hash || '","session":"' || strftime(session_date, '%Y-%m-%d') || '","volume":' || volume || '}' ORDER BY revision_number), ',') || ']' AS in_order
 FROM {{revisions}} GROUP BY 1, 2)
SELECT instrument_id, known_at, sha256('{"instrument":"' || instrument_id || '","knownAt":"' || strftime(known_at, '%Y-%m-%dT%H:%M:%S') || '.0000000+00:00","rows":' || as_set || '}') AS set_hash,
 sha256('{"instrument":"' || instrument_id || '","knownAt":"' || strftime(known_at, '%Y-%m-%dT%H:%M:%S') || '.0000000+00:00","rows":' || in_order || '}') AS ordered_hash FROM g""")
def _prj4(spark, sf):
    g = table(spark, sf, "revisions").groupBy("instrument_id", "known_at").agg(F.sort_array(F.collect_list(F.struct(
        "revision_number", F.struct(F.col("volume"), F.col("session_date").alias("session"), F.col("content_hash").alias("hash")).alias("body")))).alias("s"))
    doc = g.select("instrument_id", "known_at", F.struct(F.transform("s", lambda x: x["body"]).alias("rows"), F.col("known_at").alias("knownAt"),
                                                        F.col("instrument_id").alias("instrument")).alias("doc"))
    return doc.select("instrument_id", "known_at", hashing.canonical_hash(doc, "doc").alias("set_hash"), hashing.canonical_hash(doc, "doc", "ordered").alias("ordered_hash"))


def _admitted(spark, sf, *keep):
    return pit.bars_as_of(ad.admit_bars(table(spark, sf, "revisions")), CUTOFF, keep=(*keep, "reason"))


ASOF = f"SELECT * FROM {{{{admitted}}}} WHERE {VISIBLE} QUALIFY row_number() OVER (PARTITION BY instrument_id, session_date ORDER BY known_at DESC, revision_number DESC) = 1"
CLEAR = f"""
WITH b AS ({ASOF}), brk AS (SELECT DISTINCT a.instrument_id FROM {{{{identities}}}} a JOIN {{{{identities}}}} c ON a.instrument_id = c.instrument_id AND a.valid_from < c.valid_from AND coalesce(a.valid_to, DATE '9999-12-31') >= c.valid_from),
 j AS (SELECT b.*, k.instrument_id IS NOT NULL AS broken, i.classification, i.currency AS icur, p.source_id AS psrc, p.convention, p.continuity, p.event_coverage, p.valid_from AS pfrom, h.content_hash IS NOT NULL AS plisted,
   v.source_id AS vsrc, v.unit, v.basis, v.raw_price_compatible AS rpc, v.currency AS vcur, v.market_segment AS vseg, v.valid_from AS vfrom, vh.content_hash IS NOT NULL AS vlisted
  FROM b LEFT JOIN brk k ON k.instrument_id = b.instrument_id
  LEFT JOIN {{{{identities}}}} i ON k.instrument_id IS NULL AND i.instrument_id = b.instrument_id AND b.session_date BETWEEN i.valid_from AND coalesce(i.valid_to, DATE '9999-12-31')
  LEFT JOIN {{{{price_intervals}}}} p ON p.instrument_id = b.instrument_id AND b.session_date BETWEEN p.valid_from AND p.valid_to
  LEFT JOIN {{{{listed_hashes}}}} h ON h.instrument_id = b.instrument_id AND h.valid_from = p.valid_from AND h.content_hash = b.content_hash
  LEFT JOIN {{{{volume_intervals}}}} v ON v.instrument_id = b.instrument_id AND b.session_date BETWEEN v.valid_from AND v.valid_to
  LEFT JOIN {{{{listed_hashes}}}} vh ON vh.instrument_id = b.instrument_id AND vh.valid_from = v.valid_from AND vh.content_hash = b.content_hash)
"""


@query("prj5_clear_price_basis", CLEAR + """
SELECT instrument_id, session_date, revision_number, CASE WHEN broken THEN 'REFERENCE_INTERVAL_CONFLICT' WHEN classification IS NULL THEN 'REFERENCE_INTERVAL_MISSING'
 WHEN classification NOT IN ('ORDINARY', 'INDEX') THEN 'IDENTITY_UNVERIFIED' WHEN pfrom IS NULL THEN 'REFERENCE_INTERVAL_MISSING'
 WHEN continuity = 'RAW_AS_TRADED' AND (event_coverage = 'CLEARED' OR (classification = 'INDEX' AND event_coverage = 'NOT_APPLICABLE')) AND (classification = 'INDEX' OR (icur = 'IDR' AND volume > 0))
  AND psrc = source_id AND convention = CASE WHEN classification = 'INDEX' THEN 'INDEX_LEVEL' ELSE 'STOCK_RAW' END AND plisted AND reason IS NULL THEN NULL ELSE 'PRICE_BASIS_UNVERIFIED' END AS price_reason FROM j""")
def _prj5(spark, sf):
    t = lambda n: table(spark, sf, n)
    out = ad.clear_price_basis(_admitted(spark, sf, "content_hash", "source_id", "volume"), t("price_intervals"), t("identities"), t("listed_hashes"))
    return out.select("instrument_id", "session_date", "revision_number", "price_reason")


@query("prj6_clear_volume_basis", CLEAR + """
SELECT instrument_id, session_date, revision_number, CASE WHEN vfrom IS NULL THEN 'REFERENCE_INTERVAL_MISSING'
 WHEN classification = 'ORDINARY' AND icur = 'IDR' AND vcur = 'IDR' AND rpc AND unit IN ('SHARES', 'SHARE_COUNT_CORROBORATED') AND basis <> 'UNKNOWN' AND vseg <> 'UNKNOWN' AND vsrc = source_id
  AND unit = volume_unit AND basis = volume_basis AND vseg = market_segment AND vlisted AND volume > 0 AND reason IS NULL THEN NULL ELSE 'VOLUME_BASIS_UNVERIFIED' END AS volume_reason FROM j""")
def _prj6(spark, sf):
    t = lambda n: table(spark, sf, n)
    out = ad.clear_volume_basis(_admitted(spark, sf, "content_hash", "source_id", "volume", "volume_unit", "volume_basis", "market_segment"), t("volume_intervals"), t("identities"), t("listed_hashes"))
    return out.select("instrument_id", "session_date", "revision_number", "volume_reason")


NAMED = "SELECT concat('S', CAST(s_suppkey AS VARCHAR(12))) AS instrument_id, s_name AS symbol, concat('Nation ', CAST(s_nationkey AS VARCHAR(4))) AS issuer_name FROM {{supplier}}"
TEXT["named_instruments"] = NAMED


@query("prj8_search_instruments", f"""
WITH b AS ({ASOF}), n AS (SELECT instrument_id, max(session_date) AS market_date, arg_max(close, session_date) AS close FROM b GROUP BY 1)
SELECT i.instrument_id, i.symbol, i.issuer_name, n.market_date, n.close FROM {{{{named_instruments}}}} i LEFT JOIN n ON n.instrument_id = i.instrument_id
WHERE contains(lower(i.symbol), 'nation 1') OR contains(lower(i.issuer_name), 'nation 1')""")
def _prj8(spark, sf):
    return ad.search_instruments(table(spark, sf, "named_instruments"), pit.bars_as_of(table(spark, sf, "revisions"), CUTOFF), " NATION 1 ")


@query("prj9_stock_history", f"""
WITH b AS ({ASOF}), k AS (SELECT * FROM b WHERE session_date <= DATE '2000-05-31' QUALIFY row_number() OVER (PARTITION BY instrument_id ORDER BY session_date DESC) <= 60)
SELECT instrument_id, session_date, row_number() OVER (PARTITION BY instrument_id ORDER BY session_date) AS position, revision_number, close, reason FROM k""")
def _prj9(spark, sf):
    return ad.stock_history(table(spark, sf, "revisions"), "2000-05-31", CUTOFF, 60, ["close"]).select("instrument_id", "session_date", "position", "revision_number", "close", "reason")


@query("jn2_latest_market_state", f"""
WITH b AS ({ASOF}), n AS (SELECT * FROM b WHERE session_date <= DATE '1996-01-31' QUALIFY row_number() OVER (PARTITION BY instrument_id ORDER BY session_date DESC) = 1)
SELECT i.instrument_id, n.session_date AS market_date, n.revision_number, n.close FROM {{{{named_instruments}}}} i LEFT JOIN n ON n.instrument_id = i.instrument_id""")
def _jn2(spark, sf):
    ids = table(spark, sf, "named_instruments").select("instrument_id")
    return ad.latest_market_state(ids, table(spark, sf, "revisions"), "1996-01-31", CUTOFF).select("instrument_id", "market_date", "revision_number", "close")


TEXT["links"] = """
SELECT instrument_id, session_date, CASE WHEN volume > 45 THEN revision_number + 1 ELSE revision_number END AS revision_number, ROW_ID AS run_id FROM (
 SELECT instrument_id, session_date, revision_number, volume, concat('R', CAST(volume AS VARCHAR(8))) AS ROW_ID FROM {{revisions}}) x"""


@query("jn3_fetch_retained", """
SELECT l.run_id, l.instrument_id, l.session_date, l.revision_number, r.content_hash, CASE WHEN r.content_hash IS NULL THEN 'INPUT_NOT_AVAILABLE' ELSE 'RETAINED' END AS state
FROM {{links}} l LEFT JOIN {{revisions}} r ON r.instrument_id = l.instrument_id AND r.session_date = l.session_date AND r.revision_number = l.revision_number""")
def _jn3(spark, sf):
    return ad.fetch_retained(table(spark, sf, "links"), table(spark, sf, "revisions")).drop("close")
