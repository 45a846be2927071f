"""Scalar functions over whole tables."""

from pyspark.sql import functions as F

from tidemark.functions import hashing as hs
from tidemark.functions import scalar as sf_
from tidemark.plans.adapters import table
from tidemark.plans.registry import query


@query("fn1_normalize_symbol", "SELECT p_partkey, CASE WHEN regexp_full_match(upper(trim(p_name)), '[A-Z0-9._-]{1,32}') THEN upper(trim(p_name)) END AS a, upper(replace(p_brand, '#', '-')) AS b FROM {{part}}")
def _fn1(spark, sf):
    return table(spark, sf, "part").select("p_partkey", sf_.normalize_symbol("p_name").alias("a"), sf_.normalize_symbol(F.regexp_replace(F.concat(F.lit(" "), "p_brand"), "#", "-")).alias("b"))


@query("fn2_local_date", "SELECT event_id, CAST(ts + INTERVAL '7' HOUR AS DATE) AS local_day, CAST(CAST(ts + INTERVAL '7' HOUR AS DATE) + 1 AS TIMESTAMP) - INTERVAL '7' HOUR AS deadline FROM {{events}}")
def _fn2(spark, sf):
    return table(spark, sf, "events").select("event_id", sf_.local_date("ts").alias("local_day"), sf_.end_of_local_day("ts").alias("deadline"))


@query("fn3_deterministic_ids", """WITH h AS (SELECT event_id, sha256(CAST(event_id AS VARCHAR)) AS h FROM {{events}}) SELECT event_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS big,
 substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) || '-' || substr(h, 11, 2) || substr(h, 9, 2) || '-' || substr(h, 15, 2) || substr(h, 13, 2) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS mixed FROM h""")
def _fn3(spark, sf):
    h = F.sha2(F.col("event_id").cast("string"), 256)
    return table(spark, sf, "events").select("event_id", sf_.uuid_from_hex(h).alias("big"), sf_.uuid_from_hex_mixed(h).alias("mixed"))


@query("fn4_plain_decimal", "SELECT seq, CASE WHEN contains(CAST(px AS VARCHAR), '.') THEN rtrim(rtrim(CAST(px AS VARCHAR), '0'), '.') ELSE CAST(px AS VARCHAR) END AS text FROM {{trades}}")
def _fn4(spark, sf):
    return table(spark, sf, "trades").select("seq", sf_.plain_decimal("px").alias("text"))


@query("fn5_percent_change", "SELECT seq, CASE WHEN disc <> 0 THEN round(100 * (CAST(qty AS DOUBLE) / disc - 1), 6) END AS change FROM {{trades}}")
def _fn5(spark, sf):
    return table(spark, sf, "trades").select("seq", F.round(sf_.percent_change("qty", "disc"), 6).alias("change"))


@query("fn6_canonical_reasons", "SELECT seq, array_to_string(list_sort(list_distinct(list_filter([flag, status, CASE WHEN tax > 3 THEN 'T' END, flag], lambda x: x IS NOT NULL))), ',') AS reasons FROM {{trades}}")
def _fn6(spark, sf):
    return table(spark, sf, "trades").select("seq", F.array_join(sf_.canonical_reasons(F.array("flag", "status", F.when(F.col("tax") > 3, "T"), "flag")), ",").alias("reasons"))


def states():
    one = lambda c, n: F.struct(F.when(F.col(c) < n, "WARMUP").when(F.col(c) == n, "UNAVAILABLE").otherwise("AVAILABLE").alias("availability"), F.col(c).cast("double").alias("value"), F.lit(None).cast("string").alias("reason"))
    return F.create_map(F.lit("a"), one("disc", 3), F.lit("b"), one("tax", 2), F.lit("c"), one("qty", 10))


@query("fn7_availability_counts", """SELECT seq, CAST((disc > 3) AS INTEGER) + CAST((tax > 2) AS INTEGER) + CAST((qty > 10) AS INTEGER) AS available, CAST((disc < 3) AS INTEGER) + CAST((tax < 2) AS INTEGER) + CAST((qty < 10) AS INTEGER) AS warmup, CAST((disc = 3) AS INTEGER) + CAST((tax = 2) AS INTEGER) + CAST((qty = 10) AS INTEGER) AS unavailable FROM {{trades}}""")
def _fn7(spark, sf):
    return table(spark, sf, "trades").select("seq", sf_.availability_counts(states()).alias("c")).select("seq", "c.*")


@query("fn8_non_available", "SELECT seq, concat_ws(',', CASE WHEN disc <= 3 THEN 'a' END, CASE WHEN tax <= 2 THEN 'b' END, CASE WHEN qty <= 10 THEN 'c' END) AS fields FROM {{trades}}")
def _fn8(spark, sf):
    return table(spark, sf, "trades").select("seq", F.array_join(F.array_sort(F.map_keys(sf_.non_available(states()))), ",").alias("fields"))


@query("fn9_episode_key", """WITH k AS (SELECT event_id, md5(CAST(event_id AS VARCHAR)) AS m, ts FROM {{events}}), g AS (SELECT event_id, substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12) AS id, ts FROM k)
SELECT event_id, 'screener-v0.1.0/' || id || '/' || strftime(ts, '%Y-%m-%d') AS episode_key, ts >= TIMESTAMP '2024-01-10' AS valid FROM g""")
def _fn9(spark, sf):
    e = table(spark, sf, "events").withColumn("id", sf_.uuid_from_hex(F.md5(F.col("event_id").cast("string").cast("binary"))))
    k = sf_.episode_key("id", F.to_date("ts"))
    return e.select("event_id", k.alias("episode_key"), sf_.valid_episode_key(k, first="2024-01-10").alias("valid"))


@query("fn10_series_id", "SELECT p_partkey, p_brand || chr(31) || p_name AS series FROM {{part}}")
def _fn10(spark, sf):
    return table(spark, sf, "part").select("p_partkey", sf_.series_id("p_brand", "p_name").alias("series"))


@query("fn11_independent_reference", "SELECT session_date, reference, reference LIKE 'https://%' AND reference NOT LIKE '%eodhd.com/%' AS independent FROM {{proofs}}")
def _fn11(spark, sf):
    return table(spark, sf, "proofs").select("session_date", "reference", sf_.independent_reference("reference").alias("independent"))


@query("fn12_closed_object", """SELECT seq, disc NOT IN (1, 2) AND disc <> 3 AS closed, disc <> 2 AND disc <> 3 AS unique_keys FROM {{trades}}""")
def _fn12(spark, sf):
    d = F.col("disc")
    body = F.when(d == 1, '{"a":1,"z":2}').when(d == 2, '{"a":1,"a":2}').when(d == 3, "{oops").otherwise('{"a":1,"b":{"c":2}}')
    x = table(spark, sf, "trades").select("seq", body.alias("body"))
    return x.select("seq", sf_.closed_object("body", ("a", "b")).alias("closed"), sf_.unique_keys("body").alias("unique_keys"))


@query("fn15_personal_row_digest", """SELECT instrument_id, session_date, sha256(strftime(session_date, '%Y-%m-%d') || '|' || upper(instrument_id) || '|' || open || '|' || high || '|' || low || '|' || close || '||' || volume) AS digest FROM {{bars_sparse}}""")
def _fn15(spark, sf):
    b = table(spark, sf, "bars_sparse").withColumn("symbol", F.col("instrument_id")).withColumn("adjusted_close", F.lit(None).cast("string"))
    return b.select("instrument_id", "session_date", hs.personal_row_digest().alias("digest"))
