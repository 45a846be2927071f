"""Runs, features, trends."""

from pyspark.sql import functions as F

from tidemark.functions import smoothing
from tidemark.operators import features as ft
from tidemark.plans.adapters import TEXT, table
from tidemark.plans.registry import query

# Bars of six instruments on confirmed days, numbered into runs (islands over session ordinals).
TEXT["ordinals"] = """
SELECT session_date, row_number() OVER (ORDER BY session_date) AS ordinal, status FROM {{calendar}}
WHERE status NOT IN ('Weekend', 'AnnouncedClosed', 'ExceptionalClosure')"""
TEXT["run_rows"] = """
WITH p AS (SELECT b.*, o.ordinal, o.ordinal - row_number() OVER (PARTITION BY b.instrument_id ORDER BY b.session_date) AS run_id
           FROM {{bars_mixed}} b JOIN {{ordinals}} o ON b.session_date = o.session_date AND o.status = 'ObservedTrading')
SELECT *, row_number() OVER (PARTITION BY instrument_id, run_id ORDER BY session_date) AS pos,
       row_number() OVER (PARTITION BY instrument_id ORDER BY session_date) AS rn FROM p"""

VALUES = """
WITH RECURSIVE x AS (
 SELECT r.instrument_id, r.session_date, r.run_id, r.pos, r.rn, r.volume, CAST(r.close AS DOUBLE) AS c, CAST(r.high AS DOUBLE) AS h, CAST(r.low AS DOUBLE) AS l,
   CAST(b.close AS DOUBLE) AS b, b.volume AS bv,
   CASE WHEN r.volume % 7 = 0 THEN 'LOTS' ELSE 'SHARES' END AS unit
 FROM {{run_rows}} r LEFT JOIN {{benchmark_daily}} b ON b.session_date = r.session_date),
 t AS (SELECT *, lag(c) OVER w AS pc, lag(c, 20) OVER w AS c20, lag(c, 60) OVER w AS c60, lag(b, 20) OVER w AS b20, lag(b, 60) OVER w AS b60,
   count(b) OVER (w ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS n20, count(b) OVER (w ROWS BETWEEN 60 PRECEDING AND CURRENT ROW) AS n60,
   count(*) FILTER (WHERE bv > 0) OVER (w ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS traded,
   max(h) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS ph, min(l) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS pl,
   avg(CAST(volume AS DOUBLE)) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS vm, avg(c * volume) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS ml,
   min(unit) OVER (w ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) = max(unit) OVER (w ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS same_unit,
   avg(c) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS s20, avg(c) OVER (w ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS s50
   FROM x WINDOW w AS (PARTITION BY instrument_id, run_id ORDER BY pos)),
 u AS (SELECT *, CASE WHEN pos > 1 THEN greatest(h - l, abs(h - pc), abs(l - pc)) END AS tr FROM t),
 v AS (SELECT *, avg(tr) OVER (PARTITION BY instrument_id, run_id ORDER BY pos ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS s14 FROM u),
 e AS (SELECT instrument_id, rn, CAST(NULL AS DOUBLE) AS e20, CAST(NULL AS DOUBLE) AS e50, CAST(NULL AS DOUBLE) AS a14 FROM v WHERE rn = 1
  UNION ALL
  SELECT v.instrument_id, v.rn,
   CASE WHEN v.pos < 20 THEN NULL WHEN v.pos = 20 THEN v.s20 ELSE e.e20 + 2.0::DOUBLE / 21 * (v.c - e.e20) END,
   CASE WHEN v.pos < 50 THEN NULL WHEN v.pos = 50 THEN v.s50 ELSE e.e50 + 2.0::DOUBLE / 51 * (v.c - e.e50) END,
   CASE WHEN v.pos < 15 THEN NULL WHEN v.pos = 15 THEN v.s14 ELSE e.a14 + 1.0::DOUBLE / 14 * (v.tr - e.a14) END
  FROM e JOIN v ON v.instrument_id = e.instrument_id AND v.rn = e.rn + 1),
 f AS (SELECT v.*, e.e20, e.e50, e.a14 FROM v JOIN e USING (instrument_id, rn))
"""
FEATURE = {
    "changePercent": ("wn4", "100 * (c / pc - 1)", 2, "NULL"),
    "ema20": ("wn5", "e20", 20, "NULL"), "ema50": ("wn5", "e50", 50, "NULL"),
    "atr14": ("wn6", "a14", 15, "NULL"), "atrPercent": ("wn7", "100 * a14 / c", 15, "NULL"),
    "priorHigh20": ("wn8", "ph", 21, "NULL"), "priorLow20": ("wn8", "pl", 21, "NULL"),
    "distanceToHighPercent": ("wn9", "100 * (c / ph - 1)", 21, "NULL"),
    "volumeRatio20": ("wn10", "volume / vm", 21, "CASE WHEN NOT same_unit THEN 'VOLUME_BASIS_UNVERIFIED' END"),
    "dailyValueProxyIdr": ("wn11", "c * volume", 1, "NULL"),
    "monetaryLiquidity20Idr": ("wn12", "ml", 21, "CASE WHEN NOT same_unit THEN 'VOLUME_BASIS_UNVERIFIED' END"),
    "rs20Pp": ("wn13", "100 * ((c / c20 - 1) - (b / b20 - 1))", 21, "CASE WHEN n20 < 21 THEN 'BENCHMARK_MISSING' END"),
    "rs60Pp": ("wn13", "100 * ((c / c60 - 1) - (b / b60 - 1))", 61, "CASE WHEN n60 < 61 THEN 'BENCHMARK_MISSING' END"),
}


# Single prices or one product of the same two doubles in both engines; rounding would only add ties.
EXACT = ("dailyValueProxyIdr", "priorHigh20", "priorLow20")


def state_sql(name: str) -> str:
    _, value, minimum, reason = FEATURE[name]
    return f"""CASE WHEN pos < {minimum} THEN 'WARMUP' WHEN {reason} IS NOT NULL THEN 'UNAVAILABLE' ELSE 'AVAILABLE' END AS {name}_state,
 CASE WHEN pos >= {minimum} AND {reason} IS NULL THEN {value if name in EXACT else f'round({value}, 6)'} END AS {name}, CASE WHEN pos < {minimum} THEN 'INSUFFICIENT_SESSIONS' ELSE {reason} END AS {name}_reason"""


def aligned(spark, sf):
    run = ft.runs(table(spark, sf, "bars_mixed"), table(spark, sf, "calendar"))
    run = run.withColumn("volume_unit", F.when(F.col("volume") % 7 == 0, "LOTS").otherwise("SHARES"))
    return ft.align_benchmark(run, table(spark, sf, "benchmark_daily"))


def flat(panel, names):
    return panel.select("instrument_id", "session_date", "sessions", *[
        c for n in names for c in (F.col(f"{n}.availability").alias(f"{n}_state"), (F.col(f"{n}.value") if n in EXACT else F.round(f"{n}.value", 6)).alias(n), F.col(f"{n}.reason").alias(f"{n}_reason"))])


def _register(group: str, names: list[str]) -> None:
    title = "_".join([group, *[n.lower() for n in names]])
    sql = VALUES + f"SELECT instrument_id, session_date, pos AS sessions, {', '.join(state_sql(n) for n in names)} FROM f"

    @query(title, sql)
    def _run(spark, sf):
        return flat(ft.features(aligned(spark, sf)), names)


for _group in sorted({g for g, *_ in FEATURE.values()}):
    _register(_group, [n for n, (g, *_) in FEATURE.items() if g == _group])


@query("wn16_feature_panel_every_row", VALUES + f"SELECT instrument_id, session_date, pos AS sessions, {', '.join(state_sql(n) for n in FEATURE)} FROM f")
def _wn16(spark, sf):
    return flat(ft.features(aligned(spark, sf)), list(FEATURE))


@query("wn16_feature_panel_latest", VALUES + f"""SELECT instrument_id, session_date, pos AS sessions, {', '.join(state_sql(n) for n in FEATURE)} FROM f
QUALIFY row_number() OVER (PARTITION BY instrument_id ORDER BY session_date DESC) = 1""")
def _wn16b(spark, sf):
    run = ft.last_runs(table(spark, sf, "bars_mixed"), table(spark, sf, "calendar"))
    run = run.withColumn("volume_unit", F.when(F.col("volume") % 7 == 0, "LOTS").otherwise("SHARES"))
    return flat(ft.features(ft.align_benchmark(run, table(spark, sf, "benchmark_daily")), latest=True), list(FEATURE))


@query("wn1_canonical_runs", """
SELECT instrument_id, min(session_date) AS run_start, max(session_date) AS market_date, count(*) AS sessions FROM {{run_rows}} r
WHERE run_id = (SELECT max(run_id) FROM {{run_rows}} m WHERE m.instrument_id = r.instrument_id) GROUP BY instrument_id""")
def _wn1(spark, sf):
    run = ft.last_runs(table(spark, sf, "bars_mixed"), table(spark, sf, "calendar"))
    return run.groupBy("instrument_id").agg(F.min("session_date").alias("run_start"), F.max("session_date").alias("market_date"), F.count("*").alias("sessions"))


@query("wn2_personal_runs", """
WITH d AS (SELECT session_date, row_number() OVER (ORDER BY session_date) AS ordinal FROM {{calendar}}
  WHERE ISODOW(session_date) <= 5 AND session_date BETWEEN DATE '1999-07-02' AND DATE '2000-07-01' AND session_date NOT IN (SELECT holiday_date FROM {{holidays}})),
 p AS (SELECT b.instrument_id, b.session_date, d.ordinal - row_number() OVER (PARTITION BY instrument_id ORDER BY b.session_date) AS run_id FROM {{bars_sparse}} b JOIN d ON b.session_date = d.session_date),
 g AS (SELECT instrument_id, run_id, min(session_date) AS run_start, max(session_date) AS market_date, count(*) AS sessions FROM p GROUP BY 1, 2)
SELECT instrument_id, run_start, market_date, sessions FROM g WHERE market_date = (SELECT max(session_date) FROM d)""")
def _wn2(spark, sf):
    run = ft.personal_runs(table(spark, sf, "bars_sparse"), table(spark, sf, "holidays"), table(spark, sf, "calendar"), "2000-07-01")
    return run.groupBy("instrument_id").agg(F.min("session_date").alias("run_start"), F.max("session_date").alias("market_date"), F.count("*").alias("sessions"))


@query("wn3_pilot_runs", """
WITH edge AS (SELECT max(session_date) AS edge FROM {{calendar}} WHERE status = 'ObservedTrading' AND session_date <= DATE '2000-06-30'),
 o AS (SELECT * FROM {{bars_sparse}} WHERE session_date <= DATE '2000-06-30' AND NOT (instrument_id = 'Brand#3' AND session_date > DATE '2000-06-01')),
 p AS (SELECT b.instrument_id, b.session_date, d.ordinal - row_number() OVER (PARTITION BY instrument_id ORDER BY b.session_date) AS run_id
  FROM o b JOIN {{ordinals}} d ON b.session_date = d.session_date AND d.status = 'ObservedTrading' WHERE volume > 0),
 g AS (SELECT instrument_id, run_id, max(session_date) AS market_date, count(*) AS sessions FROM p GROUP BY 1, 2),
 s AS (SELECT g.* FROM g, edge WHERE market_date = edge)
SELECT m.instrument_id, coalesce(s.market_date, m.own) AS market_date, coalesce(s.sessions, 0) AS sessions,
 CASE WHEN s.sessions >= 50 THEN 'AVAILABLE_PILOT' WHEN s.sessions IS NOT NULL THEN 'WARMUP' WHEN m.own < edge THEN 'STALE' ELSE 'UNKNOWN' END AS status
FROM (SELECT instrument_id, max(session_date) AS own FROM o GROUP BY 1) m CROSS JOIN edge LEFT JOIN s ON s.instrument_id = m.instrument_id""")
def _wn3(spark, sf):
    bars = table(spark, sf, "bars_sparse").where("not (instrument_id = 'Brand#3' and session_date > date '2000-06-01')")
    return ft.pilot_runs(bars, table(spark, sf, "calendar"), "2000-06-30")[1]


@query("wn14_relative_performance", VALUES + """
SELECT instrument_id, session_date, CASE WHEN traded = 21 THEN round((c / c20) / (b / b20) - 1, 8) END AS relative_performance FROM f""")
def _wn14(spark, sf):
    return ft.feature_values(aligned(spark, sf)).select("instrument_id", "session_date", F.round("v_relativePerformance20", 8).alias("relative_performance"))


@query("wn15_trend", VALUES + """
SELECT instrument_id, session_date, CASE WHEN e20 IS NULL OR e50 IS NULL THEN 'UNKNOWN' WHEN c > e20 AND e20 > e50 THEN 'POSITIVE' WHEN c < e20 AND e20 < e50 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS trend,
 CASE WHEN a14 IS NULL THEN 'UNKNOWN' WHEN 100 * a14 / c >= 2 THEN 'ELEVATED' ELSE 'NORMAL' END AS volatility FROM f""")
def _wn15(spark, sf):
    p = ft.features(aligned(spark, sf))
    return p.select("instrument_id", "session_date", ft.trend(F.col("close"), F.col("ema20.value"), F.col("ema50.value")).alias("trend"),
                    ft.volatility(F.col("atrPercent.value")).alias("volatility"))


@query("wn17_clearance_history", """
WITH d AS (SELECT g.instrument_id, g.session_date, c.status IN ('Weekend', 'AnnouncedClosed') AS closed, coalesce(b.volume >= 150, false) AS broken, coalesce(b.volume >= 2, false) AS cleared
  FROM {{grid}} g JOIN {{calendar}} c ON c.session_date = g.session_date LEFT JOIN {{bars_sparse}} b ON b.instrument_id = g.instrument_id AND b.session_date = g.session_date),
 r AS (SELECT *, sum(CASE WHEN broken OR (NOT closed AND NOT cleared) THEN 1 ELSE 0 END) OVER (PARTITION BY instrument_id ORDER BY session_date) AS run FROM d)
SELECT instrument_id, session_date, CAST(sum(CASE WHEN NOT closed AND NOT broken AND cleared THEN 1 ELSE 0 END) OVER (PARTITION BY instrument_id, run ORDER BY session_date) AS BIGINT) AS cleared_sessions,
 CASE WHEN broken THEN 'KNOWN_BREAK' WHEN NOT closed AND NOT cleared THEN 'UNRESOLVED' ELSE 'CLEARED' END AS state FROM r""")
def _wn17(spark, sf):
    days = table(spark, sf, "grid").join(table(spark, sf, "calendar"), "session_date").join(
        table(spark, sf, "bars_sparse").select("instrument_id", "session_date", "volume"), ["instrument_id", "session_date"], "left")
    days = days.select("instrument_id", "session_date", F.col("status").isin("Weekend", "AnnouncedClosed").alias("closed"),
                       F.coalesce(F.col("volume") >= 150, F.lit(False)).alias("broken"), F.coalesce(F.col("volume") >= 2, F.lit(False)).alias("cleared"))
    return ft.clearance_history(days).select("instrument_id", "session_date", "cleared_sessions", "state")


@query("jn1_align_benchmark", """
SELECT r.instrument_id, r.session_date, r.pos, CAST(b.close AS DOUBLE) AS b_close,
 count(b.close) OVER (PARTITION BY r.instrument_id, r.run_id ORDER BY r.pos ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) = 21 AS aligned_21
FROM {{run_rows}} r LEFT JOIN {{benchmark_daily}} b ON b.session_date = r.session_date""")
def _jn1(spark, sf):
    return ft.feature_values(aligned(spark, sf)).select("instrument_id", "session_date", "pos", "b_close", (F.col("__aligned_20") == 21).alias("aligned_21"))


@query("ud1_smooth_function", """
WITH a AS (SELECT instrument_id, list(CAST(close AS DOUBLE) ORDER BY session_date) AS v FROM {{bars_weekly}} GROUP BY instrument_id)
SELECT instrument_id, CASE WHEN len(v) >= 20 THEN round(list_reduce(list_concat([list_sum(v[1:20]) / 20], v[21:]), lambda acc, x: acc + 2.0::DOUBLE / 21 * (x - acc)), 6) END AS ema20 FROM a""")
def _ud1(spark, sf):
    smoothing.register_sql_functions(spark)
    bars = table(spark, sf, "bars_weekly").groupBy("instrument_id").agg(F.sort_array(F.collect_list(F.struct("session_date", F.col("close").cast("double").alias("c")))).alias("s"))
    return bars.selectExpr("instrument_id", "round(tidemark_smooth(transform(s, e -> e.c), 20, 2D / 21), 6) AS ema20")
