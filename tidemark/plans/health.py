"""Data health."""

from pyspark.sql import functions as F

from tidemark.operators import health as hl
from tidemark.plans.adapters import TEXT, table
from tidemark.plans.registry import query

TEXT["health_bars"] = """
SELECT instrument_id, session_date, open, high, low, close, CASE WHEN volume = 1 THEN 0 ELSE volume END AS volume,
 CASE WHEN volume % 17 = 0 THEN 'DEGRADED' WHEN volume % 19 = 0 THEN 'STALE' WHEN volume % 23 = 0 THEN 'REJECTED' WHEN volume % 29 = 0 THEN 'UNKNOWN' ELSE 'VALID' END AS quality
FROM {{bars_sparse}} WHERE DAYS(session_date, DATE '1970-01-01') % 37 <> 0"""
COUNTS = ", ".join([f"count(*) FILTER (WHERE quality = '{q}') AS q_{q.lower()}" for q in hl.QUALITY] + [
    "count(*) FILTER (WHERE open = high AND high = low AND low = close) AS flat", "count(*) FILTER (WHERE volume = 0) AS zero_volume"])


@query("ag1_session_health", f"""
SELECT session_date, count(*) AS bars, count(DISTINCT instrument_id) AS instruments, greatest(0, 25 - count(DISTINCT instrument_id)) AS coverage_gap, {COUNTS} FROM {{{{health_bars}}}} GROUP BY session_date""")
def _ag1(spark, sf):
    return hl.session_health(table(spark, sf, "health_bars"), 25)


@query("ag2_calendar_gaps", """
WITH s AS (SELECT DISTINCT session_date FROM {{health_bars}}), d AS (SELECT CAST(unnest(generate_series((SELECT min(session_date) FROM s), (SELECT max(session_date) FROM s), INTERVAL 1 DAY)) AS DATE) AS session_date)
SELECT d.session_date, h.holiday_name, h.kind, h.holiday_name IS NOT NULL AS known_holiday FROM d LEFT JOIN {{holidays}} h ON h.holiday_date = d.session_date
WHERE ISODOW(d.session_date) <= 5 AND d.session_date NOT IN (SELECT session_date FROM s)""")
def _ag2(spark, sf):
    return hl.calendar_gaps(table(spark, sf, "health_bars"), table(spark, sf, "holidays"))


@query("ag3_anomalies", """
SELECT session_date, instrument_id, quality, 'FLAT_OHLC' AS observation FROM {{health_bars}} WHERE open = high AND high = low AND low = close
UNION ALL SELECT session_date, instrument_id, quality, 'ZERO_VOLUME' FROM {{health_bars}} WHERE volume = 0""")
def _ag3(spark, sf):
    return hl.anomalies(table(spark, sf, "health_bars"))


@query("ag4_health_report", f"""
SELECT 'OK' AS verdict, max(session_date) AS last_session, 25 AS expected_panel, count(*) AS bars, bool_or(quality <> 'VALID') AS degraded, {COUNTS} FROM {{{{health_bars}}}}""")
def _ag4(spark, sf):
    return hl.health_report(table(spark, sf, "health_bars"), 25)


@query("jn6_session_delta", """
WITH n AS (SELECT DISTINCT session_date FROM {{health_bars}} ORDER BY session_date DESC LIMIT 2), p AS (SELECT max(session_date) AS a, min(session_date) AS b FROM n),
 o AS (SELECT instrument_id, close FROM {{health_bars}}, p WHERE session_date = b), w AS (SELECT instrument_id, close FROM {{health_bars}}, p WHERE session_date = a)
SELECT coalesce(o.instrument_id, w.instrument_id) AS instrument_id, CASE WHEN o.close IS NOT NULL AND w.close IS NOT NULL THEN 'COMPARED' ELSE 'MISSING' END AS status,
 CASE WHEN o.close IS NOT NULL THEN b END AS previous_session, o.close AS previous_close, CASE WHEN w.close IS NOT NULL THEN a END AS new_session, w.close AS new_close,
 w.close - o.close AS change, round(CAST(w.close - o.close AS DOUBLE) / CAST(o.close AS DOUBLE) * 100, 6) AS change_percent,
 CASE WHEN w.close IS NULL THEN 'MISSING_NEW_SESSION' WHEN o.close IS NULL THEN 'MISSING_PREVIOUS_SESSION' END AS reason,
 CASE WHEN w.close IS NULL THEN 'PREVIOUS_ONLY' WHEN o.close IS NULL THEN 'NEW_ONLY' END AS present_in
FROM o FULL JOIN w ON o.instrument_id = w.instrument_id CROSS JOIN p""")
def _jn6(spark, sf):
    return hl.session_delta(table(spark, sf, "health_bars")).withColumn("change_percent", F.round("change_percent", 6))
