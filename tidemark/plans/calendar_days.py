"""Session evidence, gates, boundaries and day verdicts."""

from pyspark.sql import functions as F

from tidemark.operators import calendar as cal
from tidemark.operators import pit
from tidemark.plans.adapters import TEXT, table
from tidemark.plans.registry import query

# One proof per day (the lowest status at the latest knowledge), for operators that take one.
TEXT["proof_one"] = "SELECT session_date, min(status) AS status, min(reference) AS reference, min(known_at) AS known_at, min(completed_at) AS completed_at FROM {{proofs}} GROUP BY session_date"
TEXT["grid"] = """
SELECT b.instrument_id, c.session_date FROM (SELECT DISTINCT p_brand AS instrument_id FROM {{part}}) b CROSS JOIN (SELECT session_date FROM {{calendar}}) c"""
TEXT["listed_grid"] = """
WITH t AS (SELECT instrument_id, max(known_at) AS known_at FROM {{boundaries}} WHERE known_at <= TIMESTAMP '1998-06-30' GROUP BY instrument_id),
 l AS (SELECT b.instrument_id, min(b.listed_from) AS listed_on, max(b.delisted_at) AS delisted_on
       FROM {{boundaries}} b JOIN t ON b.instrument_id = t.instrument_id AND b.known_at = t.known_at
       WHERE b.status = 'VERIFIED' AND substr(b.instrument_id, 7, 1) <> '2' GROUP BY b.instrument_id)
SELECT g.instrument_id, g.session_date, l.listed_on, l.delisted_on FROM {{grid}} g LEFT JOIN l ON g.instrument_id = l.instrument_id"""
TEXT["instrument_proofs"] = """
SELECT DISTINCT p_brand AS instrument_id, session_date, CASE WHEN min(line) = 1 THEN 'Suspension' ELSE 'NoTrade' END AS status,
  CAST(session_date AS TIMESTAMP) + INTERVAL '16' HOUR AS known_at, 'https://exchange.example/notice' AS reference
FROM {{trades}} t JOIN {{part}} p ON t.part_key = p.p_partkey WHERE t.disc = 7 GROUP BY p_brand, session_date"""

AT = "2000-06-30 11:30:00"
LOCAL = "(TIMESTAMP '2000-06-30 11:30:00' + INTERVAL '7' HOUR)"
INDEPENDENT = "(reference LIKE 'https://%' AND reference NOT LIKE 'https://%eodhd.com/%')"


def gate(at: str, local: str) -> str:
    return f"""CASE WHEN session_date > CAST({local} AS DATE) THEN 'FUTURE_DATE'
 WHEN session_date = CAST({local} AS DATE) AND strftime({local}, '%H:%M') < '19:00' THEN 'SAFE_EOD_CUTOFF_NOT_REACHED'
 WHEN status IS NULL AND ISODOW(session_date) > 5 THEN 'CLOSED_BY_CALENDAR' WHEN status IS NULL THEN 'SESSION_PROOF_REQUIRED'
 WHEN NOT ({INDEPENDENT} AND known_at <= {at}) THEN 'INDEPENDENT_ALREADY_KNOWN_PROOF_REQUIRED'
 WHEN status IN ('AnnouncedClosed', 'ExceptionalClosure') THEN 'KNOWN_CLOSED' WHEN status <> 'ObservedTrading' THEN 'SESSION_PROOF_REQUIRED'
 WHEN session_date < CAST({local} AS DATE) THEN 'ELIGIBLE_PRIOR_COMPLETED_SESSION'
 WHEN completed_at IS NULL OR completed_at > known_at OR CAST(completed_at + INTERVAL '7' HOUR AS DATE) <> session_date THEN 'COMPLETED_SESSION_EVIDENCE_REQUIRED'
 ELSE 'ELIGIBLE_SAME_DAY_COMPLETED_SESSION' END"""


GATE = gate(f"TIMESTAMP '{AT}'", LOCAL)


def days_of(spark, sf):
    return table(spark, sf, "calendar").select("session_date")


@query("pit11_classify_days", """
SELECT c.session_date, coalesce(p.status, CASE WHEN ISODOW(c.session_date) > 5 THEN 'Weekend' ELSE 'Unknown' END) AS day_status
FROM {{calendar}} c LEFT JOIN {{proof_one}} p ON c.session_date = p.session_date""")
def _pit11(spark, sf):
    return cal.classify_days(days_of(spark, sf), table(spark, sf, "proof_one"))


@query("pit12_session_gate", f"""
SELECT session_date, {GATE} AS gate FROM (SELECT session_date FROM {{{{calendar}}}}) c LEFT JOIN {{{{proof_one}}}} p USING (session_date)""")
def _pit12(spark, sf):
    return cal.session_gate(days_of(spark, sf), table(spark, sf, "proof_one"), AT)


@query("pit13_resolve_sessions", f"""
WITH v AS (SELECT * FROM {{{{proofs}}}} WHERE known_at <= TIMESTAMP '{AT}' AND session_date <= DATE '2000-06-01'),
 t AS (SELECT *, rank() OVER (PARTITION BY session_date ORDER BY known_at DESC) AS rk FROM v),
 g AS (SELECT session_date, max(known_at) AS known_at, count(DISTINCT status || coalesce(CAST(completed_at AS VARCHAR), '-')) AS n,
   min(status) AS status, min(completed_at) AS completed_at, min(reference) AS reference FROM t WHERE rk = 1 GROUP BY session_date),
 j AS (SELECT c.session_date, g.n, CASE WHEN g.n = 1 THEN g.status END AS status, g.reference, g.known_at, g.completed_at FROM {{{{calendar}}}} c LEFT JOIN g ON c.session_date = g.session_date),
 e AS (SELECT *, {GATE} AS gate FROM j)
SELECT session_date,
 CASE WHEN n > 1 OR session_date > DATE '2000-06-01' THEN 'Unknown'
      WHEN status IS NULL THEN CASE WHEN ISODOW(session_date) > 5 THEN 'Weekend' ELSE 'Unknown' END
      WHEN gate LIKE 'ELIGIBLE_%' OR gate = 'KNOWN_CLOSED' THEN status ELSE 'Unknown' END AS day_status,
 CASE WHEN n > 1 THEN 'SESSION_CONFLICT' WHEN session_date > DATE '2000-06-01' THEN 'AFTER_THROUGH'
      WHEN status IS NULL THEN CASE WHEN ISODOW(session_date) > 5 THEN NULL ELSE 'SESSION_UNCONFIRMED' END
      WHEN gate LIKE 'ELIGIBLE_%' OR gate = 'KNOWN_CLOSED' THEN NULL ELSE gate END AS reason FROM e""")
def _pit13(spark, sf):
    return cal.resolve_sessions(days_of(spark, sf), table(spark, sf, "proofs"), "2000-06-01", AT).drop("completed_at")


@query("pit14_collection_eligibility", f"""
WITH p AS (SELECT session_date, count(*) AS n, min(status) AS status, min(reference) AS reference, min(known_at) AS known_at, min(completed_at) AS completed_at
           FROM {{{{proofs}}}} WHERE completed_at IS NOT NULL GROUP BY session_date),
 j AS (SELECT c.session_date, n, status, reference, known_at, completed_at, h.holiday_date IS NOT NULL AS holiday
       FROM (SELECT session_date FROM {{{{calendar}}}}) c LEFT JOIN p ON c.session_date = p.session_date LEFT JOIN {{{{holidays}}}} h ON h.holiday_date = c.session_date),
 e AS (SELECT *, {GATE.replace('status IS NULL', 'n IS NULL')} AS gate FROM j),
 r AS (SELECT *, CASE WHEN gate IN ('FUTURE_DATE', 'SAFE_EOD_CUTOFF_NOT_REACHED', 'CLOSED_BY_CALENDAR') THEN gate
   WHEN n IS NULL AND holiday THEN 'CITED_HOLIDAY' WHEN n IS NULL THEN 'ELIGIBLE_UNPROVEN_PERSONAL' WHEN n > 1 THEN 'CONFLICTING_SESSION_PROOF' ELSE gate END AS reason FROM e)
SELECT session_date, CASE WHEN gate = 'CLOSED_BY_CALENDAR' THEN 'KNOWN_CLOSED' WHEN reason = 'ELIGIBLE_UNPROVEN_PERSONAL' THEN 'UNPROVEN_PERSONAL'
   WHEN n = 1 AND {INDEPENDENT} AND known_at <= TIMESTAMP '{AT}' THEN CASE WHEN status = 'ObservedTrading' THEN 'KNOWN_OPEN' ELSE 'KNOWN_CLOSED' END
   ELSE 'UNKNOWN_SESSION' END AS session_proof, reason LIKE 'ELIGIBLE_%' AS eligible, reason FROM r""")
def _pit14(spark, sf):
    proofs = table(spark, sf, "proofs").where("completed_at is not null")
    return cal.collection_eligibility(days_of(spark, sf), proofs, table(spark, sf, "holidays"), AT, allow_unproven=True)


@query("pit15_latest_trading_day", """
WITH o AS (SELECT session_date FROM {{calendar}} WHERE ISODOW(session_date) <= 5 AND session_date NOT IN (SELECT holiday_date FROM {{holidays}}))
SELECT c.session_date AS as_of, max(o.session_date) AS latest_trading_day FROM {{calendar}} c LEFT JOIN o ON o.session_date < c.session_date GROUP BY c.session_date""")
def _pit15(spark, sf):
    dates = days_of(spark, sf).withColumnRenamed("session_date", "as_of")
    return cal.latest_trading_day(dates, table(spark, sf, "calendar"), table(spark, sf, "holidays"))


@query("pit15_pending_sessions", f"""
WITH g AS (SELECT session_date, {GATE} AS gate FROM (SELECT session_date FROM {{{{calendar}}}}) c LEFT JOIN (SELECT session_date, status, reference, known_at, completed_at FROM {{{{proof_one}}}}) p USING (session_date)),
 e AS (SELECT session_date, gate LIKE 'ELIGIBLE_%' AS eligible, gate IN ('KNOWN_CLOSED', 'CLOSED_BY_CALENDAR') AS closed FROM g WHERE session_date < DATE '2000-06-30'),
 l AS (SELECT concat(flag, CAST(supp_key AS VARCHAR)) AS instrument_id, max(session_date) AS latest_session FROM {{{{trades}}}} WHERE session_date < DATE '2000-06-20' GROUP BY 1)
SELECT instrument_id, latest_session, count(*) FILTER (WHERE eligible) AS pending, min(session_date) FILTER (WHERE NOT closed) AS next_candidate
FROM l LEFT JOIN e ON e.session_date > l.latest_session GROUP BY 1, 2""")
def _pit15b(spark, sf):
    gates = cal.session_gate(days_of(spark, sf), table(spark, sf, "proof_one"), AT)
    gates = gates.select("session_date", F.col("gate").startswith("ELIGIBLE_").alias("eligible"),
                         F.when(F.col("gate").isin("KNOWN_CLOSED", "CLOSED_BY_CALENDAR"), "KNOWN_CLOSED").otherwise("OTHER").alias("session_proof"))
    latest = table(spark, sf, "trades").where("session_date < date '2000-06-20'").groupBy(
        F.concat("flag", F.col("supp_key").cast("string")).alias("instrument_id")).agg(F.max("session_date").alias("latest_session"))
    return cal.pending_sessions(latest, gates, "2000-06-30")


@query("pit16_boundary_state", """
WITH b AS (SELECT *, rank() OVER (PARTITION BY instrument_id ORDER BY known_at DESC) AS rk FROM {{boundaries}} WHERE known_at <= TIMESTAMP '1996-06-30'),
 c AS (SELECT instrument_id, count(DISTINCT concat(status, coalesce(CAST(listed_from AS VARCHAR), '-'), coalesce(CAST(delisted_at AS VARCHAR), '-'), coalesce(CAST(retrieved_at AS VARCHAR), '-'))) AS n,
   max(status) AS status, max(listed_from) AS listed_from, max(delisted_at) AS delisted_at FROM b WHERE rk = 1 GROUP BY instrument_id),
 l AS (SELECT instrument_id, n, CASE WHEN n = 1 AND status = 'VERIFIED' THEN listed_from END AS listed_on, CASE WHEN n = 1 AND status = 'VERIFIED' THEN delisted_at END AS delisted_on FROM c)
SELECT g.instrument_id, g.session_date, l.listed_on, l.delisted_on, CASE WHEN n > 1 THEN 'BOUNDARY_CONFLICT' WHEN g.session_date < listed_on THEN 'PRE_LISTING'
 WHEN g.session_date > delisted_on THEN 'POST_DELISTING' WHEN listed_on IS NULL THEN 'UNKNOWN_BOUNDARY' ELSE 'EXPECTED_SESSION' END AS boundary_state
FROM {{grid}} g LEFT JOIN l ON g.instrument_id = l.instrument_id""")
def _pit16(spark, sf):
    return cal.boundary_state(table(spark, sf, "grid"), table(spark, sf, "boundaries"), "1996-06-30")


STATUS = "CASE WHEN ISODOW(c.session_date) > 5 OR c.status = 'AnnouncedClosed' THEN 'Holiday' WHEN i.status IS NOT NULL THEN i.status WHEN c.status = 'ObservedTrading' THEN 'Trading' ELSE 'Unknown' END"


@query("pit17_classify_availability", f"""
WITH g AS (SELECT l.*, {STATUS} AS session_status FROM {{{{listed_grid}}}} l JOIN {{{{calendar}}}} c ON c.session_date = l.session_date
  LEFT JOIN {{{{instrument_proofs}}}} i ON i.instrument_id = l.instrument_id AND i.session_date = l.session_date)
SELECT g.instrument_id, g.session_date, CASE WHEN g.session_date < listed_on THEN 'PreListing' WHEN g.session_date > delisted_on THEN 'PostDelisting'
  WHEN session_status IN ('Holiday', 'Suspension', 'NoTrade') THEN session_status WHEN session_status = 'Trading' AND b.instrument_id IS NOT NULL THEN 'Available'
  WHEN session_status = 'Trading' AND listed_on IS NULL THEN 'Unknown' WHEN session_status = 'Trading' THEN 'MissingProviderRow' ELSE 'Unknown' END AS availability
FROM g LEFT JOIN {{{{bars_sparse}}}} b ON b.instrument_id = g.instrument_id AND b.session_date = g.session_date""")
def _pit17(spark, sf):
    c = table(spark, sf, "calendar").select("session_date", F.col("status").alias("day"))
    i = table(spark, sf, "instrument_proofs").select("instrument_id", "session_date", F.col("status").alias("special"))
    grid = table(spark, sf, "listed_grid").join(c, "session_date").join(i, ["instrument_id", "session_date"], "left").withColumn(
        "session_status", F.when(cal.weekend() | (F.col("day") == "AnnouncedClosed"), "Holiday").when(F.col("special").isNotNull(), F.col("special"))
        .when(F.col("day") == "ObservedTrading", "Trading").otherwise("Unknown"))
    return cal.classify_availability(grid, table(spark, sf, "bars_sparse")).select("instrument_id", "session_date", "availability")


@query("pit18_observation_verdict", f"""
WITH j AS (SELECT l.instrument_id, l.session_date, l.listed_on, l.delisted_on, l.instrument_id = 'Brand#9' AND ISODOW(l.session_date) = 2 AS err, l.instrument_id = 'Brand#1' AS own,
   p.status, p.reference, p.known_at, i.status AS special, b.volume, CASE WHEN b.volume > 40 THEN 'REGULAR' ELSE 'UNKNOWN' END AS segment
  FROM {{{{listed_grid}}}} l LEFT JOIN {{{{proof_one}}}} p ON p.session_date = l.session_date
  LEFT JOIN {{{{instrument_proofs}}}} i ON i.instrument_id = l.instrument_id AND i.session_date = l.session_date AND i.known_at <= TIMESTAMP '{AT}'
  LEFT JOIN {{{{bars_sparse}}}} b ON b.instrument_id = l.instrument_id AND b.session_date = l.session_date),
 v AS (SELECT *, CASE WHEN session_date < listed_on THEN 'PRE_LISTING' WHEN session_date > delisted_on THEN 'POST_DELISTING'
  WHEN status IS NULL AND ISODOW(session_date) > 5 THEN 'CLOSED' WHEN status IS NULL OR known_at > TIMESTAMP '{AT}' OR trim(reference) = '' THEN 'SESSION_UNCONFIRMED'
  WHEN status IN ('AnnouncedClosed', 'ExceptionalClosure') THEN 'CLOSED' WHEN status <> 'ObservedTrading' THEN 'SESSION_UNCONFIRMED'
  WHEN NOT own AND special = 'Suspension' THEN 'SUSPENDED' WHEN NOT own AND special = 'NoTrade' THEN 'NO_TRADE' WHEN err THEN 'SOURCE_ERROR'
  WHEN volume IS NULL AND listed_on IS NULL THEN 'UNKNOWN' WHEN volume IS NULL THEN 'MISSING' WHEN volume = 1 AND NOT own THEN 'UNKNOWN' ELSE 'AVAILABLE' END AS verdict FROM j)
SELECT instrument_id, session_date, verdict, CASE WHEN verdict = 'CLOSED' AND status IS NULL THEN 'CLOSED_BY_CALENDAR' WHEN verdict = 'UNKNOWN' AND volume IS NULL THEN 'Listing boundary unknown.'
  WHEN verdict = 'UNKNOWN' THEN 'Zero volume does not establish tradable/no-trade/suspension status.' WHEN verdict = 'AVAILABLE' AND own THEN 'Index price observation; volume/tradability not applicable.'
  WHEN verdict = 'AVAILABLE' AND segment = 'UNKNOWN' THEN 'Market segment unresolved; pilot evidence only.' END AS verdict_reason FROM v""")
def _pit18(spark, sf):
    grid = table(spark, sf, "listed_grid").withColumn("source_error", (F.col("instrument_id") == "Brand#9") & (F.weekday("session_date") == 1))
    bars = table(spark, sf, "bars_sparse").select("instrument_id", "session_date", F.when(F.col("volume") == 1, 0).otherwise(F.col("volume")).alias("volume"),
                                                  F.when(F.col("volume") > 40, "REGULAR").otherwise("UNKNOWN").alias("market_segment"))
    out = cal.observation_verdict(grid, bars, table(spark, sf, "proof_one"), table(spark, sf, "instrument_proofs"), AT, "Brand#1")
    return out.select("instrument_id", "session_date", "verdict", "verdict_reason")
