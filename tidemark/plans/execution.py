"""Readiness over a history, technical execution and candidates."""

from pyspark.sql import functions as F

from tidemark.operators import technical as tc
from tidemark.plans.adapters import TEXT, table
from tidemark.plans.evidence import REASONS15
from tidemark.plans.registry import query
from tidemark.plans.screening import episode_sql

# Requests: the last bar of each month of each flag and status, with the 329 days before it. Benchmark: all flags together.
TEXT["technical_bars"] = "SELECT * FROM {{bars_mixed}}"
TEXT["technical_benchmark"] = """
SELECT 'ALL' AS instrument_id, session_date, min_by(px, seq) AS open, max(px) AS high, min(px) AS low, max_by(px, seq) AS close, CAST(sum(qty) AS BIGINT) AS volume FROM {{trades}} GROUP BY session_date"""
TEXT["technical_requests"] = """
SELECT concat(instrument_id, '@', CAST(max(session_date) AS VARCHAR(10))) AS request_id, instrument_id, 'ALL' AS benchmark_id, max(session_date) - 329 AS history_from, max(session_date) AS evaluation_date, CAST(max(session_date) AS TIMESTAMP) + INTERVAL '20' HOUR AS cutoff
FROM {{technical_bars}} GROUP BY instrument_id, date_trunc('month', session_date)"""
N = "DAYS(c.session_date, DATE '1970-01-01')"
TEXT["technical_days"] = f"""
SELECT r.request_id, c.session_date, c.session_date = r.evaluation_date AS target, coalesce(ISODOW(c.session_date) <= 5 AND {N} % 29 = 0, false) AS closed, coalesce({N} % 29 <> 0 AND {N} % 211 <> 7, false) AS completed, ISODOW(c.session_date) <= 5 AS scheduled_open, false AS schedule_conflicting,
 CASE WHEN {N} % 1009 BETWEEN 0 AND 2 THEN 'X2' WHEN {N} % 1009 = 3 THEN 'X3' WHEN {N} % 307 = 5 THEN NULL ELSE 'X1' END AS exchange_id, CASE WHEN year(c.session_date) = 1995 AND month(c.session_date) < 3 THEN 'USD' ELSE 'IDR' END AS currency,
 {N} % 409 <> 11 AS coverage, {N} % 613 = 3 AS failed, CASE WHEN {N} % 701 = 20 OR ({N} % 29 = 0 AND {N} % 5 = 0 AND {N} % 3 = 0) THEN 1 ELSE 0 END AS breaks, CASE WHEN b.session_date IS NULL THEN 0 WHEN b.volume = 13 THEN 2 ELSE 1 END AS matching_prices,
 b.volume, CASE WHEN b.volume % 97 = 0 THEN 'LOTS' ELSE 'SHARES' END AS volume_unit, 'RAW_AS_TRADED' AS volume_basis, 'REGULAR' AS market_segment
FROM {{{{technical_requests}}}} r JOIN {{{{calendar}}}} c ON c.session_date BETWEEN r.history_from AND r.evaluation_date LEFT JOIN {{{{technical_bars}}}} b ON b.instrument_id = r.instrument_id AND b.session_date = c.session_date"""
TEXT["technical_side"] = f"""
SELECT r.request_id, c.session_date, c.session_date = r.evaluation_date AS target, coalesce(ISODOW(c.session_date) <= 5 AND {N} % 29 = 0, false) AS closed, coalesce({N} % 29 <> 0 AND {N} % 211 <> 7, false) AS completed, ISODOW(c.session_date) <= 5 AS scheduled_open, false AS schedule_conflicting,
 'X1' AS exchange_id, 'IDR' AS currency, {N} % 409 <> 11 AS coverage, false AS failed, CASE WHEN {N} % 503 = 20 THEN 1 ELSE 0 END AS breaks, CASE WHEN b.session_date IS NULL THEN 0 ELSE 1 END AS matching_prices
FROM {{{{technical_requests}}}} r JOIN {{{{calendar}}}} c ON c.session_date BETWEEN r.history_from AND r.evaluation_date LEFT JOIN {{{{technical_benchmark}}}} b ON b.session_date = c.session_date"""
TEXT["technical_market"] = f"""
SELECT request_id, session_date, false AS identity_conflict, true AS identity_verified, false AS type_unsupported, true AS type_known, {N} % 83 = 2 AS pre_listing, false AS post_delisting, true AS listing_known, false AS board_conflict, false AS mechanism_unresolved, {N} % 103 <> 9 AS board_known, false AS board_unsupported, true AS mechanism_known,
 CASE WHEN {N} % 61 = 1 THEN 'SUSPENDED' ELSE 'TRADING' END AS status, CASE WHEN {N} % 127 = 4 THEN 'STALE' ELSE 'VERIFIED' END AS status_quality, completed AS session_completed FROM {{{{technical_days}}}} c"""


def states_sql(source: str, name: str) -> str:
    """The fold day by day, as one would state it: the previous binding is carried, cleared or replaced."""
    skip = "(NOT target AND ((closed AND NOT completed) OR (ISODOW(session_date) > 5 AND NOT completed AND NOT scheduled_open AND NOT schedule_conflicting)))"
    return f"""
 {name}n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY session_date) AS rn, {skip} AS skip, exchange_id IS NOT NULL AND currency IS NOT NULL AS bound FROM {source}),
 {name}f AS (SELECT request_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS VARCHAR) AS px, CAST(NULL AS VARCHAR) AS pc, CAST(0 AS BIGINT) AS run_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS pos, true AS same_x, true AS same_c, false AS reset FROM {name}n WHERE rn = 1
  UNION ALL SELECT request_id, rn, CASE WHEN bad THEN NULL WHEN skip THEN px ELSE exchange_id END, CASE WHEN bad THEN NULL WHEN skip THEN pc ELSE currency END, run_id + CAST(bad AS BIGINT), CASE WHEN bad THEN 0 WHEN skip THEN n ELSE n + 1 END, CASE WHEN NOT bad AND NOT skip THEN n + 1 END, sx, sc, bad
  FROM (SELECT *, CASE WHEN skip THEN breaks > 0 OR NOT coverage OR NOT bound OR NOT sx OR NOT sc ELSE breaks > 0 OR NOT sx OR NOT sc OR matching_prices <> 1 OR NOT completed OR closed OR NOT coverage OR failed END AS bad
   FROM (SELECT d.*, f.px, f.pc, f.run_id, f.n, bound AND coalesce(f.px = d.exchange_id, true) AS sx, bound AND coalesce(f.pc = d.currency, true) AS sc FROM {name}f f JOIN {name}n d ON d.request_id = f.request_id AND d.rn = f.rn + 1) a) b),
 {name} AS MATERIALIZED (SELECT d.*, f.run_id, f.pos, f.reset, {REASONS15.replace("identity_continuity", "f.same_x").replace("currency_continuity", "f.same_c").replace("convention_continuity", "(matching_prices = 1)").replace("session_continuity", "(completed AND NOT closed)").replace("action_coverage", "(coverage AND NOT failed)").replace("revision_binding", "(matching_prices = 1 AND NOT failed)")} AS why
  FROM {name}n d JOIN {name}f f USING (request_id, rn)),
 {name}s AS MATERIALIZED (SELECT *, CASE WHEN skip THEN CASE WHEN reset THEN CASE WHEN breaks > 0 THEN 'KNOWN_BREAK' ELSE 'UNRESOLVED' END END WHEN breaks > 0 THEN 'KNOWN_BREAK' WHEN why <> '' THEN 'UNRESOLVED' ELSE 'CLEARED' END AS comparability,
   CASE WHEN skip THEN CASE WHEN reset THEN CASE WHEN breaks > 0 THEN 'PRICE_KNOWN_BREAK' ELSE 'PRICE_UNRESOLVED' END END WHEN breaks > 0 THEN 'PRICE_KNOWN_BREAK' WHEN why <> '' THEN why ELSE 'PRICE_CLEARED' END AS codes FROM {name})"""


def days(spark, sf):
    return tc.history_states(table(spark, sf, "technical_days")), tc.history_states(table(spark, sf, "technical_side"))


@query("sm15_history_states", f"WITH RECURSIVE {states_sql('{{technical_days}}', 'h')} SELECT request_id, session_date, skip AS bridged, comparability, codes, run_id, pos FROM hs")
def _history(spark, sf):
    return days(spark, sf)[0].select("request_id", "session_date", "bridged", "comparability", F.array_join("comparability_reasons", ",").alias("codes"), "run_id", "pos")


NEED = {"Ema20": 20, "Ema50": 50, "Atr14": 15, "PriorHigh20": 21, "PriorLow20": 21, "DistanceToHighPercent": 21}
MARKET = """CASE WHEN pre_listing THEN 'PRE_LISTING' WHEN NOT board_known THEN 'BOARD_UNKNOWN' WHEN status = 'SUSPENDED' THEN 'SUSPENDED' WHEN status_quality = 'STALE' THEN 'STATUS_STALE' WHEN NOT m.session_completed THEN 'SESSION_UNCONFIRMED' END"""
READY = f"""{states_sql('{{technical_days}}', 'h')}, {states_sql('{{technical_side}}', 'b')},
 bars AS (SELECT h.request_id, h.session_date, h.run_id, h.pos, b.pos AS bpos, b.run_id AS brun, lag(h.session_date) OVER (PARTITION BY h.request_id, h.run_id ORDER BY h.pos) AS mine, (SELECT max(p.session_date) FROM bs p WHERE p.request_id = b.request_id AND p.run_id = b.run_id AND p.pos = b.pos - 1) AS theirs
  FROM hs h LEFT JOIN bs b ON b.request_id = h.request_id AND b.session_date = h.session_date AND b.pos IS NOT NULL WHERE h.pos IS NOT NULL),
 al AS (SELECT *, CASE WHEN bpos IS NULL THEN 0 ELSE pos - max(CASE WHEN NOT coalesce(mine = theirs, false) THEN pos END) OVER (PARTITION BY request_id, run_id ORDER BY pos) + 1 END AS aligned FROM bars),
 hx AS (SELECT *, count(pos) OVER u AS nb, coalesce(max(pos) OVER (PARTITION BY request_id, run_id ORDER BY session_date), 0) AS n, max(breaks) OVER u > 0 AS broken, coalesce(bool_or(comparability <> 'CLEARED') OVER u, false) AS unclear, list(codes) FILTER (WHERE comparability <> 'CLEARED') OVER u AS cs FROM hs WINDOW u AS (PARTITION BY request_id ORDER BY session_date)),
 hb AS (SELECT request_id, session_date, min(CASE WHEN volume > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY request_id ORDER BY session_date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) = 1 AS traded,
   count(*) FILTER (WHERE volume_unit = 'SHARES') OVER (PARTITION BY request_id, run_id ORDER BY pos ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) = least(pos, 21) AS comparable FROM hs WHERE pos IS NOT NULL),
 m AS (SELECT request_id, session_date, {MARKET} AS market_reason FROM {{{{technical_market}}}} m),
 z AS (SELECT h.request_id, h.session_date, h.target, h.run_id, h.pos, h.n, h.comparability, h.cs, h.currency, h.nb, CASE WHEN broken THEN 'KNOWN_BREAK' WHEN unclear THEN 'UNRESOLVED' ELSE 'CLEARED' END AS history_comparability, m.market_reason, CASE WHEN m.market_reason IS NULL THEN 'ELIGIBLE' WHEN m.market_reason IN ('PRE_LISTING', 'SUSPENDED') THEN 'INELIGIBLE' ELSE 'DATA_BLOCKED' END AS market_status,
   coalesce(al.aligned, 0) AS aligned, al.brun, coalesce(bd.comparability = 'CLEARED' AND bd.pos > 0, false) AS ready_b, coalesce(bd.pos, 0) AS bpos, coalesce(hb.traded, false) AS traded, coalesce(hb.comparable, false) AS comparable, h.codes,
   CASE WHEN h.comparability = 'KNOWN_BREAK' THEN 'PRICE_KNOWN_BREAK' WHEN h.comparability <> 'CLEARED' THEN 'PRICE_UNRESOLVED' END AS pr
  FROM hx h JOIN m USING (request_id, session_date) LEFT JOIN al USING (request_id, session_date) LEFT JOIN bs bd ON bd.request_id = h.request_id AND bd.session_date = h.session_date LEFT JOIN hb ON hb.request_id = h.request_id AND hb.session_date = h.session_date WHERE NOT h.skip),
 o AS (SELECT *, coalesce(pr, CASE WHEN n < 50 THEN 'INSUFFICIENT_HISTORY' END) AS core_reason, CASE WHEN NOT comparable THEN 'VOLUME_BASIS_UNVERIFIED' WHEN n < 21 OR NOT traded THEN 'INSUFFICIENT_HISTORY' END AS o_volume,
   CASE WHEN NOT comparable OR currency <> 'IDR' THEN 'VOLUME_BASIS_UNVERIFIED' WHEN n < 21 THEN 'INSUFFICIENT_HISTORY' END AS o_money, coalesce(pr, CASE WHEN NOT ready_b OR aligned = 0 THEN 'BENCHMARK_MISSING' WHEN aligned < 21 OR n < 21 THEN 'INSUFFICIENT_HISTORY' END) AS o_rs20,
   coalesce(pr, CASE WHEN NOT ready_b OR aligned = 0 THEN 'BENCHMARK_MISSING' WHEN aligned < 61 OR n < 61 THEN 'INSUFFICIENT_HISTORY' END) AS o_rs60, CASE WHEN NOT ready_b THEN 'BENCHMARK_MISSING' WHEN bpos < 50 THEN 'INSUFFICIENT_HISTORY' END AS o_context FROM z),
 rd AS MATERIALIZED (SELECT *, market_reason IS NULL AND comparability = 'CLEARED' AND core_reason IS NULL AS data_ready, list_sort(list_distinct(list_filter(list_concat(string_split(coalesce(array_to_string(cs, ','), ''), ','), [market_reason, CASE WHEN market_reason IS NOT NULL THEN 'MARKET_NOT_ELIGIBLE' END, CASE WHEN comparability <> 'CLEARED' THEN 'DATA_NOT_READY' END, pr,
   CASE WHEN pr IS NULL AND n < 50 THEN 'INSUFFICIENT_HISTORY' END, o_volume, o_money, 'PRICE_BASIS_UNVERIFIED', o_rs20, o_rs60, o_context]), lambda t: t IS NOT NULL AND t <> ''))) AS diagnostics FROM o)"""


def readiness(spark, sf):
    stock, side = days(spark, sf)
    return tc.compose_readiness(stock, side, table(spark, sf, "technical_market")), side


@query("sm15_compose_readiness", f"""WITH RECURSIVE {READY}
SELECT request_id, session_date, n AS observations, comparability, history_comparability, market_status, data_ready, core_reason AS ema50_reason, o_volume, o_money, o_rs20, o_rs60, o_context, array_to_string(diagnostics, ',') AS diagnostics FROM rd""")
def _readiness(spark, sf):
    ready, _ = readiness(spark, sf)
    of = lambda c, name: F.get(F.filter(c, lambda s: s["feature"] == name), F.lit(0))["reason"]
    names = {"o_volume": "RelativeVolume", "o_money": "MonetaryLiquidityProxy", "o_rs20": "Rs20", "o_rs60": "Rs60", "o_context": "MarketContext"}
    return ready.select("request_id", "session_date", "observations", "comparability", "history_comparability", "market_status", "data_ready", of("core", "Ema50").alias("ema50_reason"), *[of("optional", v).alias(k) for k, v in names.items()], F.array_join("diagnostics", ",").alias("diagnostics"))


def smooth_sql(values: str, seed: int, alpha: str) -> str:
    return f"list_reduce(list_concat([list_sum({values}[1:{seed}]) / {seed}], {values}[{seed + 1}:]), lambda a, x: a + {alpha} * (x - a))"


EXECUTED = f"""{READY},
 t AS (SELECT * FROM rd WHERE target), ok AS (SELECT * FROM t WHERE data_ready),
 rows AS MATERIALIZED (SELECT r.*, t.request_id AS rid, b.open, b.high, b.low, b.close, b.volume, CASE WHEN r.brun = t.brun THEN CAST(s.close AS DOUBLE) END AS b_close, CASE WHEN r.data_ready THEN 'ELIGIBLE' WHEN r.market_status = 'INELIGIBLE' THEN 'INELIGIBLE' ELSE 'DATA_BLOCKED' END AS eligibility
  FROM ok t JOIN rd r ON r.request_id = t.request_id AND r.run_id = t.run_id AND r.pos IS NOT NULL JOIN {{{{technical_requests}}}} q ON q.request_id = t.request_id JOIN {{{{technical_bars}}}} b ON b.instrument_id = q.instrument_id AND b.session_date = r.session_date LEFT JOIN {{{{technical_benchmark}}}} s ON s.session_date = r.session_date),
 w AS MATERIALIZED (SELECT *, CASE WHEN pos > 20 THEN max(high) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS ph, min(low) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS pl, greatest(CAST(high - low AS DOUBLE), abs(high - lag(close) OVER (PARTITION BY rid ORDER BY pos)), abs(low - lag(close) OVER (PARTITION BY rid ORDER BY pos))) AS tr FROM rows),
 f AS (SELECT rid, count(*) AS bars, list(CAST(close AS DOUBLE) ORDER BY pos) AS c, list(CAST(tr AS DOUBLE) ORDER BY pos) FILTER (WHERE pos > 1) AS tr, list(CAST(volume AS DOUBLE) ORDER BY pos) AS v, list(b_close ORDER BY pos) AS b, max_by(ph, pos) AS ph, max_by(pl, pos) AS pl,
   string_agg(concat_ws('|', CAST(session_date AS VARCHAR), CAST(open AS VARCHAR), CAST(high AS VARCHAR), CAST(low AS VARCHAR), CAST(close AS VARCHAR), CAST(volume AS VARCHAR)), chr(10) ORDER BY session_date) AS lines,
   string_agg(concat_ws('|', CAST(session_date AS VARCHAR), market_status, coalesce(market_reason, '-'), CAST(data_ready AS VARCHAR), CAST(data_ready AS VARCHAR)), chr(10) ORDER BY session_date) AS history FROM w GROUP BY rid),
 bx AS (SELECT b.request_id, b.pos, CAST(s.close AS DOUBLE) AS c, greatest(CAST(s.high - s.low AS DOUBLE), abs(s.high - lag(s.close) OVER (PARTITION BY b.request_id ORDER BY b.pos)), abs(s.low - lag(s.close) OVER (PARTITION BY b.request_id ORDER BY b.pos))) AS tr FROM ok t JOIN bs b ON b.request_id = t.request_id AND b.run_id = t.brun AND b.pos IS NOT NULL JOIN {{{{technical_benchmark}}}} s ON s.session_date = b.session_date),
 bg AS (SELECT request_id AS rid, list(c ORDER BY pos) AS c, list(CAST(tr AS DOUBLE) ORDER BY pos) FILTER (WHERE pos > 1) AS tr FROM bx GROUP BY 1),
 {episode_sql("SELECT rid AS instrument_id, session_date, pos AS rn, eligibility, close, ph AS high FROM w")},
 le AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY instrument_id ORDER BY rn DESC) = 1),
 y AS (SELECT f.*, {smooth_sql('c', 20, '2.0::DOUBLE / 21')} AS e20, {smooth_sql('c', 50, '2.0::DOUBLE / 51')} AS e50, {smooth_sql('tr', 14, '1.0::DOUBLE / 14')} AS a14 FROM f),
 bk AS (SELECT rid, c[-1] AS bc, {smooth_sql('c', 20, '2.0::DOUBLE / 21')} AS b20, {smooth_sql('c', 50, '2.0::DOUBLE / 51')} AS b50, {smooth_sql('tr', 14, '1.0::DOUBLE / 14')} AS b14 FROM bg),
 res AS (SELECT q.request_id, q.instrument_id, q.evaluation_date, q.cutoff, q.history_from, t.data_ready AS technical_evaluated, CASE WHEN NOT t.data_ready THEN 'DATA_NOT_READY' END AS failure, t.market_status, t.o_context, t.o_volume, t.o_rs20, t.o_rs60, t.diagnostics, y.*, bk.* EXCLUDE (rid), le.setup, le.evaluated, le.setup_reason, le.start_date, le.age, le.confirmed_age, le.trigger_price
  FROM {{{{technical_requests}}}} q JOIN t ON t.request_id = q.request_id LEFT JOIN y ON y.rid = q.request_id LEFT JOIN bk ON bk.rid = q.request_id LEFT JOIN le ON le.instrument_id = q.request_id),
 tech AS MATERIALIZED (SELECT *, CASE WHEN start_date IS NOT NULL THEN concat('screener-v0.2.0/', instrument_id, '/', CAST(start_date AS VARCHAR)) END AS episode_id,
   array_to_string(list_sort(list_distinct(list_concat(diagnostics, CASE WHEN technical_evaluated THEN [setup_reason] ELSE ['NOT_EVALUATED', failure] END))), ',') AS reasons,
   CASE WHEN technical_evaluated THEN sha256(concat('screener-v0.2.0|1|', request_id, '|', instrument_id, '|ALL|', CAST(history_from AS VARCHAR), '|', CAST(evaluation_date AS VARCHAR), '|', strftime(cutoff, '%Y-%m-%d %H:%M:%S'), chr(10), chr(10), lines, chr(10), chr(10), history)) END AS input_hash FROM res)"""


def executed(spark, sf):
    ready, side = readiness(spark, sf)
    return tc.technical_results(table(spark, sf, "technical_requests"), ready, table(spark, sf, "technical_bars"), side, table(spark, sf, "technical_benchmark"))


@query("sm16_technical_results", f"""WITH RECURSIVE {EXECUTED}
SELECT request_id, technical_evaluated, failure, bars, CASE WHEN technical_evaluated THEN setup ELSE 'NONE' END AS setup, setup_reason, episode_id, age, confirmed_age, CAST(trigger_price AS DOUBLE) AS trigger_price, CAST(ph AS DOUBLE) AS prior_high, CAST(pl AS DOUBLE) AS prior_low, round(e20, 4) AS ema20, round(e50, 4) AS ema50, round(a14, 4) AS atr14,
 CASE WHEN o_volume IS NULL THEN round(v[-1] / (list_sum(v[-21:-2]) / 20), 6) END AS volume_ratio, CASE WHEN o_rs20 IS NULL THEN round(100 * ((c[-1] / c[-21] - 1) - (b[-1] / b[-21] - 1)), 6) END AS rs20, CASE WHEN o_rs60 IS NULL THEN round(100 * ((c[-1] / c[-61] - 1) - (b[-1] / b[-61] - 1)), 6) END AS rs60,
 CASE WHEN NOT technical_evaluated THEN 'UNKNOWN' WHEN c[-1] > e20 AND e20 > e50 THEN 'POSITIVE' WHEN c[-1] < e20 AND e20 < e50 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS trend,
 CASE WHEN NOT technical_evaluated OR o_context IS NOT NULL THEN 'UNKNOWN' WHEN bc > b20 AND b20 > b50 THEN 'POSITIVE' WHEN bc < b20 AND b20 < b50 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS benchmark_trend,
 CASE WHEN NOT technical_evaluated OR o_context IS NOT NULL THEN 'UNKNOWN' WHEN 100 * b14 / bc >= 2 THEN 'ELEVATED' ELSE 'NORMAL' END AS benchmark_volatility, reasons, input_hash FROM tech""")
def _technical(spark, sf):
    """Features and episode of every monthly request, over the run that reaches its date."""
    x = executed(spark, sf)
    value = lambda c, n: F.round(F.col(f"{c}.value"), n)
    return x.select(
        "request_id", "technical_evaluated", "failure", F.when(F.col("technical_evaluated"), F.col("bars")).alias("bars"), "setup", "setup_reason", "episode_id", "age", "confirmed_age", F.col("trigger_price").cast("double").alias("trigger_price"), F.col("priorHigh20.value").alias("prior_high"), F.col("priorLow20.value").alias("prior_low"),
        value("ema20", 4).alias("ema20"), value("ema50", 4).alias("ema50"), value("atr14", 4).alias("atr14"), value("volumeRatio20", 6).alias("volume_ratio"), value("rs20Pp", 6).alias("rs20"), value("rs60Pp", 6).alias("rs60"), "trend", "benchmark_trend", "benchmark_volatility", F.array_join("reasons", ",").alias("reasons"), "input_hash")


AS_ID = "concat_ws('-', substr({0}, 1, 8), substr({0}, 9, 4), substr({0}, 13, 4), substr({0}, 17, 4), substr({0}, 21, 12))"


@query("sm16_promote_candidates", f"""WITH RECURSIVE {EXECUTED},
 c AS (SELECT *, {AS_ID.format('input_hash')} AS capture_id FROM tech WHERE technical_evaluated), d AS (SELECT *, sha256(concat('screener-technical-candidate-v0.2.0|1|', capture_id, '|', input_hash)) AS h FROM c)
SELECT {AS_ID.format('h')} AS decision_id, request_id, capture_id, setup, market_status = 'ELIGIBLE' AND evaluated AND setup IN ('CONFIRMED', 'WATCH') AS candidate, reasons, CASE WHEN request_id < 'AF@1994' THEN 'RETAINED' ELSE 'INSERTED' END AS disposition FROM d""")
def _promote(spark, sf):
    """Decisions of every evaluated request; those of an earlier run are found again under the same ids."""
    results = executed(spark, sf)
    earlier = tc.promote(results.where("request_id < 'AF@1994'"))
    return tc.promote(results, earlier).select("decision_id", "request_id", "capture_id", "setup", "candidate", F.array_join("reasons", ",").alias("reasons"), "disposition")
