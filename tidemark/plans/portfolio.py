"""Ledger, valuation, reconciliation and references."""

from pyspark.sql import functions as F

from tidemark.functions import smoothing
from tidemark.operators import ledger as lg
from tidemark.operators import setops as st
from tidemark.plans import market  # noqa: F401
from tidemark.plans.adapters import TEXT, table
from tidemark.plans.registry import query

CUTOFF, THROUGH = "2001-06-30 00:00:00", "2001-03-31"

# Three instruments per customer portfolio; sells start in 1998; a ninth of the trades is corrected
# once and some corrections are corrected again.
TEXT["trade_events"] = """
SELECT concat('F', CAST(o_custkey AS VARCHAR(12))) AS portfolio_id, concat('E', CAST(seq AS VARCHAR(20))) AS event_id,
 CASE WHEN flag = 'R' AND session_date >= DATE '1998-01-01' THEN 'SELL' ELSE 'BUY' END AS type, concat('I', CAST(part_key % 3 AS VARCHAR(4))) AS instrument_id,
 session_date AS trade_date, CAST(session_date + 1 AS TIMESTAMP) + INTERVAL '3' HOUR AS known_at, seq * 4 AS event_order, CAST(qty AS DECIMAL(38,10)) AS quantity,
 CAST(100 + disc * 10 + tax + part_key % 50 AS DECIMAL(38,10)) AS price, CAST(qty * 3 AS DECIMAL(38,10)) AS fees, CAST(0 AS DECIMAL(38,10)) AS cash_amount, CAST(NULL AS VARCHAR(32)) AS supersedes, seq, tax, disc
FROM {{trades}} t JOIN {{orders}} o ON o.o_orderkey = t.order_key"""
TEXT["ledger_events"] = """
SELECT portfolio_id, event_id, type, instrument_id, trade_date, known_at, event_order, quantity, price, fees, cash_amount, supersedes FROM {{trade_events}}
UNION ALL SELECT portfolio_id, concat('X', CAST(seq AS VARCHAR(20))), type, instrument_id, trade_date, known_at + INTERVAL '30' DAY, event_order + 1, quantity, price + 1, fees, cash_amount, event_id FROM {{trade_events}} WHERE tax = 8
UNION ALL SELECT portfolio_id, concat('Y', CAST(seq AS VARCHAR(20))), type, instrument_id, trade_date, known_at + INTERVAL '60' DAY, event_order + 2, quantity + 1, price, fees, cash_amount, concat('X', CAST(seq AS VARCHAR(20))) FROM {{trade_events}} WHERE tax = 8 AND disc > 7
UNION ALL SELECT concat('F', CAST(o_custkey AS VARCHAR(12))), concat('D', CAST(o_orderkey AS VARCHAR(20))), CASE WHEN o_orderkey % 40 = 0 THEN 'CASH_WITHDRAWAL' ELSE 'CASH_DEPOSIT' END, NULL, CAST(o_orderdate AS DATE), CAST(o_orderdate AS TIMESTAMP) + INTERVAL '20' HOUR,
 o_orderkey * 4 + 3, CAST(0 AS DECIMAL(38,10)), CAST(0 AS DECIMAL(38,10)), CAST(5 AS DECIMAL(38,10)), CAST(floor(o_totalprice / 20) + 10 AS DECIMAL(38,10)), NULL FROM {{orders}}"""

TEXT["current_events"] = f"""
WITH v AS (SELECT * FROM {{{{ledger_events}}}} WHERE known_at <= TIMESTAMP '{CUTOFF}'),
 r AS (SELECT e.*, coalesce(a.event_order, e.event_order) AS o1, a.supersedes AS s1 FROM v e LEFT JOIN v a ON a.event_id = e.supersedes),
 q AS (SELECT r.*, coalesce(b.event_order, o1) AS economic_order FROM r LEFT JOIN v b ON b.event_id = r.s1),
 s AS (SELECT supersedes AS event_id, min(known_at) AS superseded_at FROM v WHERE supersedes IS NOT NULL GROUP BY 1)
SELECT q.*, s.superseded_at, CASE type WHEN 'CASH_DEPOSIT' THEN cash_amount - fees WHEN 'CASH_WITHDRAWAL' THEN -cash_amount - fees WHEN 'BUY' THEN -(CAST(quantity AS DECIMAL(18,4)) * CAST(price AS DECIMAL(18,4)) + fees) ELSE CAST(quantity AS DECIMAL(18,4)) * CAST(price AS DECIMAL(18,4)) - fees END AS impact
FROM q LEFT JOIN s ON s.event_id = q.event_id"""
FIXED_STEPS = f"""
 live AS (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY trade_date, economic_order, event_id) AS rn, row_number() OVER (PARTITION BY portfolio_id, instrument_id ORDER BY trade_date, economic_order, event_id) AS n,
   sum(impact) OVER (PARTITION BY portfolio_id ORDER BY trade_date, economic_order, event_id) AS cash_after,
   sum(CASE type WHEN 'BUY' THEN quantity WHEN 'SELL' THEN -quantity ELSE 0 END) OVER (PARTITION BY portfolio_id, instrument_id ORDER BY trade_date, economic_order, event_id) AS shares_after
  FROM {{{{current_events}}}} WHERE superseded_at IS NULL AND trade_date <= DATE '{THROUGH}')"""
FIXED_POS = FIXED_STEPS + """,
 f AS (SELECT portfolio_id, instrument_id, CAST(0 AS BIGINT) AS n, 0::DOUBLE AS q, 0::DOUBLE AS c, 0::DOUBLE AS r, 0::DOUBLE AS k, CAST(NULL AS DATE) AS d FROM live WHERE n = 1 AND instrument_id IS NOT NULL
  UNION ALL SELECT f.portfolio_id, f.instrument_id, e.n, CASE WHEN type = 'BUY' THEN q + quantity::DOUBLE ELSE q - quantity::DOUBLE END,
   CASE WHEN type = 'BUY' THEN c - impact::DOUBLE WHEN quantity::DOUBLE = q THEN 0 ELSE c - c * quantity::DOUBLE / q END,
   CASE WHEN type = 'BUY' THEN r WHEN quantity::DOUBLE = q THEN r + impact::DOUBLE - c ELSE r + impact::DOUBLE - c * quantity::DOUBLE / q END, k + impact::DOUBLE, e.trade_date
  FROM f JOIN live e ON e.portfolio_id = f.portfolio_id AND e.instrument_id = f.instrument_id AND e.n = f.n + 1),
 bad AS (SELECT DISTINCT portfolio_id, instrument_id, true AS bad FROM live WHERE type = 'SELL' AND shares_after < 0),
 pos AS (SELECT f.portfolio_id, f.instrument_id, q AS shares, CASE WHEN bad IS NULL THEN c END AS invested_cost, CASE WHEN bad IS NULL THEN r END AS realized, k AS cash_impact, d AS latest_event_date
  FROM f LEFT JOIN bad ON bad.portfolio_id = f.portfolio_id AND bad.instrument_id = f.instrument_id WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY f.portfolio_id, f.instrument_id ORDER BY n DESC) = 1)"""


def steady(value, digits):
    """Rounding after a fixed tiny offset, so that exact halves do not hang on the last bit of a sum."""
    return F.round(value + 0.123 * 10**-digits, digits)


def events(spark, sf):
    return table(spark, sf, "ledger_events")


def project(spark, sf):
    return lg.project_ledger(events(spark, sf), CUTOFF, THROUGH)


def held(spark, sf):
    """Positions alone."""
    return lg.positions(lg.folded(lg.ledger_steps(events(spark, sf), CUTOFF, THROUGH)))


@query("sm1_positions", f"""
WITH RECURSIVE {FIXED_POS} SELECT portfolio_id, instrument_id, round(shares + 0.0000123::DOUBLE, 4) AS shares, round(invested_cost + 0.0000123::DOUBLE, 4) AS invested_cost, round(realized + 0.0000123::DOUBLE, 4) AS realized, round(cash_impact + 0.0000123::DOUBLE, 4) AS cash_impact, latest_event_date,
 CASE WHEN shares <> 0 THEN round(invested_cost / shares + 0.000000123::DOUBLE, 6) END AS average_cost FROM pos""")
def _sm1(spark, sf):
    p = held(spark, sf)
    return p.select("portfolio_id", "instrument_id", steady(F.col("shares").cast("double"), 4).alias("shares"), steady(F.col("invested_cost"), 4).alias("invested_cost"), steady(F.col("realized"), 4).alias("realized"),
                    steady(F.col("cash_impact").cast("double"), 4).alias("cash_impact"), "latest_event_date", steady(F.col("average_cost"), 6).alias("average_cost"))


@query("sm1_cash", f"WITH {FIXED_STEPS} SELECT portfolio_id, CAST(sum(impact) AS DOUBLE) AS cash, count(*) AS events FROM live GROUP BY 1")
def _sm1b(spark, sf):
    return lg.ledger_cash(events(spark, sf), CUTOFF, THROUGH).withColumn("cash", F.col("cash").cast("double"))


@query("sm1_violations", f"""WITH {FIXED_STEPS} SELECT portfolio_id, event_id, trade_date, CASE WHEN type = 'SELL' AND shares_after < 0 THEN 'SELL_EXCEEDS_SHARES' ELSE 'INSUFFICIENT_CASH' END AS violation
FROM live WHERE (type = 'SELL' AND shares_after < 0) OR cash_after < 0""")
def _sm1c(spark, sf):
    return lg.violations(lg.ledger_steps(events(spark, sf), CUTOFF, THROUGH))


@query("sm2_validate_corrections", """
WITH e AS (SELECT event_id, CASE WHEN portfolio_id = 'F7' AND supersedes IS NOT NULL THEN 'F8' ELSE portfolio_id END AS portfolio_id, instrument_id, known_at,
   CASE WHEN price > 170 AND supersedes IS NOT NULL THEN 'gone' WHEN quantity = 11 AND supersedes IS NOT NULL THEN event_id WHEN quantity = 12 AND event_id LIKE 'Y%' THEN concat('E', substr(event_id, 2)) ELSE supersedes END AS supersedes FROM {{ledger_events}}),
 n AS (SELECT supersedes, count(*) AS n FROM e WHERE supersedes IS NOT NULL GROUP BY 1)
SELECT c.event_id, c.supersedes, CASE WHEN c.event_id = c.supersedes THEN 'SELF_CORRECTION' WHEN t.event_id IS NULL THEN 'TARGET_MISSING' WHEN t.portfolio_id <> c.portfolio_id OR t.instrument_id IS DISTINCT FROM c.instrument_id THEN 'TARGET_MISMATCH'
 WHEN n.n > 1 THEN 'ALREADY_CORRECTED' WHEN t.known_at > c.known_at THEN 'TARGET_KNOWN_LATER' ELSE 'VALID' END AS verdict FROM e c JOIN n ON n.supersedes = c.supersedes LEFT JOIN e t ON t.event_id = c.supersedes""")
def _sm2(spark, sf):
    fix = F.col("supersedes").isNotNull()
    e = events(spark, sf).select("event_id", F.when((F.col("portfolio_id") == "F7") & fix, "F8").otherwise(F.col("portfolio_id")).alias("portfolio_id"), "instrument_id", "known_at",
                                 F.when((F.col("price") > 170) & fix, "gone").when((F.col("quantity") == 11) & fix, F.col("event_id"))
                                 .when((F.col("quantity") == 12) & F.col("event_id").startswith("Y"), F.concat(F.lit("E"), F.expr("substr(event_id, 2)"))).otherwise(F.col("supersedes")).alias("supersedes"))
    return lg.validate_corrections(e)


PREFIX = """
WITH k AS (SELECT DISTINCT {keys}, known_at FROM (SELECT {keys}, known_at FROM {{{{current_events}}}} WHERE {has} UNION ALL SELECT {keys}, superseded_at FROM {{{{current_events}}}} WHERE superseded_at IS NOT NULL AND {has})),
 a AS (SELECT {pk}, k.known_at, sum({amount}) OVER (PARTITION BY {pk}, k.known_at ORDER BY e.trade_date, e.economic_order, e.event_id) AS running, {amount} AS v
  FROM k JOIN {{{{current_events}}}} e ON {on} AND e.known_at <= k.known_at AND (e.superseded_at IS NULL OR e.superseded_at > k.known_at) AND {ehas})
SELECT {keys}, known_at, CAST(sum(v) AS DOUBLE) AS total, CAST(least(0, min(running)) AS DOUBLE) AS lowest FROM a GROUP BY {keys}, known_at"""


@query("sm3_cash_prefixes", PREFIX.format(keys="portfolio_id", pk="k.portfolio_id", on="e.portfolio_id = k.portfolio_id", amount="e.impact", has="true", ehas="true"))
def _sm3(spark, sf):
    out = lg.check_prefixes(events(spark, sf), ["portfolio_id"], CUTOFF, lg.cash_amount())
    return out.select("portfolio_id", "known_at", F.col("total").cast("double").alias("total"), F.col("lowest").cast("double").alias("lowest"))


@query("sm3_share_prefixes", PREFIX.format(keys="portfolio_id, instrument_id", pk="k.portfolio_id, k.instrument_id", on="e.portfolio_id = k.portfolio_id AND e.instrument_id = k.instrument_id",
                                           amount="CASE e.type WHEN 'BUY' THEN e.quantity ELSE -e.quantity END", has="instrument_id IS NOT NULL", ehas="e.instrument_id IS NOT NULL"))
def _sm3b(spark, sf):
    out = lg.check_prefixes(events(spark, sf), ["portfolio_id", "instrument_id"], CUTOFF, lg.share_amount())
    return out.select("portfolio_id", "instrument_id", "known_at", F.col("total").cast("double").alias("total"), F.col("lowest").cast("double").alias("lowest"))


TEXT["theses"] = """
SELECT concat('T', CAST(o_orderkey AS VARCHAR(12))) AS thesis_id, portfolio_id, instrument_id, CASE WHEN o_orderpriority = '1-URGENT' THEN n + 1 ELSE n END AS version, CAST(o_orderdate AS TIMESTAMP) AS known_at,
 CASE WHEN n = 1 THEN NULL WHEN o_orderstatus = 'P' THEN 'T0' ELSE concat('T', CAST(prev AS VARCHAR(12))) END AS supersedes, o_orderstatus = 'O' AS active, CASE WHEN o_totalprice > 200000 THEN 'INVEST' ELSE 'FAST_SWING' END AS mandate
FROM (SELECT *, concat('F', CAST(o_custkey AS VARCHAR(12))) AS portfolio_id, 'I1' AS instrument_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev FROM {{orders}}) x"""


@query("sm4_thesis_chain", """
WITH c AS (SELECT portfolio_id, instrument_id, version, count(*) AS n, min(thesis_id) AS thesis_id FROM {{theses}} GROUP BY 1, 2, 3)
SELECT t.thesis_id, t.portfolio_id, t.instrument_id, t.version, CASE WHEN c.n > 1 THEN 'DUPLICATE_VERSION' WHEN t.version > 1 AND p.thesis_id IS NULL THEN 'VERSION_GAP' WHEN t.supersedes IS DISTINCT FROM p.thesis_id THEN 'BROKEN_LINK'
 WHEN p.known_at > t.known_at THEN 'KNOWLEDGE_REGRESSED' ELSE 'VALID' END AS verdict
FROM {{theses}} t JOIN c USING (portfolio_id, instrument_id, version) LEFT JOIN {{theses}} p ON p.portfolio_id = t.portfolio_id AND p.instrument_id = t.instrument_id AND p.version = t.version - 1""")
def _sm4(spark, sf):
    return lg.thesis_chain(table(spark, sf, "theses"))


@query("jn10_event_history", f"""
WITH v AS (SELECT * FROM {{{{ledger_events}}}} WHERE known_at <= TIMESTAMP '2000-01-31') SELECT e.event_id, e.portfolio_id, e.trade_date, e.event_order, min(c.event_id) AS corrected_by FROM v e LEFT JOIN v c ON c.supersedes = e.event_id GROUP BY ALL""")
def _jn10(spark, sf):
    return lg.event_history(events(spark, sf), "2000-01-31").select("event_id", "portfolio_id", "trade_date", "event_order", "corrected_by")


TEXT["raw_events"] = """
SELECT concat('E', CAST(seq AS VARCHAR(20))) AS event_id, CASE WHEN tax = 3 THEN 'CASH_DEPOSIT' WHEN tax = 4 THEN 'GIFT' WHEN flag = 'R' THEN 'SELL' ELSE 'BUY' END AS type, CASE WHEN disc = 3 THEN NULL ELSE concat('I', CAST(part_key % 3 AS VARCHAR(4))) END AS instrument_id,
 session_date AS trade_date, CAST(session_date + CASE WHEN disc = 4 THEN -1 ELSE 1 END AS TIMESTAMP) AS known_at, CAST(CASE WHEN tax = 3 THEN 0 WHEN disc = 5 THEN -qty ELSE qty END AS DECIMAL(18,4)) AS quantity, CASE WHEN disc < 2 THEN 'LOTS' ELSE 'SHARES' END AS unit,
 CAST(CASE WHEN tax = 3 OR disc = 6 THEN 0 ELSE 100 END AS DECIMAL(18,4)) AS price, CAST(disc AS DECIMAL(18,4)) AS fees, CAST(CASE WHEN tax = 3 THEN 5 WHEN disc = 7 THEN 1 ELSE 0 END AS DECIMAL(18,4)) AS cash_amount,
 CASE WHEN disc = 8 THEN ' ' ELSE 'R1' END AS external_reference, CASE WHEN disc = 9 THEN '' ELSE ' FILE ' END AS source, CAST(NULL AS VARCHAR(10)) AS note FROM {{trades}}"""


@query("prj7_canonicalize_events", """
WITH s AS (SELECT *, quantity * CASE WHEN unit = 'LOTS' THEN 100 ELSE 1 END AS shares, type IN ('BUY', 'SELL') AS trade FROM {{raw_events}})
SELECT event_id, CAST(shares AS DOUBLE) AS quantity, trim(source) AS source, concat_ws(',', CASE WHEN type NOT IN ('CASH_DEPOSIT', 'CASH_WITHDRAWAL', 'BUY', 'SELL') THEN 'EVENT_TYPE_OR_UNIT' END, CASE WHEN trim(source) = '' OR trim(external_reference) = '' THEN 'SOURCE_REFERENCE_NOTE' END,
 CASE WHEN trade_date > CAST(known_at + INTERVAL '7' HOUR AS DATE) THEN 'TRADE_DATE' END, CASE WHEN least(quantity, price, fees, cash_amount) < 0 THEN 'AMOUNT_BOUND' END,
 CASE WHEN trade AND (instrument_id IS NULL OR shares <= 0 OR price <= 0 OR cash_amount <> 0) THEN 'TRADE_FIELDS' END, CASE WHEN NOT trade AND (instrument_id IS NOT NULL OR quantity <> 0 OR price <> 0 OR cash_amount <= 0 OR unit <> 'SHARES') THEN 'CASH_FIELDS' END,
 CASE WHEN type = 'CASH_DEPOSIT' AND fees > cash_amount THEN 'DEPOSIT_FEES' END) AS violations FROM s""")
def _prj7(spark, sf):
    return lg.canonicalize_events(table(spark, sf, "raw_events")).select("event_id", F.col("quantity").cast("double").alias("quantity"), "source", F.array_join("violations", ",").alias("violations"))


TEXT["quotes"] = """
SELECT concat('I', CAST(p_partkey % 3 AS VARCHAR(4))) AS instrument_id, max(DATE '2001-01-01' + CAST(p_size AS INTEGER)) AS market_date, CAST(max(p_retailprice) AS DOUBLE) AS close,
 TIMESTAMP '2001-04-01 00:00:00' AS known_at, CASE WHEN p_partkey % 3 = 2 THEN 'REJECTED' ELSE 'VALID' END AS quality, CAST(NULL AS VARCHAR(10)) AS unavailable_reason FROM {{part}} GROUP BY p_partkey % 3"""
VALUED = f"""{FIXED_POS}, val AS (SELECT p.*, q.market_date, CASE WHEN q.close IS NULL THEN 'NO_CURRENT_MARKET_PRICE' WHEN q.quality = 'REJECTED' THEN 'PRICE_QUALITY_UNAVAILABLE' END AS reason, CASE WHEN q.quality <> 'REJECTED' THEN p.shares * q.close END AS mv,
  date_diff('day', q.market_date, DATE '{THROUGH}') AS age FROM pos p LEFT JOIN {{{{quotes}}}} q ON q.instrument_id = p.instrument_id WHERE p.shares > 0)"""


@query("ag13_value_positions", f"""WITH RECURSIVE {VALUED} SELECT portfolio_id, instrument_id, reason, CASE WHEN reason IS NULL THEN CAST(age AS INTEGER) END AS age_days, round(mv + 0.0000123::DOUBLE, 4) AS market_value, round(mv - invested_cost + 0.0000123::DOUBLE, 4) AS unrealized FROM val""")
def _ag13a(spark, sf):
    v = lg.value_positions(held(spark, sf), table(spark, sf, "quotes"), THROUGH, CUTOFF)
    return v.select("portfolio_id", "instrument_id", "reason", "age_days", steady(F.col("market_value"), 4).alias("market_value"), steady(F.col("unrealized"), 4).alias("unrealized"))


@query("ag13_portfolio_view", f"""WITH RECURSIVE {VALUED},
 h AS (SELECT portfolio_id, count(*) AS n, count(mv) AS k, sum(mv) AS sub, sum(invested_cost) AS inv, sum(mv - invested_cost) AS un FROM val GROUP BY 1), c AS (SELECT portfolio_id, CAST(sum(impact) AS DOUBLE) AS cash FROM live GROUP BY 1), r AS (SELECT portfolio_id, sum(realized) AS realized FROM pos GROUP BY 1)
SELECT c.portfolio_id, cash < 0 AS negative_cash, coalesce(n, 0) AS holdings, coalesce(k, 0) AS priced, CASE WHEN coalesce(n, 0) = coalesce(k, 0) THEN 'COMPLETE' ELSE 'PARTIAL' END AS coverage, round(coalesce(sub, 0), 3) AS priced_market_value,
 CASE WHEN coalesce(n, 0) = coalesce(k, 0) THEN round(cash + coalesce(sub, 0), 3) END AS total_equity, round(coalesce(inv, 0), 3) AS invested_cost, round(coalesce(realized, 0), 3) AS realized, CASE WHEN coalesce(n, 0) = coalesce(k, 0) THEN round(coalesce(un, 0), 3) END AS unrealized
FROM c LEFT JOIN h USING (portfolio_id) LEFT JOIN r USING (portfolio_id)""")
def _ag13(spark, sf):
    p, c, _ = project(spark, sf)
    v = lg.portfolio_view(p, c, lg.value_positions(p, table(spark, sf, "quotes"), THROUGH, CUTOFF))
    r = lambda n: F.round(n, 3).alias(n)
    return v.select("portfolio_id", "negative_cash", "holdings", "priced", "coverage", r("priced_market_value"), r("total_equity"), r("invested_cost"), r("realized"), r("unrealized"))


TEXT["expected_holdings"] = """
SELECT concat('F', CAST(o_custkey AS VARCHAR(12))) AS portfolio_id, CASE WHEN m = 3 THEN NULL ELSE concat('I', CAST(m AS VARCHAR(4))) END AS instrument_id, concat('SYM', CAST(m AS VARCHAR(4))) AS symbol, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 26 ELSE 25 END) AS BIGINT) AS shares, CAST(101 AS DOUBLE) AS average_cost
FROM {{orders}} CROSS JOIN (SELECT DISTINCT n_regionkey AS m FROM {{nation}} WHERE n_regionkey IN (0, 1, 3)) r GROUP BY o_custkey, m"""
REC = f"""{FIXED_POS}, o AS (SELECT portfolio_id, instrument_id, shares, round(invested_cost / shares, 6) AS cost FROM pos WHERE shares > 0),
 rr AS (SELECT coalesce(o.portfolio_id, e.portfolio_id) AS portfolio_id, coalesce(o.instrument_id, e.instrument_id) AS instrument_id, o.shares AS ledger_shares, CAST(e.shares AS DOUBLE) AS expected_shares,
   CASE WHEN o.shares IS NULL THEN 'MISSING_FROM_LEDGER' WHEN e.shares IS NULL THEN 'MISSING_FROM_EXPECTED' WHEN o.shares = e.shares AND o.cost = round(e.average_cost, 6) THEN 'MATCH' ELSE 'REVIEW' END AS status
  FROM o FULL JOIN (SELECT * FROM {{{{expected_holdings}}}} WHERE instrument_id IS NOT NULL) e ON e.portfolio_id = o.portfolio_id AND e.instrument_id = o.instrument_id
  UNION ALL SELECT portfolio_id, NULL, NULL, CAST(shares AS DOUBLE), 'UNKNOWN_INSTRUMENT' FROM {{{{expected_holdings}}}} WHERE instrument_id IS NULL)"""


def rec(spark, sf):
    p, c, _ = project(spark, sf)
    cash = c.select("portfolio_id", F.col("cash").cast("double").alias("cash"), F.lit(1000.0).alias("expected_cash"))
    return lg.reconcile(p, table(spark, sf, "expected_holdings"), cash)


@query("jn5_reconcile_rows", f"WITH RECURSIVE {REC} SELECT portfolio_id, instrument_id, ledger_shares, expected_shares, ledger_shares - expected_shares AS share_difference, status FROM rr")
def _jn5(spark, sf):
    nothing = spark.createDataFrame([], "portfolio_id string, cash double, expected_cash double")  # the header's, which is not asked for
    return lg.reconcile(held(spark, sf), table(spark, sf, "expected_holdings"), nothing)[0].select("portfolio_id", "instrument_id", "ledger_shares", "expected_shares", "share_difference", "status")


@query("jn5_reconcile_header", f"""WITH RECURSIVE {REC}, c AS (SELECT portfolio_id, CAST(sum(impact) AS DOUBLE) AS cash FROM live GROUP BY 1)
SELECT portfolio_id, count(*) FILTER (WHERE status = 'MATCH') AS matched, count(*) FILTER (WHERE status <> 'MATCH') AS review, count(*) FILTER (WHERE status LIKE 'MISSING%') AS missing, count(*) FILTER (WHERE status = 'UNKNOWN_INSTRUMENT') AS unknown,
 cash - 1000 AS cash_difference, CASE WHEN count(*) FILTER (WHERE status <> 'MATCH') = 0 AND cash = 1000 THEN 'MATCH' ELSE 'REVIEW' END AS status FROM rr JOIN c USING (portfolio_id) GROUP BY portfolio_id, cash""")
def _jn5b(spark, sf):
    return rec(spark, sf)[1].select("portfolio_id", "matched", "review", "missing", "unknown", "cash_difference", "status")


@query("st2_set_diff", """
WITH a AS (SELECT o_orderkey AS run_id FROM {{orders}}), b AS (SELECT DISTINCT l_orderkey AS run_id FROM {{lineitem}} UNION ALL SELECT o_orderkey + 10000000 FROM {{orders}} WHERE o_orderstatus = 'P')
SELECT run_id, 'DECLARED_ONLY' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT run_id, 'ACTUAL_ONLY' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def _st2(spark, sf):
    o = table(spark, sf, "orders")
    actual = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id")).distinct().unionByName(o.where("o_orderstatus = 'P'").select((F.col("o_orderkey") + 10000000).alias("run_id")))
    return st.set_diff(o.select(F.col("o_orderkey").alias("run_id")), actual)


TEXT["portfolio_refs"] = "SELECT DISTINCT concat('F', CAST(o_custkey AS VARCHAR(12))) AS portfolio_id, concat('I', CAST(o_orderkey % 4 AS VARCHAR(4))) AS instrument_id FROM {{orders}}"


@query("st3_reference_closure", """
WITH u AS (SELECT DISTINCT portfolio_id, instrument_id FROM {{ledger_events}} WHERE instrument_id IS NOT NULL)
SELECT *, 'REFERENCE_MISSING' AS problem FROM (SELECT * FROM u EXCEPT SELECT * FROM {{portfolio_refs}}) UNION ALL SELECT *, 'REFERENCE_UNUSED' FROM (SELECT portfolio_id, instrument_id FROM {{portfolio_refs}} EXCEPT SELECT * FROM u)""")
def _st3(spark, sf):
    return lg.reference_closure(events(spark, sf), table(spark, sf, "portfolio_refs"))


TEXT["import_rows"] = """
SELECT seq AS row_number, concat('F', CAST(supp_key AS VARCHAR(8))) AS portfolio_id, 'BUY' AS type, concat('I', CAST(part_key % 3 AS VARCHAR(4))) AS instrument_id, session_date AS trade_date, qty AS quantity, CASE WHEN tax = 0 THEN 101 ELSE 100 END AS price, 0 AS fees, 0 AS cash_amount,
 concat('REF', CAST(order_key AS VARCHAR(12)), '-', CAST(qty AS VARCHAR(8))) AS external_reference, 'GENERIC_CSV' AS source, CAST(NULL AS VARCHAR(8)) AS supersedes, CASE WHEN session_date < DATE '1997-06-01' THEN 'OLD' ELSE 'NEW' END AS age FROM {{trades}}"""


@query("st4_classify_imports", """
WITH r AS (SELECT *, sha256('["' || portfolio_id || '","BUY","' || instrument_id || '","' || CAST(trade_date AS VARCHAR) || '","' || quantity || '","' || price || '","0","0","' || external_reference || '","GENERIC_CSV",null]') AS d FROM {{import_rows}}),
 h AS (SELECT portfolio_id, external_reference, min(d) AS d FROM r WHERE age = 'OLD' GROUP BY 1, 2), n AS (SELECT * FROM r WHERE age = 'NEW'),
 f AS (SELECT portfolio_id, external_reference, min(row_number) AS rn, arg_min(d, row_number) AS d FROM n GROUP BY 1, 2)
SELECT n.row_number, n.portfolio_id, n.external_reference, CASE WHEN h.d IS NULL AND n.row_number = f.rn THEN 'NEW' WHEN coalesce(h.d, f.d) = n.d THEN 'DUPLICATE' ELSE 'CONFLICT' END AS disposition
FROM n JOIN f USING (portfolio_id, external_reference) LEFT JOIN h USING (portfolio_id, external_reference)""")
def _st4(spark, sf):
    r = table(spark, sf, "import_rows")
    return lg.classify_imports(r.where("age = 'NEW'"), r.where("age = 'OLD'")).select("row_number", "portfolio_id", "external_reference", "disposition")


@query("st5_reusable_keys", """
WITH c AS (SELECT DISTINCT instrument_id, session_date, content_hash FROM {{revisions}} WHERE known_at <= TIMESTAMP '2000-12-31'),
 r AS (SELECT DISTINCT instrument_id, session_date, content_hash FROM {{revisions}} WHERE known_at <= CASE WHEN length(instrument_id) = 2 THEN TIMESTAMP '2000-12-31' ELSE TIMESTAMP '2000-06-30' END),
 ch AS (SELECT instrument_id FROM (SELECT * FROM c EXCEPT SELECT * FROM r) UNION SELECT instrument_id FROM (SELECT * FROM r EXCEPT SELECT * FROM c))
SELECT DISTINCT instrument_id FROM r WHERE instrument_id NOT IN (SELECT instrument_id FROM ch) AND instrument_id <> 'S4'""")
def _st5(spark, sf):
    r = table(spark, sf, "revisions").select("instrument_id", "session_date", "content_hash", "known_at")
    edge = F.when(F.length("instrument_id") == 2, F.lit("2000-12-31")).otherwise(F.lit("2000-06-30")).cast("timestamp")
    cached = r.where(F.col("known_at") <= edge)
    arts = cached.select("instrument_id", F.lit("a").alias("recorded_digest"), F.when(F.col("instrument_id") == "S4", "b").otherwise("a").alias("actual_digest"))
    return st.reusable_keys(r.where("known_at <= timestamp '2000-12-31'"), cached, arts, ["instrument_id"])


TEXT["incoming_refs"] = "SELECT instrument_id, CASE WHEN length(issuer_name) > 10 THEN 'Renamed' ELSE issuer_name END AS issuer_name, CASE WHEN listing_symbol IS NULL THEN 'EQUITY' ELSE 'INDEX' END AS type FROM {{listings}}"
TEXT["registry_refs"] = "SELECT instrument_id, issuer_name, 'EQUITY' AS type FROM {{listings}} WHERE length(instrument_id) < 5"
TEXT["incoming_history"] = "SELECT instrument_id, symbol, valid_from, CASE WHEN symbol = 'Brand#3' THEN valid_from ELSE valid_to END AS valid_to FROM {{symbol_history}} WHERE valid_from < DATE '1995-09-01'"
TEXT["registry_history"] = "SELECT instrument_id, symbol, valid_from, valid_to FROM {{symbol_history}} WHERE length(instrument_id) < 5"


@query("st6_reference_conflicts", """
WITH m AS (SELECT i.instrument_id FROM {{incoming_refs}} i JOIN {{registry_refs}} r USING (instrument_id) WHERE i.issuer_name IS DISTINCT FROM r.issuer_name OR i.type IS DISTINCT FROM r.type),
 a AS (SELECT * FROM {{incoming_history}} WHERE instrument_id IN (SELECT instrument_id FROM {{registry_refs}})), b AS (SELECT * FROM {{registry_history}} WHERE instrument_id IN (SELECT instrument_id FROM {{incoming_refs}})),
 h AS (SELECT instrument_id FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION SELECT instrument_id FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)),
 o AS (SELECT DISTINCT n.instrument_id, n.symbol FROM {{incoming_history}} n JOIN {{registry_history}} r ON r.symbol = n.symbol AND r.instrument_id <> n.instrument_id AND r.valid_from <= coalesce(n.valid_to, DATE '9999-12-31') AND coalesce(r.valid_to, DATE '9999-12-31') >= n.valid_from)
SELECT instrument_id, 'METADATA' AS problem, NULL AS symbol FROM m UNION ALL SELECT instrument_id, 'HISTORY', NULL FROM h UNION ALL SELECT instrument_id, 'SYMBOL_OVERLAP', symbol FROM o""")
def _st6(spark, sf):
    t = lambda n: table(spark, sf, n)
    return lg.reference_conflicts(t("incoming_refs"), t("registry_refs"), t("incoming_history"), t("registry_history"))


@query("ud2_cost_fold", """
WITH RECURSIVE n AS (SELECT concat(flag, CAST(supp_key AS VARCHAR)) AS k, row_number() OVER (PARTITION BY flag, supp_key ORDER BY seq) AS n, CASE WHEN tax = 8 AND row_number() OVER (PARTITION BY flag, supp_key ORDER BY seq) > 12 THEN 'SELL' ELSE 'BUY' END AS side, qty::DOUBLE AS q, (100 + disc)::DOUBLE AS p FROM {{trades}}),
 f AS (SELECT k, 0::BIGINT AS n, 0::DOUBLE AS s, 0::DOUBLE AS c, 0::DOUBLE AS r FROM n WHERE n = 1 UNION ALL
  SELECT f.k, e.n, CASE WHEN side = 'BUY' THEN s + q ELSE s - q END, CASE WHEN side = 'BUY' THEN c + q * p + 1 WHEN q = s THEN 0 ELSE c - c * q / s END, CASE WHEN side = 'BUY' THEN r WHEN q = s THEN r + q * p - 1 - c ELSE r + q * p - 1 - c * q / s END FROM f JOIN n e ON e.k = f.k AND e.n = f.n + 1)
SELECT k, s AS shares, round(c + 0.0000123::DOUBLE, 4) AS cost, round(r + 0.0000123::DOUBLE, 4) AS realized FROM f QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC) = 1""")
def _ud2(spark, sf):
    t = table(spark, sf, "trades").select(F.concat("flag", F.col("supp_key").cast("string")).alias("k"), "seq", "tax", F.col("qty").cast("double").alias("quantity"), (F.col("disc") + 100).cast("double").alias("price"))
    arr = t.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("seq", "tax", "quantity", "price"))).alias("s"))
    ev = F.transform("s", lambda e, i: F.struct(F.when((e["tax"] == 8) & (i >= 12), "SELL").otherwise("BUY").alias("side"), e["quantity"].alias("quantity"), e["price"].alias("price"), F.lit(1.0).alias("fees")))
    out = arr.select("k", smoothing.cost_fold(ev).alias("f"))
    return out.select("k", F.col("f.shares").alias("shares"), steady(F.col("f.cost"), 4).alias("cost"), steady(F.col("f.realized"), 4).alias("realized"))
