"""Ordered digests, manifests and replay."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import digests as dg
from tidemark.operators import outcomes as oc
from tidemark.operators import replay as rp
from tidemark.plans import research  # noqa: F401  (its derived tables are used here)
from tidemark.plans.adapters import TEXT, table
from tidemark.plans.registry import query

POLICY = "screener-v0.1.0"


def tree_sql(members: str, keys: str, order: str, fields: str, name: str) -> str:
    """CTEs {name}: (keys, digest, members), level by level like the operator."""
    ks = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    steps = [f" {name}0 AS MATERIALIZED (SELECT {ks}row_number() OVER ({part}ORDER BY {order}, leaf) - 1 AS place, leaf FROM (SELECT *, sha256(CAST(to_json([{fields}]) AS VARCHAR)) AS leaf FROM {members}) x)"]
    for i in range(dg.LEVELS):
        steps.append(f" {name}{i + 1} AS (SELECT {ks}place // {dg.ARITY} AS place, sha256(string_agg(leaf, '' ORDER BY place)) AS leaf FROM {name}{i} GROUP BY {ks}place // {dg.ARITY})")
    joined = f"{name}c JOIN {name}{dg.LEVELS} USING ({keys})" if keys else f"{name}c CROSS JOIN {name}{dg.LEVELS}"
    steps.append(f" {name}c AS (SELECT {ks}count(*) AS members FROM {name}0{f' GROUP BY {keys}' if keys else ''})")
    steps.append(f" {name} AS MATERIALIZED (SELECT {ks}sha256(concat(members, '|', leaf)) AS digest, members FROM {joined})")
    return ",\n".join(steps)


def text(*columns: str) -> str:
    return ", ".join(f"CAST({c} AS VARCHAR)" for c in columns)


OBSERVED = ("close", "episode_id", "instrument_id", "market_date", "run_id", "setup")
RUNS = ("market_trend", "portfolio_id", "row_count", "run_id", "through")


@query("sm25_dataset_id", f"""WITH {tree_sql('{{decision_runs}}', '', 'run_id', text(*RUNS), 'r')}, {tree_sql('{{decision_rows}}', '', 'run_id, instrument_id', text(*OBSERVED), 'o')}
SELECT sha256(concat('1995-01-01|2001-12-31|5|ALL', '|', r.digest, '|', o.digest)) AS dataset_id, r.members AS runs, o.members AS observations FROM r CROSS JOIN o""")
def _sm25(spark, sf):
    return rp.dataset_id(F.lit("1995-01-01|2001-12-31|5|ALL"), table(spark, sf, "decision_runs").select(*RUNS), table(spark, sf, "decision_rows").select(*OBSERVED))


@query("sm27_input_digest", f"""WITH {tree_sql('{{links}}', 'run_id', 'session_date, instrument_id', text('instrument_id', 'revision_number', 'session_date'), 't')} SELECT run_id, digest AS input_digest, members AS inputs FROM t""")
def _sm27(spark, sf):
    chosen = table(spark, sf, "links").select("run_id", "instrument_id", "session_date", "revision_number")
    return dg.ordered_digest(chosen, ["run_id"], ["session_date", "instrument_id"], name="input_digest").withColumnRenamed("members", "inputs")


CAPTURED = ("close", "configured", "d", "eligibility", "episode_id", "held", "instrument_id", "market_date", "q", "setup", "setup_evaluated", "t")


@query("sm21_capture_decision", f"""WITH {tree_sql('{{decision_rows}}', 'run_id', 'instrument_id', text(*CAPTURED), 't')},
 h AS (SELECT u.run_id AS request_id, market_trend AS intent, through, strftime(knowledge_cutoff, '%Y-%m-%d %H:%M:%S') AS cutoff, coalesce(t.members, 0) AS row_count, t.digest AS selected_digest,
   CASE WHEN market_volatility <> 'NORMAL' THEN 'CAPTURED' WHEN universe_snapshot_id IS NULL THEN 'CONFLICT' ELSE 'REPLAYED' END AS disposition FROM {{{{decision_runs}}}} u LEFT JOIN t USING (run_id))
SELECT *, sha256(CAST(to_json([request_id, intent, CAST(through AS VARCHAR), cutoff, selected_digest]) AS VARCHAR)) AS input_hash FROM h""")
def _capture(spark, sf):
    rows = table(spark, sf, "decision_rows").withColumnRenamed("run_id", "request_id").select("request_id", *CAPTURED)
    runs = table(spark, sf, "decision_runs")
    requests = runs.select(F.col("run_id").alias("request_id"), F.col("market_trend").alias("intent"), "through", F.date_format("knowledge_cutoff", "yyyy-MM-dd HH:mm:ss").alias("cutoff"))
    existing = runs.where("market_volatility = 'NORMAL'").select(F.col("run_id").alias("request_id"), F.when(F.col("universe_snapshot_id").isNull(), "OTHER").otherwise(F.col("market_trend")).alias("intent"))
    return oc.capture_decision(rows, requests, existing)[0]


# Weekly bars kept as revisions, and requests at the ends of quarters over the 400 days before.
CONTENT = "md5(concat_ws('|', instrument_id, CAST(session_date AS VARCHAR(10)), CAST(high AS VARCHAR(30)), CAST(low AS VARCHAR(30)), CAST(close AS VARCHAR(30)), CAST(volume AS VARCHAR(20))))"
TEXT["kept_bars"] = f"""SELECT instrument_id, session_date, CAST(1 AS BIGINT) AS revision_number, CAST(session_date AS TIMESTAMP) + INTERVAL '7' DAY AS known_at, high, low, close, volume, {CONTENT} AS content_hash FROM {{{{bars_weekly}}}}"""
TEXT["quarter_runs"] = """SELECT concat('Q', CAST(max(session_date) AS VARCHAR(10))) AS run_id, CAST(max(session_date) AS TIMESTAMP) AS cutoff, CASE WHEN year(max(session_date)) = 1993 THEN 'screener-v0.0.9' ELSE 'screener-v0.1.0' END AS policy_id FROM {{bars_weekly}} GROUP BY date_trunc('quarter', session_date)
UNION ALL SELECT concat('R', CAST(max(session_date) AS VARCHAR(10))), CAST(max(session_date) AS TIMESTAMP), 'screener-v0.1.0' FROM {{bars_weekly}} GROUP BY date_trunc('year', session_date)"""
TEXT["selected_bars"] = """SELECT q.run_id AS request_id, b.* FROM {{quarter_runs}} q JOIN {{kept_bars}} b ON b.known_at <= q.cutoff AND b.known_at > q.cutoff - INTERVAL '400' DAY"""
# What has become of the store: some revisions are gone, some were altered, with or without their hash.
TEXT["later_store"] = """SELECT instrument_id, session_date, revision_number, known_at, high, low, CASE WHEN volume % 1201 = 7 THEN close + 1 ELSE close END AS close, volume, CASE WHEN volume % 1301 = 9 THEN md5('other') ELSE content_hash END AS content_hash FROM {{kept_bars}} WHERE NOT (instrument_id = 'Brand#11' AND month(session_date) = 3 AND day(session_date) < 8 AND year(session_date) % 2 = 0)"""


def screen(bars):
    """Close, prior high and state of each instrument at its last bar."""
    own = Window.partitionBy("run_id", "instrument_id").orderBy("session_date")
    last = Window.partitionBy("run_id", "instrument_id").orderBy(F.desc("session_date"))
    x = bars.withColumn("prior_high", F.when(F.row_number().over(own) > 20, F.max("high").over(own.rowsBetween(-20, -1)))).withColumn("__back", F.row_number().over(last)).where("__back = 1")
    state = F.when(F.col("prior_high").isNull(), "INSUFFICIENT_HISTORY").when(F.col("close") > F.col("prior_high"), "CONFIRMED").when(F.col("close") >= 0.98 * F.col("prior_high"), "WATCH").otherwise("NONE")
    return x.select("run_id", "instrument_id", "session_date", "close", "prior_high", state.alias("setup"))


FIELDS = ("session_date", "close", "prior_high", "setup")
MANIFEST = tree_sql("{{selected_bars}}", "request_id", "instrument_id, session_date", text("instrument_id", "session_date", "revision_number", "known_at", "content_hash"), "t")


def capture(spark, sf):
    chosen = table(spark, sf, "selected_bars")
    links, entries = rp.capture_manifests(chosen.select("request_id", "instrument_id", "session_date", "revision_number", "known_at", "content_hash"))
    return chosen, links, entries


@query("sm21_capture_manifests", f"""WITH {MANIFEST} SELECT request_id, digest AS manifest_id, members AS inputs, count(*) OVER (PARTITION BY digest) AS requests FROM t""")
def _sm21(spark, sf):
    """The content-addressed manifest of what each request used; requests of the same selection share it."""
    _, links, _ = capture(spark, sf)
    return links.withColumn("requests", F.count("*").over(Window.partitionBy("manifest_id")))


SCREENED = """SELECT {0}, instrument_id, session_date, close, prior_high, CASE WHEN prior_high IS NULL THEN 'INSUFFICIENT_HISTORY' WHEN close > prior_high THEN 'CONFIRMED' WHEN close >= 0.98 * prior_high THEN 'WATCH' ELSE 'NONE' END AS setup
 FROM (SELECT *, CASE WHEN row_number() OVER o > 20 THEN max(high) OVER (PARTITION BY {0}, instrument_id ORDER BY session_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS prior_high FROM {1} WINDOW o AS (PARTITION BY {0}, instrument_id ORDER BY session_date) QUALIFY row_number() OVER (PARTITION BY {0}, instrument_id ORDER BY session_date DESC) = 1) x"""
REPLAY = f"""
 m AS MATERIALIZED (SELECT s.request_id AS run_id, s.instrument_id, s.session_date, s.content_hash, s.known_at, l.high, l.close, l.content_hash AS h, l.instrument_id IS NULL AS gone, l.instrument_id IS NOT NULL AND (l.content_hash <> s.content_hash OR md5(concat_ws('|', l.instrument_id, CAST(l.session_date AS VARCHAR(10)), CAST(l.high AS VARCHAR(30)), CAST(l.low AS VARCHAR(30)), CAST(l.close AS VARCHAR(30)), CAST(l.volume AS VARCHAR(20)))) <> s.content_hash) AS altered
  FROM {{{{selected_bars}}}} s LEFT JOIN {{{{later_store}}}} l USING (instrument_id, session_date, revision_number)),
 st AS (SELECT run_id, sum(gone::INT) AS missing, sum(altered::INT) AS altered FROM m GROUP BY 1),
 a AS ({SCREENED.format('request_id', '{{selected_bars}}')}), b AS ({SCREENED.format('run_id', 'm')}),
 hd AS (SELECT q.run_id, q.policy_id, st.missing, st.altered FROM {{{{quarter_runs}}}} q LEFT JOIN st USING (run_id)),
 d AS (SELECT run_id, sum((a.session_date IS DISTINCT FROM b.session_date)::INT + (a.close IS DISTINCT FROM b.close)::INT + (a.prior_high IS DISTINCT FROM b.prior_high)::INT + (a.setup IS DISTINCT FROM b.setup)::INT) AS n FROM b JOIN a ON a.request_id = b.run_id AND a.instrument_id = b.instrument_id GROUP BY 1)"""


@query("sm23_replay_decisions", f"""WITH {REPLAY}
SELECT run_id, CASE WHEN policy_id <> '{POLICY}' THEN 'POLICY_VERSION_UNAVAILABLE' WHEN missing IS NULL OR missing > 0 THEN 'INPUT_NOT_AVAILABLE' WHEN altered > 0 THEN 'DIFFERENT_RESULT' ELSE 'MATCH' END AS verdict,
 CASE WHEN policy_id <> '{POLICY}' THEN NULL WHEN missing IS NULL THEN 'MANIFEST_MISSING' WHEN missing > 0 THEN 'CANONICAL_REVISION_MISSING' WHEN altered > 0 THEN 'CANONICAL_REVISION_INTEGRITY_FAILED' END AS detail,
 CAST(CASE WHEN policy_id <> '{POLICY}' OR missing IS NULL OR missing > 0 THEN 0 ELSE coalesce(n, 0) + (altered > 0)::INT END AS BIGINT) AS differences FROM hd LEFT JOIN d USING (run_id)""")
def _sm23(spark, sf):
    """Decisions captured from the bars of their time, replayed from what the store holds now."""
    chosen, links, entries = capture(spark, sf)
    stored = screen(chosen.withColumnRenamed("request_id", "run_id"))
    runs = table(spark, sf, "quarter_runs").join(links.select(F.col("request_id").alias("run_id"), "manifest_id"), "run_id", "left").select("run_id", "policy_id", "manifest_id")
    verdicts, _ = rp.replay_decisions(runs, links, entries, table(spark, sf, "later_store"), screen, stored, FIELDS, POLICY, F.expr(CONTENT))
    return verdicts
