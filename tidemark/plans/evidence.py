"""Typed evidence: admission, resolution, premises, readiness."""

from pyspark.sql import functions as F

from tidemark.operators import evidence as ev
from tidemark.plans.adapters import TEXT, numbered, table
from tidemark.plans.registry import query

K = "CAST(substr(props, 7, length(props) - 7) AS INTEGER)"
TEXT["evidence"] = f"""
SELECT concat('V', CAST(event_id AS VARCHAR(12))) AS evidence_id, concat('U', CAST(user_id AS VARCHAR(12))) AS subject_id,
 CASE event_type WHEN 'view' THEN 'BoardRegime' WHEN 'click' THEN 'SecurityType' WHEN 'purchase' THEN 'CompletedSession' WHEN 'signup' THEN 'Suspension' ELSE 'TradingStatus' END AS claim,
 CASE event_type WHEN 'purchase' THEN 'SessionFact' WHEN 'click' THEN 'PointObservation' WHEN 'view' THEN 'VersionedRule' ELSE 'ContinuingState' END AS evidence_class,
 {K} % 3 + CASE WHEN {K} % 17 = 0 THEN 3 ELSE 0 END AS tier, {K} % 2 AS specificity, CAST(ts AS DATE) AS effective_from, CASE WHEN {K} % 7 = 0 THEN NULL WHEN event_type = 'purchase' THEN CAST(ts AS DATE) ELSE CAST(ts AS DATE) + CAST(floor(value) AS INTEGER) % 20 END AS effective_to,
 ts + CAST({K} % 6 AS INTEGER) * INTERVAL '1' HOUR AS known_at, CASE WHEN {K} % 5 = 0 THEN NULL ELSE ts END AS retrieved_at, CASE WHEN {K} % 4 = 0 THEN ts - INTERVAL '1' HOUR END AS published_at,
 CASE WHEN {K} % 13 = 0 THEN NULL ELSE concat('Z', CAST(user_id AS VARCHAR(12)), event_type, CAST({K} % 4 AS VARCHAR(4))) END AS series, event_id + 1 AS revision, CASE WHEN {K} % 9 = 0 THEN event_id - 300 END AS supersedes_revision,
 concat('v', CAST({K} % 2 AS VARCHAR(4))) AS value, CASE WHEN {K} % 19 = 0 THEN 'CANCEL' ELSE 'ASSERT' END AS operation, CASE WHEN {K} % 6 = 0 THEN 'PARTIAL' ELSE 'FULL' END AS completeness, concat(event_type, CAST({K} % 2 AS VARCHAR(4))) AS logical_key,
 CASE WHEN {K} % 2 = 0 THEN 'alpha' ELSE 'beta' END AS source_id, {K} AS k FROM {{{{events}}}}"""
DAY, CUT = "2024-01-20", "2024-01-25 00:00:00"
SEEN = f"(known_at <= TIMESTAMP '{CUT}' AND (retrieved_at IS NULL OR retrieved_at <= TIMESTAMP '{CUT}') AND (published_at IS NULL OR published_at <= TIMESTAMP '{CUT}'))"
INSIDE = f"(effective_from <= DATE '{DAY}' AND (effective_to IS NULL OR effective_to >= DATE '{DAY}'))"
ADMITTED = "(tier <= CASE claim WHEN 'Suspension' THEN 0 ELSE 1 END)"


def resolve_sql(source: str, keys: str) -> str:
    j = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    return f""" live AS (SELECT * FROM {source} WHERE {INSIDE} AND {SEEN}),
 g AS (SELECT *, count(*) OVER (PARTITION BY {keys}) AS candidates FROM live QUALIFY rank() OVER (PARTITION BY {keys} ORDER BY tier, specificity DESC) = 1),
 sv AS (SELECT a.*, NOT EXISTS (SELECT 1 FROM g b WHERE {j} AND a.series = b.series AND a.evidence_id <> b.evidence_id AND (b.revision > a.revision OR b.supersedes_revision = a.revision)) AS alive FROM g a),
 res AS (SELECT {keys}, max(candidates) AS candidates, count(*) FILTER (WHERE alive) = 0 OR count(DISTINCT value) FILTER (WHERE alive) > 1 AS conflicting, min(value) FILTER (WHERE alive) AS v,
  first(evidence_id ORDER BY alive DESC, known_at DESC, revision DESC, series NULLS FIRST, evidence_id) AS w FROM sv GROUP BY {keys})"""


def records(spark, sf):
    return table(spark, sf, "evidence")


@query("prj11_admit_sources", f"SELECT evidence_id, {ADMITTED} AS admitted, CASE WHEN NOT {ADMITTED} THEN 'EVIDENCE_SOURCE_INADMISSIBLE' END AS admission_reason FROM {{{{evidence}}}}")
def _prj11(spark, sf):
    return ev.admit_sources(records(spark, sf)).select("evidence_id", "admitted", "admission_reason")


VALIDITY = f"""CASE WHEN NOT {SEEN} THEN 'UNKNOWN' WHEN evidence_class = 'SessionFact' THEN CASE WHEN effective_from = DATE '{DAY}' AND effective_to = DATE '{DAY}' THEN 'VERIFIED' ELSE 'UNKNOWN' END
 WHEN evidence_class = 'PointObservation' THEN CASE WHEN effective_to IS NULL OR DATE '{DAY}' < effective_from THEN 'UNKNOWN' WHEN DATE '{DAY}' <= effective_to THEN 'VERIFIED' ELSE 'STALE' END
 WHEN evidence_class = 'VersionedRule' THEN CASE WHEN {INSIDE} THEN 'VERIFIED' ELSE 'UNKNOWN' END ELSE CASE WHEN DATE '{DAY}' < effective_from THEN 'UNKNOWN' WHEN effective_to < DATE '{DAY}' THEN 'STALE' ELSE 'VERIFIED' END END"""


@query("prj13_evidence_validity", f"SELECT evidence_id, {VALIDITY} AS validity FROM {{{{evidence}}}}")
def _prj13(spark, sf):
    return ev.evidence_validity(records(spark, sf), DAY, CUT).select("evidence_id", "validity")


@query("sm11_resolve_evidence", f"WITH {resolve_sql('{{evidence}}', 'subject_id, claim')} SELECT subject_id, claim, candidates, conflicting, CASE WHEN NOT conflicting THEN v END AS value, CASE WHEN NOT conflicting THEN w END AS evidence_id FROM res")
def _sm11(spark, sf):
    return ev.resolve_evidence(records(spark, sf), ["subject_id", "claim"], DAY, CUT)


FACTS = f"""
 us AS (SELECT * FROM {{{{evidence}}}} WHERE {SEEN} AND {ADMITTED}),
 cx AS (SELECT c.series, t.logical_key, max(t.revision) AS until FROM us c JOIN us t ON t.series = c.series AND t.revision = c.supersedes_revision AND t.operation = 'ASSERT' WHERE c.operation = 'CANCEL' AND c.tier <= t.tier AND c.effective_from <= DATE '{DAY}' AND (c.effective_to IS NULL OR c.effective_to >= DATE '{DAY}') GROUP BY 1, 2),
 jd AS (SELECT a.*, {VALIDITY} AS validity FROM us a LEFT JOIN cx ON cx.series = a.series AND cx.logical_key = a.logical_key WHERE a.operation = 'ASSERT' AND (cx.until IS NULL OR a.revision > cx.until)),
 ql AS (SELECT *, CASE WHEN validity = 'STALE' THEN 'STALE' WHEN completeness = 'PARTIAL' THEN 'PARTIAL' ELSE 'VERIFIED' END AS quality FROM jd WHERE validity <> 'UNKNOWN'), fresh AS (SELECT * FROM ql WHERE quality <> 'STALE'),
 {resolve_sql('fresh', 'subject_id, claim, logical_key')},
 facts AS (SELECT s.subject_id, s.claim, s.logical_key, CASE WHEN NOT conflicting THEN v END AS value, CASE WHEN NOT conflicting THEN w END AS evidence_id,
   CASE WHEN conflicting THEN 'CONFLICTING' WHEN w IS NOT NULL THEN (SELECT quality FROM ql WHERE ql.evidence_id = w) WHEN s.stale THEN 'STALE' ELSE 'UNKNOWN' END AS quality
  FROM (SELECT subject_id, claim, logical_key, bool_or(quality = 'STALE') AS stale FROM ql GROUP BY 1, 2, 3) s LEFT JOIN res USING (subject_id, claim, logical_key))"""


@query("sm12_evidence_as_of", f"WITH {FACTS} SELECT * FROM facts")
def _sm12(spark, sf):
    return ev.evidence_as_of(records(spark, sf), DAY, CUT)


@query("sm12_overall_quality", f"""WITH {FACTS} SELECT subject_id, claim, count(*) AS facts, CASE WHEN bool_or(quality = 'CONFLICTING') THEN 'CONFLICTING' WHEN bool_or(quality = 'UNKNOWN') THEN 'UNKNOWN' WHEN bool_or(quality = 'PARTIAL') THEN 'PARTIAL' WHEN bool_or(quality = 'VERIFIED') THEN 'VERIFIED' ELSE 'STALE' END AS quality FROM facts GROUP BY 1, 2""")
def _sm12b(spark, sf):
    return ev.overall_quality(ev.evidence_as_of(records(spark, sf), DAY, CUT), ["subject_id", "claim"])


TEXT["status_facts"] = f"""SELECT subject_id, source_id, tier, specificity, effective_from, CASE WHEN claim = 'Suspension' THEN 'SUSPENDED' WHEN k % 10 = 3 THEN 'REOPENING_UNCONFIRMED' ELSE 'TRADING' END AS status,
 CASE WHEN k % 23 = 0 THEN 'CONFLICTING' WHEN k % 6 = 0 THEN 'PARTIAL' WHEN k % 5 = 0 THEN 'STALE' ELSE 'VERIFIED' END AS quality FROM {{{{evidence}}}} WHERE claim IN ('Suspension', 'TradingStatus') AND known_at <= TIMESTAMP '{CUT}'"""


@query("sm13_trading_status", """
WITH t AS (SELECT * FROM {{status_facts}} QUALIFY rank() OVER (PARTITION BY subject_id ORDER BY tier, specificity DESC, effective_from DESC) = 1),
 g AS (SELECT subject_id, count(DISTINCT status) > 1 OR bool_or(quality = 'CONFLICTING') AS c, first(status ORDER BY CASE quality WHEN 'VERIFIED' THEN 0 WHEN 'PARTIAL' THEN 1 WHEN 'STALE' THEN 2 ELSE 3 END, source_id) AS s, first(quality ORDER BY CASE quality WHEN 'VERIFIED' THEN 0 WHEN 'PARTIAL' THEN 1 WHEN 'STALE' THEN 2 ELSE 3 END, source_id) AS q FROM t GROUP BY 1)
SELECT subject_id, CASE WHEN c THEN 'UNKNOWN' ELSE s END AS status, CASE WHEN c THEN 'CONFLICTING' ELSE q END AS quality, CASE WHEN c THEN 'STATUS_CONFLICT' ELSE array_to_string(list_sort(list_filter([CASE s WHEN 'TRADING' THEN 'STATUS_TRADING' ELSE s END, CASE q WHEN 'PARTIAL' THEN 'STATUS_COVERAGE_PARTIAL' WHEN 'STALE' THEN 'STATUS_STALE' END], lambda x: x IS NOT NULL)), ',') END AS reasons FROM g""")
def _sm13(spark, sf):
    return ev.trading_status(table(spark, sf, "status_facts")).withColumn("reasons", F.array_join("reasons", ","))


@query("sm14_combine_claims", f"""WITH src AS (SELECT *, CASE WHEN completeness = 'PARTIAL' THEN 'PARTIAL' ELSE 'VERIFIED' END AS quality FROM {{{{evidence}}}} WHERE claim IN ('BoardRegime', 'SecurityType')), {resolve_sql('src', 'subject_id')},
 r AS (SELECT subject_id, bool_or(quality <> 'VERIFIED') AS rough FROM g GROUP BY 1) SELECT subject_id, CASE WHEN NOT conflicting THEN v END AS value, CASE WHEN conflicting THEN 'CONFLICTING' WHEN rough THEN 'PARTIAL' ELSE 'VERIFIED' END AS quality FROM res JOIN r USING (subject_id)""")
def _sm14(spark, sf):
    x = records(spark, sf).withColumn("quality", F.when(F.col("completeness") == "PARTIAL", "PARTIAL").otherwise("VERIFIED"))
    return ev.combine_claims(x.where("claim = 'BoardRegime'"), x.where("claim = 'SecurityType'"), ["subject_id"], DAY, CUT)


# Conditions spread over the columns of every trade.
TEXT["conditions"] = """
SELECT seq AS request_id, qty, disc, tax, disc <> 0 AS convention_admitted, disc <> 1 AS session_completed, disc = 2 AS synthetic, disc = 3 AS placeholder, disc = 4 AS substituted, CASE WHEN disc = 5 THEN 0 ELSE qty END AS volume, CASE WHEN tax < 4 THEN 'Ambiguous' ELSE 'ExplicitlyGenuine' END AS zero_semantics,
 CASE WHEN disc = 6 THEN 0 ELSE 1 END AS revision_number, CASE WHEN disc = 7 THEN 'zz' ELSE concat(md5(flag), md5(status)) END AS content_hash, CAST(session_date AS TIMESTAMP) AS known_at, CAST(session_date AS TIMESTAMP) + CASE WHEN disc = 8 THEN INTERVAL '1' HOUR ELSE INTERVAL '0' HOUR END AS retrieved_at,
 disc <> 0 AND disc <> 5 AS identity_continuity, disc <> 1 AS currency_continuity, disc <> 2 AND disc <> 1 AS convention_continuity, disc <> 3 AS session_continuity, disc <> 4 AS action_coverage, tax <> 1 AS revision_binding, CASE WHEN tax = 2 THEN 1 ELSE 0 END AS known_breaks,
 qty = 1 AS identity_conflict, qty <> 2 AS identity_verified, qty = 3 AS type_unsupported, qty <> 4 AS type_known, qty = 5 AS pre_listing, qty = 6 AS post_delisting, qty <> 7 AS listing_known, qty = 8 AS board_conflict, qty = 9 AS mechanism_unresolved, qty <> 10 AS board_known, qty = 11 AS board_unsupported, qty <> 12 AS mechanism_known,
 CASE WHEN qty = 13 THEN 'SUSPENDED' WHEN qty = 14 THEN 'REOPENING_UNCONFIRMED' ELSE 'TRADING' END AS status, CASE WHEN qty = 15 THEN 'PARTIAL' WHEN qty = 16 THEN 'STALE' WHEN qty = 17 THEN 'CONFLICTING' ELSE 'VERIFIED' END AS status_quality FROM {{trades}}"""


@query("prj14_admit_prices", """SELECT request_id, CASE disc WHEN 0 THEN 'PRICE_BASIS_UNVERIFIED' WHEN 1 THEN 'SESSION_UNCONFIRMED' WHEN 2 THEN 'PRICE_SYNTHETIC_CARRY_FORWARD' WHEN 3 THEN 'PRICE_PLACEHOLDER' WHEN 4 THEN 'PRICE_SUBSTITUTED' WHEN 5 THEN CASE WHEN tax < 4 THEN 'ZERO_VOLUME_UNEXPLAINED' END
 WHEN 6 THEN 'PRICE_INVARIANT_INVALID' WHEN 7 THEN 'PRICE_INVARIANT_INVALID' WHEN 8 THEN 'PRICE_INVARIANT_INVALID' END AS reason FROM {{conditions}}""")
def _prj14(spark, sf):
    return ev.admit_prices(table(spark, sf, "conditions")).select("request_id", "reason")


REASONS15 = """array_to_string(list_sort(list_distinct(list_filter([CASE WHEN NOT identity_continuity THEN 'IDENTITY_CONFLICT' END, CASE WHEN NOT currency_continuity OR NOT convention_continuity THEN 'PRICE_BASIS_UNVERIFIED' END, CASE WHEN NOT session_continuity THEN 'SESSION_UNAVAILABLE' END,
 CASE WHEN NOT action_coverage THEN 'CORPORATE_ACTION_COVERAGE_PARTIAL' END, CASE WHEN NOT revision_binding THEN 'PRICE_CLEARANCE_INCOMPLETE' END], lambda x: x IS NOT NULL))), ',')"""


@query("prj15_price_comparability", f"""WITH r AS (SELECT *, {REASONS15} AS x FROM {{{{conditions}}}}) SELECT request_id, CASE WHEN known_breaks > 0 THEN 'KNOWN_BREAK' WHEN x <> '' THEN 'UNRESOLVED' ELSE 'CLEARED' END AS comparability, CASE WHEN known_breaks > 0 THEN 'PRICE_KNOWN_BREAK' WHEN x <> '' THEN x ELSE 'PRICE_CLEARED' END AS reasons FROM r""")
def _prj15(spark, sf):
    return ev.price_comparability(table(spark, sf, "conditions")).select("request_id", "comparability", F.array_join("comparability_reasons", ",").alias("reasons"))


MARKET = """CASE qty WHEN 1 THEN 'IDENTITY_CONFLICT' WHEN 2 THEN 'REFERENCE_NOT_KNOWN' WHEN 3 THEN 'UNSUPPORTED_TYPE' WHEN 4 THEN 'TYPE_UNKNOWN' WHEN 5 THEN 'PRE_LISTING' WHEN 6 THEN 'POST_DELISTING' WHEN 7 THEN 'LISTING_UNKNOWN' WHEN 8 THEN 'BOARD_CONFLICT' WHEN 9 THEN 'MECHANISM_UNRESOLVED'
 WHEN 10 THEN 'BOARD_UNKNOWN' WHEN 11 THEN 'UNSUPPORTED_BOARD' WHEN 12 THEN 'MECHANISM_UNRESOLVED' WHEN 13 THEN 'SUSPENDED' WHEN 14 THEN 'REOPENING_UNCONFIRMED' WHEN 15 THEN 'STATUS_COVERAGE_PARTIAL' WHEN 16 THEN 'STATUS_STALE' WHEN 17 THEN 'STATUS_CONFLICT' ELSE CASE WHEN disc = 1 THEN 'SESSION_UNCONFIRMED' END END"""


@query("prj16_market_eligibility", f"WITH r AS (SELECT request_id, qty, {MARKET} AS market_reason FROM {{{{conditions}}}}) SELECT request_id, market_reason, CASE WHEN market_reason IS NULL THEN 'ELIGIBLE' WHEN qty IN (3, 5, 6, 11, 13) THEN 'INELIGIBLE' ELSE 'DATA_BLOCKED' END AS market_status FROM r")
def _prj16(spark, sf):
    return ev.market_eligibility(table(spark, sf, "conditions")).select("request_id", "market_reason", "market_status")


TEXT["observations"] = "SELECT c.request_id, f.feature, c.qty + 10 AS observations, c.tax <> 5 AS benchmark_available, c.qty * 2 AS benchmark_observations, CASE WHEN tax = 2 THEN 'KNOWN_BREAK' WHEN disc < 3 THEN 'UNRESOLVED' ELSE 'CLEARED' END AS comparability FROM {{conditions}} c CROSS JOIN (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature" for f in ev.REQUIRED_OBSERVATIONS) + ") f"
NEED = "CASE feature " + " ".join(f"WHEN '{f}' THEN {n}" for f, n in ev.REQUIRED_OBSERVATIONS.items()) + " END"


@query("prj19_feature_readiness", f"""WITH r AS (SELECT *, CASE WHEN comparability = 'KNOWN_BREAK' THEN 'PRICE_KNOWN_BREAK' WHEN comparability <> 'CLEARED' THEN 'PRICE_UNRESOLVED' WHEN feature IN ('Rs20', 'Rs60') AND NOT benchmark_available THEN 'BENCHMARK_MISSING' WHEN feature IN ('Rs20', 'Rs60') AND benchmark_observations < {NEED} THEN 'INSUFFICIENT_HISTORY' WHEN observations < {NEED} THEN 'INSUFFICIENT_HISTORY' END AS reason FROM {{{{observations}}}})
SELECT request_id, feature, reason, CASE WHEN reason IS NULL THEN 'AVAILABLE' WHEN reason = 'INSUFFICIENT_HISTORY' THEN 'WARMUP' ELSE 'UNAVAILABLE' END AS availability FROM r""")
def _prj19(spark, sf):
    return ev.feature_readiness(table(spark, sf, "observations")).select("request_id", "feature", "reason", "availability")


TEXT["optional_inputs"] = "SELECT request_id, f.feature, disc <> 1 AS quantity_comparable, disc <> 2 AS currency_compatible, disc > 5 AS value_admitted, tax <> 3 AS benchmark_available, qty > 20 AS benchmark_sufficient, qty > 10 AS history_sufficient FROM {{conditions}} CROSS JOIN (" + " UNION ALL ".join(f"SELECT '{f}' AS feature" for f in ev.OPTIONAL_FEATURES) + ") f"


@query("prj19_optional_readiness", """WITH r AS (SELECT *, CASE feature WHEN 'RelativeVolume' THEN quantity_comparable WHEN 'MonetaryLiquidityProxy' THEN currency_compatible WHEN 'ActualTradedValue' THEN value_admitted ELSE benchmark_available END AS gate, CASE WHEN feature IN ('Rs20', 'Rs60', 'MarketContext') THEN benchmark_sufficient ELSE history_sufficient END AS enough FROM {{optional_inputs}})
SELECT request_id, feature, CASE WHEN NOT gate THEN 'UNAVAILABLE' WHEN enough THEN 'AVAILABLE' ELSE 'WARMUP' END AS availability, CASE WHEN NOT gate THEN CASE WHEN feature IN ('RelativeVolume', 'MonetaryLiquidityProxy') THEN 'VOLUME_BASIS_UNVERIFIED' WHEN feature = 'ActualTradedValue' THEN 'PRICE_BASIS_UNVERIFIED' ELSE 'BENCHMARK_MISSING' END WHEN NOT enough THEN 'INSUFFICIENT_HISTORY' END AS reason FROM r""")
def _prj19b(spark, sf):
    return ev.optional_readiness(table(spark, sf, "optional_inputs")).select("request_id", "feature", "availability", "reason")


READY = f"""WITH c AS (SELECT *, {REASONS15} AS x, {MARKET} AS mr FROM {{{{conditions}}}}), r AS (SELECT *, CASE WHEN known_breaks > 0 THEN 'PRICE_KNOWN_BREAK' ELSE x END AS pr, CASE WHEN tax = 2 THEN 'PRICE_KNOWN_BREAK' WHEN disc < 3 THEN 'PRICE_UNRESOLVED' WHEN qty + 10 < 50 THEN 'INSUFFICIENT_HISTORY' END AS fr FROM c)
SELECT request_id, mr IS NULL AND pr = '' AND fr IS NULL AS data_ready, array_to_string(list_sort(list_distinct(list_filter(string_split(concat_ws(',', CASE WHEN mr IS NOT NULL THEN 'MARKET_NOT_ELIGIBLE,' || mr END, CASE WHEN pr <> '' THEN 'DATA_NOT_READY,' || pr END, fr), ','), lambda t: t <> ''))), ',') AS reasons FROM r"""


@query("prj20_data_readiness", READY)
def _prj20(spark, sf):
    c = numbered(table(spark, sf, "conditions"), "request_id")
    core = table(spark, sf, "observations", conditions=c).where("feature not like 'Rs%'")
    packed = ev.feature_readiness(core).groupBy("request_id").agg(F.collect_list(F.struct("availability", "reason")).alias("core"))
    x = ev.price_comparability(ev.market_eligibility(c)).join(packed, "request_id")
    return ev.data_readiness(x).select(F.col("request_id.id").alias("request_id"), "data_ready", F.array_join("reasons", ",").alias("reasons"))


@query("sm15_readiness", READY)
def _sm15(spark, sf):
    c = numbered(table(spark, sf, "conditions"), "request_id")
    market = c.select("request_id", "identity_conflict", "identity_verified", "type_unsupported", "type_known", "pre_listing", "post_delisting", "listing_known", "board_conflict", "mechanism_unresolved", "board_known", "board_unsupported", "mechanism_known", "status", "status_quality", "session_completed")
    spans = c.select("request_id", "identity_continuity", "currency_continuity", "convention_continuity", "session_continuity", "action_coverage", "revision_binding", "known_breaks")
    return ev.readiness(market, spans, table(spark, sf, "observations", conditions=c)).select(F.col("request_id.id").alias("request_id"), "data_ready", F.array_join("reasons", ",").alias("reasons"))


@query("prj10_usage_decisions", """
WITH s AS (SELECT request_id, concat('P', CAST(k AS VARCHAR)) AS source_id, NOT (k = 0 AND qty = 5) AS enabled, qty = 6 AS restricted, DATE '1994-01-01' AS vf, CASE WHEN qty = 7 THEN NULL WHEN qty = 8 THEN DATE '1995-01-01' ELSE DATE '2030-01-01' END AS vu, CAST(known_at AS DATE) AS used_at, qty <> 9 AS cap FROM {{conditions}} CROSS JOIN (SELECT n_regionkey AS k FROM {{nation}} GROUP BY 1 HAVING n_regionkey < 2) n),
 o AS (SELECT request_id, op FROM {{conditions}} CROSS JOIN (VALUES ('Display'), ('RetainOriginal')) v(op) UNION ALL SELECT request_id, 'Export' FROM {{conditions}} WHERE disc = 9 UNION ALL SELECT request_id, 'SaasConsumption' FROM {{conditions}} WHERE tax = 8),
 p AS (SELECT * FROM (VALUES ('P0', 'Display', 'ExplicitPermission'), ('P1', 'Display', 'ExplicitPermission'), ('P0', 'RetainOriginal', 'ExplicitPermission'), ('P1', 'RetainOriginal', 'ExplicitPermission'), ('P0', 'Export', 'ExplicitPermission'), ('P1', 'Export', 'ExplicitProhibition'), ('P0', 'SaasConsumption', 'ExplicitPermission'), ('P1', 'SaasConsumption', 'ExplicitPermission')) v(source_id, op, perm)),
 h AS (SELECT s.request_id, bool_or(coalesce(perm = 'ExplicitProhibition', false)) AS pro, bool_and(coalesce(perm = 'ExplicitPermission', false)) AS per FROM s JOIN o USING (request_id) LEFT JOIN p ON p.source_id = s.source_id AND p.op = o.op GROUP BY 1),
 g AS (SELECT request_id, bool_and(enabled) AS en, bool_or(coalesce(used_at >= vu, false)) AS ex, bool_or(restricted OR vu IS NULL) AS un, bool_and(cap) AS cap FROM s GROUP BY 1),
 r AS (SELECT c.request_id, CASE WHEN qty = 1 THEN 'FEATURE_DISABLED' WHEN qty = 2 THEN 'MODE_UNSUPPORTED' WHEN qty = 3 THEN 'CAPABILITY_MISSING' WHEN qty = 4 THEN 'SOURCE_SELECTION_MISMATCH' WHEN NOT en THEN 'SOURCE_DISABLED' WHEN pro OR ex OR NOT per OR un THEN CASE WHEN disc = 9 THEN 'EXPORT_NOT_PERMITTED' WHEN pro THEN 'PERMISSION_PROHIBITED' WHEN ex THEN 'PERMISSION_EXPIRED' ELSE 'PERMISSION_UNKNOWN' END
   WHEN tax = 8 THEN 'UNSUPPORTED_PROFILE' WHEN NOT g.cap THEN 'CAPABILITY_UNSUPPORTED' WHEN disc = 3 AND tax < 4 THEN 'EVIDENCE_NOT_ADMITTED' ELSE 'USAGE_PERMITTED' END AS reason FROM {{conditions}} c JOIN h USING (request_id) JOIN g USING (request_id))
SELECT request_id, reason = 'USAGE_PERMITTED' AS permitted, reason FROM r""")
def _prj10(spark, sf):
    c = table(spark, sf, "conditions")
    requests = c.select("request_id", (F.col("qty") != 1).alias("feature_enabled"), (F.col("qty") != 2).alias("mode_supported"), (F.col("qty") == 3).alias("capability_missing"), (F.col("qty") != 4).alias("selection_matches"), (F.col("disc") == 9).alias("exporting"),
                        F.when(F.col("tax") == 8, "Saas").otherwise("Personal").alias("profile"), (F.col("tax") >= 4).alias("evidence_gate"), F.when(F.col("disc") == 3, "Verified").otherwise("Research").alias("mode"))
    two = table(spark, sf, "nation").where("n_regionkey < 2").select(F.col("n_regionkey").alias("k")).distinct()
    d = lambda s: F.lit(s).cast("date")
    sources = c.crossJoin(two).select("request_id", F.concat(F.lit("P"), F.col("k").cast("string")).alias("source_id"), (~((F.col("k") == 0) & (F.col("qty") == 5))).alias("enabled"), (F.col("qty") == 6).alias("restricted"), d("1994-01-01").alias("valid_from"),
                                      F.when(F.col("qty") == 7, None).when(F.col("qty") == 8, d("1995-01-01")).otherwise(d("2030-01-01")).alias("valid_until"), d("1993-01-01").alias("reviewed_at"), F.to_date("known_at").alias("at"), (F.col("qty") != 9).alias("capability_supported"))
    ops = c.select("request_id", F.explode(F.array_compact(F.array(F.lit("Display"), F.lit("RetainOriginal"), F.when(F.col("disc") == 9, F.lit("Export")), F.when(F.col("tax") == 8, F.lit("SaasConsumption"))))).alias("operation"))
    yes, no = "ExplicitPermission", "ExplicitProhibition"
    perms = spark.createDataFrame([("P0", "Display", yes), ("P1", "Display", yes), ("P0", "RetainOriginal", yes), ("P1", "RetainOriginal", yes), ("P0", "Export", yes), ("P1", "Export", no), ("P0", "SaasConsumption", yes), ("P1", "SaasConsumption", yes)], "source_id string, operation string, permission string")
    return ev.usage_decisions(requests, sources, perms, ops)


TEXT["payloads"] = """
SELECT evidence_id, claim, CASE WHEN k = 7 THEN '{"boardCode":"MAIN","boardCode":"OTHER"}' WHEN k = 8 THEN 'not json' WHEN k = 9 THEN '{"extra":1}' WHEN k = 10 THEN '{}'
 WHEN claim = 'SecurityType' THEN CASE WHEN k % 3 = 0 THEN '{"classification":"ODD"}' ELSE '{"classification":"ORDINARY"}' END WHEN claim = 'BoardRegime' THEN '{"boardCode":"MAIN"}' WHEN claim = 'CompletedSession' THEN '{"sessionId":"s1","completion":"COMPLETED"}'
 WHEN claim = 'TradingStatus' THEN '{"sessionId":"s1","status":"TRADING"}' ELSE '{"noticeId":"n1","status":"SUSPENDED"}' END AS payload, k FROM {{evidence}}"""


@query("prj12_decode_evidence", """
SELECT evidence_id, CASE WHEN k IN (7, 8) THEN 'PERSISTED_EVIDENCE_MALFORMED' WHEN k = 9 THEN 'PAYLOAD_MEMBER_UNKNOWN' WHEN k = 10 THEN 'PAYLOAD_MEMBER_MISSING' WHEN claim = 'SecurityType' AND k % 3 = 0 THEN 'PAYLOAD_VOCABULARY_INVALID' END AS decode_reason,
 CASE WHEN k IN (7, 8, 9, 10) THEN NULL WHEN claim = 'SecurityType' THEN CASE WHEN k % 3 <> 0 THEN 'ORDINARY' END WHEN claim = 'BoardRegime' THEN 'MAIN' WHEN claim = 'CompletedSession' THEN 's1|COMPLETED' WHEN claim = 'TradingStatus' THEN 's1|TRADING' ELSE 'n1|SUSPENDED' END AS value FROM {{payloads}}""")
def _prj12(spark, sf):
    return ev.decode_evidence(table(spark, sf, "payloads")).select("evidence_id", "decode_reason", "value")


TEXT["premise_edges"] = """
SELECT e.evidence_id, concat('V', CAST(CAST(substr(e.evidence_id, 2) AS BIGINT) - 150 - k AS VARCHAR(12))) AS premise_id FROM {{evidence}} e WHERE k < 40 AND CAST(substr(e.evidence_id, 2) AS BIGINT) - 150 - k >= 0"""


@query("jn7_premise_closure", """
WITH RECURSIVE c AS (SELECT evidence_id AS root_id, evidence_id AS node_id FROM {{evidence}} WHERE claim = 'CompletedSession' UNION SELECT c.root_id, e.premise_id FROM c JOIN {{premise_edges}} e ON e.evidence_id = c.node_id) SELECT root_id, node_id FROM c""")
def _jn7(spark, sf):
    return ev.premise_closure(records(spark, sf).where("claim = 'CompletedSession'"), table(spark, sf, "premise_edges"))


TEXT["graph_nodes"] = """
SELECT concat('G', CAST(user_id AS VARCHAR(12)), '-', CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR(12))) AS graph_id, concat('V', CAST(event_id AS VARCHAR(12))) AS evidence_id, CASE WHEN value > 200 THEN 'ROLE' ELSE concat('R', CAST(event_id AS VARCHAR(12))) END AS role FROM {{events}}"""
TEXT["graph_edges"] = """
SELECT concat('G', CAST(user_id AS VARCHAR(12)), '-', CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR(12))) AS graph_id, concat('V', CAST(event_id AS VARCHAR(12))) AS evidence_id, concat('V', CAST(CASE WHEN value > 180 AND event_type = 'view' THEN event_id WHEN value > 180 AND event_type = 'click' THEN 99999999 ELSE nxt END AS VARCHAR(12))) AS premise_id
FROM (SELECT *, CASE WHEN value > 150 AND event_type = 'error' THEN first_value(event_id) OVER (PARTITION BY user_id, date_trunc('week', ts) ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) ELSE lead(event_id) OVER (PARTITION BY user_id, date_trunc('week', ts) ORDER BY event_id) END AS nxt FROM {{events}}) x WHERE nxt IS NOT NULL"""


@query("jn8_audit_premises", """
WITH RECURSIVE e AS (SELECT DISTINCT * FROM {{graph_edges}}), ok AS (SELECT e.* FROM e JOIN {{graph_nodes}} n ON n.graph_id = e.graph_id AND n.evidence_id = e.premise_id WHERE e.evidence_id <> e.premise_id),
 b AS (SELECT graph_id, evidence_id AS s, evidence_id AS at FROM ok WHERE CAST(substr(premise_id, 2) AS BIGINT) < CAST(substr(evidence_id, 2) AS BIGINT) UNION SELECT b.graph_id, b.s, ok.premise_id FROM b JOIN ok ON ok.graph_id = b.graph_id AND ok.evidence_id = b.at),
 cyc AS (SELECT DISTINCT b.graph_id FROM b JOIN ok ON ok.graph_id = b.graph_id AND ok.evidence_id = b.at AND ok.premise_id = b.s)
SELECT DISTINCT graph_id, 'DUPLICATE_ROLE' AS problem FROM (SELECT graph_id FROM {{graph_nodes}} GROUP BY graph_id, role HAVING count(*) > 1) UNION ALL SELECT DISTINCT graph_id, 'UNKNOWN_DEPENDENCY' FROM e WHERE premise_id = 'V99999999' UNION ALL SELECT DISTINCT graph_id, 'SELF_DEPENDENCY' FROM e WHERE evidence_id = premise_id UNION ALL SELECT graph_id, 'CYCLE' FROM cyc""")
def _jn8(spark, sf):
    return ev.audit_premises(table(spark, sf, "graph_nodes"), table(spark, sf, "graph_edges"))


@query("jn11_validate_premises", """
SELECT p.evidence_id, p.premise_id, CASE WHEN t.evidence_id IS NULL THEN 'INPUT_UNAVAILABLE' WHEN t.claim <> 'CompletedSession' THEN 'CLAIM_MISMATCH' WHEN t.operation <> 'ASSERT' THEN 'NOT_AN_ASSERTION' WHEN t.known_at > e.known_at OR t.retrieved_at > e.known_at OR t.published_at > e.known_at THEN 'NOT_YET_VISIBLE'
 WHEN t.subject_id <> e.subject_id THEN 'SUBJECT_MISMATCH' WHEN NOT (t.effective_from <= e.effective_from AND (t.effective_to IS NULL OR t.effective_to >= e.effective_from)) THEN 'DATE_OUTSIDE' ELSE 'VALID' END AS verdict
FROM {{premise_edges}} p JOIN {{evidence}} e ON e.evidence_id = p.evidence_id LEFT JOIN {{evidence}} t ON t.evidence_id = p.premise_id""")
def _jn11(spark, sf):
    return ev.validate_premises(records(spark, sf), table(spark, sf, "premise_edges").withColumn("expected_claim", F.lit("CompletedSession")))


@query("st7_classify_evidence", f"""
WITH n AS (SELECT evidence_id, series, revision, CASE WHEN k = 3 THEN 'changed' ELSE value END AS value FROM {{{{evidence}}}}), r AS (SELECT evidence_id, series, revision, value FROM {{{{evidence}}}} WHERE known_at <= TIMESTAMP '2024-01-15')
SELECT n.evidence_id, CASE WHEN r.evidence_id IS NULL THEN 'INSERTED' WHEN r.value = n.value THEN 'DUPLICATE_IGNORED' ELSE 'IDENTITY_CONFLICT' END AS disposition FROM n LEFT JOIN r USING (evidence_id)""")
def _st7(spark, sf):
    x = records(spark, sf)
    new = x.select("evidence_id", "series", "revision", F.when(F.col("k") == 3, "changed").otherwise(F.col("value")).alias("value"))
    return ev.classify_evidence(new, x.where("known_at <= timestamp '2024-01-15'"), ["value"]).select("evidence_id", "disposition")


@query("src17_admit_evidence_batch", """
WITH m AS (SELECT DISTINCT source_id, claim, tier FROM {{evidence}} WHERE k < 80)
SELECT e.evidence_id, CASE WHEN retrieved_at IS NULL OR retrieved_at > known_at OR published_at > known_at THEN 'INGESTION_CHRONOLOGY_INVALID' WHEN CAST(substr(subject_id, 2) AS BIGINT) >= 140 THEN 'INGESTION_OUTSIDE_UNIVERSE' WHEN m.tier IS NULL OR NOT (e.tier <= CASE e.claim WHEN 'Suspension' THEN 0 ELSE 1 END) THEN 'INGESTION_SOURCE_INADMISSIBLE'
 WHEN series IS NULL OR revision <= 0 OR (revision = 1 AND supersedes_revision IS NOT NULL) OR (revision <> 1 AND (supersedes_revision IS NULL OR supersedes_revision >= revision)) THEN 'INGESTION_LINEAGE_INVALID' END AS reason
FROM {{evidence}} e LEFT JOIN m ON m.source_id = e.source_id AND m.claim = e.claim AND m.tier = e.tier""")
def _src17(spark, sf):
    x = records(spark, sf)
    universe = x.where("cast(substr(subject_id, 2, 20) as long) < 140").select(F.col("subject_id").alias("instrument_id")).distinct()
    good, bad = ev.admit_batch(x, universe, x.where("k < 80"))
    return good.select("evidence_id", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("evidence_id", "reason"))


@query("fn13_fact_identity", """SELECT evidence_id, '["' || claim || '"' || CASE WHEN series IS NULL THEN '' ELSE ',"' || logical_key || '"' END || ']' AS fact_key FROM {{evidence}}""")
def _fn13(spark, sf):
    x = records(spark, sf).withColumn("identifier", F.when(F.col("series").isNotNull(), F.col("logical_key")))
    return x.select("evidence_id", ev.fact_identity().alias("fact_key"))


@query("fn14_factual_value", """SELECT evidence_id, sha256('["' || claim || '","' || value || '"]') AS digest FROM {{evidence}}""")
def _fn14(spark, sf):
    x = records(spark, sf)
    return x.select("evidence_id", ev.factual_value(x, ["claim", "value", "source_id"], ["source_id"]).alias("digest"))
