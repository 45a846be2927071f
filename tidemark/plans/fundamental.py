"""Fundamental evidence queries."""

from pyspark.sql import functions as F

from tidemark.operators import fundamentals as fu
from tidemark.plans.adapters import TEXT, numbered, table
from tidemark.plans.registry import query

TEXT["amounts"] = "SELECT seq AS row_id, CAST(px AS VARCHAR(40)) AS amount, CASE WHEN qty = 1 THEN 29 WHEN qty = 2 THEN -25 ELSE CAST(disc AS INTEGER) - 5 END AS scale_power, CASE WHEN tax < 4 THEN 'NEGATE' ELSE 'KEEP' END AS sign FROM {{trades}}"


@query("prj22_normalize_amount", """
WITH v AS (SELECT *, CAST(amount AS DECIMAL(20,8)) * CASE scale_power WHEN 5 THEN 100000 WHEN 4 THEN 10000 WHEN 3 THEN 1000 WHEN 2 THEN 100 WHEN 1 THEN 10 ELSE 1 END AS up, CASE WHEN scale_power < 0 THEN -scale_power ELSE 0 END AS down FROM {{amounts}}),
 t AS (SELECT *, CAST(CAST(up AS DECIMAL(38,8)) AS VARCHAR) AS s FROM v), d AS (SELECT *, replace(s, '.', '') AS digits, 8 + down AS places FROM t), p AS (SELECT *, lpad(digits, CAST(greatest(length(digits), places + 1) AS INTEGER), '0') AS padded FROM d),
 r AS (SELECT row_id, scale_power, sign, amount, rtrim(rtrim(substr(padded, 1, CAST(length(padded) - places AS INTEGER)) || '.' || right(padded, CAST(places AS INTEGER)), '0'), '.') AS raw FROM p), z AS (SELECT *, CASE WHEN ltrim(split_part(raw, '.', 1), '0') = '' THEN '0' ELSE ltrim(split_part(raw, '.', 1), '0') END || CASE WHEN contains(raw, '.') THEN '.' || split_part(raw, '.', 2) ELSE '' END AS lit FROM r)
SELECT row_id, CASE WHEN scale_power = 29 THEN 'FUNDAMENTAL_MALFORMED' WHEN scale_power = -25 AND length(rtrim(split_part(amount, '.', 2), '0')) > 3 THEN 'FUNDAMENTAL_NUMERIC_UNREPRESENTABLE' END AS diagnostic,
 CASE WHEN scale_power = 29 OR (scale_power = -25 AND length(rtrim(split_part(amount, '.', 2), '0')) > 3) THEN NULL WHEN sign = 'NEGATE' AND lit <> '0' THEN '-' || lit ELSE lit END AS normalized FROM z""")
def _prj22(spark, sf):
    return fu.normalize_amount(table(spark, sf, "amounts")).select("row_id", "diagnostic", "normalized")


TEXT["metric_rows"] = """
SELECT seq AS row_id, CASE disc WHEN 0 THEN 'Revenue' WHEN 1 THEN 'TotalAssets' WHEN 2 THEN 'EarningsPerShare' WHEN 3 THEN 'SharesOutstanding' WHEN 4 THEN 'FreeCashFlow' WHEN 5 THEN 'DividendPerShare' WHEN 6 THEN 'DilutionObservation' ELSE 'Other' END AS metric,
 CASE tax WHEN 0 THEN 'PER_SHARE' WHEN 1 THEN 'SHARES' WHEN 2 THEN 'UNKNOWN' ELSE 'MONETARY' END AS unit_kind, CASE WHEN qty < 10 THEN 'INSTANT' WHEN qty < 25 THEN 'QUARTER' WHEN qty < 35 THEN 'YTD' ELSE 'ANNUAL' END AS period_kind, CASE WHEN flag = 'A' THEN 'DERIVED' ELSE 'REPORTED' END AS fact_kind,
 session_date AS start_date, session_date + CAST(qty AS INTEGER) AS end_date, CASE WHEN qty = 40 THEN NULL WHEN tax = 3 THEN session_date + 1 ELSE session_date END AS fiscal_start, CASE WHEN tax = 4 THEN session_date - 1 ELSE session_date + CAST(qty AS INTEGER) END AS fiscal_end, CASE WHEN disc = 2 THEN 1 END AS fiscal_quarter FROM {{trades}}"""


@query("prj23_metric_applicability", """
SELECT row_id, CASE WHEN CASE metric WHEN 'EarningsPerShare' THEN unit_kind <> 'PER_SHARE' WHEN 'DividendPerShare' THEN unit_kind <> 'PER_SHARE' WHEN 'SharesOutstanding' THEN unit_kind <> 'SHARES' ELSE unit_kind NOT IN ('MONETARY', 'SHARES') END
  OR (metric IN ('Revenue', 'EarningsPerShare', 'FreeCashFlow', 'DividendPerShare') AND period_kind = 'INSTANT') OR (metric = 'TotalAssets' AND period_kind <> 'INSTANT') THEN 'FUNDAMENTAL_INCOMPARABLE'
 WHEN (metric = 'FreeCashFlow' AND fact_kind <> 'DERIVED') OR (metric = 'DividendPerShare' AND fact_kind <> 'REPORTED') OR metric = 'DilutionObservation' THEN 'FUNDAMENTAL_BINDING_UNSUPPORTED' END AS diagnostic FROM {{metric_rows}}""")
def _prj23(spark, sf):
    return fu.metric_applicability(table(spark, sf, "metric_rows")).select("row_id", "diagnostic")


@query("prj24_fiscal_span", """
SELECT row_id, CASE WHEN (period_kind = 'ANNUAL' AND (fiscal_start IS NULL OR fiscal_end IS NULL OR start_date <> fiscal_start OR end_date <> fiscal_end)) OR (period_kind = 'YTD' AND fiscal_start IS NOT NULL AND start_date <> fiscal_start) OR (fiscal_quarter IS NOT NULL AND period_kind NOT IN ('QUARTER', 'YTD')) OR fiscal_start > fiscal_end THEN 'FUNDAMENTAL_INCOMPARABLE' END AS diagnostic FROM {{metric_rows}}""")
def _prj24(spark, sf):
    return fu.fiscal_span(table(spark, sf, "metric_rows")).select("row_id", "diagnostic")


TEXT["scope_rows"] = """
SELECT seq AS row_id, concat('{"period":{"type":"DURATION","kind":"QUARTER","startDate":"', CAST(session_date AS VARCHAR(10)), '","endDate":"', CASE WHEN qty = 1 THEN 'soon' ELSE CAST(session_date + 90 AS VARCHAR(10)) END, '"},"unit":{"kind":"MONETARY"', CASE WHEN tax < 4 THEN ',"currencyCode":"IDR"' ELSE '' END, '},"accounting":{"consolidation":"CONSOLIDATED"', CASE WHEN disc < 5 THEN ',"auditStatus":"AUDITED"' ELSE '' END, '}}') AS scope_json, session_date, qty, tax, disc FROM {{trades}}"""


@query("prj26_fundamental_scope", """SELECT row_id, 'DURATION' AS period_type, 'QUARTER' AS period_kind, session_date AS start_date, CASE WHEN qty <> 1 THEN session_date + 90 END AS end_date, 'MONETARY' AS unit_kind, CASE WHEN tax < 4 THEN 'IDR' ELSE 'UNKNOWN' END AS currency, 'CONSOLIDATED' AS consolidation, 'UNKNOWN' AS attribution, CASE WHEN disc < 5 THEN 'AUDITED' ELSE 'UNKNOWN' END AS audit_status FROM {{scope_rows}}""")
def _prj26(spark, sf):
    return fu.fundamental_scope(table(spark, sf, "scope_rows")).select("row_id", "period_type", "period_kind", "start_date", "end_date", "unit_kind", "currency", "consolidation", "attribution", "audit_status")


TEXT["fundamental_entries"] = """
SELECT concat('C', CAST(o_custkey AS VARCHAR(12))) AS series, n + CASE WHEN o_custkey % 10 = 1 AND n > 3 THEN 1 ELSE 0 END AS revision_number, CASE WHEN n > 1 THEN n - 1 + CASE WHEN o_custkey % 10 = 1 AND n > 4 THEN 1 ELSE 0 END - CASE WHEN o_custkey % 10 = 2 THEN 1 ELSE 0 END END AS supersedes_revision_number,
 CASE WHEN o_orderstatus = 'P' AND (n > 1 OR o_custkey % 10 = 3) THEN 'CANCEL' ELSE 'ASSERT' END AS operation, CASE WHEN o_custkey % 10 <> 4 THEN 'p' END AS premise_id, CASE WHEN o_totalprice > 250000 THEN 'T1' ELSE 'T2' END AS authority_tier,
 CAST(DATE '1996-01-01' + CAST(floor(n / 2) * 200 AS INTEGER) AS TIMESTAMP) AS known_at, CASE WHEN n % 3 = 0 THEN CAST(DATE '1996-01-01' + CAST(n * 150 AS INTEGER) AS TIMESTAMP) END AS retrieved_at, CAST(NULL AS TIMESTAMP) AS published_at
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM {{orders}}) x"""


@query("sm7_validate_series", """
SELECT series, count(*) AS entries, CASE WHEN count(*) <> count(DISTINCT revision_number) OR min(revision_number) <> 1 OR max(revision_number) <> count(*) OR count(*) FILTER (WHERE supersedes_revision_number IS DISTINCT FROM CASE WHEN revision_number > 1 THEN revision_number - 1 END) > 0
 OR count(*) FILTER (WHERE operation = 'CANCEL' AND (revision_number = 1 OR premise_id IS NULL)) > 0 THEN 'FUNDAMENTAL_MALFORMED' END AS diagnostic FROM {{fundamental_entries}} GROUP BY series""")
def _sm7(spark, sf):
    return fu.validate_series(table(spark, sf, "fundamental_entries"))


@query("sm8_governing_revision", """
WITH v AS (SELECT * FROM {{fundamental_entries}} WHERE known_at <= TIMESTAMP '1998-12-31' AND (retrieved_at IS NULL OR retrieved_at <= TIMESTAMP '1998-12-31')), h AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY series ORDER BY revision_number DESC) = 1),
 c AS (SELECT h.series, count(*) AS n FROM h JOIN v ON v.series = h.series AND v.operation = 'ASSERT' AND v.authority_tier = h.authority_tier AND v.known_at = h.known_at GROUP BY 1), r AS (SELECT series, max(revision_number) FILTER (WHERE operation = 'ASSERT') AS reinstated_revision FROM v GROUP BY 1)
SELECT h.series, CASE WHEN operation <> 'CANCEL' AND coalesce(n, 0) <= 1 THEN revision_number END AS governing_revision, CASE WHEN operation <> 'CANCEL' AND n > 1 THEN 'FUNDAMENTAL_CONFLICT' END AS diagnostic, reinstated_revision FROM h LEFT JOIN c USING (series) JOIN r USING (series)""")
def _sm8(spark, sf):
    return fu.governing_revision(table(spark, sf, "fundamental_entries"), "1998-12-31")


TEXT["quarters"] = """
SELECT concat('C', CAST(o_custkey AS VARCHAR(12))) AS subject_id, concat('Q', CAST(o_orderkey AS VARCHAR(12))) AS period_id, 'QUARTER' AS period_kind, DATE '1995-01-01' + CAST(n * 90 AS INTEGER) - CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS start_date, DATE '1995-01-01' + CAST(n * 90 + 89 AS INTEGER) - CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS end_date
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM {{orders}}) x"""


@query("sm9_period_coverage", """SELECT subject_id, period_id, start_date, CASE WHEN lag(end_date) OVER w IS NOT NULL AND start_date <> lag(end_date) OVER w + 1 THEN 'FUNDAMENTAL_INCOMPARABLE' END AS diagnostic FROM {{quarters}} WINDOW w AS (PARTITION BY subject_id ORDER BY start_date, end_date, period_id)""")
def _sm9(spark, sf):
    return fu.period_coverage(table(spark, sf, "quarters"))


TEXT["fact_sides"] = """
SELECT seq AS pair_id, 'S' AS subject_id, 'Revenue' AS metric, 'd1' AS definition_id, 'DURATION' AS period_type, session_date AS start_date, session_date + 90 AS end_date, 'QUARTER' AS period_kind, 'MONETARY' AS unit_kind, CASE WHEN tax = 1 THEN NULL ELSE 'IDR' END AS currency, 'REPORTED' AS fact_kind,
 'CONSOLIDATED' AS consolidation, 'TOTAL' AS attribution, CASE WHEN disc = 1 THEN 'UNKNOWN' ELSE 'AUDITED' END AS audit_status, 'IFRS' AS statement_family, qty FROM {{trades}}"""
TEXT["fact_other"] = "SELECT pair_id, subject_id, CASE WHEN qty = 1 THEN 'NetIncome' ELSE metric END AS metric, definition_id, period_type, start_date, CASE WHEN qty = 2 THEN end_date + 1 ELSE end_date END AS end_date, period_kind, unit_kind, currency, fact_kind, consolidation, attribution, audit_status, CASE WHEN qty = 3 THEN 'GAAP' ELSE statement_family END AS statement_family, qty FROM {{fact_sides}}"


@query("sm10_comparable_facts", "SELECT pair_id, CASE WHEN qty <= 3 OR audit_status = 'UNKNOWN' THEN 'FUNDAMENTAL_INCOMPARABLE' END AS diagnostic FROM {{fact_sides}}")
def _sm10(spark, sf):
    sides = numbered(table(spark, sf, "fact_sides"), "pair_id")
    return fu.comparable_facts(sides, table(spark, sf, "fact_other", fact_sides=sides)).withColumn("pair_id", F.col("pair_id.id"))


@query("prj21_validate_fundamentals")
def _prj21(spark, sf):
    t = table(spark, sf, "trades")
    s, q = F.col("session_date").cast("string"), F.col("qty")
    body = F.concat(
        F.lit('{"evidenceId":"e","policyId":"fundamental-v0.1.0","schemaVersion":1,"payloadSchemaVersion":1,"claim":"FundamentalFact","scopeKind":"REPORTING_ENTITY","subject":{"namespace":"idx","code":"A"},"sourceId":"alpha","sourceReference":"r","assertionKey":"k","revisionSeriesId":"'),
        F.lit("alpha\\u001ffundamental-v0.1.0/FundamentalFact/k"), F.lit('","revisionNumber":'), (q - 1).cast("string"), F.lit(',"supersedesRevisionNumber":null,"lineageEvidence":null,"authorityTier":"'), F.when(q > 45, "T5").otherwise("T1"),
        F.lit('","publishedAt":null,"publicationDate":null,"publicationEvidence":null,"receipt":null,"knownAt":"'), s, F.lit('T00:00:00Z","recordedAt":"'), s, F.lit('T01:00:00Z","admission":{},"payload":{},"payloadSha256":"'), F.sha2(F.lit("p"), 256), F.lit('"}'))
    return fu.validate_fundamentals(t.select("seq", body.alias("body"))).select("seq", F.array_join("diagnostics", ",").alias("diagnostics"))
