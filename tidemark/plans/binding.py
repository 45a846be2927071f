"""Payloads of evidence claims, bound to their records."""

from tidemark.operators import claims as cl
from tidemark.plans import evidence  # noqa: F401  (its derived tables are used here)
from tidemark.plans.adapters import TEXT, table
from tidemark.plans.registry import query

TEXT["claim_records"] = """
SELECT evidence_id, claim, operation, completeness, CASE WHEN k = 41 THEN NULL WHEN k = 42 THEN 2 ELSE 1 END AS payload_version, k <> 43 AS policy_supported, CASE WHEN claim = 'BoardRegime' AND k % 3 <> 0 THEN 'ContinuingState' WHEN claim = 'TradingStatus' AND k % 3 <> 0 THEN 'SessionFact' ELSE evidence_class END AS evidence_class,
 CASE WHEN claim = 'CompletedSession' THEN CASE WHEN k % 10 = 0 THEN 'INSTRUMENT' ELSE 'EXCHANGE' END WHEN k % 11 = 0 THEN 'EXCHANGE' ELSE 'INSTRUMENT' END AS scope_kind, tier, effective_from, effective_to, known_at, retrieved_at, 'a' AS raw_artifact_id, series, revision, supersedes_revision,
 concat('{"operation":"', operation, '","completeness":"', completeness, '","value":', CASE WHEN operation = 'CANCEL' AND k % 4 <> 1 THEN 'null'
  WHEN claim = 'BoardRegime' THEN CASE k % 7 WHEN 0 THEN '{"boardCode":"OTHER"}' WHEN 1 THEN '{"boardCode":"MAIN","otherCode":"X"}' WHEN 2 THEN '{"boardCode":"ODD"}' WHEN 3 THEN '{"boardCode":" MAIN"}' WHEN 4 THEN '{"boardCode":7}' ELSE '{"boardCode":"MAIN"}' END
  WHEN claim = 'SecurityType' THEN CASE k % 5 WHEN 0 THEN '{"classification":"ODD"}' WHEN 1 THEN '{"classification":"ORDINARY","extra":"y"}' WHEN 2 THEN '{}' ELSE '{"classification":"INDEX"}' END
  WHEN claim = 'CompletedSession' THEN concat('{"sessionId":"s', CAST(k % 3 AS VARCHAR(4)), '","completion":"', CASE WHEN k % 4 = 0 THEN 'UNPROVED' ELSE 'COMPLETED' END, '"', CASE WHEN k % 5 = 0 THEN '' ELSE concat(',"completedAt":"', CAST(CAST(known_at AS DATE) AS VARCHAR(10)), 'T12:00:00Z"') END, '}')
  WHEN claim = 'Suspension' THEN concat('{"status":"', CASE WHEN k % 6 = 0 THEN 'TRADING' ELSE 'SUSPENDED' END, '","noticeId":"n', CAST(k AS VARCHAR(4)), '"}') ELSE '{"status":"TRADING","sessionId":"s1"}' END, CASE WHEN k = 44 THEN '' ELSE '}' END) AS payload FROM {{evidence}}"""


@query("prj12_bind_evidence", """
WITH r AS (SELECT *, CASE WHEN json_valid(payload) THEN payload ELSE '{}' END AS p, NOT json_valid(payload) AS bad FROM {{claim_records}}),
 j AS (SELECT *, operation = 'CANCEL' AS cancel, json_type(p, '$.value') AS vt, p->>'$.value.boardCode' AS board, json_type(p, '$.value.boardCode') AS board_type, p->>'$.value.otherCode' AS other, p->>'$.value.classification' AS kind, json_keys(p, '$.value') AS ks,
   p->>'$.value.completion' AS done, p->>'$.value.completedAt' AS done_at, p->>'$.value.status' AS status FROM r),
 w AS (SELECT *, CASE WHEN claim = 'BoardRegime' THEN CASE WHEN board_type <> 'VARCHAR' OR board NOT IN ('MAIN', 'DEVELOPMENT', 'ACCELERATION', 'NEW_ECONOMY', 'SPECIAL_MONITORING', 'OTHER') THEN 'MEMBER_INVALID:boardCode' WHEN (board = 'OTHER') <> (other IS NOT NULL) THEN 'OTHER_CODE' END
   WHEN claim = 'SecurityType' THEN CASE WHEN len(list_filter(ks, lambda x: x <> 'classification')) > 0 THEN 'MEMBER_UNKNOWN' WHEN len(ks) = 0 THEN 'MEMBER_MISSING' WHEN kind NOT IN ('ORDINARY', 'INDEX', 'OTHER') THEN 'MEMBER_INVALID:classification' END
   WHEN claim = 'CompletedSession' THEN CASE WHEN (done = 'COMPLETED') <> (done_at IS NOT NULL) THEN 'COMPLETED_AT' WHEN CAST(replace(replace(done_at, 'T', ' '), 'Z', '') AS TIMESTAMP) > known_at THEN 'COMPLETED_LATER' END
   WHEN claim = 'Suspension' THEN CASE WHEN status <> 'SUSPENDED' THEN 'MEMBER_INVALID:status' END
   WHEN claim = 'TradingStatus' THEN CASE WHEN tier > 1 THEN 'SOURCE_TIER' END END AS own FROM j),
 b AS (SELECT *, CASE WHEN bad THEN 'PARSE' WHEN coalesce(board, '') LIKE ' %' THEN 'TEXT' WHEN cancel AND (vt <> 'NULL' OR completeness <> 'FULL') THEN 'CANCEL_VALUE' WHEN NOT cancel AND own IS NOT NULL THEN own
   WHEN NOT CASE WHEN claim IN ('BoardRegime', 'SecurityType', 'Suspension') THEN evidence_class IN ('ContinuingState', 'PointObservation') ELSE evidence_class = 'SessionFact' END THEN 'CLASS'
   WHEN (scope_kind = 'EXCHANGE' AND claim IN ('BoardRegime', 'SecurityType')) OR (scope_kind = 'INSTRUMENT' AND claim = 'CompletedSession') THEN 'SCOPE' WHEN evidence_class = 'PointObservation' AND effective_to IS NULL THEN 'POINT_END'
   WHEN evidence_class = 'SessionFact' AND effective_to IS DISTINCT FROM effective_from THEN 'SESSION_DATE' WHEN cancel AND (series IS NULL OR coalesce(supersedes_revision >= revision, true)) THEN 'CANCEL_TARGET' END AS broken FROM w),
 d AS (SELECT *, CASE WHEN NOT policy_supported THEN 'PERSISTED_EVIDENCE_BINDING_UNSUPPORTED' WHEN payload_version IS NULL THEN 'PERSISTED_EVIDENCE_UNBOUND' WHEN payload_version <> 1 THEN 'PERSISTED_EVIDENCE_BINDING_UNSUPPORTED' WHEN broken IS NOT NULL THEN 'PERSISTED_EVIDENCE_MALFORMED' END AS decode_reason FROM b)
SELECT evidence_id, decode_reason, CASE WHEN decode_reason = 'PERSISTED_EVIDENCE_MALFORMED' THEN broken END AS rule, CASE WHEN decode_reason IS NULL AND NOT cancel THEN CASE claim WHEN 'CompletedSession' THEN CAST(to_json([claim, p->>'$.value.sessionId']) AS VARCHAR) WHEN 'Suspension' THEN CAST(to_json([claim, p->>'$.value.noticeId']) AS VARCHAR)
  WHEN 'TradingStatus' THEN CAST(to_json([claim, p->>'$.value.sessionId']) AS VARCHAR) ELSE CAST(to_json([claim]) AS VARCHAR) END END AS identifier FROM d""")
def _bind(spark, sf):
    """What each record's payload says, or the first rule of its claim that it breaks."""
    return cl.bind_evidence(table(spark, sf, "claim_records")).select("evidence_id", "decode_reason", "rule", "identifier")


def uuid_sql(n: str) -> str:
    return f"concat('00000000-0000-0000-0000-', lpad(CAST({n} AS VARCHAR(12)), 12, '0'))"


TEXT["premise_records"] = f"""
SELECT {uuid_sql('n')} AS evidence_id, CASE k % 4 WHEN 0 THEN 'Reopening' WHEN 1 THEN 'CorporateAction' ELSE 'Suspension' END AS claim, 1 AS payload_version, true AS policy_supported, CASE k % 4 WHEN 1 THEN 'PointObservation' ELSE 'ContinuingState' END AS evidence_class, 'INSTRUMENT' AS scope_kind, 0 AS tier,
 effective_from, CASE WHEN k % 4 = 1 THEN effective_from ELSE effective_to END AS effective_to, known_at, retrieved_at, 'a' AS raw_artifact_id, concat('Z', CAST(n % 50 AS VARCHAR(4))) AS series, n AS revision, CASE WHEN k % 9 = 0 THEN n - 50 WHEN k % 9 = 1 THEN n - 51 END AS supersedes_revision,
 CASE WHEN k % 4 >= 2 AND k % 9 < 2 THEN '{{"operation":"CANCEL","completeness":"FULL","value":null}}' ELSE concat('{{"operation":"ASSERT","completeness":"FULL","value":', CASE k % 4
  WHEN 0 THEN concat('{{"reopeningId":"r","status":"TRADING","reopeningDate":"', CAST(effective_from AS VARCHAR(10)), '","suspensionEvidenceId":"', {uuid_sql('n + 2')}, '"}}')
  WHEN 1 THEN concat('{{"kind":"COVERAGE","coverageId":"c","coverage":"COMPLETE","eventEvidenceIds":[', CASE WHEN k % 8 = 1 THEN '' ELSE concat('"', {uuid_sql('n + 4')}, '","', {uuid_sql('n + 8')}, '"') END, ']}}') ELSE '{{"status":"SUSPENDED","noticeId":"n"}}' END, '}}') END AS payload
FROM (SELECT e.*, CAST(substr(evidence_id, 2) AS BIGINT) + 1 AS n FROM {{{{evidence}}}} e) x"""


@query("jn7_payload_edges", f"""
WITH r AS (SELECT *, payload->>'$.operation' = 'CANCEL' AS cancel FROM {{{{premise_records}}}}), ok AS (SELECT * FROM r WHERE NOT cancel OR supersedes_revision < revision)
SELECT evidence_id, payload->>'$.value.suspensionEvidenceId' AS premise_id, 'suspensionEvidenceId' AS role, 'Suspension' AS expected_claim FROM ok WHERE claim = 'Reopening'
UNION ALL SELECT evidence_id, unnest(CAST(payload->'$.value.eventEvidenceIds' AS VARCHAR[])), 'eventEvidenceIds', 'CorporateAction' FROM ok WHERE claim = 'CorporateAction'
UNION ALL SELECT a.evidence_id, b.evidence_id, 'cancelledRevision', a.claim FROM ok a LEFT JOIN r b ON b.series = a.series AND b.revision = a.supersedes_revision WHERE a.cancel""")
def _edges(spark, sf):
    """What each record rests on, as its payload says."""
    return cl.premise_edges(cl.bind_evidence(table(spark, sf, "premise_records")))
