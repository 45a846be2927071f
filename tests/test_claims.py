import json
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.operators import claims as cl

SCHEMA = "id string, claim string, payload string, payload_version int, policy_supported boolean, evidence_class string, scope_kind string, tier int, effective_from date, effective_to date, known_at timestamp, retrieved_at timestamp, raw_artifact_id string, series string, revision long, supersedes_revision long"
DAY, ID, OTHER_ID = date(2024, 3, 4), "11111111-2222-3333-4444-555555555555", "21111111-2222-3333-4444-555555555555"
BAR = dict(open="100.50", high="101", low="99.0", close="100", volume=10, adjustedClose=None, volumeUnit="SHARES", volumeBasis="RAW_AS_TRADED", marketSegment="REGULAR")


def bar_hash(bar):
    import hashlib

    plain = lambda t: None if t is None else (t.rstrip("0").rstrip(".") if "." in t else t)
    parts = [DAY.isoformat(), *[plain(bar[k]) for k in ("open", "high", "low", "close")], str(bar["volume"]), plain(bar["adjustedClose"]), bar["volumeUnit"], bar["volumeBasis"], bar["marketSegment"]]
    return hashlib.sha256(json.dumps([p for p in parts], separators=(",", ":")).encode()).hexdigest()


GOOD = {
    "StableIdentity": dict(sourceCode="BBCA"), "SecurityType": dict(classification="ORDINARY"), "Currency": dict(currencyCode="IDR"), "ListingCoverage": dict(listingDate="2024-03-04"), "Delisting": dict(delistingDate="2024-03-04"),
    "BoardRegime": dict(boardCode="MAIN"), "BoardChange": dict(changeId="c", fromBoard=dict(boardCode="MAIN"), toBoard=dict(boardCode="OTHER", otherCode="X"), changeDate="2024-03-04"),
    "ExchangeRuleVersion": dict(ruleId="r", ruleVersion="1", mechanism="CONTINUOUS"), "MechanismException": dict(exceptionId="e", exceptionType="t", mechanism="OTHER", otherMechanism="m"),
    "Suspension": dict(status="SUSPENDED", noticeId="n"), "Reopening": dict(reopeningId="r", status="TRADING", reopeningDate="2024-03-04", suspensionEvidenceId=ID), "ScheduledSession": dict(sessionId="s", schedule="OPEN"),
    "CompletedSession": dict(sessionId="s", completion="COMPLETED", completedAt="2024-03-04T09:00:00+00:00"), "TradingStatus": dict(status="TRADING", sessionId="s"),
    "SourcePriceConvention": dict(priceSourceId="p", endpoint="e", field="f", version="1", priceKind="STOCK_RAW", continuity="RAW_AS_TRADED", zeroVolumeMeaning="UNPROVED", syntheticIdentification="UNPROVED", documentationReference="d"),
    "GenuinePriceObservation": dict(sessionId="s", bar=BAR, barRevision=1, barContentHash=bar_hash(BAR), conventionEvidenceId=ID, completedSessionEvidenceId=ID, syntheticOrCarryForward="NO", placeholder="NO", substituted="NO", zeroVolumeSemantics="NOT_APPLICABLE", zeroVolumeProof="NONE"),
    "CorporateAction": dict(kind="EVENT", eventId="e", actionType="SPLIT", effectiveDate="2024-03-04", ratio=dict(newUnits="2", oldUnits="1"), termsReference=None),
}
CLASS = {"ExchangeRuleVersion": "VersionedRule", "SourcePriceConvention": "SourceConvention", "CorporateAction": "PointObservation", **{c: "SessionFact" for c in ("ScheduledSession", "CompletedSession", "TradingStatus", "GenuinePriceObservation")}}


def record(name, claim, value="good", payload=None, **changes):
    value = GOOD[claim] if value == "good" else value
    text = json.dumps(dict(operation=changes.pop("operation", "ASSERT"), completeness=changes.pop("completeness", "FULL"), value=value)) if payload is None else payload
    base = dict(id=name, claim=claim, payload=text, payload_version=1, policy_supported=True, evidence_class=CLASS.get(claim, "ContinuingState"), scope_kind="EXCHANGE" if claim in ("ScheduledSession", "CompletedSession") else "INSTRUMENT", tier=1,
                effective_from=DAY, effective_to=DAY, known_at=datetime(2024, 3, 5), retrieved_at=datetime(2024, 3, 4, 12), raw_artifact_id=ID, series="s", revision=2, supersedes_revision=1)
    return tuple({**base, **changes}.values())


def changed(claim, **members):
    return {k: v for k, v in {**GOOD[claim], **members}.items() if v != "gone"}


def price(bar=None, **members):
    bar = {**BAR, **(bar or {})}
    return {**GOOD["GenuinePriceObservation"], "bar": bar, "barContentHash": bar_hash(bar), **members}


M = cl.MALFORMED
CASES = [
    # (name, record, reason, rule)
    *[(f"good {c}", record(f"good {c}", c), None, None) for c in GOOD],
    ("coverage", record("coverage", "CorporateAction", dict(kind="COVERAGE", coverageId="c", coverage="COMPLETE", eventEvidenceIds=[ID, OTHER_ID])), None, None),
    ("zero volume", record("zero volume", "GenuinePriceObservation", price(dict(volume=0), zeroVolumeSemantics="EXPLICITLY_GENUINE", zeroVolumeProof="EXPLICIT_SOURCE_FLAG")), None, None),
    ("cancel", record("cancel", "Suspension", None, operation="CANCEL"), None, None),
    ("date of a point", record("date of a point", "ListingCoverage", dict(listingDate="2001-01-01"), evidence_class="PointObservation"), None, None),
    ("policy", record("policy", "Currency", policy_supported=False), cl.UNSUPPORTED, None), ("unbound", record("unbound", "Currency", payload_version=None), cl.UNBOUND, None), ("version", record("version", "Currency", payload_version=2), cl.UNSUPPORTED, None),
    ("derived", record("derived", "PriceComparability", {}), cl.DERIVED, None), ("claim", record("claim", "Nonsense", {}), cl.UNSUPPORTED, None),
    ("large", record("large", "StableIdentity", payload=json.dumps(dict(operation="ASSERT", completeness="FULL", value=dict(sourceCode="x" * 70_000)))), cl.BOUND_EXCEEDED, None),
    ("many", record("many", "CorporateAction", dict(kind="COVERAGE", coverageId="c", coverage="COMPLETE", eventEvidenceIds=[ID] * 257)), cl.BOUND_EXCEEDED, None),
    ("not json", record("not json", "Currency", payload="nonsense"), M, "PARSE"), ("null", record("null", "Currency", payload="")[:2] + (None,) + record("null", "Currency")[3:], M, "PARSE"), ("twice", record("twice", "Currency", payload='{"operation":"ASSERT","operation":"ASSERT","completeness":"FULL","value":{"currencyCode":"IDR"}}'), M, "PARSE"),
    ("empty text", record("empty text", "StableIdentity", dict(sourceCode="")), M, "TEXT"), ("spaces", record("spaces", "StableIdentity", dict(sourceCode=" x")), M, "TEXT"), ("long text", record("long text", "StableIdentity", dict(sourceCode="x" * 201)), M, "TEXT"), ("control", record("control", "StableIdentity", dict(sourceCode="a\nb")), M, "TEXT"),
    ("envelope", record("envelope", "Currency", payload='{"operation":"ASSERT","value":{"currencyCode":"IDR"}}'), M, "ENVELOPE"), ("operation", record("operation", "Currency", operation="DROP"), M, "OPERATION"), ("completeness", record("completeness", "Currency", completeness="SOME"), M, "COMPLETENESS"),
    ("cancel with value", record("cancel with value", "Currency", operation="CANCEL"), M, "CANCEL_VALUE"), ("partial cancel", record("partial cancel", "Currency", None, operation="CANCEL", completeness="PARTIAL"), M, "CANCEL_VALUE"), ("no value", record("no value", "Currency", None), M, "CANCEL_VALUE"),
    ("kind", record("kind", "CorporateAction", changed("CorporateAction", kind="ODD")), M, "KIND"),
    *[(f"unknown {c}", record(f"unknown {c}", c, changed(c, extra="x")), M, "MEMBER_UNKNOWN") for c in GOOD],
    *[(f"missing {c}", record(f"missing {c}", c, changed(c, **{[k for k in GOOD[c] if k != "kind"][0]: "gone"})), M, "MEMBER_MISSING") for c in GOOD],
    *[(f"number {c}", record(f"number {c}", c, changed(c, **{[k for k in GOOD[c] if k != "kind"][0]: 5})), M, f"MEMBER_INVALID:{[k for k in GOOD[c] if k != 'kind'][0]}") for c in GOOD],
    ("inner", record("inner", "BoardChange", changed("BoardChange", fromBoard=dict(boardCode="MAIN", more="x"))), M, "MEMBER_UNKNOWN"), ("inner word", record("inner word", "BoardChange", changed("BoardChange", toBoard=dict(boardCode="ODD"))), M, "MEMBER_INVALID:toBoard.boardCode"),
    ("date", record("date", "Delisting", dict(delistingDate="2024-02-30")), M, "MEMBER_INVALID:delistingDate"), ("zero id", record("zero id", "Reopening", changed("Reopening", suspensionEvidenceId=cl.NO_UUID)), M, "MEMBER_INVALID:suspensionEvidenceId"),
    ("currency", record("currency", "Currency", dict(currencyCode="idr")), M, "CURRENCY_CODE"), ("listing", record("listing", "ListingCoverage", dict(listingDate="2001-01-01")), M, "LISTING_DATE"), ("delisting", record("delisting", "Delisting", dict(delistingDate="2001-01-01")), M, "DELISTING_DATE"),
    ("other code", record("other code", "BoardRegime", dict(boardCode="MAIN", otherCode="X")), M, "OTHER_CODE"), ("no other code", record("no other code", "ExchangeRuleVersion", changed("ExchangeRuleVersion", mechanism="OTHER")), M, "OTHER_CODE"), ("exception code", record("exception code", "MechanismException", changed("MechanismException", otherMechanism="gone")), M, "OTHER_CODE"),
    ("board codes", record("board codes", "BoardChange", changed("BoardChange", toBoard=dict(boardCode="OTHER"))), M, "OTHER_CODE"), ("change", record("change", "BoardChange", changed("BoardChange", changeDate="2024-03-05")), M, "CHANGE_DATE"), ("reopening", record("reopening", "Reopening", changed("Reopening", reopeningDate="2024-03-05")), M, "REOPENING_DATE"),
    ("completed", record("completed", "CompletedSession", changed("CompletedSession", completion="UNPROVED")), M, "COMPLETED_AT"), ("later", record("later", "CompletedSession", changed("CompletedSession", completedAt="2024-03-06T00:00:00Z")), M, "COMPLETED_LATER"), ("tier", record("tier", "TradingStatus", tier=3), M, "SOURCE_TIER"),
    ("prices", record("prices", "GenuinePriceObservation", price(dict(high="99.5"))), M, "PRICES"), ("negative", record("negative", "GenuinePriceObservation", price(dict(low="-1"))), M, "PRICES"), ("zero", record("zero", "GenuinePriceObservation", price(dict(volume=0))), M, "ZERO_VOLUME"),
    ("hash", record("hash", "GenuinePriceObservation", price(barContentHash="0" * 64)), M, "BAR_HASH"), ("artifact", record("artifact", "GenuinePriceObservation", raw_artifact_id=None), M, "ARTIFACT"), ("decimal", record("decimal", "GenuinePriceObservation", price(dict(open="1e2"))), M, "MEMBER_INVALID:bar.open"),
    ("ratio", record("ratio", "CorporateAction", changed("CorporateAction", ratio=dict(newUnits="0", oldUnits="1"))), M, "RATIO"), ("effective", record("effective", "CorporateAction", changed("CorporateAction", effectiveDate="2024-03-05")), M, "EFFECTIVE_DATE"),
    ("events", record("events", "CorporateAction", dict(kind="COVERAGE", coverageId="c", coverage="COMPLETE", eventEvidenceIds=[OTHER_ID, ID])), M, "EVENT_IDS"), ("event twice", record("event twice", "CorporateAction", dict(kind="COVERAGE", coverageId="c", coverage="COMPLETE", eventEvidenceIds=[ID, ID])), M, "EVENT_IDS"),
    *[(f"class {c}", record(f"class {c}", c, evidence_class="VersionedRule" if c != "ExchangeRuleVersion" else "SessionFact"), M, "CLASS") for c in GOOD],
    ("no tier", record("no tier", "Currency", tier=None), M, "TIER"), ("scope", record("scope", "Currency", scope_kind="EXCHANGE"), M, "SCOPE"), ("session scope", record("session scope", "ScheduledSession", scope_kind="INSTRUMENT"), M, "SCOPE"),
    ("point end", record("point end", "Suspension", evidence_class="PointObservation", effective_to=None), M, "POINT_END"), ("session date", record("session date", "TradingStatus", effective_to=DAY + timedelta(1)), M, "SESSION_DATE"), ("no target", record("no target", "Suspension", None, operation="CANCEL", supersedes_revision=None), M, "CANCEL_TARGET"),
]


@pytest.fixture(scope="module")
def bound(spark):
    df = spark.createDataFrame([r for _, r, _, _ in CASES], SCHEMA)
    return {r["id"]: r for r in cl.bind_evidence(df).collect()}


def test_each_claim_and_each_rule(bound):
    wrong = {n: (bound[n]["decode_reason"], bound[n]["rule"], reason, rule) for n, _, reason, rule in CASES if (bound[n]["decode_reason"], bound[n]["rule"]) != (reason, rule)}
    assert not wrong
    assert datetime(2024, 3, 4, tzinfo=timezone.utc) and len(GOOD) == 17 and set(cl.NAMES) == set(GOOD)


def test_values_and_identities(bound):
    assert json.loads(bound["good Currency"]["value"]) == {"currencyCode": "IDR"} and bound["cancel"]["value"] is None and bound["cancel"]["operation"] == "CANCEL"
    assert bound["good Currency"]["identifier"] == '["Currency"]' and bound["good SourcePriceConvention"]["identifier"] == '["SourcePriceConvention","p","e","f"]' and bound["good CorporateAction"]["identifier"] == '["CorporateAction","e"]'
    assert bound["currency"]["value"] is None and bound["currency"]["identifier"] is None


def test_premises_are_read_from_payloads(spark):
    df = spark.createDataFrame([r for n, r, _, _ in CASES if n.startswith(("good", "coverage", "cancel", "prices"))], SCHEMA).withColumnRenamed("id", "evidence_id")
    df = df.withColumn("series", F.col("claim")).withColumn("revision", F.when(F.col("evidence_id") == "cancel", 2).otherwise(1).cast("long"))
    edges = {(r["evidence_id"], r["premise_id"], r["role"], r["expected_claim"]) for r in cl.premise_edges(cl.bind_evidence(df)).collect()}
    assert edges == {
        ("good GenuinePriceObservation", ID, "conventionEvidenceId", "SourcePriceConvention"), ("good GenuinePriceObservation", ID, "completedSessionEvidenceId", "CompletedSession"), ("good Reopening", ID, "suspensionEvidenceId", "Suspension"),
        ("coverage", ID, "eventEvidenceIds", "CorporateAction"), ("coverage", OTHER_ID, "eventEvidenceIds", "CorporateAction"), ("cancel", "good Suspension", "cancelledRevision", "Suspension")}


def test_premises_bind_each_record_once_in_many_tasks(spark):
    df = spark.createDataFrame([r for n, r, _, _ in CASES if n.startswith(("good", "coverage", "cancel", "prices"))], SCHEMA).withColumnRenamed("id", "evidence_id").coalesce(1)
    read = spark.sparkContext.accumulator(0)

    def pass_on(frames):
        for frame in frames:
            read.add(len(frame))
            yield frame

    bound = cl.bind_evidence(df.mapInPandas(pass_on, df.schema))
    assert bound.rdd.getNumPartitions() > 1
    read.value = 0
    assert cl.premise_edges(bound).count() > 0
    assert read.value == df.count()
