"""Typed evidence: admission, validity, resolution by authority, as-of reads, premises, readiness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import canonical_reasons, first_reason, reasons_where
from tidemark.operators.pit import instant
from tidemark.session import cut_lineage, shared

# Claim -> weakest authority tier that may state it.
HIGHEST_TIER = {
    "StableIdentity": 1, "SecurityType": 1, "Currency": 1, "ListingCoverage": 1, "Delisting": 0, "BoardRegime": 1, "BoardChange": 1,
    "ExchangeRuleVersion": 1, "MechanismException": 1, "Suspension": 0, "Reopening": 0, "ScheduledSession": 1, "CompletedSession": 1,
    "CorporateAction": 1, "SourcePriceConvention": 2, "GenuinePriceObservation": 2, "PriceComparability": 3, "TradingStatus": 1,
}
SECONDARY_TIER = 5
# Feature -> cleared observations it needs.
REQUIRED_OBSERVATIONS = {"Ema20": 20, "Ema50": 50, "Atr14": 15, "PriorHigh20": 21, "PriorLow20": 21, "DistanceToHighPercent": 21, "Rs20": 21, "Rs60": 61}
#: Layers of a dependency graph taken away per written round.
STRIPS = 2
OPTIONAL_FEATURES = ("RelativeVolume", "MonetaryLiquidityProxy", "ActualTradedValue", "Rs20", "Rs60", "MarketContext")


def _table(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def admit_sources(df: DataFrame) -> DataFrame:
    """Adds ``admitted``: the claim may be stated by that authority tier."""
    limit = F.element_at(_table(HIGHEST_TIER), F.col("claim"))
    ok = F.coalesce((F.col("tier") != SECONDARY_TIER) & (F.col("tier") <= limit), F.lit(False))
    return df.withColumn("admitted", ok).withColumn("admission_reason", F.when(~ok, F.lit("EVIDENCE_SOURCE_INADMISSIBLE")))


def seen_at(cutoff) -> Column:
    at = instant(cutoff)
    return (F.col("known_at") <= at) & (F.col("retrieved_at").isNull() | (F.col("retrieved_at") <= at)) & (F.col("published_at").isNull() | (F.col("published_at") <= at))


def contains(day: Column, start: str = "effective_from", end: str = "effective_to") -> Column:
    return (F.col(start) <= day) & (F.col(end).isNull() | (F.col(end) >= day))


def evidence_validity(df: DataFrame, day, cutoff) -> DataFrame:
    """Adds ``validity`` (VERIFIED, STALE, UNKNOWN) by evidence class, for one evaluation date."""
    d = F.lit(day).cast("date")
    start, end, kind = F.col("effective_from"), F.col("effective_to"), F.col("evidence_class")
    verified, stale, unknown = F.lit("VERIFIED"), F.lit("STALE"), F.lit("UNKNOWN")
    value = (
        F.when(~seen_at(cutoff), unknown)
        .when(kind == "SessionFact", F.when((start == d) & F.coalesce(end == d, F.lit(False)), verified).otherwise(unknown))
        .when(kind == "PointObservation", F.when(end.isNull() | (d < start), unknown).when(d <= end, verified).otherwise(stale))
        .when(kind == "VersionedRule", F.when(contains(d), verified).otherwise(unknown))
        .when(kind.isin("ContinuingState", "SourceConvention"), F.when(d < start, unknown).when(end < d, stale).otherwise(verified))
        .otherwise(unknown)
    )
    return df.withColumn("validity", value)


def resolve_evidence(candidates: DataFrame, keys: Sequence[str], day, cutoff) -> DataFrame:
    """One resolution per key: best tier, then best specificity, minus superseded revisions; different
    values left over are a conflict.

    Columns: series, revision, supersedes_revision, tier, specificity, value, known_at, evidence_id.
    Each narrowing is an aggregate joined back, so a key with very many records is reduced map-side.
    """
    keys = list(keys)
    live = candidates.where(contains(F.lit(day).cast("date")) & seen_at(cutoff))
    best = live.groupBy(*keys).agg(F.min(F.struct("tier", (-F.col("specificity")).alias("s"))).alias("__best"), F.count("*").alias("candidates"))
    group = live.join(best, keys).where((F.col("tier") == F.col("__best.tier")) & (F.col("specificity") == -F.col("__best.s"))).drop("__best")
    top = group.where("series is not null").groupBy(*keys, "series").agg(F.max("revision").alias("__top"))
    named = group.where("series is not null and supersedes_revision is not null").select(*keys, "series", F.col("supersedes_revision").alias("revision"), F.lit(True).alias("__replaced")).distinct()
    marked = group.join(top, [*keys, "series"], "left").join(named, [*keys, "series", "revision"], "left")
    alive = (F.col("series").isNull() | (F.col("revision") == F.col("__top"))) & F.col("__replaced").isNull()
    order = F.struct((-F.unix_micros(F.col("known_at").cast("timestamp"))).alias("k"), (-F.col("revision")).alias("r"), "series", "evidence_id")
    out = marked.groupBy(*keys).agg(
        F.max("candidates").alias("candidates"), F.count_if(alive).alias("__left"),
        F.min(F.when(alive, F.col("value"))).alias("__low"), F.max(F.when(alive, F.col("value"))).alias("__high"),
        F.min_by("evidence_id", F.when(alive, order)).alias("__winner"))
    conflict = (F.col("__left") == 0) | (F.col("__low") != F.col("__high"))
    return out.select(*keys, "candidates", conflict.alias("conflicting"), F.when(~conflict, F.col("__low")).alias("value"), F.when(~conflict, F.col("__winner")).alias("evidence_id"))


def evidence_as_of(records: DataFrame, day, cutoff) -> DataFrame:
    """Every (subject, claim, logical key) at a date and cutoff: selected value and quality.

    A visible cancellation in force removes its target's whole logical lineage up to that revision.
    """
    d = F.lit(day).cast("date")
    key = ["subject_id", "claim", "logical_key"]
    usable = shared(admit_sources(records.where(seen_at(cutoff))).where("admitted"))
    asserts = usable.where("operation = 'ASSERT'")
    target = asserts.select("series", F.col("revision").alias("supersedes_revision"), F.col("tier").alias("__tier"), F.col("logical_key").alias("__key"))
    cancels = usable.where("operation = 'CANCEL'").where(contains(d)).join(target, ["series", "supersedes_revision"]).where(F.col("tier") <= F.col("__tier"))
    reach = cancels.groupBy("series", F.col("__key").alias("logical_key")).agg(F.max("supersedes_revision").alias("__until"))
    kept = asserts.join(reach, ["series", "logical_key"], "left").where(F.col("__until").isNull() | (F.col("revision") > F.col("__until")))
    judged = evidence_validity(kept, day, cutoff).where("validity <> 'UNKNOWN'").withColumn(
        "quality", F.when(F.col("validity") == "STALE", F.lit("STALE")).when(F.col("completeness") == "PARTIAL", F.lit("PARTIAL")).otherwise(F.lit("VERIFIED")))
    judged = shared(judged)
    chosen = resolve_evidence(judged.where("quality <> 'STALE'"), key, day, cutoff)
    qualities = judged.select("evidence_id", F.col("quality").alias("__quality"))
    stale = judged.groupBy(*key).agg(F.max(F.col("quality") == "STALE").alias("__stale"))
    x = stale.join(chosen, key, "left").join(qualities, "evidence_id", "left")
    quality = F.when(F.col("conflicting"), F.lit("CONFLICTING")).when(F.col("evidence_id").isNotNull(), F.col("__quality")).when(F.col("__stale"), F.lit("STALE")).otherwise(F.lit("UNKNOWN"))
    return x.select(*key, "value", "evidence_id", quality.alias("quality"))


def overall_quality(facts: DataFrame, by: Sequence[str]) -> DataFrame:
    any_of = lambda q: F.bool_or(F.col("quality") == q)
    order = ("CONFLICTING", "UNKNOWN", "PARTIAL", "VERIFIED", "STALE")
    agg = facts.groupBy(*by).agg(*[any_of(q).alias(q) for q in order], F.count("*").alias("facts"))
    return agg.select(*by, "facts", first_reason(*[(F.col(q), q) for q in order], otherwise="UNKNOWN").alias("quality"))


def trading_status(facts: DataFrame, by: Sequence[str] = ("subject_id",)) -> DataFrame:
    """Status per subject from status facts: tier, specificity, latest effective date; contradictions conflict.

    Columns: status, quality, tier, specificity, effective_from, source_id.
    """
    by = list(by)
    best = facts.groupBy(*by).agg(F.min(F.struct("tier", (-F.col("specificity")).alias("s"), (-F.unix_date("effective_from")).alias("f"))).alias("b"))
    top = facts.join(best, by).where((F.col("tier") == F.col("b.tier")) & (F.col("specificity") == -F.col("b.s")) & (F.unix_date("effective_from") == -F.col("b.f")))
    rank = F.when(F.col("quality") == "VERIFIED", 0).when(F.col("quality") == "PARTIAL", 1).when(F.col("quality") == "STALE", 2).otherwise(3)
    x = top.groupBy(*by).agg(
        (F.min("status") != F.max("status")).alias("__differ"), F.bool_or(F.col("quality") == "CONFLICTING").alias("__clash"),
        F.min_by(F.struct("status", "quality"), F.struct(rank, "source_id")).alias("c"))
    conflict = F.col("__differ") | F.col("__clash")
    status = F.when(conflict, F.lit("UNKNOWN")).otherwise(F.col("c.status"))
    quality = F.when(conflict, F.lit("CONFLICTING")).otherwise(F.col("c.quality"))
    first = F.when(conflict, F.lit("STATUS_CONFLICT")).when(F.col("c.status") == "TRADING", F.lit("STATUS_TRADING")).when(
        F.col("c.status") == "SUSPENDED", F.lit("SUSPENDED")).when(F.col("c.status") == "REOPENING_UNCONFIRMED", F.lit("REOPENING_UNCONFIRMED")).otherwise(F.lit("STATUS_UNKNOWN"))
    second = F.when(~conflict, F.when(F.col("c.quality") == "PARTIAL", F.lit("STATUS_COVERAGE_PARTIAL")).when(F.col("c.quality") == "STALE", F.lit("STATUS_STALE")))
    return x.select(*by, status.alias("status"), quality.alias("quality"), canonical_reasons(F.array(first, second)).alias("reasons"))


def combine_claims(first: DataFrame, second: DataFrame, keys: Sequence[str], day, cutoff) -> DataFrame:
    """Two claims answering one question (a regime and its changes, a rule and its exceptions), resolved together."""
    both = shared(first.unionByName(second))
    chosen = resolve_evidence(both, keys, day, cutoff)
    live = both.where(contains(F.lit(day).cast("date")) & seen_at(cutoff))
    best = live.groupBy(*keys).agg(F.min(F.struct("tier", (-F.col("specificity")).alias("s"))).alias("b"))
    rough = live.join(best, list(keys)).where((F.col("tier") == F.col("b.tier")) & (F.col("specificity") == -F.col("b.s"))).groupBy(*keys).agg(
        F.bool_or(F.col("quality") != "VERIFIED").alias("__rough"))
    x = chosen.join(rough, list(keys))
    return x.select(*keys, "value", F.when(F.col("conflicting"), F.lit("CONFLICTING")).when(F.col("__rough"), F.lit("PARTIAL")).otherwise(F.lit("VERIFIED")).alias("quality"))


def admit_prices(df: DataFrame) -> DataFrame:
    bad = (F.col("revision_number") <= 0) | ~F.coalesce(F.lower("content_hash").rlike("^[0-9a-f]{64}$"), F.lit(False)) | F.coalesce(F.col("known_at") < F.col("retrieved_at"), F.lit(False))
    return df.withColumn("reason", first_reason(
        (~F.col("convention_admitted"), "PRICE_BASIS_UNVERIFIED"), (~F.col("session_completed"), "SESSION_UNCONFIRMED"),
        (F.col("synthetic"), "PRICE_SYNTHETIC_CARRY_FORWARD"), (F.col("placeholder"), "PRICE_PLACEHOLDER"), (F.col("substituted"), "PRICE_SUBSTITUTED"),
        ((F.col("volume") == 0) & (F.col("zero_semantics") != "ExplicitlyGenuine"), "ZERO_VOLUME_UNEXPLAINED"), (bad, "PRICE_INVARIANT_INVALID")))


def price_comparability(df: DataFrame) -> DataFrame:
    unmet = canonical_reasons(reasons_where(
        (~F.col("identity_continuity"), "IDENTITY_CONFLICT"), (~F.col("currency_continuity"), "PRICE_BASIS_UNVERIFIED"), (~F.col("convention_continuity"), "PRICE_BASIS_UNVERIFIED"),
        (~F.col("session_continuity"), "SESSION_UNAVAILABLE"), (~F.col("action_coverage"), "CORPORATE_ACTION_COVERAGE_PARTIAL"), (~F.col("revision_binding"), "PRICE_CLEARANCE_INCOMPLETE")))
    broken = F.col("known_breaks") > 0
    return df.withColumn("comparability", F.when(broken, F.lit("KNOWN_BREAK")).when(F.size(unmet) > 0, F.lit("UNRESOLVED")).otherwise(F.lit("CLEARED"))).withColumn(
        "comparability_reasons", F.when(broken, F.array(F.lit("PRICE_KNOWN_BREAK"))).when(F.size(unmet) > 0, unmet).otherwise(F.array(F.lit("PRICE_CLEARED"))))


def market_eligibility(df: DataFrame) -> DataFrame:
    """First matching of the ordered market rules, as status and reason."""
    c = lambda n: F.col(n)
    status_reason = F.when(c("status_quality") == "PARTIAL", "STATUS_COVERAGE_PARTIAL").when(c("status_quality") == "STALE", "STATUS_STALE").when(
        c("status_quality") == "CONFLICTING", "STATUS_CONFLICT").when(c("status") == "REOPENING_UNCONFIRMED", "REOPENING_UNCONFIRMED").otherwise("STATUS_UNKNOWN")
    rules = [
        (c("identity_conflict"), "B", "IDENTITY_CONFLICT"), (~c("identity_verified"), "B", "REFERENCE_NOT_KNOWN"), (c("type_unsupported"), "I", "UNSUPPORTED_TYPE"), (~c("type_known"), "B", "TYPE_UNKNOWN"),
        (c("pre_listing"), "I", "PRE_LISTING"), (c("post_delisting"), "I", "POST_DELISTING"), (~c("listing_known"), "B", "LISTING_UNKNOWN"), (c("board_conflict"), "B", "BOARD_CONFLICT"),
        (c("mechanism_unresolved"), "B", "MECHANISM_UNRESOLVED"), (~c("board_known"), "B", "BOARD_UNKNOWN"), (c("board_unsupported"), "I", "UNSUPPORTED_BOARD"), (~c("mechanism_known"), "B", "MECHANISM_UNRESOLVED"),
        (c("status") == "SUSPENDED", "I", "SUSPENDED"), ((c("status") != "TRADING") | (c("status_quality") != "VERIFIED"), "B", None), (~c("session_completed"), "B", "SESSION_UNCONFIRMED"),
    ]
    kind, why = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
    for test, k, r in rules:
        kind = kind.when(test, F.lit({"B": "DATA_BLOCKED", "I": "INELIGIBLE"}[k]))
        why = why.when(test, status_reason if r is None else F.lit(r))
    return df.withColumn("market_status", kind.otherwise(F.lit("ELIGIBLE"))).withColumn("market_reason", why)


def feature_readiness(df: DataFrame) -> DataFrame:
    """State of each technical feature from comparability and counted observations."""
    need = F.element_at(_table(REQUIRED_OBSERVATIONS), F.col("feature"))
    relative = F.col("feature").isin("Rs20", "Rs60")
    reason = first_reason(
        (F.col("comparability") == "KNOWN_BREAK", "PRICE_KNOWN_BREAK"), (F.col("comparability") != "CLEARED", "PRICE_UNRESOLVED"), (relative & ~F.col("benchmark_available"), "BENCHMARK_MISSING"),
        (relative & (F.col("benchmark_observations") < need), "INSUFFICIENT_HISTORY"), (F.col("observations") < need, "INSUFFICIENT_HISTORY"))
    return df.withColumn("reason", reason).withColumn("availability", F.when(reason.isNull(), F.lit("AVAILABLE")).when(reason == "INSUFFICIENT_HISTORY", F.lit("WARMUP")).otherwise(F.lit("UNAVAILABLE")))


def optional_readiness(df: DataFrame) -> DataFrame:
    f = F.col("feature")
    gate = F.when(f == "RelativeVolume", F.col("quantity_comparable")).when(f == "MonetaryLiquidityProxy", F.col("currency_compatible")).when(f == "ActualTradedValue", F.col("value_admitted")).otherwise(F.col("benchmark_available"))
    missing = F.when(f.isin("RelativeVolume", "MonetaryLiquidityProxy"), F.lit("VOLUME_BASIS_UNVERIFIED")).when(f == "ActualTradedValue", F.lit("PRICE_BASIS_UNVERIFIED")).otherwise(F.lit("BENCHMARK_MISSING"))
    enough = F.when(f.isin("Rs20", "Rs60", "MarketContext"), F.col("benchmark_sufficient")).otherwise(F.col("history_sufficient"))
    return df.withColumn("availability", F.when(~gate, F.lit("UNAVAILABLE")).when(enough, F.lit("AVAILABLE")).otherwise(F.lit("WARMUP"))).withColumn(
        "reason", F.when(~gate, missing).when(~enough, F.lit("INSUFFICIENT_HISTORY")))


def data_readiness(df: DataFrame) -> DataFrame:
    """Market, comparability and every core feature together. ``core``: array of struct<availability, reason>."""
    eligible, cleared = F.col("market_status") == "ELIGIBLE", F.col("comparability") == "CLEARED"
    ready = (F.size("core") > 0) & F.forall("core", lambda s: s["availability"] == "AVAILABLE")
    none = F.array().cast("array<string>")
    reasons = F.concat(
        F.when(~eligible, F.array(F.lit("MARKET_NOT_ELIGIBLE"), F.col("market_reason"))).otherwise(none),
        F.when(~cleared, F.concat(F.array(F.lit("DATA_NOT_READY")), F.col("comparability_reasons"))).otherwise(none),
        F.transform(F.filter("core", lambda s: s["availability"] != "AVAILABLE"), lambda s: F.coalesce(s["reason"], F.lit("INSUFFICIENT_HISTORY"))))
    return df.withColumn("data_ready", eligible & cleared & ready).withColumn("reasons", canonical_reasons(reasons))


def readiness(market: DataFrame, spans: DataFrame, observations: DataFrame) -> DataFrame:
    """Readiness of every request: market facts, price spans and per-feature observations, all keyed by request_id."""
    core = feature_readiness(observations.where(~F.col("feature").isin("Rs20", "Rs60"))).groupBy("request_id").agg(
        F.collect_list(F.struct("availability", "reason")).alias("core"))  # one entry per core feature
    x = market_eligibility(market).join(price_comparability(spans), "request_id").join(core, "request_id")
    return data_readiness(x)


def usage_decisions(requests: DataFrame, sources: DataFrame, permissions: DataFrame, operations: DataFrame) -> DataFrame:
    """Decision per request from its sources' permissions, windows and capabilities.

    ``requests``: request_id, feature_enabled, mode_supported, capability_missing, selection_matches, exporting, profile,
    evidence_gate, mode. ``sources``: request_id, source_id, enabled, restricted, valid_from, valid_until, reviewed_at, at,
    capability_supported. ``operations``: request_id, operation. ``permissions``: source_id, operation, permission.
    """
    needed = sources.select("request_id", "source_id").join(operations, "request_id").join(permissions, ["source_id", "operation"], "left")
    held = needed.groupBy("request_id").agg(
        F.bool_or(F.coalesce(F.col("permission") == "ExplicitProhibition", F.lit(False))).alias("prohibited"),
        F.bool_and(F.coalesce(F.col("permission") == "ExplicitPermission", F.lit(False))).alias("permitted"))
    unclear = F.col("restricted") | F.col("reviewed_at").isNull() | (F.col("reviewed_at") > F.col("at")) | F.col("valid_from").isNull() | (F.col("at") < F.col("valid_from")) | F.col("valid_until").isNull()
    state = sources.groupBy("request_id").agg(
        F.bool_and("enabled").alias("all_enabled"), F.bool_or(F.coalesce(F.col("at") >= F.col("valid_until"), F.lit(False))).alias("expired"),
        F.bool_or(F.coalesce(unclear, F.lit(True))).alias("unclear"), F.bool_and("capability_supported").alias("capable"))
    x = requests.join(state, "request_id", "left").join(held, "request_id", "left")
    deny = lambda code: F.when(F.col("exporting"), F.lit("EXPORT_NOT_PERMITTED")).otherwise(F.lit(code))
    reason = (
        F.when(~F.col("feature_enabled"), F.lit("FEATURE_DISABLED")).when(~F.col("mode_supported"), F.lit("MODE_UNSUPPORTED")).when(F.col("capability_missing"), F.lit("CAPABILITY_MISSING"))
        .when(~F.col("selection_matches"), F.lit("SOURCE_SELECTION_MISMATCH")).when(~F.col("all_enabled"), F.lit("SOURCE_DISABLED"))
        .when(F.col("prohibited"), deny("PERMISSION_PROHIBITED")).when(F.col("expired"), deny("PERMISSION_EXPIRED")).when(~F.col("permitted") | F.col("unclear"), deny("PERMISSION_UNKNOWN"))
        .when(F.col("profile") == "Saas", F.lit("UNSUPPORTED_PROFILE")).when(~F.col("capable"), F.lit("CAPABILITY_UNSUPPORTED"))
        .when((F.col("mode") == "Verified") & ~F.col("evidence_gate"), F.lit("EVIDENCE_NOT_ADMITTED")).otherwise(F.lit("USAGE_PERMITTED")))
    return x.select("request_id", (reason == "USAGE_PERMITTED").alias("permitted"), reason.alias("reason"))


# Payload schema and allowed vocabularies of the decoded claims.
PAYLOADS = {
    "SecurityType": ("classification string", {"classification": ("ORDINARY", "PREFERRED", "INDEX", "RIGHT", "WARRANT", "OTHER")}),
    "BoardRegime": ("boardCode string", {"boardCode": ("MAIN", "DEVELOPMENT", "ACCELERATION", "NEW_ECONOMY", "SPECIAL_MONITORING", "OTHER")}),
    "CompletedSession": ("sessionId string, completion string", {"completion": ("COMPLETED", "UNPROVED")}),
    "TradingStatus": ("sessionId string, status string", {"status": ("TRADING", "SUSPENDED")}),
    "Suspension": ("noticeId string, status string", {"status": ("SUSPENDED",)}),
}


def decode_evidence(records: DataFrame) -> DataFrame:
    """Decodes JSON payloads per claim and names what is wrong: malformed text or duplicate members,
    members outside the closed set, a value outside its vocabulary, a missing member."""
    parsed = F.try_parse_json("payload")
    reason, value = F.when(parsed.isNull(), F.lit("PERSISTED_EVIDENCE_MALFORMED")), None
    names = F.json_object_keys("payload")
    for claim, (schema, words) in PAYLOADS.items():
        mine = F.col("claim") == claim
        fields = [part.split()[0] for part in schema.split(", ")]
        body = F.from_json("payload", schema)
        open_members = F.size(F.array_except(names, F.array(*[F.lit(f) for f in fields]))) > 0
        missing = F.lit(False)
        for f in fields:
            missing = missing | body[f].isNull()
        outside = F.lit(False)
        for f, allowed in words.items():
            outside = outside | ~F.coalesce(body[f].isin(*allowed), F.lit(False))
        reason = reason.when(mine & open_members, F.lit("PAYLOAD_MEMBER_UNKNOWN")).when(mine & missing, F.lit("PAYLOAD_MEMBER_MISSING")).when(mine & outside, F.lit("PAYLOAD_VOCABULARY_INVALID"))
        text = F.concat_ws("|", *[body[f] for f in fields])
        value = F.when(mine, text) if value is None else value.when(mine, text)
    reason = reason.when(~F.col("claim").isin(*PAYLOADS), F.lit("CLAIM_UNSUPPORTED"))
    return records.withColumn("decode_reason", reason).withColumn("value", F.when(reason.isNull(), value))


def premise_closure(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """Everything each root rests on, transitively. ``edges``: evidence_id, premise_id.

    Each round follows edges from newly reached nodes only and is written out before the next one.
    """
    reached = cut_lineage(roots.select(F.col("evidence_id").alias("root_id"), F.col("evidence_id").alias("node_id")).distinct())
    frontier = reached
    while not frontier.isEmpty():
        step = frontier.join(edges.select(F.col("evidence_id").alias("node_id"), "premise_id"), "node_id").select("root_id", F.col("premise_id").alias("node_id")).distinct()
        frontier = cut_lineage(step.join(reached, ["root_id", "node_id"], "left_anti"))
        reached = cut_lineage(reached.unionByName(frontier))
    return reached


def audit_premises(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Graph problems per graph: duplicate id or role, unknown or self dependency, cycle.

    ``nodes``: graph_id, evidence_id, role. ``edges``: graph_id, evidence_id, premise_id. Cycles are what
    remains after repeatedly taking away nodes that depend on nothing left.
    """
    def found(df: DataFrame, code: str) -> DataFrame:
        return df.select("graph_id", F.lit(code).alias("problem")).distinct()

    key = ["graph_id", "evidence_id"]
    twice = nodes.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    roles = nodes.groupBy("graph_id", "role").agg(F.count("*").alias("n")).where("n > 1")
    ids = nodes.select(*key).distinct()
    unknown = edges.join(ids.withColumnRenamed("evidence_id", "premise_id"), ["graph_id", "premise_id"], "left_anti")
    own = edges.where("evidence_id = premise_id")
    out = found(twice, "DUPLICATE_ID").unionByName(found(roles, "DUPLICATE_ROLE")).unionByName(found(unknown, "UNKNOWN_DEPENDENCY")).unionByName(found(own, "SELF_DEPENDENCY"))
    inside = edges.join(ids.withColumnRenamed("evidence_id", "premise_id"), ["graph_id", "premise_id"], "left_semi").where("evidence_id <> premise_id").select(*key, "premise_id").distinct()
    left = cut_lineage(inside)
    size = left.count()
    while size:
        nxt = left
        for _ in range(STRIPS):  # several layers per written round
            blocked = nxt.select("graph_id", F.col("evidence_id").alias("premise_id")).distinct()
            nxt = nxt.join(blocked, ["graph_id", "premise_id"], "left_semi")
        left = cut_lineage(nxt)
        size, before = left.count(), size
        if size == before:
            break
    return out.unionByName(found(left, "CYCLE"))


def validate_premises(records: DataFrame, premises: DataFrame) -> DataFrame:
    """Verdict of every premise link: the target exists, asserts the expected claim, was visible when the
    record became known, shares subject and covers the record's date. ``premises``: evidence_id, premise_id, expected_claim."""
    mine = records.select("evidence_id", "subject_id", "known_at", "effective_from")
    t = records.select(F.col("evidence_id").alias("premise_id"), F.col("claim").alias("t_claim"), F.col("operation").alias("t_op"), F.col("subject_id").alias("t_subject"), F.col("known_at").alias("t_known"),
                       F.col("retrieved_at").alias("t_retrieved"), F.col("published_at").alias("t_published"), F.col("effective_from").alias("t_from"), F.col("effective_to").alias("t_to"))
    x = premises.join(mine, "evidence_id").join(t, "premise_id", "left")
    hidden = (F.col("t_known") > F.col("known_at")) | F.coalesce(F.col("t_retrieved") > F.col("known_at"), F.lit(False)) | F.coalesce(F.col("t_published") > F.col("known_at"), F.lit(False))
    verdict = first_reason(
        (F.col("t_claim").isNull(), "INPUT_UNAVAILABLE"), (F.col("t_claim") != F.col("expected_claim"), "CLAIM_MISMATCH"), (F.col("t_op") != "ASSERT", "NOT_AN_ASSERTION"), (hidden, "NOT_YET_VISIBLE"),
        (F.col("t_subject") != F.col("subject_id"), "SUBJECT_MISMATCH"), (~contains(F.col("effective_from"), "t_from", "t_to"), "DATE_OUTSIDE"), otherwise="VALID")
    return x.select("evidence_id", "premise_id", verdict.alias("verdict"))


def classify_evidence(new: DataFrame, retained: DataFrame, content: Sequence[str]) -> DataFrame:
    """Disposition of each record: same identity or same (series, revision) is a duplicate when the content is
    equal and an identity conflict otherwise; anything else is inserted."""
    digest = F.sha2(F.to_json(F.array(*[F.col(c).cast("string") for c in content])), 256)
    by_id = retained.select("evidence_id", digest.alias("__a"))
    by_series = retained.where("series is not null").select("series", "revision", digest.alias("__b"))
    x = new.withColumn("__d", digest).join(by_id, "evidence_id", "left").join(by_series, ["series", "revision"], "left")
    base = F.coalesce("__a", "__b")
    return x.select(*new.columns, F.when(base.isNull(), F.lit("INSERTED")).when(base == F.col("__d"), F.lit("DUPLICATE_IGNORED")).otherwise(F.lit("IDENTITY_CONFLICT")).alias("disposition"))


def fact_identity() -> Column:
    """Logical grouping key of a fact: the claim and the identifiers its payload carries."""
    return F.to_json(F.array_compact(F.array("claim", "identifier")))


def factual_value(df: DataFrame, fields: Sequence[str], citations: Sequence[str]) -> Column:
    """Digest of a value's factual part; citation fields do not count."""
    kept = [f for f in fields if f not in citations]
    return F.sha2(F.to_json(F.array(*[F.col(f).cast("string") for f in kept])), 256)


def admit_batch(rows: DataFrame, universe: DataFrame, mappings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows (with the order in which prerequisites precede dependants) and rejected rows with a reason."""
    twice = rows.groupBy("evidence_id").agg(F.count("*").alias("__n"))
    member = universe.select(F.col("instrument_id").alias("subject_id"), F.lit(True).alias("__in"))
    mapped = mappings.select("source_id", "claim", "tier", F.lit(True).alias("__map")).distinct()
    x = admit_sources(rows.join(twice, "evidence_id").join(member, "subject_id", "left").join(mapped, ["source_id", "claim", "tier"], "left"))
    clocks = (F.col("retrieved_at") > F.col("known_at")) | F.coalesce(F.col("published_at") > F.col("known_at"), F.lit(False))
    lineage = F.col("series").isNull() | (F.col("revision") <= 0) | F.when(F.col("revision") == 1, F.col("supersedes_revision").isNotNull()).otherwise(
        F.col("supersedes_revision").isNull() | (F.col("supersedes_revision") >= F.col("revision")))
    reason = first_reason((F.coalesce(clocks, F.lit(True)), "INGESTION_CHRONOLOGY_INVALID"), (F.col("__n") > 1, "INGESTION_DUPLICATE_IDENTITY"), (F.col("__in").isNull(), "INGESTION_OUTSIDE_UNIVERSE"),
                          (F.col("__map").isNull() | ~F.col("admitted"), "INGESTION_SOURCE_INADMISSIBLE"), (lineage, "INGESTION_LINEAGE_INVALID"))
    phase = F.when(F.col("claim") == "GenuinePriceObservation", 3).when(F.col("claim") == "Reopening", 2).when(F.col("claim") == "CorporateAction", 1).otherwise(0)
    x = x.withColumn("reason", reason).withColumn("phase", phase)
    return x.where("reason is null").select(*rows.columns, "phase"), x.where("reason is not null").select(*rows.columns, "reason")
