"""Payloads of all evidence claims: what each holds, and how it binds to its record, as data.

A payload is a JSON object of operation, completeness and value. Each claim names the members of its value with their
kinds, the evidence classes that may carry it, whether it may be about a whole exchange, and further rules between
members or with the record. Payloads are parsed to ``variant`` once; rules are column expressions made from the registry.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.evidence import HIGHEST_TIER, SECONDARY_TIER
from tidemark.session import shared

# Codes, bounds, formats and vocabularies of the payload contract.
MALFORMED, UNBOUND, UNSUPPORTED = "PERSISTED_EVIDENCE_MALFORMED", "PERSISTED_EVIDENCE_UNBOUND", "PERSISTED_EVIDENCE_BINDING_UNSUPPORTED"
DERIVED, BOUND_EXCEEDED = "PERSISTED_EVIDENCE_DERIVED_CLAIM", "PERSISTED_EVIDENCE_BOUND_EXCEEDED"
PAYLOAD_VERSION, MAXIMUM_BYTES, MAXIMUM_ITEMS, MAXIMUM_TEXT = 1, 65_536, 256, 200
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
NO_UUID = "00000000-0000-0000-0000-000000000000"
DECIMAL = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?$"
BOARD = ("MAIN", "DEVELOPMENT", "ACCELERATION", "NEW_ECONOMY", "SPECIAL_MONITORING", "OTHER")
MECHANISM, MARKER = ("CONTINUOUS", "CALL_AUCTION", "OTHER"), ("YES", "NO", "UNPROVED")


@dataclass(frozen=True)
class Member:
    """A member: text, word (of a vocabulary), date, instant, uuid, uuids, decimal, long or object."""

    kind: str
    words: tuple[str, ...] = ()
    nullable: bool = False
    members: tuple[tuple[str, Member], ...] = ()


def word(*words: str) -> Member:
    return Member("word", words)


TEXT, DATE, ID, AMOUNT = Member("text"), Member("date"), Member("uuid"), Member("decimal")
OPTIONAL_TEXT = Member("text", nullable=True)
BOARD_MEMBERS = (("boardCode", word(*BOARD)), ("otherCode", OPTIONAL_TEXT))
BAR_MEMBERS = (
    ("open", AMOUNT), ("high", AMOUNT), ("low", AMOUNT), ("close", AMOUNT), ("volume", Member("long")), ("adjustedClose", Member("decimal", nullable=True)),
    ("volumeUnit", TEXT), ("volumeBasis", TEXT), ("marketSegment", TEXT))


class Value:
    """Reads members of a payload's value."""

    def __init__(self, root: Column):
        self.root = root

    def variant(self, path: str) -> Column:
        return F.try_variant_get(self.root, f"$.value.{path}", "variant")

    def kind(self, path: str) -> Column:
        return F.schema_of_variant(self.variant(path))

    def text(self, path: str) -> Column:
        return F.when(self.kind(path) == "STRING", F.try_variant_get(self.root, f"$.value.{path}", "string"))

    def number(self, path: str) -> Column:
        return self.text(path).try_cast("decimal(38,10)")

    def date(self, path: str) -> Column:
        return self.text(path).try_cast("date")

    def instant(self, path: str) -> Column:
        return self.text(path).try_cast("timestamp")

    def long(self, path: str) -> Column:
        return F.try_variant_get(self.root, f"$.value.{path}", "long")

    def held(self, path: str) -> Column:
        """Whether a member is there and not null."""
        return F.coalesce(self.kind(path) != "VOID", F.lit(False))


def _other(path: str, code: str) -> Callable[[Value], Column]:
    """OTHER comes with a code of its own, anything else without."""
    return lambda v: F.when(v.text(path) == "OTHER", v.held(code)).otherwise(~v.held(code))


def _prices(v: Value) -> Column:
    o, h, low, c = (v.number(f"bar.{n}") for n in ("open", "high", "low", "close"))
    adjusted = ~v.held("bar.adjustedClose") | (v.number("bar.adjustedClose") > 0)
    return (o > 0) & (low > 0) & (c > 0) & (h >= o) & (h >= c) & (h >= low) & (low <= o) & (low <= c) & (v.long("bar.volume") >= 0) & adjusted & (v.long("barRevision") > 0)


def _zero_volume(v: Value) -> Column:
    meaning, proof = v.text("zeroVolumeSemantics"), v.text("zeroVolumeProof")
    quiet = ((meaning == "AMBIGUOUS") & (proof == "NONE")) | ((meaning == "EXPLICITLY_GENUINE") & (proof != "NONE"))
    return F.when(v.long("bar.volume") == 0, quiet).otherwise((meaning == "NOT_APPLICABLE") & (proof == "NONE"))


def payload_bar_hash(v: Value) -> Column:
    """Digest of the bar inside a price payload: its date is the record's, numbers lose trailing zeros."""
    plain = lambda path: F.regexp_replace(F.regexp_replace(v.text(path), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    parts = [F.date_format("effective_from", "yyyy-MM-dd"), *[plain(f"bar.{n}") for n in ("open", "high", "low", "close")], v.long("bar.volume").cast("string"), plain("bar.adjustedClose"), *[v.text(f"bar.{n}") for n in ("volumeUnit", "volumeBasis", "marketSegment")]]
    return F.sha2(F.to_json(F.array(*parts)), 256)


def _events(v: Value) -> Column:
    ids = F.try_variant_get(v.root, "$.value.eventEvidenceIds", "array<string>")
    return F.coalesce(F.forall(ids, lambda x: x.rlike(UUID) & (x != NO_UUID)) & (ids == F.array_sort(F.array_distinct(ids))), F.lit(False))


@dataclass(frozen=True)
class Claim:
    """Members of the value, classes that may carry it, whether it may be about an exchange (always, never or either), and rules by name."""

    members: tuple[tuple[str, Member], ...]
    classes: tuple[str, ...]
    exchange: str = "never"
    rules: tuple[tuple[str, Callable[[Value], Column]], ...] = ()
    #: What the value says (members of the fact's identity), for grouping.
    identity: tuple[str, ...] = ()


STATE, POINT, SESSION = ("ContinuingState", "PointObservation"), ("PointObservation",), ("SessionFact",)
KIND = "kind"
CLAIMS: dict[str, Claim] = {
    "StableIdentity": Claim((("sourceCode", TEXT),), STATE),
    "SecurityType": Claim((("classification", word("ORDINARY", "INDEX", "OTHER")),), STATE),
    "Currency": Claim((("currencyCode", TEXT),), STATE, rules=(("CURRENCY_CODE", lambda v: v.text("currencyCode").rlike("^[A-Z]{3}$")),)),
    "ListingCoverage": Claim((("listingDate", DATE),), STATE, rules=(("LISTING_DATE", lambda v: (F.col("evidence_class") != "ContinuingState") | (v.date("listingDate") == F.col("effective_from"))),)),
    "Delisting": Claim((("delistingDate", DATE),), STATE, rules=(("DELISTING_DATE", lambda v: (F.col("evidence_class") != "ContinuingState") | (v.date("delistingDate") == F.col("effective_from"))),)),
    "BoardRegime": Claim(BOARD_MEMBERS, STATE, rules=(("OTHER_CODE", _other("boardCode", "otherCode")),)),
    "BoardChange": Claim(
        (("changeId", TEXT), ("fromBoard", Member("object", members=BOARD_MEMBERS)), ("toBoard", Member("object", members=BOARD_MEMBERS)), ("changeDate", DATE)), ("ContinuingState",),
        rules=(("OTHER_CODE", lambda v: _other("fromBoard.boardCode", "fromBoard.otherCode")(v) & _other("toBoard.boardCode", "toBoard.otherCode")(v)), ("CHANGE_DATE", lambda v: v.date("changeDate") == F.col("effective_from"))), identity=("changeId",)),
    "ExchangeRuleVersion": Claim((("ruleId", TEXT), ("ruleVersion", TEXT), ("mechanism", word(*MECHANISM)), ("otherMechanism", OPTIONAL_TEXT)), ("VersionedRule",), "either", (("OTHER_CODE", _other("mechanism", "otherMechanism")),), ("ruleId",)),
    "MechanismException": Claim((("exceptionId", TEXT), ("exceptionType", TEXT), ("mechanism", word(*MECHANISM)), ("otherMechanism", OPTIONAL_TEXT)), ("ContinuingState",), "either", (("OTHER_CODE", _other("mechanism", "otherMechanism")),), ("exceptionId",)),
    "Suspension": Claim((("status", word("SUSPENDED")), ("noticeId", TEXT)), STATE, "either", identity=("noticeId",)),
    "Reopening": Claim((("reopeningId", TEXT), ("status", word("TRADING")), ("reopeningDate", DATE), ("suspensionEvidenceId", ID)), ("ContinuingState",), "either", (("REOPENING_DATE", lambda v: v.date("reopeningDate") == F.col("effective_from")),), ("reopeningId",)),
    "ScheduledSession": Claim((("sessionId", TEXT), ("schedule", word("OPEN", "CLOSED"))), SESSION, "always", identity=("sessionId",)),
    "CompletedSession": Claim(
        (("sessionId", TEXT), ("completion", word("COMPLETED", "UNPROVED")), ("completedAt", Member("instant", nullable=True))), SESSION, "always",
        (("COMPLETED_AT", lambda v: (v.text("completion") == "COMPLETED") == v.held("completedAt")), ("COMPLETED_LATER", lambda v: ~v.held("completedAt") | (v.instant("completedAt") <= F.col("known_at")))), ("sessionId",)),
    "TradingStatus": Claim((("status", word("TRADING", "SUSPENDED")), ("sessionId", TEXT)), SESSION, "either", (("SOURCE_TIER", lambda v: (F.col("tier") != SECONDARY_TIER) & (F.col("tier") <= HIGHEST_TIER["TradingStatus"])),), ("sessionId",)),
    "SourcePriceConvention": Claim(
        (("priceSourceId", TEXT), ("endpoint", TEXT), ("field", TEXT), ("version", TEXT), ("priceKind", word("STOCK_RAW", "INDEX_LEVEL", "UNPROVED")), ("continuity", word("RAW_AS_TRADED", "UNPROVED")),
         ("zeroVolumeMeaning", word("GENUINE_NO_EXECUTION", "EXPLICIT_GENUINE_FLAG", "UNPROVED")), ("syntheticIdentification", word("EXPLICIT_MARKER", "DOCUMENTED_NON_SYNTHETIC", "UNPROVED")), ("documentationReference", TEXT)),
        ("SourceConvention",), "either", identity=("priceSourceId", "endpoint", "field")),
    "GenuinePriceObservation": Claim(
        (("sessionId", TEXT), ("bar", Member("object", members=BAR_MEMBERS)), ("barRevision", Member("long")), ("barContentHash", TEXT), ("conventionEvidenceId", ID), ("completedSessionEvidenceId", ID), ("syntheticOrCarryForward", word(*MARKER)),
         ("placeholder", word(*MARKER)), ("substituted", word(*MARKER)), ("zeroVolumeSemantics", word("NOT_APPLICABLE", "EXPLICITLY_GENUINE", "AMBIGUOUS")), ("zeroVolumeProof", word("EXPLICIT_SOURCE_FLAG", "DOCUMENTED_CONVENTION", "NONE"))),
        SESSION, rules=(("PRICES", _prices), ("ZERO_VOLUME", _zero_volume), ("BAR_HASH", lambda v: v.text("barContentHash") == payload_bar_hash(v)), ("ARTIFACT", lambda v: F.col("raw_artifact_id").isNotNull() & F.col("retrieved_at").isNotNull())), identity=("sessionId",)),
    # A corporate action is an event or a statement of coverage; its member ``kind`` tells which.
    "CorporateAction:EVENT": Claim(
        ((KIND, word("EVENT")), ("eventId", TEXT), ("actionType", word("SPLIT", "REVERSE_SPLIT", "RIGHTS_OR_SHARE_EVENT", "BONUS_OR_SHARE_DISTRIBUTION", "CONVERSION", "MERGER_OR_REORGANIZATION")), ("effectiveDate", DATE),
         ("ratio", Member("object", nullable=True, members=(("newUnits", AMOUNT), ("oldUnits", AMOUNT)))), ("termsReference", OPTIONAL_TEXT)), POINT,
        rules=(("RATIO", lambda v: ~v.held("ratio") | ((v.number("ratio.newUnits") > 0) & (v.number("ratio.oldUnits") > 0))), ("EFFECTIVE_DATE", lambda v: (v.date("effectiveDate") == F.col("effective_from")) & (F.col("effective_to") == F.col("effective_from")))), identity=("eventId",)),
    "CorporateAction:COVERAGE": Claim(((KIND, word("COVERAGE")), ("coverageId", TEXT), ("coverage", word("COMPLETE", "PARTIAL")), ("eventEvidenceIds", Member("uuids"))), POINT, rules=(("EVENT_IDS", _events),), identity=("coverageId",)),
}
NAMES = tuple(dict.fromkeys(name.split(":")[0] for name in CLAIMS))


def _sound(v: Value, path: str, member: Member) -> Column:
    """Whether a member is of its kind."""
    kind, text = v.kind(path), v.text(path)
    tests = {
        "text": kind == "STRING", "word": text.isin(*member.words) if member.words else F.lit(False), "date": text.rlike(r"^\d{4}-\d{2}-\d{2}$") & v.date(path).isNotNull(),
        "instant": text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$") & v.instant(path).isNotNull(), "uuid": text.rlike(UUID) & (text != NO_UUID),
        "decimal": text.rlike(DECIMAL) & (F.length(F.regexp_replace(text, r"^-?0*\.?0*|\.", "")) <= 28), "long": kind == "BIGINT", "uuids": kind.startswith("ARRAY"), "object": kind.startswith("OBJECT"),
    }
    sound = F.coalesce(tests[member.kind], F.lit(False))
    return sound | F.coalesce(kind == "VOID", F.lit(False)) if member.nullable else sound


def _keys(path: str) -> Column:
    return F.json_object_keys(F.get_json_object("payload", path))


def _shape(v: Value, claim: Claim) -> list[tuple[str, Column]]:
    """(rule, holds) for closed members and kinds, nested objects included."""
    out = []

    def walk(prefix: str, members: tuple[tuple[str, Member], ...], there: Column):
        names, keys = [n for n, _ in members], _keys("$.value" + (f".{prefix[:-1]}" if prefix else ""))
        out.append(("MEMBER_UNKNOWN", ~there | F.coalesce(F.size(F.array_except(keys, F.array(*[F.lit(n) for n in names]))) == 0, F.lit(False))))
        out.append(("MEMBER_MISSING", ~there | F.coalesce(F.forall(F.array(*[F.lit(n) for n, m in members if not m.nullable] or [F.lit("")]), lambda n: (n == "") | F.array_contains(keys, n)), F.lit(False))))
        for name, member in members:
            path = prefix + name
            out.append((f"MEMBER_INVALID:{path}", ~there | _sound(v, path, member) | (v.kind(path).isNull() if member.nullable else F.lit(False))))
            if member.kind == "object":
                walk(f"{path}.", member.members, there & v.held(path))

    walk("", claim.members, F.lit(True))
    return out


def _first(rules: list[tuple[str, Column]]) -> Column:
    """The first rule that does not hold."""
    return F.get(F.array_compact(F.array(*[F.when(~holds, F.lit(rule)) for rule, holds in rules])), F.lit(0))


def bind_evidence(records: DataFrame) -> DataFrame:
    """Adds ``decode_reason`` (null if the payload binds), ``rule`` (which rule it broke), ``operation``, ``completeness``, ``value`` (canonical text) and ``identifier``.

    Columns: claim, payload, payload_version, policy_supported, evidence_class, scope_kind (INSTRUMENT or EXCHANGE), tier,
    effective_from, effective_to, known_at, retrieved_at, raw_artifact_id, series, revision, supersedes_revision.

    Every string is 1 to 200 characters without spaces at its ends and without control characters, arrays have 256
    items at most and payloads 64 KiB. A cancellation carries no value and names an earlier revision of its series.
    """
    root = F.col("__root")
    # Payloads take far longer to judge than to read, so they are dealt out; a file of a few splits would keep as few cores busy.
    dealt = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = records.repartition(dealt, "payload", "series", "revision", "known_at").withColumn("__root", F.try_parse_json("payload"))
    v = Value(root)
    top = lambda name: F.when(F.schema_of_variant(F.try_variant_get(root, f"$.{name}", "variant")) == "STRING", F.try_variant_get(root, f"$.{name}", "string"))
    value_kind = F.schema_of_variant(F.try_variant_get(root, "$.value", "variant"))
    x = x.withColumns({"operation": top("operation"), "completeness": top("completeness"), "__value": value_kind})
    strings = F.when(F.octet_length("payload") <= MAXIMUM_BYTES, F.expr(r"""regexp_extract_all(payload, '"([^"\\\\]*+(?:\\\\.[^"\\\\]*+)*+)"', 1)"""))
    sound_text = F.forall(strings, lambda s: F.length(s).between(1, MAXIMUM_TEXT) & ~s.rlike(r"^\s|\s$|[\x00-\x1f\x7f]|\\u00[01]|\\[bfnrt]"))
    items = F.coalesce(F.size(F.try_variant_get(root, "$.value.eventEvidenceIds", "array<string>")), F.lit(0))
    claim = F.when(F.col("claim") == "CorporateAction", F.concat(F.lit("CorporateAction:"), F.coalesce(F.try_variant_get(root, f"$.value.{KIND}", "string"), F.lit("")))).otherwise(F.col("claim"))
    x = x.withColumn("__claim", claim)
    cancel = F.col("operation") == "CANCEL"

    whole = lambda test: F.coalesce(test, F.lit(False))
    general = [
        ("PARSE", root.isNotNull()), ("TEXT", whole(sound_text)), ("ENVELOPE", whole(F.array_sort(F.json_object_keys("payload")) == F.array(F.lit("completeness"), F.lit("operation"), F.lit("value")))),
        ("OPERATION", whole(F.col("operation").isin("ASSERT", "CANCEL"))), ("COMPLETENESS", whole(F.col("completeness").isin("FULL", "PARTIAL"))),
        ("CANCEL_VALUE", whole(F.when(cancel, (F.col("__value") == "VOID") & (F.col("completeness") == "FULL")).otherwise(F.col("__value").startswith("OBJECT")))),
        ("KIND", cancel | (F.col("claim") != "CorporateAction") | F.col("__claim").isin("CorporateAction:EVENT", "CorporateAction:COVERAGE")),
    ]
    broken = F.coalesce(*[F.when(F.col("__claim") == name, _first(_shape(v, c) + [(r, whole(test(v))) for r, test in c.rules])) for name, c in CLAIMS.items()])
    by_claim = lambda what: F.element_at(F.create_map(*[F.lit(y) for n in NAMES for y in (n, what(CLAIMS.get(n) or CLAIMS[f"{n}:EVENT"]))]), F.col("claim"))
    classes, exchange = by_claim(lambda c: ",".join(c.classes)), by_claim(lambda c: c.exchange)
    session, point = F.col("evidence_class") == "SessionFact", F.col("evidence_class") == "PointObservation"
    binding = [
        ("CLASS", whole(F.array_contains(F.split(classes, ","), F.col("evidence_class")))), ("TIER", whole(F.col("tier").between(0, SECONDARY_TIER))),
        ("SCOPE", whole(F.when(F.col("scope_kind") == "EXCHANGE", exchange != "never").otherwise((F.col("scope_kind") == "INSTRUMENT") & (exchange != "always")))),
        ("POINT_END", whole(~point | F.col("effective_to").isNotNull())), ("SESSION_DATE", whole(~session | F.coalesce(F.col("effective_to") == F.col("effective_from"), F.lit(False)))),
        ("CANCEL_TARGET", whole(~cancel | (F.col("series").isNotNull() & F.coalesce(F.col("supersedes_revision") < F.col("revision"), F.lit(False))))),
    ]
    rule = F.coalesce(_first(general), F.when(~F.coalesce(cancel, F.lit(False)), broken), _first(binding))
    x = x.withColumn("rule", rule)
    reason = (
        F.when(~F.col("policy_supported"), F.lit(UNSUPPORTED)).when(F.col("payload_version").isNull(), F.lit(UNBOUND)).when(F.col("payload_version") != PAYLOAD_VERSION, F.lit(UNSUPPORTED)).when(F.col("claim") == "PriceComparability", F.lit(DERIVED))
        .when(~F.coalesce(F.col("claim").isin(*NAMES), F.lit(False)), F.lit(UNSUPPORTED)).when((F.octet_length("payload") > MAXIMUM_BYTES) | (items > MAXIMUM_ITEMS), F.lit(BOUND_EXCEEDED)).when(F.col("rule").isNotNull(), F.lit(MALFORMED)))
    parts = lambda c: F.array(*[v.text(p) for p in c.identity]) if c.identity else F.array().cast("array<string>")
    identity = F.coalesce(*[F.when(F.col("__claim") == name, parts(c)) for name, c in CLAIMS.items()])
    x = x.withColumn("decode_reason", reason)
    ok = F.col("decode_reason").isNull()
    return x.withColumns({
        "rule": F.when(F.col("decode_reason") == MALFORMED, F.col("rule")), "operation": F.when(ok, F.col("operation")), "completeness": F.when(ok, F.col("completeness")),
        "value": F.when(ok & (F.col("__value") != "VOID"), F.to_json(F.try_variant_get(root, "$.value", "variant"))), "identifier": F.when(ok & (F.col("__value") != "VOID"), F.to_json(F.concat(F.array("claim"), identity))),
    }).drop("__root", "__value", "__claim")


# Claim and member that names another record, and the claim that record must assert.
PREMISES = (
    ("GenuinePriceObservation", "conventionEvidenceId", "SourcePriceConvention"), ("GenuinePriceObservation", "completedSessionEvidenceId", "CompletedSession"),
    ("Reopening", "suspensionEvidenceId", "Suspension"), ("CorporateAction", "eventEvidenceIds", "CorporateAction"),
)


def premise_edges(bound: DataFrame) -> DataFrame:
    """(evidence_id, premise_id, role, expected_claim): what each bound record rests on, as its payload says.

    ``bound`` comes from ``bind_evidence`` and has evidence_id. A cancellation rests on the revision of its series that it
    names; that it is missing shows as a null premise. Records that do not bind have no premises.
    """
    # Kept, so that a record is bound once; else the tests below and both branches would each judge its payload again.
    bound = shared(bound.select("evidence_id", "claim", "series", "revision", "supersedes_revision", "decode_reason", "operation", "value"))
    value = F.try_parse_json("value")

    def premises(claim: str, member: str, expected: str) -> Column:
        path = f"$.{member}"
        ids = F.try_variant_get(value, path, "array<string>") if member.endswith("Ids") else F.array(F.try_variant_get(value, path, "string"))
        return F.when(F.col("claim") == claim, F.transform(ids, lambda x: F.struct(x.alias("premise_id"), F.lit(member).alias("role"), F.lit(expected).alias("expected_claim"))))

    named = [premises(*p) for p in PREMISES]
    kind = "array<struct<premise_id string, role string, expected_claim string>>"
    none = F.array().cast(kind)
    able = bound.where(F.col("decode_reason").isNull())
    stated = able.where("operation = 'ASSERT'").select("evidence_id", F.explode(F.filter(F.concat(*[F.coalesce(x.cast(kind), none) for x in named]), lambda e: e["premise_id"].isNotNull())).alias("e")).select("evidence_id", "e.*")
    targets = bound.select("series", F.col("revision").alias("supersedes_revision"), F.col("evidence_id").alias("premise_id"))
    cancels = able.where("operation = 'CANCEL'").join(targets, ["series", "supersedes_revision"], "left")
    return stated.unionByName(cancels.select("evidence_id", "premise_id", F.lit("cancelledRevision").alias("role"), F.col("claim").alias("expected_claim")))
