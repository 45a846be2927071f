"""Fundamental evidence: amounts, applicability, periods, revisions, envelope validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import first_reason, is_sha256, series_id
from tidemark.operators.pit import instant
from tidemark.operators.scan import prefix_scan

# Fixed values.
DURATION_ONLY = ("Revenue", "OperatingProfit", "NetIncome", "EarningsPerShare", "OperatingCashFlow", "CapitalExpenditure", "FreeCashFlow", "CashDividend", "DividendPerShare")
INSTANT_ONLY = ("TotalAssets", "TotalLiabilities", "TotalEquity", "CashAndCashEquivalents", "ShortTermDebt", "LongTermDebt", "TotalDebt")
REQUIRED_UNIT = {"EarningsPerShare": "PER_SHARE", "DividendPerShare": "PER_SHARE", "SharesOutstanding": "SHARES"}
ENVELOPE = (
    "evidenceId", "policyId", "schemaVersion", "payloadSchemaVersion", "claim", "scopeKind", "subject", "sourceId", "sourceReference", "assertionKey", "revisionSeriesId", "revisionNumber",
    "supersedesRevisionNumber", "lineageEvidence", "authorityTier", "publishedAt", "publicationDate", "publicationEvidence", "receipt", "knownAt", "recordedAt", "admission", "payload", "payloadSha256",
)
# Members whose values are judged; of the others only the names are.
JUDGED = (
    "policyId", "schemaVersion", "claim", "scopeKind", "sourceId", "assertionKey", "revisionSeriesId", "revisionNumber", "supersedesRevisionNumber", "authorityTier",
    "publishedAt", "publicationDate", "publicationEvidence", "receipt", "knownAt", "recordedAt", "payloadSha256",
)
CLAIMS = ("FinancialFiling", "FundamentalFact", "FundamentalConvention")
INCOMPARABLE, MALFORMED, NUMERIC, UNSUPPORTED = "FUNDAMENTAL_INCOMPARABLE", "FUNDAMENTAL_MALFORMED", "FUNDAMENTAL_NUMERIC_UNREPRESENTABLE", "FUNDAMENTAL_BINDING_UNSUPPORTED"
LARGEST = "79228162514264337593543950335"


def normalize_amount(df: DataFrame, amount: str = "amount", power: str = "scale_power", sign: str = "sign") -> DataFrame:
    """amount x 10^power with sign, on the digits themselves: a shift of the point is exact at any size.

    Adds ``normalized`` (plain text) and ``diagnostic``: outside the 28-digit shift, or not exactly
    representable in 28 fraction digits and a 96-bit significand.
    """
    text = F.col(amount).cast("string")
    minus = text.startswith("-")
    body = F.regexp_replace(text, r"^[+-]", "")
    whole = F.regexp_extract(body, r"^([0-9]*)", 1)
    fraction = F.regexp_extract(body, r"\.([0-9]*)$", 1)
    shift = F.col(power).cast("int")
    x = df.withColumns({"__whole": whole, "__fraction": fraction})
    padding = F.repeat(F.lit("0"), 60)
    # The point sits after 60 padding zeros and the whole part; shifting moves it inside the padding.
    x = x.withColumns({
        "__digits": F.concat(padding, F.col("__whole"), F.col("__fraction"), padding), "__point": F.lit(60) + F.length("__whole") + shift})
    digits, point = F.col("__digits"), F.col("__point")
    x = x.withColumns({"__left": F.ltrim(digits.substr(F.lit(1), point), F.lit("0")), "__right": F.rtrim(digits.substr(point + 1, F.length(digits)), F.lit("0"))})
    left, right = F.col("__left"), F.col("__right")
    x = x.withColumn("__coefficient", F.ltrim(F.concat(left, right), F.lit("0")))
    coefficient = F.col("__coefficient")
    bad_shift = (shift < -28) | (shift > 28)
    fits = (F.length(right) <= 28) & ((F.length(coefficient) < 29) | ((F.length(coefficient) == 29) & (coefficient <= LARGEST)))
    negative = minus != (F.col(sign) == "NEGATE")
    literal = F.concat(F.when(left == "", F.lit("0")).otherwise(left), F.when(right == "", F.lit("")).otherwise(F.concat(F.lit("."), right)))
    value = F.when(negative & (coefficient != ""), F.concat(F.lit("-"), literal)).otherwise(literal)
    reason = F.when(bad_shift, F.lit(MALFORMED)).when(~fits, F.lit(NUMERIC))
    return x.select(*df.columns, reason.alias("diagnostic"), F.when(reason.isNull(), value).alias("normalized"))


def metric_applicability(df: DataFrame) -> DataFrame:
    """Metric against unit, period and fact kind; null when admissible."""
    metric, unit, period, kind = (F.col(c) for c in ("metric", "unit_kind", "period_kind", "fact_kind"))
    required = F.element_at(F.create_map(*[F.lit(x) for p in REQUIRED_UNIT.items() for x in p]), metric)
    wrong_unit = F.when(required.isNotNull(), unit != required).otherwise(~unit.isin("MONETARY", "SHARES"))
    wrong_period = (metric.isin(*DURATION_ONLY) & ~period.isin("QUARTER", "YTD", "ANNUAL")) | (metric.isin(*INSTANT_ONLY) & (period != "INSTANT"))
    wrong_kind = ((metric == "FreeCashFlow") & (kind != "DERIVED")) | ((metric == "DividendPerShare") & (kind != "REPORTED")) | (metric == "DilutionObservation")
    return df.withColumn("diagnostic", first_reason((wrong_unit | wrong_period, INCOMPARABLE), (wrong_kind, UNSUPPORTED)))


def fiscal_span(df: DataFrame) -> DataFrame:
    k, start, end, fs, fe = (F.col(c) for c in ("period_kind", "start_date", "end_date", "fiscal_start", "fiscal_end"))
    annual = (k == "ANNUAL") & (fs.isNull() | fe.isNull() | (start != fs) | (end != fe))
    ytd = (k == "YTD") & fs.isNotNull() & (start != fs)
    quarter = F.col("fiscal_quarter").isNotNull() & ~k.isin("QUARTER", "YTD")
    bad = F.coalesce(annual, F.lit(False)) | F.coalesce(ytd, F.lit(False)) | F.coalesce(quarter, F.lit(False)) | F.coalesce(fs > fe, F.lit(False))
    return df.withColumn("diagnostic", F.when(bad, F.lit(INCOMPARABLE)))


def fundamental_scope(df: DataFrame, column: str = "scope_json") -> DataFrame:
    """Typed period, unit and accounting basis; what is absent stays UNKNOWN."""
    schema = "period struct<type string, kind string, startDate string, endDate string>, unit struct<kind string, currencyCode string>, accounting struct<consolidation string, attribution string, auditStatus string, statementFamily string, dimensions map<string,string>>"
    s = F.from_json(column, schema)
    known = lambda c: F.coalesce(c, F.lit("UNKNOWN"))
    a = s["accounting"]
    return df.withColumns({
        "period_type": known(s["period"]["type"]), "period_kind": known(s["period"]["kind"]),
        "start_date": F.try_to_date(s["period"]["startDate"], "yyyy-MM-dd"), "end_date": F.try_to_date(s["period"]["endDate"], "yyyy-MM-dd"),
        "unit_kind": known(s["unit"]["kind"]), "currency": known(s["unit"]["currencyCode"]), "consolidation": known(a["consolidation"]), "attribution": known(a["attribution"]),
        "audit_status": known(a["auditStatus"]), "statement_family": known(a["statementFamily"]), "dimensions": F.to_json(F.map_from_entries(F.array_sort(F.map_entries(a["dimensions"])))),
    })


def _visible(cutoff) -> Column:
    at = instant(cutoff)
    return (F.col("known_at") <= at) & (F.col("retrieved_at").isNull() | (F.col("retrieved_at") <= at)) & (F.col("published_at").isNull() | (F.col("published_at") <= at))


def validate_series(entries: DataFrame) -> DataFrame:
    """Malformed series: ordinals not consecutive from one, a wrong predecessor, a cancellation first or without premise.

    Counts and extremes of a series decide all of it, so no series is sorted in one task."""
    n, prior = F.col("revision_number"), F.col("supersedes_revision_number")
    expected = F.when(n > 1, n - 1)
    bad_cancel = (F.col("operation") == "CANCEL") & ((n == 1) | F.col("premise_id").isNull())
    x = entries.groupBy("series").agg(
        F.count("*").alias("entries"), F.countDistinct("revision_number").alias("__d"), F.min(n).alias("__a"), F.max(n).alias("__b"),
        F.count_if(~prior.eqNullSafe(expected)).alias("__links"), F.count_if(bad_cancel).alias("__cancels"))
    broken = (F.col("entries") != F.col("__d")) | (F.col("__a") != 1) | (F.col("__b") != F.col("entries")) | (F.col("__links") > 0) | (F.col("__cancels") > 0)
    return x.select("series", "entries", F.when(broken, F.lit(MALFORMED)).alias("diagnostic"))


def governing_revision(entries: DataFrame, cutoff) -> DataFrame:
    """Revision of each series that governs at the cutoff: a visible cancellation hides it, an equal
    authority known at the same instant conflicts; reinstated_revision is the last visible assertion."""
    seen = entries.where(_visible(cutoff))
    head = seen.groupBy("series").agg(
        F.max_by(F.struct("revision_number", "operation", "authority_tier", "known_at"), "revision_number").alias("h"),
        F.max(F.when(F.col("operation") == "ASSERT", F.col("revision_number"))).alias("reinstated_revision"))
    same = seen.where("operation = 'ASSERT'").groupBy(F.col("series").alias("__s"), F.col("authority_tier").alias("__t"), F.col("known_at").alias("__k")).agg(F.count("*").alias("__n"))
    x = head.join(same, (F.col("series") == F.col("__s")) & (F.col("h.authority_tier") == F.col("__t")) & (F.col("h.known_at") == F.col("__k")), "left")
    cancelled, conflict = F.col("h.operation") == "CANCEL", F.col("__n") > 1
    return x.select("series", F.when(~cancelled & ~F.coalesce(conflict, F.lit(False)), F.col("h.revision_number")).alias("governing_revision"),
                    F.when(~cancelled & conflict, F.lit("FUNDAMENTAL_CONFLICT")).alias("diagnostic"), "reinstated_revision")


def period_coverage(periods: DataFrame) -> DataFrame:
    """Quarters of each subject that duplicate, overlap or leave a gap to the one before."""
    q = periods.where("period_kind = 'QUARTER'")
    placed = prefix_scan(q, ["subject_id"], ("start_date", "end_date", "period_id"), F.trunc("start_date", "year"), {"__prior": ("last", F.struct("start_date", "end_date"))})
    bad = F.col("__prior").isNotNull() & (F.col("start_date") != F.date_add("__prior.end_date", 1))
    return placed.select("subject_id", "period_id", "start_date", F.when(bad, F.lit(INCOMPARABLE)).alias("diagnostic"))


IDENTITY = ("subject_id", "metric", "definition_id", "period_type", "start_date", "end_date", "period_kind", "unit_kind", "currency", "fact_kind")
BASIS = ("consolidation", "attribution", "audit_status", "statement_family")


def comparable_facts(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("subject_id", "metric")) -> DataFrame:
    """Whether facts paired by ``pair_id`` describe one assertion; unknown basis never compares."""
    a = left.select("pair_id", *[F.col(c).alias(f"l_{c}") for c in (*IDENTITY, *BASIS)])
    b = right.select("pair_id", *[F.col(c).alias(f"r_{c}") for c in (*IDENTITY, *BASIS)])
    x = a.join(b, "pair_id")
    same = F.lit(True)
    for c in (*IDENTITY, *BASIS):
        same = same & F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}"))
    unknown = F.lit(False)
    for c in ("audit_status", "statement_family"):
        unknown = unknown | F.col(f"l_{c}").isin("UNKNOWN", "") | F.col(f"r_{c}").isin("UNKNOWN", "") | F.col(f"l_{c}").isNull() | F.col(f"r_{c}").isNull()
    return x.select("pair_id", F.when(~same | unknown, F.lit(INCOMPARABLE)).alias("diagnostic"))


def validate_fundamentals(df: DataFrame, column: str = "body", policy: str = "fundamental-v0.1.0") -> DataFrame:
    """Adds ``diagnostics``: CODE@/pointer for shape, vocabulary, chronology, lineage and receipt rules."""
    text = F.col(column)
    schema = ", ".join(f"{f} string" for f in JUDGED)
    staged = df.withColumns({"__e": F.from_json(text, schema), "__names": F.json_object_keys(text), "__sound": F.try_parse_json(text).isNotNull()})
    e, names = F.col("__e"), F.col("__names")
    at = lambda c: F.try_to_timestamp(e[c])
    number = lambda c: e[c].try_cast("long")
    code = lambda test, c, pointer: F.when(test, F.lit(f"{c}@{pointer}"))
    published = e["publishedAt"].isNotNull() | e["publicationDate"].isNotNull()
    scope = F.when(e["claim"] == "FundamentalConvention", F.lit("SOURCE")).otherwise(F.lit("REPORTING_ENTITY"))
    series = series_id(e["sourceId"], F.concat_ws("/", F.lit(policy), e["claim"], e["assertionKey"]))
    envelope = F.array(*[F.lit(f) for f in ENVELOPE])
    absent = F.transform(F.array_except(envelope, names), lambda f: F.concat(F.lit(f"{MALFORMED}@/"), f))
    checks = [
        code(F.size(F.array_except(names, envelope)) > 0, MALFORMED, "/"),
        code(~e["claim"].isin(*CLAIMS), MALFORMED, "/claim"), code(e["policyId"] != policy, UNSUPPORTED, "/policyId"), code(number("schemaVersion") != 1, UNSUPPORTED, "/schemaVersion"),
        code(~e["authorityTier"].isin("T1", "T2", "T3", "T4"), MALFORMED, "/authorityTier"), code(e["scopeKind"] != scope, MALFORMED, "/scopeKind"),
        code(at("knownAt").isNull(), MALFORMED, "/knownAt"), code(at("recordedAt") < at("knownAt"), "FUNDAMENTAL_CHRONOLOGY", "/recordedAt"),
        code(e["publishedAt"].isNotNull() & e["publicationDate"].isNotNull(), MALFORMED, "/publicationDate"), code(published & e["publicationEvidence"].isNull(), MALFORMED, "/publicationEvidence"),
        code(number("revisionNumber") < 1, MALFORMED, "/revisionNumber"), code(number("supersedesRevisionNumber") >= number("revisionNumber"), MALFORMED, "/supersedesRevisionNumber"),
        code(e["revisionSeriesId"] != series, MALFORMED, "/revisionSeriesId"), code(~is_sha256(e["payloadSha256"]), MALFORMED, "/payloadSha256"),
        code((e["claim"] != "FundamentalFact") & e["receipt"].isNull(), MALFORMED, "/receipt"),
    ]
    broken = ~F.col("__sound") | names.isNull()
    return staged.withColumn("diagnostics", F.when(broken, F.array(F.lit(f"{MALFORMED}@/"))).otherwise(F.sort_array(F.array_distinct(F.concat(absent, F.array_compact(F.array(*checks))))))).drop("__e", "__names", "__sound")
