"""Readers and writers of the file-shaped inputs. Every reader returns lazy DataFrames with verdict columns."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.hashing import set_digest
from tidemark.functions.scalar import first_reason, independent_reference, uuid_from_text
from tidemark.operators.calendar import weekend
from tidemark.operators.pit import resolve_instruments
from tidemark.session import shared_folder

# Fixed values.
PRICES = ("open", "high", "low", "close", "adjusted_close")
MASTER_COLUMNS = (
    "Date", "Code", "Description", "Type", "Isin Code", "Issuer", "Status", "Stock Exchange", "Listing Date", "Currency", "Form", "Eff. Date Isin", "Maturity Date", "Expire Date", "Exercise Price",
    "Interest", "Interest Type", "Interest Freq", "Nominal Value", "Num. of Sec", "Originated Amt", "Current Amt", "Total Scripless", "Local (%)", "Foreign (%)", "Total (%)", "Sector", "Closing Price",
)
TRANSACTION_COLUMNS = ("trade_date", "type", "instrument_id", "symbol", "quantity", "unit", "price", "fees", "cash_amount", "external_reference", "note")
DAY_STATUSES = ("ObservedTrading", "AnnouncedClosed", "ExceptionalClosure")


def workspace(spark: SparkSession) -> str:
    """A new folder for intermediate files under the shared checkpoint folder."""
    return f"{shared_folder(spark).rstrip('/')}/files-{uuid.uuid4().hex}"


def write_documents(documents: DataFrame, root: str) -> DataFrame:
    """Writes each (name, body) as a file of that name under ``root``, and returns the names once the rows are read.

    A task that runs again writes the same bytes under the same name.
    """

    def write(batches):
        from pyarrow import RecordBatch, fs

        files, top = fs.FileSystem.from_uri(root) if ":/" in root else (fs.LocalFileSystem(), root)
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                files.create_dir(f"{top}/{name}".rpartition("/")[0], recursive=True)
                with files.open_output_stream(f"{top}/{name}", compression=None) as out:
                    out.write(body.encode())
            yield RecordBatch.from_arrays([batch.column(0)], names=["name"])

    return documents.select("name", "body").mapInArrow(write, "name string")


PROVIDER_ROW = "struct<date string, " + ", ".join(f"{p} variant" for p in PRICES) + ", volume variant>"


def variant_number(c: Column) -> Column:
    return F.try_variant_get(c, "$", "decimal(38,10)")


def provider_row_reason(date_text: Column, member, twice: Column) -> Column:
    """Why one provider row is rejected, else null. ``member(name)`` is the row's variant of that name, ``twice`` whether its date repeats."""
    number = lambda c: F.coalesce(F.schema_of_variant(c).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.lit(False))
    day, volume = F.try_to_date(date_text, "yyyy-MM-dd"), member("volume")
    missing = date_text.isNull() | volume.isNull()
    wrong, low_price = F.lit(False), F.lit(False)
    for p in PRICES:
        missing = missing | member(p).isNull()
        wrong = wrong | ~number(member(p))
        low_price = low_price | F.coalesce(variant_number(member(p)) <= 0, F.lit(True))
    o, h, low, c = (variant_number(member(p)) for p in PRICES[:4])
    whole = F.coalesce(F.schema_of_variant(volume) == "BIGINT", F.lit(False)) & F.coalesce(F.try_variant_get(volume, "$", "bigint") >= 0, F.lit(False))
    return first_reason(
        (missing, "MISSING_FIELD"), (day.isNull() | (F.length(date_text) != 10), "BAD_DATE"), (twice, "DUPLICATE_DATE"), (wrong, "PRICE_NOT_NUMBER"), (low_price, "PRICE_NOT_POSITIVE"),
        (~((low <= F.least(o, c)) & (F.greatest(o, c) <= h)), "BROKEN_BOUNDS"), (~whole, "BAD_VOLUME"), (~day.between(F.col("from_date"), F.col("to_date")), "OUTSIDE_WINDOW"))


def parse_provider_payloads(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bars and rejects from JSON row arrays. ``responses``: response_id, payload, from_date, to_date.

    A row is rejected for a missing member, a bad or repeated date, a price that is not a positive
    number, broken bounds, a bad volume, or a date outside the requested window.
    """
    rows = responses.select("response_id", "from_date", "to_date", F.explode(F.from_json("payload", f"array<{PROVIDER_ROW}>")).alias("r"))
    x = rows.select("response_id", "from_date", "to_date", F.col("r.date").alias("date_text"), *[F.col(f"r.{c}").alias(c) for c in (*PRICES, "volume")])
    twice = F.count("*").over(Window.partitionBy("response_id", "date_text")) > 1
    x = x.withColumn("__twice", twice)
    x = x.withColumn("reason", provider_row_reason(F.col("date_text"), F.col, F.col("__twice"))).drop("__twice")
    bars = x.where("reason is null").select("response_id", F.try_to_date("date_text", "yyyy-MM-dd").alias("session_date"), *[variant_number(F.col(p)).alias(p) for p in PRICES], F.try_variant_get("volume", "$", "bigint").alias("volume"))
    return bars, x.where("reason is not null").select("response_id", "date_text", "reason")


def read_provider_bars(spark: SparkSession, path: str, from_date, to_date) -> tuple[DataFrame, DataFrame]:
    whole = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("response_id"), F.col("value").alias("payload"), F.lit(from_date).cast("date").alias("from_date"), F.lit(to_date).cast("date").alias("to_date"))
    return parse_provider_payloads(whole)


ROW = "struct<symbol string, instrument_id string, open string, high string, low string, close string, adjusted_close string, volume long, content_sha256 string, artifact_sha256 string, fetched_at string, quality_status string>"
CAPTURE = f"schema_version int, session_date string, captured_at string, session_proof string, source_id string, rows array<{ROW}>"


def read_personal_store(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the highest revision per session, and the files whose place or name is corrupt."""
    raw = spark.read.schema(CAPTURE).option("multiLine", "true").option("recursiveFileLookup", "true").json(root).select("*", F.col("_metadata.file_path").alias("path"))
    parts = r"/([0-9]{4})/([0-9]{4}-[0-9]{2}-[0-9]{2})(?:\.r([0-9]+))?\.json$"
    x = raw.withColumns({"year": F.regexp_extract("path", parts, 1), "day": F.regexp_extract("path", parts, 2), "rev": F.regexp_extract("path", parts, 3)})
    revision = F.when(F.col("rev") == "", 1).otherwise(F.col("rev").try_cast("int"))
    problem = first_reason((F.col("day") == "", "BAD_NAME"), (~F.col("day").startswith(F.col("year")), "YEAR_MISMATCH"), ((F.col("rev") != "") & (revision < 2), "BAD_REVISION"), (F.col("session_date") != F.col("day"), "DATE_MISMATCH"))
    x = x.withColumn("revision", revision).withColumn("problem", problem)
    good = x.where("problem is null")
    top = good.groupBy("day").agg(F.max("revision").alias("revision"))
    rows = good.join(top, ["day", "revision"]).select(F.to_date("day").alias("session_date"), "revision", F.col("captured_at").cast("timestamp").alias("captured_at"), "session_proof", "source_id", F.explode("rows").alias("r")).select("session_date", "revision", "captured_at", "session_proof", "source_id", "r.*")
    return rows, x.where("problem is not null").select("path", "problem")


def select_sessions(df: DataFrame, from_date=None, to_date=None, newest: int = 7) -> DataFrame:
    """An inclusive range of at most 366 days, or the newest sessions. A longer range is refused."""
    if from_date is not None:
        first, last = (d if isinstance(d, date) else date.fromisoformat(d) for d in (from_date, to_date))
        if (last - first).days > 365:
            raise ValueError(f"{first} to {last} is longer than 366 days")
        return df.where(F.col("session_date").between(F.lit(first), F.lit(last)))
    days = df.select("session_date").distinct().orderBy(F.desc("session_date")).limit(newest)
    return df.join(days, "session_date", "left_semi")


def build_capture_documents(rows: DataFrame, batches: DataFrame, holidays: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Row sets per complete session, with holiday rows dropped and counted.

    ``rows``: session_date, symbol, source_id, content_sha256; ``batches``: session_date, status. A session
    is described by its rows (one table row each), a count and a digest, so no document is gathered in one task.
    """
    days = holidays.select(F.col("holiday_date").alias("session_date"))
    dropped = rows.join(days, "session_date", "left_semi").groupBy("session_date").agg(F.count("*").alias("dropped"))
    kept = rows.join(days, "session_date", "left_anti").join(batches.where("status = 'SUCCEEDED'"), "session_date", "left_semi")
    docs = kept.groupBy("session_date").agg(F.count("*").alias("rows"), F.min("source_id").alias("source_id"), (F.min("source_id") != F.max("source_id")).alias("mixed_provenance"), set_digest(F.col("content_sha256")).alias("rows_digest"))
    return docs, dropped


def write_capture(docs: DataFrame, stored: DataFrame) -> DataFrame:
    """Revision each document takes: UNCHANGED when the last stored digest is the same, else the next one."""
    last = stored.groupBy("session_date").agg(F.max_by("rows_digest", "revision").alias("__digest"), F.max("revision").alias("__rev"))
    x = docs.join(last, "session_date", "left")
    same = F.col("__digest") == F.col("rows_digest")
    return x.select(*docs.columns, F.when(same, F.lit("UNCHANGED")).when(F.col("__rev").isNull(), F.lit("CREATED")).otherwise(F.lit("REVISED")).alias("action"),
                    F.when(same, F.col("__rev")).otherwise(F.coalesce("__rev", F.lit(0)) + 1).alias("revision"))


def read_security_master(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Equities with a verdict, counts of other types, and malformed lines of a pipe-delimited master."""
    lines = spark.read.text(path)
    fields = F.split("value", r"\|", -1)
    body = lines.where(F.col("value") != "|".join(MASTER_COLUMNS)).withColumn("f", fields)
    good = body.where(F.size("f") == len(MASTER_COLUMNS))
    cell = lambda name: F.trim(F.col("f")[MASTER_COLUMNS.index(name)])
    # Month names come in capitals; the formatter wants Jan, Feb, ...
    day = lambda name: F.try_to_date(F.initcap(F.regexp_replace(cell(name), "-", " ")), "dd MMM yyyy")
    x = good.select(cell("Type").alias("type"), F.upper(cell("Code")).alias("code"), F.upper(cell("Isin Code")).alias("isin"), cell("Issuer").alias("issuer"), day("Date").alias("snapshot_date"), day("Listing Date").alias("listing_date"))
    e = x.where("type = 'EQUITY'")
    codes, isins = e.groupBy("code").agg(F.count("*").alias("__c")), e.groupBy("isin").agg(F.count("*").alias("__i"))
    e = e.join(codes, "code").join(isins, "isin").withColumn("verdict", first_reason(((F.col("code") == "") | (F.col("isin") == "") | (F.col("issuer") == ""), "MISSING_IDENTITY"), ((F.col("__c") > 1) | (F.col("__i") > 1), "DUPLICATE"), (F.col("listing_date").isNull(), "LISTING_DATE_MISSING"), otherwise="OK")).drop("__c", "__i")
    other = x.where("type <> 'EQUITY'").groupBy(F.when(F.col("type") == "", F.lit("<MISSING>")).otherwise(F.col("type")).alias("type")).agg(F.count("*").alias("n"))
    return e, other, body.where(F.size("f") != len(MASTER_COLUMNS)).select("value")


REFERENCE = "schemaVersion int, universes array<struct<snapshotId string, knownAt string, universeId string, memberIds array<string>, benchmarkId string, contentHash string>>, instruments array<struct<snapshotId string, instrumentId string, knownAt string, contentHash string, identities array<struct<`from` string, through string, symbol string, classification string, currency string, board string>>>>"


def read_reference_documents(documents: DataFrame, column: str = "body") -> tuple[DataFrame, DataFrame]:
    """Universe members and identity intervals of reference documents, with a verdict per snapshot."""
    d = documents.select(F.from_json(column, REFERENCE).alias("d")).where("d.schemaVersion = 1")
    u = d.select(F.explode("d.universes").alias("u"))
    bad = (F.size(F.array_distinct("u.memberIds")) != F.size("u.memberIds")) | F.array_contains("u.memberIds", F.col("u.benchmarkId")) | ~F.coalesce(F.col("u.contentHash").rlike("^[0-9a-f]{64}$"), F.lit(False))
    universes = u.select(F.col("u.snapshotId").alias("snapshot_id"), F.try_to_timestamp("u.knownAt").alias("known_at"), F.explode("u.memberIds").alias("instrument_id"), F.when(bad, F.lit("REFERENCE_MALFORMED")).alias("verdict"))
    i = d.select(F.explode("d.instruments").alias("i")).select("i.*", F.explode("i.identities").alias("f"))
    day = lambda c: F.try_to_date(c, "yyyy-MM-dd")
    wrong = day("f.from").isNull() | F.coalesce(day("f.through") < day("f.from"), F.lit(False)) | ~F.col("f.classification").isin("ORDINARY", "INDEX", "UNSUPPORTED", "UNKNOWN")
    identities = i.select(F.col("snapshotId").alias("snapshot_id"), F.col("instrumentId").alias("instrument_id"), day("f.from").alias("valid_from"), day("f.through").alias("valid_to"), "f.symbol", "f.classification", F.when(wrong, F.lit("REFERENCE_MALFORMED")).alias("verdict"))
    return universes, identities


def check_session_proofs(proofs: DataFrame) -> DataFrame:
    return proofs.withColumn("verdict", first_reason((~independent_reference("reference"), "REFERENCE_NOT_INDEPENDENT"), (~F.col("status").isin(*DAY_STATUSES), "STATUS_UNKNOWN"), (F.coalesce(F.col("completed_at") > F.col("known_at"), F.lit(False)), "COMPLETION_AFTER_KNOWLEDGE"), otherwise="OK"))


def read_session_proofs(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema("date string, status string, reference string, known_at timestamp, completed_at timestamp").json(path)
    return check_session_proofs(raw.withColumn("session_date", F.try_to_date("date", "yyyy-MM-dd")))


def append_boundaries(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Disposition of boundary evidence per (instrument, knowledge instant): NEW, IDENTICAL or CONFLICT."""
    fields = [c for c in new.columns if c not in ("instrument_id", "known_at")]
    digest = F.sha2(F.to_json(F.array(*[F.col(c).cast("string") for c in fields])), 256)
    key = ["instrument_id", "known_at"]
    mine = new.withColumn("__d", digest)
    spread = mine.groupBy(*key).agg(F.min("__d").alias("__low"), F.max("__d").alias("__high"))
    kept = existing.withColumn("__e", digest).groupBy(*key).agg(F.min("__e").alias("__e"))
    x = spread.join(kept, key, "left")
    return x.select(*key, F.when(F.col("__low") != F.col("__high"), F.lit("CONFLICT")).when(F.col("__e").isNull(), F.lit("NEW")).when(F.col("__e") == F.col("__low"), F.lit("IDENTICAL")).otherwise(F.lit("CONFLICT")).alias("disposition"))


def check_holidays(df: DataFrame, year: int) -> DataFrame:
    twice = df.groupBy("holiday_date").agg(F.count("*").alias("__n"))
    return df.join(twice, "holiday_date").withColumn("verdict", first_reason((F.year("holiday_date") != year, "OUTSIDE_YEAR"), (weekend("holiday_date"), "WEEKEND"), (F.col("__n") > 1, "DUPLICATE"), (~F.col("reference").startswith("https://"), "UNCITED"), otherwise="OK")).drop("__n")


def read_holidays(spark: SparkSession, path: str, year: int) -> DataFrame:
    raw = spark.read.schema("year int, holidays array<struct<date string, name string, kind string, reference string>>").option("multiLine", "true").json(path).select(F.explode("holidays").alias("h"))
    return check_holidays(raw.select(F.try_to_date("h.date", "yyyy-MM-dd").alias("holiday_date"), F.col("h.name").alias("holiday_name"), "h.kind", "h.reference"), year)


def inventory_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Content-addressed inventory of raw files; equal contents collapse into one artifact."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    x = files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("byte_length"))
    return x.groupBy("sha256").agg(F.min("path").alias("path"), F.max("byte_length").alias("byte_length"), F.count("*").alias("copies"))


def verify_artifacts(inventory: DataFrame, manifest: DataFrame) -> DataFrame:
    m = manifest.select("sha256", F.col("byte_length").alias("__want"))
    x = m.join(inventory, "sha256", "full_outer")
    return x.select("sha256", F.when(F.col("path").isNull(), F.lit("MISSING")).when(F.col("__want").isNull(), F.lit("UNLISTED")).when(F.col("__want") != F.col("byte_length"), F.lit("LENGTH_MISMATCH")).otherwise(F.lit("VERIFIED")).alias("state"))


def import_transactions(rows: DataFrame, instruments: DataFrame, symbols: DataFrame, portfolio: str) -> DataFrame:
    """Typed rows of a transaction CSV (all text) with the instrument resolved on the trade date and an
    error per row. ``instruments``: equity ids; ``symbols``: their history."""
    x = rows.withColumns({"__day": F.try_to_date("trade_date", "yyyy-MM-dd"), "__symbol": F.when(F.col("symbol") == "", None).otherwise(F.col("symbol"))})
    looked = resolve_instruments(x.where("__symbol is not null and __day is not null").select("row_number", F.col("__symbol").alias("symbol"), F.col("__day").alias("trade_date")), symbols).select(
        "row_number", F.col("instrument_id").alias("__found"), "resolution")
    known = instruments.select("instrument_id", F.lit(True).alias("__known"))
    x = x.join(looked, "row_number", "left").join(known, "instrument_id", "left")
    trade, given = F.col("type").isin("BUY", "SELL"), F.coalesce(F.col("instrument_id") != "", F.lit(False))
    plain = lambda c: F.coalesce(F.col(c).rlike(r"^[0-9]+(\.[0-9]+)?$"), F.lit(False))
    error = first_reason(
        (~F.col("type").isin("BUY", "SELL", "CASH_DEPOSIT", "CASH_WITHDRAWAL") | ~F.col("unit").isin("SHARES", "LOTS"), "EVENT_TYPE_OR_UNIT"), (F.col("__day").isNull(), "BAD_DATE"),
        (trade & given & F.col("__known").isNull(), "UNKNOWN_INSTRUMENT"), (trade & ~given & (F.coalesce("resolution", F.lit("UNKNOWN")) != "RESOLVED"), "UNKNOWN_INSTRUMENT"),
        (~trade & (given | F.col("__symbol").isNotNull()), "CASH_ROW_WITH_INSTRUMENT"), (F.trim("external_reference") == "", "REFERENCE_REQUIRED"),
        (~(plain("quantity") & plain("price") & plain("fees") & plain("cash_amount")), "BAD_AMOUNT"))
    event = uuid_from_text(F.concat(F.lit(portfolio), F.lit("\nGENERIC_CSV\n"), F.col("external_reference")))
    return x.select("row_number", event.alias("event_id"), F.when(error.isNull() & trade, F.when(given, F.col("instrument_id")).otherwise(F.col("__found"))).alias("instrument_id"), error.alias("error"))


def csv_guard(value: Column) -> Column:
    """Prefixes text a spreadsheet would run as a formula."""
    risky = F.ltrim(value).rlike(r"^[=+\-@]") | value.rlike(r"^[\t\r\n]")
    return F.when(risky, F.concat(F.lit("'"), value)).otherwise(value)


def export_transactions(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Export rows of portfolios without corrections, and the portfolios refused for having one."""
    refused = events.where("supersedes is not null").select("portfolio_id").distinct()
    out = events.join(refused, "portfolio_id", "left_anti").select(
        "portfolio_id", "event_order", F.date_format("trade_date", "yyyy-MM-dd").alias("trade_date"), "type", F.coalesce("instrument_id", F.lit("")).alias("instrument_id"), F.lit("").alias("symbol"), "quantity", F.lit("SHARES").alias("unit"),
        "price", "fees", "cash_amount", csv_guard(F.coalesce("external_reference", "event_id")).alias("external_reference"), csv_guard(F.coalesce("note", F.lit(""))).alias("note"))
    return out, refused


def write_transactions_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").option("header", "true").option("quoteAll", "true").csv(path)


def consolidate_holdings(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row per symbol from account rows, and the rows refused. ``rows``: line, source_account, symbol, lots, shares, average_cost, mandate (text)."""
    whole = lambda c: F.when(F.col(c) == "", None).otherwise(F.col(c).try_cast("long"))
    x = rows.withColumns({"sym": F.upper(F.trim("symbol")), "l": whole("lots"), "s": whole("shares"), "c": F.when(F.col("average_cost") == "", None).otherwise(F.col("average_cost").try_cast("decimal(28,8)"))})
    shares = F.coalesce(F.col("s"), F.col("l") * 100)
    error = first_reason(
        ((F.col("sym") == "") | (F.length("sym") > 50), "SYMBOL_INVALID"), (shares.isNull() | (shares <= 0) | (shares > 1_000_000_000), "SHARES_INVALID"), (F.coalesce(F.col("s") != F.col("l") * 100, F.lit(False)), "LOTS_SHARES_MISMATCH"),
        ((F.col("average_cost") != "") & F.coalesce(F.col("c") < 0, F.lit(True)), "COST_INVALID"), ((F.col("mandate") != "") & ~F.col("mandate").isin("FAST_SWING", "LONG_SWING", "INVEST"), "MANDATE_UNKNOWN"))
    x = x.withColumn("error", error).withColumn("n", shares)
    ok = x.where("error is null")
    distinct = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c)))), ",")
    sums = ok.groupBy("sym").agg(F.sum("n").alias("shares"), F.bool_and(F.col("c").isNotNull()).alias("__known"), F.sum(F.col("n") * F.col("c")).alias("__w"), F.count("*").alias("rows"), F.countDistinct(F.when(F.col("source_account") != "", F.col("source_account"))).alias("accounts"), distinct("mandate").alias("mandates"))
    return sums.select(F.col("sym").alias("symbol"), "shares", F.when(F.col("__known"), F.col("__w").cast("double") / F.col("shares")).alias("average_cost"), "rows", "accounts", "mandates", (F.col("rows") > 1).alias("duplicate_group")), x.where("error is not null").select("line", "error")


def experiment_records(responses: DataFrame) -> DataFrame:
    """HTTP outcome, row count, validity, classification and prices per response.

    ``responses``: response_id, http_status, failure_class, payload, requested_date. Only a response of one row can be
    valid, so each is judged where it stands: nothing is shuffled, and responses that share an id stay apart.
    """
    message = F.coalesce(*[F.try_variant_get("__body", f"{at}.{name}", "string") for at in ("$[0]", "$") for name in ("warning", "error", "message")])
    x = responses.select(
        "response_id", "http_status", "failure_class", F.col("requested_date").alias("from_date"), F.col("requested_date").alias("to_date"), F.coalesce(F.json_array_length("payload"), F.lit(0)).alias("row_count"),
        F.try_parse_json("payload").alias("__body"), F.get(F.from_json("payload", f"array<{PROVIDER_ROW}>"), F.lit(0)).alias("__r"))
    text, member = F.col("__r.date"), lambda name: F.col(f"__r.{name}")
    base = F.when(F.coalesce(F.col("http_status") != 200, F.lit(True)), F.coalesce("failure_class", F.lit("HTTP_ERROR"))).when(message.isNotNull(), F.lit("PROVIDER_WARNING_OR_ERROR"))
    x = x.withColumn("__base", base)
    # The reason is null for an accepted row only: one without members is MISSING_FIELD.
    x = x.withColumn("payload_valid", F.col("__base").isNull() & (F.col("row_count") == 1) & provider_row_reason(text, member, F.lit(False)).isNull())
    valid = F.col("payload_valid")
    return x.select("response_id", F.coalesce(F.concat(F.lit("HTTP_"), F.col("http_status").cast("string")), "failure_class").alias("http_outcome"), "row_count", "payload_valid",
                    F.coalesce("__base", F.when(~valid, F.lit("MALFORMED_OR_UNEXPECTED_EOD"))).alias("classification"), F.when(valid, variant_number(member("close"))).alias("close"),
                    F.when(valid, F.try_variant_get(member("volume"), "$", "bigint")).alias("volume"))


def operations_summary(requests: DataFrame, runs: DataFrame, required: int) -> DataFrame:
    """Fetch outcomes and units per run, and completed sessions against the required number."""
    per_run = requests.groupBy("run_id").agg(F.count_if(F.col("outcome") == "OK").alias("ok"), F.count_if(F.col("outcome") != "OK").alias("failed"), F.sum("units").alias("units"))
    done = runs.where("status = 'SUCCEEDED'").agg(F.countDistinct("session_date").alias("sessions"))
    return runs.join(per_run, "run_id", "left").crossJoin(F.broadcast(done)).select(  # one row
        "run_id", "status", F.coalesce("ok", F.lit(0)).alias("ok"), F.coalesce("failed", F.lit(0)).alias("failed"), F.coalesce("units", F.lit(0)).alias("units"), "sessions", (F.col("sessions") >= required).alias("soak_complete"))


def quota_preflight(plans: DataFrame) -> DataFrame:
    requests = F.col("equities") + F.col("benchmark").cast("int")
    attempts = requests * (F.lit(1) + F.col("retries"))
    units = attempts * F.col("units_per_attempt")
    extra = F.greatest(F.lit(0), units - F.col("daily_remaining"))
    ok = (units <= F.col("run_ceiling")) & (F.col("extra_balance") - extra >= F.col("reserve"))
    return plans.select("plan_id", requests.alias("requests"), attempts.alias("attempts"), units.alias("maximum_units"), extra.alias("extra"), F.when(ok, F.lit("ELIGIBLE")).otherwise(F.lit("BUDGET_BLOCKED")).alias("status"))


def ingest_summary(dispositions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Accepted rows, additions, corrections, stale and rejected evidence and the run status, per run."""
    d = dispositions.groupBy("run_id").agg(
        F.count("*").alias("accepted"), F.count_if(F.col("disposition") == "INSERTED").alias("additions"), F.count_if(F.col("disposition") == "REVISION_APPENDED").alias("corrections"),
        F.count_if(F.col("disposition") == "STALE_EVIDENCE_IGNORED").alias("stale_ignored"), F.count_if(F.col("disposition") == "DUPLICATE_IGNORED").alias("duplicates"))
    v = verdicts.groupBy("run_id").agg(F.count("*").alias("expected"), F.count_if(F.col("verdict").isin("AVAILABLE", "NO_TRADE", "SUSPENDED")).alias("accounted"), F.count_if(F.col("verdict") != "AVAILABLE").alias("unavailable"))
    x = v.join(d, "run_id", "left").fillna(0, ["accepted", "additions", "corrections", "stale_ignored", "duplicates"])
    return x.withColumn("status", F.when((F.col("accounted") == F.col("expected")) & (F.col("stale_ignored") == 0), F.lit("SUCCEEDED")).otherwise(F.lit("DEGRADED")))
