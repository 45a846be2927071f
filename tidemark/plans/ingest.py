"""Sources, sinks, and ingest accounting. File inputs are derived from the driver tables, written, and read back."""

from pyspark.sql import functions as F

from tidemark.operators import ledger as lg
from tidemark.operators import pit
from tidemark.plans import calendar_days, health, portfolio  # noqa: F401
from tidemark.plans.adapters import TEXT, table
from tidemark.plans.market import APPEND_FOLD
from tidemark.plans.registry import query
from tidemark.sources import files as fs

TEXT["provider_rows"] = """
SELECT p_brand AS response_id, session_date, CASE WHEN max(disc) = 0 THEN 'zero' WHEN max(disc) = 1 AND max(tax) < 4 THEN 'text' WHEN count(*) = 2 AND max(tax) = 8 THEN 'bounds' WHEN max(disc) = 2 THEN 'volume' WHEN max(disc) = 3 THEN 'gap' WHEN max(disc) = 4 THEN 'date' ELSE 'ok' END AS kind,
 min_by(px, seq) AS open, max(px) + 1 AS high, min(px) AS low, max_by(px, seq) AS close, CAST(sum(qty) AS BIGINT) AS volume FROM {{trades}} t JOIN {{part}} p ON p.p_partkey = t.part_key GROUP BY p_brand, session_date"""
WINDOW = ("1995-06-01", "2001-06-30")


def payloads(spark, sf):
    r = table(spark, sf, "provider_rows")
    k = F.col("kind")
    s = lambda c: F.col(c).cast("string")
    row = F.concat(
        F.lit('{"date":"'), F.when(k == "date", F.lit("2000/01/01")).otherwise(s("session_date")), F.lit('","open":'), F.when(k == "text", F.lit('"12"')).when(k == "zero", F.lit("0")).otherwise(s("open")), F.lit(',"high":'), F.when(k == "bounds", F.lit("0.01")).otherwise(s("high")),
        F.lit(',"low":'), s("low"), F.lit(',"close":'), s("close"), F.lit(',"adjusted_close":'), s("close"), F.when(k == "gap", F.lit("")).otherwise(F.concat(F.lit(',"volume":'), F.when(k == "volume", F.lit("1.5")).otherwise(s("volume")))), F.lit("}"))
    # One provider response per brand and month, as the provider pages them.
    return r.withColumn("row", row).groupBy(F.concat("response_id", F.lit("-"), F.date_format("session_date", "yyyy-MM")).alias("response_id")).agg(F.concat(F.lit("["), F.array_join(F.collect_list("row"), ","), F.lit("]")).alias("payload"))


@query("src1_read_provider_bars", f"""
SELECT r.response_id || '-' || strftime(session_date, '%Y-%m') AS response_id, CASE WHEN kind <> 'date' THEN strftime(session_date, '%Y-%m-%d') ELSE '2000/01/01' END AS day, CASE kind WHEN 'gap' THEN 'MISSING_FIELD' WHEN 'date' THEN 'BAD_DATE' WHEN 'text' THEN 'PRICE_NOT_NUMBER' WHEN 'zero' THEN 'PRICE_NOT_POSITIVE' WHEN 'bounds' THEN 'BROKEN_BOUNDS' WHEN 'volume' THEN 'BAD_VOLUME'
 ELSE CASE WHEN NOT session_date BETWEEN DATE '{WINDOW[0]}' AND DATE '{WINDOW[1]}' THEN 'OUTSIDE_WINDOW' END END AS reason, CASE WHEN kind = 'ok' AND session_date BETWEEN DATE '{WINDOW[0]}' AND DATE '{WINDOW[1]}' THEN volume END AS volume FROM {{{{provider_rows}}}} r""")
def _src1(spark, sf):
    d = lambda v: F.lit(v).cast("date")
    bars, rejects = fs.parse_provider_payloads(payloads(spark, sf).withColumns({"from_date": d(WINDOW[0]), "to_date": d(WINDOW[1])}))
    return bars.select("response_id", F.col("session_date").cast("string").alias("day"), F.lit(None).cast("string").alias("reason"), "volume").unionByName(
        rejects.select("response_id", F.col("date_text").alias("day"), "reason", F.lit(None).cast("long").alias("volume")))


TEXT["capture_rows"] = """
SELECT instrument_id AS symbol, session_date, md5(concat(instrument_id, CAST(close AS VARCHAR(40)))) AS content_sha256, CASE WHEN volume > 170 THEN 'beta' ELSE 'alpha' END AS source_id, close, volume FROM {{bars_sparse}}"""
TEXT["capture_batches"] = "SELECT session_date, CASE WHEN count(*) < 8 THEN 'DEGRADED' ELSE 'SUCCEEDED' END AS status FROM {{bars_sparse}} GROUP BY session_date"


@query("src2_read_personal_store", """
SELECT session_date, CASE WHEN day(session_date) < 8 THEN 2 ELSE 1 END AS revision, 'UNPROVEN_PERSONAL' AS session_proof, CASE WHEN day(session_date) < 8 THEN 'beta' ELSE 'alpha' END AS source_id,
 instrument_id AS symbol, CAST(close AS VARCHAR) AS close, volume FROM {{bars_weekly}} WHERE month(session_date) <> 12 OR day(session_date) < 8""")
def _src2(spark, sf):
    """Writes capture files as the store names them, sessions of a month's first week twice, late December ones under a wrong year, then reads the store."""
    rows = table(spark, sf, "bars_weekly")
    s = lambda c: F.col(c).cast("string")
    item = F.struct(F.col("instrument_id").alias("symbol"), "instrument_id", s("open").alias("open"), s("high").alias("high"), s("low").alias("low"), s("close").alias("close"), s("close").alias("adjusted_close"), "volume",
                    F.sha2("instrument_id", 256).alias("content_sha256"), F.lit("a").alias("artifact_sha256"), s("session_date").alias("fetched_at"), F.lit("UNPROVEN_PERSONAL").alias("quality_status"))
    docs = rows.groupBy("session_date").agg(F.collect_list(item).alias("rows"))  # one panel of instruments per session
    both = docs.withColumn("revision", F.explode(F.when(F.dayofmonth("session_date") < 8, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    source = F.when(F.col("revision") == 2, "beta").otherwise("alpha")
    body = F.to_json(F.struct(F.lit(1).alias("schema_version"), s("session_date").alias("session_date"), F.concat(s("session_date"), F.lit("T13:00:00Z")).alias("captured_at"), F.lit("UNPROVEN_PERSONAL").alias("session_proof"), source.alias("source_id"), "rows"))
    lost = (F.month("session_date") == 12) & (F.dayofmonth("session_date") > 7)
    folder = F.when(lost, "1000").otherwise(F.year("session_date").cast("string"))
    name = F.concat(folder, F.lit("/"), s("session_date"), F.when(F.col("revision") == 2, ".r2").otherwise(""), F.lit(".json"))
    root = fs.workspace(spark)
    fs.write_documents(both.select(name.alias("name"), body.alias("body")), root).count()
    return fs.read_personal_store(spark, root)[0].select("session_date", "revision", "session_proof", "source_id", "symbol", "close", "volume")


@query("src3_select_sessions", "SELECT instrument_id, session_date, volume FROM {{bars_sparse}} WHERE session_date IN (SELECT DISTINCT session_date FROM {{bars_sparse}} ORDER BY 1 DESC LIMIT 7)")
def _src3(spark, sf):
    return fs.select_sessions(table(spark, sf, "bars_sparse")).select("instrument_id", "session_date", "volume")


@query("src3_select_range", "SELECT instrument_id, session_date, volume FROM {{bars_sparse}} WHERE session_date BETWEEN DATE '1999-01-01' AND DATE '1999-12-31'")
def _src3b(spark, sf):
    return fs.select_sessions(table(spark, sf, "bars_sparse"), "1999-01-01", "1999-12-31").select("instrument_id", "session_date", "volume")


@query("src4_build_capture_documents", """
SELECT r.session_date, count(*) AS rows, min(source_id) AS source_id, min(source_id) <> max(source_id) AS mixed_provenance FROM {{capture_rows}} r JOIN {{capture_batches}} b ON b.session_date = r.session_date AND b.status = 'SUCCEEDED'
WHERE r.session_date NOT IN (SELECT holiday_date FROM {{holidays}}) GROUP BY r.session_date""")
def _src4(spark, sf):
    docs, _ = fs.build_capture_documents(table(spark, sf, "capture_rows"), table(spark, sf, "capture_batches"), table(spark, sf, "holidays"))
    return docs.drop("rows_digest")


@query("src4_dropped_holidays", "SELECT session_date, count(*) AS dropped FROM {{capture_rows}} WHERE session_date IN (SELECT holiday_date FROM {{holidays}}) GROUP BY session_date")
def _src4b(spark, sf):
    return fs.build_capture_documents(table(spark, sf, "capture_rows"), table(spark, sf, "capture_batches"), table(spark, sf, "holidays"))[1]


@query("src5_write_capture", """
WITH d AS (SELECT r.session_date, string_agg(content_sha256, ',' ORDER BY content_sha256) AS x FROM {{capture_rows}} r JOIN {{capture_batches}} b ON b.session_date = r.session_date AND b.status = 'SUCCEEDED' WHERE r.session_date NOT IN (SELECT holiday_date FROM {{holidays}}) GROUP BY 1)
SELECT session_date, CASE WHEN session_date < DATE '1997-01-01' THEN 'UNCHANGED' WHEN session_date < DATE '1998-01-01' THEN 'REVISED' ELSE 'CREATED' END AS action, CASE WHEN session_date < DATE '1997-01-01' THEN 3 WHEN session_date < DATE '1998-01-01' THEN 4 ELSE 1 END AS revision FROM d""")
def _src5(spark, sf):
    docs, _ = fs.build_capture_documents(table(spark, sf, "capture_rows"), table(spark, sf, "capture_batches"), table(spark, sf, "holidays"))
    stored = docs.where("session_date < date '1998-01-01'").select("session_date", F.lit(3).alias("revision"), F.when(F.col("session_date") < F.lit("1997-01-01").cast("date"), F.col("rows_digest")).otherwise(F.lit("old")).alias("rows_digest"))
    return fs.write_capture(docs, stored).select("session_date", "action", "revision")


@query("src6_read_security_master", """
SELECT concat('C', p_partkey) AS code, CASE WHEN p_size = 7 THEN 'DUPLICATE' WHEN p_size = 9 THEN 'LISTING_DATE_MISSING' ELSE 'OK' END AS verdict, CASE WHEN p_size <> 9 THEN DATE '2001-03-15' END AS listing_date FROM {{part}} WHERE p_type <> 'SMALL' AND p_size <> 11""")
def _src6(spark, sf):
    p = table(spark, sf, "part")
    cells = {"Date": F.lit("31-JUL-2026"), "Code": F.concat(F.lit("C"), F.col("p_partkey").cast("string")), "Type": F.when(F.col("p_type") == "SMALL", "WARRANT").otherwise("EQUITY"), "Isin Code": F.when(F.col("p_size") == 7, F.lit("SAME")).otherwise(F.concat(F.lit("ID"), F.col("p_partkey").cast("string"))),
             "Issuer": F.col("p_name"), "Listing Date": F.when(F.col("p_size") == 9, "").otherwise("15-MAR-2001")}
    line = F.concat_ws("|", *[cells.get(c, F.lit("")) for c in fs.MASTER_COLUMNS])
    root = fs.workspace(spark)
    p.select(F.when(F.col("p_size") == 11, "broken|line").otherwise(line).alias("value")).write.text(f"{root}/master")
    return fs.read_security_master(spark, f"{root}/master")[0].select("code", "verdict", "listing_date")


@query("src7_read_reference_documents", """
SELECT concat('P', p_partkey) AS instrument_id, p_brand AS symbol, DATE '1995-01-01' + p_size AS valid_from, CASE WHEN p_size = 5 THEN 'REFERENCE_MALFORMED' END AS verdict FROM {{part}}""")
def _src7(spark, sf):
    p = table(spark, sf, "part")
    start = F.date_add(F.lit("1995-01-01").cast("date"), F.col("p_size"))
    interval = F.struct(start.cast("string").alias("from"), F.when(F.col("p_size") == 5, F.date_sub(start, 1).cast("string")).alias("through"), F.col("p_brand").alias("symbol"), F.lit("ORDINARY").alias("classification"), F.lit("IDR").alias("currency"), F.lit("MAIN").alias("board"))
    one = F.struct(F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("snapshotId"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("instrumentId"), F.lit("2026-01-01T00:00:00Z").alias("knownAt"), F.sha2("p_name", 256).alias("contentHash"), F.array(interval).alias("identities"))
    docs = p.select(F.to_json(F.struct(F.lit(1).alias("schemaVersion"), F.array().cast("array<string>").alias("universes"), F.array(one).alias("instruments"))).alias("body"))
    return fs.read_reference_documents(docs)[1].select("instrument_id", "symbol", "valid_from", "verdict")


@query("src8_read_session_proofs", """
SELECT session_date, status, CASE WHEN NOT (reference LIKE 'https://%' AND reference NOT LIKE '%eodhd.com/%') THEN 'REFERENCE_NOT_INDEPENDENT' WHEN completed_at > known_at THEN 'COMPLETION_AFTER_KNOWLEDGE' ELSE 'OK' END AS verdict FROM {{proofs}}""")
def _src8(spark, sf):
    root = fs.workspace(spark)
    table(spark, sf, "proofs").select(F.col("session_date").cast("string").alias("date"), "status", "reference", "known_at", "completed_at").write.json(f"{root}/proofs")
    return fs.read_session_proofs(spark, f"{root}/proofs").select("session_date", "status", "verdict")


@query("src9_append_boundaries", """
WITH n AS (SELECT instrument_id, known_at, concat_ws('|', status, coalesce(CAST(listed_from AS VARCHAR), '-'), coalesce(CAST(delisted_at AS VARCHAR), '-')) AS d, status FROM {{boundaries}}), s AS (SELECT instrument_id, known_at, min(d) AS lo, max(d) AS hi FROM n GROUP BY 1, 2), e AS (SELECT instrument_id, known_at, min(d) AS d FROM n WHERE status = 'VERIFIED' GROUP BY 1, 2)
SELECT s.instrument_id, s.known_at, CASE WHEN lo <> hi THEN 'CONFLICT' WHEN e.d IS NULL THEN 'NEW' ELSE 'IDENTICAL' END AS disposition FROM s LEFT JOIN e USING (instrument_id, known_at)""")
def _src9(spark, sf):
    b = table(spark, sf, "boundaries").select("instrument_id", "known_at", "status", "listed_from", "delisted_at")
    return fs.append_boundaries(b, b.where("status = 'VERIFIED'"))


@query("src10_check_holidays", """
WITH h AS (SELECT holiday_date, 'https://exchange.example' AS reference FROM {{holidays}} UNION ALL SELECT holiday_date, 'https://exchange.example' FROM {{holidays}} WHERE month(holiday_date) = 3 UNION ALL SELECT session_date, 'note' FROM {{calendar}} WHERE status = 'Weekend')
SELECT holiday_date, reference, CASE WHEN year(holiday_date) <> 1998 THEN 'OUTSIDE_YEAR' WHEN ISODOW(holiday_date) > 5 THEN 'WEEKEND' WHEN count(*) OVER (PARTITION BY holiday_date) > 1 THEN 'DUPLICATE' WHEN reference NOT LIKE 'https://%' THEN 'UNCITED' ELSE 'OK' END AS verdict FROM h""")
def _src10(spark, sf):
    h = table(spark, sf, "holidays").select("holiday_date", F.lit("https://exchange.example").alias("reference"))
    w = table(spark, sf, "calendar").where("status = 'Weekend'").select(F.col("session_date").alias("holiday_date"), F.lit("note").alias("reference"))
    return fs.check_holidays(h.unionByName(h.where("month(holiday_date) = 3")).unionByName(w), 1998)


@query("src11_inventory_artifacts", """
WITH b AS (SELECT DISTINCT p_brand AS brand FROM {{part}})
SELECT sha256(concat('raw ', brand)) AS sha256, CASE WHEN brand LIKE '%3' THEN 'UNLISTED' WHEN brand LIKE '%5' THEN 'LENGTH_MISMATCH' ELSE 'VERIFIED' END AS state FROM b
UNION ALL SELECT sha256(concat('gone ', brand)), 'MISSING' FROM b WHERE brand LIKE '%1'""")
def _src11(spark, sf):
    """Raw files against a manifest that leaves some out, names some that are gone and has some lengths wrong."""
    brands = table(spark, sf, "part").select(F.col("p_brand").alias("brand")).distinct()
    raw = lambda kind: F.concat(F.lit(f"{kind} "), F.col("brand"))
    root = fs.workspace(spark)
    fs.write_documents(brands.select(F.concat(F.regexp_replace("brand", "[^A-Za-z0-9]", "_"), F.lit(".raw")).alias("name"), raw("raw").alias("body")), root).count()
    listed = brands.where("brand NOT LIKE '%3'").select(F.sha2(raw("raw"), 256).alias("sha256"), (F.length(raw("raw")) + F.col("brand").endswith("5").cast("int")).cast("long").alias("byte_length"))
    gone = brands.where("brand LIKE '%1'").select(F.sha2(raw("gone"), 256).alias("sha256"), F.length(raw("gone")).cast("long").alias("byte_length"))
    return fs.verify_artifacts(fs.inventory_artifacts(spark, root), listed.unionByName(gone))


TEXT["csv_rows"] = """
SELECT seq AS row_number, CASE WHEN disc = 1 THEN 'someday' ELSE CAST(session_date AS VARCHAR(10)) END AS trade_date, CASE WHEN disc = 2 THEN 'GIFT' WHEN disc = 3 THEN 'CASH_DEPOSIT' ELSE 'BUY' END AS type, CASE WHEN disc = 4 THEN concat('P', CAST(part_key AS VARCHAR(12))) WHEN disc = 5 THEN 'P999999999' ELSE '' END AS instrument_id,
 CASE WHEN disc IN (3, 4, 5) THEN '' ELSE p_brand END AS symbol, CASE WHEN tax = 1 THEN '-5' ELSE CAST(qty AS VARCHAR(8)) END AS quantity, 'SHARES' AS unit, '10.5' AS price, '0' AS fees, '0' AS cash_amount, CASE WHEN tax = 2 THEN ' ' ELSE concat('R', CAST(seq AS VARCHAR(20))) END AS external_reference, '' AS note, session_date
FROM {{trades}} t JOIN {{part}} p ON p.p_partkey = t.part_key"""


@query("src12_import_transactions", """
WITH m AS (SELECT p.symbol, p.session_date, count(h.instrument_id) AS n, min(h.instrument_id) AS found FROM (SELECT DISTINCT symbol, session_date FROM {{csv_rows}} WHERE symbol <> '') p LEFT JOIN {{symbol_history}} h ON h.symbol = p.symbol AND p.session_date BETWEEN h.valid_from AND coalesce(h.valid_to, DATE '9999-12-31') GROUP BY 1, 2),
 x AS (SELECT c.*, coalesce(n, 0) AS n, found, type = 'BUY' AS trade FROM {{csv_rows}} c LEFT JOIN m ON m.symbol = c.symbol AND m.session_date = c.session_date AND c.trade_date <> 'someday'),
 e AS (SELECT *, CASE WHEN type = 'GIFT' THEN 'EVENT_TYPE_OR_UNIT' WHEN trade_date = 'someday' THEN 'BAD_DATE' WHEN trade AND instrument_id = 'P999999999' THEN 'UNKNOWN_INSTRUMENT' WHEN trade AND instrument_id = '' AND n <> 1 THEN 'UNKNOWN_INSTRUMENT' WHEN trim(external_reference) = '' THEN 'REFERENCE_REQUIRED' WHEN quantity = '-5' THEN 'BAD_AMOUNT' END AS error, sha256('F1' || chr(10) || 'GENERIC_CSV' || chr(10) || external_reference) AS h FROM x)
SELECT row_number, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS event_id, CASE WHEN error IS NULL AND trade THEN CASE WHEN instrument_id <> '' THEN instrument_id ELSE found END END AS instrument_id, error FROM e""")
def _src12(spark, sf):
    root = fs.workspace(spark)
    table(spark, sf, "csv_rows").drop("session_date").write.option("header", "true").option("emptyValue", "").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(f"{root}/csv")
    schema = "row_number long, " + ", ".join(f"{c} string" for c in fs.TRANSACTION_COLUMNS)
    rows = spark.read.schema(schema).option("header", "true").csv(f"{root}/csv").fillna("")
    return fs.import_transactions(rows, table(spark, sf, "listings").select("instrument_id"), table(spark, sf, "symbol_history"), "F1")


@query("src13_export_numbering", """
SELECT portfolio_id, event_id, row_number() OVER (PARTITION BY portfolio_id ORDER BY event_order, event_id) AS event_order FROM {{ledger_events}}""")
def _src13(spark, sf):
    """Renumbers, writes the documents as JSON rows and reads them back."""
    root = fs.workspace(spark)
    out = lg.number_events(table(spark, sf, "ledger_events"))
    out.write.option("compression", "gzip").json(f"{root}/portfolio")
    return spark.read.schema("portfolio_id string, event_id string, event_order long").json(f"{root}/portfolio")


@query("src14_export_csv_guard", """
WITH r AS (SELECT DISTINCT portfolio_id FROM {{ledger_events}} WHERE supersedes IS NOT NULL), e AS (SELECT *, CASE CAST(quantity AS INTEGER) % 4 WHEN 0 THEN '=SUM(A1)' WHEN 1 THEN '  +1' WHEN 2 THEN 'plain' END AS note FROM {{ledger_events}})
SELECT event_id AS external_reference, CASE WHEN note LIKE '=%' OR note LIKE '  +%' THEN '''' || note ELSE coalesce(note, '') END AS note FROM e WHERE portfolio_id NOT IN (SELECT portfolio_id FROM r)""")
def _src14(spark, sf):
    m = F.col("quantity").cast("int") % 4
    e = table(spark, sf, "ledger_events").withColumn("note", F.when(m == 0, "=SUM(A1)").when(m == 1, "  +1").when(m == 2, "plain")).withColumn("external_reference", F.lit(None).cast("string"))
    return fs.export_transactions(e)[0].select("external_reference", "note")


TEXT["snapshot_csv"] = """
SELECT seq AS line, concat('A', CAST(supp_key % 5 AS VARCHAR(4))) AS source_account, CASE WHEN qty = 50 THEN '' ELSE concat(' i', CAST(part_key % 40 AS VARCHAR(8)), ' ') END AS symbol, CASE WHEN tax = 1 THEN CAST(qty AS VARCHAR(8)) ELSE '' END AS lots,
 CASE WHEN tax = 1 THEN CASE WHEN qty < 5 THEN '7' ELSE '' END ELSE CAST(qty AS VARCHAR(8)) END AS shares, CASE WHEN part_key % 40 = 3 AND disc = 2 THEN '' WHEN disc = 9 THEN 'x' ELSE '10.25' END AS average_cost, CASE WHEN disc = 1 THEN 'HOLD' WHEN disc = 2 THEN 'INVEST' ELSE '' END AS mandate FROM {{trades}}"""


@query("src15_consolidate_holdings", """
WITH x AS (SELECT *, upper(trim(symbol)) AS sym, CASE WHEN shares <> '' THEN CAST(shares AS BIGINT) ELSE CAST(lots AS BIGINT) * 100 END AS n FROM {{snapshot_csv}} WHERE trim(symbol) <> '' AND NOT (lots <> '' AND shares <> '') AND average_cost <> 'x' AND mandate <> 'HOLD')
SELECT sym AS symbol, CAST(sum(n) AS BIGINT) AS shares, CASE WHEN bool_and(average_cost <> '') THEN round(sum(n * TRY_CAST(average_cost AS DOUBLE)) / sum(n), 6) END AS average_cost, count(*) AS rows, count(DISTINCT source_account) AS accounts, coalesce(string_agg(DISTINCT nullif(mandate, ''), ','), '') AS mandates, count(*) > 1 AS duplicate_group FROM x GROUP BY sym""")
def _src15(spark, sf):
    return fs.consolidate_holdings(table(spark, sf, "snapshot_csv"))[0].withColumn("average_cost", F.round("average_cost", 6))


@query("src16_experiment_records", """
SELECT seq AS response_id, CASE WHEN disc = 0 THEN 'TIMEOUT' ELSE 'HTTP_' || CASE WHEN disc = 1 THEN 500 ELSE 200 END END AS http_outcome, CASE WHEN disc < 2 OR disc = 3 THEN 0 WHEN disc = 4 THEN 2 ELSE 1 END AS row_count, disc > 4 AS payload_valid,
 CASE WHEN disc = 0 THEN 'TIMEOUT' WHEN disc = 1 THEN 'HTTP_ERROR' WHEN disc = 2 THEN 'PROVIDER_WARNING_OR_ERROR' WHEN disc IN (3, 4) THEN 'MALFORMED_OR_UNEXPECTED_EOD' END AS classification, CASE WHEN disc > 4 THEN qty END AS volume FROM {{trades}}""")
def _src16(spark, sf):
    t = table(spark, sf, "trades")
    d, s = F.col("disc"), F.col("session_date").cast("string")
    row = lambda day: F.concat(F.lit('{"date":"'), day, F.lit('","open":10,"high":12,"low":9,"close":11,"adjusted_close":11,"volume":'), F.col("qty").cast("string"), F.lit("}"))
    body = F.when(d < 2, "").when(d == 2, '[{"warning":"slow"}]').when(d == 3, "[]").when(d == 4, F.concat(F.lit("["), row(s), F.lit(","), row(s), F.lit("]"))).otherwise(F.concat(F.lit("["), row(s), F.lit("]")))
    r = t.select(F.col("seq").alias("response_id"), F.when(d == 1, 500).when(d > 1, 200).alias("http_status"), F.when(d == 0, "TIMEOUT").alias("failure_class"), body.alias("payload"), F.col("session_date").alias("requested_date"))
    return fs.experiment_records(r).drop("close")


@query("ag14_operations_summary", """
WITH r AS (SELECT concat('R', l_orderkey) AS run_id, count(*) FILTER (WHERE l_returnflag <> 'R') AS ok, count(*) FILTER (WHERE l_returnflag = 'R') AS failed, CAST(sum(l_linenumber) AS BIGINT) AS units FROM {{lineitem}} GROUP BY 1),
 o AS (SELECT concat('R', o_orderkey) AS run_id, CASE WHEN o_orderstatus = 'O' THEN 'SUCCEEDED' ELSE 'DEGRADED' END AS status, CAST(o_orderdate AS DATE) AS d FROM {{orders}}), s AS (SELECT count(DISTINCT d) AS sessions FROM o WHERE status = 'SUCCEEDED')
SELECT o.run_id, status, coalesce(ok, 0) AS ok, coalesce(failed, 0) AS failed, coalesce(units, 0) AS units, sessions, sessions >= 20 AS soak_complete FROM o LEFT JOIN r USING (run_id) CROSS JOIN s""")
def _ag14(spark, sf):
    req = table(spark, sf, "lineitem").select(F.concat(F.lit("R"), F.col("l_orderkey").cast("string")).alias("run_id"), F.when(F.col("l_returnflag") == "R", "ERROR").otherwise("OK").alias("outcome"), F.col("l_linenumber").cast("long").alias("units"))
    runs = table(spark, sf, "orders").select(F.concat(F.lit("R"), F.col("o_orderkey").cast("string")).alias("run_id"), F.when(F.col("o_orderstatus") == "O", "SUCCEEDED").otherwise("DEGRADED").alias("status"), F.to_date("o_orderdate").alias("session_date"))
    return fs.operations_summary(req, runs, 20)


@query("ag15_quota_preflight", """
SELECT seq AS plan_id, qty + 1 AS requests, (qty + 1) * (1 + disc) AS attempts, (qty + 1) * (1 + disc) * 2 AS maximum_units, greatest(0, (qty + 1) * (1 + disc) * 2 - 100) AS extra, CASE WHEN (qty + 1) * (1 + disc) * 2 <= 400 AND 150 - greatest(0, (qty + 1) * (1 + disc) * 2 - 100) >= tax * 10 THEN 'ELIGIBLE' ELSE 'BUDGET_BLOCKED' END AS status FROM {{trades}}""")
def _ag15(spark, sf):
    p = table(spark, sf, "trades").select(F.col("seq").alias("plan_id"), F.col("qty").alias("equities"), F.lit(True).alias("benchmark"), F.col("disc").alias("retries"), F.lit(2).alias("units_per_attempt"), F.lit(100).alias("daily_remaining"), F.lit(400).alias("run_ceiling"), F.lit(150).alias("extra_balance"), (F.col("tax") * 10).alias("reserve"))
    return fs.quota_preflight(p)


@query("ag17_ingest_summary", APPEND_FOLD + """,
 d AS (SELECT instrument_id AS run_id, count(*) AS accepted, count(*) FILTER (disposition = 'INSERTED') AS additions, count(*) FILTER (disposition = 'REVISION_APPENDED') AS corrections,
   count(*) FILTER (disposition = 'STALE_EVIDENCE_IGNORED') AS stale_ignored, count(*) FILTER (disposition = 'DUPLICATE_IGNORED') AS duplicates FROM fold WHERE arrival >= 0 GROUP BY 1),
 v AS (SELECT instrument_id AS run_id, count(*) AS expected, count(*) FILTER (quality = 'VALID') AS accounted, count(*) FILTER (quality <> 'VALID') AS unavailable FROM {{revisions}} GROUP BY 1)
SELECT v.run_id, expected, accounted, unavailable, coalesce(accepted, 0) AS accepted, coalesce(additions, 0) AS additions, coalesce(corrections, 0) AS corrections, coalesce(stale_ignored, 0) AS stale_ignored, coalesce(duplicates, 0) AS duplicates,
 CASE WHEN accounted = expected AND coalesce(stale_ignored, 0) = 0 THEN 'SUCCEEDED' ELSE 'DEGRADED' END AS status FROM v LEFT JOIN d ON d.run_id = v.run_id""")
def _ag17(spark, sf):
    """Accounting of one ingest run per supplier over the append dispositions and the day verdicts."""
    r = table(spark, sf, "revisions")
    edge = F.lit("1999-01-01").cast("timestamp")
    d = pit.append_revisions(r.where(F.col("known_at") < edge), r.where(F.col("known_at") >= edge).withColumnRenamed("revision_number", "arrival")).withColumnRenamed("instrument_id", "run_id")
    v = r.select(F.col("instrument_id").alias("run_id"), "session_date", F.when(F.col("quality") == "VALID", "AVAILABLE").otherwise("MISSING").alias("verdict"))
    return fs.ingest_summary(d, v)
