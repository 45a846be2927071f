import hashlib
import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import replay as rp
from tidemark.operators.digests import ARITY, LEVELS, ordered_digest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(members):
    """The digest of a list of rows (lists of strings or None) in order."""
    level = [sha(json.dumps(m, separators=(",", ":"))) for m in members]
    for _ in range(LEVELS):
        level = [sha("".join(level[i : i + ARITY])) for i in range(0, len(level), ARITY)]
    assert len(level) == 1
    return sha(f"{len(members)}|{level[0]}")


def test_digest_hangs_on_order_and_content_alone(spark):
    n = 2 * ARITY + 7
    rows = [("a", i, f"v{i * 7919 % n}") for i in range(n)] + [("b", 1, "x"), ("b", 2, None), (None, 1, "y")]
    df = spark.createDataFrame(rows, "key string, at long, value string")
    want = {"a": plain([[str(i), v] for k, i, v in rows if k == "a"]), "b": plain([["1", "x"], ["2", None]]), None: plain([["1", "y"]])}
    for parts in (1, 13):
        got = ordered_digest(df.repartition(parts, F.col("at") % 5), ["key"], ["at"], ["at", "value"])
        assert {r["key"]: r["digest"] for r in got.collect()} == want
    # Two members of one key change places.
    swapped = df.withColumn("value", F.when((F.col("key") == "a") & (F.col("at") == 0), F.lit(rows[1][2])).when((F.col("key") == "a") & (F.col("at") == 1), F.lit(rows[0][2])).otherwise(F.col("value")))
    got = {r["key"]: r["digest"] for r in ordered_digest(swapped, ["key"], ["at"], ["at", "value"]).collect()}
    assert got["a"] != want["a"] and got["b"] == want["b"]
    assert ordered_digest(df.limit(0), ["key"], ["at"]).collect() == []


POLICY = "p1"


def content():
    return F.md5(F.concat_ws("|", "instrument_id", F.col("session_date").cast("string"), F.col("close").cast("string")))


STORE = "instrument_id string, session_date date, revision_number long, known_at timestamp, close long"


@pytest.fixture(scope="module")
def case(spark):
    rows = [(i, date(2024, 1, d), 1, datetime(2024, 1, d, 20), 100 + d) for i in ("A", "B") for d in range(1, 11)]
    store = spark.createDataFrame(rows, STORE).withColumn("content_hash", content())
    chosen = store.withColumn("request_id", F.explode(F.array(F.lit("r1"), F.lit("r2"), F.lit("r3")))).where("request_id <> 'r3' OR session_date < '2024-01-06'")
    links, entries = rp.capture_manifests(chosen.select("request_id", "instrument_id", "session_date", "revision_number", "known_at", "content_hash"))

    def screen(bars):
        return bars.groupBy("run_id", "instrument_id").agg(F.max_by("close", "session_date").alias("close"), F.sum("close").alias("total"))

    stored = screen(chosen.withColumnRenamed("request_id", "run_id"))
    policies = spark.createDataFrame([("r1", POLICY), ("r2", "p0"), ("r3", POLICY)], "run_id string, policy_id string")
    runs = policies.join(links.select(F.col("request_id").alias("run_id"), "manifest_id"), "run_id")

    def verify(now, kept=entries):
        verdicts, differences = rp.replay_decisions(runs, links, kept, now, screen, stored, ("close", "total"), POLICY, content())
        return {r["run_id"]: (r["verdict"], r["detail"]) for r in verdicts.collect()}, {(r["run_id"], r["instrument_id"], r["field"]) for r in differences.collect()}

    return store, links, entries, verify


def test_requests_of_one_selection_share_a_manifest(case):
    _, links, entries, _ = case
    ids = {r["request_id"]: (r["manifest_id"], r["inputs"]) for r in links.collect()}
    assert ids["r1"] == ids["r2"] != ids["r3"] and ids["r1"][1] == 20 and ids["r3"][1] == 10
    assert entries.count() == 30


def test_an_untouched_store_matches(case):
    store, _, _, verify = case
    verdicts, differences = verify(store)
    assert verdicts == {"r1": ("MATCH", None), "r2": ("POLICY_VERSION_UNAVAILABLE", None), "r3": ("MATCH", None)} and not differences


def test_a_lost_revision_is_no_input(case):
    store, _, _, verify = case
    verdicts, differences = verify(store.where("NOT (instrument_id = 'A' AND session_date = '2024-01-08')"))
    assert verdicts["r1"] == ("INPUT_NOT_AVAILABLE", "CANONICAL_REVISION_MISSING") and verdicts["r3"] == ("MATCH", None) and not differences


def test_a_tampered_bar_gives_another_result(case):
    store, _, _, verify = case
    bar = "instrument_id = 'A' AND session_date = '2024-01-08'"
    tampered = store.withColumn("close", F.expr(f"CASE WHEN {bar} THEN 999 ELSE close END"))
    verdicts, differences = verify(tampered)
    assert verdicts["r1"] == ("DIFFERENT_RESULT", "CANONICAL_REVISION_INTEGRITY_FAILED") and verdicts["r3"] == ("MATCH", None)
    assert differences == {("r1", "A", "total"), ("r1", None, "inputHash")}
    # Also when its stored hash was made to fit, or its clock was moved.
    assert verify(tampered.withColumn("content_hash", content()))[0]["r1"][0] == "DIFFERENT_RESULT"
    moved = store.withColumn("known_at", F.expr(f"CASE WHEN {bar} THEN known_at + INTERVAL '1' DAY ELSE known_at END"))
    assert verify(moved) == ({"r1": ("DIFFERENT_RESULT", "CANONICAL_REVISION_INTEGRITY_FAILED"), "r2": ("POLICY_VERSION_UNAVAILABLE", None), "r3": ("MATCH", None)}, {("r1", None, "inputHash")})


def test_a_lost_manifest_is_no_input(case):
    store, links, entries, verify = case
    gone = links.where("request_id = 'r3'").first()["manifest_id"]
    verdicts, _ = verify(store, entries.where(F.col("manifest_id") != gone))
    assert verdicts["r3"] == ("INPUT_NOT_AVAILABLE", "MANIFEST_MISSING") and verdicts["r1"] == ("MATCH", None)
