"""Invariants on derived tables: no leakage, idempotent append, hot keys, entry contract."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.operators import pit
from tidemark.operators.scan import asof_lookup, prefix_scan
from tidemark.plans.adapters import table
from tidemark.sources import files as fs

SF = "/root/testdata/sf0.001"


def test_later_knowledge_never_changes_an_earlier_answer(spark):
    r = table(spark, SF, "revisions").select("instrument_id", "session_date", "revision_number", "known_at", "close")
    early = r.where("known_at <= timestamp '1998-06-30'")
    a, b = pit.bars_as_of(r, "1998-06-30"), pit.bars_as_of(early, "1998-06-30")
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_prefix_scan_on_one_hot_key_equals_brute_force(spark):
    rng = random.Random(7)
    rows = [("hot" if i % 3 else f"k{i % 5}", i, date(2020, 1, 1) + timedelta(i // 3), rng.randint(-5, 9), rng.choice([None, i])) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, i long, d date, v long, m long")
    got = {r.i: (r.s, r.h, r.l) for r in prefix_scan(df, ["k"], ["i"], F.trunc("d", "month"), {"s": ("sum", F.col("v")), "h": ("max", F.col("v")), "l": ("last", F.col("m"))}).collect()}
    seen = {}
    for k, i, _, v, m in rows:
        s, h, last = seen.get(k, (None, None, None))
        assert got[i] == (s, h, last)
        seen[k] = ((s or 0) + v, v if h is None else max(h, v), last if m is None else m)


def test_asof_lookup_equals_brute_force(spark):
    rng = random.Random(3)
    facts = sorted({(rng.choice("ab"), date(2020, 1, 1) + timedelta(rng.randint(0, 400))) for _ in range(60)})
    probes = [(rng.choice("abc"), date(2020, 1, 1) + timedelta(rng.randint(-20, 450)), i) for i in range(200)]
    f = spark.createDataFrame([(k, d, n) for n, (k, d) in enumerate(facts)], "k string, at date, n int")
    got = {r.i: r.n for r in asof_lookup(spark.createDataFrame(probes, "k string, d date, i int"), f, ["k"], "d", "at", ["n"]).collect()}
    for k, d, i in probes:
        best = [n for n, (fk, fd) in enumerate(facts) if fk == k and fd <= d]
        assert got[i] == (max(best, key=lambda n: facts[n][1]) if best else None)


def test_personal_store_keeps_the_highest_revision_and_names_corrupt_files(spark, tmp_path):
    body = '{"schema_version":1,"session_date":"%s","captured_at":"2026-09-01T13:00:00Z","session_proof":"UNPROVEN_PERSONAL","source_id":"s","rows":[{"symbol":"A","close":"%s","volume":1}]}'
    folder = tmp_path / "2026"
    folder.mkdir()
    (folder / "2026-09-01.json").write_text(body % ("2026-09-01", "1"))
    (folder / "2026-09-01.r2.json").write_text(body % ("2026-09-01", "2"))
    (folder / "2026-09-02.r1.json").write_text(body % ("2026-09-02", "3"))
    (folder / "2025-09-02.json").write_text(body % ("2025-09-02", "3"))
    rows, corrupt = fs.read_personal_store(spark, str(tmp_path))
    assert [(r.revision, r.close) for r in rows.collect()] == [(2, "2")]
    assert sorted(r.problem for r in corrupt.collect()) == ["BAD_REVISION", "YEAR_MISMATCH"]


def test_a_range_over_366_days_is_refused(spark):
    days = table(spark, SF, "bars_sparse")
    assert fs.select_sessions(days, "2000-01-01", "2000-12-31").count() > 0
    with pytest.raises(ValueError):
        fs.select_sessions(days, "1999-01-01", "2000-01-02")


@pytest.mark.parametrize("alpha", [0.01, 2 / 21, 0.5, 0.9, 1.0])
def test_smoothing_is_exact_at_any_alpha_and_length(spark, alpha):
    from tidemark.functions.smoothing import smoothing_stages

    rng = random.Random(1)
    xs = [rng.uniform(50, 150) for _ in range(5_000)]
    df = spark.createDataFrame([("k", i + 1, x) for i, x in enumerate(xs)], "k string, at long, x double")
    stages, value = smoothing_stages("s", F.col("x"), F.col("at"), 20, alpha, ["k"], "at")
    for stage in stages:
        df = df.withColumns(stage)
    got = {r["at"]: r["v"] for r in df.select("at", value.alias("v")).collect()}
    v = sum(xs[:20]) / 20
    for i in range(20, 5_000):
        v += alpha * (xs[i] - v)
        assert abs(got[i + 1] - v) < 1e-9 * v


def test_streams_equal_their_batch_twins_and_count_late_rows(spark, tmp_path):
    from tidemark.streaming import jobs

    rows = [("a", "2020-01-01 01:00:00", 0, "VALID", 2, 1), ("a", "2020-01-09 01:00:00", 5, "STALE", 1, 1), ("b", "2020-01-01 02:00:00", 1, "VALID", 1, 1), ("a", "2020-01-01 03:00:00", 1, "VALID", 3, 1)]
    for i, r in enumerate(rows):  # the third and fourth come after a later day
        spark.createDataFrame([r], "instrument_id string, at string, volume long, quality string, high int, low int").withColumn("known_at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = {str(r["session_date"]): r for r in jobs.session_health_stream(stream(), f"{tmp_path}/health", 3).collect()}
    assert {k: (r["bars"], r["instruments"], r["coverage_gap"], r["zero_volume"], r["flat"], r["not_valid"]) for k, r in got.items()} == {"2020-01-01": (3, 2, 1, 1, 1, 0), "2020-01-09": (1, 1, 2, 0, 1, 1)}
    days = jobs.completed_sessions(stream().withColumn("session_date", F.to_date("at")), f"{tmp_path}/days")
    last = days.groupBy("session_date").agg(F.max_by("bars", "revision"))
    assert {str(r[0]): r[1] for r in last.collect()} == {"2020-01-01": 3}  # the clock stops in the morning of the ninth, which is still open


def test_entry_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
