import pytest
from pyspark.sql import functions as F

from tidemark.llm.mixing import BLOCK, mix, mixed, sizes, targets


def plain_targets(sizes_by_source):
    names = sorted((s for s in sizes_by_source if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes_by_source else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, out, free = 1.5 * sum(sizes_by_source.values()), {}, set(names)
    while free:
        left, heavy = total - sum(out.values()), sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / heavy >= 2 * sizes_by_source[s]}
        if not over:
            out |= {s: left * weight[s] / heavy for s in free}
            break
        out |= {s: 2.0 * sizes_by_source[s] for s in over}
        free -= over
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("source", F.when(F.col("source") != "src3", F.col("source")))


def test_targets_and_shares(docs):
    sized = sizes(docs)
    by_source = {r["source"]: r["n"] for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    want, got = plain_targets(by_source), {r["source"]: r["target"] for r in targets(sized).collect()}
    assert got == pytest.approx(want)
    rows = mixed(docs)
    taken = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    assert all(abs(taken[s] - want[s]) <= 4 * BLOCK for s in want)
    assert rows.where("taken > 2 * size OR taken < 0").isEmpty() and rows.count() == docs.count()
    assert sorted(map(repr, rows.collect())) == sorted(map(repr, mixed(docs.repartition(7)).collect()))


def test_the_schedule_keeps_shares_all_along(docs):
    schedule, members = mix(docs)
    rows = schedule.select("slot", "source", (F.col("stop_word") - F.col("first_word")).alias("n")).collect()
    goal, whole = plain_targets({r[0]: r[1] for r in members.groupBy("source").agg(F.sum("size")).collect()}), sum(r["n"] for r in rows)
    last = max(r["slot"] for r in rows)
    for part in (0.1, 0.3, 0.7):
        seen = [r for r in rows if r["slot"] <= part * last]
        for source in goal:
            assert abs(sum(r["n"] for r in seen if r["source"] == source) - part * goal[source]) <= 6 * BLOCK
    assert whole == mixed(docs).agg(F.sum("taken")).first()[0]
    # A slot's words are one block: they never pass its size, and no word is taken more often than twice.
    assert schedule.groupBy("slot").agg(F.sum(F.col("stop_word") - F.col("first_word")).alias("n")).where(F.col("n") > BLOCK).isEmpty()
    assert schedule.groupBy("sid", "begin", "first_word").count().where("count > 2").isEmpty()


def test_odd_and_empty(odd, none):
    rows = mixed(odd).collect()
    assert len(rows) == odd.count() and {r["size"] for r in rows if r["doc_id"] in (2, 3, 4)} == {0}
    assert all(r["taken"] == 0 for r in rows if r["size"] == 0)
    assert mixed(none).collect() == []
    assert [r["target"] for r in mixed(odd.where("doc_id = 3")).collect()] == [0.0]
