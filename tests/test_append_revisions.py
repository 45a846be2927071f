"""Revisions are appended in one shuffle; long bars are folded in segments, with the same verdicts."""

import pytest

import __spark_entry__ as entry
from tidemark.operators import pit
from tidemark.plans.adapters import table

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ("pit1_append_revisions", "ag17_ingest_summary"))
def test_rows_are_shuffled_once(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert len([x for x in plan.split("\n") if "Exchange" in x and "session_date" in x]) == 1 and "InMemoryTableScan" not in plan


def test_long_bars(spark, monkeypatch):
    """Bars of two days, so that most have many revisions."""
    r = table(spark, SF, "revisions").selectExpr("*", "date_trunc('year', session_date)::date AS y").drop("session_date").withColumnRenamed("y", "session_date")
    old, new = r.where("known_at < '1999-01-01'"), r.where("known_at >= '1999-01-01'").withColumnRenamed("revision_number", "arrival")
    rows = lambda: sorted(map(repr, pit.append_revisions(old, new).collect()))
    short = rows()
    monkeypatch.setattr(pit, "LONG", 40, raising=False)
    assert len(short) == new.count() and len({x.split("disposition=")[1].split(",")[0] for x in short}) > 2 and rows() == short


def test_contents_are_compared_as_they_stand(spark):
    """A text of 32 characters is not the digest with the same bytes, and case counts."""
    texts = ["61" * 32, "a" * 32, "6A" * 32, "6a" * 32, "6a" * 32]
    batch = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "arrival long, content_hash string").selectExpr(
        "'A' AS instrument_id", "DATE '2020-01-01' AS session_date", "arrival", "content_hash", "TIMESTAMP '2020-01-02' AS fetched_at", "TIMESTAMP '2020-01-02' AS known_at")
    empty = batch.withColumnRenamed("arrival", "revision_number").limit(0)
    got = [(r.disposition, r.new_revision_number) for r in pit.append_revisions(empty, batch).orderBy("arrival").collect()]
    assert got == [("INSERTED", 1), ("REVISION_APPENDED", 2), ("REVISION_APPENDED", 3), ("REVISION_APPENDED", 4), ("DUPLICATE_IGNORED", None)]
