"""The snapshot audit derives its rows once and judges the lists where the rows are."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.operators import outcomes as oc
from tidemark.plans.adapters import table
from tidemark.session import shared

SF = "/root/testdata/sf0.001"


def test_entries_are_not_shuffled(spark):
    plan = entry.queries()["sm22_audit_snapshot"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" in plan and not [x for x in plan.split("\n") if "Exchange" in x and "instrument_id" in x]
    spark.catalog.clearCache()


def test_given_tables_stay_persisted(spark):
    rows = shared(table(spark, SF, "decision_rows"))
    table(spark, SF, "snapshot_rows", decision_rows=rows)
    assert rows.storageLevel.useMemory
    rows.unpersist()


def test_entries_that_repeat_or_lack_a_run(spark):
    """An entry said twice of one row, a run nobody stored, a run stored twice and names that are null."""
    day = F.lit("2000-01-03").cast("date")
    runs = spark.createDataFrame([("a", "p", 2), ("b", "p", 1), ("b", "p", 3)], "run_id string, portfolio_id string, row_count long").select("*", day.alias("history_anchor"), day.alias("through"))
    rows = spark.createDataFrame([("a", "x", True, 1), ("a", "y", False, 0), ("b", None, False, 0)], "run_id string, instrument_id string, held boolean, shares int").select(
        "*", F.lit(False).alias("configured"), F.lit(None).cast("int").alias("discovery_rank"), F.lit(1.0).alias("average_cost"), F.lit(None).cast("string").alias("episode_id"),
        *[day.alias(c) for c in ("episode_start", "confirmation_date", "end_date", "market_date")])
    said = [("a", "evaluated", 0, "x"), ("a", "evaluated", 0, "x"), ("a", "held", 0, "x"), ("b", "evaluated", 0, None), ("c", "shortlist", 1, "x"), ("c", "ranked", 21, "x")]
    members = spark.createDataFrame(said, "run_id string, list_name string, position long, instrument_id string")
    got = sorted(tuple(r) for r in oc.audit_snapshot(runs, rows, members).collect())
    # Run a counts two for two, but x stands twice for y; c has no rows, and of its lists the place beyond the shortlist counts only as a rank.
    assert got == [("a", "EVALUATED_MEMBERSHIP"), ("b", "POPULATION_COUNT"), ("c", "RANK_ORDER"), ("c", "SHORTLIST_ORDER")]
