"""Ledger scans: one shuffle for portfolios of ordinary length, blocks for long ones, the same results."""

import pytest

import __spark_entry__ as entry
from tidemark.operators import ledger as lg
from tidemark.plans import portfolio

SF = "/root/testdata/sf0.001"


def test_short_portfolios_are_not_shuffled_by_blocks(spark):
    plan = lg.ledger_steps(portfolio.events(spark, SF), portfolio.CUTOFF, portfolio.THROUGH)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "__block" not in plan


@pytest.mark.parametrize("name", ("sm1_positions", "sm3_share_prefixes"))
def test_long_portfolios(spark, monkeypatch, name):
    rows = lambda: sorted(map(repr, entry.queries()[name](spark, SF).collect()))
    short = rows()
    monkeypatch.setattr(lg, "LONG", 60, raising=False)
    assert len(short) > 30 and rows() == short


def test_events_are_not_kept_whole(spark):
    """What is persisted or written on the way is the events that corrections speak of, not all of them with all columns."""
    spark.catalog.clearCache()
    plan = lg.ledger_steps(portfolio.events(spark, SF), portfolio.CUTOFF, portfolio.THROUGH)._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" not in plan


def test_cash_alone_needs_no_order(spark):
    events = portfolio.events(spark, SF)
    cash = lg.ledger_cash(events, portfolio.CUTOFF, portfolio.THROUGH)
    assert "Window" not in cash._jdf.queryExecution().executedPlan().toString()
    rows = lambda df: sorted(map(repr, df.select("portfolio_id", "cash", "events").collect()))
    assert rows(cash) == rows(lg.project_ledger(events, portfolio.CUTOFF, portfolio.THROUGH)[1])
