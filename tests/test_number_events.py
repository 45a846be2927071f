from pyspark.sql import functions as F

from tidemark.operators import ledger as lg


def portfolios(spark):
    """A long portfolio, ten short ones and one without a name; orders spread over several blocks."""
    n = F.col("id")
    return spark.range(300).select(F.when(n < 180, "long").when(n < 290, F.concat(F.lit("p"), n % 10)).alias("portfolio_id"), F.concat(F.lit("E"), n).alias("event_id"), (n * 7919 % 300 * 10**11 + n).alias("event_order"))


def expected(spark):
    groups = {}
    for r in portfolios(spark).collect():
        groups.setdefault(r["portfolio_id"], []).append((r["event_order"], r["event_id"]))
    return {(p, e, i) for p, rows in groups.items() for i, (_, e) in enumerate(sorted(rows), 1)}


def test_ordinary_portfolios_are_shuffled_once(spark):
    out = lg.number_events(portfolios(spark))
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r["portfolio_id"], r["event_id"], r["event_order"]) for r in out.collect()} == expected(spark)


def test_long_portfolios_are_numbered_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(lg, "LONG", 100)
    out = lg.number_events(portfolios(spark))
    assert {(r["portfolio_id"], r["event_id"], r["event_order"]) for r in out.collect()} == expected(spark)
