"""Smoothing and weighted-average cost as column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

#: Weights are rescaled inside a block of rows by at most e to this power, which a double holds with room to spare.
RANGE = 600.0


def block_rows(alpha: float) -> int:
    """Rows of a scan block: over one whole block the weight of a value falls by a factor of about e**-RANGE.

    What stands before the previous block weighs less than that, some 250 orders of magnitude below a double's last
    digit, at any alpha and any length of a run.
    """
    if not 0.0 < alpha <= 1.0:
        raise ValueError("alpha lies above 0 and not above 1")
    return 1 if alpha == 1.0 else max(1, math.floor(RANGE / -math.log1p(-alpha)))


def smooth(values: Column, n: int, alpha: float) -> Column:
    """Last smoothed value of an ordered array: mean of the first n, then v += alpha * (x - v)."""
    seed = F.aggregate(F.slice(values, 1, n), F.lit(0.0), lambda a, x: a + x) / F.lit(float(n))
    tail = F.slice(values, n + 1, F.greatest(F.size(values) - n, F.lit(0)))
    return F.when(F.size(values) >= n, F.aggregate(tail, seed, lambda v, x: v + F.lit(alpha) * (x - v)))


def register_sql_functions(spark: SparkSession) -> None:
    """SQL spelling of ``smooth``: tidemark_smooth(array, n, alpha)."""
    spark.sql("""
        CREATE OR REPLACE TEMPORARY FUNCTION tidemark_smooth(vals ARRAY<DOUBLE>, n INT, alpha DOUBLE)
        RETURNS DOUBLE RETURN CASE WHEN size(vals) >= n THEN aggregate(
          slice(vals, n + 1, greatest(size(vals) - n, 0)),
          aggregate(slice(vals, 1, n), 0D, (a, x) -> a + x) / n,
          (v, x) -> v + alpha * (x - v)) END""")


def smoothing_stages(name: str, x: Column, at: Column, n: int, alpha: float, keys: list[str], order: str):
    """Column stages giving the smoothed value at every row of a run, with window sums only.

    ``at`` is the 1-based position of x in the run. The recursion v_k = (1-a) v_{k-1} + a x_k is a
    geometric weighted sum, so each block is one running sum of rescaled terms plus the decayed end
    of the block before it. Apply the returned dicts in turn.
    """
    decay, rows = 1.0 - alpha, block_rows(alpha)
    run: WindowSpec = Window.partitionBy(*keys).orderBy(order)
    off = at % rows
    seed, term, local, end = f"__{name}_seed", f"__{name}_term", f"__{name}_local", f"__{name}_end"
    block = f"__{name}_block"
    within = Window.partitionBy(*keys, block).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    first = {seed: F.avg(x).over(run.rowsBetween(-(n - 1), 0)), block: F.floor(at / rows)}
    second = {term: F.when(at == n, F.col(seed)).when(at > n, F.lit(alpha) * x) * F.pow(F.lit(decay), -off)}
    third = {local: F.pow(F.lit(decay), off) * F.sum(term).over(within)}
    fourth = {
        end: F.last(F.when(off == rows - 1, F.col(local)), ignorenulls=True).over(
            run.rowsBetween(Window.unboundedPreceding, -1)
        )
    }
    value = F.when(
        at >= n, F.coalesce(local, F.lit(0.0)) + F.pow(F.lit(decay), off + 1) * F.coalesce(end, F.lit(0.0))
    )
    return [first, second, third, fourth], value


def cost_fold(events: Column) -> Column:
    """Weighted-average cost over an ordered array of struct<side, quantity, price, fees>.

    Returns struct<shares, cost, realized>; selling the whole holding removes the whole cost.
    """
    start = F.struct(F.lit(0.0).alias("shares"), F.lit(0.0).alias("cost"), F.lit(0.0).alias("realized"))

    def step(state: Column, e: Column) -> Column:
        gross = e["quantity"] * e["price"]
        buying = e["side"] == "BUY"
        removed = F.when(e["quantity"] == state["shares"], state["cost"]).otherwise(
            state["cost"] * e["quantity"] / F.nullif(state["shares"], F.lit(0.0))
        )
        return F.struct(
            F.when(buying, state["shares"] + e["quantity"]).otherwise(state["shares"] - e["quantity"]).alias("shares"),
            F.when(buying, state["cost"] + gross + e["fees"]).otherwise(state["cost"] - removed).alias("cost"),
            F.when(buying, state["realized"]).otherwise(state["realized"] + gross - e["fees"] - removed).alias("realized"),
        )

    return F.aggregate(events, start, step)
