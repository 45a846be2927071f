"""Two-level prefix scans: running values per key without sorting a whole key in one task.

A plain window partitioned by key puts every row of a hot key in one task. Here the key's rows are
split by a block column (a month of the ordering clock, say): each (key, block) is scanned on its
own, block totals are aggregated map-side first, and only the short list of block totals is scanned
per key to carry the value across blocks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: out column -> (kind, expression); kind is one of sum, max, min, last
Specs = Mapping[str, tuple[str, Column]]


def _local(kind: str, value: Column, window) -> Column:
    if kind == "last":
        return F.last(value, ignorenulls=True).over(window)
    return {"sum": F.sum, "max": F.max, "min": F.min}[kind](value).over(window)


def _total(kind: str, value: Column, order: Sequence[str]) -> Column:
    if kind == "last":
        return F.max_by(value, F.when(value.isNotNull(), F.struct(*order)))
    return {"sum": F.sum, "max": F.max, "min": F.min}[kind](value)


def prefix_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    specs: Specs,
    inclusive: bool = False,
) -> DataFrame:
    """Adds one running column per spec; rows before (or up to, if inclusive) the current one count.

    ``order`` must be a total order within a key and ``block`` non-decreasing along it.
    """
    keys, order = list(keys), list(order)
    work = df.withColumn("__block", block)
    totals = work.groupBy(*keys, "__block").agg(
        *[_total(kind, value, order).alias(f"__t_{out}") for out, (kind, value) in specs.items()]
    )
    across = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        F.col("__block").alias("__kb"),
        *[
            _local(kind, F.col(f"__t_{out}"), across).alias(f"__c_{out}")
            for out, (kind, _) in specs.items()
        ],
    )
    upper = 0 if inclusive else -1
    within = (
        Window.partitionBy(*keys, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, upper)
    )
    local = work.select(
        "*", *[_local(kind, value, within).alias(f"__l_{out}") for out, (kind, value) in specs.items()]
    )
    matched = F.col("__block") == F.col("__kb")
    for key in keys:
        matched = matched & F.col(key).eqNullSafe(F.col(f"__k_{key}"))
    joined = local.join(carry, matched, "left")

    def combine(out: str, kind: str) -> Column:
        here, before = F.col(f"__l_{out}"), F.col(f"__c_{out}")
        if kind == "sum":
            return F.when(here.isNull() & before.isNull(), F.lit(None)).otherwise(
                F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0))
            )
        if kind == "max":
            return F.greatest(here, before)
        if kind == "min":
            return F.least(here, before)
        return F.coalesce(here, before)

    return joined.select(*df.columns, *[combine(out, kind).alias(out) for out, (kind, _) in specs.items()])


def window_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, specs: Specs, inclusive: bool = False) -> DataFrame:
    """What prefix_scan adds, by one window per key: for keys of bounded length that are already in one partition."""
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return df.select(*df.columns, *[_local(kind, value, within).alias(out) for out, (kind, value) in specs.items()])


def asof_lookup(
    probes: DataFrame,
    facts: DataFrame,
    keys: Sequence[str],
    probe_at: str,
    fact_at: str,
    payload: Sequence[str],
    block: str = "month",
) -> DataFrame:
    """Backward as-of join: each probe gets the payload of the last fact at or before its instant.

    Sort-merge over the union of both sides, so the work is linear in rows; no pair of a key's
    probes and facts is ever enumerated, and a hot key is split by calendar block.
    ``fact_at`` must be unique per key.
    """
    left = probes.select(
        *[F.col(k) for k in keys],
        F.col(probe_at).alias("__at"),
        F.lit(1).alias("__side"),
        F.struct(*probes.columns).alias("__probe"),
        F.lit(None).cast(facts.select(F.struct(fact_at, *payload).alias("f")).schema["f"].dataType).alias("__fact"),
    )
    right = facts.select(
        *[F.col(k) for k in keys],
        F.col(fact_at).alias("__at"),
        F.lit(0).alias("__side"),
        F.lit(None).cast(left.schema["__probe"].dataType).alias("__probe"),
        F.struct(fact_at, *payload).alias("__fact"),
    )
    merged = left.unionByName(right)
    scanned = prefix_scan(
        merged,
        keys,
        ["__at", "__side"],
        F.date_trunc(block, F.col("__at")),
        {"__hit": ("last", F.col("__fact"))},
        inclusive=True,
    )
    return scanned.where(F.col("__side") == 1).select(
        "__probe.*", *[F.col(f"__hit.{c}").alias(c) for c in (fact_at, *payload) if c not in probes.columns]
    )


def ordered_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], schema: str, start, step):
    """Order-dependent fold for state machines that no prefix scan expresses.

    Rows are hash-partitioned by ``keys`` and sorted inside the task, then streamed through
    ``step(state, row) -> (state, output tuple)`` in Arrow batches: memory stays constant however
    long one key is, because no group is ever materialised. ``start(key) -> state``.
    """
    import pandas as pd

    keys, order = list(keys), list(order)
    columns = df.columns
    positions = [columns.index(k) for k in keys]
    names = [f.name for f in df.sparkSession.createDataFrame([], schema).schema.fields]

    def run(batches):
        current, state = None, None
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False, name=None):
                key = tuple(row[i] for i in positions)
                if key != current:
                    current, state = key, start(key)
                state, emitted = step(state, row)
                out.append(emitted)
            if out:
                yield pd.DataFrame(out, columns=names, dtype=object)

    arranged = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return arranged.mapInPandas(run, schema)
