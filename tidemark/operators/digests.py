"""Ordered digests of large sets, as hash trees.

Members in order are cut into blocks of a fixed number, a block's digest is that of its members' digests side by side,
and so on for three levels. Places come from counts over ranges of the order, so no task holds more than one block, and
the digest hangs on members and their order alone, never on how rows were partitioned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scan import prefix_scan
from tidemark.session import cut_lineage

#: Children of a node of the tree, and its levels: 4,096 ** 3 members a key.
ARITY, LEVELS = 4_096, 3


def member_text(columns: Sequence[str]) -> Column:
    """Canonical text of a row: its columns as a JSON array of strings, nulls as null."""
    return F.to_json(F.array(*[F.col(c).cast("string") for c in columns]))


def ordered_digest(members: DataFrame, keys: Sequence[str], order: Sequence[str], fields: Sequence[str] | None = None, name: str = "digest") -> DataFrame:
    """(keys, name, members): one digest per key over its rows in order.

    Rows equal in ``order`` follow each other by their content, so they need no total order. ``fields`` are the columns
    that count (all but the keys, sorted by name, unless given).
    """
    keys, order = list(keys), list(order)
    fields = sorted(c for c in members.columns if c not in keys) if fields is None else list(fields)
    leaves = members.select(*keys, *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], F.sha2(member_text(fields), 256).alias("__leaf"))
    along = [f"__o{i}" for i in range(len(order))] + ["__leaf"]
    ranged = cut_lineage(leaves.repartitionByRange(*keys, *along).withColumn("__range", F.spark_partition_id()))
    placed = prefix_scan(ranged, keys, along, F.col("__range"), {"__place": ("sum", F.lit(1).cast("long"))})
    level = placed.select(*keys, F.coalesce("__place", F.lit(0).cast("long")).alias("__place"), "__leaf")
    counted = ranged.groupBy(*keys).agg(F.count("*").alias("members"))
    for _ in range(LEVELS):
        block = F.floor(F.col("__place") / ARITY)
        side = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__place", "__leaf"))), lambda x: x["__leaf"]), "")  # at most ARITY of them
        level = level.groupBy(*keys, block.alias("__block")).agg(F.sha2(side, 256).alias("__leaf")).withColumnRenamed("__block", "__place")
    root = level.select(*[F.col(k).alias(f"__k_{k}") for k in keys], "__leaf")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    joined = counted.join(root, same) if keys else counted.join(root)  # without keys one row each
    return joined.select(*keys, F.sha2(F.concat_ws("|", F.col("members").cast("string"), "__leaf"), 256).alias(name), "members")
