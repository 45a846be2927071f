"""Mixing sources to target weights by a low-discrepancy schedule.

The n-th slot of the mix takes the point frac(n * golden ratio) and gives it to the source whose part of
the cumulative weights holds it, so that every stretch of the mix has the sources in proportion. A source's
documents are shuffled by a keyed hash and laid end to end; the line is cut into blocks of equal tokens, and
the r-th slot of a source takes its r-th block, beginning anew after the last one.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import is_under, written
from tidemark.operators.scan import prefix_scan

WORD = r"[^\x20\x09-\x0D]+"
#: Tokens of a block. A source's count of slots is off by a few at most, so its tokens are by a few blocks.
BLOCK = 64
SHARE, LIMIT = 1.5, 2.0
WEIGHTS = (5.0, 2.0, 1.0)
GOLDEN = 0.6180339887498949
#: Documents or slots that one running sum takes on its own; longer lines are cut into such parts.
PART_ROWS = 8_192
#: Cells of the unit interval by which points find their source.
CELLS = 1024
#: Rows of sources and their cells up to which the table is broadcast; a larger one joins by shuffle on the cell.
HELD_SOURCES = 100_000


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words) and the place in the shuffled line, from the hash of doc_id and text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.md5(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text))).alias("place")
    )


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """(source, source_size, target): one row per source.

    Sources by code point, null last, take the weights in turn. Targets add up to ``share`` of all sizes, as far as
    ``limit`` times each source's size lets them: what is above is dealt again by weight until none is. With sources
    sorted by size over weight, those below some rank are at their limit and the others share the rest by weight.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rows = by_source.withColumn("weight", weight).withColumn("ratio", limit * F.col("source_size") / F.col("weight"))
    everything = Window.partitionBy()
    fill = Window.orderBy("ratio", F.col("source").isNull(), F.col("source").cast("binary"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    filled = (
        rows.withColumn("total", share * F.sum("source_size").over(everything))
        .withColumn("left", F.col("total") - limit * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("heavy", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("heavy"))
        .withColumn("free", F.col("ratio") > F.col("level"))
        .withColumn("rate", F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, 0)))
    )
    target = F.when(F.col("rate").isNull(), limit * F.col("source_size")).otherwise(F.col("rate") * F.col("weight"))
    return filled.select("source", "source_size", target.cast("double").alias("target"))


def lined(sized: DataFrame) -> DataFrame:
    """Adds ``begin``: the tokens before a document in its source's shuffled line.

    The line is cut by leading bits of the hash into parts of about PART_ROWS documents, so that no source is summed in one task.
    """
    bits = max(0, math.ceil(math.log2(max(1, sized.count()) / PART_ROWS)))
    part = F.shiftright(F.conv(F.substring("place", 1, 15), 16, 10).cast("long"), 60 - bits) if bits else F.lit(0).cast("long")
    return prefix_scan(sized, ["source"], ["place"], part, {"__before": ("sum", F.col("size"))}).withColumn("begin", F.coalesce("__before", F.lit(0)).cast("long")).drop("__before")


def cut(targeted: DataFrame, block: int = BLOCK) -> DataFrame:
    """Sources with words: a number (sid), their blocks, the slots wanted, and the part [low, high) of the points."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    rows = targeted.where("source_size > 0").withColumn("sid", F.row_number().over(order)).withColumn("blocks", F.ceil(F.col("source_size") / block))
    rows = rows.withColumn("wanted", F.col("target") / (F.col("source_size") / F.col("blocks")))
    upto = F.sum("wanted").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("wanted").over(Window.partitionBy())
    rows = rows.withColumn("high", F.when(F.lead("sid").over(Window.orderBy("sid")).isNull(), F.lit(1.0)).otherwise(upto))
    return rows.withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("sid")), F.lit(0.0)))


def slots(sources: DataFrame, limit: float = LIMIT) -> DataFrame:
    """(slot, sid, turn, block): the schedule. ``turn`` counts a source's slots; those beyond ``limit`` rounds of its blocks are void."""
    number = sources.agg(F.coalesce(F.sum("wanted"), F.lit(0.0))).first()[0]
    every = sources.sparkSession.range(math.ceil(number)).select(F.col("id").alias("slot"), (F.col("id") * GOLDEN - F.floor(F.col("id") * GOLDEN)).alias("point"))
    every = every.withColumn("cell", F.floor(F.col("point") * CELLS))
    # A source meets only the cells of the unit interval that it reaches into.
    reach = sources.select("sid", "blocks", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.floor(F.col("high") * CELLS))).alias("cell"))
    if is_under(reach, HELD_SOURCES):
        reach = F.broadcast(reach)
    dealt = every.join(reach, "cell").where((F.col("low") <= F.col("point")) & (F.col("point") < F.col("high"))).select("slot", "sid", "blocks")
    counted = prefix_scan(dealt, ["sid"], ["slot"], F.floor(F.col("slot") / PART_ROWS), {"__turn": ("sum", F.lit(1).cast("long"))})
    turned = counted.withColumn("turn", F.coalesce("__turn", F.lit(0)).cast("long")).where(F.col("turn") < limit * F.col("blocks"))
    return turned.select("slot", "sid", "turn", (F.col("turn") % F.col("blocks")).alias("block"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The schedule and the documents it draws from.

    Schedule: (slot, source, doc_id, sid, begin, first_word, stop_word), the words of a document that a slot takes, in
    the order of slots. Documents: one row per input row, (doc_id, source, size, source_size, target, sid, begin).

    ``docs`` needs doc_id, text and source; other columns are not read. A null text has size 0; so has one without
    words, and such documents are in no block. A null source is a source of its own, the last. Equal rows are documents
    of their own, next to each other in the line. An empty table, or one without words, gives an empty schedule.
    The order rests on hashes of doc_id and text alone, so that reruns and repeated tasks agree.
    """
    sized = written(sizes(docs), "mix-sizes")
    targeted = written(targets(sized, weights, share, limit), "mix-targets")
    sources = written(cut(targeted, block), "mix-sources")
    same = F.col("source").eqNullSafe(F.col("__source"))
    known = targeted.join(sources.select(F.col("source").alias("__of"), "sid"), F.col("source").eqNullSafe(F.col("__of")), "left").select(F.col("source").alias("__source"), "source_size", "target", "sid")
    members = written(lined(sized).join(known, same, "left").drop("__source", "place"), "mix-line")
    pieces = members.where("size > 0").select(
        "doc_id", "source", "sid", "begin", "size", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("begin") + F.col("size") - 1) / block))).alias("block")
    )
    drawn = slots(sources, limit).join(pieces, ["sid", "block"])
    first, stop = F.greatest(F.col("block") * block, F.col("begin")), F.least((F.col("block") + 1) * block, F.col("begin") + F.col("size"))
    return drawn.select("slot", "source", "doc_id", "sid", "begin", (first - F.col("begin")).alias("first_word"), (stop - F.col("begin")).alias("stop_word")), members


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT, block: int = BLOCK) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target and the words that the mix takes, repeats counted."""
    schedule, members = mix(docs, weights, share, limit, block)
    # A source and a place in its line are one document, also where rows are equal.
    taken = schedule.groupBy(F.col("sid").alias("__sid"), F.col("begin").alias("__begin")).agg(F.sum(F.col("stop_word") - F.col("first_word")).alias("taken"))
    both = members.join(taken, (F.col("sid") == F.col("__sid")) & (F.col("begin") == F.col("__begin")) & (F.col("size") > 0), "left")
    return both.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
