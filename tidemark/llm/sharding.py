"""Balanced shards by label propagation under capacity quotas.

Rows that share the value of a link column are neighbours. Rows with the same links form a class, and rows of a class
in one shard are counted, not listed: moves are numbers of rows of a class that go from one shard to another. Every
round joins classes with the counts of their links by shard, lets each part of a class ask for the shard where most of
its neighbours are, and admits moves, those of the largest gain first, as far as quotas between each pair of shards
let them. Rows without neighbours cut nothing; they fill the shards up to their capacity in the end.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import written
from tidemark.operators.scan import prefix_scan

SHARDS, ROUNDS, POOR = 16, 12, 3
#: Quotas are a table of shards x shards numbers on the driver; this bounds it.
MOST_SHARDS = 256
#: Rows or classes that one running sum, or one sort of a class, takes on its own.
PART_ROWS = 8_192


def _digest(value: Column) -> Column:
    return F.unhex(F.sha2(value.cast("string"), 256))


def _leading(digest: str, rows: int) -> tuple[Column, int]:
    """Leading bits of a digest, so that about PART_ROWS of so many rows share them, and how many bits."""
    bits = max(0, math.ceil(math.log2(max(1, rows) / PART_ROWS)))
    whole = F.conv(F.hex(F.substring(digest, 1, 7)), 16, 10).cast("long")
    return (F.shiftright(whole, 56 - bits) if bits else F.lit(0).cast("long")), bits


def _constant(values: Sequence[int]) -> Column:
    """An array literal of long values."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _by_link(state: DataFrame, key: str) -> DataFrame:
    """(key, map of shard -> rows): one entry a shard at most."""
    counts = state.where(F.col(key).isNotNull()).groupBy(key, "shard").agg(F.sum("n").alias("n"))
    return counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("shard", "n"))).alias(f"by_{key}"))


def together(state: DataFrame, keys: Sequence[str]) -> float:
    """Linked pairs of rows that share a shard, over all link columns."""
    parts = [state.where(F.col(k).isNotNull()).groupBy(k, "shard").agg(F.sum("n").cast("double").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs")) for k in keys]
    return reduce(DataFrame.unionByName, parts).agg(F.coalesce(F.sum("pairs"), F.lit(0.0))).first()[0]


def quotas(wanted: dict[tuple[int, int, int], int], held: list[int], room: list[int]) -> dict[tuple[int, int, int], int]:
    """How many rows may go from shard to shard (by kind of move) so that none ends above its capacity.

    All moves are let in first. A shard that would end above its capacity takes fewer, its inflows giving way in
    proportion; those who stay behind count against their own shard, until all fit. Inflows only fall, so this ends.
    """
    moves = dict(wanted)
    while True:
        over = [held[t] + sum(n for p, n in moves.items() if p[1] == t) - sum(n for p, n in moves.items() if p[0] == t) - room[t] for t in range(len(held))]
        if max(over) <= 0:
            return moves
        for t, excess in enumerate(over):
            inflows = sorted((p for p in moves if p[1] == t and moves[p]), key=lambda p: (-moves[p], p))
            total = sum(moves[p] for p in inflows)
            excess = left = max(0, min(excess, total))
            for p in inflows:
                less = min(moves[p], -(-excess * moves[p] // total), left)
                moves[p], left = moves[p] - less, left - less


def _asking(state: DataFrame, keys: Sequence[str], shards: int, capacity: int, turned: dict[tuple[int, int], int], turn: int) -> DataFrame:
    """Parts of classes with the shard they want, what the move gains and its kind; only those that want another one.

    Kind 0 asks. The homes of a class are the shards with most of its neighbours, as many as its neighbours fill. Rows
    in a home stay; the others ask for the homes in equal parts. Kind 1 yields: a class that has all its neighbours with
    it loses nothing by moving, and goes where rows come from that its shard has turned away.
    """
    joined = state
    for key in keys:
        joined = joined.join(_by_link(state, key), key, "left")
    near = lambda t: reduce(Column.__add__, [F.coalesce(F.try_element_at(f"by_{k}", t), F.lit(0).cast("long")) for k in keys])
    # Ties hang on the link and the round alone, so that all ends of a link choose the same, and another one if that is full.
    tie = lambda t: F.xxhash64(F.coalesce(*keys, F.col("class")), (t + F.lit(1000 * turn)).cast("int"))
    every = F.sequence(F.lit(0), F.lit(shards - 1))
    ranked = F.sort_array(F.transform(every, lambda t: F.struct(near(t).alias("near"), tie(t).alias("tie"), t.alias("shard"))), asc=False)
    all_near = F.aggregate(every, F.lit(0).cast("long"), lambda a, t: a + near(t))
    homed = joined.withColumn("whole", all_near).withColumn("here", near(F.col("shard"))).withColumn("homes", F.slice(ranked, 1, F.greatest(F.ceil(F.col("whole") / capacity).cast("int"), F.lit(1))))
    at_home = F.exists("homes", lambda h: h["shard"] == F.col("shard"))
    # The i-th of m homes is asked by every m-th row.
    asks = homed.where(~at_home).select("*", F.posexplode("homes").alias("i", "home")).withColumn("n", F.floor((F.col("n") + F.size("homes") - 1 - F.col("i")) / F.size("homes"))).where("n > 0")
    columns = ["class", *keys, "shard", "n"]
    asks = asks.select(*columns, F.col("home.shard").alias("want"), F.greatest(F.col("home.near") - F.col("here"), F.lit(0)).alias("gain"), F.lit(0).alias("kind"))
    if not turned:
        return asks
    table = _constant([turned.get((s, t), 0) for t in range(shards) for s in range(shards)])
    waiting = F.filter(every, lambda s: F.get(table, (F.col("shard") * shards + s).cast("int")) > 0)
    to = F.array_max(F.transform(waiting, lambda s: F.struct(tie(s).alias("tie"), s.alias("shard"))))["shard"]
    yields = homed.where(at_home & (F.col("here") == F.col("whole"))).withColumn("to", to).where("to IS NOT NULL")
    return asks.unionByName(yields.select(*columns, F.col("to").alias("want"), F.lit(0).cast("long").alias("gain"), F.lit(1).alias("kind")))


def propagate(state: DataFrame, keys: Sequence[str], room: list[int], rounds: int = ROUNDS) -> tuple[DataFrame, list[int]]:
    """(class, keys, shard, n) after label propagation, and the rows that each shard then holds.

    The state with most linked pairs together is the result; POOR rounds without a better one, or one in which nobody
    asks, end the search. The driver holds numbers by pairs of shards only.
    """
    shards = len(room)
    columns = ["class", *keys, "shard", "n"]

    def holding(s: DataFrame) -> list[int]:
        found = dict(s.groupBy("shard").agg(F.sum("n")).collect())
        return [found.get(t, 0) for t in range(shards)]

    held, turned, poor = holding(state), {}, 0
    best, score = (state, held), together(state, keys)
    for turn in range(rounds):
        asking = written(_asking(state, keys, shards, max(1, sum(room) // shards), turned, turn), "shard-asking")
        wanted = {(r[0], r[1], r[2]): r[3] for r in asking.groupBy("shard", "want", "kind").agg(F.sum("n")).collect()}
        if not any(kind == 0 for _, _, kind in wanted):
            break
        wanted = {(s, t, kind): min(n, turned[t, s]) if kind else n for (s, t, kind), n in wanted.items()}
        moves = quotas(wanted, held, room)
        part, bits = _leading("class", asking.count())
        level = F.lit(63) - F.floor(F.log2(F.col("gain") + 1))
        ranked = prefix_scan(asking.withColumn("level", level), ["shard", "want", "kind"], ["level", "class"], F.shiftleft(F.col("level"), bits) + part, {"before": ("sum", F.col("n"))})
        table = _constant([moves.get((s, t, kind), 0) for kind in (0, 1) for s in range(shards) for t in range(shards)])
        quota = F.get(table, ((F.col("kind") * shards + F.col("shard")) * shards + F.col("want")).cast("int"))
        admitted = ranked.withColumn("n", F.least("n", F.greatest(F.lit(0), quota - F.coalesce("before", F.lit(0))))).where("n > 0")
        after = state.select(*columns).unionByName(admitted.withColumn("n", -F.col("n")).select(*columns)).unionByName(admitted.withColumn("shard", F.col("want")).select(*columns))
        state = written(after.groupBy("class", *keys, "shard").agg(F.sum("n").alias("n")).where("n > 0"), "shard-state")
        held = holding(state)
        turned = {(s, t): n - moves[s, t, 0] for (s, t, kind), n in wanted.items() if kind == 0 and n > moves[s, t, 0]}
        now = together(state, keys)
        poor = 0 if now > score else poor + 1
        if now > score:
            best, score = (state, held), now
        if poor == POOR:
            break
    return best


def balanced_shards(docs: DataFrame, links: Sequence[Column] | None = None, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): one row per input row; shards differ by one row at most.

    ``docs`` needs doc_id and text; other columns are read only through ``links``, the columns whose equal values link
    rows (the text, unless given). ``size`` is the UTF-8 length of the text plus 1 and ``slot`` numbers a shard's rows
    from 0 without gaps, linked rows of a class side by side. A null text is an empty one; a null link links nothing,
    and a null doc_id is a value like others. Rows repeated with the same id and text are rows of their own, alike.
    Texts count whole, whatever their length. Ties are settled by hashes of the links. An empty table gives none.

    A class with very many rows is cut into parts by a hash of its rows, and only (class, part) counts, (class, shard)
    counts and tables of shards x shards numbers take part in the search.
    """
    if not 1 <= shards <= MOST_SHARDS:
        raise ValueError(f"from 1 to {MOST_SHARDS} shards")
    text = F.coalesce("text", F.lit(""))
    links = [text] if links is None else list(links)
    keys = [f"key{i}" for i in range(len(links))]
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *[_digest(x).alias(k) for x, k in zip(links, keys)])
    whole = F.col(keys[0]) if len(keys) == 1 else _digest(F.concat_ws("/", *[F.coalesce(F.hex(k), F.lit("-")) for k in keys]))
    rows = written(rows.withColumn("class", F.coalesce(whole, _digest(F.lit("")))), "shard-rows")
    number = rows.count()
    room = [number // shards + (t < number % shards) for t in range(shards)]

    parts = max(1, number // PART_ROWS)
    part = F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(parts))
    in_class = Window.partitionBy("class")
    counted = rows.groupBy("class", *keys, part.alias("part")).agg(F.count("*").alias("n"))
    counted = counted.withColumn("rows", F.sum("n").over(in_class)).withColumn("offset", F.sum("n").over(in_class.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    if len(keys) == 1:
        counted = counted.withColumn("linked", F.col(keys[0]).isNotNull() & (F.col("rows") > 1))
    else:
        counted = written(counted, "shard-counted")
        for key in keys:
            many = counted.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum("n").alias(f"all_{key}")).where(f"all_{key} > 1")
            counted = counted.join(many, key, "left")
        counted = counted.withColumn("linked", F.coalesce(*[F.col(f"all_{k}") for k in keys]).isNotNull())
    counted = written(counted.select("class", *keys, "part", "n", "rows", F.coalesce("offset", F.lit(0)).alias("offset"), "linked"), "shard-parts")

    # Linked rows begin dealt out in turn, so that no shard starts above its capacity.
    classes = written(counted.where("linked").groupBy("class", *keys).agg(F.first("rows").alias("rows")), "shard-classes")
    block, _ = _leading("class", many := classes.count())
    dealt = prefix_scan(classes, [], ["class"], block, {"before": ("sum", F.col("rows"))}).withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("rows"), F.lit(shards)) - 1)))
    state = dealt.select("class", *keys, ((F.coalesce("before", F.lit(0)) + F.col("turn")) % shards).cast("int").alias("shard"), (F.floor(F.col("rows") / shards) + (F.col("turn") < F.col("rows") % shards).cast("long")).alias("n"))
    state, held = propagate(written(state, "shard-state"), keys, room, rounds)

    # Which ranks of a class go where, and where in the shard its rows begin.
    block, _ = _leading("class", many)
    placed = prefix_scan(state.select("class", "shard", "n"), ["shard"], ["class"], block, {"begin": ("sum", F.col("n"))})
    upto = F.sum("n").over(in_class.orderBy("shard"))
    runs = placed.select("class", F.struct((upto - F.col("n")).alias("low"), upto.alias("high"), "shard", F.coalesce("begin", F.lit(0).cast("long")).alias("begin")).alias("run"))
    plans = runs.groupBy("class").agg(F.array_sort(F.collect_list("run")).alias("plan"))
    linked = counted.where("linked").select("class", "part", "offset").join(plans, "class")
    alone = counted.where("NOT linked").select("class", "part", "n")
    block, _ = _leading("class", number)
    free = prefix_scan(alone, [], ["class", "part"], block, {"offset": ("sum", F.col("n"))}).select("class", "part", F.coalesce("offset", F.lit(0).cast("long")).alias("offset"), F.lit(None).cast(plans.schema["plan"].dataType).alias("plan"))

    pieces = linked.select("class", "part", "offset", "plan").unionByName(free)
    left, low, fill = 0, [], []
    for t in range(shards):
        low.append(left)
        left += room[t] - held[t]
        fill.append(left)
    lows, highs, begins = _constant(low), _constant(fill), _constant(held)
    at = lambda a: lambda t: F.get(a, t)
    spare = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda t: F.struct(at(lows)(t).alias("low"), at(highs)(t).alias("high"), t.alias("shard"), at(begins)(t).alias("begin")))
    order = Window.partitionBy("class", "part").orderBy("doc_id", "size", "text_crc32")
    ranked = rows.withColumn("part", part).join(pieces, ["class", "part"]).withColumn("rank", F.col("offset") + F.row_number().over(order) - 1)
    run = F.get(F.filter(F.coalesce("plan", spare), lambda p: (p["low"] <= F.col("rank")) & (F.col("rank") < p["high"])), F.lit(0))
    return ranked.withColumn("run", run).select("doc_id", "size", "text_crc32", F.col("run.shard").alias("shard"), (F.col("run.begin") + F.col("rank") - F.col("run.low")).alias("slot"))
