"""Benchmark decontamination by templates: finds items also where their numbers, names or units were exchanged.

Words are canonical: lower case without marks around them, with numbers, units after numbers, and names (capitals inside
a sentence) replaced by typed placeholders. Windows of canonical words of the items meet those of the documents in a hash
join; hits on one diagonal and on diagonals a few words apart are gathered, and a document's slots must fill an item's slots consistently: wherever the
item repeats a value, the document does too. Beside the canonical words stand two other forms: without names, and as
plain words in lower case, so that a verbatim item is found whatever its capitals and however many slots it has.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import is_under, text_bytes, written

#: Canonical words of a window; items of fewer words have one window of all their words.
SIZE = 8
#: Items of fewer words are searched for as plain words alone: a template of so few words stands anywhere.
LEAST_ITEM = 4
#: Item windows up to which tasks hold their hashes to pass on only windows that can join; beyond it all windows are passed on.
HELD_WINDOWS = 2_000_000
#: Words by which a window is told from the benchmark's before the rest is hashed, and places of the table of these.
LEAD, LEADS = 2, 1 << 22
#: A pair counts from this share of the item's words, or from this number of words side by side.
COVERAGE, RUN = 0.5, 13
#: Diagonals are gathered up to so many words apart, and up to this share of the item's words, so that two copies side by side stay two.
NEAR, NEAR_SHARE = 8, 0.25
#: Share of the item's slot values that must be filled with one value each.
CONSISTENT = 0.9
KEPT_WORDS = 400_000

# Units that follow numbers, and number words.
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg lb lbs ounce ounces oz pound pounds ton tons ml l liter liters litre litres gallon gallons cup cups s sec second seconds min minute "
    "minutes h hour hours day days week weeks month months year years cent cents dollar dollars euro euros usd eur gbp percent pct degree degrees celsius fahrenheit mph kmh hz khz mhz ghz w kw kwh v volt volts kb mb gb tb"
).split()
NUMBER_WORDS = (
    "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
).split()

WORD, NUMBER, UNIT, CAPITAL, NONE = range(5)
#: Codes of placeholders, by kind.
SLOT_CODES = {NUMBER: 1, UNIT: 2, CAPITAL: 3}
WINDOW_SCHEMA = "content long, pos int, window long, slots array<string>"


class _Words(dict):
    """Numbers of words as they stand in texts; what is known of a word is in arrays by its number."""

    def __init__(self):
        import re

        self.edge = re.compile(r"^[\W_]+|[\W_]+$")
        self.number = re.compile(r"^\d[\d.,:/]*(?:st|nd|rd|th|[a-z]{1,3})?$")
        self.units, self.numbers = frozenset(UNITS), frozenset(NUMBER_WORDS)
        self.clear()

    def clear(self) -> None:
        import numpy as np

        super().clear()
        self.kind, self.code, self.closes = np.zeros(1024, dtype=np.int8), np.zeros(1024, dtype=np.uint64), np.zeros(1024, dtype=bool)
        self.value: list[str] = []

    def __missing__(self, raw: bytes) -> int:
        import numpy as np
        import xxhash

        text = raw.decode("utf-8", "replace")
        # Most words are plain letters; only others need the patterns.
        core, tail = text, ""
        if not text.isalnum():
            core = self.edge.sub("", text)
            tail = text[len(text.rstrip("\"')]}*#$%&!?.")) :]
        value = core.lower()
        if not core:
            kind = NONE
        elif value in self.numbers or "0" <= value[0] <= "9" and self.number.match(value):
            kind = NUMBER
        elif value in self.units:
            kind = UNIT
        elif core[0].isupper() and not core.isupper():
            kind = CAPITAL
        else:
            kind = WORD
        self[raw] = place = len(self.value)
        if place == len(self.kind):
            self.kind, self.code, self.closes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.kind, self.code, self.closes))
        self.kind[place], self.code[place] = kind, xxhash.xxh3_64_intdigest(value.encode()) >> 1 | 8
        self.closes[place] = raw == LINE or tail != "" and ("." in tail or "!" in tail or "?" in tail)
        self.value.append(value)
        return place


#: Stands for the end of a line among the words.
LINE = b"\x00"


def canonical(text: bytes | None, words: _Words):
    """Codes, slot kinds (WORD where there is none), numbers of words, codes without placeholders and starts of sentences of a text's canonical words."""
    import numpy as np

    if len(words) > KEPT_WORDS:
        words.clear()
    found = (text or b"").replace(b"\n", b" \x00 ").split()
    ids = np.fromiter(map(words.__getitem__, found), dtype=np.int64, count=len(found))
    kind, code = words.kind[ids], words.code[ids]
    starts = np.ones(len(ids), dtype=bool)
    starts[1:] = words.closes[ids][:-1]
    # Marks and empty lines between words hand on the start of a sentence.
    keep = kind != NONE
    if not keep.all():
        group = np.cumsum(keep)
        opened = np.zeros(len(ids) + 1, dtype=bool)
        np.logical_or.at(opened, np.where(keep, group - 1, group), starts)
        kind, code, ids = kind[keep], code[keep], ids[keep]
        starts = opened[: len(ids)]
    capital = kind == CAPITAL
    if capital.any():
        # A capital at the start of a sentence is a name only if the word has one inside a sentence too.
        first, inner = capital & starts, capital & ~starts
        kind[first & ~np.isin(code, code[inner])] = WORD
    unit = np.flatnonzero(kind == UNIT)
    kind[unit[(unit == 0) | (kind[unit - 1] != NUMBER)]] = WORD
    plain = code
    if kind.any():
        plain = code.copy()
        for k, placeholder in SLOT_CODES.items():
            code[kind == k] = placeholder
    return code, kind, ids, plain, starts


class Form(NamedTuple):
    """A form of a text: canonical, without names, or plain. Neighbouring slots of one kind are one slot."""

    code: Any
    kind: Any
    #: Slots that stand as plain words, if there are any.
    lost: Any
    #: First words of the form's places, and the end of the last.
    edge: Any

    def filled(self, at: int, size: int, words: _Words, ids) -> list[str]:
        """The values of the slots of a window."""
        return [" ".join(words.value[x] for x in ids[self.edge[i] : self.edge[i + 1]]) for i in range(at, at + size) if self.kind[i] != WORD]


def _merged(code, kind, lost, starts) -> Form:
    import numpy as np

    first = np.ones(len(code), dtype=bool)
    first[1:] = (kind[1:] == WORD) | (kind[1:] != kind[:-1]) | starts[1:]
    edge = np.append(np.flatnonzero(first), len(code))
    if len(edge) > len(code):
        return Form(code, kind, lost, edge)
    return Form(code[first], kind[first], None if lost is None else lost[first], edge)


def forms(code, kind, plain, starts) -> list[Form]:
    import numpy as np

    out = [_merged(code, kind, None, starts)]
    slot = kind != WORD
    if slot.any():
        capital = kind == CAPITAL
        if capital.any() and (slot & ~capital).any():
            out.append(_merged(np.where(capital, plain, code), np.where(capital, WORD, kind), capital, starts))
        out.append(_merged(plain, np.zeros_like(kind), slot, starts))
    return out


def _within(mask, size: int):
    """How many of each window of ``size`` words are marked."""
    import numpy as np

    upto = np.concatenate([[0], np.cumsum(mask)])
    return upto[size:] - upto[:-size]


def _mix(mixed, code):
    import numpy as np

    mixed = (mixed ^ code) * np.uint64(0x9E3779B97F4A7C15)
    return mixed ^ (mixed >> np.uint64(29))


def leads(form, at, size: int):
    """Places in a table of LEADS of the first words of a form's windows."""
    import numpy as np

    with np.errstate(over="ignore"):
        mixed = np.full(len(at), size, dtype=np.uint64)
        for i in range(min(LEAD, size)):
            mixed = _mix(mixed, form.code[at + i])
    return _place(mixed)


def _place(mixed):
    import numpy as np

    return (mixed >> np.uint64(64 - LEADS.bit_length() + 1)).astype(np.int64)


def windows(form, size: int, first=None, lead=None):
    """(positions, hashes) of a form's windows of ``size`` words of which half at least are no placeholders.

    Windows without a lost slot are those of an earlier form and left out. With ``first`` (codes of first words) only
    windows that start with a name are made. With ``lead`` only those whose first words stand in that table are hashed on.
    """
    import numpy as np

    code, kind, lost, _ = form
    n = len(code) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    able = None
    if first is not None:
        able = kind[:n] == CAPITAL
    elif lost is not None:
        able = _within(lost, size) > 0
    at = np.arange(n) if able is None else np.flatnonzero(able)
    with np.errstate(over="ignore"):
        mixed = np.full(len(at), size, dtype=np.uint64)
        for i in range(size):
            source = first if i == 0 and first is not None else code
            mixed = _mix(mixed, source[i : n + i] if len(at) == n else source[at + i])
            if lead is not None and i == min(LEAD, size) - 1:
                known = lead[_place(mixed)]
                at, mixed = at[known], mixed[known]
                if not len(at):
                    break
        mixed = mixed * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
    if kind.any() and len(at):
        # Half of the words at least must be no placeholders, and a form without names must have a slot left.
        upto = np.concatenate([[0], np.cumsum(kind != WORD)])
        slots = upto[at + size] - upto[at]
        able = 2 * slots <= size
        if lost is not None:
            able &= slots > 0
        at, mixed = at[able], mixed[able]
    return at, mixed.view(np.int64)


def item_windows(benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """(item_id, item_words, width, item_pos, item_end, window, lead, item_slots, at_edge, kept_slots).

    at_edge marks slots that begin or end the item; kept_slots are the values of slots that stand as plain words.

    Items under LEAST_ITEM words have their plain form alone.
    """
    kind_of_id = benchmark.schema["item_id"].dataType.simpleString()

    def run(batches) -> Iterator:
        import pyarrow as pa

        words = _Words()
        for batch in batches:
            out = {n: [] for n in ("item_id", "item_words", "width", "item_pos", "item_end", "window", "lead", "item_slots", "at_edge", "kept_slots")}
            for item, text in zip(batch.column(0).to_pylist(), text_bytes(batch), strict=True):
                code, kind, ids, plain, starts = canonical(text, words)
                if not len(code):
                    continue
                short = len(code) < LEAST_ITEM and kind.any()
                for form in forms(code, kind, plain, starts)[-1 if short else 0 :]:
                    width, last = min(size, len(form.code)), len(form.code) - 1
                    places, values = windows(form, width)
                    for at, value, lead in zip(places.tolist(), values.tolist(), leads(form, places, width).tolist(), strict=True):
                        slots = form.filled(at, width, words, ids)
                        edges = [i in (0, last) for i in range(at, at + width) if form.kind[i] != WORD]
                        pos, end = int(form.edge[at]), int(form.edge[at + width])
                        same = [words.value[ids[form.edge[i]]] for i in range(at, at + width) if form.kind[i] == WORD != kind[form.edge[i]]]
                        for name, v in zip(out, (item, len(code), width, pos, end, value, lead, slots, edges, same), strict=True):
                            out[name].append(v)
            kinds = (batch.column(0).type, *[pa.int32()] * 4, pa.int64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.bool_()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))

    schema = f"item_id {kind_of_id}, item_words int, width int, item_pos int, item_end int, window long, lead int, item_slots array<string>, at_edge array<boolean>, kept_slots array<string>"
    return benchmark.select("item_id", "text").mapInArrow(run, schema)


def document_windows(docs: DataFrame, widths: list[int], held) -> DataFrame:
    """doc_id and WINDOW_SCHEMA; with ``held`` (sorted hashes, table of leads) only windows that are among them."""
    kind_of_id = docs.schema["doc_id"].dataType.simpleString()

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        words = _Words()
        for batch in batches:
            rows, out = [], ([], [], [], [])
            for row, text in enumerate(text_bytes(batch)):
                code, kind, ids, plain, starts = canonical(text, words)
                content = None
                every = forms(code, kind, plain, starts)
                # An item's first word has its capital at the start of a sentence; put into a sentence it looks like a name.
                turns = [(form, None) for form in every] + ([(every[0], plain[every[0].edge[1:] - 1])] if (kind == CAPITAL).any() else [])
                known, lead = held.value if held is not None else (None, None)
                for width in widths:
                    for form, first in turns:
                        at, value = windows(form, width, first, lead)
                        skip = 0 if first is None else 1
                        if held is not None and len(at):
                            hit = known[np.minimum(np.searchsorted(known, value), len(known) - 1)] == value if len(known) else np.zeros(len(at), dtype=bool)
                            at, value = at[hit], value[hit]
                        if len(at) and content is None:
                            content = xxhash.xxh3_64_intdigest(text) >> 1
                        for place, v in zip(at.tolist(), value.tolist(), strict=True):
                            rows.append(row)
                            pos = int(form.edge[place + 1]) - 1 if skip else int(form.edge[place])
                            for o, x in zip(out, (content, pos, v, form.filled(place + skip, width - skip, words, ids)), strict=True):
                                o.append(x)
            arrays = [pa.array(o, k) for o, k in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.string())), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *arrays], names=["doc_id", "content", "pos", "window", "slots"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind_of_id}, {WINDOW_SCHEMA}")


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, run: int = RUN, consistent: float = CONSISTENT) -> DataFrame:
    """(doc_id, item_id, item_words, covered, longest, coverage, consistency, verbatim): the pairs that count.

    A pair counts if hits on one diagonal, or on diagonals a few words apart, cover ``coverage`` of the item's words or ``run`` words side by side, and
    ``consistent`` of the item's slot values are filled with one value each. verbatim says that all slots keep their values.

    ``docs`` needs doc_id and text, ``benchmark`` item_id and text; other columns are not read. Null and empty texts have
    no windows. Equal rows give one row; texts sharing a doc_id are judged apart and the pair keeps the better one. A null
    doc_id is a value like others. Empty tables on either side give no rows. Whole texts are read, however long.
    """
    import numpy as np

    items = written(item_windows(benchmark), "items")
    widths = sorted(r[0] for r in items.select("width").distinct().collect())
    held = None
    if is_under(items, HELD_WINDOWS):
        known = items.select("window", "lead").distinct().toArrow()
        lead = np.zeros(LEADS, dtype=bool)
        lead[known["lead"].to_numpy()] = True
        held = docs.sparkSession.sparkContext.broadcast((np.unique(known["window"].to_numpy()), lead))
    found = document_windows(docs, widths, held)
    pair = ["doc_id", "content", "item_id", "item_words"]
    # Slots that stand as plain words on both sides keep their value. A name beside the item runs into the slot at its edge, which then says nothing.
    size_of = lambda v: F.size(F.split(v, " "))
    zipped = F.filter(F.arrays_zip("item_slots", "slots", "at_edge"), lambda p: ~p["at_edge"] | (size_of(p["item_slots"]) == size_of(p["slots"])))
    as_pair = lambda a, b: F.struct(a.alias("item_slots"), b.alias("slots"))
    pairs = F.concat(F.transform(zipped, lambda p: as_pair(p["item_slots"], p["slots"])), F.transform("kept_slots", lambda v: as_pair(v, v)))
    hits = found.join(items.drop("lead"), "window").where(F.size("slots") == F.size("item_slots")).withColumn("diagonal", F.col("pos") - F.col("item_pos"))
    hits = written(hits.select(*pair, "diagonal", "item_pos", "item_end", pairs.alias("pairs")).dropDuplicates(), "item-hits")
    # Diagonals near each other are judged together, and each on its own too.
    along = Window.partitionBy(*pair).orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(along) > F.least(F.lit(NEAR), F.floor(F.col("item_words") * NEAR_SHARE))
    near = hits.withColumn("apart", F.coalesce(apart, F.lit(False)).cast("int"))
    near = near.withColumn("cluster", F.sum("apart").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    within = Window.partitionBy(*pair, "cluster")
    several = F.min("diagonal").over(within) != F.max("diagonal").over(within)
    alone = F.struct(F.lit(0).alias("way"), F.col("diagonal").cast("long").alias("number"))
    together = F.struct(F.lit(1).alias("way"), F.col("cluster").alias("number"))
    hits = near.withColumn("several", several).withColumn("group", F.explode(F.when(F.col("several"), F.array(alone, together)).otherwise(F.array(alone))))
    key = [*pair, "group"]
    order = Window.partitionBy(*key).orderBy("item_pos")
    upto = F.max("item_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = hits.withColumn("upto", upto).withColumn("fresh", F.when(F.col("item_pos") <= F.col("upto"), 0).otherwise(1))
    runs = runs.withColumn("stretch", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    stretches = runs.groupBy(*key, "stretch").agg((F.max("item_end") - F.min("item_pos")).alias("words"))
    covered = stretches.groupBy(*key).agg(F.sum("words").alias("covered"), F.max("words").alias("longest"))
    filled = hits.select(*key, F.explode("pairs").alias("p")).groupBy(*key, F.col("p.item_slots").alias("value")).agg(F.count_distinct("p.slots").alias("fills"), F.max(F.when(F.col("p.slots") != F.col("p.item_slots"), 1).otherwise(0)).alias("changed"))
    slots = filled.groupBy(*key).agg(F.avg(F.when(F.col("fills") == 1, 1.0).otherwise(0.0)).alias("consistency"), F.max("changed").alias("changed"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key]
    both = covered.join(slots.withColumnsRenamed({k: f"__{k}" for k in key}), reduce(and_, same), "left").drop(*[f"__{k}" for k in key])
    judged = both.select(
        "doc_id", "item_id", "item_words", "covered", "longest", (F.col("covered") / F.col("item_words")).alias("coverage"), F.coalesce("consistency", F.lit(1.0)).alias("consistency"),
        (F.coalesce("changed", F.lit(0)) == 0).alias("verbatim"),
    )
    counts = judged.where(((F.col("coverage") >= coverage) | (F.col("longest") >= run)) & (F.col("consistency") >= consistent))
    best = F.max(F.struct("covered", "longest", "coverage", "consistency", "verbatim")).alias("best")
    return counts.groupBy("doc_id", "item_id", "item_words").agg(best).select(
        "doc_id", "item_id", F.col("item_words").cast("long").alias("item_words"), F.col("best.covered").cast("long").alias("covered"), F.col("best.longest").cast("long").alias("longest"), "best.coverage", "best.consistency", "best.verbatim"
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id is in a pair that counts."""
    bad = written(contaminated(docs, benchmark).select(F.col("doc_id").alias("__bad")).dropDuplicates(), "contaminated")
    if is_under(bad, 200_000):
        bad = F.broadcast(bad)
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("__bad")), "left_anti")
