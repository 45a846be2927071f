"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

The raw model is of all documents, the target model of documents labelled good. A feature (a word, a run of marks or
a pair of neighbours) that target text avoids lowers a document's importance by the log of the two models' ratio.
Documents are then drawn without replacement in proportion to importance by adding Gumbel noise and keeping the k
greatest; k is the sum of importances, so that where nothing is avoided all documents stay.

Features are counted once a document, so that one text that repeats itself does not make a model. Ratios above one
count as one: nothing in a text makes up for what target text never has. A ratio counts only if chance does not
explain it, with the number of features tested taken into account.

Most features stand in a handful of documents and can never be tested. A count-min sketch of all features is taken
first: it never counts too little, so a feature whose cells hold too few documents needs no count of its own, and only
the others are counted one by one through a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import is_under, text_bytes, written

#: Rows and cells of the sketch, and cells that one row of its table holds. A test asks for EXPECTED * documents / sample documents, which grows as the noise of a cell does, so this size serves any corpus.
DEPTH, CELLS, SEGMENT = 2, 1 << 23, 1 << 16
#: Features that a task gathers before it adds them up.
GATHERED = 1 << 20
#: Labelled documents at most from which the target model is learned: those with the least hash of their id.
FIT_ROWS = 50_000
#: Documents that a feature is expected in before it is tested, the error allowed in all tests, the log ratio from which a feature counts, and the count added to both sides.
EXPECTED, ERROR, LEAST_LOG, ADDED = 5.0, 0.1, -1.0, 0.5
#: Importance is the ratio to the power 1 / TEMPERATURE: the lower, the less chance decides.
TEMPERATURE = 0.1
SEED = 20_240_501
#: Cached token numbers of a task.
KEPT_TOKENS = 400_000


class _Numbers(dict):
    def __missing__(self, token: bytes) -> int:
        import xxhash

        self[token] = value = xxhash.xxh3_64_intdigest(token) >> 1
        return value


def _features(texts, numbers: _Numbers):
    """For each text its distinct features."""
    import re

    import numpy as np

    find = re.compile(rb"[a-z0-9_\x80-\xff]+|[^a-z0-9_\x80-\xff\s]+").findall
    if len(numbers) > KEPT_TOKENS:
        numbers.clear()
    none = np.zeros(0, dtype=np.int64)
    for text in texts:
        tokens = find(text.lower()) if text else ()
        if not tokens:
            yield none
            continue
        code = np.fromiter(map(numbers.__getitem__, tokens), dtype=np.int64, count=len(tokens)).view(np.uint64)
        with np.errstate(over="ignore"):
            pair = np.unique((code[:-1] * np.uint64(0x9E3779B97F4A7C15) + code[1:]) * np.uint64(0xBF58476D1CE4E5B9))
        yield np.concatenate([np.unique(code), pair]).view(np.int64)


def _cell(features, row: int):
    """The cell of each feature in a row of the sketch."""
    import numpy as np

    with np.errstate(over="ignore"):
        mixed = features.view(np.uint64) * np.uint64((0xD6E8FEB86659FD93, 0xA0761D6478BD642F)[row])
    return (mixed >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def _gathered(batches, numbers: _Numbers) -> Iterator:
    """(doc_ids, lists of features) of at most about GATHERED features."""
    ids, lists, size = [], [], 0
    for batch in batches:
        for doc_id, found in zip(batch.column(0).to_pylist(), _features(text_bytes(batch), numbers), strict=True):
            ids.append(doc_id)
            lists.append(found)
            size += len(found)
            if size >= GATHERED:
                yield ids, lists
                ids, lists, size = [], [], 0
    if ids:
        yield ids, lists


def frequent_cells(docs: DataFrame, least: float):
    """For each row of the sketch, whether a cell counts ``least`` documents or more, as packed bits.

    A task sends its non-empty segments, deflated; a segment's sums are made where its parts meet, and the driver gets
    a bit a cell.
    """
    import zlib

    import numpy as np

    def sketch(batches) -> Iterator:
        import pyarrow as pa

        table, numbers = np.zeros(DEPTH * CELLS, dtype=np.uint32), _Numbers()
        for _, lists in _gathered(batches, numbers):
            every = np.concatenate(lists)
            for row in range(DEPTH):
                np.add.at(table[row * CELLS : (row + 1) * CELLS], _cell(every, row), np.uint32(1))
        segments = table.reshape(-1, SEGMENT)
        for i in np.flatnonzero(segments.any(axis=1)):
            part = segments[i].astype(np.uint8) if segments[i].max() < 256 else segments[i]
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["segment", "part"])

    def add(batches) -> Iterator:
        import pyarrow as pa

        total: dict[int, object] = {}
        for batch in batches:
            for i, part in zip(*(batch.column(c).to_pylist() for c in (0, 1)), strict=True):
                raw = zlib.decompress(part)
                total.setdefault(i, np.zeros(SEGMENT, dtype=np.uint64))
                total[i] += np.frombuffer(raw, np.uint8 if len(raw) == SEGMENT else np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.packbits(t >= least).tobytes() for t in total.values()], pa.binary())], names=["segment", "bits"])

    segments = DEPTH * CELLS // SEGMENT
    parts = docs.select("doc_id", "text").mapInArrow(sketch, "segment int, part binary").repartition(min(segments, 64), "segment")
    bits = np.zeros((segments, SEGMENT // 8), dtype=np.uint8)
    for r in parts.mapInArrow(add, "segment int, bits binary").collect():
        bits[r["segment"]] = np.frombuffer(r["bits"], np.uint8)
    return bits.reshape(DEPTH, -1)


def target_ids(labels: DataFrame, rows: int = FIT_ROWS) -> list:
    """Ids of good documents (quality 1, not toxic) for the target model, ``rows`` at most."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).where("quality = 1 AND toxic = 0 AND doc_id IS NOT NULL")
    return [r[0] for r in good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()]


def feature_counts(docs: DataFrame, target: list, bits=None) -> DataFrame:
    """(feature, raw, target): documents with a feature, and those of the target sample; of all features, or of those whose cells are all set in ``bits``."""
    held = docs.sparkSession.sparkContext.broadcast((frozenset(target), bits))

    def count(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        numbers, (good, wanted) = _Numbers(), held.value
        for ids, lists in _gathered(batches, numbers):
            every, own = np.concatenate(lists), np.repeat([i in good for i in ids], [len(x) for x in lists])
            for row in range(DEPTH if wanted is not None else 0):
                cells = _cell(every, row)
                kept = (wanted[row][cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 == 1
                every, own = every[kept], own[kept]
            if len(every):
                feature, raw = np.unique(every, return_counts=True)
                seen, times = np.unique(every[own], return_counts=True)
                mine = np.zeros(len(feature), dtype=np.int64)
                mine[np.searchsorted(feature, seen)] = times
                yield pa.RecordBatch.from_arrays([pa.array(feature), pa.array(raw.astype(np.int64)), pa.array(mine)], names=["feature", "raw", "target"])

    return docs.select("doc_id", "text").mapInArrow(count, "feature long, raw long, target long").groupBy("feature").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def _unlikely(seen, raw, share: float, limit: float):
    """Whether so few or fewer of ``raw`` documents in a sample of the given share are less likely than ``limit`` (binomial)."""
    import numpy as np

    out = np.zeros(len(seen), dtype=bool)
    for i in np.flatnonzero(seen < raw * share):
        n, k = int(raw[i]), int(seen[i])
        if n > 2_000:
            z = (k + 0.5 - n * share) / math.sqrt(n * share * (1 - share) or 1.0)
            out[i] = 0.5 * math.erfc(-z / math.sqrt(2)) < limit
        elif share < 1:
            term = total = (1 - share) ** n
            for j in range(1, k + 1):
                term *= (n - j + 1) / j * share / (1 - share)
                total += term
            out[i] = total < limit
    return out


def _can_be_unlikely(share: float, limit: float) -> Column:
    """False only where _unlikely is: the chance of no more than ``target`` of ``raw`` is at least (n p / k (1 - p))^k (1 - p)^n."""
    k, n = F.col("target"), F.col("raw")
    least = F.when(k > 0, k * F.log(n * share / (k * (1 - share)))).otherwise(0.0) + n * math.log1p(-share)
    return (n > 2_000) | (least <= math.log(limit) + 1e-6)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS):
    """Features that target text avoids, in order, and the logs of their ratios.

    Every feature that can be tested is counted on its own. There are at most features a document * ``rows`` / EXPECTED
    of those, whatever the corpus, and the driver gets only those of them that can fail.
    """
    import numpy as np

    nothing = np.zeros(0, dtype=np.int64), np.zeros(0)
    target = target_ids(labels, rows)
    if not target:
        return nothing
    ids = docs.sparkSession.createDataFrame([(i,) for i in target], T.StructType([T.StructField("doc_id", labels.schema["doc_id"].dataType)]))
    documents, sample = docs.count(), docs.select("doc_id").join(F.broadcast(ids), "doc_id", "left_semi").count()
    if not sample or sample == documents:
        return nothing
    share = sample / documents
    tested = written(feature_counts(docs, target, frequent_cells(docs, EXPECTED / share * (1 - 1e-12))).where(F.col("raw") * share >= EXPECTED), "features")
    limit = ERROR / max(1, tested.count())
    log_ratio = F.log((F.col("target") + ADDED) / (F.col("raw") * share + ADDED))
    able = tested.where((log_ratio <= LEAST_LOG + 1e-9) & _can_be_unlikely(share, limit)).toArrow()
    feature, raw, mine = (able[c].to_numpy() for c in ("feature", "raw", "target"))
    logs = np.log((mine + ADDED) / (raw * share + ADDED))
    counted = (logs <= LEAST_LOG) & _unlikely(mine, raw, share, limit)
    order = np.argsort(feature[counted])
    return feature[counted][order], logs[counted][order]


def importance(docs: DataFrame, model) -> DataFrame:
    """``docs`` with n_features, log_ratio and content (a hash of the text) added; columns of these names are replaced."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    added = ("content", "n_features", "log_ratio")
    kept = docs.select(*[c for c in docs.columns if c not in added])
    names = kept.columns

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        numbers, (known, logs) = _Numbers(), held.value
        # Most features are not in the model; a look at their cell says so.
        marked = np.zeros(CELLS, dtype=bool)
        marked[_cell(known, 0)] = True

        def ratio(features) -> float:
            features = features[marked[_cell(features, 0)]]
            if not len(features):
                return 0.0
            at = np.minimum(np.searchsorted(known, features), len(known) - 1)
            return float(logs[at[known[at] == features]].sum())

        for batch in batches:
            texts = text_bytes(batch)
            found = [(len(f), ratio(f)) for f in _features(texts, numbers)]
            content = [xxhash.xxh3_64_intdigest(t or b"") >> 1 for t in texts]
            made = [pa.array(content, pa.int64()), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(n)) for n in names], *made], names=[*names, *added])

    schema = T.StructType([*kept.schema.fields, T.StructField("content", T.LongType()), T.StructField("n_features", T.LongType()), T.StructField("log_ratio", T.DoubleType())])
    return kept.mapInArrow(run, schema)


def gumbel(*columns: Column) -> Column:
    """Gumbel noise from a hash of the columns, equal for equal values."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *columns), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(-F.log(uniform))


def kth_greatest(rows: DataFrame, column: str, k: int, bins: int = 4096, few: int = 10_000) -> float:
    """The k-th greatest value by counting in ever finer bins; no task or driver holds more than bins or ``few`` values."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    while True:
        width = (high - low) / bins
        inside = rows.where(F.col(column).between(low, high))
        if width <= 0 or low + width == low or is_under(inside, few):
            values = [r[0] for r in inside.select(column).orderBy(F.desc(column)).limit(few).collect()]
            return values[min(k, len(values)) - 1]
        place = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).cast("int")
        for i, count in sorted(((r[0], r[1]) for r in inside.groupBy(place.alias("bin")).count().collect()), reverse=True):
            if count >= k:
                edges = inside.where(place == i).agg(F.min(column), F.max(column)).first()
                break
            k -= count
        low, high = edges


def _key(temperature: float) -> Column:
    return F.col("log_ratio") / temperature + gumbel(F.col("doc_id"), F.col("content"))


def _draw(docs: DataFrame, labels: DataFrame, rows: int, temperature: float, k: int | None = None):
    """The model, the keys of all documents, and the least key that is drawn."""
    model = fit(docs, labels, rows)
    keyed = importance(docs.select("doc_id", "text"), model).drop("text")
    keyed = written(keyed.withColumn("score", F.exp(F.col("log_ratio") / temperature)).withColumn("key", _key(temperature)), "importance")
    drawn, every = keyed.agg(F.sum("score"), F.count(F.lit(1))).first()
    k = round(drawn or 0.0) if k is None else k
    least = -math.inf if k >= every else math.inf if k <= 0 else kth_greatest(keyed, "key", k)
    return model, keyed, least


def resample(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, temperature: float = TEMPERATURE, k: int | None = None) -> DataFrame:
    """The documents drawn: doc_id, content, n_features, log_ratio, score (importance, 0 to 1) and key.

    ``k`` documents are drawn, or as many as the sum of importances. Texts count whole; a text of any length is one task's.

    ``docs`` needs doc_id and text, ``labels`` doc_id, quality and toxic; other columns are not read. A document labelled
    more than once is good only if all its labels are. Null and empty texts have no features, hence importance 1. Equal
    rows get equal keys, and ties at the last key are all kept. A null doc_id is a value like others and never a target.
    Without labels, or with none that are good, nothing is avoided and all documents stay. An empty table stays empty.
    """
    _, keyed, least = _draw(docs, labels, rows, temperature, k)
    return keyed.where(F.col("key") >= least)


def resampled(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, temperature: float = TEMPERATURE) -> DataFrame:
    """The rows of ``docs`` that are drawn, with their columns (but content, n_features and log_ratio, if there are any).

    The rows are scored once more as they are read, so that no text is shuffled to meet its key.
    """
    model, _, least = _draw(docs, labels, rows, temperature)
    scored = importance(docs, model)
    return scored.where(_key(temperature) >= least).drop("content", "n_features", "log_ratio")
