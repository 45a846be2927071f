"""Languages of a text as a mixture: expectation-maximisation over character trigrams.

Each language has a trigram model learned from labelled text. A text's trigrams come from a mixture of
languages whose shares EM estimates; of the nested sets of its likeliest languages that with the best penalised likelihood is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_bytes

#: Trigrams are hashed to so many numbers, so a model has that many values a language.
BUCKETS = 1 << 16
SMOOTHING = 0.5
ROUNDS = 12
#: Languages of a set at most, the least share of one, and the cost of a further language in nats per unit of log(trigrams).
MOST, LEAST_SHARE, PENALTY = 4, 0.02, 4.0
#: Languages a task counts before it passes its counts on.
HELD_LANGUAGES = 100


@lru_cache(maxsize=1)
def _letters():
    """Which code points are letters."""
    import sys

    import numpy as np

    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


def trigrams(text: bytes | None):
    """Numbers of the trigrams of a text's lower-case letters, words set apart by one space; empty without letters."""
    import numpy as np

    points = np.frombuffer((text or b"").decode("utf-8", "replace").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    line = np.concatenate([[32], np.where(letter, points, 32)[keep], [32]]).astype(np.uint64)
    code = (line[:-2] * np.uint64(0x9E3779B1) + line[1:-1]) * np.uint64(0x85EBCA77) + line[2:]
    code ^= code >> np.uint64(29)
    with np.errstate(over="ignore"):
        code *= np.uint64(0xBF58476D1CE4E5B9)
    return (code >> np.uint64(48)).astype(np.int64)[line[1:-1] != 32] % BUCKETS


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(lang, bucket, count) over all rows with a lang."""

    def count(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held: dict[str, object] = {}

        def out():
            for lang, counts in sorted(held.items()):
                used = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(counts[used])], names=["lang", "bucket", "count"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), text_bytes(batch), strict=True):
                if lang not in held:
                    if len(held) >= HELD_LANGUAGES:
                        yield from out()
                    held[lang] = np.zeros(BUCKETS, dtype=np.int64)
                bucket, times = np.unique(trigrams(text), return_counts=True)
                held[lang][bucket] += times
        yield from out()

    rows = docs.where("lang IS NOT NULL").select("lang", "text").mapInArrow(count, "lang string, bucket int, count long")
    return rows.groupBy("lang", "bucket").agg(F.sum("count").alias("count"))


def fit(docs: DataFrame):
    """Languages in order and the log-probabilities of their trigrams, as an array of BUCKETS values a language."""
    import numpy as np

    rows = trigram_counts(docs).toArrow()
    langs = sorted(set(rows["lang"].to_pylist()))
    counts = np.zeros((len(langs), BUCKETS))
    if langs:
        place = {lang: i for i, lang in enumerate(langs)}
        counts[[place[x] for x in rows["lang"].to_pylist()], rows["bucket"].to_numpy()] = rows["count"].to_numpy()
    logs = np.log(counts + SMOOTHING) - np.log(counts.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS)
    return langs, logs.astype(np.float32)


def _mixture(probability, weight, share):
    """Shares and log-likelihood of trigrams with the given probabilities (language, trigram) and counts after EM."""
    import numpy as np

    total = weight.sum()
    for _ in range(ROUNDS):
        joint = share[:, None] * probability
        share = (joint * (weight / joint.sum(axis=0))).sum(axis=1) / total
    return share, float(weight @ np.log((share[:, None] * probability).sum(axis=0)))


def shares(found, logs):
    """(language, share) pairs of a text's trigrams, greatest first; shares of the kept set add up to 1."""
    import numpy as np

    bucket, weight = np.unique(found, return_counts=True)
    own = logs[:, bucket].astype(np.float64)
    top = own.max(axis=0)
    probability, weight = np.exp(own - top), weight.astype(np.float64)
    count = len(logs)
    share, _ = _mixture(probability, weight, np.full(count, 1.0 / count))
    order = [i for i in np.argsort(-share, kind="stable")[:MOST] if share[i] >= LEAST_SHARE or i == share.argmax()]
    single = int((own @ weight).argmax())
    best, kept = float((own[single] - top) @ weight), [(single, 1.0)]
    step = PENALTY * np.log(max(2.0, weight.sum()))
    for size in range(2, len(order) + 1):
        chosen = order[:size]
        part, likelihood = _mixture(probability[chosen], weight, np.full(size, 1.0 / size))
        if likelihood - (size - 1) * step > best:
            best, kept = likelihood - (size - 1) * step, sorted(zip(chosen, part.tolist(), strict=True), key=lambda x: (-x[1], x[0]))
    return [(int(i), float(s)) for i, s in kept]


def predict(docs: DataFrame, model) -> DataFrame:
    """Adds lang_pred, score (its share) and languages (array of lang and share) to doc_id."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind_of_id = docs.schema["doc_id"].dataType.simpleString()

    def run(batches) -> Iterator:
        import pyarrow as pa

        langs, logs = held.value
        for batch in batches:
            pred, score, every = [], [], []
            for text in text_bytes(batch):
                found = trigrams(text)
                mixed = shares(found, logs) if len(found) and langs else []
                pred.append(langs[mixed[0][0]] if mixed else "und")
                score.append(min(1.0, mixed[0][1]) if mixed else 0.0)
                every.append([{"lang": langs[i], "share": s} for i, s in mixed])
            kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred), pa.array(score, pa.float64()), pa.array(every, kind)], names=["doc_id", "lang_pred", "score", "languages"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind_of_id}, lang_pred string, score double, languages array<struct<lang:string,share:double>>")


def held_out(doc_id: Column) -> Column:
    """Documents kept from learning: crc32 of the id as text divides by 5. A null id counts as an empty text, which is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def identify(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, languages.

    Learns from text and lang of the rows that are not held out; predictions see the text alone. A text that is null or
    without letters is ``und`` with score 0 and no languages; so is every text when nothing could be learned. Equal rows
    get equal answers, and rows may share a doc_id. Ties go to the first language by name. ``docs`` needs doc_id, text
    and lang; other columns are not read. An empty table gives an empty one.
    """
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "languages")
