"""Tokeniser fertility: how public vocabularies cut a text, with rejection bands per language or script.

A vocabulary cuts prose it knows into few, varied tokens. Text in no language, repeated or encoded text stands
out by characters per token, by the share of byte-fallback tokens and by the entropy of its tokens. White space
is left out: each word is cut on its own with a space before it, as both vocabularies do themselves, so that a
task cuts each distinct word once.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, text_bytes, written

#: Folder of the public vocabulary files: byte_bpe_multi_50k.tiktoken and piece_bpe_32k.model.
VOCABULARIES = "/opt/tokenizers"
#: Longest part of a word that is cut at once, in code points; longer words are cut in parts of this length.
PART = 512
#: Words whose cuts a task keeps; beyond it the memory is emptied.
KEPT_WORDS = 300_000
#: Words of a chunk of texts that are worked on together.
CHUNK_WORDS = 400_000
WINDOW = 8
SYMBOLS = b"#*$%&|<>"

# First and last letters of scripts, in code points.
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF), ("devanagari", 0x0900, 0x097F),
    ("thai", 0x0E00, 0x0E7F), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
)

# Fixed value: the public pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

METRICS = ("chars_per_token", "byte_share", "entropy_share")
MEASURE_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, token_entropy double, entropy_share double, script string"

#: A band reaches so many quartile ranges beyond the quartiles of its group, and at least so far from the median.
REACH = {"chars_per_token": 4.0, "byte_share": 4.0, "entropy_share": 1.25}
LEAST_WIDTH = {"chars_per_token": 0.25, "byte_share": 0.1, "entropy_share": 0.15}
#: Measures of short texts scatter: a text of n words has bands wider by the factor 1 + SHORT_WORDS / n.
SHORT_WORDS = 10
#: Quartiles of few texts say little: a group of n texts has bands wider by the factor 1 + SMALL_GROUP / n. None is judged by the bands of others.
SMALL_GROUP = 25
#: Words from which a text is long enough for its bands; below, n_words decides alone.
MIN_WORDS = 20


def _script(word: str) -> int:
    for c in word:
        if c.isalpha():
            for i, (_, first, last) in enumerate(SCRIPTS):
                if first <= ord(c) <= last:
                    return i
            return len(SCRIPTS)
    return len(SCRIPTS)


@lru_cache(maxsize=1)
def _vocabularies(folder: str):
    """Both encoders, loaded once a worker process."""
    import base64

    import sentencepiece
    import tiktoken

    with open(os.path.join(folder, "byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = PATTERN
    pieces = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, "piece_bpe_32k.model"))
    return tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), pieces, [pieces.is_byte(i) for i in range(pieces.vocab_size())]


class Lexicon:
    """Words seen by a task with their cuts, in flat arrays."""

    def __init__(self, folder: str):
        self.bytes_bpe, self.pieces, self.is_byte = _vocabularies(folder)
        self.clear()

    def clear(self) -> None:
        from array import array

        self.ids: dict[bytes, int] = {}
        self.flat, self.start, self.n_tokens, self.n_pieces, self.n_bytes, self.chars, self.script = (array("q") for _ in range(7))

    def look(self, words: list[bytes]):
        import numpy as np

        ids = self.ids
        fresh = [w for w in dict.fromkeys(words) if w not in ids]
        texts = [w.decode("utf-8", "replace") for w in fresh]
        cut = self.pieces.encode([t[i : i + PART] for t in texts for i in range(0, len(t), PART)], num_threads=1) if texts else []
        at = 0
        for word, text in zip(fresh, texts, strict=True):
            ids[word] = len(ids)
            tokens = [x for i in range(0, len(text), PART) for x in self.bytes_bpe.encode_ordinary((" " if i == 0 else "") + text[i : i + PART])]
            parts = -(-len(text) // PART)
            pieces = cut[at] if parts == 1 else [x for p in cut[at : at + parts] for x in p]
            at += parts
            self.start.append(len(self.flat))
            self.flat.extend(tokens)
            self.n_tokens.append(len(tokens))
            self.n_pieces.append(len(pieces))
            self.n_bytes.append(sum(self.is_byte[p] for p in pieces))
            self.chars.append(len(text))
            self.script.append(_script(text))
        return np.fromiter(map(ids.__getitem__, words), dtype=np.int64, count=len(words))


def _repeated_words(ids, start, count):
    """Per text, the words in windows of WINDOW words that stand twice or more in it."""
    import numpy as np

    n = len(ids)
    out = np.zeros(len(start), dtype=np.int64)
    if n < WINDOW:
        return out
    doc = np.repeat(np.arange(len(start)), count)
    room = np.repeat(start + count, count) - np.arange(n)
    with np.errstate(over="ignore"):
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        code = np.zeros(n, dtype=np.uint64)
        for i in range(WINDOW):
            code *= np.uint64(0xBF58476D1CE4E5B9)
            code[: n - i] += mixed[i:]
            code ^= code >> np.uint64(31)
        code = (code ^ (doc.astype(np.uint64) * np.uint64(0x94D049BB133111EB))) * np.uint64(0xD6E8FEB86659FD93)
    places = np.flatnonzero(room >= WINDOW)
    order = places[np.argsort(code[places], kind="stable")]
    same = code[order][1:] == code[order][:-1]
    twice = np.zeros(len(order), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, order[twice], 1)
    np.add.at(change, order[twice] + WINDOW, -1)
    covered = np.cumsum(change)[:n] > 0
    return np.bincount(doc, weights=covered, minlength=len(start)).astype(np.int64)


def _duplicate_lines(text: bytes) -> int:
    seen, again = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            again += bool(line.strip(SPACE))
        else:
            seen.add(line)
    return again


def _chunk(texts: list[bytes], lexicon: Lexicon) -> dict:
    import numpy as np

    split = [t.split() for t in texts]
    count = np.array([len(x) for x in split], dtype=np.int64)
    start = np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64)
    ids = lexicon.look(list(chain.from_iterable(split)))
    doc = np.repeat(np.arange(len(texts)), count)
    each = {k: np.frombuffer(getattr(lexicon, k), dtype=np.int64) for k in ("start", "n_tokens", "n_pieces", "n_bytes", "chars", "script", "flat")} if len(lexicon.ids) else None
    n = len(texts)
    total = lambda k: np.bincount(doc, weights=each[k][ids], minlength=n).astype(np.int64) if each else np.zeros(n, dtype=np.int64)
    chars, tokens, pieces, byte_pieces = total("chars"), total("n_tokens"), total("n_pieces"), total("n_bytes")
    entropy, script = np.zeros(n), np.full(n, len(SCRIPTS))
    if each:
        width = each["n_tokens"][ids]
        ends = np.cumsum(width)
        flat_at = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - width, width) + np.repeat(each["start"][ids], width)
        keyed = np.sort(np.repeat(doc, width) * 65536 + each["flat"][flat_at])
        edge = np.flatnonzero(np.concatenate([[True], keyed[1:] != keyed[:-1]])) if len(keyed) else np.zeros(0, dtype=np.int64)
        counts = np.diff(np.concatenate([edge, [len(keyed)]]))
        weighted = np.bincount(keyed[edge] >> 16, weights=counts * np.log2(np.maximum(counts, 1)), minlength=n)
        safe = np.maximum(tokens, 1)
        entropy = np.where(tokens > 0, np.log2(safe) - weighted / safe, 0.0)
        votes = np.bincount(doc * (len(SCRIPTS) + 1) + each["script"][ids], minlength=n * (len(SCRIPTS) + 1)).reshape(n, -1)
        known = votes[:, :-1].sum(axis=1) > 0
        script = np.where(known, votes[:, :-1].argmax(axis=1), len(SCRIPTS))
    names = [s for s, _, _ in SCRIPTS] + ["none"]
    most = np.log2(np.clip(tokens, 2, 4096))
    return {
        "n_words": count, "word_chars": chars, "n_symbols": np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in texts], dtype=np.int64),
        "n_dup_lines": np.array([_duplicate_lines(t) for t in texts], dtype=np.int64), "n_repeat_words": _repeated_words(ids, start, count), "n_tokens": tokens,
        "chars_per_token": chars / np.maximum(tokens, 1), "byte_share": byte_pieces / np.maximum(pieces, 1), "token_entropy": np.maximum(entropy, 0.0), "entropy_share": np.maximum(entropy, 0.0) / most,
        "script": [names[i] for i in script],
    }


def measure(docs: DataFrame, vocabularies: str = VOCABULARIES, carry: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """One row per input row: the carried columns and MEASURE_SCHEMA.

    entropy_share is the token entropy over the most that so many tokens (4,096 at most) could have.
    """

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        lexicon = Lexicon(vocabularies)
        for batch in batches:
            texts = [t or b"" for t in text_bytes(batch)]
            begin = 0
            while begin < len(texts):
                end, words = begin, 0
                while end < len(texts) and (end == begin or words + len(texts[end]) // 4 <= CHUNK_WORDS):
                    words += len(texts[end]) // 4
                    end += 1
                if len(lexicon.ids) > KEPT_WORDS:
                    lexicon.clear()
                made = _chunk(texts[begin:end], lexicon)
                arrays = [pa.array(np.asarray(v) if k != "script" else v) for k, v in made.items()]
                kept = [batch.column(batch.schema.get_field_index(c)).slice(begin, end - begin) for c in carry]
                yield pa.RecordBatch.from_arrays([*kept, *arrays], names=[*carry, *made])
                begin = end

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in carry]) + ", " + MEASURE_SCHEMA
    return docs.select(*carry, "text").mapInArrow(run, schema)


def _quartiles(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("docs"), *[F.percentile_approx(m, [0.25, 0.5, 0.75], 10_000).alias(m) for m in METRICS])


def _edges(q: Column, metric: str) -> tuple[Column, Column]:
    spread = REACH[metric] * (q[2] - q[0])
    least = F.lit(LEAST_WIDTH[metric])
    return F.least(q[0] - spread, q[1] - least), F.greatest(q[2] + spread, q[1] + least)


def fit_bands(measured: DataFrame) -> DataFrame:
    """(band, docs, <metric>_middle, <metric>_low, <metric>_high): bands per language or script over all texts of MIN_WORDS words, however few."""
    rows = measured.where(F.col("n_words") >= MIN_WORDS).withColumn("band", F.coalesce("lang", "script"))
    wider = 1 + SMALL_GROUP / F.col("docs")
    edges = []
    for m in METRICS:
        middle, (low, high) = F.col(m)[1], _edges(F.col(m), m)
        edges += [middle.alias(f"{m}_middle"), (middle - (middle - low) * wider).alias(f"{m}_low"), (middle + (high - middle) * wider).alias(f"{m}_high")]
    return _quartiles(rows, "band").select("band", "docs", *edges)


def fertility_filter(docs: DataFrame, vocabularies: str = VOCABULARIES) -> DataFrame:
    """One row per input row: doc_id, the measures, base_failed, outside (metrics beyond their band) and kept.

    ``docs`` needs doc_id, text and lang; other columns are not read. A null or empty text has no words, zeros for
    all measures and fails (fewer than 20 words). A null lang takes the bands of the text's script. Equal rows are
    answered alike, and rows may share a doc_id. An empty table gives an empty one. Bands come from all rows; the
    table of bands has one row per language or script, and is joined by size. The fewer texts a group has, the wider its
    bands: a handful is judged by the base rules almost alone.
    """
    measured = written(measure(docs, vocabularies), "fertility")
    own = fit_bands(measured).drop("docs").withColumnRenamed("band", "__band")
    joined = measured.withColumn("band", F.coalesce("lang", "script")).join(own, F.col("band") == F.col("__band"), "left")
    wider = 1 + SHORT_WORDS / F.greatest(F.col("n_words"), F.lit(1))

    def inside(m: str) -> Column:
        middle, low, high = (F.col(f"{m}_{x}") for x in ("middle", "low", "high"))
        return F.col(m).between(middle - (middle - low) * wider, middle + (high - middle) * wider)

    beyond = [F.when(~inside(m), F.lit(m)) for m in METRICS]
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    judged = joined.withColumn("base_failed", failed).withColumn("outside", F.when(F.col("n_words") >= MIN_WORDS, F.concat_ws(",", *beyond)).otherwise(F.lit("")))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("outside") == "")).alias("kept"),
        "n_tokens", *METRICS, "token_entropy", "script", "band", "outside",
    )
