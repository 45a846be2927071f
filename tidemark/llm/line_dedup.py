"""Reversible line dedup: sharded cuckoo filters over exact reference counts.

The reference table holds, for each line key, the number of documents that have it. A key that reaches
``min_docs`` enters its shard's cuckoo filter, and leaves it again when documents are deleted; no other
line-level state exists, so insertions and deletions in any order end where a fresh build would.

Dropping lines probes the filters. A fingerprint can answer for a key that is not frequent, so the keys of
the reference table that do so by mistake are listed exactly beside the filters.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import SPACE, text_bytes, written

MIN_DOCS = 10
MIN_CHARS = 1
#: Keys of a shard that a build plans for; shards follow from the number of frequent keys.
SHARD_KEYS = 50_000
#: Bytes of all filters and of the list beside them up to which every task holds them; beyond it lines are joined instead.
HELD_BYTES = 64 << 20
#: Counted keys a task holds before it passes them on.
HELD_KEYS = 200_000
SLOTS, KICKS = 4, 500
SPREAD = 0x5BD1E995


def line_key(line: bytes) -> bytes:
    return line.strip(SPACE).lower()


def _identity(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _has_length(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


class Cuckoo:
    """A cuckoo filter over 16-byte identities: four 32-bit fingerprints a bucket, two buckets a key."""

    def __init__(self, buckets: int, table=None):
        import numpy as np

        self.mask = buckets - 1
        self.table = np.zeros((buckets, SLOTS), dtype=np.uint32) if table is None else np.frombuffer(table, dtype=np.uint32).reshape(buckets, SLOTS).copy()

    @staticmethod
    def sized(keys: int) -> Cuckoo:
        return Cuckoo(1 << max(2, math.ceil(math.log2(max(1, keys) / SLOTS / 0.8))))

    def places(self, identities):
        """Fingerprints and both buckets of an array of identities."""
        import numpy as np

        parts = np.frombuffer(b"".join(identities), dtype=np.uint32).reshape(-1, 4)
        prints = np.maximum(parts[:, 0], 1)
        first = parts[:, 1] & self.mask
        return prints, first, self.other(first, prints)

    def other(self, bucket, prints):
        return bucket ^ ((prints.astype("uint64") * SPREAD >> 7).astype("uint32") & self.mask)

    def holds(self, identities):
        if not identities:
            return []
        prints, one, two = self.places(identities)
        return ((self.table[one] == prints[:, None]) | (self.table[two] == prints[:, None])).any(axis=1)

    def insert(self, identities) -> bool:
        """False when no room was found; the filter is then to be built anew."""
        import numpy as np

        if not identities:
            return True
        for print_, one, two in zip(*self.places(identities), strict=True):
            for bucket in (one, two):
                free = np.flatnonzero(self.table[bucket] == 0)
                if len(free):
                    self.table[bucket, free[0]] = print_
                    break
            else:
                bucket = two
                for kick in range(KICKS):
                    slot = kick % SLOTS
                    print_, self.table[bucket, slot] = self.table[bucket, slot], print_
                    bucket = self.other(np.uint32(bucket), np.asarray(print_))
                    free = np.flatnonzero(self.table[bucket] == 0)
                    if len(free):
                        self.table[bucket, free[0]] = print_
                        break
                else:
                    return False
        return True

    def delete(self, identities) -> None:
        import numpy as np

        if not identities:
            return
        for print_, one, two in zip(*self.places(identities), strict=True):
            for bucket in (one, two):
                slot = np.flatnonzero(self.table[bucket] == print_)
                if len(slot):
                    self.table[bucket, slot[0]] = 0
                    break


COUNT_SCHEMA = "key binary, docs long"
FILTER_SCHEMA = "shard int, buckets int, cells binary"


def line_counts(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(key, docs): in how many rows of ``docs`` each line key stands. Counts leave a task already summed."""

    def count(batches) -> Iterator:
        import pyarrow as pa

        held: dict[bytes, int] = {}

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["key", "docs"])
            held.clear()
            return batch

        for batch in batches:
            for text in text_bytes(batch):
                for key in {line_key(line) for line in (text or b"").split(b"\n")}:
                    if key and _has_length(key, min_chars):
                        key = _identity(key)
                        held[key] = held.get(key, 0) + 1
                if len(held) >= HELD_KEYS:
                    yield out()
        if held:
            yield out()

    return docs.select("text").mapInArrow(count, COUNT_SCHEMA).groupBy("key").agg(F.sum("docs").alias("docs"))


def _shard(shards: int):
    """The shard of a key column, as _shard_of gives it."""
    return (F.conv(F.substring(F.hex("key"), 25, 7), 16, 10).cast("long") % F.lit(shards)).cast("int")


def _shard_of(identity: bytes, shards: int) -> int:
    return (int.from_bytes(identity[12:16], "big") >> 4) % shards


def _built(keys: DataFrame) -> DataFrame:
    """Filters from (shard, key); a shard has about SHARD_KEYS keys at most."""

    def build(shard, pdf):
        import pandas as pd

        keys, size = list(pdf["key"]), len(pdf)
        while not (made := Cuckoo.sized(size)).insert(keys):
            size = 2 * size + 8
        return pd.DataFrame({"shard": [shard[0]], "buckets": [made.mask + 1], "cells": [made.table.tobytes()]})

    return keys.groupBy("shard").applyInPandas(build, FILTER_SCHEMA)


@dataclass(frozen=True)
class LineIndex:
    """One generation of reference counts and filters, both tables in the shared folder."""

    refs: DataFrame  # key, docs
    filters: DataFrame  # shard, buckets, cells
    shards: int
    min_docs: int = MIN_DOCS
    min_chars: int = MIN_CHARS

    @staticmethod
    def build(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> LineIndex:
        refs = written(line_counts(docs, min_chars), "line-refs")
        hot = refs.where(F.col("docs") >= min_docs)
        shards = max(1, math.ceil(hot.count() / SHARD_KEYS))
        filters = written(_built(hot.select(_shard(shards).alias("shard"), "key")), "line-filters")
        return LineIndex(refs, filters, shards, min_docs, min_chars)

    def insert(self, docs: DataFrame) -> LineIndex:
        return self._changed(docs, 1)

    def delete(self, docs: DataFrame) -> LineIndex:
        """Takes back documents that were inserted; counts never fall below nothing."""
        return self._changed(docs, -1)

    def _changed(self, docs: DataFrame, sign: int) -> LineIndex:
        delta = line_counts(docs, self.min_chars).select("key", F.lit(0).cast("long").alias("before"), (F.col("docs") * sign).alias("change"))
        both = self.refs.select("key", F.col("docs").alias("before"), F.lit(0).cast("long").alias("change")).unionByName(delta)
        summed = both.groupBy("key").agg(F.sum("before").alias("before"), (F.sum("before") + F.sum("change")).alias("docs"))
        state = written(summed, "line-state")
        refs = written(state.where("docs > 0").select("key", "docs"), "line-refs")
        was, now = F.col("before") >= self.min_docs, F.col("docs") >= self.min_docs
        moves = state.where(was != now).select(_shard(self.shards).alias("shard"), "key", now.alias("enters"))

        def update(held, moved):
            import pandas as pd

            shard = int((held if len(held) else moved)["shard"].iloc[0])
            table = Cuckoo(int(held["buckets"].iloc[0]), held["cells"].iloc[0]) if len(held) else Cuckoo.sized(len(moved))
            table.delete(list(moved.loc[~moved["enters"], "key"]))
            fits = table.insert(list(moved.loc[moved["enters"], "key"]))
            return pd.DataFrame({"shard": [shard], "buckets": [table.mask + 1], "cells": [table.table.tobytes() if fits else None]})

        updated = written(self.filters.groupBy("shard").cogroup(moves.groupBy("shard")).applyInPandas(update, FILTER_SCHEMA), "line-filters")
        full = updated.where("cells IS NULL").select("shard")
        if full.take(1):
            again = refs.where(F.col("docs") >= self.min_docs).select(_shard(self.shards).alias("shard"), "key").join(full, "shard", "left_semi")
            updated = written(updated.where("cells IS NOT NULL").unionByName(_built(again)), "line-filters")
        return LineIndex(refs, updated, self.shards, self.min_docs, self.min_chars)

    def mistaken(self, held) -> DataFrame:
        """Keys of the reference table that are not frequent but that the broadcast filters answer for."""
        shards = self.shards

        def probe(batches) -> Iterator:
            import pyarrow as pa

            tables = _tables(held.value)
            for batch in batches:
                keys = batch.column(0).to_pylist()
                hit = [k for k, yes in zip(keys, _probe(tables, shards, keys), strict=True) if yes]
                if hit:
                    yield pa.RecordBatch.from_arrays([pa.array(hit, pa.binary())], names=["key"])

        return self.refs.where(F.col("docs") < self.min_docs).select("key").mapInArrow(probe, "key binary")


def _tables(filters) -> dict[int, Cuckoo]:
    return {shard: Cuckoo(buckets, bytes(cells)) for shard, buckets, cells in filters}


def _probe(tables: dict[int, Cuckoo], shards: int, identities: list[bytes]) -> list[bool]:
    if shards == 1:
        return tables[0].holds(identities) if 0 in tables else [False] * len(identities)
    found = [False] * len(identities)
    by_shard: dict[int, list[int]] = {}
    for i, identity in enumerate(identities):
        by_shard.setdefault(_shard_of(identity, shards), []).append(i)
    for shard, places in by_shard.items():
        if shard in tables:
            for i, yes in zip(places, tables[shard].holds([identities[i] for i in places]), strict=True):
                found[i] = bool(yes)
    return found


def _out_schema(docs: DataFrame) -> T.StructType:
    kept = [f for f in docs.schema.fields if f.name not in ("n_lines", "n_dropped")]
    kept = [T.StructField("text", T.StringType()) if f.name == "text" else f for f in kept]
    return T.StructType([*kept, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])


def drop_frequent_lines(docs: DataFrame, index: LineIndex, held_bytes: int = HELD_BYTES) -> DataFrame:
    """``docs`` with frequent lines gone from text, and n_lines and n_dropped added (columns of these names are replaced).

    Every row is a document of its own: equal rows and rows sharing a doc_id count each, null ids too. A null or
    empty text is one empty line, which has no key and stays, as an empty text. A text whose lines all go becomes
    empty. Keys of fewer than ``min_chars`` code points never count. An empty table stays empty.
    """
    size = index.filters.agg(F.coalesce(F.sum(F.length("cells")), F.lit(0))).first()[0]
    if size <= held_bytes:
        held = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in index.filters.collect()])
        wrong = index.mistaken(held).limit(held_bytes // 64 + 1).collect()
        if len(wrong) <= held_bytes // 64:
            return _dropped_by_probe(docs, index, held, frozenset(bytes(r[0]) for r in wrong))
    return _dropped_by_join(docs, index)


def _dropped_by_probe(docs: DataFrame, index: LineIndex, held, wrong: frozenset) -> DataFrame:
    schema, shards, least = _out_schema(docs), index.shards, index.min_chars
    names = [f.name for f in schema.fields]

    def drop(batches) -> Iterator:
        import pyarrow as pa

        tables = _tables(held.value)
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            split = [(text or b"").split(b"\n") for text in text_bytes(batch)]
            keys = [line_key(line) for lines in split for line in lines]
            identities = [_identity(k) for k in keys]
            hit = _probe(tables, shards, identities)
            at = 0
            for lines in split:
                keep = [line for i, line in enumerate(lines, at) if not (hit[i] and keys[i] and identities[i] not in wrong and _has_length(keys[i], least))]
                at += len(lines)
                texts.append(b"\n".join(keep))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(keep))
            made = {"text": pa.array(texts, pa.binary()).cast(pa.string()), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())}
            yield pa.RecordBatch.from_arrays([made[n] if n in made else batch.column(batch.schema.get_field_index(n)) for n in names], names=names)

    return docs.select(*[n for n in docs.columns if n not in ("n_lines", "n_dropped")]).mapInArrow(drop, schema)


def _dropped_by_join(docs: DataFrame, index: LineIndex) -> DataFrame:
    """The same where the filters are too large to hold: each text's distinct keys meet the frequent keys in a shuffle join."""
    columns = [n for n in docs.columns if n not in ("n_lines", "n_dropped")]
    content = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)

    def keys(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids, found = [], []
            for content, text in zip(batch.column(0).to_pylist(), text_bytes(batch), strict=True):
                for key in {line_key(line) for line in (text or b"").split(b"\n")}:
                    ids.append(content)
                    found.append(_identity(key))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(found, pa.binary())], names=["content", "key"])

    distinct = docs.select(content.alias("content"), "text").mapInArrow(keys, "content string, key binary").dropDuplicates()
    hot = index.refs.where(F.col("docs") >= index.min_docs).select("key")
    per_text = distinct.join(hot, "key", "left_semi").groupBy("content").agg(F.collect_list("key").alias("__hot"))
    joined = docs.select(*columns, content.alias("__content")).join(per_text.withColumnRenamed("content", "__c"), F.col("__content") == F.col("__c"), "left").select(*columns, "__hot")
    schema, least = _out_schema(docs), index.min_chars
    names = [f.name for f in schema.fields]

    def drop(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, hot_keys in zip(text_bytes(batch), batch.column(batch.schema.get_field_index("__hot")).to_pylist(), strict=True):
                lines, hot_set = (text or b"").split(b"\n"), frozenset(hot_keys or ())
                keep = [line for line in lines if not (hot_set and (key := line_key(line)) and _identity(key) in hot_set and _has_length(key, least))]
                texts.append(b"\n".join(keep))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(keep))
            made = {"text": pa.array(texts, pa.binary()).cast(pa.string()), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())}
            yield pa.RecordBatch.from_arrays([made[n] if n in made else batch.column(batch.schema.get_field_index(n)) for n in names], names=names)

    return joined.mapInArrow(drop, schema)
