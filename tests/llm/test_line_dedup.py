from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm.line_dedup import Cuckoo, LineIndex, _dropped_by_join, _identity, drop_frequent_lines, line_key

SCHEMA = "doc_id long, text string"


def plain(rows, least=3):
    texts = [(i, (t or "").encode()) for i, t in rows]
    counts = Counter(k for _, t in texts for k in {line_key(x) for x in t.split(b"\n")} if k)
    out = []
    for i, t in texts:
        lines = t.split(b"\n")
        keep = [x for x in lines if counts[line_key(x)] < least or not line_key(x)]
        out.append((i, b"\n".join(keep).decode(), len(lines), len(lines) - len(keep)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in df.select("doc_id", "text", "n_lines", "n_dropped").collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    return [(i, f"line {i}\n Common LINE\t\nodd {i % 2}\nrare {i // 4}\n\n") for i in range(12)] + [(50, "common line"), (51, "É common\né common"), (52, None), (53, ""), (53, ""), (None, "COMMON line\nx")]


def test_both_ways_equal_a_plain_count(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("n_lines", F.lit("clash"))
    index = LineIndex.build(docs, min_docs=3)
    assert got(drop_frequent_lines(docs, index)) == plain(rows)
    assert got(_dropped_by_join(docs, index)) == plain(rows)
    assert got(drop_frequent_lines(docs, index, held_bytes=0)) == plain(rows)


def test_insertions_and_deletions_are_reversible(spark, rows):
    part = lambda keep: spark.createDataFrame([r for i, r in enumerate(rows) if keep(i)], SCHEMA)
    whole = spark.createDataFrame(rows, SCHEMA)
    first = LineIndex.build(part(lambda i: i < 6), min_docs=3)
    grown = first.insert(part(lambda i: i >= 6))
    fresh = LineIndex.build(whole, min_docs=3)
    refs = lambda index: sorted((bytes(r["key"]), r["docs"]) for r in index.refs.collect())
    assert refs(grown) == refs(fresh) and got(drop_frequent_lines(whole, grown)) == plain(rows)
    back = grown.delete(part(lambda i: i >= 6))
    assert refs(back) == refs(first)
    some = [r for i, r in enumerate(rows) if i < 6]
    assert got(drop_frequent_lines(part(lambda i: i < 6), back)) == plain(some)
    # From nothing, so that filters must grow.
    empty = LineIndex.build(whole.limit(0), min_docs=1)
    many = spark.range(3_000).select("id", F.col("id").cast("string").alias("text"))
    assert drop_frequent_lines(many, empty.insert(many)).where("n_dropped <> 1").isEmpty()


def test_cuckoo_filter():
    keys = [_identity(str(i).encode()) for i in range(5_000)]
    table = Cuckoo.sized(len(keys))
    assert table.insert(keys) and all(table.holds(keys))
    again = Cuckoo(table.mask + 1, table.table.tobytes())
    again.delete(keys[:2_000])
    assert all(again.holds(keys[2_000:])) and not any(again.holds(keys[:2_000]))


def test_odd_and_empty(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert got(drop_frequent_lines(odd, LineIndex.build(odd, min_docs=2))) == plain(rows, 2)
    assert drop_frequent_lines(none, LineIndex.build(none)).collect() == []
