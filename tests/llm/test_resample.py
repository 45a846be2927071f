from pyspark.sql import functions as F

from tidemark.llm import resample as rs


def tables(spark, sf="sf0.01"):
    return (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))


def test_rejects_what_target_text_avoids_and_keeps_the_rest(spark):
    docs, labels = tables(spark)
    kept = {r[0] for r in rs.resample(docs, labels).select("doc_id").collect()}
    marked = docs.withColumn("bad", F.lower("text").rlike("trash|pathetic|idiot|disgusting|worthless|stupid|loser|clown|scum|moron"))
    bad = {r[0] for r in marked.where("bad").select("doc_id").collect()}
    good = {r[0] for r in labels.where("quality = 1 AND toxic = 0").select("doc_id").collect()} - bad
    assert len(kept & bad) <= 0.03 * len(bad)
    assert len(kept & good) >= 0.99 * len(good)
    assert kept == {r[0] for r in rs.resample(docs.repartition(7), labels).select("doc_id").collect()}


def test_counts_equal_a_plain_count(spark, odd):
    import numpy as np

    texts = [(r["doc_id"], (r["text"] or "").encode()) for r in odd.collect()]
    features = [set(f.tolist()) for f in rs._features([t for _, t in texts], rs._Numbers())]
    want = {}
    for (doc_id, _), found in zip(texts, features, strict=True):
        for f in found:
            raw, mine = want.get(f, (0, 0))
            want[f] = (raw + 1, mine + (doc_id in (1, 9)))
    plain = lambda bits: {r["feature"]: (r["raw"], r["target"]) for r in rs.feature_counts(odd, [1, 9], bits).collect()}
    assert plain(None) == want
    # The sketch loses no feature of three documents or more, and spares most of the others.
    some = plain(rs.frequent_cells(odd, 3))
    frequent = {f: c for f, c in want.items() if c[0] >= 3}
    assert frequent.items() <= some.items() <= want.items() and len(some) - len(frequent) < 0.01 * len(want)
    every = np.array(sorted(want))
    assert all(0 <= rs._cell(every, row).min() and rs._cell(every, row).max() < rs.CELLS for row in range(rs.DEPTH))


def test_a_sample_of_stated_size_and_ties(spark):
    docs, labels = tables(spark, "sf0.001")
    assert rs.resample(docs, labels, k=50).count() == 50 and rs.resample(docs, labels, k=0).count() == 0
    # Equal rows have equal keys, so all of a tie at the last key stay.
    twice = docs.unionByName(docs)
    kept = rs.resample(twice, labels, k=51)
    assert kept.count() == 52 and kept.select("doc_id").distinct().count() == 26


def test_kth_greatest(spark):
    rows = spark.range(20_000).select((F.hash("id") % 997).cast("double").alias("x"))
    values = sorted((r[0] for r in rows.collect()), reverse=True)
    for k in (1, 2, 777, 19_999, 20_000):
        assert rs.kth_greatest(rows, "x", k, bins=16, few=50) == values[k - 1]


def test_odd_and_empty(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (9, None, None)], "doc_id long, quality int, toxic int")
    assert rs.resample(odd, labels).count() == odd.count()
    assert rs.resample(none, labels).collect() == []
    assert rs.resampled(odd, labels.limit(0)).count() == odd.count()


def test_finds_each_feature_that_fails_alone(spark):
    import numpy as np

    common, bad = "common", "bad"
    rows = [(i, f"{common} t{i % 7}" + (f" {bad}" if i % 8 == 1 else "")) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 800, 2)], "doc_id long, quality int, toxic int")
    model = rs.fit(docs, labels)
    feature = next(rs._features([bad.encode()], rs._Numbers()))[0]
    assert feature in model[0]
    # All features, counted and tested plainly.
    good = set(range(0, 800, 2))
    counts = {}
    for (i, _), found in zip(rows, rs._features([t.encode() for _, t in rows], rs._Numbers()), strict=True):
        for f in found.tolist():
            raw, mine = counts.get(f, (0, 0))
            counts[f] = (raw + 1, mine + (i in good))
    tested = {f: c for f, c in counts.items() if c[0] * 0.5 >= rs.EXPECTED}
    failed = rs._unlikely(np.array([c[1] for c in tested.values()]), np.array([c[0] for c in tested.values()]), 0.5, rs.ERROR / len(tested))
    low = [np.log((c[1] + rs.ADDED) / (c[0] * 0.5 + rs.ADDED)) <= rs.LEAST_LOG for c in tested.values()]
    assert model[0].tolist() == sorted(f for f, a, b in zip(tested, failed, low, strict=True) if a and b)
