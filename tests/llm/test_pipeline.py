import re
from collections import Counter

import corpus_pipeline as cp
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_each_stage_equals_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = {}
    for name, stage in cp.STAGES:
        folder = cp.work_folder(spark, "stage-test")
        stage(spark, docs, SF).write.parquet(folder)
        steps[name] = (docs.collect(), spark.read.parquet(folder).collect())
        docs = spark.read.parquet(folder)
    before, after = steps["line dedup"]
    key = lambda x: x.encode().strip(b" \t\n\r\x0b\x0c").lower()
    counts = Counter(k for r in before for k in {key(x) for x in (r["text"] or "").split("\n")} if k)
    want = {r["doc_id"]: "\n".join(x for x in (r["text"] or "").split("\n") if counts[key(x)] < 10) for r in before}
    assert {r["doc_id"]: r["text"] for r in after} == want and all(r["n_chars"] == len(r["text"]) for r in after)
    before, after = steps["n-gram Jaccard join"]
    sets = {}
    for r in before:
        words = (r["text"] or "").encode().lower().split()
        size = min(5, len(words))
        sets[r["doc_id"]] = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()
    ids, parent = sorted(sets), {i: i for i in sets}
    root = lambda i: i if parent[i] == i else root(parent[i])
    for i in ids:
        for j in ids:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and root(i) != root(j):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    assert {r["doc_id"] for r in after} == {i for i in ids if root(i) == i}
    before, after = steps["benchmark decontamination"]
    words = lambda t: " ".join(re.findall(r"[^\W_]+", (t or "").lower()))
    items = [words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before if not any(f" {i} " in f" {words(r['text'])} " for i in items)}
    before, after = steps["mixing sources"]
    assert {r["doc_id"]: r["size"] for r in after} == {r["doc_id"]: len((r["text"] or "").encode().split()) for r in before}
    assert abs(sum(r["taken"] for r in after) - 1.5 * sum(r["size"] for r in after)) < 0.02 * sum(r["size"] for r in after)


def test_quality_stage_keeps_clean_documents(spark):
    sf = SF.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    kept = cp.quality(spark, docs, sf)
    assert kept.columns == docs.columns
    good = docs.join(labels.where("quality = 1 AND toxic = 0"), "doc_id", "left_semi")
    assert kept.join(good, "doc_id", "left_semi").count() >= 0.99 * good.count()
    toxic = kept.where(F.lower("text").rlike("trash|pathetic|idiot|disgusting|worthless|stupid|loser|clown|scum|moron"))
    assert toxic.count() <= 2


def test_odd_and_empty_documents_pass_all_stages(spark, odd, none):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (odd, none):
        for _, stage in cp.STAGES[:4]:
            out = stage(spark, docs.select(columns), SF)
            assert out.columns == columns
            docs = out
        assert cp.mix(spark, docs, SF).count() == docs.count()
    one = cp.near_copies(spark, odd.select(columns), SF)
    assert one.where("doc_id = 9").count() == 1 and one.where("doc_id = 10").count() == 0


def test_stages_get_small_batches(spark, tmp_path, monkeypatch):
    def sizes(spark, docs, sf_dir):
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["rows"])

        return docs.mapInArrow(run, "rows long")

    spark.range(3000, numPartitions=1).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(cp, "STAGES", [("sizes", cp.small_batches(sizes))])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        rows = [r["rows"] for r in cp.run(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sum(rows) == 3000 and max(rows) <= 1000
