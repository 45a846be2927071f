from pyspark.sql import functions as F

from tidemark.llm.langid import held_out, identify


def test_held_out_accuracy_and_mixtures(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    first = {r["lang"]: r["text"] for r in docs.where("n_chars > 600 AND lang IN ('de', 'es')").orderBy("doc_id").select("lang", "text").collect()}
    mixed = docs.limit(1).select(F.lit(10**9 + 1).cast("long").alias("doc_id"), F.lit(first["de"][:600] + " " + first["es"][:300]).alias("text"), F.lit(None).cast("string").alias("lang"), "source", "n_chars")
    rows = identify(docs.unionByName(mixed))
    both = rows.join(docs.select("doc_id", "lang"), "doc_id")
    share = both.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert share > 0.99
    mix = rows.where(F.col("doc_id") == 10**9 + 1).first()
    assert [x["lang"] for x in mix["languages"]] == ["de", "es"] and abs(mix["score"] - 2 / 3) < 0.1


def test_predictions_do_not_see_the_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    other = docs.withColumn("lang", F.when(held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit(None).cast("string"))
    a, b = (sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in identify(d).collect()) for d in (docs, other))
    assert a == b


def test_odd_and_empty(odd, none):
    rows = identify(odd).collect()
    assert len(rows) == odd.count()
    assert {(r["lang_pred"], r["score"]) for r in rows if r["doc_id"] in (2, 3, 4)} == {("und", 0.0)}
    assert all(0.0 <= r["score"] <= 1.0 for r in rows)
    assert identify(none).collect() == []
    assert {r["lang_pred"] for r in identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
