"""The text operators as named queries, with SQL where it can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import oracles
from tidemark.session import pin_session

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def wrap(fn):
        name = fn.__name__
        QUERIES[name] = lambda spark, sf_dir: fn(pin_session(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(oracles.license_scan())
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.license_scan import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


@query(oracles.line_dedup())
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.line_dedup import LineIndex, drop_frequent_lines

    docs = table(spark, sf_dir, "documents")
    kept = drop_frequent_lines(docs.select("doc_id", "text"), LineIndex.build(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query()
def op2_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.fertility import fertility_filter

    return fertility_filter(table(spark, sf_dir, "documents"))


@query(oracles.mixing())
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.mixing import mixed

    return mixed(table(spark, sf_dir, "documents")).drop("source")


@query(oracles.warc())
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.common import work_folder
    from tidemark.llm.warc import read_archives, with_revisits, write_archives

    folder = work_folder(spark, "warc")
    write_archives(with_revisits(table(spark, sf_dir, "pages")), folder)
    back = read_archives(spark, folder).where(F.col("record_type").isin("response", "revisit"))
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1)
    intact = F.when(F.col("digest_ok").isNull() | F.col("digest_ok"), F.col("payload_digest"))
    return back.select(
        F.when(number("record_id") != "", number("record_id")).cast("long").alias("page_id"), "payload_bytes", intact.alias("payload_digest"), "record_type", F.when(number("refers_to") != "", number("refers_to")).cast("long").alias("refers_to")
    )


@query(oracles.jaccard())
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.jaccard_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=85)


@query()
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op7_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


@query()
def op4_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.resample import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "n_features", "log_ratio", "score", "key")


@query()
def op8_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.pseudonyms import pseudonymised

    return pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), key="a key for tests")


@query()
def op11_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.sharding import balanced_shards

    placed = balanced_shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query(oracles.centroids())
def op12_ptolemaic_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.pivots import centroid_clusters

    return centroid_clusters(table(spark, sf_dir, "embeddings"))


@query()
def op13_feast_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.whitening import whitened

    return whitened(table(spark, sf_dir, "embeddings"))
