"""The corpus pipeline: documents through five stages, each written as Parquet and read again.

Stages take and return tables with the columns of documents; the last returns what the mix takes of each document.
Rows with a null doc_id are documents like others; rows repeated with one doc_id and text are one document after the
near-duplicate stage. Empty tables pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import work_folder
from tidemark.llm.decontaminate import decontaminated
from tidemark.llm.jaccard_join import near_duplicates
from tidemark.llm.line_dedup import LineIndex, drop_frequent_lines
from tidemark.llm.mixing import mixed
from tidemark.llm.resample import resampled
from tidemark.session import pin_session


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling: documents that it does not draw go."""
    return resampled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in ten documents or more go from all; n_chars follows the text. A document whose lines all go stays, empty."""
    kept = drop_frequent_lines(docs, LineIndex.build(docs)).drop("n_lines", "n_dropped")
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents linked by five-word shingles at a Jaccard similarity of 0.8, that of the least doc_id stays."""
    least = near_duplicates(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__id")).dropDuplicates()
    kept = docs.join(least, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    return kept.withColumn("__content", F.xxhash64("text")).dropDuplicates(["doc_id", "__content"]).drop("__content")


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item, also with other numbers or names in it, go."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that a mix by source weights takes of each document."""
    return mixed(docs)


#: Documents of an Arrow batch. The texts of a batch stand in the executor's buffers and, several times over, in a Python worker; the default of 10,000 documents fills most of a worker's memory with them.
BATCH_ROWS = 1_000


def small_batches(stage):
    """The stage, with BATCH_ROWS for what it and the reader of its result send to Python."""

    def staged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return staged


STAGES = [
    (name, small_batches(stage))
    for name, stage in (("quality classifier", quality), ("line dedup", lines), ("n-gram Jaccard join", near_copies), ("benchmark decontamination", benchmark_free), ("mixing sources", mix))
]

#: The quality stage rests on hashes and random draws that SQL does not state; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    pin_session(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        folder = work_folder(spark, "stage-" + name.replace(" ", "-").lower())
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
