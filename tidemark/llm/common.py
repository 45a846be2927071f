"""Helpers the text operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import shared_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Cells of ASCII white space, as bytes.split() and bytes.strip() know them.
SPACE = b" \t\n\r\x0b\x0c"


def ascii_lower(text: Column) -> Column:
    """Lower case for A-Z alone; other letters stay."""
    return F.translate(text, UPPER, LOWER)


def work_folder(spark: SparkSession, kind: str) -> str:
    """A new folder under the shared checkpoint folder."""
    return f"{shared_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    folder = work_folder(df.sparkSession, kind)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def text_bytes(batch, name: str = "text") -> list[bytes | None]:
    """A string column of an Arrow batch as UTF-8 bytes."""
    import pyarrow as pa

    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def is_under(df: DataFrame, rows: int) -> bool:
    """Whether a table has at most so many rows; reads no more than needed to tell."""
    return df.limit(rows + 1).count() <= rows
