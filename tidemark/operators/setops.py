"""Set comparisons between declared and actual members, and reuse of cached state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def set_diff(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows on one side only, duplicates counted; columns of ``declared``."""
    other = actual.select(*declared.columns)
    return declared.exceptAll(other).withColumn("side", F.lit("DECLARED_ONLY")).unionByName(
        other.exceptAll(declared).withColumn("side", F.lit("ACTUAL_ONLY")))


def reusable_keys(current: DataFrame, recorded: DataFrame, artifacts: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose whole canonical state equals the recorded one and whose recorded artifact still verifies.

    ``current`` and ``recorded`` hold one row per key and session (keys, session_date, content_hash);
    ``artifacts`` holds keys, recorded_digest, actual_digest.
    """
    state = [*keys, "session_date", "content_hash"]
    a, b = current.select(*state).distinct(), recorded.select(*state).distinct()
    changed = a.subtract(b).unionByName(b.subtract(a)).select(*keys).distinct()
    verified = artifacts.groupBy(*keys).agg(F.bool_and(F.col("recorded_digest") == F.col("actual_digest")).alias("__ok")).where("__ok")
    return recorded.select(*keys).distinct().join(changed, keys, "left_anti").join(verified.select(*keys), keys, "left_semi")
