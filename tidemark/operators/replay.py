"""Datasets and decision manifests addressed by content, and replay of decisions from retained inputs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.hashing import bar_content_hash
from tidemark.operators.digests import ordered_digest
from tidemark.operators.outcomes import field_differences
from tidemark.session import shared

def dataset_id(query_text: Column, runs: DataFrame, observations: DataFrame) -> DataFrame:
    """Digest of a research dataset: the query, its runs by run_id and its observations by run and instrument, each an ordered tree."""
    first = ordered_digest(runs, [], ["run_id"], name="runs_digest").withColumnRenamed("members", "runs")
    second = ordered_digest(observations, [], ["run_id", "instrument_id"], name="observations_digest").withColumnRenamed("members", "observations")
    both = first.join(second)  # one row each
    return both.select(F.sha2(F.concat_ws("|", query_text, "runs_digest", "observations_digest"), 256).alias("dataset_id"), "runs", "observations")


def capture_manifests(inputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What each request used, stored once per content.

    ``inputs``: request_id, instrument_id, session_date, revision_number, known_at, content_hash. Returns links
    (request_id, manifest_id, inputs) and entries (manifest_id and the rest); requests that selected the same revisions
    share one manifest, whose id is the ordered digest of its entries.
    """
    inputs = shared(inputs)
    fields = ["instrument_id", "session_date", "revision_number", "known_at", "content_hash"]
    links = shared(ordered_digest(inputs, ["request_id"], ["instrument_id", "session_date"], fields, "manifest_id").withColumnRenamed("members", "inputs"))
    owner = links.groupBy("manifest_id").agg(F.min("request_id").alias("request_id"))
    return links, inputs.join(owner, "request_id").select("manifest_id", *fields)


def fetch_manifests(entries: DataFrame, store: DataFrame, content: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Retained revisions of manifests, and what is wrong with them.

    ``store``: instrument_id, session_date, revision_number, known_at, content_hash and the bar. A revision that is gone
    is CANONICAL_REVISION_MISSING; one whose clock, stored hash or recomputed hash (``content``) is not what the manifest
    says is CANONICAL_REVISION_INTEGRITY_FAILED. Returns (manifest_id, store columns) and (manifest_id, missing, altered).
    """
    key = ["instrument_id", "session_date", "revision_number"]
    content = bar_content_hash() if content is None else content
    kept = store.withColumn("__content", content).withColumnRenamed("known_at", "__known").withColumnRenamed("content_hash", "__hash")
    met = shared(entries.join(kept, key, "left"))
    gone = F.col("__hash").isNull()
    altered = ~gone & ~((F.col("__hash") == F.col("content_hash")) & F.col("__content").eqNullSafe(F.col("content_hash")) & F.col("__known").eqNullSafe(F.col("known_at")))
    state = met.groupBy("manifest_id").agg(F.count_if(gone).alias("missing"), F.count_if(altered).alias("altered"))
    return met.where(~gone).select("manifest_id", *[c for c in store.columns]), state


def replay_decisions(runs: DataFrame, links: DataFrame, entries: DataFrame, store: DataFrame, screen: Callable[[DataFrame], DataFrame], stored: DataFrame, fields: Sequence[str], policy: str, content: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Verdict per run from a replay of its retained inputs, and every field that differs.

    ``runs``: run_id, policy_id, manifest_id (as captured). ``links``: request_id, manifest_id as the manifest now stands. ``screen``
    maps bars with run_id to rows (run_id, instrument_id, fields); each manifest is screened once, whatever number of
    runs rest on it. ``stored`` has the captured rows.

    POLICY_VERSION_UNAVAILABLE if the policy is another; INPUT_NOT_AVAILABLE with a detail if the manifest or a revision
    is gone; DIFFERENT_RESULT if an altered revision or another row or field comes out; else MATCH. An altered revision
    is screened as it stands, so the differences show what it changed, and input_hash differs in any case.
    """
    bars, state = fetch_manifests(entries, store, content)
    complete = state.where("missing = 0").select("manifest_id")
    replayed = screen(bars.join(complete, "manifest_id", "left_semi").withColumnRenamed("manifest_id", "run_id")).withColumnRenamed("run_id", "manifest_id")
    head = shared(runs.join(state, "manifest_id", "left"))
    able = head.where((F.col("policy_id") == policy) & (F.col("missing") == 0)).select("run_id", "manifest_id")
    again = able.join(replayed, "manifest_id").drop("manifest_id")
    differences = field_differences(stored.join(able.select("run_id"), "run_id", "left_semi"), again, ("run_id", "instrument_id"), fields)
    hashes = head.where((F.col("policy_id") == policy) & (F.col("missing") == 0) & (F.col("altered") > 0)).select(
        "run_id", F.lit(None).cast(stored.schema["instrument_id"].dataType).alias("instrument_id"), F.lit("inputHash").alias("field"), F.col("manifest_id").alias("stored"), F.concat(F.col("altered").cast("string"), F.lit(" altered")).alias("recomputed"))
    differences = shared(differences.unionByName(hashes))
    totals = differences.groupBy("run_id").agg(F.count("*").alias("differences"))
    x = head.join(totals, "run_id", "left").withColumn("differences", F.coalesce("differences", F.lit(0)))
    held = links.select("manifest_id").distinct().withColumn("__held", F.lit(True))
    x = x.join(held, "manifest_id", "left")
    detail = F.when(F.col("policy_id") != policy, F.lit(None)).when(F.col("__held").isNull() | F.col("missing").isNull(), F.lit("MANIFEST_MISSING")).when(F.col("missing") > 0, F.lit("CANONICAL_REVISION_MISSING")).when(F.col("altered") > 0, F.lit("CANONICAL_REVISION_INTEGRITY_FAILED"))
    verdict = F.when(F.col("policy_id") != policy, F.lit("POLICY_VERSION_UNAVAILABLE")).when(detail.isin("MANIFEST_MISSING", "CANONICAL_REVISION_MISSING"), F.lit("INPUT_NOT_AVAILABLE")).when(F.col("differences") > 0, F.lit("DIFFERENT_RESULT")).otherwise(F.lit("MATCH"))
    return x.select("run_id", verdict.alias("verdict"), detail.alias("detail"), "differences"), differences
