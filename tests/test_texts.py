"""Canonical texts and envelopes: what is escaped, what is dropped, what is judged."""

import json

from pyspark.sql import functions as F

from tidemark.functions.hashing import json_string
from tidemark.functions.scalar import is_sha256, plain_decimal
from tidemark.operators.fundamentals import ENVELOPE, validate_fundamentals


def test_json_strings_read_back_as_they_were(spark):
    texts = ["plain", 'a\\b"&\'+<>`', "\n\r\t\b\f\x01\x7f", "é😀", "end\u2028", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(2)
    got = {r.t: r.j for r in df.select("t", json_string(F.col("t")).alias("j")).collect()}
    assert {t: json.loads(got[t]) for t in texts} == {t: t for t in texts}
    assert all(j.isascii() for j in got.values()) and got['a\\b"&\'+<>`'] == '"a\\\\b\\u0022\\u0026\\u0027\\u002B\\u003C\\u003E\\u0060"'


def test_decimals_lose_zeros_and_a_dangling_point(spark):
    texts = {"1.50": "1.5", "1.00": "1", "1.": "1", "100": "100", "0.0": "0", "n/a": "n/a"}
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(2)
    assert {r.t: r.d for r in df.select("t", plain_decimal("t").alias("d")).collect()} == texts


def test_digest_shape_is_judged_to_the_last_character(spark):
    texts = {"a" * 64: True, "a" * 64 + "\n": False, "a" * 63: False, "A" * 64: False}
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(2)
    assert {r.t: r.s for r in df.select("t", is_sha256("t").alias("s")).collect()} == texts


def test_envelope_names_are_judged_in_any_order(spark):
    body = {f: None for f in ENVELOPE} | {
        "policyId": "fundamental-v0.1.0", "schemaVersion": 1, "claim": "FundamentalFact", "scopeKind": "REPORTING_ENTITY", "sourceId": "a", "assertionKey": "k", "authorityTier": "T1",
        "revisionSeriesId": "a\x1ffundamental-v0.1.0/FundamentalFact/k", "revisionNumber": 1, "knownAt": "2020-01-01T00:00:00Z", "recordedAt": "2020-01-01T00:00:00Z", "payloadSha256": "0" * 64}
    turned = dict(reversed(body.items()))
    short = {k: v for k, v in body.items() if k not in ("subject", "receipt")} | {"extra": 1}
    twice = json.dumps(body | {"payload": "@"}).replace('"@"', '{"a": 1, "a": 2}')
    rows = [(0, json.dumps(body)), (1, json.dumps(turned)), (2, json.dumps(short)), (3, twice)]
    got = {r.i: r.diagnostics for r in validate_fundamentals(spark.createDataFrame(rows, "i int, body string")).collect()}
    bad = "FUNDAMENTAL_MALFORMED@/"
    assert got == {0: [], 1: [], 2: [bad, f"{bad}receipt", f"{bad}subject"], 3: [bad]}
