"""Price basis: intervals looked up in place, bars without a day, and the columns an as-of aggregate carries."""

from datetime import date

from tidemark.operators import admission as ad
from tidemark.operators import pit

INTERVAL = "instrument_id string, valid_from date, valid_to date, "


def test_price_basis_of_covered_uncovered_conflicting_and_undated_bars(spark):
    d = lambda n: date(2020, 1, n)
    bars = spark.createDataFrame(
        [(i, s, 1, h, "a", 10, None) for i, s, h in (("A", d(5), "x"), ("A", d(5), "y"), ("A", d(20), "x"), ("A", None, "x"), ("B", d(5), "x"), ("B", None, "x"))],
        "instrument_id string, session_date date, revision_number long, content_hash string, source_id string, volume long, reason string").repartition(3)
    who = spark.createDataFrame([("A", d(1), None, "ORDINARY", "IDR"), ("B", d(1), d(9), "ORDINARY", "IDR"), ("B", d(9), None, "ORDINARY", "IDR")], INTERVAL + "classification string, currency string")
    prices = spark.createDataFrame([(i, d(1), d(9), "a", "STOCK_RAW", "RAW_AS_TRADED", "CLEARED") for i in "AB"], INTERVAL + "source_id string, convention string, continuity string, event_coverage string")
    listed = spark.createDataFrame([("A", d(1), "x")] * 2, "instrument_id string, valid_from date, content_hash string")
    got = ad.clear_price_basis(bars, prices, who, listed)
    missing, conflict = "REFERENCE_INTERVAL_MISSING", "REFERENCE_INTERVAL_CONFLICT"
    rows = {(r.instrument_id, r.session_date, r.content_hash): r.price_reason for r in got.collect()}
    assert rows == {("A", d(5), "x"): None, ("A", d(5), "y"): "PRICE_BASIS_UNVERIFIED", ("A", d(20), "x"): missing, ("A", None, "x"): missing, ("B", d(5), "x"): conflict, ("B", None, "x"): conflict}
    assert got.count() == 6


def test_as_of_bars_carry_only_kept_columns(spark):
    rows = spark.sql("SELECT 'A' AS instrument_id, DATE '2020-01-01' AS session_date, id AS revision_number, TIMESTAMP '2020-01-02' AS known_at, TIMESTAMP '2020-01-02' AS fetched_at, id * 2 AS close, 'wide' AS note FROM range(3)")
    got = pit.bars_as_of(rows, "2020-01-03", keep=["close"])
    assert got.columns == ["instrument_id", "session_date", "known_at", "revision_number", "close"] and got.first()["close"] == 4
