"""Golden boundaries: features, episodes, ledger, research arithmetic, calendar policy."""

from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.functions.scalar import decimal_state, independent_reference, plain_decimal
from tidemark.operators import calendar as cal
from tidemark.operators import features as ft
from tidemark.operators import ledger as lg
from tidemark.operators import pit
from tidemark.operators import research as rs
from tidemark.operators.episodes import Bar, advance


def weekdays(n, start=date(2026, 8, 24)):
    out, d = [], start
    while len(out) < n:
        if d.weekday() < 5:
            out.append(d)
        d += timedelta(1)
    return out


def panel(spark, n, drop=(), drop_benchmark=()):
    days = weekdays(n)
    rows = [("A", d, 100.0 + i, 101.0 + i, 99.0 + i, 100.0 + i, 1000) for i, d in enumerate(days) if i not in drop]
    bars = spark.createDataFrame(rows, "instrument_id string, session_date date, open double, high double, low double, close double, volume long")
    calendar = spark.createDataFrame([(d, "ObservedTrading") for d in days], "session_date date, status string")
    bench = spark.createDataFrame([(d, 500.0, 0) for i, d in enumerate(days) if i not in drop_benchmark], "session_date date, close double, volume long")
    return ft.features(ft.align_benchmark(ft.last_runs(bars, calendar), bench), latest=True).first()


@pytest.mark.parametrize("n", [1, 2, 14, 15, 19, 20, 21, 49, 50, 60, 61])
def test_each_feature_becomes_available_exactly_at_its_minimum(spark, n):
    row = panel(spark, n)
    for name, minimum in ft.MINIMUM_SESSIONS.items():
        assert row[name]["availability"] == ("AVAILABLE" if n >= minimum else "WARMUP"), name


def test_missing_session_shortens_the_run_and_missing_benchmark_is_not_guessed(spark):
    row = panel(spark, 61, drop=(51,))
    assert row["sessions"] == 9 and row["ema20"]["availability"] == "WARMUP"
    row = panel(spark, 61, drop_benchmark=(50,))
    assert row["rs20Pp"]["reason"] == "BENCHMARK_MISSING"


def test_smoothing_over_many_blocks_equals_the_plain_recursion(spark):
    n = 3000
    closes = [100 + (i * 37 % 101) / 7 for i in range(n)]
    start = date(2000, 1, 1)
    bars = spark.createDataFrame([("A", start + timedelta(i), c, c + 1, c - 1, c, 10) for i, c in enumerate(closes)], "instrument_id string, session_date date, open double, high double, low double, close double, volume long")
    calendar = bars.select("session_date", F.lit("ObservedTrading").alias("status"))
    got = {r.session_date: r.ema50.value for r in ft.features(ft.runs(bars, calendar)).select("session_date", "ema50").collect()}
    v = sum(closes[:50]) / 50
    for i in range(50, n):
        v += 2 / 51 * (closes[i] - v)
        assert abs(got[start + timedelta(i)] - v) < 1e-9 * v


def test_episode_boundaries():
    high = Decimal(100)
    for close, setup in (("97.99", "NONE"), ("98.00", "WATCH"), ("100.00", "WATCH"), ("100.01", "CONFIRMED")):
        assert advance(None, Bar("a", date(2026, 8, 24), Decimal(close), high), "ELIGIBLE")[1] == setup
    state, seen = None, []
    for i in range(7):
        state, *out = advance(state, Bar("a", date(2026, 8, 24) + timedelta(i), Decimal(99), high), "ELIGIBLE")
        seen.append((out[0], out[2]))
    assert seen[4] == ("WATCH", "WITHIN_WATCH_BAND") and seen[5] == ("NONE", "WATCH_EXPIRED") and seen[6][0] == "WATCH"


LEDGER = "portfolio_id string, event_id string, type string, instrument_id string, trade_date date, known_at timestamp, event_order long, quantity decimal(38,10), price decimal(38,10), fees decimal(38,10), cash_amount decimal(38,10), supersedes string"


def event(i, kind, quantity=0, price=0, fees=0, cash=0, day=1, supersedes=None, known=None):
    return ("P", f"e{i}", kind, "I" if kind in ("BUY", "SELL") else None, date(2026, 9, day), known or datetime(2026, 9, day, 12), i, Decimal(quantity), Decimal(price), Decimal(fees), Decimal(cash), supersedes)


def test_ledger_golden_with_a_correction_of_a_correction(spark):
    rows = [
        event(1, "CASH_DEPOSIT", cash=1_000_000), event(2, "BUY", 1300, 100, 1300, day=2),
        event(3, "SELL", 300, 120, 300, day=3), event(4, "BUY", 1300, 105, 1300, day=2, supersedes="e2", known=datetime(2026, 9, 4)),
        event(5, "BUY", 1300, 110, 1300, day=2, supersedes="e4", known=datetime(2026, 9, 5)),
    ]
    events = spark.createDataFrame(rows, LEDGER)
    before, cash, bad = lg.project_ledger(events, "2026-09-02 23:00:00", "2026-09-30")
    p = before.first()
    assert (p.shares, p.invested_cost, p.average_cost) == (1300, 131300, 101) and cash.first().cash == 868700 and bad.count() == 0
    after, cash, bad = lg.project_ledger(events, "2026-09-30", "2026-09-30")
    p = after.first()
    assert (p.shares, round(p.invested_cost, 6), round(p.average_cost, 6), round(p.realized, 6)) == (1000, 111000, 111, 2400)
    assert cash.first().cash == 891400 and bad.count() == 0
    closed = spark.createDataFrame(rows + [event(6, "SELL", 1000, 50, 0, day=6)], LEDGER)
    p = lg.project_ledger(closed, "2026-09-30", "2026-09-30")[0].first()
    assert p.shares == 0 and p.invested_cost == 0 and p.average_cost is None


def test_research_arithmetic(spark):
    rows = [("g", "AVAILABLE", Decimal(v)) for v in (-10, 0, 5, 15)] + [("g", s, None) for s in ("ANCHOR_UNAVAILABLE", "DATA_UNAVAILABLE", "BASIS_UNCERTAIN", None)]
    r = rs.research_summary(spark.createDataFrame(rows, "cohort string, state string, price_return_pct decimal(20,6)"), ["cohort"]).first()
    assert (r.n, r.a, r.t, r.r, r.u, r.p, r.z, r.m) == (8, 4, 3, 7, 1, 2, 1, 1)
    assert (r.median, r["mean"], r.minimum, r.maximum, r.positive_percent, r.coverage_percent) == (2.5, 2.5, -10, 15, 50, 50)


def test_calendar_policy(spark):
    proofs = spark.createDataFrame([(date(2026, 10, 2), "ObservedTrading", "https://exchange.example/x", datetime(2026, 10, 3), None)], "session_date date, status string, reference string, known_at timestamp, completed_at timestamp")
    days = spark.createDataFrame([(date(2026, 10, d),) for d in (2, 3, 5)], "session_date date")
    got = {r.session_date.day: r.gate for r in cal.session_gate(days, proofs, "2026-10-06 12:00:00").collect()}
    assert got == {2: "ELIGIBLE_PRIOR_COMPLETED_SESSION", 3: "CLOSED_BY_CALENDAR", 5: "SESSION_PROOF_REQUIRED"}


def test_conflict_is_not_last_wins(spark):
    df = spark.createDataFrame([("k", datetime(2026, 1, 1), "a"), ("k", datetime(2026, 1, 2), "b"), ("k", datetime(2026, 1, 2), "c")], "key string, known_at timestamp, value string")
    assert pit.latest_or_conflict(df, ["key"], "known_at", ["value"], "CONFLICT").first().reason == "CONFLICT"
    early = pit.latest_or_conflict(df, ["key"], "known_at", ["value"], "CONFLICT", "2026-01-01 12:00:00").first()
    assert early.value == "a" and early.reason is None


BARS = "instrument_id string, session_date date, content_hash string, fetched_at timestamp, known_at timestamp, n long"


def test_append_keeps_returning_content_and_ignores_stale_and_replays(spark):
    day, t = date(2026, 9, 1), lambda h: datetime(2026, 9, 2, h)
    rows = [("A", day, "a", t(1), t(1), 1), ("A", day, "b", t(2), t(2), 2), ("A", day, "c", t(1), t(3), 3), ("A", day, "a", t(3), t(4), 4), ("A", day, "a", t(5), t(5), 5), ("A", day, "b", t(4), t(6), 6)]
    batch = spark.createDataFrame(rows, BARS).withColumnRenamed("n", "arrival")
    empty = spark.createDataFrame([], BARS).withColumnRenamed("n", "revision_number")
    got = [(r.arrival, r.disposition, r.new_revision_number) for r in pit.append_revisions(empty, batch).orderBy("arrival").collect()]
    assert got == [(1, "INSERTED", 1), (2, "REVISION_APPENDED", 2), (3, "STALE_EVIDENCE_IGNORED", None), (4, "REVISION_APPENDED", 3), (5, "DUPLICATE_IGNORED", None), (6, "REVISION_APPENDED", 4)]


def test_exact_decimals_and_references(spark):
    df = spark.createDataFrame([("1.50",), ("1.12345678901234567890123456789",), ("79228162514264337593543950335",), ("79228162514264337593543950336",), ("n/a",), ("100.00",)], "t string")
    got = df.select(decimal_state("t").alias("s"), plain_decimal("t").alias("p")).collect()
    assert [r.s for r in got] == ["OK", "NUMERIC_OUT_OF_RANGE", "OK", "NUMERIC_OUT_OF_RANGE", "CANONICAL_INVALID", "OK"]
    assert got[0].p == "1.5" and got[5].p == "100"
    urls = spark.createDataFrame([("https://a.example/x",), ("http://a.example/x",), ("https://u:p@a.example/x",), ("https://api.eodhd.com/x",), ("nonsense",)], "u string")
    assert [r[0] for r in urls.select(independent_reference("u")).collect()] == [True, False, False, False, False]
