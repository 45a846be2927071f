from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.operators import technical as tc

DAYS = "request_id string, session_date date, target boolean, closed boolean, completed boolean, scheduled_open boolean, schedule_conflicting boolean, exchange_id string, currency string, coverage boolean, failed boolean, breaks int, matching_prices int, volume long, volume_unit string, volume_basis string, market_segment string"
MARKET = "request_id string, session_date date, identity_conflict boolean, identity_verified boolean, type_unsupported boolean, type_known boolean, pre_listing boolean, post_delisting boolean, listing_known boolean, board_conflict boolean, mechanism_unresolved boolean, board_known boolean, board_unsupported boolean, mechanism_known boolean, status string, status_quality string, session_completed boolean"
BARS = "instrument_id string, session_date date, open decimal(20,8), high decimal(20,8), low decimal(20,8), close decimal(20,8), volume long"
REQUESTS = "request_id string, instrument_id string, benchmark_id string, history_from date, evaluation_date date, cutoff timestamp"
START = date(2024, 1, 1)  # a Monday


def sessions(n):
    out, day = [], START
    while len(out) < n:
        if day.weekday() < 5:
            out.append(day)
        day += timedelta(1)
    return out


PLAIN = dict(identity_conflict=False, identity_verified=True, type_unsupported=False, type_known=True, pre_listing=False, post_delisting=False, listing_known=True, board_conflict=False, mechanism_unresolved=False, board_known=True, board_unsupported=False, mechanism_known=True)


class Cases:
    """Requests over rising closes, one per name; each changes some of its days. All of them run at once."""

    def __init__(self):
        self.days, self.side, self.market, self.bars, self.index, self.requests = [], [], [], [], [], []

    def add(self, name, n=70, changes=None, status=None, lost=(), benchmark=True):
        dates, changes, status = sessions(n), changes or {}, status or {}
        last = dates[-1]
        price = lambda i: 100 + i % 7 + i / 4
        exact = lambda *v: [Decimal(str(round(x, 8))) for x in v]
        for d in (START + timedelta(i) for i in range((last - START).days + 1)):
            base = dict(target=d == last, closed=False, completed=d in dates, scheduled_open=d.weekday() < 5, schedule_conflicting=False, exchange_id="X1", currency="IDR", coverage=True, failed=False, breaks=0, matching_prices=int(d in dates))
            tail = (100, "SHARES", "RAW_AS_TRADED", "REGULAR")
            self.days.append((name, d, *{**base, **changes.get(d, {})}.values(), *tail))
            if benchmark:
                self.side.append((name, d, *base.values(), *tail))
            self.market.append((name, d, *PLAIN.values(), status.get(d, "TRADING"), "VERIFIED", True))
        for i, d in enumerate(dates):
            if d not in lost:
                self.bars.append((name, d, *exact(price(i), price(i) + 1, price(i) - 1, price(i)), 100))
            self.index.append((f"{name}-index", d, *exact(50 + i / 3, 51 + i / 3, 49 + i / 3, 50 + i / 3), 9))
        self.requests.append((name, name, f"{name}-index", START, last, datetime(2030, 1, 1)))
        return self

    def frames(self, spark, order=list):
        make = lambda rows, schema: spark.createDataFrame(order(rows), schema)
        return make(self.requests, REQUESTS), make(self.days, DAYS), make(self.side, DAYS), make(self.market, MARKET), make(self.bars, BARS), make(self.index, BARS)

    def run(self, spark, order=list):
        requests, days, side, market, bars, index = self.frames(spark, order)
        side = tc.history_states(side)
        return tc.technical_results(requests, tc.compose_readiness(tc.history_states(days), side, market), bars, side, index)


def cases():
    at = sessions(130)
    x = Cases().add("plain").add("no benchmark", benchmark=False).add("broken", 130, {at[59]: {"breaks": 1}}).add("too short", 100, {at[59]: {"breaks": 1}})
    return x.add("lost bar", lost=(at[30],)).add("suspended", status={at[68]: "SUSPENDED"}).add("thirty", 30)


@pytest.fixture(scope="module")
def executed(spark):
    return cases().run(spark).cache()


@pytest.fixture(scope="module")
def results(executed):
    return {r["request_id"]: r for r in executed.collect()}


def test_ready_input_executes(results):
    r = results["plain"]
    assert r["technical_evaluated"] and r["failure"] is None and r["bars"] == 70 and r["setup_evaluated"]
    closes = [100 + i % 7 + i / 4 for i in range(70)]
    ema = sum(closes[:20]) / 20
    for c in closes[20:]:
        ema += 2 / 21 * (c - ema)
    assert r["ema20"]["value"] == pytest.approx(ema, rel=1e-12) and r["priorHigh20"]["value"] == max(closes[-21:-1]) + 1
    assert r["rs20Pp"]["availability"] == "AVAILABLE" and r["benchmark_trend"] == "POSITIVE" and r["actualTradedValue"]["reason"] == "PRICE_BASIS_UNVERIFIED"
    assert r["episode_id"] is None or r["episode_id"].startswith("screener-v0.2.0/plain/")


def test_without_a_benchmark_it_still_executes(results):
    r = results["no benchmark"]
    assert r["technical_evaluated"] and r["rs20Pp"]["reason"] == "BENCHMARK_MISSING" and r["benchmark_ema20"]["reason"] == "BENCHMARK_MISSING" and r["benchmark_trend"] == "UNKNOWN"


def test_a_known_break_leaves_the_clean_run_after_it(results):
    r = results["broken"]
    assert r["technical_evaluated"] and r["bars"] == 70 and "PRICE_KNOWN_BREAK" in r["reasons"]
    r = results["too short"]
    assert not r["technical_evaluated"] and r["failure"] == "DATA_NOT_READY" and r["setup"] == "NONE" and {"NOT_EVALUATED", "INSUFFICIENT_HISTORY"} <= set(r["reasons"])
    assert not results["thirty"]["technical_evaluated"]


def test_a_bar_that_readiness_counted_and_nobody_has_is_a_mismatch(results):
    r = results["lost bar"]
    assert not r["technical_evaluated"] and r["failure"] == "TECHNICAL_REPLAY_BINDING_MISMATCH" and r["input_hash"] is None


def test_an_exclusion_in_the_past_interrupts_the_episode(results):
    r = results["suspended"]
    assert r["technical_evaluated"] and (r["start_date"] is None or r["start_date"] == sessions(70)[69])


def test_order_of_rows_changes_nothing(spark, results):
    again = {r["request_id"]: r for r in cases().run(spark, lambda rows: rows[::-1]).collect()}
    assert again == results


def test_consecutive_changes_of_exchange_end_every_second_run(spark):
    at = sessions(12)
    changes = {at[4]: {"exchange_id": "X2"}, at[5]: {"exchange_id": "X3"}} | {START + timedelta(i): {"exchange_id": "X4"} for i in range(8, 16)}
    closed = {"closed": True, "completed": False, "matching_prices": 0}
    x = Cases().add("changes", 12, changes).add("bridged", 12, {at[3]: closed, at[6]: {**closed, "currency": "USD"}})
    rows = {(r["request_id"], r["session_date"]): r for r in tc.history_states(x.frames(spark)[1]).collect()}
    assert [rows["changes", d]["pos"] for d in at] == [1, 2, 3, 4, None, 1, None, 1, 2, 3, 4, 5]
    assert rows["changes", at[4]]["comparability_reasons"] == ["IDENTITY_CONFLICT"]
    # A closed day is bridged, one with another currency ends the run, and the day after it begins anew.
    assert rows["bridged", at[3]]["bridged"] and rows["bridged", at[3]]["comparability"] is None and rows["bridged", at[4]]["pos"] == 4
    assert rows["bridged", at[6]]["comparability"] == "UNRESOLVED" and rows["bridged", at[7]]["pos"] == 1


def test_candidates_survive_a_rerun_and_show_conflicts(spark, executed):
    first = tc.promote(executed).collect()
    again = tc.promote(executed, spark.createDataFrame(first)).collect()
    assert {r["request_id"] for r in first} == {"plain", "no benchmark", "broken", "suspended"} and {r["disposition"] for r in again} == {"RETAINED"}
    assert {(r["request_id"], r["decision_id"]) for r in again} == {(r["request_id"], r["decision_id"]) for r in first}
    other = tc.promote(executed.withColumn("setup", F.lit("FAILED")), spark.createDataFrame(first)).collect()
    assert {r["disposition"] for r in other} == {"CONFLICT"} and not any(r["candidate"] for r in other)
