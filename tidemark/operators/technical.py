"""Readiness of every session of a request's history, technical execution over it, and promotion of candidates.

A request asks about one instrument at one date and cutoff, with a bounded history before it. Every session of that
history gets the readiness it would have had as the request's own date, all in one pass: what one session hands to the
next is only which run it is in, so runs, counts and alignment are window expressions, and no session is evaluated again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import canonical_reasons, first_reason
from tidemark.operators import evidence as ev
from tidemark.operators import features as ft
from tidemark.operators import screener as sc
from tidemark.session import shared

# Calendar days of a history, sessions that execution needs, names of policies, reasons of uncleared days, core features.
MAXIMUM_DAYS, LEAST_BARS = 330, 50
TECHNICAL_POLICY, CANDIDATE_POLICY, SCHEMA_VERSION = "screener-v0.2.0", "screener-technical-candidate-v0.2.0", 1
UNCLEAR = ("CORPORATE_ACTION_COVERAGE_PARTIAL", "IDENTITY_CONFLICT", "PRICE_BASIS_UNVERIFIED", "PRICE_CLEARANCE_INCOMPLETE", "PRICE_KNOWN_BREAK", "PRICE_UNRESOLVED", "SESSION_UNAVAILABLE")
CORE = ("Ema20", "Ema50", "Atr14", "PriorHigh20", "PriorLow20", "DistanceToHighPercent")
CORE_FIELDS = ("ema20", "ema50", "atr14", "priorHigh20", "priorLow20", "distanceToHighPercent")
# Optional feature -> fields it admits.
OPTIONAL_FIELDS = {
    "RelativeVolume": ("volumeRatio20",), "MonetaryLiquidityProxy": ("dailyValueProxyIdr", "monetaryLiquidity20Idr"),
    "ActualTradedValue": ("actualTradedValue",), "Rs20": ("rs20Pp",), "Rs60": ("rs60Pp",),
}
CONTEXT_FIELDS = ("ema20", "ema50", "atr14", "atrPercent")
COMPARABLE_UNITS = ("SHARES", "SHARE_COUNT_CORROBORATED")
STATE = "struct<availability string, value double, reason string>"


def history_states(days: DataFrame, keys: tuple[str, ...] = ("request_id",)) -> DataFrame:
    """State of each civil day of each history, and the run its bar belongs to.

    ``days``: keys, session_date, target, closed, completed, scheduled_open, schedule_conflicting, exchange_id, currency,
    coverage, failed, breaks, matching_prices. A day that is closed, or a weekend nobody traded on, is bridged unless
    something breaks there. Any other day must clear on its own and carry on the exchange and currency of the run's last
    bar; if it does not, the run ends and the next bar begins another.

    Adds ``bridged``, ``comparability``, ``comparability_reasons`` (null on bridged days that pass), ``run_id``, and for
    bars that count ``pos``, their number in the run.

    A day whose exchange or currency differs from the last bar's ends the run, so the bar after it has nothing to differ
    from: of consecutive changes every second one ends a run. That makes a count out of what looks like a fold.
    """
    keys = list(keys)
    own = Window.partitionBy(*keys).orderBy("session_date")
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    weekend = F.weekday("session_date") >= 5
    bridged = ~F.col("target") & ((F.col("closed") & ~F.col("completed")) | (weekend & ~F.col("completed") & ~F.col("scheduled_open") & ~F.col("schedule_conflicting")))
    bound = F.col("exchange_id").isNotNull() & F.col("currency").isNotNull()
    quiet = (F.col("breaks") == 0) & F.col("coverage") & bound
    alone = F.when(bridged, quiet).otherwise(quiet & ~F.col("failed") & (F.col("matching_prices") == 1) & F.col("completed") & ~F.col("closed"))
    x = days.withColumn("bridged", bridged).withColumn("__alone", alone).withColumn("__bound", bound)
    x = x.withColumn("__part", F.sum((~F.col("__alone")).cast("long")).over(upto))
    part = Window.partitionBy(*keys, "__part").orderBy("session_date")
    before = part.rowsBetween(Window.unboundedPreceding, -1)
    bar = F.col("__alone") & ~F.col("bridged")
    here = F.struct("exchange_id", "currency")
    last = F.last(F.when(bar, here), ignorenulls=True).over(before)
    x = x.withColumn("__bar", bar).withColumn("__n", F.coalesce(F.sum(bar.cast("long")).over(before), F.lit(0))).withColumn("__changed", F.col("__alone") & F.coalesce(last != here, F.lit(False)))
    gap = Window.partitionBy(*keys, "__part", "__n").orderBy("session_date").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("__first", F.col("__changed") & ~F.coalesce(F.max(F.col("__changed") & F.col("bridged")).over(gap), F.lit(False)))
    calm = F.max(F.when(F.col("__bar") & ~F.col("__first"), F.col("__n"))).over(part.rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("__ends", F.col("__bar") & F.col("__first") & ((F.col("__n") - calm) % 2 == 1))
    x = x.withColumn("__ends", F.when(F.col("bridged"), F.col("__first") & ~F.coalesce(F.last(F.when(F.col("__bar"), F.col("__ends")), ignorenulls=True).over(before), F.lit(False))).otherwise(F.col("__ends")))
    same = ~F.col("__ends") & F.col("__bound")
    exchange, currency = F.col("exchange_id") == last["exchange_id"], F.col("currency") == last["currency"]
    x = x.withColumn("__same_exchange", F.when(F.col("__ends"), exchange).otherwise(same)).withColumn("__same_currency", F.when(F.col("__ends"), currency).otherwise(same))
    judged = ev.price_comparability(x.withColumns({
        "identity_continuity": F.col("__same_exchange"), "currency_continuity": F.col("__same_currency"), "convention_continuity": F.col("matching_prices") == 1, "session_continuity": F.col("completed") & ~F.col("closed"),
        "action_coverage": F.col("coverage") & ~F.col("failed"), "revision_binding": (F.col("matching_prices") == 1) & ~F.col("failed"), "known_breaks": F.col("breaks"),
    }))
    resets = ~F.col("__alone") | F.col("__ends")
    code = F.when(F.col("breaks") > 0, F.lit("PRICE_KNOWN_BREAK")).otherwise(F.lit("PRICE_UNRESOLVED"))
    out = judged.withColumns({
        "__resets": resets,
        "comparability": F.when(F.col("bridged"), F.when(resets, F.when(F.col("breaks") > 0, F.lit("KNOWN_BREAK")).otherwise(F.lit("UNRESOLVED")))).otherwise(F.col("comparability")),
        "comparability_reasons": F.when(F.col("bridged"), F.when(resets, F.array(code))).otherwise(F.col("comparability_reasons")),
    }).withColumn("run_id", F.sum(F.col("__resets").cast("long")).over(upto))
    counted = F.col("__bar") & ~F.col("__resets")
    run = Window.partitionBy(*keys, "run_id").orderBy("session_date").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("pos", F.when(counted, F.sum(counted.cast("long")).over(run))).select(*days.columns, "bridged", "comparability", "comparability_reasons", "run_id", "pos")


def aligned_bars(stock: DataFrame, benchmark: DataFrame, keys: tuple[str, ...] = ("request_id",)) -> DataFrame:
    """Adds the benchmark's state, pos and run of the day, and to bars ``aligned``: how many last bars of both runs stand on the same dates."""
    keys = list(keys)
    run = Window.partitionBy(*keys, "run_id").orderBy("session_date")
    bar = F.when(F.col("pos").isNotNull(), F.col("session_date"))
    earlier = F.last(bar, ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, -1))
    theirs = benchmark.select(
        *keys, "session_date", F.col("comparability").alias("benchmark_state"), F.col("pos").alias("benchmark_pos"), F.when(bar.isNotNull(), F.col("run_id")).alias("benchmark_run"), F.when(bar.isNotNull(), earlier).alias("__theirs"))
    both = stock.withColumn("__mine", earlier).join(theirs, [*keys, "session_date"], "left")
    linked = F.coalesce((F.col("__mine") == F.col("__theirs")) & F.col("benchmark_pos").isNotNull(), F.lit(False))
    since = F.max(F.when(~linked, F.col("pos"))).over(run.rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("aligned", F.when(F.col("benchmark_pos").isNotNull(), F.col("pos") - since + 1).otherwise(F.lit(0))).drop("__mine", "__theirs")


def feature_state(name: str, comparability: Column, observations: Column, benchmark_ready: Column | None = None, aligned: Column | None = None) -> Column:
    """(feature, availability, reason) of a core feature or of Rs20 and Rs60."""
    need = F.lit(ev.REQUIRED_OBSERVATIONS[name])
    relative = name in ("Rs20", "Rs60")
    tests = [(comparability == "KNOWN_BREAK", "PRICE_KNOWN_BREAK"), (comparability != "CLEARED", "PRICE_UNRESOLVED")]
    if relative:
        tests += [(~(benchmark_ready & (aligned > 0)), "BENCHMARK_MISSING"), (aligned < need, "INSUFFICIENT_HISTORY")]
    reason = first_reason(*tests, (observations < need, "INSUFFICIENT_HISTORY"))
    availability = F.when(reason.isNull(), F.lit("AVAILABLE")).when(reason == "INSUFFICIENT_HISTORY", F.lit("WARMUP")).otherwise(F.lit("UNAVAILABLE"))
    return F.struct(F.lit(name).alias("feature"), availability.alias("availability"), reason.alias("reason"))


def _optional(name: str, gate: Column, enough: Column, missing: str) -> Column:
    reason = F.when(~gate, F.lit(missing)).when(~enough, F.lit("INSUFFICIENT_HISTORY"))
    availability = F.when(~gate, F.lit("UNAVAILABLE")).when(enough, F.lit("AVAILABLE")).otherwise(F.lit("WARMUP"))
    return F.struct(F.lit(name).alias("feature"), availability.alias("availability"), reason.alias("reason"))


def compose_readiness(stock: DataFrame, benchmark: DataFrame, market: DataFrame, keys: tuple[str, ...] = ("request_id",)) -> DataFrame:
    """Readiness of every day of every history that is not bridged, as if it were the request's own date.

    ``stock`` and ``benchmark`` come from ``history_states``; stock days also carry volume, volume_unit, volume_basis and
    market_segment of their bar. ``market`` has the facts of ``market_eligibility`` by keys and session_date.

    Adds market_status, market_reason, core and optional (arrays of feature, availability, reason), data_ready,
    can_evaluate and diagnostics (sorted reason codes), and history_comparability: CLEARED only while no day of the
    history up to here broke or stayed unresolved.
    """
    keys = list(keys)
    upto = Window.partitionBy(*keys).orderBy("session_date").rowsBetween(Window.unboundedPreceding, 0)
    run = Window.partitionBy(*keys, "run_id").orderBy("session_date").rowsBetween(Window.unboundedPreceding, 0)
    x = aligned_bars(stock, benchmark, tuple(keys)).withColumns({
        "__broken": F.max((F.col("breaks") > 0).cast("int")).over(upto) == 1,
        "__unclear": F.max(F.coalesce(F.col("comparability") != "CLEARED", F.lit(False)).cast("int")).over(upto) == 1,
        "__codes": F.array_compact(F.array(*[F.when(F.max(F.array_contains("comparability_reasons", code).cast("int")).over(upto) == 1, F.lit(code)) for code in UNCLEAR])),
        "observations": F.coalesce(F.max("pos").over(run), F.lit(0)),
    })
    # The last 21 bars of the history, in whatever run, and those of the run alone.
    counted = F.col("pos").isNotNull()
    x = x.withColumn("__bars", F.sum(counted.cast("long")).over(upto))
    recent = Window.partitionBy(*keys).orderBy("__bars").rangeBetween(-20, 0)
    marks = F.struct("volume_unit", "volume_basis", "market_segment")
    mine = Window.partitionBy(*keys, "run_id").orderBy("pos").rowsBetween(-20, 0)
    bar_marks = F.when(counted, marks)
    known = F.col("volume_unit").isin(*COMPARABLE_UNITS) & (F.col("volume_basis") == "RAW_AS_TRADED") & (F.col("market_segment") != "UNKNOWN")
    x = x.withColumn("__traded", F.min(F.when(counted, (F.col("volume") > 0).cast("int"))).over(recent) == 1)
    x = x.withColumn("__comparable", counted & (F.min(F.when(counted, known.cast("int"))).over(mine) == 1) & (F.min(bar_marks).over(mine) == F.max(bar_marks).over(mine)))
    x = ev.market_eligibility(x.where(~F.col("bridged")).join(market, [*keys, "session_date"], "left"))
    state, n = F.col("comparability"), F.col("observations")
    ready_benchmark = F.coalesce((F.col("benchmark_state") == "CLEARED") & (F.col("benchmark_pos") > 0), F.lit(False))
    aligned = F.coalesce("aligned", F.lit(0))
    quantity, money = F.coalesce("__comparable", F.lit(False)), F.coalesce(F.col("__comparable") & (F.col("currency") == "IDR"), F.lit(False))
    context = ready_benchmark & (F.col("benchmark_pos") >= ev.REQUIRED_OBSERVATIONS["Ema50"])
    optional = F.array(
        _optional("RelativeVolume", quantity, (n >= 21) & F.coalesce("__traded", F.lit(False)), "VOLUME_BASIS_UNVERIFIED"), _optional("MonetaryLiquidityProxy", money, n >= 21, "VOLUME_BASIS_UNVERIFIED"),
        _optional("ActualTradedValue", F.lit(False), n >= 21, "PRICE_BASIS_UNVERIFIED"), feature_state("Rs20", state, n, ready_benchmark, aligned), feature_state("Rs60", state, n, ready_benchmark, aligned),
        _optional("MarketContext", ready_benchmark, context, "BENCHMARK_MISSING"))
    x = x.withColumn("core", F.array(*[feature_state(name, state, n) for name in CORE])).withColumn("optional", optional)
    x = ev.data_readiness(x)
    none = F.array().cast("array<string>")
    codes = F.concat(
        F.col("reasons"), F.coalesce(F.array_compact(F.array("market_reason")), none), F.coalesce("__codes", none), F.array_compact(F.transform("optional", lambda s: s["reason"])))
    history = F.when(F.col("__broken"), F.lit("KNOWN_BREAK")).when(F.col("__unclear"), F.lit("UNRESOLVED")).otherwise(F.lit("CLEARED"))
    return x.select(
        *keys, "session_date", "target", "run_id", "pos", "observations", "benchmark_run", "comparability", "comparability_reasons", history.alias("history_comparability"), "market_status", "market_reason", "core", "optional",
        "data_ready", F.col("data_ready").alias("can_evaluate"), canonical_reasons(codes).alias("diagnostics"))


def gate() -> Column:
    """Whether a session may be executed: everything ready, the market eligible, prices cleared and each core feature available."""
    return F.col("data_ready") & F.col("can_evaluate") & (F.col("market_status") == "ELIGIBLE") & (F.col("comparability") == "CLEARED") & F.forall("core", lambda s: s["availability"] == "AVAILABLE")


def technical_results(requests: DataFrame, readiness: DataFrame, bars: DataFrame, benchmark_days: DataFrame, benchmark_bars: DataFrame) -> DataFrame:
    """One row per request: features, episode, trend and reasons at its date, or why it was not evaluated.

    ``requests``: request_id, instrument_id, benchmark_id, history_from, evaluation_date, cutoff. ``readiness`` comes from
    ``compose_readiness``, ``benchmark_days`` from ``history_states``. ``bars`` and ``benchmark_bars``: instrument_id,
    session_date, open, high, low, close, volume.

    The run that reaches the request's date is executed: sessions that pass the gate move the episode machine, others
    interrupt it. A run of fewer than 50 bars, a bar that readiness counted and nobody has, or a history over the limit
    is not evaluated. ``input_hash`` covers the request, the bars and the readiness history; ``result_hash`` the result.
    """
    readiness = shared(readiness)  # read by the target day and by the run before it
    target = readiness.where("target").select("request_id", F.col("run_id").alias("__run"), F.col("benchmark_run").alias("__b_run"), *[F.col(c).alias(f"t_{c}") for c in ("market_status", "comparability", "data_ready", "can_evaluate", "core", "optional", "diagnostics", "pos")], gate().alias("__gate"))
    asked = requests.join(target, "request_id", "left")
    days = readiness.where("pos IS NOT NULL").join(asked.select("request_id", "instrument_id", "benchmark_id", "__run", "__b_run"), "request_id").where("run_id = __run")
    run = days.join(bars, ["instrument_id", "session_date"], "left")
    # The benchmark's run is read where readiness has aligned it with this one.
    side = benchmark_bars.select(F.col("instrument_id").alias("benchmark_id"), "session_date", F.col("close").cast("double").alias("b_close"), F.col("volume").alias("b_volume"))
    run = run.join(side, ["benchmark_id", "session_date"], "left").withColumn("b_close", F.when(F.col("benchmark_run") == F.col("__b_run"), F.col("b_close")))
    run = shared(run.withColumn("instrument_id", F.col("request_id")))

    high = Window.partitionBy("request_id").orderBy("pos").rowsBetween(-20, -1)
    passed = run.withColumn("eligibility", F.when(gate(), F.lit("ELIGIBLE")).when(F.col("market_status") == "INELIGIBLE", F.lit("INELIGIBLE")).otherwise(F.lit("DATA_BLOCKED")))
    rows = passed.withColumn("prior_high20", F.when(F.col("pos") > 20, F.max("high").over(high))).select("instrument_id", "session_date", "eligibility", "close", "prior_high20")
    newest = Window.partitionBy("instrument_id")
    setup = sc.episodes(rows).withColumn("__end", F.max("session_date").over(newest)).where("session_date = __end").select(
        F.col("instrument_id").alias("request_id"), "setup", "evaluated", "setup_reason", "start_date", "confirmation_date", "end_date", "end_reason", "age", "confirmed_age", "trigger_price", "watch_threshold")
    panel = ft.features(run, latest=True).select(F.col("instrument_id").alias("request_id"), F.col("close").alias("last_close"), *ft.MINIMUM_SESSIONS)
    line = lambda *cells: F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in cells])
    content = run.groupBy("request_id").agg(  # a history is at most MAXIMUM_DAYS long
        F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", F.date_format("session_date", "yyyy-MM-dd"), line("open", "high", "low", "close", "volume")))), "\n").alias("__bars"),
        F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", F.date_format("session_date", "yyyy-MM-dd"), line("market_status", "market_reason", "data_ready", "can_evaluate")))), "\n").alias("__history"),
        F.count("*").alias("bars"), F.count("close").alias("__held"), F.count_distinct("session_date").alias("__dates"), F.max("session_date").alias("__last"))
    context = _context(asked, benchmark_days, benchmark_bars)
    x = asked.join(content, "request_id", "left").join(setup, "request_id", "left").join(panel, "request_id", "left").join(context, "request_id", "left")

    too_long = F.date_diff("evaluation_date", "history_from") >= MAXIMUM_DAYS
    bound = (F.col("bars") >= LEAST_BARS) & (F.col("__held") == F.col("bars")) & (F.col("__dates") == F.col("bars")) & (F.col("__last") == F.col("evaluation_date"))
    core_values = F.forall(F.array(*CORE_FIELDS), lambda s: s["availability"] == "AVAILABLE")
    range_ = F.exists(F.array(*CORE_FIELDS), lambda s: s["reason"] == "NUMERIC_OUT_OF_RANGE")
    why = first_reason(
        (too_long | (F.col("history_from") > F.col("evaluation_date")), "REQUEST_INVALID"), (~F.coalesce("__gate", F.lit(False)), "DATA_NOT_READY"), (~F.coalesce(bound, F.lit(False)), "TECHNICAL_REPLAY_BINDING_MISMATCH"),
        (range_, "NUMERIC_OUT_OF_RANGE"), (~F.coalesce(core_values, F.lit(False)) | ~F.coalesce("evaluated", F.lit(False)), "TECHNICAL_READINESS_MISMATCH"))
    x = x.withColumn("failure", why).withColumn("technical_evaluated", why.isNull())
    none = F.lit(None).cast(STATE)
    state_of = lambda name: F.get(F.filter("t_optional", lambda s: s["feature"] == name), F.lit(0))
    fields = {name: F.col(name).cast(STATE) for name in (*CORE_FIELDS, "atrPercent", "changePercent")}
    for feature, names in OPTIONAL_FIELDS.items():
        held = state_of(feature)
        for name in names:
            own = F.col(name).cast(STATE) if name in ft.MINIMUM_SESSIONS else none
            fields[name] = F.when(held["availability"] == "AVAILABLE", own).otherwise(F.struct(held["availability"].alias("availability"), F.lit(None).cast("double").alias("value"), held["reason"].alias("reason")))
    held = state_of("MarketContext")
    blank = F.struct(held["availability"].alias("availability"), F.lit(None).cast("double").alias("value"), held["reason"].alias("reason"))
    market = {f"benchmark_{name}": F.when(held["availability"] == "AVAILABLE", F.col(f"c_{name}").cast(STATE)).otherwise(blank) for name in CONTEXT_FIELDS}
    done = F.col("technical_evaluated")
    x = x.withColumns({k: F.when(done, v) for k, v in {**fields, **market}.items()})
    x = x.withColumns({
        "trend": F.when(done, ft.trend(F.col("last_close"), F.col("ema20.value"), F.col("ema50.value"))).otherwise(F.lit("UNKNOWN")),
        "benchmark_trend": F.when(done, ft.trend(F.col("c_close"), F.col("benchmark_ema20.value"), F.col("benchmark_ema50.value"))).otherwise(F.lit("UNKNOWN")),
        "benchmark_volatility": F.when(done, ft.volatility(F.col("benchmark_atrPercent.value"))).otherwise(F.lit("UNKNOWN")),
        "setup": F.when(done, F.col("setup")).otherwise(F.lit("NONE")), "setup_evaluated": F.when(done, F.col("evaluated")).otherwise(F.lit(False)),
        "episode_id": F.when(done & F.col("start_date").isNotNull(), F.concat_ws("/", F.lit(TECHNICAL_POLICY), "instrument_id", F.date_format("start_date", "yyyy-MM-dd"))),
    })
    none_ = F.array().cast("array<string>")
    missing = F.array_compact(F.transform(F.array(*fields, *market), lambda s: s["reason"]))
    codes = F.concat(F.coalesce("t_diagnostics", none_), F.when(done, F.concat(F.array_compact(F.array("setup_reason")), missing)).otherwise(F.array(F.lit("NOT_EVALUATED"), F.col("failure"))))
    x = x.withColumn("reasons", canonical_reasons(codes))
    head = F.concat_ws("|", F.lit(TECHNICAL_POLICY), F.lit(str(SCHEMA_VERSION)), *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("request_id", "instrument_id", "benchmark_id", "history_from", "evaluation_date")], F.date_format("cutoff", "yyyy-MM-dd HH:mm:ss"))
    x = x.withColumn("input_hash", F.when(done, F.sha2(F.concat_ws("\n\n", head, F.col("__bars"), F.col("__history")), 256)))
    episode = ("start_date", "confirmation_date", "end_date", "end_reason", "age", "confirmed_age", "trigger_price", "watch_threshold")
    result = F.to_json(F.struct("request_id", "setup", "setup_reason", "episode_id", *episode, *fields, *market, "trend", "benchmark_trend", "benchmark_volatility", "reasons"))
    return x.select(
        "request_id", "instrument_id", "evaluation_date", "cutoff", "technical_evaluated", "failure", F.col("t_market_status").alias("market_status"), "bars", "setup", "setup_evaluated", F.when(done, F.col("setup_reason")).alias("setup_reason"), "episode_id",
        *[F.when(done, F.col(c)).alias(c) for c in episode], *fields, *market, "trend", "benchmark_trend", "benchmark_volatility", "reasons", "input_hash", F.when(done, F.sha2(F.concat("input_hash", result), 256)).alias("result_hash"))


def _context(asked: DataFrame, benchmark_days: DataFrame, benchmark_bars: DataFrame) -> DataFrame:
    """The benchmark's averages at the end of its own run, which may be longer than the instrument's."""
    run = benchmark_days.where("pos IS NOT NULL").join(asked.select("request_id", "benchmark_id", F.col("__b_run").alias("run_id")), ["request_id", "run_id"])
    run = run.select("request_id", F.col("benchmark_id").alias("instrument_id"), "session_date", "run_id", "pos").join(benchmark_bars, ["instrument_id", "session_date"]).withColumn("instrument_id", F.col("request_id"))
    return ft.features(run, latest=True).select(F.col("instrument_id").alias("request_id"), F.col("close").alias("c_close"), *[F.col(n).alias(f"c_{n}") for n in CONTEXT_FIELDS])


def promote(results: DataFrame, retained: DataFrame | None = None) -> DataFrame:
    """A decision per evaluated result: whether it is a candidate, under an id that hangs on what was captured alone.

    ``capture_id`` and ``decision_id`` are the leading digits of content digests, so a rerun over the same input gives the
    same ids. With ``retained`` (decision_id, replay_identity) a decision is INSERTED, RETAINED if it is there already, or
    CONFLICT if it is there with another content; only the inserted ones are to be appended.
    """
    as_id = lambda digest: F.concat_ws("-", *[F.substring(digest, i, n) for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    x = results.where("technical_evaluated").withColumn("capture_id", as_id(F.col("input_hash")))
    candidate = (F.col("market_status") == "ELIGIBLE") & F.col("setup_evaluated") & F.col("setup").isin("CONFIRMED", "WATCH")
    projection = F.concat_ws("|", F.lit(CANDIDATE_POLICY), F.lit(str(SCHEMA_VERSION)), "capture_id", "input_hash", "result_hash", "request_id", "instrument_id", F.lit(TECHNICAL_POLICY), F.date_format("evaluation_date", "yyyy-MM-dd"), F.date_format("cutoff", "yyyy-MM-dd HH:mm:ss"), candidate.cast("string"), "setup", F.array_join("reasons", ","))
    x = x.withColumn("candidate", candidate).withColumn("decision_id", as_id(F.sha2(F.concat_ws("|", F.lit(CANDIDATE_POLICY), F.lit(str(SCHEMA_VERSION)), "capture_id", "input_hash"), 256)))
    x = x.select("decision_id", F.sha2(projection, 256).alias("replay_identity"), "request_id", "instrument_id", "evaluation_date", "candidate", "setup", "reasons", "capture_id", "input_hash", "result_hash")
    if retained is None:
        return x.withColumn("disposition", F.lit("INSERTED"))
    x = x.join(retained.select("decision_id", F.col("replay_identity").alias("__held")), "decision_id", "left")
    return x.withColumn("disposition", F.when(F.col("__held").isNull(), F.lit("INSERTED")).when(F.col("__held") == F.col("replay_identity"), F.lit("RETAINED")).otherwise(F.lit("CONFLICT"))).drop("__held")
