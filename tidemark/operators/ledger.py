"""Portfolio ledger: corrections, replay with weighted-average cost, prefix checks, valuation.

Events: portfolio_id, event_id, type (BUY, SELL, CASH_DEPOSIT, CASH_WITHDRAWAL), instrument_id,
trade_date, known_at, event_order, quantity, price, fees, cash_amount, supersedes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import local_date, reasons_where
from tidemark.operators.pit import instant
from tidemark.operators.scan import asof_lookup, prefix_scan, window_scan
from tidemark.session import cut_lineage, shared

# Fixed values.
AMOUNT_LIMIT, SHARE_LIMIT, LOT = 1_000_000_000_000, 1_000_000_000, 100
TYPES = ("CASH_DEPOSIT", "CASH_WITHDRAWAL", "BUY", "SELL")
#: Events per block of the cost fold; it bounds every list a task holds.
COST_BLOCK = 4096
#: Children per node when block summaries are combined level by level.
FAN = 8
#: Events up to which a portfolio is scanned in one task; those with more are scanned by blocks.
LONG = 1_000_000


def canonicalize_events(df: DataFrame) -> DataFrame:
    """Lots to shares, trimmed source, and the rules each event type breaks."""
    trade = F.col("type").isin("BUY", "SELL")
    shares = (F.col("quantity") * F.when(F.col("unit") == "LOTS", LOT).otherwise(1)).cast("decimal(38,10)")
    amounts = [F.col(c) for c in ("quantity", "price", "fees", "cash_amount")]
    bad_amount = F.least(*amounts) < 0
    big_amount = F.greatest(*amounts) > AMOUNT_LIMIT
    source, reference, note = F.col("source"), F.col("external_reference"), F.col("note")
    text = (
        source.isNull() | (F.trim(source) == "") | (F.length(source) > 100) | F.coalesce(F.length(note) > 4000, F.lit(False))
        | F.coalesce((F.length(reference) > 200) | (F.trim(reference) == ""), F.lit(False))
    )
    bad_trade = (
        F.col("instrument_id").isNull() | (shares <= 0) | (shares > SHARE_LIMIT) | (shares != F.floor(shares))
        | (F.col("price") <= 0) | (F.col("cash_amount") != 0)
    )
    bad_cash = (
        F.col("instrument_id").isNotNull() | (F.col("quantity") != 0) | (F.col("price") != 0)
        | (F.col("cash_amount") <= 0) | (F.col("unit") != "SHARES")
    )
    violations = reasons_where(
        (~F.col("type").isin(*TYPES) | ~F.col("unit").isin("SHARES", "LOTS"), "EVENT_TYPE_OR_UNIT"),
        (text, "SOURCE_REFERENCE_NOTE"),
        ((F.col("trade_date") < F.lit("1900-01-01").cast("date")) | (F.col("trade_date") > local_date("known_at")), "TRADE_DATE"),
        (bad_amount | big_amount, "AMOUNT_BOUND"),
        (trade & bad_trade, "TRADE_FIELDS"), (~trade & bad_cash, "CASH_FIELDS"),
        ((F.col("type") == "CASH_DEPOSIT") & (F.col("fees") > F.col("cash_amount")), "DEPOSIT_FEES"),
    )
    return df.withColumn("violations", violations).withColumn("quantity", shares).withColumn("unit", F.lit("SHARES")).withColumn("source", F.trim(source))


def validate_corrections(events: DataFrame) -> DataFrame:
    """Verdict of every correction: its target exists, belongs to the same portfolio and instrument, was
    not known later and is corrected only once."""
    fixes = events.where("supersedes is not null")
    target = events.select(
        F.col("event_id").alias("supersedes"), F.col("portfolio_id").alias("__p"), F.col("instrument_id").alias("__i"), F.col("known_at").alias("__k"))
    times = fixes.groupBy("supersedes").agg(F.count("*").alias("__times"))
    x = fixes.join(target, "supersedes", "left").join(times, "supersedes")
    verdict = (
        F.when(F.col("event_id") == F.col("supersedes"), F.lit("SELF_CORRECTION"))
        .when(F.col("__p").isNull(), F.lit("TARGET_MISSING"))
        .when((F.col("__p") != F.col("portfolio_id")) | ~F.col("__i").eqNullSafe(F.col("instrument_id")), F.lit("TARGET_MISMATCH"))
        .when(F.col("__times") > 1, F.lit("ALREADY_CORRECTED"))
        .when(F.col("__k") > F.col("known_at"), F.lit("TARGET_KNOWN_LATER")).otherwise(F.lit("VALID"))
    )
    return x.select("event_id", "supersedes", verdict.alias("verdict"))


def correction_roots(events: DataFrame) -> DataFrame:
    """Root event of every correction by pointer doubling: the remaining chain length halves each
    round, so a chain of any depth takes a logarithmic number of joins. A chain that loops or lacks
    its target ends without a root."""
    links = events.where("supersedes is not null").select("event_id", F.col("supersedes").alias("root"))
    links = cut_lineage(links)
    rounds = 1 + math.ceil(math.log2(max(2, links.count() + 1)))
    for _ in range(rounds):
        step = links.select(F.col("event_id").alias("root"), F.col("root").alias("__next"))
        jumped = cut_lineage(links.join(step, "root", "left").select(
            "event_id", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("moved")))
        links = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            return links
    # Whatever still moves after that many doublings is a cycle.
    looping = links.join(links.select(F.col("event_id").alias("root"), F.lit(True).alias("__loop")), "root", "left")
    return looping.select("event_id", F.when(F.col("__loop").isNull(), F.col("root")).alias("root"))


def impact() -> Column:
    gross = F.col("quantity") * F.col("price")
    return (
        F.when(F.col("type") == "CASH_DEPOSIT", F.col("cash_amount") - F.col("fees"))
        .when(F.col("type") == "CASH_WITHDRAWAL", -F.col("cash_amount") - F.col("fees"))
        .when(F.col("type") == "BUY", -(gross + F.col("fees"))).otherwise(gross - F.col("fees"))
    ).cast("decimal(38,10)")


def _visible(events: DataFrame, cutoff) -> tuple[DataFrame, DataFrame, int, DataFrame | None]:
    """Visible events, what corrections say of the few they touch (by portfolio and event), the number of
    events of the longest portfolio, and the portfolios longer than LONG, if any. ``__p`` is the portfolio, never null."""
    # Events are read again for each of these, a few columns at a time: kept whole they would outweigh all that is shuffled.
    seen = events.where(F.col("known_at") <= instant(cutoff)).withColumn("__p", F.coalesce("portfolio_id", F.lit("")))
    lengths = seen.groupBy("__p").agg(F.count("*").alias("n"))
    longest = lengths.agg(F.max("n")).first()[0] or 0
    roots = correction_roots(seen)
    replaced = seen.where("supersedes is not null").groupBy(F.col("supersedes").alias("event_id")).agg(F.min("known_at").alias("superseded_at"))
    # The events that corrections speak of are looked up by id once, roots and corrected ones together.
    asked = roots.select("event_id").unionByName(roots.select(F.col("root").alias("event_id"))).unionByName(replaced.select("event_id")).distinct()
    found = cut_lineage(seen.select("event_id", "__p", "event_order").join(asked, "event_id", "left_semi"))
    order = found.select(F.col("event_id").alias("root"), F.col("event_order").alias("root_order"))
    resolved = roots.join(order, "root", "left").select("event_id", "root_order", F.lit(True).alias("__fix"))
    notes = resolved.join(replaced, "event_id", "full_outer")
    # Each (portfolio, event) once: an id that repeats meets its notes as often as it stands, not squared.
    touched = found.select("__p", "event_id").distinct().join(notes, "event_id")
    return seen, touched, longest, lengths.where(F.col("n") > LONG).select("__p") if longest > LONG else None


def _placed(seen: DataFrame, touched: DataFrame) -> DataFrame:
    """Events with what corrections say of them, each portfolio in one partition."""
    x = seen.repartition("__p").join(touched.repartition("__p"), ["__p", "event_id"], "left")
    return x.withColumn("economic_order", F.when(F.col("__fix"), F.col("root_order")).otherwise(F.col("event_order"))).withColumn(
        "invalid_chain", F.coalesce(F.col("__fix") & F.col("root_order").isNull(), F.lit(False))
    ).drop("__fix", "root_order")


def economic_events(events: DataFrame, cutoff) -> DataFrame:
    """Every visible event with the order of its root; superseded_at tells when a later one replaced it."""
    seen, touched, _, _ = _visible(events, cutoff)
    return _placed(seen, touched).drop("__p")


def _split(seen: DataFrame, long: DataFrame | None) -> list[tuple[DataFrame, bool]]:
    """Events of short portfolios, and those of long ones if there are any."""
    if long is None:
        return [(seen, False)]
    names = cut_lineage(long)
    return [(seen.join(F.broadcast(names), "__p", "left_anti"), False), (seen.join(F.broadcast(names), "__p", "left_semi"), True)]


ORDER = ("trade_date", "economic_order", "event_id")


def ledger_steps(events: DataFrame, cutoff, through) -> DataFrame:
    """Current events in ledger order with cash and shares after each one, and what each violates.

    A portfolio of ordinary length is shuffled once and scanned in place; long ones are scanned by months.
    """
    signed = F.when(F.col("type") == "BUY", F.col("quantity")).when(F.col("type") == "SELL", -F.col("quantity")).otherwise(F.lit(0)).cast("decimal(38,10)")
    month = F.trunc("trade_date", "month")
    seen, touched, _, long = _visible(events, cutoff)
    # Only what the scans and folds read is shuffled.
    narrow = seen.where(F.col("trade_date") <= F.lit(through).cast("date")).withColumn("impact", impact()).select(
        "__p", "portfolio_id", "event_id", "type", "instrument_id", "trade_date", "event_order", "quantity", "impact")
    parts = []
    for rows, blocked in _split(narrow, long):
        x = _placed(rows, touched).where("superseded_at is null").withColumn("__signed", signed)
        scan, x = (prefix_scan, shared(x)) if blocked else (window_scan, x)
        cash = scan(x, ["__p", "portfolio_id"], ORDER, month, {"cash_after": ("sum", F.col("impact"))}, inclusive=True)
        specs = {"shares_after": ("sum", F.col("__signed")), "__n": ("sum", F.lit(1).cast("long"))}
        parts.append(scan(cash, ["__p", "portfolio_id", "instrument_id"], ORDER, month, specs, inclusive=True))
    full = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    oversold = (F.col("type") == "SELL") & (F.col("shares_after") < 0)
    return full.withColumn("violation", F.when(F.col("invalid_chain"), F.lit("INVALID_CORRECTION_CHAIN")).when(oversold, F.lit("SELL_EXCEEDS_SHARES")))


def _fold_map(events: Column) -> Column:
    """Composition of one block's events as a linear map of the entering cost: cost = m*C + b and
    realized = a*C + r."""
    start = F.struct(F.lit(1.0).alias("m"), F.lit(0.0).alias("b"), F.lit(0.0).alias("a"), F.lit(0.0).alias("r"))

    def step(s: Column, e: Column) -> Column:
        keep = e["keep"]
        return F.struct(
            (s["m"] * keep).alias("m"), (s["b"] * keep + e["add"]).alias("b"),
            (s["a"] - (F.lit(1.0) - keep) * s["m"]).alias("a"), (s["r"] + e["gain"] - (F.lit(1.0) - keep) * s["b"]).alias("r"),
        )

    return F.aggregate(events, start, step)


def folded(steps: DataFrame) -> DataFrame:
    """Shares, invested cost, realized result, cash impact and numbers of events per (portfolio, instrument).

    Selling removes cost in proportion to shares, so every event is a linear map of the cost before
    it. Maps compose, hence a key's history is cut into blocks of bounded length folded on their
    own, and only the block maps are folded per key. A key that sells more than it holds has no cost.
    """
    trade = F.col("type").isin("BUY", "SELL")
    before = (F.col("shares_after") - F.col("__signed")).cast("double")
    selling = F.col("type") == "SELL"
    keep = F.when(~selling, F.lit(1.0)).when(F.col("shares_after") == 0, F.lit(0.0)).otherwise(
        F.lit(1.0) - F.try_divide(F.col("quantity").cast("double"), before))
    event = F.struct(
        *ORDER, keep.alias("keep"), F.when(selling, F.lit(0.0)).otherwise(-F.col("impact").cast("double")).alias("add"),
        F.when(selling, F.col("impact").cast("double")).otherwise(F.lit(0.0)).alias("gain"),
    )
    key = ["__p", "portfolio_id", "instrument_id"]
    of_trades = lambda c: F.when(trade, F.col(c))
    blocks = steps.groupBy(*key, F.floor((F.col("__n") - 1) / COST_BLOCK).alias("__block")).agg(
        _fold_map(F.sort_array(F.collect_list(F.when(trade, event)))).alias("map"),
        F.sum(of_trades("__signed")).alias("shares"), F.sum(of_trades("impact")).alias("cash_impact"), F.max(of_trades("trade_date")).alias("latest_event_date"),
        F.count(of_trades("violation")).alias("__broken"), F.count_if(trade).alias("__trades"), F.sum("impact").alias("cash"), F.count("*").alias("events"),
    )
    start = F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("r"))
    chained = F.aggregate(
        F.sort_array(F.collect_list(F.struct("__block", "map"))), start,
        lambda s, x: F.struct((x["map"]["m"] * s["c"] + x["map"]["b"]).alias("c"), (s["r"] + x["map"]["a"] * s["c"] + x["map"]["r"]).alias("r")),
    )
    return blocks.groupBy(*key).agg(
        chained.alias("__s"), F.sum("shares").alias("shares"), F.sum("cash_impact").alias("cash_impact"),
        F.max("latest_event_date").alias("latest_event_date"), F.sum("__broken").alias("__broken"), F.sum("__trades").alias("__trades"),
        F.sum("cash").alias("cash"), F.sum("events").alias("events"))


def positions(folds: DataFrame) -> DataFrame:
    """Shares, invested cost, realized result and cash impact per traded (portfolio, instrument)."""
    sound = lambda c: F.when(F.col("__broken") == 0, c)
    return folds.where("__trades > 0").select(
        "portfolio_id", "instrument_id", "shares", sound(F.col("__s.c")).alias("invested_cost"), sound(F.col("__s.r")).alias("realized"), "cash_impact", "latest_event_date",
        sound(F.try_divide(F.col("__s.c"), F.col("shares").cast("double"))).alias("average_cost"),
    )


def violations(steps: DataFrame, allow_negative_cash: bool = False) -> DataFrame:
    """Steps that break a correction chain, sell more than is held or overdraw the portfolio."""
    short = F.lit(False) if allow_negative_cash else F.col("cash_after") < 0
    broken = steps.withColumn("violation", F.coalesce("violation", F.when(short, F.lit("INSUFFICIENT_CASH")))).where("violation is not null")
    return broken.select("portfolio_id", "event_id", "trade_date", "violation")


def project_ledger(events: DataFrame, cutoff, through, allow_negative_cash: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Positions, cash per portfolio, and violations. A portfolio with violations has no valid projection.

    Folds are written once, for positions and cash to share; who wants one of the three alone takes its own function.
    """
    steps = ledger_steps(events, cutoff, through)
    folds = cut_lineage(folded(steps))
    cash = folds.groupBy("portfolio_id").agg(F.sum("cash").alias("cash"), F.sum("events").alias("events"))
    return positions(folds), cash, violations(steps, allow_negative_cash)


def ledger_cash(events: DataFrame, cutoff, through) -> DataFrame:
    """Cash and number of current events per portfolio, as project_ledger gives them: a sum needs neither order nor positions."""
    seen = events.where(F.col("known_at") <= instant(cutoff))
    replaced = seen.where("supersedes is not null").select(F.col("supersedes").alias("event_id")).distinct()
    current = seen.where(F.col("trade_date") <= F.lit(through).cast("date")).withColumn("impact", impact()).select("portfolio_id", "event_id", "impact")
    return current.join(replaced, "event_id", "left_anti").groupBy("portfolio_id").agg(F.sum("impact").alias("cash"), F.count("*").alias("events"))


def check_prefixes(events: DataFrame, keys: list[str], cutoff, amount: Column) -> DataFrame:
    """Lowest running total at every knowledge instant of every key, over the events known then.

    Each event holds from its known_at until it is superseded. Events are leaves in ledger order; a
    node keeps, per instant at which something below it changes, the sum and the lowest running sum
    of its part. Nodes are combined FAN at a time up to one node per key: every level is one scan of
    at most (events + corrections) rows, so no (instant, event) pairs are formed.
    """
    seen, touched, longest, long = _visible(events, cutoff)
    # Only the amount and the places in ledger order are shuffled.
    narrow = seen.withColumn("__v", amount.cast("decimal(38,10)")).where("__v is not null").select(
        "__p", *keys, "event_id", "trade_date", "event_order", "known_at", "__v")
    parts = []
    for rows, blocked in _split(narrow, long):
        scan, cut = (prefix_scan, cut_lineage) if blocked else (window_scan, lambda df: df)
        parts.append(_lowest(_placed(rows, touched), ["__p", *keys], scan, cut, longest if blocked else min(longest, LONG)))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.drop("__p")


def _lowest(x: DataFrame, keys: list[str], scan, cut, longest: int) -> DataFrame:
    """The levels of check_prefixes; keys of ordinary length stay in their partition through all of them."""
    placed = scan(x, keys, ORDER, F.trunc("trade_date", "month"), {"__pos": ("sum", F.lit(1).cast("long"))}).withColumn("__pos", F.coalesce("__pos", F.lit(0)))
    zero = F.lit(0).cast("decimal(38,10)")
    added = F.struct(F.col("known_at").alias("at"), F.col("__v").alias("s"), F.least(zero, F.col("__v")).alias("low"))
    removed = F.when(F.col("superseded_at").isNotNull(), F.struct(F.col("superseded_at").alias("at"), zero.alias("s"), zero.alias("low")))
    nodes = placed.select(*keys, "__pos", F.explode(F.array_compact(F.array(added, removed))).alias("n")).select(*keys, "__pos", "n.*")
    levels = 1
    while FAN**levels < longest:
        levels += 1
    for _ in range(levels):
        rows = cut(nodes.withColumn("__child", F.col("__pos") % FAN).withColumn("__pos", F.floor(F.col("__pos") / FAN)))
        specs = {f"__c{i}": ("last", F.when(F.col("__child") == i, F.struct("s", "low"))) for i in range(FAN)}
        held = scan(rows, [*keys, "__pos"], ("at", "__child"), F.trunc(F.to_date("at"), "month"), specs, inclusive=True)
        total, lows = zero, [zero]
        for i in range(FAN):
            lows.append(total + F.coalesce(F.col(f"__c{i}.low"), zero))
            total = total + F.coalesce(F.col(f"__c{i}.s"), zero)
        joined = held.select(*keys, "__pos", "at", "__child", total.cast("decimal(38,10)").alias("s"), F.least(*lows).cast("decimal(38,10)").alias("low"))
        # Rows of one instant form one boundary: the last child's row has seen them all.
        nodes = joined.groupBy(*keys, "__pos", "at").agg(F.max_by(F.struct("s", "low"), "__child").alias("n")).select(*keys, "__pos", "at", "n.*")
    return nodes.select(*keys, F.col("at").alias("known_at"), F.col("s").alias("total"), F.col("low").alias("lowest"))


def cash_amount() -> Column:
    return impact()


def share_amount() -> Column:
    return F.when(F.col("type") == "BUY", F.col("quantity")).when(F.col("type") == "SELL", -F.col("quantity"))


def thesis_chain(versions: DataFrame) -> DataFrame:
    """Verdict of each thesis version: consecutive numbers, link to the one before, knowledge in order.

    A predecessor is found by its key, so a long history is never sorted in one task.
    """
    key = ["portfolio_id", "instrument_id"]
    prior = versions.select(*key, (F.col("version") + 1).alias("version"), F.col("thesis_id").alias("__id"), F.col("known_at").alias("__k"))
    copies = versions.groupBy(*key, "version").agg(F.count("*").alias("__copies"))
    x = versions.join(copies, [*key, "version"]).join(prior, [*key, "version"], "left")
    verdict = (
        F.when(F.col("__copies") > 1, F.lit("DUPLICATE_VERSION"))
        .when((F.col("version") > 1) & F.col("__id").isNull(), F.lit("VERSION_GAP"))
        .when(~F.col("supersedes").eqNullSafe(F.col("__id")), F.lit("BROKEN_LINK"))
        .when(F.col("__k") > F.col("known_at"), F.lit("KNOWLEDGE_REGRESSED")).otherwise(F.lit("VALID"))
    )
    return x.select("thesis_id", *key, "version", verdict.alias("verdict"))


def event_history(events: DataFrame, cutoff) -> DataFrame:
    """Visible events with the visible correction of each."""
    at = instant(cutoff)
    seen = events.where(F.col("known_at") <= at)
    fixes = seen.where("supersedes is not null").groupBy(F.col("supersedes").alias("event_id")).agg(F.min("event_id").alias("corrected_by"))
    return seen.join(fixes, "event_id", "left")


def value_positions(held: DataFrame, market: DataFrame, through, cutoff) -> DataFrame:
    """Market value and unrealized result per holding, or the reason it has none.

    ``market``: instrument_id, market_date, close, known_at, quality, unavailable_reason.
    """
    limit = F.lit(through).cast("date")
    x = held.where("shares > 0").join(market, "instrument_id", "left")
    reason = (
        F.when(F.col("known_at") > instant(cutoff), F.lit("PRICE_AFTER_KNOWLEDGE_CUTOFF"))
        .when(F.col("market_date") > limit, F.lit("PRICE_AFTER_VALUATION_DATE"))
        .when(F.col("unavailable_reason").isNotNull(), F.col("unavailable_reason"))
        .when(F.col("close").isNull() | F.col("market_date").isNull(), F.lit("NO_CURRENT_MARKET_PRICE"))
        .when(F.col("quality").isNull() | F.col("quality").isin("REJECTED", "UNKNOWN"), F.lit("PRICE_QUALITY_UNAVAILABLE"))
    )
    value = F.when(reason.isNull(), F.col("shares").cast("double") * F.col("close").cast("double"))
    return x.select(
        *held.columns, "market_date", reason.alias("reason"), F.when(reason.isNull(), F.datediff(limit, "market_date")).alias("age_days"),
        value.alias("market_value"), (value - F.col("invested_cost")).alias("unrealized"),
        (F.try_divide(value - F.col("invested_cost"), F.col("invested_cost")) * 100).alias("unrealized_percent"),
    )


def portfolio_view(pos: DataFrame, cash: DataFrame, valued: DataFrame) -> DataFrame:
    """Totals per portfolio; total value, equity and unrealized result only when every holding is priced."""
    holdings = valued.groupBy("portfolio_id").agg(
        F.count("*").alias("holdings"), F.count("market_value").alias("priced"), F.sum("market_value").alias("subtotal"),
        F.sum("invested_cost").alias("invested_cost"), F.sum("unrealized").alias("unrealized"))
    realized = pos.groupBy("portfolio_id").agg(F.sum("realized").alias("realized"))
    x = cash.join(holdings, "portfolio_id", "left").join(realized, "portfolio_id", "left")
    count, priced = F.coalesce("holdings", F.lit(0)), F.coalesce("priced", F.lit(0))
    subtotal, complete = F.coalesce("subtotal", F.lit(0.0)), count == priced
    return x.select(
        "portfolio_id", F.col("cash").cast("double").alias("cash"), (F.col("cash") < 0).alias("negative_cash"), count.alias("holdings"), priced.alias("priced"),
        F.when(complete, F.lit("COMPLETE")).otherwise(F.lit("PARTIAL")).alias("coverage"), subtotal.alias("priced_market_value"),
        F.when(complete, subtotal).alias("total_market_value"), F.when(complete, F.col("cash").cast("double") + subtotal).alias("total_equity"),
        F.coalesce("invested_cost", F.lit(0.0)).alias("invested_cost"), F.coalesce("realized", F.lit(0.0)).alias("realized"),
        F.when(complete, F.coalesce("unrealized", F.lit(0.0))).alias("unrealized"),
    )


def reconcile(pos: DataFrame, expected: DataFrame, cash: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ledger against expected holdings. ``expected``: portfolio_id, instrument_id (null when the symbol
    resolves to nothing), symbol, shares, average_cost. Returns rows and a header per portfolio."""
    unknown = expected.where("instrument_id is null").select(
        "portfolio_id", F.lit(None).cast("string").alias("instrument_id"), "symbol", F.lit(None).cast("double").alias("ledger_shares"),
        F.col("shares").cast("double").alias("expected_shares"), F.lit(None).cast("double").alias("ledger_cost"),
        F.col("average_cost").alias("expected_cost"), F.lit("UNKNOWN_INSTRUMENT").alias("status"))
    ours = pos.where("shares > 0").select("portfolio_id", "instrument_id", F.col("shares").cast("double").alias("ledger_shares"), F.col("average_cost").alias("ledger_cost"))
    theirs = expected.where("instrument_id is not null").select(
        "portfolio_id", "instrument_id", "symbol", F.col("shares").cast("double").alias("expected_shares"), F.col("average_cost").alias("expected_cost"))
    both = ours.join(theirs, ["portfolio_id", "instrument_id"], "full_outer")
    same = (F.col("ledger_shares") == F.col("expected_shares")) & F.coalesce(F.round("ledger_cost", 6) == F.round("expected_cost", 6), F.lit(False))
    status = F.when(F.col("ledger_shares").isNull(), F.lit("MISSING_FROM_LEDGER")).when(
        F.col("expected_shares").isNull(), F.lit("MISSING_FROM_EXPECTED")).when(same, F.lit("MATCH")).otherwise(F.lit("REVIEW"))
    rows = both.withColumn("status", status).select(*unknown.columns).unionByName(unknown)
    rows = rows.withColumn("share_difference", F.col("ledger_shares") - F.col("expected_shares")).withColumn(
        "cost_difference", F.col("ledger_cost") - F.col("expected_cost"))
    header = rows.groupBy("portfolio_id").agg(
        F.count_if(F.col("status") == "MATCH").alias("matched"), F.count_if(F.col("status") != "MATCH").alias("review"),
        F.count_if(F.col("status").startswith("MISSING")).alias("missing"), F.count_if(F.col("status") == "UNKNOWN_INSTRUMENT").alias("unknown"))
    difference = F.col("cash") - F.col("expected_cash")
    head = header.join(cash, "portfolio_id").withColumn("cash_difference", difference).withColumn(
        "status", F.when((F.col("review") == 0) & (difference == 0), F.lit("MATCH")).otherwise(F.lit("REVIEW")))
    return rows, head


def number_events(events: DataFrame) -> DataFrame:
    """Renumbers each portfolio's events 1..n in (order, id) order, as an export does.

    Portfolios of ordinary length are shuffled once and numbered in place; long ones are numbered by blocks.
    """
    order, block, specs = ("event_order", "event_id"), F.floor(F.col("event_order") / F.lit(10**12)), {"__before": ("sum", F.lit(1).cast("long"))}
    long = cut_lineage(events.groupBy("portfolio_id").agg(F.count("*").alias("n")).where(F.col("n") > LONG).select("portfolio_id"))
    if long.isEmpty():
        ordered = window_scan(events, ["portfolio_id"], order, block, specs)
    else:
        names = F.broadcast(long)  # at most one a million events
        short, rest = events.join(names, "portfolio_id", "left_anti"), events.join(names, "portfolio_id", "left_semi")
        ordered = window_scan(short, ["portfolio_id"], order, block, specs).unionByName(prefix_scan(rest, ["portfolio_id"], order, block, specs))
    return ordered.withColumn("event_order", F.coalesce("__before", F.lit(0)) + 1).drop("__before")


def reference_closure(events: DataFrame, instruments: DataFrame) -> DataFrame:
    """Instruments used without a reference and references nothing uses."""
    used = events.where("instrument_id is not null").select("portfolio_id", "instrument_id").distinct()
    given = instruments.select("portfolio_id", "instrument_id").distinct()
    return used.subtract(given).withColumn("problem", F.lit("REFERENCE_MISSING")).unionByName(
        given.subtract(used).withColumn("problem", F.lit("REFERENCE_UNUSED")))


FACT = ("portfolio_id", "type", "instrument_id", "trade_date", "quantity", "price", "fees", "cash_amount", "external_reference", "source", "supersedes")


def classify_imports(new: DataFrame, history: DataFrame) -> DataFrame:
    """Each incoming fact against retained ones and earlier rows of the batch with the same
    (source, reference): NEW, DUPLICATE when the content is equal, CONFLICT otherwise."""
    digest = F.sha2(F.to_json(F.array(*[F.col(c).cast("string") for c in FACT])), 256)
    incoming = new.withColumn("__fact", digest)
    kept = history.withColumn("__fact", digest).groupBy("portfolio_id", "source", "external_reference").agg(F.min("__fact").alias("__kept"))
    key = ["portfolio_id", "source", "external_reference"]
    first = incoming.groupBy(*key).agg(F.min_by(F.struct("row_number", "__fact"), "row_number").alias("__first"))
    x = incoming.join(kept, key, "left").join(first, key)
    base = F.coalesce("__kept", F.when(F.col("row_number") > F.col("__first.row_number"), F.col("__first.__fact")))
    status = F.when(base.isNull(), F.lit("NEW")).when(base == F.col("__fact"), F.lit("DUPLICATE")).otherwise(F.lit("CONFLICT"))
    return x.select(*new.columns, status.alias("disposition"))


def reference_conflicts(incoming: DataFrame, registry: DataFrame, incoming_history: DataFrame, registry_history: DataFrame) -> DataFrame:
    """Incoming metadata or symbol history that differs from the registry, or a symbol interval that
    overlaps another identity's."""
    meta = ["issuer_name", "type"]
    a = incoming.select("instrument_id", *[F.col(c).alias(f"n_{c}") for c in meta])
    b = registry.select("instrument_id", *meta)
    differs = ~(F.col("n_issuer_name").eqNullSafe(F.col("issuer_name")) & F.col("n_type").eqNullSafe(F.col("type")))
    metadata = a.join(b, "instrument_id").where(differs).select("instrument_id", F.lit("METADATA").alias("problem"), F.lit(None).cast("string").alias("symbol"))
    cols = ["instrument_id", "symbol", "valid_from", "valid_to"]
    known = registry.select("instrument_id")
    mine = incoming_history.join(known, "instrument_id", "left_semi").select(*cols)
    theirs = registry_history.join(incoming.select("instrument_id"), "instrument_id", "left_semi").select(*cols)
    changed = mine.exceptAll(theirs).unionByName(theirs.exceptAll(mine)).select("instrument_id").distinct().select(
        "instrument_id", F.lit("HISTORY").alias("problem"), F.lit(None).cast("string").alias("symbol"))
    return metadata.unionByName(changed).unionByName(_overlapping(incoming_history, registry_history))


def _overlapping(incoming: DataFrame, registry: DataFrame) -> DataFrame:
    """Incoming symbol intervals that overlap a registry interval of another identity.

    Intervals overlapping [a, b] number (starts up to b) minus (ends before a); the same count for the
    own identity is taken off. Counting needs running sums only, never the overlapping pairs.
    """
    far = F.lit("9999-12-31").cast("date")
    rows = shared(incoming.select("instrument_id", "symbol", F.col("valid_from").alias("a"), F.coalesce("valid_to", far).alias("b"), F.date_sub("valid_from", 1).alias("before_a")).distinct())
    spans = registry.select("instrument_id", "symbol", F.col("valid_from").alias("start"), F.coalesce("valid_to", far).alias("end")).distinct()

    def counted(edge: str, at: str, keys: list[str], name: str) -> DataFrame:
        per_day = spans.groupBy(*keys, F.col(at).alias("__at")).agg(F.count("*").alias("__k"))
        running = prefix_scan(per_day, keys, ["__at"], F.trunc("__at", "year"), {name: ("sum", F.col("__k"))}, inclusive=True)
        probes = rows.select("instrument_id", "symbol", F.col(edge).alias("__edge")).distinct()
        hit = asof_lookup(probes, running.select(*keys, "__at", name), keys, "__edge", "__at", [name], block="year")
        return hit.select("instrument_id", "symbol", F.col("__edge").alias(edge), name)

    x = rows
    for who, keys in (("all", ["symbol"]), ("own", ["symbol", "instrument_id"])):
        x = x.join(counted("b", "start", keys, f"{who}_starts"), ["instrument_id", "symbol", "b"])
        x = x.join(counted("before_a", "end", keys, f"{who}_ends"), ["instrument_id", "symbol", "before_a"])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    others = zero("all_starts") - zero("all_ends") - zero("own_starts") + zero("own_ends")
    return x.where(others > 0).select("instrument_id", F.lit("SYMBOL_OVERLAP").alias("problem"), "symbol").distinct()
