"""Execution layer: trade schedules, risk gate and fill simulation as relations.

Times are ns, prices ticks of 1/10,000 dollar; products use DECIMAL(38,0). A price of 0 means none. Schedules hold at most
512 children.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookweave.functions.running import as_of, running

MAX_CHILDREN = 512
# Cumulative share of a day's volume after each of 13 equal parts, in millionths.
VOLUME_CURVE = [150754, 241206, 311558, 371859, 422111, 467337, 512563, 562814, 618090, 678392, 748744, 839196, 1000000]
BLOCK = 600_000_000_000  # ns of a symbol's prints that one task orders
D = "decimal(38,0)"


def check_schedule(start_ts: int, end_ts: int, bin_ns: int = 1, risk_aversion: float = 0.0, volatility: float = 0.0, impact: float = 1.0) -> None:
    """Preconditions of a parent order; raises ValueError."""
    if start_ts >= end_ts:
        raise ValueError("start_ts must be before end_ts")
    if bin_ns <= 0:
        raise ValueError("bin_ns must be above 0")
    if not 1 <= -(-(end_ts - start_ts) // bin_ns) <= MAX_CHILDREN:
        raise ValueError(f"a schedule has 1 to {MAX_CHILDREN} bins")
    if not (risk_aversion >= 0 and volatility >= 0 and impact > 0) or math.isinf(risk_aversion):
        raise ValueError("risk_aversion and volatility must not be below 0, impact must be above 0")


def _parent_error() -> Column:
    """Why a parent order (start_ts, end_ts, bin_ns, total) has no schedule; null if it has one."""
    bins = F.expr("(end_ts - start_ts + bin_ns - 1) div nullif(bin_ns, 0)")
    return (
        F.when(F.expr("start_ts IS NULL OR end_ts IS NULL OR bin_ns IS NULL"), "incomplete")
        .when(F.expr("start_ts >= end_ts"), "start_ts must be before end_ts")
        .when(F.expr("bin_ns <= 0"), "bin_ns must be above 0")
        .when(bins > MAX_CHILDREN, f"a schedule has 1 to {MAX_CHILDREN} bins")
    )


def rejected_parents(parents: DataFrame) -> DataFrame:
    """Parents that the schedules refuse, with ``error``."""
    return parents.withColumn("error", _parent_error()).where("error IS NOT NULL")


def accepted_parents(parents: DataFrame) -> DataFrame:
    return parents.where(_parent_error().isNull())


def _bins(parents: DataFrame) -> DataFrame:
    """One row per bin. A parent without a schedule fails the query; see ``rejected_parents`` for telling them apart first."""
    wrong = _parent_error()
    n = F.when(wrong.isNotNull(), F.raise_error(wrong).cast("bigint")).otherwise(F.expr("(end_ts - start_ts + bin_ns - 1) div nullif(bin_ns, 0)"))
    return parents.withColumn("bins", n).withColumn("bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bins") - 1)))


def twap_schedule(parents: DataFrame) -> DataFrame:
    """Equal bins; the first (total mod bins) get one share more."""
    b = _bins(parents)
    return b.withColumn("due_ts", F.expr("start_ts + (bin + 1) * bin_ns")).withColumn("shares", F.expr("total div bins + CASE WHEN bin < total % bins THEN 1 ELSE 0 END"))


def almgren_schedule(parents: DataFrame, risk_aversion: float, volatility: float, impact: float) -> DataFrame:
    """Risk-averse trajectory: uniform below kappa T = 1e-6, kappa T at most 50, rounded half away from 0, the last bin
    takes what is left."""
    if not (risk_aversion >= 0 and volatility >= 0 and impact > 0) or math.isinf(risk_aversion):
        raise ValueError("risk_aversion and volatility must not be below 0, impact must be above 0")
    b = _bins(parents)
    tau = F.col("bin_ns").cast("double")
    horizon = tau * F.col("bins")
    arg = 1.0 + (risk_aversion * volatility * volatility * tau * tau) / (2.0 * impact)
    kappa = F.acosh(arg) / tau if risk_aversion > 0 else F.lit(0.0)
    kappa = F.when(kappa * horizon > 50.0, F.lit(50.0) / horizon).otherwise(kappa)

    def rest(j: Column) -> Column:
        return F.col("total") * F.sinh(kappa * (horizon - j * tau)) / F.sinh(kappa * horizon)

    uniform = F.col("total").cast("double") / F.col("bins")
    first = F.when(F.col("bin") == 0, F.col("total").cast("double")).otherwise(rest(F.col("bin")))
    x = F.when(kappa * horizon < 1e-6, uniform).otherwise(first - rest(F.col("bin") + 1))
    b = b.withColumn("shares", F.round(x).cast("bigint")).withColumn("due_ts", F.expr("start_ts + (bin + 1) * bin_ns"))
    key = [c for c in parents.columns if c in ("parent_id", "trade_day", "locate")]
    s = b.groupBy(*key).agg(F.sum("shares").alias("_sum"))
    last = F.greatest(F.lit(0), F.col("shares") + F.col("total") - F.col("_sum"))
    return b.join(s, key).withColumn("shares", F.when(F.col("bin") == F.col("bins") - 1, last).otherwise(F.col("shares"))).drop("_sum")


def released(schedule: DataFrame, clock: DataFrame, keys: list[str]) -> DataFrame:
    """Children of a schedule: each bin is released at the first tick of the clock not before its due time; bins without such
    a tick stay unsent."""
    s = schedule.withColumnRenamed("due_ts", "ts")
    c = clock.select(*keys, "ts", F.col("ts").alias("child_ts")).distinct()
    out = as_of(s, c, keys, "ts", ["child_ts"], "child_ts", BLOCK, forward=True)
    return out.where("child_ts IS NOT NULL").withColumnRenamed("ts", "due_ts")


def curve_target(now: Column, start: Column, end: Column, total: Column) -> Column:
    """Shares that the volume curve wants sent by now; every division floors."""
    cum = F.array(*[F.lit(c).cast(D) for c in [0, *VOLUME_CURVE]])
    elapsed, span = (now - start).cast(D), (end - start).cast(D)
    late = elapsed >= span
    scaled = elapsed * 13
    index = F.when(late, F.lit(12)).otherwise(F.floor(scaled / span).cast("int"))
    # the quotient of decimals is rounded: settle it by its remainder
    index = F.when(index.cast(D) * span > scaled, index - 1).otherwise(index)
    rem = F.when(late, span).otherwise(scaled - index.cast(D) * span)
    lo, hi = F.get(cum, index), F.get(cum, index + 1)
    within = _div((hi - lo) * rem, span)
    return F.least(total, _div(total.cast(D) * (lo + within), F.lit(1000000).cast(D)).cast("bigint"))


def _div(a: Column, b: Column) -> Column:
    """Floor of a quotient of whole numbers not below 0; the numerator is made a multiple first, so it is exact."""
    return F.floor((a - F.pmod(a, b)) / b).cast(D)


def vwap_children(parents: DataFrame, prints: DataFrame, keys: list[str]) -> DataFrame:
    """For each print inside [start, end]: what the curve wants beyond what was sent. Also ``market_shares`` seen so far."""
    t = prints.join(parents, keys).where("ts BETWEEN start_ts AND end_ts")
    t = t.withColumn("target", curve_target(F.col("ts"), F.col("start_ts"), F.col("end_ts"), F.col("total")))
    r = running(t, keys, F.expr(f"ts div {BLOCK}"), ["ts", "print_id"], {"sent": ("max", "target"), "market_shares": ("sum", "shares")})
    return r.withColumn("child_shares", F.col("sent") - F.coalesce("sent_before", F.lit(0)))


def pov_children(parents: DataFrame, prints: DataFrame, keys: list[str], bps: int) -> DataFrame:
    """For each print up to the end: floor(shares * bps / 10000), until the total is used up."""
    t = prints.join(parents, keys).where("end_ts = 0 OR ts <= end_ts").withColumn("raw", F.expr(f"shares * {bps} div 10000"))
    r = running(t, keys, F.expr(f"ts div {BLOCK}"), ["ts", "print_id"], {"cum": ("sum", "raw")})
    return r.withColumn("child_shares", (F.least("total", "cum") - F.least("total", "cum_before")).cast("bigint"))


def first_children(children: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The children that fit the queue: the first 512 of each parent."""
    c = children.where("child_shares > 0").withColumn("_one", F.lit(1))
    r = running(c, keys, F.expr(f"{order[0]} div {BLOCK}"), order, {"slot": ("count", "_one")})
    return r.where(f"slot <= {MAX_CHILDREN}").drop("_one", "slot_before")


def fills(children: DataFrame, quotes: DataFrame, prints: DataFrame, keys: list[str]) -> DataFrame:
    """Immediate fills: a limit child against the quote as of its time, a market child at the last print; null if none."""
    q = as_of(children, quotes, keys, "ts", ["bid_price", "ask_price"], "version", BLOCK)
    q = as_of(q, prints.select(*keys, "ts", "print_id", F.col("price").alias("last_price")), keys, "ts", ["last_price"], "print_id", BLOCK)
    limit = F.when((F.col("side") == "B") & (F.col("price") >= F.col("ask_price")), F.col("ask_price")).when((F.col("side") != "B") & (F.col("price") <= F.col("bid_price")), F.col("bid_price"))
    return q.withColumn("fill_price", F.when(F.col("type") == "Limit", limit).otherwise(F.nullif("last_price", F.lit(0))))


def fill_stats(filled: DataFrame, by: list[str]) -> DataFrame:
    got = F.col("fill_price").isNotNull()
    s = filled.groupBy(*by).agg(
        F.sum("shares").alias("attempted"), F.coalesce(F.sum(F.when(got, F.col("shares"))), F.lit(0)).alias("filled"),
        F.sum(F.when(got, F.col("shares").cast(D) * F.col("fill_price"))).alias("_n"),
    )
    rate = F.when(F.col("attempted") > 0, F.col("filled") / F.col("attempted")).otherwise(0.0)
    price = F.when(F.col("filled") > 0, F.col("_n").cast("double") / F.col("filled")).otherwise(0.0)
    return s.select(*by, "attempted", "filled", F.round(rate, 6).alias("fill_rate"), F.round(price, 6).alias("vwap_price"))


def risk_gate(orders: DataFrame, keys: list[str], order: list[str], max_shares: int, max_notional: int, collar_bps: int, cum_shares: int, cum_notional: int, resets: DataFrame | None = None) -> DataFrame:
    """Add ``reason`` to each order (``reference_price`` null or 0: no collar). Orders that pass on their own run up totals;
    the first to break one trips the gate of its key, and all later orders meet a tripped gate. ``resets`` (keys, order[0]): from that
    time on the gate of a key is open again and its totals start from 0."""
    if resets is not None:
        w = Window.partitionBy(*keys).orderBy(order[0])  # acts of a person: few a key
        e = resets.select(*keys, order[0]).distinct().withColumn("_epoch", F.row_number().over(w))
        o = as_of(orders, e, keys, order[0], ["_epoch"], "_epoch", BLOCK).withColumn("_epoch", F.coalesce("_epoch", F.lit(0)))
        return risk_gate(o, [*keys, "_epoch"], order, max_shares, max_notional, collar_bps, cum_shares, cum_notional).drop("_epoch")
    notional = F.col("price").cast(D) * F.col("shares")
    ref = F.nullif("reference_price", F.lit(0))
    off = (F.col("type") == "Limit") & ref.isNotNull() & (F.abs(F.col("price") - ref) > F.expr(f"reference_price * {collar_bps} div 10000"))
    own = F.when(F.col("shares") > max_shares, "OrderTooLarge").when(notional > max_notional, "NotionalTooLarge").when(F.coalesce(off, F.lit(False)), "PriceOutOfCollar")
    o = orders.withColumn("_own", own)
    passes = F.col("_own").isNull()
    o = o.withColumn("_s", F.when(passes, F.col("shares")).otherwise(0)).withColumn("_n", F.when(passes, notional).otherwise(0).cast(D))
    o = running(o, keys, F.expr(f"{order[0]} div {BLOCK}"), order, {"_cs": ("sum", "_s"), "_cn": ("sum", "_n")})
    broke = passes & ((F.col("_cs") > cum_shares) | (F.col("_cn") > cum_notional))
    at = F.struct(*order)
    trip = o.where(broke).groupBy(*keys).agg(F.min(at).alias("_trip"))
    o = o.join(trip, keys, "left")
    reason = (
        F.when(F.col("_trip").isNotNull() & (at > F.col("_trip")), "KillSwitchTripped")
        .when(~passes, F.col("_own"))
        .when(F.col("_cs") > cum_shares, "CumulativeSharesExceeded")
        .when(F.col("_cn") > cum_notional, "CumulativeNotionalExceeded")
        .otherwise("None")
    )
    return o.select(*orders.columns, reason.alias("reason"))
