"""The tick-ladder book model: which adds it refuses for their price.

A ladder covers a window of prices, at first 30 % around the price of the book's first message. An add outside widens it by 30 %
around its own price, unless the window would exceed 8,000,000 ticks; a price off the 100-tick grid is refused after that, a
repeated ref last. Refused births are removed from the feed, so what refers to them is unknown, and everything else is the
common lifecycle. The add half of a replace is tried only if its old ref was open.

Where no price of a book reaches ``FAR`` no window can grow too wide, and only the grid refuses: that is a filter. The other books
(``far_books``, those with implausible prices) are settled by a fixpoint: the adds tried under the refusals so far are folded in
order of seq, which gives the refusals of the next round. Every round is right for a longer beginning of the day, so it ends with the
sequential result. Of these books only adds outside the first window enter the fold, a stream with a state of two numbers.

Defined results: a null price is tried as no price and never refused; rows without trade_day, locate or seq belong to no book;
repeated rows of a seq count once; an empty input gives no rows; columns not named are kept by ``ladder_messages``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from bookweave.operators import lifecycle as lc
from bookweave.session import buckets, written

# Fixed values of the ladder.
TICK, WINDOW, MAX_TICKS, FALLBACK, MAX_SANE, TOP = 100, 0.30, 8_000_000, 500_000, 100_000_000, 4_294_967_295
FAR = 615_384_000  # below it a window of MAX_TICKS always has room: 1.3 times it is less than 800,000,000
KEY = ["trade_day", "locate"]


def _low(price):
    low = F.greatest(price - F.floor(price * WINDOW), F.lit(0))
    return (low - F.pmod(low, F.lit(TICK))).cast("bigint")


def _high(price):
    return F.least(F.lit(TOP), price + F.floor(price * WINDOW)).cast("bigint")


def _adds(messages: DataFrame) -> DataFrame:
    m = lc.book_messages(messages).where("type IN ('A', 'F', 'U') AND price IS NOT NULL AND trade_day IS NOT NULL AND locate IS NOT NULL")
    return m.groupBy(*KEY, "seq").agg(F.min("type").alias("type"), F.min("price").alias("price"))


def _fold(rows: DataFrame) -> DataFrame:
    """(trade_day, locate, seq) of the adds whose window would grow too wide; rows: KEY, seq, price, low, high (the first window)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, lo, hi = None, 0, 0
        for b in batches:
            out = []
            for day, loc, seq, price, low, high in zip(b.trade_day, b.locate, b.seq, b.price, b.low, b.high):
                if (day, loc) != at:
                    at, lo, hi = (day, loc), low, high
                if lo <= price <= hi:
                    continue
                own = int(price * WINDOW)
                new_lo = min(lo, max(0, price - own) // TICK * TICK) if price < lo else lo
                new_hi = max(hi, min(TOP, price + own)) if price > hi else hi
                if (new_hi - new_lo) // TICK + 1 > MAX_TICKS:
                    out.append((day, loc, seq))
                else:
                    lo, hi = new_lo, new_hi
            yield pd.DataFrame(out, columns=[*KEY, "seq"])

    parts = rows.select(*KEY, "seq", "price", "low", "high").repartition(buckets(rows.sparkSession), *KEY).sortWithinPartitions(*KEY, "seq")
    return parts.mapInPandas(run, "trade_day int, locate int, seq bigint")


def refused(messages: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(trade_day, locate, seq) of adds and replaces whose price the ladder refuses, were they tried."""
    adds = _adds(messages)
    grid = adds.where(f"price % {TICK} <> 0").select(*KEY, "seq")
    far = adds.where(f"price >= {FAR}").select(*KEY).distinct()
    if not far.take(1):
        return grid
    m = written(messages.join(written(far, "far"), KEY, "left_semi"), "farbooks")
    hint = F.when(F.col("type").isin("A", "F"), F.col("price"))
    base = lc.book_messages(m).groupBy(*KEY).agg(F.min_by(F.coalesce(hint, F.lit(0)), "seq").alias("_hint"))
    base = base.withColumn("_base", F.when(F.col("_hint").between(1, MAX_SANE), F.col("_hint")).otherwise(FALLBACK)).select(*KEY, _low(F.col("_base")).alias("low"), _high(F.col("_base")).alias("high"))
    outside = written(_adds(m).join(base, KEY).where("price < low OR price > high"), "outside")
    own = _adds(m).where(f"price % {TICK} <> 0").select(*KEY, "seq")
    bad, last = own, None
    for _ in range(max_rounds):
        feed = lc.settled_feed(_without(m, bad))
        void = lc.orphan_mutations(feed).select(*lc.split_day_locate(), "seq")
        tried = outside.where("type <> 'U'").unionByName(outside.where("type = 'U'").join(void, [*KEY, "seq"], "left_anti"))
        seen = Observation()
        wide = written(_fold(tried).observe(seen, F.count("*").alias("n"), F.bit_xor(F.xxhash64(*KEY, "seq")).alias("x")), "wide")
        if seen.get == last:
            return grid.unionByName(wide).distinct()
        last, bad = seen.get, own.unionByName(wide).distinct()
    raise RuntimeError(f"no fixpoint after {max_rounds} rounds")


def _without(messages: DataFrame, bad: DataFrame) -> DataFrame:
    m = messages.join(bad.withColumn("_bad", F.lit(True)), [*KEY, "seq"], "left")
    m = m.where("_bad IS NULL OR type = 'U' OR NOT decoded")
    return m.withColumn("type", F.when(F.col("_bad") & F.col("decoded") & (F.col("type") == "U"), "D").otherwise(F.col("type"))).drop("_bad").select(*messages.columns)


def ladder_messages(messages: DataFrame, bad: DataFrame | None = None) -> DataFrame:
    """The feed as the ladder sees it: refused adds are gone, a refused replace only removes its old ref."""
    return _without(messages, refused(messages) if bad is None else bad)


def unknown_refs(messages: DataFrame) -> DataFrame:
    """(trade_day, type, unknown_refs): mutations that found nothing, repeated refs, refused adds, and replaces whose new half was refused."""
    from bookweave.operators import book

    bad = written(refused(messages), "refused")
    feed = lc.settled_feed(ladder_messages(messages, bad), full=True)
    rest = book.applied(feed).where("NOT applied").select(*lc.split_day_locate(), "seq", "kind").join(bad, [*KEY, "seq"], "left_anti").select("trade_day", F.col("kind").alias("type"))
    kinds = lc.book_messages(messages).where("type IN ('A', 'F', 'U')").select(*KEY, "seq", F.when(F.col("type") == "U", "U").otherwise("A").alias("type")).distinct()
    own = kinds.join(bad, [*KEY, "seq"], "left_semi").select("trade_day", "type")
    return rest.unionByName(own).groupBy("trade_day", "type").agg(F.count("*").alias("unknown_refs"))
