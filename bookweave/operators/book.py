"""Limit order books from a settled feed: what each message did, resting orders, levels, quotes, snapshots, checkpoints.

Everything is a join or an aggregation on (trade day, locate) or finer; no symbol's events are replayed in one task.
Model ``unbounded``: any price is a level. Rows of the input may repeat and arrive in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bookweave.operators import lifecycle as lc

TICK = 100  # fixed value: the ladder's tick


def _settled(feed: lc.Feed) -> DataFrame:
    """Events with ``ok``: whether they took effect. Only refs born by a replace are looked up among the void ones."""
    s = feed.events().where(f"grp <> {lc.MULTI}")
    birth = F.col("kind") <= lc.BORN
    effect = F.when(birth, F.col("valid") & ~F.col("open")).otherwise(F.col("open"))
    plain = s.where(f"grp <> {lc.REPLACED}").withColumn("ok", effect)
    heirs = s.where(f"grp = {lc.REPLACED}").join(lc.void_births(feed).withColumn("_void", F.lit(True)), ["dl", "ref"], "left")
    return plain.unionByName(heirs.withColumn("ok", effect & F.col("_void").isNull()).drop("_void"))


def applied(feed: lc.Feed) -> DataFrame:
    """(dl, seq, kind, applied): whether each message changed a book. A replace counts as applied if its new half did.

    ``kind``: A, R (reduced), D or U; of a full store the message's own type, F counted as A."""
    name = F.expr(f"CASE kind WHEN {lc.ADD} THEN 'A' WHEN {lc.REDUCE} THEN 'R' WHEN {lc.DELETE} THEN 'D' ELSE 'U' END")
    if "type" in feed.events().columns:
        name = F.when(F.col("type") == "F", "A").otherwise(F.col("type"))
    return _settled(feed).where(f"kind <> {lc.KILL} OR other IS NULL").select("dl", F.expr("sk div 2").alias("seq"), name.alias("kind"), F.col("ok").alias("applied"))


def deltas(feed: lc.Feed, extra: list[str] | None = None) -> DataFrame:
    """(dl, seq, side 'B'/'S', price, shares, orders): the change each effective event makes to its price level.

    The side is an add's own or carried from it to what follows; only events of orders that a replace bore are joined to get it."""
    e = _settled(feed).where("ok")
    birth = F.col("kind") <= lc.BORN
    start = F.when(birth, F.col("sk")).otherwise(F.col("born"))
    out = (F.col("kind") >= lc.DELETE) | (F.col("qty") >= F.col("left"))
    shares = F.when(birth, F.col("qty")).otherwise(-F.when(out, F.col("left")).otherwise(F.col("qty")))
    orders = F.when(birth, 1).otherwise(F.when(out, -1).otherwise(0)).cast("bigint")
    side = F.when(birth, F.col("side")).otherwise(F.col("pside"))
    cols = ["dl", "seq", "price", "shares", "orders", *(extra or [])]
    d = e.select("dl", F.expr("sk div 2").alias("seq"), "price", shares.alias("shares"), orders.alias("orders"), start.alias("_start"), side.alias("_s"), *(extra or []))
    own = d.where("_start % 2 = 0").select(*cols, "_s")
    heirs = d.where("_start % 2 = 1").drop("_s").withColumn("_by", F.expr("_start div 2"))
    heirs = heirs.join(lc.replace_sides(feed).select("dl", F.col("seq").alias("_by"), F.col("side").alias("_s")), ["dl", "_by"]).select(*cols, "_s")
    d = own.unionByName(heirs)
    return d.select("dl", "seq", F.when(F.col("_s"), "B").otherwise("S").alias("side"), "price", "shares", "orders", *(extra or []))


def levels(feed: lc.Feed) -> DataFrame:
    """Price levels at the end of each trade day: those with a resting order, whatever its size."""
    d = deltas(feed).groupBy("dl", "side", "price").agg(F.sum("shares").alias("shares"), F.sum("orders").alias("orders")).where("orders > 0")
    return d.select(*lc.split_day_locate(), "side", "price", "shares", "orders")


def depth(lv: DataFrame, n: int = 5) -> DataFrame:
    """The n best levels of each side."""
    best = F.when(F.col("side") == "B", -F.col("price")).otherwise(F.col("price"))
    rank = F.row_number().over(Window.partitionBy("trade_day", "locate", "side").orderBy(best))
    return lv.withColumn("level", rank.cast("bigint")).where(F.col("level") <= n)


def books(messages: DataFrame) -> DataFrame:
    """(trade_day, locate) of every book: any decoded message makes one, even if it found nothing."""
    return lc.book_messages(messages).where("trade_day IS NOT NULL AND locate IS NOT NULL").select("trade_day", "locate").distinct()


def quotes(lv: DataFrame) -> DataFrame:
    """Best bid and ask, open orders and number of levels per (trade_day, locate)."""
    bid, ask = F.col("side") == "B", F.col("side") == "S"
    return lv.groupBy("trade_day", "locate").agg(
        F.max(F.when(bid, F.col("price"))).alias("bid_price"),
        F.max_by("shares", F.when(bid, F.col("price"))).alias("bid_shares"),
        F.min(F.when(ask, F.col("price"))).alias("ask_price"),
        F.min_by("shares", F.when(ask, F.col("price"))).alias("ask_shares"),
        F.sum("orders").alias("open_orders"),
        F.count(F.when(bid, 1)).alias("bid_levels"),
        F.count(F.when(ask, 1)).alias("ask_levels"),
    )


def snapshot(messages: DataFrame, feed: lc.Feed | None = None) -> DataFrame:
    """One row per book, empty ones included."""
    feed = feed or lc.settled_feed(messages)
    q = books(messages).join(quotes(levels(feed)), ["trade_day", "locate"], "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("open_orders", "bid_levels", "ask_levels")}
    return q.withColumns(zero)


def _dyadic(first: str, last: str):
    """Nodes (k, i) of a binary tree over versions that together cover first..last: at most two a level; node (k, i) covers
    the versions v with v >> k = i."""
    step = (
        f"aggregate(sequence(0, 40), named_struct('l', {first}, 'r', {last} + 1, 'out', cast(array() as array<struct<k:int,i:bigint>>)), "
        "(a, k) -> CASE WHEN a.l >= a.r THEN a ELSE named_struct('l', (a.l + a.l % 2) div 2, 'r', (a.r - a.r % 2) div 2, 'out', concat(a.out, "
        "CASE WHEN a.l % 2 = 1 THEN array(named_struct('k', k, 'i', a.l)) ELSE cast(array() as array<struct<k:int,i:bigint>>) END, "
        "CASE WHEN a.r % 2 = 1 THEN array(named_struct('k', k, 'i', a.r - 1)) ELSE cast(array() as array<struct<k:int,i:bigint>>) END)) END, a -> a.out)"
    )
    return F.expr(step)


def checkpoints(messages: DataFrame, feed: lc.Feed, every: int) -> DataFrame:
    """What is published after each ``every`` decoded messages of a trade day and once more at its end: one row per version and
    book that exists by then, empty books included.

    The ordinal of a decoded message is its rank by seq within the day, from counts per block of seq and a rank inside
    the block; a level's state is a running sum over the versions in which it changed. The best level of a version is not
    looked for among all levels: the time a level stands is cut into nodes of a binary tree over the versions, the best is
    kept per node, and a version in which a side changed asks its ancestors, so the work is changes times the logarithm
    of the versions. Between changes a book's row is repeated.
    """
    key = ["trade_day", "locate"]
    block = F.expr("seq div 65536").alias("block")
    m = lc.book_messages(messages).where("trade_day IS NOT NULL").select("trade_day", "locate", block, "seq").distinct()
    w = Window.partitionBy("trade_day")
    n = m.groupBy("trade_day", "block").agg(F.count("*").alias("_n")).withColumn("_base", F.sum("_n").over(w.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)))
    rank = F.row_number().over(Window.partitionBy("trade_day", "block").orderBy("seq", "locate"))
    at = m.withColumn("_r", rank).join(n, ["trade_day", "block"]).select("trade_day", "locate", "seq", F.ceil((F.coalesce("_base", F.lit(0)) + F.col("_r")) / every).alias("version"))
    last = n.groupBy("trade_day").agg((F.expr(f"sum(_n) div {every}") + 1).alias("versions"))  # one row per trade day
    d = deltas(feed).select(*lc.split_day_locate(), "seq", "side", "price", "shares", "orders").join(at, [*key, "seq"])
    d = d.groupBy(*key, "side", "price", "version").agg(F.sum("shares").alias("shares"), F.sum("orders").alias("orders"))
    lw = Window.partitionBy(*key, "side", "price").orderBy("version")
    run = lw.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("change", F.col("orders")).withColumn("shares", F.sum("shares").over(run)).withColumn("orders", F.sum("orders").over(run)).withColumn("_next", F.lead("version").over(lw))
    there, was = (F.col("orders") > 0).cast("int"), (F.col("orders") - F.col("change") > 0).cast("int")
    d = d.withColumn("levels", there - was).join(F.broadcast(last), "trade_day")
    # the price that is best is the greatest of these
    worth = F.when(F.col("side") == "B", F.col("price")).otherwise(-F.col("price"))
    stands = d.where("orders > 0").select(*key, "side", F.struct(worth.alias("w"), "price", "shares").alias("best"), F.inline(_dyadic("version", "coalesce(_next - 1, versions)")))
    nodes = stands.groupBy(*key, "side", "k", "i").agg(F.max("best").alias("best"))
    changed = d.groupBy(*key, "side", "version", "versions").agg(F.sum("change").alias("orders"), F.sum("levels").alias("levels"))
    depth = F.expr("cast(ceil(log2(versions + 1)) as int)")
    ask = changed.select(*key, "side", "version", F.explode(F.sequence(F.lit(0), depth)).alias("k")).withColumn("i", F.expr("shiftright(version, k)"))
    best = ask.join(nodes, [*key, "side", "k", "i"], "left").groupBy(*key, "side", "version").agg(F.max("best").alias("best"))
    side = lambda x, c: F.when(F.col("side") == x, F.col(c))
    rows = changed.join(best, [*key, "side", "version"]).groupBy(*key, "version").agg(
        F.sum("orders").alias("orders"), *[F.coalesce(F.sum(side(x, "levels")), F.lit(0)).alias(f"levels_{x}") for x in "BS"],
        *[F.max(F.when(F.col("side") == x, F.struct("best"))).alias(f"best_{x}") for x in "BS"],
    )
    born = at.where("locate IS NOT NULL").groupBy(*key).agg(F.min("version").alias("version")).withColumn("_born", F.lit(True))
    rows = rows.join(born, [*key, "version"], "full")
    kw = Window.partitionBy(*key).orderBy("version")
    upto = kw.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(
        *key, "version", F.lead("version").over(kw).alias("_next"), *[F.last(f"best_{x}", ignorenulls=True).over(upto).alias(f"best_{x}") for x in "BS"],
        *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(c) for c in ("orders", "levels_B", "levels_S")],
    ).join(F.broadcast(last), "trade_day")
    rows = rows.withColumn("version", F.explode(F.sequence("version", F.coalesce(F.col("_next") - 1, F.col("versions")))))
    got = lambda x, c: F.col(f"best_{x}.best.{c}")
    return rows.select(
        "trade_day", "version", "locate", got("B", "price").alias("bid_price"), got("B", "shares").alias("bid_shares"), got("S", "price").alias("ask_price"), got("S", "shares").alias("ask_shares"),
        F.col("orders").alias("open_orders"), F.col("levels_B").alias("bid_levels"), F.col("levels_S").alias("ask_levels"),
    )


def replace_chains(feed: lc.Feed) -> DataFrame:
    """Replaces that worked: (trade_day, locate, seq, side) with the side of the order the chain began with."""
    return lc.replace_sides(feed).select(*lc.split_day_locate(), "seq", F.when(F.col("side"), "B").otherwise("S").alias("side"))


def trades(feed: lc.Feed) -> DataFrame:
    """The tape: every execution that met a resting order, clamped to its size, at the message's price (C) or the order's
    (E); from a full store."""
    d = deltas(feed, lc.EXTRA).where("type IN ('E', 'C')")
    price = F.when(F.col("type") == "C", F.col("paid")).otherwise(F.col("price"))
    return d.select(*lc.split_day_locate(), "seq", "side", price.alias("price"), (-F.col("shares")).alias("shares"), "match")
