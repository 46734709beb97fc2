"""The reference operators as queries over a folder of tables, with SQL to check them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookweave.functions import wire
from bookweave.operators import book, ladder, lifecycle
from bookweave.plans import catalogue_more
from bookweave.plans.feed_sql import FEED_SQL
from bookweave.session import table

CHECKPOINT_EVERY = 2000


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "messages")


def book_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return book.snapshot(_messages(spark, d))


def _feed(spark: SparkSession, d: str) -> lifecycle.Feed:
    return lifecycle.settled_feed(_messages(spark, d))


def book_levels(spark: SparkSession, d: str) -> DataFrame:
    return book.levels(_feed(spark, d))


def book_depth_top5(spark: SparkSession, d: str) -> DataFrame:
    return book.depth(book.levels(_feed(spark, d)), 5)


def open_orders_by_side(spark: SparkSession, d: str) -> DataFrame:
    return book.levels(_feed(spark, d)).groupBy("trade_day", "locate", "side").agg(F.sum("orders").alias("open_orders"), F.sum("shares").alias("shares"))


def unknown_refs_by_type(spark: SparkSession, d: str) -> DataFrame:
    u = book.applied(lifecycle.settled_feed(_messages(spark, d), full=True)).where("NOT applied")
    return u.groupBy(lifecycle.split_day_locate()[0], F.col("kind").alias("type")).agg(F.count("*").alias("unknown_refs"))


def crossed_books(spark: SparkSession, d: str) -> DataFrame:
    s = book_snapshot(spark, d)
    return s.groupBy("trade_day").agg(F.count("*").alias("books"), F.count(F.when(F.col("bid_price") >= F.col("ask_price"), 1)).alias("crossed"))


def replace_lineage(spark: SparkSession, d: str) -> DataFrame:
    feed = _feed(spark, d)
    done = book.applied(feed).where("kind = 'U' AND applied").select(*lifecycle.split_day_locate(), "seq")
    return book.replace_chains(feed).join(done, ["trade_day", "locate", "seq"], "left_semi")


def trade_tape(spark: SparkSession, d: str) -> DataFrame:
    return book.trades(lifecycle.settled_feed(_messages(spark, d), full=True))


def replay_report(spark: SparkSession, d: str) -> DataFrame:
    """Per trade day: frames, bytes, decoded frames, frames by counted type, books and their totals, unknown refs; 0 where there are none."""
    m = _messages(spark, d)
    feed = lifecycle.settled_feed(m)
    once = m.groupBy("trade_day", "seq").agg(F.max("len").alias("len"), F.max("decoded").alias("decoded"), F.max_by("type", F.col("decoded").cast("int")).alias("type"))
    kind = F.when(F.col("decoded") & (F.col("type") == "F"), "A").otherwise(F.col("type"))
    by = once.groupBy("trade_day", kind.alias("type")).agg(F.count("*").alias("n"), F.sum(F.col("len") + 2).alias("bytes"), F.count(F.when(F.col("decoded"), 1)).alias("decoded"))
    # at most one entry for each of the 256 type bytes
    counts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("type", "n"))), lambda x: F.concat(x["type"], F.lit("="), x["n"])), " ")
    frames = by.groupBy("trade_day").agg(F.sum("n").alias("frames"), F.sum("bytes").alias("bytes"), F.sum("decoded").alias("decoded"), counts.alias("frames_by_type"))
    s = book.snapshot(m, feed).groupBy("trade_day").agg(F.count("*").alias("books"), *[F.sum(c).alias(c) for c in ("open_orders", "bid_levels", "ask_levels")])
    u = book.applied(feed).where("NOT applied").groupBy(lifecycle.split_day_locate()[0]).agg(F.count("*").alias("unknown_refs"))
    return frames.join(s, "trade_day", "left").join(u, "trade_day", "left").fillna(0, ["books", "open_orders", "bid_levels", "ask_levels", "unknown_refs"])


def threeway_diff(spark: SparkSession, d: str) -> DataFrame:
    """The true book against what the live handler last published, per trade day."""
    b = table(spark, d, "book_snapshots")
    last = b.groupBy("trade_day").agg(F.max("version").alias("version"))
    cols = ["bid_price", "ask_price", "open_orders", "bid_levels", "ask_levels"]
    h = b.join(F.broadcast(last), ["trade_day", "version"], "left_semi").select("trade_day", "locate", *cols).distinct()
    h = h.select("trade_day", "locate", *[F.col(c).alias(f"h_{c}") for c in cols], F.lit(True).alias("_h"))
    j = book_snapshot(spark, d).withColumn("_s", F.lit(True)).join(h, ["trade_day", "locate"], "full_outer")

    def other(c: str):
        return ~F.col(c).eqNullSafe(F.col(f"h_{c}"))

    return j.groupBy("trade_day").agg(
        F.count("*").alias("books"), F.count(F.when(F.col("_s").isNull() | F.col("_h").isNull(), 1)).alias("one_sided"),
        F.count(F.when(other("bid_price") | other("ask_price"), 1)).alias("other_quote"), F.count(F.when(other("open_orders"), 1)).alias("other_open_orders"),
    )


def quote_point(spark: SparkSession, d: str) -> DataFrame:
    """Every book as the service answers for it after the last publish of its day: one each CHECKPOINT_EVERY messages and one at the end."""
    m = _messages(spark, d)
    feed = lifecycle.settled_feed(m)
    n = lifecycle.book_messages(m).where("trade_day IS NOT NULL").select("trade_day", "locate", "seq").distinct().groupBy("trade_day").agg((F.expr(f"count(*) div {CHECKPOINT_EVERY}") + 1).alias("snapshot_version"))
    u = book.applied(feed).where("NOT applied").groupBy(lifecycle.split_day_locate()[0]).agg(F.count("*").alias("unknown_refs"))
    s = book.snapshot(m, feed).join(F.broadcast(n), "trade_day").join(F.broadcast(u), "trade_day", "left").fillna(0, ["unknown_refs"])
    return s.select("trade_day", wire.quote_json().alias("response"))


def checkpoint_bbo(spark: SparkSession, d: str) -> DataFrame:
    return book.checkpoints(_messages(spark, d), _feed(spark, d), CHECKPOINT_EVERY)


def ladder_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The books as the tick ladder holds them at the end of each day."""
    m = _messages(spark, d)
    return book.snapshot(m, lifecycle.settled_feed(ladder.ladder_messages(m)))


def ladder_unknown_refs(spark: SparkSession, d: str) -> DataFrame:
    return ladder.unknown_refs(_messages(spark, d))


def threeway_checkpoints(spark: SparkSession, d: str) -> DataFrame:
    """At every checkpoint and for every book: where the ladder differs from the unbounded model, and where either is crossed."""
    m = _messages(spark, d)
    own = book.checkpoints(m, lifecycle.settled_feed(m), CHECKPOINT_EVERY)
    key, cols = ["trade_day", "version", "locate"], ["bid_price", "bid_shares", "ask_price", "ask_shares", "open_orders", "bid_levels", "ask_levels"]
    other = book.checkpoints(m, lifecycle.settled_feed(ladder.ladder_messages(m)), CHECKPOINT_EVERY).select(*key, *[F.col(c).alias(f"l_{c}") for c in cols])

    def differ(*cs: str):
        return F.count(F.when(~F.struct(*cs).eqNullSafe(F.struct(*[F.col(f"l_{c}").alias(c) for c in cs])), 1))

    return own.join(other, key, "full").groupBy("trade_day").agg(
        F.countDistinct("version").alias("versions"), F.count("*").alias("books"), differ("bid_price", "bid_shares").alias("other_bid"), differ("ask_price", "ask_shares").alias("other_ask"),
        differ("open_orders").alias("other_open_orders"), differ("bid_levels", "ask_levels").alias("other_levels"),
        F.count(F.when(F.col("bid_price") >= F.col("ask_price"), 1)).alias("crossed"), F.count(F.when(F.col("l_bid_price") >= F.col("l_ask_price"), 1)).alias("ladder_crossed"),
    )


_ALL = (
    book_snapshot, book_levels, book_depth_top5, open_orders_by_side, unknown_refs_by_type, crossed_books, replace_lineage, trade_tape, replay_report,
    threeway_diff, quote_point, checkpoint_bbo, ladder_snapshot, ladder_unknown_refs, threeway_checkpoints,
)
QUERIES = {f.__name__: f for f in _ALL}
SQL = dict(FEED_SQL)

QUERIES |= catalogue_more.QUERIES
SQL |= catalogue_more.SQL
