"""References to records that do not exist, per table and trade day, direct or inherited.

Defined results: a null reference refers to nothing and is never reported (executions, fills); a record whose trade
day or locate is null names no order and is an orphan; repeated rows of a record are reported once; a fill without a
``ts`` has no child order before it; empty tables give no rows; columns other than those named are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookweave.operators import lifecycle as lc


def _out(df: DataFrame, src: str, rec: str) -> DataFrame:
    return df.select(F.lit(src).alias("src_table"), "trade_day", F.col(rec).cast("bigint").alias("rec_id"), "direct").distinct()


def message_orphans(messages: DataFrame, feed: lc.Feed) -> DataFrame:
    placed = lc.orphan_mutations(feed).select(lc.split_day_locate()[0], "seq", "direct")
    lost = lc.book_messages(messages).where("type IN ('E', 'C', 'X', 'D', 'U') AND (trade_day IS NULL OR locate IS NULL OR ref IS NULL)")
    return _out(placed, "messages", "seq").unionByName(_out(lost.withColumn("direct", F.lit(True)), "messages", "seq"))


def execution_orphans(executions: DataFrame, feed: lc.Feed) -> DataFrame:
    """Executions whose ref names no order open at any time of their trade day and locate.

    The references are reduced to distinct (day, locate, ref) before anything is joined, so a ref that many records
    share costs one row; the missing ones are then looked up in the records.
    """
    x = executions.where("ref IS NOT NULL").select("exec_id", "trade_day", lc.day_locate().alias("dl"), "ref")
    missing = x.where("dl IS NOT NULL").select("dl", "ref").distinct().join(lc.known_orders(feed), ["dl", "ref"], "left_anti")
    inherited = lc.void_births(feed).withColumn("_void", F.lit(True))
    missing = missing.join(inherited, ["dl", "ref"], "left").select("dl", "ref", F.col("_void").isNull().alias("direct"))
    return _out(x.join(missing, ["dl", "ref"]), "executions", "exec_id").unionByName(_out(x.where("dl IS NULL").withColumn("direct", F.lit(True)), "executions", "exec_id"))


def fill_orphans(fills: DataFrame, child_orders: DataFrame) -> DataFrame:
    """Fills without a child order of their trade day that is not later than they are."""
    born = child_orders.where("child_id IS NOT NULL").groupBy("trade_day", "child_id").agg(F.min("ts").alias("_born"))
    f = fills.where("child_id IS NOT NULL").select("fill_id", "trade_day", "child_id", "ts")
    lost = f.join(born, ["trade_day", "child_id"], "left").where("_born IS NULL OR ts IS NULL OR _born > ts")
    return _out(lost.withColumn("direct", F.lit(True)), "fills", "fill_id")


def orphans(messages: DataFrame, executions: DataFrame, fills: DataFrame, child_orders: DataFrame, feed: lc.Feed | None = None) -> DataFrame:
    """(src_table, trade_day, rec_id, direct) of every orphan record."""
    feed = feed or lc.settled_feed(messages)
    return message_orphans(messages, feed).unionByName(execution_orphans(executions, feed)).unionByName(fill_orphans(fills, child_orders))


def orphan_report(found: DataFrame, book_snapshots: DataFrame) -> DataFrame:
    """Counts per table and trade day beside the handler's own last count of unknown refs."""
    n = found.groupBy("src_table", "trade_day").agg(
        F.count(F.when(F.col("direct"), 1)).alias("direct"), F.count(F.when(~F.col("direct"), 1)).alias("inherited")
    )
    own = book_snapshots.groupBy("trade_day").agg(F.max("unknown_refs").alias("handler_unknown_refs"))
    return n.join(own, "trade_day", "left").select("src_table", "trade_day", "direct", "inherited", "handler_unknown_refs")
