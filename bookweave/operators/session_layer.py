"""Sequenced datagram sessions in batch: duplicates, gaps, the contiguous prefix, gap requests and their answers.

A session is a trade day; ``seq`` numbers its frames. Sequence numbers are cut into blocks, so no session is ordered by
one task. Rows without a day or seq carry no frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16
MAX_REQUEST = 65534  # fixed value: messages one request may ask for


def frames(datagrams: DataFrame) -> DataFrame:
    return datagrams.where("trade_day IS NOT NULL AND seq IS NOT NULL")


def dedupe(datagrams: DataFrame) -> DataFrame:
    """Per session: datagrams, distinct frames and repeats, by line of first arrival (ties: the lesser line)."""
    first = F.struct(F.col("recv_ts").isNull(), "recv_ts", "line")
    f = frames(datagrams).groupBy("trade_day", "seq").agg(F.count("*").alias("n"), F.min(first).alias("_f"))
    return f.groupBy("trade_day", F.col("_f.line").alias("line")).agg(F.count("*").alias("frames"), F.sum("n").alias("datagrams"), F.sum(F.col("n") - 1).alias("repeats"))


def gaps(datagrams: DataFrame) -> DataFrame:
    """(trade_day, first, count, requests) of every run of frames that never came, between the first and last that did."""
    f = frames(datagrams).select("trade_day", "seq", F.expr(f"seq div {BLOCK}").alias("block")).distinct()
    inner = f.withColumn("next", F.lead("seq").over(Window.partitionBy("trade_day", "block").orderBy("seq")))
    ends = f.groupBy("trade_day", "block").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    outer = ends.select("trade_day", F.col("hi").alias("seq"), F.lead("lo").over(Window.partitionBy("trade_day").orderBy("block")).alias("next"))
    g = inner.select("trade_day", "seq", "next").unionByName(outer).where("next > seq + 1")
    n = F.col("next") - F.col("seq") - 1
    return g.select("trade_day", (F.col("seq") + 1).alias("first"), n.alias("count"), F.expr(f"(next - seq - 2 + {MAX_REQUEST}) div {MAX_REQUEST}").alias("requests"))


def drain(datagrams: DataFrame) -> DataFrame:
    """Per session: first frame, the next one wanted once the contiguous run is drained, frames held back behind the gap."""
    d = frames(datagrams).groupBy("trade_day").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    g = gaps(datagrams).groupBy("trade_day").agg(F.min("first").alias("next_seq"), F.count("*").alias("gaps"), F.sum("requests").alias("requests"), F.sum("count").alias("missing"))
    j = d.join(g, "trade_day", "left").withColumn("next_seq", F.coalesce("next_seq", F.col("last_seq") + 1))
    held = frames(datagrams).select("trade_day", "seq").distinct().join(F.broadcast(j.select("trade_day", "next_seq")), "trade_day")
    held = held.groupBy("trade_day").agg(F.count(F.when(F.col("seq") > F.col("next_seq"), 1)).alias("pending"))
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("gaps", "requests", "missing")}
    return j.join(held, "trade_day").withColumns(zero)


def retransmitted(requests: DataFrame, log: DataFrame) -> DataFrame:
    """Frames of the log that answer requests (trade_day, first, count): a range join, met block by block."""
    r = requests.withColumn("block", F.explode(F.expr(f"sequence(first div {BLOCK}, (first + count - 1) div {BLOCK})")))
    f = frames(log).select("trade_day", "seq", F.expr(f"seq div {BLOCK}").alias("block")).distinct()
    j = f.join(r, ["trade_day", "block"]).where("seq BETWEEN first AND first + count - 1")
    return j.groupBy("trade_day", "first", "count").agg(F.count("*").alias("answered"))
