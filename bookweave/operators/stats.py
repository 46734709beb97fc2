"""Statistics over latency history: percentiles by lower rank, ratio gate, drift warning, idempotent append.

Repeated rows of a run count once. A null figure takes no part; a ratio with a null or zero divisor is null and fails nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bookweave.functions.running import once, rank_percentiles

RATIO, DRIFT, RECENT, ENOUGH = 0.90, 1.75, 10, 3  # fixed values of the budget


def runs(history: DataFrame) -> DataFrame:
    return once(history, "run_id")


def latency_percentiles(history: DataFrame, value: str = "p99_ns") -> DataFrame:
    return rank_percentiles(runs(history), ["book_type", "message_type"], value, {"p50": 0.5, "p99": 0.99, "p999": 0.999})


def throughput(history: DataFrame) -> DataFrame:
    """Median and best messages a second of each machine and book."""
    r = runs(history).where("p50_ns > 0").withColumn("rate", F.lit(1e9) / F.col("p50_ns"))
    return r.groupBy("runner", "book_type").agg(F.round(F.median("rate"), 3).alias("median_rate"), F.round(F.max("rate"), 3).alias("best_rate"))


def _pairs(history: DataFrame) -> DataFrame:
    key = ["commit_sha", "os", "runner", "message_type", "timestamp_utc"]
    r = runs(history).where("commit_sha IS NOT NULL").select(*key, "book_type", "p50_ns")
    a = r.where("book_type = 'LadderBook'").select(*key, F.col("p50_ns").alias("ladder_p50"))
    b = r.where("book_type = 'OrderBook'").select(*key, F.col("p50_ns").alias("order_p50"))
    return a.join(b, key).withColumn("ratio", F.col("ladder_p50") / F.nullif(F.col("order_p50"), F.lit(0)))


def ratio_gate(history: DataFrame) -> DataFrame:
    """Commits whose ladder is not below 0.90 of the map book, per message type; only a warning on macOS."""
    bad = _pairs(history).where(F.col("ratio") >= RATIO)
    level = F.when(F.col("os").isin("macOS", "Darwin"), "warning").otherwise("failure")
    return bad.select("commit_sha", "os", "runner", "message_type", "ladder_p50", "order_p50", level.alias("level"))


def drift_warning(history: DataFrame) -> DataFrame:
    """Runs whose p99 is above 1.75 times the median of the last 10 runs of their series, if there were at least 3.

    The window holds 10 rows; a series is one machine, book and message type."""
    w = Window.partitionBy("os", "runner", "book_type", "message_type").orderBy("timestamp_utc", "run_id").rowsBetween(-RECENT, -1)
    h = F.array_sort(F.collect_list("p99_ns").over(w))
    r = runs(history).withColumn("_h", h).withColumn("_n", F.size("_h"))
    mid = (F.get("_h", F.expr("(_n - 1) div 2").cast("int")) + F.get("_h", F.expr("_n div 2").cast("int"))) / 2.0
    return r.withColumn("median_p99", mid).where((F.col("_n") >= ENOUGH) & (F.col("p99_ns") > DRIFT * F.col("median_p99"))).select("run_id", "p99_ns", "median_p99")


def new_rows(incoming: DataFrame, history: DataFrame, key: list[str]) -> DataFrame:
    """Rows to append: those whose key is not recorded yet, each once; null keys are compared as equal."""
    have = history.select(*[F.col(k).alias(f"_h_{k}") for k in key]).distinct()
    cond = None
    for k in key:
        c = F.col(k).eqNullSafe(F.col(f"_h_{k}"))
        cond = c if cond is None else cond & c
    return incoming.dropDuplicates(key).join(have, cond, "left_anti")


def ratio_per_commit(history: DataFrame) -> DataFrame:
    return _pairs(history).groupBy("commit_sha", "os").agg(F.round(F.avg("ratio"), 6).alias("mean_ratio"), F.count("ratio").alias("types"))


def pivot_types(history: DataFrame) -> DataFrame:
    """Median p50 per message type, one column per book."""
    r = runs(history).groupBy("message_type").pivot("book_type", ["LadderBook", "OrderBook"]).agg(F.median("p50_ns"))
    return r.select("message_type", F.col("LadderBook").alias("ladder_p50"), F.col("OrderBook").alias("order_p50"))
