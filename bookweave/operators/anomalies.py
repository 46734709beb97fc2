"""Implausible readings of many sources: physical limits, run-length counters and robust control charts.

A chart runs through the readings of one source in order, but one source may hold a third of all rows. So sources are
cut into chunks of ``CHUNK`` readings that overlap by what a decision needs: run-length counters look at most
``stuck - 1`` readings away, and an exponentially weighted chart forgets (after ``WARM`` readings the weight of what
came before is (1 - ALPHA) ** WARM, below 1e-6). Ordinals inside a source, which the chunks are cut by, come from a
prefix sum over blocks, never from a window over a whole source.

Chart: each reading is compared with the level just before it (forward chart) and just after it (the same chart run
backwards); values further than CLIP scales from the level are clipped before level and scale are updated, so a spike
hardly moves the chart; SHIFT suspects in a row are taken for a lasting shift and the chart starts anew at their median. Impossible and stuck readings are left out.
What is usual for a source is the median distance from the level, over all its readings.

Defined results: a null value is no reading; repeated rows of an id count once; ties in the order are broken by id; a
reading without a source is only held against physical limits; sources below ``MIN_READINGS`` readings have no
spikes; where a reading has no level on one side (first, last), the other side decides; a source whose usual distance
is 0 counts a distance of one unit as usual.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bookweave.operators.lifecycle import day_locate
from bookweave.session import written

CHUNK, WARM = 1024, 64
ALPHA, CLIP, SHIFT = 0.2, 4.0, 5
MIN_READINGS = 50
SPIKE_TIMES, SIZE_TIMES = 20, 50
MAX_PRICE = 1_999_999_900


def _chart(x: np.ndarray, scale0: float) -> np.ndarray:
    """Level just before each value: robust exponentially weighted mean (nan for the first value)."""
    n = len(x)
    out = np.full(n, np.nan)
    if n < 2:
        return out
    head = sorted(x[: min(n, 7)])
    level, scale = head[len(head) // 2], scale0
    off: list[float] = []  # the suspects since the last reading near the level
    for i, v in enumerate(x.tolist()):
        if i:
            out[i] = level
        r = v - level
        a = abs(r)
        if a > CLIP * scale:
            off.append(v)
            if len(off) == SHIFT:  # so many in a row are a shift of level, not spikes
                level, off = sorted(off)[SHIFT // 2], []
                continue
            r = CLIP * scale if r > 0 else -CLIP * scale
        else:
            off = []
        level += ALPHA * r
        scale = max(scale0, scale + ALPHA * (min(a, 2 * scale) - scale))
    return out


def _levels(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("pos", kind="stable")
    x = pdf["value"].to_numpy(float)
    steps = np.abs(np.diff(x))
    scale0 = max(1.0, float(np.median(steps)) / 2) if len(steps) else 1.0
    before, after = np.abs(x - _chart(x, scale0)), np.abs(x - _chart(x[::-1], scale0)[::-1])
    near = np.fmin(before, after)
    usual = np.where(np.isnan(before), after, before)
    core = pdf["core"].to_numpy(bool)
    return pd.DataFrame({"src": pdf["src"].to_numpy()[core], "id": pdf["id"].to_numpy()[core], "value": pdf["value"].to_numpy()[core], "near": near[core], "usual": usual[core]})


def _ordinal(rows: DataFrame, part: str, within: str) -> DataFrame:
    """Add ``pos`` (0, 1, .. inside a source) and ``n`` (its readings) to rows that have ``within``, their 1-based place
    inside (src, part); one row per (src, part) is all that is summed along a source."""
    size = rows.groupBy("src", part).agg(F.max(within).alias("_k"))
    w = Window.partitionBy("src")
    size = size.withColumn("_base", F.sum("_k").over(w.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))).withColumn("n", F.sum("_k").over(w))
    return rows.join(size.drop("_k"), ["src", part]).withColumn("pos", F.coalesce("_base", F.lit(0)) + F.col(within) - 1).drop("_base", within)


def _overlapping(rows: DataFrame, overlap: int) -> DataFrame:
    """Repeat the readings next to a chunk's ends in the neighbouring chunk, there with ``core`` false."""
    k, r = F.expr(f"pos div {CHUNK}"), F.col("pos") % CHUNK
    near = F.array(
        F.struct(k.alias("chunk"), F.lit(True).alias("core")),
        F.struct(F.when(r < overlap, k - 1).otherwise(F.when(r >= CHUNK - overlap, k + 1)).alias("chunk"), F.lit(False).alias("core")),
    )
    return rows.select("*", F.inline(near)).where(f"chunk IS NOT NULL AND chunk BETWEEN 0 AND (n - 1) div {CHUNK}")


def chart(readings: DataFrame, stuck: int) -> tuple[DataFrame, DataFrame]:
    """readings: src, block (coarse, monotone in the order), at (order), id, value, impossible.

    Returns (stuck readings: src, id) and (good readings of sources of at least MIN_READINGS: src, id, value, near, usual);
    near: distance from the nearer of the two levels.
    """
    w = Window.partitionBy("src", "block").orderBy("at", "id", "value")
    r = readings.where("src IS NOT NULL AND value IS NOT NULL").withColumn("_l", F.lag("id").over(w)).where("_l IS NULL OR _l <> id").drop("_l")
    r = _ordinal(r.withColumn("_i", F.row_number().over(w)), "block", "_i")
    c = Window.partitionBy("src", "chunk").orderBy("pos")
    r = _overlapping(r.drop("block", "at"), stuck - 1)
    r = r.withColumn("_new", F.when(F.lag("value").over(c) == F.col("value"), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(c))
    r = r.withColumn("stuck", F.count("*").over(Window.partitionBy("src", "chunk", "_run")) >= stuck).where("core")
    r = written(r.select("src", "id", "value", "impossible", "stuck", "n", "pos", "chunk"), "runs")
    good = r.where(f"n >= {MIN_READINGS} AND NOT stuck AND NOT impossible").drop("n").withColumn("_i", F.row_number().over(c))
    good = _overlapping(_ordinal(good.drop("pos", "impossible", "stuck"), "chunk", "_i").drop("chunk"), WARM)
    kind = dict(readings.dtypes)
    dev = good.select("src", "id", "value", "pos", "core", "chunk").groupBy("src", "chunk").applyInPandas(_levels, f"src {kind['src']}, id bigint, value bigint, near double, usual double")
    return r.where("stuck").select("src", "id"), written(dev, "levels")


def chart_findings(readings: DataFrame, stuck: int) -> DataFrame:
    """Ids that are impossible, stuck or a spike of the chart."""
    runs, dev = chart(readings, stuck)
    usual = dev.groupBy("src").agg(F.percentile_approx("usual", 0.5, 10000).alias("_usual"))
    spikes = dev.join(usual, "src").where(F.col("near") > SPIKE_TIMES * F.greatest("_usual", F.lit(1.0))).select("id")
    return readings.where("impossible").select("id").unionByName(runs.select("id")).unionByName(spikes)


def size_findings(readings: DataFrame) -> DataFrame:
    """Ids whose value is not above 0 or more than SIZE_TIMES the source's usual (median) size; one row per id needed."""
    size = readings.where("src IS NOT NULL").groupBy("src").agg(
        F.count("*").alias("_n"), F.percentile_approx(F.when(F.col("value") > 0, F.col("value")), 0.5, 10000).alias("_usual")
    )
    big = readings.join(size.where(f"_n >= {MIN_READINGS}"), "src").where(F.col("value") > SIZE_TIMES * F.col("_usual")).select("id")
    return readings.where("value <= 0").select("id").unionByName(big)


def feed_readings(messages: DataFrame, block: int = 1 << 16) -> DataFrame:
    """Prices and sizes of decoded adds, once per seq."""
    m = messages.where("decoded AND type IN ('A', 'F') AND seq IS NOT NULL")
    return m.select(day_locate().alias("src"), F.expr(f"seq div {block}").alias("block"), F.col("seq").alias("at"), F.col("seq").alias("id"), "price", "shares")


def implausible(messages: DataFrame, ci_history: DataFrame) -> DataFrame:
    """(src_table, field, rec_id) of every implausible price, size or p99."""
    feed = feed_readings(messages)
    price = feed.withColumn("value", F.col("price")).withColumn("impossible", F.expr(f"coalesce(value <= 0 OR value > {MAX_PRICE}, false)"))
    price = price.drop("price", "shares")
    shares = feed.where("shares IS NOT NULL").groupBy("src", "block", "id").agg(F.max("shares").alias("value"))
    ci = ci_history.where("run_id IS NOT NULL AND p99_ns IS NOT NULL AND timestamp_utc IS NOT NULL").select(
        F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in ("runner", "book_type", "message_type")]).alias("src"),
        F.expr("unix_micros(cast(timestamp_utc AS timestamp)) div 2592000000000").alias("block"),
        F.expr("unix_micros(cast(timestamp_utc AS timestamp))").alias("at"),
        F.col("run_id").alias("id"),
        F.col("p99_ns").alias("value"),
        F.expr("p99_ns <= 0 OR coalesce(p99_ns < p50_ns, false) OR coalesce(p99_ns > p999_ns, false)").alias("impossible"),
    )

    def out(df: DataFrame, table: str, field: str) -> DataFrame:
        return df.select(F.lit(table).alias("src_table"), F.lit(field).alias("field"), F.col("id").cast("bigint").alias("rec_id")).distinct()

    return (
        out(chart_findings(price, 12), "messages", "price")
        .unionByName(out(size_findings(shares), "messages", "shares"))
        .unionByName(out(chart_findings(ci, 6), "ci_history", "p99_ns"))
    )
