"""Applying a change feed: newest-first resolution.

Batches of changes are processed backwards. For each key the first image or tombstone met on the way back decides;
once it is recorded, all older changes of that key are removed by an anti-join before they are grouped. Changes that
only adjust a row (deltas) are summed until their image is met. Base rows of keys that no change touched are appended
at the end.

Input batches: ``keys``, ``ord`` BIGINT (the order of effect, not of arrival), ``op`` ('I' image: insert or full
update; 'T' tombstone: delete; 'D' delta), ``delta`` BIGINT, and payload columns (non-null for images only).

Defined results: repeats of one (key, ord) count once (a tombstone before an image before a delta); rows with a null
``ord`` or ``op`` have no place in the feed and are ignored; a null key is a key like any other; null deltas count as
changes of size 0; extra columns are not read. Rows may arrive in any order, but every batch must hold all rows of
its range of ``ord``. Empty batches and an empty base are allowed.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bookweave.session import buckets, write_bucketed


def newest_first(batches: Iterable[DataFrame], keys: list[str], payload: list[str], base: DataFrame | None = None, bucketed: bool = False) -> DataFrame:
    """Final rows: keys, payload, ``ord`` of the deciding image (null: from the base), ``delta_sum``, ``delta_n`` after it.

    ``bucketed``: the batches are read from tables hash-bucketed by ``keys``; nothing is shuffled then, as the record
    of resolved keys is bucketed alike. Otherwise each batch is shuffled once, after the anti-join's keys are known.
    """
    done: str | None = None
    w = Window.partitionBy(*keys)
    back = w.orderBy(F.col("ord").desc(), F.col("op").desc())
    for step, batch in enumerate(batches):
        spark = batch.sparkSession
        rows = batch.select(*keys, "ord", "op", F.coalesce("delta", F.lit(0)).cast("bigint").alias("delta"), *payload).where("ord IS NOT NULL AND op IS NOT NULL")
        if not bucketed:
            rows = rows.repartition(buckets(spark), *keys)
        if done:
            resolved = spark.table(done).where("op IS NOT NULL").select(*[F.col(k).alias(f"_r_{k}") for k in keys])
            same = None
            for k in keys:
                c = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
                same = c if same is None else same & c
            rows = rows.join(resolved, same, "left_anti")
        rows = (
            rows.withColumn("_newer", F.lag("ord").over(back))
            .where("_newer IS NULL OR _newer <> ord")
            .withColumn("_anchor", F.max(F.when(F.col("op") != "D", F.col("ord"))).over(w))
            .where("_anchor IS NULL OR ord >= _anchor")
        )
        anchor, delta = F.col("op") != "D", F.when(F.col("op") == "D", F.col("delta"))
        part = rows.groupBy(*keys).agg(
            F.max("_anchor").alias("ord"),
            F.max(F.when(anchor, F.col("op"))).alias("op"),
            F.sum(delta.cast("decimal(38,0)")).alias("delta_sum"),
            F.count(delta).alias("delta_n"),
            *[F.max(F.when(anchor, F.col(c))).alias(c) for c in payload],
        )
        done = write_bucketed(part.withColumn("step", F.lit(step)), keys, "resolved", ["step"], table=done)
    if done is None:
        raise ValueError("no batches")
    spark = batch.sparkSession
    last = spark.table(done).groupBy(*keys).agg(
        F.max("ord").alias("ord"),
        F.max("op").alias("op"),
        F.coalesce(F.sum("delta_sum"), F.lit(0)).cast("decimal(38,0)").alias("delta_sum"),
        F.sum("delta_n").alias("delta_n"),
        *[F.max(c).alias(c) for c in payload],
    )
    if base is None:
        return last.where("op = 'I'").select(*keys, *payload, "ord", "delta_sum", "delta_n")
    b = base.select(*[F.col(k).alias(f"_b_{k}") for k in keys], *[F.col(c).alias(f"_b_{c}") for c in payload], F.lit(True).alias("_base"))
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_b_{k}"))
        cond = c if cond is None else cond & c
    out = last.withColumn("_seen", F.lit(True)).join(b, cond, "full_outer")
    from_base = F.col("op").isNull()  # untouched, or touched by deltas only
    return out.where("op = 'I' OR (op IS NULL AND _base)").select(
        *[F.when(F.col("_seen").isNull(), F.col(f"_b_{k}")).otherwise(F.col(k)).alias(k) for k in keys],
        *[F.when(from_base, F.col(f"_b_{c}")).otherwise(F.col(c)).alias(c) for c in payload],
        "ord",
        F.coalesce("delta_sum", F.lit(0)).cast("decimal(38,0)").alias("delta_sum"),
        F.coalesce("delta_n", F.lit(0)).alias("delta_n"),
    )


def open_orders(messages: DataFrame, batches: int = 3) -> DataFrame:
    """Orders open when the last message of each trade day has taken effect (trade_day, locate, ref, side, shares, price).

    The feed of a day is cut into ``batches`` ranges of seq, resolved newest first: an add or the new half of a replace
    is an image, a delete or the old half a tombstone, E/C/X a delta. Refs count from the start every day, so there
    is no base. Which replaces took effect, and the side they inherit, comes from the settled feed; images of void
    replaces are dropped, and refs born more than once enter with the changes that took effect only.
    """
    from bookweave.operators import lifecycle as lc

    feed = lc.settled_feed(messages, batches)

    def changes(b: int) -> DataFrame:
        s = feed.events().where((F.col("batch") == b) & (F.col("grp") != lc.MULTI))
        birth, reduce = F.col("kind") <= lc.BORN, F.col("kind") == lc.REDUCE
        effective = (F.col("grp") != lc.FOLDED) | F.when(birth, ~F.col("open") & F.col("valid")).otherwise(F.col("open"))
        op = F.when(birth, "I").when(reduce, "D").otherwise("T")
        keep = F.when(birth, True)
        return s.where(effective).select(
            "dl", "ref", F.col("sk").alias("ord"), op.alias("op"), F.when(reduce, F.col("qty")).alias("delta"),
            F.when(keep, F.col("qty")).alias("qty"), "price", "side",
        )

    last = newest_first((changes(b) for b in reversed(range(batches))), ["dl", "ref"], ["qty", "price", "side"], bucketed=True)
    left = F.when(F.col("qty") > 0, F.col("delta_sum") < F.col("qty")).otherwise(F.col("delta_n") == 0)
    live = last.where(left).withColumn("seq", F.expr("ord div 2")).withColumn("born", F.expr("ord % 2 = 1"))
    live = live.select("dl", "ref", "seq", "born", "side", (F.col("qty") - F.col("delta_sum")).cast("bigint").alias("shares"), "price")
    own = live.where("NOT born").select("dl", "ref", "side", "shares", "price")
    # the inner join drops images of void replaces: they have no side
    heir = live.where("born").drop("side").join(lc.replace_sides(feed), ["dl", "seq"]).select("dl", "ref", "side", "shares", "price")
    side = F.when(F.col("side"), "B").otherwise("S")
    return own.unionByName(heir).select(*lc.split_day_locate(), "ref", side.alias("side"), "shares", "price")
