"""Running aggregates, as-of joins and rank percentiles that do not put a whole key into one task.

A key's rows are cut into blocks of its order; inside a block a window runs, and one row per block carries the rest.
Nulls: a null value counts neither for a sum nor a maximum; rows with a null order are sorted first in block null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_AGG = {"sum": F.sum, "max": F.max, "count": F.count}


def once(df: DataFrame, key: str) -> DataFrame:
    """One row per key: the least in the order of its columns, so rows that disagree give the same result in every run."""
    rest = [c for c in df.columns if c != key]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*rest)).alias("_r")).select(key, "_r.*").select(*df.columns)


def running(df: DataFrame, keys: list[str], block: Column, order: list[str], what: dict[str, tuple[str, str]]) -> DataFrame:
    """Add, for each out: (kind, column), the aggregate over the rows before (``out_before``) and up to (``out``) each row
    of its key. ``order`` must be a total order, ``block`` monotone in it."""
    df = df.withColumn("_block", block)
    w = Window.partitionBy(*keys, "_block").orderBy(*order)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = df.groupBy(*keys, "_block").agg(*[_AGG[k](c).alias(f"_t_{o}") for o, (k, c) in what.items()])
    merge = {o: ("sum" if k == "count" else k) for o, (k, _) in what.items()}
    blocks = blocks.select(*keys, "_block", *[_AGG[merge[o]](f"_t_{o}").over(along).alias(f"_c_{o}") for o in what])
    for o, (k, c) in what.items():
        df = df.withColumn(o, _AGG[k](c).over(upto)).withColumn(f"{o}_before", _AGG[k](c).over(before))
    cond = [df[k].eqNullSafe(blocks[k]) for k in [*keys, "_block"]]
    out = df.join(blocks, cond).select(*[df[c] for c in df.columns], *[blocks[f"_c_{o}"] for o in what])
    for o in what:
        for c in (o, f"{o}_before"):
            if merge[o] == "sum":
                out = out.withColumn(c, F.coalesce(f"_c_{o}", F.lit(0)) + F.coalesce(c, F.lit(0)))
            else:
                out = out.withColumn(c, F.greatest(c, f"_c_{o}"))
    return out.drop("_block", *[f"_c_{o}" for o in what])


def as_of(left: DataFrame, right: DataFrame, keys: list[str], order: str, values: list[str], tie: str, width: int, forward: bool = False) -> DataFrame:
    """Add to each left row the ``values`` of the last right row of its key with ``order`` not after it (``forward``: of
    the first not before it); null if there is none. ``tie`` orders right rows of equal ``order``; blocks are ``width`` wide.
    Rows without ``order`` find nothing."""
    pick = F.struct(*[F.col(c) for c in values])
    names = [c for c in left.columns if c not in (*keys, order)]
    lhs = left.select(*keys, order, F.lit(1 if not forward else -1).alias("_k"), F.lit(None).cast("bigint").alias("_tie"), F.struct(*names).alias("_l"), F.lit(None).alias("_v"))
    rhs = right.where(F.col(order).isNotNull()).select(*keys, order, F.lit(0).alias("_k"), F.col(tie).cast("bigint").alias("_tie"), F.lit(None).alias("_l"), pick.alias("_v"))
    both = lhs.unionByName(rhs).withColumn("_block", F.expr(f"{order} div {width}"))
    w = Window.partitionBy(*keys, "_block").orderBy(order, "_k", "_tie")
    along = Window.partitionBy(*keys).orderBy("_block")
    near = (
        F.first("_v", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
        if forward
        else F.last("_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    at = F.struct(F.col(order), F.coalesce("_tie", F.lit(0)))
    ends = both.groupBy(*keys, "_block").agg((F.min_by if forward else F.max_by)("_v", F.when(F.col("_v").isNotNull(), at)).alias("_e"))
    far = (
        F.first("_e", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing))
        if forward
        else F.last("_e", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    )
    ends = ends.select(*[F.col(k).alias(f"_e_{k}") for k in keys], F.col("_block").alias("_e_block"), far.alias("_far"))
    rows = both.withColumn("_near", near).where("_l IS NOT NULL")
    cond = F.col("_block").eqNullSafe(F.col("_e_block"))
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_e_{k}"))
    j = rows.join(ends, cond, "left").withColumn("_got", F.when(F.col(order).isNotNull(), F.coalesce("_near", "_far")))
    return j.select(*keys, order, "_l.*", *[F.col("_got")[c].alias(c) for c in values])


def rank_percentiles(df: DataFrame, keys: list[str], value: str, ps: dict[str, float]) -> DataFrame:
    """Per key, the value of lower rank floor(p * (n - 1)): equal values are counted first, so a hot key costs one row per
    distinct value."""
    c = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys)
    c = c.withColumn("_cum", F.sum("_n").over(w.orderBy(value))).withColumn("_all", F.sum("_n").over(w))
    return c.groupBy(*keys).agg(F.max("_all").alias("n"), *[F.min(F.when(F.col("_cum") > F.floor(F.lit(p) * (F.col("_all") - 1)), F.col(value))).alias(o) for o, p in ps.items()])
