"""Per-entity features from events, and per-key results without the imbalance of hot keys.

Both start from the same compact form: repeated frames are removed by grouping on (day, locate, type, seq), whose rows
are spread evenly however many a locate has, and everything after works on one row per (day, locate, type).

Defined results: rows without a seq are no events; a null trade_day or locate is an entity of its own; a type that is
neither a single byte nor ``0x..`` is counted under ``other``; null ts and shares count neither for the last ts nor for
the total; an empty input gives no rows; columns not named are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Every value a type byte can take: the pivot's list is explicit, so the schema does not depend on the data.
TYPE_CODES = [f"{b:02x}" for b in range(256)] + ["other"]
TYPE_CODE_SQL = (
    "CASE WHEN length(type) = 1 AND ascii(type) < 128 THEN lower(hex(type)) "
    "WHEN length(type) = 4 AND substring(type, 1, 2) = '0x' AND lower(substring(type, 3, 2)) RLIKE '^[0-9a-f]{2}$' THEN lower(substring(type, 3, 2)) ELSE 'other' END"
)


def compact_types(messages: DataFrame) -> DataFrame:
    """Long table: (trade_day, locate, code) with the number of distinct seq, last ts and total shares."""
    once = (
        messages.where("seq IS NOT NULL")
        .groupBy("trade_day", "locate", F.expr(TYPE_CODE_SQL).alias("code"), "seq")
        .agg(F.max("ts").alias("ts"), F.max("shares").alias("shares"))
    )
    return once.groupBy("trade_day", "locate", "code").agg(
        F.count("*").alias("n"), F.max("ts").alias("last_ts"), F.sum("shares").alias("shares")
    )


def entity_features(messages: DataFrame, codes: list[str] | None = None) -> DataFrame:
    """One wide row per (trade_day, locate): for each type byte code c ``t{c}_n``, ``t{c}_last_ts``, ``t{c}_shares`` and
    ``t{c}_recency`` (ns from the type's last event to the entity's last event of the day).

    Column names carry the byte's hex code, because type bytes that differ in case only would clash.
    """
    codes = codes or TYPE_CODES
    wide = compact_types(messages).groupBy("trade_day", "locate").pivot("code", codes).agg(
        F.max("n").alias("n"), F.max("last_ts").alias("last_ts"), F.max("shares").alias("shares")
    )
    last = F.greatest(*[F.col(f"{c}_last_ts") for c in codes]) if len(codes) > 1 else F.col(f"{codes[0]}_last_ts")
    wide = wide.withColumn("_last", last)
    cols = []
    for c in codes:
        cols += [
            F.coalesce(F.col(f"{c}_n"), F.lit(0)).alias(f"t{c}_n"),
            F.col(f"{c}_last_ts").alias(f"t{c}_last_ts"),
            F.coalesce(F.col(f"{c}_shares"), F.lit(0)).alias(f"t{c}_shares"),
            (F.col("_last") - F.col(f"{c}_last_ts")).alias(f"t{c}_recency"),
        ]
    return wide.select("trade_day", "locate", *cols)


def eager_join(left: DataFrame, right: DataFrame, on: list[str], left_sums: list[str], right_sums: list[str]) -> DataFrame:
    """Sums over the join of two states that are already grouped by ``on``, without joining their rows.

    ``left``/``right`` carry ``on``, ``n`` (rows behind the state) and their sums. Result per key (all keys of both):
    the left state (``n`` 0 and null sums if only the right has the key), ``right_n`` and the right sums, ``pairs`` = n * right_n, and for each sum x ``pairs_x``: its sum over
    all joined pairs (a left sum times the right count, a right sum times the left count).
    A null key joins nothing, but its states are kept.
    """
    r = right.select(*on, F.col("n").alias("right_n"), *right_sums)
    j = left.join(r, on, "full")
    big = "decimal(38,0)"
    n, rn = F.coalesce("n", F.lit(0)).cast(big), F.coalesce("right_n", F.lit(0)).cast(big)
    return j.withColumns(
        {"n": F.coalesce("n", F.lit(0)), "right_n": F.coalesce("right_n", F.lit(0)), "pairs": n * rn}
        | {f"pairs_{c}": F.coalesce(F.col(c), F.lit(0)).cast(big) * rn for c in left_sums}
        | {f"pairs_{c}": F.coalesce(F.col(c), F.lit(0)).cast(big) * n for c in right_sums}
    )


def locate_totals(messages: DataFrame, executions: DataFrame) -> DataFrame:
    """Per locate: messages by type, executed shares, last ts, and what the trade tape adds over (trade_day, locate).

    ``pairs``/``pairs_tape_shares``: rows and tape shares of the join of messages and tape on (trade_day, locate); null
    if beyond BIGINT. Tape records of a day or locate without messages count too. Repeated frames (seq) and repeated tape rows (exec_id) count once.
    """
    names = {f"{ord(t):02x}": t for t in "AFECXDU"}
    c = compact_types(messages)
    per = [F.sum(F.when(F.col("code") == k, F.col("n")).otherwise(0)).alias(f"n_{t}") for k, t in names.items()]
    day = c.groupBy("trade_day", "locate").agg(
        F.sum("n").alias("n"), *per, F.max("last_ts").alias("last_ts"),
        F.sum(F.when(F.col("code").isin("45", "43"), F.col("shares")).otherwise(0)).alias("executed_shares"),
    )
    tape = (
        executions.where("exec_id IS NOT NULL").groupBy("trade_day", "locate", "exec_id").agg(F.max("shares").alias("shares"))
        .groupBy("trade_day", "locate").agg(F.count("*").alias("n"), F.sum("shares").alias("tape_shares"))
    )
    j = eager_join(day, tape, ["trade_day", "locate"], [], ["tape_shares"])
    big = [F.sum(x).alias(x) for x in ("pairs", "pairs_tape_shares")]
    out = j.groupBy("locate").agg(
        F.sum("n").alias("n_messages"), *[F.coalesce(F.sum(f"n_{t}"), F.lit(0)).alias(f"n_{t}") for t in names.values()], F.coalesce(F.sum("executed_shares"), F.lit(0)).alias("executed_shares"),
        F.max("last_ts").alias("last_ts"), F.sum("right_n").alias("tape_records"), F.coalesce(F.sum("tape_shares"), F.lit(0)).alias("tape_shares"), *big,
    )
    return out.withColumns({x: F.expr(f"try_cast({x} AS bigint)") for x in ("pairs", "pairs_tape_shares")})
