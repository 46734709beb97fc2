"""Order lifecycle: which mutation met an open order, exactly, without a per-symbol sequential replay.

The feed of one trade day and locate is an ordered program over order refs. Two facts make it parallel:

* what a mutation does depends only on the earlier events of *its own ref*, so the work is partitioned by
  (trade day, locate, ref) and a symbol that holds a third of all rows is spread over all tasks;
* refs influence each other only through replaces: the new ref is born only if the old one was open. That is a
  foreign-key graph, settled by a fixpoint over the (small) table of replaces.

``build_store`` does the one wide shuffle: it removes repeated frames, splits a replace into the removal of the old
ref and the birth of the new one, evaluates refs with a single birth in closed form with window functions, and writes
everything hash-bucketed by ref, so every later join on the ref is local. ``settle`` runs the fixpoint (pointer doubling along chains). Refs with
several births (re-use, repeated adds, ``next == orig``) need the true ordered fold; they go through a streaming
fold over sorted rows whose memory does not grow with the group.

Defined results for dirty input
* a decoded row without trade_day, locate or ref cannot belong to a book: a mutation is an orphan, an add opens nothing;
  a row without seq has no place in the order and is ignored;
* null shares count as 0; a null or odd side byte is S; null ``decoded`` is undecoded;
* repeated rows of one seq count once; if they disagreed, the smallest payload in column order would win;
* other columns of the input, whatever their names, are not read; an empty input gives empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from bookweave.session import buckets, scratch_path, write_bucketed, written

ADD, BORN, REDUCE, DELETE, KILL = 0, 1, 2, 3, 4  # kinds of events; BORN and KILL are the two halves of a replace
BOOK_TYPES = ("A", "F", "E", "C", "X", "D", "U")
SINGLE, REPLACED, MULTI, FOLDED = 0, 1, 2, 3  # groups of refs in the store
EVENT = ["dl", "ref", "sk", "kind", "qty", "price", "side", "other"]
EXTRA = ["type", "paid", "match"]  # of a full store: the message's own type, price and match number
_L = 4294967296


def day_locate(day: str = "trade_day", locate: str = "locate"):
    """Trade day and locate in one BIGINT, null if either is null."""
    return F.col(day).cast("bigint") * F.lit(_L) + F.pmod(F.col(locate).cast("bigint"), F.lit(_L))


def split_day_locate(dl: str = "dl") -> list:
    return [F.expr(f"cast({dl} div {_L} as int)").alias("trade_day"), F.expr(f"cast({dl} % {_L} as int)").alias("locate")]


def book_messages(messages: DataFrame) -> DataFrame:
    """Decoded rows of the seven types that act on a book, with a place in the order."""
    return messages.where(F.col("decoded") & F.col("type").isin(*BOOK_TYPES) & F.col("seq").isNotNull())


def order_events(messages: DataFrame, full: bool = False) -> DataFrame:
    """One row per effect on one ref; ``sk`` orders them (twice the seq, plus one for the birth half of a replace)."""
    m = book_messages(messages).where("trade_day IS NOT NULL AND locate IS NOT NULL AND ref IS NOT NULL")
    q = "coalesce(shares, 0L)"

    more = ", 'type', type, 'paid', price, 'match', match" if full else ""

    def half(ref: str, add: int, kind: str, qty: str, price: str, side: str, other: str) -> str:
        return (
            f"named_struct('ref', {ref}, 'sk', seq * 2L + {add}L, 'kind', cast({kind} as tinyint), 'qty', {qty}, "
            f"'price', {price}, 'side', {side}, 'other', {other}{more})"
        )

    none = "cast(null as bigint)"
    plain = half(
        "ref", 0,
        f"CASE WHEN type IN ('A', 'F') THEN {ADD} WHEN type = 'D' THEN {DELETE} WHEN type = 'U' THEN {KILL} ELSE {REDUCE} END",
        f"CASE WHEN type IN ('D', 'U') THEN {none} ELSE {q} END",
        f"CASE WHEN type IN ('A', 'F') THEN price ELSE {none} END",
        "CASE WHEN type IN ('A', 'F') THEN coalesce(side = 'B', false) END",
        f"CASE WHEN type = 'U' THEN new_ref ELSE {none} END",
    )
    born = half("new_ref", 1, str(BORN), q, "price", "cast(null as boolean)", "ref")
    return m.select(
        day_locate().alias("dl"),
        F.expr(f"inline(CASE WHEN type = 'U' AND new_ref IS NOT NULL THEN array({plain}, {born}) ELSE array({plain}) END)"),
    )


def _closed_form(events: DataFrame) -> DataFrame:
    """Drop repeats; add ``grp`` and, for refs with at most one birth, whether the ref was open just before each event.

    ``left``: shares that rested before a mutation; ``born``: the birth of the order it acts on; ``price`` and ``pside`` of a mutation
    are that order's price and side (null: inherited through a replace). For the removal half of a replace: ``psk`` = birth of the order it replaces.
    All windows share one sort by (dl, ref, sk).
    """
    key = Window.partitionBy("dl", "ref")
    order = key.orderBy("sk", "kind", "qty", "price", "side", "other")
    prev = order.rowsBetween(Window.unboundedPreceding, -1)
    birth = F.col("kind") <= BORN
    e = (
        events.withColumn("_last", F.lag("sk").over(order))
        .where(F.col("_last").isNull() | (F.col("_last") != F.col("sk")))
        .drop("_last")
    )
    e = (
        e.withColumn("_births", F.count(F.when(birth, 1)).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("_born", F.count(F.when(F.col("kind") == BORN, 1)).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("_psk", F.max(F.when(birth, F.col("sk"))).over(prev))
        .withColumn("_pqty", F.max(F.when(birth, F.col("qty"))).over(prev))
        .withColumn("_pprice", F.max(F.when(birth, F.col("price"))).over(prev))
        .withColumn("_pside", F.max(F.when(birth, F.col("side"))).over(prev))
    )
    e = (
        e.withColumn("_eff", F.when((F.col("kind") == REDUCE) & F.col("_psk").isNotNull(), F.col("qty")))
        .withColumn("_gone", F.max(F.when((F.col("kind") >= DELETE) & F.col("_psk").isNotNull(), True)).over(prev))
        .withColumn("_sum", F.sum(F.col("_eff").cast("decimal(38,0)")).over(prev))
        .withColumn("_n", F.count("_eff").over(prev))
    )
    is_open = (
        F.col("_psk").isNotNull()
        & F.col("_gone").isNull()
        & F.when(F.col("_pqty") > 0, F.coalesce("_sum", F.lit(0)) < F.col("_pqty")).otherwise(F.col("_n") == 0)
    )
    grp = F.when(F.col("_births") > 1, MULTI).when(F.col("_born") > 0, REPLACED).otherwise(SINGLE)
    kill, one = F.col("kind") == KILL, F.col("_births") <= 1
    cols = [c for c in (*EVENT, *EXTRA) if c in events.columns]
    own = [F.when(one & ~birth, F.col("_pprice")).otherwise(F.col("price")).alias(c) if c == "price" else F.col(c) for c in cols]
    return e.select(
        *own,
        F.when(one, is_open).alias("open"),
        F.when(one & is_open & ~birth, (F.col("_pqty") - F.coalesce("_sum", F.lit(0))).cast("bigint")).alias("left"),
        F.when(one & ~birth, F.col("_psk")).alias("born"),
        F.when(kill, F.col("_psk")).alias("psk"),
        F.when(one & ~birth, F.col("_pside")).alias("pside"),
        F.lit(True).alias("valid"),
        grp.cast("int").alias("grp"),
    )


def fold(rows: DataFrame) -> DataFrame:
    """The ordered fold over refs with several births; input has EVENT columns and ``valid`` (of BORN rows).

    Gives ``open`` (was the ref open just before the event) and the other columns of the closed form. Rows are sorted inside
    hash partitions and folded as a stream: one ref's state is a few numbers, whatever the length of its history.
    """
    out = ", ".join(["dl bigint", "ref bigint", "sk bigint", "kind tinyint", "qty bigint", "price bigint", "side boolean", "other bigint", "open boolean", "left bigint", "born bigint", "psk bigint", "pside boolean", "valid boolean"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, left, since, side, cost = None, -1, None, None, None  # left: shares of the open order, -1 if none
        for b in batches:
            was, psk, pside, rest, born, paid = [], [], [], [], [], []
            for dl, ref, sk, kind, qty, price, s, valid in zip(b.dl, b.ref, b.sk, b.kind, b.qty, b.price, b.side, b.valid):
                if (dl, ref) != at:
                    at, left, since, side, cost = (dl, ref), -1, None, None, None
                is_open = left >= 0
                was.append(is_open)
                act = kind > BORN and is_open
                rest.append(left if act else None)
                born.append(since if act else None)
                paid.append(cost if act else None if pd.isna(price) else int(price))
                kill = kind == KILL and is_open
                psk.append(since if kill else None)
                pside.append(side if act else None)
                if kind <= BORN:
                    if not is_open and valid:
                        left, since, side, cost = int(qty), sk, (None if kind == BORN else bool(s)), (None if pd.isna(price) else int(price))
                elif is_open:
                    if kind == REDUCE and qty < left:
                        left -= int(qty)
                    else:
                        left = -1
            ints = {"left": rest, "born": born, "psk": psk, "price": paid}
            yield b.assign(open=was, pside=pd.array(pside, dtype="boolean"), **{k: pd.array(v, dtype="Int64") for k, v in ints.items()})

    kinds = dict(rows.dtypes)
    more = [c for c in (*EXTRA, "batch") if c in kinds]
    cols, out = [*EVENT, "valid", *more], out + "".join(f", {c} {kinds[c]}" for c in more)
    # by a hash of the key, not the key: a repartition equal to the store's buckets would be planned away, and with
    # no join above it the bucketed scan too
    parts = rows.select(*cols).repartition(buckets(rows.sparkSession), F.xxhash64("dl", "ref"))
    return parts.sortWithinPartitions("dl", "ref", "sk").mapInPandas(run, out)


@dataclass
class Feed:
    """A settled feed. ``name``: the bucketed table of events (``grp`` MULTI holds the raw rows of folded refs,
    FOLDED their settled rows); ``tops``: every replace of a ref with one birth (dl, seq, new_ref, bad, ext, side), see
    ``_tops``; ``void``: replaces that found no open order at their turn (dl, seq, new_ref); ``void_refs``: their new refs."""

    spark: SparkSession
    name: str
    tops: DataFrame
    void: DataFrame
    void_refs: DataFrame
    many: bool
    rounds: int

    def events(self) -> DataFrame:
        return self.spark.table(self.name)


def build_store(messages: DataFrame, batches: int = 1, full: bool = False) -> str:
    """One shuffle: events hash-partitioned by ref, evaluated in closed form, written bucketed by ref.

    ``batches``: number of change batches of equal seq range per trade day that the store is cut into; ``full``: keep EXTRA.
    """
    spark = messages.sparkSession
    events = order_events(messages, full).repartition(buckets(spark), "dl", "ref")
    rows = _closed_form(events)
    part = ["grp"]
    if batches > 1:
        day = messages.where("decoded AND seq IS NOT NULL AND trade_day IS NOT NULL").groupBy(F.col("trade_day").cast("bigint").alias("_day"))
        # one row per trade day is all that every task gets
        span = F.broadcast(day.agg(F.min("seq").alias("_lo"), F.max("seq").alias("_hi")))
        at = F.expr(f"cast((cast(sk div 2 as double) - _lo) * {batches} / (_hi - _lo + 1) as int)")
        rows = rows.withColumn("_day", F.expr(f"dl div {_L}")).join(span, "_day").withColumn("batch", at).drop("_day", "_lo", "_hi")
        part = ["batch", "grp"]
    return write_bucketed(rows, ["dl", "ref"], "events", part)


def _climb(cur: DataFrame, what: str) -> tuple[DataFrame, int]:
    """Pointer doubling. cur: dl, seq, up (the replace that bore the order this one replaces, null at the top), bad, ext, side, and
    other columns. Each row takes over what is above it until no row points up: ``bad`` if any replace of its chain is,
    ``side`` of the order the chain began with, or ``ext``, the replace outside of cur that its chain begins with.

    A job doubles twice, so a chain of n links takes log4(n) of them; only rows that still point up are joined.
    """
    keep = [c for c in cur.columns if c not in ("up", "bad", "ext", "side")]

    def double(c: DataFrame) -> DataFrame:
        par = c.select("dl", F.col("seq").alias("up"), F.col("up").alias("_up"), F.col("bad").alias("_bad"), F.col("ext").alias("_ext"), F.col("side").alias("_side"), F.lit(True).alias("_in"))
        j = c.where("up IS NOT NULL").join(par, ["dl", "up"], "left")
        return c.where("up IS NULL").unionByName(
            j.select(*keep, F.when(~F.col("_bad"), F.col("_up")).alias("up"), F.coalesce("_bad", F.lit(False)).alias("bad"), F.when(F.col("_in"), F.col("_ext")).otherwise(F.col("up")).alias("ext"), F.col("_side").alias("side"))
        )

    jobs = 0
    while True:
        seen = Observation()
        cur = written((double(double(cur)) if jobs else cur).observe(seen, F.count("up").alias("n")), what)
        if not seen.get["n"]:
            return cur, jobs
        jobs += 1


def _tops(single: DataFrame) -> tuple[DataFrame, int]:
    """What becomes of the replaces of refs with one birth, as far as it does not depend on other refs: ``bad`` if some
    replace of the chain above found no order in any case; ``ext``: the replace of a ref with several births that the chain
    begins with, on which the rest depends; ``side`` of the order it began with otherwise."""
    start = single.select(
        "dl", "seq", "new_ref", F.when(F.col("open") & (F.col("psk") % 2 == 1), F.expr("psk div 2")).alias("up"), (~F.col("open")).alias("bad"),
        F.lit(None).cast("bigint").alias("ext"), F.when(F.col("psk") % 2 == 0, F.coalesce("pside", F.lit(False))).alias("side"),
    )
    return _climb(start, "tops")


def settle(spark: SparkSession, name: str, max_rounds: int = 1000) -> Feed:
    """Fixpoint over the foreign keys between refs: a replace whose old ref is not open gives birth to nothing, which
    orphans the events of the new ref and with them further replaces.

    The chains of replaces through refs with one birth do not depend on anything else: they are climbed once by pointer
    doubling, in log4(longest chain) jobs. What remains is a fixpoint over the refs with several births: each round folds
    them again with the void replaces of the round before, found by a semi-join on the tops of the chains; it ends when the void
    replaces of these refs stay the same. A chain that passes through k such refs takes k + 1 rounds at most. Starting from
    "every replace worked" any fixpoint is the sequential result, because a replace depends on earlier ones only.
    """
    store = spark.table(name)
    extra = [c for c in (*EXTRA, "batch") if c in store.columns]
    tops, rounds = _tops(store.where(f"grp <> {MULTI} AND kind = {KILL}").select("dl", F.expr("sk div 2").alias("seq"), "psk", "pside", "open", F.col("other").alias("new_ref")))
    multi = store.where(f"grp = {MULTI}").select(*EVENT, *extra)
    many = len(multi.take(1)) > 0
    void = tops.where("bad").select("dl", "seq", "new_ref")
    # what a set of replaces is recognised by: their number and two sums over hashes, taken while it is written
    lost = F.col("kind").eqNullSafe(KILL) & ~F.col("open")
    mark = [F.count_if(lost).alias("n"), F.sum(F.when(lost, F.xxhash64("dl", "sk").cast("decimal(38,0)"))).alias("s"), F.bit_xor(F.when(lost, F.xxhash64("sk", "dl"))).alias("x")]
    if many:
        bad, last = void, None
        while True:
            if rounds > max_rounds:
                raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
            rounds += 1
            seen = Observation()
            gone = bad.select("dl", (F.col("seq") * 2 + 1).alias("sk"), F.lit(True).alias("_bad"))
            rows = multi.join(gone, ["dl", "sk"], "left").withColumn("valid", F.col("_bad").isNull() | (F.col("kind") != BORN)).drop("_bad")
            folded = written(fold(rows).observe(seen, *mark), "folded")
            got = seen.get
            if got == last:
                break
            last = got
            other = folded.where(f"kind = {KILL} AND NOT open").select("dl", F.expr("sk div 2").alias("seq"), F.col("other").alias("new_ref"))
            under = tops.join(other.select("dl", F.col("seq").alias("ext")), ["dl", "ext"], "left_semi").select("dl", "seq", "new_ref")
            bad = void.unionByName(under).unionByName(other)
        void = written(bad, "void")
        out = folded.withColumn("grp", F.lit(FOLDED)).select(*store.columns)
        write_bucketed(out.repartition(buckets(spark), "dl", "ref"), ["dl", "ref"], "events", ["batch", "grp"] if "batch" in extra else ["grp"], table=name)
    refs = written(void.select("dl", F.col("new_ref").alias("ref")).where("ref IS NOT NULL").distinct(), "voidrefs")
    return Feed(spark, name, tops, void, refs, many, rounds)


def settled_feed(messages: DataFrame, batches: int = 1, full: bool = False) -> Feed:
    return settle(messages.sparkSession, build_store(messages, batches, full))


def void_births(feed: Feed) -> DataFrame:
    """Refs whose single birth was a replace that found nothing: (dl, ref)."""
    return feed.void_refs


def orphan_mutations(feed: Feed) -> DataFrame:
    """(dl, seq, ref, kind, direct) of every mutation that met no open order.

    ``direct``: there would be no order even if every earlier replace had worked; otherwise the order is missing only
    because a replace further up was itself an orphan (inherited). For refs with several births: inherited if one of
    the ref's own births before the mutation was such a replace.
    """
    s = feed.events().where(f"kind >= {REDUCE}")
    out = ["dl", F.expr("sk div 2").alias("seq"), "ref", "kind"]
    direct = s.where(f"grp IN ({SINGLE}, {REPLACED}) AND NOT open").select(*out, F.lit(True).alias("direct"))
    inherited = s.where(f"grp = {REPLACED} AND open").join(void_births(feed), ["dl", "ref"], "left_semi").select(*out, F.lit(False).alias("direct"))
    raw = s.where(f"grp = {FOLDED} AND NOT open").select(*out)
    # a folded ref's orphan is inherited if one of its own births was void before it
    cause = s.sparkSession.table(feed.name).where(f"grp = {FOLDED} AND kind = {BORN} AND NOT valid").groupBy("dl", "ref").agg(F.min(F.expr("sk div 2")).alias("_void"))
    folded = raw.join(cause, ["dl", "ref"], "left").withColumn("direct", F.col("_void").isNull() | (F.col("_void") > F.col("seq"))).drop("_void")
    return direct.unionByName(inherited).unionByName(folded)


def known_orders(feed: Feed) -> DataFrame:
    """(dl, ref) of every ref that named an open order at some time, still bucketed by ref."""
    s = feed.events().where(f"kind <= {BORN}")
    plain = s.where(f"(grp = {SINGLE}) OR (grp = {FOLDED} AND valid) OR grp = {REPLACED}").select("dl", "ref", "grp")
    gone = void_births(feed).withColumn("_v", F.lit(True))
    return plain.join(gone, ["dl", "ref"], "left").where(f"NOT (grp = {REPLACED} AND _v IS NOT NULL)").select("dl", "ref")


def replace_sides(feed: Feed) -> DataFrame:
    """(dl, seq, side) of every replace that worked: the side of the order its chain began with."""
    plain = feed.tops.where("NOT bad")
    if not feed.many:
        return plain.select("dl", "seq", "side")
    m = feed.events().where(f"grp = {FOLDED} AND kind = {KILL} AND open").select("dl", F.expr("sk div 2").alias("seq"), "pside", F.when(F.col("pside").isNull(), F.expr("psk div 2")).alias("up"))
    par = plain.select("dl", F.col("seq").alias("up"), F.col("ext").alias("_ext"), F.col("side").alias("_side"), F.lit(True).alias("_in"))
    m = m.join(par, ["dl", "up"], "left").select(
        "dl", "seq", F.when(F.col("_in"), F.col("_ext")).otherwise(F.col("up")).alias("up"), F.lit(False).alias("bad"), F.lit(None).cast("bigint").alias("ext"), F.coalesce("pside", "_side").alias("side")
    )
    m, _ = _climb(m, "sides")
    m = m.select("dl", "seq", F.coalesce("side", F.lit(False)).alias("side"))
    own = plain.where("ext IS NULL").select("dl", "seq", "side")
    # the chains that begin in a ref with several births: those whose beginning worked
    heirs = plain.where("ext IS NOT NULL").select("dl", "seq", "ext").join(m.select("dl", F.col("seq").alias("ext"), "side"), ["dl", "ext"]).select("dl", "seq", "side")
    return own.unionByName(heirs).unionByName(m)
