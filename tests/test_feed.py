import pytest
from model import MESSAGE, msg, random_feed, replay

from bookweave.operators import book, changes, ladder, orphans
from bookweave.operators import lifecycle as lc

NO_EXEC = "exec_id long, trade_day int, locate int, ref long"
NO_FILL = "fill_id long, trade_day int, child_id long, ts long"
NO_CHILD = "child_id long, trade_day int, ts long"


def feed_of(spark, rows, **kw):
    return spark.createDataFrame(rows, MESSAGE)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_feeds_match_the_sequential_model(spark, seed):
    rows = random_feed(seed)
    bad, live, refused = replay(rows)
    m = feed_of(spark, rows).repartition(3)
    feed = lc.settled_feed(m)
    got = {(r.dl // 4294967296, r.seq) for r in lc.orphan_mutations(feed).collect()}
    assert got == bad
    unknown = {(r.dl // 4294967296, r.seq) for r in book.applied(feed).where("NOT applied").collect()}
    assert unknown == bad | refused
    assert {tuple(r) for r in changes.open_orders(m, batches=3).collect()} == live
    levels = {}
    for day, loc, _, side, shares, price in live:
        x = levels.setdefault((day, loc, side, price), [0, 0])
        x[0] += shares
        x[1] += 1
    assert {(r.trade_day, r.locate, r.side, r.price): [r.shares, r.orders] for r in book.levels(feed).collect()} == levels


def test_self_test_session(spark):
    rows = [
        msg(1, "S", 0, decoded=False), msg(2, "A", 1, 1001, None, "B", 300, 1500000), msg(3, "A", 1, 1002, None, "B", 200, 1499900), msg(4, "A", 1, 2001, None, "S", 500, 1500100),
        msg(5, "A", 2, 3001, None, "B", 1000, 4200000), msg(6, "E", 1, 1001, shares=300), msg(7, "X", 1, 2001, shares=100), msg(8, "U", 2, 3001, 3002, None, 800, 4199500), msg(9, "D", 1, 1002),
    ]
    got = {r.locate: (r.bid_price, r.bid_shares, r.ask_price, r.ask_shares, r.open_orders, r.bid_levels, r.ask_levels) for r in book.snapshot(feed_of(spark, rows)).collect()}
    assert got == {1: (None, None, 1500100, 400, 1, 0, 1), 2: (4199500, 800, None, None, 1, 1, 0)}


def test_replace_chain_direct_and_inherited(spark):
    rows = [msg(1, "U", 1, 99, 100, None, 10, 100), msg(2, "U", 1, 100, 101, None, 10, 100), msg(3, "E", 1, 101, shares=5), msg(4, "A", 1, 7, None, "B", 5, 100), msg(5, "X", 1, 7, shares=1)]
    feed = lc.settled_feed(feed_of(spark, rows))
    assert {(r.seq, r.direct) for r in lc.orphan_mutations(feed).collect()} == {(1, True), (2, False), (3, False)}
    assert feed.rounds <= 3


def test_boundary_values_and_the_ladder(spark):
    top = 2**32 - 1
    rows = [
        msg(1, "A", 0, 1, None, "B", 0, 0), msg(2, "A", 65535, -1, None, "S", top, top), msg(3, "E", 65535, -1, shares=top),
        msg(4, "A", 1, 42, None, "B", 10, 1000000), msg(5, "A", 1, 42, None, "S", 10, 1000100),
    ]
    m = feed_of(spark, rows)
    s = {r.locate: r for r in book.snapshot(m).collect()}
    assert (s[0].open_orders, s[0].bid_price, s[0].bid_shares) == (1, 0, 0)
    assert s[65535].open_orders == 0 and s[1].bid_shares == 10
    assert {r.seq for r in book.applied(lc.settled_feed(m)).where("NOT applied").collect()} == {5}
    assert [tuple(r) for r in ladder.refused(m).collect()] == [(20240102, 65535, 2)]
    assert {r.seq for r in book.applied(lc.settled_feed(ladder.ladder_messages(m))).where("NOT applied").collect()} == {3, 5}


def test_orphans_of_dirty_and_empty_tables(spark):
    rows = [msg(1, "A", 1, 5, None, "B", 10, 100), msg(2, "E", None, 5, shares=1), msg(3, "D", 1, None), msg(None, "D", 1, 77), msg(4, "X", 1, 5, shares=None), msg(5, "E", 1, 6, shares=1, decoded=False)]
    m = feed_of(spark, rows).selectExpr("*", "'x' AS dl", "1 AS kind", "2 AS _births")
    x = spark.createDataFrame([(1, 20240102, 1, 5), (2, 20240102, 1, 6), (2, 20240102, 1, 6), (3, 20240102, 1, None), (4, None, 1, 5)], NO_EXEC)
    f = spark.createDataFrame([(1, 20240102, 8, 50), (2, 20240102, 8, 40), (3, 20240102, None, 1), (4, 20240102, 8, None), (5, 20240103, 8, 60)], NO_FILL)
    c = spark.createDataFrame([(8, 20240102, 45), (8, 20240102, 47)], NO_CHILD)
    got = {tuple(r) for r in orphans.orphans(m, x, f, c).select("src_table", "rec_id").collect()}
    assert got == {("messages", 2), ("messages", 3), ("executions", 2), ("executions", 4), ("fills", 2), ("fills", 4), ("fills", 5)}
    none = [spark.createDataFrame([], s) for s in (MESSAGE, NO_EXEC, NO_FILL, NO_CHILD)]
    assert orphans.orphans(*none).count() == 0
    assert changes.open_orders(none[0]).count() == 0
    assert book.snapshot(none[0]).count() == 0


def test_newest_first_with_base_repeats_and_null_keys(spark):
    schema = "k int, ord long, op string, delta long, v long"
    old = spark.createDataFrame([(1, 1, "I", None, 10), (2, 2, "I", None, 20), (None, 3, "I", None, 5), (1, 1, "I", None, 10), (6, 4, "T", None, None)], schema)
    new = spark.createDataFrame([(1, 12, "T", None, None), (2, 11, "D", 3, None), (2, 11, "D", 3, None), (3, 10, "D", 1, None), (4, None, "T", None, None), (None, 13, "D", None, None)], schema)
    base = spark.createDataFrame([(3, 30), (4, 40), (5, 50), (6, 60), (1, 99)], "k int, v long")
    got = {(r.k, r.v, int(r.delta_sum), r.delta_n) for r in changes.newest_first([new, old], ["k"], ["v"], base).collect()}
    assert got == {(2, 20, 3, 1), (None, 5, 0, 1), (3, 30, 1, 1), (4, 40, 0, 0), (5, 50, 0, 0)}


@pytest.mark.parametrize("seed,every", [(9, 25), (10, 20)])
def test_checkpoints_follow_the_model(spark, seed, every):
    """Empty books stay, and the end of the day is published once more, also if the cadence divides the messages (120 by 20)."""
    rows = [r[:0] + (20240102,) + r[1:] for r in random_feed(seed, 120)]
    m = feed_of(spark, rows)
    got = {(r.version, r.locate): (r.open_orders, r.bid_price, r.bid_shares, r.ask_price, r.ask_shares, r.bid_levels, r.ask_levels) for r in book.checkpoints(m, lc.settled_feed(m), every).collect()}
    seqs = sorted({r[1] for r in rows})
    want = {}
    for v in range(1, len(seqs) // every + 2):
        upto = set(seqs[: v * every])
        part = [r for r in rows if r[1] in upto]
        live = replay(part)[1]
        for loc in {r[3] for r in part}:
            lv = {}
            for _, o, _, side, shares, price in live:
                if o == loc:
                    x = lv.setdefault((side, price), [0, 0])
                    x[0], x[1] = x[0] + shares, x[1] + 1
            bids, asks = sorted(p for s, p in lv if s == "B"), sorted(p for s, p in lv if s == "S")
            want[(v, loc)] = (
                sum(x[1] for x in lv.values()), bids[-1] if bids else None, lv[("B", bids[-1])][0] if bids else None, asks[0] if asks else None, lv[("S", asks[0])][0] if asks else None, len(bids), len(asks),
            )
    assert got == want


FAR_PRICES = (100, 700, 50_000, 500_000, 500_050, 60_000_000, 300_000_000, 600_000_000, 610_000_000, 620_000_000, 700_000_000, 1_900_000_000)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ladder_matches_the_sequential_model(spark, seed):
    rows = random_feed(seed, 300, prices=FAR_PRICES)
    bad, live, refused = replay(rows, ladder=True)
    m = feed_of(spark, rows)
    assert {tuple(r) for r in changes.open_orders(ladder.ladder_messages(m)).collect()} == live
    assert sum(r.unknown_refs for r in ladder.unknown_refs(m).collect()) == len(bad | refused)


def test_long_chains_of_void_replaces_settle_in_few_rounds(spark):
    rows = [msg(i, "U", 1, i, i + 1, None, 10, 100) for i in range(1, 10_001)] + [msg(20_000, "E", 1, 10_001, shares=1)]
    feed = lc.settled_feed(feed_of(spark, rows))
    assert feed.rounds <= 16
    assert lc.orphan_mutations(feed).where("NOT direct").count() == 10_000


def test_result_does_not_depend_on_partitions(spark):
    rows = random_feed(5)
    a, b = (sorted(map(str, changes.open_orders(feed_of(spark, rows).repartition(n)).collect())) for n in (1, 9))
    assert a == b
