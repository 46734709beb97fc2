import numpy as np
import pytest
from model import MESSAGE, msg
from pyspark.sql import functions as F

from bookweave.functions import running as rn
from bookweave.functions import wire
from bookweave.operators import anomalies, features, session_layer, stats
from bookweave.operators import execution as ex

CI = "run_id long, timestamp_utc timestamp_ntz, commit_sha string, os string, runner string, book_type string, message_type string, p50_ns long, p99_ns long, p999_ns long"


def test_features_of_dirty_rows(spark):
    rows = [msg(1, "A", 1, 1, None, "B", 10, 5, ts=7), msg(1, "A", 1, 1, None, "B", 10, 5, ts=7, line="R"), msg(2, "a", 1, decoded=False, ts=9), msg(3, "0x1f", None, decoded=False), msg(4, None, 1, decoded=False, ts=1), msg(None, "A", 1)]
    m = spark.createDataFrame(rows, MESSAGE).withColumn("n", F.lit(1)).withColumn("code", F.lit("x"))
    got = {r.locate: r.asDict() for r in features.entity_features(m).collect()}
    one = got[1]
    assert (one["t41_n"], one["t41_last_ts"], one["t41_shares"], one["t41_recency"]) == (1, 7, 10, 2)
    assert (one["t61_n"], one["tother_n"], one["t42_n"], one["t42_last_ts"]) == (1, 1, 0, None)
    assert got[None]["t1f_n"] == 1
    empty = spark.createDataFrame([], MESSAGE)
    assert features.entity_features(empty).count() == 0
    assert features.locate_totals(empty, spark.createDataFrame([], "exec_id long, trade_day int, locate int, shares long")).count() == 0


def test_eager_join_equals_the_plain_join(spark):
    rng = np.random.default_rng(1)
    left = spark.createDataFrame([(int(k), int(v)) for k, v in zip(rng.integers(0, 4, 300), rng.integers(0, 9, 300))] + [(None, 1)], "k int, v long")
    right = spark.createDataFrame([(int(k), int(v)) for k, v in zip(rng.integers(1, 6, 200), rng.integers(0, 9, 200))] + [(None, 1)], "k int, w long")
    a = left.groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("v"))
    b = right.groupBy("k").agg(F.count("*").alias("n"), F.sum("w").alias("w"))
    got = {r.k: (int(r.pairs), int(r.pairs_v), int(r.pairs_w)) for r in features.eager_join(a, b, ["k"], ["v"], ["w"]).collect()}
    want = {r.k: (r.n, r.v, r.w) for r in left.join(right, "k").groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("v"), F.sum("w").alias("w")).collect()}
    assert {k: v for k, v in got.items() if v[0]} == want and got[None] == (0, 0, 0) and got[0] == (0, 0, 0)


def readings(spark, values, src=1, block=100):
    return spark.createDataFrame([(src, i // block, i, i, int(v), bool(v <= 0)) for i, v in enumerate(values)], "src long, block long, at long, id long, value long, impossible boolean")


def test_spikes_stuck_and_shifts(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = 100_000 + rng.normal(0, 100, 3000).round()
    v[1500:] += 40_000  # a lasting shift is no spike
    for i in (0, 700, 1023, 1024, 1499, 2999):
        v[i] = 300_000
    v[1200] = -5
    v[2040:2060] = v[2040]  # stuck, over the end of a chunk
    v[900:911] = v[900]  # one short of stuck
    got = {r.id for r in anomalies.chart_findings(readings(spark, v), 12).distinct().collect()}
    assert got == {0, 700, 1023, 1024, 1499, 2999, 1200, *range(2040, 2060)}


def test_implausible_on_few_null_and_no_rows(spark):
    rows = [msg(1, "A", 1, 1, None, "B", 0, 5), msg(2, "A", None, 1, None, "B", 5, -1), msg(3, "A", 1, 1, None, "B", None, None), msg(4, "F", 1, 1, None, "B", 9, 2_000_000_000)]
    ci = [(1, None, None, "L", "r", "b", "A", 5, 6, None), (2, None, None, "L", None, "b", "A", 5, None, None)]
    import datetime as dt

    ci += [(3, dt.datetime(2024, 1, 1), None, "L", "r", "b", "A", 9, 6, None), (3, dt.datetime(2024, 1, 1), None, "L", "r", "b", "A", 9, 6, None), (4, dt.datetime(2024, 1, 1), None, "L", "r", "b", "A", 1, 6, 5)]
    got = {tuple(r) for r in anomalies.implausible(spark.createDataFrame(rows, MESSAGE), spark.createDataFrame(ci, CI)).collect()}
    assert got == {("messages", "shares", 1), ("messages", "price", 2), ("messages", "price", 4), ("ci_history", "p99_ns", 3), ("ci_history", "p99_ns", 4)}
    assert anomalies.implausible(spark.createDataFrame([], MESSAGE), spark.createDataFrame([], CI)).count() == 0


def test_running_and_as_of_across_blocks(spark):
    rng = np.random.default_rng(2)
    rows = [(int(k), int(t), i, int(v)) for i, (k, t, v) in enumerate(zip(rng.integers(0, 2, 200), rng.integers(0, 1000, 200), rng.integers(0, 9, 200)))]
    df = spark.createDataFrame(rows, "k int, t long, i long, v long")
    out = rn.running(df, ["k"], F.expr("t div 50"), ["t", "i"], {"s": ("sum", "v"), "m": ("max", "v"), "c": ("count", "v")}).collect()
    for r in out:
        up = [x[3] for x in rows if x[0] == r.k and (x[1], x[2]) <= (r.t, r.i)]
        assert (r.s, r.m, r.c, r.s_before) == (sum(up), max(up), len(up), sum(up) - r.v)
    left = spark.createDataFrame([(0, t, t) for t in range(0, 1100, 7)] + [(1, None, -1), (5, 3, -2)], "k int, t long, n long")
    for forward in (False, True):
        got = {r.n: r.v for r in rn.as_of(left, df, ["k"], "t", ["v"], "i", 50, forward).collect()}
        for t in range(0, 1100, 7):
            c = sorted((x[1], x[2], x[3]) for x in rows if x[0] == 0 and (x[1] >= t if forward else x[1] <= t))
            assert got[t] == ((c[0] if forward else c[-1])[2] if c else None)
        assert got[-1] is None and got[-2] is None


def parent(spark, total, start, end, bin_ns):
    return spark.createDataFrame([(1, total, start, end, bin_ns)], "parent_id int, total long, start_ts long, end_ts long, bin_ns long")


def ticks(spark, rows):
    return spark.createDataFrame([(1, t, i, 100, s) for i, (t, s) in enumerate(rows)], "parent_id int, ts long, print_id long, price long, shares long")


def test_schedules(spark):
    assert [r.shares for r in ex.twap_schedule(parent(spark, 1000, 0, 300, 100)).orderBy("bin").collect()] == [334, 333, 333]
    assert ex.twap_schedule(parent(spark, 10000, 0, 1000, 3)).count() == 334
    for risk in (0.0, 1e-6, 1e3):
        s = [r.shares for r in ex.almgren_schedule(parent(spark, 100_001, 0, 1000, 100), risk, 1e-3, 1.0).orderBy("bin").collect()]
        assert sum(s) == 100_001 and min(s) >= 0 and s[0] >= s[-1] - 1
    clock = spark.createDataFrame([(1, t) for t in (50, 150, 400)], "parent_id int, ts long")
    got = {r.bin: r.child_ts for r in ex.released(ex.twap_schedule(parent(spark, 9, 0, 300, 100)), clock, ["parent_id"]).collect()}
    assert got == {0: 150, 1: 400, 2: 400}
    for bad in (dict(start_ts=5, end_ts=5), dict(start_ts=0, end_ts=9, bin_ns=0), dict(start_ts=0, end_ts=600), dict(start_ts=0, end_ts=9, risk_aversion=-1.0), dict(start_ts=0, end_ts=9, impact=0.0)):
        with pytest.raises(ValueError):
            ex.check_schedule(**bad)


def test_vwap_and_pov(spark):
    p = parent(spark, 1_000_000, 1_000_000, 2_000_000, 1)
    v = ex.vwap_children(p, ticks(spark, [(1_000_000 + i * 250_000, 500) for i in range(5)]), ["parent_id"])
    assert v.agg(F.sum("child_shares"), F.max("market_shares")).collect()[0][:] == (1_000_000, 2500)
    c = ex.pov_children(parent(spark, 10**6, 0, 0, 1), ticks(spark, [(1, 1000), (2, 333)]), ["parent_id"], 1000)
    assert [r.child_shares for r in c.orderBy("ts").collect()] == [100, 33]
    c = ex.pov_children(parent(spark, 500, 0, 0, 1), ticks(spark, [(1, 800), (2, 800)]), ["parent_id"], 5000)
    assert [r.child_shares for r in c.orderBy("ts").collect()] == [400, 100]
    many = ex.pov_children(parent(spark, 10**9, 0, 0, 1), ticks(spark, [(i, 100) for i in range(600)]), ["parent_id"], 5000)
    assert ex.first_children(many, ["parent_id"], ["ts", "print_id"]).count() == 512


def test_risk_gate(spark):
    o = [(1, 1, "Limit", 100, 100), (1, 2, "Limit", 100, 1001), (1, 3, "Limit", 102, 50), (1, 4, "Limit", 101, 100), (1, 5, "Limit", 100, 100), (1, 6, "Limit", 100, 1)]
    df = spark.createDataFrame([(*x, 100) for x in o], "k int, ts long, type string, price long, shares long, reference_price long")
    got = [r.reason for r in ex.risk_gate(df, ["k"], ["ts"], 1000, 50000, 100, 250, 10**12).orderBy("ts").collect()]
    assert got == ["None", "OrderTooLarge", "PriceOutOfCollar", "None", "CumulativeSharesExceeded", "KillSwitchTripped"]


def test_lower_rank_percentiles(spark):
    df = spark.createDataFrame([(1, v) for v in (10, 20, 30, 40, 50, None)], "k int, v long")
    r = rn.rank_percentiles(df, ["k"], "v", {"p50": 0.5, "p99": 0.99}).collect()[0]
    assert (r.n, r.p50, r.p99) == (5, 30, 40)
    assert stats.new_rows(df, df.where("v < 30"), ["v"]).count() == 4


def test_sessions(spark):
    rows = [msg(s, "A", line="A") for s in range(1, 10) if s not in (3, 6, 7)] + [msg(6, "A", line="R"), msg(9, "A", line="B")]
    m = spark.createDataFrame(rows, MESSAGE)
    r = session_layer.drain(m).collect()[0]
    assert (r.first_seq, r.next_seq, r.gaps, r.missing, r.pending) == (1, 3, 2, 2, 5)  # 4, 5, 6, 8 and 9 wait for 3
    g = session_layer.gaps(m.where("line = 'A'"))
    assert sorted((x["first"], x["count"]) for x in g.collect()) == [(3, 1), (6, 2)]
    assert [tuple(x) for x in session_layer.retransmitted(g.select("trade_day", "first", "count"), m.where("line = 'R'")).collect()] == [(20240102, 6, 2, 1)]


def test_wire_edges_and_requests(spark):
    rows = [msg(1, "A", 65535, -1, None, "B", 2**32 - 1, 2**32 - 1, ts=2**48 - 1), msg(2, "U", 0, 1, -5, None, 0, 0), msg(3, "C", 1, 7, shares=1, price=3, match=-9)]
    m = spark.createDataFrame(rows, MESSAGE).withColumn("payload", wire.encode())
    back = {r.type: r for r in wire.decode(m.select("payload")).collect()}
    assert (back["A"].ref, back["A"].locate, back["A"].ts, back["A"].shares, back["A"].price, back["A"].stock) == (-1, 65535, 2**48 - 1, 2**32 - 1, 2**32 - 1, "X")
    assert (back["U"].ref, back["U"].new_ref, back["C"].match, back["C"].printable) == (1, -5, -9, True)
    junk = spark.createDataFrame([(b"",), (b"\x01abc",), (b"A" + b"x" * 3,), (b"H" + b"0" * 34,)], "payload binary")
    assert [r.decoded for r in wire.decode(junk).collect()] == [False] * 4
