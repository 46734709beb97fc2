import gzip

import pytest
from pyspark.sql import functions as F

from bookweave import session
from bookweave.functions import wire
from bookweave.functions.running import once
from bookweave.operators import execution as ex
from bookweave.sources import itch

STORE = "locate int, bid_price long, bid_shares long, ask_price long, ask_shares long, open_orders long, bid_levels long, ask_levels long, snapshot_version long, unknown_refs long"


def test_list_and_quote_carry_all_fields(spark):
    store = spark.createDataFrame([(7, 100, 5, None, None, 1, 1, 0, 3, 2)], STORE)
    ask = spark.createDataFrame([('{"cmd":"list"}',), ('{"cmd":"quote","locate":7}',)], "line string")
    book = '"locate":7,"best_bid":100,"best_bid_shares":5,"best_ask":null,"best_ask_shares":null,"open_orders":1,"bid_levels":1,"ask_levels":0'
    got = {r.cmd: r.response for r in wire.answer(ask, store).collect()}
    assert got == {"list": '{"snapshot_version":3,"unknown_refs":2,"books":[{' + book + "}]}", "quote": "{" + book + ',"snapshot_version":3,"unknown_refs":2}'}
    assert {r.response for r in wire.answer(ask.limit(1), store.limit(0)).collect()} == {'{"snapshot_version":0,"unknown_refs":0,"books":[]}'}


def test_parents_without_a_schedule_fail_or_are_told_apart(spark):
    p = spark.createDataFrame([(1, 0, 10, 5, 100), (2, 10, 10, 5, 100), (3, 0, 10, 0, 100), (4, 0, 1000, 1, 100), (5, None, 10, 5, 100)], "parent_id int, start_ts long, end_ts long, bin_ns long, total long")
    assert [r.parent_id for r in ex.rejected_parents(p).orderBy("parent_id").collect()] == [2, 3, 4, 5]
    assert ex.twap_schedule(ex.accepted_parents(p)).count() == 2
    with pytest.raises(Exception, match="start_ts must be before end_ts"):
        ex.twap_schedule(p.where("parent_id = 2")).collect()


def test_the_gate_opens_again_after_a_reset(spark):
    o = spark.createDataFrame([(1, t, 1, "Limit", 100, n) for t, n in ((1, 100), (2, 1), (3, 50), (5, 50))], "k int, ts long, child_id int, type string, price long, shares long").withColumn("reference_price", F.lit(100).cast("long"))
    reset = spark.createDataFrame([(1, 3)], "k int, ts long")
    limits = dict(max_shares=1000, max_notional=10**9, collar_bps=500, cum_shares=100, cum_notional=10**9)
    got = [r.reason for r in ex.risk_gate(o, ["k"], ["ts", "child_id"], **limits, resets=reset).orderBy("ts").collect()]
    assert got == ["None", "CumulativeSharesExceeded", "None", "None"]


def test_data_after_the_first_gzip_member_is_an_error(tmp_path):
    one = gzip.compress(b"\x00\x01S")
    (tmp_path / "a.gz").write_bytes(one)
    (tmp_path / "b.gz").write_bytes(one + one)
    assert len(list(itch.walk(str(tmp_path / "a.gz")))) == 1
    with pytest.raises(ValueError, match="after the first gzip member"):
        list(itch.walk(str(tmp_path / "b.gz")))


def test_scratch_tables_are_dropped_and_repeats_have_one_choice(spark):
    name = session.write_bucketed(spark.range(10), ["id"], "test")
    assert spark.catalog.tableExists(name)
    assert session.drop_scratch(spark) >= 1 and not spark.catalog.tableExists(name)
    d = spark.createDataFrame([(1, 5, "b"), (1, 5, "a"), (2, None, "c"), (None, 1, "d")], "k int, v int, w string")
    assert sorted(map(tuple, once(d, "k").collect())) == [(1, 5, "a"), (2, None, "c")]
