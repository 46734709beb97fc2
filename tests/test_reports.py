from model import MESSAGE, msg

from bookweave.plans import catalogue


def test_clean_days_and_days_without_a_book_are_reported(spark, tmp_path):
    clean = [msg(1, "A", 1, 1001, None, "B", 300, 1500000)]
    bare = [msg(2, "S", 0, decoded=False)]
    spark.createDataFrame(clean, MESSAGE).unionByName(spark.createDataFrame(bare, MESSAGE).selectExpr(
        *["20200102 AS trade_day" if c == "trade_day" else c for c in spark.createDataFrame(bare, MESSAGE).columns]
    )).write.parquet(f"{tmp_path}/messages.parquet")
    got = sorted((r.frames, r.books, r.open_orders, r.unknown_refs) for r in catalogue.replay_report(spark, str(tmp_path)).collect())
    assert got == [(1, 0, 0, 0), (1, 1, 1, 0)]


def test_ladder_refusals_are_a_query(spark, tmp_path):
    rows = [msg(1, "A", 1, 1001, None, "B", 300, 1500000), msg(2, "A", 1, 1002, None, "B", 300, 1500050), msg(3, "A", 1, 1003, None, "S", 5, 1900000000), msg(4, "A", 1, 1004, None, "S", 5, 1500100)]
    spark.createDataFrame(rows, MESSAGE).write.parquet(f"{tmp_path}/messages.parquet")
    assert [tuple(r)[1:] for r in catalogue.QUERIES["ladder_rejects"](spark, str(tmp_path)).collect()] == [("A", 2)]
