from bookweave.operators import features


def test_tape_without_messages_is_kept(spark):
    m = [(1, 1, "A", 5, 10, 100), (1, 1, "E", 6, 11, 40), (1, None, "A", 7, 12, 1)]
    x = [(1, 1, 1, 40), (2, 2, 1, 7), (3, 1, 9, 5), (3, 1, 9, 5), (4, None, 9, 6), (5, 1, None, 8)]
    messages = spark.createDataFrame(m, "trade_day int, locate int, type string, seq long, ts long, shares long")
    executions = spark.createDataFrame(x, "exec_id long, trade_day int, locate int, shares long")
    out = features.locate_totals(messages, executions)
    cols = ["locate", "n_messages", "n_A", "n_E", "executed_shares", "last_ts", "tape_records", "tape_shares", "pairs", "pairs_tape_shares"]
    got = sorted(map(tuple, out.select(*cols).collect()), key=str)
    assert got == [(1, 2, 1, 1, 40, 11, 2, 47, 2, 80), (9, 0, 0, 0, 0, None, 2, 11, 0, 0), (None, 1, 1, 0, 0, 12, 1, 8, 0, 0)]
