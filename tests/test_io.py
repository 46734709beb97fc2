import gzip

import pytest
from model import MESSAGE, msg
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from bookweave.functions import wire
from bookweave.sources.itch import FrameSource, walk
from bookweave.streaming.session import in_order, publish_books


@pytest.fixture(scope="module")
def source(spark):
    spark.dataSource.register(FrameSource)
    return spark


def stream(*payloads):
    return b"".join(len(p).to_bytes(2, "big") + p for p in payloads)


@pytest.mark.parametrize("size", [1, 20, 39, 1 << 20])
def test_frames_over_any_chunks(tmp_path, size):
    data = stream(b"a" * 36, b"b" * 19, b"c")
    (tmp_path / "x").write_bytes(data)
    (tmp_path / "x.gz").write_bytes(gzip.compress(data))
    for name in ("x", "x.gz"):
        assert [(o, len(p)) for o, p in walk(str(tmp_path / name), size)] == [(0, 36), (38, 19), (59, 1)]


def test_ends_and_faults(tmp_path):
    (tmp_path / "zero").write_bytes(stream(b"ab") + b"\0\0" + stream(b"cd"))
    (tmp_path / "short").write_bytes(stream(b"ab") + b"\0\x09xy")
    (tmp_path / "none").write_bytes(b"")
    assert [[p for _, p in walk(str(tmp_path / n))] for n in ("zero", "short", "none")] == [[b"ab"], [b"ab"], []]
    (tmp_path / "part.gz").write_bytes(gzip.compress(stream(b"ab") + b"\0\x09xy"))
    (tmp_path / "cut.gz").write_bytes(gzip.compress(stream(b"ab" * 999))[:-9])
    (tmp_path / "bad.gz").write_bytes(b"no gzip at all")
    for n in ("part.gz", "cut.gz", "bad.gz"):
        with pytest.raises(Exception):
            list(walk(str(tmp_path / n)))


def test_write_read_decode(source, tmp_path):
    rows = [msg(i, "A", 1, i, None, "B", 10, 100) for i in range(1, 6)] + [msg(6, "D", 1, 3)]
    m = source.createDataFrame(rows, MESSAGE).coalesce(1).orderBy("seq").select(wire.encode().alias("payload"))
    m.write.format("framed").mode("append").save(str(tmp_path / "day"))
    back = wire.decode(source.read.format("framed").load(str(tmp_path / "day")))
    assert [(r.type, r.ref) for r in back.orderBy("file", "frame").collect()] == [("A", 1), ("A", 2), ("A", 3), ("A", 4), ("A", 5), ("D", 3)]
    with pytest.raises(PySparkException):
        source.read.format("framed").load(str(tmp_path / "missing")).count()


SCHEMA = "session string, seq long, count int, payload binary"


def packets(spark, folder, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{folder}/in/b={i}")


def run(spark, folder, batches, cap=256):
    got, state = [], None
    import os

    os.makedirs(f"{folder}/in", exist_ok=True)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        q = in_order(spark.readStream.schema(SCHEMA).parquet(f"{folder}/in"), cap).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
    out = spark.read.parquet(f"{folder}/out").collect()
    frames = sorted(r.seq for r in out if r.kind == "frame")
    state = max((r for r in out if r.kind == "state"), key=lambda r: (r.next_seq, r.pending))
    return frames, state, out


def test_gaps_are_asked_for_and_filled(spark, tmp_path):
    p = [("s", i, 1, stream(b"m%d" % i)) for i in range(1, 10)]
    first = [x for x in p if x[1] not in (2, 5, 8)] + [p[0], ("s", 0, 0, b"")]
    frames, state, out = run(spark, str(tmp_path), [first, [p[1], p[4], p[7]] + [("s", 10, 65535, b"")]])
    assert frames == list(range(1, 10)) and (state.next_seq, state.pending, state.ended) == (10, 0, True)
    assert {(r.ask_from, r.ask_count) for r in out if r.ask_from} == {(2, 1)}


def test_cap_and_packets_of_many_frames(spark, tmp_path):
    burst = [("s", i, 1, stream(b"x")) for i in range(2, 322)]
    frames, state, _ = run(spark, str(tmp_path / "a"), [burst])
    assert frames == [] and (state.pending, state.dropped) == (256, 64)
    frames, state, _ = run(spark, str(tmp_path / "b"), [[("s", 2, 1, stream(b"x")), ("s", 4, 1, stream(b"z")), ("s", 1, 3, stream(b"a", b"b", b"c"))]])
    assert frames == [1, 2, 3, 4] and (state.pending, state.mismatches) == (0, 0)


def test_books_are_published_per_batch(spark, tmp_path):
    rows = [msg(1, "A", 1, 1, None, "B", 10, 100), msg(2, "A", 2, 2, None, "S", 5, 200)]
    spark.createDataFrame(rows, MESSAGE).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(MESSAGE).parquet(str(tmp_path / "in"))
    publish_books(src, str(tmp_path / "log"), str(tmp_path / "books"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "books")).groupBy("version").agg(F.count("*").alias("n")).collect()
    assert [(r.version, r.n) for r in got] == [(0, 2)]
