"""Framed binary day files as a Spark data source, and a sink that writes them.

``spark.dataSource.register(FrameSource)``; ``spark.read.format("framed").load(path)`` gives (file, frame, offset, len,
payload), one row per complete frame. A frame is a two-byte big-endian length and that many bytes. Reading stops at a
zero length or a short tail of a plain file. A ``.gz`` file is inflated in chunks and never held whole; bad data, a
truncated stream, data after the first gzip member or a partial last frame raise. An empty file has no frames, a missing one raises.

A file is one partition (framing is sequential), so a large feed should be cut into files; memory is one chunk a task.
"""

from __future__ import annotations

import glob
import os
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "file string, frame bigint, offset bigint, len int, payload binary"
CHUNK = 4 << 20
ROWS = 20_000


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def chunks(path: str, size: int = CHUNK) -> Iterator[bytes]:
    with open(path, "rb") as f:
        if not path.endswith(".gz"):
            while data := f.read(size):
                yield data
            return
        z = zlib.decompressobj(wbits=31)
        while not z.eof:
            data = f.read(size)
            if not data:
                raise ValueError(f"{path}: truncated gzip stream")
            yield z.decompress(data)
        if z.unused_data or f.read(1):
            raise ValueError(f"{path}: data after the first gzip member")


def walk(path: str, size: int = CHUNK) -> Iterator[tuple[int, bytes]]:
    """(offset, payload) of each frame."""
    carry, base = b"", 0
    for data in chunks(path, size):
        carry += data
        at = 0
        while len(carry) - at >= 2:
            n = int.from_bytes(carry[at : at + 2], "big")
            if n == 0:
                return
            if len(carry) - at < 2 + n:
                break
            yield base + at, carry[at + 2 : at + 2 + n]
            at += 2 + n
        carry, base = carry[at:], base + at
    if carry and path.endswith(".gz"):
        raise ValueError(f"{path}: partial last frame")


def paths(spec: str) -> list[str]:
    spec = spec.removeprefix("file://")
    if os.path.isdir(spec):
        return sorted(p for p in glob.glob(f"{spec}/**/*", recursive=True) if os.path.isfile(p) and not os.path.basename(p).startswith((".", "_")))
    found = sorted(glob.glob(spec))
    if not found:
        raise FileNotFoundError(spec)
    return found


class FrameReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("chunk", CHUNK))

    def partitions(self):
        return [File(p) for p in paths(self.path)]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        rows: list = []
        names = ["file", "frame", "offset", "len", "payload"]
        types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for i, (offset, payload) in enumerate(walk(partition.path, self.size)):
            rows.append((partition.path, i + 1, offset, len(payload), payload))
            if len(rows) == ROWS:
                yield batch()
                rows = []
        if rows:
            yield batch()


class Done(WriterCommitMessage):
    def __init__(self, path: str, frames: int):
        self.path, self.frames = path, frames


class FrameWriter(DataSourceWriter):
    """Each task writes its payloads, in the order of its rows, to a file of its own; files appear on commit."""

    def __init__(self, options: dict):
        self.path = options["path"].removeprefix("file://")

    def write(self, rows) -> Done:
        from pyspark import TaskContext

        os.makedirs(self.path, exist_ok=True)
        c = TaskContext.get()
        name, n = f"{self.path}/.part-{c.partitionId():05d}-{c.taskAttemptId()}", 0
        with open(name, "wb") as f:
            for r in rows:
                f.write(len(r.payload).to_bytes(2, "big") + bytes(r.payload))
                n += 1
        return Done(name, n)

    def commit(self, messages: list[Done | None]) -> None:
        for m in messages:
            if m:
                os.replace(m.path, m.path.replace("/.part-", "/part-"))

    def abort(self, messages: list[Done | None]) -> None:
        for m in messages:
            if m and os.path.exists(m.path):
                os.remove(m.path)


class FrameSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "framed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FrameReader:
        return FrameReader(self.options)

    def writer(self, schema, overwrite: bool) -> FrameWriter:
        return FrameWriter(self.options)
