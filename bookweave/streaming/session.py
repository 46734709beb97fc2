"""Sequenced datagram sessions as a stream: reorder, drop repeats, ask for gaps; and a book published per micro-batch.

``in_order`` keeps, per session, the next wanted number and what came too early (at most ``cap`` packets; any further one is
refused and counted, and asked for again as part of a later gap). Its rows are the frames in order and, per trigger, one row of
counters with the gap to ask for, once a trigger (there is no timer: a session without new packets asks for nothing);
``requests`` counts what was asked. A retransmit server's answers are simply more
datagrams of the same stream. Packets below the wanted number are dropped, and purged from the buffer when a packet of several
frames drains past them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

END, CAP, MAX_REQUEST = 65535, 256, 65534  # fixed values: count that ends a session, buffered packets, frames a request
OUT = "session string, kind string, seq bigint, payload binary, next_seq bigint, pending bigint, dropped bigint, mismatches bigint, ended boolean, ask_from bigint, ask_count bigint, requests bigint"
STATE = "next_seq bigint, seqs array<bigint>, counts array<int>, payloads array<binary>, dropped bigint, mismatches bigint, ended boolean, requests bigint"


def split_frames(payload: bytes) -> list[bytes]:
    out, at = [], 0
    while len(payload) - at >= 2:
        n = int.from_bytes(payload[at : at + 2], "big")
        if n == 0 or len(payload) - at < 2 + n:
            break
        out.append(payload[at + 2 : at + 2 + n])
        at += 2 + n
    return out


def in_order(datagrams: DataFrame, cap: int = CAP) -> DataFrame:
    """datagrams: session STRING, seq BIGINT, count INT, payload BINARY (length-prefixed frames)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            nxt, seqs, counts, loads, dropped, wrong, ended, requests = state.get
            held = {s: (c, p) for s, c, p in zip(seqs, counts, loads)}
        else:
            nxt, held, dropped, wrong, ended, requests = 1, {}, 0, 0, False, 0
        rows: list = []

        def drain() -> None:
            nonlocal nxt, wrong
            while nxt in held:
                count, payload = held.pop(nxt)
                frames = split_frames(bytes(payload))
                wrong += len(frames) != count
                rows.extend((nxt + i, f) for i, f in enumerate(frames))
                if not frames:
                    break
                nxt += len(frames)
                for s in [s for s in held if s < nxt]:
                    del held[s]

        for b in batches:
            for seq, count, payload in zip(b.seq, b["count"], b.payload):
                if count == END:
                    ended = True
                elif count == 0 or seq < nxt:
                    continue
                elif seq not in held and len(held) >= cap:
                    dropped += 1
                else:
                    held[int(seq)] = (int(count), bytes(payload))
                    drain()
        gap = min(held) - nxt if held else 0
        ask = gap > 0
        requests += ask
        state.update((nxt, list(held), [c for c, _ in held.values()], [p for _, p in held.values()], dropped, wrong, bool(ended), requests))
        none = (nxt, len(held), dropped, wrong, bool(ended))
        out = [(key[0], "frame", s, f, *none, None, None, requests) for s, f in rows]
        out.append((key[0], "state", None, None, *none, nxt if ask else None, min(gap, MAX_REQUEST) if ask else None, requests))
        df = pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])
        yield df.astype({c: "Int64" for c in ("seq", "next_seq", "pending", "dropped", "mismatches", "ask_from", "ask_count", "requests")})

    return datagrams.groupBy("session").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def publish_books(messages: DataFrame, folder: str, out: str, checkpoint: str):
    """Append each micro-batch of decoded messages to ``folder`` and publish the books as of it, whole, under ``out``
    as version=N. Returns the started query."""
    from bookweave.operators import book

    def each(batch: DataFrame, version: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{folder}/batch={version}")
        book.snapshot(spark.read.parquet(folder).drop("batch")).write.mode("overwrite").parquet(f"{out}/version={version}")

    return messages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
