"""Reassembly over a stream of segments: the state of each connection lives in the state store between micro-batches."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from binframe.operators.flows import FRAMERS, KEYS, MOST_BUFFERED, Stream

OUTPUT = "_src_file string, src_addr string, src_port int, dst_addr string, dst_port int, packet_id long, offset long, n_bytes long, data binary"


class _Reassemble(StatefulProcessor):
    def __init__(self, framers: dict[int, str], most: int, idle_ms: int | None) -> None:
        self.framers, self.most, self.idle_ms = framers, most, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("stream", "packed binary")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        held = self.state.get() if self.state.exists() else None
        name = next((n for p, n in self.framers.items() if p in (key[2], key[4])), None)
        framer = FRAMERS[name] if name else None
        stream: Stream = pickle.loads(bytes(held[0])) if held else Stream(None, self.most, keep=False)  # noqa: S301
        stream.framer = framer
        out = []
        for batch in rows:
            for r in batch.sort_values("packet_id").itertuples():
                kinds = set((r.flags or "").split("|"))
                for m in stream.feed(r.packet_id, r.seq, "SYN" in kinds, "FIN" in kinds, "RST" in kinds, bytes(r.payload or b""), r.payload_start):
                    out.append((*key, m["packet_id"], m["offset"], len(m["data"]), m["data"]))
        stream.framer = None
        # Closed generations but the last have nothing to wait for.
        stream.generations = stream.generations[-1:]
        self.state.update((pickle.dumps(stream),))
        if self.idle_ms:
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + self.idle_ms)
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def handleExpiredTimer(self, key, timer_values, expired) -> Iterator[pd.DataFrame]:  # noqa: N802
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


def stream_messages(segments: DataFrame, framers: dict[int, str] | None = None, *, most: int = MOST_BUFFERED, idle_ms: int | None = 3_600_000) -> DataFrame:
    """Messages of a stream of TCP rows with payloads, as they become complete; a connection idle for ``idle_ms`` is forgotten.

    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    rows = segments.select(*KEYS, "packet_id", "seq", "flags", "payload", "payload_start")
    return rows.groupBy(*KEYS).transformWithStateInPandas(statefulProcessor=_Reassemble(framers or {443: "tls", 53: "dns"}, most, idle_ms), outputStructType=OUTPUT, outputMode="Append", timeMode="ProcessingTime" if idle_ms else "None")


def windowed_counts(events: DataFrame, time: str, by: list[str], every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows of each tumbling window and key; on a stream, rows later than ``late`` are left out and windows come once."""
    return events.withWatermark(time, late).groupBy(F.window(time, every), *by).count()
