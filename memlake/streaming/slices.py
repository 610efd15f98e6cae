"""Slices of a session's messages, from a stream with event-time timers, and the same over a table."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: What a slice says: full (as many messages as the threshold asks for) or idle (nothing came for so long).
SLICES = "session_id string, slice long, cause string, first_ms long, last_ms long, seqs array<long>"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass
class Slicer:
    """The open slice of a session, and how many it has had. Thresholds are 1, 2, 4, ... and `steady` from there on; each slice, full or idle, is a step."""

    steady: int
    idle_ms: int
    done: int = 0
    seqs: list = field(default_factory=list)
    first_ms: int = 0
    last_ms: int = 0

    def threshold(self) -> int:
        return min(self.steady, 1 << min(self.done, 62))

    def flush(self, cause: str) -> tuple:
        out = (self.done + 1, cause, self.first_ms, self.last_ms, self.seqs)
        self.done, self.seqs = self.done + 1, []
        return out

    def quiet(self, now_ms: int) -> Iterator[tuple]:
        """The open slice, if nothing has come for idle_ms by now."""
        if self.seqs and now_ms - self.last_ms >= self.idle_ms:
            yield self.flush("idle")

    def take(self, ts_ms: int, seq: int) -> Iterator[tuple]:
        """Slices that end by the next message, in the order of time and number."""
        yield from self.quiet(ts_ms)
        self.first_ms = self.first_ms if self.seqs else ts_ms
        self.seqs = [*self.seqs, seq]
        self.last_ms = ts_ms
        if len(self.seqs) >= self.threshold():
            yield self.flush("full")


class SliceStream(StatefulProcessor):
    """Messages wait until the watermark has passed them, and are taken in order then, so neither lateness within the delay nor replays change a slice.

    State: the waiting messages by number (a replay falls on itself; one behind the watermark is late and dropped), and the open slice, which
    has fewer messages than `steady`. Timers: when the watermark passes the first waiting message, and when the open slice has been quiet for so long.
    """

    def __init__(self, steady: int, idle_ms: int):
        self.steady, self.idle_ms = steady, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "seq long", "ts_ms long")
        self.open = handle.getValueState("open", "done long, seqs array<long>, first_ms long, last_ms long")

    def _turn(self, key: tuple, new: list[tuple[int, int]], mark: int) -> Iterator[pd.DataFrame]:
        """Take what has waited and the watermark has passed by now, and set the timers anew. New messages behind it are late."""
        waiting, due = {seq: ts for ts, seq in new if ts > mark}, []
        for (seq,), (ts,) in list(self.waiting.iterator()):
            if ts <= mark:
                due.append((ts, seq))
                self.waiting.removeKey((seq,))
            else:
                waiting[seq] = ts
        for ts, seq in new:
            if ts > mark:
                self.waiting.updateValue((seq,), (ts,))
        held = self.open.get() if self.open.exists() else (0, [], 0, 0)
        slicer = Slicer(self.steady, self.idle_ms, held[0], list(held[1]), held[2], held[3])
        out = [s for ts, seq in sorted(due) for s in slicer.take(ts, seq)]
        out += slicer.quiet(mark)
        self.open.update((slicer.done, slicer.seqs, slicer.first_ms, slicer.last_ms))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        nexts = [min(waiting.values())] if waiting else []
        nexts += [slicer.last_ms + self.idle_ms] if slicer.seqs else []
        for at in nexts:
            self.handle.registerTimer(max(at, mark + 1))
        if out:
            yield pd.DataFrame([(key[0], *s) for s in out], columns=["session_id", "slice", "cause", "first_ms", "last_ms", "seqs"])

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        mark = max(0, timerValues.getCurrentWatermarkInMs())
        new = [(int(ts), int(seq)) for batch in rows for ts, seq in zip(batch["ts_ms"], batch["seq"], strict=True)]
        yield from self._turn(key, new, mark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        yield from self._turn(key, [], max(0, timerValues.getCurrentWatermarkInMs()))

    def close(self) -> None:
        pass


def slice_stream(messages: DataFrame, steady: int = 6, idle_ms: int = 1_800_000, delay: str = "10 minutes") -> DataFrame:
    """Slices (see SLICES) of a stream of messages (session_id, seq, ts timestamp): each once it is full or has been idle, as the watermark tells.

    Messages of a session are told apart by seq. Sessions that are off are to be left out before. Timers and maps need the state store ROCKS: see `run_to_table`.
    """
    rows = messages.select("session_id", "seq", F.unix_millis("ts").alias("ts_ms"), "ts").withWatermark("ts", delay)
    return rows.groupBy("session_id").transformWithStateInPandas(SliceStream(steady, idle_ms), SLICES, "Append", "EventTime")


def slices(messages: DataFrame, mark_ms: int, steady: int = 6, idle_ms: int = 1_800_000) -> DataFrame:
    """The slices that `slice_stream` has given out once its watermark is mark_ms, of a table of messages (session_id, seq, ts_ms).

    Sorted sessions pass by in batches; only the open slice of one is held. Rows that repeat a message count once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("session_id", pa.string()), ("slice", pa.int64()), ("cause", pa.string()), ("first_ms", pa.int64()), ("last_ms", pa.int64()), ("seqs", pa.list_(pa.int64()))])
        at, slicer, last = None, None, None
        for batch in batches:
            out = []
            for session, ts, seq in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if slicer is None or session != at:
                    if slicer is not None:
                        out += [(at, *s) for s in slicer.quiet(mark_ms)]
                    at, slicer, last = session, Slicer(steady, idle_ms), None
                if (ts, seq) != last:
                    out += [(at, *s) for s in slicer.take(ts, seq)]
                last = (ts, seq)
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)
        if slicer is not None:
            end = [(at, *s) for s in slicer.quiet(mark_ms)]
            if end:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in end], schema)

    rows = messages.where(F.col("ts_ms") <= mark_ms).select("session_id", "ts_ms", "seq")
    return rows.repartition("session_id").sortWithinPartitions("session_id", "ts_ms", "seq").mapInArrow(run, SLICES)
