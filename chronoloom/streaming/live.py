"""Recordings that still grow, as a stream: new frames are read by ranges of index rows, decoded without state, and placed
and filtered by a stateful operator keyed by recording and input. What it emits equals the batch operators' results."""

from __future__ import annotations

import contextlib
import os
import sqlite3
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from chronoloom.operators.filters import recursion
from chronoloom.sources.recording import decoded, locate

BLOBS = "rec int, frame_no long, ts string, Data binary"
PLACED = "rec int, amp_input int, frame_no long, kind string, first_sample long, segment int, missing long, rate int, samples array<double>, filtered array<double>, error string"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Index rows of one partition of a batch.
ROWS = 256


class RowRange(InputPartition):
    def __init__(self, rec: int, path: str, low: int, high: int) -> None:
        self.rec, self.path, self.low, self.high = rec, path, low, high


def growing(path: str) -> sqlite3.Connection:
    """A database that others write to."""
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True, timeout=30)


class GrowingReader(DataSourceStreamReader):
    """Offsets are the last row number of each index; a recording that joins the list later begins at its first row."""

    def __init__(self, options: dict[str, str]) -> None:
        self.paths, self.track = options["path"].split(os.pathsep), int(options.get("track", "0"))

    def initialOffset(self) -> dict:
        return {path: 0 for path in self.paths}

    def latestOffset(self) -> dict:
        ends = {}
        for path in self.paths:
            with contextlib.closing(growing(path)) as con:
                ends[path] = con.execute("select coalesce(max(rowid), 0) from FrameInfo").fetchone()[0]
        return ends

    def partitions(self, start: dict, end: dict) -> list[RowRange]:
        return [
            RowRange(rec, path, low, min(low + ROWS - 1, end[path]))
            for rec, path in enumerate(self.paths)
            if path in end
            for low in range(start.get(path, 0) + 1, end[path] + 1, ROWS)
        ]

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        with contextlib.closing(growing(partition.path)) as con:
            rows = con.execute(
                "select JoinDatabase, Offset, TimeStamp, FrameKey from FrameInfo where rowid between ? and ? and Track = ? order by JoinDatabase",
                (partition.low, partition.high, self.track),
            ).fetchall()
        for file in dict.fromkeys(r[0] for r in rows):
            mine = [r[1:] for r in rows if r[0] == file]
            with contextlib.closing(growing(os.path.join(os.path.dirname(partition.path), file))) as data:
                # one look-up for all keys: data files have no index that would serve single ones
                wanted = f"select FrameKey, Data from FrameInfo where FrameKey in ({', '.join('?' * len(mine))})"
                blobs = dict(data.execute(wanted, [key for _, _, key in mine]))
            columns = [[partition.rec] * len(mine), [r[0] for r in mine], [r[1] for r in mine], [blobs.get(r[2]) for r in mine]]
            kinds = (pa.int32(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in BLOBS.split(", ")])


class GrowingRecording(DataSource):
    """readStream.format('growing_recording').load(paths of indexes)"""

    @classmethod
    def name(cls) -> str:
        return "growing_recording"

    def schema(self) -> str:
        return BLOBS

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader(self.options)


class PlaceAndFilter(StatefulProcessor):
    """Of one input of a recording: last frame, next sample's place, segment, and the filter's two states. The frames
    that begin a segment wait until there is what primes the filter; they are in a list of their own."""

    def __init__(self, pad: int, overdue_ms: int | None, highpass: bool) -> None:
        self.pad, self.overdue_ms, self.highpass = pad, overdue_ms, highpass

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "last long, cursor long, segment int, rate int, primed boolean, z1 double, z2 double")
        self.waiting = handle.getListState("waiting", "frame_no long, first_sample long, segment int, missing long, samples binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows), ignore_index=True)
        wrong = every[every["error"].notna()]
        out = [self.row(key, int(f), "error", error=e) for f, e in zip(wrong["frame_no"], wrong["error"], strict=True)]
        fine = every[every["error"].isna()].sort_values("frame_no", kind="stable")
        if len(fine):
            out += self.placed(key, fine)
            if self.overdue_ms is not None:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.overdue_ms)
        yield self.table(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The next frame is overdue: what waits is filtered as if the recording ended here."""
        last, cursor, segment, rate, primed, z1, z2 = self.place.get()
        waiting = self.waited()
        out, state, primed = self.flushed(key, waiting, rate, np.array([z1, z2]), primed)
        self.waiting.clear()
        self.place.update((last, cursor, segment, rate, primed, *map(float, state)))
        yield self.table([*out, self.row(key, last + 1, "overdue", cursor, segment, rate=rate)])

    def placed(self, key: tuple, rows: pd.DataFrame) -> list[tuple]:
        last, cursor, segment, rate, primed, z1, z2 = self.place.get() if self.place.exists() else (None, 0, 0, None, False, 0.0, 0.0)
        state, waiting, out = np.array([z1, z2]), self.waited(), []
        for frame, its_rate, samples in zip(rows["frame_no"], rows["rate"], rows["samples"], strict=True):
            frame, its_rate, x = int(frame), int(its_rate), np.asarray(samples, float)
            if last is not None and frame <= last:
                out.append(self.row(key, frame, "late", rate=its_rate, samples=x))
                continue
            gap = 0 if last is None else frame - last - 1
            if last is not None and (gap or its_rate != rate):
                more, state, _ = self.flushed(key, waiting, rate, state, primed)
                out, waiting, primed, segment = out + more, [], False, segment + 1
            cursor += gap * self.pad
            waiting.append((frame, cursor, segment, gap, x))
            cursor, last, rate = cursor + len(x), frame, its_rate
            if primed or not self.highpass or sum(len(w[4]) for w in waiting) > recursion(float(rate)).lead:
                more, state, primed = self.flushed(key, waiting, rate, state, primed)
                out, waiting = out + more, []
        self.waiting.put([(*w[:4], w[4].tobytes()) for w in waiting]) if waiting else self.waiting.clear()
        if last is not None:
            self.place.update((last, cursor, segment, rate, primed, *map(float, state)))
        return out

    def flushed(self, key: tuple, waiting: list[tuple], rate: int, state: np.ndarray, primed: bool) -> tuple[list[tuple], np.ndarray, bool]:
        """The rows of the frames that wait, the states behind them, and whether the filter is primed."""
        if not waiting:
            return [], state, primed
        if not self.highpass:
            return [self.row(key, frame, "frame", first, segment, gap, rate, x) for frame, first, segment, gap, x in waiting], state, False
        system = recursion(float(rate))
        state = state if primed else system.primed(np.concatenate([w[4] for w in waiting]))
        out = []
        for frame, first, segment, gap, x in waiting:
            y, state = system.run(x, state)
            out.append(self.row(key, frame, "frame", first, segment, gap, rate, x, y))
        return out, state, True

    def waited(self) -> list[tuple]:
        return [(*w[:4], np.frombuffer(w[4])) for w in self.waiting.get()] if self.waiting.exists() else []

    @staticmethod
    def row(key, frame, kind, first=None, segment=None, missing=None, rate=None, samples=None, filtered=None, error=None) -> tuple:
        return (int(key[0]), int(key[1]), frame, kind, first, segment, missing, rate, samples, filtered, error)

    @staticmethod
    def table(rows: list[tuple]) -> pd.DataFrame:
        found = pd.DataFrame(rows, columns=[c.split()[0] for c in PLACED.split(", ")], dtype=object)
        return found.astype({"first_sample": "Int64", "segment": "Int32", "missing": "Int64", "rate": "Int32", "frame_no": "int64", "rec": "int32", "amp_input": "int32"})

    def close(self) -> None:
        pass


def live_frames(spark: SparkSession, paths: list[str], pad: int = 0, overdue_seconds: float | None = None, highpass: bool = True) -> DataFrame:
    """A stream of the frames of growing recordings (rec: the place in `paths`), a row for each frame and input: its first
    sample (frames that are missing before it count `pad` samples each), its segment, missing (frames left out before it),
    samples and filtered samples (0.16 Hz high-pass; without highpass, none, and no frame waits).

    kind: `frame`; `late`, for a number not above the last one, which is passed on unfiltered; `error`, for a frame without
    readable data (amp_input -1); `overdue`, once no frame has come for overdue_seconds. A segment's frames are emitted
    when the 20 s that prime its filter are there, or when it ends: by a gap, a change of rate, or an overdue frame. A
    frame that follows an overdue one without a gap goes on with the same states.

    Writers put a frame's data before its index row. Files are on a file system that all machines have mounted. A task
    holds an input's frames of one batch."""
    spark.dataSource.register(GrowingRecording)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    blobs = spark.readStream.format("growing_recording").load(os.pathsep.join(locate(p) for p in paths))
    rows = decoded(blobs).withColumn("amp_input", F.coalesce("amp_input", F.lit(-1)))
    kept = rows.select("rec", "amp_input", "frame_no", "rate", "samples", "error")
    processor = PlaceAndFilter(pad, None if overdue_seconds is None else int(overdue_seconds * 1000), highpass)
    return kept.groupBy("rec", "amp_input").transformWithStateInPandas(processor, PLACED, "append", "processingTime")
