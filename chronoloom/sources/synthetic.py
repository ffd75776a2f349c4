"""Recordings made from DataFrames: frames are encoded and written to data files in tasks, the index by one of them.

They serve queries, tests and the benchmark where no recorded files are at hand."""

from __future__ import annotations

import os
import sqlite3
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.sources.recording import CHANNEL_TAG, DELTAS, FIRST_TAG, INDEX_SUFFIX, LAYOUT_MAGIC, MAGIC

INDEX = "Offset integer, TimeStamp text, Track integer, Status integer, FileIndex integer, JoinDatabase text, FrameKey blob"
OTHERS = {
    "SchemaUpdateLog": "OldVersion text, NewVersion text, TimeStamp text",
    "MediaHeader": "Key text, Value blob",
    "TrackInfo": "Offset integer, Track integer, Data blob",
    "GapInfo": "Track integer, StartOffset integer, EndOffset integer, StartTime text, EndTime text",
    "MiscInfo": "Key text, TimeStamp text, Value blob",
    "PcTimeSync": "PcTime text, SyncTime text",
}
EVENTS = "EventType text, Text text, StartTime text, EndTime text, StartOffset integer, EndOffset integer, Deleted integer, Priority integer"


def channel_block(amp: int, rate: int, units: np.ndarray) -> bytes:
    """Whole-number units as a first value and deltas, in bytes where they fit."""
    deltas = np.diff(np.asarray(units, np.int64))
    kind = 2 if not len(deltas) or np.abs(deltas).max() < 128 else 1
    data = deltas.astype(DELTAS[kind]).tobytes()
    head = [0] * 16
    head[1], head[4], head[10] = amp, amp, rate
    out = bytearray(94)
    out[:8] = CHANNEL_TAG
    struct.pack_into("<16I", out, 8, *head)
    struct.pack_into("<BIff", out, 81, kind, len(data) + 8, float(units[0]), 1.0)
    return bytes(out) + data


def frame_blob(channels: list[bytes], start: int, end: int) -> bytes:
    head = bytearray(FIRST_TAG)
    struct.pack_into("<I", head, 0, MAGIC)
    struct.pack_into("<IQQ", head, 0x2E, len(channels), start, end)
    return bytes(head) + b"".join(channels)


def amp_layout(kind: int) -> bytes:
    out = bytearray(60)
    out[:4] = LAYOUT_MAGIC
    struct.pack_into("<I", out, 32, kind)
    return bytes(out)


def write_recording(
    frames: DataFrame, folder: str, name: str = "r", files: int = 4, events: DataFrame | None = None, version: str = "2.5", kind: int = 1, correction: tuple[str, str] | None = None
) -> str:
    """Writes a recording of frames (frame_no, ts, start_ticks, end_ticks, amp_input, rate, units: whole numbers below
    2^15 apart) and events (the columns of the events table), and returns its index's path."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name + INDEX_SUFFIX)

    def data_file(rows: pd.DataFrame) -> pd.DataFrame:
        file = f"{name}-{int(rows['__file'].iloc[0])}.ezdata"
        part, found = f"{folder}/{file}.{os.getpid()}", []
        con = sqlite3.connect(part)
        con.execute("create table FrameInfo (DataKey blob, FrameKey blob, Data blob)")
        for no, one in rows.groupby("frame_no"):
            one = one.sort_values("amp_input")
            first, key = one.iloc[0], struct.pack("<QQ", int(no), 7)
            blob = frame_blob([channel_block(int(a), int(r), u) for a, r, u in zip(one["amp_input"], one["rate"], one["units"], strict=True)], int(first["start_ticks"]), int(first["end_ticks"]))
            con.execute("insert into FrameInfo values (x'00', ?, ?)", (key, blob))
            found.append((int(no), str(first["ts"]), file, key))
        con.commit()
        con.close()
        os.replace(part, f"{folder}/{file}")  # a task that is run again replaces its own file
        return pd.DataFrame(found, columns=["frame_no", "ts", "file", "key"])

    def database(target: str, table: str, columns: str, others: list[tuple[str, str, list[tuple]]]):
        def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            part = f"{target}.{os.getpid()}"
            con, n = sqlite3.connect(part), 0
            for t, c, rows in [(table, columns, []), *others]:
                con.execute(f"create table {t} ({c})")
                con.executemany(f"insert into {t} values ({', '.join('?' * len(c.split(',')))})", rows)
            for batch in batches:
                rows = [tuple(None if isinstance(x, float) and x != x else x for x in r) for r in batch.astype(object).itertuples(index=False, name=None)]
                con.executemany(f"insert into {table} values ({', '.join('?' * len(columns.split(',')))})", rows)
                n += len(batch)
            con.commit()
            con.close()
            os.replace(part, target)
            yield pd.DataFrame({"n": [n]})

        return put

    filed = frames.withColumn("__file", F.pmod("frame_no", F.lit(files)).cast("int"))
    rows = filed.groupBy("__file").applyInPandas(data_file, "frame_no long, ts string, file string, key binary")
    listed = rows.select("frame_no", "ts", F.lit(0).alias("track"), F.lit(1).alias("status"), F.lit(0).alias("file_no"), "file", "key")
    known = {
        "SchemaUpdateLog": [("1.0", "2.0", "2024-01-01T00:00:00.0000000"), ("2.0", version, "2025-01-01T00:00:00.0000000")],
        "MiscInfo": [("AMPLAYOUT", "2025-01-01T00:00:00.0000000", amp_layout(kind))],
        "PcTimeSync": [correction] if correction else [],
    }
    others = [(t, c, known.get(t, [])) for t, c in OTHERS.items()]
    listed.coalesce(1).mapInPandas(database(path, "FrameInfo", INDEX, others), "n long").count()
    if events is not None:
        target = path.removesuffix(INDEX_SUFFIX) + ".ezevents"
        events.select(*(c.split()[0] for c in EVENTS.split(", "))).coalesce(1).mapInPandas(database(target, "Events", EVENTS, []), "n long").count()
    return path
