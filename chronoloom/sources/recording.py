"""Recordings kept as SQLite databases: tables as a Python data source, frames decoded by an Arrow kernel.

A recording is an index database, data databases beside it that hold the frames' blobs, and an events database. Small
files share a partition of the scan and large ones are read in ranges of rows, by several tasks.
"""

from __future__ import annotations

import contextlib
import os
import re
import sqlite3
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from chronoloom.functions.signal import UNIT_UV
from chronoloom.functions.timeutil import micros_of_ticks, ticks_of_text

# Fixed values of the frame format.
MAGIC = 0x033149BD
CHANNEL_TAG = bytes.fromhex("ab792193de4225a2")
FIRST_TAG = 0x42
DELTAS = {1: np.dtype("<i2"), 2: np.dtype("i1")}
INDEX_SUFFIX, SUPPORTED_SCHEMAS = ".ezdataindex", ("2.5",)
LAYOUT_MAGIC = bytes.fromhex("0b847557")
TABLES = {
    "FrameInfo": "Offset bigint, TimeStamp string, Track int, Status int, JoinDatabase string, FrameKey binary",
    "FrameData": "FrameKey binary, Data binary",
    "SchemaUpdateLog": "OldVersion string, NewVersion string, TimeStamp string",
    "GapInfo": "Track int, StartOffset bigint, EndOffset bigint, StartTime string, EndTime string",
    "Events": "EventType string, Text string, StartTime string, EndTime string, StartOffset bigint, EndOffset bigint, Deleted int, Priority int",
    "MediaHeader": "Key string, Value binary",
    "TrackInfo": "Offset bigint, Track int, Data binary",
    "MiscInfo": "Key string, TimeStamp string, Value binary",
    "PcTimeSync": "PcTime string, SyncTime string",
}


ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


#: Bytes of a database file, about, that one partition reads; larger files are read in ranges of row numbers.
SPLIT = 64 << 20
#: Most files of one partition.
FILES = 16
#: Comparisons that the database makes itself.
PUSHED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
#: What scan(told=True) adds to a table's columns: the file of a row, and why a file can't be read (in a row of its own).
TOLD = ", file string, error string"


class FilePart(InputPartition):
    """Files with the row numbers to read of each, or none for all."""

    def __init__(self, files: list[tuple[str, tuple[int, int] | None]]) -> None:
        self.files = files


def sqlite_rows(con: sqlite3.Connection, table: str, tests: list[tuple[str, str, object]], rows: tuple[int, int] | None = None) -> Iterator[list[tuple]]:
    """The rows of a table that pass the tests (column, comparison, value), some at a time."""
    name = "FrameInfo" if table == "FrameData" else table
    tests = [*tests, *((("rowid", ">=", rows[0]), ("rowid", "<=", rows[1])) if rows else ())]
    where = " where " + " and ".join(f"{c} {op} ?" for c, op, _ in tests) if tests else ""
    found = con.execute(f"select {', '.join(c.split()[0] for c in TABLES[table].split(', '))} from {name}{where}", [v for _, _, v in tests])
    while some := found.fetchmany(256):
        yield some


def batch_of(table: str, rows: list[tuple], *more: tuple[str, str | None]) -> pa.RecordBatch:
    columns = [c.split() for c in TABLES[table].split(", ")]
    arrays = [pa.array([r[i] for r in rows], ARROW[kind]) for i, (_, kind) in enumerate(columns)]
    return pa.RecordBatch.from_arrays([*arrays, *(pa.array([x] * len(rows), pa.string()) for _, x in more)], names=[*(c for c, _ in columns), *(c for c, _ in more)])


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.files = [f for f in options["path"].split(os.pathsep) if f]
        self.table = options["table"]
        self.optional, self.told = (options.get(o, "false") == "true" for o in ("optional", "told"))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of a table's whole numbers and texts go to the database; Spark makes the others."""
        kinds = dict(c.split() for c in TABLES[self.table].split(", "))
        for f in filters:
            op = PUSHED.get(type(f))
            if op and len(f.attribute) == 1 and kinds.get(f.attribute[0]) in ("bigint", "int", "string") and isinstance(f.value, int | str):
                self.tests.append((f.attribute[0], op, f.value))
            else:
                yield f

    def partitions(self) -> list[FilePart]:
        parts: list[list[tuple[str, tuple[int, int] | None]]] = []
        room = 0
        for path in self.files:
            size = os.path.getsize(path) if os.path.exists(path) else 0
            if self.optional and not os.path.exists(path):
                continue
            if size > SPLIT and (ends := self.rows_in(path)):
                low, high, n = *ends, -(-size // SPLIT)
                cuts = [low + (high + 1 - low) * k // n for k in range(n + 1)]
                parts += [[(path, (x, y - 1))] for x, y in zip(cuts, cuts[1:], strict=False) if x < y]
                room = 0
            elif room >= size and parts and len(parts[-1]) < FILES:
                parts[-1].append((path, None))
                room -= size
            else:
                parts.append([(path, None)])
                room = SPLIT - size
        return [FilePart(p) for p in parts]

    def rows_in(self, path: str) -> tuple[int, int] | None:
        """The first and last row number: two look-ups in the table's tree."""
        try:
            with contextlib.closing(opened(path)) as con:
                ends = con.execute(f"select min(rowid), max(rowid) from {'FrameInfo' if self.table == 'FrameData' else self.table}").fetchone()
                return ends if ends[0] is not None else None
        except sqlite3.Error:
            return None

    def read(self, partition: FilePart | None) -> Iterator[pa.RecordBatch]:
        for path, rows in partition.files if partition else ():  # none is Spark's stand-in where there is no file
            try:
                with contextlib.closing(opened(path)) as con:
                    for some in sqlite_rows(con, self.table, self.tests, rows):
                        yield batch_of(self.table, some, *((("file", path), ("error", None)) if self.told else ()))
            except sqlite3.Error as e:
                if not self.told:
                    raise
                yield batch_of(self.table, [(None,) * len(TABLES[self.table].split(", "))], ("file", path), ("error", f"{type(e).__name__}: {e}"))


def opened(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro&immutable=1", uri=True)


class SqliteTable(DataSource):
    """format('recording_table').option('table', ...).load(paths)"""

    @classmethod
    def name(cls) -> str:
        return "recording_table"

    def schema(self) -> str:
        return TABLES[self.options["table"]] + (TOLD if self.options.get("told") == "true" else "")

    def reader(self, schema) -> SqliteReader:
        return SqliteReader(self.options)


def locate(path: str) -> str:
    """The index database: the file itself, or the one hit in the first folder of the usual ones that has any."""
    if os.path.isfile(path):
        return path
    for folder in ("", "native-export/CadLink/Data", "CadLink/Data", "Data"):
        at = os.path.join(path, folder)
        found = sorted(x for x in os.listdir(at) if x.endswith(INDEX_SUFFIX)) if os.path.isdir(at) else []
        if len(found) > 1:
            raise ValueError(f"several recordings in {at}")
        if found:
            return os.path.join(at, found[0])
    raise FileNotFoundError(f"no recording under {path}")


def discover(folder: str) -> list[str]:
    return sorted(os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(INDEX_SUFFIX))


def scan(spark: SparkSession, table: str, *paths: str, optional: bool = False, told: bool = False) -> DataFrame:
    """A table of databases. Comparisons of whole numbers and texts are asked of the databases themselves. told: with
    `file` and `error`; a file that can't be read is then a row with its error. Paths with a scheme (hdfs://..., s3a://...)
    are read by Spark, and their databases opened from their bytes."""
    if any("://" in p and not p.startswith("file:") for p in paths):
        return _scan_bytes(spark, table, list(paths), told)
    spark.dataSource.register(SqliteTable)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("recording_table").option("table", table).option("optional", str(optional).lower()).option("told", str(told).lower())
    return reader.load(os.pathsep.join(re.sub("^file:/*", "/", p) for p in paths))


def _scan_bytes(spark: SparkSession, table: str, paths: list[str], told: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with contextlib.closing(sqlite3.connect(":memory:")) as con:
                    con.deserialize(content)
                    for some in sqlite_rows(con, table, []):
                        yield batch_of(table, some, *((("file", path), ("error", None)) if told else ()))

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInArrow(run, TABLES[table] + (TOLD if told else ""))


def schema_version(log: DataFrame) -> DataFrame:
    return log.agg(F.max_by("NewVersion", "TimeStamp").alias("version"))


def check_supported(spark: SparkSession, index_path: str, allow: bool = False) -> str | None:
    """The schema version that the index was last brought to; one that isn't supported is an error unless allowed."""
    version = schema_version(scan(spark, "SchemaUpdateLog", index_path)).first()[0]
    if version not in SUPPORTED_SCHEMAS and not allow:
        raise ValueError(f"schema version {version or 'unknown'} is not supported")
    return version


def value_of(spark: SparkSession, index_path: str, table: str, key: str) -> bytes | None:
    """The value of a key in MediaHeader or MiscInfo, its earliest one where it has several."""
    rows = scan(spark, table, index_path).where(F.col("Key") == key)
    value = F.min_by("Value", "TimeStamp") if table == "MiscInfo" else F.first("Value")
    return rows.agg(value).first()[0]


def amp_type(layout: Column) -> Column:
    """The amplifier's type of a layout: its 32-bit number at byte 32, least byte first, or null if it is too short or of
    another form."""
    number = F.concat(*(F.substring(layout, 33 + k, 1) for k in (3, 2, 1, 0)))
    return F.when((F.octet_length(layout) >= 36) & (F.substring(layout, 1, len(LAYOUT_MAGIC)) == F.lit(LAYOUT_MAGIC)), F.conv(F.hex(number), 16, 10).cast("int"))


def clock_correction(spark: SparkSession, index_path: str) -> int:
    """Microseconds between both clocks at their first comparison (0 if there is none)."""
    return scan(spark, "PcTimeSync", index_path).agg(correction()).first()[0]


def correction() -> Column:
    """clock_correction() as an aggregate of PcTimeSync."""
    first = F.min_by(F.struct("PcTime", "SyncTime"), "PcTime")
    return F.coalesce(micros_of_ticks(ticks_of_text(first["PcTime"])) - micros_of_ticks(ticks_of_text(first["SyncTime"])), F.lit(0)).cast("long")


def channel_blocks(blob: bytes) -> tuple[int | None, int | None, list[tuple[int, int, np.ndarray]]]:
    """Start and end ticks (none on auxiliary tracks) and (input, rate, samples in microvolts) of each channel."""
    if len(blob) < 4 or struct.unpack_from("<I", blob)[0] != MAGIC:
        raise ValueError("not a frame")
    at, out = blob.find(CHANNEL_TAG), []
    count = start = end = None
    if at == FIRST_TAG:
        count, start, end = struct.unpack_from("<IQQ", blob, 0x2E)
    while at >= 0:
        head = struct.unpack_from("<16I", blob, at + 8)
        kind, length, first, scale = struct.unpack_from("<BIff", blob, at + 81)
        if kind not in DELTAS:
            raise ValueError(f"unknown delta type {kind}")
        size = DELTAS[kind].itemsize
        deltas = np.frombuffer(blob, DELTAS[kind], (length - 8) // size, at + 94)
        units = np.empty(len(deltas) + 1)
        units[0] = first
        units[1:] = first + np.cumsum(deltas, dtype=np.int64) * float(scale)
        out.append((head[4], head[10], units * UNIT_UV))
        at = blob.find(CHANNEL_TAG, at + 94 + length - 8)
    if not out or count is not None and len(out) != count:
        raise ValueError("a frame without its channels")
    return start, end, out


def decode_frame(blob: bytes) -> tuple[int | None, int | None, list[tuple[int, int, list[float]]]]:
    """channel_blocks() with plain lists."""
    start, end, channels = channel_blocks(blob)
    return start, end, [(a, r, x.tolist()) for a, r, x in channels]


def index(spark: SparkSession, path: str, track: int = 0) -> DataFrame:
    """frame_no, ts, JoinDatabase and FrameKey of a track's frames."""
    rows = scan(spark, "FrameInfo", locate(path))
    return rows.where(F.col("Track") == track).select(F.col("Offset").alias("frame_no"), F.col("TimeStamp").alias("ts"), "JoinDatabase", "FrameKey")


def data_files(spark: SparkSession, path: str, track: int = 0) -> DataFrame:
    """file and present: the data files that the index names, and whether they are there."""
    folder = os.path.dirname(locate(path))
    there = spark.createDataFrame([(f,) for f in os.listdir(folder)], "__file string")
    named = index(spark, path, track).select(F.col("JoinDatabase").alias("file")).distinct()
    return named.join(F.broadcast(there), F.col("file") == F.col("__file"), "left").select("file", F.col("__file").isNotNull().alias("present"))


def frames(spark: SparkSession, path: str, track: int = 0) -> DataFrame:
    """frame_no, ts, start_ticks, end_ticks, amp_input, rate and samples (microvolts): one row for each frame and
    channel. The index, which has no blobs, meets the blobs by key; a frame without a blob is an error."""
    wanted = index(spark, path, track)
    folder = os.path.dirname(locate(path))
    files = [os.path.join(folder, r.file) for r in wanted.select(F.col("JoinDatabase").alias("file")).distinct().orderBy("file").collect()]
    blobs = scan(spark, "FrameData", *files) if files else spark.createDataFrame([], TABLES["FrameData"])
    met = wanted.join(blobs, "FrameKey", "left").select(F.lit(0).alias("rec"), "frame_no", "ts", "Data")
    found = decoded(met)
    fine = F.assert_true(F.col("error").isNull(), F.col("error")).isNull()
    return found.where(F.coalesce(fine, F.lit(True))).drop("rec", "error")


FRAMES = "rec int, frame_no long, ts string, start_ticks long, end_ticks long, amp_input int, rate int, samples array<double>, error string"


def decoded(blobs: DataFrame) -> DataFrame:
    """A row for each channel of each frame of blobs (rec, frame_no, ts, Data), or one with an error where there is no
    blob or it is none of a frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found, errors = [], []
                for no, blob in zip(part.column(1).to_pylist(), part.column(3), strict=True):
                    error = None if blob.is_valid else f"no data for frame {no}"
                    try:
                        got = channel_blocks(blob.as_py()) if blob.is_valid else None
                    except (ValueError, struct.error) as e:
                        got, error = None, f"frame {no}: {e}"
                    found.append(got or (None, None, [(None, None, np.empty(0))]))
                    errors.append(error)
                of = np.repeat(np.arange(part.num_rows), [len(f[2]) for f in found])
                flat = [c for f in found for c in f[2]]
                ends = np.cumsum([0, *(len(c[2]) for c in flat)]).astype(np.int32)
                samples = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([c[2] for c in flat])))
                ticks = [pa.array([found[k][i] for k in of], pa.int64()) for i in (0, 1)]
                numbers = [pa.array([c[i] for c in flat], pa.int32()) for i in (0, 1)]
                taken = [part.column(i).take(pa.array(of)) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*taken, *ticks, *numbers, samples, pa.array([errors[k] for k in of], pa.string())], names=[c.split()[0] for c in FRAMES.split(", ")])

    return blobs.select("rec", "frame_no", "ts", "Data").mapInArrow(run, FRAMES)


def recorded_events(spark: SparkSession, path: str) -> DataFrame:
    """The events beside the index, none if there is no such file; deleted is false where it is null."""
    return shown(scan(spark, "Events", locate(path).removesuffix(INDEX_SUFFIX) + ".ezevents", optional=True))


def shown(events: DataFrame, *more: str) -> DataFrame:
    return events.select(*more, "EventType", "Text", "StartTime", "EndTime", "StartOffset", "EndOffset", (F.coalesce("Deleted", F.lit(0)) != 0).alias("deleted"))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Each track's frames, first and last number, data files, statuses and missing numbers."""
    index = scan(spark, "FrameInfo", locate(path))
    return index.groupBy("Track").agg(
        F.count("*").alias("frames"), F.min("Offset").alias("first"), F.max("Offset").alias("last"), F.sort_array(F.collect_set("JoinDatabase")).alias("files"),
        F.sort_array(F.collect_set("Status")).alias("statuses"), (F.max("Offset") - F.min("Offset") + 1 - F.count_distinct("Offset")).alias("missing"),
    )
