"""EDF and EDF+ files: a scan of records in parallel, annotations, header fields, and a writer.

A range of records is an input partition, read as Arrow batches. Patient and recording fields are never returned. The
writer's tasks put their records into the file themselves; it takes its name when all have.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from chronoloom.operators.asof import asof_or_first
from chronoloom.operators.frames import out_of_order

# Fixed values of the file format: fields of a signal with their widths, and the label of annotation signals.
FIELDS = {"label": 16, "transducer": 80, "unit": 8, "pmin": 8, "pmax": 8, "dmin": 8, "dmax": 8, "prefilter": 80, "samples": 8, "reserved": 32}
ANNOTATIONS = "EDF Annotations"
MONTHS = "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split()
#: Records of one input partition.
RANGE = 600


@dataclass
class Header:
    start: datetime
    size: int
    kind: str
    n_records: int
    seconds: float
    signals: list[dict] = field(default_factory=list)

    @property
    def record_bytes(self) -> int:
        return 2 * sum(s["samples"] for s in self.signals)


def read_header(path: str) -> Header:
    """A count of records that is unknown or more than the file holds is taken from the file's length."""
    with open(path, "rb") as f:
        fixed = f.read(256).decode("latin-1")
        n = int(fixed[252:256])
        per_signal = f.read(256 * n).decode("latin-1")
    columns, at = {}, 0
    for name, width in FIELDS.items():
        columns[name] = [per_signal[at + k * width : at + (k + 1) * width].strip() for k in range(n)]
        at += n * width
    signals = [{name: columns[name][k] for name in FIELDS} for k in range(n)]
    for s in signals:
        s |= {"pmin": float(s["pmin"]), "pmax": float(s["pmax"]), "dmin": int(s["dmin"]), "dmax": int(s["dmax"]), "samples": int(s["samples"])}
    day, month, year = (int(x) for x in fixed[168:176].split("."))
    hour, minute, second = (int(x) for x in fixed[176:184].split("."))
    start = datetime(year + (1900 if year >= 85 else 2000), month, day, hour, minute, second)
    head = Header(start, int(fixed[184:192]), fixed[192:236].strip(), int(fixed[236:244]), float(fixed[244:252]), signals)
    held = (os.path.getsize(path) - head.size) // max(1, head.record_bytes)
    if not 0 <= head.n_records <= held:
        head.n_records = held
    return head


SCHEMA = "path string, record long, signal_no int, label string, unit string, step double, pmin double, dmin int, digital array<int>, notes binary"
SCHEMA_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


class Records(InputPartition):
    def __init__(self, path: str, first: int, n: int) -> None:
        self.path, self.first, self.n = path, first, n


class EdfReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.files = options["path"].split(os.pathsep)

    def partitions(self) -> list[Records]:
        return [Records(p, k, min(RANGE, n - k)) for p in self.files for n in [read_header(p).n_records] for k in range(0, n, RANGE)]

    def read(self, partition: Records | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's stand-in where there is no file
            return
        head = read_header(partition.path)
        starts = np.cumsum([0, *(2 * s["samples"] for s in head.signals)])
        with open(partition.path, "rb") as f:
            f.seek(head.size + partition.first * head.record_bytes)
            for at in range(partition.first, partition.first + partition.n, 16):
                n = min(16, partition.first + partition.n - at)
                block = np.frombuffer(f.read(n * head.record_bytes), np.uint8).reshape(n, head.record_bytes)
                for no, s in enumerate(head.signals):
                    raw, notes = np.ascontiguousarray(block[:, starts[no] : starts[no + 1]]), s["label"] == ANNOTATIONS
                    values = np.empty(0, np.int32) if notes else raw.view("<i2").ravel().astype(np.int32)
                    ends = np.arange(n + 1, dtype=np.int32) * (0 if notes else s["samples"])
                    same = lambda x, kind: pa.array([x] * n, kind)
                    step = 0.0 if notes else (s["pmax"] - s["pmin"]) / (s["dmax"] - s["dmin"])
                    columns = [
                        same(partition.path, pa.string()), pa.array(np.arange(at, at + n)), same(no, pa.int32()), same(s["label"], pa.string()), same(s["unit"], pa.string()),
                        same(step, pa.float64()), same(float(s["pmin"]), pa.float64()), same(int(s["dmin"]), pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(values)),
                        pa.array([r.tobytes() if notes else None for r in raw], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=SCHEMA_NAMES)


class Edf(DataSource):
    """format('edf'): load(paths) has a row for each record and signal; save(folder) takes rows of file, at and body"""

    @classmethod
    def name(cls) -> str:
        return "edf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> EdfReader:
        return EdfReader(self.options)

    def writer(self, schema, overwrite: bool) -> EdfWriter:
        return EdfWriter(self.options["path"], overwrite)


def scan(spark: SparkSession, *paths: str) -> DataFrame:
    spark.dataSource.register(Edf)
    return spark.read.format("edf").load(os.pathsep.join(paths))


def samples(records: DataFrame) -> DataFrame:
    """path, record, signal_no, label and values (physical units) of the signals that are no annotations."""
    physical = F.transform("digital", lambda d: (d - F.col("dmin")) * F.col("step") + F.col("pmin"))
    return records.where(F.col("notes").isNull()).select("path", "record", "signal_no", "label", physical.alias("values"))


def tals(records: DataFrame) -> DataFrame:
    """path, record, place, onset, duration and texts of each entry of the annotation signals."""
    held = records.where(F.col("notes").isNotNull()).select("path", "record", F.posexplode(F.split(F.decode("notes", "UTF-8"), "\x00")).alias("place", "tal"))
    held = held.where("tal <> ''").withColumn("p", F.split("tal", "\x14")).withColumn("when", F.split(F.get("p", F.lit(0)), "\x15"))
    onset, duration = (F.try_element_at("when", F.lit(k)).try_cast("double") for k in (1, 2))
    return held.select("path", "record", "place", onset.alias("onset"), duration.alias("duration"), F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))).alias("texts")).where("onset is not null")


def annotations(records: DataFrame) -> DataFrame:
    """path, record, onset, duration (null if none) and text of each annotation; entries without a valid onset are
    skipped, those without text only keep time."""
    return tals(records).select("path", "record", "onset", "duration", F.explode("texts").alias("text")).where("text <> ''")


def record_onsets(records: DataFrame) -> DataFrame:
    """path, record and onset of each record: that of its first entry without a text."""
    silent = tals(records).where(F.forall("texts", lambda t: t == ""))
    return silent.groupBy("path", "record").agg(F.min_by("onset", "place").alias("onset"))


def number(value: float, width: int = 8) -> bytes:
    """The number with as many digits as fit into the field."""
    if value == int(value) and len(str(int(value))) <= width:
        return f"{int(value):<{width}}".encode()
    for digits in range(width, 0, -1):
        text = f"{value:.{digits}g}"
        if len(text) <= width and "e" not in text:
            return f"{text:<{width}}".encode()
    raise ValueError(f"{value} does not fit into {width} characters")


def header(start: datetime, kind: str, seconds: float, signals: list[dict], patient: str = "X X X X", recording: str = "X X X", n_records: int = -1) -> bytes:
    """The header of a file of kind "edf", "edf+c" or "edf+d". A count of records of -1 is unknown as yet. Fields are
    laid out as one table of values and widths, which is checked as a whole."""
    if not 1985 <= start.year <= 2084:
        raise ValueError("the year must be from 1985 to 2084")
    plus = kind != "edf"
    dated = f"Startdate {start:%d}-{MONTHS[start.month - 1]}-{start:%Y} {recording}"
    line = [("0", 8), (patient if plus else "", 80), (dated if plus else "", 80), (f"{start:%d.%m.%y%H.%M.%S}", 16), (str(256 + 256 * len(signals)), 8), (kind.upper() if plus else "", 44), (str(n_records), 8), (number(seconds).decode(), 8), (str(len(signals)), 4)]
    worded = {"label", "transducer", "unit", "prefilter", "reserved"}
    line += [(str(s.get(name) or "") if name in worded else number(s[name], width).decode(), width) for name, width in FIELDS.items() for s in signals]
    if over := [text for text, width in line if len(text) > width]:
        raise ValueError(f"{over[0]!r} does not fit into its field")
    return "".join(text.ljust(width) for text, width in line).encode("ascii", "replace")


def tal(onset: float, duration: float | None, text: str) -> bytes:
    """One entry of an annotation signal."""
    def short(x: float) -> str:
        return f"{x:.6f}".rstrip("0").rstrip(".")

    length = "" if duration is None or not duration >= 0 else f"\x15{short(duration)}"
    return f"{'+' if onset >= 0 else ''}{short(onset)}{length}\x14{text.translate(MARKS)}\x14\x00".encode()


#: Marks inside an annotation signal, which no text may hold.
MARKS = str.maketrans("\x00\x14\x15", "   ")


def body(digital: list[np.ndarray], sizes: list[int], room: int, onset: float, notes: list[dict] | None, record: int) -> bytes:
    """A record: its signals' samples, and if there is room (samples of the annotation signal) its onset and notes."""
    if [len(x) for x in digital] != sizes or onset is None or onset != onset:
        raise ValueError(f"record {record} is not whole")
    out = b"".join(np.asarray(x, "<i2").tobytes() for x in digital)
    if room:
        texts = tal(onset, None, "") + b"".join(tal(x["onset"], x["duration"], x["text"]) for x in notes or ())
        out += texts.ljust(2 * room, b"\x00")
    return out


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: bytes and the last one's end, by file."""

    files: dict[str, tuple[int, int]]


class EdfWriter(DataSourceArrowWriter):
    """Rows of file, at and body: bytes of EDF files at their places. All records of a file have one size, so that tasks
    write theirs straight into the file, under a name of this job's own; a task that is run again, or twice at a time,
    writes the same bytes to the same places. The driver, which sees no samples, looks whether a file has holes, sets its
    count of records and gives it its name; if anything fails, nothing stays."""

    OPEN = 64

    def __init__(self, folder: str, overwrite: bool) -> None:
        self.folder, self.overwrite, self.job = folder, overwrite, uuid.uuid4().hex

    def part(self, file: str) -> str:
        return os.path.join(self.folder, f".{file}.{self.job}.part")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        open_: dict[str, int] = {}
        done: dict[str, tuple[int, int]] = {}
        try:
            for some in _parts(iterator):
                for file, at, data in zip(*(some.column(c).to_pylist() for c in ("file", "at", "body")), strict=True):
                    if file not in open_:
                        if len(open_) >= self.OPEN:
                            os.close(open_.pop(next(iter(open_))))
                        open_[file] = os.open(self.part(file), os.O_CREAT | os.O_RDWR, 0o644)
                    os.pwrite(open_[file], data, at)
                    size, end = done.get(file, (0, 0))
                    done[file] = size + len(data), max(end, at + len(data))
        finally:
            for f in open_.values():
                os.close(f)
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        sums: dict[str, tuple[int, int]] = {}
        for m in messages:
            for file, (size, end) in (m.files if m else {}).items():
                before = sums.get(file, (0, 0))
                sums[file] = before[0] + size, max(before[1], end)
        for file, (size, end) in sums.items():
            head = read_header(self.part(file))
            if size != end or head.size + head.n_records * head.record_bytes != end:
                raise ValueError(f"{file} is not whole: {size} bytes up to {end}")
            if os.path.exists(os.path.join(self.folder, file)) and not self.overwrite:
                raise FileExistsError(os.path.join(self.folder, file))
            with open(self.part(file), "r+b") as f:
                f.seek(236)
                f.write(number(head.n_records))
        for file in sums:
            os.replace(self.part(file), os.path.join(self.folder, file))

    def abort(self, messages: list[Written | None]) -> None:
        for name in os.listdir(self.folder):
            if name.endswith(f".{self.job}.part"):
                os.remove(os.path.join(self.folder, name))


def write_files(rows: DataFrame, folder: str, overwrite: bool = False) -> None:
    """rows (file, at, body) as files in a folder that all machines have mounted: df.write.format("edf")."""
    rows.sparkSession.dataSource.register(Edf)
    rows.select("file", "at", "body").write.format("edf").mode("overwrite" if overwrite else "append").save(folder)


NOTE = "struct<onset:double,duration:double,text:string>"


def write(
    digital: DataFrame, path: str, start: datetime, seconds: float, signals: list[dict], notes: DataFrame | None = None,
    overwrite: bool = False, kind: str | None = None, onsets: DataFrame | None = None, patient: str = "X X X X", recording: str = "X X X",
) -> int:
    """Writes an EDF file ("edf"), or EDF+C or EDF+D ("edf+c", "edf+d"; by default EDF+C with notes, else EDF), and
    returns its number of records.

    digital: record, signal_no and digital (array of int16), every signal in every record from 0 on. notes: onset (from
    the data's start), duration and text. onsets, for EDF+D: record and onset, rising by a record's duration at least.
    The file is written by EdfWriter's tasks and takes its name when it is whole; an existing one is only replaced with
    `overwrite`. EDF has no notes and starts on a whole second; years from 1985 to 2084 can be written.
    """
    kind = kind or ("edf" if notes is None else "edf+c")
    if kind not in ("edf", "edf+c", "edf+d"):
        raise ValueError(f"no kind of EDF file: {kind}")
    if kind == "edf" and (notes is not None or start.microsecond):
        raise ValueError("EDF holds no annotations and starts on a whole second")
    if (kind == "edf+d") != (onsets is not None):
        raise ValueError("the onsets of records are for EDF+D, which needs them")
    if os.path.exists(path) and not overwrite:
        raise FileExistsError(path)
    spark, (folder, file) = digital.sparkSession, os.path.split(path)
    sizes, within = [s["samples"] for s in signals], start.microsecond / 1e6
    header(start, kind, seconds, signals, patient, recording)  # what doesn't fit is said before anything runs
    packed = digital.groupBy("record").agg(F.sort_array(F.collect_list(F.struct("signal_no", "digital"))).alias("s"))
    if onsets is not None:
        late = out_of_order(onsets.withColumn("__one", F.lit(0)), "__one", "record", "onset", seconds)
        if late.limit(1).count():
            raise ValueError("a record begins before the one before it ends")
        packed = packed.join(onsets.select("record", F.col("onset").cast("double").alias("onset")), "record", "left")
    else:
        packed = packed.withColumn("onset", F.col("record") * F.lit(float(seconds)))
    room = 0
    if kind != "edf":
        packed, room = _with_notes(packed, notes, seconds, onsets)
    listed = [*signals, note_signal(room)] if room else signals
    head, size = header(start, kind, seconds, listed, patient, recording), 2 * (sum(sizes) + room)

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _parts(batches):
            rows = []
            for row in some.to_pandas().itertuples(index=False):
                notes = [{"onset": x["onset"] + within, "duration": x["duration"], "text": x["text"]} for x in (row.notes if row.notes is not None else ())]
                rows.append((file, len(head) + row.record * size, body([x["digital"] for x in row.s], sizes, room, row.onset + within, notes, row.record)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.binary()))], names=["file", "at", "body"])

    rows = packed.select("record", "s", "onset", F.col("notes") if room else F.lit(None).cast(f"array<{NOTE}>").alias("notes")).mapInArrow(bodies, ROWS)
    write_files(rows.unionByName(spark.createDataFrame([(file, 0, head)], ROWS)), folder or ".", overwrite)
    return read_header(path).n_records


#: Records that a task has as Python objects at a time.
HELD = 64


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, which Spark limits by bytes, in parts of HELD rows: as objects they take many times that."""
    for batch in batches:
        for at in range(0, batch.num_rows, HELD):
            yield batch.slice(at, HELD)


#: The rows that EdfWriter takes.
ROWS = "file string, at long, body binary"


def note_signal(room: int) -> dict:
    return {"label": ANNOTATIONS, "unit": "", "pmin": -1, "pmax": 1, "dmin": -32768, "dmax": 32767, "samples": room}


def _with_notes(packed: DataFrame, notes: DataFrame | None, seconds: float, onsets: DataFrame | None) -> tuple[DataFrame, int]:
    """packed with the notes of each record, sorted, and the samples that the longest record's notes take. A note
    belongs to the last record that begins at or before it, or else to the first."""
    if notes is None:
        return packed.withColumn("notes", F.lit(None).cast(f"array<{NOTE}>")), 30
    held = notes.select(F.col("onset").cast("double").alias("onset"), F.col("duration").cast("double").alias("duration"), "text")
    if onsets is None:
        last = F.broadcast(packed.agg(F.max("record").alias("last")))
        of = held.crossJoin(last).withColumn("record", F.least("last", F.greatest(F.floor(F.col("onset") / seconds + 1e-9), F.lit(0)).cast("long")))
    else:
        of = asof_or_first(held.withColumn("__one", F.lit(0)), onsets.select("record", (F.col("onset") - 1e-9).alias("__start"), F.lit(0).alias("__one")), "__one", "onset", "__start", ["record"])
    of = of.groupBy("record").agg(F.sort_array(F.collect_list(F.struct("onset", "duration", "text"))).alias("notes"))
    longest = of.agg(F.max(F.aggregate("notes", F.lit(0).cast("long"), lambda a, n: a + F.octet_length(n["text"]) + 40))).first()[0]
    return packed.join(of, "record", "left"), max(30, (64 + (longest or 0) + 1) // 2)
