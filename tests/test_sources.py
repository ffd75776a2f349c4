"""Readers and writers: bytes typed by hand, filters that databases make, ranges of rows, tasks that fail or run twice."""

import os
import sqlite3
import struct
from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThanOrEqual

from chronoloom.functions import signal as sig
from chronoloom.operators import filters
from chronoloom.sources import edf, recording, tables

# One frame of two channels at 4 Hz: input 3 in byte deltas (10, 12, 9, 9), input 40 in word deltas at scale 0.5 (-1, 299, -1).
GOLDEN = bytes.fromhex(
    "bd493103" + "00" * 42 + "02000000" + "00e1f50500000000" + "8096980000000000"
    # tag; 16 words: channel 1, input 3, rate 4; then type 2, length 8 + 3, first 10.0, scale 1.0, deltas +2 -3 0
    + "ab792193de4225a2" + "00000000" + "01000000" + "00000000" * 2 + "03000000" + "00000000" * 5 + "04000000" + "00000000" * 5 + "00" * 9
    + "02" + "0b000000" + "00002041" + "0000803f" + "02fd00"
    # channel 2, input 40, rate 4; type 1, length 8 + 4, first -1.0, scale 0.5, deltas +600 -600
    + "ab792193de4225a2" + "00000000" + "02000000" + "00000000" * 2 + "28000000" + "00000000" * 5 + "04000000" + "00000000" * 5 + "00" * 9
    + "01" + "0c000000" + "000080bf" + "0000003f" + "5802" + "a8fd"
)


def test_golden_frame(spark):
    start, end, channels = recording.channel_blocks(GOLDEN)
    assert (start, end) == (100_000_000, 10_000_000)
    assert [(a, r, [round(x / 0.72998046, 6) for x in v]) for a, r, v in channels] == [(3, 4, [10.0, 12.0, 9.0, 9.0]), (40, 4, [-1.0, 299.0, -1.0])]
    tables.register(spark)
    spark.createDataFrame([(1, GOLDEN), (2, None)], "k int, data binary").createOrReplaceTempView("golden")
    rows = spark.sql("select k, d.amp_input, d.samples from golden, lateral frame_decode(data) d order by amp_input").collect()
    assert [(r.k, r.amp_input, len(r.samples)) for r in rows] == [(1, 3, 4), (1, 40, 3)]
    broken = spark.createDataFrame([(0, 1, "t", GOLDEN), (0, 2, "t", GOLDEN[:150]), (0, 3, "t", None), (0, 4, "t", b"xx")], "rec int, frame_no long, ts string, Data binary")
    got = {(r.frame_no, r.amp_input): r.error for r in recording.decoded(broken).collect()}
    assert got[1, 3] is None and got[3, None] == "no data for frame 3" and got[4, None] == "frame 4: not a frame" and (2, None) in got


def test_golden_edf(spark, tmp_path):
    fields = ["0".ljust(8), "X X X X".ljust(80), "Startdate 02-MAR-1999 X X X".ljust(80), "02.03.99", "04.05.06", "768".ljust(8), "EDF+C".ljust(44), "1".ljust(8), "1".ljust(8), "2".ljust(4)]
    fields += ["EEG A-Cz".ljust(16), "EDF Annotations".ljust(16), " " * 160, "uV".ljust(8), " " * 8, "-10".ljust(8), "-1".ljust(8), "10".ljust(8), "1".ljust(8), "-100".ljust(8), "-32768".ljust(8), "100".ljust(8), "32767".ljust(8), " " * 160, "3".ljust(8), "15".ljust(8), " " * 64]
    data = "".join(fields).encode() + struct.pack("<3h", -100, 0, 50) + b"+0\x14\x14\x00+0.5\x150.25\x14blink\x14\x00".ljust(30, b"\x00")
    (tmp_path / "g.edf").write_bytes(data)
    head = edf.read_header(str(tmp_path / "g.edf"))
    assert head.start == datetime(1999, 3, 2, 4, 5, 6) and head.n_records == 1 and head.size == 768
    records = edf.scan(spark, str(tmp_path / "g.edf"))
    assert edf.samples(records).first()["values"] == [-10.0, 0.0, 5.0]
    assert [tuple(r)[2:] for r in edf.annotations(records).collect()] == [(0.5, 0.25, "blink")]
    records.createOrReplaceTempView("golden_edf")
    tables.register(spark)
    rows = spark.sql("select t.* from golden_edf, lateral tal_parse(notes) t order by place").collect()
    assert [tuple(r) for r in rows] == [(0, 0.0, None, ""), (1, 0.5, 0.25, "blink")]
    # and the writer gives just these bytes
    df = spark.createDataFrame([(0, 0, [-100, 0, 50])], "record long, signal_no int, digital array<int>")
    notes = spark.createDataFrame([(0.5, 0.25, "blink")], "onset double, duration double, text string")
    edf.write(df, str(tmp_path / "w.edf"), datetime(1999, 3, 2, 4, 5, 6), 1.0, [{"label": "EEG A-Cz", "unit": "uV", "pmin": -10, "pmax": 10, "dmin": -100, "dmax": 100, "samples": 3}], notes)
    written = (tmp_path / "w.edf").read_bytes()
    ours = edf.read_header(str(tmp_path / "w.edf"))
    assert written[:168] == data[:168] and written[768:774] == data[768:774] and written[774:].rstrip(b"\x00") == data[774:].rstrip(b"\x00") and ours.n_records == 1


@pytest.fixture
def database(tmp_path):
    path = str(tmp_path / "x.ezdataindex")
    con = sqlite3.connect(path)
    con.execute("create table FrameInfo (Offset integer, TimeStamp text, Track integer, Status integer, JoinDatabase text, FrameKey blob)")
    con.executemany("insert into FrameInfo values (?, 't', ?, 1, 'f', x'00')", [(k, k % 3) for k in range(1000)])
    con.commit()
    con.close()
    return path


def test_filters_are_made_by_the_database(spark, database):
    reader = recording.SqliteReader({"path": database, "table": "FrameInfo"})
    left = list(reader.pushFilters([EqualTo(("Track",), 0), GreaterThanOrEqual(("Offset",), 100), LessThanOrEqual(("Offset",), 199), In(("Track",), (0, 1)), EqualTo(("FrameKey",), b"x")]))
    assert len(left) == 2
    read = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    assert read == len([k for k in range(100, 200) if k % 3 == 0])
    df = recording.scan(spark, "FrameInfo", database).where("Track = 0 and Offset between 100 and 199 and FrameKey = x'00'")
    assert df.count() == read


def test_large_files_are_read_in_ranges(spark, database, monkeypatch):
    monkeypatch.setattr(recording, "SPLIT", 8192)
    reader = recording.SqliteReader({"path": database, "table": "FrameInfo"})
    parts = reader.partitions()
    sizes = [sum(b.num_rows for b in reader.read(p)) for p in parts]
    assert len(parts) > 2 and sum(sizes) == 1000 and max(sizes) < 2 * min(sizes)


def test_files_that_are_no_databases(spark, database, tmp_path):
    (tmp_path / "bad.ezdataindex").write_bytes(b"nothing of the kind" * 100)
    rows = recording.scan(spark, "FrameInfo", database, str(tmp_path / "bad.ezdataindex"), told=True)
    assert rows.where("error is not null").select("file").distinct().count() == 1 and rows.where("error is null").count() == 1000
    with pytest.raises(Exception, match="DatabaseError"):
        recording.scan(spark, "FrameInfo", str(tmp_path / "bad.ezdataindex")).count()


def test_databases_by_their_bytes(spark, database):
    assert recording._scan_bytes(spark, "FrameInfo", [f"file://{database}"], True).where("Track = 0").count() == 334


def batch(*rows):
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows]) for i in range(3)], names=["file", "at", "body"])


def test_writer_commits_whole_files_only(tmp_path):
    signals = [{"label": "A", "pmin": -1, "pmax": 1, "dmin": -8, "dmax": 8, "samples": 2}]
    head = edf.header(datetime(2024, 1, 1), "edf", 1.0, signals)
    writer = edf.EdfWriter(str(tmp_path), False)
    body = [b"abcd", b"efgh", b"ijkl"]
    first = writer.write(iter([batch(("r.edf", 0, head), ("r.edf", len(head), body[0]))]))
    second = writer.write(iter([batch(("r.edf", len(head) + 8, body[2]))]))
    with pytest.raises(ValueError, match="not whole"):
        writer.commit([first, second])
    # a task that ran twice wrote the same bytes; the message of one of them counts
    writer.write(iter([batch(("r.edf", len(head) + 4, body[1]))]))
    third = writer.write(iter([batch(("r.edf", len(head) + 4, body[1]))]))
    writer.commit([first, second, third, None])
    assert os.listdir(tmp_path) == ["r.edf"] and (tmp_path / "r.edf").read_bytes()[len(head) :] == b"".join(body)
    assert edf.read_header(str(tmp_path / "r.edf")).n_records == 3
    other = edf.EdfWriter(str(tmp_path), False)
    told = other.write(iter([batch(("r.edf", 0, head), ("r.edf", len(head), body[0]))]))
    with pytest.raises(FileExistsError):
        other.commit([told])
    other.abort([told])
    assert os.listdir(tmp_path) == ["r.edf"]


def test_failed_tasks_leave_nothing(spark, tmp_path):
    df = spark.range(40).select(F.concat(F.lit("f"), (F.col("id") % 3).cast("string")).alias("file"), F.when(F.col("id") == 39, F.raise_error("stop")).otherwise(F.col("id")).cast("long").alias("at"), F.lit(b"x").alias("body"))
    with pytest.raises(Exception, match="stop"):
        edf.write_files(df.repartition(4), str(tmp_path))
    assert os.listdir(tmp_path) == []


def test_labels(spark):
    rows = [("Fp1", "2R", 3, None), ("Fp1", None, 3, None), (None, None, 40, None), (None, None, 40, "mine is a long label")]
    df = spark.createDataFrame(rows, "name string, reference string, amp int, own string")
    assert [r[0] for r in df.select(sig.channel_label(*map(F.col, df.columns))).collect()] == ["EEG Fp1-2R", "EEG Fp1-Cz", "EEG ch40-Cz", "mine is a long l"]


def test_highpass_of_arrays_is_that_of_samples(spark):
    import numpy as np

    x = np.random.default_rng(4).normal(size=3000).cumsum()
    cuts = [0, 400, 450, 900, 901, 2000, 2600, 3000]
    pieces = spark.createDataFrame([(1, a, x[a:b].tolist(), 10, "k") for a, b in zip(cuts, cuts[1:])], "s int, pos long, v array<double>, hz int, kept string")
    got = filters.highpass_arrays(pieces.repartition(3), ["s"], "pos", "v", "hz", ["kept"], chunk=500).orderBy("pos").collect()
    assert [r.pos for r in got] == cuts[:-1] and {r.kept for r in got} == {"k"}
    assert np.allclose(np.concatenate([r.v for r in got]), filters.highpass(x, 10.0), atol=1e-8)
