from datetime import datetime

import numpy as np
import pytest

from chronoloom.sources import edf

SIGNALS = [{"label": "EEG A-Cz", "unit": "uV", "pmin": -100, "pmax": 100, "dmin": -32768, "dmax": 32767, "samples": 50}, {"label": "EEG B-Cz", "unit": "uV", "pmin": -12.5, "pmax": 12.5, "dmin": -2048, "dmax": 2047, "samples": 20}]
START = datetime(2025, 11, 1, 13, 4, 5)


def digital(spark, n):
    rng = np.random.default_rng(3)
    rows = [(r, k, rng.integers(-2048, 2048, s["samples"]).tolist()) for r in range(n) for k, s in enumerate(SIGNALS)]
    return rows, spark.createDataFrame(rows[::-1], "record long, signal_no int, digital array<int>")


def test_round_trip(spark, tmp_path):
    rows, df = digital(spark, 7)
    notes = spark.createDataFrame([(2.25, 0.5, "blink"), (2.0, None, "Ω eyes"), (99.0, None, "late")], "onset double, duration double, text string")
    path = str(tmp_path / "a.edf")
    assert edf.write(df, path, START, 1.0, SIGNALS, notes) == 7
    head = edf.read_header(path)
    assert head.start == START and head.kind == "EDF+C" and head.n_records == 7 and [s["samples"] for s in head.signals[:2]] == [50, 20]
    back = edf.scan(spark, path)
    got = back.where("notes is null").orderBy("record", "signal_no").collect()
    assert [(r.record, r.signal_no, r.digital) for r in got] == rows
    values = edf.samples(back).where("record = 3 and signal_no = 1").first()["values"]
    assert np.allclose(values, (np.array(rows[7][2]) + 2048) * 25 / 4095 - 12.5)
    found = [(r.record, r.onset, r.duration, r.text) for r in edf.annotations(back).orderBy("onset").collect()]
    assert found == [(2, 2.0, None, "Ω eyes"), (2, 2.25, 0.5, "blink"), (6, 99.0, None, "late")]


def test_plain_file_and_refusals(spark, tmp_path):
    rows, df = digital(spark, 2)
    path = tmp_path / "b.edf"
    assert edf.write(df, str(path), START, 1.0, SIGNALS) == 2
    with pytest.raises(FileExistsError):
        edf.write(df, str(path), START, 1.0, SIGNALS)
    with pytest.raises(Exception, match="numbered from|not whole"):
        edf.write(df.where("record <> 0"), str(tmp_path / "c.edf"), START, 1.0, SIGNALS)
    with pytest.raises(ValueError):
        edf.write(df, str(tmp_path / "d.edf"), START.replace(year=1984), 1.0, SIGNALS)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["b.edf"]
    whole = path.read_bytes()
    path.write_bytes(whole[:236] + b"-1      " + whole[244:])
    assert edf.scan(spark, str(path)).count() == 4


def test_numbers_fit_their_field():
    assert edf.number(-12.5) == b"-12.5   " and edf.number(100) == b"100     " and edf.number(-123.456789) == b"-123.457"
    with pytest.raises(ValueError):
        edf.number(1234567890.0)


def test_kinds_and_their_rules(spark, tmp_path):
    rows, df = digital(spark, 4)
    notes = spark.createDataFrame([(0.5, None, "a\x14b\x00c")], "onset double, duration double, text string")
    at = lambda *x: spark.createDataFrame(list(enumerate(map(float, x))), "record long, onset double")
    write = lambda name, **more: edf.write(df, str(tmp_path / name), more.pop("start", START), 1.0, SIGNALS, **more)
    assert write("a.edf", notes=notes) == 4
    assert [r.text for r in edf.annotations(edf.scan(spark, str(tmp_path / "a.edf"))).collect()] == ["a b c"]
    assert write("b.edf", notes=notes, start=START.replace(microsecond=250000)) == 4
    assert edf.annotations(edf.scan(spark, str(tmp_path / "b.edf"))).first()["onset"] == 0.75
    assert write("d.edf", kind="edf+d", onsets=at(0, 1, 5, 6), notes=notes) == 4
    for wrong in ({"kind": "edf", "notes": notes}, {"kind": "edf", "start": START.replace(microsecond=1)}, {"kind": "edf+d"}, {"kind": "edf+d", "onsets": at(0, 0.5, 2, 3)}, {"kind": "x"}):
        with pytest.raises(ValueError):
            write("w.edf", **wrong)
    with pytest.raises(ValueError, match="does not fit"):
        edf.write(df, str(tmp_path / "l.edf"), START, 1.0, [{**SIGNALS[0], "label": "a label that is too long"}, SIGNALS[1]])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.edf", "b.edf", "d.edf"]


def test_writer_holds_few_records_of_a_batch(tmp_path):
    import tracemalloc

    import pyarrow as pa

    bodies = [bytes([k % 251]) * 10_000 for k in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(["a"] * 2000), pa.array([k * 10_000 for k in range(2000)]), pa.array(bodies, pa.binary())], names=["file", "at", "body"])
    writer = edf.EdfWriter(str(tmp_path), False)
    tracemalloc.start()
    assert writer.write(iter([batch])).files == {"a": (20_000_000, 20_000_000)}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert open(writer.part("a"), "rb").read() == b"".join(bodies) and peak < 4_000_000
