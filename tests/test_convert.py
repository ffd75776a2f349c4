"""Whole jobs on small recordings of our own making."""

import json
import os
import sqlite3
import zipfile
from datetime import UTC, datetime

import numpy as np
import pytest

from chronoloom.functions.signal import UNIT_UV
from chronoloom.plans import convert
from chronoloom.plans.convert import Options
from chronoloom.sources import edf, recording, synthetic, texts

RATE, ORIGIN = 50, 17_300_000_000_000_000
ORIGIN_TIME = datetime(2024, 10, 26, 22, 13, 20)
EVENTS = [("Comment", "John was here", 2.5, 0.5, 0), ("Marker", "eyes open", 1.25, 0.0, 0), ("Marker", "gone", 1.0, 0.0, 1), ("AmpConfigurationData", "x", 1.0, 0.0, 0), ("Marker", "before", -5.0, 0.0, 0), ("Marker", "after", 500.0, 0.0, 0)]


def stamp(ticks):
    seconds, rest = divmod(ticks, 10_000_000)
    return datetime.fromtimestamp(seconds, UTC).strftime("%Y-%m-%dT%H:%M:%S") + f".{rest:07}"


def wave(no, k, amp, n):
    return [int(x) for x in np.round(80 * np.sin(np.arange(n) / (3 + amp) + no) + 10 * amp)]


def made(spark, folder, numbers=range(5), sizes=None, version="2.5", kind=5, name="r", amps=(3, 4, 26, 40), correction=("2024-10-27T00:00:00.5000000", "2024-10-27T00:00:00.0000000")):
    sizes = sizes or {0: 48}
    rows = []
    for no in numbers:
        n = sizes.get(no, 50 + no % 2)
        ticks = ORIGIN + no * 10_000_000
        rows += [(no, stamp(ticks), ticks, ticks + 10_000_000, a, RATE, wave(no, 0, a, n)) for a in amps]
    frames = spark.createDataFrame(rows, "frame_no long, ts string, start_ticks long, end_ticks long, amp_input int, rate int, units array<long>")
    events = [(t, x, stamp(ORIGIN + round(at * 1e7)), stamp(ORIGIN + round((at + d) * 1e7)), ORIGIN + round(at * 1e7), ORIGIN + round((at + d) * 1e7), gone, 0) for t, x, at, d, gone in EVENTS]
    events = spark.createDataFrame(events, "EventType string, Text string, StartTime string, EndTime string, StartOffset long, EndOffset long, Deleted int, Priority int")
    return synthetic.write_recording(frames, str(folder), name, events=events, version=version, kind=kind, correction=correction)


def values(spark, path):
    rows = edf.samples(edf.scan(spark, path)).orderBy("record").collect()
    out = {}
    for r in rows:
        out.setdefault(r.label, []).extend(r["values"])
    return {k: np.array(v) for k, v in out.items()}


def test_raw_conversion(spark, tmp_path):
    path, out = made(spark, tmp_path / "a"), str(tmp_path / "a.edf")
    report = convert.convert(spark, path, out, Options(zone="UTC+02:00", labels={40: "mine"}))
    assert report["kind"] == "EDF+C" and report["records"] == report["seconds"] == 5 and report["raw_samples"] == 250 and report["headbox"] == "Apollo"
    assert report["samples_per_frame"] == {"48": 1, "50": 2, "51": 2} and report["schema_version"] == "2.5"
    got = values(spark, out)
    assert list(got) == ["EEG Fp1-Cz", "EEG Fp2-Cz", "EEG 27-2R", "mine"]
    whole = np.concatenate([wave(no, 0, 3, 48 if no == 0 else 50 + no % 2) for no in range(5)]) * UNIT_UV
    assert np.abs(got["EEG Fp1-Cz"] - whole).max() < 100.01 * 2 / 65535
    head = edf.read_header(out)
    assert head.start == datetime.fromtimestamp(ORIGIN // 10_000_000 + 7200, UTC).replace(tzinfo=None) and head.kind == "EDF+C"
    records = edf.scan(spark, out)
    notes = {r.text: (round(r.onset, 3), r.duration) for r in edf.annotations(records).collect()}
    # positions by the sample clock, plus half a second of the start that the header can't hold
    assert notes == {"John was here": (0.5 + (48 + 51 + 25) / 50, 0.5), "eyes open": (0.5 + round((48 + 12.75) / 50, 3), None)}
    assert [round(r.onset, 3) for r in edf.record_onsets(records).orderBy("record").collect()] == [0.5, 1.5, 2.5, 3.5, 4.5]
    assert {r["reason"]: r["n"] for r in report["events_skipped"]} == {"deleted": 1, "outside exported range": 2, "type skipped": 1}
    with pytest.raises(FileExistsError):
        convert.convert(spark, path, out)


def test_anonymised_and_all_events(spark, tmp_path):
    path, out = made(spark, tmp_path / "a"), str(tmp_path / "a.edf")
    convert.convert(spark, path, out, Options(anonymise=True, all_events=True))
    assert {r.text for r in edf.annotations(edf.scan(spark, out)).collect()} == {"Comment", "eyes open", "x"}
    assert b"John" not in (tmp_path / "a.edf").read_bytes()


def test_gaps_padded_and_left_out(spark, tmp_path):
    path = made(spark, tmp_path / "g", [1, 2, 3, 7, 8], {k: 50 for k in range(10)}, correction=None)
    out = str(tmp_path / "p.edf")
    report = convert.convert(spark, path, out, Options(start_at="record-origin"))
    got = values(spark, out)["EEG Fp1-Cz"]
    step = 100 * 2 / 65535
    assert report["records"] == 9 and report["frames_padded"] == 4 and np.abs(got[:50]).max() < step and np.abs(got[200:350]).max() < step and np.abs(got[50:100]).max() > 10
    assert {r.text for r in edf.annotations(edf.scan(spark, out)).collect()} >= {"Recording gap 3 s (padded with zeros)", "Recording gap 1 s (padded with zeros)"}
    report = convert.convert(spark, path, str(tmp_path / "d.edf"), Options(gaps="discontinuous"))
    assert report["kind"] == "EDF+D" and report["records"] == 5
    onsets = [r.onset for r in edf.record_onsets(edf.scan(spark, str(tmp_path / "d.edf"))).orderBy("record").collect()]
    assert onsets == [0.0, 1.0, 2.0, 6.0, 7.0]


def test_vendor_mode_decimates_and_filters(spark, tmp_path):
    sizes = {k: 51 if k in (3, 9) else 50 for k in range(12)}
    path = made(spark, tmp_path / "v", range(12), sizes, kind=1)
    report = convert.convert(spark, path, str(tmp_path / "v.edf"), Options(mode="vendor"))
    assert report["records"] == 11 and report["samples_removed"] == 2 and report["highpass"] and report["headbox"] == "Essentia"
    got = values(spark, str(tmp_path / "v.edf"))
    assert len(got["EEG Fp1-Cz"]) == 550 and abs(got["EEG Fp1-Cz"][-200:].mean()) < 8


def test_options_are_checked(spark, tmp_path):
    for wrong in ({"mode": "x"}, {"gaps": "discontinuous", "mode": "vendor"}, {"gaps": "discontinuous", "kind": "edf"}, {"timing": "x"}, {"zone": "Nowhere/At all"}):
        with pytest.raises((ValueError, KeyError)):
            Options(**wrong)
    path = made(spark, tmp_path / "s", version="9.9")
    with pytest.raises(ValueError, match="9.9"):
        convert.convert(spark, path, str(tmp_path / "s.edf"))
    assert not (tmp_path / "s.edf").exists()
    assert convert.convert(spark, path, str(tmp_path / "s.edf"), Options(allow_unsupported=True))["warnings"]


def test_plain_file(spark, tmp_path):
    path, out = made(spark, tmp_path / "a"), str(tmp_path / "a.edf")
    report = convert.convert(spark, path, out, Options(kind="edf"))
    assert report["kind"] == "EDF" and len(report["warnings"]) == 2 and edf.read_header(out).kind == "" and edf.annotations(edf.scan(spark, out)).count() == 0


def statuses(checks):
    return {r.check: r.status for r in checks.collect()}


def test_selftest_and_what_it_notices(spark, tmp_path):
    sizes = {k: 51 if k in (5, 9) else 50 for k in range(20)}
    path, export = made(spark, tmp_path / "a", range(20), sizes, kind=1), str(tmp_path / "export.edf")
    convert.convert(spark, path, export, Options(mode="vendor", zone="UTC+02:00", first=3, last=14))
    (tmp_path / "w").mkdir()
    checks = convert.selftest(spark, path, export, str(tmp_path / "w"))
    assert set(statuses(checks).values()) <= {"PASS", "INFO"} and len(statuses(checks)) == 8
    from chronoloom.operators.compare import verdict

    assert verdict(checks).first() == (True, 0)
    data = bytearray(open(export, "rb").read())
    head = edf.read_header(export)
    data[head.size + 10 : head.size + 12] = (int.from_bytes(data[head.size + 10 : head.size + 12], "little", signed=True) + 3).to_bytes(2, "little", signed=True)
    (tmp_path / "one.edf").write_bytes(data)
    assert statuses(convert.compared(spark, export, str(tmp_path / "one.edf")))["samples"] == "FAIL"
    (tmp_path / "label.edf").write_bytes(open(export, "rb").read().replace(b"EEG Fp1-Cz", b"EEG Fp9-Cz"))
    got = statuses(convert.compared(spark, export, str(tmp_path / "label.edf")))
    assert got["signals"] == "FAIL" and got["samples"] == "PASS"
    (tmp_path / "text.edf").write_bytes(open(export, "rb").read().replace(b"eyes open", b"eyes shut"))
    with pytest.raises(Exception, match="places fit"):
        other = made(spark, tmp_path / "b", range(20), sizes, kind=1, correction=("2024-10-27T00:00:00.7000000", "2024-10-27T00:00:00.0000000"))
        convert.selftest(spark, other, export, str(tmp_path / "w"))


def written(spark, path, values, start=ORIGIN_TIME, reach=100.0, label="EEG A-Cz", kind=None, notes=None):
    signals = [{"label": label, "unit": "uV", "pmin": -reach, "pmax": reach, "dmin": -32768, "dmax": 32767, "samples": RATE}]
    digital = np.rint((values + reach) / (2 * reach) * 65535 - 32768).astype(int).reshape(-1, RATE).tolist()
    df = spark.createDataFrame([(k, 0, d) for k, d in enumerate(digital)], "record long, signal_no int, digital array<int>")
    edf.write(df, str(path), start, 1.0, signals, notes, kind=kind)
    return str(path)


def test_compared_fails_files_that_differ(spark, tmp_path):
    x = 80 * np.sin(np.arange(4 * RATE) / 3.0)
    one = written(spark, tmp_path / "1.edf", x, kind="edf+c")
    late = written(spark, tmp_path / "2.edf", x, ORIGIN_TIME.replace(microsecond=900_000), kind="edf+c")
    got = statuses(convert.compared(spark, one, late))
    assert got["start"] == "FAIL" and got["samples"] == got["gain"] == got["lag"] == "PASS"
    # another physical range: said so, and compared in the coarser step
    got = statuses(convert.compared(spark, one, written(spark, tmp_path / "3.edf", x, reach=105.0, kind="edf+c")))
    assert got["signals"] == "FAIL" and got["samples"] == got["gain"] == "PASS"
    # nothing in common
    none = written(spark, tmp_path / "4.edf", np.zeros(4 * RATE), kind="edf+c")
    assert statuses(convert.compared(spark, one, none))["gain"] == "FAIL"
    assert statuses(convert.compared(spark, one, written(spark, tmp_path / "5.edf", np.roll(x, 2), kind="edf+c")))["lag"] == "FAIL"


def test_batch_equals_single_conversions(spark, tmp_path):
    for k in range(2):
        made(spark, tmp_path / "in" / str(k), range(4 + k), kind=(1, 9)[k], name="n")
    (tmp_path / "in" / "bad").mkdir()
    (tmp_path / "in" / "bad" / "n.ezdataindex").write_bytes(b"no database at all")
    rows = convert.batch(spark, str(tmp_path / "in"), str(tmp_path / "out"), Options(mode="vendor")).collect()
    assert [r.status for r in rows] == ["ok", "ok", "failed"] and "DatabaseError" in rows[2].error
    (tmp_path / "one").mkdir()
    alone = str(tmp_path / "one" / "x.edf")
    convert.convert(spark, rows[1].input, alone, Options(mode="vendor"))
    assert open(alone, "rb").read() == open(rows[1].output, "rb").read()


def test_inspect_and_batch(spark, tmp_path):
    for k, version in enumerate(("2.5", "9.9", "2.5")):
        made(spark, tmp_path / "in" / str(k), range(3), version=version)
    told = convert.inspect(spark, str(tmp_path / "in" / "0"), 3)
    assert told["supported"] and told["tracks"][0]["frames"] == 3 and len(told["first_events"]) == 3 and told["events"] == 6 and all(f["present"] for f in told["files"])
    got = convert.batch(spark, str(tmp_path / "in"), str(tmp_path / "out"), reports=True)
    assert [(r.status, "9.9" in (r.error or "")) for r in got.orderBy("input").collect()] == [("ok", False), ("failed", True), ("ok", False)]
    assert sorted(os.listdir(tmp_path / "out")) == ["r-3.edf", "r-3.json", "r.edf", "r.json"]
    assert json.load(open(tmp_path / "out" / "r.json"))["frames"] == 3
    assert convert.batch(spark, str(tmp_path / "in"), str(tmp_path / "out")).where("status = 'failed' and error like 'FileExists%'").count() == 3


def test_missing_data_is_an_error(spark, tmp_path):
    path = made(spark, tmp_path / "a", range(3))
    con = sqlite3.connect(tmp_path / "a" / "r-1.ezdata")
    con.execute("delete from FrameInfo")
    con.commit()
    con.close()
    with pytest.raises(Exception, match="no data for frame"):
        recording.frames(spark, path).collect()


def test_zipped_text(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "e.zip", "w") as z:
        z.writestr("e.txt", "% head\n01.11.2025 10:00:00\t1,5\t-0,25\n")
    assert texts.vendor_text(spark, f"file://{tmp_path}/e.zip").first()["values"][1:] == [1500.0, -250.0]
