"""Growing recordings: what the stream gives equals the batch operators', also when it is stopped and started again."""

import sqlite3
import struct
import time

import numpy as np
import pytest

from chronoloom.functions.signal import UNIT_UV
from chronoloom.operators.filters import highpass
from chronoloom.sources.recording import INDEX_SUFFIX
from chronoloom.sources.synthetic import INDEX, channel_block, frame_blob
from chronoloom.streaming import live

RATE = 10


def units(frame: int, amp: int) -> np.ndarray:
    return np.random.default_rng(frame * 7 + amp).integers(-50, 50, RATE)


def write(folder, numbers, amps=(1, 2)) -> str:
    """Appends one-second frames, data before index rows."""
    path = f"{folder}/r{INDEX_SUFFIX}"
    data, index = sqlite3.connect(f"{folder}/r.ezdata"), sqlite3.connect(path)
    data.execute("create table if not exists FrameInfo (DataKey blob, FrameKey blob, Data blob)")
    index.execute(f"create table if not exists FrameInfo ({INDEX})")
    for no in numbers:
        blob = frame_blob([channel_block(a, RATE, units(no, a)) for a in amps], no, no + 1)
        data.execute("insert into FrameInfo values (x'00', ?, ?)", (struct.pack("<Q", no), blob))
        data.commit()
        index.execute("insert into FrameInfo values (?, ?, 0, 1, 0, 'r.ezdata', ?)", (no, f"t{no}", struct.pack("<Q", no)))
    index.commit()
    data.close(), index.close()
    return path


def run(spark, path, folder, **options):
    out = live.live_frames(spark, [path], pad=RATE, **options)
    query = out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/out")
    assert query.awaitTermination(120)
    return {(r.amp_input, r.frame_no, r.kind): r for r in spark.read.parquet(f"{folder}/out").collect()}


def expected(numbers, amp):
    """frame -> first sample, segment, missing, filtered, of the batch filter by segments."""
    found, segment, at, parts = {}, 0, 0, []
    for k, no in enumerate(numbers):
        gap = no - numbers[k - 1] - 1 if k else 0
        segment += gap > 0
        at += gap * RATE
        parts.append((no, at, segment, gap))
        at += RATE
    for s in {p[2] for p in parts}:
        inside = [p for p in parts if p[2] == s]
        y = highpass(np.concatenate([units(p[0], amp) for p in inside]) * UNIT_UV, float(RATE))
        for k, p in enumerate(inside):
            found[p[0]] = (*p[1:], y[k * RATE : (k + 1) * RATE])
    return found


def test_stream_equals_batch_over_restarts(spark, tmp_path):
    # the first segment's priming waits over a restart; the second is shorter than what primes the filter
    numbers = [*range(5, 35), *range(40, 48), *range(60, 95)]
    path = write(tmp_path, numbers[:12])
    first = run(spark, path, tmp_path)
    assert not first  # twelve of twenty seconds
    write(tmp_path, numbers[12:33])
    second = run(spark, path, tmp_path)
    assert {k[1] for k in second} == set(range(5, 35))
    write(tmp_path, numbers[33:])
    rows = run(spark, path, tmp_path)
    for amp in (1, 2):
        wanted = expected(numbers, amp)
        assert sorted(k[1] for k in rows if k[0] == amp) == numbers
        for no, (at, segment, gap, y) in wanted.items():
            r = rows[amp, no, "frame"]
            assert (r.first_sample, r.segment, r.missing) == (at, segment, gap)
            np.testing.assert_allclose(r.filtered, y, atol=1e-9)
            np.testing.assert_allclose(r.samples, units(no, amp) * UNIT_UV, atol=1e-9)


def test_late_and_unreadable_frames(spark, tmp_path):
    path = write(tmp_path, range(30))
    run(spark, path, tmp_path)
    write(tmp_path, [7])
    with sqlite3.connect(path) as index:
        index.execute("insert into FrameInfo values (30, 't', 0, 1, 0, 'r.ezdata', x'ff')")
    rows = run(spark, path, tmp_path)
    assert rows[1, 7, "late"].filtered is None and rows[1, 7, "late"].segment is None
    assert "no data for frame 30" in rows[-1, 30, "error"].error
    assert sum(k[2] == "frame" for k in rows) == 60


def test_overdue_frames_end_the_wait(spark, tmp_path):
    path = write(tmp_path, range(4), amps=(1,))
    out = live.live_frames(spark, [path], overdue_seconds=2)
    query = out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(processingTime="1 second").start(f"{tmp_path}/out")
    try:
        for _ in range(90):
            time.sleep(1)
            rows = spark.read.schema(live.PLACED).parquet(f"{tmp_path}/out").collect()
            if any(r.kind == "overdue" for r in rows):
                break
        else:
            pytest.fail("no frame was overdue")
    finally:
        query.stop()
    frames = {r.frame_no: r for r in rows if r.kind == "frame"}
    assert sorted(frames) == [0, 1, 2, 3] and [r.frame_no for r in rows if r.kind == "overdue"] == [4]
    y = highpass(np.concatenate([units(k, 1) for k in range(4)]) * UNIT_UV, float(RATE))
    np.testing.assert_allclose(np.concatenate([frames[k].filtered for k in range(4)]), y, atol=1e-9)
