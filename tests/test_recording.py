import sqlite3
import struct

import numpy as np
import pytest

from chronoloom.sources import recording


def block(amp, rate, kind, first, scale, deltas):
    data = np.asarray(deltas, recording.DELTAS[kind]).tobytes()
    head = [0] * 16
    head[1], head[4], head[10] = amp, amp, rate
    out = bytearray(94)
    out[:8] = recording.CHANNEL_TAG
    struct.pack_into("<16I", out, 8, *head)
    struct.pack_into("<BIff", out, 81, kind, len(data) + 8, first, scale)
    return bytes(out) + data


def frame(channels, start, end):
    head = bytearray(recording.FIRST_TAG)
    struct.pack_into("<I", head, 0, recording.MAGIC)
    struct.pack_into("<IQQ", head, 0x2E, len(channels), start, end)
    return bytes(head) + b"".join(channels)


@pytest.fixture
def export(tmp_path):
    folder = tmp_path / "CadLink" / "Data"
    folder.mkdir(parents=True)
    index, data = sqlite3.connect(folder / "r.ezdataindex"), sqlite3.connect(folder / "r-1.ezdata")
    index.execute("create table FrameInfo (Offset integer, TimeStamp text, Track integer, Status integer, FileIndex integer, JoinDatabase text, FrameKey blob)")
    data.execute("create table FrameInfo (DataKey blob, FrameKey blob, Data blob)")
    for no in (0, 1, 2, 5):
        key = struct.pack("<QQ", no, 7)
        index.execute("insert into FrameInfo values (?, ?, 0, 1, 0, 'r-1.ezdata', ?)", (no, f"2025-11-01T00:00:{no:02}.1234567", key))
        blob = frame([block(3, 50, 1, 10.0, 0.5, range(49)), block(4, 50, 2, -1.0, 2.0, [1, -1] * 10)], no * 10**7, (no + 1) * 10**7)
        data.execute("insert into FrameInfo values (x'00', ?, ?)", (key, blob))
    for con in (index, data):
        con.commit()
        con.close()
    return tmp_path


def test_frames_decode(spark, export):
    rows = recording.frames(spark, str(export)).orderBy("frame_no", "amp_input").collect()
    assert [(r.frame_no, r.amp_input, len(r.samples)) for r in rows[:2]] == [(0, 3, 50), (0, 4, 21)] and len(rows) == 8
    want = (10.0 + np.concatenate([[0], np.cumsum(np.arange(49))]) * 0.5) * recording.UNIT_UV
    assert np.array_equal(rows[0].samples, want) and rows[7].end_ticks == 6 * 10**7
    assert recording.inventory(spark, str(export)).first()["missing"] == 2
    assert recording.recorded_events(spark, str(export)).count() == 0 and len(recording.discover(str(export))) == 1


def test_bad_frames_are_refused():
    with pytest.raises(ValueError):
        recording.decode_frame(b"nothing of the kind")
    with pytest.raises(ValueError):
        recording.decode_frame(frame([block(1, 1, 1, 0.0, 1.0, [1])], 0, 1).replace(b"\x01\x0a", b"\x01\x0a")[:66])
