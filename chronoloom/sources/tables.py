"""Table functions for SQL: what frames and annotation signals hold, by LATERAL joins; and a recording's tables as views."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from chronoloom.sources import recording


@F.udtf(returnType="start_ticks bigint, end_ticks bigint, amp_input int, rate int, samples array<double>", useArrow=True)
class FrameDecode:
    """frame_decode(data): a row for each channel of a frame; a null has none, and what is no frame is an error."""

    def eval(self, data: bytes | None) -> Iterator[tuple]:
        if data is not None:
            start, end, channels = recording.channel_blocks(bytes(data))
            for amp, rate, samples in channels:
                yield start, end, amp, rate, samples.tolist()


@F.udtf(returnType="place int, onset double, duration double, text string", useArrow=True)
class TalParse:
    """tal_parse(notes): a row for each text of each entry of an annotation signal's record, and one with an empty text
    for an entry that only keeps time; entries without a valid onset are skipped."""

    def eval(self, notes: bytes | None) -> Iterator[tuple]:
        for place, entry in enumerate((notes or b"").decode("utf-8", "replace").split("\x00")):
            when, *texts = entry.split("\x14")
            onset, *length = when.split("\x15")
            try:
                at, lasts = float(onset), float(length[0]) if length else None
            except ValueError:
                continue
            for text in [t for t in texts if t] or [""]:
                yield place, at, lasts, text


def register(spark: SparkSession) -> None:
    """frame_decode and tal_parse for spark.sql()."""
    spark.udtf.register("frame_decode", FrameDecode)
    spark.udtf.register("tal_parse", TalParse)


def recording_views(spark: SparkSession, path: str, prefix: str) -> None:
    """A recording's tables as the views prefix_FrameInfo, prefix_FrameData, prefix_Events and so on."""
    index = recording.locate(path)
    for name in recording.TABLES:
        if name == "FrameData":
            files = [r[0] for r in recording.scan(spark, "FrameInfo", index).select("JoinDatabase").distinct().collect()]  # a row for each file
            table = recording.scan(spark, name, *(os.path.join(os.path.dirname(index), f) for f in files))
        elif name == "Events":
            table = recording.scan(spark, name, index.removesuffix(recording.INDEX_SUFFIX) + ".ezevents", optional=True)
        else:
            table = recording.scan(spark, name, index)
        table.createOrReplaceTempView(f"{prefix}_{name}")
