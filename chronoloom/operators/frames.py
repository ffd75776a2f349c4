"""Frames of a recording: gaps, islands, cursors and padding. All windows are partitioned by recording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.operators.asof import asof_backward


def by_frame(rec: str, frame: str) -> W:
    return W.partitionBy(rec).orderBy(frame)


def gaps(frames: DataFrame, rec: str, frame: str) -> DataFrame:
    """rec, after_frame, before_frame and missing: where frame numbers jump."""
    before = F.lag(frame).over(by_frame(rec, frame))
    found = frames.select(rec, F.col(frame).alias("before_frame"), before.alias("after_frame"))
    return found.where("before_frame > after_frame + 1").select(rec, "after_frame", "before_frame", (F.col("before_frame") - F.col("after_frame") - 1).alias("missing"))


def missing(frames: DataFrame, rec: str, frame: str) -> DataFrame:
    """rec and frame of each number that a jump leaves out. Only jumps are exploded, not the frames that exist."""
    return gaps(frames, rec, frame).select(rec, F.explode(F.sequence(F.col("after_frame") + 1, F.col("before_frame") - 1)).alias(frame))


def padded(frames: DataFrame, rec: str, frame: str, zeros: dict[str, Column]) -> DataFrame:
    """frames (rec, frame and the columns that zeros names) with a row of zeros for each missing number."""
    return frames.select(rec, frame, *zeros).unionByName(missing(frames, rec, frame).select(rec, frame, *(v.alias(k) for k, v in zeros.items())))


def led(frames: DataFrame, rec: str, frame: str, zeros: dict[str, Column]) -> DataFrame:
    """frames with a row of zeros for each number from 0 to the first one, so that a recording begins at its origin."""
    first = frames.groupBy(rec).agg(F.min(frame).alias("__first")).where("__first > 0")
    lead = first.select(rec, F.explode(F.sequence(F.lit(0).cast("long"), F.col("__first") - 1)).alias(frame))
    return frames.select(rec, frame, *zeros).unionByName(lead.select(rec, frame, *(v.alias(k) for k, v in zeros.items())))


def in_range(frames: DataFrame, frame: str, first: int, last: int) -> DataFrame:
    """The frames from first to last, both included, renumbered from 0; none at all is an error."""
    if last < first:
        raise ValueError(f"frames {first} to {last} are no range")
    kept = frames.where(F.col(frame).between(first, last)).withColumn(frame, F.col(frame) - first)
    n = kept.agg(F.count("*").alias("__n")).select(F.when(F.col("__n") == 0, F.raise_error(f"no frame from {first} to {last}").cast("long")).otherwise(F.col("__n")).alias("__n"))
    return kept.join(F.broadcast(n), F.col("__n") > 0).drop("__n")


def gap_annotations(found: DataFrame, rec: str, seconds: float = 1.0) -> DataFrame:
    """rec, onset and duration (seconds) and text of an annotation for each gap (see gaps), to append to the events."""
    return found.select(rec, ((F.col("after_frame") + 1) * seconds).alias("onset"), (F.col("missing") * seconds).alias("duration"), F.lit("Recording gap").alias("text"))


def effective_rate(frames: DataFrame, rec: str, frame: str, n: str, start: str, ticks: float) -> DataFrame:
    """rec and rate: samples of all frames but the last over the time from the first frame's start to the last one's."""
    sums = frames.groupBy(rec).agg((F.sum(n) - F.max_by(n, frame)).alias("__n"), (F.max_by(start, frame) - F.min_by(start, frame)).alias("__span"))
    return sums.where("__span > 0").select(rec, (F.col("__n") / (F.col("__span") / ticks)).alias("rate"))


def drift(frames: DataFrame, rec: str, frame: str, stamp: str, clock: str) -> DataFrame:
    """rec, n, and mean, least and greatest change of stamp - clock from one frame to the next."""
    off = F.col(stamp) - F.col(clock)
    step = frames.withColumn("__step", off - F.lag(off).over(by_frame(rec, frame))).where("__step is not null")
    return step.groupBy(rec).agg(F.count("*").alias("n"), F.avg("__step").alias("mean"), F.min("__step").alias("least"), F.max("__step").alias("greatest"))


def out_of_order(onsets: DataFrame, rec: str, record: str, onset: str, seconds: float) -> DataFrame:
    """The records that begin before the one before them has ended (less than `seconds` after its onset)."""
    before = F.lag(onset).over(by_frame(rec, record))
    return onsets.withColumn("__before", before).where(F.col(onset) < F.col("__before") + seconds - 1e-9).drop("__before")


def cursor(frames: DataFrame, rec: str, frame: str, n: str, pad: int | Column | None) -> DataFrame:
    """frames with first_sample; each missing frame counts `pad` samples, or none (None: gaps are closed up)."""
    jump = F.coalesce(F.col(frame) - F.lag(frame).over(by_frame(rec, frame)) - 1, F.lit(0)) * (F.lit(0) if pad is None else pad)
    at = frames.withColumn("__jump", jump)
    running = F.sum(F.col(n) + F.col("__jump")).over(by_frame(rec, frame).rowsBetween(W.unboundedPreceding, 0))
    return at.withColumn("first_sample", running - F.col(n)).drop("__jump")


def islands(frames: DataFrame, rec: str, frame: str) -> DataFrame:
    """frames with segment, counted from 0 at the recording's start and up by one at each gap."""
    starts = F.when(F.col(frame) > F.lag(frame).over(by_frame(rec, frame)) + 1, 1).otherwise(0)
    at = frames.withColumn("__start", starts)
    return at.withColumn("segment", F.sum("__start").over(by_frame(rec, frame).rowsBetween(W.unboundedPreceding, 0))).drop("__start")


def pause_shift(events: DataFrame, pauses: DataFrame, rec: str, at: str) -> DataFrame:
    """events with `joined`, their place after pauses (rec, start, length; they don't overlap) are cut out: an event
    inside a pause lands on the join, one behind it moves up by its length. Each event meets the last pause before it,
    which carries the length of those before."""
    before = F.sum("length").over(by_frame(rec, "start").rowsBetween(W.unboundedPreceding, -1))
    p = pauses.select(rec, "start", "length", F.coalesce(before, F.lit(0)).alias("__cut"))
    met = asof_backward(events, p.withColumnRenamed("start", "__start").withColumnRenamed("length", "__length"), rec, at, "__start", ["__start", "__length", "__cut"])
    cut = F.col("__cut") + F.least("__length", F.col(at) - F.col("__start"))
    return met.withColumn("joined", F.col(at) - F.coalesce(cut, F.lit(0))).drop("__start", "__length", "__cut")


def records_outside(records: DataFrame, holes: DataFrame, rec: str) -> DataFrame:
    """The records (rec, record) that are not wholly inside a hole (rec, start, end in records)."""
    inside = holes.select(F.col(rec).alias("__rec"), F.explode(F.expr("sequence(cast(ceil(start) as bigint), cast(floor(end) as bigint) - 1)")).alias("__k")).where("__k >= 0")
    return records.join(inside, (records[rec] == inside["__rec"]) & (records["record"] == inside["__k"]), "left_anti")
