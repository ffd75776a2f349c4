"""Closed forms of the decimation that drops surplus samples, and positions through it. Stateless, so it runs on any
partitioning of the output."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def period(n_in: int, n_out: int) -> tuple[int, int]:
    """Surplus samples and the outputs from one removal to the next."""
    surplus = max(0, n_in - n_out)
    if not surplus:
        return 0, n_out + 1
    t = math.ceil(n_in / (surplus + 1))
    if surplus * t > n_out:
        raise ValueError("the surplus is too dense for two smoothed samples at each removal")
    return surplus, t


def removals(n_in: int, n_out: int) -> list[int]:
    """Raw positions that are dropped."""
    surplus, t = period(n_in, n_out)
    return [(i + 1) * t + i for i in range(surplus)]


def period_columns(n_in: Column, n_out: Column) -> tuple[Column, Column]:
    """period() of each row, for recordings of different lengths; a surplus that is too dense is an error."""
    surplus = F.greatest(F.lit(0), n_in - n_out)
    t = F.when(surplus == 0, n_out + 1).otherwise(F.ceil(n_in / (surplus + 1)))
    dense = F.when(surplus * t > n_out, F.raise_error("the surplus is too dense for two smoothed samples at each removal").cast("long"))
    return F.coalesce(dense, surplus), t


def raw_position(out: Column, surplus: Column, t: Column) -> tuple[Column, Column]:
    """Of an output: the raw sample it starts from, and whether it is the mean of that and the next."""
    removed = F.floor(out / t)
    smoothed = (out % t >= t - 2) & (removed < surplus)
    return out + F.least(removed, surplus), smoothed


def decimated(raw: DataFrame, by: list[str], pos: str, value: str, n_in: Column, n_out: Column) -> DataFrame:
    """by, pos, value and at (the place on the raw axis) of the outputs; raw has one row for each recording and
    position below n_in.

    Each raw sample knows which outputs it feeds, so the raw rows are only exploded to at most two and summed; no
    self-join by position is needed."""
    surplus, t = period_columns(n_in, n_out)
    known = raw.select(*by, F.col(pos).alias("__q"), F.col(value).alias("__v"), surplus.alias("__surplus"), t.alias("__t"), n_out.alias("__n"))
    q, surplus, t = F.col("__q"), F.col("__surplus"), F.col("__t")
    # outputs that may start at q (o = q - i) or end at q (o = q - 1 - i), for the i removals before about q
    i = F.least(F.floor(q / (t + 1)), surplus)
    tries = F.array(*(q - (i + k) - e for k in (-1, 0, 1) for e in (0, 1)))
    fed = known.withColumn("pos", F.explode(F.array_distinct(tries))).where("pos >= 0 and pos < __n")
    start, smoothed = raw_position(F.col("pos"), surplus, t)
    fed = fed.withColumn("__start", start).withColumn("__two", smoothed)
    fed = fed.where((q == F.col("__start")) | F.col("__two") & (q == F.col("__start") + 1))
    out = fed.groupBy(*by, "pos").agg(F.min("__start").alias("__start"), F.first("__two").alias("__two"), (F.sum("__v") / F.count("*")).alias("value"))
    return out.select(*by, "pos", "value", (F.col("__start") + F.when(F.col("__two"), 0.5).otherwise(0.0)).alias("at"))


def output_position(raw: Column, n_in: Column, n_out: Column) -> Column:
    """Of a raw position: the place among the outputs, linear between the removals."""
    surplus, t = period_columns(n_in, n_out)
    i = F.least(F.floor(raw / (t + 1)), surplus)
    into = raw - i * (t + 1)
    # the last two outputs before a removal stand half a raw step late
    late = F.when(into <= t - 3, into).when(into <= t - 1.5, (t - 3) + (into - (t - 3)) / 1.5)
    late = late.when(into <= t - 0.5, (t - 2) + (into - (t - 1.5))).otherwise((t - 1) + (into - (t - 0.5)) / 1.5)
    return (i * t + F.when(i < surplus, late).otherwise(into)).cast("double")
