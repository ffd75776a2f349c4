"""Backward as-of join: each left row with the last right row at or before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, by: str, at: str, start: str, take: list[str]) -> DataFrame:
    """left with the columns `take` of right (null where none is before). One window over the union, partitioned by
    `by`: both sides are shuffled once and no pair of rows is tried."""
    l = left.select(F.col(by).alias("__by"), F.col(at).alias("__at"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row"), F.lit(None).alias("__got"))
    got = F.struct(*take)
    r = right.select(F.col(by).alias("__by"), F.col(start).alias("__at"), F.lit(0).alias("__side"), F.lit(None).alias("__row"), got.alias("__got"))
    w = W.partitionBy("__by").orderBy("__at", "__side").rowsBetween(W.unboundedPreceding, 0)
    both = l.unionByName(r).withColumn("__last", F.last("__got", ignorenulls=True).over(w)).where("__side = 1")
    return both.select("__row.*", *(F.col(f"__last.{c}").alias(c) for c in take))


def sample_position(at: Column, start: Column, end: Column, first: Column, n: Column, rate: Column) -> Column:
    """Place on the sample axis of an instant: inside a frame in proportion, before or after it at the nominal rate from
    its start or end (clocks in the same unit as 1 / rate). Before the first frame it may be negative."""
    inside = first + (at - start) / (end - start) * n
    return F.when(at < start, first + (at - start) * rate).when(at <= end, inside).otherwise(first + n + (at - end) * rate)


def asof_or_first(left: DataFrame, right: DataFrame, by: str, at: str, start: str, take: list[str]) -> DataFrame:
    """asof_backward(), but rows before the first right row get that one (null where `by` has none)."""
    firsts = right.groupBy(F.col(by).alias("__of")).agg(F.min_by(F.struct(*take), start).alias("__first"))
    met = asof_backward(left, right.withColumn("__seen", F.lit(True)), by, at, start, [*take, "__seen"])
    met = met.join(firsts, F.col(by) == F.col("__of"), "left")
    got = [F.when(F.col("__seen"), F.col(c)).otherwise(F.col(f"__first.{c}")).alias(c) for c in take]
    return met.select(*left.columns, *got)


def asof_both(left: DataFrame, right: DataFrame, by: str, at: str, start: str, take: list[str], width: float) -> DataFrame:
    """left with `before` and `after`: the columns `take` of the last right row at or before it, and of the first at or
    after it, as structs (null where there is none; of right rows at one instant the greatest is before, the least after).

    Instants are looked at in slots of `width`, so that no task holds all rows of a `by`; what a slot needs of the others,
    the nearest right row on either side, travels over one row for each slot."""
    l = left.select(F.col(by).alias("__by"), F.col(at).alias("__at"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row"), F.lit(None).alias("__got"))
    r = right.select(F.col(by).alias("__by"), F.col(start).alias("__at"), F.lit(0).alias("__side"), F.lit(None).alias("__row"), F.struct(*take).alias("__got"))
    both = l.unionByName(r).withColumn("__slot", F.floor(F.col("__at") / width))
    slot, so_far = W.partitionBy("__by", "__slot"), (W.unboundedPreceding, 0)
    met = both.withColumn("__before", F.last("__got", ignorenulls=True).over(slot.orderBy("__at", "__side", "__got").rowsBetween(*so_far)))
    met = met.withColumn("__after", F.last("__got", ignorenulls=True).over(slot.orderBy(F.desc("__at"), "__side", F.desc("__got")).rowsBetween(*so_far)))
    place = F.when(F.col("__got").isNotNull(), F.struct("__at", "__got"))
    slots = both.groupBy("__by", "__slot").agg(F.max_by("__got", place).alias("__last"), F.min_by("__got", place).alias("__first"))
    along = W.partitionBy("__by").orderBy("__slot")
    slots = slots.select(
        F.col("__by").alias("__of"), F.col("__slot").alias("__in"),
        F.last("__last", ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, -1)).alias("__earlier"),
        F.first("__first", ignorenulls=True).over(along.rowsBetween(1, W.unboundedFollowing)).alias("__later"),
    )
    met = met.where("__side = 1").join(slots, F.col("__by").eqNullSafe(F.col("__of")) & F.col("__slot").eqNullSafe(F.col("__in")), "left")
    return met.select("__row.*", F.coalesce("__before", "__earlier").alias("before"), F.coalesce("__after", "__later").alias("after"))
