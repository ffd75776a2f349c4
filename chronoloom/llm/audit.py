"""Audit of how filters interact: for every order of a set of filters, what each of its steps removes.

Each document's failures are a bit mask, and documents count by part and mask, a few cells. The cells are unpivoted
against the steps of all orders; a running bit-or along an order tells what an earlier step has removed; conditional
sums over the cells and totals over a filter's steps are the metrics.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.llm._common import Saved, Scope, column, table

#: Most filters whose orders are made: 720 of them.
MOST = 6
#: A text that makes up more than this share of all rows is met by broadcast; so at most 1 / HOT_SHARE are.
HOT_SHARE = 1 / 512
METRICS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def quality_failures(text: Column) -> dict[str, Column]:
    """The conditions A to D: short, repetitive, shouting, odd characters."""
    parts = F.filter(F.split(text, r"[\x20\x09-\x0D]++"), lambda w: w != "")
    # bound in an outer transform, so that the text is split once
    words = F.transform(F.array(parts), lambda p: F.struct(F.size(p).cast("long").alias("n"), F.size(F.array_distinct(p)).cast("long").alias("distinct")))[0]
    n, capitals = F.length(text), F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    sized = lambda test: F.transform(F.array(words), test)[0]
    return {
        "A": sized(lambda w: w["n"] < 200), "B": sized(lambda w: 100 * w["distinct"] < 50 * w["n"]),
        "C": 100 * capitals.cast("long") > 2 * n.cast("long"), "D": text.rlike(r"[#$%&*|]"),
    }


def copies(rows: DataFrame, key: str, digest: str) -> DataFrame:
    """rows with `copy`: whether a row of a smaller key has the same digest. A digest that very many rows have is met by
    broadcast, all others by a join."""
    firsts = Saved(rows.groupBy(digest).agg(F.min(key).alias("__first"), F.count("*").alias("__copies")).where("__copies > 1"), "audit-firsts").df
    limit = max(1, int(rows.count() * HOT_SHARE))
    hot, cold = firsts.where(F.col("__copies") > limit), firsts.where(F.col("__copies") <= limit)
    met = rows.join(F.broadcast(hot), digest).unionByName(rows.join(F.broadcast(hot.select(digest)), digest, "left_anti").join(cold, digest, "left"), allowMissingColumns=True)
    return met.withColumn("copy", F.coalesce(F.col(key) > F.col("__first"), F.lit(False))).drop("__first", "__copies")


def interactions(cells: DataFrame, filters: str) -> DataFrame:
    """part, filter_order, step, filter and the METRICS and shapley of cells: part, mask (bit i: the i-th filter fails), n,
    good and toxic (documents, and those of them with a label)."""
    if len(filters) > MOST:
        raise ValueError(f"the orders of more than {MOST} filters are too many")
    orders = ",".join(map("".join, itertools.permutations(filters)))
    steps = cells.withColumn("filter_order", F.explode(F.split(F.lit(orders), ",")))
    steps = steps.select("*", F.posexplode(F.split("filter_order", "")).alias("at", "filter")).where("filter <> ''")
    bit = F.expr(f"shiftleft(1, instr('{filters}', filter) - 1)")
    steps = steps.withColumn("step", F.col("at") + 1).withColumn("bit", bit).withColumn("fails", F.col("mask").bitwiseAND(F.col("bit")))
    along = W.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    steps = steps.withColumn("earlier", F.coalesce(F.bit_or("fails").over(along), F.lit(0)))
    fails, gone = F.col("fails") > 0, F.col("earlier") > 0
    some = lambda test, value: F.coalesce(F.sum(F.when(test, F.col(value))), F.lit(0)).cast("long")
    sums = [some(~fails & ~gone, "n"), some(fails & ~gone, "n"), some(fails & gone, "n"), some(F.col("mask") == F.col("bit"), "n"), some(fails & ~gone, "good"), some(fails & ~gone, "toxic")]
    out = steps.groupBy("part", "filter_order", "step", "filter").agg(*(s.alias(m) for s, m in zip(sums, METRICS, strict=True)))
    return out.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", "filter")).cast("long"))


def audited(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """A row for each part, order of the filters A to E and step, as interactions() has them. A to D are those of
    quality_failures(); E: a smaller key has the same text. labels: key, quality and toxic.

    Edge cases: null and empty texts are the same empty text; a null part is the empty part; a null key has no label, is
    no copy and makes none; repeated rows are documents of their own, and none is a copy of another with its own key; of
    a key with several labels any that is 1 counts; an empty table has no parts and gives no rows; extra columns are
    ignored.
    """
    with Scope() as scope:
        body = F.coalesce(column(text), F.lit(""))
        tests = quality_failures(body)
        mask = sum((F.shiftleft(t.cast("int"), i) for i, t in enumerate(tests.values())), F.lit(0))
        rows = docs.select(column(key).alias("key"), F.coalesce(column(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(body, 256)).alias("digest"), mask.alias("mask"))
        rows = copies(Saved(rows, "audit-rows").df, "key", "digest")
        every = rows.withColumn("mask", F.col("mask") + F.shiftleft(F.col("copy").cast("int"), len(tests)))
        # rows of one key count together before they meet its label
        counted = every.groupBy("key", "part", "mask").agg(F.count("*").alias("n"))
        one = lambda c: F.coalesce(F.max((column(c) == 1).cast("int")), F.lit(0))
        known = labels.groupBy(column(key).alias("__key")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
        met = counted.join(known, F.col("key") == F.col("__key"), "left")
        times = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)) * F.col("n")).alias(c)
        cells = Saved(met.groupBy("part", "mask").agg(F.sum("n").alias("n"), times("good"), times("toxic")), "audit-cells").df
        return scope.result(interactions(cells, "".join(tests) + "E"), "audit-result")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("part", "filter_order", "step", *METRICS, "shapley")


OP12_SQL = r"""
with d as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words
  from documents
), f as (
  select doc_id, part, [
    len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text),
    regexp_matches(text, '[#$%&*|]'), doc_id > min(doc_id) over (partition by text)] as fails
  from d
), l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
c as (
  select part, fails, count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic from f left join l using (doc_id) group by part, fails
), x as (select * from (values (1, 'A'), (2, 'B'), (3, 'C'), (4, 'D'), (5, 'E')) as x(i, name)),
o as (
  select a.name || b.name || c.name || d.name || e.name as filter_order, [a.i, b.i, c.i, d.i, e.i] as places
  from x a, x b, x c, x d, x e where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), s as (
  select filter_order, step::int as step, places[step] as i, places[1:step - 1] as before from o, range(1, 6) as r(step)
), m as (
  select part, filter_order, step, i, n, good, toxic, fails[i] as fail, len(list_filter(before, lambda j: fails[j])) > 0 as gone, fail and len(list_filter(fails, lambda z: z)) = 1 as lone
  from c, s
), r as (
  select part, filter_order, step, i, coalesce(sum(n) filter (not fail and not gone), 0)::bigint as kept, coalesce(sum(n) filter (fail and not gone), 0)::bigint as removed,
         coalesce(sum(n) filter (fail and gone), 0)::bigint as redundant, coalesce(sum(n) filter (lone), 0)::bigint as unique_fails,
         coalesce(sum(good) filter (fail and not gone), 0)::bigint as good_lost, coalesce(sum(toxic) filter (fail and not gone), 0)::bigint as toxic_lost
  from m group by part, filter_order, step, i
)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, i))::bigint as shapley from r
"""
