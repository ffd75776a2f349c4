"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order, read at most `max_epochs` times. An entry of the queue
has a virtual start and finish: the words of its source before and after it, divided by the source's target. All
entries are range-sorted by virtual finish and the stream is cut where the total budget is spent; targets add up to
the budget, so that is virtual time 1, and the one entry of each source in service then is cut with it.

The range sort is by slots of virtual time: a slot is a range of finish times, sorted inside. Running sums go in
levels: inside buckets of the shuffle order (or slots) that hold some hundred rows each, over the buckets of a group of
GROUP, and over one row for each group. No task holds a whole source, however large it is.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.llm._common import WORD, Scope, column, saved, table

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 2
#: The budget is BUDGET[0] / BUDGET[1] of all words.
BUDGET = (3, 2)
#: Documents in one bucket of the shuffle order, at most about.
BUCKET_ROWS = 512
#: Buckets or slots in a group, a power of 16.
GROUP = 4096


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_order(key: Column) -> Column:
    """The same for a key in every run: its digest as hexadecimal text."""
    return F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))


def sized_documents(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """Written once, as both the targets and the queues read it: key, queue, size, order and a number for each row.
    `queue` names the source and is never null: 's' and its name, or '~', which sorts last."""
    queue = F.coalesce(F.concat(F.lit("s"), column(source).cast("string")), F.lit("~"))
    out = docs.select(column(key).alias("key"), queue.alias("queue"), words_in(column(text)).alias("size"), shuffle_order(column(key)).alias("order"))
    return saved(out.withColumn("row", F.monotonically_increasing_id()), "mix-sizes")


def queue_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, budget: tuple[int, int] = BUDGET) -> DataFrame:
    """queue, source_size and target: one row for each source, and all windows run over these rows only.

    Sources by code point, null last, take the weights in turn and share the budget by weight; a target stops at
    max_epochs times its source's size and the excess is shared anew, until none is above.
    """
    a, b = budget
    every = W.partitionBy()
    by_fill = W.orderBy(F.col("source_size") * F.expr(f"{math.prod(weights)} div weight"), "queue")
    before = by_fill.rowsBetween(W.unboundedPreceding, -1)
    turn = (F.row_number().over(W.orderBy("queue")) - 1) % len(weights)
    out = sized.groupBy("queue").agg(F.sum("size").alias("source_size"))
    out = out.withColumn("weight", F.get(F.array(*map(F.lit, weights)), turn).cast("long"))
    out = out.select(
        "*",  # left: b times the budget that the sources before leave
        (a * F.sum("source_size").over(every) - b * max_epochs * F.coalesce(F.sum("source_size").over(before), F.lit(0))).alias("left"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("shares"),
    )
    out = out.withColumn("full", b * max_epochs * F.col("source_size") * F.col("shares") <= F.col("left") * F.col("weight"))
    first = lambda c: F.max_by(F.col(c), F.when(~F.col("full"), F.col("shares"))).over(every)
    out = out.select("*", first("left").alias("rest"), first("shares").alias("rest_shares"))
    shared = F.col("rest").cast("double") * F.col("weight") / (b * F.col("rest_shares"))
    return out.select("queue", "source_size", F.when(F.col("full"), (max_epochs * F.col("source_size")).cast("double")).otherwise(shared).alias("target"))


def running_before(sums: DataFrame, within: list[str], order: str, group: Column, value: str) -> DataFrame:
    """sums with `before`: the sum of `value` in the rows before, by `order` inside `within`. `group` puts rows that
    are next to each other together and rises with `order`."""
    grouped = sums.withColumn("__group", group)
    tops = grouped.groupBy(*within, "__group").agg(F.sum(value).alias("__sum"))
    tops = tops.select(*within, "__group", (F.sum("__sum").over(W.partitionBy(*within).orderBy("__group")) - F.col("__sum")).alias("__top"))
    inside = F.sum(value).over(W.partitionBy(*within, "__group").orderBy(order)) - F.col(value)
    return grouped.withColumn("__inside", inside).join(tops, [*within, "__group"]).withColumn("before", F.col("__top") + F.col("__inside")).drop("__group", "__top", "__inside")


def entries(sized: DataFrame, rows: int, targets: DataFrame, max_epochs: int) -> DataFrame:
    """Each document once an epoch: its virtual start and finish, and `served`, the words it gives until virtual time 1."""
    digits = max(0, math.ceil(math.log(max(1, rows / BUCKET_ROWS), 16)))
    sized = sized.withColumn("bucket", F.substring("order", 1, digits) if digits else F.lit(""))
    buckets = sized.groupBy("queue", "bucket").agg(F.sum("size").alias("bucket_size"))
    group = F.substring("bucket", 1, max(0, digits - int(math.log(GROUP, 16))))
    buckets = running_before(buckets, ["queue"], "bucket", group, "bucket_size").withColumnRenamed("before", "bucket_start")
    buckets = buckets.drop("bucket_size").join(targets, "queue")
    within = W.partitionBy("queue", "bucket").orderBy("order", "size", "row").rowsBetween(W.unboundedPreceding, 0)
    placed = sized.withColumn("in_bucket", F.sum("size").over(within) - F.col("size")).join(buckets, ["queue", "bucket"])
    epochs = placed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
    begin = F.col("bucket_start") + F.col("in_bucket") + F.col("epoch") * F.col("source_size")
    over = lambda tokens: F.when(F.col("target") > 0, tokens / F.col("target")).otherwise(F.lit(0.0))
    served = F.greatest(F.lit(0), F.least(F.col("size"), F.floor(F.col("target") + 0.5) - begin)).cast("long")
    return epochs.select(
        "row", "key", "queue", "size", "source_size", "target", "order", "epoch",
        over(begin).alias("start"), over(begin + F.col("size")).alias("finish"), served.alias("served"),
    )


def cut_stream(stream: DataFrame, rows: int, total: int, budget: tuple[int, int]) -> DataFrame:
    """The entries in service before virtual time 1 with `offset`, the words before them in the order of virtual
    finish, and `taken`, what the budget leaves of `served`."""
    slots = max(1, rows // BUCKET_ROWS)
    stream = stream.where("served > 0").withColumn("slot", F.floor(F.least(F.col("finish"), F.lit(1.0)) * slots))
    starts = stream.groupBy("slot").agg(F.sum("served").alias("slot_served"))
    starts = running_before(starts, [], "slot", F.floor(F.col("slot") / GROUP), "slot_served").select("slot", F.col("before").alias("slot_start"))
    within = W.partitionBy("slot").orderBy("finish", "queue", "epoch", "order", "row").rowsBetween(W.unboundedPreceding, 0)
    stream = stream.withColumn("in_slot", F.sum("served").over(within) - F.col("served")).join(starts, "slot")
    stream = stream.withColumn("offset", F.col("slot_start") + F.col("in_slot"))
    left = F.lit(total * budget[0] // budget[1]) - F.col("offset")
    return stream.withColumn("taken", F.greatest(F.lit(0), F.least(F.col("served"), left))).where("taken > 0").drop("slot", "in_slot", "slot_start")


class Mix:
    """sizes: a row for each document (row, key, queue, size, order); targets; stream: what the mix takes, in order.

    Edge cases: a null text has size 0, takes nothing and is in no stream; null sources are one source; a null key
    counts as empty text in the shuffle order; repeated rows are documents of their own; an empty table gives an
    empty stream; extra columns are ignored.
    """

    def __init__(self, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, budget: tuple[int, int] = BUDGET, key: str = "doc_id", text: str = "text", source: str = "source") -> None:
        self.sizes = sized_documents(docs, key, text, source)
        rows, total = self.sizes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        self.targets = saved(queue_targets(self.sizes, weights, max_epochs, budget), "mix-targets")
        self.entries = entries(self.sizes, rows, self.targets, max_epochs)
        self._cut = cut_stream(self.entries, rows, total, budget)

    @property
    def stream(self) -> DataFrame:
        return self._cut.repartitionByRange("finish", "queue").sortWithinPartitions("finish", "queue", "epoch", "order", "row")

    def by_document(self) -> DataFrame:
        """row, key, size, source_size, target and taken of every document, also those that the mix leaves out."""
        taken = self._cut.groupBy("row").agg(F.sum("taken").alias("taken"))
        placed = self.entries.where("epoch = 0").select("row", "key", "size", "source_size", "target")
        return placed.join(taken, "row", "left").fillna(0, ["taken"])


def mix_by_document(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Mix.by_document(), computed; what the mix has written meanwhile is dropped."""
    with Scope() as scope:
        return scope.result(Mix(docs, key=key, text=text, source=source).by_document(), "mix-result")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_by_document(table(spark, sf_dir, "documents"))
    return out.select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents that the mix takes words of: their own columns, then mix_size, mix_target and mix_taken (columns
    of these names are replaced).

    Edge cases: as in Mix; documents without words are taken never; rows that share a key, null included, are counted
    together, and each shows the sum; columns of other names pass through; an empty table stays empty.
    """
    mixed = mix_by_document(docs, key, text, source).where("taken > 0").groupBy("key")
    mixed = mixed.agg(F.sum("size").alias("mix_size"), F.max("target").alias("mix_target"), F.sum("taken").alias("mix_taken"))
    kept = [c for c in docs.columns if c not in ("mix_size", "mix_target", "mix_taken")]
    # the table's columns go in one struct, so that no name of theirs meets one of ours
    own = docs.select(F.struct(*map(column, kept)).alias("own"), column(key).alias("own_key"))
    met = own.join(mixed, F.col("own_key").eqNullSafe(F.col("key")))
    return met.select(*(F.col("own")[c].alias(c) for c in kept), "mix_size", "mix_target", "mix_taken")


OP1_SQL = r"""
with d as (
  select doc_id, coalesce('s' || source, '~') as queue, md5(coalesce(cast(doc_id as varchar), '')) as ord,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size
  from documents
), s as (
  select queue, sum(size)::hugeint as source_size, [5, 2, 1][(row_number() over (order by queue) - 1) % 3 + 1]::hugeint as weight
  from d group by queue
), f as (
  select *, 3 * sum(source_size) over () - 4 * coalesce(sum(source_size) over (order by source_size * (10 // weight), queue rows between unbounded preceding and 1 preceding), 0) as rest,
         sum(weight) over () - coalesce(sum(weight) over (order by source_size * (10 // weight), queue rows between unbounded preceding and 1 preceding), 0) as shares
  from s
), g as (select *, 4 * source_size * shares <= rest * weight as full_ from f),
h as (select max_by(rest, shares) as rest0, max(shares) as shares0 from g where not full_),
t as (
  select queue, source_size::bigint as source_size,
         case when full_ then (2 * source_size)::double else rest0::double * weight::double / (2 * shares0)::double end as target
  from g, h
), q as (
  select d.*, source_size, target, sum(size) over (partition by d.queue order by ord, size rows between unbounded preceding and current row) - size as begins
  from d join t on d.queue = t.queue
), e as (
  select *, case when target > 0 then (begins + epoch * source_size + size)::double / target else 0 end as finish,
         greatest(0, least(size, floor(target + 0.5)::bigint - begins - epoch * source_size)) as served
  from q, (values (0), (1)) as v(epoch)
), c as (
  select *, sum(served) over (order by finish, queue, epoch, ord rows between unbounded preceding and current row) - served as off
  from e where served > 0
), k as (
  select doc_id, sum(greatest(0, least(served, (select (sum(size) * 3) // 2 from d) - off)))::bigint as taken from c group by doc_id
)
select q.doc_id, q.size, q.source_size, q.target, coalesce(k.taken, 0)::bigint as taken
from q left join k on q.doc_id = k.doc_id
"""
