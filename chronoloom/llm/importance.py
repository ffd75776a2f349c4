"""Importance resampling towards a target distribution.

A document's weight is the mean gain of its features (runs of words, hashed to buckets): how much likelier their
buckets are in the target texts than in the corpus. Gains are one array with a place for each bucket. A Gumbel noise
made of the key is added to the weight, so that the highest scores are a draw without replacement by weight.

The draw's last row is found by radix selection: digit after digit of the composite key (score, then key, then row) is
counted over the rows that are still in question, which shrink with every digit. Only rows up to that key are
range-sorted and ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm._common import Saved, Scope, ascii_lower, column, numbered, table

BUCKETS, SEED, LEAST_WORDS, PERCENT = 10_000, 2024, 20, 10
#: Bits of a digit: at most 2^DIGIT counts of a pass reach the driver.
DIGIT = 16


def words_of(text: Column) -> Column:
    """Runs of digits, lower-cased letters and characters beyond ASCII."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]++")
    return F.filter(parts, lambda w: w != "")


def bucketed(texts: DataFrame, longest: int, buckets: int) -> DataFrame:
    """texts with `words` (an array) replaced by n_words and `bag`, the bucket of each feature."""
    def runs(n: int) -> Column:
        starts = F.when(F.size("words") >= n, F.sequence(F.lit(1), F.size("words") - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice("words", i, n), " "))

    features = F.concat(F.col("words"), *map(runs, range(2, longest + 1)))
    bag = F.transform(features, lambda f: F.pmod(F.crc32(f.cast("binary")), F.lit(buckets)).cast("int"))
    return texts.withColumn("n_words", F.size("words").cast("long")).withColumn("bag", bag).drop("words")


def gains(bags: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """The gain of each bucket; the list has `buckets` numbers, however many texts there are."""
    def counted(some: DataFrame, name: str) -> DataFrame:
        return some.select(F.explode("bag").alias("bucket")).groupBy("bucket").agg(F.count("*").alias(name))

    every = bags.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    met = every.join(counted(bags, "s"), "bucket", "left").join(counted(target, "t"), "bucket", "left").fillna(0)
    rows = met.select("bucket", *(F.col(c).cast("double").alias(c) for c in "st"))
    s, t = rows.agg(F.sum("s"), F.sum("t")).first()
    ratio = (F.col("t") + 1) * F.lit(s and s + buckets or float(buckets)) / ((F.col("s") + 1) * F.lit(t and t + buckets or float(buckets)))
    return [r.gain for r in rows.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).orderBy("bucket").collect()]


def kth(rows: DataFrame, digits: dict[str, Column], k: int) -> list[int]:
    """The digits, as many as are needed, of the k-th smallest key: just k rows have keys up to it. rows and digits
    must tell all rows apart, and hold k rows at least."""
    found, left = [], Saved(rows.select(*(d.alias(name) for name, d in digits.items())), "radix")
    for name in digits:
        counts = {r[name]: r["count"] for r in left.df.groupBy(name).count().collect()}  # 2^DIGIT rows at most
        for digit in sorted(counts):
            if k <= counts[digit]:
                break
            k -= counts[digit]
        found.append(digit)
        if k == counts[digit]:
            break
        before, left = left, Saved(left.df.where(F.col(name) == digit).drop(name), "radix")
        before.drop()
    left.drop()
    return found


def composite(score: str, key: str, row: str) -> dict[str, Column]:
    """Digits of (score descending, key ascending and null last, row) from the highest on, none below 0."""
    mask, half = F.lit((1 << DIGIT) - 1), 1 << DIGIT - 1
    top = lambda c, bits: F.shiftright(c, bits - DIGIT) + half  # noqa: E731  keeps the sign's order
    rest = lambda c, bits: [F.shiftrightunsigned(c, at).bitwiseAND(mask) for at in range(bits - 2 * DIGIT, -1, -DIGIT)]
    down, known = -F.col(score), F.coalesce(F.col(key).cast("long"), F.lit(0))
    every = [top(down, 32), *rest(down, 32), F.col(key).isNull().cast("int"), top(known, 64), *rest(known, 64), top(F.col(row), 64), *rest(F.col(row), 64)]
    return {f"d{i}": d for i, d in enumerate(every)}


def resampled(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", longest: int = 1,
    buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT,
) -> DataFrame:
    """key, row (unique), n_features, weight, score and rank of every document; rank counts the drawn ones, percent %
    of those with least_words words at least, from the highest score on, and is null for the others.

    Edge cases: a null text has no words, weight 0, and isn't drawn (while least_words is above 0); ties of score go to
    the smaller key, a null key (hashed as an empty one) last, and repeated rows by the order in which they are read;
    a repeated row is a document of its own; an empty table, of documents or targets, gives an empty result or gains
    against a flat target; extra columns are ignored. The key is a whole number.
    """
    with Scope() as scope:
        read = docs.select(column(key).cast("long").alias("key"), words_of(column(text)).alias("words"))
        bags = Saved(bucketed(read, longest, buckets).withColumn("row", F.monotonically_increasing_id()), "resample-bags").df
        goal = bucketed(target.select(words_of(column(target_text)).alias("words")), longest, buckets)
        gain = F.split(F.lit(",".join(map(str, gains(bags, goal, buckets)))), ",").cast("array<int>")
        total, n = F.aggregate("bag", F.lit(0).cast("long"), lambda sum_, b: sum_ + F.get(gain, b)), F.size("bag").cast("long")
        weight = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(F.lit(0)).cast("long")
        drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit("")).cast("string")), 256), 1, 8), 16, 10).cast("double")
        noise = F.floor(-1000 * F.log(-F.log((drawn + 0.5) / F.lit(4294967296.0))))
        scored = bags.select("row", "key", "n_words", n.alias("n_features"), total.alias("total")).withColumn("weight", weight)
        scored = Saved(scored.select("row", "key", "n_words", "n_features", "weight", (F.col("weight") + noise).cast("long").alias("score")), "resample-scores").df
        some = scored.where(F.col("n_words") >= least_words)
        k = some.count() * percent // 100
        digits = composite("score", "key", "row")
        if k:
            last = kth(some, digits, k)
            upto = F.struct(*list(digits.values())[: len(last)]) <= F.struct(*(F.lit(d).cast("long") for d in last))
            top = numbered(some.where(upto).select("row", "score", "key"), "resample-top", F.desc("score"), F.asc_nulls_last("key"), F.asc("row"))
            ranks = top.select("row", F.col("index").cast("long").alias("rank"))
        else:
            ranks = some.where("false").select("row", F.lit(None).cast("long").alias("rank"))
        return scope.result(scored.join(ranks, "row", "left").select("key", "row", "n_features", "weight", "score", "rank"), "resample-result")


def drawn_documents(docs: DataFrame, target: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The documents that resampled() draws, with their own columns and `draw_rank` (replaced if there is one). Rows that
    share a key, null included, go together, at their best rank; else as in resampled()."""
    ranks = resampled(docs, target, key, **options).where("rank is not null").groupBy(F.col("key").alias("__drawn_key")).agg(F.min("rank").alias("draw_rank"))
    own = docs.select(*(column(c) for c in docs.columns if c != "draw_rank"))
    met = own.join(ranks, column(key).cast("long").eqNullSafe(F.col("__drawn_key")))
    return met.drop("__drawn_key")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("key").alias("doc_id"), "n_features", "weight", "score", "rank")


#: DuckDB has no crc32: it is computed byte by byte with its table of 256 entries, once for each word.
OP11_SQL = r"""
with crc_table as (
  select list(list_reduce(list_prepend(b, range(8)), lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by b) as t
  from (select range::bigint as b from range(256))
), w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as words
  from documents
), g as (
  select list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as words
  from benchmark
), d as (select doc_id, unnest(words) as word from w), e as (select unnest(words) as word from g),
c as (
  select word, hex(encode(word)) as h from (select word from d union select word from e)
), k as (
  select word, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint)), lambda a, x: xor(a >> 8, t[(xor(a, x) % 256) + 1])), 4294967295) % 10000 as bucket
  from c, crc_table
), s as (select bucket, count(*) as s from d join k using (word) group by bucket),
t as (select bucket, count(*) as t from e join k using (word) group by bucket),
gain as (
  select b.bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select count(*) from d) + 10000)::double / ((coalesce(s, 0) + 1)::double * ((select count(*) from e) + 10000)::double)))::bigint as gain
  from (select range::bigint as bucket from range(10000)) b left join s using (bucket) left join t using (bucket)
), m as (
  select doc_id, sum(gain) as total from d join k using (word) join gain using (bucket) group by doc_id
), v as (
  select w.doc_id, len(words)::bigint as n_features, case when len(words) > 0 then floor(total::double / len(words))::bigint else 0 end as weight,
         ('0x' || substr(sha256('2024:' || w.doc_id), 1, 8))::bigint as h
  from w left join m using (doc_id)
), r as (
  select doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5)::double / 4294967296::double)))::bigint as score from v
), x as (
  select doc_id, row_number() over (order by score desc, doc_id) as rank from r where n_features >= 20
)
select r.doc_id, n_features, weight, score, case when rank <= (select count(*) * 10 // 100 from x) then rank end as rank
from r left join x using (doc_id)
"""
