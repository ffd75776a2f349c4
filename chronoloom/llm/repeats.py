"""Exact repeats: every byte covered by a string of LENGTH bytes that also starts elsewhere is removed.

Induced suffix sorting isn't what runs: no suffix is ordered and no common prefix is measured. It was replaced by
winnowed anchors, and content is compared by 64-bit hashes, not byte by byte (see the README for collisions):

1. A window of LENGTH bytes holds SPAN grams of GRAM bytes; the gram with the smallest hash is its anchor. Anchors are
   about 1 % of the positions and are the same wherever a window repeats. Only anchors that occur twice matter.
2. From each anchor runs a region to the end of the first anchor that is a gram behind the next one; it is LENGTH
   bytes or longer, and its windows reach the next region's. A region whose content occurs twice is covered whole, so
   its windows need no look.
3. The windows that hold a repeated anchor and are in no repeated region (the ends of repeats), together with those of
   one occurrence of each repeated region, are compared by content. A window that occurs twice is covered. To spare
   most of them, blocks a little shorter than a window are compared first, a few for each anchor; only windows that
   hold a repeated block are looked up.

Passages of PASSAGE words that also stand in another document, however few bytes they have and whatever blanks are
between the words, are counted besides and not removed: in the same way, words stand for bytes, WORDS_GRAM words for a
gram, and all windows that hold an anchor of two documents are compared.

Spark's shuffles sort and spill the tuples (content hash, document, position) outside memory, as keys of joins and
aggregations; no task holds more than a batch of texts and no list of a group is gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm._common import Saved, Scope, rows_of, table
from chronoloom.llm.neardup import scrambled

LENGTH, GRAM = 400, 200
#: The words of a passage of over 50 words, at least, and of a gram in it.
PASSAGE, WORDS_GRAM = 51, 26
#: Blocks are shorter than windows by a length of which a window has so many.
STRIDES = 8
#: A key that has more than this share of all rows is joined by broadcast.
HOT_SHARE = 1 / 512
_BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(20240301).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Powers:
    """Powers of the base and of its inverse, as long as the longest text so far."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            made = [np.full(max(n, 1 << 16), x, np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
            for x in made:
                x[0] = 1
            cls.up, cls.down = (np.cumprod(x, dtype=np.uint64) for x in made)
        return cls.up[:n], cls.down[:n]


class Rolling:
    """64-bit hashes of any substrings of one text, from a running sum of bytes times powers of the base."""

    def __init__(self, data: bytes) -> None:
        self._add_up(_BYTES[np.frombuffer(data, np.uint8)])

    def _add_up(self, values: np.ndarray) -> None:
        n = len(values)
        up, self.down = Powers.upto(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * up[:n], out=self.sums[1:])

    def words(self, data: bytes) -> Rolling:
        """The hashes of any runs of words of the same text; whatever blanks are between words don't count."""
        x = np.frombuffer(data, np.uint8)
        edge = np.diff(((x != 0x20) & ((x < 0x09) | (x > 0x0D))).astype(np.int8), prepend=np.int8(0), append=np.int8(0))
        starts = np.flatnonzero(edge == 1)
        out = Rolling.__new__(Rolling)
        out._add_up(self.at(starts, np.flatnonzero(edge == -1) - starts))
        return out

    def at(self, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
        return scrambled((self.sums[starts + lengths] - self.sums[starts]) * self.down[starts] + np.uint64(1) * np.asarray(lengths, np.uint64))

    def every(self, length: int) -> np.ndarray:
        return scrambled((self.sums[length:] - self.sums[:-length]) * self.down[: len(self.sums) - length] + np.uint64(length))


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    w = 1
    while w * 2 <= width:
        x, w = np.minimum(x[:-w], x[w:]), w * 2
    return np.minimum(x[: len(x) - (width - w)], x[width - w :]) if width > w else x


def minimal(x: np.ndarray, width: int) -> np.ndarray:
    """Where x has a value that is the least of any `width` values in a row. The least values are few and come in runs,
    so that each value of x is looked up among one of each run."""
    least = sliding_minimum(x, width)
    ends = np.sort(least[np.append(np.flatnonzero(least[1:] != least[:-1]), len(least) - 1)])
    return np.flatnonzero(ends[np.minimum(np.searchsorted(ends, x), len(ends) - 1)] == x)


def anchors_of(roll: Rolling, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors, and the content hash and size of each one's region (0: it has none)."""
    grams = roll.every(gram)
    at = minimal(grams, length - gram + 1)
    last = np.searchsorted(at, np.append(at[1:], len(roll.sums) - 1) + gram)  # so that a region's windows reach the next one's
    has = last < len(at)
    size = np.where(has, at[np.minimum(last, len(at) - 1)] + gram - at, 0)
    size = np.where(size >= length, size, 0)
    region = scrambled(grams[at] + np.uint64(1))
    some = size > 0
    region[some] = roll.at(at[some], size[some])
    return at, grams[at], region, size


def word_anchors(roll: Rolling) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of a text's windows of PASSAGE words."""
    if len(roll.sums) <= PASSAGE:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    grams = roll.every(WORDS_GRAM)
    at = minimal(grams, PASSAGE - WORDS_GRAM + 1)
    return at, grams[at]


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """By place below n, whether any of the ranges, ends exclusive, holds it."""
    return np.cumsum(np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1))[:n] > 0


def lists_of(column: pa.ListArray) -> Iterator[np.ndarray]:
    """The lists of a column of numbers, an array each; null is an empty one."""
    values, at = column.values.to_numpy(), column.offsets.to_numpy()
    return (values[a:b] for a, b in zip(at[:-1], at[1:], strict=True))


def marks_of(column: pa.ListArray) -> Iterator[dict[str, np.ndarray]]:
    """The marks of each text of a column, by field."""
    fields = {k: column.values.field(k).to_numpy(zero_copy_only=False) for k in ("pos", "size", "twice", "chosen")}
    at = column.offsets.to_numpy()
    return ({k: x[a:b] for k, x in fields.items()} for a, b in zip(at[:-1], at[1:], strict=True))


def word_windows(anchors: np.ndarray, n: int) -> np.ndarray:
    """Starts of the windows of PASSAGE words, of n words, that hold one of the anchors."""
    return np.flatnonzero(covered(np.maximum(anchors - (PASSAGE - WORDS_GRAM), 0), np.minimum(anchors, n - PASSAGE) + 1, n - PASSAGE + 1))


def windows(marks: dict[str, np.ndarray], n: int, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a text of n bytes, by window start: whether it is to look up, to look among (one occurrence of each repeated
    region), and in a repeated region."""
    last = n - length
    p, repeated = marks["pos"], marks["twice"] & (marks["size"] > 0)
    near = covered(np.maximum(p - (length - gram), 0), np.minimum(p, last) + 1, last + 1)
    end = p + marks["size"] - length + 1
    done, shown = (covered(p[x], end[x], last + 1) for x in (repeated, repeated & marks["chosen"]))
    return near & ~done, shown & done, done


def blocks_of(marks: dict[str, np.ndarray], n: int, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the blocks in whose reach windows are to look up or among, and whether to look up.

    A block is `length` less stride bytes from a multiple of stride before an anchor. A window holds the block that
    starts at it or less than a stride behind it, counted from its anchor, so equal windows hold equal blocks."""
    ask, show, _ = windows(marks, n, length, gram)
    stride, last = length // STRIDES, n - length
    p = marks["pos"].astype(np.int64)[:, None]
    start = p - np.arange(0, length - gram + stride, stride)
    low, high = np.maximum(np.maximum(start - stride + 1, p - (length - gram)), 0), np.minimum(np.minimum(start, p), last)
    inside = low <= high
    low, high = np.where(inside, low, 0), np.where(inside, high, -1)
    asks, shows = (np.concatenate([[0], np.cumsum(x)]) for x in (ask, show))
    asked = inside & (asks[high + 1] > asks[low])
    wanted = asked | inside & (shows[high + 1] > shows[low])
    starts, first = np.unique(start[wanted], return_inverse=True)
    return starts, np.bincount(first, asked[wanted], len(starts)) > 0


def in_blocks(starts: np.ndarray, n: int, length: int) -> np.ndarray:
    """By window start, whether it holds one of the blocks."""
    stride, last = length // STRIDES, n - length
    return covered(np.maximum(starts - stride + 1, 0), np.minimum(starts, last) + 1, last + 1)


def _scan(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def lists(found: list[tuple[np.ndarray, ...]], kinds: dict[str, type]) -> pa.ListArray:
        offsets = np.concatenate([[0], np.cumsum([len(f[0]) for f in found])])
        flat = [np.concatenate([f[i].view(c) if f[i].dtype == np.uint64 else f[i].astype(c) for f in found]) for i, c in enumerate(kinds.values())]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(x) for x in flat], names=list(kinds)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rows_of(batch, 256):
                texts = [(t or "").encode("utf-8", "surrogatepass") for t in part.column(1).to_pylist()]
                found, passages, n_words = [], [], []
                for b in texts:
                    roll = Rolling(b)
                    words = roll.words(b)
                    found.append(anchors_of(roll, length, gram) if len(b) >= length else (np.empty(0, np.int64),) * 4)
                    passages.append(word_anchors(words))
                    n_words.append(len(words.sums) - 1)
                columns = [part.column(0), pa.array([hashlib.sha256(b).hexdigest() for b in texts]), pa.array([len(b) for b in texts], pa.int64())]
                columns += [lists(found, {"pos": np.int32, "gram": np.int64, "region": np.int64, "size": np.int32}), pa.array(n_words, pa.int64()), lists(passages, {"at": np.int32, "gram": np.int64})]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "sha", "n_bytes", "anchors", "n_words", "passages"])

    kind = docs.schema[0].dataType.simpleString()
    return docs.mapInArrow(run, f"key {kind}, sha string, n_bytes long, anchors array<struct<pos:int,gram:long,region:long,size:int>>, n_words long, passages array<struct<at:int,gram:long>>")


def _hashed(texts: DataFrame, length: int, find: Callable[..., tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """content, class, at and ask: the hashes of `length` bytes from the places in a text that `find` gives, from its
    size, its marks and, if texts has them, its open blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rows_of(batch, 64):
                out = []
                more = [marks_of(part.column("marks")), *(lists_of(part.column(k)) for k in part.schema.names[3:])]
                for n, t, *told in zip(part.column("class").to_pylist(), part.column("text").to_pylist(), *more, strict=True):
                    data = t.encode("utf-8", "surrogatepass")
                    at, ask = find(len(data), *told)
                    out.append((Rolling(data).at(at, length).view(np.int64), np.full(len(at), n), at.astype(np.int32), ask))
                columns = [pa.array(np.concatenate(x)) for x in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["content", "class", "at", "ask"])

    return texts.mapInArrow(run, "content long, class long, at int, ask boolean")


def _blocks(texts: DataFrame, length: int, gram: int) -> DataFrame:
    return _hashed(texts.select("class", "text", "marks"), length - length // STRIDES, lambda n, marks: blocks_of(marks, n, length, gram))


def _windows(texts: DataFrame, length: int, gram: int) -> DataFrame:
    def find(n: int, marks: dict[str, np.ndarray], open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ask, show, _ = windows(marks, n, length, gram)
        at = np.flatnonzero((ask | show) & in_blocks(open_, n, length))
        return at, ask[at]

    return _hashed(texts.select("class", "text", "marks", "open"), length, find)


def _passages(texts: DataFrame) -> DataFrame:
    """content, class and at (in words) of the windows of PASSAGE words that hold an anchor of two documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rows_of(batch, 64):
                out = []
                for n, t, marks in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), lists_of(part.column(2)), strict=True):
                    data = t.encode("utf-8", "surrogatepass")
                    words = Rolling(data).words(data)
                    at = word_windows(marks, len(words.sums) - 1)
                    out.append((words.at(at, PASSAGE).view(np.int64), np.full(len(at), n), at.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["content", "class", "at"])

    return texts.select("class", "text", "word_marks").mapInArrow(run, "content long, class long, at int")


def _in_two(rows: DataFrame, key: str, name: str) -> DataFrame:
    """The rows whose key two classes have."""
    total = rows.agg(F.count("*")).first()[0]
    counts = rows.groupBy(key).agg(F.count("*").alias("k"), F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select(key, "k")
    return _met(rows, key, Saved(counts, name).df, total)


def _met(rows: DataFrame, key: str, counts: DataFrame, total: int) -> DataFrame:
    """rows with counts' other columns, joined by key; counts has a row for each key, with `k`, how many rows have it.
    A key of more than HOT_SHARE of all rows is met by broadcast (there are 1 / HOT_SHARE of them at most), so that no
    task gathers its rows."""
    hot = F.col("k") > max(1, int(total * HOT_SHARE))
    few = F.broadcast(counts.where(hot))
    rest = rows.join(F.broadcast(counts.where(hot).select(key)), key, "left_anti").join(counts.where(~hot), key)
    return rows.join(few, key).unionByName(rest).drop("k")


def _asked_again(looked: DataFrame, scope_name: str) -> DataFrame:
    """class and at of the places to look up whose content stands elsewhere too, and of those it stands at."""
    total = looked.agg(F.count("*")).first()[0]
    again = looked.groupBy("content").agg(F.count("*").alias("k"), F.bool_or("ask").alias("asked")).where("k > 1 and asked").drop("asked")
    return _met(looked, "content", Saved(again, scope_name).df, total)


def _cut(texts: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rows_of(batch, 64):
                out = []
                for sha, t, marks, found in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), marks_of(part.column(2)), lists_of(part.column(3)), strict=True):
                    data = np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)
                    starts = np.concatenate([np.flatnonzero(windows(marks, len(data), length, gram)[2]), found])
                    gone = covered(starts, starts + length, len(data))
                    begins = np.flatnonzero(gone & ~np.concatenate([[False], gone[:-1]]))
                    ends = np.flatnonzero(gone & ~np.concatenate([gone[1:], [False]])) + 1
                    out.append((sha, int(gone.sum()), [{"start": int(a), "end": int(b)} for a, b in zip(begins, ends, strict=True)], hashlib.sha256(data[~gone].tobytes()).hexdigest()))
                spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                kinds = (pa.string(), pa.int64(), spans, pa.string())
                columns = [pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=["c_sha", "c_removed", "c_spans", "c_kept"])

    return texts.select("sha", "text", "marks", "found").mapInArrow(run, "c_sha string, c_removed long, c_spans array<struct<start:long,end:long>>, c_kept string")


def repeated_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """key, n_bytes, n_removed, removed (maximal runs of bytes, end exclusive), kept_sha256 and n_passage_words (words of
    passages of PASSAGE words or more that also stand in another document) of every row.

    Edge cases: a null text is an empty one; texts shorter than `length` lose nothing and take nothing from others;
    rows with one text, also repeated rows and null keys, are documents of their own, so each such text of `length`
    bytes or more goes whole; extra columns are ignored; an empty table gives an empty result.
    """
    with Scope() as scope:
        return scope.result(_repeated_bytes(docs, key, text, length, gram), "repeat-result")


def _repeated_bytes(docs: DataFrame, key: str, text: str, length: int, gram: int) -> DataFrame:
    source = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    scanned = Saved(_scan(source, length, gram), "repeat-scan")
    rows = Saved(scanned.df.drop("anchors", "passages"), "repeat-rows")
    classes = scanned.df.groupBy("sha").agg(F.count("*").alias("copies"), F.min("key").alias("head"), F.first("anchors").alias("anchors"), F.first("passages").alias("passages"))
    held = Saved(classes.withColumn("class", F.monotonically_increasing_id()), "repeat-held")
    scanned.drop()
    classes = Saved(held.df.drop("anchors", "passages"), "repeat-classes")
    anchors = held.df.select("class", F.inline("anchors"))
    total = anchors.agg(F.count("*")).first()[0]
    twice = Saved(anchors.groupBy("gram").agg(F.count("*").alias("k")).where("k > 1"), "repeat-grams")
    anchors = Saved(_met(anchors, "gram", twice.df, total).drop("gram"), "repeat-anchors")
    twice.drop()
    shared = _in_two(held.df.select("class", F.inline("passages")), "gram", "repeat-grams").groupBy("class").agg(F.collect_list("at").alias("word_marks"))
    shared = Saved(shared, "repeat-passages")
    held.drop()
    regions = anchors.df.groupBy("region").agg(F.count("*").alias("k"), F.min(F.struct("class", "pos")).alias("one"))
    known = _met(anchors.df, "region", Saved(regions, "repeat-regions").df.withColumn("one", F.when(F.col("k") > 1, F.col("one"))), total)
    mark = F.struct("pos", "size", F.col("one").isNotNull().alias("twice"), F.coalesce(F.struct("class", "pos") == F.col("one"), F.lit(False)).alias("chosen"))
    marks = known.groupBy("class").agg(F.collect_list(mark).alias("marks"))
    marks = marks.join(shared.df, "class", "full")
    marks = marks.join(classes.df.select("class", F.col("sha").alias("m_sha"), "head"), "class")
    named = source.withColumn("sha", F.sha2("text", 256))
    texts = Saved(named.join(marks, (named["sha"] == marks["m_sha"]) & named[key].eqNullSafe(marks["head"])).select("sha", "class", "text", "marks", "word_marks").dropDuplicates(["sha"]), "repeat-texts")
    anchors.drop(), shared.drop()
    passages = Saved(_passages(texts.df.where("word_marks is not null")), "repeat-passages")
    # words of the windows' union: of each, those up to the next one's start
    union = F.aggregate(F.array_sort(F.collect_list("at")), F.struct(F.lit(-PASSAGE).alias("last"), F.lit(0).cast("long").alias("n")), lambda u, x: F.struct(x.alias("last"), (u["n"] + F.least(F.lit(PASSAGE), x - u["last"])).alias("n")), lambda u: u["n"])
    in_passages = Saved(_in_two(passages.df, "content", "repeat-again").groupBy("class").agg(union.alias("p_words")), "repeat-in-passages")
    passages.drop()
    near = texts.df.where("marks is not null").drop("word_marks")
    blocks = Saved(_blocks(near, length, gram), "repeat-blocks")
    open_ = _asked_again(blocks.df, "repeat-again").groupBy("class").agg(F.collect_list("at").alias("open"))
    looked = Saved(_windows(near.join(open_, "class"), length, gram), "repeat-windows")
    blocks.drop()
    hits = _asked_again(looked.df, "repeat-again").where("ask").groupBy("class").agg(F.collect_list("at").alias("found"))
    cut = Saved(_cut(near.join(hits, "class", "left"), length, gram), "repeat-cut")
    looked.drop(), texts.drop()
    copied = classes.df.join(in_passages.df, "class", "left").where("copies > 1 or p_words is not null").select(F.col("sha").alias("c_sha"), (F.col("copies") > 1).alias("copied"), "p_words")
    told = copied.join(cut.df, "c_sha", "full")
    met = rows.df.join(told, F.col("sha") == F.col("c_sha"), "left")
    whole = F.coalesce("copied", F.lit(False)) & (F.col("n_bytes") >= length)
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return met.select(
        F.col("key").alias(key), "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("c_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, all_of_it).otherwise(F.coalesce("c_spans", none)).alias("removed"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("c_kept", "sha")).alias("kept_sha256"),
        F.when(F.coalesce("copied", F.lit(False)) & (F.col("n_words") >= PASSAGE), F.col("n_words")).otherwise(F.coalesce("p_words", F.lit(0))).cast("long").alias("n_passage_words"),
    )


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), "kept_sha256", "n_passage_words")
