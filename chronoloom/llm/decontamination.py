"""Benchmark decontamination by q-gram lemma filtering.

A window is SEGMENT bytes of a benchmark item, at any offset (a shorter item is one window). A window of w bytes that
stands in a text with at most k edits shares w - Q + 1 - k Q of its q-grams with it, and all of them on diagonals
(position in the text less position in the item) that drift by k at most. So the q-grams that a text shares with whole
items are put in diagonal bands of twice k + 1, each overlapping the next by half, and the windows of a band that hold
enough of them are aligned; a window within the edit budget is contaminated.

Not every window needs to be aligned: moving a window by d bytes changes its edits by d at most, so those near a window
with too many edits are out. Windows of one run (adjacent offsets in one band) are aligned at every STRIDE-th offset,
and then at every offset that may, by this bound, be within the budget and better than the best so far.

The benchmark is read in blocks of at most about BLOCK_BYTES, each broadcast in turn, so that what is broadcast has a
bound whatever the benchmark's size; documents are never shuffled. Kernels work on many texts at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm._common import Saved, Scope, column, filtered, rows_of, table

Q = 8
#: Bytes of a window, from one window that is always aligned to the next, and the edits allowed for each byte.
SEGMENT, STRIDE, RATE = 80, 16, 0.10
BLOCK_BYTES = 8 << 20
#: A text that shares more q-grams with the items than this, as an item of one repeated letter makes it, is cut in halves.
MOST_HITS = 1 << 20
_TABLE = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 128 and not chr(c).isalnum() else c for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22
REGION = "struct<item_id:bigint,start:int,end:int,edits:int>"
_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())]))


def plain(text: str) -> bytes:
    """UTF-8 with A-Z lower-cased and each run of ASCII punctuation, blanks and control characters one space."""
    return b" ".join(text.encode("utf-8", "surrogatepass").translate(_TABLE).split())


def edits_for(w: int) -> int:
    """RATE of the bytes, and few enough that one shared q-gram at least is left to be found."""
    return max(0, min(int(RATE * w), (w - Q) // Q))


def q_grams(data: bytes) -> np.ndarray:
    return np.ndarray((max(0, len(data) - Q + 1),), "<u8", data, strides=(1,)) if len(data) >= Q else np.empty(0, np.uint64)


class Index:
    """The q-grams of a block of items. Items of less than Q bytes hold none and match nothing."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        parts = [(i, s) for i, t in items if len(s := plain(t or "")) >= Q]
        self.item = np.array([i for i, _ in parts], np.int64)
        length = np.array([len(s) for _, s in parts], np.int64)
        self.size = np.minimum(length, SEGMENT)
        self.last = length - self.size
        self.longest = int(length.max(initial=0))
        self.edits = np.array([edits_for(n) for n in self.size], np.int64)
        self.least = self.size - Q + 1 - self.edits * Q
        self.band = int(self.edits.max(initial=0)) + 1
        self.begin = np.cumsum(length) - length
        self.text = np.frombuffer(b"".join(s for _, s in parts) + bytes(SEGMENT), np.uint8)
        grams = [q_grams(s) for _, s in parts]
        gram = np.concatenate([*grams, np.empty(0, np.uint64)])
        order = np.argsort(gram, kind="stable")
        self.gram, self.first, self.count = np.unique(gram[order], return_index=True, return_counts=True)
        self.of = np.repeat(np.arange(len(parts)), [len(g) for g in grams])[order]
        self.at = np.concatenate([*(np.arange(len(g)) for g in grams), np.empty(0, np.int64)]).astype(np.int64)[order]
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[self.slot(self.gram)] = True

    @staticmethod
    def slot(grams: np.ndarray) -> np.ndarray:
        return (grams * _MIX) >> np.uint64(64 - _BITS)

    def shared(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where the data has q-grams of items, and which."""
        grams = q_grams(data)
        at = np.flatnonzero(self.bitmap[self.slot(grams)])
        k = np.searchsorted(self.gram, grams[at])
        same = (k < len(self.gram)) & (self.gram[np.minimum(k, len(self.gram) - 1)] == grams[at])
        return at[same], k[same]

    def hits(self, at: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item, position in it and diagonal of each place that a shared q-gram (see shared) has in an item."""
        n = self.count[k]
        which = np.repeat(self.first[k], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return self.of[which], self.at[which], np.repeat(at, n) - self.at[which]

    def runs(self, data: bytes, shared: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Item, band, first and last offset of the runs of windows that share enough q-grams with the data."""
        item, at, diagonal = self.hits(*shared)
        below = self.longest // self.band + 2  # bands may begin before the data does
        bands, wide = len(data) // self.band + below + 2, self.longest + 1
        key = item * bands + diagonal // self.band + below
        keys = np.sort(np.concatenate([key * wide + at, (key - 1) * wide + at]))
        key, at = keys // wide, keys % wide
        item = key // bands
        # the hit that makes it enough for a window in which this one is the first
        other = np.arange(len(key)) + self.least[item] - 1
        within = np.flatnonzero(other < len(key))
        other = other[within]
        near = (key[other] == key[within]) & (at[other] - at[within] <= self.size[item[within]] - Q)
        this, other = within[near], other[near]
        key, item = key[this], item[this]
        low = np.maximum(at[other] - (self.size[item] - Q), 0)
        high = np.minimum(at[this], self.last[item])
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (low[1:] > high[:-1] + 1)
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(key))[: len(starts)] - 1
        return item[starts], key[starts] % bands - below, low[starts], high[ends]

    def regions(self, data: bytes) -> list[tuple[int, int, int, int]]:
        """item, start, end and fewest edits of the regions that windows within the edit budget cover; windows of one
        item that overlap are one region."""
        out: list[tuple[int, int, int, int]] = []
        for i, x, y, e in sorted(self.found(data, 0)):
            if out and out[-1][0] == i and x < out[-1][2]:
                out[-1] = (i, out[-1][1], max(y, out[-1][2]), min(e, out[-1][3]))
            else:
                out.append((i, x, y, e))
        return out

    def found(self, data: bytes, begin: int) -> list[tuple[int, int, int, int]]:
        """item, start, end and edits of each aligned window within the edit budget, of a text that stands at `begin`."""
        if not len(self.gram) or len(data) < Q:
            return []
        reach = SEGMENT + 2 * self.band  # the longest piece of text that a window can be aligned with
        shared = self.shared(data)
        if not len(shared[0]):
            return []
        if len(data) >= 4 * reach and self.count[shared[1]].sum() > MOST_HITS:
            half = len(data) // 2
            return self.found(data[: half + reach], begin) + self.found(data[half:], begin + half)
        item, band, low, high = self.runs(data, shared)
        if not len(item):
            return []
        padded = np.zeros(len(data) + 4 * SEGMENT + 4 * self.band, np.uint8)
        origin = SEGMENT + 2 * self.band
        padded[origin : origin + len(data)] = np.frombuffer(data, np.uint8)
        found: list[tuple[int, int, int, int]] = []

        def align(run: np.ndarray, offset: np.ndarray) -> np.ndarray:
            out = []
            for k in range(0, len(run), 4096):
                r, o = run[k : k + 4096], offset[k : k + 4096]
                edits, start, end = self.aligned(padded, item[r], o, band[r] * self.band + o + origin)
                good = edits <= self.edits[item[r]]
                found.extend((int(self.item[i]), begin + max(0, int(x) - origin), begin + min(len(data), int(y) - origin), int(e)) for i, x, y, e in zip(item[r][good], start[good], end[good], edits[good], strict=True))
                out.append(edits)
            return np.concatenate([*out, np.empty(0, np.int64)])

        # every STRIDE-th offset of a run and its last one
        n = (high - low + STRIDE - 1) // STRIDE + 1
        run = np.repeat(np.arange(len(item)), n)
        offset = np.minimum(low[run] + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * STRIDE, high[run])
        edits = align(run, offset)
        fewest = self.edits[item] + 1
        np.minimum.at(fewest, run, edits)
        # of the offsets between two aligned ones, those that may be within the budget and better than the run's best
        k = np.flatnonzero((run[:-1] == run[1:]) & (fewest[run[:-1]] > 0))
        gap = np.maximum(offset[k + 1] - offset[k] - 1, 0)
        left = np.repeat(k, gap)
        between = offset[left] + 1 + np.arange(gap.sum()) - np.repeat(np.cumsum(gap) - gap, gap)
        most = fewest[run[left]] - 1
        open_ = (edits[left] - (between - offset[left]) <= most) & (edits[left + 1] - (offset[left + 1] - between) <= most)
        align(run[left][open_], between[open_])
        return found

    def aligned(self, text: np.ndarray, item: np.ndarray, offset: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fewest edits between each window (item and offset) and a piece of the text inside its band, and where about
        that piece stands. Rows are diagonals: a step takes a byte of both, one to the row below a byte of the text only,
        to the row above one of the window only. A cost is held less its row's number, so that the way down is a running
        minimum. Windows that have STRIDE edits more than they may are given up with the edits they have by then: neither
        they nor those nearer than STRIDE can be within the budget."""
        wide = 2 * self.band
        across = np.arange(wide, dtype=np.int16)[:, None]
        size, at = self.size[item], self.begin[item] + offset
        longest = int(size.max(initial=0))
        pieces = text[begin + np.arange(longest + wide - 1)[:, None]]
        windows = self.text[at + np.arange(longest)[:, None]]
        ends, most = set(size.tolist()), self.edits[item] + STRIDE
        edits, where = np.zeros(len(item), np.int64), np.zeros(len(item), np.int64)
        open_, cost = np.arange(len(item)), np.repeat(-across, len(item), axis=1)
        for i in range(longest):
            step = cost + (pieces[i : i + wide] != windows[i])
            np.minimum(step[:-1], cost[1:] + np.int16(2), out=step[:-1])
            cost = np.minimum.accumulate(step, axis=0)
            if i + 1 in ends or i % 8 == 7:
                best = cost + across
                fewest, left = best.min(axis=0), size[open_] > i + 1
                go = left & (fewest <= most[open_])
                if i + 1 in ends or go.sum() < 0.8 * len(go):
                    told = open_[~go]
                    edits[told], where[told] = fewest[~go], best[:, ~go].argmin(axis=0)
                    open_, cost, pieces, windows = open_[go], cost[:, go], pieces[:, go], windows[:, go]
                    if not len(open_):
                        break
        end = begin + where + size
        return edits, end - size, end


def blocks_of(benchmark: DataFrame, item: str, text: str) -> Iterator[tuple[int, int, Index]]:
    """The benchmark in blocks by a hash of the item, as many as keep a block near BLOCK_BYTES; each with its number and
    how many there are."""
    held = benchmark.where(column(item).isNotNull() & column(text).isNotNull()).select(column(item).cast("long").alias("i"), column(text).alias("t"))
    total = held.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = 1 + total // BLOCK_BYTES
    for k in range(n):
        yield k, n, Index([(r.i, r.t) for r in held.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).orderBy("i", "t").collect()])


def _regions(index: Index, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
    return [index.regions(plain(t)) if t else [] for t in texts]


def _listed(regions: list[list[tuple[int, int, int, int]]]) -> pa.Array:
    return pa.array([[dict(zip(("item_id", "start", "end", "edits"), r, strict=True)) for r in some] for some in regions], _ARROW)


def regions_by_text(docs: DataFrame, benchmark: DataFrame, text: str, item: str) -> DataFrame:
    """sha (of a text) and regions of the texts that have any. The benchmark's blocks are looked for one after another
    in the texts as they are read; only what is found is kept between them."""
    found = None
    for _, _, index in blocks_of(benchmark, item, "text"):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in rows_of(batch):
                    texts = part.column(0).to_pylist()
                    hits = [(t, r) for t, r in zip(texts, _regions(held.value, texts), strict=True) if r]
                    shas = pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t, _ in hits], pa.string())
                    yield pa.RecordBatch.from_arrays([shas, _listed([r for _, r in hits])], names=["sha", "regions"])

        some = docs.select(column(text).alias("text")).mapInArrow(run, f"sha string, regions array<{REGION}>")
        some = Saved(some.groupBy("sha").agg(F.first("regions").alias("regions")), "benchmark-regions").df
        held.destroy()
        found = some if found is None else found.unionByName(some)
    return found.groupBy("sha").agg(F.flatten(F.collect_list("regions")).alias("regions"))  # a row for each block


def contaminated_regions(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """key and `regions` of every row: item_id, start and end (bytes of the plain text) and edits of each region.

    Edge cases: a null or empty text has no regions; items that are null, or of less than Q bytes, match nothing; of
    repeated items and rows each counts for itself; a null key passes through; extra columns are ignored; an empty
    table of either kind gives rows without regions or no rows.
    """
    first = next(blocks := blocks_of(benchmark, item, "text"))
    if first[1] == 1:
        blocks.close()
        held = docs.sparkSession.sparkContext.broadcast(first[2])
        source = docs.select(column(key).alias("key"), column(text).alias("text"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in rows_of(batch):
                    yield pa.RecordBatch.from_arrays([part.column(0), _listed(_regions(held.value, part.column(1).to_pylist()))], names=["key", "regions"])

        return source.mapInArrow(run, f"key {source.schema[0].dataType.simpleString()}, regions array<{REGION}>").toDF(key, "regions")
    with Scope() as scope:
        found = regions_by_text(docs, benchmark, text, item).withColumnRenamed("sha", "found_sha")
        rows = docs.select(column(key).alias(key), F.sha2(column(text), 256).alias("sha"))
        met = rows.join(found, F.col("sha") == F.col("found_sha"), "left")
        return scope.result(met.select(column(key), F.coalesce("regions", F.array().cast(f"array<{REGION}>")).alias("regions")), "benchmark-result")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id") -> DataFrame:
    """The rows of docs without a contaminated region, with all their columns. Each block of the benchmark looks at what
    the blocks before have left, in one pass over the texts if one block holds the benchmark.

    Edge cases: as in contaminated_regions; rows with null or empty texts stay; repeated rows fare alike; columns of
    any name pass through; an empty table stays empty, and an empty benchmark keeps every row.
    """
    first = next(blocks := blocks_of(benchmark, item, "text"))
    if first[1] == 1:
        blocks.close()
        held = docs.sparkSession.sparkContext.broadcast(first[2])
        return filtered(docs, text, lambda: lambda texts: [not r for r in _regions(held.value, texts)])
    with Scope() as scope:
        gone = scope.result(regions_by_text(docs, benchmark, text, item).select("sha"), "benchmark-gone")
    return docs.join(gone, F.sha2(column(text), 256) == gone["sha"], "left_anti")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated_regions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.sort_array(F.array_distinct(F.transform("regions", lambda r: r["item_id"])))
    return found.select("doc_id", (F.size("regions") > 0).alias("contaminated"), F.size("regions").cast("long").alias("n_regions"), items.alias("item_ids"))
