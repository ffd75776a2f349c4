"""MinHash near-duplicates: universal hash minima in bands, signature checks, full-set checks, connected components.

Every text becomes the set of its shingles (five words, A-Z lower-cased). Documents with one word sequence are one
class, and only classes are compared. A band of ROWS minima is a bucket; two sets with similarity s share one of the
BANDS buckets with probability 1 - (1 - s^ROWS)^BANDS, which at the threshold of 0.75 is 0.99998. Candidates first
compare signatures (8 bits of each minimum), then the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm._common import Saved, Scope, column, rows_of, table
from chronoloom.llm.components import bucket_components, mixed_blocks, with_component

SHINGLE = 5
#: Linked if 100 * intersection >= PERCENT * union.
PERCENT = 75
BANDS, ROWS = 40, 5
#: A pair whose signatures agree less than this is not checked further: four deviations below the threshold.
LEAST_AGREEMENT = 0.63
#: Members of a block of a bucket, where blocks are compared with blocks.
BLOCK = 64
_SEED = np.random.default_rng(20240229)
_A = _SEED.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _SEED.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def scrambled(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finish of a common public hash)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class WordHashes(dict):
    """64-bit hashes of words, kept for up to KEEP of them."""

    KEEP = 1_000_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.KEEP:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


def shingle_set(text: str, hashes: WordHashes) -> tuple[np.ndarray, bytes]:
    """The sorted distinct hashes of the shingles, and what tells the word sequence from others (16 bytes)."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII blanks split
    if not words:
        return np.empty(0, np.uint64), b""
    h = np.array([hashes[w] for w in words], np.uint64)
    n = max(1, len(h) - SHINGLE + 1)
    out = np.full(n, min(len(h), SHINGLE), np.uint64)
    for k in range(min(len(h), SHINGLE)):
        out = scrambled(out * _STEP + h[k : k + n])
    return np.unique(out), xxhash.xxh3_128_digest(h.tobytes())


def minima(shingles: np.ndarray) -> np.ndarray:
    best = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 512):
        x = shingles[at : at + 512] * _A[:, None]
        x += _B[:, None]
        np.minimum(best, x.min(axis=1), out=best)
    return best


def band_keys(best: np.ndarray) -> np.ndarray:
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = scrambled(key * _STEP + best.reshape(BANDS, ROWS)[:, k])
    return key.view(np.int64)


def features(docs: DataFrame, key: str, text: str) -> DataFrame:
    """id, n_shingles, content, signature and bands of every row; the last three are null where the set is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part in rows_of(batch):
                out: list[tuple] = []
                for t in part.column(1).to_pylist():
                    shingles, content = shingle_set(t or "", hashes)
                    if len(shingles):
                        best = minima(shingles)
                        out.append((len(shingles), content, (best >> np.uint64(40)).astype(np.uint8).tobytes(), band_keys(best)))
                    else:
                        out.append((0, None, None, None))
                kinds = (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
                columns = [pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["id", "n_shingles", "content", "signature", "bands"])

    source = docs.select(column(key).cast("long").alias("id"), column(text).alias("text"))
    return source.mapInArrow(run, "id long, n_shingles long, content binary, signature binary, bands array<long>")


def alike(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """The pairs whose signatures agree enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array((x == y).mean(axis=1) >= LEAST_AGREEMENT))

    met = pairs.join(signatures.select(F.col("id").alias("a"), F.col("signature").alias("x")), "a")
    met = met.join(signatures.select(F.col("id").alias("b"), F.col("signature").alias("y")), "b")
    return met.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar enough; sets: id, n and packed (sorted 64-bit hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, m, x, y in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                shared = 0
                if 100 * min(n, m) >= PERCENT * max(n, m):
                    shared = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                keep.append(100 * shared >= PERCENT * (n + m - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    met = pairs.join(sets.select(F.col("id").alias("a"), F.col("n").alias("n"), F.col("packed").alias("x")), "a")
    met = met.join(sets.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("packed").alias("y")), "b")
    return met.select("a", "b", "n", "m", "x", "y").mapInArrow(run, "a long, b long")


def block_links(blocks: DataFrame) -> DataFrame:
    """Links between the members of two blocks, one for each member and other component. A pair that shares several
    buckets is looked at in the first of them only."""

    def columns(members: pa.StructArray) -> tuple[np.ndarray, ...]:
        ids, components, payload = members.flatten()
        n, packed, signature, bands = payload.flatten()
        fixed = lambda x, kind: np.frombuffer(b"".join(x.to_pylist()), kind).reshape(len(ids), -1)
        return ids.to_numpy(), components.to_numpy(), n.to_numpy(), packed, fixed(signature, np.uint8), bands.flatten().to_numpy().reshape(len(ids), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for row in range(batch.num_rows):
                bucket, most = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                x_id, x_in, x_n, x_set, x_sig, x_bands = columns(batch.column(2)[row].values)
                y_id, y_in, y_n, y_set, y_sig, y_bands = columns(batch.column(3)[row].values)
                for i in range(len(x_id)):
                    same = y_bands == x_bands[i]
                    here = y_bands[np.arange(len(y_id)), same.argmax(axis=1)] == bucket
                    near = (y_sig == x_sig[i]).mean(axis=1) >= LEAST_AGREEMENT
                    sized = 100 * np.minimum(y_n, x_n[i]) >= PERCENT * np.maximum(y_n, x_n[i])
                    other = (y_in != x_in[i]) & ((y_in == most) | (x_id[i] < y_id))
                    done: set[int] = set()
                    own = np.frombuffer(x_set[i].as_py(), np.uint64)
                    for j in np.flatnonzero(here & near & sized & other).tolist():
                        if y_in[j] not in done:
                            shared = len(np.intersect1d(own, np.frombuffer(y_set[j].as_py(), np.uint64), assume_unique=True))
                            if 100 * shared >= PERCENT * (x_n[i] + y_n[j] - shared):
                                done.add(y_in[j])
                                found.append((int(x_id[i]), int(y_id[j])))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return blocks.mapInArrow(run, "a long, b long")


def packed_sets(docs: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """id, n and packed sets of the wanted ids' texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part in rows_of(batch):
                sets = [shingle_set(t or "", hashes)[0] for t in part.column(1).to_pylist()]
                columns = [part.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "packed"])

    source = docs.select(column(key).cast("long").alias("id"), column(text).alias("__text")).join(wanted, "id", "left_semi")
    return source.mapInArrow(run, "id long, n long, packed binary")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_shingles, component_id and kept of every row.

    Edge cases: a null text, or one without words, has an empty set, is linked with nothing and is kept; a row with a
    null id is linked with nothing, has a null component_id and is kept; rows with one id are one document, linked by
    any of their texts; ids must be whole numbers of 64 bits at most, others fail or, as text, are cast; extra columns
    are ignored; an empty table gives an empty result.
    """
    with Scope() as scope:
        return scope.result(_near_duplicates(docs, key, text), "near-result")


def _near_duplicates(docs: DataFrame, key: str, text: str) -> DataFrame:
    rows = Saved(features(docs, key, text), "near-features")
    sets = rows.df.where("id is not null and content is not null")
    classes = Saved(sets.groupBy("content").agg(F.min("id").alias("head")), "near-classes")
    heads = sets.join(classes.df, (sets["content"] == classes.df["content"]) & (F.col("id") == F.col("head"))).select("id", "signature", "bands")
    heads = Saved(heads.dropDuplicates(["id", "signature"]), "near-heads")
    members = heads.df.select("id", F.explode("bands").alias("bucket")).select("bucket", "id")

    def sets_of(ids: DataFrame) -> DataFrame:
        wanted = Saved(ids, "near-wanted")  # as in one_of_each_group: few ids need no text dealt out
        out = Saved(packed_sets(docs, key, text, wanted.df), "near-sets").df
        wanted.drop()
        return out

    def confirm(pairs: DataFrame) -> DataFrame:
        close = Saved(alike(pairs, heads.df), "near-close")
        return similar(close.df, sets_of(close.df.select(F.explode(F.array("a", "b")).alias("id")).distinct())).distinct()

    def confirm_mixed(placed: DataFrame) -> DataFrame:
        full = sets_of(placed.select("id").distinct()).join(heads.df, "id")
        payload = full.select("id", F.struct("n", "packed", "signature", "bands").alias("payload"))
        return block_links(mixed_blocks(placed, payload, BLOCK)).distinct()

    components = bucket_components(members, confirm, "near", confirm_mixed)
    named = with_component(classes.df, "head", components)
    # a class's component, by the class; copies follow it
    out = rows.df.join(named.select(F.col("content").alias("c"), "component"), F.col("content") == F.col("c"), "left")
    component = F.coalesce("component", "id")
    return out.select("id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def one_of_each_group(docs: DataFrame, key: str = "doc_id", text: str = "text", before: DataFrame | None = None) -> DataFrame:
    """The rows of docs, with all their columns, but those that a near-duplicate with a smaller id stands for. before, if
    given, has key and text as they were before other steps changed them (rows of other keys are ignored): documents are
    near-duplicates by either of their texts.

    Edge cases: as in near_duplicates; rows without words or with a null key stay; rows with one id go or stay together;
    columns of any name pass through; an empty table stays empty.
    """
    texts = docs.select(column(key).cast("long").alias("id"), column(text).alias("text"))
    if before is not None:
        own = texts.select(F.col("id").alias("own_id"), F.xxhash64("text").alias("own_hash")).distinct()
        old = before.select(column(key).cast("long").alias("id"), column(text).alias("text"))
        # saved, since the texts are read once for their signatures and again for the sets of candidates
        changed = Saved(old.join(own, (F.col("id") == F.col("own_id")) & (F.xxhash64("text") != F.col("own_hash"))).select("id", "text"), "near-changed")
        texts = texts.unionByName(changed.df)
    # ids of their own table, whose size tells Spark whether the documents need be dealt out to meet them
    gone = Saved(near_duplicates(texts, "id", "text").where(~F.col("kept")).select(F.col("id").alias("gone_id")).distinct(), "near-gone").df
    if before is not None:
        changed.drop()
    return docs.join(gone, column(key).cast("long") == gone["gone_id"], "left_anti")


#: Exact similarity of all pairs of classes that share a shingle, then components by label spreading.
OP5_SQL = r"""
with recursive w as (
  select doc_id, case when text is null then [] else [x for x in regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if x <> ''] end as words
  from documents
), s as (
  select doc_id, case when len(words) = 0 then [] when len(words) < 5 then [array_to_string(words, ' ')]
                 else list_sort(list_distinct([array_to_string(words[i:i + 4], ' ') for i in range(1, len(words) - 3)])) end as shingles
  from w
), c as (select min(doc_id) as head, shingles, len(shingles) as n from s where len(shingles) > 0 group by shingles),
e as (select head, n, unnest(shingles) as shingle from c),
p as (
  select a.head as a, b.head as b from e a join e b on a.shingle = b.shingle and a.head < b.head
  group by a.head, a.n, b.head, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))
), l as (select a, b from p union select b, a from p),
r(id, reach) as (select head, head from c union select r.id, l.b from r join l on r.reach = l.a),
k as (select id, min(reach) as component from r group by id)
select s.doc_id, len(s.shingles)::bigint as n_shingles, coalesce(k.component, s.doc_id) as component_id,
       s.doc_id = coalesce(k.component, s.doc_id) as kept
from s left join c on s.shingles = c.shingles left join k on k.id = c.head
"""
