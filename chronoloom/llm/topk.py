"""Exact top-k search by inner product with M-trees, searched best first.

An inner product is a distance in one more dimension: with M at least every norm, a vector x becomes (x, sqrt(M^2 -
|x|^2)) and a query q becomes (q, 0), and |q' - x'|^2 = |q|^2 + M^2 - 2 q.x falls as the product rises. Each chunk of
a partition becomes an M-tree of paged nodes: a routing vector, its covering radius and its distance to the parent's.
The queries of a block walk it together; pages leave the queue by their smallest lower bound over the queries, and a
query whose bound shows that a page can't better its results computes nothing there.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.llm._common import Saved, Scope, table

SCALE, EVERY, K = 256, 50, 5
#: Vectors of a chunk, of a page, and queries of a block.
CHUNK, PAGE, BLOCK = 8192, 64, 16384


class MTree:
    """Two levels of routing nodes over pages of vectors (int values in float64, exact below 2^53), each vector with its
    distance to its page's routing vector."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, limit: float) -> None:
        self.ids, self.vectors = ids, vectors
        self.scored = 0  # products computed so far
        lifted = np.column_stack([vectors, np.sqrt(np.maximum(0.0, limit - (vectors**2).sum(axis=1)))])
        self.nodes = []  # (routing vector, covering radius, pages)
        for rows in self.split(lifted, np.arange(len(ids)), PAGE * 16):
            top = lifted[rows].mean(axis=0)
            pages = []
            for r in self.split(lifted, rows, PAGE):
                centre = lifted[r].mean(axis=0)
                away = np.sqrt(((lifted[r] - centre) ** 2).sum(axis=1))
                pages.append((centre, away.max(), np.sqrt(((centre - top) ** 2).sum()), (r, away)))
            self.nodes.append((top, max(p[2] + p[1] for p in pages), pages))

    @staticmethod
    def split(x: np.ndarray, rows: np.ndarray, most: int) -> Iterator[np.ndarray]:
        """Rows in groups of at most `most`, cut in halves along the line between two vectors far apart."""
        todo = [rows]
        while todo:
            rows = todo.pop()
            if len(rows) <= most:
                yield rows
                continue
            a = x[rows[((x[rows] - x[rows[0]]) ** 2).sum(axis=1).argmax()]]
            b = x[rows[((x[rows] - a) ** 2).sum(axis=1).argmax()]]
            order = np.argsort(x[rows] @ (b - a), kind="stable")
            todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]

    def search(self, own: np.ndarray, queries: np.ndarray, limit: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query the k best scores and ids (-1: none), ties to the smaller id, its own id left out."""
        n = len(queries)
        score, best = np.full((n, k), -np.inf), np.full((n, k), -1, np.int64)
        lifted = np.column_stack([queries, np.zeros(n)])
        square = (queries**2).sum(axis=1) + limit

        def reach() -> np.ndarray:
            """The distance that a vector must not pass to enter a query's results, a little widened for rounding."""
            return np.sqrt(np.maximum(0.0, square - 2 * score[:, -1])) * (1 + 1e-9) + 1e-6

        def distance(rows: np.ndarray, to: np.ndarray) -> np.ndarray:
            return np.sqrt(((lifted[rows] - to) ** 2).sum(axis=1))

        queue, count = [], 0
        every = np.arange(n)
        for top, radius, pages in self.nodes:
            d = distance(every, top)
            heapq.heappush(queue, (float((d - radius).min()), count, d, radius, pages))
            count += 1
        while queue:
            _, _, d, radius, inside = heapq.heappop(queue)
            rows = np.flatnonzero(d - radius <= reach())
            if not len(rows):
                continue
            if isinstance(inside, list):
                for centre, covers, away, r in inside:
                    # the stored distance to the parent bounds the distance from below before it is computed
                    some = rows[np.abs(d[rows] - away) - covers <= reach()[rows]]
                    if len(some):
                        to = np.full(n, np.inf)
                        to[some] = distance(some, centre)
                        heapq.heappush(queue, (float((to[some] - covers).min()), count, to, covers, r))
                        count += 1
                continue
            # so do the stored distances of single vectors to the page's routing vector
            inside, away = inside
            inside = inside[(np.abs(d[rows][:, None] - away) <= reach()[rows][:, None]).any(axis=0)]
            ids = self.ids[inside]
            self.scored += len(rows) * len(inside)
            found = queries[rows] @ self.vectors[inside].T
            found[own[rows][:, None] == ids[None, :]] = -np.inf
            all_s = np.concatenate([score[rows], found], axis=1)
            all_i = np.concatenate([best[rows], np.broadcast_to(ids, found.shape)], axis=1)
            order = np.lexsort((all_i, -all_s), axis=1)[:, :k]
            score[rows], best[rows] = np.take_along_axis(all_s, order, 1), np.take_along_axis(all_i, order, 1)
        return score, best


def quantised(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """id and v (floor of SCALE times each component); vectors that are null, or hold a null, NaN or infinity, go."""
    rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return rows.where(~F.exists("v", odd)).select("id", F.transform("v", lambda x: F.floor(x * SCALE).cast("double")).alias("v"))


def top_k(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = EVERY, k: int = K) -> DataFrame:
    """query_id, rank, vec_id and score: the k highest inner products of each query (rows whose id `every` divides)
    with the other rows.

    Edge cases: vectors that are null or hold null or non-finite components take no part, nor do null ids; vectors
    meet those of their own length only; of rows with one id the query is the smallest vector, and each is a candidate
    of its own for other queries; fewer than k candidates give fewer rows; components times SCALE must stay
    below 2^26 / sqrt(length), as all sums are exact in 53 bits then, and larger ones raise an error; extra columns are
    ignored; an empty table gives an empty result.
    """
    rows = quantised(vectors, key, vector)
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    queries = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    n, limit = queries.count(), rows.agg(F.max(norm)).first()[0] or 0.0
    if limit >= 2.0**52:
        raise ValueError("components are too large for exact products")
    with Scope() as scope:
        return scope.result(_best_of_blocks(rows, queries, n, limit, k), "top-result")


def _best_of_blocks(rows: DataFrame, queries: DataFrame, n: int, limit: float, k: int) -> DataFrame:
    """The queries go block by block, at most about BLOCK of them in the driver and in a task at a time."""
    spark, out = rows.sparkSession, None
    blocks = 1 + n // BLOCK
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    for b in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toPandas() if n else None
        if block is None or not len(block):
            continue
        by_length = {m: (g["id"].to_numpy(np.int64), np.array(g["v"].tolist(), np.float64).reshape(len(g), m)) for m, g in block.groupby(block["v"].map(len))}
        held = spark.sparkContext.broadcast(by_length)
        found = rows.mapInArrow(_searcher(held, limit, k), "query_id long, vec_id long, score long")
        found = Saved(found.withColumn("rank", rank).where(F.col("rank") <= k), "top-found").df
        held.destroy()
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return out.select("query_id", "rank", "vec_id", "score")


def _searcher(held, limit: float, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = defaultdict(list)
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def search(length: int) -> None:
            rows = waiting.pop(length)
            ids = np.concatenate([r[0] for r in rows])
            own, queries = held.value[length]
            score, found = MTree(ids, np.concatenate([r[1] for r in rows]), limit).search(own, queries, limit, k)
            if length in best:
                score, found = np.concatenate([best[length][0], score], axis=1), np.concatenate([best[length][1], found], axis=1)
            order = np.lexsort((found, -score), axis=1)[:, :k]
            best[length] = np.take_along_axis(score, order, 1), np.take_along_axis(found, order, 1)

        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            sizes = lists.value_lengths().to_numpy()
            for m in np.unique(sizes).tolist():
                if m in held.value:
                    at = np.flatnonzero(sizes == m)
                    flat = lists.take(pa.array(at)).flatten().to_numpy().reshape(len(at), m)
                    for c in range(0, len(at), CHUNK):
                        waiting[m].append((ids[at][c : c + CHUNK], flat[c : c + CHUNK]))
                        if sum(len(x[0]) for x in waiting[m]) >= CHUNK:
                            search(m)
        for m in [*waiting]:
            search(m)
        for m, (score, found) in best.items():
            q, c = np.nonzero(np.isfinite(score))
            columns = [pa.array(held.value[m][0][q]), pa.array(found[q, c]), pa.array(score[q, c].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "score"])

    return run


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP9_SQL = """
with v as (
  select vec_id, [floor(256 * x::double)::bigint for x in embedding] as v from embeddings
  where vec_id is not null and embedding is not null and len([1 for x in embedding if x is null or not isfinite(x)]) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_inner_product([x::double for x in q.v], [x::double for x in c.v])::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5
"""
