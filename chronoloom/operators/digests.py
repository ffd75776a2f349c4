"""Tree digests: tables with the same rows have the same root, and where roots differ a descent names the key ranges that
do, reading of each level only what lies about the branches that differ.

A leaf is a range of WIDTH keys, a node of a level FAN neighbouring nodes of the level below it. A leaf's digest is made
of the number of its rows and four sums of 60-bit pieces of their SHA-256, so rows count with their repeats and in any
order; a node's digest is the SHA-256 of its children's numbers and digests, in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, FAN, LEVELS = 256, 64, 4
NODES = "level int, node long, n long, digest string"


def row_text(*columns: str) -> Column:
    """All values as text, each behind its length, so that no two rows read alike; nulls are `n`."""
    part = lambda c: F.col(f"`{c}`").cast("string")
    return F.concat(*(F.coalesce(F.concat(F.length(part(c)).cast("string"), F.lit(":"), part(c)), F.lit("n")) for c in columns))


def leaves(rows: DataFrame, key: str, columns: list[str], width: int = WIDTH) -> DataFrame:
    """Level 0 of a table's tree: node, n and digest. Rows are summed where they are before they are shuffled; a hot key
    is one row of each task then. Rows with a null key are in the node null."""
    hashed = rows.select(F.floor(F.col(f"`{key}`") / width).cast("long").alias("node"), F.sha2(row_text(*columns), 256).alias("h"))
    pieces = [F.sum(F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(28,0)")).alias(f"s{k}") for k in range(4)]
    sums = hashed.groupBy("node").agg(F.count("*").alias("n"), *pieces)
    digest = F.sha2(F.concat_ws("|", F.col("n").cast("string"), *(F.col(f"s{k}").cast("string") for k in range(4))), 256)
    return sums.select("node", "n", digest.alias("digest"))


def parents(nodes: DataFrame, fan: int = FAN) -> DataFrame:
    """The level above: node, n and digest. A group has `fan` children at most."""
    child = F.concat_ws(":", F.coalesce(F.col("node").cast("string"), F.lit("n")), "digest")
    up = nodes.groupBy(F.floor(F.col("node") / fan).cast("long").alias("node"))
    kids = F.transform(F.sort_array(F.collect_list(F.struct("node", child.alias("c")))), lambda x: x["c"])
    return up.agg(F.sum("n").alias("n"), F.sha2(F.array_join(kids, "|"), 256).alias("digest"))


def write_tree(rows: DataFrame, key: str, columns: list[str], path: str, width: int = WIDTH, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """Writes the tree of a table to a folder, each level from the one below as written, in files of neighbouring nodes,
    and returns it (level, node, n, digest). The highest level has a node for each width * fan ^ levels keys. An empty
    table has no nodes."""
    spark = rows.sparkSession
    level = leaves(rows, key, columns, width)
    for at in range(levels + 1):
        level.select(F.lit(at).alias("level"), "node", "n", "digest").repartitionByRange("node").sortWithinPartitions("node").write.parquet(f"{path}/level-{at}")
        level = parents(spark.read.schema(NODES).parquet(f"{path}/level-{at}"), fan)
    return read_tree(spark, path, levels)


def read_tree(spark: SparkSession, path: str, levels: int = LEVELS) -> DataFrame:
    return spark.read.schema(NODES).parquet(*(f"{path}/level-{at}" for at in range(levels + 1)))


def differing(spark: SparkSession, a: str, b: str, width: int = WIDTH, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """node, first and last (keys), n_a and n_b (rows, null without the leaf) of the leaves in which two written trees
    differ. From the top down, a level is read between the least and greatest child of what differed above it (this goes
    to the scan), and of these the children of the differing nodes are compared."""
    wanted, bounds = None, None
    for at in range(levels, -1, -1):
        sides = []
        for path in (a, b):
            one = spark.read.schema(NODES).parquet(f"{path}/level-{at}")
            if bounds is not None:
                low, high, nulls = bounds
                inside = F.col("node").between(low * fan, high * fan + fan - 1) if low is not None else F.lit(False)
                one = one.where(inside | F.col("node").isNull() if nulls else inside)
                one = one.join(wanted, F.floor(F.col("node") / fan).eqNullSafe(F.col("__up")), "left_semi")
            sides.append(one)
        x, y = (s.select(*(F.col(c).alias(f"__{n}_{c}") for c in ("node", "n", "digest"))) for n, s in zip("ab", sides, strict=True))
        met = x.join(y, F.col("__a_node").eqNullSafe(F.col("__b_node")), "full").where(~F.col("__a_digest").eqNullSafe(F.col("__b_digest")))
        found = met.select(F.coalesce("__a_node", "__b_node").alias("node"), F.col("__a_n").alias("n_a"), F.col("__b_n").alias("n_b"))
        if at:
            low, high, nulls = found.agg(F.min("node"), F.max("node"), F.count_if(F.col("node").isNull())).first()
            bounds, wanted = (low, high, bool(nulls)), found.select(F.col("node").alias("__up"))
    return found.select("node", (F.col("node") * width).alias("first"), (F.col("node") * width + (width - 1)).alias("last"), "n_a", "n_b")


def differing_rows(a: DataFrame, b: DataFrame, key: str, columns: list[str], ranges: DataFrame) -> DataFrame:
    """side (`a` or `b`) and the columns of the rows that one table has more often than the other, within the ranges that
    differing() names; with `more`, how much more often."""
    low, high, nulls = ranges.agg(F.min("first"), F.max("last"), F.count_if(F.col("node").isNull())).first()
    place, sides = F.col(f"`{key}`"), []
    spans = ranges.select(F.col("node").alias("__node"))
    width = ranges.select((F.col("last") - F.col("first") + 1).alias("w")).where("w is not null").first()
    for n, rows in ((1, a), (-1, b)):
        inside = place.between(low, high) if low is not None else F.lit(False)
        some = rows.select(*columns, place.alias("__key")).where(inside | place.isNull() if nulls else inside)
        some = some.withColumn("__in", F.floor(F.col("__key") / (width.w if width else 1))).join(spans, F.col("__in").eqNullSafe(F.col("__node")), "left_semi")
        sides.append(some.select(*columns, F.lit(n).alias("__side")))
    counted = sides[0].unionByName(sides[1]).groupBy(*columns).agg(F.sum("__side").alias("__more")).where("__more <> 0")
    return counted.select(F.when(F.col("__more") > 0, "a").otherwise("b").alias("side"), *columns, F.abs("__more").alias("more"))


def folder_files(spark: SparkSession, folder: str) -> DataFrame:
    """path (within the folder), size and sha256 of each file under it, hashed in tasks (files of up to 2 GB)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    base = folder.split("://", 1)[-1].removeprefix("file:").rstrip("/") + "/"
    inner = F.expr("substring(path, locate(__base, path) + length(__base))")
    return files.withColumn("__base", F.lit(base)).select(inner.alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def folder_digest(files: DataFrame) -> DataFrame:
    """files, size and digest of a folder (see folder_files): the SHA-256 of up to 4096 digests, each of the sorted paths
    and hashes of the files whose path's hash begins alike."""
    line = F.concat(F.length("path").cast("string"), F.lit(":"), "path", F.lit("="), "sha256")
    parts = files.groupBy(F.substring(F.sha2("path", 256), 1, 3).alias("__part")).agg(
        F.count("*").alias("files"), F.sum("size").alias("size"), F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "|"), 256).alias("__digest"),
    )
    kids = F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "__part", "__digest"))), "|")
    return parts.agg(F.coalesce(F.sum("files"), F.lit(0)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.sha2(kids, 256).alias("digest"))
