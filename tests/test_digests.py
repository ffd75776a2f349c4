"""Tree digests find what differs, and only that."""

from pyspark.sql import functions as F

from chronoloom.operators import digests

COLUMNS = ["k", "v", "t"]


def table(spark, n):
    return spark.range(n).select(F.col("id").alias("k"), (F.col("id") * 7 % 1000).alias("v"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("t"))


def test_one_changed_cell_of_a_million(spark, tmp_path):
    a = table(spark, 1_000_000)
    b = a.withColumn("v", F.when(F.col("k") == 654_321, -1).otherwise(F.col("v")))
    x, y = f"{tmp_path}/a", f"{tmp_path}/b"
    root, other = (digests.write_tree(t.repartition(n), "k", COLUMNS, p, levels=3).where("level = 3").collect() for t, p, n in ((a, x, 3), (b, y, 5)))
    assert len(root) == len(other) == 1 and root[0].n == 1_000_000 and root[0].digest != other[0].digest
    ranges = digests.differing(spark, x, y, levels=3)
    plan = ranges._jdf.queryExecution().toString()
    low = 654_321 // 256 // 64 * 64  # what is read of the leaves: the children of one node
    assert f"GreaterThanOrEqual(node,{low})" in plan and f"LessThanOrEqual(node,{low + 63})" in plan
    assert [tuple(r) for r in ranges.collect()] == [(2555, 654_080, 654_335, 256, 256)]
    rows = digests.differing_rows(a, b, "k", COLUMNS, ranges).collect()
    assert sorted((r.side, r.k, r.v, r.more) for r in rows) == [("a", 654_321, 654_321 * 7 % 1000, 1), ("b", 654_321, -1, 1)]


def test_order_repeats_nulls_and_missing_rows(spark, tmp_path):
    rows = [(1, 5, "a"), (1, 5, "a"), (300, None, "b"), (None, 1, None), (9000, 2, "")]
    make = lambda r: spark.createDataFrame(r, "k long, v long, t string")
    tree = lambda r, n: digests.write_tree(make(r), "k", COLUMNS, f"{tmp_path}/{n}", levels=2) and f"{tmp_path}/{n}"
    one = tree(rows, "one")
    assert digests.differing(spark, one, tree(rows[::-1], "turned"), levels=2).count() == 0
    found = lambda r, n: sorted((x.node, x.n_a, x.n_b) if x.node is not None else (-1, x.n_a, x.n_b) for x in digests.differing(spark, one, tree(r, n), levels=2).collect())
    assert found(rows[1:], "once") == [(0, 2, 1)]
    assert found(rows[:4], "less") == [(35, 1, None)]
    assert found([*rows[:3], (None, 2, None), rows[4]], "nulls") == [(-1, 1, 1)]
    assert found([*rows[:2], (300, None, "n"), *rows[3:]], "text") == [(1, 1, 1)]
    assert found([], "empty") == [(-1, 1, None), (0, 2, None), (1, 1, None), (35, 1, None)]


def test_folders(spark, tmp_path):
    for base in ("a", "b"):
        (tmp_path / base / "x").mkdir(parents=True)
        (tmp_path / base / "x" / "1.bin").write_bytes(b"one")
        (tmp_path / base / "2.bin").write_bytes(b"two")
    digest = lambda d: digests.folder_digest(digests.folder_files(spark, str(tmp_path / d))).first()
    assert {r.path for r in digests.folder_files(spark, str(tmp_path / "a")).collect()} == {"x/1.bin", "2.bin"}
    assert digest("a") == digest("b") and digest("a").files == 2 and digest("a").size == 6
    (tmp_path / "b" / "2.bin").write_bytes(b"twq")
    assert digest("a").digest != digest("b").digest
    (tmp_path / "b" / "2.bin").write_bytes(b"two")
    (tmp_path / "b" / "x" / "1.bin").rename(tmp_path / "b" / "x" / "3.bin")
    assert digest("a").digest != digest("b").digest
