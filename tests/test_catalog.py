"""Every query with SQL equals DuckDB's answer at the smallest scale; the others have brute-force tests below."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoloom.operators import compare, filters, frames, resample
from chronoloom.plans import catalog, recordings  # noqa: F401  the latter adds its queries to the former
from tests.conftest import SF


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted(tuple(None if pd.isna(x) else x for x in r) for r in df.itertuples(index=False, name=None))


def key(t):
    return tuple((x is None, str(type(x)), x) for x in t)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, duck, name):
    ours, theirs = catalog.QUERIES[name](spark, SF).toPandas(), duck.sql(catalog.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    a = [tuple(None if pd.isna(x) else x for x in r) for r in ours[sorted(ours.columns)].itertuples(index=False, name=None)]
    b = [tuple(None if pd.isna(x) else x for x in r) for r in theirs[sorted(ours.columns)].itertuples(index=False, name=None)]
    order = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)
    assert sorted(a, key=order) == sorted(b, key=order)


def test_versions_lie_in_parts_of_bounded_size(spark, duck, monkeypatch):
    monkeypatch.setattr(catalog, "PART_ROWS", 300)
    a, b = catalog.halves(spark, SF)
    assert a.rdd.getNumPartitions() >= 20
    assert rows(catalog.QUERIES["sample_compare"](spark, SF).toPandas()) == rows(duck.sql(catalog.SQL["sample_compare"]).df())


def test_removals_golden():
    assert resample.removals(11008, 11000) == [1224, 2449, 3674, 4899, 6124, 7349, 8574, 9799]


def test_dense_surplus_is_refused():
    with pytest.raises(ValueError):
        resample.period(1200, 1000)


def test_decimation_against_simulation(spark):
    n_in, n_out = 250, 240
    x = np.sin(np.arange(n_in) / 7)
    surplus, t = resample.period(n_in, n_out)
    want, raw = [], 0
    for o in range(n_out):
        last = o // t < surplus and o % t >= t - 2
        want.append((x[raw] + x[raw + 1]) / 2 if last else x[raw])
        raw += 2 if last and o % t == t - 1 else 1
    data = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "pos long, v double")
    got = resample.decimated(data, [], "pos", "v", F.lit(n_in), F.lit(n_out)).orderBy("pos").toPandas()
    assert np.allclose(got["value"], want) and len(got) == n_out
    back = got.select_dtypes("number")["at"]
    again = spark.createDataFrame([(float(v),) for v in back], "at double").select(resample.output_position(F.col("at"), F.lit(n_in), F.lit(n_out)).alias("o")).toPandas()["o"]
    assert np.allclose(again, np.arange(n_out))


def test_highpass_gain_and_priming():
    b, a = filters.highpass_coefficients(100.0, 5.0)
    z = np.exp(-1j * 2 * np.pi * 5 / 100 * np.arange(3))
    assert abs(abs((b * z).sum() / (a * z).sum()) - 1 / np.sqrt(2)) < 1e-9
    assert np.abs(filters.highpass(np.full(5000, 3.0), 100.0)[-10:]).max() < 0.2
    assert len(filters.highpass(np.array([]), 100.0)) == 0


def plain_highpass(x, rate):
    b, a = filters.highpass_coefficients(rate)
    lead, z1, z2, out = min(int(20 * rate), len(x) - 1) + 1, 0.0, 0.0, []
    for v in [*x[:lead][::-1], *x]:
        y = b[0] * v + z1
        z1, z2 = b[1] * v - a[1] * y + z2, b[2] * v - a[2] * y
        out.append(y)
    return np.array(out[lead:])


def test_highpass_of_short_segments_takes_no_group_each(spark, capsys):
    rng = np.random.default_rng(5)
    x = {s: rng.normal(size=int(rng.integers(1, 80))).cumsum() for s in range(150)} | {200: rng.normal(size=900)}
    data = spark.createDataFrame([(s, i, float(v)) for s, values in x.items() for i, v in enumerate(values)] + [(None, 0, 1.0)], "s int, pos long, v double")
    out = filters.highpass_segments(data.repartition(3), ["s"], "pos", "v", 2.0, chunk=300)
    out.explain()
    plan = capsys.readouterr().out
    # what is left of groups is one over the states of whole chunks
    assert plan.count("FlatMapGroups") == 1 and plan.count("MapInArrow") == 2
    got = out.orderBy("s", "pos").toPandas()
    assert list(got.columns) == ["s", "pos", "v", "filtered"] and len(got) == sum(map(len, x.values()))
    for s, values in x.items():
        assert np.allclose(got[got["s"] == s]["filtered"], plain_highpass(values, 2.0), atol=1e-9) and (got[got["s"] == s]["v"] == values).all()


def test_highpass_in_chunks_equals_the_recursion(spark):
    rng = np.random.default_rng(4)
    x = {s: rng.normal(size=n).cumsum() for s, n in ((0, 5000), (1, 700), (2, 1), (3, 1024))}
    data = spark.createDataFrame([(s, i, float(v)) for s, values in x.items() for i, v in enumerate(values)], "s int, pos long, v double")
    got = filters.highpass_segments(data, ["s"], "pos", "v", 10.0, chunk=900).orderBy("s", "pos").toPandas()
    for s, values in x.items():
        assert np.allclose(got[got["s"] == s]["filtered"], plain_highpass(values, 10.0), atol=1e-8), s


def test_band_share_finds_a_tone(spark):
    t = np.arange(400) / 100
    data = spark.createDataFrame([(1, i, float(np.sin(2 * np.pi * 10 * v))) for i, v in enumerate(t)], "rec long, pos long, v double")
    assert filters.band_share(data, ["rec"], "pos", "v", 100.0, 8, 12).first()["share"] > 0.95


def test_annotations_match_one_to_one(spark):
    a = spark.createDataFrame([("x", 1.0), ("x", 1.0005), ("x", 9.0), ("y", 2.0)], "text string, onset double")
    b = spark.createDataFrame([("x", 1.0003), ("x", 9.0), ("z", 5.0)], "text string, onset double")
    got = {r.text: tuple(r)[1:] for r in compare.matched_annotations(a, b, 0.001).collect()}
    assert got == {"x": (2, 1, 0), "y": (0, 1, 0), "z": (0, 0, 1)}


@pytest.mark.parametrize("copies", [2, 5])
def test_annotations_of_copied_events_equal_sql(spark, tmp_path, copies):
    """Events with the times of others, as larger copies of the table have them."""
    import duckdb

    e = spark.read.parquet(f"{SF}/events.parquet")
    e.crossJoin(spark.range(copies).withColumnRenamed("id", "i")).withColumn("event_id", F.col("event_id") + F.col("i") * 1000).drop("i").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got = catalog.QUERIES["annotation_match"](spark, str(tmp_path)).toPandas()
    want = con.sql(catalog.SQL["annotation_match"]).df()
    assert rows(got) == rows(want) and (got["matched"] > got["only_ours"]).all()


def test_pairs_of_annotations(spark):
    a = spark.createDataFrame([("x", 1.0), ("x", 1.0), ("x", 1.0005), ("x", 9.0), ("y", 2.0), (None, 1.0)], "text string, onset double")
    b = spark.createDataFrame([("x", 1.0003), ("x", 1.0003), ("x", 9.001), ("x", 9.0011), ("z", 5.0), (None, 1.0)], "text string, onset double")
    got = {r.text: tuple(r)[1:] for r in compare.paired_annotations(a, b, 0.001).collect()}
    assert got == {"x": (7, -3, -3), "y": (0, 1, 0), None: (0, 1, 0)}


def test_annotations_against_two_pointers(spark):
    rng = np.random.default_rng(8)
    ours, theirs = (sorted((str(t), float(o)) for t, o in zip(rng.choice(["x", "y"], 400), rng.integers(0, 7300 * 4, 400) * 0.25, strict=True)) for _ in range(2))
    got = {r.text: tuple(r)[1:] for r in compare.matched_annotations(spark.createDataFrame(ours, "text string, onset double"), spark.createDataFrame(theirs, "text string, onset double"), 6.0).collect()}
    for text in "xy":
        a, b = ([o for t, o in side if t == text] for side in (ours, theirs))
        i = j = n = 0
        while i < len(a) and j < len(b):
            if abs(a[i] - b[j]) <= 6.0 + 1e-9:
                i, j, n = i + 1, j + 1, n + 1
            elif a[i] < b[j]:
                i += 1
            else:
                j += 1
        assert got[text] == (n, len(a) - n, len(b) - n)


def test_comparison_notices_changes(spark):
    pairs = spark.createDataFrame([(1, i, float(i % 13), float(i % 13) * 1.001 + (3 if i == 40 else 0)) for i in range(100)], "s long, pos long, a double, b double")
    got = compare.share_identical(pairs, "s", "a", "b", "pos").first()
    assert got["max_step"] > 3 and got["first_differing"] == 1
    assert abs(compare.gain_through_origin(pairs.where("pos <> 40"), "s", "a", "b").first()["gain"] - 1.001) < 1e-9


def test_records_inside_holes_go(spark):
    records = spark.createDataFrame([(1, k) for k in range(10)], "rec long, record long")
    holes = spark.createDataFrame([(1, 2.5, 6.0)], "rec long, start double, end double")
    assert [r.record for r in frames.records_outside(records, holes, "rec").orderBy("record").collect()] == [0, 1, 2, 6, 7, 8, 9]


def test_padding_and_concatenation(spark):
    f = spark.createDataFrame([(1, 1, 5), (1, 2, 5), (1, 6, 5)], "rec long, frame long, n long")
    assert [r.first_sample for r in frames.cursor(f, "rec", "frame", "n", 10).orderBy("frame").collect()] == [0, 5, 40]
    assert [r.first_sample for r in frames.cursor(f, "rec", "frame", "n", None).orderBy("frame").collect()] == [0, 5, 10]
    assert frames.missing(f, "rec", "frame").count() == 3
