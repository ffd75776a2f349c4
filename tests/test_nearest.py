"""Two-sided as-of joins, placing by frames that aren't stored, and lags by blocks, against brute force."""

import numpy as np
import pytest

from chronoloom.operators import asof, compare


def test_both_sides_against_brute_force(spark):
    rng = np.random.default_rng(3)
    left = [(int(b), int(t), k) for k, (b, t) in enumerate(zip(rng.integers(0, 3, 80), rng.integers(-40, 400, 80), strict=True))]
    right = [(int(b), int(t)) for b, t in zip(rng.integers(0, 2, 30), rng.integers(0, 300, 30), strict=True)]
    l, r = spark.createDataFrame(left, "b int, t long, id int"), spark.createDataFrame(right, "b int, s long")
    got = asof.asof_both(l, r, "b", "t", "s", ["s"], 25.0).collect()
    assert len(got) == len(left)
    for row in got:
        mine = [s for b, s in right if b == row.b]
        assert (row.before and row.before.s) == max((s for s in mine if s <= row.t), default=None)
        assert (row.after and row.after.s) == min((s for s in mine if s >= row.t), default=None)


def test_both_sides_of_nothing(spark):
    l, r = spark.createDataFrame([(1, 5)], "b int, t long"), spark.createDataFrame([], "b int, s long")
    assert [(x.before, x.after) for x in asof.asof_both(l, r, "b", "t", "s", ["s"], 10.0).collect()] == [(None, None)]
    assert asof.asof_both(l.limit(0), r, "b", "t", "s", ["s"], 10.0).count() == 0


@pytest.mark.parametrize(("guess", "frame"), [(12_000_300, 12), (15_000_000, 15), (18_000_500, 18), (20_000_700, 20), (4_000_000, 4), (30_001_000, 30), (17_500_000, None), (12_600_000, None)])
def test_an_export_that_begins_in_a_pause(spark, guess, frame):
    # frames 10 to 13 and 20 to 23 are stored; the latter start 700 us late
    stamps = spark.createDataFrame([(n * 1_000_000 + (700 if n >= 20 else 0), n) for n in (10, 11, 12, 13, 20, 21, 22, 23)], "start long, frame long")
    guesses = spark.createDataFrame([(1, guess)], "quarter int, guess long")
    got = compare.aligned_over_pauses(guesses, stamps, 2000, 1_000_000).collect()
    assert [r.frame for r in got] == ([] if frame is None else [frame])
    if frame == 18:  # nearer to 20 than to 13
        assert got[0].residual == 200


@pytest.mark.parametrize("block", [8, 64, 1 << 16])
def test_lag_by_blocks_of_three_channels(spark, block):
    rng = np.random.default_rng(1)
    rows, total = [], np.zeros(11)
    for c in range(3):
        x = rng.normal(size=300)
        y = np.roll(x, 4) * (1 + c) + rng.normal(size=300) / 4
        rows += [(c, p, float(x[p]), None if p == 7 else float(y[p])) for p in range(300)]
        for k in range(-5, 6):
            total[k + 5] += sum(x[p] * y[p + k] for p in range(300) if 0 <= p + k < 300 and p + k != 7)
    signal = spark.createDataFrame(rows, "c int, p long, x double, y double")
    got = compare.lag_by_blocks(signal, ["c"], [], "p", "x", "y", 5, block).first()
    assert got.lag == 4 == int(total.argmax()) - 5 and abs(got.score - total.max()) < 1e-5
    each = {r.c: r.lag for r in compare.lag_by_blocks(signal, ["c"], ["c"], "p", "x", "y", 5, block).collect()}
    assert each == {0: 4, 1: 4, 2: 4}


def test_lag_of_a_block_below_the_lag_is_refused(spark):
    with pytest.raises(ValueError):
        compare.lag_by_blocks(spark.createDataFrame([(1, 1.0, 1.0)], "p long, x double, y double"), [], [], "p", "x", "y", 5, 5)


@pytest.mark.parametrize("most", [3, 40])
def test_lag_of_many_short_channels_takes_no_group_each(spark, capsys, most):
    rng = np.random.default_rng(12)
    sets = [(c, c % 2, p, float(x), float(y) if p % 5 else None) for c in range(400) for p, (x, y) in enumerate(rng.integers(-300, 300, (int(rng.integers(1, 30)), 2)) / 100)]
    signal = spark.createDataFrame(sets, "c long, kind long, p long, x double, y double")
    found = compare.lag_by_blocks(signal, ["kind", "c"], ["kind"], "p", "x", "y", most, 64)
    found.explain()
    assert "FlatMapGroups" not in capsys.readouterr().out
    got = {r.kind: (r.lag, r.score) for r in found.collect()}
    for kind in (0, 1):
        at = {(c, p): y for c, k, p, _, y in sets if k == kind and y is not None}
        sums = {k: round(sum(x * at.get((c, p + k), 0.0) for c, kd, p, x, _ in sets if kd == kind), 6) for k in range(-most, most + 1)}
        best = max(sums.values())
        assert got[kind] == (min(k for k in sums if sums[k] == best), best)
