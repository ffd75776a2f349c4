"""Importance resampling, the audit of filters and fingerprints against brute force."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.llm import audit, fingerprints, importance
from chronoloom.llm._common import numbered

RNG = np.random.default_rng(8)
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
DOC = "doc_id long, text string, source string, `a.b` int, key int, row int, id int, mask int"


def words(n):
    return " ".join(RNG.choice(WORDS, n))


@pytest.fixture(scope="module")
def corpus():
    same = words(240)
    texts = [None, "", " ", "Ünïcode wörds ÉÀ 12a3", same, same, same + "!", words(19), words(20), words(300), "na " * 250, words(210) + " $1", words(30).upper(), words(220).title(), "x" * 5000, "tiny"]
    texts += [words(int(n)) for n in RNG.integers(1, 60, 60)]
    rows = [(None if i == 9 else i, t, ("a", "b", None, "")[i % 4], 1, 2, 3, 4, 5) for i, t in enumerate(texts)]
    return rows + [(4, same, "b", 1, 2, 3, 4, 5), (30, words(40), "a", 1, 2, 3, 4, 5)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOC)


def test_numbered(spark):
    rows = [(int(x),) for x in RNG.integers(0, 50, 500)]
    got = numbered(spark.createDataFrame(rows, "x int").repartition(7), "numbered", F.desc("x")).collect()
    assert sorted(r["index"] for r in got) == list(range(1, 501))
    assert [r.x for r in sorted(got, key=lambda r: r["index"])] == sorted((x for x, in rows), reverse=True)


def features(text, longest):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(ws), [" ".join(ws[i : i + n]) for n in range(1, longest + 1) for i in range(len(ws) - n + 1)]


@pytest.mark.parametrize("longest", [1, 2])
def test_resampling(spark, docs, corpus, longest):
    target = [(1, "alpha beta alpha", 0), (2, None, 0), (3, words(30) + " Ünïcode", 0)]
    bucket = lambda f: zlib.crc32(f.encode()) % 500
    s = Counter(bucket(f) for r in corpus for f in features(r[1], longest)[1])
    t = Counter(bucket(f) for r in target for f in features(r[1], longest)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + 500) / ((s[b] + 1) * (n_t + 500)))) for b in range(500)]
    want = []
    for r in corpus:
        n, found = features(r[1], longest)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        want.append([r[0], len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    order = sorted((w for w in want if w[4] >= 20), key=lambda w: (-w[3], w[0] is None, w[0] or 0))
    k = len(order) * 30 // 100
    got = importance.resampled(docs, spark.createDataFrame(target, "item_id long, text string, bag int"), longest=longest, buckets=500, seed=7, percent=30).collect()
    assert Counter((r.key, r.n_features, r.weight, r.score) for r in got) == Counter(tuple(w[:4]) for w in want)
    drawn = sorted((r.rank, r.key, r.score) for r in got if r["rank"] is not None)
    assert [d[1:] for d in drawn] == [(w[0], w[3]) for w in order[:k]] and [d[0] for d in drawn] == list(range(1, k + 1)) and k > 3


def test_radix_selection(spark):
    """Every k of rows whose scores tie, down to repeated rows."""
    rows = [(int(s), None if k == 3 else int(k), i) for i, (s, k) in enumerate(zip(RNG.integers(-70000, 70000, 40) // 30000 * 30000, RNG.integers(-4, 4, 40)))] + [(0, 1 << 62, 40), (0, -(1 << 62), 41)]
    df = spark.createDataFrame(rows, "score long, key long, row long").coalesce(1).cache()
    digits = importance.composite("score", "key", "row")
    order = sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0, r[2]))
    for k in (1, 7, 20, 41, 42):
        last = importance.kth(df, digits, k)
        upto = F.struct(*list(digits.values())[: len(last)]) <= F.struct(*(F.lit(d).cast("long") for d in last))
        assert {r.row for r in df.where(upto).collect()} == {r[2] for r in order[:k]}, k


def test_resampling_of_nothing(spark, docs):
    empty, bench = spark.createDataFrame([], DOC), spark.createDataFrame([], "item_id long, text string")
    assert importance.resampled(empty, bench).count() == 0
    flat = importance.resampled(docs, bench).collect()
    assert len(flat) == docs.count() and any(r["rank"] for r in flat)
    drawn = importance.drawn_documents(docs, bench, percent=50)
    assert drawn.columns == [*docs.columns, "draw_rank"] and 0 < drawn.count() < docs.count()


def test_audit(spark, docs, corpus):
    labels = [(4, 1, 0), (4, 0, 1), (12, 1, None), (16, None, 1), (None, 1, 1)] + [(i, i % 2, i % 3 == 0) for i in range(20, 60)]
    labels = [(k, q, int(t) if t is not None else None) for k, q, t in labels]
    good, toxic = {k for k, q, _ in labels if q == 1 and k is not None}, {k for k, _, t in labels if t == 1 and k is not None}
    first = {}
    for r in corpus:
        if r[0] is not None:
            first[r[1] or ""] = min(first.get(r[1] or "", r[0]), r[0])
    facts = []
    for r in corpus:
        t = r[1] or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": r[0] is not None and r[0] > first[t]}
        facts.append((r[2] or "", fails, r[0] in good, r[0] in toxic))
    want = {}
    for part in {f[0] for f in facts}:
        shapley = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [f for f in facts if f[0] == part]
            for step, name in enumerate(order):
                gone, own = [f for f in left if f[1][name]], [f for f in facts if f[0] == part]
                left = [f for f in left if not f[1][name]]
                shapley[name] += len(gone)
                failing = sum(f[1][name] for f in own)
                want[(part, order, step + 1)] = [len(left), len(gone), failing - len(gone), sum(f[1][name] and sum(f[1].values()) == 1 for f in own), sum(f[2] for f in gone), sum(f[3] for f in gone)]
        for (p, order, step), w in want.items():
            if p == part:
                w.append(shapley[order[step - 1]])
    got = audit.audited(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {(r.part, r.filter_order, r.step): [r[m] for m in (*audit.METRICS, "shapley")] for r in got} == want and len(got) == len(want)
    assert sum(w[4] for w in want.values()) and sum(w[2] for w in want.values())


def test_audit_of_nothing(spark):
    assert audit.audited(spark.createDataFrame([], DOC), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def brute_anchors(text):
    import xxhash

    code = text.encode("utf-32-be")
    h = lambda at, n: xxhash.xxh64_intdigest(code[4 * at : 4 * (at + n)], seed=42)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    inner = [signed(h(i, fingerprints.S)) for i in range(len(text) - fingerprints.S + 1)]
    for i in range(len(text) - fingerprints.K + 1):
        w = inner[i : i + fingerprints.INNER]
        if min(w) in (w[0], w[-1]):
            yield h(i, fingerprints.K) >> 33, i


def brute_fingerprint(text):
    import xxhash

    first = {}
    for h, at in brute_anchors(text):
        first.setdefault(h, at)
    if not first and text:
        first = {xxhash.xxh64_intdigest(text.encode(), seed=42) >> 33: 0}
    return sorted(first.items())[: fingerprints.SIZE]


def brute_likeness(a, b):
    if not a and not b:
        return 1.0
    x, y = dict(a), dict(b)
    top = sorted({**x, **y})[: fingerprints.SIZE]
    shifts = sorted(y[h] - x[h] for h in top if h in x and h in y)
    if not shifts:
        return 0.0
    slack = max(fingerprints.K, max([*x.values(), *y.values()]) * fingerprints.SLACK)
    return sum(abs(s - shifts[len(shifts) // 2]) <= slack for s in shifts) / len(top)


def test_fingerprints(spark, docs, corpus):
    ids = sorted({r[0] for r in corpus if r[0] is not None}, reverse=True)
    of = {}
    for r in corpus:
        of.setdefault(r[0], set()).add(r[1] or "")
    import xxhash

    signed = lambda t: (lambda x: x - (1 << 64) if x >> 63 else x)(xxhash.xxh64_intdigest(t.encode(), seed=42))
    want = Counter()
    for r in corpus:
        t, after = r[1] or "", None
        if r[0] is not None:
            after = min(of[ids[(ids.index(r[0]) + 1) % len(ids)]], key=signed)
        cut = len(t) // 3
        edited = t[: len(t) - cut] + (after or "")[:cut]
        own, new = brute_fingerprint(t), brute_fingerprint(edited)
        near = 0.0 if after is None else brute_likeness(own, brute_fingerprint(after))
        want[(r[0], len(t), hashlib.sha256(edited.encode()).hexdigest(), tuple(own), tuple(new), round(brute_likeness(own, new), 9), round(near, 9))] += 1
    got = Counter((r.id, r.n_chars, r.edited_sha256, *(tuple((x >> 32, x & fingerprints.PLACE) for x in f) for f in (r.fingerprint, r.edited_fingerprint)), round(r.near_edited, 9), round(r.near_next, 9)) for r in fingerprints.fingerprinted(docs).collect())
    assert got == want
    assert fingerprints.fingerprinted(spark.createDataFrame([], DOC)).count() == 0


def test_fingerprints_tell_texts_apart(spark):
    base = words(2000)
    texts = [base, "new head " + base, base[:6000] + words(600), words(2000), base]
    rows = fingerprints.fingerprinted(spark.createDataFrame([(9 - i, t) for i, t in enumerate(texts)], "doc_id long, text string")).orderBy(F.desc("id")).collect()
    assert rows[0].near_next > 0.9 and 0.2 < rows[1].near_next < 0.9 and rows[2].near_next < 0.1 and rows[3].near_next < 0.1 and rows[4].near_next == 1.0 and rows[0].fingerprint == rows[4].fingerprint
