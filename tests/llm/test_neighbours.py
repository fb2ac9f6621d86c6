import math

import numpy as np
import pytest

from folioweave.llm import neighbours as nn


def brute(rows, k, every=20):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in good:
        if i % every == 0:
            found = sorted((-float((v * q).sum()), j) for j, v in good if j != i)
            out[i] = [(j, -s) for s, j in found[:k]]
    return out


def rows(n, dim=16, seed=2):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, dim)).astype(np.float32)
    m[5 : n : 7] = m[5]  # one very common vector
    return [(i, m[i].tolist()) for i in range(n)]


def test_exact_when_all_is_visited(spark):
    data = rows(400) + [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] + [1.0] * 15), (1060, [None] + [1.0] * 15), (1080, [float("inf")] * 16), (None, [1.0] * 16)]
    df = spark.createDataFrame([(i, v, 3) for i, v in data], "vec_id long, embedding array<float>, rank int")
    got = nn.nearest_neighbours(df, k=7, sample_rows=300, centroids=4, aim=1.0, shard=50).collect()
    want = brute(data, 7)
    assert {r.query_id for r in got} == set(want)
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = sum(len({j for j, _ in by[q]} & {j for j, _ in want[q]}) for q in want)
    assert hits >= 0.97 * 7 * len(want)
    for q in by:
        assert [s for _, s in by[q]] == sorted((s for _, s in by[q]), reverse=True) and len(by[q]) == 7
        scores = dict(by[q])
        assert all(scores[j] == pytest.approx(s, abs=1e-12) for j, s in want[q] if j in scores)


def test_ties_and_few(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(60)], "vec_id long, embedding array<float>")
    got = nn.nearest_neighbours(df, k=5).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(q, n + 1, v) for q in (0, 20, 40) for n, v in enumerate([v for v in range(6) if v != q][:5])]
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id, r.score) for r in nn.nearest_neighbours(few).collect()] == [(0, 1, 4.0)]
    assert nn.nearest_neighbours(few.where("false")).count() == 0


def test_repeated_rows(spark):
    data = [(i, [float(i % 7 + 1), float(i % 5)]) for i in range(40)]
    rows = data + [data[0], data[0], (20, [9.0, 9.0]), data[7]]
    got = nn.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=5, aim=1.0).collect()
    want = brute(data, 5)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted((q, n + 1, j, s) for q in want for n, (j, s) in enumerate(want[q]))


def test_recall_on_the_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = nn.nearest_neighbours(df).collect()
    data = [(r.vec_id, r.embedding) for r in df.collect()]
    want = brute(data, 20)
    hits = sum(len({r.vec_id for r in got if r.query_id == q} & {j for j, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_heap_order():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=6), rng.normal(size=5)
    order = nn.traverse(a, b, np.ones(30, int), float("inf"))
    sums = [a[c // 5] + b[c % 5] for c in order]
    assert len(set(order)) == 30 and sums == sorted(sums, reverse=True)


def test_layout_spreads_a_large_cell():
    first, many = nn.layout(np.array([10, 0, 500, 30, 30, 50]), 100)
    assert many.tolist() == [1, 1, 10, 1, 1, 1] and first[2] == 1 and first[3] == first[4] == 11 and first[5] == 12
