import numpy as np
import pytest
from pyspark.sql import functions as F

from gatewright.llm import vector_search as vs


def brute(rows, asked, k):
    ok = [(i, np.array(v, float)) for i, v in rows if v and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for n, (i, q) in enumerate(ok):
        if asked(i):
            scores = [(-vs.cosines(q[None], v[None])[0], np.inf if j is None else j) for m, (j, v) in enumerate(ok) if m != n]
            yield i, [(None if j == np.inf else j, -s) for s, j in sorted(scores)[:k]]


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(8)]) for i in range(300)]
    rows += [(1000 + i, rows[50][1]) for i in range(12)]  # a common vector
    rows += [(2000, None), (2001, []), (2002, [0.0] * 8), (2003, [None] + [1.0] * 7), (2004, [float("nan")] * 8), (2005, [float("inf")] + [1.0] * 7), (2006, [1.0]), (None, rows[3][1]), (50, rows[50][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"row": F.lit("x"), "list": F.lit(1)})
    got = {}
    for r in vs.nearest(spark, df, F.col("vec_id") % 50 == 0, miss=0.0, test=50.0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    expected = {}
    for i, near in brute(rows, lambda i: i is not None and i % 50 == 0, 5):
        expected.setdefault(i, []).extend((n + 1, j, s) for n, (j, s) in enumerate(near))
    assert got.keys() == expected.keys()
    for i in got:
        a, b = sorted(got[i], key=str), sorted(expected[i], key=str)
        assert [x[:2] for x in a] == [x[:2] for x in b] and [x[2] for x in a] == pytest.approx([x[2] for x in b], abs=1e-15)


def test_few_candidates_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r["rank"], r.vec_id) for r in vs.nearest(spark, df, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert vs.nearest(spark, df.limit(0), F.col("vec_id") == 0).count() == 0
    assert vs.nearest(spark, df.limit(1), F.col("vec_id") == 0).count() == 0


def exact(x, ids, asked, k=5):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = set()
    for i in asked:
        score = x @ x[i]
        score[i] = -9
        near |= {(int(ids[i]), int(ids[j])) for j in np.argsort(-score, kind="stable")[:k]}
    return near


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_with_the_defaults(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    got = {(r.query_id, r.vec_id) for r in vs.nearest(spark, df, F.col("vec_id") % 50 == 0).collect()}
    rows = df.orderBy("vec_id").toPandas()
    near = exact(np.stack(rows["embedding"]).astype(float), rows.vec_id.to_numpy(), np.flatnonzero(rows.vec_id % 50 == 0))
    assert len(got & near) >= 0.9 * len(near) and len(got) == len(near)


def clustered(n, clusters=200, d=32):
    rng = np.random.default_rng(4)
    centers = rng.standard_normal((clusters, d))
    return (centers[rng.integers(0, clusters, n)] + 0.15 * rng.standard_normal((n, d))).astype(np.float32)


def test_clustered_vectors_probe_few_lists(spark, monkeypatch):
    """Recall with small segments and blocks, and lists probed that grow slower than the lists."""
    monkeypatch.setattr(vs, "SEGMENT", 50)
    monkeypatch.setattr(vs, "QUERY_BLOCK", 7)
    x = clustered(4000)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {(r.query_id, r.vec_id) for r in vs.nearest(spark, df, F.col("vec_id") % 50 == 0).collect()}
    assert len(got & exact(x.astype(float), np.arange(4000), range(0, 4000, 50))) >= 0.9 * 5 * 80


def test_probes_follow_the_clusters():
    """Of vectors in clusters few lists are probed, of shapeless ones many."""
    probed = {}
    for name, x in (("clusters", clustered(20_000)), ("shapeless", np.random.default_rng(1).standard_normal((20_000, 32)))):
        u = vs.unit(x.astype(float))
        centers = vs.unit(vs.centroids_of(u[:8000], 142, 1))
        b = u @ centers.T
        near, cos = b.argmax(axis=1), b.max(axis=1)
        by = [cos[near == i] if (near == i).any() else np.ones(1) for i in range(142)]
        rest = u - cos[:, None] * centers[near]
        cov = rest.T @ rest
        lists = vs.Lists(centers, np.bincount(near, minlength=142), np.array([c.mean() for c in by]), np.array([c.var() for c in by]), np.array([c.min() for c in by]), np.trace(cov) ** 2 / (cov * cov).sum())
        probed[name] = np.mean([len(p) for p in lists.probes(u[:200], np.full(200, -1.0), 5, vs.MISS)]) / 142
    assert probed["clusters"] < 0.1 < probed["shapeless"]


def test_scan_abandons_but_keeps_the_near():
    rng = np.random.default_rng(9)
    x = rng.standard_normal((2000, 64))
    q = x[:3] + 0.1 * rng.standard_normal((3, 64))
    turn = vs.rotation(64, 1)
    assert np.allclose(turn @ turn.T, np.eye(64))
    for sparse in (0.0, 0.1, 2.0):  # all at once, both, one by one
        vs.SPARSE, old = sparse, vs.SPARSE
        i, j = vs.scan(vs.unit(q) @ turn, vs.unit(x) @ turn, np.zeros((3, 2000), bool), np.full(3, 4.0), 5, 8, vs.TEST)
        vs.SPARSE = old
        assert len(i) < 1500
        score = vs.cosines(q[i], x[j])
        top = vs.best(i, score, j, 5)
        for a in range(3):
            exact_ = np.argsort(-vs.cosines(np.repeat(q[a : a + 1], 2000, axis=0), x), kind="stable")[:5]
            mine = j[top][i[top] == a]
            assert mine[0] == a and len(mine) == 5 and len(set(mine) & set(exact_)) >= 4


def test_normal_tail():
    import math

    z = np.linspace(-5, 5, 41)
    assert vs.above(z) == pytest.approx([0.5 * math.erfc(x / math.sqrt(2)) for x in z], abs=1e-6)
