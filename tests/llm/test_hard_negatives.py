"""Hard negatives against brute force over all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatewright.llm import hard_negatives as hn


def brute(rows, anchors, label, positives=5, negatives=10):
    """rows: (id, vector, label), as given; label(id, label): the one that counts."""
    ok = []
    for n, (i, v, y) in enumerate(rows):
        y = label(i, y)
        if y is not None and v and all(x is not None and np.isfinite(x) for x in v):
            ok.append((n, i, [int(np.floor(256 * float(x))) for x in v], y))
    last = lambda i: float("inf") if i is None else i
    out = []
    for n, i, a, y in ok:
        if i is None or not anchors(i):
            continue
        scored = sorted((-sum(p * q for p, q in zip(a, v, strict=True)), last(j), m, j, z) for m, j, v, z in ok if m != n)
        for s, _, _, p, _ in [x for x in scored if x[4] == y][:positives]:
            inside = [x for x in scored if x[4] != y and 30 * -s <= 100 * -x[0] <= 90 * -s]
            out += [(i, p, r, x[3], -s, -x[0]) for r, x in enumerate(inside[:negatives], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    x = np.float32(rng.standard_normal((700, 6)) * 0.6)
    out = [(i, x[i].tolist(), int(rng.integers(0, 4))) for i in range(700)]
    out += [(1000 + i, x[100].tolist(), i % 3) for i in range(60)]  # a common vector
    out += [(100, x[5].tolist(), 1), (None, x[3].tolist(), 2), (None, x[200].tolist(), out[200][2]), out[200], (2000, [0.0] * 6, 1)]
    out += [(3000, None, 1), (3100, [], 1), (3200, [None] + [1.0] * 5, 1), (3300, [float("nan")] * 6, 1), (3400, [float("inf")] * 6, 1), (3500, x[1].tolist(), None)]
    return out


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("sizes", [(4096, 1024), (64, 3)])
def test_same_as_brute_force(spark, rows, sizes):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit("x") for c in ("row", "id", "anchor", "vector", "segment", "scores")})
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hn.hard_negatives(spark, df, F.col("vec_id") % 20 == 0, label=label, segment_rows=sizes[0], anchor_rows=sizes[1])
    moved = lambda i, y: (y + 1) % 10 if i is not None and i % 7 == 0 and y is not None else y
    expected = brute(rows, lambda i: i % 20 == 0, moved)
    assert sorted(map(tuple, got.collect()), key=str) == expected and len(expected) > 1000


def test_query(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    got = sorted(map(tuple, hn.op11_hard_negatives(spark, "/root/testdata/sf0.01").collect()), key=str)
    assert got == brute(rows, lambda i: i % 100 == 0, lambda i, y: (y + 1) % 10 if i % 7 == 0 else y) and got


def test_few_rows_and_none(spark):
    one = spark.createDataFrame([(0, [1.0], 1)], SCHEMA)
    assert hn.hard_negatives(spark, one.limit(0), F.lit(True)).count() == 0
    assert hn.hard_negatives(spark, one, F.lit(True)).count() == 0
    assert hn.hard_negatives(spark, one, F.lit(False)).count() == 0
    three = spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 1), (2, [0.5], 2), (3, [0.5, 1.0], 2), (4, [1e9], 2), (5, [0.1], 2)], SCHEMA)
    assert [tuple(r) for r in hn.hard_negatives(spark, three, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 2, 256 * 256, 128 * 256)]


def test_bounds_leave_few_to_read():
    """Where an anchor's weight lies in a few dimensions, most candidates are ruled out long before the last."""
    rng = np.random.default_rng(1)
    x = rng.integers(-256, 256, (4000, 64))
    anchor = np.round(4000 * 0.6 ** np.arange(64)).astype(np.int64)[rng.permutation(64)]
    seen = []
    segment = hn.Segment(x)
    scan = segment.scan

    def counted(a, alive, keep):
        def kept(partial, less, more):
            seen.append(len(partial))
            return keep(partial, less, more)

        return scan(a, alive, kept)

    segment.scan = counted
    at, score = hn.highest(segment, anchor, np.ones(4000, bool), 5)
    assert sorted(score.tolist())[-5:] == sorted((x @ anchor).tolist())[-5:] and seen[0] == 4000 and seen[1] < 400
