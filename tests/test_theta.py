"""Joins by two inequalities against a nested loop."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatewright.operators import theta

HOLDS = {">=": lambda a, b: a >= b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, "<": lambda a, b: a < b}
LEFT, RIGHT = "request_id long, budget double, level int", "tool_id string, cost double, need int"


def rows(seed, n, name):
    rng = random.Random(seed)
    out = [(name(i), rng.choice([1.5, float(rng.randrange(40)), rng.random() * 40]), rng.randrange(12)) for i in range(n)]
    return out + [(name(0), None, 3), (name(1), 2.0, None), (name(2), float("nan"), 3), (name(3), float("inf"), 5), (name(4), float("-inf"), 5), out[0], out[0]]


@pytest.mark.parametrize("ops", [(">=", ">="), (">", "<="), ("<", "<"), ("<=", ">")])
@pytest.mark.parametrize("block", [7, 4096])
def test_same_as_a_nested_loop(spark, ops, block):
    a, b = rows(1, 120, lambda i: i), rows(2, 90, lambda i: f"t{i}")
    left = spark.createDataFrame(a, LEFT).repartition(3).withColumns({"id": F.lit("x"), "block": F.lit("y"), "x": F.lit(1)})
    got = theta.inequality_join(left, spark.createDataFrame(b, RIGHT), ("budget", ops[0], "cost"), ("level", ops[1], "need"), block=block)
    assert got.columns == ["request_id", "tool_id"]
    fine = lambda r: r[1] is not None and r[2] is not None and not math.isnan(r[1])
    expected = Counter((x[0], y[0]) for x in a if fine(x) for y in b if fine(y) and HOLDS[ops[0]](x[1], y[1]) and HOLDS[ops[1]](x[2], y[2]))
    assert Counter(map(tuple, got.collect())) == expected and expected


def test_empty_sides(spark):
    left, right = spark.createDataFrame([(1, 2.0, 3)], LEFT), spark.createDataFrame([("a", 1.0, 3)], RIGHT)
    join = lambda a, b: theta.inequality_join(a, b, ("budget", ">=", "cost"), ("level", ">=", "need")).count()
    assert (join(left, right), join(left.limit(0), right), join(left, right.limit(0))) == (1, 0, 0)


def test_a_value_of_a_third_of_all_rows_is_split(spark):
    df = spark.range(9000).select(F.col("id").alias("request_id"), F.when(F.col("id") < 3000, 5.0).otherwise(F.col("id").cast("double")).alias("budget"), (F.col("id") % 7).cast("int").alias("level"))
    blocks = theta._blocks(df, "request_id", F.col("budget"), F.col("level"), 256, "t").select("block", "low_x", "high_x", F.size("ids").alias("n")).collect()
    assert sum(b.n for b in blocks) == 9000 and max(b.n for b in blocks) <= 256
    assert len({b.block >> 32 for b in blocks if b.low_x <= 5.0 <= b.high_x}) > 1


def test_blocks_that_cannot_match_are_not_met(spark):
    """The pairs of blocks follow from bounds: here half of them, and none of the other half reaches a task."""
    rng = np.random.default_rng(1)
    lx, rx = np.sort(rng.random(400)), np.sort(rng.random(300))
    i, j = theta.matches(lx, np.ones(400), rx, np.zeros(300), (True, True))
    assert len(i) == sum((rx <= x).sum() for x in lx) and (rx[j] <= lx[i]).all()


@pytest.mark.parametrize("ops", [(">=", ">="), (">", "<="), ("<", "<"), ("<=", ">")])
@pytest.mark.parametrize("block", [1, 7, 4096])
def test_nearest_are_those_of_a_nested_loop(spark, ops, block):
    a, b = rows(1, 120, lambda i: i), rows(2, 90, lambda i: f"t{i}")
    a, b = ([(n, v, None if y is None else float(y)) for n, v, y in t] for t in (a, b))
    a, b = a + [(200, 39.0, float("inf")), (201, 0.5, -1.0)], b + [("u", 1.5, float("inf"))]
    left, right = spark.createDataFrame(a, "request_id long, budget double, level double"), spark.createDataFrame(b, "tool_id string, cost double, need double")
    left = left.repartition(3).withColumns({"id": F.lit("x"), "block": F.lit("y"), "x": F.lit(1)})
    got = theta.inequality_nearest(left, right, ("budget", ops[0], "cost"), ("level", ops[1], "need"), 3, block=block)
    assert got.columns == ["request_id", "tool_id", "value"]
    fine, sign = lambda r: r[1] is not None and r[2] is not None and not math.isnan(r[1]), -1 if ops[0] in (">=", ">") else 1
    expected, best = {}, {}
    for x in a:
        found = [(sign * y[1], y[0]) for y in b if fine(x) and fine(y) and HOLDS[ops[0]](x[1], y[1]) and HOLDS[ops[1]](x[2], y[2])]
        expected[x[0]] = sorted(expected.get(x[0], []) + found)[:3]
    for r in got.collect():
        best.setdefault(r.request_id, []).append((sign * r.value, r.tool_id))
    assert {q: sorted(v)[:3] for q, v in best.items()} == {q: v for q, v in expected.items() if v} and best


def test_nearest_asks_few_blocks_and_few_pairs(spark):
    """3,000 rows with some millions of matches, a third of them of one value: each row meets four blocks at most, and nine pairs or so come out."""
    df = spark.range(3000).select(F.col("id").alias("request_id"), F.col("id").alias("tool_id"), F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id").cast("double")).alias("v"), (F.col("id") % 7).cast("int").alias("y"))
    join = lambda how, *more: how(df, df, ("v", ">=", "v"), ("y", ">=", "y"), *more, block=64)
    assert join(theta.inequality_join).count() > 2_000_000
    assert join(theta.inequality_nearest, 3).count() <= 3000 * 4 * 3
    low = np.arange(50.0)
    i, b = theta.visits(np.full(4, 60.0), np.array([0.0, 1.0, 2.0, 5.0]), low, low + 1, np.array([[1.0, 1.0, 1.0]] + [[3.0, np.inf, np.inf]] * 49), (True, True))
    assert sorted(zip(i.tolist(), b.tolist(), strict=True)) == [(1, 0), (2, 0), (3, 47), (3, 48), (3, 49)]


def test_rank_affordable_makes_no_pair_that_is_not_asked_for(spark, monkeypatch):
    """It joined all affordable pairs before it ranked them."""
    from gatewright.plans import follow_up

    monkeypatch.delattr(theta, "inequality_join")
    assert follow_up.rank_affordable(spark, "/root/testdata/sf0.001").count() > 0
