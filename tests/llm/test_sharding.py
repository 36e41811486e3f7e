"""Shards: sizes, groups, slots and splitters against plain sums."""

import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gatewright.llm import sharding as sh


def held(got, rows, shards=16, heavy=sh.HEAVY):
    """What every result must fulfil. rows: (doc_id, text)."""
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert all(r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards for r in got)
    slots, sizes, groups = defaultdict(list), [0] * shards, defaultdict(lambda: defaultdict(int))
    for r in got:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
        groups[(r.text_crc32, r.size)][r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    fair = sum(sizes) / shards
    for where in groups.values():
        assert len(where) == 1 or sum(where.values()) > fair
    largest = max(((sum(w.values()) if len(w) == 1 else 0) for w in groups.values()), default=0)
    # whole groups beyond a fair shard aside, every shard is as near as half a light group at each end
    assert max(sizes) <= max(largest, fair * (1 + heavy + 0.002) + 2)
    return sizes


def some(n, seed, longest=200):
    rng = random.Random(seed)
    return [(i, " ".join(f"w{rng.randrange(999)}" for _ in range(rng.randrange(longest)))) for i in range(n)]


def test_sizes_near_equal(spark):
    rows = some(4000, 1)
    rows += [(9000 + i, rows[7][1]) for i in range(400)]  # a group under a fair shard
    rows += [(20_000 + i, f"long {i} " * 2500) for i in range(9)]  # rows over a part of a fair shard
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    sizes = held(sh.balanced(spark, df).collect(), rows)
    assert max(sizes) - min(sizes) < 0.02 * sum(sizes) / 16


@pytest.mark.parametrize("slot_rows", [sh.SLOT_ROWS, 500])
def test_groups_that_hold_a_third_of_all(spark, slot_rows):
    rows = some(3000, 2, 20) + [(i, "the same words in all of these " * 3) for i in range(2000)] + [(None, None)] * 2500 + [(None, "alike in all " * 20)] * 1000
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sh.balanced(spark, df, slot_rows=slot_rows).collect()
    sizes = held(got, rows)
    assert max(sizes) - min(sizes) < 0.05 * sum(sizes) / 16
    assert len({r.shard for r in got if r.size == 13 * 20 + 1}) > 4


def test_the_tables_own(spark):
    for sf in ("sf0.001", "sf0.01"):
        docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()
        held(sh.op13_sharding(spark, f"/root/testdata/{sf}").collect(), [(r.doc_id, r.text) for r in docs])


def test_nulls_clashes_and_few_rows(spark, docs, rows, empty):
    clash = docs.withColumns({c: F.lit("x") for c in ("row", "key", "tie", "salt", "second", "range", "piece", "n", "base", "placed", "bytes", "a.b")})
    got = sh.balanced(spark, clash, columns=[c for c in clash.columns]).collect()
    held(got, [(i, t) for i, t, _ in rows])
    assert all(r["key"] == r["base"] == r["piece"] == r["row"] == r["a.b"] == "x" for r in got) and "text" in got[0]
    assert sh.balanced(spark, empty).count() == 0
    one = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert [(r.size, r.slot) for r in sh.balanced(spark, one).collect()] == [(1, 0)]
    large = [(i, "x" * 1_000_000) for i in range(3)] + [(9, "y" * 2_000_000)]
    held(sh.balanced(spark, spark.createDataFrame(large, "doc_id long, text string")).collect(), large)


def test_splitters_refine(spark):
    """Keys that share all but their last bits need every pass."""
    rng = random.Random(4)
    values = sorted((5 << 60) - rng.randrange(3000) for _ in range(2000)) + [7]
    rows = spark.createDataFrame([(v, rng.randrange(1, 50)) for v in values], "key long, size long")
    sizes = Counter()
    for v, s in rows.collect():
        sizes[v] += s
    total = sum(sizes.values())
    targets = [total * i / 7 for i in range(1, 7)]
    found, _ = sh.splitters(rows, "key", targets, 5.0)
    for t, v in zip(targets, found, strict=True):
        below = sum(s for k, s in sizes.items() if k < v)
        best = min(abs(sum(s for k, s in sizes.items() if k < x) - t) for x in [*sizes, max(sizes) + 1])
        assert abs(below - t) <= max(5.0, best)
    assert sh.splitters(rows.limit(0), "key", targets, 5.0) == ([0] * 6, {})


def test_level():
    assert sh.level([5, 0, 1], 4) == [0.0, 2.5, 1.5]
    assert sh.level([0, 0], 0) == [0.0, 0.0]
    assert sum(sh.level([9, 3, 1, 0], 30)) == pytest.approx(30)


def test_only_dataframe_functions(spark):
    plan = sh.op13_sharding(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
