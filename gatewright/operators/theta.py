"""Legality by two inequalities: a join by sorted permutations and bit arrays on range blocks.

Either side is range-sorted by the first condition's value and cut into blocks of at most
BLOCK rows, each a row with its values in arrays. Equal values are spread by a hash of
the id, so a value that a third of all rows have is many blocks, in several tasks. From the
blocks' bounds alone follows which pairs can hold a match: a left block meets a prefix of
the right blocks, by their least first value, less those that the second value rules out. Each
pair that is left is a group of its own: right rows enter a bit array, ordered by the second
value, as the first admits them, and a left row's matches are the bits set up to its place.
So no row is compared with rows of blocks that cannot match it, and work follows the result.

Where only the nearest k matches of each left row are wanted, all matches are never made: the
right side's blocks are in the order of nearness, and each carries its k least second values.
So from the blocks' summaries follows, for each left row by itself, which blocks hold its
k nearest: each block that lies as a whole under its first value is visited only if it holds a match, and only one
block can lie around that value. A left row visits k + 1 blocks at most, and work follows the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.steps import written

BLOCK = 2048
#: left <operator> right: whether values turn their sign, and whether equal ones match.
_OPERATORS = {">=": (1, True), ">": (1, False), "<=": (-1, True), "<": (-1, False)}


def matches(lx: np.ndarray, ly: np.ndarray, rx: np.ndarray, ry: np.ndarray, equal: tuple[bool, bool]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) with rx[j] under lx[i] and ry[j] under ly[i], or equal to them where that counts."""
    by_x, by_y = np.argsort(rx, kind="stable"), np.argsort(ry, kind="stable")
    place = np.empty(len(ry), np.int64)
    place[by_y] = np.arange(len(ry))
    side = ["right" if e else "left" for e in equal]
    admitted, under = np.searchsorted(rx[by_x], lx, side[0]), np.searchsorted(ry[by_y], ly, side[1])
    bits, entered, found_i, found_j = np.zeros(len(rx), bool), 0, [], []
    for i in np.argsort(admitted, kind="stable").tolist():
        bits[place[by_x[entered : admitted[i]]]] = True
        entered = admitted[i]
        hits = np.flatnonzero(bits[: under[i]])
        if len(hits):
            found_i.append(np.full(len(hits), i))
            found_j.append(by_y[hits])
    none = np.zeros(0, np.int64)
    return np.concatenate(found_i or [none]), np.concatenate(found_j or [none])


def _least(ys: np.ndarray) -> list[np.ndarray]:
    """For each power of two, the least of so many values up to each place."""
    levels = [ys]
    while len(levels[-1]) > (n := 1 << (len(levels) - 1)):
        levels.append(np.minimum(levels[-1], np.concatenate([np.full(n, np.inf), levels[-1][:-n]])))
    return levels


def _last_under(levels: list[np.ndarray], at: np.ndarray, y: np.ndarray, equal: bool) -> np.ndarray:
    """For each i, the last place up to at[i] whose value is under y[i], or equal to it where that counts; -1 for none."""
    at = at.copy()
    for t in range(len(levels) - 1, -1, -1):
        least = levels[t][np.maximum(at, 0)]
        at = np.where((at >= 0) & ((least > y) if equal else (least >= y)), np.maximum(at - (1 << t), -1), at)
    return at


def nearest(lx: np.ndarray, ly: np.ndarray, rx: np.ndarray, ry: np.ndarray, equal: tuple[bool, bool], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) as of `matches`, for each i only the last k places j; rx is sorted."""
    levels, i, found = _least(ry), np.arange(len(lx)), []
    at = np.searchsorted(rx, lx, "right" if equal[0] else "left") - 1
    for _ in range(k):
        at = _last_under(levels, at, ly[i], equal[1])
        i, at = i[at >= 0], at[at >= 0]
        found.append((i, at))
        at = at - 1
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def visits(lx: np.ndarray, ly: np.ndarray, low: np.ndarray, high: np.ndarray, least: np.ndarray, equal: tuple[bool, bool]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, b): the blocks b that may hold one of the k nearest matches of i. Blocks are in order, from low to high first values; least: their k least second values, a row a block, filled up with infinity, NaN for infinite values of their own."""
    # infinite values match infinite ones; what fills up a short block matches nothing
    fill, values = np.isposinf(least), np.where(np.isnan(least), np.inf, least)
    levels, i, found = _least(values[:, 0]), np.arange(len(lx)), []
    at = np.searchsorted(low, lx, "right" if equal[0] else "left") - 1
    sure = np.zeros(len(lx), np.int64)
    while len(i):
        at = _last_under(levels, at, ly[i], equal[1])
        i, at, sure = i[at >= 0], at[at >= 0], sure[at >= 0]
        found.append((i, at))
        whole = (high[at] <= lx[i]) if equal[0] else (high[at] < lx[i])
        y = ly[i][:, None]
        sure = sure + whole * (((values[at] <= y) if equal[1] else (values[at] < y)) & ~fill[at]).sum(1)
        more = sure < least.shape[1]
        i, at, sure = i[more], at[more] - 1, sure[more]
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2


def _blocks(df: DataFrame, id_: str, x: Column, y: Column, block: int, what: str) -> DataFrame:
    """(block, n, ids, x, y and their bounds), written. Rows with a null or NaN value are none."""
    rows = df.select(F.col(id_).alias("id"), x.cast("double").alias("x"), y.cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    kind = rows.schema["id"].dataType.simpleString()
    rows = rows.withColumn("salt", F.xxhash64("id", F.monotonically_increasing_id())).repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "x", "salt").sortWithinPartitions("x", "salt").drop("salt")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                xs, ys = (np.asarray(part[c]) for c in ("x", "y"))
                arrays = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part[c]) for c in ("id", "x", "y")]
                yield pa.RecordBatch.from_arrays([pa.array([k]), *[pa.array([float(v)]) for v in (xs.min(), xs.max(), ys.min(), ys.max())], *arrays], ["block", "low_x", "high_x", "low_y", "high_y", "ids", "xs", "ys"])
                k += 1

    return written(rows.mapInArrow(cut, f"block long, low_x double, high_x double, low_y double, high_y double, ids array<{kind}>, xs array<double>, ys array<double>"), what)


def inequality_join(left: DataFrame, right: DataFrame, first: tuple[str, str, str], second: tuple[str, str, str], *, left_id: str = "request_id", right_id: str = "tool_id", block: int = BLOCK) -> DataFrame:
    """(left_id, right_id) for all pairs of rows that fulfil both conditions; each is (column of left, operator, column of right) with one of < <= > >=.

    Values are compared as doubles. Null and NaN match nothing; repeated rows match one by
    one; an empty table on either side gives none. Other columns, whatever their names, are not read.
    """
    (sx, ex), (sy, ey) = (_OPERATORS[c[1]] for c in (first, second))
    sides = [_blocks(df, id_, F.col(first[at]) * sx, F.col(second[at]) * sy, block, what) for df, id_, at, what in ((left, left_id, 0, "theta-left"), (right, right_id, 2, "theta-right"))]
    bounds = ("block", "low_x", "high_x", "low_y", "high_y")
    mine, other = (s.select(*bounds) for s in sides)
    # a row a block: right blocks by their least x, and how many of them a left block's greatest x reaches
    other = other.withColumn("place", F.row_number().over(Window.orderBy("low_x", "block")))
    both = mine.select(F.col("high_x").alias("at"), "block", F.lit(0).alias("n")).unionByName(other.select(F.col("low_x").alias("at"), F.lit(None).cast("long").alias("block"), F.lit(1).alias("n")))
    reach = both.select("block", F.sum("n").over(Window.orderBy("at").rangeBetween(Window.unboundedPreceding, 0)).alias("reach")).where("block IS NOT NULL AND reach > 0")
    met = mine.join(reach, "block").select(F.col("block").alias("lb"), F.col("high_y").alias("up_to"), F.explode(F.sequence(F.lit(1), F.col("reach").cast("int"))).alias("place"))
    met = met.join(other.select("place", F.col("block").alias("rb"), "low_y"), "place").where(F.col("low_y") <= F.col("up_to")).select("lb", "rb")

    named = [s.select(F.col("block").alias(b), F.col("ids").alias(f"{b}_ids"), F.col("xs").alias(f"{b}_x"), F.col("ys").alias(f"{b}_y")) for s, b in zip(sides, ("lb", "rb"), strict=True)]
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((left, left_id), (right, right_id))]

    def meet(table: pa.Table) -> pa.Table:
        cell = lambda c: table[c].combine_chunks().flatten()
        i, j = matches(*(np.asarray(cell(c)) for c in ("lb_x", "lb_y", "rb_x", "rb_y")), (ex, ey))
        return pa.table([cell("lb_ids").take(pa.array(i)), cell("rb_ids").take(pa.array(j))], names=[left_id, right_id])

    return met.join(named[0], "lb").join(named[1], "rb").groupBy("lb", "rb").applyInArrow(meet, f"`{left_id}` {kinds[0]}, `{right_id}` {kinds[1]}")


def inequality_nearest(left: DataFrame, right: DataFrame, first: tuple[str, str, str], second: tuple[str, str, str], k: int, *, left_id: str = "request_id", right_id: str = "tool_id", block: int = BLOCK) -> DataFrame:
    """(left_id, right_id, value): of the pairs of `inequality_join`, for each left row the k whose right value in the first condition is nearest to its own, of equal ones the lesser right_id; with that value, as a double.

    The summaries of right blocks, a row for `block` rows, go to the driver and to each task.
    """
    (sx, ex), (sy, ey) = (_OPERATORS[c[1]] for c in (first, second))
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sides = []
    for df, id_, at in ((left, left_id, 0), (right, right_id, 2)):
        rows = df.select(F.col(id_).alias("id"), (F.col(first[at]) * sx).cast("double").alias("x"), (F.col(second[at]) * sy).cast("double").alias("y"))
        sides.append(rows.where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)").withColumn("salt", F.xxhash64("id", F.monotonically_increasing_id())))
    kinds = [s.schema["id"].dataType.simpleString() for s in sides]
    arrays = [f"ids array<{kind}>, xs array<double>, ys array<double>" for kind in kinds]
    row = lambda part, cols: [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part[c]) for c in cols]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                xs, ys = (np.asarray(part[c]) for c in ("x", "y"))
                # the order is by values, with infinity as NaN, which is sorted last, before what fills up
                least = np.sort(ys)[:k]
                least = np.concatenate([np.where(np.isposinf(least), np.nan, least), np.full(max(k - len(ys), 0), np.inf)])
                bounds = [pa.array([n]), pa.array([float(xs[0])]), pa.array([float(xs[-1])]), pa.array([least.tolist()], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([*bounds, *row(part, ("id", "x", "y"))], ["block", "low", "high", "least", "ids", "xs", "ys"])
                n += 1

    # the greater place is the nearer: by value, then by descending id
    order = ("x", F.desc("id"), "salt")
    ranged = sides[1].repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("salt")
    blocks = written(ranged.mapInArrow(cut, f"block long, low double, high double, least array<double>, {arrays[1]}"), "nearest-right")
    known = blocks.select("block", "low", "high", "least").orderBy("block").collect()
    numbers, low, high = (np.array([r[c] for r in known], t) for c, t in (("block", np.int64), ("low", float), ("high", float)))
    least = np.array([r["least"] for r in known], float).reshape(-1, k)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                i, b = visits(*(np.asarray(part[c]) for c in ("x", "y")), low, high, least, (ex, ey))
                for one in np.unique(b).tolist():
                    mine = part.take(pa.array(i[b == one]))
                    yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([int(numbers[one])]), *row(mine, ("id", "x", "y"))], ["chunk", "block", "ids", "xs", "ys"])
                    n += 1

    asked = sides[0].repartitionByRange(parts, "x", "salt").sortWithinPartitions("x", "salt").drop("salt").mapInArrow(ask, f"chunk long, block long, {arrays[0]}")
    asked = written(asked, "nearest-left").withColumnsRenamed({c: f"l_{c}" for c in ("ids", "xs", "ys")})

    def meet(table: pa.Table) -> pa.Table:
        cell = lambda c: table[c].combine_chunks().flatten()
        i, j = nearest(*(np.asarray(cell(c)) for c in ("l_xs", "l_ys", "xs", "ys")), (ex, ey), k)
        return pa.table([cell("l_ids").take(pa.array(i)), cell("ids").take(pa.array(j)), pa.array(np.asarray(cell("xs"))[j] * sx)], names=[left_id, right_id, "value"])

    return asked.join(blocks.select("block", "ids", "xs", "ys"), "block").groupBy("chunk").applyInArrow(meet, f"`{left_id}` {kinds[0]}, `{right_id}` {kinds[1]}, value double")
