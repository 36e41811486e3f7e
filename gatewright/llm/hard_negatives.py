"""Hard negatives for anchors by a vertical scan of dimensions with min/max bounds.

Components are integers, floor(SCALE * x), so scores are exact. An anchor reads the
dimensions of a segment of vectors, held column by column, from its own component of
largest magnitude down. After each COLUMNS of them, what the other dimensions can still
add to a score lies between sums of their products with the segment's least and
greatest components; candidates that these bounds rule out leave the bitmap. First,
per segment of the anchor's label, all that cannot be among its best `positives`;
then, with those known, per segment of all rows, all that lie in no positive's window
[lo, hi] of scores or under the `negatives`-th score that is sure to be in it. Those left
have been read whole, so their scores are exact and the windows resolve exactly.

Rows are dealt to segments of about SEGMENT rows by a hash of their row number, and
anchors to blocks of ANCHOR_BLOCK; each segment meets each block in a group of its own.
So a label that a third of all rows have, or a vector that they share, makes more
groups and not larger ones. Every group returns a few rows an anchor, of which a
window takes the first.

Defined results: rows take no part whose label or vector is null or whose vector is
empty, has a null, NaN or infinite component, another length than most have, or a
component too large for scores of 63 bits (some 10^6 at 64 dimensions). Rows with
repeated ids are rows of their own, as candidates and as anchors; of equal scores the
lesser id counts, null last. A positive whose window is empty, such as one with a
negative score, has no rows; an empty table gives an empty result. Other input
columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch

SCALE = 256
SEGMENT, ANCHOR_BLOCK, COLUMNS = 4096, 1024, 8
LAST = np.iinfo(np.int64).max


def whole(vector: Column, scale: int) -> Column:
    """Components as integers; null where one is null, not finite or beyond 31 bits, or there is none."""
    scaled = F.transform(vector.cast("array<double>"), lambda x: F.floor(x * scale).cast("double"))
    fits = F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 2.0**31))
    given = F.forall(vector.cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when((F.size(vector) > 0) & F.coalesce(given & fits, F.lit(False)), scaled.cast("array<int>"))


class Segment:
    """Vectors column by column, with each column's least and greatest value."""

    def __init__(self, vectors: np.ndarray):
        self.columns = np.ascontiguousarray(vectors.T)
        self.low, self.high = self.columns.min(axis=1), self.columns.max(axis=1)

    def scan(self, anchor: np.ndarray, alive: np.ndarray, keep: Callable[[np.ndarray, int, int], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the candidates that stay. keep(partial, less, more): which stay, if what is left adds from less to more."""
        at = np.flatnonzero(alive)
        order = np.argsort(-np.abs(anchor), kind="stable")
        ends = anchor * self.low, anchor * self.high
        less, more = (np.r_[np.cumsum(f(*ends)[order][::-1])[::-1], 0] for f in (np.minimum, np.maximum))
        partial = np.zeros(len(at), np.int64)
        all_ = len(at) == self.columns.shape[1]
        for k, d in enumerate(order.tolist(), 1):
            column = self.columns[d]
            partial += anchor[d] * (column if all_ else column[at])
            if k % COLUMNS == 0 or k == len(order):
                stay = keep(partial, int(less[k]), int(more[k]))
                if not stay.all():
                    at, partial, all_ = at[stay], partial[stay], False
            if not len(at):
                break
        return at, partial


def kth_largest(x: np.ndarray, k: int) -> int | None:
    return int(np.partition(x, len(x) - k)[len(x) - k]) if len(x) >= k else None


def first_of(score: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((rows, ids, -score))[:k]


def highest(segment: Segment, anchor: np.ndarray, alive: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All that can be among the k best, with scores."""

    def keep(partial: np.ndarray, less: int, more: int) -> np.ndarray:
        sure = kth_largest(partial, k)
        return np.ones(len(partial), bool) if sure is None else partial + more >= sure + less

    return segment.scan(anchor, alive, keep)


def within(segment: Segment, anchor: np.ndarray, alive: np.ndarray, windows: list[tuple[int, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """All that can be among the k best of a window (lo, hi), with scores."""

    def keep(partial: np.ndarray, less: int, more: int) -> np.ndarray:
        stay = np.zeros(len(partial), bool)
        least, most = partial + less, partial + more
        for lo, hi in windows:
            sure = kth_largest(least[(least >= lo) & (most <= hi)], k)
            stay |= (most >= (lo if sure is None else max(lo, sure))) & (least <= hi)
        return stay

    return segment.scan(anchor, alive, keep)


def matrix(column: pa.ChunkedArray, d: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten()).reshape(-1, d).astype(np.int64)


def ids_of(column: pa.ChunkedArray) -> np.ndarray:
    """Ids with null as the last."""
    return np.asarray(column.fill_null(LAST))


def hard_negatives(
    spark: SparkSession,
    vectors: DataFrame,
    anchors: Column,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label: Column | None = None,
    positives: int = 5,
    negatives: int = 10,
    low_percent: int = 30,
    high_percent: int = 90,
    scale: int = SCALE,
    segment_rows: int = SEGMENT,
    anchor_rows: int = ANCHOR_BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for the rows where `anchors` holds and each of their best `positives` of the same label, the best `negatives` of other labels whose scores are from low_percent to high_percent of the positive's. label: by default the column of that name."""
    scratch = Scratch(spark, "hard_negatives")
    label = F.col("label") if label is None else label
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), whole(F.col(vector_col), scale).alias("vector"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    rows = rows.where("label IS NOT NULL AND vector IS NOT NULL")
    rows = scratch.table(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    lengths = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], result)
    d = lengths["d"]
    most = int(((2**63 - 1) // d) ** 0.5) - 1
    rows = rows.where((F.size("vector") == d) & (F.array_max(F.transform("vector", lambda x: F.abs(x.cast("long")))) <= most))
    part = lambda n: F.pmod(F.xxhash64("row"), n).cast("int")
    pieces = lambda n: F.ceil(F.count("*") / n).cast("int")

    # a table of its own, as both sides of a cogroup must be
    asking = scratch.table(rows.where("anchor").drop("anchor"), "anchors")
    rows = rows.drop("anchor")
    # each label's rows and anchors, in as many parts as they fill
    counts = asking.groupBy("label").agg(pieces(anchor_rows).alias("blocks")).join(rows.groupBy("label").agg(pieces(segment_rows).alias("segments")), "label")
    counts = scratch.table(counts, "counts")

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        """Each row in its own part of one side, copied to all parts of the other."""
        df = df.join(counts, "label").withColumn(own, part(F.col(f"{own}s")))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1))).select("label", "segment", "block", "row", "id", "vector")

    def best_positives(candidates: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if candidates.num_rows and asked.num_rows:
            segment, ids, row = Segment(matrix(candidates["vector"], d)), ids_of(candidates["id"]), np.asarray(candidates["row"])
            for a, own in zip(matrix(asked["vector"], d), asked["row"].to_pylist(), strict=True):
                at, score = highest(segment, a, row != own, positives)
                top = first_of(score, ids[at], row[at], positives)
                out += [(own, s, row[i], ids[i]) for i, s in zip(at[top].tolist(), score[top].tolist(), strict=True)]
        columns = list(zip(*out, strict=True)) or [()] * 4
        ids = pa.array([None if i == LAST else i for i in columns[3]], pa.int64())
        return pa.table([*[pa.array(c, pa.int64()) for c in columns[:3]], ids], names=["anchor", "score", "positive", "positive_id"])

    keys = ("label", "segment", "block")
    pairs = dealt(rows, "segment", "block").groupBy(*keys).cogroup(dealt(asking, "block", "segment").groupBy(*keys))
    near = pairs.applyInArrow(best_positives, "anchor long, score long, positive long, positive_id long")
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), F.asc_nulls_last("positive_id"), "positive")
    near = scratch.table(near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives), "positives")

    # windows of scores, by an anchor's positives in order
    by_anchor = near.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "score"))), lambda x: x.score).alias("scores"))
    asked = asking.join(by_anchor.withColumnRenamed("anchor", "row"), "row")
    asked = scratch.table(asked.select("row", "label", "vector", "scores"), "asked")
    segments, blocks = (max(1, -(-df.count() // n)) for df, n in ((rows, segment_rows), (asked, anchor_rows)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.select(part(F.lit(segments)).alias("segment"), every(blocks).alias("block"), "row", "id", "label", "vector")
    asked = asked.select(every(segments).alias("segment"), part(F.lit(blocks)).alias("block"), "row", "label", "vector", "scores")

    def best_negatives(candidates: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if candidates.num_rows and asked.num_rows:
            segment, ids, row, labels = Segment(matrix(candidates["vector"], d)), ids_of(candidates["id"]), np.asarray(candidates["row"]), np.asarray(candidates["label"])
            for a, own, mine, scores in zip(matrix(asked["vector"], d), asked["row"].to_pylist(), asked["label"].to_pylist(), asked["scores"].to_pylist(), strict=True):
                windows = [(-(-low_percent * s // 100), high_percent * s // 100) for s in scores]
                open_ = [(p, lo, hi) for p, (lo, hi) in enumerate(windows, 1) if lo <= hi]
                if not open_:
                    continue
                at, score = within(segment, a, labels != mine, [w[1:] for w in open_], negatives)
                for p, lo, hi in open_:
                    inside = np.flatnonzero((score >= lo) & (score <= hi))
                    top = inside[first_of(score[inside], ids[at[inside]], row[at[inside]], negatives)]
                    out += [(own, p, s, row[i], ids[i]) for i, s in zip(at[top].tolist(), score[top].tolist(), strict=True)]
        columns = list(zip(*out, strict=True)) or [()] * 5
        ids = pa.array([None if i == LAST else i for i in columns[4]], pa.int64())
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), *[pa.array(c, pa.int64()) for c in columns[2:4]], ids], names=["anchor", "place", "negative_score", "negative", "negative_id"])

    pairs = candidates.groupBy("segment", "block").cogroup(asked.groupBy("segment", "block"))
    far = pairs.applyInArrow(best_negatives, "anchor long, place int, negative_score long, negative long, negative_id long")
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"), "negative")
    far = scratch.table(far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives), "negatives")
    named = near.join(asking.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    named = named.select("anchor", "place", "anchor_id", "positive_id", F.col("score").alias("positive_score"))
    return far.join(named, ["anchor", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every embedding whose id is divisible by 100; labels of ids divisible by 7 move to the next of ten."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(spark, vectors, F.col("vec_id") % 100 == 0, label=label)
