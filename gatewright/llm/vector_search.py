"""Nearest neighbours by cosine, with an adaptive dimension scan of probed lists.

Unit vectors are divided into lists by the nearest of about sqrt(rows) centroids,
fitted on a bounded sample; every row is indexed. A query first searches the list
whose centroid is nearest; the k-th score found there bounds the rest of its search.
Then it probes lists by what they are expected to hold: in a list, similarities to
a query spread like a normal variable whose mean follows from the centroid and whose
deviation from the spread of the list; the score that only k rows should exceed
follows from all lists, and lists are taken, best first, until fewer than `miss` of
the k neighbours are expected in those left. Lists that by the triangle inequality
hold nothing above the bound are left out with certainty. So clustered vectors probe
few lists and shapeless ones many, by the same rule at every size.

In a list, vectors are rotated by a seeded orthogonal matrix and scanned in column
blocks: after each block, a candidate whose partial squared distance is too large
for its share of the dimensions, by a hypothesis test against the distance of the
k-th best so far, is abandoned. What remains is scored exactly, in double precision
on the original vectors.

Lists are cut into segments of SEGMENT rows and their queries into blocks of
QUERY_BLOCK, and each pair is a group; so a vector that a third of the rows share
makes more groups, not larger ones. Bounds: the sample is SAMPLE_VALUES numbers,
lists are a quarter of its rows at most, and only these and a few numbers a list come to the driver.

Defined results: vectors null, empty or zero, vectors with null, NaN or infinite
components, and those of another length than most have, take no part. Of equal
scores the smaller vec_id is nearer; rows that share a vec_id are rows of their
own, each query's own row alone is left out. Rows with a null id are candidates,
farther than others of their score. With fewer than k candidates all are
returned; an empty table gives an empty result. Other input columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch

SAMPLE_VALUES = 2 << 20
SEGMENT, QUERY_BLOCK, COLUMNS = 2048, 512, 8
#: Under this share of candidates left, they are followed one by one.
SPARSE = 0.1
MISS = 0.02
TEST = 2.4


def usable(vector: Column) -> Column:
    """No null, NaN or infinite component, and one that is not 0."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def centroids_of(x: np.ndarray, lists: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means of unit vectors."""
    rng = np.random.default_rng(seed)
    c = np.unique(x, axis=0)
    c = c[rng.permutation(len(c))[:lists]]
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.maximum(norm, 1e-300), c)
    return c


def rotation(d: int, seed: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))[0]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact cosines of rows with rows, each summed alike wherever the rows stand."""
    q, x = (v / np.abs(v).max(axis=1, keepdims=True) for v in (q, x))
    return (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum(axis=1)))


def scan(rq: np.ndarray, rx: np.ndarray, own: np.ndarray, limit: np.ndarray, k: int, columns: int, test: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) that are not abandoned. rq, rx: rotated at length 1; own: pairs to leave out; limit: squared distance that a query's candidates may have."""
    d, few = rq.shape[1], min(4 * k, len(rx))
    # the k-th best of the first candidates
    first = np.where(own[:, :few], -np.inf, rq @ rx[:few].T)
    kth = np.sort(first, axis=1)[:, -k] if few >= k else np.full(len(rq), -np.inf)
    limit = np.minimum(limit, 2 - 2 * kth + 1e-12)
    bound = lambda to: limit * ((to / d) * (1 + test / to**0.5) ** 2 if to < d else 1) + 1e-9
    alive, partial, at = ~own, np.zeros(own.shape), 0
    while at < d and alive.mean() > SPARSE:
        to = min(at + columns, d)
        a, b = rq[:, at:to], rx[:, at:to]
        partial += (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)
        # for distances of more dimensions than seen, what is seen is a sample: abandoned if far above its share
        alive &= partial <= bound(to)[:, None]
        at = to
    i, j = np.nonzero(alive)
    partial = partial[i, j]
    while at < d and len(i):
        to = min(at + columns, d)
        partial += ((rx[j, at:to] - rq[i, at:to]) ** 2).sum(axis=1)
        stay = partial <= bound(to)[i]
        i, j, partial, at = i[stay], j[stay], partial[stay], to
    return i, j


def best(i: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best pairs of each query i, by score, then id."""
    order = np.lexsort((ids, -score, i))
    place = np.arange(len(order)) - np.searchsorted(i[order], i[order])
    return order[place < k]


def above(z: np.ndarray) -> np.ndarray:
    """Share of a normal variable above z; to 2 parts in 10^7."""
    t = 1 / (1 + 0.2316419 * np.abs(z))
    tail = np.exp(-z * z / 2) / np.sqrt(2 * np.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(z >= 0, tail, 1 - tail)


class Lists:
    """What is known of the lists: centroids (unit), rows, mean and variance of the members' cosines with the centroid and the least of them; and over how many dimensions the rest of a vector spreads."""

    def __init__(self, centers: np.ndarray, rows: np.ndarray, mean: np.ndarray, variance: np.ndarray, least: np.ndarray, spread: float):
        self.centers, self.rows, self.mean, self.variance, self.least, self.spread = centers, rows, mean, np.maximum(variance, 0), least, spread

    def probes(self, q: np.ndarray, found: np.ndarray, k: int, miss: float) -> list[np.ndarray]:
        """Lists for each query (unit rows) beyond its nearest, best first. found: its k-th score so far, or -1."""
        b = np.clip(q @ self.centers.T, -1, 1)
        nearest = np.argmax(b, axis=1)
        mean = b * self.mean
        deviation = np.sqrt(b * b * self.variance + np.maximum(0, (1 - b * b) * (1 - self.mean**2)) / self.spread) + 1e-6
        # the score that k rows are expected to exceed, by halving
        lo, hi = np.full(len(q), -1.0), np.ones(len(q))
        for _ in range(16):
            mid = (lo + hi) / 2
            more = (above((mid[:, None] - mean) / deviation) * self.rows).sum(axis=1) > k
            lo, hi = np.where(more, mid, lo), np.where(more, hi, mid)
        share = above((np.maximum(found, lo)[:, None] - mean) / deviation)
        # no member is nearer to q than the angle to the centroid less the list's widest
        angle = np.arccos(b) - np.arccos(np.clip(self.least, -1, 1))
        possible = (np.cos(np.maximum(angle, 0)) >= found[:, None] - 1e-9) & (self.rows > 0)
        out = []
        for i in range(len(q)):
            share[i, nearest[i]] = 2
            order = np.argsort(-share[i], kind="stable")
            order = order[possible[i, order] | (order == nearest[i])]
            expected = np.where(order == nearest[i], 0, share[i, order] * self.rows[order])
            left = expected.sum() - np.cumsum(expected)
            # at least k candidates beside the query's own row
            enough = (left < miss * k) & (np.cumsum(self.rows[order]) > k)
            out.append(order[1 : int(np.argmax(enough)) + 1 if enough.any() and miss > 0 else len(order)])
        return out


def nearest(spark: SparkSession, vectors: DataFrame, queries: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, miss: float = MISS, columns: int = COLUMNS, test: float = TEST, seed: int = 11) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows where `queries` holds, against all other rows. miss: share of the neighbours that lists left out may be expected to hold; 0 leaves out only what the triangle inequality allows."""
    scratch = Scratch(spark, "vector_search")
    # single precision is kept as it is, so that half as much is moved
    kind = np.float32 if isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType) else np.float64
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(queries, F.lit(False)).alias("query")).where(usable(F.col("vector")))
    rows = scratch.table(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    lengths = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    found = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return spark.createDataFrame([], found)
    d, n = lengths["d"], lengths["count"]
    rows = rows.where(F.size("vector") == d)
    sample = rows.orderBy(F.xxhash64(F.lit(seed), "row")).limit(max(4, SAMPLE_VALUES // d)).select("vector").toPandas()
    sample = unit(np.stack(sample["vector"].to_numpy()))
    centers = centroids_of(sample, min(-(-len(sample) // 4), int(np.ceil(n**0.5))), seed)
    centers = unit(centers)
    rest = sample - (sample @ centers.T).max(axis=1)[:, None] * centers[np.argmax(sample @ centers.T, axis=1)]
    cov = rest.T @ rest
    spread = float(max(1.0, np.trace(cov) ** 2 / max((cov * cov).sum(), 1e-300)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = np.asarray(part["vector"].flatten()).reshape(-1, d)
                b = unit(x) @ centers.T
                near = np.argmax(b, axis=1)
                yield pa.RecordBatch.from_arrays([*(part[c] for c in ("id", "row", "query")), pa.array(near.astype(np.int32)), pa.array(b[np.arange(len(x)), near]), pa.array([v.tobytes() for v in x.astype(kind)], pa.binary())], ["id", "row", "query", "list", "cosine", "vector"])

    indexed = scratch.table(rows.mapInArrow(assign, "id long, row long, query boolean, list int, cosine double, vector binary"), "indexed")
    numbers = np.zeros((4, len(centers)))
    numbers[3] = 1
    for r in indexed.groupBy("list").agg(F.count("*").alias("n"), F.avg("cosine").alias("mean"), F.var_pop("cosine").alias("variance"), F.min("cosine").alias("least")).collect():
        numbers[:, r["list"]] = r["n"], r["mean"], r["variance"], r["least"]
    lists = Lists(centers, *numbers, spread)
    read = lambda column: np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, d).astype(np.float64)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                probes = lists.probes(unit(read(part["vector"])), np.asarray(part["bound"]), k, miss)
                take = pa.array(np.repeat(np.arange(len(probes)), [len(p) for p in probes]))
                yield pa.RecordBatch.from_arrays([*(part[c].take(take) for c in ("id", "row", "vector", "bound")), pa.array(np.concatenate(probes).astype(np.int32))], ["id", "row", "vector", "bound", "list"])

    def search(candidates: pa.Table, asked: pa.Table) -> pa.Table:
        out = [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64())]
        if candidates.num_rows and asked.num_rows:
            turn = rotation(d, seed)
            x, q = read(candidates["vector"]), read(asked["vector"])
            own = np.asarray(asked["row"])[:, None] == np.asarray(candidates["row"])
            i, j = scan(unit(q) @ turn, unit(x) @ turn, own, 2 - 2 * np.asarray(asked["bound"]), k, columns, test)
            score, ids = cosines(q[i], x[j]) if len(i) else np.zeros(0), np.asarray(candidates["id"].fill_null(np.iinfo(np.int64).max))[j]
            top = best(i, score, ids, k)
            i, j = pa.array(i[top]), pa.array(j[top])
            out = [asked["row"].take(i), asked["id"].take(i), candidates["id"].take(j), pa.array(score[top])]
        return pa.table(out, names=["row", "query_id", "vec_id", "score"])

    def searched(asked: DataFrame, name: str) -> DataFrame:
        asked = scratch.table(asked, f"asked-{name}")
        # a row a list: how many segments its vectors and blocks its queries make
        segments = indexed.groupBy("list").agg(F.ceil(F.count("*") / SEGMENT).cast("int").alias("segments"))
        counts = scratch.table(segments.join(asked.groupBy("list").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks")), "list"), f"counts-{name}")

        def dealt(df: DataFrame, own: str, other: str, *more: str) -> DataFrame:
            """Each row in its own part of one side, copied to all parts of the other."""
            df = df.join(F.broadcast(counts), "list").withColumn(own, F.pmod(F.xxhash64("row"), F.col(f"{own}s")).cast("int"))
            return df.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1))).select("list", "segment", "block", "id", "row", "vector", *more)

        keys = ("list", "segment", "block")
        pairs = dealt(indexed, "segment", "block").groupBy(*keys).cogroup(dealt(asked, "block", "segment", "bound").groupBy(*keys))
        near = pairs.applyInArrow(search, "row long, query_id long, vec_id long, score double")
        nearest_first = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
        return scratch.table(near.withColumn("rank", F.row_number().over(nearest_first)).where(F.col("rank") <= k), f"found-{name}")

    asked = indexed.where("query").select("id", "row", "vector", F.lit(-1.0).alias("bound"), "list")
    first = searched(asked, "first")
    bound = first.where(F.col("rank") == k).select("row", F.col("score").alias("bound"))
    asked = indexed.where("query").select("id", "row", "vector").join(bound, "row", "left").select("id", "row", "vector", F.coalesce("bound", F.lit(-1.0)).alias("bound"))
    then = searched(asked.mapInArrow(probe, "id long, row long, vector binary, bound double, list int"), "then")
    nearest_first = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    both = first.unionByName(then).withColumn("rank", F.row_number().over(nearest_first)).where(F.col("rank") <= k)
    return both.select("query_id", "rank", "vec_id", "score")


def op8_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of all other embeddings to each whose id is divisible by 50."""
    return nearest(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
