"""Jaccard join on word n-grams with Bayesian candidate pruning.

1. Each text gives the set of its n-word shingles as 64-bit hashes (a shorter text
   its whole word sequence), a digest of that set, and 128 MinHash values. Texts
   with equal sets are one class, whose representative goes on; so a group of
   copies, however large, is one row.
2. Values are banded, 32 bands of 4; at a Jaccard similarity of 0.8 a pair
   shares a band but for 5 in 10^8. Bands with one class are dropped.
3. In each band's bucket, values (a byte each) are compared 16 at a time; a pair
   is dropped as soon as the posterior probability that its similarity reaches
   the threshold, given the matches so far, is under `tolerance`. Pairs are never
   written: a bucket gives the edges of a spanning forest of what remains.
4. Within each component of these edges all pairs are pruned in the same way, and
   the rest are verified on the whole sets. Links are counted there.

A bucket or component above a block's size is cut into blocks, and each pair of
blocks is a group of its own; no task holds more than two blocks. A bucket's block is
BUCKET_BLOCK signatures, a component's GROUP_BYTES of text or GROUP_ROWS rows, so a
text is copied as often as its component has blocks of several megabytes; within a
group, pairs are made TILE by TILE rows and only those that pass the pruning are
verified. Work in a group of m different but near texts grows with its m^2 links, which are counted.

Defined results: a null or empty text has no shingles, no links, and is its own
class; a class_id is the least doc_id of the group (null ids last; the row's own
id in a group of null ids); repeated rows are copies; an empty table gives an
empty result. Input columns named class_id, rep_id, copies, n_links or keeper
give way to the result's.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hashing
from .components import components
from .given import Given
from .scratch import Scratch

HASHES, BANDS, STEP = 128, 32, 16
BUCKET_BLOCK, GROUP_ROWS, GROUP_BYTES, TILE = 1024, 2048, 4 << 20, 256
BROADCAST_ROWS = 100_000
OUT = ("class_id", "rep_id", "copies", "n_links", "keeper")

_SEEDS = hashing.mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64))
_XOR, _FACTOR = _SEEDS[:HASHES], _SEEDS[HASHES:] | np.uint64(1)


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, one after the other, and where each row begins."""
    w = hashing.words_of(column)
    grams, count = hashing.windows(w.hash, n, 9), np.diff(w.first)
    short = hashing.sequence_hash(w.hash, w.first, 9)
    sets = [np.unique(grams[a : a + c - n + 1]) if c >= n else short[i : i + 1] if c else short[:0] for i, (a, c) in enumerate(zip(w.first[:-1], count, strict=True))]
    return np.concatenate(sets) if sets else short, np.cumsum([0, *map(len, sets)])


def signatures(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of 64-bit MinHash values for each row that has shingles."""
    out = np.empty((HASHES, len(at)), np.uint64)
    for i in range(HASHES if len(at) else 0):
        np.minimum.reduceat((values ^ _XOR[i]) * _FACTOR[i], at, out=out[i])
    return hashing.mix(out.T)


@functools.lru_cache(maxsize=8)
def least_matches(threshold: float, tolerance: float) -> tuple[int, ...]:
    """For each number of values compared, the fewest matches with which a pair stays: a uniform prior, and one in 256 for a chance match of a byte."""
    j = (np.arange(4000) + 0.5) / 4000
    p = j + (1 - j) / 256
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        m = np.arange(n + 1)[:, None]
        like = m * np.log(p) + (n - m) * np.log1p(-p)
        like = np.exp(like - like.max(axis=1, keepdims=True))
        out.append(int(np.argmax(like[:, j >= threshold].sum(axis=1) / like.sum(axis=1) >= tolerance)))
    return tuple(out)


def surviving(sigs: np.ndarray, a: np.ndarray, b: np.ndarray, least: tuple[int, ...]) -> np.ndarray:
    """Which of the pairs (a, b) of rows of sigs stay."""
    alive, hits = np.arange(len(a)), np.zeros(len(a), np.int64)
    for step, fewest in enumerate(least):
        cols = slice(step * STEP, (step + 1) * STEP)
        hits = hits + (sigs[a[alive], cols] == sigs[b[alive], cols]).sum(axis=1)
        stay = hits >= fewest
        alive, hits = alive[stay], hits[stay]
        if not len(alive):
            break
    return alive


def surviving_tile(left: np.ndarray, right: np.ndarray, least: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of rows of two small arrays stay. As in surviving(), but all pairs at once as long as many are left."""
    hits, step = np.zeros((len(left), len(right)), np.int64), 0
    alive = np.ones(hits.shape, bool)
    while step < len(least) and alive.size and alive.mean() > 0.25:
        cols = slice(step * STEP, (step + 1) * STEP)
        hits += np.count_nonzero(left[:, None, cols] == right[None, :, cols], axis=2)
        alive &= hits >= least[step]
        step += 1
    a, b = np.nonzero(alive)
    hits = hits[a, b]
    for step in range(step, len(least)):
        cols = slice(step * STEP, (step + 1) * STEP)
        hits = hits + (left[a, cols] == right[b, cols]).sum(axis=1)
        stay = hits >= least[step]
        a, b, hits = a[stay], b[stay], hits[stay]
    return a, b


def forest(sigs: np.ndarray, least: tuple[int, ...]) -> list[tuple[int, int]]:
    """Edges that join rows of sigs in the components of the pairs that stay: each row reached is compared with those not yet reached."""
    left, edges = np.arange(len(sigs)), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = surviving(sigs, np.full(len(left), x), left, least)
            edges += [(x, y) for y in left[near]]
            queue += left[near].tolist()
            left = np.delete(left, near)
    return edges


def overlaps(values: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets of rows a and b."""
    n = len(at) - 1
    if len(a) <= 4 * n:
        return np.array([np.intersect1d(values[at[x] : at[x + 1]], values[at[y] : at[y + 1]], assume_unique=True).size for x, y in zip(a, b, strict=True)], np.int64)
    # many pairs: products of 0/1 columns, over shingles of two texts or more
    row = np.repeat(np.arange(n), np.diff(at))
    order = np.argsort(values, kind="stable")
    v, row = values[order], row[order]
    new = np.r_[True, v[1:] != v[:-1]]
    key = np.cumsum(new) - 1
    several = np.bincount(key)[key] > 1
    key, row = np.cumsum(new & several)[several] - 1, row[several]
    total = np.zeros((n, n), np.int64)
    keys = int(key[-1]) + 1 if len(key) else 0
    step = max(1, min(keys, (4 << 20) // max(1, n)))
    for lo in range(0, keys, step):
        i, k = np.searchsorted(key, [lo, lo + step])
        dense = np.zeros((n, step), np.float32)
        dense[row[i:k], key[i:k] - lo] = 1
        total += (dense @ dense.T).astype(np.int64)
    return total[a, b]


def _bucket_edges(threshold: float, tolerance: float):
    least = least_matches(threshold, tolerance)

    def edges(table: pa.Table) -> pa.Table:
        band, row = np.asarray(table["band"]), np.asarray(table["row"])
        sigs = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint8).reshape(-1, HASHES)
        order = np.lexsort((row, band))
        band, row, sigs = band[order], row[order], sigs[order]
        bounds = np.array(list(hashing.runs(band)))
        pairs = bounds[bounds[:, 1] - bounds[:, 0] == 2, 0]
        found = pairs[surviving(sigs, pairs, pairs + 1, least)]
        out = [np.stack([row[found], row[found + 1]], axis=1)]
        for lo, hi in bounds[bounds[:, 1] - bounds[:, 0] > 2]:
            if got := forest(sigs[lo:hi], least):
                out.append(row[lo + np.array(got)])
        out = np.unique(np.sort(np.concatenate(out), axis=1), axis=0)
        return pa.table({"a": pa.array(out[:, 0]), "b": pa.array(out[:, 1])})

    return edges


def _union(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the trees of a and b in place: root[i] is always the least row of i's tree."""
    while len(a):
        p, q = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = p != q
        a, b, p, q = a[apart], b[apart], p[apart], q[apart]
        np.minimum.at(root, q, p)
        while (root[root] != root).any():
            root[:] = root[root]


def _verified(threshold: float, tolerance: float, n: int):
    least = least_matches(threshold, tolerance)

    def links(table: pa.Table) -> pa.Table:
        group, block, row = (np.asarray(table[k]) for k in ("group", "block", "row"))
        order = np.lexsort((row, block, group))
        group, block, row = group[order], block[order], row[order]
        table = table.take(pa.array(order))
        sigs = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint8).reshape(-1, HASHES)
        texts = table["text"].combine_chunks()
        out: list[tuple[np.ndarray, ...]] = []
        for lo, hi in hashing.runs(group):
            m, split = hi - lo, np.searchsorted(block[lo:hi], block[lo], side="right")
            # within the one block, or between two
            within = split == m
            if table["blocks"][lo].as_py() > 1 and within and table["i"][lo].as_py() != table["j"][lo].as_py():
                m = 0  # the other block of this pair is empty; pairs within are another group's
            values, at = shingle_sets(texts.slice(lo, m), n)
            size, count, root = np.diff(at), np.zeros(hi - lo, np.int64), np.arange(hi - lo)
            for x in range(0, m if within else split, TILE):
                for y in range(x if within else split, m, TILE):
                    left, right = np.arange(x, min(x + TILE, m if within else split)), np.arange(y, min(y + TILE, m))
                    a, b = surviving_tile(sigs[lo + left], sigs[lo + right], least)
                    a, b = left[a], right[b]
                    if x == y:
                        a, b = a[a < b], b[a < b]
                    if not len(a):
                        continue
                    rows = left if x == y else np.concatenate([left, right])
                    both = overlaps(np.concatenate([values[at[r] : at[r + 1]] for r in rows]), np.cumsum([0, *size[rows]]), np.searchsorted(rows, a), np.searchsorted(rows, b))
                    ok = both >= threshold * (size[a] + size[b] - both) - 1e-9
                    a, b = a[ok], b[ok]
                    count += np.bincount(np.concatenate([a, b]), minlength=hi - lo)
                    _union(root, a, b)
            out.append((row[lo:hi], count, row[lo:hi][root]))
        cols = [np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True)]
        return pa.table({k: pa.array(c) for k, c in zip(("row", "links", "root"), cols, strict=True)})

    return links


def near_duplicates(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, tolerance: float = 1e-6) -> DataFrame:
    """docs with class_id (the least id of the group of documents that links connect), rep_id (the least id with the same shingle set), copies (documents with that set), n_links (other sets at the threshold or above) and keeper (true for one document of each group)."""
    scratch = Scratch(spark, "near_duplicates")
    given = Given(docs, [c for c in docs.columns if c not in OUT])
    docs, id_col, text_col = given.df, given.name(id_col), given.name(text_col)
    text_at = docs.columns.index(text_col)
    own = ["_nd_row", "_nd_d1", "_nd_d2", "_nd_n", "_nd_bands", "_nd_sig"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in hashing.slices(batch, text_at, 1 << 19):
                values, at = shingle_sets(part.column(text_at), n)
                size = np.diff(at)
                has = size > 0
                begin = at[:-1][has]
                sig = signatures(values, begin)
                bands = hashing.mix(sum(sig.reshape(len(sig), BANDS, HASHES // BANDS)[:, :, i] * _FACTOR[i] for i in range(HASHES // BANDS)) + np.arange(BANDS, dtype=np.uint64))
                digest = [np.add.reduceat(hashing.mix(values ^ s), begin).view(np.int64) if len(begin) else np.zeros(0, np.int64) for s in _SEEDS[:2]]
                spread = np.cumsum(has) - 1

                def rows(x: np.ndarray, has: np.ndarray = has, spread: np.ndarray = spread) -> list:
                    return [x[j].tobytes() if h else None for h, j in zip(has, spread, strict=True)]

                def longs(x: np.ndarray, has: np.ndarray = has) -> pa.Array:
                    full = np.zeros(len(has), np.int64)
                    full[has] = x
                    return pa.array(full, mask=~has)

                new = [pa.array(key + np.arange(part.num_rows)), longs(digest[0]), longs(digest[1]), pa.array(size.astype(np.int64)), pa.array(rows(bands), pa.binary()), pa.array(rows(sig.astype(np.uint8)), pa.binary())]
                key += part.num_rows
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, *own])

    types = {pa.int64(): T.LongType(), pa.binary(): T.BinaryType()}
    signed = scratch.table(docs.mapInArrow(sign, T.StructType([*docs.schema.fields, *[T.StructField(k, types[t]) for k, t in zip(own, kinds, strict=True)]])), "signed")
    best = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("_nd_row").alias("row"))).alias("best")
    classes = signed.where("_nd_n > 0").groupBy("_nd_d1", "_nd_d2").agg(best, F.count("*").alias("copies"), F.first("_nd_bands").alias("bands"), F.first("_nd_sig").alias("sig"))
    classes = scratch.table(classes.select("_nd_d1", "_nd_d2", "best", "copies", F.col("best.row").alias("row"), "bands", "sig"), "classes")

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.frombuffer(b"".join(batch["bands"].to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.repeat(np.asarray(batch["row"]), BANDS))], ["band", "row"])

    banded = classes.select("row", "bands").mapInArrow(band, "band long, row long")
    buckets = scratch.table(banded.groupBy("band").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    rows = int(buckets.agg(F.sum("size")).first()[0] or 0)
    members = scratch.table(banded.join(buckets, "band"), "members")
    edges = scratch.table(_in_blocks(members.join(classes.select("row", "sig"), "row"), "band", "size", BUCKET_BLOCK, max(16, rows // 50_000)).applyInArrow(_bucket_edges(threshold, tolerance), "a long, b long"), "edges")
    scratch.drop("members", "buckets")
    groups = components(scratch, edges, "groups")
    lengths = signed.select(F.col("_nd_row").alias("node"), F.octet_length(text_col).alias("bytes"))
    # in blocks' worth of rows or of text, whichever is more; in whole rows of a block
    worth = F.ceil(F.greatest(F.count("*"), F.sum("bytes") / F.lit(GROUP_BYTES) * GROUP_ROWS)).cast("long")
    sizes = scratch.table(groups.join(lengths, "node").groupBy("root").agg(worth.alias("size")), "sizes")
    grouped = scratch.table(groups.join(sizes, "root").select(F.col("node").alias("_nd_row"), F.col("root").alias("group"), "size"), "grouped")
    most, worth = sizes.agg(F.max("size"), F.coalesce(F.sum("size"), F.lit(0))).first()
    count = grouped.count()
    texts = signed.select("_nd_row", F.col(text_col).alias("text"), F.col("_nd_sig").alias("sig")).join(F.broadcast(grouped) if count <= BROADCAST_ROWS else grouped, "_nd_row").withColumnRenamed("_nd_row", "row")
    links = scratch.table(_in_blocks(texts, "group", "size", GROUP_ROWS, max(16, count // 400, worth // GROUP_ROWS)).applyInArrow(_verified(threshold, tolerance, n), "row long, links long, root long"), "links")
    scratch.drop("sizes", "grouped", "groups", "edges")
    if (most or 0) > GROUP_ROWS:
        roots = components(scratch, links.select(F.col("row").alias("a"), F.col("root").alias("b")), "roots")
    else:
        roots = links.select(F.col("row").alias("node"), "root")  # each component was seen whole, so its roots are final
    linked = scratch.table(links.groupBy("row").agg(F.sum("links").alias("n_links")), "linked").join(roots.withColumnRenamed("node", "row"), "row", "left")
    classes = scratch.table(classes.select("_nd_d1", "_nd_d2", "row", "best", "copies").join(linked, "row", "left").withColumn("root", F.coalesce("root", "row")), "joined")
    tops = scratch.table(classes.groupBy("root").agg(F.min("best").alias("top")), "tops")
    classes = scratch.table(classes.join(tops, "root").select("_nd_d1", "_nd_d2", F.col("top.id").alias("class_id"), F.col("top.row").alias("_nd_top"), F.col("best.id").alias("rep_id"), "copies", F.coalesce("n_links", F.lit(0)).alias("n_links")), "final")
    out = signed.select(*docs.columns, "_nd_row", "_nd_d1", "_nd_d2").join(classes, ["_nd_d1", "_nd_d2"], "left")
    ids = [F.coalesce(c, id_col).alias(c) for c in ("class_id", "rep_id")]
    keeper = F.coalesce(F.col("_nd_top") == F.col("_nd_row"), F.lit(True)).alias("keeper")
    return out.select(*given.back(), *ids, F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"), keeper)


def _in_blocks(df: DataFrame, key: str, size: str, block: int, groups: int):
    """df grouped so that keys of up to `block` rows share `groups` groups, and a larger key has one for each pair of its blocks."""
    blocks = F.ceil(F.col(size) / block)
    own = F.when(blocks > 1, F.pmod(F.xxhash64("row"), blocks)).otherwise(0).cast("int").alias("block")
    df = df.select("*", blocks.cast("int").alias("blocks"), own)
    places = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.col(key).alias("place"), F.least("block", x).alias("i"), F.greatest("block", x).alias("j")))
    shared = F.array(F.struct(F.pmod(F.xxhash64(key), F.lit(groups)).cast("long").alias("place"), F.lit(-1).alias("i"), F.lit(-1).alias("j")))
    return df.select("*", F.explode(F.when(F.col("blocks") > 1, places).otherwise(shared)).alias("at")).select("*", "at.place", "at.i", "at.j").drop("at").groupBy("place", "i", "j")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with word 5-gram similarity 0.8 or more: class, copies and links of each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(spark, docs).select("doc_id", "class_id", "rep_id", "copies", "n_links")
