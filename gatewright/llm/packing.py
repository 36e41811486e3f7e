"""Packing token sequences by non-negative least squares on a length histogram.

A document's tokens, with its end token, give whole windows, a sequence each,
and a tail. Tails are counted by length in units of window / UNITS tokens,
rounded down. All combinations of at most DEPTH such lengths that fill a window
are enumerated; non-negative least squares finds how often to repeat each so that
the histogram is used up best; counts are rounded down and held to the tails that
exist. Tails of a combination may exceed the window by less than a unit each: the
last are cut. Cut ends, tails under a unit and what rounding left over are packed
greedily: they follow each other and are cut at each full window. The last window
is divided into powers of two, so that nothing is padded.

Only the histogram, the combinations' counts and a sum a task come to the driver:
their sizes follow UNITS, DEPTH and the number of input splits, not the rows.
Tails get their rank by (task of the written token table, place in it), so a
length that a third of all documents share is dealt like any other.

Defined results: null text is empty and gives the end token alone; rows with
null or repeated ids are packed one by one; an empty table gives no pieces. Of
the input only the id column is returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashing import slices
from .scratch import Scratch
from .tokens import encoder

UNITS = 32
DEPTH = 4


def combinations(units: int, depth: int) -> list[tuple[int, ...]]:
    """Multisets of at most depth lengths in 1 .. units - 1 that sum to units, longest first."""

    def fill(left: int, most: int, depth: int) -> Iterator[tuple[int, ...]]:
        if not left:
            yield ()
        elif depth:
            for x in range(min(left, most), 0, -1):
                for rest in fill(left - x, x, depth - 1):
                    yield (x, *rest)

    return list(fill(units, units - 1, depth))


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 3000) -> np.ndarray:
    """x >= 0 that minimises |ax - b|, by active sets."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    gram, target = a.T @ a, a.T @ b
    least = 1e-10 * max(1.0, np.abs(target).max(initial=0))
    for _ in range(rounds):
        slope = np.where(active, -np.inf, target - gram @ x)
        if not n or slope.max() <= least:
            break
        active[np.argmax(slope)] = True
        while True:
            s = np.zeros(n)
            s[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            bad = active & (s <= 0)
            if not bad.any():
                break
            ratio = np.full(n, np.inf)
            ratio[bad] = x[bad] / np.maximum(x[bad] - s[bad], 1e-300)
            x += ratio.min() * (s - x)
            active &= ~(bad & (ratio <= ratio.min()))
            x[~active] = 0
        x = s
    return x


def repeats(histogram: np.ndarray, combos: list[tuple[int, ...]]) -> np.ndarray:
    """How often to repeat each combination; no length is used more often than it occurs."""
    a = np.zeros((len(histogram), len(combos)))
    for j, combo in enumerate(combos):
        for x in combo:
            a[x, j] += 1
    scale = max(1, histogram.max(initial=0))
    x = np.floor(nnls(a[1:], histogram[1:] / scale) * scale + 1e-6).astype(np.int64)
    for i in range(1, len(histogram)):
        over = int((a[i] @ x) - histogram[i])
        for j in np.flatnonzero(a[i] * x):
            if over <= 0:
                break
            less = min(x[j], -(-over // int(a[i, j])))
            x[j] -= less
            over -= less * int(a[i, j])
    return x


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, *, end_id: int, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, units: int = UNITS, depth: int = DEPTH) -> DataFrame:
    """A row for each piece: the id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    scratch, unit = Scratch(spark, "packing"), window // units
    kind = docs.schema[id_col].dataType

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, row, full, seen = encoder(tokenizer).ids, TaskContext.get().partitionId(), 0, 0, np.zeros(units, np.int64)
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for part in slices(batch, 1, 4 << 20):
                out: dict[str, list] = {k: [] for k in ("task", "row", "n", "full", "bin", "place", "ids")}
                for text in part.column(1).to_pylist():
                    ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                    b = len(ids) % window // unit
                    for k, v in zip(out, (task, row, len(ids), full, b, seen[b], squeeze(ids.tobytes() if ids.max() >> 16 else ids.astype("<u2").tobytes())), strict=True):
                        out[k].append(v)
                    row, full, seen[b] = row + 1, full + len(ids) // window, seen[b] + 1
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in out.items())], [id_col, *out])

    stored = T.StructType([T.StructField(id_col, kind), *[T.StructField(k, T.LongType()) for k in ("task", "row", "n", "full", "bin", "place")], T.StructField("ids", T.BinaryType())])
    table = scratch.table(docs.select(id_col, text_col).mapInArrow(tokenize, stored), "tokens")

    # what comes before each task: of tails in each bin, and of whole windows
    sums = scratch.table(table.groupBy("task", "bin").agg(F.count("*").alias("tails"), F.sum(F.expr(f"n div {window}")).alias("full")), "sums")
    histogram = np.zeros(units, np.int64)
    for r in sums.groupBy("bin").agg(F.sum("tails").alias("n")).collect():
        histogram[r["bin"]] = r["n"]
    combos = combinations(units, depth)
    times = repeats(histogram, combos)
    first = np.concatenate([[0], np.cumsum(times)])
    # for each bin, ranks from `rank` on belong to a place in a combination, whose sequences begin at `sequence`
    deals: list[list[tuple[int, int, int]]] = [[] for _ in range(units)]
    dealt = np.zeros(units, np.int64)
    for combo, t, s in zip(combos, times, first, strict=False):
        for place, b in enumerate(combo if t else ()):
            deals[b].append((int(dealt[b]), int(s), place))
            dealt[b] += t
    deals = [[*d, (int(n), -1, 0)] for d, n in zip(deals, dealt, strict=True)]

    before = Window.partitionBy("bin").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ranks = sums.select("task", "bin", F.coalesce(F.sum("tails").over(before), F.lit(0)).alias("base"))
    tails = table.select("task", "row", "bin", (F.col("n") % window).alias("length"), "place").where("length > 0")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.array(d, np.int64).T for d in deals]
        for batch in batches:
            task, row, b, length, rank = (np.asarray(batch[k]) for k in ("task", "row", "bin", "length", "rank"))
            sequence, place = np.full(len(b), -1, np.int64), np.zeros(len(b), np.int64)
            for x in np.unique(b):
                at = np.flatnonzero(b == x)
                start, s, p = tables[x]
                i = np.searchsorted(start, rank[at], side="right") - 1
                mine = s[i] >= 0
                sequence[at[mine]] = (s[i] + rank[at] - start[i])[mine]
                place[at[mine]] = p[i][mine]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (task, row, length, sequence, place)], ["task", "row", "length", "sequence", "place"])

    ranked = tails.join(ranks, ["task", "bin"]).select("task", "row", "bin", "length", (F.col("base") + F.col("place")).alias("rank"))
    dealt_out = scratch.table(ranked.mapInArrow(deal, "task long, row long, length long, sequence long, place long"), "dealt")
    in_sequence = Window.partitionBy("sequence").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    fitted = dealt_out.where("sequence >= 0").withColumn("offset", F.coalesce(F.sum("length").over(in_sequence), F.lit(0)))
    fitted = fitted.withColumn("kept", F.greatest(F.lit(0), F.least(F.col("length"), window - F.col("offset"))))
    fitted = scratch.table(fitted, "fitted")
    rest = dealt_out.where("sequence < 0").select("task", "row", F.lit(0).cast("long").alias("at"), "length")
    rest = rest.unionByName(fitted.where("kept < length").select("task", "row", F.col("kept").alias("at"), (F.col("length") - F.col("kept")).alias("length")))
    in_task = Window.partitionBy("task").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    rest = scratch.table(rest.withColumn("before", F.coalesce(F.sum("length").over(in_task), F.lit(0))), "rest")
    # a row a task: in order, what the tasks before hold
    tasks = sums.groupBy("task").agg(F.sum("full").alias("full")).join(rest.groupBy("task").agg(F.sum("length").alias("rest")), "task", "left")
    in_all = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = scratch.table(tasks.select("task", *[F.coalesce(F.sum(k).over(in_all), F.lit(0)).alias(f"{k}_base") for k in ("full", "rest")]), "tasks")
    total = int(rest.agg(F.sum("length")).first()[0] or 0)
    # greedy sequences begin at multiples of the window, then at the powers of two that make up what is left
    whole, tail_starts = total // window, [total // window * window]
    for p in range(window.bit_length() - 1, -1, -1):
        if total % window >> p & 1:
            tail_starts.append(tail_starts[-1] + (1 << p))
    n_greedy, n_fitted = whole + len(tail_starts) - 1, int(first[-1])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = np.array(tail_starts, np.int64)
        for batch in batches:
            out: list[tuple] = []
            for task, row, at, length, lo in zip(*(batch[k].to_pylist() for k in ("task", "row", "at", "length", "before")), strict=True):
                hi = lo + length
                while lo < hi:
                    if lo < whole * window:
                        s, begin, end = lo // window, lo // window * window, (lo // window + 1) * window
                    else:
                        i = int(np.searchsorted(ends, lo, side="right")) - 1
                        s, begin, end = whole + i, int(ends[i]), int(ends[i + 1])
                    step = min(hi, end) - lo
                    out.append((task, row, at, step, n_fitted + s, lo - begin))
                    at, lo = at + step, lo + step
            names = ["task", "row", "at", "length", "sequence", "offset"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] or [pa.array([], pa.int64())] * 6, names)

    greedy = rest.join(tasks, "task").select("task", "row", "at", "length", (F.col("before") + F.col("rest_base")).alias("before"))
    greedy = greedy.mapInArrow(cut, "task long, row long, at long, length long, sequence long, offset long")
    pieces = fitted.where("kept > 0").select("task", "row", F.lit(0).cast("long").alias("at"), F.col("kept").alias("length"), "sequence", "offset").unionByName(greedy)
    # a document's tail lies in a few pieces: its place in a combination, and greedy ones
    plans = pieces.groupBy("task", "row").agg(F.collect_list(F.struct("at", "length", "sequence", "offset")).alias("pieces"))

    def slice_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out: list[tuple] = []
            held = 0

            def rows(out: list[tuple], batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                columns = [*zip(*out, strict=True)] or [()] * 7
                ids = batch.column(0).take(pa.array(columns[0], pa.int64()))
                return pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.binary() if k == "ids" else pa.int64()) for k, c in zip(names, columns[1:], strict=True))], [id_col, *names])

            for i, (n, blob, full, plan) in enumerate(zip(batch["n"].to_pylist(), batch["ids"], batch["sequence"].to_pylist(), batch["pieces"].to_pylist(), strict=True)):
                raw = expand(blob.as_py())
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4").tobytes()
                done = n // window * window
                for k in range(n // window):
                    out.append((i, k * window, window, ids[4 * k * window : 4 * (k + 1) * window], n, full + k, 0))
                for p in plan or ():
                    lo = done + p["at"]
                    out.append((i, lo, p["length"], ids[4 * lo : 4 * (lo + p["length"])], n, p["sequence"], p["offset"]))
                held += 4 * n
                if held > 8 << 20:
                    yield rows(out)
                    out, held = [], 0
            yield rows(out)

    based = table.select(id_col, "task", "row", "n", "ids", "full").join(plans, ["task", "row"], "left").join(tasks.select("task", "full_base"), "task")
    based = based.select(id_col, "n", "ids", (F.lit(n_fitted + n_greedy) + F.col("full_base") + F.col("full")).alias("sequence"), "pieces")
    result = T.StructType([T.StructField(id_col, kind), *[T.StructField(k, T.BinaryType() if k == "ids" else T.LongType()) for k in ("start", "length", "ids", "doc_tokens", "sequence_id", "offset")]])
    return based.mapInArrow(slice_ids, result)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    return packed_digests(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def packed_digests(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The pieces, each with a digest in place of its ids."""
    import public_tokenizers

    out = pack(spark, docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
