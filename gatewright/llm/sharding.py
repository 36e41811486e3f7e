"""Shards of near equal bytes by a histogram sort.

Rows stand in the order of a 63-bit digest of their text, so equal texts are
neighbours. Shards are cut where the bytes below reach their targets: each pass counts
the exact bytes between candidate boundaries, 2^BITS of them in every interval that
holds a target, in one partial aggregate over all partitions, and the next pass looks
into those intervals only, until a boundary lies within `tolerance` of each target or
one text fills the interval. Then rows are exchanged once, to their shards.

A group of equal texts stays in one shard, unless it exceeds a fair shard. Groups over
`heavy` of a fair shard, at most shards / heavy, are placed before the sort, largest
first, each into the shard with least; targets of the sort are what these leave open.
A group that exceeds a fair shard, and so must be split, is cut at exact bytes as well,
in the order of a hash of id and row number; which of its copies go where follows
from the layout of the input, all else from contents only.

Size: UTF-8 bytes of the text, null none, plus 1. Slots count a shard's rows from 0:
rows are numbered in ranges of about SLOT_ROWS, a task each, that begin at exact
counts of those before; texts with more copies than that are cut into ranges too.
So no task numbers a whole shard, or all copies of a text. The driver holds counts of
candidate boundaries and of heavy groups only; both are bounded as said. Only
DataFrame functions are used.

Defined results: a null text is placed like an empty one; rows with null or
repeated ids, and repeated rows, are placed one by one; an empty table gives an empty
result; input columns named like the result's give way to them, all others pass
through untouched.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch

SHARDS, TOLERANCE, HEAVY = 16, 0.0005, 0.05
BITS, KEY_BITS = 12, 63
SLOT_ROWS, MOST_SPLIT = 1 << 18, 20_000
OUT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def digest(*values: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*values), 1)


def histogram(rows: DataFrame, column: str, shift: int, parents: Iterable[int] | None, wider: int) -> dict[int, tuple[int, int, int, int]]:
    """Exact bytes, rows, least and greatest value of each interval of 2^shift values, within the parents of 2^wider."""
    if parents is not None:
        rows = rows.where(F.shiftright(column, wider).isin(sorted(parents)))
    found = rows.groupBy(F.shiftright(column, shift).alias("k")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi"))
    return {r["k"]: (r["bytes"], r["n"], r["lo"], r["hi"]) for r in found.collect()}


def splitters(rows: DataFrame, column: str, targets: list[float], tolerance: float, first: dict | None = None, least: dict[int, int] | None = None) -> tuple[list[int], dict[int, tuple[int, int, int]]]:
    """For each target of bytes a value, such that the bytes of lesser values are as near to it as tolerance, or as one value's bytes, allow. And the values that a target falls into, by target's place: (value, bytes below, bytes of it). first: the histogram of the first pass, if known; least: what to leave out of it, bytes by interval."""
    found: list[int] = [0] * len(targets)
    inside: dict[int, tuple[int, int, int]] = {}
    # place of the target: interval's number, bits, bytes below it
    open_ = {i: (0, KEY_BITS, 0) for i in range(len(targets))}
    shift = KEY_BITS
    while open_:
        wider, shift = shift, max(0, shift - BITS)
        if wider == KEY_BITS and first is not None:
            counted = {k: (v[0] - (least or {}).get(k, 0), *v[1:]) for k, v in first.items()}
        else:
            counted = histogram(rows, column, shift, {k for k, _, _ in open_.values()} if wider < KEY_BITS else None, wider)
        by_parent: dict[int, list[int]] = {}
        for k in sorted(counted):
            by_parent.setdefault(k >> (wider - shift), []).append(k)
        next_ = {}
        for i, (parent, _, below) in open_.items():
            for k in by_parent.get(parent, []):
                size, _, lo, hi = counted[k]
                if below + size < targets[i] - tolerance and k != by_parent[parent][-1]:
                    below += size
                    continue
                if abs(below - targets[i]) <= tolerance:
                    found[i] = k << shift
                elif abs(below + size - targets[i]) <= tolerance or below + size < targets[i]:
                    found[i] = min((k + 1) << shift, (1 << KEY_BITS) - 1)
                elif lo == hi or shift == 0:
                    found[i] = lo if targets[i] - below <= below + size - targets[i] else lo + 1
                    inside[i] = (lo, below, size)
                else:
                    next_[i] = (k, shift, below)
                break
        open_ = next_
    return found, inside


def level(loads: list[int], more: int) -> list[float]:
    """How much each gets of `more`, so that the least loaded are filled to one level."""
    order = sorted(loads)
    filled, total = 0.0, 0
    for n, load in enumerate(order, 1):
        total += load
        filled = (more + total) / n
        if n == len(order) or filled <= order[n]:
            break
    return [max(0.0, filled - x) for x in loads]


def balanced(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", columns: list[str] | None = None, shards: int = SHARDS, tolerance: float = TOLERANCE, heavy: float = HEAVY, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """docs (only `columns`, if given) with size, text_crc32 (of UTF-8, null as empty), law (bytes), shard, slot and grown_shard (null: this law does not say where rows would go with more shards)."""
    scratch = Scratch(spark, "sharding")
    keep = [c for c in columns or docs.columns if c not in OUT]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        digest(text).alias("key"),
        digest(F.col(id_col)).alias("tie"),
        F.monotonically_increasing_id().alias("salt"),
    )
    rows = scratch.table(rows, "rows")

    first = histogram(rows, "key", KEY_BITS - BITS, None, KEY_BITS)
    total, n = sum(v[0] for v in first.values()), sum(v[1] for v in first.values())
    fair, many = total / shards, max(slot_rows, n // MOST_SPLIT)
    suspects = [k for k, v in first.items() if v[0] > heavy * fair or v[1] > many]
    groups = []
    if suspects:
        grouped = rows.where(F.shiftright("key", KEY_BITS - BITS).isin(sorted(suspects))).groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
        groups = [tuple(r) for r in grouped.where((F.col("bytes") > heavy * fair) | (F.col("n") > many)).collect()]
    giants = {k for k, size, copies in groups if size > fair and copies > 1}

    # heavy groups, largest first, to the shard with least
    loads, placed = [(0, s) for s in range(shards)], {}
    for key, size, _ in sorted(groups, key=lambda g: (-g[1], g[0])):
        if size > heavy * fair and key not in giants:
            load, s = heapq.heappop(loads)
            placed[key] = s
            heapq.heappush(loads, (load + size, s))
    taken, sizes = {}, {k: size for k, size, _ in groups}
    for key in placed:
        prefix = key >> (KEY_BITS - BITS)
        taken[prefix] = taken.get(prefix, 0) + sizes[key]
    share = level([load for load, _ in sorted(loads, key=lambda x: x[1])], total - sum(taken.values()))
    targets = [sum(share[: i + 1]) for i in range(shards - 1)]

    # a row a group that is placed, or whose rows are too many for one range; at most shards / heavy + MOST_SPLIT
    special = spark.createDataFrame([(k, placed.get(k), -(-copies // slot_rows) if copies > slot_rows else 1, k in giants) for k, _, copies in groups], "key long, placed int, pieces int, giant boolean")
    rows = rows.join(F.broadcast(special), "key", "left")
    cut = F.coalesce("giant", F.lit(False)) | (F.coalesce("pieces", F.lit(1)) > 1)
    rows = rows.withColumn("second", F.when(cut, digest("tie", "salt")).otherwise(F.col("tie")))
    sorted_ = rows.where("placed IS NULL")
    bounds, inside = splitters(sorted_, "key", targets, tolerance * fair, first, taken)
    pairs = [(k, 0) for k in bounds]
    for key in giants:
        within = [i for i, x in inside.items() if x[0] == key]
        if within:
            cuts, _ = splitters(sorted_.where(F.col("key") == key), "second", [targets[i] - inside[i][1] for i in within], tolerance * fair)
            for i, second in zip(within, cuts, strict=True):
                pairs[i] = (key, second)

    one = lambda k, s: (F.struct(F.col("key").alias("a"), F.col("second").alias("b")) >= F.struct(F.lit(k).alias("a"), F.lit(s).alias("b"))).cast("int")
    shard = sum((one(k, s) for k, s in pairs), F.lit(0))
    bits = max(0, (-(-n // slot_rows) - 1).bit_length())
    rows = rows.select(
        "row", "size", "crc", "key", "second", "salt",
        F.coalesce("placed", shard).alias("shard"),
        F.shiftright("key", KEY_BITS - bits).alias("range"),
        F.shiftright(F.shiftright("second", 32) * F.coalesce("pieces", F.lit(1)).cast("long"), 31).alias("piece"),
    )
    own = ("shard", "range", "piece")
    counts = rows.groupBy(*own).agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("range", "piece").rowsBetween(Window.unboundedPreceding, -1)
    bases = scratch.table(counts.select(*own, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases")
    at = F.row_number().over(Window.partitionBy(*own).orderBy("key", "second", "salt"))
    out = rows.join(bases, list(own)).withColumn("slot", F.col("base") + at - 1)
    return out.select("row.*", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return balanced(spark, docs, columns=["doc_id"])
