"""Substring dedup by relative Lempel-Ziv parsing.

The reference of a document is every document with a smaller id, indexed in
blocks of `window` words; a block's source is the least (id, word) where it starts.
Parsing is greedy. A match goes on, word by word, while the block at the next word
has the same source document and its next word there; so all words of a match are
those of the source from one word on. A factor begins at the first block that has
a source and is its match; at its end, matches that begin in it or right behind it
are checked, so blocks that reach over the boundary are not lost, and the one that
reaches farthest is the next factor. Factors have `window` words or more; the union
of their spans is removed.

The index is never gathered on one machine. The least 5-word hash in a block is
its anchor, and equal blocks have equal anchors, about one for every five words.
1. Anchors of each chunk are dealt out by hash; those in two documents or more,
   by chunk or inside one, go back to the chunks that hold them.
2. Chunks deal out hashes of the blocks with such anchors, with the least source
   in the chunk; a chunk gets back the blocks that have a smaller id elsewhere.
3. Chunks are parsed. Whole copies of a document with a smaller id are known from
   step 1 by a 128-bit hash of all their words; each is one factor and takes no part in step 2.
Per block and chunk one entry travels, however many documents hold the block.
Above GROUP_CHUNKS chunks, entries are first merged within groups of so many, and
answers come back the same way, so that a block that every chunk holds is one entry a group.

Words have 64-bit hashes; blocks are told apart by 96 bits and whole texts by 128
bits made of them; what comes back names a block by 64 bits within its chunk.

Defined results. Null text is empty: no words, nothing removed, kept text "".
A document with a null id is kept whole and is no reference. Documents with equal
ids are no references for each other; where they are a source, its word may be in either. Ids must be integers; others
are refused. An empty table gives an empty result. Columns of the input named
n_words, n_removed, kept_text or spans give way to those of the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hashing
from .chunks import CHUNK_BYTES, chunked, slots_for, unpack
from .scratch import Scratch

WINDOW = 13
ANCHOR = 5
SLOT_BYTES = 8 << 20
GROUP_CHUNKS = 4096
OUT = ("n_words", "n_removed", "spans", "kept_text")
_NEVER = np.iinfo(np.int64).max
_MESSAGE = "slot int, chunk long, kind int, blob binary"
#: Entries by kind, sent and back: 0 anchors, 1 whole texts, 2 blocks.
_SENT = (("<u8",), ("<u8", "<u8", "<i8"), ("<u8", "<u4", "<i8", "<u4"))
_BACK = (("<u8",), ("<u8", "<i8"), ("<u8", "<i8", "<u4"))


class _Chunk:
    """Words and blocks of one chunk."""

    def __init__(self, blob: bytes, id_at: int, text_at: int, window: int):
        self.batch = unpack(blob)
        self.words = hashing.words_of(self.batch.column(text_at))
        first, ids = self.words.first, self.batch.column(id_at)
        self.n = np.diff(first)
        self.known = np.asarray(ids.is_valid())
        self.ids = np.asarray(ids.cast(pa.int64()).fill_null(0))
        h = self.words.hash
        k = min(ANCHOR, window)
        self.count = max(0, len(h) - window + 1)
        self.row = np.repeat(np.arange(len(self.n)), self.n)[: self.count]
        self.ok = hashing.whole(first, window, self.count) & self.known[self.row]
        # mixed, as minima are small and would crowd the first slots
        self.anchor = hashing.mix(hashing.rolling(np.minimum, hashing.windows(h, k, 3), window - k + 1)) if self.count else np.zeros(0, np.uint64)
        self.window = window
        self.long = self.known & (self.n >= window)
        self.digest = [hashing.sequence_hash(h, first, s) for s in (1, 2)]

    def blocks(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash, further bits, id and word in the document of the blocks at `which`."""
        x, y = (hashing.windows(self.words.hash, self.window, s)[which] for s in (5, 6))
        row = self.row[which]
        return x, (y >> np.uint64(32)).astype(np.uint32), self.ids[row], (which - self.words.first[:-1][row]).astype(np.uint32)

    def copies(self, found: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Rows that are whole copies of a document with a smaller id, here or, by the sorted digests found, elsewhere."""
        dead = np.zeros(len(self.n), bool)
        rows = np.flatnonzero(self.long)
        if len(rows):
            d, e = self.digest[0][rows], self.digest[1][rows]
            order, new, low, _ = _least(d, e, self.ids[rows])
            own = np.empty(len(rows), np.int64)
            own[order] = low[np.cumsum(new) - 1]
            own = np.minimum(own, hashing.lookup(d, found, least, _NEVER))
            dead[rows] = own < self.ids[rows]
        return dead


def _least(a: np.ndarray, b: np.ndarray, ids: np.ndarray, words: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """An order by (a, b), where a new pair begins in it, and the least id of each pair with the least word there."""
    order = np.lexsort((b, a))
    x, y = a[order], b[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    words = np.zeros(len(x), np.uint32) if words is None else words[order]
    if not len(x):
        return order, new, np.zeros(0, np.int64), words
    begin, ids = np.flatnonzero(new), ids[order]
    low = np.minimum.reduceat(ids, begin)
    here = ids == low[np.cumsum(new) - 1]
    return order, new, low, np.minimum.reduceat(np.where(here, words, np.uint32(2**32 - 1)), begin)


def _send(slots: int, chunk: int, kind: int, *columns: np.ndarray) -> Iterator[dict]:
    """Columns sorted by the first, a hash, cut by slot; each goes whole, one after the other."""
    slot = hashing.slot_of(columns[0], slots)
    for lo, hi in hashing.runs(slot):
        yield {"slot": int(slot[lo]), "chunk": chunk, "kind": kind, "blob": _blob(kind, _SENT, [c[lo:hi] for c in columns])}


def _blob(kind: int, types: tuple, columns: list[np.ndarray]) -> bytes:
    return b"".join(c.astype(t, copy=False).tobytes() for t, c in zip(types[kind], columns, strict=True))


def _gather(table: pa.Table | None, kind: int, types: tuple) -> tuple[np.ndarray, list[np.ndarray]]:
    """All entries of a kind: the index of the sending row for each, and the columns."""
    kinds = [np.dtype(t) for t in types[kind]]
    rows, parts = [], []
    for i, (k, blob) in enumerate(zip(table["kind"].to_pylist(), table["blob"], strict=True)) if table is not None else ():
        if k == kind:
            blob = blob.as_py()
            n, at, columns = len(blob) // sum(t.itemsize for t in kinds), 0, []
            for t in kinds:
                columns.append(np.frombuffer(blob, t, n, at))
                at += n * t.itemsize
            rows.append(np.full(n, i))
            parts.append(columns)
    if not rows:
        return np.zeros(0, np.int64), [np.zeros(0, t) for t in kinds]
    return np.concatenate(rows), [np.concatenate(c) for c in zip(*parts, strict=True)]


def _rows(rows: list[dict]) -> pa.Table:
    kinds = {"slot": pa.int32(), "chunk": pa.int64(), "kind": pa.int32(), "blob": pa.binary()}
    return pa.table({n: pa.array([r[n] for r in rows], t) for n, t in kinds.items()})


def merge(table: pa.Table, told: pa.Table | None = None, up: bool = False) -> pa.Table:
    """What a slot learns from the entries of its senders. up: the entries merged, as one sender's, named by the group; else answers to each sender, with what the group was told from elsewhere."""
    if not table.num_rows:
        return _rows([])
    slot, chunk, out = table["slot"][0].as_py(), table["chunk"].to_pylist(), []
    group = table["group"][0].as_py() if up else 0

    def back(kind: int, source: np.ndarray, *columns: np.ndarray) -> None:
        order = np.argsort(source, kind="stable")
        source, columns = source[order], [c[order] for c in columns]
        for lo, hi in hashing.runs(source):
            out.append({"slot": slot, "chunk": chunk[source[lo]], "kind": kind, "blob": _blob(kind, _BACK, [c[lo:hi] for c in columns])})

    source, (a,) = _gather(table, 0, _SENT)
    if len(a):
        # the lowest bit says that several documents of the sender have the anchor
        order = np.argsort(a)
        a, source = a[order], source[order]
        begin = np.flatnonzero(np.r_[True, a[1:] >> np.uint64(1) != a[:-1] >> np.uint64(1)])
        size = np.diff(np.r_[begin, len(a)])
        several = (size > 1) | (np.bitwise_or.reduceat(a, begin) & np.uint64(1) == 1)
        if up:
            out.append({"slot": slot, "chunk": group, "kind": 0, "blob": _blob(0, _SENT, [a[begin] & ~np.uint64(1) | several])})
        else:
            if told is not None:
                several = hashing.member(a[begin] >> np.uint64(1), np.sort(_gather(told, 0, _BACK)[1][0]))
            common = np.repeat(several, size)
            back(0, source[common], a[common] >> np.uint64(1))
    for kind in (1, 2):
        source, (x, y, ids, *words) = _gather(table, kind, _SENT)
        if not len(x):
            continue
        order, new, low, word = _least(x, y, ids, *words)
        pick = order[new]
        if up:
            out.append({"slot": slot, "chunk": group, "kind": kind, "blob": _blob(kind, _SENT, [x[pick], y[pick], low, word][: len(_SENT[kind])])})
            continue
        if told is not None:
            keys, far, *far_words = _gather(told, kind, _BACK)[1]
            sort = np.argsort(keys)
            less = hashing.lookup(x[pick], keys[sort], far[sort], _NEVER)
            word = np.where(less < low, hashing.lookup(x[pick], keys[sort], far_words[0][sort], 0), word) if far_words else word
            low = np.minimum(low, less)
        each = np.cumsum(new) - 1
        late = low[each] < ids[order]
        back(kind, source[order][late], *[x[order][late], low[each][late], word[each][late]][: len(_BACK[kind])])
    return _rows(out)


def farthest(start: np.ndarray, end: np.ndarray, row: np.ndarray) -> list[int]:
    """Which matches, ascending by start, are the factors: the first of each run of matches that touch, then always the one that begins by the end of the last factor and reaches farthest."""
    out, i, n = [], 0, len(start)
    first, last, rows = start.tolist(), end.tolist(), row.tolist()
    while i < n:
        out.append(i)
        at, j = i, i + 1
        while True:
            best = -1
            while j < n and rows[j] == rows[at] and first[j] <= last[at]:
                if last[j] > last[at] and (best < 0 or last[j] > last[best]):
                    best = j
                j += 1
            if best < 0:
                break
            out.append(best)
            at = best
        i = j
    return out


def substring_dedup(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES, slot_bytes: int = SLOT_BYTES, group_chunks: int = GROUP_CHUNKS) -> DataFrame:
    """All columns of docs, with n_words, n_removed, spans (array of start, length, source and source_start: the factors, in words) and kept_text."""
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be an integer column")
    scratch = Scratch(spark, "substring_dedup")
    docs = docs.select(*[c for c in docs.columns if c not in OUT])
    id_at, text_at = docs.columns.index(id_col), docs.columns.index(text_col)
    chunks = chunked(scratch, docs, text_col, "chunks", chunk_bytes)
    slots = slots_for(chunks, slot_bytes)
    groups = -(-chunks.count() // group_chunks)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch["chunk"].to_pylist(), batch["blob"], strict=True):
                c = _Chunk(blob.as_py(), id_at, text_at, window)
                at = np.flatnonzero(c.ok)
                a, row = c.anchor[at], c.row[at]
                if len(a):
                    new = np.ones(len(a), bool)
                    new[1:] = (a[1:] != a[:-1]) | (row[1:] != row[:-1])
                    a, row = a[new], row[new]
                    order = np.argsort(a, kind="stable")
                    a, ids = a[order], c.ids[row[order]]
                    begin = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
                    several = np.minimum.reduceat(ids, begin) != np.maximum.reduceat(ids, begin)
                    a = a[begin] & ~np.uint64(1) | several
                rows = np.flatnonzero(c.long)
                order, new, low, _ = _least(c.digest[0][rows], c.digest[1][rows], c.ids[rows])
                pick = rows[order][new]
                out = [*_send(slots, chunk, 0, a), *_send(slots, chunk, 1, c.digest[0][pick], c.digest[1][pick], low)]
                yield from _rows(out).to_batches()

    def answered(sent: DataFrame, name: str) -> DataFrame:
        """Answers to chunks for what they sent to slots, as a written table."""
        if groups <= 1:
            return scratch.table(sent.groupBy("slot").applyInArrow(lambda t: merge(t), _MESSAGE), name)
        sent = scratch.table(sent.withColumn("group", F.pmod(F.xxhash64("chunk"), F.lit(groups)).cast("long")), f"{name}-sent")
        whole = sent.groupBy("slot", "group").applyInArrow(lambda t: merge(t, up=True), _MESSAGE).groupBy("slot").applyInArrow(lambda t: merge(t), _MESSAGE)
        whole = whole.withColumnRenamed("chunk", "group").groupBy("slot", "group")
        out = scratch.table(sent.groupBy("slot", "group").cogroup(whole).applyInArrow(lambda t, told: merge(t, told), _MESSAGE), name)
        scratch.drop(f"{name}-sent")
        return out

    def _dead(c: _Chunk, told: pa.Table) -> np.ndarray:
        _, (d, low) = _gather(told, 1, _BACK)
        order = np.argsort(d)
        return c.copies(d[order], low[order])

    def blocks(table: pa.Table, told: pa.Table) -> pa.Table:
        out: list[dict] = []
        _, (a,) = _gather(told, 0, _BACK)
        if table.num_rows and len(a):
            c = _Chunk(table["blob"][0].as_py(), id_at, text_at, window)
            at = np.flatnonzero(c.ok & hashing.member(c.anchor >> np.uint64(1), np.sort(a)) & ~_dead(c, told)[c.row])
            x, y, ids, words = c.blocks(at)
            order, new, low, word = _least(x, y, ids, words)
            pick = order[new]
            out += _send(slots, table["chunk"][0].as_py(), 2, x[pick], y[pick], low, word)
        return _rows(out)

    kept = pa.schema([("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("source", pa.int64()), ("source_start", pa.int64())]))), ("kept_text", pa.string())])

    def parse(table: pa.Table, told: pa.Table) -> pa.Table:
        c = _Chunk(table["blob"][0].as_py(), id_at, text_at, window)
        dead = _dead(c, told)
        at = np.flatnonzero(c.ok)
        x, y, ids, words = c.blocks(at)
        order, new, low, word = _least(x, y, ids, words)
        least, where = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        least[order], where[order] = low[np.cumsum(new) - 1], word[np.cumsum(new) - 1]
        _, (keys, far, far_word) = _gather(told, 2, _BACK)
        sort = np.argsort(keys)
        less = hashing.lookup(x, keys[sort], far[sort], _NEVER)
        where = np.where(less < least, hashing.lookup(x, keys[sort], far_word[sort].astype(np.int64), 0), where)
        least = np.minimum(least, less)
        hit = (least < ids) & ~dead[c.row[at]]
        at, least, where = at[hit], least[hit], where[hit]
        begin = np.ones(len(at), bool)
        begin[1:] = (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1]) | (where[1:] != where[:-1] + 1) | (c.row[at[1:]] != c.row[at[:-1]])
        begin = np.flatnonzero(begin)
        start, end = at[begin], at[np.r_[begin, len(at)][1:] - 1] + window
        taken = np.array(farthest(start, end, c.row[start]), np.int64)
        start, end, source, word = start[taken], end[taken], least[begin][taken], where[begin][taken]
        cover = np.zeros(len(c.words.hash) + 1, np.int32)
        np.add.at(cover, start, 1)
        np.add.at(cover, end, -1)
        gone = np.cumsum(cover)[:-1] > 0
        gone |= np.repeat(dead, c.n)
        first, buf = c.words.first, c.words.buf
        _, offsets = hashing.utf8(c.batch.column(text_at))
        removed = np.diff(np.r_[0, np.cumsum(gone)][first])
        texts = []
        for i in range(c.batch.num_rows):
            words = buf[offsets[i] : offsets[i + 1]].tobytes().split()
            texts.append(b" ".join(words if not removed[i] else compress(words, ~gone[first[i] : first[i + 1]])))
        row = c.row[start] if len(start) else np.zeros(0, np.int64)
        rows, starts, lengths, ids, words = [row], [start - first[:-1][row]], [end - start], [source], [word]
        whole = np.flatnonzero(dead)
        if len(whole):
            _, (d, least_id) = _gather(told, 1, _BACK)
            sort = np.argsort(d)
            near = _own_least(c, whole)
            far = hashing.lookup(c.digest[0][whole], d[sort], least_id[sort], _NEVER)
            none = np.zeros(len(whole), np.int64)
            rows, starts, lengths, ids, words = [*rows, whole], [*starts, none], [*lengths, c.n[whole]], [*ids, np.minimum(near, far)], [*words, none]
        rows = np.concatenate(rows)
        order = np.argsort(rows, kind="stable")
        offsets = np.searchsorted(rows[order], np.arange(c.batch.num_rows + 1))
        factors = pa.StructArray.from_arrays([pa.array(np.concatenate(v)[order].astype(np.int64)) for v in (starts, lengths, ids, words)], ["start", "length", "source", "source_start"])
        return pa.table([*c.batch.columns, pa.array(c.n.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), factors), pa.array(texts, pa.binary()).cast(pa.string())], names=[*c.batch.schema.names, *kept.names])

    def _own_least(c: _Chunk, rows: np.ndarray) -> np.ndarray:
        long = np.flatnonzero(c.long)
        order, new, low, _ = _least(c.digest[0][long], c.digest[1][long], c.ids[long])
        out = np.empty(len(c.n), np.int64)
        out[long[order]] = low[np.cumsum(new) - 1]
        return out[rows]

    told = answered(chunks.select("chunk", "blob").mapInArrow(anchors, _MESSAGE), "shared")
    by_chunk = chunks.select("chunk", "blob").groupBy("chunk")
    found = answered(by_chunk.cogroup(told.groupBy("chunk")).applyInArrow(blocks, _MESSAGE), "sources")
    result = T.StructType([*docs.schema.fields, *[T.StructField(n, t) for n, t in (("n_words", T.LongType()), ("n_removed", T.LongType()), ("spans", T.ArrayType(T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "source", "source_start")]))), ("kept_text", T.StringType()))]])
    messages = told.where("kind = 1").unionByName(found)
    return by_chunk.cogroup(messages.groupBy("chunk")).applyInArrow(parse, result)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of 13 words or more in documents: what is left, as a digest."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = substring_dedup(spark, docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))
