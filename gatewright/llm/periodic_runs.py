"""Runs of repeating words in texts, by longest common extensions over a difference cover.

A run is a stretch of words with smallest period q, that is, words q apart are
alike, of at least max(MIN_WORDS, EXPONENT * q) words, which no neighbouring word
extends at that period. For each q a harmonic grid of positions is visited, so
wide that every run holds a grid point followed by COMPARED words that agree with
those q further on; n log n points in all. Where they agree, the extension of the
pair to both sides gives the run's bounds.

An extension compares a few words, until both positions are of a difference cover
modulo PERIOD, and takes the rest from a range minimum: the suffixes that begin at
cover positions, under a quarter of all, are sorted within their text by rounds
over those still alike (three words a round, then by ranks of suffixes further on,
doubling), neighbours' common lengths follow from the rounds, and a sparse table
answers minima. The same over reversed words gives the extension to the left. Only
texts with a grid point that agrees are sorted.

Texts are worked on in slices of about SLICE bytes, one whole text at least, without
a shuffle; grid points are visited in parts of GRID, so memory is bounded by the
longest text. Words are matches of [^\\x20\\x09-\\x0D]+, told apart by 64-bit hashes.

Defined results: a null or empty text has no words, no runs and an empty
collapsed_text; rows with null or repeated ids, and repeated rows, are worked on
one by one; an empty table gives an empty result; input columns named n_words,
runs or collapsed_text give way to the result's.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hashing
from .scratch import let_workers_import

MIN_WORDS, EXPONENT = 24, 3
#: A difference cover: every difference modulo PERIOD is one of two members.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
COMPARED, GRID, SLICE = 4, 1 << 20, 4 << 20
SPACE = " \t\n\x0b\x0c\r"
OUT = ("n_words", "runs", "collapsed_text")

_IN_COVER = np.isin(np.arange(PERIOD), COVER)
#: How many words to compare from two positions (modulo PERIOD) until both are in the cover.
_SHIFT = np.array([[next(k for k in range(PERIOD) if _IN_COVER[(i + k) % PERIOD] and _IN_COVER[(j + k) % PERIOD]) for j in range(PERIOD)] for i in range(PERIOD)])


class Extensions:
    """Longest common prefixes of suffixes of one text, for many texts in a row. word: a number a word; first: bounds of the texts."""

    def __init__(self, word: np.ndarray, first: np.ndarray):
        n, lengths = len(word), np.diff(first)
        self.word, self.end, self.begin = word, np.repeat(first[1:], lengths), np.repeat(first[:-1], lengths)
        self.pos = np.flatnonzero(_IN_COVER[(np.arange(n) - self.begin) % PERIOD])
        self.sample = np.full(n, -1, np.int64)
        self.sample[self.pos] = np.arange(len(self.pos))
        end = self.end[self.pos]
        # samples of a text first stand in a group of their own; a group's rank is its first place
        self.order = np.arange(len(self.pos))
        begin = self.begin[self.pos]
        new = np.r_[True, begin[1:] != begin[:-1]] if len(begin) else np.zeros(0, bool)
        self.rank = np.flatnonzero(new)[np.cumsum(new) - 1]
        # places whose suffix is still alike with another
        self._alike = np.arange(len(self.pos))
        padded = np.concatenate([word + 1, np.zeros(PERIOD + 3, np.int64)])
        for depth in range(0, PERIOD, 3):
            at = self.pos[self.order[self._alike]]
            key = np.zeros(len(at), np.int64)
            for j in range(depth, depth + 3):
                next_ = np.where(at + j < self.end[at], padded[at + j], 0)
                # three numbers under 2^21 make one of 63 bits
                key = key * (n + 1) + next_ if n < (1 << 21) - 1 else self._pair(key, next_)
            self._split(key)
        self.levels = [self.rank.copy()]
        step, longest = PERIOD, int(lengths.max(initial=0))
        while step < longest and len(self._alike):
            which = self.order[self._alike]
            at = self.pos[which] + step
            inside = at < end[which]
            key = np.full(len(at), -1, np.int64)
            key[inside] = self.rank[self.sample[at[inside]]]
            self._split(key)
            self.levels.append(self.rank.copy())
            step *= 2
        self.place = np.empty(len(self.pos), np.int64)
        self.place[self.order] = np.arange(len(self.pos))
        self._minima(self._neighbours())

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """One number for each pair, in the order of pairs."""
        order = np.lexsort((b, a))
        new = np.r_[False, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])] if len(a) else np.zeros(0, bool)
        out = np.empty(len(a), np.int64)
        out[order] = np.cumsum(new)
        return out

    def _split(self, key: np.ndarray) -> None:
        """Sort the tied places by (rank, key), and part their groups."""
        places = self._alike
        which = self.order[places]
        rank = self.rank[which]
        sort = np.lexsort((key, rank))
        which, rank, key = which[sort], rank[sort], key[sort]
        self.order[places] = which
        new = np.r_[True, (rank[1:] != rank[:-1]) | (key[1:] != key[:-1])] if len(rank) else np.zeros(0, bool)
        self.rank[which] = places[np.flatnonzero(new)[np.cumsum(new) - 1]]
        alone = new & np.r_[new[1:], True] if len(new) else new
        self._alike = places[~alone]

    def _neighbours(self) -> np.ndarray:
        """Common words of each suffix with the next in order; 0 over a text's end."""
        a, b = self.pos[self.order[:-1]], self.pos[self.order[1:]]
        same = np.flatnonzero(self.begin[a] == self.begin[b])
        out = np.zeros(max(0, len(self.pos) - 1), np.int64)
        a, b, end = a[same].copy(), b[same].copy(), self.end[a[same]]
        start = a.copy()
        for i in range(len(self.levels) - 1, -1, -1):
            inside = (a < end) & (b < end)
            alike = np.zeros(len(a), bool)
            alike[inside] = self.levels[i][self.sample[a[inside]]] == self.levels[i][self.sample[b[inside]]]
            a[alike] += PERIOD << i
            b[alike] += PERIOD << i
        out[same] = a - start + self._agree(a, b, end, np.full(len(a), PERIOD))
        return out

    def _agree(self, a: np.ndarray, b: np.ndarray, end: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words from a and b on are alike, up to `most` and the end."""
        got, live = np.zeros(len(a), np.int64), np.arange(len(a))
        for k in range(int(most.max(initial=0))):
            live = live[(k < most[live]) & (a[live] + k < end[live]) & (b[live] + k < end[live])]
            live = live[self.word[a[live] + k] == self.word[b[live] + k]]
            if not len(live):
                break
            got[live] += 1
        return got

    def _minima(self, least: np.ndarray) -> None:
        widest = int(np.unique(self.begin[self.pos], return_counts=True)[1].max(initial=1))
        self.table = [least]
        while 1 << len(self.table) < widest:
            half = 1 << (len(self.table) - 1)
            last = self.table[-1]
            self.table.append(np.minimum(last[: max(0, len(last) - half)], last[half:]))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common words from a and from b > a on, both in one text; 0 where b is the text's end."""
        end = self.end[a]
        shift = _SHIFT[(a - self.begin[a]) % PERIOD, (b - self.begin[a]) % PERIOD]
        got = self._agree(a, b, end, shift)
        on = np.flatnonzero((got == shift) & (b + shift < end))
        x, y = self.place[self.sample[a[on] + shift[on]]], self.place[self.sample[b[on] + shift[on]]]
        lo, hi = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        for i in np.unique(level):
            k = np.flatnonzero(level == i)
            t = self.table[i]
            got[on[k]] += np.minimum(t[lo[k]], t[hi[k] - (1 << i)])
        return got


def grid(h: np.ndarray, first: np.ndarray, min_words: int, exponent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, periods) of grid points whose next words agree with those a period on, in parts. h: hashes of words; first: bounds of texts."""
    n = np.diff(first)
    text = np.flatnonzero(n >= min_words)
    most = n[text] // exponent
    # a row a text and period
    owner, period = np.repeat(text, most), np.arange(most.sum()) - np.repeat(np.cumsum(most) - most, most) + 1
    alike = np.maximum((exponent - 1) * period, min_words - period)  # at least so many words of a run agree with those a period on
    step = alike - COMPARED + 1
    points = np.maximum(0, (n[owner] - period - COMPARED) // step + 1)
    total = np.cumsum(points)
    at = 0
    while at < len(points):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + GRID, side="right")))
        k = points[at:to]
        row = np.repeat(np.arange(at, to), k)
        i = first[owner[row]] + (np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)) * step[row]
        q = period[row]
        for j in range(COMPARED):
            same = h[i + j] == h[i + j + q]
            i, q = i[same], q[same]
        yield i, q
        at = to


def runs_of(h: np.ndarray, first: np.ndarray, min_words: int = MIN_WORDS, exponent: int = EXPONENT) -> np.ndarray:
    """Rows (start, end, period) of all runs, by start and period; places in the whole array of words."""
    found = [np.zeros((0, 3), np.int64)]
    some = np.zeros(len(first), bool)
    for i, _ in grid(h, first, min_words, exponent):
        some[np.searchsorted(first, i, side="right") - 1] = True
    texts = np.flatnonzero(some)
    if not len(texts):
        return found[0]
    # only texts in question, one behind the other
    n = np.diff(first)[texts]
    own = np.r_[0, np.cumsum(n)]
    move = np.repeat(first[texts] - own[:-1], n)
    _, word = np.unique(h[np.arange(own[-1]) + move], return_inverse=True)
    right, left, size = Extensions(word, own), Extensions(word[::-1], own[-1] - own[::-1]), own[-1]
    for i, q in grid(word, own, min_words, exponent):
        ahead = right.common(i, i + q)
        # words before i and before i + q, read backwards; none at a text's begin
        back = np.zeros(len(i), np.int64)
        inner = np.flatnonzero(i > right.begin[i])
        back[inner] = left.common(size - i[inner] - q[inner], size - i[inner])
        start, end = i - back, i + q + ahead
        long = end - start >= np.maximum(min_words, exponent * q)
        found = [_least_periods(np.concatenate([*found, np.stack([start[long], end[long], q[long]], axis=1)]))]
    out = found[0]
    out = out[np.lexsort((out[:, 2], out[:, 0]))]
    out[:, :2] += move[out[:, 0]][:, None]
    return out


def _least_periods(rows: np.ndarray) -> np.ndarray:
    """A stretch is found at all multiples of its period; the least is its own."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    return rows[new]


def periodic_runs(spark: SparkSession, docs: DataFrame, *, text_col: str = "text", min_words: int = MIN_WORDS, exponent: int = EXPONENT) -> DataFrame:
    """docs with n_words, runs (array of start, length and period, in words, by start and period) and collapsed_text: the words that lie in no run after its first period, joined by one space."""
    if exponent < 3 or min_words < 8:
        raise ValueError("runs of fewer than three periods or eight words are not sought")
    let_workers_import(spark)
    docs = docs.select(*[c for c in docs.columns if c not in OUT])
    at = docs.columns.index(text_col)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in hashing.slices(batch, at, SLICE):
                buf, offsets = hashing.utf8(part.column(at))
                w = hashing.words_of(part.column(at))
                n, size = np.diff(w.first), len(w.hash)
                runs = runs_of(w.hash, w.first, min_words, exponent)
                cover = np.zeros(size + 1, np.int64)
                np.add.at(cover, runs[:, 0] + runs[:, 2], 1)
                np.add.at(cover, runs[:, 1], -1)
                kept = np.cumsum(cover)[:-1] == 0
                lost = np.diff(np.r_[0, np.cumsum(~kept)][w.first])
                texts = []
                for i in range(part.num_rows):
                    words = buf[offsets[i] : offsets[i + 1]].tobytes().split()
                    texts.append(b" ".join(compress(words, kept[w.first[i] : w.first[i + 1]]) if lost[i] else words))
                row = np.searchsorted(w.first, runs[:, 0], side="right") - 1
                bounds = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                fields = [runs[:, 0] - w.first[row], runs[:, 1] - runs[:, 0], runs[:, 2]]
                runs_column = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays([pa.array(f.astype(np.int64)) for f in fields], ["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n.astype(np.int64)), runs_column, pa.array(texts, pa.binary()).cast(pa.string())], [*part.schema.names, *OUT])

    run = T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")])
    return docs.mapInArrow(parse, T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(run)), T.StructField("collapsed_text", T.StringType())]))


def planted(text: Column, doc_id: Column) -> Column:
    """The text of the contract: where crc32 of the id is a multiple of 10, its words from some place on repeat with some period; else as it is."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    bare = F.trim(text, F.lit(SPACE))

    def rewritten(w: Column) -> Column:
        n, g = F.size(w).cast("long"), F.floor(h / 10)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        block, times = F.slice(w, (a + 1).cast("int"), p.cast("int")), F.ceil((n - a) / p).cast("int")
        tail = F.slice(F.flatten(F.array_repeat(block, times)), F.lit(1), (n - a).cast("int"))
        return F.array_join(F.concat(F.slice(w, F.lit(1), a.cast("int")), tail), " ")

    words = F.split(bare, r"[\x20\x09-\x0D]+")
    return F.when((h % 10 == 0) & (bare != ""), F.get(F.transform(F.array(words), rewritten), F.lit(0))).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, of which one in ten is made periodic, and digests of all runs and of what is left without repeats."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodic_runs(spark, docs)
    more = lambda a, r: a.isNull() | (r.length * a.period > a.length * r.period)
    best = F.aggregate("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda a, r: F.when(more(a, r), r).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
