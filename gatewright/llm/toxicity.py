"""Toxicity by compression distance.

Zstandard dictionaries are trained in pairs, one on toxic and one on ordinary text. A
text is cut into windows of six words; each is compressed with either, and a window
counts by the bytes that the toxic dictionary saves beyond the ordinary one, in the
mean over PAIRS pairs. The sum, less what ordinary windows give and over its deviation,
is the text's z; the threshold on z is calibrated on labelled texts that trained no
dictionary, and the score is a logistic curve with 0.7 there.

Labels are of texts, and most of a toxic text is ordinary. Compression itself tells
them apart, before the pairs are made: each of `bags` tasks trains two dictionaries
on random halves of the toxic and as many ordinary texts, all their windows, here of
two words, and compresses the windows of texts it did not see. What one bag saves by
chance another does not; a window's distance is the mean over the bags. Windows of
toxic texts whose distance only one ordinary window in a thousand reaches train the
toxic dictionaries, ordinary windows but for the nearest 2 % the others, and all end
with the same base, trained on those as well. Of CANDIDATES such pairs the PAIRS that
tell calibration texts apart best are kept. No word list, and no statistic of words, is used.

Bounds of the labelled sample, the only data that is sampled: MOST_TOXIC and
MOST_ORDINARY labelled ids, least by a hash, one text an id, each text whole, up to
SAMPLE_BYTES of text a class in that order; the driver and the tasks of the fit hold no
more. Of near copies in it (by one MinHash value) one is used. The fit within that sample is
bounded too: bags compare with PLAIN_TEXTS ordinary texts a toxic one, whose windows alone
are measured and train base and ordinary dictionaries, and an ordinary dictionary is
trained on as many windows as its toxic one, PLAIN_WINDOWS at least. Scoring covers
every whole text and is a map without a shuffle.

Defined results: null or blank text has no windows and scores 0; rows whose id is null count as not held out, and teach nothing; of
two labels of one id the higher counts, of two texts the lesser, so an id that comes often
widens nothing; without a toxic or an ordinary label all
scores are 0; an empty table gives an empty result; input columns named
held_out, score or predicted give way to the result's.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import hashing
from .scratch import let_workers_import

MOST_TOXIC, MOST_ORDINARY, SAMPLE_BYTES = 1500, 4500, 64 << 20
#: Ordinary texts measured for each toxic one, and the fewest windows that train an ordinary dictionary.
PLAIN_TEXTS, PLAIN_WINDOWS = 2, 500
BAGS, BAG_BYTES = 18, (1 << 10, 4 << 10, 16 << 10)
CANDIDATES, PAIRS, CLASS_BYTES, BASE_BYTES, FILL_BYTES, LEVEL = 8, 2, 2 << 10, 128 << 10, 64, 3
#: Share of ordinary windows that a toxic training window exceeds, and of those that train the ordinary dictionary and the base.
NEARER, PLAIN = 0.999, 0.98
THRESHOLD = 0.7
OUT = ("held_out", "score", "predicted")
FIT_WORDS, WORDS = 2, 6
_WINDOW = {n: re.compile(rb"(?: [^ ]+){1,%d}" % n) for n in (FIT_WORDS, WORDS)}
_OTHER = re.compile(r"[\W_]+")


def held_out(id_: Column) -> Column:
    """Rows that labels are never learned from."""
    return F.coalesce(F.crc32(id_.cast("string")) % 3 == 1, F.lit(False))


def text_windows(text: str | None, words: int = WORDS) -> list[bytes]:
    """Windows of a text: its words in lower case, each after a blank, so many at a time, with a blank behind."""
    plain = _OTHER.sub(" ", (text or "").lower()).strip()
    return [w + b" " for w in _WINDOW[words].findall(b" " + plain.encode())] if plain else []


def train(size: int, samples: list[bytes], k: int = 16, d: int = 6) -> bytes:
    """Content of a trained dictionary, `size` bytes; of too few samples, their end."""
    try:
        content = zstandard.train_dictionary(size, samples, k=k, d=d).as_bytes()
    except zstandard.ZstdError:
        content = b"".join(samples)[-size:]
    return content.rjust(size)


def distance(toxic: bytes, ordinary: bytes) -> Callable[[list[bytes]], list[int]]:
    """The function from windows to the bytes that the toxic dictionary saves in each beyond the ordinary one."""
    packs = []
    for content in (toxic, ordinary):
        use = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        packs.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=use, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
    # with the end of either dictionary behind it, no window is stored as it is because little of it is matched
    ends = toxic[-FILL_BYTES:], ordinary[-FILL_BYTES:]
    return lambda windows: [len(packs[1](w + ends[1])) - len(packs[0](w + ends[0])) for w in windows]


def saver(pairs: list[tuple[bytes, bytes]]) -> Callable[[list[bytes]], list[float]]:
    """Distances of windows, 0 at least, in the mean over pairs of a toxic and an ordinary dictionary."""
    found = [distance(*pair) for pair in pairs]
    return lambda windows: [sum(v for v in x if v > 0) / len(x) for x in zip(*(f(windows) for f in found), strict=True)]


def apart(texts: list[str]) -> list[str]:
    """One text of each group of near copies, by the least hash of their word 5-grams; no blank ones."""
    seen, out = set(), []
    for at in range(0, len(texts), 256):
        part = texts[at : at + 256]
        w = hashing.words_of(pa.array(part))
        grams = hashing.windows(w.hash, 5, 11)
        for text, a, b in zip(part, w.first[:-1], w.first[1:], strict=True):
            key = int((grams[a : b - 4] if b - a >= 5 else w.hash[a:b]).min()) if b > a else 0
            if key not in seen and text_windows(text):
                seen.add(key)
                out.append(text)
    return out


def _joined(docs: list[list[bytes]], which: np.ndarray) -> list[bytes]:
    return [w for doc, use in zip(docs, which, strict=True) if use for w in doc]


def _halves(bag: int, toxic: int, ordinary: int) -> tuple[np.ndarray, np.ndarray]:
    """Which texts train the pair of a bag."""
    rng = np.random.default_rng(bag)
    return rng.random(toxic) < 0.5, rng.random(ordinary) < 0.5 * min(1.0, toxic / max(1, ordinary))


def bag_distances(bag: int, toxic: list[list[bytes]], ordinary: list[list[bytes]], measured: int) -> list[bytes]:
    """Distances of the windows of toxic texts, and of the first `measured` ordinary ones, that do not train this bag's pair; a signed byte each."""
    bad, good = _halves(bag, len(toxic), len(ordinary))
    size = BAG_BYTES[bag % len(BAG_BYTES)]
    found = distance(*(train(size, _joined(docs, use) or [b" "]) for docs, use in ((toxic, bad), (ordinary, good))))
    unseen = _joined(toxic, ~bad), _joined(ordinary[:measured], ~good[:measured])
    return [np.clip(found(w), -127, 127).astype(np.int8).tobytes() for w in unseen]


def mean_distances(bags: list[list[bytes]], toxic: list[list[bytes]], ordinary: list[list[bytes]], measured: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean distance of each window over the bags that did not see its text; -inf where all did."""
    docs = toxic, ordinary[:measured]
    sizes = [np.array([len(d) for d in x], np.int64) for x in docs]
    total, n = [np.zeros(s.sum()) for s in sizes], [np.zeros(s.sum()) for s in sizes]
    for bag, blobs in enumerate(bags):
        halves = _halves(bag, len(toxic), len(ordinary))
        for i, blob in enumerate(blobs):
            unseen = np.repeat(~halves[i][: len(docs[i])], sizes[i])
            total[i][unseen] += np.frombuffer(blob, np.int8)
            n[i][unseen] += 1
    return tuple(np.where(k > 0, t / np.maximum(k, 1), -np.inf) for t, k in zip(total, n, strict=True))


class Model:
    """Bytes and numbers only, so it travels to workers in a closure. each: runs a function from a number to bytes for 0 .. n - 1, in tasks."""

    def __init__(self, toxic: list[str], ordinary: list[str], each: Callable[[Callable[[int], list[bytes]], int], list[list[bytes]]], bags: int = BAGS):
        toxic, ordinary = apart(toxic), apart(ordinary)
        self.empty, self.pairs = not toxic or not ordinary, []
        if self.empty:
            return
        # a quarter of each class calibrates
        (bad, bad_held), (good, good_held) = (([t for i, t in enumerate(x) if i % 4 or len(x) < 4], [t for i, t in enumerate(x) if i % 4 == 0]) for x in (toxic, ordinary))
        bad, good = ([text_windows(t, FIT_WORDS) for t in x] for x in (bad, good))
        bad_held, good_held = ([text_windows(t) for t in x] for x in (bad_held, good_held))
        measured = min(len(good), PLAIN_TEXTS * len(bad))
        far, near = mean_distances(each(lambda bag: bag_distances(bag, bad, good, measured), bags), bad, good, measured)
        windows, plain = [w for d in bad for w in d], [w for d in good[:measured] for w in d]
        picked = [windows[i] for i in np.flatnonzero(far > np.quantile(near, NEARER))] or windows
        plain = [plain[i] for i in np.flatnonzero(near <= np.quantile(near, PLAIN))] or plain
        base, candidates = train(BASE_BYTES, plain, 64, 8), []
        for candidate in range(CANDIDATES):
            rng = np.random.default_rng(candidate)
            # each but the first without another fifth of the picked windows
            some = [picked[i] for i in rng.permutation(len(picked))[: max(1, len(picked) * 4 // 5)]] if candidate else picked
            alike = [plain[i] for i in rng.permutation(len(plain))[: max(len(some), PLAIN_WINDOWS)]]
            # the parts of the classes are of one length, so the base is as far from either
            candidates.append(tuple(train(CLASS_BYTES, x) + base for x in (some, alike)))

        def sums(candidate: int) -> list[bytes]:
            saved = saver([candidates[candidate]])
            return [np.array([(sum(x := saved(d)), sum(v * v for v in x), len(d)) for d in docs]).tobytes() for docs in (bad_held, good_held)]

        def calibrate(found: list[np.ndarray]) -> float:
            """Sets mean, variance, cut and slope by the sums over calibration texts, toxic and ordinary; returns the F1 there."""
            total, squares, n = found[1].sum(axis=0)
            self.mean, self.variance = float(total / n), float(squares / n - (total / n) ** 2 + 0.05)
            z = np.concatenate([(x[:, 0] - self.mean * x[:, 2]) / (self.variance * (x[:, 2] + 1)) ** 0.5 for x in found])
            is_bad = np.arange(len(z)) < len(found[0])
            order = np.argsort(-z, kind="stable")
            f1 = 2 * np.cumsum(is_bad[order]) / (np.arange(len(z)) + 1 + is_bad.sum())
            at = int(np.argmax(f1))
            below = z[order[at + 1]] if at + 1 < len(z) else z[order[at]] - 1
            self.cut = float((z[order[at]] + below) / 2)
            self.slope = 2.0 / max(1.0, float(np.median(z[is_bad])) - self.cut)
            return float(f1[at])

        found = [[np.frombuffer(b).reshape(-1, 3) for b in x] for x in each(sums, CANDIDATES)]
        best = sorted(range(CANDIDATES), key=lambda i: -calibrate(found[i]))[:PAIRS]
        self.pairs = [candidates[i] for i in best]
        saved = saver(self.pairs)
        calibrate([np.array([(sum(x := saved(d)), sum(v * v for v in x), len(d)) for d in docs]) for docs in (bad_held, good_held)])

    def _z(self, saved: list[float]) -> float:
        n = len(saved)
        return (sum(saved) - self.mean * n) / (self.variance * (n + 1)) ** 0.5

    def scorer(self) -> Callable[[str | None], float]:
        if self.empty:
            return lambda text: 0.0
        saved, top = saver(self.pairs), np.log(THRESHOLD / (1 - THRESHOLD))

        def score(text: str | None) -> float:
            windows = text_windows(text)
            if not windows:
                return 0.0
            x = self.slope * (self._z(saved(windows)) - self.cut) + top
            return float(1 / (1 + np.exp(-min(50.0, max(-50.0, x)))))

        return score


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", bags: int = BAGS) -> Model:
    """A model from the labelled rows that are not held out."""
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    usable = usable.groupBy(id_col).agg((F.max(label_col) > 0).alias("_toxic"))
    ids = [usable.where(F.col("_toxic") == which).orderBy(F.xxhash64(id_col), id_col).limit(most) for which, most in ((True, MOST_TOXIC), (False, MOST_ORDINARY))]
    sample = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).join(F.broadcast(ids[0].unionByName(ids[1]).withColumnRenamed(id_col, "id")), "id")

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The least text of each id of a task, and so at most the sampled ids of it."""
        held: dict = {}
        for batch in batches:
            for id_, text, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if id_ not in held or text < held[id_][0]:
                    held[id_] = text, toxic
        columns = [list(held), [t for t, _ in held.values()], [y for _, y in held.values()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.types, strict=True)], kinds.names)

    kinds = to_arrow_schema(sample.schema)
    one = sample.mapInArrow(least, sample.schema).groupBy("id", "_toxic").agg(F.min("text").alias("text"))
    # at most MOST_TOXIC + MOST_ORDINARY rows
    first = (F.xxhash64("id"), F.col("id"))
    held = F.sum(F.octet_length("text").cast("long")).over(Window.partitionBy("_toxic").orderBy(*first).rowsBetween(Window.unboundedPreceding, 0))
    rows = one.withColumn("held", held).where(F.col("held") <= SAMPLE_BYTES).orderBy(*first).collect()

    def each(use: Callable[[int], list[bytes]], n: int) -> list[list[bytes]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in batch["id"].to_pylist():
                    yield pa.RecordBatch.from_pydict({"i": [i], "found": pa.array([use(i)], pa.list_(pa.binary()))})

        return [r["found"] for r in sorted(spark.range(0, n, 1, n).mapInArrow(run, "i long, found array<binary>").collect())]

    return Model([r["text"] for r in rows if r["_toxic"]], [r["text"] for r in rows if not r["_toxic"]], each, bags)


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """docs with held_out, score (0 to 1) and predicted (1 where score >= 0.7)."""
    let_workers_import(spark)
    docs = docs.select(*[c for c in docs.columns if c not in OUT])
    model, text_at = learn(spark, docs, labels, id_col=id_col, text_col=text_col, label_col=label_col), docs.columns.index(text_col)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            for part in hashing.slices(batch, text_at, 4 << 20):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([score(t) for t in part.column(text_at).to_pylist()], pa.float64())], [*part.schema.names, "score"])

    scored = docs.mapInArrow(judge, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))
    return scored.select(*docs.columns, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return toxicity(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", *OUT)
