from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gatewright.llm import packing, token_counts, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  a  b", "x\n\n  y", "it's we'll  'S", "<|endoftext|>", "a <|endoftext|>b<|endoftext|> ", "  x y 　", "é\x0bü\x1c\x85z", "日本語 です", "12 345,67", "a" * 5000, " " * 3000 + "x", "\t\t\r\n", "👍🏽 ok"]


@pytest.fixture(scope="module")
def whole():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_ids_as_the_library_gives_them(whole, rows):
    encode = tokens.encoder(PATH).ids
    for text in ODD + [t for _, t, _ in rows if t]:
        assert encode(text).tolist() == whole(text), text[:40]


def test_other_files():
    for name in ("word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"):
        assert len(tokens.encoder(public_tokenizers.path(name)).ids("some plain text")) > 2
    assert tokens.version_digest(PATH) != tokens.version_digest(public_tokenizers.path("word_bpe_49k.json"))


def test_counts_and_cache(spark, docs, rows, whole, tmp_path):
    cache = f"file://{tmp_path}/cache"
    expected = Counter((i, len((t or "").encode()), len(whole(t)), len(whole(t)) > 50) for i, t, _ in rows)
    distinct = len({t or "" for _, t, _ in rows})
    for part, stored in ((docs.where("doc_id < 50"), None), (docs, distinct), (docs, distinct)):
        got = token_counts.token_counts(spark, part, PATH, cache=cache, limit=50)
        result = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect())
        assert got.columns.count("n_tokens") == 1
        if stored:
            assert result == expected
            assert spark.read.parquet(cache).count() == stored  # each distinct text was encoded once


def test_stored_counts_are_used(spark, docs, tmp_path):
    cache = f"file://{tmp_path}/cache"
    content = docs.select(F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("content")).distinct()
    content.withColumn("n_tokens", F.lit(7).cast("long")).write.parquet(f"{cache}/tokenizer={tokens.version_digest(PATH)}")
    assert {r.n_tokens for r in token_counts.token_counts(spark, docs, PATH, cache=cache).collect()} == {7}


def test_counts_of_nothing(spark, empty):
    assert token_counts.token_counts(spark, empty, PATH).count() == 0


@pytest.mark.parametrize("window, units", [(64, 16), (2048, 32)])
def test_packing(spark, docs, rows, whole, window, units):
    got = packing.pack(spark, docs, PATH, end_id=1, window=window, units=units).collect()
    check_packing(got, [(i, [*whole(t), 1]) for i, t, _ in rows], window)


def check_packing(got, ids, window):
    # pieces of each document, told apart by their rows' tokens: put together, they give every row
    pieces, places = Counter(), defaultdict(list)
    for r in got:
        pieces[(r.doc_id, r.start, r.ids)] += 1
        assert len(r.ids) == 4 * r.length and r.length > 0
        places[r.sequence_id].append((r.offset, r.length))
    total = Counter()
    for (i, _, blob), n in pieces.items():
        for x in np.frombuffer(blob, "<u4").tolist():
            total[(i, x)] += n
    expected = Counter((i, x) for i, row in ids for x in row)
    assert total == expected
    once = {i for i, n in Counter(i for i, _ in ids).items() if n == 1}
    for i, row in ids:
        if i in once:
            own = sorted((r.start, r.ids) for r in got if r.doc_id == i)
            assert b"".join(b for _, b in own) == np.array(row, "<u4").tobytes()
            assert all(r.doc_tokens == len(row) for r in got if r.doc_id == i)
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at == window or at & (at - 1) == 0  # nothing is padded


def test_packing_of_nothing(spark, empty):
    assert packing.pack(spark, empty, PATH, end_id=1).count() == 0


def test_least_squares():
    rng = np.random.default_rng(3)
    for _ in range(5):
        a, b = rng.random((12, 30)), rng.random(12)
        x = packing.nnls(a, b)
        slope = a.T @ (b - a @ x)
        assert (x >= 0).all() and slope.max() < 1e-6 and np.abs(slope[x > 1e-9]).max() < 1e-6
    combos = packing.combinations(8, 3)
    assert len(combos) == len(set(combos)) == 9 and all(sum(c) == 8 for c in combos)
    histogram = np.array([0, 10, 3, 7, 100, 0, 5, 9])
    times = packing.repeats(histogram, combos)
    used = np.bincount([x for c, t in zip(combos, times, strict=True) for x in c * int(t)], minlength=8)
    assert (used <= histogram).all() and used[4] >= 90
