"""Runs of words against a brute-force search of all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatewright.llm import hashing
from gatewright.llm import periodic_runs as pr

from .conftest import words


def brute(w, least=24, times=3):
    """All (start, length, period): maximal stretches at each period, longest first seen at its smallest."""
    out, n = {}, len(w)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                out.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, k, q) for (s, k), q in out.items())


def collapsed(w, runs):
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def texts():
    rng = random.Random(3)
    some = lambda n, v: [f"w{rng.randrange(v)}" for _ in range(n)]
    yield from ([], ["a"] * 23, ["a"] * 24, ["a"] * 200, ["a", "b"] * 12, ["a", "b"] * 12 + ["a"], some(500, 2), some(800, 3))
    for _ in range(60):
        p = rng.randrange(1, 40)
        block = some(p, rng.choice([2, 50, 10**6]))
        yield some(rng.randrange(40), 30) + (block * 8)[: rng.randrange(2 * p, 7 * p)] + some(rng.randrange(40), 30)
    inner = some(5, 99) * 6
    yield (inner + some(3, 99)) * 4  # runs within a run
    yield some(40, 9) + ["x", "y", "z"] * 9 + ["x", "y", "y"] * 9 + ["y"] * 30
    yield some(700, 10**6) * 4


def test_cover():
    assert {(a - b) % pr.PERIOD for a in pr.COVER for b in pr.COVER} == set(range(pr.PERIOD))


@pytest.mark.parametrize("part", [1 << 20, 7])
def test_runs_of_many_texts_at_once(monkeypatch, part):
    monkeypatch.setattr(pr, "GRID", part)
    all_ = list(texts())
    if part < 100:
        all_ = all_[:20]
    ids = {}
    h = np.array([ids.setdefault(x, len(ids)) for w in all_ for x in w], np.uint64)
    first = np.r_[0, np.cumsum([len(w) for w in all_])]
    got = [[] for _ in all_]
    for s, e, q in pr.runs_of(hashing.mix(h), first).tolist():
        t = int(np.searchsorted(first, s, side="right")) - 1
        got[t].append((s - int(first[t]), e - s, q))
    assert got == [brute(w) for w in all_] and any(got)


@pytest.mark.parametrize("alphabet", [1, 2, 5, 10**6])
def test_extensions(alphabet):
    rng = np.random.default_rng(alphabet)
    word = rng.integers(0, alphabet, 900)
    word[500:700] = word[100:300]
    first = np.array([0, 0, 400, 401, 900])
    found = pr.Extensions(word, first)
    a = rng.integers(0, 900, 3000)
    b = rng.integers(0, 900, 3000)
    same = (np.searchsorted(first, a, side="right") == np.searchsorted(first, b, side="right")) & (a < b)
    a, b = a[same], b[same]
    expected = []
    for i, j in zip(a, b, strict=True):
        end, k = found.end[i], 0
        while j + k < end and word[i + k] == word[j + k]:
            k += 1
        expected.append(k)
    assert found.common(a, b).tolist() == expected


def test_operator(spark, docs, rows, empty):
    extra = [(500 + i, " \n".join(w) + "\t") for i, w in enumerate(texts())]
    df = docs.select("doc_id", "text", "kept").unionByName(spark.createDataFrame(extra, "doc_id long, text string").withColumn("kept", F.lit("x")))
    df = df.withColumns({"runs": F.lit(1), "start": F.lit(2), "period": F.lit(3)})
    got = pr.periodic_runs(spark, df).collect()
    assert len(got) == len(rows) + len(extra) and all((r.kept, r.start, r.period) == ("x", 2, 3) for r in got)
    for r in got:
        w = words(r.text)
        runs = brute(w) if len(w) < 3000 else None
        assert r.n_words == len(w)
        if runs is not None:
            assert [tuple(x) for x in r.runs] == runs and r.collapsed_text == collapsed(w, runs)
    assert pr.periodic_runs(spark, empty).count() == 0


def test_query(spark, rows, tmp_path):
    all_ = [(i, t) for i, t, _ in rows] + [(9000 + i, " ".join(w)) for i, w in enumerate(texts())]
    all_.append((None, "z " * 1000))
    spark.createDataFrame(all_, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, pr.op12_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    expected, made = [], 0
    for i, t in all_:
        w = words(t)
        n, h = len(w), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w, made = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)], made + 1
        runs = brute(w)
        best = None
        for r in runs:
            if best is None or r[1] * best[2] > best[1] * r[2]:
                best = r
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        expected.append((i, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(collapsed(w, runs))))
    assert got == sorted(expected, key=str) and made > 5


def test_a_text_of_a_megabyte(spark):
    rng = random.Random(1)
    w = [f"w{rng.randrange(5000)}" for _ in range(170_000)]
    w[50_000:140_000] = (w[50_000:70_000] * 5)[:90_000]
    r = pr.periodic_runs(spark, spark.createDataFrame([(" ".join(w),)], "text string")).first()
    assert len(r.text) > 900_000 and [tuple(x) for x in r.runs] == [(50_000, 90_000, 20_000)] and r.collapsed_text.count(" ") == 100_000 - 1
