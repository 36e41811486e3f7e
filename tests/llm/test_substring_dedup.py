import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gatewright.llm.substring_dedup import farthest, substring_dedup

from .conftest import prose, words


def brute(rows, k=13):
    least = {}
    for i, t in rows:
        if i is not None:
            w = words(t)
            for j in range(len(w) - k + 1):
                key = tuple(w[j : j + k])
                least[key] = min(i, least.get(key, i))
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            if i is not None and least[tuple(w[j : j + k])] < i:
                gone[j : j + k] = [True] * k
        yield i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)


def check_spans(got, texts):
    """Spans cover what was removed, and each is the source's words, word for word."""
    for r in got:
        cover, w = set(), words(r.text)
        for s in r.spans:
            assert s.length >= 13 and s.source < r.doc_id
            cover.update(range(s.start, s.start + s.length))
            assert any(words(t)[s.source_start : s.source_start + s.length] == w[s.start : s.start + s.length] for t in texts[s.source])
        assert len(cover) == r.n_removed


@pytest.mark.parametrize("options", [{}, {"chunk_bytes": 500, "slot_bytes": 100}, {"chunk_bytes": 2000, "slot_bytes": 4000, "group_chunks": 3}])
def test_brute_force(spark, docs, rows, options):
    got = substring_dedup(spark, docs, **options).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == Counter(brute([(i, t) for i, t, _ in rows]))
    texts = {}
    for i, t, _ in rows:
        texts.setdefault(i, []).append(t)
    check_spans(got, texts)
    assert got[0].size == "x" and got[0].chunk == "x"


def test_a_text_of_several_chunks(spark):
    """One text above the size of a chunk, and passages of it elsewhere."""
    rng = random.Random(4)
    long = prose(rng, 400_000, 10**7)
    w = long.split()
    rows = [(5, long), (3, " ".join(w[1000:1200])), (7, " ".join(w[399_900:]) + " end"), (9, long + " more")]
    got = substring_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == Counter(brute(rows))
    check_spans(got, {i: [t] for i, t in rows})
    by = {r.doc_id: r for r in got}
    assert [tuple(s) for s in by[5].spans] == [(1000, 200, 3, 0)] and [tuple(s) for s in by[7].spans] == [(0, 100, 5, 399_900)]


def test_a_factor_goes_on_in_its_source(spark):
    """A third document with a smaller id, within the match, adds no factor of its own."""
    rng = random.Random(6)
    w = prose(rng, 100, 10**7).split()
    rows = [(2, " ".join(w)), (1, "a b c " + " ".join(w[40:55])), (3, "x " + " ".join(w) + " y")]
    got = {r.doc_id: r for r in substring_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(s) for s in got[2].spans] == [(40, 15, 1, 3)]
    spans = [tuple(s) for s in got[3].spans]
    assert got[3].kept_text == "x y" and spans == [(1, 52, 2, 0), (44, 57, 2, 43)]


def test_factors_reach_farthest():
    import numpy as np

    a = np.array
    assert farthest(a([0, 2, 3, 30]), a([15, 15, 25, 50]), a([0, 0, 0, 0])) == [0, 2, 3]
    assert farthest(a([0, 5, 6, 7]), a([13, 20, 40, 39]), a([0, 0, 0, 0])) == [0, 2]
    assert farthest(a([0, 5]), a([13, 20]), a([0, 1])) == [0, 1]


def test_empty_and_other_ids(spark, empty):
    assert substring_dedup(spark, empty).count() == 0
    with pytest.raises(TypeError):
        substring_dedup(spark, empty.withColumn("doc_id", F.lit("a")))
