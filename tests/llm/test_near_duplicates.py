import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from gatewright.llm import near_duplicates as nd
from gatewright.llm.components import components
from gatewright.llm.scratch import Scratch

from .conftest import prose, words


def shingles(text, n=5):
    w = words(text)
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows, threshold=0.8):
    """(doc_id, class_id, rep_id, copies, n_links), for ids of which none is null."""
    sets = [shingles(t) for _, t in rows]
    groups = {}
    for (i, _), s in zip(rows, sets, strict=True):
        groups.setdefault(s, []).append(i)
    groups.pop(frozenset(), None)
    root, links = {s: s for s in groups}, Counter()

    def top(s):
        while root[s] != s:
            s = root[s]
        return s

    for a, b in combinations(groups, 2):
        if len(a & b) >= threshold * len(a | b) - 1e-12:
            links[a] += 1
            links[b] += 1
            root[top(a)] = top(b)
    least = {}
    for s, ids in groups.items():
        least[top(s)] = min(min(ids), least.get(top(s), min(ids)))
    for (i, _), s in zip(rows, sets, strict=True):
        yield (i, least[top(s)], min(groups[s]), len(groups[s]), links[s]) if s else (i, i, i, 1, 0)


def result(df):
    return Counter((r.doc_id, r.class_id, r.rep_id, r.copies, r.n_links) for r in df.collect())


def test_brute_force(spark, docs, rows):
    known = [(i, t) for i, t, _ in rows if i is not None]
    got = nd.near_duplicates(spark, docs.where("doc_id IS NOT NULL"))
    assert result(got) == Counter(brute(known))
    kept = got.where("keeper").collect()
    with_text = [r for r in kept if words(r.text) and r.class_id != 300]  # two texts have the id 300
    assert len({r.class_id for r in with_text}) == len(with_text) and all(r.doc_id == r.class_id for r in with_text)
    assert kept[0].chunk == "x"


def test_groups_over_blocks(spark, monkeypatch):
    """A large group of near copies and one of copies, in many blocks of both kinds."""
    monkeypatch.setattr(nd, "BUCKET_BLOCK", 16)
    monkeypatch.setattr(nd, "GROUP_ROWS", 8)
    monkeypatch.setattr(nd, "TILE", 3)
    base = [f"u{i}" for i in range(60)]
    rows = [(i, " ".join(base[:k] + [f"x{i % 45}"] + base[k:])) for i, k in ((i, 5 + i % 3) for i in range(70))]
    rows += [(100 + i, "same text for all of these rows here") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(nd.near_duplicates(spark, df)) == Counter(brute(rows))


def test_null_ids_and_nothing(spark, docs, empty):
    got = nd.near_duplicates(spark, docs)
    assert got.count() == docs.count()
    assert got.where("keeper AND text IS NULL").count() == docs.where("text IS NULL").count()
    assert nd.near_duplicates(spark, empty).count() == 0
    bare = spark.createDataFrame([(None, "a b c d e f g"), (None, "a b c d e f g"), (1, None)], "doc_id long, text string")
    assert Counter((r.doc_id, r.class_id, r.copies, r.keeper) for r in nd.near_duplicates(spark, bare).collect()) == Counter({(None, None, 2, True): 1, (None, None, 2, False): 1, (1, 1, 1, True): 1})


@pytest.mark.parametrize("many", [False, True])
def test_overlaps(many):
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, 200).astype(np.uint64)) for _ in range(30)]
    a, b = np.triu_indices(30, 1) if many else (np.array([0, 5, 7]), np.array([1, 6, 29]))
    at = np.cumsum([0, *map(len, sets)])
    assert nd.overlaps(np.concatenate(sets), at, a, b).tolist() == [np.intersect1d(sets[x], sets[y]).size for x, y in zip(a, b, strict=True)]


def test_posterior():
    least = nd.least_matches(0.8, 1e-6)
    assert len(least) == 8 and list(least) == sorted(least) and 50 < least[-1] < 0.8 * 128
    rng = np.random.default_rng(4)
    drawn = rng.random((20000, 128)) < 0.8
    lost = np.zeros(20000, bool)
    for i, fewest in enumerate(least):
        lost |= drawn[:, : 16 * (i + 1)].sum(axis=1) < fewest
    assert lost.mean() < 1e-3


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1040)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    got = components(Scratch(spark, "test"), spark.createDataFrame(edges, "a long, b long"), "c").collect()
    assert {r.node: r.root for r in got} == {x: top(x) for a, b in edges if a != b for x in (a, b)}


def test_union_and_blocks_by_bytes(spark, monkeypatch):
    root = np.arange(7)
    nd._union(root, np.array([5, 6, 1]), np.array([6, 4, 3]))
    nd._union(root, np.array([3, 2]), np.array([5, 2]))
    assert root.tolist() == [0, 1, 2, 1, 1, 1, 1]
    # near copies that make several blocks by bytes, though few by rows
    monkeypatch.setattr(nd, "GROUP_BYTES", 2000)
    rng = random.Random(3)
    base = prose(rng, 100, 10**6).split()
    rows = [(i, " ".join([*base[:50], f"x{i}", *base[51:]])) for i in range(40)] + [(100, prose(rng, 50, 10**6))]
    got = {r.doc_id: (r.class_id, r.n_links) for r in nd.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**{i: (0, 39) for i in range(40)}, 100: (100, 0)}


def test_tiles_prune_like_pairs():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 256, (30, nd.HASHES))
    sigs = np.array([np.where(rng.random(nd.HASHES) < rng.choice([0.05, 0.2, 0.5, 1.0]), rng.integers(0, 256, nd.HASHES), base[i % 30]) for i in range(240)]).astype(np.uint8)
    least = nd.least_matches(0.8, 1e-6)
    for left, right in ((range(100), range(100, 240)), (range(0, 240, 30), range(0, 240, 30)), (range(3), range(0))):
        left, right = np.array(left, np.int64), np.array(right, np.int64)
        a, b = (v.ravel() for v in np.meshgrid(left, right, indexing="ij"))
        stay = nd.surviving(sigs, a, b, least)
        i, j = nd.surviving_tile(sigs[left], sigs[right], least)
        assert sorted(zip(left[i], right[j], strict=True)) == sorted(zip(a[stay], b[stay], strict=True))
