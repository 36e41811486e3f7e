"""Each stage on what its predecessor kept, against brute force."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from gatewright.llm import toxicity

from .conftest import words
from .test_near_duplicates import brute as near
from .test_rules import labelled  # noqa: F401
from .test_substring_dedup import brute as repeated

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf(spark, rows, labelled, tmp_path_factory):  # noqa: F811
    at = str(tmp_path_factory.mktemp("sf"))
    docs = [(i, t, "en", s, len(t or "")) for i, t, s in rows if i is not None]
    docs += [(10_000 + i, t, "en", f"t{i % 3}", len(t)) for i, t, _ in labelled]
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(10_000 + i, 1, y) for i, _, y in labelled], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


@pytest.fixture(scope="module")
def steps(spark, sf):
    """The rows before all stages and after each."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    out.append(docs.collect())
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, docs, sf)
        if i < 4:
            assert got.columns == docs.columns
        got.write.parquet(f"{sf}/out{i}")
        docs = spark.read.parquet(f"{sf}/out{i}")
        out.append(docs.collect())
    return out


def test_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near duplicates", "substring dedup", "source mix", "packing"]


def test_toxic_documents_go(spark, sf, steps, labelled):  # noqa: F811
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scored = toxicity.toxicity(spark, docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()
    assert Counter(r.doc_id for r in steps[1]) == Counter(r.doc_id for r in scored if r.score < 0.7)
    kept = {r.doc_id for r in steps[1]}
    bad = [10_000 + i in kept for i, _, y in labelled if y]
    good = [10_000 + i in kept for i, _, y in labelled if not y]
    assert sum(bad) <= 0.1 * len(bad) and sum(good) >= 0.95 * len(good)


def test_one_of_each_group_stays(steps):
    before, after = steps[1], steps[2]
    classes = defaultdict(set)
    for i, top, *_ in near([(r.doc_id, r.text) for r in before]):
        classes[top].add(i)
    ids = Counter(r.doc_id for r in after if words(r.text))
    for top, members in classes.items():
        held = [i for i in members if i in ids]
        if top != 300 and any(words(r.text) for r in before if r.doc_id == top):  # two texts have the id 300
            assert held == [top] and ids[top] == 1
    assert Counter(r.doc_id for r in after if not words(r.text)) == Counter(r.doc_id for r in before if not words(r.text))


def test_repeated_passages_go(steps):
    before, after = steps[2], steps[3]
    expected = Counter((i, " ".join(words(kept))) for i, _, _, kept in repeated([(r.doc_id, r.text) for r in before]))
    assert Counter((r.doc_id, " ".join(words(r.text))) for r in after) == expected
    assert all(r.n_chars == len(r.text) for r in after if r.text is not None)


def test_mix(steps):
    before, after = steps[3], steps[4]
    size, taken, source = Counter(), Counter(), Counter()
    for r in before:
        size[r.doc_id] += len(words(r.text))
        source[r.source] += len(words(r.text))
    for r in after:
        taken[r.doc_id] += len(words(r.text))
    assert all(taken[i] <= 2 * size[i] for i in taken)
    assert abs(taken.total() - 1.5 * source.total()) < 0.01 * source.total()


def test_packing(steps):
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    rows = [(r.doc_id, np.array([*encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")) for r in steps[4]]
    assert Counter({i: sum(len(x) for j, x in rows if j == i) for i in {i for i, _ in rows}}) == Counter({i: sum(r.length for r in steps[5] if r.doc_id == i) for i in {i for i, _ in rows}})
    once = {i for i, n in Counter(i for i, _ in rows).items() if n == 1}
    for i, ids in rows:
        for r in steps[5] if i in once else ():
            if r.doc_id == i:
                assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids)
    places = defaultdict(list)
    for r in steps[5]:
        places[r.sequence_id].append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0


def test_run(spark, sf, steps):
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert Counter((r.doc_id, r.doc_tokens) for r in got.collect()).keys() == Counter((r.doc_id, r.doc_tokens) for r in steps[5]).keys()


def test_stages_do_not_disturb_each_other(spark, sf):
    """The result of a stage can be read after the same stage ran on other documents."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a = corpus_pipeline.cut_repeated_passages(spark, docs.where("doc_id % 2 = 0"), sf)
    b = corpus_pipeline.cut_repeated_passages(spark, docs.where("doc_id % 2 = 1"), sf)
    assert a.count() + b.count() == docs.count()


def test_no_documents_and_null_ids(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "a few words " * 20, None, None, 240), (1, "", "en", "s", 0)], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        # the mix takes no document without words, and packing none away
        assert stage(spark, odd, sf).count() >= (1 if name == "source mix" else 3)
