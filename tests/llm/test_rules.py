"""Licence scans, quality rules and toxicity."""

import random
import re
import textwrap
import zlib
from collections import Counter

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from gatewright.llm import license_scan, quality_rules, toxicity

from .conftest import prose, words


def test_licenses(spark, docs):
    mit = dict(license_scan.KNOWN)["MIT"]
    texts = [mit, "MIT Licence\n\nCopyright (c) 2020 Some One\n\n" + mit.split("\n\n", 1)[1].upper().replace(" ", "  "), mit + " more", "released, under the MIT LICENCE!", None, "", "Copyright me"]
    got = license_scan.license_scan(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()
    assert [r.license_id for r in got] == ["MIT", "MIT", None, "MIT (notice)", None, None, None]
    assert [r.canonical_chars for r in got[4:]] == [0, 0, 0]
    assert license_scan.license_scan(spark, docs).count() == docs.count()
    own = spark.createDataFrame([("b", "One, two"), ("a", "one two."), (None, None)], "license_id string, text string")
    assert license_scan.license_scan(spark, docs.limit(1).withColumn("text", F.lit("ONE\ntwo")), own).first().license_id == "a"


def test_other_marks_and_files(spark, tmp_path):
    """Marks of any script count as punctuation; known texts may come from files."""
    mit = dict(license_scan.KNOWN)["MIT"]
    texts = ["\u2022 " + mit.replace(". ", "\u2026 ").replace(", ", " \u00a7 "), "\u3010" + mit.replace(" ", "\u2003") + "\u3011"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    assert [r.license_id for r in license_scan.license_scan(spark, df).collect()] == ["MIT", "MIT"]
    (tmp_path / "own-1.0.txt").write_text("Do as you like.\n\nBut say so.")
    own = license_scan.read_known(spark, str(tmp_path))
    got = license_scan.license_scan(spark, spark.createDataFrame([(1, "DO as you like; but\nsay so!"), (2, mit)], "doc_id int, text string"), own).orderBy("doc_id").collect()
    assert [r.license_id for r in got] == ["own-1.0", None]


def test_known_texts_in_sql(spark):
    """Every known text in three layouts, by the SQL's own rule."""
    rows = []
    for name, text in license_scan.KNOWN:
        whole = " ".join(text.split())
        rows += [(name, text), (name, whole.upper()), (name, "Copyright (c) 2020 Some One\n\n" + text.replace("\n\n", "\n"))]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "doc_id int, expected string, text string").toPandas()
    with duckdb.connect() as con:
        con.register("documents", df)
        got = dict(con.sql(f"SELECT doc_id, license_id FROM ({license_scan.oracle_sql()})").fetchall())
    assert [got[i] for i in df.doc_id] == df.expected.tolist()


def test_licenses_wrapped_at_any_width(spark):
    """Body lines that wrapping lets begin with 'copyright' stay; notices go, also in front of a text on one line."""
    notices = ["", "Copyright (c) 2020 J. R. Smith and Foo Inc. All rights reserved.", "\u00a9 2019-2021, Some One <a@b.org>", "(C) Copyright 2001 Some One.", "Copyright Some One"]
    texts = []
    for n, (name, text) in enumerate(license_scan.KNOWN):
        whole = " ".join(text.split())
        for width in (*range(16, 121, 4), 10**6):
            lines = lambda x: textwrap.fill(x, width, break_long_words=False, break_on_hyphens=False)
            paragraphs = [lines(x) for x in text.split("\n\n")]
            texts += [(name, lines(whole)), (name, "\n\n".join([notices[(n + width) % 5], *paragraphs]).strip()), (name, "\r\n\r\n".join([notices[1], *(x.replace("\n", "\r\n") for x in paragraphs)]))]
        texts += [(name, f"{notice} {whole}") for notice in notices[:2]] + [(name, f"{notice}\n{notices[3]}\nAll rights reserved.\n\n{text}") for notice in notices]
    texts += [("MIT", "MIT License\nCopyright Some One\n\n" + dict(license_scan.KNOWN)["MIT"].split("\n\n", 1)[1])]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(texts)], "doc_id int, expected string, text string")
    assert [(r.expected, r.text) for r in license_scan.license_scan(spark, df).where("license_id is distinct from expected").collect()] == []
    kept = ["x\ncopyright law of 1976", "copyright holders may act", "4. You must\n(c) retain, in the form, all notices", "keep\nCopyright notice 2020 or\nleave"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(kept)], "doc_id int, text string")
    got = license_scan.license_scan(spark, df).orderBy("doc_id").collect()
    assert [r.canonical_chars for r in got] == [len(re.sub("[^a-z0-9]+", " ", x.lower())) for x in kept]


def test_licenses_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted(map(tuple, license_scan.op3_license_scan(spark, sf).collect()), key=str)
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW documents AS FROM '{sf}/documents.parquet'")
        assert got == sorted(con.sql(license_scan.oracle_sql()).fetchall(), key=str)


def base_rules(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    counts = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = [False] * len(w)
    for i in range(len(w) - 7):
        if counts[tuple(w[i : i + 8])] > 1:
            hit[i : i + 8] = [True] * 8
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), sum(hit)


def gram_buckets(text, buckets):
    w, signed = words(text), lambda h: h - 2**64 if h >= 2**63 else h
    one = [xxhash.xxh64_intdigest(x.encode(), 42) for x in w]
    two = [xxhash.xxh64_intdigest(b.encode(), h) for h, b in zip(one, w[1:], strict=False)]
    return [signed(h) % buckets for h in one + two]


def test_quality(spark, docs, rows):
    import math

    ids = [5, 7, 9, 403, 10**6]
    trusted = spark.createDataFrame([(i,) for i in [*ids, 5, None]], "doc_id long")
    got = quality_rules.quality(spark, docs, trusted, buckets=256).collect()
    n, t = Counter(), Counter()
    for i, text, _ in rows:
        b = gram_buckets(text, 256)
        n.update(b)
        t.update(b if i in ids else [])
    weight = {b: math.log((t[b] + 1) / (t.total() + 256)) - math.log((n[b] + 1) / (n.total() + 256)) for b in range(256)}
    expected = []
    for i, text, _ in rows:
        rules, b = base_rules(text), gram_buckets(text, 256)
        score = sum(weight[x] for x in b) / len(b) if b else 0.0
        failed = rules[0] < 20 or 100 * rules[4] > 30 * rules[0]
        bound = -(quality_rules.RATE + quality_rules.SAMPLING / t.total() ** 0.5 + quality_rules.ALLOWANCE / (2 * rules[0] - 1))
        expected.append((i, *rules, round(score, 9), failed, not failed and score >= bound))
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, round(r.score, 9), r.base_failed, r.kept) for r in got) == Counter(expected)


def test_quality_without_trust_or_rows(spark, docs, empty):
    nobody = spark.createDataFrame([], "doc_id long")
    assert {r.score for r in quality_rules.quality(spark, docs, nobody).collect()} == {0.0}
    assert quality_rules.quality(spark, empty, nobody).count() == 0


def test_quality_counts_every_trusted_document(spark):
    """More trusted ids than the former bound of 20,000, by shuffle; documents without an id and repeated ids are counted as they are."""
    n = 25_000
    docs = spark.range(n).select("id", F.concat_ws(" ", F.lit("alpha"), F.concat(F.lit("w"), F.col("id") % 50)).alias("text"))
    docs = docs.unionByName(docs.where("id < 100")).unionByName(spark.range(70).select(F.lit(None).cast("long").alias("id"), F.lit("beta gamma").alias("text")))
    trusted = spark.range(n - 1000).unionByName(spark.range(5))
    scratch = quality_rules.Scratch(spark, "quality")
    _, target = quality_rules.gram_weights(spark, scratch, docs, trusted, "id", "text", 64)
    # three n-grams a text: two words and a pair
    assert target == 3 * (n - 1000 + 100)
    counts = spark.read.parquet(f"{scratch.root}/counts").agg(F.sum("n"), F.sum("t")).first()
    assert tuple(counts) == (3 * (n + 170), target)


def test_quality_by_shuffle_equals_broadcast(spark, docs, monkeypatch):
    trusted = spark.createDataFrame([(i,) for i in [5, 7, 9, 403, 10**6, None]], "doc_id long")
    result = lambda: Counter((r.doc_id, r.score, r.kept) for r in quality_rules.quality(spark, docs, trusted).collect())
    few = result()
    monkeypatch.setattr(quality_rules, "BROADCAST_ROWS", 1)
    assert result() == few


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(2)
    bad = ["vileword", "nastyterm", "foulspeak", "gruesome"]
    out = []
    for i in range(900):
        w = prose(rng, rng.randrange(40, 160), 300).replace("w", "wort").split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(max(2, len(w) // 25)):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        out.append((i, " ".join(w), int(toxic)))
    return out


def test_toxicity_on_held_out_rows(spark, labelled):
    df = spark.createDataFrame(labelled, "doc_id long, text string, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(spark, df.select("doc_id", "text"), df.select("doc_id", "toxic")).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for i, r in got.items())
    held = [(y, got[i].predicted) for i, _, y in labelled if got[i].held_out]
    bad, good = [p for y, p in held if y], [p for y, p in held if not y]
    assert sum(bad) >= 0.9 * len(bad) and sum(good) <= 0.05 * len(good)


def test_score_is_what_the_docstring_says(spark, labelled):
    """The score of each text, made again from the dictionaries with plain zstandard calls."""
    import math

    import zstandard

    df = spark.createDataFrame(labelled, "doc_id long, text string, toxic int")
    model = toxicity.learn(spark, df.select("doc_id", "text"), df.select("doc_id", "toxic"))

    def packed(content, window):
        use = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        options = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        return len(zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=use, **options).compress(window + content[-64:]))

    assert len(model.pairs) == toxicity.PAIRS and {len(d) for pair in model.pairs for d in pair} == {toxicity.CLASS_BYTES + toxicity.BASE_BYTES}
    score = model.scorer()
    for _, text, _ in labelled[:40]:
        w = re.sub(r"[\W_]+", " ", text.lower()).strip().encode().split()
        windows = [b" " + b" ".join(w[i : i + 6]) + b" " for i in range(0, len(w), 6)]
        saved = [sum(max(0, packed(o, x) - packed(t, x)) for t, o in model.pairs) / len(model.pairs) for x in windows]
        z = (sum(saved) - model.mean * len(saved)) / math.sqrt(model.variance * (len(saved) + 1))
        assert score(text) == pytest.approx(1 / (1 + math.exp(-(model.slope * (z - model.cut) + math.log(0.7 / 0.3)))), abs=1e-9)


def test_toxicity_by_language(spark):
    """Figures that the README reports, on held-out rows of sf0.1."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = labels.join(toxicity.op6_toxicity(spark, sf).where("held_out"), "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    by = {(r.lang, r.toxic): (r.n, r.p) for r in rows.groupBy("lang", "toxic").agg(F.count("*").alias("n"), F.avg("predicted").alias("p")).collect()}
    print({k: (n, round(p, 3)) for k, (n, p) in sorted(by.items())})
    caught = sum(n * p for (_, y), (n, p) in by.items() if y) / sum(n for (_, y), (n, _) in by.items() if y)
    alarms = sum(n * p for (_, y), (n, p) in by.items() if not y) / sum(n for (_, y), (n, _) in by.items() if not y)
    assert caught > 0.4 and alarms < 0.03 and by["en", 1][1] > 0.7


def test_toxicity_learns_nothing_from_held_out_rows(spark, labelled):
    df = spark.createDataFrame(labelled, "doc_id long, text string, toxic int")
    labels = df.select("doc_id", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")).alias("toxic"))
    a, b = (sorted((r.doc_id, r.score) for r in toxicity.toxicity(spark, df.select("doc_id", "text"), x).collect()) for x in (df.select("doc_id", "toxic"), labels))
    assert a == b


def test_toxicity_odd_rows(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, None), (None, 1), (4, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(spark, docs, labels)
    assert got.count() == docs.count()
    assert all(r.predicted == 0 for r in got.where("trim(coalesce(text, '')) = ''").collect())
    assert {r.score for r in toxicity.toxicity(spark, docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(spark, empty, labels).count() == 0


def test_a_repeated_id_does_not_fill_the_sample(spark, labelled, monkeypatch):
    """One labelled id that comes more often than the sample has places: the model is that of the rows without it."""
    df = spark.createDataFrame(labelled, "doc_id long, text string, toxic int")
    labels = df.select("doc_id", "toxic")
    learned = next(i for i, _, y in labelled if y == 0 and zlib.crc32(str(i).encode()) % 3 != 1)
    again = spark.range(9000).select(F.lit(learned).cast("long").alias("doc_id"), F.concat(F.lit("zz later "), F.col("id")).alias("text"))
    docs = df.select("doc_id", "text")
    score = lambda d: {(r.doc_id, r.text): r.score for r in toxicity.toxicity(spark, d, labels).collect()}
    plain, widened = score(docs), score(docs.unionByName(again))
    assert max(plain.values()) > 0.7 and all(widened[k] == v for k, v in plain.items())


def test_the_sample_is_bounded_in_bytes(spark, labelled, monkeypatch):
    df = spark.createDataFrame(labelled, "doc_id long, text string, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "Model", lambda bad, good, each, bags: seen.append((bad, good)))
    for most in (64 << 20, 20_000):
        monkeypatch.setattr(toxicity, "SAMPLE_BYTES", most)
        toxicity.learn(spark, df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    (bad, good), (less_bad, less_good) = seen
    assert len(bad) == sum(y for i, _, y in labelled if zlib.crc32(str(i).encode()) % 3 != 1)
    for some, all_ in ((less_bad, bad), (less_good, good)):
        assert 0 < len(some) < len(all_) and some == all_[: len(some)] and sum(map(len, some)) <= 20_000


#: Names that operators work with; the engine's own lists of columns are added in the test.
WORKING = ["_content", "_form", "_m", "_weights", "_source", "_order", "_row", "_shard", "_lo", "_texts", "_toxic", "_nd_row", "_nd_d1", "_nd_top", "rows", "given", "shard_size", "weight", "rank", "row", "key", "content", "root", "best", "sig", "bands", "group", "party", "parts2", "given_0", "given_1", "given_2", "chunk", "blob", "slot", "words", "id", "trusted", "held"]


def test_working_names_pass_through(spark, rows):
    from gatewright.llm import near_duplicates, periodic_runs, sharding, source_mix, substring_dedup, token_counts

    import public_tokenizers

    plain = spark.createDataFrame(rows[:80], "doc_id long, text string, source string")
    clash = plain.withColumns({c: F.lit(c) for c in WORKING})
    path = public_tokenizers.path("byte_bpe_50k.json")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    trusted = spark.createDataFrame([(5,), (7,)], "doc_id long")
    operators = {
        "dedup": lambda d: substring_dedup.substring_dedup(spark, d),
        "counts": lambda d: token_counts.token_counts(spark, d, path),
        "licences": lambda d: license_scan.license_scan(spark, d),
        "quality": lambda d: quality_rules.quality(spark, d, trusted),
        "toxicity": lambda d: toxicity.toxicity(spark, d, labels),
        "mix": lambda d: source_mix.mix(spark, d),
        "taken": lambda d: source_mix.taken_texts(source_mix.mix(spark, d)),
        "near": lambda d: near_duplicates.near_duplicates(spark, d),
        "runs": lambda d: periodic_runs.periodic_runs(spark, d),
        "shards": lambda d: sharding.balanced(spark, d).drop("slot"),
    }
    for name, run in operators.items():
        got = run(clash)
        found = got.collect()
        gone = {"slot"} if name == "shards" else set()
        assert found and all(r[c] == c for r in found for c in WORKING if c not in gone), name
        bare = run(plain)
        kept = [c for c in bare.columns if c not in ("spans", "parts", "runs") and not (c in ("target", "source_size", "taken") and name == "mix")]
        as_text = lambda rs: Counter(str([r[c] for c in kept]) for r in rs)
        if name not in ("mix", "taken"):  # where null ids are told apart by their place
            assert as_text(found) == as_text(bare.collect()), name
