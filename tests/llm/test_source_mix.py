from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatewright.llm import source_mix
from gatewright.llm.scratch import Scratch

from .conftest import words


def quotients(votes, seats, most):
    given = [0] * len(votes)
    for _ in range(seats):
        free = [(votes[i] / (2 * given[i] + 1), -i) for i in range(len(votes)) if given[i] < most[i] and votes[i] > 0]
        if not free:
            break
        given[-max(free)[1]] += 1
    return given


def water(sizes, weights, share, most):
    """Targets, one source after the other."""
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while free:
        part = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        above = {i for i in free if part[i] > most * sizes[i]}
        for i in above or free:
            out[i] = most * sizes[i] if above else part[i]
        if not above:
            break
        left -= sum(out[i] for i in above)
        free -= above
    return out


@pytest.mark.parametrize("ranked", [5, 20_000])
def test_highest_quotients(spark, monkeypatch, ranked):
    rng = np.random.default_rng(8)
    parties, seats, expected = [], [], {}
    for g in range(60):
        n = int(rng.integers(1, 12))
        votes, most = rng.integers(0, 50, n).astype(float), rng.integers(0, 30, n)
        parties += [(str(g), str(i), float(v), int(m)) for i, (v, m) in enumerate(zip(votes, most, strict=True))]
        seats.append((str(g), int(rng.integers(0, 200))))
        expected[str(g)] = votes, quotients(votes, seats[-1][1], most)
    monkeypatch.setattr(source_mix, "RANKED", ranked)  # with passes, and without
    out = source_mix.apportion(Scratch(spark, "test"), spark.createDataFrame(parties, "group string, party string, votes double, most long"), spark.createDataFrame(seats, "group string, seats long"), "x", 3)
    got = defaultdict(dict)
    for r in out.collect():
        got[r.group][int(r.party)] = r.given
    for g, (votes, given) in expected.items():
        mine = [got[g][i] for i in range(len(votes))]
        assert sum(mine) == sum(given) and sorted(v / (2 * k + 1) for v, k in zip(votes, mine, strict=True)) == pytest.approx(sorted(v / (2 * k + 1) for v, k in zip(votes, given, strict=True)))


def test_targets(spark):
    def got(*rows):
        df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "i int, size double, weight double")
        return [r.target for r in source_mix.targets(df, 1.5, 2.0).orderBy("i").collect()]

    assert got((10, 3), (100, 1), (100, 2)) == pytest.approx([20, 295 / 3, 590 / 3])
    assert got((10, 3), (1000, 1)) == pytest.approx([20, 1495])
    assert got((0, 1), (0, 1)) == [0, 0]
    rng = np.random.default_rng(1)
    rows = [(int(rng.integers(0, 10 ** rng.integers(1, 6))), (3, 1, 2)[i % 3]) for i in range(40)]
    assert got(*rows) == pytest.approx(water(*zip(*rows, strict=True), 1.5, 2.0))


def test_rank_over_partitions(spark):
    df = spark.range(1000).select(F.concat(F.lit("k"), F.xxhash64("id").cast("string")).alias("k"))
    got = source_mix.ranked(Scratch(spark, "test"), df.repartition(7), "k", "r").collect()
    assert {r.k: r["rank"] for r in got} == {k: i for i, k in enumerate(sorted(r.k for r in got))} and len(got) == 1000


def hashed(spark, *columns):
    """xxhash64 of rows of values, as Spark computes it."""
    return lambda rows: [r[0] for r in spark.createDataFrame(rows, columns[0]).select(F.xxhash64(*columns[1])).collect()]


@pytest.mark.parametrize("options", [{}, {"shard_rows": 20, "block": 7}])
def test_placement(spark, docs, rows, options):
    """Every document's words against blocks laid out one by one."""
    block, per_shard, seed = options.get("block", source_mix.BLOCK), options.get("shard_rows", source_mix.SHARD_ROWS), 7
    got = source_mix.mix(spark, docs, **options).collect()
    again = source_mix.mix(spark, docs.repartition(5), **options).collect()
    key = lambda r: (r.doc_id, r.text, r.source, r.size, r.source_size, r.target, r.taken, tuple(map(tuple, r.parts)))
    assert Counter(map(key, got)) == Counter(map(key, again)) and got[0].chunk == "x"
    assert Counter((r.doc_id, r.text, r.size) for r in got) == Counter((i, t, len(words(t))) for i, t, _ in rows)
    # sources, targets, quotas
    by = defaultdict(list)
    content = hashed(spark, "t string", [F.coalesce("t", F.lit(""))])([(t,) for _, t, _ in rows])
    order = hashed(spark, "s int, i long, c long", ["s", "i", "c"])([(seed, i, c) for (i, _, _), c in zip(rows, content, strict=True)])
    shard_hash = hashed(spark, "s int, o long", ["s", "o"])([(seed + 1, o) for o in order])
    for (i, t, s), c, o, h in zip(rows, content, order, shard_hash, strict=True):
        by["1" if s is None else "0" + s].append((o, c, i, t, h))
    names = sorted(by)
    sizes = [sum(len(words(d[3])) for d in by[s]) for s in names]
    target = dict(zip(names, water(sizes, [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5, 2.0), strict=True))
    quota = dict(zip(names, quotients([target[s] for s in names], round(sum(target.values()) / block), [-(-2 * n // block) for n in sizes]), strict=True))
    taken = Counter()
    for s in names:
        shards = defaultdict(list)
        for d in by[s]:
            shards[d[4] % -(-len(by[s]) // per_shard)].append(d)
        ids = sorted(shards)
        votes = [sum(len(words(d[3])) for d in shards[k]) for k in ids]
        given = dict(zip(ids, quotients(votes, quota[s], [-(-2 * v // block) for v in votes]), strict=True))
        if len(set(votes)) < len(votes) and len(ids) > 1:
            continue  # equal shards may change places
        first = dict(zip(ids, hashed(spark, "a int, b string, c long", ["a", "b", "c"])([(seed + 2, s, k) for k in ids]), strict=True))
        for k in ids:
            stream = [(i, t, s) for _, _, i, t, _ in sorted(shards[k], key=lambda d: d[:2]) for _ in words(t)]
            n = -(-len(stream) // block)
            cut = [stream[x * block : (x + 1) * block] for x in range(n)]
            for b in range(given[k] if n else 0):
                taken.update(cut[b % n if b < given[k] // n * n else (first[k] + b) % n])
    mine, name = Counter(), lambda source: "1" if source is None else "0" + source
    for r in got:
        mine[r.doc_id, r.text, name(r.source)] += r.taken
        assert 0 <= r.taken <= 2 * r.size and r.target == pytest.approx(target[name(r.source)])
    for k in taken:
        assert mine[k] == taken[k]
    total = Counter()
    for (_, _, s), n in mine.items():
        total[s] += n
    for s, n in zip(names, sizes, strict=True):
        assert abs(total[s] - target[s]) <= block * (1 + 2 * -(-len(by[s]) // per_shard)) and {r.source_size for r in got if name(r.source) == s} == {n}


def test_taken_texts(spark, docs):
    mixed = source_mix.mix(spark, docs)
    rows = mixed.collect()
    out = source_mix.taken_texts(mixed)
    got = out.collect()
    assert sum(len(words(r.text)) for r in got) == sum(r.taken for r in rows) and "source" in out.columns
    whole, texts = Counter(), Counter(" ".join(words(r.text)) for r in got)
    for r in rows:
        w = words(r.text)
        some = [x for p in r.parts for x in w[p.start : p.start + p.length]]
        times = (r.taken - len(some)) // max(1, r.size) + (len(some) == r.size)
        whole[" ".join(w)] += times if r.taken else 0
        if 0 < len(some) < r.size:
            whole[" ".join(some)] += 1
    assert texts == +whole


def test_no_words_and_nothing(spark, empty):
    assert source_mix.mix(spark, empty).count() == 0
    none = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in source_mix.mix(spark, none).collect()] == [(0, 0.0, 0)] * 2


def test_rows_alike_fill_many_shards(spark):
    """20,000 rows without an id and with one text: no shard has more than a few times the rows of the others, and any layout gives the same rows."""
    alike = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b c d").alias("text"), F.lit("s").alias("source"))
    others = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("w"), F.col("id"), F.lit("x y")).alias("text"), F.lit("s").alias("source"))
    docs = alike.unionByName(others)
    scratch = source_mix.Scratch(spark, "test")
    sized = docs.withColumns({"_order": F.xxhash64("doc_id", "text"), "_at": F.monotonically_increasing_id()})
    sizes = sorted(r["count"] for r in source_mix.apart(scratch, scratch.table(sized, "sized"), 512).groupBy("_order").count().collect())
    assert sizes[-1] == 512 and sum(sizes) == 22_000 and len(sizes) == 2000 + 40
    rows = lambda d: Counter((r.doc_id, r.text, r.taken, tuple(map(tuple, r.parts))) for r in source_mix.mix(spark, d).collect())
    assert rows(docs.repartition(3)) == rows(docs.repartition(7))
