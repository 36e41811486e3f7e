"""Repair plans, schemas, calibration, learned and followed rankings, on hand-made cases and against plain loops."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gatewright.functions.schemas import schema_faults
from gatewright.operators import calibrate, learn, rank, repair, rerank
from gatewright.plans import follow_up

REGISTRY = "tool_id string, prereqs array<string>"
CALLS = "call_id long, scope int, tool_id string, state array<string>"


def plans(spark, calls, registry, legal=None):
    df = spark.createDataFrame(calls, CALLS).withColumns({c: F.lit("x") for c in ("q", "steps", "blocked", "_tool", "need")})
    given = spark.createDataFrame(legal, "scope int, tool_id string") if legal is not None else None
    out = repair.repair_plans(df, spark.createDataFrame(registry, REGISTRY), given, scope="scope" if given is not None else None)
    assert out.columns == ["call_id", "scope", "tool_id", "state", "q", "_tool", "need", "reachable", "steps", "blocked"]
    got = {}
    for r in out.collect():
        assert (r.q, r._tool, r.need) == ("x", "x", "x")
        got.setdefault(r.call_id, []).append((r.reachable, r.steps, r.blocked))
    return got


def test_chain_of_ten(spark):
    chain = [("t0", None)] + [(f"t{i}", [f"t{i - 1}"]) for i in range(1, 11)]
    got = plans(spark, [(1, 0, "t10", []), (2, 0, "t10", ["t6"]), (3, 0, "t0", None), (4, 0, "t10", ["t9", None, "other"])], chain)
    assert got == {1: [(True, [f"t{i}" for i in range(10)], None)], 2: [(True, ["t7", "t8", "t9"], None)], 3: [(True, [], None)], 4: [(True, [], None)]}


def test_diamond_cycle_unknown_and_repeats(spark):
    graph = [("a", []), ("b", ["a"]), ("c", ["a", "a"]), ("d", ["c", "b", None]), ("x", ["y"]), ("y", ["x", "a"]), ("z", ["x", "b"]), ("u", ["ghost", "a"]), ("self", ["self"])]
    calls = [(1, 0, "d", []), (2, 0, "d", ["b"]), (3, 0, "z", []), (4, 0, "z", ["y"]), (5, 0, "u", []), (6, 0, "nowhere", []), (7, 0, None, []), (8, 0, "self", []), (8, 0, "self", []), (9, 0, "self", ["self"]), (None, 0, "b", ["a", "a"])]
    assert plans(spark, calls, graph) == {
        1: [(True, ["a", "b", "c"], None)],
        2: [(True, ["a", "c"], None)],
        3: [(False, None, ["x", "y"])],
        4: [(True, ["a", "x", "b"], None)],
        5: [(False, None, ["ghost"])],
        6: [(False, None, [])],
        7: [(False, None, [])],
        8: [(False, None, []), (False, None, [])],
        9: [(True, [], None)],
        None: [(True, [], None)],
    }


def test_only_legal_tools(spark):
    graph = [("a", []), ("b", ["a"]), ("c", ["b"])]
    legal = [(1, "a"), (1, "b"), (1, "c"), (2, "b"), (2, "c"), (1, "a")]
    got = plans(spark, [(1, 1, "c", []), (2, 2, "c", []), (3, 2, "c", ["a"]), (4, None, "c", []), (5, 3, "c", ["b"])], graph, legal)
    assert got == {1: [(True, ["a", "b"], None)], 2: [(False, None, ["a", "b"])], 3: [(True, ["b"], None)], 4: [(False, None, ["a", "b"])], 5: [(False, None, [])]}


def test_plans_of_random_graphs(spark):
    rng = random.Random(2)
    tools = [f"t{i}" for i in range(25)]
    graph = [(t, rng.sample(tools, rng.choice([0, 1, 1, 2, 3]))) for t in tools[:23]]
    needs = dict(graph)
    calls = [(i, 0, rng.choice(tools), rng.sample(tools, rng.randrange(6))) for i in range(120)]
    got = plans(spark, calls, graph)
    for i, _, tool, facts in calls:
        needed, front = {tool}, {tool}
        while front:
            front = {n for t in front for n in needs.get(t, []) if n not in facts} - needed
            needed |= front
        step, k = {}, 0
        while new := {t for t in needed - step.keys() if t in needs and all(n in facts or n in step for n in needs[t])}:
            step |= dict.fromkeys(new, k)
            k += 1
        expected = (True, sorted(step.keys() - {tool}, key=lambda t: (step[t], t)), None) if tool in step else (False, None, sorted(needed - step.keys() - {tool}))
        assert got[i] == [expected]
    assert plans(spark, [], graph) == {}


CASES = [
    ({"type": "object"}, "[1]", ["$:type"]),
    ({"type": "object"}, "{", ["$:json"]),
    ({"type": "object"}, None, ["$:json"]),
    ({"type": "null"}, "null", []),
    ({"type": ["null", "string"]}, '"a"', []),
    ({"type": "integer"}, "1", []),
    ({"type": "integer"}, "1.5", ["$:type"]),
    ({"type": "integer"}, "123456789012345678901", []),
    ({"type": "number"}, "1.5e3", []),
    ({"type": "boolean"}, "0", ["$:type"]),
    ({"minimum": 2, "maximum": 3}, "1", ["$:minimum"]),
    ({"minimum": 2, "maximum": 3}, "3.5", ["$:maximum"]),
    ({"exclusiveMinimum": 2, "exclusiveMaximum": 3}, "2", ["$:exclusiveMinimum"]),
    ({"exclusiveMinimum": 2, "exclusiveMaximum": 3}, "3", ["$:exclusiveMaximum"]),
    ({"minimum": 2}, '"a"', []),
    ({"minLength": 2, "pattern": "^a"}, '"b"', ["$:minLength", "$:pattern"]),
    ({"maxLength": 2}, '"abc"', ["$:maxLength"]),
    ({"pattern": "^a"}, "5", []),
    ({"enum": ["a", 1, None, True]}, '"a"', []),
    ({"enum": ["a", 1, None, True]}, "1.0", []),
    ({"enum": ["a", 1, None, True]}, "null", []),
    ({"enum": ["a", 1, None, True]}, "true", []),
    ({"enum": ["a", 1, None, True]}, "false", ["$:enum"]),
    ({"enum": ["1"]}, "1", ["$:enum"]),
    ({"enum": []}, "1", ["$:enum"]),
    ({"const": 5}, "6", ["$:const"]),
    ({"anyOf": [{"type": "string"}, {"minimum": 5, "type": "number"}]}, "3", ["$:anyOf"]),
    ({"anyOf": [{"type": "string"}, {"minimum": 5, "type": "number"}]}, "7", []),
    ({"oneOf": [{"minimum": 1}, {"minimum": 2}]}, "3", ["$:oneOf"]),
    ({"oneOf": [{"minimum": 1}, {"minimum": 2}]}, "1", []),
    ({"allOf": [{"minimum": 1}, {"maximum": 0}]}, "0.5", ["$:maximum", "$:minimum"]),
    ({"items": {"type": "integer"}}, '[1, "a", null]', ["$[1]:type", "$[2]:type"]),
    ({"minItems": 2}, "[1]", ["$:minItems"]),
    ({"maxItems": 1}, "[1, 2]", ["$:maxItems"]),
    ({"uniqueItems": True}, '[{"a": 1, "b": 2}, {"b": 2, "a": 1}]', ["$:uniqueItems"]),
    ({"uniqueItems": True}, "[1, 2]", []),
    ({"items": {"items": {"maximum": 1}}}, "[[0, 2], [], [3]]", ["$[0][1]:maximum", "$[2][0]:maximum"]),
    ({"required": ["a", "b"]}, '{"a": null}', ["$.b:required"]),
    ({"properties": {"a": {"type": "null"}}}, '{"a": null}', []),
    ({"properties": {"a": {"type": "string"}}}, '{"a": null}', ["$.a:type"]),
    ({"properties": {"a": {"type": "string"}}}, "{}", []),
    ({"properties": {"a": {"properties": {"b": {"items": {"required": ["c"]}}}}}}, '{"a": {"b": [{"c": 1}, {}, 5]}}', ["$.a.b[1].c:required"]),
    ({"properties": {"a": {}}, "additionalProperties": False}, '{"a": 1, "z": 1, "b": null}', ["$.b:unknown", "$.z:unknown"]),
    ({"additionalProperties": False}, '{"a": 1}', ["$.a:unknown"]),
    ({"additionalProperties": {"type": "integer"}}, '{"a": 1, "b": "x"}', ["$.b:type"]),
    ({"minProperties": 1}, "{}", ["$:minProperties"]),
    ({"maxProperties": 1}, '{"a": 1, "b": 2}', ["$:maxProperties"]),
    ({"properties": {"a": False}}, '{"a": 1}', ["$.a:unknown"]),
    ({"$ref": "#/$defs/n", "$defs": {"n": {"properties": {"next": {"$ref": "#/$defs/n"}, "v": {"type": "integer"}}}}}, '{"v": 1, "next": {"v": "x", "next": {"v": 2}}}', ["$.next.v:type"]),
    ({"$ref": "#/$defs/n", "$defs": {"n": {"properties": {"n": {"$ref": "#/$defs/n"}}}}}, '{"n": {"n": {"n": {"n": {"n": 1}}}}}', ["$.n.n.n.n:depth"]),
    ('{"type": "object", "title": "said of nothing"}', "{}", []),
]


def test_schema_rules(spark):
    for schema, given, expected in CASES:
        df = spark.createDataFrame([(given,)], "j string")
        assert df.select(schema_faults(F.col("j"), schema)).first()[0] == expected, (schema, given)
    with pytest.raises(ValueError):
        schema_faults(F.col("j"), {"not": {"type": "string"}})
    with pytest.raises(ValueError):
        schema_faults(F.col("j"), {"type": "text"})


def sequential(points):
    """Pool-adjacent-violators, one after the other. points: score -> (n, right)."""
    out = []
    for s in sorted(points):
        out.append([s, s, *points[s]])
        while len(out) > 1 and out[-2][3] / out[-2][2] >= out[-1][3] / out[-1][2]:
            last = out.pop()
            out[-1] = [out[-1][0], last[1], out[-1][2] + last[2], out[-1][3] + last[3]]
    return [tuple(b) for b in out]


@pytest.mark.parametrize("parts", [1, 3, 40])
@pytest.mark.parametrize("kind", ["noise", "rising", "falling", "ties"])
def test_calibration_is_that_of_a_sequential_pass(spark, parts, kind):
    rng = random.Random(parts)
    rows = []
    for _ in range(1500):
        s = rng.randrange(20) / 20 if kind == "ties" else round(rng.random(), 6)
        rows.append((s, rng.random() < {"noise": 0.5, "rising": s, "falling": 1 - s, "ties": s}[kind]))
    points = {}
    for s, r in rows:
        n, k = points.get(s, (0, 0))
        points[s] = (n + 1, k + r)
    blocks = calibrate.calibrate(spark.createDataFrame([*rows, (None, True), (0.5, None)], "score double, right boolean"), parts)
    got = [tuple(r)[:4] for r in blocks.orderBy("lo").collect()]
    assert got == sequential(points)
    for errors in (0.0, 0.3, 0.5, 1.0):
        tail = [(b[0], sum(x[2] - x[3] for x in got[i:]), sum(x[2] for x in got[i:])) for i, b in enumerate(got)]
        fits = [lo for lo, wrong, n in tail if wrong <= errors * n]
        assert calibrate.threshold(blocks, errors) == (min(fits) if fits else None)


def test_confidence(spark):
    blocks = spark.createDataFrame([(0.2, 0.4, 4, 1, 0.25), (0.5, 0.9, 4, 3, 0.75)], "lo double, hi double, n long, rights long, share double")
    scored = spark.createDataFrame([(1, 0.1), (2, 0.2), (3, 0.45), (4, 0.5), (5, 2.0), (6, None), (7, 0.45)], "i int, score double").withColumn("confidence", F.lit("x"))
    assert {r.i: r.confidence for r in calibrate.confidence(scored, blocks).collect()} == {1: 0.25, 2: 0.25, 3: 0.25, 4: 0.75, 5: 0.75, 6: None, 7: 0.25}
    none = calibrate.calibrate(scored.limit(0).withColumn("right", F.lit(True)))
    assert none.count() == 0 and calibrate.threshold(none, 0.5) is None
    assert {r.confidence for r in calibrate.confidence(scored, none).collect()} == {None}


def newton(x, y, ridge):
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        w = w - np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
    return w


def test_weights_are_those_of_numpy(spark):
    rng = random.Random(3)
    rows = [(sorted(rng.randrange(12) for _ in range(rng.randrange(6))), rng.random() < 0.3) for _ in range(600)]
    weights = learn.fit(spark.createDataFrame([*rows, (None, True)], "x array<int>, chosen boolean").repartition(5), 12)
    x = np.zeros((len(rows), 12))
    for i, (at, _) in enumerate(rows):
        np.add.at(x[i], at, 1)
    assert np.abs(weights - newton(x, np.array([float(c) for _, c in rows]), learn.RIDGE)).max() < 1e-6
    assert not learn.fit(spark.createDataFrame([], "x array<int>, chosen boolean"), 12).any()


def test_joint_scores_are_those_of_sql(spark):
    """Crosses and scores by DuckDB, from the same weights; null objectives and facts included."""
    rng = random.Random(5)
    rows = [(i, rng.choice([None, 1, 2]), rng.choice([None, [], ["a"], ["a", "b"]]), rng.choice("pq"), rng.choice([None, True, False])) for i in range(80)]
    weights = np.random.default_rng(1).standard_normal(32)
    df = spark.createDataFrame(rows, "i int, objective int, facts array<string>, tool_id string, ready boolean")
    crossed = learn.crosses(F.col("objective"), F.col("facts"), F.col("tool_id"), F.col("ready"), 32)
    got = {r.i: r.score for r in learn.score_joint(df, weights, crossed).collect()}
    con = duckdb.connect()
    given = df.toPandas()  # noqa: F841
    names = """list_concat(['tool|' || tool_id, 'kind|' || k || '|' || tool_id, 'known|' || k || '|' || len(f) || '|' || tool_id, 'ready|' || coalesce(ready, false) || '|' || tool_id], list_transform(f, lambda x: 'fact|' || x || '|' || tool_id))"""
    sql = f"""WITH a AS (SELECT i, tool_id, ready, coalesce(objective::INT::VARCHAR, 'none') AS k, coalesce(facts, []) AS f FROM given), b AS (SELECT i, unnest({names}) AS name FROM a),
w AS (SELECT unnest({weights.tolist()}) AS w, unnest(range(32)) AS n)
SELECT i, round(1 / (1 + exp(-sum(w))), 6) AS score FROM b JOIN w ON w.n = ('0x' || substr(md5(name), 1, 8))::BIGINT % 32 GROUP BY 1"""
    expected = dict(con.sql(sql).fetchall())
    assert got.keys() == expected.keys() and all(abs(got[i] - expected[i]) <= 1e-6 for i in got)


def test_joint_ranking_beats_either(spark):
    got = {r.measure: r.mrr for r in follow_up.eval_joint(spark, "/root/testdata/sf0.01").collect()}
    assert got["joint"] > got["objective"] + 0.05 and got["joint"] > got["facts"] + 0.05


def full(graph, legal, facts, k=3):
    out = set()
    for r, mine in facts.items():
        scored = []
        for t in {t for q, t in legal if q == r}:
            if t in graph:
                needs = set(graph[t] or [])
                met = len(needs & mine) / len(needs) if needs else 1.0
                scored.append((-round(met - (0.5 if t in mine else 0), 6), t))
        out |= {(r, i, t, -s) for i, (s, t) in enumerate(sorted(scored)[:k], 1)}
    return out


@pytest.mark.parametrize("reserve", [0, 1, 4])
def test_followed_lists_are_full_rankings(spark, reserve):
    rng = random.Random(reserve)
    tools = [f"t{i:02d}" for i in range(24)]
    graph = {t: rng.choice([None, rng.sample(tools, 1), rng.sample(tools, 3)]) for t in tools[:22]}
    requests = range(12)
    legal = [(r, t) for r in requests for t in rng.sample(tools, rng.choice([0, 2, 4, 20]))]
    facts = {r: set(rng.sample(tools, rng.randrange(3))) for r in requests}
    registry = spark.createDataFrame(list(graph.items()), REGISTRY)
    pairs = spark.createDataFrame(legal + legal[:5], "request_id int, tool_id string")
    lists = rerank.begin(spark.createDataFrame([(r, list(f) or None) for r, f in facts.items()], "request_id int, facts array<string>"), registry, pairs, reserve=reserve)
    offered = lambda: {tuple(r) for r in rerank.offers(lists).collect()}
    assert offered() == full(graph, legal, facts) and lists.touched == sum(t in graph for _, t in legal)
    less = 0
    for _ in range(5):
        news = [(rng.choice(requests), rng.choice([*tools, None])) for _ in range(rng.randrange(1, 6))] + [(99, "t01")]
        for r, f in news:
            if r in facts and f:
                facts[r].add(f)
        lists = rerank.follow(lists, spark.createDataFrame(news, "request_id int, fact string"), registry, pairs, reserve=reserve)
        assert offered() == full(graph, legal, facts)
        less += lists.touched < sum(t in graph for _, t in legal) / 2
    assert less == 5
    lists = rerank.follow(lists, spark.createDataFrame([], "request_id int, fact string"), registry, pairs, reserve=reserve)
    assert offered() == full(graph, legal, facts) and lists.touched == 0


def test_followed_lists_broadcast_by_rows_not_by_bytes(spark, monkeypatch):
    """Pairs take a byte or two in files, so Spark broadcast millions of them through the driver. Here no table has few rows."""
    monkeypatch.setattr(rerank, "FEW", -1)
    plans, store = [], rerank.written

    def watched(df, what):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df, what)

    registry = spark.createDataFrame([(f"t{i:02d}", [f"t{i // 2:02d}"]) for i in range(20)], REGISTRY)
    asked = store(spark.range(200).select(F.col("id").alias("request_id"), F.array().cast("array<string>").alias("facts")), "test-asked")
    legal = store(asked.select("request_id").crossJoin(registry.select("tool_id")), "test-legal")
    lists = rerank.begin(asked, registry, legal)
    monkeypatch.setattr(rerank, "written", watched)
    lists = rerank.follow(lists, asked.select("request_id", F.lit("t03").alias("fact")), registry, legal)
    assert not [p for p in plans for line in p.splitlines() if "BroadcastHashJoin" in line and "request_id" in line.partition("Build")[0]]
    assert lists.touched >= 400 and rerank.offers(lists).count() == 600


def test_dot_product_once_and_null_scores(spark):
    found = spark.createDataFrame([(1, "a", [1.0, 0.0], [1.0, 2.0]), (1, "b", [1.0, 0.0], [None, 2.0]), (1, "c", [1.0], [1.0, 2.0]), (1, "d", None, [1.0])], "request_id int, tool_id string, objective_vec array<float>, tool_vec array<float>")
    ranked = rank.rank(rank.score_vectors(found))
    assert ranked._jdf.queryExecution().optimizedPlan().toString().count("zip_with") == 1
    assert [tuple(r) for r in ranked.collect()] == [(1, 1, "a", 1.0)]


def test_generated_rows_get_no_hint(spark):
    from gatewright.sources.tables import small

    hinted = lambda df: "broadcast" in small(df)._jdf.queryExecution().logical().toString().lower()
    assert not hinted(spark.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(3_000_000)))))
    assert hinted(spark.range(9))


def test_offers_follow_a_stream(spark, tmp_path):
    from gatewright.streaming.offers import live_offers

    rng = random.Random(8)
    tools = [f"t{i:02d}" for i in range(12)]
    graph = {t: rng.sample(tools, rng.choice([0, 1, 3])) for t in tools}
    legal, facts = [(r, t) for r in range(5) for t in rng.sample(tools, 8)], {r: set() for r in range(5)}
    registry, pairs = spark.createDataFrame(list(graph.items()), REGISTRY), spark.createDataFrame(legal, "request_id int, tool_id string")
    lists = rerank.begin(spark.createDataFrame([(r, []) for r in facts], "request_id int, facts array<string>"), registry, pairs, reserve=1)
    batches = [[(rng.randrange(5), rng.choice(tools)) for _ in range(3)] for _ in range(3)]
    latest = {}
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, "request_id int, fact string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema("request_id int, fact string").parquet(f"{tmp_path}/in")
        live_offers(source, lists, registry, pairs, f"{tmp_path}/out", f"{tmp_path}/at", reserve=1, once=True).awaitTermination()
        for r, f in batch:
            facts[r].add(f)
        expected = full(graph, legal, facts)
        got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out/offers/batch={n}").collect()]
        assert set(got) == {x for x in expected if x[0] in {r for r, _ in batch}}
        latest |= {r: {x for x in got if x[0] == r} for r, _ in batch}
    assert all(latest[r] == {x for x in full(graph, legal, facts) if x[0] == r} for r in latest)
    assert {p.name for p in (tmp_path / "out" / "lists").iterdir()} == {"1", "2"}


def test_pairs_of_the_graph_are_made_in_many_tasks(spark):
    """All requests, a few bytes each, met their tools in one task."""
    asked, legal = follow_up._graph_asked(spark, "/root/testdata/sf0.01")
    for df in (asked, legal):
        assert df.select(F.spark_partition_id().alias("p")).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    rounds = follow_up.recover_followed(spark, "/root/testdata/sf0.01")
    assert rounds._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") >= 1


def test_no_sketch_a_tool_and_session(spark):
    """A distinct count beside a sketch made Spark carry one of 3 KB for each pair."""
    from gatewright.operators import evaluate

    log = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (None, "a"), (None, "b"), (3, None)], "session_id long, tool_id string")
    out = evaluate.sessions_of_tools(log)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not [p for p in plan.splitlines() if "approx_count" in p and "session_id" in p.partition("functions")[0]]
    assert {tuple(r) for r in out.collect()} == {("a", 2, True), ("b", 0, True), (None, 1, True)}


def test_small_differences_are_not_told_by_sketches(spark):
    """30,000 sessions bought and all but 300 of them clicked: sketches say so instead of an estimate that is far off."""
    from gatewright.operators import sketches

    log2 = sketches.log_for(0.05)
    log = spark.range(60_000).select((F.col("id") % 30_000).alias("session_id"), F.when(F.col("id") < 30_000, "a").otherwise("b").alias("tool_id"), F.lit("2024-01-01").cast("timestamp_ntz").alias("ts")).where("tool_id = 'a' OR session_id >= 300")
    spans = spark.sql("SELECT 1 AS span_id, DATE'2024-01-01' AS first, DATE'2024-01-02' AS last")
    merged = sketches.of_spans(sketches.daily_sketches(log, log2=log2), spans, log2)
    assert sketches.without(merged, "a", "b", 0.05, log2).first().told is False
    alone = sketches.without(merged, "a", "c", 0.05, log2).first()
    assert alone.told and abs(alone.sessions - 30_000) <= 1500
    assert log2 == 14 and 16384 >= (sketches.SIGMAS / 0.05) ** 2


def test_vectors_of_tools_are_broadcast(spark):
    """All later pairs met the tools' vectors in one task a tool, and each call carried its vector through an exchange for that."""
    _, later = follow_up._choices(spark, "/root/testdata/sf0.001")
    assert "objective_vec" not in later.columns and later.count() > 0
