"""Hand-made cases for ranking, checks, recovery and abstention."""

import json

import pytest
from pyspark.sql import functions as F

from gatewright.functions import scoring
from gatewright.functions.encoder import encode, onnx_encoder
from gatewright.operators import evaluate, policy, rank, recover, state
from gatewright.sources.tables import ARG, CONTRACT

REQUEST = "request_id long, objective_vec array<float>"
TOOL = "tool_id string, tool_vec array<float>"


def ranked(spark, requests, tools, legal, k=3):
    legal = spark.createDataFrame(legal, "request_id long, tool_id string")
    found = rank.candidates(spark.createDataFrame(requests, REQUEST), spark.createDataFrame(tools, TOOL), legal)
    return sorted((r.request_id, r.rk, r.tool_id, r.score) for r in rank.rank(rank.score_vectors(found), k).collect())


def test_rank_ties_nulls_and_few_tools(spark):
    tools = [("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0]), ("d", [-1.0, 0.0]), ("e", None), ("f", [1.0])]
    legal = [(1, t) for t in "abcdef"] + [(2, "c")] + [(3, "e"), (3, "nowhere")]
    got = ranked(spark, [(1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, [1.0, 1.0]), (4, [1.0, 1.0]), (5, None)], tools, legal)
    assert got == [(1, 1, "a", 1.0), (1, 2, "b", 1.0), (1, 3, "c", 0.0), (2, 1, "c", 0.5)]


def test_rank_of_empty_tables(spark):
    assert ranked(spark, [], [("a", [1.0])], []) == []


def test_words(spark):
    asked = spark.createDataFrame([(1, "Read the File"), (2, None), (3, "nothing here")], "request_id long, t string")
    tools = spark.createDataFrame([("x", "read file"), ("y", "the the"), ("z", None)], "tool_id string, d string")
    legal = spark.createDataFrame([(i, t) for i in (1, 2, 3) for t in "xyz"], "request_id long, tool_id string")
    got = {(r.request_id, r.tool_id): r.score for r in rank.score_words(asked, tools, legal, "t", "d").collect()}
    assert got == {(1, "x"): 0.666667, (1, "y"): 0.333333}


def test_readiness(spark):
    df = spark.createDataFrame([(["a"], ["a"]), ([], ["a"]), (None, ["a"]), (None, None), (["a"], None)], "s array<string>, p array<string>")
    assert [r[0] for r in df.select(scoring.readiness(F.col("s"), F.col("p"))).collect()] == [True, False, False, True, True]


ARGS = [("n", "int", True, 0.0, 9.0), ("s", "string", False, None, None), ("x", "number", False, -1.0, 1.0), ("b", "boolean", False, None, None)]


@pytest.mark.parametrize(
    "given, faults",
    [
        ('{"n": 1}', []),
        ('{"n": 0, "s": "q", "x": 0.5, "b": true}', []),
        ('{"n": 1, "x": 1}', []),
        ("{n", ["bad_json"]),
        ("null", ["bad_json"]),
        (None, ["bad_json"]),
        ("[1]", ["bad_json"]),
        ("{}", ["missing:n"]),
        ('{"n": null}', ["missing:n"]),
        ('{"n": 1.5}', ["type:n"]),
        ('{"n": "1"}', ["type:n"]),
        ('{"n": 10}', ["range:n"]),
        ('{"n": -1}', ["range:n"]),
        ('{"n": 99999999999}', ["range:n"]),
        ('{"n": 1, "s": 2, "x": "a", "b": 0}', ["type:s", "type:x", "type:b"]),
        ('{"n": 1, "z": 2, "y": 3}', ["unknown:y", "unknown:z"]),
    ],
)
def test_arguments(spark, given, faults):
    from gatewright.functions.arguments import argument_faults

    df = spark.createDataFrame([(given, ARGS)], f"j string, c array<{ARG}>")
    assert df.select(argument_faults(F.col("j"), F.col("c"))).first()[0] == faults


@pytest.fixture(scope="module")
def verdicts(spark):
    registry = spark.createDataFrame([("edit", ["inspect", "open"], ["write"], [("k", "int", True, None, None)]), ("look", None, None, None), ("off", [], [], [])], CONTRACT)
    legal = spark.createDataFrame([(1, "edit"), (1, "look"), (1, "ghost")], "session_id long, tool_id string")
    calls = [
        (1, 1, "look", "{}", None, None),
        (2, 1, "ghost", "{}", [], []),
        (3, 1, "off", "{}", [], []),
        (4, 1, "edit", '{"k": 1}', ["open", "inspect"], ["write"]),
        (5, 1, "edit", '{"k": 1}', ["open"], ["write"]),
        (6, 1, "edit", "{}", [], []),
        (7, 1, "edit", '{"k": 1}', ["open", "inspect"], None),
        (8, 2, "look", "{}", [], []),
        (9, 1, None, None, None, None),
    ]
    calls = spark.createDataFrame(calls, "call_id long, session_id long, tool_id string, args_json string, state array<string>, allowed array<string>")
    return {r.call_id: r for r in policy.check(calls, registry, legal).collect()}


def test_verdicts(verdicts):
    assert {i: (r.accepted, r.reasons) for i, r in verdicts.items()} == {
        1: (True, []),
        2: (False, ["unknown"]),
        3: (False, ["illegal"]),
        4: (True, []),
        5: (False, ["prerequisites"]),
        6: (False, ["arguments", "prerequisites", "effects"]),
        7: (False, ["effects"]),
        8: (False, ["illegal"]),
        9: (False, ["unknown"]),
    }


def test_repair(verdicts):
    assert verdicts[1].repair is None
    shape = json.loads(verdicts[6].repair)
    assert shape["reason"] == "arguments" and shape["faults"] == ["missing:k"] and shape["missing"] == ["inspect", "open"] and shape["disallowed"] == ["write"]
    assert [(a["name"], a["type"], a["required"]) for a in shape["args"]] == [("k", "int", True)]


def test_recovery(spark):
    scored = spark.createDataFrame([(1, t, s) for t, s in zip("abcde", [0.9, 0.8, 0.7, 0.6, 0.5], strict=True)] + [(2, "a", 0.1)], "request_id long, tool_id string, score double")
    got = lambda d: [(r.request_id, r.tool_id) for r in recover.recover(scored, spark.createDataFrame(d, "request_id long, tool_id string")).orderBy("request_id", "rk").collect()]
    assert got([(1, "a")]) == [(1, "b"), (1, "c"), (1, "d"), (2, "a")]
    assert got([(1, t) for t in "abcde"] + [(2, "never offered"), (None, None)]) == [(2, "a")]


def test_abstention(spark):
    requests = spark.createDataFrame([(1,), (2,), (3,), (4,)], "request_id long")
    found = spark.createDataFrame([(1, 1, "a", 0.5), (2, 1, "a", 0.1), (3, 1, "a", 0.15)], "request_id long, rk int, tool_id string, score double")
    got = {r.request_id: r.outcome for r in recover.outcome(requests, found, 0.15).collect()}
    assert got == {1: "offer", 2: "low_confidence", 3: "offer", 4: "no_tool"}


def test_state(spark):
    log = spark.createDataFrame([(2, 1, 5, "b"), (1, 1, 5, "a"), (3, 1, 9, None), (4, 1, 10, "a"), (5, None, 1, "a"), (6, 2, 1, "c")], "call_id long, session_id long, ts int, tool_id string").withColumn("ts", F.timestamp_seconds("ts"))
    got = {r.call_id: r.state for r in state.before(log).collect()}
    assert got == {1: [], 2: ["a"], 3: ["a", "b"], 4: ["a", "b"], 5: [], 6: []}
    assert {r.session_id: r.facts for r in state.fold(log).where("session_id IS NOT NULL").collect()} == {1: ["a", "b"], 2: ["c"]}


def test_as_of_over_days(spark):
    day = 86400
    log = spark.createDataFrame([(1, 1, 5, 10), (2, 1, day, None), (3, 1, day + 1, 20), (4, 1, day + 2, None), (5, 1, 5 * day, None)], "call_id long, session_id long, ts int, v int").withColumn("ts", F.timestamp_seconds("ts"))
    assert {r.call_id: r.o for r in state.as_of(log, "v", "o").collect()} == {1: None, 2: 10, 3: 10, 4: 20, 5: 20}


def test_recall_and_menu(spark):
    pairs = spark.createDataFrame([("a", "x")] * 3 + [("a", "y")] * 2 + [("b", "z")], "current string, next string")
    r = evaluate.recall_and_mrr(pairs, 1).first()
    assert (r.pairs, r.recall, r.mrr) == (6, 0.666667, 0.666667)
    tools = spark.createDataFrame([("a", "1234"), ("b", "12345678"), ("c", None)], "tool_id string, d string")
    offered = spark.createDataFrame([(1, 1, "a", 0.5), (2, 1, "a", 0.5), (2, 2, "c", 0.5)], "request_id long, rk int, tool_id string, score double")
    assert tuple(rank.menu_reduction(offered, tools, "d").first()) == (2, 8, 24, 0.333333)


def test_encoder_hook(spark):
    df = spark.createDataFrame([("ab",), (None,)], "t string")
    got = encode(df, "t", "v", lambda texts: [[float(len(t)), 1.0] for t in texts]).collect()
    assert [r.v for r in got] == [[2.0, 1.0], [0.0, 1.0]]
    assert callable(onnx_encoder("no-such-file.onnx", lambda texts: {}))


def test_menu_without_descriptions(spark):
    tools = spark.createDataFrame([("a", None), ("b", "")], "tool_id string, d string")
    offered = spark.createDataFrame([(1, 1, "a", 0.5)], "request_id long, rk int, tool_id string, score double")
    assert tuple(rank.menu_reduction(offered, tools, "d").first()) == (1, 0, 0, None)
    assert rank.menu_reduction(offered.limit(0), tools, "d").first().share is None


def test_words_only_of_legal_tools(spark):
    requests = spark.createDataFrame([(1, "a b c"), (2, None), (3, "x")], "request_id long, t string")
    tools = spark.createDataFrame([("p", "a b"), ("q", "a b c"), ("r", None)], "tool_id string, d string")
    legal = spark.createDataFrame([(1, "p"), (1, "r"), (2, "p"), (3, "q")], "request_id long, tool_id string")
    assert [tuple(r) for r in rank.score_words(requests, tools, legal, "t", "d").collect()] == [(1, "p", 0.666667)]


def test_rank_follows_facts(spark):
    found = spark.createDataFrame([(1, "edit", ["open"], ["open", "lock"]), (1, "open", ["open"], []), (2, "edit", None, None), (3, "edit", ["lock", "open"], ["open", "lock", "open"])], "request_id long, tool_id string, facts array<string>, prereqs array<string>")
    got = {(r.request_id, r.tool_id): (r.rk, r.score, r.ready) for r in rank.rank(rank.score_state(found), keep=("ready",)).collect()}
    assert got == {(1, "edit"): (1, 0.5, False), (1, "open"): (2, 0.5, True), (2, "edit"): (1, 1.0, True), (3, "edit"): (1, 1.0, True)}


def test_next_tools_over_buckets(spark):
    day = 86400
    rows = [(1, 1, 5, "a"), (2, 1, day, None), (3, 1, day + 1, "b"), (4, 1, 5 * day, "c"), (5, None, 1, "x"), (6, None, 2, "y"), (7, 2, 1, "z")]
    log = spark.createDataFrame(rows, "call_id long, session_id long, ts int, tool_id string").withColumn("ts", F.timestamp_seconds("ts"))
    assert sorted(map(tuple, evaluate.next_tools(log).collect()), key=str) == [("b", "c"), ("x", "y"), (None, "b")]
    assert evaluate.next_tools(log.limit(0)).count() == 0


def test_clashing_columns_and_empty_tables(spark, verdicts):
    log = spark.createDataFrame([(1, 1, 1, "look", "{}"), (2, 1, 2, "look", "{}")], "call_id long, session_id long, ts int, tool_id string, args_json string").withColumn("ts", F.timestamp_seconds("ts"))
    registry, legal = spark.createDataFrame([("look", [], [], None)], CONTRACT), spark.createDataFrame([(1, "look")], "session_id long, tool_id string")
    clash = log.withColumns({c: F.lit("x") for c in ("state", "reason", "accepted", "faults", "repair")})
    got = policy.check(state.before(clash).withColumn("allowed", F.array().cast("array<string>")), registry, legal).orderBy("call_id").collect()
    assert [(r.state, r.accepted, r.reason, r.faults) for r in got] == [([], True, None, []), (["look"], True, None, [])]
    none = log.limit(0)
    assert policy.check(state.before(none).withColumn("allowed", F.array().cast("array<string>")), registry, legal).count() == 0
    assert state.as_of(none, "call_id", "o").count() == 0 and state.fold(none).count() == 0
    assert tuple(evaluate.recall_and_mrr(evaluate.next_tools(none)).first()) == (None, None, None)


def test_union_keeps_sessions_apart(spark):
    from gatewright.sources.tables import union_logs

    a = spark.createDataFrame([(1, 7, "x")], "call_id long, session_id long, tool_id string")
    got = union_logs(a=a, b=a.withColumn("ts", F.lit("2024-01-01 00:00:00"))).collect()
    assert sorted((r.log, r.call_id, r.session_id, r.tool_id, r.ts is None) for r in got) == [("a", "a-1", "a-7", "x", True), ("b", "b-1", "b-7", "x", False)]


def test_frozen(spark):
    at = lambda *c: {x: F.col(x).cast("timestamp_ntz") for x in c}
    calls = spark.createDataFrame([(1, "a", "2024-01-01 10:00:00"), (2, "a", "2024-01-02 00:00:00"), (3, "b", "2024-01-01 10:00:00"), (4, "a", None), (5, "a", "2024-01-04 00:00:00")], "call_id long, tool_id string, ts string").withColumns(at("ts"))
    freezes = spark.createDataFrame([(1, "a", "2024-01-01 00:00:00", "2024-01-02 00:00:00"), (2, "a", "2024-01-01 09:00:00", "2024-01-04 00:00:00"), (3, "b", None, "2025-01-01 00:00:00"), (4, "b", "2024-02-01 00:00:00", "2024-01-01 00:00:00")], "freeze_id int, tool_id string, since string, until string").withColumns(at("since", "until"))
    assert sorted((r.call_id, r.freeze_id) for r in policy.frozen(calls, freezes).collect()) == [(1, 1), (1, 2), (2, 2)]


def test_small_is_judged_by_bytes_without_a_job(spark):
    from gatewright.sources.tables import small

    wide = spark.range(10).withColumn("s", F.repeat(F.lit("x"), 100))
    assert "broadcast" in small(wide)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in small(wide, 10)._jdf.queryExecution().logical().toString().lower()


def test_freezes_without_end_and_clashing_names(spark):
    at = lambda *c: {x: F.col(x).cast("timestamp_ntz") for x in c}
    calls = spark.createDataFrame([(1, "a", "2024-01-01 10:00:00"), (2, "a", "2024-03-02 00:00:00")], "call_id long, tool_id string, ts string").withColumns(at("ts")).withColumns({c: F.lit("x") for c in ("bucket", "since", "a", "at", "freeze_id", "_bucket")})
    freezes = spark.createDataFrame([(1, "a", "2024-02-01 00:00:00", "9999-12-31 00:00:00"), (2, "a", "0001-01-01 00:00:00", "2024-02-01 00:00:00"), (3, "a", "2025-01-01 00:00:00", "9999-01-01 00:00:00")], "freeze_id int, tool_id string, since string, until string").withColumns(at("since", "until"))
    got = policy.frozen(calls, freezes)
    assert sorted((r.call_id, r.freeze_id, r.bucket, r.since, r["at"], r["_bucket"]) for r in got.collect()) == [(1, 2, "x", "x", "x", "x"), (2, 1, "x", "x", "x", "x")]
    assert policy.frozen(calls.limit(0), freezes).count() == 0


def test_check_passes_working_names_through(spark):
    names = ["_known", "_legal", "_contract", "_prereqs", "_effects", "call", "missing_", "prereqs", "effects", "args"]
    calls = spark.createDataFrame([(1, "look", "{}")], "session_id long, tool_id string, args_json string").withColumns({c: F.lit(c) for c in names})
    calls = calls.withColumns({"state": F.array().cast("array<string>"), "allowed": F.array().cast("array<string>")})
    registry, legal = spark.createDataFrame([("look", ["open"], [], None)], CONTRACT), spark.createDataFrame([(1, "look")], "session_id long, tool_id string")
    r = policy.check(calls, registry, legal).first()
    assert [r[c] for c in names] == names and (r.accepted, r.reasons, r.missing) == (False, ["prerequisites"], ["open"])


def test_recall_on_later_pairs(spark):
    pairs = spark.createDataFrame([("a", "x", 1)] * 3 + [("a", "y", 1)] * 2 + [("a", "y", 9), ("a", "z", 9), ("b", "x", 9), ("a", "x", 9), ("a", "x", 8), ("a", "x", None)], "current string, next string, day int")
    assert {r.day: (r.pairs, r.recall, r.mrr) for r in evaluate.recall_later(pairs, F.col("day") > 5, "day").collect()} == {9: (4, 0.5, 0.375), 8: (1, 1.0, 1.0)}
    assert tuple(evaluate.recall_later(pairs, F.col("day") > 5, k=1).first()) == (5, 0.4, 0.4)
    assert evaluate.recall_later(pairs, F.lit(False), "day").count() == 0
