"""Queries over the driver's tables, by name, with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import encoder, scoring
from ..functions.arguments import argument_faults
from ..operators import evaluate, policy, rank, recover, state
from ..sources import tables
from . import follow_up

THRESHOLD = 0.15
SCOPES = 4


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = tables.label_requests(spark, sf_dir)
    return rank.score_vectors(rank.candidates(requests, tables.label_registry(spark, sf_dir), tables.unlocked(requests))).select("request_id", "level", "tool_id", "score")


def rank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.rank(_scored(spark, sf_dir))


def rank_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.rank(_lexical(spark, sf_dir))


def _lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = tables.table(spark, sf_dir, "conversations").where("role = 'user'")
    asked = turns.select(F.concat_ws("-", "conv_id", "turn").alias("request_id"), (F.col("turn") % SCOPES).alias("scope"), "text")
    items = _items(spark, sf_dir)
    return rank.score_words(asked, items, _in_scope(asked, items), "text", "description")


def _in_scope(asked: DataFrame, items: DataFrame) -> DataFrame:
    """(request_id, tool_id): stand-in for what is legal: a turn may use the items of its scope."""
    return asked.select("request_id", "scope").join(items.select("tool_id", (F.col("tool_id") % SCOPES).alias("scope")), "scope").select("request_id", "tool_id")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("tool_id"), F.col("text").alias("description"))


def menu_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.menu_reduction(rank_lexical(spark, sf_dir), _items(spark, sf_dir), "description")


def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each call's tool was premature: relevant, but its prerequisites not yet seen."""
    calls = state.before(tables.calls(spark, sf_dir)).join(tables.small(tables.contracts(spark)), "tool_id")
    return calls.select("call_id", "tool_id", scoring.readiness(F.col("state"), F.col("prereqs")).alias("ready"))


def state_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.fold(tables.calls(spark, sf_dir)).select("session_id", F.concat_ws(",", "facts").alias("facts"))


def state_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.before(tables.calls(spark, sf_dir)).select("call_id", F.concat_ws(",", "state").alias("state"))


def state_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time of each session's last purchase before every call."""
    log = tables.calls(spark, sf_dir).withColumn("bought", F.when(F.col("tool_id") == "purchase", F.col("call_id")))
    return state.as_of(log, "bought", "last_purchase").select("call_id", "last_purchase")


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = tables.calls(spark, sf_dir)
    calls = state.before(log).withColumn("allowed", F.array(*map(F.lit, tables.ALLOWED_EFFECTS)))
    return policy.check(calls, tables.contracts(spark), tables.session_legal(log))


def _failing(reason: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _verdicts(spark, sf_dir).where(F.array_contains("reasons", reason)).select("call_id", "tool_id")

    query.__doc__ = f"Calls that fail the check for {reason}."
    return query


def check_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir).select("call_id", "accepted", "reason", F.concat_ws(",", "reasons").alias("reasons"))


def repair_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = _verdicts(spark, sf_dir).where("NOT accepted")
    shape = F.from_json("repair", "reason string, missing array<string>, args array<struct<name:string,type:string>>")
    rows = verdicts.select("call_id", shape.alias("r"))
    args = F.transform("r.args", lambda a: F.concat(a["name"], F.lit(":"), a["type"]))
    return rows.select("call_id", "r.reason", F.concat_ws(",", "r.missing").alias("missing"), F.concat_ws(",", args).alias("args"))


def verdict_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.verdict_rollup(_verdicts(spark, sf_dir))


def recover_no_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next three when the first offer was declined."""
    scored = _scored(spark, sf_dir)
    return recover.recover(scored, rank.rank(scored, 1))


def recover_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page: three more when all three were declined."""
    scored = _scored(spark, sf_dir)
    return recover.recover(scored, rank.rank(scored))


def recover_updated_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After all three were declined the state has changed: the tool of the level just below is worth 0.5 more."""
    scored = _scored(spark, sf_dir)
    changed = scored.withColumn("score", F.round(F.col("score") + F.when(F.col("tool_id") == F.col("level") - 1, 0.5).otherwise(0.0), scoring.PLACES))
    return recover.recover(changed, rank.rank(scored))


def abstain_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recover.outcome(tables.label_requests(spark, sf_dir), rank_topk(spark, sf_dir), THRESHOLD)


def eval_recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.recall_and_mrr(evaluate.next_tools(tables.calls(spark, sf_dir)))


def rank_with_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At each call, the two tools that its session may and should call next, by what it has seen, and whether each is ready."""
    log = tables.calls(spark, sf_dir)
    asked = state.before(log).select(F.col("call_id").alias("request_id"), "session_id", F.col("state").alias("facts"))
    legal = asked.select("request_id", "session_id").join(tables.session_legal(log), "session_id").select("request_id", "tool_id")
    found = rank.score_state(rank.candidates(asked, tables.contracts(spark).select("tool_id", "prereqs"), legal))
    return rank.rank(found, 2, keep=("ready",))


def rank_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shape of the baseline's probe: every embedding asks, the first hundred are the tools, and all are legal."""
    requests = tables.label_requests(spark, sf_dir).select("request_id", "objective_vec")
    tools = tables.table(spark, sf_dir, "embeddings").where("vec_id < 100").select(F.col("vec_id").alias("tool_id"), F.col("embedding").alias("tool_vec"))
    legal = requests.select("request_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(99).cast("long"))).alias("tool_id"))
    return rank.rank(rank.score_vectors(rank.candidates(requests, tools, legal)))


def legal_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with a legal tool."""
    requests = tables.label_requests(spark, sf_dir)
    return rank.with_any(requests, tables.unlocked(requests)).select("request_id")


def rank_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexical requests ranked through the encoder path, with the encoder that needs no weights."""
    turns = tables.table(spark, sf_dir, "conversations").where("role = 'user'")
    asked = turns.select(F.concat_ws("-", "conv_id", "turn").alias("request_id"), (F.col("turn") % SCOPES).alias("scope"), "text")
    items, encode = _items(spark, sf_dir), encoder.hashing_encoder()
    legal = _in_scope(asked, items)
    found = rank.candidates(encoder.encode(asked, "text", "objective_vec", encode), encoder.encode(items, "description", "tool_vec", encode), legal)
    # the first k hold all positive scores that are among them, so the filter may come last
    return rank.rank(rank.score_vectors(found)).where("score > 0")


def state_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of the sessions of two logs."""
    log = tables.union_logs(calls=tables.calls(spark, sf_dir), turns=tables.turns(spark, sf_dir))
    return state.fold(log).select("session_id", F.concat_ws(",", "facts").alias("facts"))


def check_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of arguments under a contract of three: bounds on either side, an optional one, and keys that it does not name."""
    args = [("k", "int", True, 10.0, 89.0), ("amount", "number", True, 0.0, 300.0), ("note", "string", False, None, None)]
    contract = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("type"), F.lit(r).alias("required"), F.lit(lo).cast("double").alias("min"), F.lit(hi).cast("double").alias("max")) for n, t, r, lo, hi in args])
    return tables.rich_calls(spark, sf_dir).select("call_id", F.concat_ws(",", argument_faults(F.col("args_json"), contract)).alias("faults"))


def check_frozen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls made while their tool was frozen."""
    freezes = spark.createDataFrame(FREEZES, "freeze_id int, tool_id string, since string, until string")
    freezes = freezes.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("since", "until")})
    return policy.frozen(tables.calls(spark, sf_dir), freezes).select("call_id", "freeze_id")


def verdict_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.verdict_cube(_verdicts(spark, sf_dir))


def verdicts_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.verdicts_by_window(_verdicts(spark, sf_dir), "1 day")


def verdicts_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts in windows of two days that begin each day."""
    return evaluate.verdicts_by_window(_verdicts(spark, sf_dir), "2 days", "1 day")


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of a session within six hours of each other."""
    return evaluate.visits(tables.calls(spark, sf_dir), "6 hours")


def tool_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.tool_places(tables.calls(spark, sf_dir))


def sessions_of_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.sessions_of_tools(tables.calls(spark, sf_dir))


def eval_mrr_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the tool of the level below stands among those offered, by level."""
    requests = tables.label_requests(spark, sf_dir)
    wanted = requests.where("level > 0").select("request_id", "level", (F.col("level") - 1).alias("tool_id"))
    return evaluate.mean_reciprocal_rank(rank.rank(_scored(spark, sf_dir)), wanted, "level")


def sql_offered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The engine's tables through SQL: sessions whose first call was accepted."""
    return spark.sql(
        "SELECT session_id, min_by(tool_id, ts) AS tool_id FROM {verdicts} GROUP BY session_id HAVING min_by(accepted, ts)",
        verdicts=_verdicts(spark, sf_dir).select("session_id", "ts", "tool_id", "accepted"),
    )


#: Stand-ins for times at which a tool must not be called.
FREEZES = [(1, "purchase", "2024-01-03 00:00:00", "2024-01-05 12:00:00"), (2, "click", "2024-01-05 06:00:00", "2024-01-05 18:30:00"), (3, "purchase", "2024-01-05 00:00:00", "2024-01-06 00:00:00"), (4, "view", "2024-01-09 00:00:00", "2024-01-09 00:00:00")]

QUERIES = {
    "rank_topk": rank_topk,
    "rank_lexical": rank_lexical,
    "menu_reduction": menu_reduction,
    "readiness": readiness,
    "state_fold": state_fold,
    "state_before": state_before,
    "state_asof": state_asof,
    "check_unknown": _failing("unknown"),
    "check_illegal": _failing("illegal"),
    "check_args": _failing("arguments"),
    "check_prereq": _failing("prerequisites"),
    "check_effects": _failing("effects"),
    "check_verdict": check_verdict,
    "repair_shape": repair_shape,
    "verdict_rollup": verdict_rollup,
    "recover_no_repeat": recover_no_repeat,
    "recover_page": recover_page,
    "recover_updated_state": recover_updated_state,
    "abstain_outcome": abstain_outcome,
    "eval_recall_mrr": eval_recall_mrr,
    "rank_with_state": rank_with_state,
    "rank_encoded": rank_encoded,
    "rank_probe": rank_probe,
    "legal_requests": legal_requests,
    "state_union": state_union,
    "check_contract": check_contract,
    "check_frozen": check_frozen,
    "verdict_cube": verdict_cube,
    "verdicts_per_day": verdicts_per_day,
    "verdicts_sliding": verdicts_sliding,
    "visits": visits,
    "tool_places": tool_places,
    "sessions_of_tools": sessions_of_tools,
    "eval_mrr_by_level": eval_mrr_by_level,
    "sql_offered": sql_offered,
    **follow_up.QUERIES,
}

_TOP = "row_number() OVER (PARTITION BY request_id ORDER BY score DESC, tool_id)"
_SCORED = """cells AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
means AS (SELECT label AS tool_id, pos, avg(x::DOUBLE) AS m FROM cells GROUP BY 1, 2),
scored AS (SELECT vec_id AS request_id, label AS level, tool_id, round(sum(x::DOUBLE * m), 6) AS score FROM cells JOIN means USING (pos) WHERE tool_id < label GROUP BY 1, 2, 3),
ranked AS (SELECT * FROM (SELECT *, ROWNUMBER AS rk FROM scored) WHERE rk <= 3)""".replace("ROWNUMBER", _TOP)
_WORDS = """asked AS (SELECT conv_id || '-' || turn AS request_id, turn % 4 AS scope, list_filter(list_distinct(string_split(lower(text), ' ')), lambda t: t <> '') AS a FROM conversations WHERE role = 'user'),
tools AS (SELECT item_id AS tool_id, item_id % 4 AS scope, text AS description, list_filter(list_distinct(string_split(lower(text), ' ')), lambda t: t <> '') AS b FROM benchmark),
pairs AS (SELECT request_id, tool_id, count(*) AS n, any_value(len(a)) AS na, any_value(len(b)) AS nb
FROM (SELECT *, unnest(a) AS token FROM asked) JOIN (SELECT *, unnest(b) AS token FROM tools) USING (token, scope) GROUP BY 1, 2),
words AS (SELECT * FROM (SELECT *, ROWNUMBER AS rk FROM (SELECT request_id, tool_id, round(n::DOUBLE / (na + nb - n), 6) AS score FROM pairs)) WHERE rk <= 3)""".replace("ROWNUMBER", _TOP)
_CALLS = """contract(tool_id, prereqs, effects) AS (VALUES ('view', []::VARCHAR[], []::VARCHAR[]), ('click', ['view'], ['track']), ('purchase', ['view', 'click'], ['charge']), ('signup', [], ['write'])),
seen AS (SELECT user_id, event_type AS fact, min({'ts': ts, 'id': event_id}) AS first FROM events GROUP BY 1, 2),
stated AS (SELECT e.event_id AS call_id, any_value(e.event_type) AS tool_id, any_value(e.props) AS props, any_value(e.user_id) AS session_id, e.ts,
list_sort(coalesce(list(s.fact) FILTER (s.first < {'ts': e.ts, 'id': e.event_id}), [])) AS state
FROM events e LEFT JOIN seen s ON s.user_id = e.user_id GROUP BY e.event_id, e.ts),
checked AS (SELECT call_id, session_id, ts, tool_id, c.tool_id IS NULL AS unknown, c.tool_id IS NOT NULL AND tool_id NOT IN ('view', 'click', 'purchase', 'error') AS illegal,
c.tool_id IS NOT NULL AND NOT coalesce(json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') AND (props->>'$.k')::BIGINT <= 89, false) AS arguments,
list_sort(list_filter(coalesce(c.prereqs, []), lambda p: NOT list_contains(state, p))) AS missing,
len(list_filter(coalesce(c.effects, []), lambda p: p NOT IN ('track', 'write'))) > 0 AS effects, state, c.prereqs
FROM stated LEFT JOIN contract c USING (tool_id)),
verdict AS (SELECT *, list_filter([CASE WHEN unknown THEN 'unknown' END, CASE WHEN illegal THEN 'illegal' END, CASE WHEN arguments THEN 'arguments' END,
CASE WHEN len(missing) > 0 THEN 'prerequisites' END, CASE WHEN effects THEN 'effects' END], lambda r: r IS NOT NULL) AS reasons FROM checked)"""
_RECOVER = "SELECT request_id, rk, tool_id, score FROM (SELECT *, " + _TOP + " AS rk FROM {rows}) WHERE rk <= 3"

ORACLE_SQL = {
    "rank_topk": f"WITH {_SCORED} SELECT request_id, rk, tool_id, score FROM ranked",
    "rank_lexical": f"WITH {_WORDS} SELECT request_id, rk, tool_id, score FROM words",
    "menu_reduction": f"""WITH {_WORDS}, menus AS (SELECT count(DISTINCT request_id) AS requests, sum(length(description))::BIGINT AS menu_chars FROM words JOIN tools USING (tool_id)),
registry AS (SELECT sum(length(description))::BIGINT AS chars FROM tools)
SELECT requests, menu_chars, requests * chars AS registry_chars, round(menu_chars::DOUBLE / (requests * chars), 6) AS share FROM menus, registry""",
    "readiness": f"WITH {_CALLS} SELECT call_id, tool_id, len(missing) = 0 AS ready FROM checked WHERE NOT unknown",
    "state_fold": "SELECT user_id AS session_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS facts FROM events GROUP BY 1",
    "state_before": f"WITH {_CALLS} SELECT call_id, array_to_string(state, ',') AS state FROM stated",
    "state_asof": """SELECT e.event_id AS call_id, p.event_id AS last_purchase FROM (SELECT *, ts::VARCHAR || lpad(event_id::VARCHAR, 20, '0') AS at FROM events) e
ASOF LEFT JOIN (SELECT event_id, user_id, ts::VARCHAR || lpad(event_id::VARCHAR, 20, '0') AS at FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.at > p.at""",
    **{f"check_{name}": f"WITH {_CALLS} SELECT call_id, tool_id FROM verdict WHERE list_contains(reasons, '{reason}')" for name, reason in (("unknown", "unknown"), ("illegal", "illegal"), ("args", "arguments"), ("prereq", "prerequisites"), ("effects", "effects"))},
    "check_verdict": f"WITH {_CALLS} SELECT call_id, len(reasons) = 0 AS accepted, reasons[1] AS reason, array_to_string(reasons, ',') AS reasons FROM verdict",
    "repair_shape": f"WITH {_CALLS} SELECT call_id, reasons[1] AS reason, array_to_string(missing, ',') AS missing, CASE WHEN unknown THEN '' ELSE 'k:int' END AS args FROM verdict WHERE len(reasons) > 0",
    "verdict_rollup": f"WITH {_CALLS} SELECT coalesce(tool_id, 'all') AS tool_id, coalesce(reason, 'all') AS reason, count(*) AS n FROM (SELECT tool_id, coalesce(reasons[1], 'accepted') AS reason FROM verdict) GROUP BY ROLLUP (tool_id, reason)",
    "recover_no_repeat": f"WITH {_SCORED} " + _RECOVER.format(rows="(SELECT * FROM scored ANTI JOIN (FROM ranked WHERE rk = 1) USING (request_id, tool_id))"),
    "recover_page": f"WITH {_SCORED} " + _RECOVER.format(rows="(SELECT * FROM scored ANTI JOIN ranked USING (request_id, tool_id))"),
    "recover_updated_state": f"WITH {_SCORED} " + _RECOVER.format(rows="(SELECT request_id, tool_id, round(score + CASE WHEN tool_id = level - 1 THEN 0.5 ELSE 0.0 END, 6) AS score FROM scored ANTI JOIN ranked USING (request_id, tool_id))"),
    "abstain_outcome": f"WITH {_SCORED} SELECT vec_id AS request_id, CASE WHEN best IS NULL THEN 'no_tool' WHEN best < {THRESHOLD} THEN 'low_confidence' ELSE 'offer' END AS outcome, best FROM embeddings LEFT JOIN (SELECT request_id, max(score) AS best FROM ranked GROUP BY 1) ON vec_id = request_id",
    "eval_recall_mrr": """WITH steps AS (SELECT event_type AS current, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events),
counts AS (SELECT current, next, count(*) AS n, row_number() OVER (PARTITION BY current ORDER BY count(*) DESC, next) AS rk FROM steps WHERE next IS NOT NULL GROUP BY 1, 2)
SELECT sum(n)::BIGINT AS pairs, round(sum(CASE WHEN rk <= 3 THEN n ELSE 0 END)::DOUBLE / sum(n), 6) AS recall, round(sum(CASE WHEN rk <= 3 THEN n / rk::DOUBLE ELSE 0 END) / sum(n), 6) AS mrr FROM counts""",
    "rank_with_state": f"""WITH {_CALLS}, found AS (SELECT call_id AS request_id, c.tool_id, state, c.prereqs AS needs FROM stated, contract c WHERE c.tool_id IN ('view', 'click', 'purchase')),
judged AS (SELECT request_id, tool_id, round(CASE WHEN len(needs) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(needs, state))::DOUBLE / len(needs) END - CASE WHEN list_contains(state, tool_id) THEN 0.5 ELSE 0 END, 6) AS score, len(list_intersect(needs, state)) = len(needs) AS ready FROM found)
SELECT request_id, rk, tool_id, score, ready FROM (SELECT *, {_TOP} AS rk FROM judged) WHERE rk <= 2""",
    "rank_encoded": f"""WITH asked AS (SELECT conv_id || '-' || turn AS request_id, turn % 4 AS scope, ('0x' || substr(md5(t), 1, 8))::BIGINT % 256 AS bucket FROM (SELECT *, unnest(string_split(lower(text), ' ')) AS t FROM conversations WHERE role = 'user') WHERE t <> ''),
tools AS (SELECT item_id AS tool_id, item_id % 4 AS scope, ('0x' || substr(md5(t), 1, 8))::BIGINT % 256 AS bucket FROM (SELECT *, unnest(string_split(lower(text), ' ')) AS t FROM benchmark) WHERE t <> ''),
pairs AS (SELECT request_id, tool_id, count(*)::DOUBLE AS score FROM asked JOIN tools USING (scope, bucket) GROUP BY 1, 2)
SELECT request_id, rk, tool_id, score FROM (SELECT *, {_TOP} AS rk FROM pairs) WHERE rk <= 3""",
    "rank_probe": f"""WITH pairs AS (SELECT a.vec_id AS request_id, b.vec_id AS tool_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE b.vec_id < 100)
SELECT request_id, rk, tool_id, score FROM (SELECT *, {_TOP} AS rk FROM pairs) WHERE rk <= 3""",
    "legal_requests": "SELECT vec_id AS request_id FROM embeddings WHERE label > 0",
    "state_union": "SELECT session_id, string_agg(DISTINCT tool, ',' ORDER BY tool) AS facts FROM (SELECT 'calls-' || user_id AS session_id, event_type AS tool FROM events UNION ALL SELECT 'turns-' || conv_id, role FROM conversations) GROUP BY 1",
    "check_contract": """SELECT event_id AS call_id, CASE WHEN event_id % 101 = 0 THEN 'bad_json' ELSE concat_ws(',', CASE WHEN event_id % 7 = 0 THEN 'unknown:other' END,
CASE WHEN event_id % 13 = 0 OR event_id % 17 = 0 THEN 'type:k' WHEN event_id % 100 < 10 OR event_id % 100 > 89 THEN 'range:k' END,
CASE WHEN event_id % 5 = 0 THEN 'missing:amount' WHEN event_id % 400 > 300 THEN 'range:amount' END, CASE WHEN event_id % 3 = 0 THEN 'type:note' END) END AS faults FROM events""",
    "check_frozen": "SELECT event_id AS call_id, freeze_id FROM events JOIN (VALUES " + ", ".join(f"({i}, '{t}', TIMESTAMP '{a}', TIMESTAMP '{b}')" for i, t, a, b in FREEZES) + ") f(freeze_id, tool_id, since, until) ON event_type = tool_id AND ts >= since AND ts < until",
    "verdict_cube": f"WITH {_CALLS} SELECT coalesce(tool_id, 'all') AS tool_id, coalesce(accepted, 'all') AS accepted, count(*) AS n FROM (SELECT tool_id, CASE WHEN len(reasons) = 0 THEN 'true' ELSE 'false' END AS accepted FROM verdict) GROUP BY CUBE (tool_id, accepted)",
    "verdicts_per_day": f"WITH {_CALLS} SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, coalesce(reasons[1], 'accepted') AS reason, count(*) AS n FROM verdict GROUP BY 1, 2",
    "verdicts_sliding": f"WITH {_CALLS} SELECT strftime(day, '%Y-%m-%d %H:%M:%S') AS start, reason, count(*) AS n FROM (SELECT coalesce(reasons[1], 'accepted') AS reason, unnest([date_trunc('day', ts)::TIMESTAMP, date_trunc('day', ts)::TIMESTAMP - INTERVAL 1 DAY]) AS day FROM verdict) GROUP BY 1, 2",
    "visits": """WITH steps AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
numbered AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new DESC ROWS UNBOUNDED PRECEDING) AS visit FROM steps)
SELECT user_id AS session_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%g') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%g') AS last, count(*) AS n FROM numbered GROUP BY user_id, visit""",
    "tool_places": """SELECT session_id, tool_id, n, rank() OVER (PARTITION BY session_id ORDER BY n DESC) AS place, dense_rank() OVER (PARTITION BY session_id ORDER BY n DESC) AS dense_place, ntile(2) OVER (PARTITION BY session_id ORDER BY n DESC, tool_id) AS half
FROM (SELECT user_id AS session_id, event_type AS tool_id, count(*) AS n FROM events GROUP BY 1, 2)""",
    "sessions_of_tools": "SELECT event_type AS tool_id, count(DISTINCT user_id) AS sessions, true AS near FROM events GROUP BY 1",
    "eval_mrr_by_level": f"WITH {_SCORED} SELECT label AS level, round(avg(coalesce(1.0::DOUBLE / rk, 0.0)), 6) AS mrr FROM embeddings e LEFT JOIN ranked r ON r.request_id = e.vec_id AND r.tool_id = e.label - 1 WHERE label > 0 GROUP BY 1",
    "sql_offered": f"WITH {_CALLS} SELECT session_id, arg_min(tool_id, ts) AS tool_id FROM verdict GROUP BY 1 HAVING arg_min(len(reasons) = 0, ts)",
    **follow_up.ORACLE_SQL,
}
