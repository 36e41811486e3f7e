"""A table function that turns contract documents into rows.

    SELECT * FROM contract_rows(TABLE(documents) PARTITION BY tool_id ORDER BY (version), 'type,minimum,maximum')

documents has tool_id, version and document (a JSON schema as text). Of each tool the last
version counts that can be read. A row comes for every place in the schema: its tool, version,
path ($, $.name, $.list[], one|0 for alternatives), whether its parent requires it, and a column for each
rule that was asked for, typed by the rule's name; the columns follow from the argument when
the query is analyzed.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BooleanType, DataType, DoubleType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

# fixed values: rules by the type of their column
_DOUBLES = {"minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum"}
_LONGS = {"minItems", "maxItems", "minLength", "maxLength", "minProperties", "maxProperties"}
_BOOLEANS = {"uniqueItems"}
_TEXTS = {"type", "enum", "const", "pattern", "title", "description", "format"}


def _kind(rule: str) -> DataType:
    for names, kind in ((_DOUBLES, DoubleType()), (_LONGS, LongType()), (_BOOLEANS, BooleanType()), (_TEXTS, StringType())):
        if rule in names:
            return kind
    raise ValueError(f"no such rule: {rule}")


def _rules(text: str) -> list[str]:
    return [r.strip() for r in text.split(",") if r.strip()]


def places(schema: object, path: str = "$", required: bool = True) -> Iterator[tuple[str, bool, dict]]:
    """(path, required, rules) of a schema and all that it holds, outermost first."""
    if not isinstance(schema, dict):
        return
    yield path, required, schema
    needed = schema.get("required") or []
    for name, inner in sorted((schema.get("properties") or {}).items()):
        yield from places(inner, f"{path}.{name}", name in needed)
    if isinstance(schema.get("items"), dict):
        yield from places(schema["items"], f"{path}[]", False)
    for word in ("anyOf", "oneOf", "allOf"):
        for i, inner in enumerate(schema.get(word) or []):
            yield from places(inner, f"{path}|{i}", word == "allOf")


def _value(rule: str, rules: dict) -> object:
    value = rules.get(rule)
    if value is None:
        return None
    if rule in _TEXTS:
        return value if isinstance(value, str) else json.dumps(value, separators=(",", ":"))
    if rule in _BOOLEANS:
        return bool(value)
    return float(value) if rule in _DOUBLES else int(value)


class ContractRows:
    @staticmethod
    def analyze(documents: AnalyzeArgument, rules: AnalyzeArgument) -> AnalyzeResult:
        if not documents.isTable:
            raise ValueError("the first argument must be a table")
        if rules.value is None:
            raise ValueError("the rules must be given as a literal")
        fixed = [StructField("tool_id", StringType()), StructField("version", LongType()), StructField("path", StringType()), StructField("required", BooleanType())]
        return AnalyzeResult(StructType([*fixed, *[StructField(r, _kind(r)) for r in _rules(rules.value)]]))

    def __init__(self) -> None:
        self.last: tuple | None = None

    def eval(self, row: Row, rules: str) -> None:
        try:
            schema = json.loads(row["document"])
        except (TypeError, ValueError):
            return
        if isinstance(schema, dict) and row["tool_id"] is not None and (self.last is None or (row["version"] or 0) >= self.last[1]):
            self.last = (row["tool_id"], row["version"] or 0, schema, _rules(rules))

    def terminate(self) -> Iterator[tuple]:
        if self.last is not None:
            tool, version, schema, rules = self.last
            for path, required, found in places(schema):
                yield (tool, version, path, required, *[_value(r, found) for r in rules])


def register(spark: SparkSession, name: str = "contract_rows") -> None:
    """Make the function known to SQL under a name."""
    spark.udtf.register(name, udtf(ContractRows))
