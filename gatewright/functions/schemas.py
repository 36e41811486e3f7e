"""JSON schemas as one expression over variants.

A schema is compiled once to a tree of column functions: every node of it is evaluated
once a row, on the variant at its place, and gives its faults as `path:rule`. Rules:
type (or several), enum and const (of scalars), anyOf, oneOf, allOf, $ref to #/$defs;
for objects properties, required, additionalProperties, minProperties, maxProperties;
for arrays items, minItems, maxItems, uniqueItems; for text minLength, maxLength,
pattern; for numbers minimum, maximum, exclusiveMinimum, exclusiveMaximum. Titles,
descriptions and other words of no rule say nothing; a rule that is not known here, such as not
or if, is an error when the schema is compiled, so nothing passes unseen.

A reference may lead to itself; it is unrolled `depth` times, and what lies deeper is the
fault `depth`. A value of a wrong type has that fault only. An integer is a number
without decimal places, as written. Text that is no JSON, or null, is `$:json`; a JSON null
is a value of type null.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: how schema_of_variant names JSON types
_KINDS = {"object": "^OBJECT", "array": "^ARRAY", "string": "^STRING$", "integer": r"^(BIGINT|DECIMAL\(\d+,0\))$", "number": r"^(BIGINT|FLOAT|DOUBLE|DECIMAL\(.*)$", "boolean": "^BOOLEAN$", "null": "^VOID$"}
_SILENT = {"title", "description", "examples", "default", "$schema", "$id", "$defs", "definitions", "$comment", "format"}
_NONE = "array<string>"


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once even where it is read often."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _none() -> Column:
    return F.array().cast(_NONE)


def _when(fails: Column, path: Column, rule: str) -> Column:
    return F.when(F.coalesce(fails, F.lit(False)), F.array(F.concat(path, F.lit(":" + rule)))).otherwise(_none())


def _all(parts: list[Column]) -> Column:
    return F.concat(*parts) if len(parts) > 1 else parts[0] if parts else _none()


def _is(kind: Column, *types: str) -> Column:
    unknown = [t for t in types if t not in _KINDS]
    if unknown:
        raise ValueError(f"unknown types: {unknown}")
    return functools.reduce(Column.__or__, [kind.rlike(_KINDS[t]) for t in types])


def _equals(value: Column, kind: Column, wanted: object) -> Column:
    """Whether a variant is this scalar."""
    if wanted is None:
        return _is(kind, "null")
    if isinstance(wanted, bool):
        return _is(kind, "boolean") & (F.try_variant_get(value, "$", "boolean") == wanted)
    if isinstance(wanted, (int, float)):
        return _is(kind, "number") & (F.try_variant_get(value, "$", "double") == float(wanted))
    if isinstance(wanted, str):
        return _is(kind, "string") & (F.try_variant_get(value, "$", "string") == wanted)
    raise ValueError("only scalars can be listed in enum and const")


class _Compiler:
    def __init__(self, root: dict, depth: int):
        self.root, self.depth = root, depth

    def node(self, schema: dict | bool, value: Column, path: Column, seen: int = 0) -> Column:
        """Faults of a variant that is there."""
        if isinstance(schema, bool):
            return _none() if schema else F.array(F.concat(path, F.lit(":unknown")))
        if "$ref" in schema:
            if seen == self.depth:
                return F.array(F.concat(path, F.lit(":depth")))
            target: object = self.root
            for step in schema["$ref"].removeprefix("#").strip("/").split("/"):
                target = target[step] if step else target  # type: ignore[index]
            rest = {k: v for k, v in schema.items() if k != "$ref"}
            return self.node({"allOf": [target, *([rest] if rest else [])]}, value, path, seen + 1)
        return _bind(F.struct(value.alias("v"), F.schema_of_variant(value).alias("kind")), lambda x: self.rules(schema, x["v"], x["kind"], path, seen))

    def rules(self, schema: dict, v: Column, kind: Column, path: Column, seen: int) -> Column:
        rules, parts = dict(schema), []
        take = lambda name: rules.pop(name, None)
        types = take("type")
        if (listed := take("enum")) is not None:
            parts.append(_when(~functools.reduce(Column.__or__, [F.coalesce(_equals(v, kind, x), F.lit(False)) for x in listed], F.lit(False)), path, "enum"))
        if "const" in rules:
            parts.append(_when(~F.coalesce(_equals(v, kind, take("const")), F.lit(False)), path, "const"))
        for name, fits in (("anyOf", lambda n: n > 0), ("oneOf", lambda n: n == 1)):
            if (ways := take(name)) is not None:
                passed = functools.reduce(Column.__add__, [(F.size(self.node(w, v, path, seen)) == 0).cast("int") for w in ways], F.lit(0))
                parts.append(_when(~fits(passed), path, name))
        parts += [self.node(s, v, path, seen) for s in take("allOf") or []]
        parts += [*self.numbers(take, v, kind, path), *self.text(take, v, kind, path), *self.array(take, v, kind, path, seen), *self.object(take, v, kind, path, seen)]
        if unknown := rules.keys() - _SILENT:
            raise ValueError(f"rules that are not known: {sorted(unknown)}")
        if types is None:
            return _all(parts)
        wrong = ~_is(kind, *([types] if isinstance(types, str) else types))
        return F.when(wrong, F.array(F.concat(path, F.lit(":type")))).otherwise(_all(parts))

    def numbers(self, take, v: Column, kind: Column, path: Column) -> list[Column]:
        bounds = [("minimum", Column.__lt__), ("maximum", Column.__gt__), ("exclusiveMinimum", Column.__le__), ("exclusiveMaximum", Column.__ge__)]
        given = [(name, fails, take(name)) for name, fails in bounds]
        number = F.when(_is(kind, "number"), F.try_variant_get(v, "$", "double"))
        return [_when(fails(number, F.lit(float(x))), path, name) for name, fails, x in given if x is not None]

    def text(self, take, v: Column, kind: Column, path: Column) -> list[Column]:
        least, most, pattern = take("minLength"), take("maxLength"), take("pattern")
        text = F.when(_is(kind, "string"), F.try_variant_get(v, "$", "string"))
        out = [_when(F.length(text) < least, path, "minLength")] if least is not None else []
        out += [_when(F.length(text) > most, path, "maxLength")] if most is not None else []
        return out + ([_when(~text.rlike(pattern), path, "pattern")] if pattern is not None else [])

    def array(self, take, v: Column, kind: Column, path: Column, seen: int) -> list[Column]:
        items, least, most, unique = take("items"), take("minItems"), take("maxItems"), take("uniqueItems")
        if items is None and least is None and most is None and not unique:
            return []

        def of(a: Column) -> Column:
            out = [_when(F.size(a) < least, path, "minItems")] if least is not None else []
            out += [_when(F.size(a) > most, path, "maxItems")] if most is not None else []
            out += [_when(F.size(F.array_distinct(F.transform(a, lambda x: F.to_json(x)))) < F.size(a), path, "uniqueItems")] if unique else []
            if items is not None:
                out.append(F.flatten(F.transform(a, lambda x, i: self.node(items, x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), seen))))
            return _all(out)

        return [F.when(_is(kind, "array"), _bind(v.try_cast("array<variant>"), of)).otherwise(_none())]

    def object(self, take, v: Column, kind: Column, path: Column, seen: int) -> list[Column]:
        known, required, more, least, most = take("properties") or {}, take("required") or [], take("additionalProperties"), take("minProperties"), take("maxProperties")
        if not known and not required and more is None and least is None and most is None:
            return []
        at = lambda key: F.concat(path, F.lit("."), key)

        def of(m: Column) -> Column:
            has = lambda name: F.map_contains_key(m, F.lit(name))
            # a JSON null may come as no variant at all
            value = lambda x: F.coalesce(x, F.parse_json(F.lit("null")))
            out = [_when(~has(name), at(F.lit(name)), "required") for name in required]
            out += [F.when(has(name), self.node(s, value(F.try_element_at(m, F.lit(name))), at(F.lit(name)), seen)).otherwise(_none()) for name, s in known.items()]
            out += [_when(F.size(m) < least, path, "minProperties")] if least is not None else []
            out += [_when(F.size(m) > most, path, "maxProperties")] if most is not None else []
            if more is not None and more is not True:
                others = F.array_sort(F.filter(F.map_keys(m), lambda k: ~k.isin(*known) if known else F.lit(True)))
                out.append(F.flatten(F.transform(others, lambda k: self.node(more, value(F.try_element_at(m, k)), at(k), seen))))
            return _all(out)

        return [F.when(_is(kind, "object"), _bind(v.try_cast("map<string,variant>"), of)).otherwise(_none())]


def schema_faults(args_json: Column, schema: dict | str, depth: int = 4) -> Column:
    """Sorted array of faults of JSON text under a schema (a dict, or its JSON); empty where it holds."""
    schema = json.loads(schema) if isinstance(schema, str) else schema
    tree = _Compiler(schema if isinstance(schema, dict) else {}, depth)
    given = F.try_parse_json(args_json)
    return _bind(given, lambda v: F.when(v.isNull(), F.array(F.lit("$:json"))).otherwise(F.array_sort(F.array_distinct(tree.node(schema, v, F.lit("$"))))))
