"""Strict checks of JSON arguments against a contract, as one expression.

Types: int, number, string, boolean. JSON null counts as missing; keys that the
contract does not name are faults; bounds are inclusive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: how schema_of_variant names JSON types
_KINDS = {"int": "^BIGINT$", "number": r"^(BIGINT|DOUBLE|DECIMAL\(.*)$", "string": "^STRING$", "boolean": "^BOOLEAN$"}


def argument_faults(args_json: Column, contract: Column) -> Column:
    """Array of faults: bad_json, unknown:<key>, missing:<name>, type:<name>, range:<name>. Empty if the arguments hold; a null contract takes none."""
    given = F.try_parse_json(F.coalesce(args_json, F.lit("null"))).try_cast("map<string,variant>")
    args = F.coalesce(contract, F.array().cast("array<struct<name:string,type:string,required:boolean,min:double,max:double>>"))

    def faults(m: Column) -> Column:
        def fault(a: Column) -> Column:
            value = F.try_element_at(m, a["name"])
            kind = F.schema_of_variant(value)
            number = F.try_variant_get(value, "$", "double")
            fits = F.coalesce(*[F.when(a["type"] == t, kind.rlike(pattern)) for t, pattern in _KINDS.items()], F.lit(False))
            outside = F.coalesce(number < a["min"], F.lit(False)) | F.coalesce(number > a["max"], F.lit(False))
            missing = kind.isNull() | (kind == "VOID")
            return (
                F.when(missing, F.when(F.coalesce(a["required"], F.lit(False)), F.concat(F.lit("missing:"), a["name"])))
                .when(~fits, F.concat(F.lit("type:"), a["name"]))
                .when(outside, F.concat(F.lit("range:"), a["name"]))
            )

        unknown = F.array_sort(F.array_except(F.map_keys(m), F.transform(args, lambda a: a["name"])))
        return F.concat(F.transform(unknown, lambda k: F.concat(F.lit("unknown:"), k)), F.filter(F.transform(args, fault), lambda x: x.isNotNull()))

    return F.when(given.isNull(), F.array(F.lit("bad_json"))).otherwise(faults(given))
