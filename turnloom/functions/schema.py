"""Shapes of JSON values, compiled to one expression over a VARIANT that names the path of the first value out of shape.

A shape is a dictionary in the words of JSON Schema: type (one or a list), enum, minimum, maximum, properties, required,
additionalProperties, items, anyOf.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$"


def _let(value: Column, then) -> Column:
    """then(value), the value made once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _is(v: Column, kind: Column, name: str) -> Column:
    if name == "integer":
        number = F.try_variant_get(v, "$", "double")
        return kind.rlike(_NUMBER) & ((kind == "BIGINT") | (number == F.floor(number).cast("double")))
    return {
        "string": kind == "STRING", "boolean": kind == "BOOLEAN", "null": kind == "VOID", "number": kind.rlike(_NUMBER),
        "object": F.startswith(kind, F.lit("OBJECT")), "array": F.startswith(kind, F.lit("ARRAY")),
    }[name]


def _among(v: Column, kind: Column, values: list) -> Column:
    text, number = F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "double")
    out = F.lit(False)
    for x in values:
        if x is None:
            same = kind == "VOID"
        elif isinstance(x, bool):
            same = (kind == "BOOLEAN") & (text == str(x).lower())
        elif isinstance(x, str):
            same = (kind == "STRING") & (text == x)
        else:
            same = kind.rlike(_NUMBER) & (number == float(x))
        out = out | same
    return out


def violation(v: Column, shape: dict) -> Column:
    """The path of the first violation of a shape, `$` being the value itself; null where there is none.

    A value is looked at before its parts; then missing properties, then those too many, then properties and elements in order. Of
    alternatives, none of which fits, the one that fits furthest tells its path: by depth, and at one depth by the order of
    properties, whose values come after those missing or too many. What isn't JSON (null) violates any shape.
    """
    return _found(v, shape, F.lit("$"), 0, 0)["path"]


def _found(v: Column, shape: dict, path: Column, depth: int, order: int) -> Column:
    at = lambda p, rank: F.struct(p.alias("path"), F.lit(rank).alias("rank"))
    if "anyOf" in shape:
        furthest = lambda a: reduce(lambda x, y: F.when(y["rank"] > x["rank"], y).otherwise(x), [F.get(a, F.lit(i)) for i in range(len(shape["anyOf"]))])
        return _let(F.array(*[_found(v, s, path, depth, order) for s in shape["anyOf"]]), lambda a: F.when(~F.exists(a, lambda x: x.isNull()), furthest(a)))
    kind = F.schema_of_variant(v)
    own = F.lit(False)
    if "type" in shape:
        types = [shape["type"]] if isinstance(shape["type"], str) else shape["type"]
        own = own | ~reduce(lambda x, y: x | y, [_is(v, kind, n) for n in types])
    if "enum" in shape:
        own = own | ~_among(v, kind, shape["enum"])
    for word, beyond in (("minimum", lambda n, m: n < m), ("maximum", lambda n, m: n > m)):
        if word in shape:
            own = own | F.coalesce(beyond(F.try_variant_get(v, "$", "double"), shape[word]), F.lit(False))
    steps = [F.when(v.isNull() | F.coalesce(own, F.lit(True)), at(path, 1000 * depth + order))]
    parts = shape.get("properties", {})
    child = {k: F.try_variant_get(v, f"$['{k}']", "variant") for k in parts}
    steps += [F.when(child[k].isNull(), at(F.concat(path, F.lit(f".{k}")), 1000 * (depth + 1) + i)) for i, k in enumerate(shape.get("required", []))]
    if shape.get("additionalProperties") is False:
        more = F.get(F.array_except(F.json_object_keys(F.to_json(v)), F.array(*[F.lit(k) for k in parts]) if parts else F.expr("cast(array() as array<string>)")), F.lit(0))
        steps.append(F.when(F.startswith(kind, F.lit("OBJECT")) & more.isNotNull(), at(F.concat(path, F.lit("."), more), 1000 * (depth + 1) + 99)))
    steps += [F.when(child[k].isNotNull(), _found(child[k], s, F.concat(path, F.lit(f".{k}")), depth + 1, 100 + i)) for i, (k, s) in enumerate(parts.items())]
    if "items" in shape:
        each = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x, i: _found(x, shape["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), depth + 1, 100))
        steps.append(F.when(F.startswith(kind, F.lit("ARRAY")), F.get(F.filter(each, lambda x: x.isNotNull()), F.lit(0))))
    return F.coalesce(*steps)


def ddl(shape: dict) -> str:
    """The type of values of a shape; alternatives share one, with the fields of all."""
    if "anyOf" in shape:
        if all("properties" in s for s in shape["anyOf"]):
            return ddl({"type": "object", "properties": reduce(lambda a, s: s["properties"] | a, reversed(shape["anyOf"]), {})})
        return ddl(shape["anyOf"][0])
    types = [shape["type"]] if isinstance(shape["type"], str) else shape["type"]
    kind = next((n for n in types if n != "null"), "null")
    if kind == "object":
        return f"struct<{','.join(f'`{k}`:{ddl(s)}' for k, s in shape['properties'].items())}>"
    if kind == "array":
        return f"array<{ddl(shape['items'])}>"
    return {"string": "string", "boolean": "boolean", "integer": "bigint", "number": "double", "null": "string"}[kind]


def strict(body: Column, shape: dict) -> Column:
    """A JSON text as a value of a shape; null if it isn't JSON or violates it anywhere."""
    return _let(F.try_parse_json(body), lambda v: F.when(violation(v, shape).isNull(), F.try_variant_get(v, "$", ddl(shape))))


def problem(body: Column, shape: dict) -> Column:
    """The path of a JSON text's first violation; null if it has the shape."""
    return _let(F.try_parse_json(body), lambda v: violation(v, shape))
