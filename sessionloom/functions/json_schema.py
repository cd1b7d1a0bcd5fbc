"""A JSON schema compiled into one column expression over a variant."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def kind(value: Column) -> Column:
    """JSON type of a variant. A number without a fraction in its text is an integer."""
    found = F.schema_of_variant(value)
    plain = {"STRING": "string", "BOOLEAN": "boolean", "VOID": "null", "BIGINT": "integer"}
    out = F.when(found.startswith("OBJECT"), "object").when(found.startswith("ARRAY"), "array")
    for name, known in plain.items():
        out = out.when(found == name, known)
    return out.otherwise("number")


def schema_error(text: Column, schema: dict) -> Column:
    """The first way in which a JSON text breaks a schema, led by its place ($.a[2]); null where it keeps it.

    The walk knows type (one or several), enum, required, properties, additionalProperties: false and items, in that order,
    parents before children; other keywords and types are passed by. The top must be an object. True is no number. Values of
    an enum are compared as JSON texts. The schema is walked once, on the driver; rows never leave the JVM.
    """
    top = lambda v: F.when(v.isNull(), "$: no JSON").when(kind(v) != "object", F.concat(F.lit("$: expected object, got "), kind(v)))
    return _once(F.try_parse_json(text), lambda v: F.coalesce(top(v), _walk(v, schema, F.lit("$"))))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression over a value that is worked out once a row: the variable of a one-element array's transform."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _walk(value: Column, schema: dict, path: Column) -> Column:
    seen = F.struct(value.alias("value"), kind(value).alias("kind"), F.try_variant_get(value, "$", "map<string,variant>").alias("fields"))
    return _once(seen, lambda s: _checks(s["value"], s["kind"], s["fields"], schema, path))


def _checks(value: Column, is_kind: Column, fields: Column, schema: dict, path: Column) -> Column:
    checks = []
    wanted = schema.get("type", [])
    wanted = [wanted] if isinstance(wanted, str) else wanted
    known = {"string", "number", "integer", "boolean", "array", "object", "null"}
    if wanted and set(wanted) <= known:
        fits = is_kind.isin(*wanted, *(["integer"] if "number" in wanted else []))
        checks.append(F.when(~fits, F.concat(path, F.lit(f": expected {' or '.join(wanted)}, got "), is_kind)))
    if isinstance(schema.get("enum"), list):
        texts = [json.dumps(v, ensure_ascii=False, separators=(",", ":")) for v in schema["enum"]]
        checks.append(F.when(~F.to_json(value).isin(*texts), F.concat(path, F.lit(f": not one of [{', '.join(texts)}]"))))
    properties = schema.get("properties") or {}
    own = F.when(is_kind == "object", F.map_keys(fields))
    for key in schema.get("required") or []:
        checks.append(F.when(~F.array_contains(own, key), F.concat(path, F.lit(f": no key {key}"))))
    if schema.get("additionalProperties") is False:
        extra = F.array_sort(F.array_except(own, F.array(*map(F.lit, properties)) if properties else F.array().cast("array<string>")))
        checks.append(F.when(F.size(extra) > 0, F.concat(path, F.lit(": undeclared keys "), F.array_join(extra, ", "))))
    for key, part in properties.items():
        checks.append(F.when(F.array_contains(own, key), _walk(F.element_at(fields, F.lit(key)), part, F.concat(path, F.lit(f".{key}")))))
    if isinstance(schema.get("items"), dict):
        elements = F.when(is_kind == "array", F.try_variant_get(value, "$", "array<variant>"))
        each = F.transform(elements, lambda e, k: _walk(e, schema["items"], F.concat(path, F.lit("["), k.cast("string"), F.lit("]"))))
        checks.append(F.get(F.filter(each, lambda e: e.isNotNull()), F.lit(0)))
    return F.coalesce(*checks) if checks else F.lit(None).cast("string")
