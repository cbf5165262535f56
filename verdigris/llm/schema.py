"""JSON Schema for arguments: keywords that are built, and refusal of all others.

Built: boolean schemas, type, enum, const, minimum, maximum, exclusiveMinimum, exclusiveMaximum, multipleOf, minLength,
maxLength, pattern (Python's syntax), items (one schema or a list), prefixItems, additionalItems, minItems, maxItems,
uniqueItems, properties, required, patternProperties, additionalProperties, minProperties, maxProperties, allOf, anyOf,
oneOf, not, and $ref to a place in the same schema. Annotations say nothing about values and are passed over.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

KINDS = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}
ANNOTATIONS = frozenset(["title", "description", "default", "examples", "deprecated", "readOnly", "writeOnly", "format", "$schema", "$id", "$comment", "$defs", "definitions"])
_ONE, _MANY, _NAMED = ("additionalItems", "additionalProperties", "not"), ("prefixItems", "allOf", "anyOf", "oneOf"), ("properties", "patternProperties", "$defs", "definitions")
_NUMBERS = ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minLength", "maxLength", "minItems", "maxItems", "minProperties", "maxProperties")
KNOWN = ANNOTATIONS | {"type", "enum", "const", "pattern", "items", "uniqueItems", "required", "$ref", *_ONE, *_MANY, *_NAMED, *_NUMBERS}
Schema = dict | bool


def checked(schema: Schema, root: Schema | None = None) -> Schema:
    """The schema; raises ValueError where it, or one inside it, has a keyword, a type or a shape that is not built."""
    root = schema if root is None else root
    if isinstance(schema, bool):
        return schema
    if not isinstance(schema, dict):
        raise ValueError(f"a schema is an object or a boolean, not {schema!r}")
    if unknown := sorted(set(schema) - KNOWN):
        raise ValueError(f"unknown keyword {unknown[0]!r} in a schema")
    kinds = schema.get("type", [])
    for k in [kinds] if isinstance(kinds, str) else kinds:
        if k not in KINDS and k not in ("number", "integer"):
            raise ValueError(f"unknown type {k!r} in a schema")
    for k in _NUMBERS:
        if k in schema and (isinstance(schema[k], bool) or not isinstance(schema[k], (int, float)) or k == "multipleOf" and schema[k] <= 0):
            raise ValueError(f"{k} is no number that can be used")
    for k in ("enum", "required", *_MANY):
        if not isinstance(schema.get(k, []), list):
            raise ValueError(f"{k} is no list")
    for p in [*([schema["pattern"]] if "pattern" in schema else []), *schema.get("patternProperties", {})]:
        try:
            re.compile(p)
        except (re.error, TypeError) as e:
            raise ValueError(f"pattern {p!r}: {e}") from None
    for k in _NAMED:
        if not isinstance(schema.get(k, {}), dict):
            raise ValueError(f"{k} is no object")
    items = schema.get("items", True)
    inner = [schema[k] for k in _ONE if k in schema] + [x for k in _MANY for x in schema.get(k, [])] + [x for k in _NAMED for x in schema.get(k, {}).values()] + (items if isinstance(items, list) else [items])
    for x in inner:
        checked(x, root)
    seen, at = [], schema
    while isinstance(at, dict) and "$ref" in at:
        if at["$ref"] in seen:
            raise ValueError(f"{at['$ref']} refers to itself")
        seen.append(at["$ref"])
        at = referred(root, at["$ref"])
    return schema


def referred(root: Schema, ref: object) -> Schema:
    at = root
    if not isinstance(ref, str) or not ref.startswith("#"):
        raise ValueError(f"{ref!r} is not inside the schema")
    for part in ref[1:].split("/")[1:]:
        part = part.replace("~1", "/").replace("~0", "~")
        at = at[int(part)] if isinstance(at, list) and part.isdigit() and int(part) < len(at) else at.get(part) if isinstance(at, dict) else None
    if not isinstance(at, (dict, bool)):
        raise ValueError(f"{ref!r} names no schema")
    return at


def fault(value: object, schema: Schema, same: Callable[[object], str], at: str = "$", root: Schema | None = None) -> str | None:
    """The first way in which value breaks the (checked) schema, by place and keyword. same: a text of values that equal
    ones share."""
    root = schema if root is None else root
    if isinstance(schema, bool):
        return None if schema else f"{at}: not allowed"
    inside = lambda v, s, where=at: fault(v, s, same, where, root)
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    kinds = schema.get("type")
    if kinds:
        fits = lambda k: number and (k == "number" or isinstance(value, int) or value.is_integer()) if k in ("number", "integer") else isinstance(value, KINDS[k])
        if not any(fits(k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
            return f"{at}: type"
    if "enum" in schema and same(value) not in map(same, schema["enum"]):
        return f"{at}: enum"
    if "const" in schema and same(value) != same(schema["const"]):
        return f"{at}: const"
    if "$ref" in schema and (f := inside(value, referred(root, schema["$ref"]))):
        return f
    size = lambda low, high, n: not schema.get(low, 0) <= n <= schema.get(high, math.inf)
    if number:
        if not schema.get("minimum", -math.inf) <= value <= schema.get("maximum", math.inf) or value <= schema.get("exclusiveMinimum", -math.inf) or value >= schema.get("exclusiveMaximum", math.inf):
            return f"{at}: range"
        if "multipleOf" in schema and not _whole(value, schema["multipleOf"]):
            return f"{at}: multiple"
    if isinstance(value, str):
        if size("minLength", "maxLength", len(value)):
            return f"{at}: length"
        if "pattern" in schema and not re.search(schema["pattern"], value):
            return f"{at}: pattern"
    if isinstance(value, list):
        if size("minItems", "maxItems", len(value)):
            return f"{at}: items"
        if schema.get("uniqueItems") and len(set(map(same, value))) < len(value):
            return f"{at}: unique"
        items = schema.get("items", True)
        first = schema.get("prefixItems", items if isinstance(items, list) else [])
        rest = schema.get("additionalItems", True) if isinstance(items, list) else items
        for i, x in enumerate(value):
            if f := inside(x, first[i] if i < len(first) else rest, f"{at}[{i}]"):
                return f
    if isinstance(value, dict):
        for k in schema.get("required", ()):
            if k not in value:
                return f"{at}.{k}: required"
        if size("minProperties", "maxProperties", len(value)):
            return f"{at}: properties"
        known, shapes, other = schema.get("properties", {}), schema.get("patternProperties", {}), schema.get("additionalProperties", True)
        for k in sorted(value):
            own = [known[k]] if k in known else []
            own += [s for p, s in shapes.items() if re.search(p, k)]
            if not own and other is False:
                return f"{at}.{k}: unknown"
            for s in own or [other]:
                if f := inside(value[k], s, f"{at}.{k}"):
                    return f
    for s in schema.get("allOf", ()):
        if f := inside(value, s):
            return f
    if "anyOf" in schema and all(inside(value, s) for s in schema["anyOf"]):
        return f"{at}: anyOf"
    if "oneOf" in schema and sum(inside(value, s) is None for s in schema["oneOf"]) != 1:
        return f"{at}: oneOf"
    return f"{at}: not" if "not" in schema and inside(value, schema["not"]) is None else None


def _whole(value: float, unit: float) -> bool:
    """Whether value is a multiple of unit, within rounding where either is no integer."""
    if isinstance(value, int) and isinstance(unit, int):
        return value % unit == 0
    try:
        q = value / unit
    except OverflowError:
        return False
    return not math.isinf(q) and abs(q - round(q)) <= 1e-9 * max(1.0, abs(q))
