"""Validation of JSON text against a declared shape, as column expressions.

Shapes are built from the functions below.  ``first_issue`` gives the first problem
(path and message), ``shaped`` the value as the shape reads it (undeclared keys gone,
defaults filled in), ``strict_problems`` the paths of keys that a shape does not
declare, all without Python code per row.  Values are walked as variants, which keep
the keys of an object sorted: problems of a record come in the order of its keys.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Shape:
    """``kind`` and what it allows.  ``optional`` keys may be absent, null still fails unless
    ``nullable``; ``default`` is JSON text for an absent key."""

    kind: str
    low: float | None = None
    high: float | None = None
    pattern: str | None = None
    values: tuple = ()
    fields: dict[str, Shape] = field(default_factory=dict)
    item: Shape | None = None
    branches: tuple[Shape, ...] = ()
    optional: bool = False
    nullable: bool = False
    default: str | None = None

    @property
    def required(self) -> bool:
        return not self.optional and self.default is None

    def json_schema(self) -> dict:
        """The shape as JSON Schema."""
        names = {"string": ("minLength", "maxLength"), "array": ("minItems", "maxItems")}
        bounds = names.get(self.kind, ("minimum", "maximum"))
        kind = {"record": "object"}.get(self.kind, self.kind)
        out: dict = {} if kind in ("unknown", "enum", "literal", "union") else {"type": kind}
        out |= {k: v for k, v in zip(bounds, (self.low, self.high), strict=True) if v is not None}
        if self.pattern is not None:
            out["pattern"] = self.pattern
        if self.kind == "enum":
            out["enum"] = list(self.values)
        if self.kind == "literal":
            out["const"] = self.values[0]
        if self.kind == "union":
            out["anyOf"] = [s.json_schema() for s in self.branches]
        if self.kind == "object":
            out["properties"] = {k: s.json_schema() for k, s in self.fields.items()}
            out["required"] = [k for k, s in self.fields.items() if s.required]
        if self.item is not None:
            out["additionalProperties" if self.kind == "record" else "items"] = self.item.json_schema()
        if self.default is not None:
            out["default"] = json.loads(self.default)
        return {"anyOf": [out, {"type": "null"}]} if self.nullable else out


def string(low=None, high=None, pattern=None, **kw) -> Shape:
    return Shape("string", low, high, pattern, **kw)


def number(low=None, high=None, **kw) -> Shape:
    return Shape("number", low, high, **kw)


def integer(low=None, high=None, **kw) -> Shape:
    return Shape("integer", low, high, **kw)


def enum(*values: str, **kw) -> Shape:
    return Shape("enum", values=values, **kw)


def obj(fields: dict[str, Shape], **kw) -> Shape:
    return Shape("object", fields=fields, **kw)


def boolean(**kw) -> Shape:
    return Shape("boolean", **kw)


def unknown(**kw) -> Shape:
    return Shape("unknown", **kw)


def literal(value: str | int | bool, **kw) -> Shape:
    """One value only."""
    return Shape("literal", values=(value,), **kw)


def array(item: Shape, low=None, high=None, **kw) -> Shape:
    return Shape("array", low, high, item=item, **kw)


def record(item: Shape, **kw) -> Shape:
    """An object of any keys, whose values all have one shape."""
    return Shape("record", item=item, **kw)


def union(*branches: Shape, **kw) -> Shape:
    """The first branch that a value fits."""
    return Shape("union", branches=branches, **kw)


def defaulted(shape: Shape, value) -> Shape:
    """A key that may be absent, and the value it then has; null is no absence."""
    return replace(shape, default=json.dumps(value))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, for which ``value`` is computed once a row, however often it stands in there."""
    return F.get(F.transform(F.array(value), use), 0)


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _numeric(value: Column) -> Column:
    kind = _kind(value)
    return (kind == "BIGINT") | kind.startswith("DECIMAL") | (kind == "DOUBLE")


def _part(value: Column, name: str) -> Column:
    """A key's value, null where the key is absent."""
    return F.try_variant_get(value, "$[" + json.dumps(name) + "]", "variant")


def _items(value: Column) -> Column:
    """The elements of an array; those that are null stay variants."""
    return F.transform(
        F.try_variant_get(value, "$", "array<variant>"), lambda v: F.coalesce(v, F.parse_json(F.lit("null")))
    )


def _entries(value: Column) -> Column:
    """(key, value) of an object, by key."""
    return F.transform(
        F.map_entries(F.try_variant_get(value, "$", "map<string, variant>")),
        lambda e: F.struct(e["key"].alias("key"), F.coalesce(e["value"], F.parse_json(F.lit("null"))).alias("value")),
    )


def _first(issues: Column) -> Column:
    return F.get(F.filter(issues, lambda i: i.isNotNull()), 0)


def _field(shape: Shape, path: Column, missing: Column) -> Callable[[Column], Column]:
    """The first problem of a key's value, ``missing`` where it is absent."""
    return lambda part: F.when(part.isNull(), missing).otherwise(_check(shape, part, path))


def _check(shape: Shape, value: Column, path: Column) -> Column:
    """The first problem of a variant that is there, or null."""
    kind = _kind(value)
    bad = lambda text: F.concat(path, F.lit(f": {text}"))
    if shape.kind == "unknown":
        out = F.lit(None).cast("string")
    elif shape.kind in ("string", "enum"):
        text = F.try_variant_get(value, "$", "string")
        out = F.when(kind != "STRING", bad("expected a string"))
        if shape.kind == "enum":
            out = out.when(~text.isin(*shape.values), bad("not one of the values"))
        if shape.low is not None:
            out = out.when(F.length(text) < shape.low, bad("too short"))
        if shape.high is not None:
            out = out.when(F.length(text) > shape.high, bad("too long"))
        if shape.pattern is not None:
            out = out.when(~text.rlike(shape.pattern), bad("does not match"))
    elif shape.kind in ("number", "integer"):
        x = F.try_variant_get(value, "$", "double")
        out = F.when(~_numeric(value), bad("expected a number"))
        if shape.kind == "integer":
            out = out.when(x != F.floor(x), bad("expected an integer"))
        if shape.low is not None:
            out = out.when(x < shape.low, bad("too small"))
        if shape.high is not None:
            out = out.when(x > shape.high, bad("too large"))
    elif shape.kind == "boolean":
        out = F.when(kind != "BOOLEAN", bad("expected a boolean"))
    elif shape.kind == "literal":
        (wanted,) = shape.values
        if isinstance(wanted, str):
            same = (kind == "STRING") & (F.try_variant_get(value, "$", "string") == wanted)
        elif isinstance(wanted, bool):
            same = (kind == "BOOLEAN") & (F.try_variant_get(value, "$", "boolean") == wanted)
        else:
            same = _numeric(value) & (F.try_variant_get(value, "$", "double") == float(wanted))
        out = F.when(~same, bad(f"expected {wanted if isinstance(wanted, str) else json.dumps(wanted)}"))
    elif shape.kind == "array":
        items, count = _items(value), F.size(F.try_variant_get(value, "$", "array<variant>"))
        at = lambda i: F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
        out = F.when(~kind.startswith("ARRAY"), bad("expected an array"))
        if shape.low is not None:
            out = out.when(count < shape.low, bad("too few"))
        if shape.high is not None:
            out = out.when(count > shape.high, bad("too many"))
        out = out.otherwise(_first(F.transform(items, lambda v, i: _check(shape.item, v, at(i)))))
    elif shape.kind == "record":
        under = lambda e: F.concat(path, F.lit("."), e["key"])
        out = F.when(~kind.startswith("OBJECT"), bad("expected an object")).otherwise(
            _first(F.transform(_entries(value), lambda e: _check(shape.item, e["value"], under(e))))
        )
    elif shape.kind == "union":
        none = F.lit(True)
        for s in shape.branches:
            none = none & _check(s, value, path).isNotNull()
        out = F.when(none, bad("fits none of the branches"))
    else:
        out = F.when(~kind.startswith("OBJECT"), bad("expected an object"))
        parts = []
        for name, s in shape.fields.items():
            below = F.concat(path, F.lit(f".{name}"))
            missing = F.concat(below, F.lit(": required")) if s.required else F.lit(None).cast("string")

            parts.append(_once(_part(value, name), _field(s, below, missing)))
        out = out.otherwise(F.coalesce(*parts)) if parts else out
    if shape.nullable:
        out = F.when(F.is_variant_null(value), F.lit(None)).otherwise(out)
    return out


def first_issue(text: Column, shape: Shape) -> Column:
    """The first problem of JSON text, in order of the shape; null for valid text."""
    return _once(F.try_parse_json(text), lambda value: _issue(value, shape))


def _issue(value: Column, shape: Shape) -> Column:
    """The first problem of parsed text."""
    return F.when(value.isNull(), "$: not JSON").otherwise(_check(shape, value, F.lit("$")))


def _quoted(key: Column) -> Column:
    """A key as JSON text."""
    listed = F.to_json(F.array(key))
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


def _read(shape: Shape) -> Callable[[Column], Column]:
    """JSON text of a key's value, the default where it is absent."""
    absent = F.lit(shape.default).cast("string")
    return lambda part: F.when(part.isNull(), absent).otherwise(_text(shape, part))


def _text(shape: Shape, value: Column) -> Column:
    """JSON text of a valid variant as its shape reads it."""
    if shape.kind == "object":
        parts = []
        for name, s in shape.fields.items():
            own = _once(_part(value, name), _read(s))
            # an absent key makes null, which concat_ws leaves out
            parts.append(F.concat(F.lit(json.dumps(name) + ":"), own))
        out = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    elif shape.kind == "array":
        out = F.concat(F.lit("["), F.array_join(F.transform(_items(value), lambda v: _text(shape.item, v)), ","), F.lit("]"))
    elif shape.kind == "record":
        pairs = F.transform(
            _entries(value), lambda e: F.concat(_quoted(e["key"]), F.lit(":"), _text(shape.item, e["value"]))
        )
        out = F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
    elif shape.kind == "union":
        fits = [F.when(_check(s, value, F.lit("")).isNull(), _text(s, value)) for s in shape.branches]
        out = F.coalesce(*fits)
    else:
        out = F.to_json(value)
    return F.when(F.is_variant_null(value), F.lit("null")).otherwise(out) if shape.nullable else out


def shaped(text: Column, shape: Shape) -> Column:
    """JSON text of the value that the shape reads from JSON text, null where it has a problem:
    keys that it does not declare are gone, absent keys with a default have it, the first
    branch of a union that fits is taken.  A value without change in it is stable: shaping the
    result again gives the result."""
    return _once(F.try_parse_json(text), lambda value: F.when(_issue(value, shape).isNull(), _text(shape, value)))


def round_trip_problem(text: Column, shape: Shape) -> Column:
    """Whether a valid value no longer parses, or changes, when its shaped text is read again."""

    def problem(once: Column, again: Column) -> Column:
        return F.when(once.isNull(), F.lit(None)).when(again.isNull(), "no longer parses").when(again != once, "changes")

    return _once(
        shaped(text, shape), lambda once: _once(shaped(once, shape), lambda again: problem(once, again))
    )


def _undeclared(shape: Shape, value: Column, path: Column) -> Column:
    """Paths of the keys of a variant that its shape does not declare."""
    none = F.array().cast("array<string>")
    if shape.kind == "object":
        known = F.array(*map(F.lit, shape.fields)) if shape.fields else none
        keys = F.coalesce(F.json_object_keys(F.to_json(value)), none)
        own = F.transform(F.array_except(keys, known), lambda k: F.concat(path, F.lit("."), k))
        below = [
            F.coalesce(_undeclared(s, _part(value, k), F.concat(path, F.lit(f".{k}"))), none)
            for k, s in shape.fields.items()
            if s.kind in ("object", "array")
        ]
        return F.concat(own, *below) if below else own
    if shape.kind == "array":
        at = lambda i: F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
        found = F.transform(_items(value), lambda v, i: _undeclared(shape.item, v, at(i)))
        return F.coalesce(F.flatten(found), none)
    # records take any key, and a union can't tell which branch was meant
    return none


def strict_problems(text: Column, shape: Shape) -> Column:
    """Paths of keys that a shape's objects do not declare, sorted; inside arrays with the
    place of the element.  Records and unions are not looked into; text that is no JSON has none."""
    found = _once(F.try_parse_json(text), lambda value: _undeclared(shape, value, F.lit("$")))
    return F.array_sort(F.coalesce(found, F.array().cast("array<string>")))
