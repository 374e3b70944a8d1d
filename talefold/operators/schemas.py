"""JSON documents against a JSON Schema, and secrets taken out of nested rows.

A schema is compiled into one column over VARIANT values: each keyword is an expression,
items of arrays are looked at by a lambda, so a document of any size is checked where it
is read, and a finding names the place of the value and the keyword that it breaks.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.recordings import redact

#: Keywords that say nothing about a value, and those that are known.
NOTES = {"$schema", "$id", "$defs", "definitions", "title", "description", "default", "examples", "format", "$comment"}
KNOWN = NOTES | {
    *("$ref", "type", "const", "enum", "minLength", "maxLength", "pattern", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum"),
    *("items", "minItems", "maxItems", "uniqueItems", "properties", "required", "additionalProperties", "minProperties", "maxProperties", "allOf", "anyOf"),
}
_NONE = "array<string>"


def _get(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def _with(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c), with c computed once."""
    return F.transform(F.array(c), use)[0]


def _kind(v: Column) -> Column:
    """The JSON type of a value: integers are whole numbers, however they are written."""

    def named(told: Column) -> Column:
        number = told.startswith("DECIMAL") | told.isin("DOUBLE", "FLOAT", "BIGINT", "INT", "SMALLINT", "TINYINT")
        whole = F.coalesce(_get(v, "double") == F.floor(_get(v, "double")), F.lit(False))
        other = F.when(told == "STRING", "string").when(told == "BOOLEAN", "boolean").when(told == "VOID", "null").when(told.startswith("OBJECT"), "object").when(told.startswith("ARRAY"), "array")
        return F.when(number, F.when(whole, "integer").otherwise("number")).otherwise(other)

    return _with(F.schema_of_variant(v), named)


def _is(kind: Column, name: str) -> Column:
    return kind.isin("integer", "number") if name == "number" else kind == name


def _equals(v: Column, kind: Column, value: object) -> Column:
    if value is None:
        return kind == "null"
    if isinstance(value, bool):
        return (kind == "boolean") & (_get(v, "boolean") == value)
    if isinstance(value, str):
        return (kind == "string") & (_get(v, "string") == value)
    if isinstance(value, int | float):
        return _is(kind, "number") & (_get(v, "double") == float(value))
    return F.to_json(v) == F.to_json(F.parse_json(F.lit(json.dumps(value))))


def _resolved(schema: dict, root: dict, seen: tuple[str, ...]) -> tuple[dict, tuple[str, ...]]:
    while "$ref" in schema:
        ref = schema["$ref"]
        if not ref.startswith("#/") or ref in seen:
            raise ValueError(f"{ref}: only references inside the document that end are followed")
        target = root
        for part in ref[2:].split("/"):
            target = target[part.replace("~1", "/").replace("~0", "~")]
        schema, seen = {**target, **{k: x for k, x in schema.items() if k != "$ref"}}, (*seen, ref)
    return schema, seen


def findings(v: Column, path: Column, schema: dict | bool, root: dict | None = None, seen: tuple[str, ...] = ()) -> Column:
    """'place: keyword' of all that the variant v breaks, as an array; v is not null."""
    if isinstance(schema, bool):
        return F.array().cast(_NONE) if schema else F.array(F.concat(path, F.lit(": false")))
    known = F.struct(v.alias("v"), _kind(v).alias("kind"), path.alias("path"))
    return _with(known, lambda x: _broken(x["v"], x["kind"], x["path"], schema, schema if root is None else root, seen))


def _broken(v: Column, kind: Column, path: Column, schema: dict, root: dict, seen: tuple[str, ...]) -> Column:
    schema, seen = _resolved(schema, root, seen)
    if unknown := set(schema) - KNOWN:
        raise ValueError(f"unknown keywords: {sorted(unknown)}")
    rules: list[tuple[str, Column]] = []
    nested: list[Column] = []
    below = lambda x, p, s: findings(x, p, s, root, seen)

    def when(name: str, of: str, broken: Callable[[object], Column], label: str | None = None) -> None:
        if name in schema:
            rules.append((label or name, _is(kind, of) & broken(schema[name])))

    if "type" in schema:
        names = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        ok = F.lit(False)
        for name in names:
            ok = ok | _is(kind, name)
        rules.append(("type", ~ok))
    if "const" in schema:
        rules.append(("const", ~F.coalesce(_equals(v, kind, schema["const"]), F.lit(False))))
    if "enum" in schema:
        ok = F.lit(False)
        for value in schema["enum"]:
            ok = ok | F.coalesce(_equals(v, kind, value), F.lit(False))
        rules.append(("enum", ~ok))
    text, number = _get(v, "string"), _get(v, "double")
    when("minLength", "string", lambda n: F.length(text) < n)
    when("maxLength", "string", lambda n: F.length(text) > n)
    when("pattern", "string", lambda p: ~text.rlike(p))
    when("minimum", "number", lambda n: number < float(n))
    when("maximum", "number", lambda n: number > float(n))
    when("exclusiveMinimum", "number", lambda n: number <= float(n))
    when("exclusiveMaximum", "number", lambda n: number >= float(n))
    items = _get(v, "array<variant>")
    when("minItems", "array", lambda n: F.size(items) < n)
    when("maxItems", "array", lambda n: F.size(items) > n)
    if schema.get("uniqueItems"):
        when("uniqueItems", "array", lambda _: F.size(F.array_distinct(F.transform(items, lambda x: F.to_json(x)))) < F.size(items))
    if "items" in schema:
        each = F.flatten(F.transform(items, lambda x, i: below(x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), schema["items"])))
        nested.append(F.when(_is(kind, "array"), each))
    fields = _get(v, "map<string,variant>")
    when("minProperties", "object", lambda n: F.size(fields) < n)
    when("maxProperties", "object", lambda n: F.size(fields) > n)
    for name in schema.get("required", []):
        rules.append((f"required {name}", _is(kind, "object") & ~F.map_contains_key(fields, F.lit(name))))
    for name, own in schema.get("properties", {}).items():
        # As the one element of an array, so that the value is taken out once.
        held = F.filter(F.array(fields[name]), lambda x: x.isNotNull())
        nested.append(F.when(_is(kind, "object"), F.flatten(F.transform(held, lambda x: below(x, F.concat(path, F.lit(f".{name}")), own)))))
    more = schema.get("additionalProperties", True)
    if more is not True:
        known = list(schema.get("properties", {}))
        others = F.filter(F.map_keys(fields), lambda k: ~k.isin(known)) if known else F.map_keys(fields)
        if more is False:
            nested.append(F.when(_is(kind, "object"), F.transform(others, lambda k: F.concat(path, F.lit(": additionalProperties "), k))))
        else:
            nested.append(F.when(_is(kind, "object"), F.flatten(F.transform(others, lambda k: below(fields[k], F.concat(path, F.lit("."), k), more)))))
    nested += [below(v, path, own) for own in schema.get("allOf", [])]
    if "anyOf" in schema:
        fits = F.lit(False)
        for own in schema["anyOf"]:
            fits = fits | (F.size(F.coalesce(below(v, path, own), F.array().cast(_NONE))) == 0)
        rules.append(("anyOf", ~fits))
    told = F.array(*(F.when(F.coalesce(broken, F.lit(False)), F.concat(path, F.lit(f": {name}"))) for name, broken in rules)) if rules else F.array().cast(_NONE)
    return F.concat(F.array_compact(told), *(F.coalesce(x, F.array().cast(_NONE)) for x in nested))


def schema_findings(rows: DataFrame, key: str, column: str, schema: dict) -> DataFrame:
    """key, findings (sorted) of the JSON texts or variants in a column; a text that is no JSON breaks `json` alone, as does a null."""
    # As the one element of an array, as a parser by itself ignores what follows the first value.
    alone = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), F.col(column), F.lit("]"))), "$", "array<variant>")
    v = F.col(column) if isinstance(rows.schema[column].dataType, T.VariantType) else F.when(F.size(alone) == 1, alone[0])
    parsed = rows.select(key, v.alias("v"))
    return parsed.select(key, F.when(F.col("v").isNull(), F.array(F.lit("$: json"))).otherwise(F.array_sort(findings(F.col("v"), F.lit("$"), schema))).alias("findings"))


def without_secrets(rows: DataFrame, secrets: list[str], mark: str = "***REDACTED***") -> DataFrame:
    """rows with the secrets replaced in every text at any depth: fields of structs, items of arrays, values of maps and variants.

    Names of fields and keys of maps stay as they are; those of variants are texts of their JSON and are rewritten with it.
    """
    escaped = sorted({*secrets, *(json.dumps(s, ensure_ascii=False)[1:-1] for s in secrets)}, key=len, reverse=True)

    def of(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType):
            return redact(c, secrets, mark)
        if isinstance(kind, T.ArrayType) and _holds_text(kind):
            return F.transform(c, lambda x: of(x, kind.elementType))
        if isinstance(kind, T.MapType) and _holds_text(kind.valueType):
            return F.transform_values(c, lambda _, x: of(x, kind.valueType))
        if isinstance(kind, T.StructType) and _holds_text(kind):
            return F.when(c.isNotNull(), F.struct(*(of(c.getField(f.name), f.dataType).alias(f.name) for f in kind.fields)))
        if isinstance(kind, T.VariantType):
            return F.parse_json(redact(F.to_json(c), escaped, mark))
        return c

    return rows.select(*(of(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in rows.schema.fields))


def _holds_text(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _holds_text(kind.elementType)
    if isinstance(kind, T.MapType):
        return _holds_text(kind.valueType)
    if isinstance(kind, T.StructType):
        return any(_holds_text(f.dataType) for f in kind.fields)
    return isinstance(kind, T.StringType | T.VariantType)
