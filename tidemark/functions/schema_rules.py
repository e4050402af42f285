"""A JSON Schema compiled into Columns that list its violations.

Every node becomes a few conditional structs; a node whose type is wrong reports only
that.  Scalars are tested as typed columns; nested values as variants, so that JSON null,
absent members and undeclared members can be told apart.  Keywords that aren't listed in
``KEYWORDS`` are ignored, as is a root that isn't an object with properties.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.canonical import canonical_text, let
from tidemark.functions.formats import matches_format, matches_pattern

KEYWORDS = ("type", "const", "enum", "minLength", "maxLength", "pattern", "format", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "required", "additionalProperties", "properties", "minItems", "maxItems", "items")
VIOLATION = "struct<field:string,code:string,message:string,constraint:string,actual_value:string,contract_title:string,contract_description:string>"
NUMBER = T.DecimalType(38, 18)


def _type_names(schema: Mapping[str, Any]) -> list[str]:
    t = schema.get("type")
    return [t] if isinstance(t, str) else [x for x in t if isinstance(x, str)] if isinstance(t, list) else []


def _text_of(schema: Mapping[str, Any], name: str) -> str | None:
    v = schema.get(name)
    return v.strip() if isinstance(v, str) and v.strip() else None


def _json(value: Any) -> str:
    return json.dumps(value, ensure_ascii=True, sort_keys=True)


class _Value:
    """One value under test: its JSON type, and itself as text, number and variant."""

    def __init__(self, c: Column, kind: T.DataType, shape: Column | None = None):
        self.c, self.kind = c, kind
        if isinstance(kind, T.VariantType):
            shape = F.schema_of_variant(c) if shape is None else shape
            self.type = (
                F.when(c.isNull() | (shape == "VOID"), "null")
                .when(shape == "BOOLEAN", "boolean").when(shape == "STRING", "string")
                .when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "array")
                .when(shape.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "integer").otherwise("number")
            )
            self.text = F.try_variant_get(c, "$", "string")
            self.number = F.try_variant_get(c, "$", NUMBER.simpleString())
            self.boolean = F.try_variant_get(c, "$", "boolean")
            self.shown = F.to_json(c)
        else:
            if isinstance(kind, T.BooleanType):
                name = F.lit("boolean")
            elif isinstance(kind, T.IntegralType):
                name = F.lit("integer")
            elif isinstance(kind, (T.DoubleType, T.FloatType)):
                name = F.when(F.isnan(c) | F.abs(c).isin(float("inf")), "not finite").otherwise("number")
            elif isinstance(kind, T.DecimalType):
                name = F.lit("number")
            else:
                name = F.lit("string")
            self.type = F.when(c.isNull(), "null").otherwise(name)
            self.text = c if isinstance(kind, T.StringType) else canonical_text(c, kind, null_text=False)
            self.number = c.try_cast(NUMBER) if isinstance(kind, T.NumericType) else F.lit(None).cast(NUMBER)
            self.boolean = c if isinstance(kind, T.BooleanType) else F.lit(None).cast("boolean")
            if isinstance(kind, T.BooleanType):
                self.shown = c.cast("string")
            elif isinstance(kind, T.NumericType):
                self.shown = F.regexp_replace(F.regexp_replace(c.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
            else:
                quoted = F.to_json(F.struct(self.text.alias("v")))
                self.shown = quoted.substr(F.lit(6), F.length(quoted) - 6)

    def is_type(self, name: str) -> Column:
        if name == "number":
            return self.type.isin("number", "integer")
        return self.type == name if name in ("null", "boolean", "string", "integer", "object", "array") else F.lit(True)

    def equals(self, literal: Any) -> Column:
        """By value: numbers by amount, booleans never equal numbers."""
        if literal is None:
            return self.type == "null"
        if isinstance(literal, bool):
            return F.coalesce((self.type == "boolean") & (self.boolean == literal), F.lit(False))
        if isinstance(literal, (int, float, Decimal)):
            return F.coalesce(self.type.isin("number", "integer") & (self.number == F.lit(str(literal)).cast(NUMBER)), F.lit(False))
        if isinstance(literal, str):
            return F.coalesce((self.type == "string") & (self.text == literal), F.lit(False))
        if isinstance(self.kind, T.VariantType):
            return F.coalesce(self.shown == F.to_json(F.parse_json(F.lit(json.dumps(literal)))), F.lit(False))
        return F.lit(False)


class SchemaCompiler:
    """Compiles one schema.  ``strict_optional``: a null breaks a declared type."""

    def __init__(self, strict_optional: bool = True):
        self.strict_optional = strict_optional

    @staticmethod
    def _violation(schema: Mapping[str, Any], path: Column, code: str, constraint: str | Column, reason: str | Column, actual: Column | None) -> Column:
        title, about = _text_of(schema, "title"), _text_of(schema, "description")
        constraint = F.lit(constraint) if isinstance(constraint, str) else constraint
        reason = F.lit(reason) if isinstance(reason, str) else reason
        parts = [F.concat(F.lit("Constraint: "), constraint, F.lit(".")), F.concat(F.lit("Reason: "), reason, F.lit("."))]
        if actual is not None:
            parts.append(F.concat(F.lit("Actual value: "), actual, F.lit(".")))
        if title:
            parts.append(F.lit(f"Contract title: {title}."))
        if about:
            parts.append(F.lit(f"Contract description: {about}."))
        return F.struct(
            path.alias("field"), F.lit(code).alias("code"), F.concat_ws(" ", *parts).alias("message"), constraint.alias("constraint"),
            (F.lit(None).cast("string") if actual is None else actual).alias("actual_value"), F.lit(title).cast("string").alias("contract_title"), F.lit(about).cast("string").alias("contract_description"),
        )

    @staticmethod
    def _listed(parts: Sequence[tuple[Column, Column]]) -> Column:
        """The violations whose condition holds, in order."""
        if not parts:
            return F.array().cast(f"array<{VIOLATION}>")
        return F.filter(F.array(*[F.when(cond, v) for cond, v in parts]), lambda x: x.isNotNull())

    def node(self, schema: Mapping[str, Any], c: Column, kind: T.DataType, path: Column, depth: int = 0) -> Column:
        """array<VIOLATION> of a value that is present; a variant is parsed once."""
        if not isinstance(kind, T.VariantType):
            return self._node(schema, _Value(c, kind), path, depth)
        return let(F.struct(c.alias("c"), F.schema_of_variant(c).alias("shape")), lambda b: self._node(schema, _Value(b["c"], kind, b["shape"]), path, depth))

    def _node(self, schema: Mapping[str, Any], v: _Value, path: Column, depth: int) -> Column:
        kind = v.kind
        names = _type_names(schema)
        report = lambda code, constraint, reason, actual=v.shown: self._violation(schema, path, code, constraint, reason, actual)
        parts: list[tuple[Column, Column]] = []
        if "const" in schema:
            parts.append((~v.equals(schema["const"]), report("schema.const", f"const={_json(schema['const'])}", "the value isn't the contract's constant")))
        allowed = schema.get("enum")
        if isinstance(allowed, list):
            hit = F.lit(False)
            for x in allowed:
                hit = hit | v.equals(x)
            parts.append((~hit, report("schema.enum", f"enum={_json(allowed)}", "the value isn't among those allowed")))
        if "string" in names:
            parts += self._string(schema, v, report)
        if "integer" in names or "number" in names:
            parts += self._number(schema, v, report)
        found = self._listed(parts)
        if isinstance(kind, T.VariantType):
            if "object" in names:
                found = F.when(v.type == "object", F.concat(found, self._object(schema, v, path, depth))).otherwise(found)
            if "array" in names:
                found = F.when(v.type == "array", F.concat(found, self._array(schema, v, path, depth))).otherwise(found)
        if names:
            fits = F.lit(False)
            for n in names:
                fits = fits | v.is_type(n)
            expected = names[0] if len(names) == 1 else _json(names)
            wrong = F.array(report("schema.type", f'type="{names[0]}"' if len(names) == 1 else f"type={_json(names)}", F.concat(F.lit(f"expected {expected}, got "), v.type), F.coalesce(v.shown, F.lit("null"))))
            found = F.when(fits, found).otherwise(wrong)
        if not self.strict_optional:
            found = F.when(v.type == "null", self._listed([])).otherwise(found)
        return found

    @staticmethod
    def _string(schema: Mapping[str, Any], v: _Value, report) -> list[tuple[Column, Column]]:
        out, length = [], F.char_length(v.text)
        is_text = v.type == "string"
        bound = lambda k: schema.get(k) if isinstance(schema.get(k), int) and not isinstance(schema.get(k), bool) else None
        if (n := bound("minLength")) is not None:
            out.append((is_text & (length < n), report("schema.min_length", f"minLength={n}", F.format_string(f"%d characters are fewer than {n}", length))))
        if (n := bound("maxLength")) is not None:
            out.append((is_text & (length > n), report("schema.max_length", f"maxLength={n}", F.format_string(f"%d characters are more than {n}", length))))
        if isinstance(p := schema.get("pattern"), str):
            out.append((is_text & ~matches_pattern(v.text, p), report("schema.pattern", f"pattern={_json(p)}", "the text doesn't match the pattern")))
        if isinstance(f := schema.get("format"), str) and f.strip():
            holds = F.lit(False) if f.strip().lower() == "date-time" and isinstance(v.kind, (T.TimestampNTZType, T.DateType)) else F.coalesce(matches_format(v.text, f), F.lit(False))
            out.append((is_text & ~holds, report("schema.format", f"format={_json(f)}", f"the text isn't of format {f}")))
        return out

    @staticmethod
    def _number(schema: Mapping[str, Any], v: _Value, report) -> list[tuple[Column, Column]]:
        out, is_number = [], v.type.isin("number", "integer")
        rules = {
            "minimum": ("schema.minimum", lambda x, b: x < b, "less than"),
            "maximum": ("schema.maximum", lambda x, b: x > b, "greater than"),
            "exclusiveMinimum": ("schema.exclusive_minimum", lambda x, b: x <= b, "not greater than"),
            "exclusiveMaximum": ("schema.exclusive_maximum", lambda x, b: x >= b, "not less than"),
        }
        for key, (code, broken, words) in rules.items():
            b = schema.get(key)
            if b is None:
                continue
            if isinstance(b, bool) or not isinstance(b, (int, float, Decimal)):
                raise ValueError(f"{key} must be a number, not {b!r}")
            out.append((is_number & broken(v.number, F.lit(str(b)).cast(NUMBER)), report(code, f"{key}={_json(b)}", F.concat(v.shown, F.lit(f" is {words} {b}")))))
        return out

    def _object(self, schema: Mapping[str, Any], v: _Value, path: Column, depth: int) -> Column:
        props = schema["properties"] if isinstance(schema.get("properties"), Mapping) else {}
        all_members = F.coalesce(v.c.try_cast("map<string,variant>"), F.create_map().cast("map<string,variant>"))
        return let(all_members, lambda members: self._members(schema, props, members, path, depth))

    def _members(self, schema: Mapping[str, Any], props: Mapping[str, Any], members: Column, path: Column, depth: int) -> Column:
        child = lambda name: F.concat(path, F.lit("."), F.lit(name) if isinstance(name, str) else name)
        needed = [n for n in schema.get("required") or [] if isinstance(n, str)] if isinstance(schema.get("required"), list) else []
        chunks = [self._listed([(~F.map_contains_key(members, n), self._violation(schema, child(n), "schema.required", f"required contains {_json(n)}", f"property {n} is absent", F.lit("<missing>"))) for n in needed])]
        if schema.get("additionalProperties", True) is False:
            extra = F.array_sort(F.array_except(F.map_keys(members), F.array(*[F.lit(p) for p in props]).cast("array<string>")))
            chunks.append(F.transform(extra, lambda n: self._violation(schema, child(n), "schema.additional_properties", "additionalProperties=false", F.concat(F.lit("property "), n, F.lit(" isn't declared")), F.concat(F.lit('"'), n, F.lit('"')))))
        for name, sub in props.items():
            if isinstance(sub, Mapping):
                here = F.map_contains_key(members, name)
                chunks.append(F.when(here, self.node(sub, members[name], T.VariantType(), child(name), depth + 1)).otherwise(self._listed([])))
        return F.concat(*chunks)

    def _array(self, schema: Mapping[str, Any], v: _Value, path: Column, depth: int) -> Column:
        every = F.coalesce(v.c.try_cast("array<variant>"), F.array().cast("array<variant>"))
        return let(every, lambda items: self._items(schema, v, items, path, depth))

    def _items(self, schema: Mapping[str, Any], v: _Value, items: Column, path: Column, depth: int) -> Column:
        parts = []
        for key, code, broken, words in (("minItems", "schema.min_items", lambda n, b: n < b, "fewer"), ("maxItems", "schema.max_items", lambda n, b: n > b, "more")):
            b = schema.get(key)
            if isinstance(b, int) and not isinstance(b, bool):
                parts.append((broken(F.size(items), b), self._violation(schema, path, code, f"{key}={b}", F.format_string(f"%d items are {words} than {b}", F.size(items)), v.shown)))
        found = self._listed(parts)
        if isinstance(sub := schema.get("items"), Mapping):
            each = F.transform(items, lambda x, i: self.node(sub, x, T.VariantType(), F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), depth + 1))
            found = F.concat(found, F.flatten(each))
        return found


def root_violations(schema: Mapping[str, Any] | None, fields: Sequence[tuple[str, Column, T.DataType]], strict_optional: bool = True) -> list[Column]:
    """Violation arrays of a row with the given members, in the schema's order.

    Empty when the schema isn't an object with properties.
    """
    if not isinstance(schema, Mapping) or schema.get("type") != "object" or not isinstance(schema.get("properties"), Mapping):
        return []
    compiler, props = SchemaCompiler(strict_optional), schema["properties"]
    names = {n for n, _, _ in fields}
    fixed = []
    for n in schema.get("required") if isinstance(schema.get("required"), list) else []:
        if isinstance(n, str) and n not in names:
            fixed.append(compiler._violation(schema, F.lit(n), "schema.required", f"required contains {_json(n)}", f"property {n} is absent", F.lit("<missing>")))
    if schema.get("additionalProperties", True) is False:
        for n in sorted(names - set(props)):
            fixed.append(compiler._violation(schema, F.lit(n), "schema.additional_properties", "additionalProperties=false", f"property {n} isn't declared", F.lit(_json(n))))
    out = [F.array(*fixed)] if fixed else []
    by_name = {n: (c, k) for n, c, k in fields}
    for name, sub in props.items():
        if name in by_name and isinstance(sub, Mapping):
            c, kind = by_name[name]
            if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
                c, kind = F.try_parse_json(F.to_json(c)), T.VariantType()
            elif isinstance(kind, T.StringType) and {"object", "array"} & set(_type_names(sub)):
                c, kind = F.try_parse_json(c), T.VariantType()
            out.append(compiler.node(sub, c, kind, F.lit(name)))
    return out
