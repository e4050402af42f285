"""The contract a dataset is held to, and how its wire form is read."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


class ContractPayloadError(ValueError):
    """A registry answer or contract file that doesn't hold a usable contract."""


class ContractValidationError(ValueError):
    """A snapshot was rejected; where its artifacts lie and how many rows were bad."""

    def __init__(self, message: str, error_path: str | None = None, manifest_path: str | None = None, accepted_path: str | None = None, invalid_count: int = 0):
        super().__init__(message)
        self.error_path, self.manifest_path, self.accepted_path, self.invalid_count = error_path, manifest_path, accepted_path, invalid_count


@dataclass(frozen=True)
class Contract:
    """Fields, types, keys and schema of one version of a dataset."""

    contract_id: str
    version: str
    fields: tuple[str, ...]
    field_types: Mapping[str, str] = field(default_factory=dict)
    required_fields: tuple[str, ...] = ()
    primary_keys: tuple[str, ...] = ()
    business_keys: tuple[str, ...] = ()
    hash_keys: tuple[str, ...] = ()
    schema_json: Mapping[str, Any] = field(default_factory=dict)
    target_layer: str = "curated"
    checksum: str = ""

    @property
    def key_fields(self) -> tuple[str, ...]:
        """Primary keys, else business keys."""
        return self.primary_keys or self.business_keys

    @property
    def effective_hash_fields(self) -> tuple[str, ...]:
        """What the row hash covers: the hash keys, else every field, keys included."""
        return self.hash_keys or self.fields

    def nullable(self, name: str) -> bool:
        return name not in self.required_fields and name not in self.key_fields

    def property_schema(self, name: str) -> Mapping[str, Any]:
        p = (self.schema_json.get("properties") or {}) if isinstance(self.schema_json, Mapping) else {}
        return p[name] if isinstance(p.get(name), Mapping) else {}

    def check(self) -> "Contract":
        """The contract itself; ValueError that tells everything wrong with it."""
        empty = {"contract_id": self.contract_id, "fields": self.fields, "primary_keys and business_keys": self.key_fields}
        wrong = [f"{what} must not be empty" for what, value in empty.items() if not value]
        if not isinstance(self.schema_json, Mapping):
            wrong.append("schema_json must be an object")
        uses = {"a key": self.key_fields, "part of the hash": self.effective_hash_fields, "typed": self.field_types, "required": self.required_fields}
        wrong += [f"{name} is {use}, but no field" for use, names in uses.items() for name in sorted(set(names) - set(self.fields))]
        if wrong:
            raise ValueError(f"contract {self.contract_id!r}: " + "; ".join(wrong))
        return self


#: Contract types of JSON-Schema types that go by another name, and of strings by format (fixed values).
TYPE_NAMES = {"number": "decimal", "object": "json"}
STRING_FORMATS = {"date-time": "timestamp", "date": "date", "time": "time", "uuid": "uuid"}


def _word(value: Any) -> str:
    return value.strip().lower() if isinstance(value, str) else ""


def contract_type(prop: Mapping[str, Any]) -> str | None:
    """Contract type of a JSON-Schema property; of a union the first that isn't null."""
    declared = prop.get("type")
    kinds = [k for k in map(_word, declared) if k and k != "null"] if isinstance(declared, list) else [_word(declared)]
    kind = kinds[0] if kinds else ""
    if kind == "string":
        return STRING_FORMATS.get(_word(prop.get("format")), kind)
    return TYPE_NAMES.get(kind, kind) or None


#: Where the registry's answer holds what a contract has as text, and the schema its lists (fixed names).
TEXTS = {"contract_id": "contract.id", "target_layer": "contract.target_layer", "version": "version.version", "checksum": "version.checksum"}
LISTS = {"primary_keys": "x-primaryKey", "business_keys": "x-businessKey", "hash_keys": "x-hashKeys"}


def _dig(doc: Any, path: str) -> Any:
    for step in path.split("."):
        doc = doc.get(step) if isinstance(doc, Mapping) else None
    return doc


def _text(value: Any, name: str) -> str:
    s = "" if value is None else str(value).strip()
    if not s:
        raise ContractPayloadError(f"{name} is missing or blank")
    return s


def parse_registry_payload(payload: Any) -> Contract:
    """A contract from ``{contract: …, version: …}``, alone or as the ``data`` of an envelope.

    An answer without a ``contract`` part holds its members itself.  Property names are
    stripped, those without a name left out.
    """
    inner = _dig(payload, "data")
    doc = inner if isinstance(inner, Mapping) else payload
    if not isinstance(doc, Mapping):
        raise ContractPayloadError("the payload must be an object")
    if not isinstance(doc.get("contract"), Mapping):
        doc = {**doc, "contract": doc}
    schema = _dig(doc, "version.schema_json")
    props = _dig(schema, "properties")
    named = {k.strip(): p for k, p in props.items() if k.strip()} if isinstance(props, Mapping) else {}
    if _dig(schema, "type") != "object" or not named:
        raise ContractPayloadError("version.schema_json must be a JSON Schema of type object with named properties")
    types = {name: contract_type(p) for name, p in named.items() if isinstance(p, Mapping)}
    required = schema.get("required") if isinstance(schema.get("required"), list) else []
    return Contract(
        fields=tuple(named),
        field_types={name: kind for name, kind in types.items() if kind},
        required_fields=tuple(dict.fromkeys(r.strip() for r in required if isinstance(r, str) and r.strip())),
        schema_json=schema,
        **{name: _text(_dig(doc, path), path) for name, path in TEXTS.items()},
        **{name: tuple(map(str, schema.get(key) or ())) for name, key in LISTS.items()},
    )


def load_contract_file(path: str) -> Contract:
    """A contract from a file in either form: the registry's, or the fields themselves."""
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    if not isinstance(raw, dict):
        raise ContractPayloadError("a contract file must hold an object")
    if "fields" not in raw:
        return parse_registry_payload(raw).check()
    names = ("fields", "required_fields", "primary_keys", "business_keys", "hash_keys")
    return Contract(
        contract_id=_text(raw.get("contract_id"), "contract_id"),
        version=str(raw.get("version") or ""),
        target_layer=str(raw.get("target_layer") or "curated"),
        checksum=str(raw.get("checksum") or ""),
        field_types=dict(raw.get("field_types") or {}),
        schema_json=raw.get("schema_json") or {},
        **{n: tuple(raw.get(n) or ()) for n in names},
    ).check()


def validate_identifier(name: str) -> str:
    """A name that is safe unquoted; ValueError for any other."""
    if not isinstance(name, str) or not IDENTIFIER.fullmatch(name):
        raise ValueError(f"not a valid identifier: {name!r}")
    return name


def parse_table_name(name: str, default_schema: str = "public") -> tuple[str, str]:
    """(schema, table); a name without a schema is in ``public``."""
    parts = name.split(".")
    if len(parts) > 2:
        raise ValueError(f"not a table name: {name!r}")
    schema, table = parts if len(parts) == 2 else (default_schema, parts[0])
    return validate_identifier(schema), validate_identifier(table)
