"""Reading files of drifting schemas into one table, and reporting every change.

Rescue-column ingestion: a payload is parsed once, members that the file's contract
version declares and whose value can be cast go to the typed part, everything else is
kept as JSON in the rescue column.  What was ingested is stored, and everything else reads
that: the report of undeclared fields, the values that tell renames, promotion of approved
fields by replaying rescued values, and the table under current names.

Contracts are metadata: versions of one contract are compared in one task.  What is
said about values comes from the landed rows through distributed aggregation.
"""

from __future__ import annotations

import datetime as dt
import json
import math
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import broadcast_if_small, kept, shared_dir

#: Rows of contract metadata that the driver takes in (and MAX_BYTES of them); more stay distributed.
MAX_METADATA = 200_000
FIELD_SCHEMA = "contract_id string, version string, step long, position long, field string, kind string, described string, former string, key_fields array<string>"
CHANGE_SCHEMA = "contract_id string, version string, change string, field string, old_field string"
#: How schema authors note a field's former name: a keyword, or a comment.
FORMER_KEYWORDS = ("x-formerName", "x-former-name", "x-renamedFrom", "x-renamed-from")
FORMER_COMMENT = re.compile(r"\b(?:called|named|formerly|was|renamed from)\s+[`'\"]?([A-Za-z_][A-Za-z0-9_]*)", re.I)
#: Share of records with equal values under both names that speaks for, or against, a rename.
AGREE, DISAGREE, LEAST_RECORDS = 0.6, 0.2, 3


def kind_of(prop: dict) -> str:
    """Type (null aside) and format as one text."""
    t = prop.get("type")
    names = sorted({str(x) for x in (t if isinstance(t, list) else [t]) if x not in (None, "null")})
    return "|".join(names) + ("/" + str(prop["format"]) if prop.get("format") else "")


def _former(prop: dict) -> str | None:
    for k in FORMER_KEYWORDS:
        if isinstance(prop.get(k), str):
            return prop[k]
    m = FORMER_COMMENT.search(prop["$comment"]) if isinstance(prop.get("$comment"), str) else None
    return m[1] if m else None


def _described(prop: dict) -> str:
    d = prop.get("description") or prop.get("title") or ""
    return re.sub(r"[\s.]+", " ", str(d)).strip().lower()


def _fields_of(pdf: pd.DataFrame) -> pd.DataFrame:
    """Fields of each version of one contract, versions in order of first publication."""
    first = pdf.sort_values(["published_at", "version", "schema_json"], na_position="last", kind="stable").drop_duplicates("version")
    out = []
    for step, r in enumerate(first.itertuples(index=False)):
        try:
            schema = json.loads(r.schema_json or "{}")
        except ValueError:
            schema = {}
        props = schema.get("properties") if isinstance(schema, dict) else None
        if not isinstance(props, dict) or not props:
            types = dict(r.field_types) if r.field_types is not None else {}
            props = {f: {"type": types.get(f)} for f in (r.fields if r.fields is not None else [])}
        keys = next((list(k) for k in (r.primary_keys, r.business_keys) if k is not None and len(k)), [])
        for i, (f, p) in enumerate(props.items()):
            p = p if isinstance(p, dict) else {}
            out.append((r.contract_id, r.version, step, i, f, kind_of(p), _described(p), _former(p), keys))
    return pd.DataFrame(out, columns=["contract_id", "version", "step", "position", "field", "kind", "described", "former", "key_fields"])


def schema_fields(contracts: DataFrame) -> DataFrame:
    """One row per contract version and field.

    A version registered again counts from its first publication; a version without a
    usable schema is described by ``fields`` and ``field_types``; rows without contract
    or version are left out.
    """
    cols = ["contract_id", "version", "published_at", "schema_json", "fields", "field_types", "primary_keys", "business_keys"]
    usable = contracts.select(*cols).where("contract_id is not null and version is not null")
    return kept(usable.groupBy("contract_id").applyInPandas(_fields_of, FIELD_SCHEMA))


def _steps(pdf: pd.DataFrame) -> Iterable[tuple[str, dict, dict]]:
    """(later version, fields before, fields after); fields by name, in order."""
    previous = None
    for _, rows in pdf.sort_values(["step", "position"]).groupby("step", sort=True):
        now = {r.field: r for r in rows.itertuples(index=False)}
        if previous is not None:
            yield rows["version"].iloc[0], previous, now
        previous = now


def _anchor(fields: dict, name: str, other: dict) -> int:
    """How many fields that both versions have stand before this one."""
    n = 0
    for f in fields:
        if f == name:
            return n
        n += f in other
    return n


def _possible(old, new) -> bool:
    if new.former == old.field:
        return True
    if new.former or (old.described and new.described and old.described != new.described):
        return False
    return old.kind == new.kind or bool(old.described and old.described == new.described)


def _candidates(pdf: pd.DataFrame) -> pd.DataFrame:
    out = []
    for version, before, now in _steps(pdf):
        for o in before.values():
            if o.field not in now:
                for n in now.values():
                    if n.field not in before and _possible(o, n) and n.former != o.field:
                        out.append((n.contract_id, version, o.field, n.field, list(n.key_fields)))
    return pd.DataFrame(out, columns=["contract_id", "version", "old_field", "field", "key_fields"])


def _changes(pdf: pd.DataFrame, seen: pd.DataFrame) -> pd.DataFrame:
    """Changes of one contract; ``seen``: records and agreement of candidate pairs."""
    values = {(r.version, r.old_field, r.field): (r.n_records, r.n_equal) for r in seen.itertuples(index=False)}
    out = []
    for version, before, now in _steps(pdf):
        gone, new = [o for f, o in before.items() if f not in now], [n for f, n in now.items() if f not in before]
        scored = []
        for o in gone:
            for n in new:
                if not _possible(o, n):
                    continue
                n_records, n_equal = values.get((version, o.field, n.field), (0, 0))
                share = n_equal / n_records if n_records >= LEAST_RECORDS else None
                same_place = _anchor(before, o.field, now) == _anchor(now, n.field, before)
                if n.former == o.field:
                    score = 100
                elif o.described and o.described == n.described:
                    score = 60
                elif share is not None:
                    score = 40 if share >= AGREE else 0 if share <= DISAGREE else 15 * same_place
                else:
                    score = 20 * same_place
                if score:
                    scored.append((-score, -(share or 0), not same_place, abs(o.position - n.position), o.position, n.position, o, n))
        renamed, taken = {}, set()
        for *_, o, n in sorted(scored, key=lambda x: x[:6]):
            if n.field not in renamed and o.field not in taken:
                renamed[n.field] = o
                taken.add(o.field)
        cid = next(iter(now.values())).contract_id if now else next(iter(before.values())).contract_id
        for n in now.values():
            o = before.get(n.field) or renamed.get(n.field)
            if n.field in renamed:
                out.append((cid, version, "renamed", n.field, o.field))
            elif o is None:
                out.append((cid, version, "added", n.field, ""))
            if o is not None and o.kind != n.kind:
                out.append((cid, version, "retyped", n.field, ""))
        out += [(cid, version, "removed", o.field, "") for o in gone if o.field not in taken]
    return pd.DataFrame(out, columns=["contract_id", "version", "change", "field", "old_field"])


class _Number(str):
    """A number as it was written."""

    __slots__ = ()


def _distinct(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    found = dict(pairs)
    if len(found) != len(pairs):
        raise ValueError("a member name is repeated")
    return found


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} isn't JSON")


_STRICT = json.JSONDecoder(object_pairs_hook=_distinct, parse_float=_Number, parse_int=_Number, parse_constant=_no_constant)
_PLAIN = json.JSONDecoder(parse_float=_Number, parse_int=_Number, parse_constant=_no_constant)


def _decoded(payload: str) -> Any:
    """The JSON value of a text; ValueError if it isn't JSON or repeats a member name.

    What was read accounts for a number of quotation marks.  A repeated name, an escaped
    mark or a deeper value leaves more of them in the text, which is then read strictly.
    """
    found = _PLAIN.decode(payload)
    if type(found) is not dict:
        return found
    marks = 2 * len(found)
    for v in found.values():
        kind = type(v)
        if kind is str:
            marks += 2
        elif kind is list:
            marks += 2 * [type(x) for x in v].count(str)
        elif kind is dict:
            marks += 2 * len(v) + 2 * [type(x) for x in v.values()].count(str)
    return found if marks == payload.count('"') else _STRICT.decode(payload)


_compact = json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode
_quoted = json.encoder.encode_basestring


def _written(v: Any) -> str:
    """A value as compact JSON, numbers as they were."""
    if type(v) is _Number:
        return str(v)
    if type(v) is list:
        return "[" + ",".join([_quoted(x) if type(x) is str else _written(x) for x in v]) + "]"
    if type(v) is dict:
        return "{" + ",".join([f"{_quoted(k)}:{_quoted(x) if type(x) is str else _written(x)}" for k, x in v.items()]) + "}"
    return _quoted(v) if type(v) is str else _compact(v)


def payload_members(payload: str | None) -> dict[str, str | None] | None:
    """Members of a well-formed JSON object as text; None for anything else.

    Text after the object, single quotes, cut lines, NaN and repeated member names aren't
    well-formed.  A number stays as it was written, a nested value is compact JSON.
    """
    try:
        found = _decoded(payload) if payload else None
    except (ValueError, RecursionError):
        return None
    if type(found) is not dict:
        return None
    for k, v in found.items():
        if v is not None and type(v) is not str and type(v) is not _Number:
            found[k] = _written(v)
    return found


_NOISE = {ord(c): None for c in '[]" \t\n\r\f\v'}


def _plain(v: str) -> str:
    """A value's text without brackets, quotes, blanks and fractions, to compare across types."""
    bare = v.translate(_NOISE).lower()
    if bare.isdigit() and bare.isascii():
        return bare.lstrip("0") or "0"
    try:
        number = float(bare)
    except ValueError:
        return bare
    return str(math.floor(number)) if math.isfinite(number) and "_" not in bare else bare


def value_agreement(ingested: DataFrame, candidates: DataFrame) -> DataFrame:
    """For each candidate rename: records seen under both names, and with equal values.

    A record lands in several files, under the old and the new schema.  ``ingested`` is
    what ``rescue_ingest`` gives when it is told the candidates: each line's record and the
    values of the members that are asked for, and nothing else of it goes on.
    """
    sides = candidates.select("contract_id", "version", "old_field", "field", F.explode(F.array(F.lit(True), F.lit(False))).alias("is_old")).withColumn("name", F.when(F.col("is_old"), F.col("old_field")).otherwise(F.col("field")))
    entries = ingested.where("record is not null").select("contract_id", "record", F.explode("watched").alias("name", "v"))
    seen = entries.join(broadcast_if_small(sides), ["contract_id", "name"])
    both = seen.groupBy("contract_id", "version", "old_field", "field", "record").agg(
        F.min(F.when(F.col("is_old"), F.col("v"))).alias("a0"), F.max(F.when(F.col("is_old"), F.col("v"))).alias("a1"),
        F.min(F.when(~F.col("is_old"), F.col("v"))).alias("b0"), F.max(F.when(~F.col("is_old"), F.col("v"))).alias("b1"),
    ).where("a0 is not null and b0 is not null")
    equal = F.col("a0").isin(F.col("b0"), F.col("b1")) | F.col("a1").isin(F.col("b0"), F.col("b1"))
    return both.groupBy("contract_id", "version", "old_field", "field").agg(F.count("*").alias("n_records"), F.count_if(equal).alias("n_equal"))


def rename_candidates(fields: DataFrame) -> DataFrame:
    """Removed and added fields of one step that could be one, with the contract's key fields."""
    return kept(fields.groupBy("contract_id").applyInPandas(_candidates, "contract_id string, version string, old_field string, field string, key_fields array<string>"))


def schema_changes(contracts: DataFrame, landed: DataFrame | None = None, ingested: DataFrame | None = None, fields: DataFrame | None = None) -> DataFrame:
    """Every change from one version of a contract to the next.

    ``contract_id, version`` (the later one)``, change`` (added, removed, renamed,
    retyped)``, field, old_field`` (empty unless renamed).  A removed and an added field
    are one renamed field if the schema notes the former name, if their descriptions say
    the same, or, where there is no description to compare, if landed records have the
    same values under both names; without enough such records, if both stand in the same
    place and have the same type.  A renamed field of another type is retyped as well.
    Landed values come from ``ingested`` (which has to know the candidates), or from
    ``landed``, which is then ingested.
    """
    fields = schema_fields(contracts) if fields is None else fields
    pairs = rename_candidates(fields)
    if ingested is None and landed is not None:
        ingested = rescue_ingest(landed, contracts, fields=fields, candidates=pairs)
    if ingested is None:
        agreement = contracts.sparkSession.createDataFrame([], "contract_id string, version string, old_field string, field string, n_records long, n_equal long")
    else:
        agreement = value_agreement(ingested, pairs)
    return kept(fields.groupBy("contract_id").cogroup(agreement.groupBy("contract_id")).applyInPandas(lambda f, s: _changes(f, s), CHANGE_SCHEMA))


def castable_as(v: Column, kind: str) -> Column | None:
    """Whether a member's text that isn't null can be stored under one kind; None if always."""
    base, _, fmt = kind.partition("/")
    tests = {
        "integer": lambda: v.rlike(r"^\s*[+-]?\d+\s*$") & v.try_cast("bigint").isNotNull(),
        "number": lambda: v.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"),
        "boolean": lambda: F.lower(F.trim(v)).isin("true", "false"),
        "array": lambda: v.rlike(r"^\s*\["),
        "object": lambda: v.rlike(r"^\s*\{"),
        "string/date": lambda: v.rlike(r"^\d{4}-\d{2}-\d{2}$") & v.try_cast("date").isNotNull(),
        "string/date-time": lambda: v.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}") & v.try_cast("timestamp").isNotNull(),
        "string/uuid": lambda: v.rlike(r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"),
    }
    test = tests.get(f"{base}/{fmt}" if base == "string" else base)
    return test() if test else None


def castable(v: Column, kind: Column) -> Column:
    """Whether a member's text can be stored under a declared type; null always can."""
    base, full = F.split_part(kind, F.lit("/"), F.lit(1)), kind
    out = F.when(v.isNull(), True)
    for known in ("integer", "number", "boolean", "array", "object"):
        out = out.when(base == known, castable_as(v, known))
    for known in ("string/date", "string/date-time", "string/uuid"):
        out = out.when(full == known, castable_as(v, known))
    return out.otherwise(True)


def file_versions(landed: DataFrame) -> DataFrame:
    """The version that files with lines without one declare on other lines, if any."""
    by_file = landed.groupBy("contract_id", "file_id").agg(F.max("version").alias("file_version"), F.min("landed_at").alias("file_landed"), F.count_if(F.col("version").isNull()).alias("__open"))
    return by_file.where("__open > 0").drop("__open")


#: Where a member belongs.
TYPED, UNDECLARED, UNCASTABLE = 0, 1, 2


def _members_in(places: Sequence[int], entries: Column) -> Column:
    """Members (key, value, place) of some places as a map."""
    return F.map_from_entries(F.transform(F.filter(entries, lambda e: e["place"].isin(*places)), lambda e: F.struct(e["key"], e["value"])))


_INTEGER = re.compile(r"\s*[+-]?\d+\s*$", re.A)
_NUMBER_TEXT = re.compile(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$", re.A)
_DATE = re.compile(r"\d{4}-\d{2}-\d{2}$", re.A)
_TIME = re.compile(r"(\d{4}-\d{2}-\d{2})[T ](\d{2}):(\d{2})(?::(\d{2})(?:\.\d{1,9})?)?\s*(?:Z|UTC|[+-](\d{1,2})(?::?(\d{2}))?)?$", re.A)
_UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$")


def _is_date(v: str) -> bool:
    try:
        return bool(_DATE.match(v)) and dt.date.fromisoformat(v[:10]) is not None
    except ValueError:
        return False


def _is_time(v: str) -> bool:
    if v[10:11] == "T" and v[4:5] == v[7:8] == "-" and v[13:14] == ":":
        try:
            return dt.datetime.fromisoformat(v) is not None
        except ValueError:
            pass
    m = _TIME.match(v)
    return bool(m) and _is_date(m[1]) and int(m[2]) < 24 and int(m[3]) < 60 and int(m[4] or 0) < 60 and int(m[5] or 0) <= 18 and int(m[6] or 0) < 60


def _is_integer(v: str) -> bool:
    if len(v) < 19 and v.isdigit() and v.isascii():
        return True
    return bool(_INTEGER.match(v)) and len(v.strip().lstrip("+-0")) < 20 and -(1 << 63) <= int(v) < 1 << 63


_FITS: dict[str, Callable[[str], Any]] = {
    "integer": _is_integer,
    "number": lambda v: v.replace(".", "", 1).isdigit() and v.isascii() or _NUMBER_TEXT.match(v),
    "boolean": lambda v: v.strip(" ").lower() in ("true", "false"),
    "array": lambda v: v.lstrip().startswith("["),
    "object": lambda v: v.lstrip().startswith("{"),
    "string/date": _is_date, "string/date-time": _is_time, "string/uuid": _UUID.match,
}


def fits(kind: str) -> Callable[[str], Any] | None:
    """What ``castable`` says of a text that isn't null, for one kind, in Python; None if always yes."""
    base, _, fmt = kind.partition("/")
    return _FITS.get(f"{base}/{fmt}" if base == "string" else base)


def _split(watching: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lines with payload, declared kinds and watched names (JSON) last, members in their places."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests: dict[str, dict[str, Callable[[str], Any] | None]] = {}
        nothing, nobody = {}, object()
        for b in batches:
            n = b.num_columns - 3
            ok, rescued, records = [], [], []
            keys, values, ends = [[], [], [], []], [[], [], [], []], [[0], [0], [0], [0]]
            declared, watch = (b.column(n + i).dictionary_encode() for i in (1, 2))
            # Few texts stand on many lines: each is read once a batch, lines have its number.
            kinds = [tests.get(d) or tests.setdefault(d, {f: fits(k) for f, k in json.loads(d).items()}) for d in declared.dictionary.to_pylist()]
            asks = [(w["names"], w["keys"]) for w in map(json.loads, watch.dictionary.to_pylist())]
            for payload, d, w in zip(b.column(n).to_pylist(), declared.indices.to_pylist(), watch.indices.to_pylist()):
                known = nothing if d is None else kinds[d]
                members = payload_members(payload)
                ok.append(members is not None)
                beyond = {}
                for k, v in (members or {}).items():
                    test = known.get(k, nobody)
                    if test is nobody:
                        beyond[k] = UNDECLARED
                    elif test is not None and v is not None and not test(v):
                        beyond[k] = UNCASTABLE
                if not beyond:
                    if members:
                        keys[TYPED].extend(members)
                        values[TYPED].extend(members.values())
                    rescued.append(payload if members is None else "{}")
                else:
                    for k, v in members.items():
                        place = beyond.get(k, TYPED)
                        keys[place].append(k)
                        values[place].append(v)
                    rescued.append(_compact({k: members[k] for k in beyond}))
                if members and w is not None:
                    names, own = asks[w]
                    record = "\1".join([members.get(k) or "" for k in own])
                    records.append(record if record.strip("\1") else None)
                    for k in names:
                        v = members.get(k)
                        if v is not None and (v := _plain(v)):
                            keys[3].append(k)
                            values[3].append(v)
                elif watching:
                    records.append(None)
                for place in range(4):
                    ends[place].append(len(keys[place]))
            maps = [pa.MapArray.from_arrays(pa.array(ends[i], pa.int32()), pa.array(keys[i], pa.string()), pa.array(values[i], pa.string())) for i in range(4 if watching else 3)]
            more = [pa.array(records, pa.string()), maps[3]] if watching else []
            columns = [*b.schema.names[:n], "well_formed", "typed", "undeclared", "uncastable", "rescued", *(["record", "watched"] if watching else [])]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(ok, pa.bool_()), *maps[:3], pa.array(rescued, pa.string()), *more], names=columns)

    return run


def rescue_ingest(landed: DataFrame, contracts: DataFrame, extra: Sequence[str] = (), fields: DataFrame | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """Landed lines as ``typed`` and ``rescued`` members under their file's version.

    Result: ``contract_id, file_id, line_in_file, file_version, well_formed, typed``
    (map, declared and castable)``, undeclared`` (map)``, uncastable`` (map)``, rescued``
    (JSON of both, or the payload itself when it isn't a JSON object) and ``extra``
    columns; a line that isn't a JSON object has empty maps.  A line without a version has
    that of its file's other lines; a file that declares its version nowhere is read with
    the version in force when it landed; if there is none, everything in it is undeclared.
    Only lines without a version meet their files' versions in a join, so a huge file isn't
    brought together.  With ``candidates`` (``rename_candidates``) there are also ``record``
    (the line's key) and ``watched`` (map: plain values of the members they name).

    A payload is parsed and its members are placed in one pass of an Arrow-batched
    function: as built-in functions (``from_json`` and lambdas over maps, which aren't
    compiled) the same took four times the processor time.
    """
    fields = schema_fields(contracts) if fields is None else fields
    declared = fields.groupBy("contract_id", "version").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("field", "kind")))).alias("__declared"))
    declared = declared.join(contracts.groupBy("contract_id", "version").agg(F.min("published_at").alias("from_time")), ["contract_id", "version"])
    named = broadcast_if_small(declared.select(F.col("contract_id").alias("__c"), F.col("version").alias("__v"), "__declared", "from_time"), MAX_METADATA)
    files = file_versions(landed)
    in_force = (
        files.where("file_version is null").join(named, (F.col("contract_id") == F.col("__c")) & (F.col("from_time") <= F.col("file_landed")), "left")
        .groupBy("contract_id", "file_id")
        .agg(F.max_by("__v", F.struct("from_time", "__v")).alias("file_version"))
    )
    resolved = files.where("file_version is not null").select("contract_id", "file_id", "file_version").unionByName(in_force).withColumnsRenamed({"contract_id": "__fc", "file_id": "__ff"})
    resolved = broadcast_if_small(resolved, MAX_METADATA)
    own = [F.col(c) for c in ("contract_id", "file_id", "line_in_file", *extra)]
    told = landed.where("version is not null").select(*own, F.col("version").alias("file_version"), "payload")
    untold = landed.where("version is null").join(resolved, F.col("contract_id").eqNullSafe(F.col("__fc")) & F.col("file_id").eqNullSafe(F.col("__ff")), "left").select(*own, "file_version", "payload")
    lines = told.unionByName(untold)
    j = lines.join(named, (F.col("contract_id") == F.col("__c")) & (F.col("file_version") == F.col("__v")), "left").drop("__c", "__v", "from_time")
    if candidates is not None:
        names = F.array_distinct(F.flatten(F.array(F.collect_set("old_field"), F.collect_set("field"))))
        watch = candidates.groupBy(F.col("contract_id").alias("__c")).agg(F.to_json(F.struct(names.alias("names"), F.array_distinct(F.flatten(F.collect_set("key_fields"))).alias("keys"))).alias("__watch"))
        j = j.join(broadcast_if_small(watch), F.col("contract_id") == F.col("__c"), "left")
    else:
        j = j.withColumn("__watch", F.lit(None).cast("string"))
    j = j.select(*own, "file_version", "payload", "__declared", "__watch")
    text = T.MapType(T.StringType(), T.StringType())
    more = [T.StructField("record", T.StringType()), T.StructField("watched", text)] if candidates is not None else []
    schema = T.StructType([*j.schema.fields[:-3], T.StructField("well_formed", T.BooleanType()), *[T.StructField(c, text) for c in ("typed", "undeclared", "uncastable")], T.StructField("rescued", T.StringType()), *more])
    return j.mapInArrow(_split(candidates is not None), schema)


def stored_ingest(landed: DataFrame, contracts: DataFrame, extra: Sequence[str] = (), fields: DataFrame | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """``rescue_ingest`` written to the shared folder, for several plans to read."""
    path = shared_dir(landed.sparkSession, "ingested")
    rescue_ingest(landed, contracts, extra, fields, candidates).write.parquet(path)
    return landed.sparkSession.read.parquet(path)


def undeclared_fields(ingested: DataFrame) -> DataFrame:
    """One row per file and field name, exactly as spelled, that its version doesn't declare."""
    return ingested.where("size(undeclared) > 0").select("contract_id", "file_version", "file_id", F.explode(F.map_keys("undeclared")).alias("field")).distinct()


def promote(ingested: DataFrame, approved: dict[str, str] | DataFrame) -> DataFrame:
    """Moves approved fields from the rescue column into ``typed`` by replaying their values.

    ``approved``: kinds by name, for all lines, or a frame ``contract_id, version, field,
    kind`` for lines of that contract and version (an empty version: lines without any).
    Values that can't be cast stay rescued; replaying twice changes nothing.
    """
    if isinstance(approved, dict):
        if not approved:
            return ingested
        lines, kinds = ingested, F.create_map(*[F.lit(x) for kv in approved.items() for x in kv])
    else:
        by_version = broadcast_if_small(approved.groupBy(F.col("contract_id").alias("__c"), F.col("version").alias("__v")).agg(F.map_from_entries(F.collect_list(F.struct("field", "kind"))).alias("__kinds")), MAX_METADATA)
        lines = ingested.join(by_version, (F.col("contract_id") == F.col("__c")) & (F.coalesce("file_version", F.lit("")) == F.col("__v")), "left")
        kinds = F.coalesce(F.col("__kinds"), F.create_map().cast("map<string,string>"))
    rest = F.concat(
        F.transform(F.map_entries("undeclared"), lambda e: F.struct(e["key"], e["value"], F.lit(UNDECLARED).alias("place"))),
        F.transform(F.map_entries("uncastable"), lambda e: F.struct(e["key"], e["value"], F.lit(UNCASTABLE).alias("place"))),
    )
    goes = lambda e: F.map_contains_key(kinds, e["key"]) & ~F.map_contains_key(F.col("typed"), e["key"]) & castable(e["value"], kinds[e["key"]])
    keep = [F.col(c) for c in ingested.columns if c not in ("typed", "undeclared", "uncastable", "rescued")]
    placed = lines.select(*keep, "typed", "rescued", F.transform(rest, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"), F.when(goes(e), TYPED).otherwise(e["place"]).alias("place"))).alias("__e"))
    return placed.select(
        *keep,
        F.map_concat("typed", _members_in([TYPED], F.col("__e"))).alias("typed"),
        _members_in([UNDECLARED], F.col("__e")).alias("undeclared"), _members_in([UNCASTABLE], F.col("__e")).alias("uncastable"),
        F.when(~F.col("well_formed"), F.col("rescued")).otherwise(F.to_json(_members_in([UNDECLARED, UNCASTABLE], F.col("__e")))).alias("rescued"),
    )


def current_kinds(fields: DataFrame, names: DataFrame) -> DataFrame:
    """``contract_id, version, field, kind``: what each version's fields are typed as now.

    Of every version the fields that still exist, as that version and as the last one
    calls them, with the last version's type; also for an empty version.
    """
    last = fields.groupBy("contract_id").agg(F.max("step").alias("step")).join(fields, ["contract_id", "step"]).select("contract_id", F.col("field").alias("current"), "kind")
    own = names.join(last, ["contract_id", "current"]).select("contract_id", "version", "field", "kind", F.lit(0).alias("rank"))
    versions = names.select("contract_id", "version").distinct()
    versions = versions.unionByName(versions.select("contract_id", F.lit("").alias("version")).distinct())
    now = versions.join(last, "contract_id").select("contract_id", "version", F.col("current").alias("field"), "kind", F.lit(1).alias("rank"))
    return own.unionByName(now).groupBy("contract_id", "version", "field").agg(F.min_by("kind", "rank").alias("kind"))


def current_names(changes: DataFrame, contracts: DataFrame, fields: DataFrame | None = None) -> DataFrame:
    """``contract_id, version, field, current``: what a field of a version is called now.

    A field removed later keeps its last name.
    """
    fields = (schema_fields(contracts) if fields is None else fields).select("contract_id", "version", "step", "field")

    def follow(f: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        steps = dict(zip(f["version"], f["step"]))
        renames = {(steps[r.version], r.old_field): r.field for r in c.itertuples(index=False) if r.change == "renamed"}
        last = max(steps.values(), default=0)
        out = []
        for r in f.itertuples(index=False):
            name = r.field
            for s in range(int(r.step) + 1, int(last) + 1):
                name = renames.get((s, name), name)
            out.append((r.contract_id, r.version, r.field, name))
        return pd.DataFrame(out, columns=["contract_id", "version", "field", "current"])

    return kept(fields.groupBy("contract_id").cogroup(changes.groupBy("contract_id")).applyInPandas(follow, "contract_id string, version string, field string, current string"))


def consistent_rows(ingested: DataFrame, names: DataFrame) -> DataFrame:
    """Typed members of all files under the fields' current names, as ``row`` (map)."""
    by_version = names.groupBy("contract_id", "version").agg(F.map_from_entries(F.collect_list(F.struct("field", "current"))).alias("__names"))
    by_version = broadcast_if_small(by_version.withColumnsRenamed({"contract_id": "__c", "version": "__v"}), MAX_METADATA)
    j = ingested.join(by_version, (F.col("contract_id") == F.col("__c")) & (F.col("file_version") == F.col("__v")), "left")
    # A payload may hold a field's old and new name at once: the current name's value counts.
    entries = F.map_entries("typed")
    name = lambda e: F.coalesce(F.try_element_at(F.col("__names"), e["key"]), e["key"])
    moved = F.filter(entries, lambda e: (name(e) == e["key"]) | ~F.map_contains_key(F.col("typed"), name(e)))
    row = F.map_from_entries(F.transform(moved, lambda e: F.struct(name(e).alias("key"), e["value"].alias("value"))))
    return j.select(*[c for c in ingested.columns if c != "typed"], row.alias("row"))


def contract_table(consistent: DataFrame, contract_id: str, kinds: dict[str, str]) -> DataFrame:
    """One contract's rows with a typed column for each field in ``kinds``.

    A value that an older version allowed and the field's kind doesn't is null in its
    column and kept in ``_untyped`` (JSON; null where there is none).
    """
    spark_type = {"integer": "bigint", "number": "double", "boolean": "boolean"}
    other = {"date": "date", "date-time": "timestamp"}

    def typed(name: str, kind: str) -> Column:
        base, _, fmt = kind.partition("/")
        target = other.get(fmt) if base == "string" else spark_type.get(base)
        v = F.col(f"__v_{name}")
        fit, value = castable_as(v, kind), v.try_cast(target) if target else v
        return (value if fit is None else F.when(fit, value)).alias(name)

    # Each value is looked up once, then typed or kept as it is.
    own = consistent.where(F.col("contract_id") == F.lit(contract_id)).select("file_id", "line_in_file", "rescued", *[F.col("row")[n].alias(f"__v_{n}") for n in kinds])
    unfit = [F.when(~fit, F.col(f"__v_{n}")).alias(n) for n, k in kinds.items() if (fit := castable_as(F.col(f"__v_{n}"), k)) is not None]
    kept_text = F.nullif(F.to_json(F.struct(*unfit)), F.lit("{}")) if unfit else F.lit(None).cast("string")
    return own.select(*[typed(n, k) for n, k in kinds.items()], F.col("file_id").alias("_file_id"), F.col("line_in_file").alias("_line"), F.col("rescued").alias("_rescued"), kept_text.alias("_untyped"))
