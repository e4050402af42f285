"""Queries of whole pipelines, change normalisation and decoding, and the same in SQL.

Each runs the stages as a user would, over whole tables, and returns what they left in the
curated tables or in their counters.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.contract.model import Contract, ContractValidationError, parse_registry_payload
from tidemark.contract.types import contract_schema
from tidemark.functions.lsn import lsn_col, lsn_text
from tidemark.operators import delta, pipelines, validate
from tidemark.operators.redelivery import first_copies
from tidemark.plans import contract_queries as cq
from tidemark.plans.change_queries import table
from tidemark.session import shared_dir
from tidemark.sources import pgoutput
from tidemark.sources.store import VersionedTable, get_json

#: Key fields and the party of each table whose log is captured.
CAPTURED = {"public.shipments": (("shipment_id",), "customer_id"), "public.shipment_lines": (("shipment_id", "line_no"), "customer_id")}


def contract_of(name: str) -> Contract:
    keys, party = CAPTURED[name]
    types = {k: "integer" for k in (*keys, party)} | {"amount": "decimal", "status": "string", "updated_at": "timestamp"}
    return Contract(name, "1", tuple(types), types, keys, keys, hash_keys=(party, "status"))


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# Snapshots


def _customer_runs(spark: SparkSession, d: str) -> tuple[VersionedTable, list[dict]]:
    """An older customer table, today's, and today's again, brought into a versioned table."""
    c = table(spark, d, "customer").select(*cq.CUSTOMER.fields)
    t = VersionedTable(spark, shared_dir(spark, "customers"), cq.CUSTOMER, rows_per_bucket=2000)
    runs = [pipelines.run_hash_diff(cq.older_customers(c), t), pipelines.run_hash_diff(c, t, hash_input="normalized"), pipelines.run_hash_diff(c, t)]
    return t, runs


def pipeline_hash_diff(spark: SparkSession, d: str) -> DataFrame:
    """The curated customers, with their hashes, after three runs."""
    return _customer_runs(spark, d)[0].stored()


def pipeline_hash_diff_counts(spark: SparkSession, d: str) -> DataFrame:
    names = ("read_count", "insert_count", "update_count", "unchanged_count", "delete_count", "version")
    rows = [(i + 1, *[int(r[n]) for n in names]) for i, r in enumerate(_customer_runs(spark, d)[1])]
    return spark.createDataFrame(rows, "run long, " + ", ".join(f"{n} long" for n in names))


def pipeline_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Orders validated, landed, merged and merged again from the artifact alone."""
    landed = pipelines.validate_and_land_snapshot(table(spark, d, "orders"), cq.ORDERS, shared_dir(spark, "snapshot"))
    t = VersionedTable(spark, shared_dir(spark, "orders"), cq.ORDERS)
    first = pipelines.merge_snapshot(spark, landed["accepted_path"], t)
    again = pipelines.merge_snapshot(spark, landed["accepted_path"], t)
    same = again["unchanged_count"] == first["insert_count"] and again["version"] == first["version"]
    return t.curated().select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"), F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"), "o_orderpriority", F.lit(same).alias("replay_changed_nothing"))


def pipeline_snapshot_rejected(spark: SparkSession, d: str) -> DataFrame:
    """What is left of a snapshot with rows that break the contract: counters, and no rows."""
    try:
        dirty = cq.dirty_orders(spark, d).withColumn("o_custkey", F.col("o_custkey").try_cast("bigint"))
        pipelines.validate_and_land_snapshot(dirty, cq.TIGHT, shared_dir(spark, "rejected"))
        rows: list[tuple] = []
    except ContractValidationError as e:
        m = get_json(spark, e.manifest_path)
        kept = spark.read.json(e.error_path).groupBy().agg(F.count_distinct("row_number")).first()[0]
        rows = [(m["source_row_count"], m["valid_row_count"], m["invalid_row_count"], kept, m["accepted_path"] is not None, len(m["sample_errors"]))]
    return spark.createDataFrame(rows, "source_row_count long, valid_row_count long, invalid_row_count long, rows_in_errors long, accepted boolean, n_samples long")


# Audit


def _audit_events(spark: SparkSession, d: str) -> DataFrame:
    """The audit log, each event once, with its visible time as the ordering time."""
    a = table(spark, d, "audit_log")
    once = first_copies(a, ["audit_event_id"], [F.col("extracted_at")])
    return once.withColumn("recorded_at", F.coalesce("ordering_ts", "recorded_at")).select("source_table", "audit_event_id", "op", "source_txid", "recorded_at", "key_json", "row_before", "row_after")


def pipeline_audit(spark: SparkSession, d: str) -> DataFrame:
    """The curated tables after their audit logs were landed and applied in two windows."""
    events, out = _audit_events(spark, d).persist(), []
    middle = F.lit("2025-03-12").cast(events.schema["recorded_at"].dataType)
    try:
        for name in cq.AUDITED:
            c, mine = cq.audited_contract(name), events.where(F.col("source_table") == name)
            t, start = VersionedTable(spark, shared_dir(spark, "audited"), c), None
            for log in (mine.where(F.col("recorded_at") < middle), mine):
                landed = pipelines.land_audit_delta(log, c, shared_dir(spark, "delta"), start)
                applied = pipelines.apply_delta_artifact(spark, landed["delta_path"], t, delta.AUDIT)
                start = delta.checkpoint_watermark({**landed, **applied})
            out.append(t.stored().select(F.lit(name).alias("source_table"), cq.key_text(c).alias("key"), "status", "row_hash"))
    finally:
        events.unpersist()
    return _all(out)


# Change capture


def decoded_changes(cdc: DataFrame) -> DataFrame:
    """Stored change events in the form the decoder gives them: I, U (moved key) or D.

    The two halves of a moved key, at one position, are one U with the old key; repeated
    deliveries count once.
    """
    at = cdc.withColumns({"__at": lsn_col(F.col("commit_lsn")), "__end": lsn_col(F.col("end_lsn")), "op": F.upper(F.trim("op"))})
    once = first_copies(at, ["source_table", "__at", "change_index", "op"], [F.col("received_at"), F.col("batch_no")])
    both = once.groupBy("source_table", "__at", "change_index").agg(
        F.max(F.when(F.col("op") == "UPSERT", F.col("row_json"))).alias("row_after"), F.max(F.when(F.col("op") == "DELETE", F.col("key_json"))).alias("old_key"),
        F.max("__end").alias("__end"), F.max("xid").alias("xid"), F.max("commit_ts").alias("commit_ts"),
    )
    op = F.when(F.col("row_after").isNull(), "D").when(F.col("old_key").isNull(), "I").otherwise("U")
    return both.select("source_table", op.alias("op"), lsn_text(F.col("__at")).alias("commit_lsn"), lsn_text(F.col("__end")).alias("end_lsn"), "change_index", "xid", "commit_ts", "old_key", "row_after")


def _normalized_cdc(spark: SparkSession, d: str, spoil: bool = False) -> list[tuple[str, Contract, DataFrame]]:
    """Change events of every captured table, normalised.

    ``spoil``: by a fixed recipe, positions divisible by 13 have an op nobody knows, and
    those divisible by 11 have lost their row.
    """
    e = decoded_changes(table(spark, d, "cdc_delta"))
    if spoil:
        at = lsn_col(F.col("commit_lsn"))
        e = e.withColumn("op", F.when(at % 13 == 0, "X").otherwise(F.col("op"))).withColumn("row_after", F.when(at % 11 != 0, F.col("row_after")))
    return [(n, contract_of(n), delta.normalize_events(e.where(F.col("source_table") == n), contract_of(n), delta.CDC, old_key=F.col("old_key"))) for n in CAPTURED]


def cdc_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Upserts and deletes made of the decoded changes of all captured tables."""
    return _all([
        delta.delta_events(n, delta.CDC).select(F.lit(name).alias("source_table"), lsn_col(F.col("commit_lsn")).alias("lsn"), "change_index", "op", cq.key_text(c, "key.").alias("key"), "row_hash")
        for name, c, n in _normalized_cdc(spark, d)
    ])


def cdc_event_errors(spark: SparkSession, d: str) -> DataFrame:
    """Errors of changes without their row and of unknown ops."""
    return _all([
        delta.event_errors(n, ["commit_lsn", "change_index"]).select(F.lit(name).alias("source_table"), lsn_col(F.col("commit_lsn")).alias("lsn"), "change_index", "field", "code", "message", "event_role")
        for name, _, n in _normalized_cdc(spark, d, spoil=True)
    ])


def cdc_quarantine_counts(spark: SparkSession, d: str) -> DataFrame:
    """The seven counters of an extract whose spoilt transactions are quarantined whole."""
    out = []
    for name, _, n in _normalized_cdc(spark, d, spoil=True):
        q = delta.quarantine_transactions(n, ["commit_lsn"])
        out.append(delta.extract_counts(q, ["commit_lsn"]).withColumn("source_table", F.lit(name)))
    return _all(out)


def pipeline_cdc(spark: SparkSession, d: str) -> DataFrame:
    """The curated tables after decoded changes were landed and applied, the second half twice."""
    e, out = decoded_changes(table(spark, d, "cdc_delta")).persist(), []
    try:
        for name in CAPTURED:
            c, mine = contract_of(name), e.where(F.col("source_table") == name)
            t = VersionedTable(spark, shared_dir(spark, "shipped"), c)
            at = lsn_col(F.col("commit_lsn"))
            span = mine.agg(F.min(at).alias("lo"), F.max(at).alias("hi")).first()
            middle = None if span["lo"] is None else f"{(span['lo'] + span['hi']) // 2 >> 32:X}/{(span['lo'] + span['hi']) // 2 & 0xFFFFFFFF:X}"
            for start, end in ((None, middle), (middle, None), (middle, None)):
                landed = pipelines.land_cdc_delta(mine, c, shared_dir(spark, "delta"), start, end)
                pipelines.apply_delta_artifact(spark, landed["delta_path"], t, delta.CDC)
            out.append(t.stored().select(F.lit(name).alias("source_table"), cq.key_text(c).alias("key"), "status", "row_hash"))
    finally:
        e.unpersist()
    return _all(out)


def pgoutput_lines(spark: SparkSession, d: str) -> DataFrame:
    """Messages of one transaction per order with a change per line, decoded again.

    Changes are inserts, updates with a moved key and deletes with their old row, by line
    number.  In the middle of each capture the relation is announced again with its
    columns in another order, so a change has to be read by the relation as of it.
    """
    u = lambda c, n: F.unhex(F.lpad(F.hex(c.cast("bigint")), 2 * n, "0"))
    text = lambda c: F.concat(F.lit(b"t"), u(F.length(c.cast("binary")), 4), c.cast("binary"))
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_returnflag")
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_returnflag"))
    li = li.withColumns({"n": rank, "late": F.col("l_orderkey") % 1000 >= 500})
    pair = lambda a, b: F.concat(F.lit(b"\0\2"), F.when(F.col("late"), F.concat(b, a)).otherwise(F.concat(a, b)))
    key, flag = text(F.concat_ws("-", "l_orderkey", "n")), text(F.col("l_returnflag"))
    new, old = F.concat(F.lit(b"N"), pair(key, flag)), F.concat(F.lit(b"K"), pair(text(F.concat_ws("-", F.lit("old"), "n")), F.lit(b"n")))
    rel_id = struct.pack("!I", 77)
    body = (
        F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit(b"I" + rel_id), new))
        .when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit(b"U" + rel_id), old, new))
        .otherwise(F.concat(F.lit(b"D" + rel_id + b"O"), pair(key, flag)))
    )
    per_order = 1_000
    at = lambda i: F.col("l_orderkey") * per_order + i
    capture = F.expr("l_orderkey div 1000").cast("string").alias("capture")
    orders = li.groupBy("l_orderkey").agg(F.max("n").alias("last"))
    lsn, none = u(F.col("l_orderkey"), 8), F.lit(b"\0" * 8)
    names = {False: b"\1key\0" + struct.pack("!Ii", 25, -1) + b"\0flag\0" + struct.pack("!Ii", 25, -1), True: b"\0flag\0" + struct.pack("!Ii", 25, -1) + b"\1key\0" + struct.pack("!Ii", 25, -1)}
    told = lambda late: F.lit(b"R" + rel_id + b"public\0lines\0d" + struct.pack("!H", 2) + names[late])
    captures = orders.select(F.expr("l_orderkey div 1000").alias("c")).distinct()
    messages = _all([
        li.select(capture, at(F.col("n")).alias("seq"), body.alias("data")),
        orders.select(capture, at(0).alias("seq"), F.concat(F.lit(b"B"), lsn, none, u(F.col("l_orderkey"), 4)).alias("data")),
        orders.select(capture, at(F.col("last") + 1).alias("seq"), F.concat(F.lit(b"C\0"), lsn, lsn, none).alias("data")),
        captures.select(F.col("c").cast("string").alias("capture"), (F.col("c") * 1000 * per_order - 1).alias("seq"), told(False).alias("data")),
        captures.select(F.col("c").cast("string").alias("capture"), ((F.col("c") * 1000 + 500) * per_order - 1).alias("seq"), told(True).alias("data")),
    ])
    ev = pgoutput.decode_messages(messages, "public.lines")
    get = lambda c, k: F.coalesce(F.get_json_object(c, f"$.{k}"), F.lit("-"))
    return ev.select("xid", "op", "change_index", get("old_key", "key").alias("old_key"), get("old_key", "flag").alias("old_flag"), get("row_after", "key").alias("new_key"), get("row_after", "flag").alias("new_flag"))


# Hashes, formats and messages

#: Texts of each format and whether they satisfy it.
SAMPLES: dict[str, list[tuple[str, bool]]] = {
    "date-time": [("2025-01-02T03:04:05Z", True), ("2025-01-02 03:04:05+01:00", True), ("2025-01-02T03:04:05", False), ("2025-02-30T00:00:00Z", False), ("soon", False)],
    "date": [("2024-02-29", True), ("2025-02-29", False), ("2025-1-2", False), ("20250102", False)],
    "time": [("03:04:05", True), ("23:59:59.5Z", True), ("24:00:00", False), ("3 o'clock", False)],
    "uuid": [("123e4567-e89b-12d3-a456-426614174000", True), ("123e4567e89b12d3a456426614174000", True), ("123e4567-e89b-12d3-a456-42661417400", False), ("g23e4567-e89b-12d3-a456-426614174000", False)],
    "email": [("a@b.org", True), ("a.b+c@d-e.net", True), ("a@b", False), ("a b@c.org", False), ("@c.org", False)],
    "hostname": [("example.org", True), ("a-1.b", True), ("-a.org", False), ("a..b", False), ("a_b", False)],
    "ipv4": [("127.0.0.1", True), ("255.255.255.255", True), ("256.1.1.1", False), ("1.2.3", False), ("01.2.3.4", False)],
    "ipv6": [("::1", True), ("2001:db8::ff00:42:8329", True), ("2001:db8::1::2", False), ("127.0.0.1", False)],
    "uri": [("https://a.org/b?c#d", True), ("mailto:a@b.org", True), ("file:///x", True), ("http://", False), ("http:?x", False), ("/b", False), ("a.org", False)],
    "uri-reference": [("/b", True), ("?q", True), ("#f", True), ("a.org", True), ("?", False), ("#", False), ("//", False)],
    "regex": [("^a+$", True), ("[a-z]{2,3}", True), ("(", False), ("[", False), ("*a", False)],
    "duration": [("P1Y2M3D", True), ("PT0.5S", True), ("P", False), ("PT", False), ("1D", False)],
}


def validate_formats(spark: SparkSession, d: str) -> DataFrame:
    """All string formats, over samples dealt to the customers in turn."""
    fields = {f.replace("-", "_"): f for f in SAMPLES}
    deal = lambda f: F.array(*[F.lit(t) for t, _ in SAMPLES[f]])[(F.col("c_custkey") % len(SAMPLES[f])).cast("int")]
    rows = table(spark, d, "customer").select("c_custkey", *[deal(f).alias(n) for n, f in fields.items()])
    c = Contract("formats", "1", ("c_custkey", *fields), {"c_custkey": "integer"}, primary_keys=("c_custkey",), schema_json={"type": "object", "properties": {n: {"type": "string", "format": f} for n, f in fields.items()}})
    return validate.error_rows(validate.validated_rows(rows, c), ["c_custkey"]).select("c_custkey", "field", "code")


def validate_messages(spark: SparkSession, d: str) -> DataFrame:
    """Bounds with everything an error tells: message, constraint, value, title and description."""
    props = {
        "p_size": {"type": "integer", "exclusiveMinimum": 10, "maximum": 40, "title": "Size", "description": "How large a part is"},
        "p_name": {"type": "string", "maxLength": 12},
    }
    c = Contract("parts", "1", ("p_partkey", *props), {"p_partkey": "integer", "p_size": "integer", "p_name": "string"}, primary_keys=("p_partkey",), schema_json={"type": "object", "properties": props})
    v = validate.validated_rows(table(spark, d, "part").select("p_partkey", F.col("p_size").cast("bigint").alias("p_size"), "p_name"), c)
    none = F.lit("-")
    return validate.error_rows(v, ["p_partkey"]).select("p_partkey", "field", "code", "message", "constraint", F.coalesce("actual_value", none).alias("actual_value"), F.coalesce("contract_title", none).alias("contract_title"), F.coalesce("contract_description", none).alias("contract_description"))


def row_hash_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Hash of doubles, decimals, bytes, times and nulls, beside the text it is taken of."""
    li = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", F.col("l_discount").cast("decimal(12,4)").alias("discount"), F.col("l_returnflag").cast("binary").alias("flag"), "l_shipdate",
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_tax")).alias("tax"),
    )
    from tidemark.functions.canonical import canonical_row, row_hash

    return li.select(canonical_row(li, li.columns).alias("canonical_text"), row_hash(li, li.columns).alias("row_hash"))


def contract_fields(spark: SparkSession, d: str) -> DataFrame:
    """Registry payloads made of the stored contracts, read back: fields, types and table columns."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                version = {"version": r.version, "checksum": r.checksum, "schema_json": json.loads(r.schema_json)}
                c = parse_registry_payload({"data": {"contract": {"id": r.contract_id, "target_layer": r.target_layer}, "version": version}}).check()
                for f in contract_schema(c):
                    out.append((c.contract_id, c.version, f.name, c.field_types.get(f.name, "-"), f.dataType.simpleString(), f.nullable, f.name in c.required_fields, f.name in c.key_fields, f.name in c.effective_hash_fields))
            yield pd.DataFrame(out, columns=["contract_id", "version", "field", "contract_type", "column_type", "nullable", "required", "is_key", "is_hashed"])

    rows = table(spark, d, "contracts").where("schema_json is not null").select("contract_id", "target_layer", "version", "checksum", "schema_json")
    return rows.mapInPandas(read, "contract_id string, version string, field string, contract_type string, column_type string, nullable boolean, required boolean, is_key boolean, is_hashed boolean").distinct()


_Q = (
    contract_fields, pipeline_hash_diff, pipeline_hash_diff_counts, pipeline_snapshot, pipeline_snapshot_rejected, pipeline_audit, cdc_normalize, cdc_event_errors, cdc_quarantine_counts, pipeline_cdc, pgoutput_lines,
    validate_formats, validate_messages, row_hash_kinds,
)
QUERIES = {f.__name__: f for f in _Q}

_LSN = cq._LSN

_CDC = f"""
with raw as (
  select *, {_LSN.format('commit_lsn')} as lsn, upper(trim(op)) as o from cdc_delta
), e as (
  select source_table, lsn, change_index, max(row_json) filter (o = 'UPSERT') as row_after, max(key_json) filter (o = 'DELETE') as old_key from raw group by 1, 2, 3
), p as (
  select *, case when row_after is null then 'D' when old_key is null then 'I' else 'U' end as op,
    concat_ws('/', json_extract_string(row_after, '$.shipment_id'), json_extract_string(row_after, '$.line_no')) as new_key, concat_ws('/', json_extract_string(old_key, '$.shipment_id'), json_extract_string(old_key, '$.line_no')) as was,
    json_extract_string(row_after, '$.status') as status, sha256(concat_ws('|', coalesce(json_extract_string(row_after, '$.customer_id'), '<NULL>'), coalesce(json_extract_string(row_after, '$.status'), '<NULL>'))) as h
  from e
), made as (
  select source_table, lsn, change_index, 'UPSERT' as op, new_key as key, h as row_hash, status from p where op in ('I', 'U')
  union all select source_table, lsn, change_index, 'DELETE', was, null, null from p where op = 'D' or (op = 'U' and was <> new_key)
)
"""
_SPOILT = _CDC + """, s as (
  select source_table, lsn, change_index, case when lsn % 13 = 0 then 'X' else op end as op, case when lsn % 11 <> 0 then row_after end as row_after, was, new_key from p
), bad as (
  select *, case when op = 'X' then 'unsupported_op' when op in ('I', 'U') and row_after is null then 'missing_row_after' end as code from s
)
"""

_AUDITED = cq.AUDIT_ONCE + """, ranked as (
  select m.*, row_number() over (partition by m.source_table, m.key order by m.event_ts desc, m.event_id desc, m.op desc) as r from made m
)
"""

_OLD_CUSTOMERS = """
with old as (
  select c_custkey, c_name, c_nationkey, case when c_custkey % 7 = 0 then 'NONE' else c_mktsegment end as c_mktsegment from customer where c_custkey % 10 <> 0
  union all select -c_custkey, c_name, c_nationkey, c_mktsegment from customer where c_custkey % 5 = 1
), j as (
  select c.c_custkey as now, o.c_custkey as was, (c.c_name, c.c_nationkey, c.c_mktsegment) is not distinct from (o.c_name, o.c_nationkey, o.c_mktsegment) as same
  from customer c full join old o on c.c_custkey = o.c_custkey
), n as (select (select count(*) from customer) as n_now, (select count(*) from old) as n_old)
"""


def _formats_sql() -> str:
    parts = []
    for f, samples in SAMPLES.items():
        bad = ", ".join(str(i) for i, (_, ok) in enumerate(samples) if not ok)
        parts.append(f"select c_custkey, '{f.replace('-', '_')}' as field, 'schema.format' as code from customer where c_custkey % {len(samples)} in ({bad})")
    return " union all ".join(parts)


def _bound_sql(field: str, code: str, constraint: str, reason: str, shown: str, where: str, title: str = "-", about: str = "-") -> str:
    tail = "" if title == "-" else f" || ' Contract title: {title}. Contract description: {about}.'"
    return f"""select p_partkey, '{field}' as field, '{code}' as code, 'Constraint: {constraint}. Reason: ' || {reason} || '. Actual value: ' || {shown} || '.'{tail} as message, '{constraint}' as "constraint",
        {shown} as actual_value, '{title}' as contract_title, '{about}' as contract_description from part where {where}"""


ORACLE = {
    "contract_fields": """
        with c as (select contract_id, version, fields, field_types, required_fields, case when len(primary_keys) > 0 then primary_keys else business_keys end as keys, schema_json from contracts where schema_json is not null),
        f as (select *, unnest(fields) as field from c),
        h as (select *, from_json(json_extract(schema_json, '$."x-hashKeys"'), '["VARCHAR"]') as hashed from f)
        select distinct contract_id, version, field, coalesce(field_types[field], '-') as contract_type,
          case field_types[field] when 'integer' then 'bigint' when 'decimal' then 'decimal(38,18)' when 'boolean' then 'boolean' when 'timestamp' then 'timestamp' when 'date' then 'date' else 'string' end as column_type,
          not (list_contains(required_fields, field) or list_contains(keys, field)) as nullable, list_contains(required_fields, field) as required, list_contains(keys, field) as is_key,
          case when len(hashed) > 0 then list_contains(hashed, field) else true end as is_hashed from h""",
    "pipeline_hash_diff": "select c_custkey, c_name, c_nationkey, c_mktsegment, sha256(concat_ws('|', coalesce(c_name, '<NULL>'), coalesce(cast(c_nationkey as varchar), '<NULL>'), coalesce(c_mktsegment, '<NULL>'))) as row_hash from customer",
    "pipeline_hash_diff_counts": _OLD_CUSTOMERS + """
        select 1::bigint as run, n_old as read_count, n_old as insert_count, 0::bigint as update_count, 0::bigint as unchanged_count, 0::bigint as delete_count, 1::bigint as version from n
        union all select 2, (select n_now from n), count(*) filter (was is null), count(*) filter (was is not null and now is not null and not same), count(*) filter (now is not null and same), count(*) filter (now is null), 2 from j
        union all select 3, n_now, 0, 0, n_now, 0, 2 from n""",
    "pipeline_snapshot": "select *, true as replay_changed_nothing from orders",
    "pipeline_snapshot_rejected": """
        with o as (select count(*) as total, count(*) filter (o_orderkey % 97 = 0 or o_orderstatus is null or o_orderstatus not in ('F', 'O') or o_totalprice < 1000 or o_totalprice >= 300000 or o_orderpriority <> '1-URGENT') as bad from orders)
        select total as source_row_count, total - bad as valid_row_count, bad as invalid_row_count, bad as rows_in_errors, false as accepted, least(bad, 5) as n_samples from o""",
    "pipeline_audit": _AUDITED + "select source_table, key, status, row_hash from ranked where r = 1 and op = 'UPSERT'",
    "cdc_normalize": _CDC + "select source_table, lsn, change_index, op, key, row_hash from made",
    "cdc_event_errors": _SPOILT + """select source_table, lsn, change_index, '$' as field, code, case code when 'unsupported_op' then 'Unsupported operation' else 'WAL event does not include row_after' end as message,
        case code when 'unsupported_op' then 'WAL' else 'UPSERT' end as event_role from bad where code is not null""",
    "cdc_quarantine_counts": _SPOILT + """, q as (select *, bool_or(code is not null) over (partition by source_table, lsn) as spoilt from bad)
        select source_table, count(*) as source_event_count, coalesce(sum(case when spoilt then 0 when op = 'U' and was <> new_key then 2 else 1 end), 0)::bigint as normalized_event_count,
          count(*) filter (not spoilt and op in ('I', 'U')) as upsert_event_count, count(*) filter (not spoilt and (op = 'D' or (op = 'U' and was <> new_key))) as delete_event_count,
          count(*) filter (code is not null) as invalid_event_count, count(*) filter (spoilt) as quarantined_event_count, count(distinct lsn) filter (spoilt) as quarantined_transaction_count from q group by 1""",
    "pipeline_cdc": _CDC + """, ranked as (select *, row_number() over (partition by source_table, key order by lsn desc, change_index desc, op desc) as r from made)
        select source_table, key, status, row_hash from ranked where r = 1 and op = 'UPSERT'""",
    "pgoutput_lines": """
        with l as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_returnflag) as n from lineitem)
        select l_orderkey as xid, case l_linenumber % 3 when 0 then 'I' when 1 then 'U' else 'D' end as op, n - 1 as change_index,
          case l_linenumber % 3 when 0 then '-' when 1 then 'old-' || n else l_orderkey || '-' || n end as old_key, case when l_linenumber % 3 = 2 then l_returnflag else '-' end as old_flag,
          case when l_linenumber % 3 = 2 then '-' else l_orderkey || '-' || n end as new_key, case when l_linenumber % 3 = 2 then '-' else l_returnflag end as new_flag from l""",
    "validate_formats": _formats_sql(),
    "validate_messages": " union all ".join([
        _bound_sql("p_size", "schema.exclusive_minimum", "exclusiveMinimum=10", "p_size || ' is not greater than 10'", "cast(p_size as varchar)", "p_size <= 10", "Size", "How large a part is"),
        _bound_sql("p_size", "schema.maximum", "maximum=40", "p_size || ' is greater than 40'", "cast(p_size as varchar)", "p_size > 40", "Size", "How large a part is"),
        _bound_sql("p_name", "schema.max_length", "maxLength=12", "length(p_name) || ' characters are more than 12'", "'\"' || p_name || '\"'", "length(p_name) > 12"),
    ]),
    "row_hash_kinds": f"""
        with t as (select concat_ws('|', l_orderkey::varchar, l_linenumber::varchar, l_extendedprice::varchar, l_discount::decimal(12,4)::varchar, to_base64(l_returnflag::blob), {cq._ISO.format('l_shipdate')},
          case when l_linenumber % 2 = 0 then l_tax::varchar else '<NULL>' end) as canonical_text from lineitem)
        select canonical_text, sha256(canonical_text) as row_hash from t""",
}
