"""Queries of the contract-driven operators, and the same in SQL for the check.

Where a previous state is needed it is derived from the table by a fixed recipe: rows with
key % 10 = 0 are missing (inserts to come), rows with key % 7 = 0 have another value
(updates), and rows with negated keys were there (deletes).
"""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.contract.model import Contract
from tidemark.functions import canonical, lsn
from tidemark.operators import delta, hash_diff, validate
from tidemark.operators.redelivery import first_copies
from tidemark.operators.pipelines import typed_delta
from tidemark.plans.change_queries import table
from tidemark.sources import pgoutput

ORDERS = Contract(
    "sales.orders", "1", ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
    {"o_orderkey": "integer", "o_custkey": "integer", "o_orderstatus": "string", "o_totalprice": "decimal", "o_orderdate": "timestamp", "o_orderpriority": "string"},
    required_fields=("o_orderkey",), primary_keys=("o_orderkey",), hash_keys=("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"),
)
CUSTOMER = Contract(
    "sales.customer", "1", ("c_custkey", "c_name", "c_nationkey", "c_mktsegment"),
    {"c_custkey": "integer", "c_name": "string", "c_nationkey": "integer", "c_mktsegment": "string"},
    required_fields=("c_custkey",), primary_keys=("c_custkey",), hash_keys=("c_name", "c_nationkey", "c_mktsegment"),
)


def _codes(validated: DataFrame, key: list[str]) -> DataFrame:
    return validate.error_rows(validated, key).select(*key, "field", "code")


# Hashes and snapshot diff


def row_hash_orders(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select("o_orderkey", canonical.row_hash(o, list(ORDERS.hash_keys)).alias("row_hash"))


def row_hash_types(spark: SparkSession, d: str) -> DataFrame:
    """Canonical text of integers, decimals, dates, booleans and nulls."""
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("decimal(12,2)").alias("size"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("p_size")).alias("day"), (F.col("p_size") > 25).alias("large"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("brand"))
    return p.select("p_partkey", canonical.canonical_row(p, p.columns).alias("canonical_text"))


def row_hash_documents_nested(spark: SparkSession, d: str) -> DataFrame:
    """Canonical JSON of nested values: sorted keys, ASCII, no blanks."""
    e = table(spark, d, "events").select("event_id", F.struct(F.col("user_id").alias("u"), F.col("event_type").alias("t"), F.array("event_id", "user_id").alias("a")).alias("nested"))
    return e.select("event_id", canonical.canonical_text(F.col("nested"), e.schema["nested"].dataType).alias("canonical_text"))


def _orders_state(o: DataFrame) -> DataFrame:
    was = o.where("o_orderkey % 10 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("old "), "o_orderstatus")).otherwise(F.col("o_orderstatus")))
    gone = o.where("o_orderkey % 100 = 1").withColumn("o_orderkey", -F.col("o_orderkey"))
    was = was.unionByName(gone)
    return was.withColumn("row_hash", canonical.row_hash(was, list(ORDERS.hash_keys)))


def _orders_diff(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    now = o.withColumn("row_hash", canonical.row_hash(o, list(ORDERS.hash_keys)))
    return hash_diff.classify(now, _orders_state(o), ["o_orderkey"])


def hash_diff_orders(spark: SparkSession, d: str) -> DataFrame:
    return _orders_diff(spark, d).select("o_orderkey", "change_type")


def hash_diff_orders_counts(spark: SparkSession, d: str) -> DataFrame:
    return hash_diff.change_counts(_orders_diff(spark, d))


def hash_diff_unchanged_rerun(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    now = o.withColumn("row_hash", canonical.row_hash(o, list(ORDERS.hash_keys)))
    return hash_diff.change_counts(hash_diff.classify(now, now, ["o_orderkey"]))


def delete_missing_null_safe(spark: SparkSession, d: str) -> DataFrame:
    """Customers whose key the source still has; every 13th key is null on both sides."""
    c = table(spark, d, "customer").select(F.when(F.col("c_custkey") % 13 != 0, F.col("c_custkey")).alias("c_custkey"), "c_name")
    kept = hash_diff.delete_missing(c, c.where("c_custkey is null or c_custkey % 3 <> 0"), ["c_custkey"])
    return kept.select(F.col("c_custkey").cast("string").alias("c_custkey"), "c_name")


def older_customers(c: DataFrame) -> DataFrame:
    """The customers as they once were: fewer, others, and some in another segment."""
    was = c.where("c_custkey % 10 <> 0").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 7 == 0, F.lit("NONE")).otherwise(F.col("c_mktsegment")))
    return was.unionByName(c.where("c_custkey % 5 = 1").withColumn("c_custkey", -F.col("c_custkey")))


def merge_snapshot_state(spark: SparkSession, d: str) -> DataFrame:
    """The customer table after merging today's snapshot over an older state."""
    c = table(spark, d, "customer").select(*CUSTOMER.fields)
    old = older_customers(c)
    state = old.withColumn("row_hash", canonical.row_hash(old, list(CUSTOMER.hash_keys)))
    now = c.withColumn("row_hash", canonical.row_hash(c, list(CUSTOMER.hash_keys)))
    return hash_diff.merged(hash_diff.classify(now, state, ["c_custkey"]), old, ["c_custkey"])


def changed_columns(spark: SparkSession, d: str) -> DataFrame:
    """Which columns of a customer differ between two versions of the row."""
    c = table(spark, d, "customer")
    names = ["c_name", "c_nationkey", "c_mktsegment"]
    after = {"c_name": F.col("c_name"), "c_nationkey": F.when(F.col("c_custkey") % 7 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")), "c_mktsegment": F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment"))}
    return c.select("c_custkey", F.concat_ws(",", hash_diff.changed_columns({n: F.col(n) for n in names}, after)).alias("changed"))


# Validation

TIGHT = Contract(
    "sales.orders", "2", ORDERS.fields, ORDERS.field_types, ("o_orderkey",), ("o_orderkey",),
    schema_json={"type": "object", "properties": {"o_orderkey": {"type": "integer"}, "o_orderstatus": {"type": "string", "enum": ["F", "O"]}, "o_totalprice": {"type": "number", "minimum": 1000, "exclusiveMaximum": 300000}, "o_orderpriority": {"type": "string", "const": "1-URGENT"}}},
)


def dirty_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders whose keys are null for every 97th and whose customers are text for every 89th."""
    return table(spark, d, "orders").select(
        F.when(F.col("o_orderkey") % 97 != 0, F.col("o_orderkey")).alias("o_orderkey"), F.when(F.col("o_orderkey") % 89 == 0, "n/a").otherwise(F.col("o_custkey").cast("string")).alias("o_custkey"),
        "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", F.col("o_orderkey").alias("id"),
    )


def validate_orders_errors(spark: SparkSession, d: str) -> DataFrame:
    return _codes(validate.validated_rows(dirty_orders(spark, d), TIGHT), ["id"])


def snapshot_accept_gate(spark: SparkSession, d: str) -> DataFrame:
    v = validate.validated_rows(dirty_orders(spark, d), TIGHT)
    bad = F.size("errors") > 0
    return v.agg(F.count("*").alias("source_row_count"), F.count_if(~bad).alias("valid_row_count"), F.count_if(bad).alias("invalid_row_count"), (F.count_if(bad) == 0).alias("accepted"))


def error_preview_top5(spark: SparkSession, d: str) -> DataFrame:
    """The first five errors by key (the preview is the feature)."""
    v = validate.error_rows(validate.validated_rows(dirty_orders(spark, d), TIGHT), ["id"])
    return v.orderBy("id", "error_index").limit(5).select("id", "field", "code")


def validate_lineitem_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """How many rows of each order line have a key that another row has before them."""
    c = Contract("sales.lineitem", "1", ("l_orderkey", "l_linenumber"), {"l_orderkey": "integer", "l_linenumber": "integer"}, primary_keys=("l_orderkey", "l_linenumber"))
    li = table(spark, d, "lineitem")
    v = validate.with_duplicates(validate.validated_rows(li, c), c, [F.col("l_shipdate"), F.col("l_partkey"), F.col("l_suppkey")])
    return validate.error_rows(v, ["l_orderkey", "l_linenumber"]).groupBy("l_orderkey", "l_linenumber", "code").agg(F.count("*").alias("n"))


def validate_documents_strings(spark: SparkSession, d: str) -> DataFrame:
    c = Contract(
        "docs", "1", ("doc_id", "text", "lang", "repo"), {"doc_id": "integer", "text": "string", "lang": "string", "repo": "string"}, primary_keys=("doc_id",),
        schema_json={"type": "object", "properties": {"text": {"type": "string", "minLength": 300, "maxLength": 3000, "pattern": "return [a-z]+"}, "lang": {"type": ["string", "null"], "enum": ["python", "go", "java", None]}, "repo": {"type": "string", "minLength": 1}}},
    )
    return _codes(validate.validated_rows(table(spark, d, "documents"), c), ["doc_id"])


def validate_urls_format(spark: SparkSession, d: str) -> DataFrame:
    """uri, email and uuid formats over values made from customers."""
    u = table(spark, d, "customer").select(
        "c_custkey",
        F.concat(F.when(F.col("c_custkey") % 3 == 0, "").otherwise("https://"), F.lit("example.org/"), F.col("c_custkey").cast("string")).alias("url"),
        F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 4 == 0, " at ").otherwise("@"), F.lit("example.org")).alias("mail"),
        F.when(F.col("c_custkey") % 5 == 0, "none").otherwise(F.concat(F.lpad(F.hex("c_custkey"), 8, "0"), F.lit("-0000-4000-8000-000000000000"))).alias("ref"),
    )
    prop = lambda f: {"type": "string", "format": f}
    c = Contract("links", "1", ("c_custkey", "url", "mail", "ref"), {"c_custkey": "integer"}, primary_keys=("c_custkey",), schema_json={"type": "object", "properties": {"url": prop("uri"), "mail": prop("email"), "ref": prop("uuid")}})
    return _codes(validate.validated_rows(u, c), ["c_custkey"])


def validate_events_props(spark: SparkSession, d: str) -> DataFrame:
    """Nested objects: members that must be there, undeclared ones, and ranges within."""
    e = table(spark, d, "events").select("event_id", F.to_json(F.struct(F.col("user_id").alias("user"), F.when(F.col("event_id") % 3 != 0, F.struct(F.col("event_id").alias("n"), F.when(F.col("event_id") % 5 == 0, F.lit(1)).alias("extra"))).alias("inner"))).alias("body"))
    c = Contract("events", "1", ("event_id", "body"), {"event_id": "integer", "body": "string"}, primary_keys=("event_id",), schema_json={"type": "object", "properties": {"body": {"type": "object", "required": ["user", "inner"], "properties": {"user": {"type": "integer", "maximum": 100}, "inner": {"type": "object", "additionalProperties": False, "properties": {"n": {"type": "integer", "minimum": 10}}}}}}})
    return _codes(validate.validated_rows(e, c), ["event_id"])


def validate_embeddings_items(spark: SparkSession, d: str) -> DataFrame:
    """Array lengths, and every element of whole vectors by index."""
    e = table(spark, d, "embeddings").select("vec_id", F.when(F.col("vec_id") % 4 == 0, F.concat("embedding", F.slice("embedding", 1, 1))).when(F.col("vec_id") % 4 == 1, F.slice("embedding", 1, F.size("embedding") - 1)).otherwise(F.col("embedding")).alias("v"))
    c = Contract("vectors", "1", ("vec_id", "v"), {"vec_id": "integer", "v": "array"}, primary_keys=("vec_id",), schema_json={"type": "object", "properties": {"v": {"type": "array", "minItems": 64, "maxItems": 64, "items": {"type": "number", "maximum": 0.3}}}})
    return _codes(validate.validated_rows(e, c), ["vec_id"])


def validate_lines_keys(spark: SparkSession, d: str) -> DataFrame:
    """Composite keys in JSON: absent, null and well-formed parts of audit_log's keys."""
    c = Contract("lines", "1", ("order_id", "line_no"), {"order_id": "integer", "line_no": "integer"}, primary_keys=("order_id", "line_no"))
    a = table(spark, d, "audit_log").where("source_table = 'public.order_lines'").select("audit_event_id", "key_json").distinct()
    _, errors = validate.validated_keys(F.coalesce(validate.json_members(F.col("key_json")), F.create_map().cast("map<string,variant>")), c)
    return a.select("audit_event_id", F.explode(errors).alias("e")).select("audit_event_id", "e.field", "e.code").distinct()


# Audit events

#: Key fields and party of each audited table.
AUDITED = {"public.orders": (("order_id",), "customer_id"), "public.order_lines": (("order_id", "line_no"), "customer_id"), "public.accounts": (("account_id",), "owner_id"), "public.price_list": (("price_id",), "vendor_no")}


def audited_contract(name: str) -> Contract:
    keys, party = AUDITED[name]
    types = {k: "integer" for k in (*keys, party)} | {"amount": "decimal", "status": "string", "updated_at": "timestamp"}
    return Contract(f"audit of {name}", "1", tuple(types), types, keys, keys, hash_keys=(party, "status"))


def _log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.col("ts").alias("event_ts"), F.when(F.col("event_type") == "signup", "I").when(F.col("event_type") == "error", "D").otherwise("U").alias("op"), "user_id", "event_type")


def audit_latest_watermark(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "audit_log").select(F.coalesce("ordering_ts", "recorded_at").alias("event_ts"), F.col("audit_event_id").alias("event_id"))
    return delta.latest_position(a, ("event_ts", "event_id"))


def audit_window_scan(spark: SparkSession, d: str) -> DataFrame:
    """Events after one position and up to another."""
    a = table(spark, d, "audit_log").select(F.coalesce("ordering_ts", "recorded_at").alias("event_ts"), F.col("audit_event_id").alias("event_id"), "op")
    start, end = F.lit("2025-03-05 00:00:00").cast("timestamp_ntz"), F.lit("2025-03-20 12:00:00").cast("timestamp_ntz")
    return delta.window(a, ("event_ts", "event_id"), (start, F.lit(0)), (end, F.lit(10**12))).select("event_id", "op").distinct()


def _normalized_audit(spark: SparkSession, d: str) -> list[tuple[str, Contract, DataFrame]]:
    """The audit log by table, each event once, normalised under the table's contract."""
    a = table(spark, d, "audit_log").select("source_table", "audit_event_id", "op", "recorded_at", "ordering_ts", "key_json", "row_before", "row_after", "extracted_at")
    once = first_copies(a, ["audit_event_id"], [F.col("extracted_at")]).withColumns({"event_id": F.col("audit_event_id"), "event_ts": F.coalesce("ordering_ts", "recorded_at")})
    old = delta.audit_old_key(F.col("row_before"), F.col("key_json"))
    return [(n, audited_contract(n), delta.normalize_events(once.where(F.col("source_table") == n), audited_contract(n), delta.AUDIT, old_key=old)) for n in AUDITED]


def _by_table(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def key_text(c: Contract, prefix: str = "") -> Column:
    return F.concat_ws("/", *[F.col(f"{prefix}{k}").cast("string") for k in c.key_fields])


def audit_normalize_events(spark: SparkSession, d: str) -> DataFrame:
    """Upserts and deletes made of the audit log of all tables."""
    return _by_table([delta.delta_events(n, delta.AUDIT).select(F.lit(name).alias("source_table"), "event_id", "op", key_text(c, "key.").alias("key"), "row_hash") for name, c, n in _normalized_audit(spark, d)])


def audit_quarantine_counts(spark: SparkSession, d: str) -> DataFrame:
    return _by_table([delta.extract_counts(n).withColumn("source_table", F.lit(name)) for name, _, n in _normalized_audit(spark, d)])


def audit_event_errors(spark: SparkSession, d: str) -> DataFrame:
    return _by_table([delta.event_errors(n, ["event_id", "op"]).select(F.lit(name).alias("source_table"), "event_id", "op", "field", "code", "event_role") for name, _, n in _normalized_audit(spark, d)])


def delta_latest_effective(spark: SparkSession, d: str) -> DataFrame:
    e = _log(spark, d).withColumn("op", F.when(F.col("op") == "D", "DELETE").otherwise("UPSERT"))
    return delta.latest_effective(e, ["user_id"], ["event_ts", "event_id"]).select("user_id", "op", "event_id")


def _users(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(target, classified events): a table by user, before and after the event log."""
    e = _log(spark, d).select("event_id", "event_ts", F.when(F.col("op") == "D", "DELETE").otherwise("UPSERT").alias("op"), "user_id", "event_type")
    e = e.withColumn("row_hash", canonical.row_hash(e, ["user_id", "event_type"]))
    t = e.select("user_id").distinct().where("user_id % 3 <> 0").select("user_id", F.when(F.col("user_id") % 2 == 0, "click").otherwise("view").alias("event_type"))
    t = t.unionByName(t.where("user_id % 5 = 0").withColumn("user_id", -F.col("user_id")))
    state = t.withColumn("row_hash", canonical.row_hash(t, ["user_id", "event_type"]))
    effective = delta.latest_effective(e, ["user_id"], ["event_ts", "event_id"]).select("user_id", "event_type", "op", "row_hash")
    return t, delta.classify_effective(effective, state, ["user_id"])


def delta_apply_counts(spark: SparkSession, d: str) -> DataFrame:
    return delta.apply_counts(_users(spark, d)[1])


def delta_apply_state(spark: SparkSession, d: str) -> DataFrame:
    target, classified = _users(spark, d)
    return delta.applied(classified, target, ["user_id"])


def delta_artifact_rows(spark: SparkSession, d: str) -> DataFrame:
    """The delta artifacts as typed rows: hashes as supplied, completed where absent."""
    text = lambda names: "struct<" + ",".join(f"{n}:string" for n in names) + ">"
    op, out = F.upper(F.trim("op")), []
    for name in ("public.orders", "public.order_lines"):
        c = audited_contract(name)
        raw = table(spark, d, "audit_delta").where(F.col("source_table") == name)
        shaped = raw.select("event_id", "event_ts", F.when(op.isin("D", "DELETE"), "DELETE").otherwise("UPSERT").alias("op"), F.from_json("key_json", text(c.key_fields)).alias("key"), F.from_json("row_json", text(c.fields)).alias("row"), "row_hash")
        typed = typed_delta(shaped, c, delta.AUDIT)
        out.append(typed.select(F.lit(name).alias("source_table"), "event_id", "op", key_text(c).alias("key"), F.col("customer_id").cast("string").alias("customer_id"), "status", "row_hash").distinct())
    return _by_table(out)


# Change capture


def cdc_txn_quarantine(spark: SparkSession, d: str) -> DataFrame:
    """Transactions of five events each; any event of type error spoils its transaction."""
    e = table(spark, d, "events").select(F.expr("event_id div 5").alias("txn"), "event_id", F.when(F.col("event_type") == "error", F.array(validate.error("$", "unsupported_op", "x"))).otherwise(F.array().cast(validate.NO_ERRORS)).alias("errors"))
    q = delta.quarantine_transactions(e, ["txn"])
    return q.groupBy("txn").agg(F.count("*").alias("n_events"), F.count_if(F.size("errors") > 0).alias("n_invalid"), F.bool_or("quarantined").alias("quarantined"))


def cdc_latest_by_lsn(spark: SparkSession, d: str) -> DataFrame:
    c = delta.with_lsn(table(spark, d, "cdc_delta"))
    part = lambda n: F.trim(F.get_json_object("key_json", f"$.{n}")).try_cast("bigint")
    c = c.withColumns({"shipment_id": part("shipment_id"), "line_no": F.coalesce(part("line_no"), F.lit(0))})
    return delta.latest_effective(c, ["source_table", "shipment_id", "line_no"], ["__lsn", "change_index"]).select("source_table", "shipment_id", "line_no", "op", F.col("__lsn").alias("lsn"), "change_index")


def lsn_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "cdc_delta").select("commit_lsn").distinct()
    n = lsn.lsn_col(F.col("commit_lsn"))
    return c.select("commit_lsn", n.alias("as_int"), lsn.lsn_text(n).alias("as_text"))


def max_position(spark: SparkSession, d: str) -> DataFrame:
    """The greatest position of each change-capture table and the commit it belongs to."""
    c = delta.with_lsn(table(spark, d, "cdc_delta"))
    m = c.groupBy("source_table").agg(F.max(F.struct("__lsn", "change_index")).alias("p"), F.max(lsn.lsn_col(F.col("end_lsn"))).alias("end_lsn"))
    return m.select("source_table", F.col("p.__lsn").alias("lsn"), F.col("p.change_index").alias("change_index"), "end_lsn")


def _message_columns() -> dict[str, Column]:
    """pgoutput messages of one transaction per order: BEGIN, a change, COMMIT."""
    u = lambda c, n: F.unhex(F.lpad(F.hex(c.cast("bigint")), 2 * n, "0"))
    text = lambda c: F.concat(F.lit(b"t"), u(F.length(c.cast("binary")), 4), c.cast("binary"))
    key, status = F.col("o_orderkey").cast("string"), F.col("o_orderstatus")
    no_ts = F.lit(b"\0" * 8)
    row = F.concat(F.lit(b"N\0\2"), text(key), text(status))
    old = F.concat(F.lit(b"K\0\2"), text(key), F.lit(b"n"))
    change = (
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(b"I" + struct.pack("!I", 10)), row))
        .when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit(b"U" + struct.pack("!I", 10)), row))
        .otherwise(F.concat(F.lit(b"D" + struct.pack("!I", 10)), old))
    )
    at = u(F.col("o_orderkey"), 8)
    return {"begin": F.concat(F.lit(b"B"), at, no_ts, u(F.col("o_orderkey"), 4)), "change": change, "commit": F.concat(F.lit(b"C\0"), at, at, no_ts)}


def pgoutput_decode(spark: SparkSession, d: str) -> DataFrame:
    """Messages built from orders, decoded again."""
    rel = b"R" + struct.pack("!I", 10) + b"public\0orders\0d" + struct.pack("!H", 2) + b"\1id\0" + struct.pack("!Ii", 20, -1) + b"\0status\0" + struct.pack("!Ii", 25, -1)
    m = _message_columns()
    o = table(spark, d, "orders").withColumn("capture", F.expr("o_orderkey div 1000").cast("string"))
    parts = F.array(*[F.struct((F.col("o_orderkey") * 4 + i).alias("seq"), m[k].alias("data")) for i, k in enumerate(("begin", "change", "commit"))])
    msgs = o.select("capture", F.explode(parts).alias("m")).select("capture", "m.*")
    heads = o.select("capture").distinct().select("capture", F.lit(-1).cast("bigint").alias("seq"), F.lit(rel).alias("data"))
    ev = pgoutput.decode_messages(msgs.unionByName(heads), "public.orders")
    get = lambda c, k: F.get_json_object(c, f"$.{k}")
    return ev.select("xid", "op", "change_index", lsn.lsn_col(F.col("commit_lsn")).alias("lsn"), F.coalesce(get("row_after", "id"), get("old_key", "id")).cast("bigint").alias("id"), get("row_after", "status").alias("status"))


def row_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Rows numbered in key order without a one-partition window."""
    return validate.numbered(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"])


_Q = (
    row_hash_orders, row_hash_types, row_hash_documents_nested, hash_diff_orders, hash_diff_orders_counts, hash_diff_unchanged_rerun, delete_missing_null_safe, merge_snapshot_state, changed_columns,
    validate_orders_errors, snapshot_accept_gate, error_preview_top5, validate_lineitem_duplicates, validate_documents_strings, validate_urls_format, validate_events_props, validate_embeddings_items, validate_lines_keys,
    audit_latest_watermark, audit_window_scan, audit_normalize_events, audit_quarantine_counts, audit_event_errors, delta_latest_effective, delta_apply_counts, delta_apply_state, delta_artifact_rows,
    cdc_txn_quarantine, cdc_latest_by_lsn, lsn_roundtrip, max_position, pgoutput_decode, row_numbers,
)
QUERIES = {f.__name__: f for f in _Q}

_LSN = "(cast(('0x' || split_part(trim({0}), '/', 1)) as bigint) * 4294967296 + cast(('0x' || split_part(trim({0}), '/', 2)) as bigint))"
_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S') || case when extract(microsecond from {0}) % 1000000 <> 0 then strftime({0}, '.%f') else '' end"


def _n(c: str) -> str:
    return f"coalesce(cast({c} as varchar), '<NULL>')"


def _orders_hash(status: str = "o_orderstatus", key: str = "o_orderkey") -> str:
    return f"sha256(concat_ws('|', {_n(key)}, {_n('o_custkey')}, {_n(status)}, coalesce({_ISO.format('o_orderdate')}, '<NULL>'), {_n('o_orderpriority')}))"


_ORDERS_DIFF = f"""
with now as (select o_orderkey, {_orders_hash()} as h from orders),
was as (
  select o_orderkey, {_orders_hash("case when o_orderkey % 7 = 0 then 'old ' || o_orderstatus else o_orderstatus end")} as h from orders where o_orderkey % 10 <> 0
  union all select -o_orderkey, {_orders_hash(key='-o_orderkey')} from orders where o_orderkey % 100 = 1
), diff as (
  select coalesce(n.o_orderkey, w.o_orderkey) as o_orderkey,
    case when n.o_orderkey is null then 'DELETE' when w.o_orderkey is null then 'INSERT' when n.h <> w.h then 'UPDATE' else 'UNCHANGED' end as change_type
  from now n full join was w on n.o_orderkey = w.o_orderkey
)
"""
_COUNTS = """count(*) filter (change_type = 'INSERT') as insert_count, count(*) filter (change_type = 'UPDATE') as update_count,
  count(*) filter (change_type = 'UNCHANGED') as unchanged_count, count(*) filter (change_type = 'DELETE') as delete_count"""

_DIRTY = """
with e as (
  select o_orderkey as id, 'o_orderkey' as field, 'required_field' as code, 1 as ix from orders where o_orderkey % 97 = 0
  union all select o_orderkey, 'o_custkey', 'invalid_value', 2 from orders where o_orderkey % 89 = 0
), f as (
  select * from e
  union all
  select o_orderkey, field, code, ix from (
    select o_orderkey, unnest([
      {'field': 'o_orderstatus', 'code': case when o_orderstatus is null then 'schema.type' when o_orderstatus not in ('F', 'O') then 'schema.enum' end, 'ix': 3},
      {'field': 'o_totalprice', 'code': case when o_totalprice < 1000 then 'schema.minimum' end, 'ix': 4},
      {'field': 'o_totalprice', 'code': case when o_totalprice >= 300000 then 'schema.exclusive_maximum' end, 'ix': 5},
      {'field': 'o_orderpriority', 'code': case when o_orderpriority <> '1-URGENT' then 'schema.const' end, 'ix': 6}], recursive := true)
    from orders where o_orderkey % 97 <> 0 and o_orderkey % 89 <> 0
  ) where code is not null
)
"""

AUDIT_ONCE = """
with a as (
  select *, coalesce(ordering_ts, recorded_at) as event_ts, coalesce(row_before, key_json) as old,
    case source_table when 'public.accounts' then ['account_id'] when 'public.price_list' then ['price_id'] when 'public.order_lines' then ['order_id', 'line_no'] else ['order_id'] end as fields
  from audit_log qualify row_number() over (partition by audit_event_id order by extracted_at) = 1
), f as (select *, unnest(fields) as field from a),
e as (
  select source_table, audit_event_id as event_id, op, field, case when not coalesce(json_exists(old, '$.' || field), false) then 'missing_field' when json_extract_string(old, '$.' || field) is null then 'null_key' end as code, 'DELETE' as event_role
  from f where op in ('D', 'U')
  union all
  select source_table, audit_event_id, op, field, case when not json_exists(row_after, '$.' || field) then 'missing_field' when json_extract_string(row_after, '$.' || field) is null then 'required_field' end, 'UPSERT'
  from f where op in ('I', 'U') and row_after is not null
  union all
  select source_table, audit_event_id, op, '$', 'missing_row_after', 'UPSERT' from a where op in ('I', 'U') and row_after is null
), errors as (select * from e where code is not null),
good as (
  select *, list_aggregate(list_transform(fields, lambda x: json_extract_string(row_after, '$.' || x)), 'string_agg', '/') as new_key, list_aggregate(list_transform(fields, lambda x: json_extract_string(old, '$.' || x)), 'string_agg', '/') as old_key,
    json_extract_string(row_after, '$.status') as s, coalesce(json_extract_string(row_after, '$.customer_id'), json_extract_string(row_after, '$.owner_id'), json_extract_string(row_after, '$.vendor_no')) as party
  from a where audit_event_id not in (select event_id from errors)
), made as (
  select source_table, audit_event_id as event_id, event_ts, 'UPSERT' as op, new_key as key, sha256(concat_ws('|', coalesce(party, '<NULL>'), coalesce(s, '<NULL>'))) as row_hash, s as status from good where op in ('I', 'U')
  union all select source_table, audit_event_id, event_ts, 'DELETE', old_key, null, null from good where op = 'D' or (op = 'U' and old_key <> new_key)
)
"""

_USERS = """
with e as (select event_id, ts, case when event_type = 'error' then 'DELETE' else 'UPSERT' end as op, user_id, event_type from events),
t0 as (select distinct user_id, case when user_id % 2 = 0 then 'click' else 'view' end as event_type from e where user_id % 3 <> 0),
t as (select * from t0 union all select -user_id, event_type from t0 where user_id % 5 = 0),
latest as (select * from e qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1),
c as (
  select l.user_id, l.event_type, case when l.op = 'DELETE' then case when t.user_id is null then 'ABSENT' else 'DELETE' end
    when t.user_id is null then 'INSERT' when t.event_type is distinct from l.event_type then 'UPDATE' else 'UNCHANGED' end as change_type
  from latest l left join t on t.user_id = l.user_id
)
"""

ORACLE = {
    "row_hash_orders": f"select o_orderkey, {_orders_hash()} as row_hash from orders",
    "row_hash_types": """select p_partkey, concat_ws('|', cast(p_partkey as varchar), cast(cast(p_size as decimal(12,2)) as varchar), strftime(date '2020-01-01' + p_size::int, '%Y-%m-%d'),
        case when p_size > 25 then 'True' else 'False' end, case when p_size % 2 = 0 then p_brand else '<NULL>' end) as canonical_text from part""",
    "row_hash_documents_nested": """select event_id, '{"a":[' || event_id || ',' || user_id || '],"t":"' || event_type || '","u":' || user_id || '}' as canonical_text from events""",
    "hash_diff_orders": _ORDERS_DIFF + "select * from diff",
    "hash_diff_orders_counts": _ORDERS_DIFF + f"select {_COUNTS} from diff",
    "hash_diff_unchanged_rerun": "select 0::bigint as insert_count, 0::bigint as update_count, count(*) as unchanged_count, 0::bigint as delete_count from orders",
    "delete_missing_null_safe": """with c as (select case when c_custkey % 13 <> 0 then c_custkey end as c_custkey, c_name from customer)
        select cast(c_custkey as varchar) as c_custkey, c_name from c t where exists (select 1 from c s where (s.c_custkey is null or s.c_custkey % 3 <> 0) and s.c_custkey is not distinct from t.c_custkey)""",
    "merge_snapshot_state": """
        with old as (
          select c_custkey, c_name, c_nationkey, case when c_custkey % 7 = 0 then 'NONE' else c_mktsegment end as c_mktsegment from customer where c_custkey % 10 <> 0
          union all select -c_custkey, c_name, c_nationkey, c_mktsegment from customer where c_custkey % 5 = 1
        ), hashed as (select c.*, o.c_custkey is not null as stored, sha256(concat_ws('|', c.c_name, c.c_nationkey, c.c_mktsegment)) = sha256(concat_ws('|', o.c_name, o.c_nationkey, o.c_mktsegment)) as same from customer c left join old o using (c_custkey))
        select c_custkey, c_name, c_nationkey, c_mktsegment from hashed where not stored or not same
        union all select c_custkey, c_name, c_nationkey, c_mktsegment from old where c_custkey in (select c_custkey from hashed where stored and same)""",
    "changed_columns": "select c_custkey, concat_ws(',', case when c_custkey % 5 = 0 and c_mktsegment is not null then 'c_mktsegment' end, case when c_custkey % 7 = 0 and c_nationkey is not null then 'c_nationkey' end) as changed from customer",
    "validate_orders_errors": _DIRTY + "select id, field, code from f",
    "snapshot_accept_gate": _DIRTY + """, n as (select count(distinct id) as bad from f), o as (select count(*) as total from orders)
        select total as source_row_count, total - bad as valid_row_count, bad as invalid_row_count, bad = 0 as accepted from n, o""",
    "error_preview_top5": _DIRTY + "select id, field, code from f order by id, ix limit 5",
    "validate_lineitem_duplicates": "select l_orderkey, l_linenumber, 'duplicate_key' as code, count(*) - 1 as n from lineitem group by 1, 2 having count(*) > 1",
    "validate_documents_strings": """
        select doc_id, field, code from (
          select doc_id, unnest([
            {'field': 'text', 'code': case when text is null then 'schema.type' when length(text) < 300 then 'schema.min_length' end},
            {'field': 'text', 'code': case when length(text) > 3000 then 'schema.max_length' end},
            {'field': 'text', 'code': case when not regexp_matches(text, 'return [a-z]+') then 'schema.pattern' end},
            {'field': 'lang', 'code': case when lang not in ('python', 'go', 'java') then 'schema.enum' end},
            {'field': 'repo', 'code': case when repo is null then 'schema.type' when length(repo) < 1 then 'schema.min_length' end}], recursive := true)
          from documents where doc_id is not null) where code is not null""",
    "validate_urls_format": """
        select c_custkey, 'url' as field, 'schema.format' as code from customer where c_custkey % 3 = 0
        union all select c_custkey, 'mail', 'schema.format' from customer where c_custkey % 4 = 0
        union all select c_custkey, 'ref', 'schema.format' from customer where c_custkey % 5 = 0""",
    "validate_events_props": """
        select event_id, 'body.inner' as field, 'schema.required' as code from events where event_id % 3 = 0
        union all select event_id, 'body.user', 'schema.maximum' from events where user_id > 100
        union all select event_id, 'body.inner.extra', 'schema.additional_properties' from events where event_id % 3 <> 0 and event_id % 5 = 0
        union all select event_id, 'body.inner.n', 'schema.minimum' from events where event_id % 3 <> 0 and event_id < 10""",
    "validate_embeddings_items": """
        with e as (select vec_id, case vec_id % 4 when 0 then embedding || embedding[1:1] when 1 then embedding[1:len(embedding) - 1] else embedding end as v from embeddings)
        select vec_id, 'v' as field, 'schema.min_items' as code from e where len(v) < 64
        union all select vec_id, 'v', 'schema.max_items' from e where len(v) > 64
        union all select vec_id, 'v[' || (i - 1) || ']', 'schema.maximum' from (select vec_id, v, unnest(range(1, len(v) + 1)) as i from e) where v[i]::double > 0.3""",
    "validate_lines_keys": """
        with k as (select distinct audit_event_id, key_json from audit_log where source_table = 'public.order_lines'),
        p as (select audit_event_id, key_json, unnest(['order_id', 'line_no']) as field from k)
        select distinct audit_event_id, field, case when not json_exists(key_json, '$.' || field) then 'missing_field' else 'null_key' end as code
        from p where json_extract_string(key_json, '$.' || field) is null""",
    "audit_latest_watermark": "select coalesce(ordering_ts, recorded_at) as event_ts, audit_event_id as event_id from audit_log order by 1 desc, 2 desc limit 1",
    "audit_window_scan": """
        with p as (select audit_event_id as event_id, op, coalesce(ordering_ts, recorded_at) as ts from audit_log)
        select distinct event_id, op from p where (ts > timestamp '2025-03-05 00:00:00' or (ts = timestamp '2025-03-05 00:00:00' and event_id > 0))
        and (ts < timestamp '2025-03-20 12:00:00' or (ts = timestamp '2025-03-20 12:00:00' and event_id <= 1000000000000))""",
    "audit_normalize_events": AUDIT_ONCE + "select source_table, event_id, op, key, row_hash from made",
    "audit_quarantine_counts": AUDIT_ONCE + """, n as (select source_table, count(*) as n from a group by 1), x as (select source_table, count(distinct event_id) as x from errors group by 1),
        m as (select source_table, count(*) as c, count(*) filter (op = 'UPSERT') as u, count(*) filter (op = 'DELETE') as d from made group by 1)
        select source_table, n as source_event_count, c as normalized_event_count, u as upsert_event_count, d as delete_event_count, coalesce(x, 0) as invalid_event_count from n join m using (source_table) left join x using (source_table)""",
    "audit_event_errors": AUDIT_ONCE + "select source_table, event_id, op, field, code, event_role from errors",
    "delta_latest_effective": _USERS + "select user_id, op, event_id from latest",
    "delta_apply_counts": _USERS + """select count(*) as effective_event_count, count(*) filter (change_type = 'INSERT') as insert_count, count(*) filter (change_type = 'UPDATE') as update_count,
        count(*) filter (change_type = 'DELETE') as delete_count, count(*) filter (change_type = 'UNCHANGED') as unchanged_count from c""",
    "delta_apply_state": _USERS + """select user_id, event_type from t where user_id not in (select user_id from c)
        union all select user_id, event_type from c where change_type in ('INSERT', 'UPDATE', 'UNCHANGED')""",
    "delta_artifact_rows": """
        with r as (select source_table, event_id, case when upper(trim(op)) in ('D', 'DELETE') then 'DELETE' else 'UPSERT' end as op, key_json, row_json, lower(nullif(trim(row_hash), '')) as given from audit_delta where source_table in ('public.orders', 'public.order_lines')),
        k as (select *, case when op = 'UPSERT' then coalesce(row_json, key_json) else key_json end as from_json from r)
        select distinct source_table, event_id, op, concat_ws('/', json_extract_string(from_json, '$.order_id'), json_extract_string(from_json, '$.line_no')) as key,
          case when op = 'UPSERT' then cast(try_cast(json_extract_string(row_json, '$.customer_id') as bigint) as varchar) end as customer_id, case when op = 'UPSERT' then json_extract_string(row_json, '$.status') end as status,
          case when op = 'UPSERT' then coalesce(given, sha256(concat_ws('|', coalesce(json_extract_string(row_json, '$.customer_id'), '<NULL>'), coalesce(json_extract_string(row_json, '$.status'), '<NULL>')))) end as row_hash from k""",
    "cdc_txn_quarantine": "select event_id // 5 as txn, count(*) as n_events, count(*) filter (event_type = 'error') as n_invalid, count(*) filter (event_type = 'error') > 0 as quarantined from events group by 1",
    "cdc_latest_by_lsn": f"""
        with k as (select source_table, try_cast(json_extract_string(key_json, '$.shipment_id') as bigint) as shipment_id, coalesce(try_cast(json_extract_string(key_json, '$.line_no') as bigint), 0) as line_no, op, {_LSN.format('commit_lsn')} as lsn, change_index from cdc_delta)
        select * from k qualify row_number() over (partition by source_table, shipment_id, line_no order by lsn desc, change_index desc, op desc) = 1""",
    "lsn_roundtrip": f"""select commit_lsn, n as as_int, upper(format('{{:x}}/{{:x}}', n >> 32, n & 4294967295)) as as_text from (select distinct commit_lsn, {_LSN.format('commit_lsn')} as n from cdc_delta)""",
    "max_position": f"""with p as (select source_table, {_LSN.format('commit_lsn')} as lsn, change_index, {_LSN.format('end_lsn')} as e from cdc_delta)
        select source_table, arg_max(lsn, (lsn, change_index)) as lsn, arg_max(change_index, (lsn, change_index)) as change_index, max(e) as end_lsn from p group by 1""",
    "pgoutput_decode": """select o_orderkey as xid, case o_orderkey % 3 when 0 then 'I' when 1 then 'U' else 'D' end as op, 0::bigint as change_index, o_orderkey as lsn, o_orderkey as id,
        case when o_orderkey % 3 <> 2 then o_orderstatus end as status from orders""",
    "row_numbers": "select o_orderkey, row_number() over (order by o_orderkey) as row_number from orders",
}
