"""Queries p1 to p6 over the change tables, and the same in SQL for the check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.hashes import row_hash64
from tidemark.functions.lsn import lsn_col, lsn_text
from tidemark.functions.times import utc_micros
from tidemark.operators import change_feed as cf
from tidemark.operators import drift, incremental, late_events, redelivery, snapshots
from tidemark.plans import drift_sql
from tidemark.session import broadcast_if_small, shared_dir


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# 1: applying a stream of inserts, updates and deletes

_KEY = ["feed", "source_table", "key_id", "line_no"]


def _all_changes(spark: SparkSession, d: str) -> DataFrame:
    return cf.normalise_audit(table(spark, d, "audit_delta")).unionByName(cf.normalise_cdc(table(spark, d, "cdc_delta")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return cf.current_state(_all_changes(spark, d), _KEY, ("p_major", "p_minor"), cf.is_delete(F.col("op"))).drop("image")


def p1_state(spark: SparkSession, d: str) -> DataFrame:
    """The current rows themselves, as the members every table has."""
    s = cf.current_state(_all_changes(spark, d), _KEY, ("p_major", "p_minor"), cf.is_delete(F.col("op")), image=F.col("row_json"))
    row = F.from_json("image", "customer_id bigint, amount string, status string")
    return s.select(*_KEY, row["customer_id"].cast("string").alias("customer_id"), row["amount"].alias("amount"), row["status"].alias("status"))


# 2: what changed between full snapshots

_VALUES = ("customer_id", "amount", "status", "updated_at", "order_id", "line_no")


def _snapshots(spark: SparkSession, d: str) -> dict:
    """Rows, key, compared values and precedence, as the snapshot operators take them."""
    rows = table(spark, d, "snapshot_rows")
    newest = table(spark, d, "contracts").groupBy("contract_id").agg(F.max_by(F.struct("hash_keys", "fields", "primary_keys", "business_keys"), F.struct("published_at", "version")).alias("c"))
    filled = lambda *names: F.coalesce(*[F.when(F.size(f"c.{n}") > 0, F.col(f"c.{n}")) for n in names], F.array().cast("array<string>"))
    specs = newest.select(F.col("contract_id").alias("__c"), filled("hash_keys", "fields").alias("__hashed"), filled("primary_keys", "business_keys").alias("__key"))
    rows = rows.join(broadcast_if_small(specs), F.col("contract_id") == F.col("__c"), "left")
    of = lambda spec, name: F.when(F.array_contains(spec, name), F.col(name))
    # A column that isn't part of a contract's key isn't shown as one either.
    rows = rows.withColumns({"key_order_id": of("__key", "order_id").cast("bigint"), "key_line_no": of("__key", "line_no").cast("bigint")})
    key = [F.col("key_order_id"), F.col("key_line_no")]
    compared = row_hash64([of("__hashed", c) for c in _VALUES], "values")
    first = [F.col("row_number_in_file"), F.col("delivery_no"), F.col("snapshot_at")]
    return {"rows": rows, "group": "contract_id", "snapshot": "snapshot_no", "key": key, "value_hash": compared, "first": first, "carry": ["key_order_id", "key_line_no"]}


def _snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.snapshot_changes(**_snapshots(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _snapshot_diff(spark, d).select("contract_id", "snapshot_no", F.col("key_order_id").alias("order_id"), F.coalesce("key_line_no", F.lit(0).cast("bigint")).alias("line_no"), "change")


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    """Per snapshot the counts a run reports (delete_count and its like)."""
    n = lambda what: F.count_if(F.col("change") == what)
    return p2_found(spark, d).groupBy("contract_id", "snapshot_no").agg(n("added").alias("insert_count"), n("changed").alias("update_count"), n("removed").alias("delete_count"))


def p2_rows(spark: SparkSession, d: str) -> DataFrame:
    """The full rows of the keys that were added or changed, fetched for those keys only."""
    s = _snapshots(spark, d)
    found = snapshots.differing_rows(snapshots.snapshot_changes(**s), **{k: s[k] for k in ("rows", "group", "snapshot", "key", "first")})
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c)
    return found.select("contract_id", F.col("snapshot_no").cast("bigint").alias("snapshot_no"), F.col("key_order_id").alias("order_id"), F.coalesce("key_line_no", F.lit(0).cast("bigint")).alias("line_no"), "change", text("customer_id"), text("amount"), text("status"))


# 3: messages delivered more than once


def _audit_messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "audit_log").select(
        F.lit("audit").alias("feed"), "source_table", F.col("audit_event_id").alias("id_major"), F.lit(0).cast("bigint").alias("id_minor"), F.upper(F.trim("op")).alias("op"),
        F.col("extracted_at").alias("arrived_at"), F.col("extract_batch").alias("batch"),
    )


def _cdc_messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cdc_delta").select(
        F.lit("cdc").alias("feed"), "source_table", lsn_col(F.col("commit_lsn")).alias("id_major"), F.col("change_index").alias("id_minor"), F.upper(F.trim("op")).alias("op"),
        F.col("received_at").alias("arrived_at"), F.col("batch_no").alias("batch"),
    )


_MESSAGE = ["feed", "source_table", "id_major", "id_minor", "op"]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    m = _audit_messages(spark, d).unionByName(_cdc_messages(spark, d)).where("id_major is not null and id_minor is not null")
    return redelivery.repeated_identifiers(m, _MESSAGE, [F.col("arrived_at"), F.col("batch")])


def p3_first_copies(spark: SparkSession, d: str) -> DataFrame:
    """The copy kept of every message, with its time of arrival."""
    m = _audit_messages(spark, d).unionByName(_cdc_messages(spark, d))
    return redelivery.first_copies(m, _MESSAGE, [F.col("arrived_at"), F.col("batch")]).drop("batch")


def p3_accepted(spark: SparkSession, d: str) -> DataFrame:
    """What the later half of each feed's batches brought that the earlier half hadn't."""
    m = _audit_messages(spark, d).unionByName(_cdc_messages(spark, d))
    last = m.groupBy("feed").agg(F.max("batch").alias("__last"))
    m = m.join(broadcast_if_small(last), "feed")
    seen = redelivery.SeenMessages(spark, shared_dir(spark, "seen"), _MESSAGE, [F.col("arrived_at")])
    seen.accept(m.where("batch * 2 <= __last").drop("__last"), 1)
    return seen.accept(m.where("batch * 2 > __last").drop("__last"), 2).select(*_MESSAGE)


# 4: late and out-of-order events


#: Into how many batches a log is cut when it is replayed.
REPLAYED_BATCHES = 6


def _late_counts(spark: SparkSession, d: str) -> late_events.LateEventCounts:
    """The log replayed in the order of its extract batches, several at a time."""
    op = late_events.LateEventCounts(spark, shared_dir(spark, "late-events"), ["audit_event_id"], ["source_table"], "recorded_at", "ordering_ts")
    for n, part in enumerate(late_events.in_groups(table(spark, d, "audit_log"), "extract_batch", REPLAYED_BATCHES)):
        op.add_batch(part, n)
    return op


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _late_counts(spark, d).events().where("lateness <> 'on_time'").select("audit_event_id", "lateness")


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    c = _late_counts(spark, d).counts()
    return c.select("source_table", F.col("period_start").cast("timestamp_ntz").alias("period_start"), "n_events", "n_late", "n_too_late")


def p4_recomputed(spark: SparkSession, d: str) -> DataFrame:
    """Which days each replayed batch was the last to recompute."""
    return _late_counts(spark, d).counts().groupBy("part").agg(F.max("as_of").alias("as_of")).where("as_of is not null")


# 5: processing only new or changed records


def _positions(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "audit_log")
    c = table(spark, d, "cdc_delta")
    seen = utc_micros(F.coalesce("ordering_ts", "recorded_at"))
    audit = a.select(F.lit("audit").alias("feed"), "source_table", F.col("audit_event_id").alias("id_major"), F.lit(0).cast("bigint").alias("id_minor"), seen.alias("pos0"), F.col("audit_event_id").alias("pos1"), F.floor(seen / F.lit(86_400_000_000)).alias("segment"))
    end = F.coalesce(lsn_col(F.col("end_lsn")), lsn_col(F.col("commit_lsn")))
    cdc = c.select(F.lit("cdc").alias("feed"), "source_table", lsn_col(F.col("commit_lsn")).alias("id_major"), F.col("change_index").alias("id_minor"), end.alias("pos0"), F.lit(0).cast("bigint").alias("pos1"), F.floor(end / F.lit(1 << 30)).alias("segment"))
    return audit.unionByName(cdc).where("id_major is not null and id_minor is not null")


def furthest_marks(checkpoints: DataFrame) -> DataFrame:
    """The furthest position that a succeeded run noted, per feed and source table."""
    ok = checkpoints.where(F.lower(F.trim("status")) == "succeeded")
    audit = ok.where("feed = 'audit' and ordering_ts is not null and event_id is not null").select("feed", "source_table", utc_micros(F.col("ordering_ts")).alias("m0"), F.col("event_id").alias("m1"))
    cdc = ok.where("feed = 'cdc'").select("feed", "source_table", lsn_col(F.col("last_applied_lsn")).alias("m0"), F.lit(0).cast("bigint").alias("m1")).where("m0 is not null")
    m = audit.unionByName(cdc).groupBy("feed", "source_table").agg(F.max(F.struct("m0", "m1")).alias("m"))
    return m.select("feed", "source_table", "m.m0", "m.m1")


def _next_run(spark: SparkSession, d: str) -> incremental.IncrementalTable:
    marks = furthest_marks(table(spark, d, "run_checkpoints"))
    return incremental.next_run(_positions(spark, d), marks, ["feed", "source_table"], ["id_major", "id_minor"], ("pos0", "pos1"), "segment", shared_dir(spark, "incremental"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    t = _next_run(spark, d)
    return t.read().where(F.col("first_run") == t.version()).select("feed", "source_table", "id_major", "id_minor").distinct()


def p5_replaced(spark: SparkSession, d: str) -> DataFrame:
    """The partitions that the next run replaces, with their events and how many are new."""
    t = _next_run(spark, d)
    new = F.col("first_run") == t.version()
    return t.read().groupBy("feed", "source_table", "segment").agg(F.count("*").alias("n"), F.count_if(new).alias("n_new")).where("n_new > 0")


def p5_marks(spark: SparkSession, d: str) -> DataFrame:
    m = furthest_marks(table(spark, d, "run_checkpoints"))
    return m.select("feed", "source_table", "m0", "m1", F.when(F.col("feed") == "cdc", lsn_text(F.col("m0"))).alias("lsn"))


def p5_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Events per feed, source table and segment (the fingerprints' counts)."""
    once = _positions(spark, d).distinct()
    return incremental.fingerprints(once, ["feed", "source_table", "segment"], ["id_major", "id_minor"]).select("feed", "source_table", "segment", "n")


# 6: schemas that drift between files


def _ingested(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(contracts, their fields by version, landed lines as ingested and stored)."""
    contracts = table(spark, d, "contracts")
    fields = drift.schema_fields(contracts)
    return contracts, fields, drift.stored_ingest(table(spark, d, "landed_rows"), contracts, fields=fields, candidates=drift.rename_candidates(fields))


def _beyond(ingested: DataFrame) -> DataFrame:
    return drift.undeclared_fields(ingested).select("contract_id", F.col("file_version").alias("version"), "file_id", F.lit("undeclared").alias("change"), "field", F.lit("").alias("old_field"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    contracts, fields, ingested = _ingested(spark, d)
    declared = drift.schema_changes(contracts, ingested=ingested, fields=fields).select("contract_id", "version", F.lit(0).cast("bigint").alias("file_id"), "change", "field", "old_field")
    return declared.unionByName(_beyond(ingested))


def p6_undeclared(spark: SparkSession, d: str) -> DataFrame:
    """The fields that files hold beyond their version, by themselves."""
    return _beyond(_ingested(spark, d)[2])


def _consistent(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(consistent rows, kinds of the current fields): rescued values replayed, names current."""
    contracts, fields, ingested = _ingested(spark, d)
    names = drift.current_names(drift.schema_changes(contracts, ingested=ingested, fields=fields), contracts, fields)
    promoted = drift.promote(ingested, drift.current_kinds(fields, names))
    last = fields.groupBy("contract_id").agg(F.max("step").alias("step"))
    return drift.consistent_rows(promoted, names), fields.join(last, ["contract_id", "step"]).select("contract_id", "field", "kind")


def p6_consistent(spark: SparkSession, d: str) -> DataFrame:
    """Every landed line in its contract's one table: typed members under current names."""
    rows, _ = _consistent(spark, d)
    return rows.select("contract_id", "file_id", "line_in_file", "file_version", "well_formed", F.when(F.col("well_formed"), F.to_json(F.map_from_entries(F.array_sort(F.map_entries("row"))))).alias("row_json"), "rescued")


def p6_tables(spark: SparkSession, d: str) -> DataFrame:
    """The typed table of every contract: per column its lines and its values."""
    rows, kinds = _consistent(spark, d)
    path = shared_dir(spark, "consistent")
    rows.write.parquet(path)
    rows, out = spark.read.parquet(path), None
    by_contract: dict[str, dict[str, str]] = {}
    landed = rows.select("contract_id").distinct()
    for k in kinds.join(landed, "contract_id").orderBy("contract_id", "field").toLocalIterator():
        by_contract.setdefault(k["contract_id"], {})[k["field"]] = k["kind"]
    for contract_id, columns in by_contract.items():
        t = drift.contract_table(rows, contract_id, columns)
        n = t.agg(F.count("*").alias("n_lines"), *[F.count(f"`{c}`").alias(f"n{i}") for i, c in enumerate(columns)])
        one = n.select(F.lit(contract_id).alias("contract_id"), "n_lines", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.lit(k).alias("kind"), F.col(f"n{i}").alias("n_values")) for i, (c, k) in enumerate(columns.items())])).alias("x")).select("contract_id", "x.*", "n_lines")
        out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], "contract_id string, field string, kind string, n_values long, n_lines long") if out is None else out


def p6_rescued_counts(spark: SparkSession, d: str) -> DataFrame:
    """Per contract: lines, lines that aren't JSON objects, lines with rescued members."""
    i = _ingested(spark, d)[2]
    return i.groupBy("contract_id").agg(F.count("*").alias("n_lines"), F.count_if(~F.col("well_formed")).alias("n_malformed"), F.count_if(F.size("undeclared") > 0).alias("n_undeclared"))


QUERIES = {f.__name__: f for f in (p1_found, p1_state, p2_found, p2_counts, p2_rows, p3_found, p3_first_copies, p3_accepted, p4_found, p4_counts, p4_recomputed, p5_found, p5_replaced, p5_marks, p5_fingerprints, p6_found, p6_undeclared, p6_consistent, p6_tables, p6_rescued_counts)}

_LSN = "(cast(('0x' || split_part(trim({0}), '/', 1)) as bigint) * 4294967296 + cast(('0x' || split_part(trim({0}), '/', 2)) as bigint))"


def _lsn_sql(c: str) -> str:
    return _LSN.format(c)


_CHANGES = f"""
with changes as (
  select 'audit' as feed, source_table, try_cast(json_extract_string(key_json, '$.order_id') as bigint) as key_id,
         case when json_extract_string(key_json, '$.line_no') is null then 0 else try_cast(json_extract_string(key_json, '$.line_no') as bigint) end as line_no,
         epoch_us(event_ts) as pos_major, event_id as pos_minor, upper(trim(op)) in ('DELETE', 'D') as gone, row_json
  from audit_delta
  union all
  select 'cdc', source_table, try_cast(json_extract_string(key_json, '$.shipment_id') as bigint),
         case when json_extract_string(key_json, '$.line_no') is null then 0 else try_cast(json_extract_string(key_json, '$.line_no') as bigint) end,
         {_lsn_sql('commit_lsn')}, change_index, upper(trim(op)) in ('DELETE', 'D'), row_json
  from cdc_delta
), latest as (
  select * from changes where key_id is not null and line_no is not null
  qualify row_number() over (partition by feed, source_table, key_id, line_no order by pos_major desc, pos_minor desc, gone, row_json desc) = 1
)
"""

_MESSAGES = f"""
with m as (
  select 'audit' as feed, source_table, audit_event_id as id_major, 0::bigint as id_minor, upper(trim(op)) as op, extracted_at as arrived_at, extract_batch as batch from audit_log
  union all
  select 'cdc', source_table, {_lsn_sql('commit_lsn')}, change_index, upper(trim(op)), received_at, batch_no from cdc_delta
)
"""

_SNAPSHOTS = """
with spec as (
  select contract_id, arg_max(case when len(hash_keys) > 0 then hash_keys else fields end, struct_pack(p := published_at, v := version)) as hashed from contracts group by 1
), kept as (
  select contract_id, snapshot_no, order_id, coalesce(line_no, 0) as line_no, customer_id, amount, status, updated_at from snapshot_rows
  qualify row_number() over (partition by contract_id, snapshot_no, order_id, line_no order by row_number_in_file, delivery_no) = 1
), numbers as (
  select contract_id, snapshot_no, lag(snapshot_no) over (partition by contract_id order by snapshot_no) as before
  from (select distinct contract_id, snapshot_no from snapshot_rows)
), here as (
  select k.*, n.before from kept k join numbers n using (contract_id, snapshot_no) where n.before is not null
), there as (
  select k.*, n.snapshot_no as later from kept k join numbers n on k.contract_id = n.contract_id and k.snapshot_no = n.before
), found as (
  select coalesce(h.contract_id, t.contract_id) as contract_id, coalesce(h.snapshot_no, t.later)::bigint as snapshot_no,
         coalesce(h.order_id, t.order_id) as order_id, coalesce(h.line_no, t.line_no)::bigint as line_no,
         case when t.order_id is null then 'added' when h.order_id is null then 'removed' else 'changed' end as change
  from here h full join there t on h.contract_id = t.contract_id and h.snapshot_no = t.later and h.order_id = t.order_id and h.line_no = t.line_no
  join spec s on s.contract_id = coalesce(h.contract_id, t.contract_id)
  where t.order_id is null or h.order_id is null
     or (list_contains(s.hashed, 'customer_id') and h.customer_id is distinct from t.customer_id) or (list_contains(s.hashed, 'amount') and h.amount is distinct from t.amount)
     or (list_contains(s.hashed, 'status') and h.status is distinct from t.status) or (list_contains(s.hashed, 'updated_at') and h.updated_at is distinct from t.updated_at)
)
"""

_VISIBLE = """
with e as (
  select audit_event_id, any_value(source_table) as source_table, min(recorded_at) as recorded_at, min(coalesce(ordering_ts, recorded_at)) as seen
  from audit_log where recorded_at is not null group by 1
), c as (
  select *, date_trunc('hour', recorded_at) as period_start,
    case when seen < date_trunc('hour', recorded_at) + interval 1 hour then 'on_time'
         when seen < date_trunc('hour', recorded_at) + interval 7 hour then 'late' else 'too_late' end as lateness
  from e
)
"""

_POSITIONS = f"""
with marks as (
  select feed, source_table, ordering_ts, event_id, null::bigint as lsn from run_checkpoints
  where status = 'succeeded' and feed = 'audit' and ordering_ts is not null and event_id is not null
  qualify row_number() over (partition by source_table order by ordering_ts desc, event_id desc) = 1
  union all
  select 'cdc', source_table, null, null, max({_lsn_sql('last_applied_lsn')}) from run_checkpoints
  where status = 'succeeded' and feed = 'cdc' and last_applied_lsn is not null group by source_table
)
"""

ORACLE = {
    "p1_found": _CHANGES + "select feed, source_table, key_id, line_no, pos_major, pos_minor from latest where not gone",
    "p1_state": _CHANGES + """select feed, source_table, key_id, line_no, cast(try_cast(json_extract_string(row_json, '$.customer_id') as bigint) as varchar) as customer_id,
        json_extract_string(row_json, '$.amount') as amount, json_extract_string(row_json, '$.status') as status from latest where not gone""",
    "p2_found": _SNAPSHOTS + "select * from found",
    "p2_counts": _SNAPSHOTS + """select contract_id, snapshot_no, count(*) filter (change = 'added') as insert_count, count(*) filter (change = 'changed') as update_count,
        count(*) filter (change = 'removed') as delete_count from found group by 1, 2""",
    "p2_rows": _SNAPSHOTS + """select f.contract_id, f.snapshot_no, f.order_id, f.line_no, f.change, coalesce(cast(k.customer_id as varchar), '-') as customer_id, coalesce(cast(k.amount as varchar), '-') as amount, coalesce(k.status, '-') as status
        from found f join kept k on k.contract_id = f.contract_id and k.snapshot_no = f.snapshot_no and k.order_id = f.order_id and k.line_no = f.line_no where f.change <> 'removed'""",
    "p3_found": _MESSAGES + "select feed, source_table, id_major, id_minor, op from m where id_major is not null and id_minor is not null group by all having count(*) > 1",
    "p3_first_copies": _MESSAGES + "select feed, source_table, id_major, id_minor, op, min(arrived_at) as arrived_at from m group by 1, 2, 3, 4, 5",
    "p3_accepted": _MESSAGES + """, last as (select feed, max(batch) as b from m group by 1)
        select distinct feed, source_table, id_major, id_minor, op from m join last using (feed) where batch * 2 > b
        except select feed, source_table, id_major, id_minor, op from m join last using (feed) where batch * 2 <= b""",
    "p4_found": _VISIBLE + "select audit_event_id, lateness from c where lateness <> 'on_time'",
    "p4_counts": _VISIBLE + """select source_table, period_start, count(*) filter (lateness <> 'too_late') as n_events, count(*) filter (lateness = 'late') as n_late,
        count(*) filter (lateness = 'too_late') as n_too_late from c group by 1, 2""",
    "p4_recomputed": _VISIBLE + f""", sizes as (select extract_batch as b, count(*) as n from audit_log where extract_batch is not null group by 1),
        sized as (select b, n, sum(n) over (order by b) as done, sum(n) over () as total from sizes),
        cut as (select b, dense_rank() over (order by least({REPLAYED_BATCHES} - 1, ((done - 1) * {REPLAYED_BATCHES} // total)::bigint)) - 1 as g from sized),
        first_in as (select audit_event_id, min(coalesce(g, 0)) as g from audit_log left join cut on b = extract_batch group by 1)
        select strftime(recorded_at, '%Y%m%d') as part, max(g) as as_of from c join first_in using (audit_event_id) where lateness <> 'too_late' group by 1""",
    "p5_replaced": _POSITIONS + f""", e as (
        select distinct 'audit' as feed, a.source_table, a.audit_event_id as i, 0::bigint as j, epoch_us(coalesce(a.ordering_ts, a.recorded_at)) // 86400000000 as segment,
          m.feed is null or coalesce(a.ordering_ts, a.recorded_at) > m.ordering_ts or (coalesce(a.ordering_ts, a.recorded_at) = m.ordering_ts and a.audit_event_id > m.event_id) as fresh
        from audit_log a left join marks m on m.feed = 'audit' and m.source_table = a.source_table
        union all
        select distinct 'cdc', c.source_table, {_lsn_sql('c.commit_lsn')}, c.change_index, {_lsn_sql('c.end_lsn')} // 1073741824, m.feed is null or {_lsn_sql('c.end_lsn')} > m.lsn
        from cdc_delta c left join marks m on m.feed = 'cdc' and m.source_table = c.source_table)
        select feed, source_table, segment, count(*) as n, count(*) filter (fresh) as n_new from e group by 1, 2, 3 having n_new > 0""",
    "p5_found": _POSITIONS + f"""
select distinct 'audit' as feed, a.source_table, a.audit_event_id as id_major, 0::bigint as id_minor
from audit_log a left join marks m on m.feed = 'audit' and m.source_table = a.source_table
where m.feed is null or coalesce(a.ordering_ts, a.recorded_at) > m.ordering_ts
   or (coalesce(a.ordering_ts, a.recorded_at) = m.ordering_ts and a.audit_event_id > m.event_id)
union all
select distinct 'cdc', c.source_table, {_lsn_sql('c.commit_lsn')}, c.change_index
from cdc_delta c left join marks m on m.feed = 'cdc' and m.source_table = c.source_table
where m.feed is null or {_lsn_sql('c.end_lsn')} > m.lsn""",
    "p5_marks": _POSITIONS + """select feed, source_table, coalesce(epoch_us(ordering_ts), lsn) as m0, coalesce(event_id, 0) as m1,
        case when feed = 'cdc' then upper(format('{:x}/{:x}', lsn >> 32, lsn & 4294967295)) end as lsn from marks""",
    "p5_fingerprints": f"""
select 'audit' as feed, source_table, epoch_us(coalesce(ordering_ts, recorded_at)) // 86400000000 as segment, count(distinct audit_event_id) as n from audit_log group by 1, 2, 3
union all
select 'cdc', source_table, {_lsn_sql('end_lsn')} // 1073741824, count(distinct ({_lsn_sql('commit_lsn')}, change_index)) from cdc_delta group by 1, 2, 3""",
}
ORACLE |= drift_sql.ORACLE
