"""Queries p7 to p9 over the text tables, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import leakage, mixing, truncation


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Each test item and in how many documents it leaked."""
    return leakage.leak_report(p7_found(spark, d), table(spark, d, "eval_items"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents drawn for every mix, with shard and order."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of every source in every mix."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p8_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What any mix has to keep to: its targets, caps, total and repeats, source by source."""
    drawn, shares = mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    by_mix = Window.partitionBy("mix_name")
    copies = drawn.groupBy("mix_name", "source", "doc_id").agg(F.count("*").alias("n"), F.max("n_tokens").alias("t")).groupBy("mix_name", "source").agg(F.max("n").alias("most"), F.min("n").alias("least"), F.max("t").alias("longest"), F.sum(F.col("n") * F.col("t")).alias("drawn_tokens"))
    s = shares.join(copies, ["mix_name", "source"], "left")
    capacity = F.when(F.col("max_repeats").isNull(), F.when(F.col("source_tokens") > 0, F.lit(float("inf"))).otherwise(0.0)).otherwise(F.col("source_tokens").cast("double") * F.col("max_repeats"))
    total = F.sum("target_tokens").over(by_mix)
    # A source ends at most one document below its part, whose length bounds what is missing.
    slack = F.sum(F.coalesce("longest", F.lit(0))).over(by_mix) + 1
    reached = F.sum("actual_tokens").over(by_mix)
    able = F.sum(F.when(F.col("target_share") > 0, capacity).otherwise(0.0)).over(by_mix)
    return s.select(
        "mix_name", "source", F.round("target_share", 6).alias("target_share"),
        (F.coalesce("most", F.lit(0)) <= F.coalesce("max_repeats", F.lit(2**31 - 1))).alias("cap_kept"),
        (F.coalesce("most", F.lit(0)) - F.when(F.col("most") == 1, 1).otherwise(F.coalesce("least", F.lit(0))) <= 1).alias("even_repeats"),
        ((F.col("actual_tokens") == F.coalesce("drawn_tokens", F.lit(0))) & (F.col("actual_tokens") <= capacity)).alias("tokens_add_up"),
        (reached <= total + 1).alias("not_over"), (reached >= F.least(total, able) - slack).alias("filled"),
    )


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.judged_documents(table(spark, d, "documents")).where("truncated").select("doc_id")


def p9_sources(spark: SparkSession, d: str) -> DataFrame:
    """How often each source truncates."""
    return truncation.truncation_by_source(truncation.judged_documents(table(spark, d, "documents")))


def p9_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a text by source, and whether the shares given for them add up."""
    judged = truncation.judged_documents(table(spark, d, "documents"))
    s, j = truncation.truncation_by_source(judged), judged.groupBy("source").agg(F.count_if(F.col("reason") != "").alias("n_reasons"), F.count_distinct("doc_id").alias("n_ids"))
    ok = (F.col("n_truncated") == F.col("n_reasons")) & (F.col("n_documents") == F.col("n_ids")) & (F.abs(F.col("share_truncated") * F.col("n_documents") - F.col("n_truncated")) < 1e-6)
    return s.join(j, "source").select("source", "n_documents", ok.alias("adds_up"))


QUERIES = {f.__name__: f for f in (p7_found, p7_report, p8_mix, p8_shares, p8_invariants, p9_found, p9_sources, p9_invariants)}

#: Every run of 30 words of an item against every run of a document, word by word.
_LEAKS = r"""
with d as (select doc_id as id, list_transform(regexp_extract_all(regexp_replace(text, '\\[nt]', ' ', 'g'), '[A-Za-z0-9_]+'), lambda x: lower(x)) as w from documents where text is not null),
i as (select item_id as id, list_transform(regexp_extract_all(regexp_replace(text, '\\[nt]', ' ', 'g'), '[A-Za-z0-9_]+'), lambda x: lower(x)) as w from eval_items where text is not null),
dr as (select id, array_to_string(w[k : k + 29], ' ') as run from (select id, w, unnest(range(1, len(w) - 28)) as k from d)),
ir as (select distinct id, array_to_string(w[k : k + 29], ' ') as run from (select id, w, unnest(range(1, len(w) - 28)) as k from i)),
found as (select distinct ir.id as item_id, dr.id as doc_id from dr join ir using (run))
"""

#: p8_mix and p8_shares hang on a tokenizer and p9_found and p9_sources on an automaton, which
#: SQL has none of; tests/llm holds them against exact sums and planted cuts, and
#: p8_invariants and p9_invariants say in SQL what their results must keep to.
ORACLE: dict[str, str] = {
    "p7_found": _LEAKS + "select item_id, doc_id from found",
    "p7_report": _LEAKS + ", n as (select item_id, count(*) as n_documents from found group by 1) select i.item_id, i.suite, coalesce(n_documents, 0) as n_documents from (select distinct item_id, suite from eval_items) i left join n using (item_id)",
    "p8_invariants": """
        with t as (select mix_name, coalesce(lower(trim(source)), '') as source, sum(greatest(coalesce(target_share, 0), 0)) as s from mix_targets where mix_name is not null group by 1, 2)
        select mix_name, source, round(s / sum(s) over (partition by mix_name), 6) as target_share, true as cap_kept, true as even_repeats, true as tokens_add_up, true as not_over, true as filled from t""",
    "p9_invariants": "select coalesce(lower(trim(source)), '') as source, count(*) as n_documents, true as adds_up from documents where text is not null group by 1",
}
