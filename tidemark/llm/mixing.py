"""Mixing sources to target shares of the total number of tokens.

1. Every document gets its number of tokens and, by a seeded hash, a place in a random
   permutation of its source; the permutation is cut into BLOCKS equal ranges.
2. From the blocks' sizes each source's quota is laid out: whole passes over the source
   and, of one further pass, as many blocks as it takes; the block in which it ends is cut
   again into BLOCKS ranges, and of one of those as many documents as it takes.
3. A splitting tree hands the quotas to the output shards: at each node the blocks of
   the left half are drawn from the multivariate hypergeometric distribution, so the
   shards are disjoint random samples of exactly the quotas' blocks.
4. Documents find their block's shard and are shuffled within it by a seeded hash.

Passes stay numbers until a document is repeated: what is planned is one row for each mix
and source, by tasks of one mix each, and the driver lays out nothing.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.tokens import TOKENIZERS, VOCABULARY, with_token_counts
from tidemark.session import broadcast_if_small, kept, shared_dir

#: Ranges of a source's permutation, and of the one range in which a quota ends.
BLOCKS = 1024
#: Blocks up to which the hypergeometric draw is made; of more, even parts are dealt first.
DRAWN_BLOCKS = 500_000_000


def source_name(c: Column) -> Column:
    """Sources are spelled in several ways; blanks and letter case don't count."""
    return F.lower(F.trim(c))


def fill_to_shares(total: float, shares: dict[str, float], capacity: dict[str, float]) -> dict[str, float]:
    """Tokens for each source: the shares of ``total`` within the capacities.

    What a source can't give is spread over the others by their shares, until the total
    is reached or every source is used up.  Shares may be in any unit; sources with a
    share of nothing, or less, get nothing.
    """
    got = {s: 0.0 for s in shares}
    open_ = {s for s, x in shares.items() if x > 0 and capacity.get(s, 0) > 0}
    left = float(total)
    while open_ and left > 1e-9:
        unit = left / sum(shares[s] for s in open_)
        full = {s for s in open_ if got[s] + shares[s] * unit >= capacity[s]}
        for s in full or open_:
            more = min(shares[s] * unit, capacity[s] - got[s])
            got[s] += more
            left -= more
        open_ -= full
        if not full:
            break
    return got


def splitting_tree(counts: dict[str, int], shards: int, rng: np.random.Generator) -> list[dict[str, int]]:
    """How many blocks of each source go to each shard; the sums are exactly ``counts``."""
    names = sorted(counts)
    out: list[dict[str, int]] = []

    def split(have: np.ndarray, n: int) -> None:
        if n == 1:
            out.append(dict(zip(names, map(int, have))))
            return
        left = n // 2
        even = have // n * left if have.sum() > DRAWN_BLOCKS else np.zeros_like(have)
        rest = have % n if have.sum() > DRAWN_BLOCKS else have
        size = int(rest.sum())
        take = size * left // n + (rng.random() < (size * left % n) / n)
        drawn = even + (rng.multivariate_hypergeometric(rest, take, method="marginals") if size else rest)
        split(drawn, left)
        split(have - drawn, n - left)

    split(np.array([counts[s] for s in names], np.int64), max(1, shards))
    return out


def measured_documents(documents: DataFrame, seed: int, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, source, n_tokens, place, block, part``, written once to the shared folder.

    ``block`` is the range of the permutation, ``part`` the range within the block.
    Documents without text, tokens or source can't be measured or mixed and are left out.
    """
    spark = documents.sparkSession
    counted = with_token_counts(documents.select("doc_id", source_name(F.col("source")).alias("source"), "text").where("text is not null and source is not null and doc_id is not null"), "text", ["doc_id", "source"], folder, vocabulary)
    path = shared_dir(spark, "mix")
    counted.where("n_tokens > 0").withColumn("place", F.xxhash64(F.lit(seed), "source", "doc_id")).write.parquet(path)
    # The place as an unsigned number: its first bits are the block, the next ones the part.
    bits = BLOCKS.bit_length() - 1
    range_of = lambda skip: F.shiftrightunsigned("place", 64 - skip - bits).bitwiseAND(F.lit(BLOCKS - 1)).cast("int")
    return spark.read.parquet(path).withColumns({"block": range_of(0), "part": range_of(bits)})


QUOTAS = "mix_name string, source string, target_share double, target_tokens double, max_repeats int, source_tokens long, passes long, rest double"


def _quotas_of(pdf: pd.DataFrame) -> pd.DataFrame:
    """One mix: tokens wanted of each source, as whole passes and what remains."""
    shares = {r.source: r.share for r in pdf.itertuples(index=False)}
    size = {r.source: int(r.source_tokens) for r in pdf.itertuples(index=False)}
    cap = {r.source: math.inf if pd.isna(r.cap) else max(0, int(r.cap)) for r in pdf.itertuples(index=False)}
    total, whole = float(pdf["total"].max()) if len(pdf) else 0.0, sum(shares.values())
    got = fill_to_shares(total, shares, {s: size[s] * cap[s] if size[s] else 0 for s in shares})
    out = []
    for s, want in got.items():
        passes = int(want // size[s]) if size[s] else 0
        rest = want - passes * size[s]
        share = shares[s] / whole if whole else 0.0
        # Rounding mustn't begin one pass too many.
        out.append((pdf["mix_name"].iloc[0], s, share, total * share, None if math.isinf(cap[s]) else int(cap[s]), size[s], passes, 0.0 if cap[s] <= passes else rest))
    return pd.DataFrame(out, columns=[c.split()[0] for c in QUOTAS.split(", ")])


def quotas(targets: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row per mix and source.  A source named twice has both shares and the smaller cap.

    Rows without a mix are left out; a null source is one without a name; a null or
    negative share is nothing, a null cap none; the greatest total of a mix counts.
    """
    t = targets.where("mix_name is not null").select("mix_name", F.coalesce(source_name(F.col("source")), F.lit("")).alias("source"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("share"), "max_repeats", F.coalesce("total_tokens", F.lit(0)).alias("total"))
    once = t.groupBy("mix_name", "source").agg(F.sum("share").alias("share"), F.min("max_repeats").alias("cap"), F.max("total").alias("total"))
    known = once.join(broadcast_if_small(sizes), "source", "left").fillna(0, ["source_tokens"])
    return known.groupBy("mix_name").applyInPandas(_quotas_of, QUOTAS)


def cut_off(sizes: DataFrame, by: list[str], of: str, limit: str) -> DataFrame:
    """Where a running sum passes its limit: ``by``, ``cut`` (null if nowhere), ``before``, ``left``.

    ``sizes`` holds at most BLOCKS rows for each ``by``: the range, its tokens ``n`` and the
    limit.  ``before`` is how many ranges fit whole, ``left`` what remains of the limit.
    """
    done = F.sum("n").over(Window.partitionBy(*by).orderBy(of).rowsBetween(Window.unboundedPreceding, 0))
    fits = F.col("__done") <= F.col(limit)
    summed = sizes.withColumn("__done", done)
    return summed.groupBy(*by).agg(F.min(F.when(~fits, F.col(of))).alias("cut"), F.count_if(fits).cast("long").alias("before"), (F.max(limit) - F.coalesce(F.max(F.when(fits, F.col("__done"))), F.lit(0))).alias("left"))


def _dealt(seed: int, shards: int):
    """A mix's blocks handed to shards: where each shard's units end, and how units are permuted."""

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf["mix_name"].iloc[0]
        rng = np.random.default_rng([seed, zlib.crc32(name.encode())])
        units = {r.source: int(r.units) for r in pdf.itertuples(index=False)}
        leaves = splitting_tree(units, shards, rng)
        out = []
        for s, n in sorted(units.items()):
            ends = np.cumsum([leaf[s] for leaf in leaves]).tolist()
            step, shift = int(rng.integers(1, min(max(n, 2), 1 << 20))), int(rng.integers(0, max(n, 1)))
            while math.gcd(step, max(n, 1)) != 1:
                step += 1
            out.append((name, s, step, shift, ends))
        return pd.DataFrame(out, columns=["mix_name", "source", "step", "shift", "ends"])

    return deal


def mix(documents: DataFrame, targets: DataFrame, shards: int = 16, seed: int = 42, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(drawn documents, shares reached) for every mix in ``targets``.

    Drawn: ``mix_name, shard, order_key, source, doc_id, repeat, n_tokens``; within a
    shard, ``order_key`` is the shuffled order.  A document is in a mix at most
    ``max_repeats`` times (no cap if null; the smallest if a source is named twice), and
    every repeat of a source is begun only after the one before has been used up.  The
    last block is filled document by document without going over the quota, so a source
    ends at most one document below its target.  Shares: one row per mix and source with
    the target and actual tokens and shares; sources without documents reach 0.
    """
    docs = measured_documents(documents, seed, folder, vocabulary)
    blocks = kept(docs.groupBy("source", "block").agg(F.sum("n_tokens").alias("n")))
    sizes = blocks.groupBy("source").agg(F.sum("n").alias("source_tokens"), F.count("*").alias("n_blocks"))
    goal = kept(quotas(targets, sizes.drop("n_blocks")))
    own = ["mix_name", "source"]

    # The last pass: whole blocks, and the block (or the whole source) in which it ends.
    begun = goal.where("passes > 0 or rest > 0").join(sizes.select("source", "n_blocks"), "source")
    ends = cut_off(goal.where("rest > 0").select(*own, "rest").join(blocks, "source"), own, "block", "rest")
    planned = begun.join(ends, own, "left").select(*own, "passes", "n_blocks", "cut", F.coalesce("before", F.lit(0)).alias("before"), "left")
    planned = planned.withColumn("units", F.col("passes") * F.col("n_blocks") + F.col("before") + F.col("cut").isNotNull().cast("long"))
    dealt = planned.groupBy("mix_name").applyInPandas(_dealt(seed, shards), "mix_name string, source string, step long, shift long, ends array<long>")
    plan = broadcast_if_small(kept(planned.join(dealt, own)))
    ranked = blocks.select("source", "block", (F.row_number().over(Window.partitionBy("source").orderBy("block")) - 1).cast("long").alias("rank"))
    placed = docs.join(broadcast_if_small(ranked), ["source", "block"]).join(plan, "source")

    # Only the one part, of the one block, in which a quota ends needs a running sum.
    last = placed.where("block = cut")
    parts = cut_off(last.groupBy(*own, "part").agg(F.sum("n_tokens").alias("n"), F.max("left").alias("limit")), own, "part", "limit")
    parts = broadcast_if_small(kept(parts.select(*own, F.col("cut").alias("cut_part"), F.col("left").alias("left_part"))))
    ending = last.join(parts, own).where("cut_part is null or part <= cut_part")
    running = F.sum("n_tokens").over(Window.partitionBy(*own).orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    within = ending.where("part = cut_part").withColumn("__sum", running).where("__sum <= left_part").drop("__sum")
    once_more = ending.where("cut_part is null or part < cut_part").unionByName(within).select(*placed.columns, F.col("passes").alias("repeat"))

    times = F.col("passes") + (F.col("rank") < F.col("before")).cast("long")
    drawn = placed.where(times > 0).withColumn("repeat", F.explode(F.sequence(F.lit(0).cast("long"), times - 1))).unionByName(once_more)
    unit = F.col("repeat") * F.col("n_blocks") + F.col("rank")
    turn = F.pmod(unit * F.col("step") + F.col("shift"), F.col("units"))
    shard = F.size(F.filter("ends", lambda e: e <= F.col("__turn")))
    drawn = drawn.withColumn("__turn", turn).withColumn("shard", shard)
    drawn = drawn.select("mix_name", "shard", F.xxhash64(F.lit(seed), "mix_name", "shard", "doc_id", "repeat").alias("order_key"), "source", "doc_id", F.col("repeat").cast("int").alias("repeat"), "n_tokens")

    reached = drawn.groupBy(*own).agg(F.sum("n_tokens").alias("actual_tokens"), F.count("*").alias("n_documents"), (F.max("repeat") + 1).alias("most_repeats"))
    all_of = F.sum("actual_tokens").over(Window.partitionBy("mix_name"))
    shares = goal.drop("passes", "rest").join(reached, own, "left").fillna(0, ["actual_tokens", "n_documents", "most_repeats"]).withColumn("actual_share", F.when(all_of > 0, F.col("actual_tokens") / all_of).otherwise(0.0))
    return drawn, shares


def write_mix(drawn: DataFrame, path: str) -> None:
    """Shards of a mix in their shuffled order."""
    drawn.repartition("mix_name", "shard").sortWithinPartitions("mix_name", "shard", "order_key").write.partitionBy("mix_name", "shard").parquet(path)
