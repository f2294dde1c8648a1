"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Each source's target is its share of all words by weight, at most ``max_epochs`` times its own
   words; what a capped source can't take is reshared by weight. The common rate is found by
   repeated aggregation over the table of sources.
2. Each source gives whole epochs of its documents, and of one more epoch the documents that come
   first in a seeded permutation; the last of these is trimmed to the word that fills the target.
3. The drawn copies of a source, permuted, form blocks of ``block_docs`` copies. A binary tree over
   the output shards splits the vector of block quotas: each node draws its left half's quotas from
   the multivariate hypergeometric distribution, seeded by the node's path, so every shard finds
   its quotas and the start of its blocks by descending from the root, without its siblings.
4. Shards take disjoint runs of permuted blocks and order their copies by a local hash.

Nulls: a null text has no words; null sources are one source, the last; a null doc_id is a value
like others. A document without words takes 0 words and has no copy. Repeated rows are documents
of their own. An empty table gives an empty mix. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinloom.plans.scratch import Scratch, free_name, small

WORD = r"[^\x20\x09-\x0D]+"
#: Leaves of the tree that one task finds.
LEAVES = 256


def source_targets(sources: DataFrame, weights: Sequence[float], max_epochs: int, s: Scratch) -> DataFrame:
    """Adds weight and target to (source, size): ``weights`` repeat over the sources by code point,
    null last. The rank is a sum of counts over ranges, so no task sees all sources."""
    ranged = s.table(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    before = ranged.groupBy("part").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) + F.col("before") - 1
    listed = F.array(*[F.lit(float(w)) for w in weights])
    out = ranged.join(F.broadcast(before.select("part", "before")), "part")
    out = out.withColumn("weight", F.get(listed, (rank % len(weights)).cast("int")))
    out = s.table(out.select("source", "size", "weight", (F.col("size") * float(max_epochs)).alias("cap")), "sources")
    # water level: a source is full if weight * rate > cap; the rest share what full ones leave
    rate = 0.0
    while True:
        full = F.col("weight") * rate >= F.col("cap")
        got = out.agg(F.sum("size"), F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not got[0] or not got[2]:
            break
        new = (got[0] - got[1]) / got[2]
        if new <= rate * (1 + 1e-12):
            break
        rate = new
    return out.withColumn("target", F.least("cap", F.col("weight") * rate)).drop("cap")


def _halves(total: int, low: int, middle: int, high: int) -> int:
    """Blocks of a node's left half."""
    return total * (middle - low) // (high - low)


def _split(quota: np.ndarray, take: int, rng: np.random.Generator, numpy_limit: int) -> np.ndarray:
    """The multivariate draw of ``take`` blocks from ``quota``, one pool after another."""
    left, bad = np.zeros_like(quota), int(quota.sum())
    for i in np.flatnonzero(quota):
        bad -= int(quota[i])
        left[i] = _hypergeometric(rng, int(quota[i]), bad, take, numpy_limit)
        take -= int(left[i])
    return left


def _leaves(shards: int, wanted: tuple[int, int], totals: np.ndarray, group: int, quota: np.ndarray, seed: int, numpy_limit: int = 1_000_000_000) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, quotas, first blocks) of the pools of one group, for the shards of a range.

    Each node first splits the ``totals`` of all groups between its halves, then the group's share among its pools
    (``quota``). Draws are seeded by the node's path, so only paths to wanted shards are walked."""
    stack = [(0, shards, 1, totals, quota, np.zeros_like(quota))]
    while stack:
        low, high, node, totals, quota, start = stack.pop()
        if high - low == 1:
            yield low, quota, start
            continue
        middle = (low + high) // 2
        left = _split(totals, _halves(int(totals.sum()), low, middle, high), np.random.default_rng([seed, node]), numpy_limit)
        part = _split(quota, int(left[group]), np.random.default_rng([seed, node, group]), numpy_limit) if len(totals) > 1 or len(quota) > 1 else left
        if middle < wanted[1] and high > wanted[0]:
            stack.append((middle, high, 2 * node + 1, totals - left, quota - part, start + part))
        if low < wanted[1] and middle > wanted[0]:
            stack.append((low, middle, 2 * node, left, part, start))


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int, numpy_limit: int) -> int:
    """How many of ``n`` blocks drawn are good. Beyond ``numpy_limit``, which is numpy's own, the distribution
    function is inverted: probabilities follow from the mode by their exact ratios, and what lies 14 standard deviations
    away is below the resolution of a uniform number."""
    if not n or not good:
        return 0
    if not bad:
        return n
    if good + bad < numpy_limit:
        return int(rng.hypergeometric(good, bad, n))
    total = good + bad
    least, most = max(0, n - bad), min(good, n)
    mode = min(max((n + 1) * (good + 1) // (total + 2), least), most)
    wide = int(14 * (n * (good / total) * (bad / total) * ((total - n) / (total - 1))) ** 0.5) + 20
    x = np.arange(max(least, mode - wide), min(most, mode + wide) + 1, dtype=np.float64)
    step = np.log(good - x[:-1]) + np.log(n - x[:-1]) - np.log(x[1:]) - np.log(bad - n + x[1:])
    log = np.concatenate([[0.0], np.cumsum(step)])
    mass = np.exp(log - log.max())
    return int(x[min(int(np.searchsorted(np.cumsum(mass), rng.random() * mass.sum(), side="right")), len(x) - 1)])


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_epochs: int = 3, shard_words: int = 1_000_000, block_docs: int = 32, seed: int = 17, group_pools: int = 4096, scratch: Scratch | None = None) -> DataFrame:
    """One row per drawn copy, and one with null epoch for a document that has none:
    (uid, doc_id, source, size, source_size, target, epoch, words, shard, position).

    ``words`` are the copy's first words (its size but for the trimmed one); ``position`` orders
    the copies of a shard. ``uid`` tells rows of a run apart. Each source is a pool with quotas of
    its own, however many there are: pools are dealt into groups of about ``group_pools``, a node of
    the tree splits its groups' totals, and then each group's share among its pools. The driver holds the groups' totals.
    """
    s = scratch or Scratch(docs.sparkSession)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    d = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.col("source").cast("string").alias("source"), size.alias("size"))
    d = s.table(d.withColumn("key", key).withColumn("order", F.xxhash64(F.lit(seed), "doc_id", "key")), "sizes")
    sources = d.groupBy("source").agg(F.sum("size").alias("size"))
    targets = source_targets(sources, weights, max_epochs, s).withColumnRenamed("size", "source_size")
    whole = F.least(F.lit(max_epochs), F.floor(F.col("target") / F.greatest("source_size", F.lit(1)) + 1e-9)).cast("int")
    targets = targets.withColumn("whole", whole).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    targets = s.table(targets.withColumn("key", key), "targets")
    d = d.join(small(targets.drop("source")), "key")

    # The partial epoch: hash ranges that lie before the target are taken whole, the range that
    # meets it is cut by a running sum. A range has about 4,096 documents, however large a source.
    n = d.count()
    ranges = 1 << max(0, (max(1, n) // 4096).bit_length())
    d = d.withColumn("range", F.shiftrightunsigned("order", 64 - ranges.bit_length() + 1) if ranges > 1 else F.lit(0).cast("long"))
    w = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    by_range = d.groupBy("key", "range").agg(F.sum("size").alias("here")).withColumn("ahead", F.coalesce(F.sum("here").over(w), F.lit(0)))
    by_range = s.table(by_range.select("key", "range", "ahead"), "ranges")
    within = Window.partitionBy("key", "range").orderBy("order", "doc_id", "uid").rowsBetween(Window.unboundedPreceding, -1)
    d = d.join(small(by_range), ["key", "range"]).withColumn("ahead", F.col("ahead") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    part = F.greatest(F.lit(0), F.least("size", F.round("rest").cast("long") - F.col("ahead")))
    d = d.withColumn("part", part)
    copies = F.when(F.col("size") > 0, F.concat(F.array_repeat("size", F.col("whole")), F.when(F.col("part") > 0, F.array("part")).otherwise(F.array().cast("array<long>"))))
    d = d.select("uid", "doc_id", "source", "key", "size", "source_size", "target", F.posexplode_outer(copies).alias("epoch", "words"))
    pool = F.when(F.col("epoch").isNotNull(), F.col("key"))
    d = s.table(d.withColumn("pool", pool).withColumn("order", F.xxhash64(F.lit(seed + 1), "doc_id", "key", "epoch")).drop("key"), "copies")

    per_source = d.where("pool is not null").groupBy("pool").agg(F.count(F.lit(1)).alias("copies"))
    per_source = s.table(per_source.withColumn("quota", F.ceil(F.col("copies") / block_docs)), "pools")
    total_words, n_pools = d.agg(F.sum("words")).first()[0] or 0, per_source.count()
    groups = max(1, -(-n_pools // group_pools))
    per_source = per_source.withColumn("group", F.pmod(F.xxhash64("pool"), F.lit(groups)))
    totals = np.zeros(groups, np.int64)
    for g, q in per_source.groupBy("group").agg(F.sum("quota")).collect():
        totals[g] = q
    shards = max(1, -(-total_words // shard_words))

    # rank of a copy in its pool, by ranges again
    w = Window.partitionBy("pool").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    drawn = d.where("pool is not null")
    drawn = drawn.withColumn("range", F.shiftrightunsigned("order", 64 - ranges.bit_length() + 1) if ranges > 1 else F.lit(0).cast("long"))
    by_range = drawn.groupBy("pool", "range").count().withColumn("ahead", F.coalesce(F.sum("count").over(w), F.lit(0)))
    by_range = s.table(by_range.select("pool", "range", "ahead"), "ranges")
    within = Window.partitionBy("pool", "range").orderBy("order", "doc_id", "uid")
    rank = F.col("ahead") + F.row_number().over(within) - 1
    drawn = drawn.join(small(by_range), ["pool", "range"]).withColumn("block", F.floor(rank / block_docs))

    # a group's pools meet once for every LEAVES shards
    def leaves(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        group, batch = map(int, key)
        frame, out = frame.sort_values("pool"), []
        for shard, got, start in _leaves(shards, (batch * LEAVES, (batch + 1) * LEAVES), totals, group, frame["quota"].to_numpy(np.int64), seed):
            on = np.flatnonzero(got)
            out.append(pd.DataFrame({"pool": frame["pool"].to_numpy()[on], "shard": shard, "start": start[on], "blocks": got[on]}))
        return pd.concat(out)

    batches = F.sequence(F.lit(0), F.lit(-(-shards // LEAVES) - 1))
    plan = per_source.select("pool", "quota", "group", F.explode(batches).alias("batch")).groupBy("group", "batch").applyInPandas(leaves, "pool string, shard long, start long, blocks long")
    blocks = s.table(plan.select("pool", "shard", F.explode(F.sequence("start", F.col("start") + F.col("blocks") - 1)).alias("block")), "blocks")
    drawn = drawn.join(small(blocks), ["pool", "block"]).withColumn("position", F.xxhash64(F.lit(seed + 2), "shard", "order"))
    cols = ["uid", "doc_id", "source", "size", "source_size", "target", "epoch", "words", "shard", "position"]
    none = d.where("pool is null").withColumn("shard", F.lit(None).cast("long")).withColumn("position", F.lit(None).cast("long"))
    return drawn.select(cols).unionByName(none.select(cols))


def mixed_rows(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """The mix itself: a row of ``docs`` per drawn copy, the trimmed copies' texts cut to the words that the
    mix takes, and two more columns at the end, shard and position. ``docs`` must be the frame, a file scan or
    materialised table, that ``mix`` was given. Its columns keep their names and values, but for a trimmed copy's text and
    n_chars; where it has a shard or position of its own, the new one gets underscores before its name."""
    uid, cut_to = free_name(docs, "uid"), free_name(docs, "words")
    shard, position = (c if c not in docs.columns else free_name(docs, c) for c in ("shard", "position"))
    drawn = copies.where("epoch is not null").select(F.col("uid").alias(uid), F.when(F.col("words") < F.col("size"), F.col("words")).alias(cut_to), F.col("shard").alias(shard), F.col("position").alias(position))
    rows = docs.withColumn(uid, F.monotonically_increasing_id()).join(drawn, uid)
    # the end of the last word taken: that many words, each with the blanks before it
    found = F.lit(rf"[\x20\x09-\x0D]*{WORD}")
    cut = F.array_join(F.slice(F.regexp_extract_all("text", found, F.lit(0)), F.lit(1), F.col(cut_to).cast("int")), "")
    rows = rows.withColumn("text", F.when(F.col(cut_to).isNull(), F.col("text")).otherwise(cut))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col(cut_to).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return rows.select(*[f"`{c}`" for c in docs.columns], shard, position)


def in_shards(rows: DataFrame) -> DataFrame:
    """Each shard in one partition, its copies in their shuffled order, by the last two columns of ``mixed_rows``."""
    shard, position = rows.columns[-2:]
    return rows.repartition(shard).sortWithinPartitions(shard, position)


def op1(docs: DataFrame) -> DataFrame:
    """The query's digest: words taken from each document, all copies together, and the shards that hold them."""
    copies = mix(docs)
    by = ["uid", "doc_id", "size", "source_size", "target"]
    return copies.groupBy(*by).agg(F.coalesce(F.sum("words"), F.lit(0)).alias("taken"), F.array_sort(F.collect_list("shard")).alias("shards")).drop("uid")
