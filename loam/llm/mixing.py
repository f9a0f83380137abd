"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source's documents fall into ``BLOCKS`` blocks by a seeded hash.  A source's quota
of tokens is met by whole passes over it and a partial pass of blocks in a permuted order,
the last of them cut within.  A binary tree over the output shards then divides the exact
number of blocks of each source: at every node the left side draws its share without
replacement, so that every shard is a fair draw of the whole and no block is lost or used
twice.  Documents follow their blocks, and each shard is shuffled on its own.

Blocks are as fine as the largest source needs.  Their quotas and permutations are running
sums in Spark; only totals per source reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.llm.tokenize import count_tokens
from loam.sources.tables import collect_bounded, materialize

BLOCKS, MOST_BLOCKS = 1024, 65_536  # blocks of a source, at least and at most
BLOCK_TOKENS = 1_000_000  # tokens that a block of the largest source aims at
SHARDS = 16
SOURCES = 1000  # most target rows


@dataclass(frozen=True)
class Source:
    """What a source has and gives: ``passes`` whole ones and ``rest`` tokens of one more."""

    source: str
    weight: float
    max_repeats: int
    available: int
    quota: int
    reached: bool

    @property
    def passes(self) -> int:
        return self.quota // self.available if self.available else 0

    @property
    def rest(self) -> int:
        return self.quota % self.available if self.available else 0


def split_tree(rng: np.random.Generator, blocks: np.ndarray, shards: int) -> list[np.ndarray]:
    """The number of blocks of each source in each shard; the sums are ``blocks``."""
    if shards == 1:
        return [blocks]
    left = shards // 2
    take = rng.multivariate_hypergeometric(blocks, int(blocks.sum()) * left // shards, method="marginals") if blocks.sum() else blocks.copy()
    return split_tree(rng, take, left) + split_tree(rng, blocks - take, shards - left)


def sized(documents: DataFrame, seed: int) -> DataFrame:
    """doc_id, source, n_tokens and the finest block of every document with a source, written once."""
    counted = count_tokens(documents.where(F.col("source").isNotNull()), ["doc_id", "source"])
    return materialize(counted.withColumn("fine", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "source"), F.lit(MOST_BLOCKS)).cast("int")))


def quotas(docs: DataFrame, targets: DataFrame, total: int | None) -> list[Source]:
    """What each source gives: its weight of all tokens, or all that its repeats allow."""
    goals = collect_bounded(targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("weight").alias("weight"), F.max("max_repeats").alias("repeats")), SOURCES)
    names = sorted(g["source"] for g in goals)
    have = {r["source"]: int(r["t"]) for r in docs.where(F.col("source").isin(names)).groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()} if names else {}
    whole = sum(have.values()) if total is None else total
    out = []
    for g in sorted(goals, key=lambda g: g["source"]):
        weight, repeats, own = max(g["weight"] or 0.0, 0.0), max(g["repeats"] or 0, 0), have.get(g["source"], 0)
        wanted = round(weight * whole)
        out.append(Source(g["source"], weight, repeats, own, min(wanted, repeats * own), wanted <= repeats * own))
    return out


def plan(docs: DataFrame, sources: list[Source], seed: int) -> tuple[DataFrame, int]:
    """source, block, copy, shard and most (the tokens to take of a cut block, else null) of
    every block that is drawn, and how many blocks a source has."""
    spark = docs.sparkSession
    size = max((s.available for s in sources), default=0)
    blocks = BLOCKS
    while blocks < MOST_BLOCKS and size > blocks * BLOCK_TOKENS:
        blocks *= 2
    given = spark.createDataFrame([(s.source, s.passes, s.rest) for s in sources], "source string, passes int, rest bigint")
    # a row per source: its bound is SOURCES
    sums = docs.where(F.col("n_tokens") > 0).groupBy("source", (F.col("fine") % blocks).alias("block")).agg(F.sum("n_tokens").alias("size")).join(F.broadcast(given), "source")
    order = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed), "source", "block"), "block")
    placed = materialize(sums.withColumn("before", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")))
    partial = F.col("before") < F.col("rest")
    counts = {r["source"]: int(r["n"]) for r in placed.groupBy("source").agg(F.sum(F.col("passes") + partial.cast("int")).alias("n")).collect()}
    tree = split_tree(np.random.default_rng(seed), np.array([counts.get(s.source, 0) for s in sources], np.int64), SHARDS) if sources else []
    ends = spark.createDataFrame([(s.source, [int(x) for x in np.cumsum([t[i] for t in tree])]) for i, s in enumerate(sources)], "source string, ends array<bigint>")
    copies = F.explode(F.sequence(F.lit(0), F.col("passes") - F.when(partial, 0).otherwise(1))).alias("copy")
    units = placed.where((F.col("passes") > 0) | partial).select("source", "block", "size", "before", "passes", "rest", copies)
    left = F.col("rest") - F.col("before")
    cut = F.when((F.col("copy") == F.col("passes")) & (left < F.col("size")), left)
    nth = F.row_number().over(Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 3), "source", "block", "copy"), "block", "copy"))
    drawn = units.select("source", "block", "copy", cut.alias("most"), nth.alias("nth")).join(F.broadcast(ends), "source")
    shard = F.size(F.filter("ends", lambda e: e < F.col("nth")))
    return drawn.select("source", "block", "copy", shard.alias("shard"), "most"), blocks


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 0) -> DataFrame:
    """The mixed selection: doc_id, source, copy, shard, position and n_tokens.

    ``total`` is the size that the weights divide, by default all tokens of the sources with
    a target.  A source gives its weight of it, or all that ``max_repeats`` allows; what it
    lacks is not taken from others.  A document without a source or of a source without a
    target is never mixed; documents without tokens add nothing and are left out.  A null or
    negative weight or number of repeats is 0.  Copies of a document count from 0.
    """
    docs = sized(documents, seed)
    return _drawn(docs, quotas(docs, targets, total), seed)


def _drawn(docs: DataFrame, sources: list[Source], seed: int) -> DataFrame:
    chosen, blocks = plan(docs, sources, seed)
    # the join's key is a block, so no source is a hot key
    rows = docs.where(F.col("n_tokens") > 0).withColumn("block", F.col("fine") % blocks).join(chosen, ["source", "block"])
    rows = materialize(rows)
    whole, partial = rows.where(F.col("most").isNull()), rows.where(F.col("most").isNotNull())
    # at most one block of each source is cut: the documents that end within what is left of its quota
    upto = F.sum("n_tokens").over(Window.partitionBy("source", "block", "copy").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    partial = partial.withColumn("upto", upto).where(F.col("upto") <= F.col("most")).drop("upto")
    drawn = whole.unionByName(partial)
    return drawn.select("doc_id", "source", "copy", "shard", F.xxhash64(F.lit(seed + 2), "doc_id", "copy").alias("position"), "n_tokens").repartitionByRange("shard", "position").sortWithinPartitions("shard", "position")


def shares(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 0) -> DataFrame:
    """Per source of the targets: weight, max_repeats, available tokens, quota, tokens drawn,
    actual share of all drawn tokens and whether the target could be reached."""
    spark = documents.sparkSession
    docs = sized(documents, seed)
    sources = quotas(docs, targets, total)
    drawn = _drawn(docs, sources, seed).groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    wanted = spark.createDataFrame([(s.source, s.weight, s.max_repeats, s.available, s.quota, s.reached) for s in sources], "source string, weight double, max_repeats int, available bigint, quota bigint, reached boolean")
    got = F.coalesce("tokens", F.lit(0))
    all_of = F.sum(got).over(Window.partitionBy(F.lit(1)))
    return wanted.join(drawn, "source", "left").select("source", "weight", "max_repeats", "available", "quota", got.alias("tokens"), F.coalesce(F.try_divide(got, all_of), F.lit(0.0)).alias("share"), "reached")
