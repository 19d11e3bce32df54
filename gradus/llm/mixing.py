"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree over source blocks.

The words of a source are cut into blocks by a hash of the rows. A target of r
times the source's words draws every block floor(r) times and then, in hash
order, as many more as the rest takes; the last block is cut inside, found by
descending on sums of ever smaller pieces, so no source is ordered as a whole.
Every source thus has an exact quota of block draws. The tree deals the quotas
to the output shards: a node splits its quota vector by a multivariate
hypergeometric draw. A shard takes its part of each source's permuted draws,
so draws of different shards are disjoint, and shuffles its rows locally.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradus.bounds import collect_small
from gradus.session import checkpointed

#: sources that a mix may have; their sums and targets are held on the driver
MAX_SOURCES = 100_000
#: blocks of a source, and pieces of the block that is cut: bits of the row hash
BLOCK_BITS = 10
SHARD_WORDS = 50_000_000
#: blocks of all sources up to which their draws are broadcast
BROADCAST_BLOCKS = 200_000
#: tree nodes from which on subtrees are split in tasks
DRIVER_NODES = 64


def targets(sizes: Sequence[float], weights: Sequence[float], share: float, cap: float) -> list[float]:
    """Shares of ``share`` times all sizes by weight, none above ``cap`` times its size; the excess is reshared by weight."""
    out, open_ = [0.0] * len(sizes), [i for i in range(len(sizes)) if sizes[i] > 0]
    left = share * sum(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > cap * sizes[i]]
        if not full:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = cap * sizes[i]
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def split_node(quota: np.ndarray, low: int, high: int, seed: int, stop: int = 1) -> list[tuple[int, int, np.ndarray]]:
    """(first shard, shard after the last, quotas) of the nodes below [low, high) that have at most ``stop`` shards."""
    if high - low <= stop:
        return [(low, high, quota)]
    middle, total = (low + high) // 2, int(quota.sum())
    draws = total * (middle - low) // (high - low)
    rng = np.random.Generator(np.random.Philox(key=[seed, (low << 32) | high]))
    left = rng.multivariate_hypergeometric(quota, draws, method="marginals") if total else quota
    return split_node(left, low, middle, seed, stop) + split_node(quota - left, middle, high, seed, stop)


@dataclass(frozen=True)
class Mix:
    """``rows``: a row per document with its draws; ``shards``: number of output shards."""

    rows: DataFrame
    shards: int

    def mixture(self) -> DataFrame:
        """A row per taken copy: all columns of the documents, shard and the place-giving shuffle key."""
        taken = self.rows.select("*", F.explode("draws").alias("__d"))
        key = F.xxhash64("__u", "__d.turn", "__d.shard")
        return taken.select("*", F.col("__d.shard").alias("shard"), key.alias("shuffle_key")).drop("__d", "draws")

    def shuffled(self) -> DataFrame:
        """The mixture, each shard whole in one partition and shuffled there."""
        return self.mixture().repartition(self.shards, "shard").sortWithinPartitions("shard", "shuffle_key")


def _piece(u: str, level: int):
    """The bits of the hash that number a row's block (level 0) or its piece of the block (level 1)."""
    return F.shiftrightunsigned(F.col(u), 64 - BLOCK_BITS * (level + 1)).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, shard_words: int = SHARD_WORDS, seed: int = 17,
    keep: bool = False,
) -> Mix:
    """Draws documents so that each source's words come near its target.

    Sources by code point, null last, take the weights in turn, share ``share``
    times all words, and stop at ``cap`` times their own (at most 2 copies a
    document for a cap of 2). A word is a run of other characters than
    ``[\\x20\\x09-\\x0D]``; a null text has none. Rows: doc_id, size,
    source_size, target, taken (words of all copies), draws, and with
    ``keep`` the whole document as ``kept``. The choice depends on (id, source, size) and the seed alone:
    reruns agree, repeated rows are all taken or left, null ids are an id like
    others. Texts without words are drawn with their block. Empty tables give
    empty results.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("__source"), size.alias("size"), *([F.struct("*").alias("kept")] if keep else []))
    sized = sized.withColumn("__u", F.xxhash64(F.lit(seed), "doc_id", "__source", "size"))
    narrow = sized.select("doc_id", "__source", "size", "__u")
    if not keep:
        sized = narrow = checkpointed(narrow)
    else:
        narrow = checkpointed(narrow)
    sums = collect_small(narrow.groupBy("__source").agg(F.sum("size").alias("n")), MAX_SOURCES)
    sums.sort(key=lambda r: (r["__source"] is None, r["__source"] or ""))
    totals = [int(r["n"]) for r in sums]
    goal = targets(totals, [weights[i % len(weights)] for i in range(len(sums))], share, cap)
    passes = [int(g // n) if n else 0 for g, n in zip(goal, totals)]
    table = [(r["__source"], i, n, g, p, g - p * n) for i, (r, n, g, p) in enumerate(zip(sums, totals, goal, passes))]
    known = F.broadcast(spark.createDataFrame(table, "__source string, __i int, source_size long, target double, __full int, __rest double"))
    placed = narrow.join(known, narrow["__source"].eqNullSafe(known["__source"]), "inner").drop(known["__source"])
    cut = _cuts(placed)
    # draws of each block: whole turns and, up to the source's cut, one more
    blocks = placed.select("__i", "__full", _piece("__u", 0).alias("__block")).distinct()
    marks = F.broadcast(spark.createDataFrame([(i, c) for i, c in cut.items()], "__i int, __cut long"))
    cut_block = F.when(F.col("__cut").isNotNull(), F.shiftrightunsigned("__cut", 64 - BLOCK_BITS).cast("int"))
    turns = F.when(F.col("__full") > 0, F.sequence(F.lit(1), F.col("__full"))).otherwise(F.array().cast("array<int>"))
    extra = F.when(F.col("__block") <= cut_block, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    drawn = blocks.join(marks, "__i", "left").select("__i", "__block", F.explode(F.concat(turns, extra)).alias("turn"))
    order = Window.partitionBy("__i").orderBy(F.xxhash64(F.lit(seed + 1), "__i", "__block", "turn"), "__block", "turn")
    drawn = checkpointed(drawn.withColumn("place", F.row_number().over(order) - 1))  # at most 3 * 2^BLOCK_BITS rows a source
    quotas = np.zeros(len(table), np.int64)
    for r in collect_small(drawn.groupBy("__i").count(), MAX_SOURCES):
        quotas[r["__i"]] = r["count"]
    shards = max(1, min(int(quotas.sum()), -(-int(sum(goal)) // shard_words)))
    dealt = drawn.join(_deal(spark, quotas, shards, seed), "__i").filter("place >= low and place < high")
    by_block = dealt.groupBy("__i", "__block").agg(F.collect_list(F.struct("turn", "shard")).alias("__draws"))
    source_known = sized.join(known, sized["__source"].eqNullSafe(known["__source"]), "inner").drop(known["__source"])
    source_known = source_known.join(marks, "__i", "left").withColumn("__block", _piece("__u", 0))
    few = len(table) << BLOCK_BITS <= BROADCAST_BLOCKS  # then the documents aren't shuffled
    rows = source_known.join(F.broadcast(by_block) if few else by_block, ["__i", "__block"], "left")
    inside = F.coalesce(_below("__u", "__cut"), F.lit(False))
    draws = F.filter(F.coalesce("__draws", F.array().cast("array<struct<turn:int,shard:int>>")), lambda d: (d["turn"] > 0) | inside)
    rows = rows.withColumn("draws", draws).select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), "draws", "__u", *(["kept"] if keep else []))
    return Mix(rows, shards)


def _below(u: str, cut: str):
    """u <= cut as unsigned numbers."""
    flip = F.lit(-(1 << 63)).cast("long")
    return F.col(u).bitwiseXOR(flip) <= F.col(cut).bitwiseXOR(flip)


def _cuts(placed: DataFrame) -> dict[int, int]:
    """For each source with a rest, the last hash that the partial turn takes; its words come nearest to the rest."""
    spark, open_ = placed.sparkSession, placed.filter("__rest > 0").select("__i", "size", "__u", "__rest")
    for level in (0, 1):
        sums = open_.groupBy("__i", "__rest", _piece("__u", level).alias("p")).agg(F.sum("size").alias("n"))
        before = Window.partitionBy("__i").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # at most 2^BLOCK_BITS rows
        sums = sums.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        ends = sums.filter("before < __rest").groupBy("__i").agg(F.max_by(F.struct("p", "before", "__rest"), "p").alias("e"))
        found = [(r["__i"], r["e"]["p"], float(r["e"]["__rest"] - r["e"]["before"])) for r in collect_small(ends, MAX_SOURCES)]
        ends = F.broadcast(spark.createDataFrame(found, "__i int, __p int, __left double"))
        open_ = open_.join(ends, "__i").filter(_piece("__u", level) == F.col("__p")).select("__i", "size", "__u", F.col("__left").alias("__rest"))
    # what is left of a source is one piece in 2^(2 * BLOCK_BITS); equal hashes stay together
    tied = open_.groupBy("__i", "__rest", "__u").agg(F.sum("size").alias("size"))
    in_order = Window.partitionBy("__i").orderBy(F.col("__u").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))).rowsBetween(Window.unboundedPreceding, 0)
    last = tied.withColumn("n", F.sum("size").over(in_order)).groupBy("__i").agg(
        F.max_by("__u", F.when(F.col("n") - F.col("size") / 2 <= F.col("__rest"), F.col("n"))).alias("cut"), F.min_by("__u", "n").alias("first")
    )
    out = {}
    for r in collect_small(last, MAX_SOURCES):
        # without a row that fits, the cut lies just before the piece's first row
        out[r["__i"]] = r["cut"] if r["cut"] is not None else _signed((r["first"] - 1) % (1 << 64))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _deal(spark, quotas: np.ndarray, shards: int, seed: int) -> DataFrame:
    """(__i, shard, low, high): the places among a source's permuted draws that each shard takes."""
    top = split_node(quotas, 0, shards, seed, -(-shards // DRIVER_NODES))
    starts, at = [], np.zeros(len(quotas), np.int64)
    for low, high, quota in top:
        starts.append((low, high, quota.tolist(), at.tolist()))
        at = at + quota

    def below(parts):
        for part in parts:
            for low, high, quota, start in part.itertuples(index=False):
                begin = np.asarray(start, np.int64)
                for shard, _, own in split_node(np.asarray(quota, np.int64), low, high, seed):
                    some = np.flatnonzero(own)
                    yield pd.DataFrame({"__i": some.astype("int32"), "shard": np.int32(shard), "low": begin[some], "high": begin[some] + own[some]})
                    begin = begin + own

    nodes = spark.createDataFrame(starts, "low int, high int, quota array<long>, start array<long>")
    return nodes.repartition(max(1, len(starts) // 4)).mapInPandas(below, "__i int, shard int, low long, high long")
