"""Near duplicates by SimHash fingerprints and multi-index hashing.

A fingerprint is cut into three segments. Two fingerprints that differ in at
most four bits differ in at most one bit of some segment; so every fingerprint
looks up the Hamming ball of radius one around each of its segments in the
table of all segments, and the join checks the whole distance. Equal
fingerprints are one node. Before that, fingerprints two bits apart or less
are grouped through the words one bit away from them, of which no word has
more than 65; the lookup then returns links between different groups only, so
a crowd of near copies doesn't come out as all its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.llm.common import batches_of, id_and_text, join_groups, small_batches
from gradus.llm.components import connected_components
from gradus.session import checkpointed

SEED = 42
BITS = 64


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """Unsigned XXH64 of all word shingles, repeats included. A shorter text is one shingle; without words there is none."""
    words = text.encode().lower().split()  # for bytes, both look at ASCII only
    if not words:
        return np.zeros(0, np.uint64)
    line, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([hashed(line, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-shingle].tolist()]
    return np.fromiter((hashed(line[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes; zero without hashes."""
    ones, n = np.zeros(BITS, np.int64), len(hashes)
    planes = np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(n, BITS)
    for at in range(0, n, 255):  # a byte holds the sum of 255 rows
        ones += planes[at : at + 255].sum(0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def remixed(hashes: np.ndarray, turn: int) -> np.ndarray:
    """Other hashes of the same shingles; the hashes themselves for turn 0."""
    for _ in range(turn):
        hashes = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return hashes


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, prints: int = 1) -> DataFrame:
    """(doc_id, fp0, fp1, ...): the fingerprints of every text as signed longs."""
    small_batches(docs.sparkSession)
    names = [f"fp{i}" for i in range(prints)]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes = [shingle_hashes(t, shingle) for t in batch.column(1).to_pylist()]
        fps = [np.array([fingerprint(remixed(h, i)) for h in hashes], np.uint64).view(np.int64) for i in range(prints)]
        return pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, fps)], names=["doc_id", *names])

    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(batches_of(run), ", ".join([f"doc_id {kind}", *(f"{n} long" for n in names)]))


def segments(count: int) -> list[tuple[int, int]]:
    """(lowest bit, bits) of ``count`` segments of nearly equal length."""
    cuts = [BITS * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def segment(fp: Column, low: int, bits: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _bit(i: int) -> Column:
    return F.lit((1 << i) - (1 << BITS if i == BITS - 1 else 0)).cast("long")


def close_groups(fps: DataFrame) -> DataFrame:
    """(fp, crowd): groups linked by steps of at most two bits; the work grows with the fingerprints, not with their pairs."""
    words = fps.select("fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(_bit(i)) for i in range(BITS)])).alias("word"))
    # a word has at most 65 fingerprints within one bit
    shared = words.groupBy("word").agg(F.min("fp").alias("hub"), F.max("fp").alias("top"), F.sort_array(F.collect_set("fp")).alias("near"))
    edges = shared.filter("hub < top").select("hub", F.explode("near").alias("fp")).filter("hub < fp").distinct()
    found = connected_components(edges, "hub", "fp")
    return checkpointed(fps.join(found, fps["fp"] == found["node"], "left").select("fp", F.coalesce("component", "fp").alias("crowd")))


def links(crowds: DataFrame, radius: int = 4, parts: int = 3) -> DataFrame:
    """(a, b): crowds that hold two fingerprints at most ``radius`` bits apart, by multi-index hashing."""
    cuts, ball = segments(parts), radius // parts
    if ball > 1:
        raise ValueError("radius needs more segments")
    keys = [(i, segment(F.col("fp"), *cut), cut[1]) for i, cut in enumerate(cuts)]
    entry = [F.struct(F.lit(i).alias("part"), key.alias("key")) for i, key, _ in keys]
    probe = [
        F.struct(F.lit(i).alias("part"), (key if flip is None else key.bitwiseXOR(_bit(flip))).alias("key"))
        for i, key, bits in keys for flip in [None, *(range(bits) if ball else ())]
    ]
    table = crowds.select(F.col("fp").alias("fp_b"), F.col("crowd").alias("b"), F.explode(F.array(*entry)).alias("e")).select("e.*", "fp_b", "b")
    looked = crowds.select(F.col("fp").alias("fp_a"), F.col("crowd").alias("a"), F.explode(F.array(*probe)).alias("e")).select("e.*", "fp_a", "a")
    same = (looked["part"] == table["part"]) & (looked["key"] == table["key"])
    near = (F.col("a") < F.col("b")) & (distance(F.col("fp_a"), F.col("fp_b")) <= radius)
    return looked.join(table, same & near).select("a", "b")


def value_groups(values: DataFrame, radius: int, parts: int) -> DataFrame:
    """(fp, group): groups of distinct fingerprints linked by steps of at most ``radius`` bits."""
    crowds = close_groups(values)
    found = connected_components(links(crowds, radius, parts), "a", "b")
    return crowds.join(found, crowds["crowd"] == found["node"], "left").select("fp", F.coalesce("component", "crowd").alias("group"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, parts: int = 3, prints: int = 1
) -> DataFrame:
    """Groups of documents whose fingerprints are linked by chains of at most ``radius`` differing bits.

    ``parts`` segments must allow at most one bit each. With several ``prints``
    (independent fingerprints of the same shingles) a link by any of them counts.

    Returns a row per input row: doc_id, fingerprint (16 hex digits) and
    component_id, the smallest id of its group. A null text equals an empty
    one; texts without words have fingerprint zero and are linked like others.
    Repeated rows give repeated rows. Null ids count for no component_id; a
    group of null ids only has a null one. An empty table gives an empty result.
    """
    names = [f"fp{i}" for i in range(prints)]
    hashed = checkpointed(fingerprints(docs, id_col, text_col, shingle, prints).withColumn("fp", F.col("fp0") if prints == 1 else F.xxhash64(*names)))
    # one node for equal fingerprints; a hot one is one row from each task
    nodes = checkpointed(hashed.groupBy("fp", *names).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")))
    grouped = nodes
    for i, name in enumerate(names):
        groups = value_groups(nodes.select(F.col(name).alias("fp")).distinct(), radius, parts)
        grouped = grouped.join(groups.select(F.col("fp").alias(name), F.col("group").alias(f"group{i}")), name)
    grouped = checkpointed(grouped.withColumn("group", F.col("group0")))
    if prints > 1:  # groups of different fingerprints that share a document are one
        tagged = [F.xxhash64(F.lit(i), f"group{i}") for i in range(prints)]
        ties = grouped.select(F.explode(F.array(*[F.struct(tagged[0].alias("a"), t.alias("b")) for t in tagged[1:]])).alias("e")).select("e.*").distinct()
        found = connected_components(ties, "a", "b")
        grouped = grouped.withColumn("tag", tagged[0])
        grouped = checkpointed(grouped.join(found, grouped["tag"] == found["node"], "left").withColumn("group", F.coalesce("component", "tag")).select("fp", "first_id", "n", "group"))
    smallest = grouped.groupBy("group").agg(F.min("first_id").alias("component_id"), F.count("*").alias("fps"))
    labelled = join_groups(grouped.select("fp", "n", "group"), checkpointed(smallest), "group", "fps", nodes.count())
    out = join_groups(hashed, labelled.select("fp", "n", "component_id"), "fp", "n", hashed.count())
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp0")), 16, "0").alias("fingerprint"), "component_id")
