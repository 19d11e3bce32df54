"""Token-id files with keyed access: raw ids in blocks, each with a minimal perfect hash index.

``write`` sorts the documents by id over the cluster, encodes them and writes
blocks: the ids of consecutive documents as raw little-endian numbers, where
each document ends, and an index. The index maps a document's key to its place
by hash and displace: a key's bucket holds the seed under which all keys of
the bucket fall on free slots, and there are as many slots as keys. A slot
stores a fingerprint, so foreign keys are noticed. One lookup reads one seed
and one slot. The blocks are rows of Parquet files, which makes them readable
and writable wherever Spark is.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.bounds import collect_small
from gradus.llm.common import id_and_text, shared_folder, small_batches
from gradus.llm.tokens import WordTokenizer, gathered

#: ids of a block; a longer document makes a block of its own
BLOCK_IDS = 1 << 20
#: blocks whose starts are summed up on the driver
MAX_BLOCKS = 5_000_000
KEYS_PER_BUCKET = 4


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser by shifts and odd multipliers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _slot(h: np.ndarray, seed: np.ndarray, n: int) -> np.ndarray:
    return (_mix(h + seed.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)) % np.uint64(n)).astype(np.int64)


@dataclass(frozen=True)
class PerfectHash:
    """``seeds``: a bucket's seed, or -1 - slot for a bucket of one key; ``prints``: each slot's fingerprint."""

    seeds: np.ndarray
    prints: np.ndarray

    @staticmethod
    def of(keys: np.ndarray) -> tuple[PerfectHash, np.ndarray]:
        """The hash of distinct integer keys, and the slot of each."""
        n = len(keys)
        if not n:
            return PerfectHash(np.zeros(0, np.int64), np.zeros(0, np.uint32)), np.zeros(0, np.int64)
        h = _mix(keys.astype(np.int64).view(np.uint64))
        buckets = max(1, n // KEYS_PER_BUCKET)
        bucket = (h % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=buckets)
        starts = np.cumsum(sizes) - sizes
        seeds, free, slots = np.zeros(buckets, np.int64), np.ones(n, bool), np.zeros(n, np.int64)
        for b in np.argsort(-sizes, kind="stable"):
            own = order[starts[b] : starts[b] + sizes[b]]
            if len(own) < 2:
                break
            base = 0
            while True:  # 32 seeds at once
                tries = _slot(h[own][:, None], np.arange(base, base + 32)[None, :], n)
                good = free[tries].all(0) & (np.diff(np.sort(tries, 0), axis=0) > 0).all(0)
                if good.any():
                    at = int(good.argmax())
                    seeds[b], slots[own] = base + at, tries[:, at]
                    free[tries[:, at]] = False
                    break
                base += 32
        left = iter(np.flatnonzero(free).tolist())
        for b in np.flatnonzero(sizes == 1):
            slot = next(left)
            seeds[b], slots[order[starts[b]]] = -1 - slot, slot
        prints = np.zeros(n, np.uint32)
        prints[slots] = (h >> np.uint64(32)).astype(np.uint32)
        return PerfectHash(seeds, prints), slots

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where the fingerprint says that the key isn't there."""
        n = len(self.prints)
        if not n:
            return np.full(len(keys), -1, np.int64)
        h = _mix(keys.astype(np.int64).view(np.uint64))
        seed = self.seeds[(h % np.uint64(len(self.seeds))).astype(np.int64)]
        slot = np.where(seed < 0, -1 - seed, _slot(h, np.maximum(seed, 0), n))
        return np.where(self.prints[slot] == (h >> np.uint64(32)).astype(np.uint32), slot, -1)


BLOCK = (
    "part int, seq int, n_ids long, n_null int, width int, keys binary, ends binary, seeds binary, prints binary, places binary, payload binary"
)
_BLOCK = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_ids", pa.int64()), ("n_null", pa.int32()), ("width", pa.int32()), *((c, pa.binary()) for c in ("keys", "ends", "seeds", "prints", "places", "payload"))])


def _block(part: int, seq: int, keys: list, ends: np.ndarray, ids: np.ndarray, width: int) -> pa.RecordBatch:
    """Rows come by key, null keys first; the index has each key's first row (a repeated key's rows follow one another)."""
    n_null = sum(k is None for k in keys)
    known = np.array(keys[n_null:], np.int64)
    distinct, first = np.unique(known, return_index=True)
    index, slots = PerfectHash.of(distinct)
    places = np.zeros(len(distinct), np.int64)
    places[slots] = first + n_null
    row = {
        "part": part, "seq": seq, "n_ids": len(ids), "n_null": n_null, "width": width, "keys": known.astype("<i8").tobytes(), "ends": ends.astype("<i8").tobytes(),
        "seeds": index.seeds.astype("<i8").tobytes(), "prints": index.prints.astype("<u4").tobytes(), "places": places.astype("<i8").tobytes(), "payload": ids.astype(f"<u{width}").tobytes(),
    }
    return pa.RecordBatch.from_pylist([row], schema=_BLOCK)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None, block_ids: int = BLOCK_IDS) -> None:
    """Encodes every text, ends it with ``end_id`` and writes the blocks in the order of the integer ids, null ids first.

    Ids fit two bytes where the vocabulary does, else they take four. Null
    texts count as empty; of repeated ids, every row is stored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def encode(batches):
        words = WordTokenizer(tokenizer)
        width = 2 if words.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        part, seq = TaskContext.get().partitionId(), 0
        keys, ends, held, size = [], [], [], 0
        for batch in gathered(batches):
            ids, stops = words.encode(batch.column(1), end_id)
            before = 0
            for key, stop in zip(batch.column(0).to_pylist(), stops.tolist()):
                if keys and size + stop - before > block_ids:
                    yield _block(part, seq, keys, np.array(ends), np.concatenate(held), width)
                    keys, ends, held, size, seq = [], [], [], 0, seq + 1
                held.append(ids[before:stop])
                size += stop - before
                keys.append(key)
                ends.append(size)
                before = stop
        if keys:
            yield _block(part, seq, keys, np.array(ends), np.concatenate(held), width)

    rows = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id").mapInArrow(encode, BLOCK).write.option("compression", "zstd").parquet(path)


class Block:
    """One block read back."""

    def __init__(self, row: dict):
        self.n_null, self.ends = row["n_null"], np.frombuffer(row["ends"], "<i8")
        self.keys, self.places = np.frombuffer(row["keys"], "<i8"), np.frombuffer(row["places"], "<i8")
        self.index = PerfectHash(np.frombuffer(row["seeds"], "<i8"), np.frombuffer(row["prints"], "<u4"))
        self.payload = np.frombuffer(row["payload"], f"<u{row['width']}")

    def span(self, row: int) -> tuple[int, int]:
        return (int(self.ends[row - 1]) if row else 0), int(self.ends[row])

    def rows_of(self, key: int) -> range:
        """The rows of a key, by its slot; none for a key that isn't in the block."""
        slot = int(self.index.find(np.array([key]))[0])
        if slot < 0:
            return range(0)
        at = first = int(self.places[slot])
        while at < len(self.ends) and self.keys[at - self.n_null] == key:
            at += 1
        return range(first, at)


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with ``start``, the number of ids before each."""
    blocks = spark.read.parquet(path)
    sizes = sorted((r["part"], r["seq"], r["n_ids"]) for r in collect_small(blocks.select("part", "seq", "n_ids"), MAX_BLOCKS))
    starts, at = [], 0
    for part, seq, n in sizes:
        starts.append((part, seq, at))
        at += n
    return blocks.join(F.broadcast(spark.createDataFrame(starts, "part int, seq int, start long")), ["part", "seq"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of all stored documents, each found through the index by its key."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                distinct, first = np.unique(block.keys, return_index=True)
                slots = block.index.find(distinct)
                begin = block.places[slots]  # a key that isn't found would fail the check below
                if (slots < 0).any() or (begin != first + block.n_null).any():
                    raise ValueError("the index doesn't lead to a stored key")
                runs = np.diff(np.append(first, len(block.keys)))
                rows = np.concatenate([np.arange(block.n_null), np.repeat(begin, runs) + np.arange(len(block.keys)) - np.repeat(first, runs)])
                low, high = np.concatenate([[0], block.ends])[rows], block.ends[rows]
                ids = [block.payload[a:b].astype("<u4") for a, b in zip(low.tolist(), high.tolist())]
                crc = [zlib.crc32(x.tobytes()) for x in ids]
                keys = pa.array([None] * block.n_null + block.keys.tolist(), pa.int64())
                yield pa.RecordBatch.from_arrays([keys, pa.array(low + row["start"]), pa.array(high - low), pa.array(crc, pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return _placed(spark, path).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def lookup(keys: DataFrame, path: str, key_col: str = "doc_id") -> DataFrame:
    """(doc_id, start, ids) of the asked keys: a key's block by its range, its rows by the index of that block."""
    spark = keys.sparkSession

    def ends(batches):
        for batch in batches:
            rows = [(r["part"], r["seq"], np.frombuffer(r["keys"], "<i8")) for r in batch.to_pylist() if r["keys"]]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([int(r[2][0]) for r in rows], pa.int64()), pa.array([int(r[2][-1]) for r in rows], pa.int64())], names=["part", "seq", "low", "high"])

    spans = sorted(tuple(r) for r in collect_small(spark.read.parquet(path).select("part", "seq", "keys").mapInArrow(ends, "part int, seq int, low long, high long"), MAX_BLOCKS))
    low, high = np.array([s[2] for s in spans]), np.array([s[3] for s in spans])

    def route(batches):
        for batch in batches:
            for key in batch.column(0).to_pylist():
                if key is not None:
                    hit = range(int(np.searchsorted(high, key, "left")), int(np.searchsorted(low, key, "right")))
                    if len(hit):
                        yield pa.RecordBatch.from_arrays([pa.array([spans[i][0] for i in hit], pa.int32()), pa.array([spans[i][1] for i in hit], pa.int32()), pa.array([key] * len(hit), pa.int64())], names=["part", "seq", "key"])

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                block = Block(row)
                for key in row["wanted"]:
                    for r in block.rows_of(key):
                        a, b = block.span(r)
                        out.append((key, row["start"] + a, block.payload[a:b].astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.binary())], names=["doc_id", "start", "ids"])

    asked = keys.select(F.col(key_col).cast("long").alias("key")).distinct().mapInArrow(route, "part int, seq int, key long")
    asked = asked.groupBy("part", "seq").agg(F.collect_list("key").alias("wanted"))  # at most a block's documents
    return _placed(spark, path).join(asked, ["part", "seq"]).mapInArrow(run, "doc_id long, start long, ids binary")


def encode_and_read(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files into the shared folder and returns what :func:`read` finds there.

    A row per input row: doc_id, start (ids of all documents before it),
    n_tokens (with the end id), ids_crc32, ids. A null text has its end id
    alone. Null ids come first and can't be looked up; repeated ids follow one
    another. An empty table gives an empty result.
    """
    path = shared_folder(docs.sparkSession, "token-files")
    write(docs, path, tokenizer, end_id, id_col, text_col)
    return read(docs.sparkSession, path)
