"""Exact duplicates: counting quotient filters route repeated fingerprints to a comparison of bytes.

Every task turns the 64-bit fingerprints of its rows into a counting quotient
filter: the upper bits of a fingerprint are its quotient, the rest its
remainder; remainders lie sorted below their quotient, each with a counter.
Filters merge losslessly, as equal (quotient, remainder) pairs add their
counters. A filter is cut by quotient range for the merge, so no task sees the
whole of it. Only texts whose fingerprint counts over one are compared.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.llm.common import id_and_text, join_groups, stored
from gradus.session import checkpointed

QUOTIENT_BITS = 16
#: fingerprints that one filter takes in before it is handed on
FILTER_ROWS = 1 << 22
#: repeated fingerprints (8 bytes each) up to which they are broadcast to the scan of the texts
BROADCAST_FINGERPRINTS = 500_000


@dataclass(frozen=True)
class CountingQuotientFilter:
    """Remainders in the order of (quotient, remainder) with their counters; ``runs`` holds the end of each quotient's run."""

    first: int
    runs: np.ndarray
    remainders: np.ndarray
    counts: np.ndarray

    @staticmethod
    def of(fingerprints: np.ndarray, counts: np.ndarray | None = None, first: int = 0, quotients: int = 1 << QUOTIENT_BITS) -> CountingQuotientFilter:
        """From unsigned fingerprints whose quotients lie in [first, first + quotients)."""
        fps, at = np.unique(fingerprints.astype(np.uint64), return_inverse=True)
        weights = np.ones(len(fingerprints), np.int64) if counts is None else counts
        total = np.zeros(len(fps), np.int64)
        np.add.at(total, at, weights)
        shift = np.uint64(64 - QUOTIENT_BITS)
        quotient = (fps >> shift).astype(np.int64) - first
        runs = np.cumsum(np.bincount(quotient, minlength=quotients))
        return CountingQuotientFilter(first, runs, fps & ((np.uint64(1) << shift) - np.uint64(1)), total)

    def fingerprints(self) -> np.ndarray:
        sizes = np.diff(self.runs, prepend=0)
        quotient = np.repeat(np.arange(len(sizes), dtype=np.uint64) + np.uint64(self.first), sizes)
        return (quotient << np.uint64(64 - QUOTIENT_BITS)) | self.remainders

    @staticmethod
    def merged(filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """Of filters over the same quotients; equal remainders add their counters, so no count is lost."""
        one = filters[0]
        fps, counts = np.concatenate([f.fingerprints() for f in filters]), np.concatenate([f.counts for f in filters])
        return CountingQuotientFilter.of(fps, counts, one.first, len(one.runs))

    def count(self, fingerprint: int) -> int:
        shift = 64 - QUOTIENT_BITS
        q = (fingerprint >> shift) - self.first
        if not 0 <= q < len(self.runs):
            return 0
        low, high = (int(self.runs[q - 1]) if q else 0), int(self.runs[q])
        at = low + int(np.searchsorted(self.remainders[low:high], np.uint64(fingerprint & ((1 << shift) - 1))))
        return int(self.counts[at]) if at < high and int(self.remainders[at]) == fingerprint & ((1 << shift) - 1) else 0

    def slices(self, parts: int) -> list[CountingQuotientFilter]:
        """Cut by quotient range."""
        width, out = len(self.runs) // parts, []
        for p in range(parts):
            low = int(self.runs[p * width - 1]) if p else 0
            high = int(self.runs[(p + 1) * width - 1])
            out.append(CountingQuotientFilter(self.first + p * width, self.runs[p * width : (p + 1) * width] - low, self.remainders[low:high], self.counts[low:high]))
        return out


def repeated_fingerprints(hashes: DataFrame, column: str = "fp", parts: int | None = None) -> DataFrame:
    """(fp, n) of all fingerprints that occur more than once; ``parts``: quotient ranges (a power of two up to 2^16)."""
    spark = hashes.sparkSession
    wanted = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = min(1 << QUOTIENT_BITS, 1 << max(0, (wanted - 1).bit_length()))
    width = (1 << QUOTIENT_BITS) // parts

    def build(batches):
        held, n = [], 0

        def flush():
            for s in CountingQuotientFilter.of(np.concatenate(held)).slices(parts):
                if len(s.remainders):
                    yield pa.RecordBatch.from_pylist(
                        [{"part": s.first // width, "runs": s.runs.astype("<i8").tobytes(), "remainders": s.remainders.astype("<u8").tobytes(), "counts": s.counts.astype("<i8").tobytes()}],
                        schema=pa.schema([("part", pa.int32()), ("runs", pa.binary()), ("remainders", pa.binary()), ("counts", pa.binary())]),
                    )

        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            n += batch.num_rows
            if n >= FILTER_ROWS:
                yield from flush()
                held, n = [], 0
        if n:
            yield from flush()

    def merged(key, table):
        first = int(key[0].as_py()) * width
        read = zip(*(table.column(c).to_pylist() for c in ("runs", "remainders", "counts")))
        whole = CountingQuotientFilter.merged(
            [CountingQuotientFilter(first, np.frombuffer(r, "<i8"), np.frombuffer(m, "<u8"), np.frombuffer(c, "<i8")) for r, m, c in read]
        )
        many = whole.counts > 1
        return pa.table({"fp": pa.array(whole.fingerprints()[many].view(np.int64)), "n": pa.array(whole.counts[many])})

    filters = hashes.select(F.col(column).alias("fp")).mapInArrow(build, "part int, runs binary, remainders binary, counts binary")
    return filters.groupBy("part").applyInArrow(merged, "fp long, n long")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of byte-identical texts; the row with the largest id stays.

    Returns a row per input row: doc_id, keep_id (id that stays), group_size
    (rows of the text), kept, text_sha256. A null text equals an empty one. Of
    repeated rows with one id, every row counts in group_size and all with the
    largest id are kept. A null id is smaller than all others; a text with null
    ids only has a null keep_id and keeps its rows. An empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    rows = id_and_text(docs, id_col, text_col)
    hashed = rows.select("doc_id", F.xxhash64("text").alias("fp"), F.unhex(F.sha2("text", 256)).alias("sha"))
    hashed = stored(hashed, "exact-hashes")
    total = hashed.count()
    suspects = checkpointed(repeated_fingerprints(hashed))
    routed = rows.withColumn("fp", F.xxhash64("text")).join(
        F.broadcast(suspects.select("fp")) if suspects.count() <= BROADCAST_FINGERPRINTS else suspects.select("fp"), "fp", "left_semi"
    )
    # equal bytes meet in one group; each task sends a text at most once
    same = routed.groupBy("fp", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    groups = same.filter("n > 1").select(F.unhex(F.sha2("text", 256)).alias("sha"), "keep_id", "n", F.lit(True).alias("found"))
    out = join_groups(hashed, checkpointed(groups), "sha", "n", total)
    keep_id = F.when(F.col("found"), F.col("keep_id")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id", keep_id.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )
