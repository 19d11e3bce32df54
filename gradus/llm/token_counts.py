"""Token counts without token ids: pieces are counted once per distinct pre-token, joined to each document's pre-token frequencies and summed.

A byte-pair tokenizer joins two neighbouring characters only if some piece of
its vocabulary holds both side by side. A text may be cut wherever no piece
does, and the counts of the parts add up to the count of the whole. Cuts are
made before runs of blanks and around those ASCII characters that no piece
joins to another one, such as line breaks and digits.

Frequent pre-tokens have their counts sent to all tasks (a fixed number of
short strings), the others meet theirs in a shuffle join.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.llm.common import batches_of, id_and_text, small_batches, stored

#: pre-tokens whose counts are sent to all tasks, at most, and their largest length
HEAD, HEAD_CHARS = 1 << 18, 32
#: the sign that stands for a blank in pieces
BLANK = "▁"
#: pre-tokens are grouped by log2(frequency) * STEPS for the choice of the head
STEPS = 16


class PieceCounter:
    """Cuts texts into pre-tokens and counts the pieces of each, for one sentencepiece BPE model."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        model = proto.ModelProto.FromString(self.processor.serialized_model_proto())
        rules, kinds = model.normalizer_spec, proto.ModelProto.SentencePiece
        pieces = [p.piece for p in model.pieces if p.type == kinds.NORMAL]
        plain = rules.name == "identity" and rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces
        bpe = model.trainer_spec.model_type == proto.TrainerSpec.BPE and model.trainer_spec.byte_fallback
        others = any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces)
        if not plain or not bpe or others or any(re.search(f"[^{BLANK}]{BLANK}", p) for p in pieces):
            raise ValueError("counts per pre-token need a BPE model with byte fallback, plain text rules and blanks at the start of pieces only")
        joined = {c for p in pieces if len(p) > 1 for c in p}
        alone = {chr(c) for c in range(128)} - joined - {" "}
        if "\n" not in alone:
            raise ValueError("a line break must be a token of its own")
        signs = "".join(map(re.escape, sorted(alone)))
        self._cut = re.compile(f"[ {BLANK}]+[^ {BLANK}{signs}]*|[^ {BLANK}{signs}]+|[{signs}]")

    def pre_tokens(self, text: str) -> list[str]:
        """The parts of the text behind the blank that the model puts first; none for an empty text."""
        return self._cut.findall(" " + text) if text else []

    def count(self, pre_tokens: list[str]) -> list[int]:
        """The number of pieces of each pre-token."""
        # the model's own first blank stands for a leading one; where there is none, a line break keeps it off, which takes two tokens
        led = [p[0] in (" ", BLANK) for p in pre_tokens]
        found = self.processor.encode([p[1:] if own else "\n" + p for p, own in zip(pre_tokens, led)], num_threads=1)
        # a lone blank leaves the empty text, for which the model gives nothing
        return [len(ids) + (len(p) == 1) if own else len(ids) - 2 for p, own, ids in zip(pre_tokens, led, found)]


@lru_cache(maxsize=2)
def piece_counter(path: str) -> PieceCounter:
    """One for all tasks of a Python worker."""
    return PieceCounter(path)


def _distinct(model: str):
    """For ``mapInArrow``: the pre-tokens of some documents, each with the number of documents that have it."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cut, seen = piece_counter(model).pre_tokens, Counter()
        for text in batch.column(0).to_pylist():
            seen.update(set(cut(text)))
        return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["piece", "docs"])

    return run


def distinct_pre_tokens(texts: DataFrame, model: str) -> DataFrame:
    """(piece, docs, tokens): every pre-token of the column ``text`` once, the documents that have it and its number of tokens."""

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.append_column("tokens", pa.array(piece_counter(model).count(batch.column(0).to_pylist()), pa.int64()))

    pieces = texts.mapInArrow(batches_of(_distinct(model), 2048), "piece string, docs long").groupBy("piece").agg(F.sum("docs").alias("docs"))
    return pieces.mapInArrow(batches_of(counted, 4096), "piece string, docs long, tokens long")


def _head(pieces: DataFrame, size: int) -> DataFrame:
    """The most frequent short pre-tokens, at most ``size``: whole steps of equal rounded frequency."""
    short = pieces.filter(F.length("piece") <= HEAD_CHARS).withColumn("step", F.floor(F.log2("docs") * STEPS).cast("int"))
    room, least = size, None
    for row in short.groupBy("step").count().orderBy(F.desc("step")).collect():  # at most 64 * STEPS rows
        room -= row["count"]
        if room < 0:
            break
        least = row["step"]
    return short.filter(F.lit(False) if least is None else F.col("step") >= least).select("piece", "tokens")


def count_tokens(docs: DataFrame, model: str, limit: int, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; ``model`` is the path of a sentencepiece BPE model on all machines.

    The count is that of the whole text, without begin, end or other added
    tokens; strings that look like special tokens are plain text, as the
    library has it. A null text counts as empty: no bytes, no tokens. Null and
    repeated ids keep their rows, equal rows too; other columns are left out.
    Very long texts are cut like others; only their list of pre-tokens is held
    in memory. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = id_and_text(docs, id_col, text_col)
    pieces = stored(distinct_pre_tokens(rows.select("text"), model), "token-counts")
    known = spark.sparkContext.broadcast(dict(_head(pieces, head).collect()))

    def frequencies(batch: pa.RecordBatch) -> pa.RecordBatch:
        """A row per document with the tokens of its frequent pre-tokens, and one per other pre-token with its frequency."""
        cut, of = piece_counter(model).pre_tokens, known.value
        owner, rest, times, sums = [], [], [], []
        for i, text in enumerate(batch.column(2).to_pylist()):
            total = 0
            for piece, n in Counter(cut(text)).items():
                tokens = of.get(piece)
                if tokens is None:
                    owner.append(i)
                    rest.append(piece)
                    times.append(n)
                else:
                    total += n * tokens
            sums.append(total)
        n, more = batch.num_rows, len(owner)
        row, every = batch.column(0), pa.array([*range(n), *owner], pa.int64())
        ids = pa.concat_arrays([batch.column(1), pa.nulls(more, batch.column(1).type)])
        size = pa.concat_arrays([pc.cast(pc.binary_length(batch.column(2)), pa.int64()), pa.nulls(more, pa.int64())])
        # rows of documents get keys of their own, so that they don't meet in one task
        scatter = pa.concat_arrays([pc.add(row, 1), pa.array([0] * more, pa.int64())])
        return pa.RecordBatch.from_arrays(
            [row.take(every), ids, size, scatter, pa.array([""] * n + rest, pa.string()), pa.array(sums + times, pa.int64())], names=["row", "doc_id", "n_bytes", "scatter", "piece", "n"]
        )

    own = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    schema = f"row long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, scatter long, piece string, n long"
    parts = own.mapInArrow(batches_of(frequencies, 512), schema)
    joined = parts.join(pieces.select("piece", "tokens", F.lit(0).cast("long").alias("scatter")), ["piece", "scatter"], "left")
    sums = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum(F.when(F.col("scatter") > 0, F.col("n")).otherwise(F.col("n") * F.col("tokens"))).alias("n_tokens")
    )
    return sums.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
