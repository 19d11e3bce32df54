"""Scores by a log-bilinear language model over word classes, trained by noise-contrastive estimation.

A frequent word is a class of its own, the others share classes by their
endings. The two classes before a token give a vector, the sum of one
embedding for each place; its products with the output embeddings score all
classes. Training sees the counts of all class triples of the corpus: every
task runs noise-contrastive steps on its share of the table, and a round ends
with the weighted mean of the parameters. Matrix products over all pairs of
context classes then give a normalised table. A class spreads its probability
over its words by discounted counts and keeps the discount for unknown words.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.bounds import collect_small
from gradus.llm.common import small_batches, stored
from gradus.llm.tokens import words_of

FOLDS, HELD_OUT = 7, 2
#: most frequent tokens (as many as this at most) whose counts are broadcast; the counts of all others come by a join
HEAD = 50_000
#: classes: the end, then frequent words, then endings
CLASSES, ENDINGS = 256, 96
#: stands for the end of a text; no word holds white space
END = "\n"
WIDTH, ROUNDS, NOISE, BATCH, RATE = 24, 4, 64, 1024, 0.15
#: steps see so many draws for each row of the triple table in a round
DRAWS = 1.5
#: tokens between two hand-overs of counts
FLUSH = 2_000_000


def held_out(doc_id: str) -> Column:
    """Rows that nothing is learned from; a null id is one of them."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == HELD_OUT, F.lit(True))


@dataclass(frozen=True)
class Vocabulary:
    """``counts`` of the head's tokens; ``own``: classes of single words; N, V; sums of the ending classes."""

    counts: dict[str, int]
    own: dict[str, int]
    n: int
    v: int
    class_n: np.ndarray
    class_v: np.ndarray
    discount: float

    def base(self, count) -> float:
        return np.log10((count + 1) / (self.n + self.v + 1))


def class_of(word: str, own: dict[str, int]) -> int:
    found = own.get(word)
    return CLASSES - ENDINGS + zlib.crc32(word[-2:].encode("utf-8", "replace")) % ENDINGS if found is None else found


def _class_triples(cls: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classes one and two before each token; before a text there are ends (class 0)."""
    one, two = np.zeros_like(cls), np.zeros_like(cls)
    one[1:], two[2:] = cls[:-1], cls[:-2]
    begins = np.concatenate([[0], ends[:-1]])
    one[begins] = two[begins] = 0
    second = begins[begins + 1 < ends] + 1
    two[second] = 0
    return one, two


def _with_ends(values: np.ndarray, ends: np.ndarray, end) -> tuple[np.ndarray, np.ndarray]:
    return np.insert(values, ends, end), ends + np.arange(1, len(ends) + 1)


def token_counts(train: DataFrame) -> DataFrame:
    """(token, n) over all texts, ends included."""

    def run(batches):
        for batch in batches:
            words, place, ends = words_of(batch.column(0))
            n = np.bincount(place, minlength=len(words))
            yield pa.RecordBatch.from_arrays([pa.array([*words, END]), pa.array([*n.tolist(), len(ends)], pa.int64())], names=["token", "n"])

    return train.select("text").mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, head: int = HEAD) -> Vocabulary:
    """The head, and the sums of all ending classes over the whole of ``counts``."""
    step = F.floor(8 * F.log2("n"))  # counts in steps of a ninth, some hundred at most
    least, held = None, 0
    for r in sorted(collect_small(counts.groupBy(step.alias("step")).count()), key=lambda r: -r["step"]):
        held += r["count"]
        if held > head:
            break
        least = r["step"]
    wanted = counts.filter(step >= least) if least is not None else counts.limit(0)  # at most ``head`` rows reach the driver
    top = {r["token"]: r["n"] for r in sorted(collect_small(wanted, head), key=lambda r: (-r["n"], r["token"]))}
    own = {END: 0}
    for word in top:
        if word != END and len(own) < CLASSES - ENDINGS:
            own[word] = len(own)

    def run(batches):
        sums = np.zeros((CLASSES, 4), np.int64)
        for batch in batches:
            n = batch.column(1).to_numpy(zero_copy_only=False)
            cls = np.array([class_of(w, own) for w in batch.column(0).to_pylist()], np.int64)
            for j, x in enumerate((n, np.ones_like(n), n == 1, n == 2)):
                sums[:, j] += np.bincount(cls, x, CLASSES).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES, dtype=np.int32)), *(pa.array(sums[:, j]) for j in range(4))], names=["class", "n", "v", "n1", "n2"])

    parts = counts.mapInArrow(run, "class int, n long, v long, n1 long, n2 long").groupBy("class").agg(*[F.sum(c).alias(c) for c in ("n", "v", "n1", "n2")])
    table = np.zeros((CLASSES, 4), np.int64)
    for r in collect_small(parts, CLASSES):
        table[r["class"]] = r["n"], r["v"], r["n1"], r["n2"]
    n1, n2 = int(table[:, 2].sum()), int(table[:, 3].sum())
    discount = min(0.95, max(0.1, n1 / max(1, n1 + 2 * n2)))
    return Vocabulary(top, own, int(table[:, 0].sum()), int(table[:, 1].sum()), table[:, 0], table[:, 1], discount)


def class_counts(train: DataFrame, own: dict[str, int]) -> DataFrame:
    """(code, n) of all class triples; code = (two before * CLASSES + one before) * CLASSES + class. At most CLASSES^3 rows."""

    def run(batches):
        codes, held = [], 0

        def flush():
            code, n = np.unique(np.concatenate(codes), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["code", "n"])

        for batch in batches:
            words, place, ends = words_of(batch.column(0))
            cls = np.array([class_of(w, own) for w in words], np.int64)[place] if words else np.zeros(0, np.int64)
            cls, ends = _with_ends(cls, ends, 0)
            if len(cls):
                one, two = _class_triples(cls, ends)
                codes.append((two * CLASSES + one) * CLASSES + cls)
                held += len(cls)
            if held >= FLUSH:
                yield flush()
                codes, held = [], 0
        if codes:
            yield flush()

    return train.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


@dataclass
class Parameters:
    """Embeddings of the context classes one and two before, of the output classes, and output biases."""

    one: np.ndarray
    two: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @staticmethod
    def start(unigram: np.ndarray, seed: int = 5) -> Parameters:
        rng = np.random.Generator(np.random.Philox(seed))
        small = [rng.standard_normal((CLASSES, WIDTH)).astype(np.float32) * 0.1 for _ in range(3)]
        return Parameters(*small, np.log(unigram).astype(np.float32))

    def to_bytes(self) -> bytes:
        return np.concatenate([x.ravel() for x in (self.one, self.two, self.out, self.bias)]).astype("<f4").tobytes()

    @staticmethod
    def of(flat: np.ndarray) -> Parameters:
        size = CLASSES * WIDTH
        one, two, out = (flat[i * size : (i + 1) * size].reshape(CLASSES, WIDTH).astype(np.float32) for i in range(3))
        return Parameters(one, two, out, flat[3 * size :].astype(np.float32))

    def log10_table(self) -> np.ndarray:
        """log10 probability of each class after each pair of classes: products of all context vectors with all outputs, normalised."""
        table = np.empty((CLASSES, CLASSES, CLASSES), np.float32)
        for c in range(CLASSES):  # two before = c
            scores = (self.one + self.two[c]) @ self.out.T + self.bias
            scores -= scores.max(1, keepdims=True)
            table[c] = (scores - np.log(np.exp(scores).sum(1, keepdims=True))) / np.log(10)
        return table


def nce_round(p: Parameters, code: np.ndarray, n: np.ndarray, unigram: np.ndarray, draws: int, seed: int) -> Parameters:
    """Noise-contrastive steps with AdaGrad on triples drawn by their counts; a batch shares its noise classes."""
    rng = np.random.Generator(np.random.Philox(seed))
    cell, noise = np.cumsum(n) / n.sum(), np.cumsum(unigram) / unigram.sum()
    shift = (np.log(NOISE) + np.log(unigram)).astype(np.float32)
    values = [p.one, p.two, p.out, p.bias]
    squares = [np.full_like(v, 1e-3) for v in values]
    for _ in range(max(1, draws // BATCH)):
        c = code[np.minimum(np.searchsorted(cell, rng.random(BATCH)), len(code) - 1)]
        w, one, two = c % CLASSES, c // CLASSES % CLASSES, c // CLASSES**2
        false = np.minimum(np.searchsorted(noise, rng.random(NOISE)), CLASSES - 1)
        h = p.one[one] + p.two[two]
        up = 1 / (1 + np.exp(np.clip((h * p.out[w]).sum(1) + p.bias[w] - shift[w], -30, 30)))
        down = -1 / (1 + np.exp(np.clip(shift[false] - p.bias[false] - h @ p.out[false].T, -30, 30)))
        back = up[:, None] * p.out[w] + down @ p.out[false]
        steps = [np.zeros_like(v) for v in values]
        np.add.at(steps[0], one, back)
        np.add.at(steps[1], two, back)
        np.add.at(steps[2], w, up[:, None] * h)
        np.add.at(steps[2], false, down.T @ h)
        np.add.at(steps[3], w, up)
        np.add.at(steps[3], false, down.sum(0))
        for v, s, g in zip(values, squares, steps):
            g /= BATCH
            s += g * g
            v += RATE * g / np.sqrt(s)
    return p


def train_model(triples: DataFrame, class_n: np.ndarray, rounds: int = ROUNDS) -> Parameters:
    """Rounds of steps in all tasks; after each, the mean of the parameters, weighted by the tokens seen."""
    unigram = (class_n + 0.5) / (class_n.sum() + 0.5 * CLASSES)
    params = Parameters.start(unigram)
    for turn in range(rounds):
        flat = params.to_bytes()

        def run(batches):
            read = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
            if sum(len(c) for c, _ in read):
                code, n = (np.concatenate(x) for x in zip(*read))  # a share of at most CLASSES^3 rows
                p = Parameters.of(np.frombuffer(flat, "<f4").copy())
                p = nce_round(p, code, n, unigram, int(DRAWS * len(code)), int(code[0]) * rounds + turn)
                yield pa.RecordBatch.from_arrays([pa.array([int(code[0]) % 16], pa.int32()), pa.array([p.to_bytes()], pa.binary()), pa.array([float(n.sum())])], names=["k", "flat", "weight"])

        def mean(rows):
            w = rows.column("weight").to_numpy()
            total = sum(np.frombuffer(x, "<f4").astype(np.float64) * v for x, v in zip(rows.column("flat").to_pylist(), w))
            return pa.table({"flat": pa.array([(total / w.sum()).astype("<f4").tobytes()], pa.binary()), "weight": [float(w.sum())]})

        parts = triples.mapInArrow(run, "k int, flat binary, weight double").groupBy("k").applyInArrow(mean, "flat binary, weight double").collect()
        if not parts:
            break
        weights = np.array([r["weight"] for r in parts])
        params = Parameters.of(sum(np.frombuffer(r["flat"], "<f4").astype(np.float64) * w for r, w in zip(parts, weights)) / weights.sum())
    return params


_TABLES: dict[int, np.ndarray] = {}


def _table(flat: bytes) -> np.ndarray:
    """Once in a Python worker."""
    key = zlib.crc32(flat)
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = Parameters.of(np.frombuffer(flat, "<f4")).log10_table()
    return _TABLES[key]


def _partial(rows: DataFrame, vocab: Vocabulary, params: Parameters) -> DataFrame:
    """Per document what the head and the class table tell, and its other tokens with their classes and counts."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((vocab, params.to_bytes()))
    tail = pa.struct([("token", pa.string()), ("class", pa.int32()), ("m", pa.int64())])

    def run(batches):
        vocab, flat = shared.value
        table = _table(flat)
        for batch in batches:
            words, place, ends = words_of(batch.column(1))
            words, at_end = [*words, END], len(words)
            tokens, ends = _with_ends(place, ends, at_end)
            cls_of = np.array([class_of(w, vocab.own) for w in words], np.int64)
            count = np.array([vocab.counts.get(w, -1) for w in words], np.int64)
            known = np.maximum(count, 0)
            inside = np.where(cls_of < CLASSES - ENDINGS, 1.0, np.maximum(known - vocab.discount, 1e-300) / np.maximum(vocab.class_n[cls_of], 1))
            head = count >= 0
            sums = lambda x: np.diff(np.concatenate([[0.0], np.cumsum(x)])[np.concatenate([[0], ends])])
            cls = cls_of[tokens]
            if len(tokens):
                one, two = _class_triples(cls, ends)
                ln = table[two, one, cls].astype(float)
            else:
                ln = np.zeros(0)
            score = sums(ln + np.where(head, np.log10(inside), 0.0)[tokens])
            base = sums(np.where(head, vocab.base(known), 0.0)[tokens])
            n_known = sums((known > 0)[tokens])
            n_tokens = np.diff(np.concatenate([[0], ends]))
            doc = np.repeat(np.arange(len(ends)), n_tokens)
            other = ~head[tokens]
            pair, m = np.unique(doc[other] * len(words) + tokens[other], return_counts=True)
            d, w = pair // len(words), pair % len(words)
            offsets = np.searchsorted(d, np.arange(len(ends) + 1))
            structs = pa.StructArray.from_arrays([pa.array([words[i] for i in w], pa.string()), pa.array(cls_of[w].astype(np.int32)), pa.array(m)], fields=list(tail))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n_tokens), pa.array(n_known.astype(np.int64)), pa.array(base), pa.array(score), lists], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "tail"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, tail array<struct<token:string,class:int,m:long>>")


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """Learns from the documents that aren't held out and scores all.

    Returns a row per input row: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score and score (log10 probabilities). A null or empty
    text is its end alone. An unknown word counts as the unknown one of its
    class, as the base gives one probability to all unknown words. Repeated
    rows are learned from and scored each; without training rows the base is
    0 and the classes are alike.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("held_out", held_out("doc_id"))
    train = rows.filter("not held_out")
    counts = stored(token_counts(train), "token-counts")
    vocab = vocabulary(counts, head)
    triples = stored(class_counts(train, vocab.own), "class-triples")
    params = train_model(triples, vocab.class_n)
    partial = stored(_partial(rows.select("doc_id", "text", "held_out"), vocab, params).withColumn("row", F.monotonically_increasing_id()), "partial-scores")
    tail = partial.select("row", F.explode("tail").alias("t")).select("row", "t.token", "t.class", "t.m")
    joined = tail.join(counts, "token", "left")
    n_k, v_k = (F.get(F.array(*[F.lit(float(x)) for x in of]), F.col("class")) for of in (vocab.class_n, vocab.class_v))
    unknown = F.when(n_k > 0, F.greatest(vocab.discount * v_k, F.lit(1e-9)) / n_k).otherwise(F.lit(1.0))
    emission = F.log10(F.when(F.col("n").isNull(), unknown).otherwise((F.col("n") - vocab.discount) / n_k))
    base = F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(vocab.n + vocab.v + 1)))
    rest = joined.select("row", F.when(F.col("n").isNotNull(), F.col("m")).otherwise(0).alias("n_known"), (F.col("m") * base).alias("base_score"), (F.col("m") * emission).alias("score"))
    first = partial.drop("tail")
    both = first.unionByName(rest, allowMissingColumns=True)
    out = both.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").cast("long").alias("n_known"),
        F.lit(vocab.n).cast("long").alias("train_tokens"), F.sum("base_score").alias("base_score"), F.sum("score").alias("score"),
    )
    return out.drop("row")
