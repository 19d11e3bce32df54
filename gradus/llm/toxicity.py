"""Toxicity by compression distance: zstandard dictionaries of ordinary and of toxic text.

Both dictionaries share a background that zstandard's trainer draws from
ordinary text. The toxic one goes on with the pieces of words that labelled
toxic documents have far more often than ordinary ones; pieces are starts of words,
and the bytes are shifted by their place in the word, so that they match there only. A window of a few
words that compresses better with the toxic dictionary holds such pieces; what
it gains counts in bytes. The largest gains of a document's windows are turned
into a probability by thresholds calibrated on other labelled documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.llm.common import ascii_lower, batches_of, id_and_text, small_batches
from gradus.session import checkpointed

#: labelled documents of each class that the model learns from at most, in hash order
SAMPLE_DOCS = 4000
WINDOW_WORDS = 4
BACKGROUND_BYTES = 16384
#: pieces of words that are looked at for the dictionaries
PIECES = 6000
#: a document asks for so many pieces; then it counts no more for others
ENOUGH = 2
#: log-likelihood ratio (chi-squared scale) that a piece needs
LEAST_RATIO = 22.0
#: a pure piece is so many times as frequent in toxic documents as in ordinary ones
PURE = 20
#: gains of a document that the calibration looks at
TOP = 4
FOLDS = 5

#: both dictionaries end with it and TRAIL, and every window starts with it: such a window always compresses, so none is stored raw
LEAD = b"\x01\x02\x03\x04\x05\x06\x07\x08\x0e\x0f\x10\x11\x12\x13\x14\x15\x16\x17\x18\x19"
#: every window ends with it, as zstandard looks for no match in the last bytes
TRAIL = b"\x1a\x1b\x1c\x1d\x1e\x1f\x7f\x00\x1a\x1c\x1e\x7f"
PARAMETERS = dict(window_log=16, hash_log=13, chain_log=13, search_log=4, min_match=4, strategy=zstandard.STRATEGY_DFAST, write_content_size=0, write_checksum=0, write_dict_id=0)


def held_out(doc_id) -> object:
    """Rows that nothing is learned from: crc32 of the id as text is a multiple of FOLDS. A null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(True))


def keyed(text: str) -> tuple[bytes, np.ndarray]:
    """The text in lower case (A-Z) with every byte shifted by its place in its word, and where words start.

    Equal pieces then match at the same place of a word only: ends of ordinary
    words, which are much alike, don't match the middle of others.
    """
    raw = np.frombuffer(text.encode("utf-8", "replace").lower() + b" ", np.uint8)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    at = np.arange(len(raw))
    last = np.maximum.accumulate(np.where(blank, at, -1))
    out = np.where(blank, np.uint8(32), (raw + 7 * (at - last)).astype(np.uint8))
    before = np.concatenate([[True], blank[:-1]])
    return out.tobytes(), np.flatnonzero(before & ~blank)


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    parameters = zstandard.ZstdCompressionParameters(**PARAMETERS)
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters)


@dataclass(frozen=True)
class Model:
    background: bytes
    toxic: bytes
    weights: np.ndarray

    def gains(self):
        """A function from a text to the bytes each window saves with the toxic dictionary."""
        plain, toxic = (_compressor(c + TRAIL + LEAD).compress for c in (self.background, self.background + self.toxic + b" "))

        def of(text: str) -> np.ndarray:
            line, starts = keyed(text)
            cuts = [*starts[::WINDOW_WORDS].tolist(), len(line)]
            windows = [LEAD + b" " + line[a:b] + TRAIL for a, b in zip(cuts, cuts[1:])]
            return np.fromiter((len(plain(w)) - len(toxic(w)) for w in windows), np.int64, len(windows))

        return of


def features(gains: np.ndarray) -> np.ndarray:
    """One, the largest gains, and how many windows there are."""
    top = np.zeros(TOP)
    best = np.sort(gains)[::-1][:TOP]
    top[: len(best)] = np.maximum(best, 0)
    return np.array([1.0, *np.minimum(top, 24), np.minimum(top, 24).sum(), np.log1p(len(gains))])


def _starts():
    """The pieces of a word: its starts, and the whole with its end."""
    starts = F.array(*[F.when(F.length("word") >= n, F.substring("word", 1, n)) for n in (3, 4, 5, 6, 7, 8, 10, 12)], F.concat("word", F.lit(" ")))
    return F.array_distinct(F.array_compact(starts))


def _piece_table(words: DataFrame, n_toxic: int, n_plain: int) -> DataFrame:
    """(piece, gain, pure): starts of words that toxic documents have more often, by a log-likelihood ratio.

    Those that ordinary documents have too, if less often, aren't pure.
    """
    pieces = words.select(F.explode(_starts()).alias("piece"), "toxic", "n")
    counts = pieces.groupBy("piece").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("p"))
    t, p, all_t, all_p = F.col("t"), F.col("p"), float(n_toxic + 1), float(n_plain + 1)
    expected_t, expected_p = (t + p) * (all_t / (all_t + all_p)), (t + p) * (all_p / (all_t + all_p))
    ratio = 2 * (t * F.log(t / expected_t) + F.when(p > 0, p * F.log(p / expected_p)).otherwise(0.0))
    return counts.filter("t >= 3").withColumn("gain", ratio).filter((F.col("gain") > LEAST_RATIO) & (t * all_p > 2 * p * all_t)).select("piece", "gain", "p", (t * all_p > PURE * p * all_t).alias("pure"))


def _stems(pieces: list, holders: list[list[int]], n_toxic: int, n_plain: int) -> list[str]:
    """Greedy choice of pure pieces that explain the toxic documents (each a list of places in ``pieces``).

    A document counts until it holds ENOUGH chosen pieces. What copies of one
    document have in common beside its toxic words is thus not taken for toxic.
    """
    at = {i for i, r in enumerate(pieces) if r["pure"]}
    by_piece: dict[int, list[int]] = {i: [] for i in at}
    for d, held in enumerate(holders):
        for i in held:
            if i in at:
                by_piece[i].append(d)
    rate = n_toxic / max(1, n_toxic + n_plain)
    need, open_ = np.full(len(holders), ENOUGH), {i: np.array(d) for i, d in by_piece.items()}
    out: list[str] = []
    while open_:
        worth = {}
        for i, docs in open_.items():
            t, p = int((need[docs] > 0).sum()), pieces[i]["p"]
            worth[i] = (2 * t * np.log(max(t, 1) / max(rate * (t + p), 1e-9)) - 4 * p, len(pieces[i]["piece"])) if t >= 3 else (0.0, 0)
        best = max(worth, key=lambda i: (round(worth[i][0], 6), worth[i][1], pieces[i]["piece"]))
        if worth[best][0] < LEAST_RATIO:
            break
        need[open_.pop(best)] -= 1
        piece = pieces[best]["piece"]
        out.append(piece)
        # parts and continuations of a chosen piece explain the same words
        open_ = {i: d for i, d in open_.items() if worth[i][0] > 0 and not (pieces[i]["piece"].startswith(piece.strip()) or piece.startswith(pieces[i]["piece"]))}
    return out


def _dictionary(pieces: list[tuple[str, float]]) -> bytes:
    """Pieces by rising gain, as zstandard reaches the end of a dictionary most cheaply; those inside a better one are left out."""
    chosen: list[str] = []
    for piece, _ in sorted(pieces, key=lambda x: (-round(x[1]), -len(x[0]), x[0])):
        if not any((" " + piece) in other for other in chosen):
            chosen.append(" " + piece)
    return b"".join(b" " + keyed(piece)[0][: None if piece.endswith(" ") else -1] for piece in (c[1:] for c in reversed(chosen)))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Learns from at most ``sample_docs`` labelled documents of each class that aren't held out."""
    marked = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.col(label_col)).cast("int").alias("toxic"))
    marked = marked.withColumn("h", F.xxhash64(F.lit(29), "doc_id"))
    labelled = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    picked = [marked.filter(F.col("toxic") == y).orderBy("h", "doc_id").limit(sample_docs) for y in (0, 1)]
    sample = checkpointed(picked[0].unionByName(picked[1]))  # at most 2 * sample_docs ids
    rows = id_and_text(docs, id_col, text_col).join(F.broadcast(sample), "doc_id").select("toxic", "text", (F.pmod("h", F.lit(3)) == 0).alias("calibrates"))
    rows = checkpointed(rows.dropDuplicates(["text"]).withColumn("row", F.monotonically_increasing_id()))
    train = rows.filter("not calibrates").withColumn("words", F.array_distinct(F.array_remove(F.split(ascii_lower(F.col("text")), r"[\x20\x09-\x0D]+"), "")))
    sizes = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    n_toxic, n_plain = sizes.get(1, 0), sizes.get(0, 0)
    words = checkpointed(train.select("toxic", F.explode("words").alias("word")).groupBy("toxic", "word").agg(F.count("*").alias("n")))
    best = _piece_table(words, n_toxic, n_plain).orderBy(F.desc("gain"), "piece").limit(PIECES).collect()
    places = train.sparkSession.createDataFrame([(r["piece"], i) for i, r in enumerate(best)], "piece string, i int")
    held = train.filter("toxic = 1").select("row", F.explode("words").alias("word")).select("row", F.explode(_starts()).alias("piece"))
    held = held.join(F.broadcast(places), "piece").groupBy("row").agg(F.collect_set("i").alias("i"))  # at most sample_docs rows
    stems = _stems(best, [r["i"] for r in held.orderBy("row").collect()], n_toxic, n_plain)
    toxic = _dictionary([(r["piece"], r["gain"]) for r in best if r["pure"] and r["piece"].startswith(tuple(x.strip() for x in stems))])
    shared = _dictionary([(r["piece"], r["gain"]) for r in best if not r["pure"]])
    # windows of ordinary text, a few from every ordinary document
    plain = train.filter("toxic = 0").select(F.slice(F.split(ascii_lower(F.col("text")), r"[\x20\x09-\x0D]+"), F.expr("1 + cast(pmod(xxhash64(text), greatest(1, size(words) - 40)) as int)"), F.lit(40)).alias("w"))
    samples = [keyed(" ".join(r["w"]))[0] for r in plain.select("w").collect()]  # at most sample_docs short windows
    model = Model(_background(samples) + shared + b" ", toxic, np.zeros(0))
    x, y = _calibration(rows.filter("calibrates"), model)
    weights = _logistic(x, y)
    if 0 < y.sum() < len(y):  # the sample holds other shares of the classes than the labels do
        weights[0] += np.log(labelled[1] / labelled[0]) - np.log(y.sum() / (len(y) - y.sum()))
    return Model(model.background, toxic, weights)


def _background(samples: list[bytes]) -> bytes:
    if sum(map(len, samples)) < 16 * BACKGROUND_BYTES:  # too few for the trainer
        return (b" ".join(samples)[:BACKGROUND_BYTES] or b" ").ljust(8)
    return zstandard.train_dictionary(BACKGROUND_BYTES, samples).as_bytes()


def _calibration(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the calibrating documents: a few numbers for each."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        gains = model.gains()
        found = [features(gains(t)).tolist() for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], names=["toxic", "x"])

    read = rows.select("toxic", "text").mapInArrow(batches_of(run), "toxic int, x array<double>").collect()
    return np.array([r["x"] for r in read]).reshape(len(read), TOP + 3), np.array([r["toxic"] for r in read], float)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> np.ndarray:
    """Newton steps; without two classes, the share of toxic labels decides."""
    w = np.zeros(x.shape[1])
    if len(set(y.tolist())) < 2:
        w[0] = 5.0 if len(y) and y[0] == 1 else -5.0
        return w
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(model: Model):
    """A function from a text column to a column of scores."""

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        gains = model.gains()
        x = np.array([features(gains(t)) for t in texts]).reshape(len(texts), TOP + 3)
        return pd.Series(1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30))))

    return lambda text: of(F.coalesce(text.cast("string"), F.lit("")))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Learns from the labelled rows that aren't held out and scores every document.

    Returns a row per input row: doc_id, held_out, score (0 to 1), predicted (1
    from 0.5 on). A null text equals an empty one, which has no windows and
    gets the calibration's base score. Repeated rows and null ids are scored
    like others. Without labels of both classes the only class there is (or
    0) is predicted.
    """
    small_batches(docs.sparkSession)
    out = docs.select(F.col(id_col).alias("doc_id"), score(learn(docs, labels, id_col, text_col, label_col))(F.col(text_col)).alias("score"))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
