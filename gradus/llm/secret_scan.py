"""Secrets: fixed patterns, and a battery of randomness tests under false-discovery control.

Any run of 16 or more characters of the usual encodings is a candidate. Its
encoding is the smallest known alphabet that holds all its characters. Three
tests ask whether it looks drawn at random from that alphabet: chi-squared
uniformity, runs of character classes and serial correlation. Their sum is
compared with that of ordinary text: the letters outside of base spans and
candidates, cut into strings of each length class from end to end, are the
null distribution, which so grows with the text. The p-values that this gives
are put through the Benjamini-Hochberg rule inside each length class, over all
documents; so short candidates, which tell little, need a better score.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.llm.common import batches_of, id_and_text, small_batches, stored

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
#: lower ends of the length classes
LENGTHS = (16, 20, 24, 32, 48)
ALPHABETS = ("0123456789", "0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdefghijklmnopqrstuvwxyz", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/-_=")
#: scores are counted in steps of 1 / BINS, from LOW on
BINS, LOW = 10, -60
FALSE_DISCOVERIES = 0.01


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, leftmost and not overlapping within a kind."""
    lower, out = text.lower(), []
    if any(w in lower for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _tables():
    member, place, classes = np.zeros((len(ALPHABETS), 256), bool), np.zeros((len(ALPHABETS), 256)), np.zeros(256, np.int64)
    for i, a in enumerate(ALPHABETS):
        codes = np.frombuffer(a.encode(), np.uint8)
        member[i, codes], place[i, codes] = True, np.arange(len(a))
    for c, chars in enumerate(("01234", "56789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "+/-_=")):
        classes[np.frombuffer(chars.encode(), np.uint8)] = c
    return member, place, classes


MEMBER, PLACE, CLASSES = _tables()


def randomness(codes: np.ndarray) -> np.ndarray:
    """For equally long strings (rows of ASCII codes): minus the summed excess of the three tests; near zero is random."""
    m, n = codes.shape
    fits = MEMBER[:, codes].all(2)  # alphabets by strings
    which = np.where(fits.any(0), fits.argmax(0), len(ALPHABETS) - 1)
    out = np.empty(m)
    for a in np.unique(which):
        rows = codes[which == a]
        k, base = len(ALPHABETS[a]), np.arange(len(rows))[:, None] * 256
        counts = np.bincount((rows + base).ravel(), minlength=256 * len(rows)).reshape(-1, 256)
        chi = (counts.astype(float) ** 2).sum(1) * k / n - n
        uniform = np.maximum(0, (chi - (k - 1)) / np.sqrt(2 * (k - 1)))
        kind = CLASSES[rows] // 2 if a else CLASSES[rows]  # letters against digits; among digits, low against high
        kind = np.where(CLASSES[rows] < 2, kind, CLASSES[rows])
        own = CLASSES[np.frombuffer(ALPHABETS[a].encode(), np.uint8)]
        own = own if a == 0 else np.where(own < 2, 0, own)
        change = 1 - ((np.bincount(own) / k) ** 2).sum()
        runs = np.abs((kind[:, 1:] != kind[:, :-1]).sum(1) - (n - 1) * change) / np.sqrt((n - 1) * change * (1 - change))
        x = PLACE[a][rows] - (k - 1) / 2
        serial = np.abs((x[:, 1:] * x[:, :-1]).sum(1)) / ((k * k - 1) / 12) / np.sqrt(n - 1)
        out[which == a] = -(uniform + runs + serial)
    return out


def _bin(scores: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((scores - LOW) * BINS), 0, -LOW * BINS).astype(np.int32)


def _class(n: int) -> int:
    return int(np.searchsorted(LENGTHS, n, side="right")) - 1


_LETTERS = bytes(range(256)), bytes(i for i in range(256) if not (65 <= i <= 90 or 97 <= i <= 122))


def binned(codes: np.ndarray, rows: int = 4096) -> np.ndarray:
    """Score bins of equally long strings, a part at a time."""
    return np.concatenate([_bin(randomness(codes[at : at + rows].astype(np.int64))) for at in range(0, len(codes), rows)])


def scan_text(text: str) -> tuple[list, list, list]:
    """Base spans, candidates outside of them as (start, end, class, codes), and the null strings by class (rows of codes)."""
    base = base_spans(text)
    found, cut, plain = [], [(a, b) for a, _, b in base], []
    for m in CANDIDATE.finditer(text):
        cut.append(m.span())
        if not any(a < m.end() and m.start() < b for a, _, b in base):
            found.append((m.start(), m.end(), _class(m.end() - m.start()), np.frombuffer(m[0].encode(), np.uint8)))
    at = 0
    for a, b in sorted(cut):
        plain.append(text[at:a])
        at = max(at, b)
    letters = np.frombuffer("".join([*plain, text[at:]]).encode("utf-8", "replace").translate(*_LETTERS), np.uint8)
    null = [(c, letters[: len(letters) // n * n].reshape(-1, n)) for c, n in enumerate(LENGTHS)]
    return base, found, null


SCAN = "doc_id {}, base array<struct<start:int,kind:int,end:int>>, found array<struct<start:int,end:int,class:int,bin:int>>, null_bins array<struct<class:int,bin:int,n:long>>"


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: base spans and scored candidates; the first of a batch has the counts of its scored null strings."""
    small_batches(docs.sparkSession)
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
    one = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("class", pa.int32()), ("bin", pa.int32())])
    two = pa.struct([("class", pa.int32()), ("bin", pa.int32()), ("n", pa.int64())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        read = [scan_text(t) for t in batch.column(1).to_pylist()]
        strings = [c[3] for _, found, _ in read for c in found]
        bins = np.zeros(len(strings), np.int32)
        lengths = np.array([len(s) for s in strings])
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            bins[at] = binned(np.stack([strings[i] for i in at]))
        scored = iter(bins.tolist())
        base = [[{"start": a, "kind": k, "end": b} for a, k, b in spans] for spans, _, _ in read]
        found = [[{"start": a, "end": b, "class": c, "bin": next(scored)} for a, b, c, _ in each] for _, each, _ in read]
        null = [[] for _ in read]
        for c in range(len(LENGTHS)):
            windows = [each[c][1] for _, _, each in read if len(each[c][1])]
            if windows:
                bins, n = np.unique(binned(np.concatenate(windows)), return_counts=True)
                null[0] += [{"class": c, "bin": b, "n": k} for b, k in zip(bins.tolist(), n.tolist())]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, pa.list_(span)), pa.array(found, pa.list_(one)), pa.array(null, pa.list_(two))], names=["doc_id", "base", "found", "null_bins"])

    rows = id_and_text(docs, id_col, text_col)
    return rows.mapInArrow(batches_of(run), SCAN.format(rows.schema["doc_id"].dataType.simpleString()))


def thresholds(null: np.ndarray, found: np.ndarray, rate: float) -> list[int]:
    """By length class, the least score bin of a discovery at this false-discovery rate (one above all bins if none)."""
    out = []
    for no, yes in zip(null, found):
        p = (no[::-1].cumsum()[::-1] + 1) / (no.sum() + 1)  # share of ordinary strings that score as high
        above = yes[::-1].cumsum()[::-1]  # candidates that are discoveries if the bin is the least
        good = np.flatnonzero((above > 0) & (p * yes.sum() <= rate * above))
        out.append(int(good[0]) if len(good) else len(no))
    return out


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """Secrets of every document.

    Returns a row per input row: doc_id, n_assign, n_access, n_hex, base_sha256
    (of the base spans as kind:start:end, joined by commas), spans (all spans
    likewise, those of kind ``random`` added by the tests), secrets (the spans
    as structs). Starts and ends are code points, ends exclusive. A null text
    equals an empty one and has no spans. Repeated rows give repeated rows.
    """
    read = stored(scanned(docs, id_col, text_col), "secret-scan")
    n = -LOW * BINS + 1
    table = np.zeros((2, len(LENGTHS), n), np.int64)
    counted = read.select(F.explode("found").alias("x")).select(F.lit(1).alias("of"), "x.class", "x.bin", F.lit(1).cast("long").alias("n")).unionByName(
        read.select(F.explode("null_bins").alias("x")).select(F.lit(0).alias("of"), "x.class", "x.bin", "x.n"))
    for r in counted.groupBy("of", "class", "bin").agg(F.sum("n").alias("n")).collect():  # at most 2 * classes * bins rows
        table[r["of"], r["class"], r["bin"]] = r["n"]
    least = F.array(*[F.lit(t) for t in thresholds(table[0], table[1], rate)])
    random = F.transform(F.filter("found", lambda x: x["bin"] >= F.get(least, x["class"])), lambda x: F.struct(x["start"], F.lit(KINDS.index("random")).alias("kind"), x["end"]))
    names = F.array(*[F.lit(k) for k in KINDS])
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    out = read.withColumn("secrets", F.sort_array(F.concat("base", random)))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return out.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])], F.sha2(line(F.col("base")), 256).alias("base_sha256"),
        line(F.col("secrets")).alias("spans"), "secrets",
    )
