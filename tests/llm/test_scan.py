"""Toxicity, licenses, secrets, language model."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from brute import words

from gradus.llm import language_model, licenses, queries, secret_scan, toxicity

KINDS = ("assign", "access", "hex")
ANY = "".join(f"[{c}{c.upper()}]" for c in "password"), "".join(f"[{c}{c.upper()}]" for c in "passwd"), "".join(f"[{c}{c.upper()}]" for c in "secret"), "".join(f"[{c}{c.upper()}]" for c in "token")
ASSIGN = re.compile("(" + "|".join(ANY) + r"""|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_line(text):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans)), spans


def test_secrets_of_planted_texts(spark):
    rng = random.Random(3)
    plain = "the quick answer of every honest person who reads the morning paper " * 6
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    token = ["".join(rng.choice(alphabet) for _ in range(44)) for _ in range(40)]
    texts = [plain + " " + t for t in token] + [plain + " internationalisationalities " + "e" * 30] * 3
    texts += ["\U0001F600 Password: token=abcdefghijklmnop and secret=token:abcdefghijklmn", "AKIAABCDEFGHIJKLMN akia AKIASHORT", "PASSWORD='0123456789abcdef0123'", "paſſword=abcdefghijklmnop api_Key=abcdefghijklmnop", None, "", "deadbeefdeadbeef" * 3]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in secret_scan.secret_scan(rows, rate=0.05).collect()}
    for i, t in enumerate(texts):
        line, spans = base_line(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in KINDS] == [sum(s[1] == j for s in spans) for j in range(3)]
        assert set(filter(None, line.split(","))) <= set(got[i]["spans"].split(","))
    found = [i for i in range(40) if any(f"random:{texts[i].index(token[i])}:" in s for s in got[i]["spans"].split(","))]
    assert len(found) >= 36
    assert not any("random" in got[i]["spans"] for i in range(40, 43))


@pytest.mark.parametrize("keys", [40, 2])
def test_keys_are_found_at_the_production_rate(spark, keys):
    rng = random.Random(9)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    token = ["".join(rng.choice(alphabet) for _ in range(44)) for _ in range(keys)]
    texts = [f"{words(rng, 4000)} {token[i] if i < keys else 'see/the/morning/paper/and/the/daily/news'} {words(rng, 2000)}" for i in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in secret_scan.secret_scan(rows).collect()}
    assert sum(f"random:{texts[i].index(t)}:" in got[i] for i, t in enumerate(token)) >= 0.9 * keys
    assert not any("random" in got[i] for i in range(keys, 60))


def test_randomness_separates(rng=np.random.default_rng(2)):
    hexes = np.frombuffer(b"0123456789abcdef", np.uint8)[rng.integers(0, 16, (300, 40))].astype(np.int64)
    text = np.frombuffer(b"theanswerofeveryhonestpersonwhoreadsthemorningpaperandthenewsoftheday", np.uint8).astype(np.int64)
    plain = np.stack([text[i : i + 40] for i in range(25)])
    assert np.median(secret_scan.randomness(hexes)) > secret_scan.randomness(plain).max()


def test_secrets_and_licenses_of_odd_rows(odd, odd_rows, nothing):
    assert Counter(r["doc_id"] for r in secret_scan.secret_scan(odd).collect()) == Counter(r[0] for r in odd_rows)
    assert Counter(r["doc_id"] for r in licenses.license_scan(odd).collect()) == Counter(r[0] for r in odd_rows)
    assert secret_scan.secret_scan(nothing).count() == 0 and licenses.license_scan(nothing).count() == 0


def test_license_scan_matches_sql_and_allows_gaps(spark):
    texts = [
        None, "", "...", "MIT License", "the mit-license; MIT license mit", "Licensed under CC BY-NC 4.0.", "GNU general\npublic LICENSE, gnu general public license", "apache licence",
        "Redistribution and use in source and in binary forms, with or without modification are permitted provided that the following conditions are met",
        "Permission is hereby granted free of any charge to any person obtaining a copy of this software", "K mit İlicense", "mit license " * 50, "of the terms of the",
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "MIT License"), (None, "cc by")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    cols = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    want = Counter(con.execute(f"SELECT {', '.join(cols)} FROM ({queries.SQL['op7_license_scan']})").fetchall())
    found = licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).select(*cols).collect()
    assert Counter(tuple(r) for r in found) == want
    by = {r["doc_id"]: r for r in found}
    assert by[8]["labels"] == "bsd" and by[8]["n_base"] == 0 and by[5]["labels"] == "cc-by,cc-by-nc" and by[11]["n_base"] == 50 and by[4]["n_base"] == 2


@pytest.fixture(scope="module")
def marked(spark):
    """Toxic documents hold two or more of some invented words, others at most one of them."""
    rng = random.Random(6)
    bad, rows, labels = ["grobnik", "zarfum", "quellox", "mudwort"], [], []
    for i in range(900):
        toxic = i % 4 == 0
        text = words(rng, rng.randint(30, 200)).split()
        for _ in range(rng.randint(2, 5) if toxic else int(rng.random() < 0.05)):
            text.insert(rng.randrange(len(text)), rng.choice(bad))
        rows.append((i, " ".join(text)))
        if i % 5:
            labels.append((i, 0, int(toxic)))
    schema = "doc_id long, text string"
    return spark.createDataFrame(rows, schema).repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(marked):
    docs, labels = marked
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 900 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    right = [r["predicted"] == (r["doc_id"] % 4 == 0) for r in got if r["held_out"]]
    assert len(right) > 100 and sum(right) >= 0.95 * len(right)


def test_toxicity_of_odd_rows(spark, odd, odd_rows, nothing):
    labels = spark.createDataFrame([(3, 1), (7, 0), (3, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(odd, labels).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in odd_rows) and all(0 <= r["score"] <= 1 for r in got)
    none = toxicity.toxicity(odd, labels.filter("false")).collect()
    assert len(none) == len(odd_rows) and not any(r["predicted"] for r in none)
    assert toxicity.toxicity(nothing, labels).count() == 0


def test_class_table_is_normalised():
    rng = np.random.default_rng(0)
    p = language_model.Parameters.start(rng.random(language_model.CLASSES) + 0.01)
    again = language_model.Parameters.of(np.frombuffer(p.to_bytes(), "<f4"))
    assert np.allclose((10 ** again.log10_table()[[0, 7, 200]].astype(float)).sum(2), 1, atol=1e-4)


def base_scores(rows):
    cut = lambda t: [w.decode() for w in (t or "").encode().lower().split()] + ["\n"]
    learns = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 != 2
    counts = Counter(w for i, t in rows if learns(i) for w in cut(t))
    n, v = sum(counts.values()), len(counts)
    return n, [(i, not learns(i), len(cut(t)), sum(counts[w] > 0 for w in cut(t)), sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in cut(t))) for i, t in rows]


@pytest.mark.parametrize("head", [50_000, 40])
def test_base_scores_and_held_out_gain(small, small_rows, head):
    n, want = base_scores([(i, t) for i, t, _ in small_rows])
    got = {r["doc_id"]: r for r in language_model.score_documents(small, head=head).collect()}
    for i, held, tokens, known, base in want:
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, tokens, known, n) and math.isclose(r["base_score"], base, rel_tol=1e-9)
        assert r["score"] < 0
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_scores_of_odd_rows(odd, odd_rows, nothing):
    n, want = base_scores([(r[0], r[1]) for r in odd_rows])
    got = Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in language_model.score_documents(odd).collect())
    assert got == Counter((i, h, t, k, round(b, 4)) for i, h, t, k, b in want)
    assert language_model.score_documents(nothing).count() == 0
