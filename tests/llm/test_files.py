"""Token files, mixing, packing, vectors, the pipeline."""

import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gradus.llm import mixing, packing, token_files, tokens, vectors
from gradus.llm.common import shared_folder

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def encoded(text, end):
    return np.array([*Tokenizer.from_file(TOKENIZER).encode(text or "", add_special_tokens=False).ids, end], "<u4")


@settings(max_examples=25, deadline=None)
@given(st.sets(st.integers(-(2**63), 2**63 - 1), max_size=300))
def test_perfect_hash_is_minimal(keys):
    keys = np.array(sorted(keys), np.int64)
    index, slots = token_files.PerfectHash.of(keys)
    assert sorted(slots.tolist()) == list(range(len(keys))) and (index.find(keys) == slots).all()


def test_token_files_round_trip(spark, odd, odd_rows):
    path = shared_folder(spark, "token-files-test")
    token_files.write(odd, path, TOKENIZER, 2, parts=3, block_ids=3000)
    ordered = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0))
    want, at, by_text = Counter(), 0, {}
    for r in ordered:
        ids = by_text.setdefault(r[1], encoded(r[1], 2))
        want[(r[0], len(ids), zlib.crc32(ids.tobytes()))] += 1
        at += len(ids)
    got = token_files.read(spark, path).orderBy("start").collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert [r["doc_id"] for r in got] == [r[0] for r in ordered]
    assert [r["start"] for r in got] == np.cumsum([0, *[r["n_tokens"] for r in got]])[:-1].tolist()
    asked = token_files.lookup(spark.createDataFrame([(3,), (9,), (777,), (None,)], "doc_id long"), path).collect()
    assert Counter(r["doc_id"] for r in asked) == {3: 2, 9: 1}
    assert all(r["ids"] == by_text[dict((x[0], x[1]) for x in odd_rows)[r["doc_id"]]].tobytes() for r in asked)


def test_token_files_of_nothing(nothing):
    assert token_files.encode_and_read(nothing, TOKENIZER, 2).count() == 0


def test_targets_stop_at_the_cap():
    got = mixing.targets([100, 10, 0, 50], [3, 1, 2, 3], 1.5, 2.0)
    assert got[1] == 20 and got[2] == 0 and abs(sum(got) - 240) < 1e-9 and got[3] == 100 and got[0] == 120


def test_splitting_tree_deals_all(rng=np.random.default_rng(1)):
    quota = rng.integers(0, 40, 9)
    leaves = mixing.split_node(quota, 0, 13, 5)
    assert [x[:2] for x in leaves] == [(i, i + 1) for i in range(13)] and (sum(x[2] for x in leaves) == quota).all()
    totals = [int(x[2].sum()) for x in leaves]
    assert max(totals) - min(totals) <= 13


def test_mix_comes_near_its_targets(small, small_rows):
    whole = mixing.mix(small, shard_words=8000, keep=True)
    rows = whole.rows.collect()
    size = defaultdict(int)
    for _, t, s in small_rows:
        size[s] += len((t or "").split())
    names = sorted(size)
    goal = dict(zip(names, mixing.targets([size[s] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5, 2.0)))
    source, taken, largest = {i: s for i, _, s in small_rows}, defaultdict(int), defaultdict(int)
    for r in rows:
        s = source[r["doc_id"]]
        assert r["source_size"] == size[s] and abs(r["target"] - goal[s]) < 1e-6 and r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    assert all(abs(taken[s] - goal[s]) <= largest[s] / 2 + 1 for s in names)
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(small.repartition(5), shard_words=8000).rows.collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}
    copies = whole.shuffled().collect()
    count = Counter(r["kept"]["doc_id"] for r in copies)
    assert all(count[r["doc_id"]] * r["size"] == r["taken"] for r in rows) and whole.shards > 1
    assert len({r["shard"] for r in copies}) > 1 and all(r["kept"]["text"] is not None for r in copies)


def test_mix_of_odd_rows(odd, odd_rows, nothing):
    rows = mixing.mix(odd).rows.collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in odd_rows)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows) and mixing.mix(nothing).rows.count() == 0
    assert sum(r["size"] for r in rows) == sum(len((r[1] or "").encode().split()) for r in odd_rows)


def check_packing(rows, texts):
    by_text, want = {}, Counter()
    for doc_id, text in texts:
        ids = by_text.setdefault(text, encoded(text, 0))
        for p in range(0, len(ids), 2048):
            part = ids[p : p + 2048]
            want[(doc_id, p // 2048, p, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in bins.values():
        spans.sort()
        assert [s[0] for s in spans] == np.cumsum([0, *[s[1] for s in spans]])[:-1].tolist() and sum(s[1] for s in spans) <= 2048
    return len(bins), -(-sum(k[3] * n for k, n in want.items()) // 2048)


def test_packing(small, small_rows, odd, odd_rows, nothing):
    used, least = check_packing(packing.pack(small, TOKENIZER, group_pieces=60).collect(), [r[:2] for r in small_rows])
    assert used <= 1.03 * least + 1
    check_packing(packing.pack(odd, TOKENIZER).collect(), [r[:2] for r in odd_rows])
    assert packing.pack(nothing, TOKENIZER).count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(1, 99), min_size=1, max_size=60), st.integers(0, 1000))
def test_evolution_keeps_every_piece(lengths, seed):
    best = packing.evolve(lengths, 100, seed, [[[i] for i in range(len(lengths))]], generations=6)
    assert sorted(i for items in best.items for i in items) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in items) + room == 100 for items, room in zip(best.items, best.free))
    plain = packing.best_fit(lengths, sorted(range(len(lengths)), key=lambda i: -lengths[i]), 100)
    assert len(best.items) <= len(plain.items)


def vector_rows(rng):
    centres = rng.standard_normal((30, 16))
    near = [c + 0.05 * rng.standard_normal(16) for c in centres for _ in range(8)]
    rows = [(i, [float(x) for x in v.astype(np.float32)], i % 3) for i, v in enumerate([*near, *rng.standard_normal((80, 16))])]
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [], 0), (n + 2, [0.0] * 16, 0), (n + 3, [1.0] * 15 + [float("nan")], 0), (n + 4, [1.0] * 15 + [None], 0), (n + 5, [float("inf")] * 16, 0)]
    rows += [(n + 6, rows[3][1], 0), (n + 7, [2 * x for x in rows[3][1]], 0), (n + 8, rows[3][1][:15], 0), (n + 9, [1e30 * x for x in rows[3][1]], 1), rows[3], (None, rows[3][1], 2)]
    return rows


def test_vectors_match_brute_force(spark):
    rows = vector_rows(np.random.default_rng(3))
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if v and None not in v and np.isfinite(v).all() and any(v) else None for _, v, _ in rows]
    linked = lambda i, j: unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95
    import brute

    label = brute.components(len(rows), linked)
    want = [sum(linked(i, j) for j in range(len(rows)) if j != i) for i in range(len(rows))]
    for block in (1024, 5):
        got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, unit int").repartition(3), block_rows=block).collect()
        by = defaultdict(list)
        for r in got:
            by[r["vec_id"]].append(r)
        assert len(got) == len(rows)
        found = 0
        for i, (vec_id, _, _) in enumerate(rows):
            r = by[vec_id][0]
            assert r["n_links"] <= want[i]
            found += r["n_links"]
            if r["n_links"] == want[i] and unit[i] is not None:
                least = min(x[0] for x, c in zip(rows, label) if c == label[i] and x[0] is not None)
                assert r["component_id"] == least and r["kept"] == (vec_id == least)
            if unit[i] is None:
                assert (r["n_links"], r["component_id"], r["kept"]) == (0, vec_id, True)
        assert found >= 0.95 * sum(want)
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_tables_reach_the_recall():
    for n in (100, 10**5, 10**9):
        k, tables = vectors.table_sizes(n, 0.95, 0.97)
        assert 1 - (1 - vectors.collision(np.sqrt(0.1)) ** k) ** tables >= 0.97


def test_pipeline_stages(spark, small_rows):
    import brute

    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    kept = stages["exact_dedup"](spark, docs, "")
    last = {}
    for i, t, _ in small_rows:
        last[t] = max(i, last.get(t, -1))
    rows = kept.collect()
    assert kept.columns == docs.columns and {r["doc_id"] for r in rows} == set(last.values())
    near = stages["near_dedup"](spark, kept, "")
    left = sorted((r["doc_id"], r["text"]) for r in rows)
    shingles = [set(zip(*[t.lower().split()[k:] for k in range(5)])) or {t} for _, t in left]
    likeness = lambda i, j: len(shingles[i] & shingles[j]) / len(shingles[i] | shingles[j])
    ids, stays = [i for i, _ in left], {r["doc_id"] for r in near.collect()}
    alike = brute.components(len(ids), lambda i, j: likeness(i, j) > 0.3)
    assert near.columns == docs.columns and all(i in stays for k, i in enumerate(ids) if alike.count(alike[k]) == 1)
    pairs = [(i, j) for i in range(len(ids)) for j in range(i) if likeness(i, j) >= 0.9]
    assert sum(ids[i] in stays and ids[j] in stays for i, j in pairs) <= 0.2 * len(pairs)
    mixed = stages["mixing"](spark, near, "")
    assert mixed.columns == docs.columns and max(Counter(r["doc_id"] for r in mixed.collect()).values()) <= 2
    clean = stages["toxicity"](spark, docs, "/root/testdata/sf0.001")
    assert clean.columns == docs.columns and 0.7 * 200 <= clean.count() <= 200
    assert os.path.isdir("/root/testdata/sf0.001")


def test_pipeline_of_odd_rows(spark, odd, odd_rows, nothing):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    for name in ("exact_dedup", "near_dedup", "mixing"):
        out = stages[name](spark, odd, "")
        assert out.columns == odd.columns and 0 < out.count() <= 2 * len(odd_rows)
        assert stages[name](spark, nothing, "").count() == 0
    random.seed(0)


def test_letter_runs_are_encoded_as_in_whole_texts(monkeypatch):
    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(3)
    whole = tokens._tokenizer(path)
    signs = "abzéßüÿµ́'.,<|>1 9­ÉÅ\n"
    texts = ["École straße ŷou", "it's WE'LL don't", "<|endoftext|>abc a<|b", "ªbc þorn ÷x", "", None, "日本語 ünï😀x", "ﬁ ǆ"]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(500)]
    ids, stops = tokens.WordTokenizer(path).encode(pa.array(texts), 7)
    assert [x.tolist() for x in np.split(ids, stops[:-1])] == [[*whole.encode(t or "", add_special_tokens=False).ids, 7] for t in texts]
    seen = []
    words = tokens.WordTokenizer(path)

    class Counting:
        model = whole.model

        def encode(self, pieces, **options):
            seen.extend(pieces)
            return whole.encode(pieces, **options)

    monkeypatch.setattr(words, "tokenizer", Counting())
    words.encode(pa.array(["plain wörds, run straße 12"]), 7)
    assert not {"plain", "wörds", "run", "straße"} & set(seen) and "12" in seen
