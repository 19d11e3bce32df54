"""Exact and near duplicates of texts, connected components, hot keys."""

import hashlib
import random
from collections import Counter

import brute
import corpus_pipeline
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from gradus.llm import exact, minhash, queries, simhash
from gradus.llm.common import join_groups, without
from gradus.llm.components import connected_components


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**64 - 1) | st.sampled_from([0, 1, 2**64 - 1, 2**48]), min_size=1), min_size=1, max_size=4))
def test_filters_merge_losslessly(parts):
    filters = [exact.CountingQuotientFilter.of(np.array(p, np.uint64)) for p in parts]
    whole = exact.CountingQuotientFilter.merged(filters)
    want = Counter(x for p in parts for x in p)
    assert dict(zip(whole.fingerprints().tolist(), whole.counts.tolist())) == want
    assert all(whole.count(x) == n for x, n in want.items()) and whole.count(12345) == want.get(12345, 0)
    again = [s for s in whole.slices(16)]
    assert sum(len(s.remainders) for s in again) == len(want)
    assert sorted(x for s in again for x in s.fingerprints().tolist()) == sorted(want)


def test_exact_duplicates_of_odd_rows(odd, odd_rows):
    got = Counter(tuple(r) for r in exact.exact_duplicates(odd).collect())
    want = Counter()
    for doc_id, text, *_ in odd_rows:
        same = [r[0] for r in odd_rows if (r[1] or "") == (text or "")]
        known = [i for i in same if i is not None]
        keep = (max(known) if known else None) if len(same) > 1 else doc_id
        want[(doc_id, keep, len(same), doc_id == keep, hashlib.sha256((text or "").encode()).hexdigest())] += 1
    assert got == want


def test_exact_duplicates_match_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    cols = "doc_id, keep_id, group_size, kept, text_sha256"
    want = con.execute(f"SELECT {cols} FROM ({queries.SQL['op4_exact_dedup']}) ORDER BY doc_id").fetchall()
    got = queries.QUERIES["op4_exact_dedup"](spark, "/root/testdata/sf0.001").select(*cols.split(", ")).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want


def test_colliding_fingerprints_are_compared_by_bytes(spark):
    rows = spark.createDataFrame([(5,), (5,), (-1,), (7,), (-1,), (-1,)], "fp long")
    assert {tuple(r) for r in exact.repeated_fingerprints(rows, "fp", 8).collect()} == {(5, 2), (-1, 3)}


def test_near_duplicates_match_brute_force(small, small_rows):
    prints = [brute.simhash(t) for _, t, _ in small_rows]
    label = brute.components(len(prints), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    ids = [r[0] for r in small_rows]
    least = {c: min(i for i, x in zip(ids, label) if x == c) for c in set(label)}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(small).collect()}
    assert got == {i: (format(p, "016x"), least[c]) for i, p, c in zip(ids, prints, label)}


def test_near_duplicates_of_odd_rows(odd, odd_rows):
    prints = [brute.simhash(r[1]) for r in odd_rows]
    label = brute.components(len(prints), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    want = Counter()
    for r, p, c in zip(odd_rows, prints, label):
        want[(r[0], format(p, "016x"), min((x[0] for x, y in zip(odd_rows, label) if y == c and x[0] is not None), default=None))] += 1
    assert Counter(tuple(r) for r in simhash.near_duplicates(odd).collect()) == want


def test_links_by_segments_lose_none(spark):
    rng = random.Random(8)
    centres = [rng.getrandbits(64) for _ in range(12)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for c in centres for _ in range(25)}
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    rows = spark.createDataFrame([(x,) for x in fps], "fp long")
    for radius, parts in ((4, 3), (7, 4)):
        label = brute.components(len(fps), lambda i, j: ((fps[i] ^ fps[j]) & (2**64 - 1)).bit_count() <= radius)
        got = {r["fp"]: r["group"] for r in simhash.value_groups(rows, radius, parts).collect()}
        assert {frozenset(f for f in fps if got[f] == g) for g in got.values()} == {frozenset(f for f, x in zip(fps, label) if x == c) for c in label}


def test_several_fingerprints_find_what_one_finds(odd):
    one = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(odd, shingle=5, radius=7, parts=4).collect()}
    two = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(odd, shingle=5, radius=7, parts=4, prints=2).collect()}
    assert {(i, c) for i, c in two if i == c} <= {(i, c) for i, c in one if i == c}


def test_empty_tables(nothing):
    assert exact.exact_duplicates(nothing).count() == 0
    assert simhash.near_duplicates(nothing).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 60)] + [(-5, 7), (200, 201), (201, 200), (3, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(101, 141)}, **{i: -5 for i in range(7, 60)}, 201: 200}


def test_hot_keys_keep_all_rows(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else None if i % 2 else f"k{i}") for i in range(3000)], "i int, k string").repartition(4)
    sizes = rows.filter("k is not null").groupBy("k").count().withColumnRenamed("count", "size")
    got = join_groups(rows, sizes, "k", "size", 3000).collect()
    assert len(got) == 3000 and all(r["size"] == (2000 if r["k"] == "hot" else None if r["k"] is None else 1) for r in got)


def test_without_drops_by_null_safe_keys(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (None, "a"), (2, "a")], "i int, t string")
    gone = spark.createDataFrame([(1, "b"), (None, "a")], "i int, t string")
    assert sorted(map(tuple, without(rows, gone, [rows["i"], rows["t"]]).collect())) == [(1, "a"), (2, "a")]


def test_pairs_of_similarity_point_eight_are_found(spark, odd, odd_rows, nothing):
    rng = random.Random(11)
    rows = []
    for i in range(120):  # 400 words; a changed word changes five shingles, so eight give a similarity of about 0.82
        base = [f"w{rng.getrandbits(40)}" for _ in range(400)]
        far = base[:]
        for at in range(20, 400, 50 if i < 100 else 20):
            far[at] = f"x{i}"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(far))]
    crowd = [f"c{rng.getrandbits(40)}" for _ in range(300)]
    rows += [(1000 + i, " ".join(crowd[:i] + ["new"] + crowd[i + 1 :])) for i in range(100, 160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert kept >= {2 * i for i in range(120)} and sum(2 * i + 1 not in kept for i in range(100)) >= 97
    assert kept >= {2 * i + 1 for i in range(100, 120)}  # about 0.6
    assert {i for i in kept if i >= 1000} == {1100}
    assert Counter(r["doc_id"] for r in minhash.near_duplicates(odd).collect()) == Counter(r[0] for r in odd_rows)
    assert minhash.near_duplicates(nothing).count() == 0


def test_links_to_nodes_behind_a_hub_are_kept(spark):
    rng = random.Random(5)
    rows = []
    for family in range(4):  # copies of a text and looser variants of single copies, which are like these and not like a hub
        base = [f"w{rng.getrandbits(40)}" for _ in range(300)]
        copies = []
        for i in range(60):
            copies.append(base[:])
            for at in rng.sample(range(300), 2):
                copies[i][at] = f"c{rng.getrandbits(40)}"
        for parent in rng.sample(copies, 20):
            copies.append(parent[:])
            for at in rng.sample(range(300), rng.randint(5, 7)):
                copies[-1][at] = f"v{rng.getrandbits(40)}"
        rows += [(1000 * family + i, " ".join(c)) for i, c in enumerate(copies)]
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for _, t in rows]
    bands = [minhash.band_keys(np.unique(simhash.shingle_hashes(t, 5))) for _, t in rows]

    def linked(i, j):
        return len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and (bands[i] == bands[j]).any()

    label = brute.components(len(rows), linked)
    want = {r[0]: min(x[0] for x, y in zip(rows, label) if y == c) for r, c in zip(rows, label)}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()} == want


def test_turns_of_hubs_end_when_they_settle_little(spark, monkeypatch):
    rng = np.random.default_rng(3)
    common, turns = np.arange(100), []
    sets = {i: np.concatenate([common, 1000 * i + np.arange(60)]) for i in range(1, 161)}  # a similarity of 0.45
    for i in range(161, 171):
        sets[i] = np.concatenate([sets[i - 80][:-3], -1000 * i - np.arange(rng.integers(1, 4))])  # about 0.96 with one of them
    sets[171] = sets[1][:100]  # too small for a link
    rows = spark.createDataFrame([(k, n, len(s)) for k in (7, 8) for n, s in sets.items()], "key long, node long, size int")
    table = spark.createDataFrame([(n, s.tolist()) for n, s in sets.items()], "node long, shingles array<long>")
    monkeypatch.setattr(minhash, "PAIRS", 4)
    monkeypatch.setattr(minhash, "in_components", lambda *a, run=minhash.in_components: turns.append(1) or run(*a))
    assert {tuple(r) for r in minhash.similar_nodes(rows, table, 0.8).distinct().collect()} == {(i - 80, i) for i in range(161, 171)}
    assert len(turns) == 1
