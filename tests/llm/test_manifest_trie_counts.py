"""Merkle manifest, conversation trie, token counts."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import public_tokenizers
import pytest
import sentencepiece
from brute import LOWER

from gradus.llm import manifest, token_counts, trie
from gradus.llm.queries import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_conversation_trie"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.sql(SQL[name])
    got = QUERIES[name](spark, SMALL)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.select(want.columns)) == sorted(want.fetchall(), key=repr)


# --- manifest ---------------------------------------------------------------


def climb(digests, fanout):
    """(root, siblings of each node as (left, right) per level)."""
    ways, at, nodes = [[] for _ in digests], list(range(len(digests))), digests
    while len(nodes) > 1:
        for i, way in enumerate(ways):
            run = at[i] // fanout * fanout
            way.append(("".join(nodes[run : at[i]]), "".join(nodes[at[i] + 1 : run + fanout])))
            at[i] //= fanout
        nodes = [sha("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
    return nodes[0], ways


def plain_manifest(rows, fanout):
    """Of (doc_id, source, lang, n_chars, text), the results of ``documents_manifest`` with that fanout."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = defaultdict(list)
    for r in rows:
        claim = (*r[:4], r[4].translate(LOWER)) if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else r
        groups["" if r[1] is None else "=" + r[1]].append((r[0] is not None, r[0] or 0, sha("".join(map(field, r))), sha("".join(map(field, claim)))))
    names = sorted(groups, key=str.encode)
    trees = {g: climb([x[2] for x in sorted(groups[g])], fanout) for g in names}
    root, above = climb([trees[g][0] for g in names], fanout)
    out = []
    for g, more in zip(names, above):
        for (known, doc, leaf, claim), way in zip(sorted(groups[g]), trees[g][1]):
            at = claim
            for left, right in way + more:
                at = sha(left + at + right)
            out.append((doc if known else None, leaf, trees[g][0], root, sha("".join(a + b for a, b in way + more)), at, at == root))
    return sorted(out, key=repr)


def of_columns(df):
    return [tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]


def test_manifest_of_odd_rows(odd, nothing):
    want = plain_manifest(of_columns(odd), 16)
    assert rows_of(manifest.documents_manifest(odd)) == want
    assert Counter(w[-1] for w in want)[False]  # some texts with A-Z were altered
    assert manifest.documents_manifest(nothing).collect() == []


@pytest.mark.parametrize("fanout,block_levels,n", [(2, 1, 77), (2, 0, 33), (3, 2, 244), (16, 1, 300), (4, 1, 1)])
def test_butterfly_rounds_match_plain_trees(spark, fanout, block_levels, n):
    rng = random.Random(n)
    rows = [(i, rng.choice(["hot", "hot", "hot", f"s{i % 7}", None]), "en", i, f"Text {i}") for i in range(n)]
    rows.append((n, "alone", "en", 1, "x"))
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    built = manifest.build(docs, ["doc_id", "source", "lang", "n_chars", "text"], "source", "doc_id", fanout=fanout, block_levels=block_levels)
    got = rows_of(built.rows())
    want = [(*w[:5], w[3], True) for w in plain_manifest(rows, fanout)]
    assert got == want
    for r in built.rows(paths=True).collect():
        at = r["leaf"]
        for step in r["path"]:
            at = sha(step["left"] + at + step["right"])
        assert at == r["root"]
    assert built.groups().count() == len({r[1] for r in rows})


def test_any_change_breaks_the_proof(spark):
    docs = spark.createDataFrame([(i, "a", i) for i in range(50)], "doc_id long, source string, value long")
    changed = {"value": manifest.F.when(manifest.F.col("doc_id") == 7, 8).otherwise(manifest.F.col("value"))}
    got = manifest.build(docs, ["doc_id", "value"], "source", "doc_id", changed).rows()
    assert [r["doc_id"] for r in got.filter("not verified").collect()] == [7]


# --- trie -------------------------------------------------------------------


def plain_trie(sequences):
    """Nodes of {conv_id: [(role, text), ...]}."""
    members = defaultdict(list)
    for conv, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, convs in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(convs) - 1) * (len(k[-1][1].encode()) if k else 0)
    ends = lambda k: sha(",".join(map(str, sorted(c for c in members[k] if len(sequences[c]) == len(k)))))
    return sorted(((min(v), len(k), min(members[k[:-1]]) if k else None, len(v), children[k], leaves[k], saved[k], ends(k)) for k, v in members.items()), key=repr)


def plain_rebuilt(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            digest = sha(f"{len((role or '').encode())}:{role or ''}{text or ''}")[:32]
            turns[conv].append((turn is not None, turn or 0, digest, (role or "", text or "")))
    own = {c: [x[3] for x in sorted(v)] for c, v in turns.items()}
    out = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + mine[h:]
    return out


CONVERSATIONS = "conv_id long, turn long, role string, text string, head string, path string, n int, up int"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "h", "p", 1, 2) for r in rows], CONVERSATIONS).repartition(3)


@pytest.fixture(scope="module")
def talks():
    """Hot first turns, copies, beginnings of others, nulls, ties, a repeated row, a long conversation, ids without a donor."""
    rng = random.Random(5)
    rows = []
    for c in range(160):
        if c % 40 == 35:
            continue  # donors that are missing
        for t in range(rng.choice([1, 2, 3, 3, 9, 12])):
            rows.append((c, t, rng.choice(["user", "assistant"]), "start" if t == 0 and c % 3 else rng.choice(["yes", "no", "Ünï", "more " * 20, ""])))
    for c in range(200, 240):
        rows += [(c, t, "user", f"same {t}") for t in range(10)]
    rows += [(300, t, "user", str(t)) for t in range(400)]
    rows += [(301, None, None, None), (301, None, "user", "x"), (301, 1, "a", "b"), (301, 1, "a", "a"), (None, 1, "user", "nobody"), rows[0]]
    return rows


@pytest.mark.parametrize("paths,size", [(8192, 2_000_000), (3, 10**9), (1, 100)])
def test_trie_of_odd_conversations(spark, talks, paths, size):
    built = trie.rebuilt(conversations(spark, talks))
    assert rows_of(trie.prefix_trie(built, paths, size)) == plain_trie(plain_rebuilt(talks))


def test_trie_of_nothing_and_turnless_conversations(spark):
    assert trie.conversation_trie(conversations(spark, [])).collect() == []
    gone = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    rows = [(gone, 0, "user", "only turn")]
    assert rows_of(trie.conversation_trie(conversations(spark, rows))) == [(gone, 0, None, 1, 0, 1, 0, sha(str(gone)))]


def test_ids_of_one_path_pass_through_several_runs(spark, monkeypatch):
    monkeypatch.setattr(trie, "RUN_IDS", 4)
    df = spark.range(1000).select(trie.F.col("id").alias("conv_id"), trie.F.lit(bytearray(b"p" * 20)).alias("path")).repartition(7)
    got = trie.distinct_paths(df).collect()
    assert [(r["conv_id"], r["n"], r["ends"]) for r in got] == [(0, 1000, sha(",".join(map(str, range(1000)))))]


# --- token counts -----------------------------------------------------------


def library_counts(rows):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    out = []
    for doc, text in rows:
        n = len(model.encode(text or ""))
        out.append((doc, len((text or "").encode()), n, n > 4096))
    return sorted(out, key=repr)


@pytest.mark.parametrize("head", [0, 50, 1 << 18])
def test_token_counts_of_odd_rows(odd, odd_rows, nothing, head):
    got = token_counts.count_tokens(odd, MODEL, 4096, head=head)
    assert rows_of(got) == library_counts([(r[0], r[1]) for r in odd_rows])
    assert token_counts.count_tokens(nothing, MODEL, 4096).collect() == []


def test_token_counts_of_documents(spark, small_rows):
    assert rows_of(QUERIES["op13_token_counts"](spark, SMALL)) == library_counts([r[:2] for r in small_rows])


def test_parts_add_up_to_the_text():
    rng, counter, model = random.Random(6), token_counts.PieceCounter(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    signs = [" ", "  ", "▁", "a", "the", "ing", "1", "2", "\n", "\r", "\t", "\0", "é", "中", "文字", "😀", "<s>", "</s>", "<unk>", "<0x0A>", ".", "--", " ", "　"]
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 12)))
        assert sum(counter.count(counter.pre_tokens(text))) == len(model.encode(text)), repr(text)


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto.FromString(open(MODEL, "rb").read())
    model.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "other.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="byte fallback"):
        token_counts.PieceCounter(str(tmp_path / "other.model"))
