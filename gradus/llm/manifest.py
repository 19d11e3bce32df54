"""Merkle manifest of a table: a digest per row, a root per group and one for all, and a proof for every row.

Rows are cut into blocks of ``fanout ** block_levels`` consecutive leaves of a
group. A block hashes its own subtree in its task. Above that, blocks exchange
in butterflies: in round r, the up to ``fanout`` blocks that differ in digit r
of their number alone swap the roots of their subtrees, and each hashes the
common ancestor. So every block ends with its group's root and all siblings on
its way there, and nothing has to travel down again. The last subtree of a
group may have fewer blocks than the others; each of them then serves several
partners. The groups' roots climb to the root of all in the same way.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.llm.common import ascii_lower, batches_of, crc32_sql, join_groups, stored
from gradus.llm.numbering import numbered

FANOUT = 16
#: a block has FANOUT ** BLOCK_LEVELS leaves
BLOCK_LEVELS = 3


def field(value: Column) -> Column:
    """A value in a leaf: its length in UTF-8 bytes, a colon and the value; a null is a dash."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: list[Column]) -> Column:
    """The digest of a row."""
    return F.sha2(F.concat(*map(field, values)), 256)


def _digest(text: Column) -> Column:
    return F.sha2(text, 256)


@lru_cache(maxsize=64)
def _steps(n: int, fanout: int) -> int:
    """Levels above ``n`` nodes until one remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def exchange(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Rows (tree, node, nodes, digest) climb to their tree's root; adds ``path`` and makes ``digest`` the root.

    ``node`` counts from 0 inside its tree, ``nodes`` is the tree's number of
    them. ``path`` has, per level, the digests to the left and right of the way
    up. Each round is one shuffle of about as many short rows as there are nodes.
    """
    most = nodes.agg(F.max("nodes")).first()[0]
    path = "array<struct<left:string,right:string>>"
    now = nodes.withColumn("path", F.array().cast(path))
    for r in range(_steps(most or 0, fanout)):
        span = fanout**r
        climbing = F.col("nodes") > span
        subtree, low = F.floor(F.col("node") / span), F.col("node") % span
        held = F.least(F.lit(span), F.col("nodes") - subtree * span)  # nodes in the own subtree
        # the only subtree of a run has no partners, a short one at the end of a run serves those of the whole ones
        served = F.when(climbing & (subtree % fanout > 0), F.sequence(low, F.lit(span - 1).cast("long"), held)).otherwise(F.array(low))
        sent = now.select(
            "tree", F.when(climbing, F.floor(subtree / fanout)).otherwise(F.col("node")).alias("run"), climbing.alias("climbing"), F.explode(served).alias("partner"),
            F.struct((subtree % fanout).alias("digit"), "digest").alias("one"),
            F.struct("node", "nodes", "path", (subtree % fanout).alias("digit"), low.alias("low")).alias("own"),
        )
        met = sent.groupBy("tree", "climbing", "run", "partner").agg(
            F.sort_array(F.collect_list("one")).alias("ring"),  # at most ``fanout``
            F.collect_list(F.when(F.col("own.low") == F.col("partner"), F.col("own"))).alias("owns"),
        )
        alone = met.select("tree", "climbing", "ring", F.explode("owns").alias("own"))
        joined = lambda keep: F.array_join(F.transform(F.filter("ring", keep), lambda x: x["digest"]), "")
        left, right = joined(lambda x: x["digit"] < F.col("own.digit")), joined(lambda x: x["digit"] > F.col("own.digit"))
        step = F.array(F.struct(left.alias("left"), right.alias("right"))).cast(path)
        now = alone.select(
            "tree", "own.node", "own.nodes",
            F.when(F.col("climbing"), _digest(F.array_join("ring.digest", ""))).otherwise(F.col("ring")[0]["digest"]).alias("digest"),
            F.when(F.col("climbing"), F.concat("own.path", step)).otherwise(F.col("own.path")).alias("path"),
        )
    return now


def _levels(leaves: list[str], alone: bool, fanout: int, block_levels: int) -> list[list[str]]:
    """The digests of a block, from its leaves to its root; a block that is its whole tree stops at one node."""
    levels = [leaves]
    while len(levels[-1]) > 1 if alone else len(levels) <= block_levels:
        last = levels[-1]
        levels.append([hashlib.sha256("".join(last[i : i + fanout]).encode()).hexdigest() for i in range(0, len(last), fanout)])
    return levels


@dataclass(frozen=True)
class Manifest:
    """``blocks``: the leaves of each block with its way up. A digest is lowercase hex."""

    blocks: DataFrame
    key: str
    fanout: int
    block_levels: int

    def rows(self, paths: bool = False) -> DataFrame:
        """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of every row; with ``paths`` also the siblings themselves.

        ``folded_root`` is what the row's claimed digest and its siblings lead
        to, ``verified`` says whether that is the root. ``path`` has, from the
        leaf upwards, the siblings to the left and right of each level.
        """
        fanout, block_levels = self.fanout, self.block_levels

        def run(batch: pa.RecordBatch) -> pa.Table:
            return pa.concat_tables([one(batch.slice(i, 1)) for i in range(batch.num_rows)]) if batch.num_rows else pa.Table.from_batches([], schema=schema(batch))

        def schema(batch: pa.RecordBatch) -> pa.Schema:
            step = pa.struct([("left", pa.string()), ("right", pa.string())])
            texts = [(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")]
            return pa.schema([("key", batch.schema.field("rows").type.value_type.field("key").type), *texts, ("verified", pa.bool_()), *([("path", pa.list_(step))] if paths else [])])

        def one(batch: pa.RecordBatch) -> pa.Table:
            own = batch.column("rows").flatten()
            leaves, claims = own.field("leaf").to_pylist(), own.field("claim").to_pylist()
            upper = [(s["left"], s["right"]) for s in batch.column("path")[0].as_py()]
            subroot, root, nodes = (batch.column(c)[0].as_py() for c in ("subroot", "root", "nodes"))
            levels = _levels(leaves, nodes == 1, fanout, block_levels)[:-1]
            # the siblings of every node of the block, once per level
            sides = []
            for level in levels:
                runs = ["".join(level[i : i + fanout]) for i in range(0, len(level), fanout)]
                sides.append([(runs[i // fanout][: i % fanout * len(d)], runs[i // fanout][(i % fanout + 1) * len(d) :]) for i, d in enumerate(level)])
            tail = "".join(a + b for a, b in upper).encode()
            proofs, folded, ways = [], [], []
            for i, claim in enumerate(claims):
                proof, at, place, way = hashlib.sha256(), claim, i, []
                for side in sides:
                    left, right = side[place]
                    proof.update((left + right).encode())
                    at = hashlib.sha256((left + at + right).encode()).hexdigest()
                    place //= fanout
                    way.append({"left": left, "right": right}) if paths else None
                proof.update(tail)
                for left, right in upper:
                    at = hashlib.sha256((left + at + right).encode()).hexdigest()
                    way.append({"left": left, "right": right}) if paths else None
                proofs.append(proof.hexdigest())
                folded.append(at)
                ways.append(way)
            n, form = len(leaves), schema(batch)
            columns = [own.field("key"), pa.array(leaves), pa.array([subroot] * n), pa.array([root] * n), pa.array(proofs), pa.array(folded), pa.array([f == root for f in folded])]
            return pa.Table.from_arrays([*columns, *([pa.array(ways, form.field("path").type)] if paths else [])], schema=form)

        kind = self.blocks.schema["rows"].dataType.elementType["key"].dataType.simpleString()
        out = f"key {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + (", path array<struct<left:string,right:string>>" if paths else "")
        return self.blocks.mapInArrow(batches_of(run, 16), out).withColumnRenamed("key", self.key)

    def groups(self) -> DataFrame:
        """(grp, subroot, root) of every group."""
        return self.blocks.filter("block = 0").select("grp", "subroot", "root")


def build(docs: DataFrame, columns: list[str], group: str, key: str, claims: dict[str, Column] | None = None, fanout: int = FANOUT, block_levels: int = BLOCK_LEVELS) -> Manifest:
    """The manifest of ``docs``: a leaf per row over ``columns``, trees per ``group`` in the order of ``key``, one tree over the groups.

    ``claims`` replaces columns by what is claimed of them, say by another copy
    of the table; the proofs are then tried on the claimed rows. Null values
    are leaf values of their own, a null group is a group and comes first, null
    keys come first in their group; equal keys are ordered by their leaves, so
    repeated rows each have a place. Columns that aren't named, of whatever
    name, don't matter. Texts of any length are hashed where they are read. An
    empty table has no leaves, groups or root: the results are empty.
    """
    spark = docs.sparkSession
    grp = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # never null, and in the same order
    # the second digest is taken only where the claim differs
    other = reduce(lambda x, y: x | y, [~value.eqNullSafe(F.col(c)) for c, value in (claims or {}).items()], F.lit(False))
    claim = F.when(other, leaf([(claims or {}).get(c, F.col(c)) for c in columns]))
    leaves = docs.select(F.col(key).alias("key"), grp.alias("grp"), leaf([F.col(c) for c in columns]).alias("leaf"), claim.alias("claim"))
    leaves = stored(leaves, "manifest-rows")  # short rows; the sort reads them twice
    placed = numbered(leaves, "grp", ["key", "leaf"], "manifest-leaves")
    width = fanout**block_levels
    entry = F.struct("place", "key", "leaf", F.coalesce("claim", "leaf").alias("claim"))
    blocks = placed.groupBy("grp", F.floor(F.col("place") / width).alias("block")).agg(
        F.ceil(F.first("size") / width).alias("nodes"), F.sort_array(F.collect_list(entry)).alias("rows")  # at most ``width``
    )
    blocks = stored(blocks, "manifest-blocks")

    def roots(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [_levels(row.values.field("leaf").to_pylist(), n == 1, fanout, block_levels)[-1][0] for row, n in zip(batch.column("rows"), batch.column("nodes").to_pylist())]
        return pa.RecordBatch.from_arrays([batch.column("grp"), batch.column("block"), batch.column("nodes"), pa.array(found, pa.string())], names=["tree", "node", "nodes", "digest"])

    low = blocks.mapInArrow(batches_of(roots, 16), "tree string, node long, nodes long, digest string")
    climbed = stored(exchange(low, fanout), "manifest-paths")
    tops = climbed.filter("node = 0").select("tree", F.col("nodes").alias("blocks"), F.col("digest").alias("subroot"), F.lit("").alias("all"))
    tops = numbered(tops, "all", ["tree"], "manifest-groups").select(F.lit("").alias("tree"), F.col("place").alias("node"), F.col("size").alias("nodes"), F.col("subroot").alias("digest"), F.col("tree").alias("grp"), "subroot", "blocks")
    tops = stored(tops, "manifest-tops")
    whole = exchange(tops.select("tree", "node", "nodes", "digest"), fanout).select("node", F.col("digest").alias("root"), F.col("path").alias("above"))
    groups = stored(tops.select("node", "grp", "subroot", "blocks").join(whole, "node").drop("node"), "manifest-roots")
    ways = join_groups(climbed.select(F.col("tree").alias("grp"), F.col("node").alias("block"), "path"), groups, "grp", "blocks", climbed.count())
    ways = ways.select("grp", "block", "subroot", "root", F.concat("path", "above").alias("path"))
    return Manifest(blocks.join(ways, ["grp", "block"]), key, fanout, block_levels)


def documents_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of the documents by source, tried on a copy in which every fifth text (by its id's CRC) has its A-Z in lower case."""
    altered = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    claims = {"text": F.when(altered, ascii_lower(F.col("text"))).otherwise(F.col("text"))}
    return build(docs, ["doc_id", "source", "lang", "n_chars", "text"], "source", "doc_id", claims).rows()


def manifest_sql(levels: int = 6) -> str:
    """:func:`documents_manifest` as DuckDB SQL, for trees of up to ``levels`` levels."""
    digest = lambda text: "sha256(concat(" + ", ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen({c}::VARCHAR), ':', {c}::VARCHAR) END" for c in ("doc_id", "source", "lang", "n_chars", text)) + "))"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def tree(name: str) -> str:
        """Levels ``name``0, ``name``1, ... above ``name``0 (t, i, h, n), and what lies beside each node in ``name``s0, ..."""
        out = []
        for k in range(levels):
            out.append(f"""{name}{k + 1} AS (SELECT t, i // {FANOUT} AS i, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE min(h) END AS h, (n + {FANOUT - 1}) // {FANOUT} AS n
                FROM {name}{k} GROUP BY t, i // {FANOUT}, n)""")
            out.append(f"""{name}s{k} AS (SELECT a.t, a.i, any_value(a.n) AS n, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
                FROM {name}{k} a LEFT JOIN {name}{k} b ON a.t = b.t AND a.i // {FANOUT} = b.i // {FANOUT} AND a.i <> b.i GROUP BY a.t, a.i)""")
        return ", ".join(out)

    def climb(name: str, source: str) -> str:
        """Rows (t, i, held, beside, ...) of ``source`` led up one level after another."""
        out, last = [], source
        for k in range(levels):
            out.append(f"""{name}c{k} AS (SELECT x.* REPLACE (x.i // {FANOUT} AS i, CASE WHEN s.n > 1 THEN sha256(concat(s.l, x.held, s.r)) ELSE x.held END AS held, concat(x.beside, s.l, s.r) AS beside)
                FROM {last} x JOIN {name}s{k} s ON x.t = s.t AND x.i = s.i)""")
            last = f"{name}c{k}"
        return ", ".join(out)

    return f"""
        WITH d AS (SELECT doc_id, coalesce('=' || source, '') AS t, {digest('text')} AS leaf, CASE WHEN {crc32_sql('doc_id::VARCHAR')} % 5 = 0 THEN {digest(lowered)} ELSE {digest('text')} END AS claim FROM documents),
        e AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
        g0 AS (SELECT t, i, leaf AS h, count(*) OVER (PARTITION BY t) AS n FROM e), {tree('g')},
        o0 AS (SELECT '' AS t, row_number() OVER (ORDER BY t) - 1 AS i, h, count(*) OVER () AS n, t AS source FROM g{levels}), {tree('o')},
        start AS (SELECT doc_id, leaf, t, i, t AS source, claim AS held, '' AS beside FROM e), {climb('g', 'start')},
        middle AS (SELECT c.* REPLACE (o.t AS t, o.i AS i), o.h AS subroot FROM gc{levels - 1} c JOIN o0 o USING (source)), {climb('o', 'middle')}
        SELECT doc_id, leaf, subroot, (SELECT h FROM o{levels}) AS root, sha256(beside) AS proof_sha256, held AS folded_root, held = (SELECT h FROM o{levels}) AS verified FROM oc{levels - 1}"""
