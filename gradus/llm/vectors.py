"""Near duplicates among vectors: Euclidean p-stable hashing and exact cosines.

Normalised vectors are projected on Gaussian directions, shifted and quantised
with one width; a table's bucket joins several such numbers. The number of
directions in a table follows the logarithm of the number of vectors, the
number of tables the wanted recall at the threshold. Equal vectors are one node
with a weight. Each bucket is compared in blocks of bounded size. A linked pair
counts in the first table in which both vectors share a bucket, so the tasks
return counts and links to local hubs, never the pairs.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.llm.common import batches_of, join_groups, stored
from gradus.llm.components import connected_components
from gradus.session import checkpointed

WIDTH = 2.0
#: rows of one bucket that a task compares at once
BLOCK_ROWS = 1024
#: other vectors expected in a bucket by chance
CHANCE_ROWS = 8


def collision(distance: float, width: float = WIDTH) -> float:
    """Probability that two vectors at this distance get the same quantised projection."""
    t = width / distance
    below = 0.5 * math.erfc(t / math.sqrt(2))
    return 1 - 2 * below - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def table_sizes(n: int, min_cosine: float, recall: float) -> tuple[int, int]:
    """(directions in a table, tables) for ``n`` vectors: recall holds for pairs just at the threshold, closer pairs have more."""
    near, far = collision(math.sqrt(2 - 2 * min_cosine)), collision(math.sqrt(2))
    k = max(4, math.ceil(math.log(max(n, 2) / CHANCE_ROWS) / -math.log(far)))
    return k, math.ceil(math.log(1 - recall) / math.log1p(-(near**k)))


def _unit(values: pa.Array) -> tuple[list[int], list[np.ndarray]]:
    """The places of the usable vectors, and these normalised."""
    keep, rows = [], []
    for i, v in enumerate(values.to_pylist()):
        if v and None not in v:
            x = np.asarray(v, float)
            top = np.abs(x).max()
            if np.isfinite(top) and top > 0:
                x = x / top  # no overflow in the norm
                keep.append(i)
                rows.append(x / math.sqrt(float(x @ x)))
    return keep, rows


def _directions(width: int, count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.Philox(key=[seed, width]))
    return rng.standard_normal((width, count)), rng.uniform(0, WIDTH, count)


def unit_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, key, unit): normalised vectors and a 128-bit key of their values; both null for unusable vectors."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, units = [None] * batch.num_rows, [None] * batch.num_rows
        for i, x in zip(*_unit(batch.column(1))):
            units[i], keys[i] = x, hashlib.blake2b(x.tobytes(), digest_size=16).digest()
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(units, pa.list_(pa.float64()))], names=["vec_id", "key", "unit"])

    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    return rows.mapInArrow(batches_of(run), f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, key binary, unit array<double>")


def hashed(nodes: DataFrame, k: int, tables: int, seed: int) -> DataFrame:
    """Adds ``buckets``: the bucket of every table."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list = [None] * batch.num_rows
        units = batch.column(batch.schema.get_field_index("unit")).to_pylist()
        for width in {len(u) for u in units}:
            at = [i for i, u in enumerate(units) if len(u) == width]
            a, b = _directions(width, k * tables, seed)
            cells = np.floor((np.array([units[i] for i in at]) @ a + b) / WIDTH).astype(np.int64).reshape(len(at), tables, k)
            mixed = np.full((len(at), tables), width, np.uint64)
            for j in range(k):  # a 64-bit mix of the k numbers; a chance meeting costs a comparison, nothing else
                mixed = (mixed ^ cells[:, :, j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(29)
            for i, row in zip(at, mixed.view(np.int64)):
                out[i] = row
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int64()))], names=[*batch.schema.names, "buckets"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema.fields)
    return nodes.mapInArrow(batches_of(run), f"{fields}, buckets array<long>")


def compare(left: dict, right: dict, table: int, min_cosine: float, same: bool):
    """Linked weight of each row of both sides, and the smallest node of each row's local component.

    Sides hold unit, node, w and buckets. Pairs that already met in an earlier
    table are left out of the weights, but not of the components.
    """
    near = [np.zeros(len(left["node"]), np.int64), np.zeros(len(right["node"]), np.int64)]
    hubs = [left["node"].copy(), right["node"].copy()]
    rows, cols = [], []
    for at in range(0, len(left["node"]), 128):
        cos = left["unit"][at : at + 128] @ right["unit"].T
        r, c = np.nonzero(cos >= min_cosine)
        r = r + at
        ok = r < c if same else np.ones(len(r), bool)
        r, c = r[ok], c[ok]
        shared = left["buckets"][r, : table + 1] == right["buckets"][c, : table + 1]
        first = shared[:, table] & (shared.argmax(1) == table)
        near[0] += np.bincount(r[first], right["w"][c[first]], len(near[0])).astype(np.int64)
        near[1] += np.bincount(c[first], left["w"][r[first]], len(near[1])).astype(np.int64)
        rows.append(r)
        cols.append(c)
    r, c = np.concatenate(rows), np.concatenate(cols)
    while len(r):
        low = np.minimum(hubs[0][r], hubs[1][c])
        before = [h.copy() for h in hubs]
        np.minimum.at(hubs[0], r, low)
        np.minimum.at(hubs[1], c, low)
        if same:
            hubs[0] = hubs[1] = np.minimum(*hubs)
        if all((a == b).all() for a, b in zip(before, hubs)):
            break
    if same:
        near[0] = near[1] = near[0] + near[1]
    return near, hubs


def _side(table: pa.Table) -> dict:
    unit = table.column("unit").combine_chunks()
    buckets = table.column("buckets").combine_chunks()
    n = table.num_rows
    square = lambda x: x.flatten().to_numpy().reshape(n, len(x.flatten()) // max(1, n))
    return {
        "unit": square(unit), "buckets": square(buckets),
        "node": table.column("node").to_numpy(), "w": table.column("w").to_numpy(),
    }


def linked(nodes: DataFrame, tables: int, min_cosine: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(node, near, hub) from every comparison of blocks: linked weight and a node of the same component."""
    spots = nodes.select("node", F.posexplode("buckets").alias("table", "bucket"))
    place = F.xxhash64("table", "bucket")
    sizes = spots.select(place.alias("spot")).groupBy("spot").agg(F.count("*").alias("in_spot")).filter("in_spot > 1")
    total = nodes.count() * tables
    wide = nodes.select("node", "w", "unit", "buckets", F.posexplode("buckets").alias("table", "bucket")).withColumn("spot", place).drop("bucket")
    wide = join_groups(wide, checkpointed(sizes), "spot", "in_spot", total).filter("in_spot > 1")
    count = F.ceil(F.col("in_spot") / block_rows).cast("int")
    own = F.pmod(F.xxhash64(F.lit(5), "node"), F.col("blocks")).cast("int")
    # a block meets itself and every other block of its bucket once
    wide = wide.withColumn("blocks", count).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    wide = wide.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "blocks", "in_spot")

    def run(key, rows):
        _, table, i, j = (k.as_py() for k in key)
        out = []
        own = rows.column("own").to_numpy()
        widths = pc.list_value_length(rows.column("unit")).to_numpy()
        for width in np.unique(widths):
            some = rows.filter(pa.array(widths == width))
            mine = own[widths == width]
            if i == j:
                sides = [_side(some)] * 2
            else:
                sides = [_side(some.filter(pa.array(mine == b))) for b in (i, j)]
            if all(len(s["node"]) for s in sides):
                near, hubs = compare(*sides, table, min_cosine, i == j)
                for side, n, h in list(zip(sides, near, hubs))[: 1 if i == j else 2]:
                    out.append(pa.table({"node": side["node"], "near": n, "hub": h}))
        found = pa.concat_tables(out) if out else pa.table({"node": pa.array([], pa.int64()), "near": pa.array([], pa.int64()), "hub": pa.array([], pa.int64())})
        some = (found.column("near").to_numpy() > 0) | (found.column("hub").to_numpy() != found.column("node").to_numpy())
        return found.filter(pa.array(some))

    return wide.groupBy("spot", "table", "i", "j").applyInArrow(run, "node long, near long, hub long")


def near_vectors(
    df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", min_cosine: float = 0.95, recall: float = 0.97,
    seed: int = 23, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Links between vectors with a cosine of at least ``min_cosine``, and their components.

    Returns a row per input row: vec_id, n_links (other rows linked directly),
    component_id (smallest id reachable), kept (the id is its component's
    smallest). No pair below the threshold is linked; pairs above are found
    with a probability of at least ``recall``. Null and zero vectors, and those
    with null, NaN or infinite components, link with nothing; vectors of
    different lengths neither. Rows with one id and one vector are copies that
    link with each other. A null id counts for no component_id.
    """
    rows = stored(unit_vectors(df, id_col, vec_col), "unit-vectors")
    total = rows.count()
    nodes = rows.filter(F.col("key").isNotNull()).groupBy("key").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("w"), F.first("unit").alias("unit"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "distinct-vectors")
    k, tables = table_sizes(nodes.count(), min_cosine, recall)
    placed = stored(hashed(nodes.select("node", "w", "unit"), k, tables, seed), "hashed-vectors")
    found = checkpointed(linked(placed, tables, min_cosine, block_rows).groupBy("node", "hub").agg(F.sum("near").alias("near")))
    near = found.groupBy("node").agg(F.sum("near").alias("near"))
    parts = connected_components(found.filter("node <> hub"), "node", "hub").withColumnRenamed("node", "member")
    labelled = nodes.select("key", "node", "first_id", "w").join(near, "node", "left")
    labelled = labelled.join(parts, labelled["node"] == parts["member"], "left").withColumn("component", F.coalesce("component", "node")).drop("member")
    labelled = checkpointed(labelled)
    smallest = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("size"))
    labelled = join_groups(labelled, checkpointed(smallest), "component", "size", nodes.count())
    labelled = labelled.select("key", "w", (F.coalesce("near", F.lit(0)) + F.col("w") - 1).alias("n_links"), "component_id")
    out = join_groups(rows.select("vec_id", "key"), checkpointed(labelled), "key", "w", total)
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
