"""Prefix trie of conversations by burst tries.

A conversation is a path: 20 bytes per turn, 16 of the digest of its role and
text and 4 for the length of its text, so a path orders and compares as bytes.
Equal paths are collapsed first. Containers hold the suffixes of the paths
below a head. An oversized container bursts: what all its suffixes begin with
becomes a chain of nodes, and the next turn deals the suffixes to containers
below it. Small containers are dealt over the tasks, sorted, and swept into
nodes in one pass; the nodes that burst get their sums from the containers below.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.llm.common import crc32_sql, join_groups, stored

#: bytes of a turn in a path, and of its digest
TURN, DIGEST = 20, 16
#: a container bursts beyond that many suffixes or bytes of them
CONTAINER_PATHS, CONTAINER_BYTES = 8192, 2_000_000
#: ids joined to one string before it is hashed
RUN_IDS = 20_000

NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_NAMES = [c.split()[0] for c in NODES.split(", ")]
_NODES = pa.schema([(c, pa.string() if c == "ends_sha256" else pa.int64()) for c in _NAMES])
_NOBODY = hashlib.sha256(b"").hexdigest()


def paths(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(base, conv_id, path): the turns of each conversation in order, null turns first, equal turns by their digests.

    ``base`` is the id without its remainder by five; the rows are dealt by it.
    A row without conversation id belongs to none. A null role or text is empty.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST)
    conv = F.col(conv_col).cast("long")
    turns = conversations.filter(conv.isNotNull()).select(
        (conv - conv % 5).alias("base"), conv.alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), F.concat(digest, F.lpad(F.hex(F.octet_length(text)), 8, "0")).alias("code")).alias("turn")
    )
    # one conversation's digests are one row
    whole = turns.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return whole.select("base", "conv_id", F.unhex(F.array_join("turns.code", "")).alias("path"))


def rebuilt(conversations: DataFrame, **columns: str) -> DataFrame:
    """(conv_id, path): conversation c begins with the first h turns of conversation c - c % 5 in place of its own, h the id's CRC-32 by nine."""
    own = paths(conversations, **columns)
    first = own.filter("conv_id = base").select("base", F.substring("path", 1, 8 * TURN).alias("first"))
    taken = (F.crc32(F.col("conv_id").cast("string")) % 9).cast("int")
    led = own.join(first, "base", "left").withColumn("taken", taken)
    return led.select("conv_id", F.expr(f"concat(coalesce(substring(first, 1, {TURN} * taken), X''), substring(path, {TURN} * taken + 1))").alias("path"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive ids of one path as one string."""
    path, ids, out = None, [], []

    def flush():
        if ids:
            out.append((path, ids[0], len(ids), ",".join(map(str, ids))))

    for batch in batches:
        for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if key != path or len(ids) == RUN_IDS:
                flush()
                path, ids = key, []
            ids.append(conv)
        yield from _rows(out, ["seq", "first", "n", "ids"], 1000)
    flush()
    yield from _rows(out, ["seq", "first", "n", "ids"], 1)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of a path in order to one digest, whatever their number."""
    path, digest, first, n, out = None, None, 0, 0, []
    for batch in batches:
        for key, low, more, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if key != path:
                if path is not None:
                    out.append((path, first, n, digest.hexdigest()))
                path, digest, first, n = key, hashlib.sha256(), low, 0
            digest.update(("," if n else "").encode() + ids.encode())
            n += more
        yield from _rows(out, ["seq", "conv_id", "n", "ends"], 1000)
    if path is not None:
        out.append((path, first, n, digest.hexdigest()))
    yield from _rows(out, ["seq", "conv_id", "n", "ends"], 1)


def _rows(out: list[tuple], names: list[str], least: int) -> Iterator[pa.RecordBatch]:
    """The gathered rows as a batch once there are ``least``; they are forgotten then."""
    if len(out) >= least:
        columns = [list(c) for c in zip(*out)]
        out.clear()
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if isinstance(c[0], int) else pa.string()) for c in columns], names=names)


def distinct_paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, n, ends, path): each path of (conv_id, path) once, with its smallest and its number of ids and the digest of them all.

    The ids of a path are joined in runs by many tasks; the runs of one path,
    short rows, pass through one hash in order.
    """
    rows = stored(conversations.withColumn("seq", F.sha2("path", 256)), "trie-paths")
    runs = rows.select("seq", "conv_id").repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id").mapInArrow(_runs, "seq string, first long, n long, ids string")
    ends = runs.repartition("seq").sortWithinPartitions("seq", "first").mapInArrow(_ends, "seq string, conv_id long, n long, ends string")
    return ends.drop("seq").join(rows.select("conv_id", "path"), "conv_id")


@dataclass
class _Sweep:
    """The nodes of one container, from its suffixes in order."""

    depth: int
    head_bytes: int
    nodes: list[list] = field(default_factory=list)  # conv_id, depth, parent, n_convs, n_children, n_leaves, saved, ends
    sizes: list[int] = field(default_factory=list)
    way: list[int] = field(default_factory=list)  # open nodes, by their place
    last: bytes = b""

    def _open(self, size: int) -> None:
        self.nodes.append([None, self.depth + len(self.way), self.way[-1] if self.way else -1, 0, 0, 0, 0, _NOBODY])
        self.sizes.append(size)
        self.way.append(len(self.nodes) - 1)

    def _close(self) -> None:
        at = self.way.pop()
        node = self.nodes[at]
        node[5] = node[5] or 1
        node[6] += (node[3] - 1) * self.sizes[at]
        if node[2] >= 0:
            above = self.nodes[node[2]]
            above[0] = node[0] if above[0] is None else min(above[0], node[0])
            above[3], above[4], above[5], above[6] = above[3] + node[3], above[4] + 1, above[5] + node[5], above[6] + node[6]

    def add(self, suffix: bytes, conv: int, n: int, ends: str) -> None:
        if not self.nodes:
            self._open(self.head_bytes)
        same, most = 0, min(len(self.last), len(suffix))
        while same < most and self.last[same : same + TURN] == suffix[same : same + TURN]:
            same += TURN
        while len(self.way) > 1 + same // TURN:
            self._close()
        for at in range(same, len(suffix), TURN):
            self._open(int.from_bytes(suffix[at + DIGEST : at + TURN], "big"))
        node = self.nodes[self.way[-1]]
        node[0] = conv if node[0] is None else min(node[0], conv)
        node[3], node[7], self.last = node[3] + n, ends, suffix

    def close(self, parent: int | None) -> list[list]:
        while self.way:
            self._close()
        for node in reversed(self.nodes):  # a node comes behind its parent
            node[2] = self.nodes[node[2]][0] if node[2] >= 0 else parent
        return self.nodes


_SWEPT = f"{NODES}, up string"


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Containers, sorted by head and suffix, to nodes; ``up`` names the burst node above the top of a container."""
    head, sweep, parent, up, out = None, None, None, None, [[] for _ in range(9)]

    def flush():
        if sweep is not None:
            nodes = sweep.close(parent)
            for column, values in zip(out, zip(*nodes)):
                column.extend(values)
            out[8].extend([up, *[None] * (len(nodes) - 1)])

    def batch_of():
        table = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, [*_NODES, pa.field("up", pa.string())])], names=[*_NAMES, "up"])
        for column in out:
            column.clear()
        return table

    for batch in batches:
        for row in batch.to_pylist():
            if row["head"] != head:
                flush()
                head, parent, up, sweep = row["head"], row["parent"], row["up"], _Sweep(row["depth"], row["bytes"])
            sweep.add(row["suffix"], row["conv_id"], row["n"], row["ends"])
        if len(out[0]) > 10_000:
            yield batch_of()
    flush()
    yield batch_of()


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the smallest and largest suffix of a container, and so all of them, begin with, in whole turns."""
    for batch in batches:
        found = []
        for low, high in zip(batch.column("low").to_pylist(), batch.column("high").to_pylist()):
            at = 0
            while at < min(len(low), len(high)) and low[at : at + TURN] == high[at : at + TURN]:
                at += TURN
            found.append(low[:at])
        kept = [i for i, name in enumerate(batch.schema.names) if name not in ("low", "high")]
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], pa.array(found, pa.binary())], names=[*[batch.schema.names[i] for i in kept], "common"])


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A burst container to the chain of nodes that all its paths share; the last has the containers below."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            common = row["common"]
            sizes = [row["bytes"], *(int.from_bytes(common[at + DIGEST : at + TURN], "big") for at in range(0, len(common), TURN))]
            saved = row["saved"]
            for i in range(len(sizes) - 1, -1, -1):
                last = i == len(sizes) - 1
                saved += (row["members"] - 1) * sizes[i]
                ends = (row["ends"] or _NOBODY) if last else _NOBODY
                out.append((row["first"], row["depth"] + i, row["first"] if i else row["parent"], row["members"], row["below"] if last else 1, row["leaves"], saved, ends, None if i else row["up"]))
        columns = list(zip(*out)) or [()] * 9
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, [*_NODES, pa.field("up", pa.string())])], names=[*_NAMES, "up"])


def prefix_trie(sequences: DataFrame, container_paths: int = CONTAINER_PATHS, container_bytes: int = CONTAINER_BYTES) -> DataFrame:
    """The nodes of the trie over (conv_id, path); ``path`` is made by :func:`paths` or :func:`rebuilt`.

    Per distinct beginning, the empty one included: conv_id (smallest member),
    depth, parent_conv_id, n_convs, n_children, n_leaves (childless nodes below
    or itself), saved_tokens (sum over the nodes below and itself of the
    members but one, times the bytes of the last text), ends_sha256 (digest of
    the sorted ids that end here). Ids are unique and not null. Paths may be
    empty, equal, or beginnings of others. Rounds follow the branchings under
    which more paths lie than a container takes. An empty table has no nodes.
    """
    rows = stored(distinct_paths(sequences).withColumnRenamed("path", "suffix").select(
        F.lit("").alias("head"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("bytes"), F.lit(None).cast("long").alias("parent"), F.lit(None).cast("string").alias("up"),
        "conv_id", "n", "ends", "suffix",
    ), "trie-root")
    ready, bursts = None, []
    while True:
        stats = rows.groupBy("head").agg(
            F.count("*").alias("seqs"), F.sum(F.length("suffix")).alias("size"), F.min("suffix").alias("low"), F.max("suffix").alias("high"),
            F.min("conv_id").alias("first"), F.sum("n").alias("members"), *[F.first(c, ignorenulls=True).alias(c) for c in ("depth", "bytes", "parent", "up")],
        )
        big = stats.filter((F.col("seqs") > 1) & ((F.col("seqs") > container_paths) | (F.col("size") > container_bytes)))
        burst = stored(big.mapInArrow(_common, "head string, seqs long, size long, first long, members long, depth long, bytes long, parent long, up string, common binary"), "trie-bursts")
        if burst.isEmpty():
            ready = rows if ready is None else ready.unionByName(rows)
            break
        placed = join_groups(rows, burst.select("head", "seqs", "common", "first"), "head", "seqs", rows.count())
        placed = stored(placed, "trie-placed")
        small = placed.filter("common IS NULL").select(rows.columns)
        ready = small if ready is None else ready.unionByName(small)
        split = placed.filter("common IS NOT NULL")
        stop = split.filter(F.length("suffix") == F.length("common")).select("head", "ends")
        bursts.append(burst.join(stop, "head", "left"))
        step = f"substring(suffix, 1, length(common) + {TURN})"
        rows = split.filter(F.length("suffix") > F.length("common")).select(
            F.sha2(F.concat("head", F.expr(f"hex({step})")), 256).alias("head"), F.expr(f"depth + length(common) div {TURN} + 1").alias("depth"),
            F.expr(f"cast(conv(hex(substring(suffix, length(common) + {DIGEST + 1}, {TURN - DIGEST})), 16, 10) AS long)").alias("bytes"),
            F.col("first").alias("parent"), F.col("head").alias("up"), "conv_id", "n", "ends", F.expr(f"substring(suffix, length(common) + {TURN + 1})").alias("suffix"),
        )
        rows = stored(rows, "trie-round")
    nodes = stored(ready.repartition("head").sortWithinPartitions("head", "suffix").mapInArrow(_swept, _SWEPT), "trie-nodes")
    tops = nodes.filter("up IS NOT NULL")
    for burst in reversed(bursts):
        below = tops.groupBy("up").agg(F.count("*").alias("below"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        whole = burst.join(below.withColumnRenamed("up", "head"), "head")
        chain = stored(whole.mapInArrow(_chain, _SWEPT), "trie-chains")
        nodes = nodes.unionByName(chain)
        tops = tops.unionByName(chain.filter("up IS NOT NULL"))
    return nodes.drop("up")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return prefix_trie(rebuilt(conversations))


TRIE_SQL = f"""
    WITH t AS (SELECT conv_id, turn, strlen(coalesce(text, '')) AS b, substr(sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))), 1, 32) AS s FROM conversations WHERE conv_id IS NOT NULL),
    o AS (SELECT conv_id, b, s, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, s) - 1 AS p, count(*) OVER (PARTITION BY conv_id) AS n FROM t),
    ids AS (SELECT DISTINCT conv_id, {crc32_sql('conv_id::VARCHAR')} % 9 AS h FROM t),
    led AS (SELECT i.conv_id, o.p, o.b, o.s FROM ids i JOIN o ON o.conv_id = i.conv_id - i.conv_id % 5 AND o.p < i.h),
    own AS (SELECT i.conv_id, o.p - i.h + coalesce((SELECT max(l.p) + 1 FROM led l WHERE l.conv_id = i.conv_id), 0) AS p, o.b, o.s FROM ids i JOIN o USING (conv_id) WHERE o.p >= i.h),
    r AS (FROM led UNION ALL FROM own),
    m AS (SELECT conv_id, p + 1 AS depth, b, string_agg(s, '') OVER (PARTITION BY conv_id ORDER BY p) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM r
        UNION ALL SELECT conv_id, 0, 0, '', (SELECT count(*) FROM r WHERE r.conv_id = ids.conv_id) FROM ids),
    nodes AS (SELECT k, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(b) AS b, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256 FROM m GROUP BY k, depth),
    kids AS (SELECT a.k, a.depth, count(DISTINCT b.k) AS n_children FROM m a JOIN m b ON a.conv_id = b.conv_id AND b.depth = a.depth + 1 GROUP BY a.k, a.depth),
    n AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (k, depth)),
    pairs AS (SELECT DISTINCT a.k, a.depth, b.k AS bk FROM m a JOIN m b ON a.conv_id = b.conv_id AND a.depth <= b.depth),
    sums AS (SELECT p.k, p.depth, count(*) FILTER (n.n_children = 0) AS n_leaves, sum((n.n_convs - 1) * n.b)::BIGINT AS saved_tokens FROM pairs p JOIN n ON n.k = p.bk GROUP BY p.k, p.depth),
    ups AS (SELECT DISTINCT a.k, u.k AS uk FROM m a JOIN m u ON a.conv_id = u.conv_id AND u.depth = a.depth - 1)
    SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, n.ends_sha256
    FROM n JOIN sums USING (k, depth) LEFT JOIN ups ON ups.k = n.k AND n.depth > 0 LEFT JOIN n u ON u.k = ups.uk AND u.depth = n.depth - 1"""
