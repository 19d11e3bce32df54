"""Packing documents into sequences by a grouping genetic algorithm on islands.

Pieces shorter than a sequence are dealt by hash to groups of bounded size. A
group is solved by several islands, each with a population of packings that
starts from best-fit packings in varied orders. Crossover injects whole
well-filled sequences of one parent into another, removes the sequences that
hold a piece twice, and best-fits the displaced pieces. Between rounds each
island hands its elite to the next one. What a group can't fill well goes to
the next level, where the loose pieces of all groups are packed together.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.llm.common import batches_of, id_and_text, small_batches, stored
from gradus.llm.tokens import WordTokenizer, gathered
from gradus.session import checkpointed

SEQUENCE = 2048
GROUP_PIECES = 3000
ISLANDS = 3
ROUNDS = 2
POPULATION = 6
GENERATIONS = 10
#: a sequence filled to this share is final; others go to the next level while that has fewer groups
WELL_FILLED = 0.995
LEVELS = 4


class Bins:
    """Sequences with their free room; finds the fullest one that takes a piece by a bit mask over room sizes."""

    def __init__(self, capacity: int):
        self.capacity, self.items, self.free, self.by_room, self.mask = capacity, [], [], [[] for _ in range(capacity + 1)], 0

    def add(self, items: list[int], room: int) -> None:
        self.by_room[room].append(len(self.items))
        self.mask |= 1 << room
        self.items.append(items)
        self.free.append(room)

    def put(self, item: int, length: int) -> None:
        above = self.mask >> length
        if not above:
            self.add([item], self.capacity - length)
            return
        room = length + (above & -above).bit_length() - 1
        where = self.by_room[room].pop()
        if not self.by_room[room]:
            self.mask ^= 1 << room
        self.items[where].append(item)
        left = room - length
        self.free[where] = left
        self.by_room[left].append(where)
        self.mask |= 1 << left

    def fitness(self) -> tuple[int, float]:
        """Fewer sequences first, then uneven filling, which keeps room in one place."""
        return -len(self.items), sum((self.capacity - f) ** 2 for f in self.free)


def best_fit(lengths: list[int], order, capacity: int, bins: Bins | None = None) -> Bins:
    bins = bins or Bins(capacity)
    for i in order:
        bins.put(i, lengths[i])
    return bins


def crossover(a: Bins, b: Bins, lengths: list[int], rng: np.random.Generator) -> Bins:
    """Whole sequences of ``b``, fuller ones more likely, replace those of ``a`` that share a piece with them."""
    free = np.array(b.free)
    chosen = np.flatnonzero(rng.random(len(free)) < 0.3 * np.exp(-free / 16.0))
    taken = {i for c in chosen for i in b.items[c]}
    child, loose = Bins(a.capacity), []
    for c in chosen:
        child.add(list(b.items[c]), b.free[c])
    worst = max(a.free, default=0) / 2
    for items, room in zip(a.items, a.free):
        if taken.isdisjoint(items) and not (room > worst and rng.random() < 0.5):
            child.add(list(items), room)
        else:
            loose += [i for i in items if i not in taken]
    loose.sort(key=lambda i: (-lengths[i], i))
    return best_fit(lengths, loose, a.capacity, child)


def evolve(lengths: list[int], capacity: int, seed: int, elites: list[list[list[int]]], generations: int = GENERATIONS, population: int = POPULATION) -> Bins:
    """The best packing of one island; ``elites`` are packings that join its population."""
    rng = np.random.Generator(np.random.Philox(seed))
    sizes = np.array(lengths, float)
    people = []
    for packed in elites:
        bins = Bins(capacity)
        for items in packed:
            bins.add(list(items), capacity - sum(lengths[i] for i in items))
        people.append(bins)
    noise = 0.0 if not elites else 0.05
    while len(people) < population:
        order = np.lexsort((np.arange(len(sizes)), -sizes * (1 + noise * rng.standard_normal(len(sizes)))))
        people.append(best_fit(lengths, order.tolist(), capacity))
        noise = noise * 2 or 0.01
    least = -(-sum(lengths) // capacity)
    for _ in range(generations):
        people.sort(key=Bins.fitness, reverse=True)
        if len(people[0].items) <= least:
            break
        i, j = rng.choice(len(people) - 1, 2, replace=False) if len(people) > 2 else (0, 1)
        child = crossover(people[min(i, j)], people[max(i, j)], lengths, rng)
        other = crossover(people[max(i, j)], people[min(i, j)], lengths, rng)
        people[-1] = max(child, other, key=Bins.fitness)
    return max(people, key=Bins.fitness)


def _pack_level(loose: DataFrame, groups: int, capacity: int, seed: int) -> DataFrame:
    """(uid, length, group, bin, fill): every group's best packing after all rounds."""
    dealt = loose.select("uid", "length").withColumn("group", F.pmod(F.xxhash64(F.lit(seed), "uid"), F.lit(groups)).cast("int"))
    elites = None
    schema = "group int, island int, n_bins int, fitness double, packed binary"

    def run(rows, packed, group, island, turn):
        order = np.argsort(rows.column("uid").to_numpy(), kind="stable")
        lengths = rows.column("length").to_numpy()[order].astype(np.int64).tolist()
        packings = []
        for blob in packed:
            label = np.frombuffer(blob, "<i4")
            cuts = np.flatnonzero(np.diff(np.sort(label))) + 1
            packings.append([x.tolist() for x in np.split(np.argsort(label, kind="stable"), cuts)])
        best = evolve(lengths, capacity, hash((seed, group, island, turn)) & 0x7FFFFFFF, packings)
        label = np.zeros(len(lengths), np.int32)
        for b, items in enumerate(best.items):
            label[items] = b
        return pa.table({"group": pa.array([group], pa.int32()), "island": pa.array([island], pa.int32()), "n_bins": pa.array([len(best.items)], pa.int32()), "fitness": [float(best.fitness()[1])], "packed": pa.array([label.astype("<i4").tobytes()], pa.binary())})

    spread = dealt.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])))
    for turn in range(ROUNDS):
        if elites is None:
            def first(key, rows):
                return run(rows, [], key[0].as_py(), key[1].as_py(), 0)

            elites = checkpointed(spread.groupBy("group", "island").applyInArrow(first, schema))
        else:
            # an island's own elite and that of its neighbour
            moved = elites.unionByName(elites.withColumn("island", ((F.col("island") + 1) % ISLANDS).cast("int"))).select("group", "island", "packed")

            def later(key, rows, found):
                return run(rows, found.column("packed").to_pylist(), key[0].as_py(), key[1].as_py(), turn)

            elites = checkpointed(spread.groupBy("group", "island").cogroup(moved.groupBy("group", "island")).applyInArrow(later, schema))
    best = elites.groupBy("group").agg(F.max_by("packed", F.struct(-F.col("n_bins"), "fitness", "island")).alias("packed"))

    def label(key, rows, found):
        order = np.argsort(rows.column("uid").to_numpy(), kind="stable")
        uid, lengths = rows.column("uid").to_numpy()[order], rows.column("length").to_numpy()[order].astype(np.int64)
        bins = np.frombuffer(found.column("packed")[0].as_py(), "<i4")
        fill = np.bincount(bins, lengths).astype(np.int64)
        by_bin = np.lexsort((uid, bins))
        before = np.cumsum(lengths[by_bin]) - lengths[by_bin]
        starts = np.concatenate([[0], np.cumsum(fill)[:-1]])
        offset = np.zeros(len(uid), np.int64)
        offset[by_bin] = before - starts[bins[by_bin]]
        return pa.table({"uid": uid, "length": lengths, "group": pa.array(np.full(len(uid), key[0].as_py()), pa.int32()), "bin": bins.astype(np.int32), "fill": fill[bins], "offset": offset})

    return checkpointed(dealt.groupBy("group").cogroup(best.groupBy("group")).applyInArrow(label, "uid long, length long, group int, bin int, fill long, offset long"))


def pack_lengths(pieces: DataFrame, capacity: int = SEQUENCE, group_pieces: int = GROUP_PIECES, seed: int = 31) -> DataFrame:
    """(uid, sequence_id, offset) for pieces (uid, length) with distinct uids and lengths of 1 to ``capacity``."""
    full = pieces.filter(F.col("length") == capacity).select("uid", (F.lit(1 << 62) + F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    done, loose = [full], pieces.filter(F.col("length") < capacity).select("uid", F.col("length").cast("long").alias("length"))
    n = loose.count()
    for level in range(LEVELS):
        if not n:
            break
        groups = -(-n // group_pieces)
        packed = _pack_level(loose, groups, capacity, seed + level)
        final = F.lit(True) if groups == 1 or level == LEVELS - 1 else F.col("fill") >= int(WELL_FILLED * capacity)
        number = F.lit(level << 56).cast("long") + F.shiftleft(F.col("group").cast("long"), 24) + F.col("bin")
        done.append(packed.filter(final).select("uid", number.alias("sequence_id"), "offset"))
        loose = packed.filter(~final).select("uid", "length")
        n = 0 if groups == 1 or level == LEVELS - 1 else loose.count()
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pieces_of(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", capacity: int = SEQUENCE) -> DataFrame:
    """(uid, doc_id, piece, start, length, ids_crc32): documents with their end id, cut only where they are longer than a sequence."""
    small_batches(docs.sparkSession)

    def run(batches):
        words = WordTokenizer(tokenizer)
        for batch in gathered(batches):
            yield cut_pieces(batch, *words.encode(batch.column(1), end_id))

    def cut_pieces(batch, ids, stops):
        ids, rows, piece, start, length, crc, low = ids.astype("<u4", copy=False), [], [], [], [], [], 0
        for d, high in enumerate(stops.tolist()):
            for p, at in enumerate(range(low, high, capacity)):
                part = ids[at : min(at + capacity, high)]
                rows.append(d)
                piece.append(p)
                start.append(at - low)
                length.append(len(part))
                crc.append(zlib.crc32(part))
            low = high
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    cut = rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")
    return stored(cut.withColumn("uid", F.monotonically_increasing_id()), "pieces")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", capacity: int = SEQUENCE, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Places every piece of every document in a sequence of at most ``capacity`` ids.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset (gapless from 0). A null or empty text is its end id
    alone. Repeated rows and null ids are documents of their own. An empty
    table gives an empty result.
    """
    pieces = pieces_of(docs, tokenizer, end_id, id_col, text_col, capacity)
    placed = pack_lengths(pieces.select("uid", "length"), capacity, group_pieces)
    return pieces.join(placed, "uid").drop("uid")
