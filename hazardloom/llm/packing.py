"""Best-fit packing by a grouping genetic algorithm on islands.

A solution is a set of bins (sequences).  Crossover injects whole well-filled bins of one
parent into the other, drops the bins there that hold the same documents a second time, and
puts the displaced ones back by best fit, longest first.  The pieces are dealt at random to
groups of about ``GROUP_PIECES``; several islands evolve each group, one Spark row each, and
after every epoch the best solution of an island migrates to the next.  A group stops as soon
as it meets the lower bound of its total length.  Pieces of sequences that stay underfull
are dealt to new groups and packed once more, so that groups' remainders fill each other.
"""

from __future__ import annotations

import math
import random
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardloom.llm.chunks import encoder, small_slices
from hazardloom.session import write_and_read

CAPACITY = 4_096
GROUP_PIECES = 4_096
ISLANDS = 4
ISLANDS_PER_TASK = 16
EPOCHS = 2
CHILDREN = 8
POPULATION = 4
# Sequences filled less than this go to the second dealing.
UNDERFULL = 0.98
ROUNDS = 3


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """``slot, id, piece, start, length, ids_crc32``: every document cut at ``capacity`` tokens.

    ``slot`` numbers the pieces within their partition; it is only stable once written.
    """

    def cut(batches):
        coder, slot = encoder(path, True), TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in small_slices(batch):
                rows = []
                texts = coder.of(part.column(1).to_pylist())
                for doc_id, data in zip(part.column(0).to_pylist(), texts, strict=True):
                    data += np.uint32(end_id).astype("<u4").tobytes()
                    for k, at in enumerate(range(0, len(data), 4 * capacity)):
                        ids = data[at : at + 4 * capacity]
                        rows.append((slot, doc_id, k, at // 4, len(ids) // 4, zlib.crc32(ids)))
                        slot += 1
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=schema)

    names = ["slot", "id", "piece", "start", "length", "ids_crc32"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    schema = pa.schema(list(zip(names, types, strict=True)))
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return source.mapInArrow(cut, "slot long, id long, piece int, start long, length long, ids_crc32 long")


class Packing:
    """Solutions for one group of lengths; a solution is a list of bins, a bin a list of piece numbers."""

    def __init__(self, lengths: list[int], capacity: int, seed: int):
        self.lengths, self.capacity, self.random = lengths, capacity, random.Random(seed)
        self.bound = math.ceil(sum(lengths) / capacity)

    def fill(self, of: list[int]) -> int:
        return sum(self.lengths[i] for i in of)

    def fit(self, bins: list[list[int]], items: list[int], noise: float = 0.0) -> list[list[int]]:
        """``bins`` with ``items`` put in by best fit, longest first; ``noise`` blurs the order."""
        room = sorted((self.capacity - self.fill(b), at) for at, b in enumerate(bins))
        blur = self.random.uniform
        for i in sorted(items, key=lambda i: -self.lengths[i] * (blur(1 - noise, 1 + noise) if noise else 1)):
            need = self.lengths[i]
            at = bisect_left(room, (need, -1))
            if at == len(room):
                bins.append([i])
                insort(room, (self.capacity - need, len(bins) - 1))
            else:
                left, number = room.pop(at)
                bins[number].append(i)
                insort(room, (left - need, number))
        return bins

    def worth(self, bins: list[list[int]]) -> tuple[int, float]:
        """Fewer bins are better; among equals, full ones beside empty ones."""
        return -len(bins), sum((self.fill(b) / self.capacity) ** 2 for b in bins)

    def cross(self, mother: list[list[int]], father: list[list[int]]) -> list[list[int]]:
        """Whole well-filled bins of ``father`` in ``mother``."""
        full = sorted(father, key=self.fill, reverse=True)
        full = full[: max(1, len(full) // 2)]
        child = [list(b) for b in self.random.sample(full, max(1, len(full) // self.random.randint(2, 6)))]
        taken = {i for b in child for i in b}
        displaced = []
        for b in mother:
            if taken.isdisjoint(b):
                child.append(list(b))
            else:
                displaced += [i for i in b if i not in taken]
        return self.fit(child, displaced)

    def mutate(self, bins: list[list[int]]) -> list[list[int]]:
        """Empties the worst bins and a few others and refits their pieces."""
        order = sorted(bins, key=self.fill)
        out = order[: max(1, len(order) // 20)]
        rest = order[len(out) :]
        self.random.shuffle(rest)
        cut = min(len(rest), len(out))
        out, rest = out + rest[:cut], rest[cut:]
        return self.fit([list(b) for b in rest], [i for b in out for i in b], 0.2)

    def evolve(self, given: list[list[list[int]]], children: int) -> list[list[int]]:
        """The best solution after some generations from ``given`` solutions."""
        people = list(given) or [self.fit([], list(range(len(self.lengths))))]
        while len(people) < POPULATION and len(min(people, key=len)) > self.bound:
            people.append(self.fit([], list(range(len(self.lengths))), 0.3))
        for _ in range(children):
            people.sort(key=self.worth, reverse=True)
            if len(people[0]) <= self.bound:
                break
            mother, father = self.random.sample(people, 2) if len(people) > 1 else people * 2
            child = self.cross(mother, father)
            people = [*people[: POPULATION - 1], self.mutate(child) if self.random.random() < 0.5 else child]
        return max(people, key=self.worth)


def _as_bytes(bins: list[list[int]], n: int) -> bytes:
    of = np.zeros(n, "<i4")
    for number, b in enumerate(bins):
        of[b] = number
    return of.tobytes()


def _as_bins(data: bytes) -> list[list[int]]:
    of = np.frombuffer(data, "<i4")
    bins: list[list[int]] = [[] for _ in range(int(of.max()) + 1 if len(of) else 0)]
    for i, number in enumerate(of.tolist()):
        bins[number].append(i)
    return [b for b in bins if b]


def _evolved(state: DataFrame, capacity: int, epoch: int, groups: int) -> DataFrame:
    """One epoch on every island: ``group, island, lengths, solution, n_bins, bound``."""

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                work = Packing(r["lengths"], capacity, hash((r["group"], r["island"], epoch)))
                given = [_as_bins(x) for x in (r["solution"], r["migrant"]) if x is not None]
                best = work.evolve(given, CHILDREN)
                out.append(
                    {
                        "group": r["group"],
                        "island": r["island"],
                        "lengths": r["lengths"],
                        "solution": _as_bytes(best, len(r["lengths"])),
                        "n_bins": len(best),
                        "bound": work.bound,
                    }
                )
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema(
        [
            ("group", pa.int64()),
            ("island", pa.int32()),
            ("lengths", pa.list_(pa.int32())),
            ("solution", pa.binary()),
            ("n_bins", pa.int32()),
            ("bound", pa.int32()),
        ]
    )
    # Few bytes but much work: the number of tasks follows the islands, not the size.
    spread = state.repartition(math.ceil(groups * ISLANDS / ISLANDS_PER_TASK), "group", "island")
    return spread.mapInArrow(
        run, "group long, island int, lengths array<int>, solution binary, n_bins int, bound int"
    )


def _pack_round(open_pieces: DataFrame, count: int, capacity: int, number: int, group_pieces: int) -> DataFrame:
    """``slot, length, sequence_id, offset, fill`` of every piece in ``slot, length``."""
    groups = max(1, math.ceil(count / group_pieces))
    dealt = open_pieces.select(
        F.pmod(F.xxhash64("slot", F.lit(number)), F.lit(groups)).alias("group"), "slot", F.col("length").cast("int").alias("length")
    )
    # A group's size is bounded by the dealing: slots are unique, so equal documents spread too.
    rows = dealt.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("slot", "length"))).alias("members"))
    rows = write_and_read(rows.select("group", F.col("members.slot").alias("slots"), F.col("members.length").alias("lengths")), "packing-groups")
    state = rows.select(
        "group",
        F.explode(F.array(*[F.lit(k) for k in range(ISLANDS)])).alias("island"),
        "lengths",
        F.lit(None).cast("binary").alias("solution"),
        F.lit(None).cast("binary").alias("migrant"),
    )
    for epoch in range(EPOCHS):
        evolved = write_and_read(_evolved(state, capacity, epoch, groups), "packing-islands")
        # Elites move on to the next island of their group; groups at their bound rest.
        elites = evolved.select(
            "group", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("solution").alias("migrant")
        )
        state = evolved.drop("n_bins", "bound").join(elites, ["group", "island"])
    best = evolved.groupBy("group").agg(F.min_by("solution", F.struct("n_bins", "island")).alias("solution"))

    def place(batches):
        for batch in batches:
            for r in batch.to_pylist():
                bins, slots, lengths = _as_bins(r["solution"]), r["slots"], r["lengths"]
                out = []
                for k, b in enumerate(bins):
                    sequence, at, total = -1 - ((number << 58) | (r["group"] << 18) | k), 0, sum(lengths[i] for i in b)
                    for i in b:
                        out.append((slots[i], lengths[i], sequence, at, total))
                        at += lengths[i]
                columns = [pa.array(x, pa.int64()) for x in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["slot", "length", "sequence_id", "offset", "fill"])

    placed = rows.join(best, "group").select("slots", "lengths", "group", "solution")
    return placed.mapInArrow(place, "slot long, length long, sequence_id long, offset long, fill long")


def pack(
    docs: DataFrame,
    path: str,
    end_id: int,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece.

    A null or empty text is its end id alone.  Only documents longer than ``capacity`` are
    cut; whole-capacity pieces are sequences of their own.  Repeated rows and null ids are
    documents like others; other columns are not read.  An empty table gives no rows.
    """
    cut = write_and_read(pieces(docs, path, end_id, capacity, id_col, text_col), "packing-pieces")
    full = cut.where(F.col("length") == capacity).select("slot", F.col("slot").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left, done = cut.where(F.col("length") < capacity).select("slot", "length"), full
    for number in range(ROUNDS):
        count = left.count()
        if not count:
            break
        placed = write_and_read(_pack_round(left, count, capacity, number, group_pieces), "packing-placed")
        last = number == ROUNDS - 1 or count <= group_pieces
        ready = placed if last else placed.where(F.col("fill") >= UNDERFULL * capacity)
        done = done.union(ready.select("slot", "sequence_id", "offset"))
        if last:
            break
        left = placed.where(F.col("fill") < UNDERFULL * capacity).select("slot", "length")
    return cut.join(done, "slot").select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
