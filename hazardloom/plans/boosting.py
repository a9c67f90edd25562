"""Boosted trees and forests on histograms, as Spark jobs.

Columns are binned once into a written table of one byte a cell.  While that table is small
(``LOCAL_BYTES``), it is broadcast and trees grow inside tasks: a block of boosting rounds in one task, which goes
on from the margins that the block before left in its part, a forest's trees dealt over tasks.  A forest's table travels
packed, a bit a cell where a feature has two bins, up to ``FOREST_BYTES``.  Beyond, the table stays where it is and one job per step sums
histograms of all wanted nodes of all classes: rows are aggregated in their tasks, Spark brings
the sums of a (tree, node, block of features) together, and only best splits reach the driver.
Sums are of integers, so both ways grow the same trees.

Finished blocks of rounds are parts of a :class:`~hazardloom.sources.runs.RunStore`.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardloom.operators import trees as T
from hazardloom.operators.features import is_sparse, set_cells
from hazardloom.operators.trees import Forest, Growing, TreeSpec
from hazardloom.session import scratch_path
from hazardloom.sources.runs import RunStore, settings_digest

# Up to this size of the binned table (rows x features) it is sent to the tasks.
LOCAL_BYTES = 64 << 20
# The same for a forest's packed table; a task holds about twice as much while it grows a tree.
FOREST_BYTES = 192 << 20
# Rows that are packed together, and bytes of a row beside its bins.
PACKED_ROWS = 1 << 14
ROW_BYTES = 20
# Histograms that a task holds before it sends them on.
SUMS_BYTES = 64 << 20
# Rounds, or trees, of a stored block; the second for the way that keeps the table distributed.
BLOCK = 25
FAR_BLOCK = 5
# Features whose histograms travel together, and leaves looked at early by one job.
FEATURE_BLOCK = 32
AHEAD = 8
# Rows whose margins lie in a row of a block's part.
MARGIN_ROWS = 1 << 16
# Rows a scoring task walks down all trees at a time.
SLICE = 256
# Nodes that pass the driver, and lie in a scoring task, at once; a larger model is applied in blocks of trees.
NODE_BLOCK = 1 << 20

NODE_COLUMNS = (
    "round int, cls int, node long, n long, feature int, bin int, cell int, left long, right long, gain double, value array<double>"
)
_NODE_TYPES = pa.schema(
    [("round", pa.int32()), ("cls", pa.int32()), ("node", pa.int64()), ("n", pa.int64()), ("feature", pa.int32()), ("bin", pa.int32()),
     ("cell", pa.int32()), ("left", pa.int64()), ("right", pa.int64()), ("gain", pa.float64()), ("value", pa.list_(pa.float64()))]
)
# A block of rounds grown in a task: its nodes, then the margins of all rows after it.
_BLOCK_TYPES = _NODE_TYPES.append(pa.field("part", pa.int32())).append(pa.field("margins", pa.binary()))


def _block_nodes(block: DataFrame) -> DataFrame:
    return block.where("node is not null").select(*_NODE_TYPES.names)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column of equal lengths, or of sparse vectors; missing entries become NaN."""
    if pa.types.is_struct(column.type):
        size, indices, values = (column.field(i) for i in range(3))
        out = np.zeros((len(column), size[0].as_py() if len(column) else 0))
        lengths = np.diff(indices.offsets.to_numpy())
        out[np.repeat(np.arange(len(column)), lengths), indices.flatten().to_numpy()] = values.flatten().to_numpy(zero_copy_only=False)
        return out
    size = len(column[0]) if len(column) else 0
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _bytes_matrix(column: pa.Array) -> np.ndarray:
    """Rows of a binary column of equal lengths, without a copy."""
    ends = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset :][: len(column) + 1]
    if not len(column):
        return np.zeros((0, 0), np.uint8)
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(len(column), -1)


# --- bins -----------------------------------------------------------------------------------
@dataclass
class Binning:
    """Ranges of the features and the bin of every cell."""

    low: np.ndarray
    high: np.ndarray
    bins: np.ndarray
    first: np.ndarray  # lowest and highest bin with a row
    last: np.ndarray
    two: np.ndarray  # whether no other bin has rows

    @property
    def size(self) -> int:
        return len(self.low)

    def packed_bytes(self, rows: int) -> int:
        """Size of the binned table with a bit for cells of two-valued features."""
        two = int(self.two.sum())
        return rows * (ROW_BYTES + self.size - two) + -(-rows // 8) * two

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.bins[np.arange(self.size), T.cells(x, self.low, self.high)]


def _slices(batch):
    """Parts of a batch small enough to be made dense."""
    for at in range(0, batch.num_rows, SLICE):
        yield batch.slice(at, SLICE)


def _ranges(rows: DataFrame, features: str) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value of every feature; a missing one counts as 0."""
    if is_sparse(rows, features):
        n, size = rows.agg(F.count(features), F.max(f"{features}.size")).first()
        low, high = np.zeros(size), np.zeros(size)
        cells = set_cells(rows, features).groupBy("feature").agg(F.min("value"), F.max("value"), F.count(F.lit(1)))
        for f, a, b, k in cells.collect():  # one per feature
            low[f], high[f] = (a, b) if k == n else (min(a, 0.0), max(b, 0.0))
        return low, high
    vector = array_to_vector(F.transform(features, lambda v: F.coalesce(F.nanvl(v.cast("double"), F.lit(0.0)), F.lit(0.0))))
    found = rows.select(Summarizer.metrics("min", "max").summary(vector).alias("s"))
    found = found.select(vector_to_array("s.min").alias("low"), vector_to_array("s.max").alias("high")).first()
    return np.array(found["low"]), np.array(found["high"])


def bin_table(rows: DataFrame, features: str) -> DataFrame:
    """``feature, low, high, counts`` (rows per cell) of a feature array: two passes, sums before the shuffle."""
    low, high = _ranges(rows, features)
    d = len(low)

    def count(batches):
        total = np.zeros((d, T.CELLS), np.int64)
        for batch in batches:
            for part in _slices(batch):
                at = T.cells(_matrix(part.column(0)), low, high).astype(np.int64) + np.arange(d) * T.CELLS
                total += np.bincount(at.ravel(), minlength=d * T.CELLS).reshape(d, T.CELLS)
        f, c = np.nonzero(total)
        arrays = [pa.array(f, pa.int32()), pa.array(low[f]), pa.array(high[f]), pa.array(c, pa.int32()), pa.array(total[f, c])]
        yield pa.RecordBatch.from_arrays(arrays, names=["feature", "low", "high", "cell", "n"])

    counted = rows.select(features).mapInArrow(count, "feature int, low double, high double, cell int, n long")
    summed = counted.groupBy("feature", "low", "high", "cell").agg(F.sum("n").alias("n"))
    return summed.groupBy("feature", "low", "high").agg(F.sort_array(F.collect_list(F.struct("cell", "n"))).alias("counts"))


def read_binning(table: DataFrame) -> Binning:
    rows = table.orderBy("feature").collect()  # one per feature
    counts = np.zeros((len(rows), T.CELLS), np.int64)
    for i, r in enumerate(rows):
        for cell, n in r["counts"]:
            counts[i, cell] = n
    bins = T.bins_of_cells(counts)
    # Bins rise with the cells.
    first, last = (np.array([b[c > 0][end] if c.any() else 0 for b, c in zip(bins, counts, strict=True)], np.uint8) for end in (0, -1))
    two = np.array([bool(((b == f) | (b == e))[c > 0].all()) for b, c, f, e in zip(bins, counts, first, last, strict=True)], bool)
    return Binning(np.array([r["low"] for r in rows]), np.array([r["high"] for r in rows]), bins, first, last, two)


def binned_rows(rows: DataFrame, key: str, label: str, weight: str, features: str, binning: Binning, seed: int) -> DataFrame:
    """``y``, ``weight`` (fixed point kept as a double), ``number`` (for a forest's draws) and the ``bins`` of each row."""

    def cut(batches):
        for batch in batches:
            for part in _slices(batch):
                bins = binning.apply(_matrix(part.column(3)))
                numbers = T.row_numbers(part.column(0).to_pylist(), seed)
                arrays = [part.column(1), part.column(2), pa.array(numbers), pa.array([r.tobytes() for r in bins], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["y", "weight", "number", "bins"])

    source = rows.select(F.col(key).cast("string"), F.col(label).cast("int"), F.col(weight).cast("double"), F.col(features))
    return source.mapInArrow(cut, "y int, weight double, number long, bins binary")


# --- rows in memory -----------------------------------------------------------------------
@dataclass
class Block:
    """Binned rows of a task."""

    y: np.ndarray
    weight: np.ndarray
    number: np.ndarray  # below 0: no row
    bins: np.ndarray | T.Columns

    @staticmethod
    def from_batch(batch) -> Block:
        y, weight, number = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "weight", "number"))
        return Block(y, weight, number, _bytes_matrix(batch.column("bins")))

    def measures(self, spec: TreeSpec, k: int, tree: int, margins: np.ndarray | None) -> np.ndarray:
        """Integer measures of one tree: gradient, hessian and row count, or class weights and row count."""
        if spec.kind == "boosted":
            g, h = T.gradients(margins, self.y, self.weight)
            return np.column_stack([g[:, tree], h[:, tree], np.ones(len(g), np.int64)])
        times = T.draws(self.number, spec.seed, tree) * (self.number >= 0)
        fixed = np.rint(self.weight * T.FIXED).astype(np.int64) * times
        return np.column_stack([*(np.where(self.y == c, fixed, 0) for c in range(k)), times > 0]).astype(np.int64)


def _node_rows(tree: Growing, bins: np.ndarray, round_: int, cls: int) -> list[dict]:
    return [{"round": round_, "cls": cls, **r} for r in tree.rows(bins)]


def walked_margins(block: Block, k: int, earlier: list[dict]) -> np.ndarray:
    """Margins of all rows after the rounds of some node rows."""
    return Forest.from_rows(earlier, "bin").margins(block.bins, k) if earlier else np.zeros((len(block.y), k))


def grown_rounds(
    spec: TreeSpec, block: Block, k: int, binning: np.ndarray, margins: np.ndarray, first: int, count: int
) -> tuple[list[dict], np.ndarray]:
    """Node rows of ``count`` rounds from ``first`` on, and the margins after them; ``margins`` are those before."""
    columns, out = np.ascontiguousarray(block.bins.T), []
    for r in range(first, first + count):
        g, h = T.gradients(margins, block.y, block.weight)
        margins = margins.copy()
        for c in range(k):
            grown = T.LocalTree(spec, columns, np.column_stack([g[:, c], h[:, c], np.ones(len(g), np.int64)]))
            for leaf in grown.tree.leaves:
                margins[grown.rows(leaf), c] += T.leaf_value(spec, grown.tree.totals(leaf))[0]
            out += _node_rows(grown.tree, binning, r, c)
    return out, margins


def boosted_rounds(spec: TreeSpec, block: Block, k: int, binning: np.ndarray, earlier: list[dict], first: int, count: int) -> list[dict]:
    """Node rows of ``count`` rounds from ``first`` on; ``earlier`` are the node rows before."""
    return grown_rounds(spec, block, k, binning, walked_margins(block, k, earlier), first, count)[0]


# --- the two ways to fit --------------------------------------------------------------------
class Trainer:
    """Fits one model on a run's split; every finished block of rounds is a part of the store."""

    def __init__(self, spec: TreeSpec, k: int, store: RunStore, train: DataFrame, key: str, label: str, weight: str, features: str,
                 local_bytes: int | None = None, block: int | None = None):
        self.spec, self.k, self.store, self.spark = spec, k, store, train.sparkSession
        self.binning = read_binning(store.part("binning", lambda: bin_table(train, features)))
        self.table = store.part("binned", lambda: binned_rows(train, key, label, weight, features, self.binning, spec.seed))
        self.n = self.table.count()
        if spec.kind == "forest":
            self.local = self.binning.packed_bytes(self.n) <= (FOREST_BYTES if local_bytes is None else local_bytes)
        else:
            self.local = self.n * self.binning.size <= (LOCAL_BYTES if local_bytes is None else local_bytes)
        self.block = block or (BLOCK if self.local else FAR_BLOCK)

    def nodes(self) -> DataFrame:
        """All node rows, in a part of their own once the last block is there."""
        return self.store.part("nodes", self._all).select("*")

    def _all(self) -> DataFrame:
        if self.spec.kind == "forest" and self.local:
            return self._forest_tasks()
        if self.local:
            return self._near_rounds()
        earlier, far = [], None
        for first in range(0, self.spec.rounds, self.block):
            count = min(self.block, self.spec.rounds - first)
            name = f"rounds-{first}-{count}"
            if self.store.has(name):
                made = self.store.read(name)
            else:
                far = far or FarRows(self, earlier)
                made = self.store.part(name, lambda: far.block(first, count))  # noqa: B023
            rows = [r.asDict() for r in _block_nodes(made).collect()]  # a block's nodes: bounded by the settings
            earlier += rows
            if far:
                far.applied(rows)
        return self.spark.createDataFrame(pa.Table.from_pylist(earlier, _NODE_TYPES)).coalesce(1)

    def _near_rounds(self) -> DataFrame:
        """Blocks of rounds, a task each, after one another; nodes and margins stay in the blocks' parts."""
        shared, blocks = self._broadcast(), []
        for first in range(0, self.spec.rounds, self.block):
            count = min(self.block, self.spec.rounds - first)
            blocks.append(self.store.part(f"rounds-{first}-{count}", lambda: self._near_block(shared, blocks, first, count)))  # noqa: B023
        none = self.spark.createDataFrame([], NODE_COLUMNS)
        return reduce(DataFrame.unionByName, map(_block_nodes, blocks), none).coalesce(1)

    def _broadcast(self):
        """The whole binned table, whose size was checked, in a fixed order; only wholly equal rows may change places."""
        parts = [Block.from_batch(b) for b in self.table.toArrow().to_batches() if b.num_rows]
        if not parts:
            none = np.zeros(0)
            return self.spark.sparkContext.broadcast(Block(none, none, none.astype(np.int64), np.zeros((0, self.binning.size), np.uint8)))
        block = Block(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("y", "weight", "number", "bins")))
        del parts  # the table is held twice at most
        cells = [block.bins.view(f"S{self.binning.size}").ravel()] if self.binning.size else []
        order = np.lexsort([block.weight, *cells, block.y, block.number])
        ordered = Block(block.y[order], block.weight[order], block.number[order], block.bins[order])
        return self.spark.sparkContext.broadcast(ordered)

    def _packed_rows(self) -> DataFrame:
        """The table in chunks of rows packed by feature: ``n`` rows, and room for as many as fill whole bytes."""
        first, two = self.binning.first, self.binning.two

        def pack(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, PACKED_ROWS):
                    block = Block.from_batch(batch.slice(at, PACKED_ROWS))
                    columns = T.Columns.pack(np.ascontiguousarray(block.bins.T), two, first)
                    y = np.nan_to_num(block.y, nan=-1).astype(np.int32)  # a missing class is no class
                    held = [y, block.weight, block.number, columns.bits, columns.rest]
                    yield pa.RecordBatch.from_pylist([{"n": len(y), "room": -(-len(y) // 8) * 8} | dict(zip(names, (x.tobytes() for x in held), strict=True))])

        names = ["y", "weight", "number", "bits", "rest"]
        return self.table.mapInArrow(pack, "n long, room long, " + ", ".join(f"{c} binary" for c in names))

    def _packed(self):
        """The whole table, whose packed size was checked, filled in a partition at a time; a forest's sums don't ask for an order."""
        chunks, two = self.store.part("packed", self._packed_rows), self.binning.two
        room = chunks.agg(F.sum("room")).first()[0] or 0
        # Places that are left over are no rows.
        columns = T.Columns(two, self.binning.first, np.zeros((int(two.sum()), room // 8), np.uint8), np.zeros((int((~two).sum()), room), np.uint8))
        whole, at = Block(np.full(room, -1, np.int32), np.zeros(room), np.full(room, -1), columns), 0
        for c in chunks.toLocalIterator():
            end = at + c["n"]
            for to, name in ((whole.y, "y"), (whole.weight, "weight"), (whole.number, "number")):
                to[at:end] = np.frombuffer(c[name], to.dtype)
            columns.bits[:, at // 8 : (at + c["room"]) // 8] = np.frombuffer(c["bits"], np.uint8).reshape(len(columns.bits), c["room"] // 8)
            columns.rest[:, at:end] = np.frombuffer(c["rest"], np.uint8).reshape(len(columns.rest), c["n"])
            at += c["room"]
        return self.spark.sparkContext.broadcast(whole)

    def _near_block(self, shared, earlier: list[DataFrame], first: int, count: int) -> DataFrame:
        """Nodes and margins of the rounds after the blocks before."""
        spec, k, bins, rows = self.spec, self.k, self.binning.bins, []
        if earlier and "margins" in earlier[-1].columns:
            before = earlier[-1].where("margins is not null").select("part", "margins")
        else:
            # The first block, or one after blocks of the other way, which keeps margins elsewhere.
            rows = [r.asDict() for b in earlier for r in _block_nodes(b).collect()]
            before = self.spark.range(0, 1, 1, 1).select(F.lit(0).alias("part"), F.lit(None).cast("binary").alias("margins"))

        def grow(batches):
            held = [p for batch in batches for p in zip(*(c.to_pylist() for c in batch.columns), strict=True) if p[1] is not None]
            if held:
                margins = np.frombuffer(b"".join(m for _, m in sorted(held))).reshape(-1, k)
            else:
                margins = walked_margins(shared.value, k, rows)
            grown, margins = grown_rounds(spec, shared.value, k, bins, margins, first, count)
            yield pa.RecordBatch.from_pylist(grown, _BLOCK_TYPES)
            for part, at in enumerate(range(0, len(margins), MARGIN_ROWS)):
                yield pa.RecordBatch.from_pylist([{"part": part, "margins": margins[at : at + MARGIN_ROWS].tobytes()}], _BLOCK_TYPES)

        return before.coalesce(1).mapInArrow(grow, f"{NODE_COLUMNS}, part int, margins binary")

    def _forest_tasks(self) -> DataFrame:
        spec, k, bins, shared = self.spec, self.k, self.binning.bins, self._packed()

        def grow(batches):
            block = shared.value
            for batch in batches:
                for tree in batch.column(0).to_pylist():
                    grown = T.LocalTree(spec, block.bins, block.measures(spec, k, tree, None), tree)
                    yield pa.RecordBatch.from_pylist(_node_rows(grown.tree, bins, tree, 0), _NODE_TYPES)

        tasks = max(1, min(spec.rounds, 4 * self.spark.sparkContext.defaultParallelism))
        return self.spark.range(0, spec.rounds, 1, tasks).mapInArrow(grow, NODE_COLUMNS)


class FarRows:
    """Rows that stay in their table, with the margins of the finished rounds written beside them."""

    def __init__(self, trainer: Trainer, earlier: list[dict]):
        self.t, self.margins = trainer, None
        self.applied(earlier)

    def applied(self, rows: list[dict]) -> None:
        """Add finished rounds to the margins; the table is written once per block."""
        t = self.t
        if t.spec.kind == "forest":
            self.margins = self.margins or t.table
            return
        k, source = t.k, self.margins if self.margins is not None else t.table.withColumn("margins", F.array(*[F.lit(0.0)] * t.k))
        if not rows:
            self.margins = source
            return
        done = rows[-1]["round"]

        def add(batches):
            forest = Forest.from_rows(rows, "bin")
            for batch in batches:
                if not batch.num_rows:
                    continue
                block, total = Block.from_batch(batch), _matrix(batch.column("margins")).copy()
                at = forest.leaves(block.bins)
                for tree, c in enumerate(forest.of.tolist()):  # in the order of the rounds, as they were grown
                    total[:, c] += forest.value[at[:, tree], 0]
                arrays = [*batch.columns[:-1], pa.array(total.tolist(), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

        added = source.mapInArrow(add, "y int, weight double, number long, bins binary, margins array<double>")
        self.margins = t.store.part(f"margins-{done}", lambda: added)

    def block(self, first: int, count: int) -> DataFrame:
        out = []
        if self.t.spec.kind == "forest":
            grown = self._grow(range(first, first + count), [])
            for tree in range(first, first + count):
                out += _node_rows(grown[tree], self.t.binning.bins, tree, 0)
        else:
            for r in range(first, first + count):
                grown = self._grow(range(self.t.k), out)
                for c in range(self.t.k):
                    out += _node_rows(grown[c], self.t.binning.bins, r, c)
        return self.t.spark.createDataFrame(pa.Table.from_pylist(out, _NODE_TYPES)).coalesce(1)

    def _grow(self, numbers, recent: list[dict]) -> dict[int, Growing]:
        """Grow one tree per number, all in the same jobs."""
        growing = {i: Growing(self.t.spec, AHEAD) for i in numbers}
        while True:
            wanted = {i: w for i, tree in growing.items() if (w := tree.wanted())}
            if not wanted:
                return growing
            for i, splits in self._splits(growing, wanted, recent).items():
                growing[i].accept(splits)

    def _splits(self, growing: dict[int, Growing], wanted: dict[int, list[int]], recent: list[dict]) -> dict[int, dict[int, T.Split]]:
        spec, k, d = self.t.spec, self.t.k, self.t.binning.size
        growing = {i: growing[i] for i in wanted}

        def features(tree: int, node: int) -> np.ndarray:
            return T.node_features(spec.seed, tree, node, d) if spec.kind == "forest" else np.arange(d)

        def measure(batches):
            since = Forest.from_rows(recent, "bin") if recent else None
            sums: dict = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                block, margins = Block.from_batch(batch), None
                if spec.kind == "boosted":
                    margins = _matrix(batch.column("margins")).copy()
                    if since:
                        at = since.leaves(block.bins)
                        for tree, c in enumerate(since.of.tolist()):
                            margins[:, c] += since.value[at[:, tree], 0]
                for i, tree in growing.items():
                    measures = block.measures(spec, k, i, margins)
                    nodes = T.moved(np.ones(len(block.y), np.int64), block.bins, tree)
                    drawn = np.flatnonzero(measures[:, -1] > 0)
                    drawn = drawn[np.argsort(nodes[drawn], kind="stable")]
                    ends = np.searchsorted(nodes[drawn], [[n, n + 1] for n in wanted[i]]).tolist()
                    for node, (first, end) in zip(wanted[i], ends, strict=True):
                        if first == end:
                            continue
                        at, chosen = drawn[first:end], features(i, node)
                        for b in range(0, len(chosen), FEATURE_BLOCK):
                            hist = T.histogram(block.bins[at[:, None], chosen[b : b + FEATURE_BLOCK]], measures[at])
                            sums[i, node, b] = sums[i, node, b] + hist if (i, node, b) in sums else hist
                        if len(sums) * hist.nbytes > SUMS_BYTES:
                            yield from sent(sums)
                            sums = {}
            yield from sent(sums)

        def sent(sums):
            for (i, node, b), hist in sums.items():
                cells = np.flatnonzero(hist[-1].ravel())  # the others have no row
                row = {"tree": i, "node": node, "part": b, "cells": cells.astype(np.int32).tobytes(), "sums": hist.reshape(len(hist), -1)[:, cells].tobytes()}
                yield pa.RecordBatch.from_pylist([row], partial)

        def choose(batches):
            # The rows of a node's features follow each other.
            now, hist = None, None
            for batch in batches:
                for r in batch.to_pylist():
                    key = r["tree"], r["node"], r["part"]
                    if key != now:
                        if now:
                            yield chosen_split(now, hist)
                        now, hist = key, np.zeros((measured, len(some_features(*key)), T.BINS), np.int64)
                    cells = np.frombuffer(r["cells"], np.int32)
                    hist.reshape(measured, -1)[:, cells] += np.frombuffer(r["sums"], np.int64).reshape(measured, -1)
            if now:
                yield chosen_split(now, hist)

        def some_features(tree: int, node: int, b: int) -> np.ndarray:
            return features(tree, node)[b : b + FEATURE_BLOCK]

        def chosen_split(key, hist):
            s = T.best_split(spec, hist, some_features(*key))
            row = {"tree": key[0], "node": key[1], "gain": s.gain, "feature": s.feature, "bin": s.bin, "total": s.total, "left": s.left}
            return pa.RecordBatch.from_pylist([row], best)

        measured = 3 if spec.kind == "boosted" else k + 1
        partial = pa.schema([("tree", pa.int32()), ("node", pa.int64()), ("part", pa.int32()), ("cells", pa.binary()), ("sums", pa.binary())])
        best = pa.schema([("tree", pa.int32()), ("node", pa.int64()), ("gain", pa.float64()), ("feature", pa.int32()), ("bin", pa.int32()),
                          ("total", pa.list_(pa.int64())), ("left", pa.list_(pa.int64()))])
        keys = "tree", "node", "part"
        summed = self.margins.mapInArrow(measure, "tree int, node long, part int, cells binary, sums binary").repartition(*keys).sortWithinPartitions(*keys)
        splits = summed.mapInArrow(choose, "tree int, node long, gain double, feature int, bin int, total array<long>, left array<long>")
        first = F.max_by(F.struct("gain", "feature", "bin", "total", "left"), F.struct("gain", -F.col("feature"))).alias("s")
        found: dict = {i: {} for i in wanted}
        for r in splits.groupBy("tree", "node").agg(first).collect():  # one per wanted node
            found[r["tree"]][r["node"]] = T.Split(r["s"]["gain"], r["s"]["feature"], r["s"]["bin"], list(r["s"]["total"]), list(r["s"]["left"]))
        for i, nodes in wanted.items():  # a node that no row reaches
            for n in nodes:
                found[i].setdefault(n, T.Split(0.0, 0, 0, [0] * measured, [0] * measured))
        return found


# --- models -----------------------------------------------------------------------------------
@dataclass
class TreeModel:
    """A fitted model: a table of nodes and the ranges of the features."""

    spec: TreeSpec
    k: int
    nodes: DataFrame
    ranges: DataFrame

    def arrays(self) -> tuple[Forest, np.ndarray, np.ndarray]:
        """The nodes and ranges as arrays."""
        wanted = ["round", "cls", "node", "n", F.coalesce("feature", F.lit(-1)).alias("feature")]
        wanted += [F.coalesce(c, F.lit(0)).alias(c) for c in ("cell", "left", "right")]
        found = self.nodes.select(*wanted, "value").toArrow().combine_chunks()
        lists = pa.concat_arrays(found["value"].chunks) if found.num_rows else pa.array([], pa.list_(pa.float64()))
        leaf, width = ~lists.is_null().to_numpy(zero_copy_only=False), 1
        if leaf.any():
            width = len(lists[int(leaf.argmax())])
        value = np.zeros((found.num_rows, width))
        value[leaf] = lists.flatten().to_numpy().reshape(-1, width)
        columns = {c: found[c].to_numpy() for c in found.column_names if c != "value"}
        ranges = self.ranges.orderBy("feature").collect()
        return Forest.from_columns(columns, value), np.array([r["low"] for r in ranges]), np.array([r["high"] for r in ranges])

    def blocks(self) -> list[tuple[int, int]]:
        """Ranges (first, last) of rounds with at most ``NODE_BLOCK`` nodes, or one round, each."""
        out, size = [], 0
        for r in self.nodes.groupBy("round").count().orderBy("round").collect():  # one per round
            if out and size + r["count"] <= NODE_BLOCK:
                out[-1], size = (out[-1][0], r["round"]), size + r["count"]
            else:
                out, size = [*out, (r["round"], r["round"])], r["count"]
        return out

    def upto(self, rounds: int) -> TreeModel:
        """The model after its first rounds, or trees."""
        return TreeModel(self.spec, self.k, self.nodes.where(F.col("round") < rounds), self.ranges)

    def predict(self, rows: DataFrame, features: str, keep: list[str], rounds: int | None = None) -> DataFrame:
        """``keep``, the class ``yhat`` and the class probabilities ``scores``; ``rounds`` stops early.

        One map stage, or one per block of trees where the model has more nodes than one holds (``NODE_BLOCK``).
        """
        model = self if rounds is None else self.upto(rounds)
        blocks = model.blocks()
        if len(blocks) > 1:
            return model._predict_in_blocks(rows, features, keep, blocks)
        forest, low, high = model.arrays()
        boosted, k = self.spec.kind == "boosted", self.k

        def walk(x: np.ndarray) -> list[pa.Array]:
            x = T.cells(x, low, high)
            scores = T.softmax(forest.margins(x, k)) if boosted else forest.shares(x, k)
            return [pa.array(scores.argmax(axis=1), pa.int32()), pa.array(list(scores), pa.list_(pa.float64()))]

        return _by_slices(rows, features, keep, walk, "yhat int, scores array<double>")

    def _predict_in_blocks(self, rows: DataFrame, features: str, keep: list[str], blocks: list[tuple[int, int]]) -> DataFrame:
        """The rows' cells and running totals are written per block, to two places in turn; the totals add up in tree order."""
        spark, boosted, k = self.nodes.sparkSession, self.spec.kind == "boosted", self.k
        paths, state, trees = [scratch_path(spark, "scores") for _ in range(2)], None, 0
        for number, (first, last) in enumerate(blocks):
            forest, low, high = TreeModel(self.spec, k, self.nodes.where(F.col("round").between(first, last)), self.ranges).arrays()
            trees += len(forest.roots)

            def begin(x: np.ndarray) -> list[pa.Array]:
                x, total = T.cells(x, low, high), np.zeros((len(x), k))  # noqa: B023
                forest.add(x, total)  # noqa: B023
                return [pa.array([r.tobytes() for r in x], pa.binary()), pa.array(list(total), pa.list_(pa.float64()))]

            def go_on(batches):
                for batch in batches:
                    for part in _slices(batch):
                        total = _matrix(part.column("__total")).copy()
                        forest.add(_bytes_matrix(part.column("__cells")).view(np.uint16), total)  # noqa: B023
                        arrays = [*part.columns[:-1], pa.array(list(total), pa.list_(pa.float64()))]
                        yield pa.RecordBatch.from_arrays(arrays, names=part.schema.names)

            if state is None:
                state = _by_slices(rows, features, keep, begin, "__cells binary, __total array<double>")
            else:
                state = state.mapInArrow(go_on, state.schema)
            state.write.mode("overwrite").parquet(paths[number % 2])
            state = spark.read.schema(state.schema).parquet(paths[number % 2])

        def finish(total: np.ndarray) -> list[pa.Array]:
            scores = T.softmax(total) if boosted else total / trees
            return [pa.array(scores.argmax(axis=1), pa.int32()), pa.array(list(scores), pa.list_(pa.float64()))]

        return _by_slices(state, "__total", keep, finish, "yhat int, scores array<double>")

    def contributions(self, rows: DataFrame, features: str, keep: list[str], cls: str) -> DataFrame:
        """``keep``, the ``base`` and the ``contribution`` of every feature to the margin (boosted) or share (forest) of
        the class in column ``cls``; base and contributions add up to it."""
        forest, low, high = self.arrays()
        k = self.k

        def explain(x: np.ndarray, wanted: np.ndarray) -> list[pa.Array]:
            each, base = forest.contributions(T.cells(x, low, high), k, len(low))
            chosen = each[np.arange(len(x)), wanted]
            return [pa.array(base[wanted]), pa.array(list(chosen), pa.list_(pa.float64()))]

        return _by_slices(rows, features, keep, explain, "base double, contribution array<double>", cls)

    def save(self, folder: str) -> None:
        spark = self.nodes.sparkSession
        self.nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
        self.ranges.select("feature", "low", "high").write.mode("overwrite").parquet(f"{folder}/ranges")
        text = json.dumps({"spec": asdict(self.spec), "k": self.k})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/settings")


def load_model(spark: SparkSession, folder: str) -> TreeModel | None:
    """A saved model, or None when there is none in the folder."""
    try:
        settings = json.loads(spark.read.text(f"{folder}/settings").first()["value"])
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    nodes, ranges = spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/ranges")
    return TreeModel(TreeSpec(**settings["spec"]), settings["k"], nodes, ranges)


def _by_slices(rows: DataFrame, features: str, keep: list[str], work, added: str, also: str | None = None) -> DataFrame:
    source = rows.select(*[F.col(f"`{c}`") for c in keep], *([F.col(f"`{also}`").cast("int").alias("__also")] if also else []),
                         (F.col(features) if is_sparse(rows, features) else F.col(f"`{features}`").cast("array<double>")).alias("__x"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[: len(keep)])
    names = [*keep, *[c.split()[0] for c in added.split(", ")]]

    def run(batches):
        for batch in batches:
            for part in _slices(batch):
                more = [part.column("__also").to_numpy(zero_copy_only=False)] if also else []
                results = work(_matrix(part.column("__x")), *more)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *results], names=names)

    return source.mapInArrow(run, f"{kept}, {added}")


def fit_trees(spec: TreeSpec, train: DataFrame, key: str, label: str, weight: str, features: str, k: int, store: RunStore,
              **ways) -> TreeModel:
    """Fit, or go on fitting, a model on the rows of ``train`` in the run's store."""
    inner = store.inside("trees", settings_digest(asdict(spec), k))
    if inner.has("nodes"):
        return TreeModel(spec, k, inner.read("nodes"), inner.read("binning"))
    trainer = Trainer(spec, k, inner, train, key, label, weight, features, **ways)
    return TreeModel(spec, k, trainer.nodes(), inner.read("binning"))
