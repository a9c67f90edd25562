"""SimHash near duplicates by pigeonhole blocks.

A fingerprint of 64 bits is cut into six blocks.  Three differing bits touch at most three
blocks, so a linked pair has three whole blocks in common: each distinct fingerprint goes
to the 20 keys of three blocks, rows with one key meet, and the Hamming distance is checked.
A group of a key gives the edges of a spanning forest of its links, never all pairs.

Groups are counted first.  Members of one beyond ``GROUP_LIMIT`` are never brought together by
that key; they meet in a second cut, of its 32 or so free bits in eight blocks, of which five must
agree.  At most 13 bits stay free there, so such a group has 8,192 distinct fingerprints at most.
Both cuts lose no link.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardloom.llm.chunks import small_slices
from hazardloom.session import write_and_read

DISTANCE = 3
SHINGLE = 3
SEED = 42
GROUP_LIMIT = 4_096
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None) -> int:
    """Bits set in over half of the XXH64 of the word shingles, as a signed integer; 0 without words."""
    from xxhash import xxh64_digest

    words = text.encode().translate(LOWER).split() if text else []
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)), strict=False))
    hashes = np.frombuffer(b"".join([xxh64_digest(s, SEED) for s in shingles]), np.uint8).reshape(-1, 8)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        votes += np.unpackbits(hashes[at : at + 4096], axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes)).view(">u8")[0].astype(np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fp`` of every row, in one map stage."""

    def measure(batches):
        for batch in batches:
            for part in small_slices(batch, 512):
                found = [fingerprint(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.int64())], names=["id", "fp"])

    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return source.mapInArrow(measure, "id long, fp long")


def _cuts(bits: list[int], blocks: int) -> list[list[int]]:
    """The bits in ``blocks`` runs of nearly equal length."""
    bounds = [round(k * len(bits) / blocks) for k in range(blocks + 1)]
    return [bits[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


def _mask(bits) -> int:
    return sum(1 << b for b in bits)


def key_masks(bits: list[int], blocks: int) -> list[int]:
    """Masks of the kept bits: every choice of ``blocks - DISTANCE`` whole blocks."""
    cut = _cuts(bits, blocks)
    return [_mask(b for block in chosen for b in block) for chosen in combinations(cut, blocks - DISTANCE)]


FIRST = key_masks(list(range(64)), 6)
SECOND = [
    [m | first for m in key_masks([b for b in range(64) if not first >> b & 1], 8)] for first in FIRST
]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Edges (member, root) that connect the members of a group as their links do."""
    edges, left = [], np.sort(fps)
    while len(left):
        root, left = left[0], left[1:]
        frontier = [root]
        while frontier and len(left):
            near = np.bitwise_count(left ^ frontier.pop()) <= DISTANCE
            found = left[near]
            if len(found):
                left = left[~near]
                frontier.extend(found)
                edges.extend((int(f), int(root)) for f in found)
    return edges


def _meet(keyed: DataFrame) -> DataFrame:
    """Forest edges ``fp, root`` of every (mask, key) group, read in key order one group at a time."""

    def walk(batches):
        held, group = [], None
        for batch in batches:
            masks, keys, fps = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(fps):
                continue
            out = []
            cuts = np.flatnonzero((masks[1:] != masks[:-1]) | (keys[1:] != keys[:-1])) + 1
            starts, ends = [0, *cuts.tolist()], [*cuts.tolist(), len(fps)]
            for a, b in zip(starts, ends, strict=True):
                name = (masks[a], keys[a])
                if name != group:
                    out += forest(np.array(held, np.int64))
                    held, group = [], name
                held.extend(fps[a:b].tolist())
            yield _edge_batch(out)
        yield _edge_batch(forest(np.array(held, np.int64)))

    dealt = keyed.select("mask", "key", "fp").repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
    return dealt.mapInArrow(walk, "fp long, root long")


def _edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    fps, roots = zip(*edges, strict=True) if edges else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.array(roots, pa.int64())], names=["fp", "root"])


def _keyed(mask: int, masks: list[int]) -> Column:
    """Rows (mask number, key) for some masks."""
    return F.array(
        *[F.struct(F.lit(mask + k).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(masks)]
    )


def links(nodes: DataFrame, limit: int = GROUP_LIMIT) -> DataFrame:
    """Edges ``fp, root`` whose components are those of all pairs within ``DISTANCE`` bits.

    ``nodes`` has the distinct fingerprints in ``fp``.
    """
    first = nodes.select("fp", F.inline(_keyed(0, FIRST)))
    # Large groups are told by their counts, so their members go to the second cut from where they are.
    over = first.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
    large = write_and_read(over.select("mask", "key"), "simhash-large")
    edges = _meet(first.join(large, ["mask", "key"], "left_anti"))
    # A literal table of 20 x 56 masks; the rest of the key is the mask's number.
    table = F.array(*[F.array(*[F.lit(_signed(m)) for m in masks]) for masks in SECOND])
    wide = first.join(large, ["mask", "key"], "left_semi")
    wide = wide.select("fp", "mask", F.posexplode(F.get(table, F.col("mask"))).alias("k", "bits"))
    second = wide.select(
        (F.col("mask") * 64 + F.col("k")).alias("mask"), F.col("fp").bitwiseAND(F.col("bits")).alias("key"), "fp"
    )
    return edges.union(_meet(second)).distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``fp, component_id`` of every node: the least ``id`` reachable.

    Labels (null mark, id, fingerprint of that id) fall to the least of the neighbours', then
    to the label of the labelled node (pointer jumping), until no label changes.  Each round's
    labels are written to the shared folder; every join is between two plain tables, so that
    Spark can split a hub.
    """
    both = edges.union(edges.select(F.col("root").alias("fp"), F.col("fp").alias("root"))).toDF("fp", "other").distinct()
    both = write_and_read(both, "simhash-edges")
    labels = both.select("fp").distinct().join(nodes, "fp")
    labels = labels.select("fp", F.struct(F.col("id").isNull().alias("none"), "id", F.col("fp").alias("at")).alias("label"))
    labels, before = write_and_read(labels, "simhash-labels"), None
    while True:
        total = labels.agg(F.sum(F.xxhash64("fp", "label").cast("decimal(38,0)")).alias("x")).collect()[0]["x"]
        if total == before:
            break
        before = total
        sent = both.join(labels, "fp").select(F.col("other").alias("fp"), "label")
        least = write_and_read(labels.union(sent).groupBy("fp").agg(F.min("label").alias("label")), "simhash-labels")
        target = least.select(F.col("fp").alias("at"), F.col("label").alias("next"))
        jumped = least.withColumn("at", F.col("label.at")).join(target, "at").select("fp", F.col("next").alias("label"))
        labels = write_and_read(jumped, "simhash-labels")
    own = nodes.join(labels, "fp", "left")
    return own.select("fp", F.when(F.col("label").isNull(), F.col("id")).otherwise(F.col("label.id")).alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    Null and empty texts have fingerprint zero and are linked to each other like any other.
    A null id takes no part in the least id; a component of null ids only has a null id.
    Repeated rows, also of one id, each come out.  Other columns are not read.
    """
    rows = write_and_read(fingerprints(docs, id_col, text_col), "simhash-rows")
    nodes = write_and_read(rows.groupBy("fp").agg(F.min("id").alias("id")), "simhash-nodes")
    found = write_and_read(components(nodes, links(nodes)), "simhash-components")
    return rows.join(found, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
