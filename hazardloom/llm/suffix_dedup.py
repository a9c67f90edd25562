"""Exact removal of repeated byte strings by blockwise suffix sorting over a sampled cover.

A byte goes if a string of ``LENGTH`` bytes around it starts anywhere else too.  Sorting all
suffixes would bring such strings side by side; most suffixes are settled long before.

Cover.  Every window of ``LENGTH`` bytes samples one place: the leftmost of its byte grams with
the least hash.  Equal windows sample the same place in them, so any two equal strings hold a
sampled suffix at the same distance - what a difference cover ensures by numbering, here by
content, and with one sample in about 180 bytes.  Consecutive windows with one sample are a
*run*; the hash of the sample's gram is its bucket.

Blocks.  A bucket with one run has no repeats.  Runs of a bucket whose bytes agree throughout are
repeats throughout.  Only the distinct runs of the remaining buckets are sorted, one bucket at a
time: the sampled suffixes are ranked once, forward and backward, with the common lengths of
neighbours; the suffixes at each distance before the sample are then told apart by two ranks, that
of the few bytes before the sample and that of the sampled suffix, so long ties are never compared
byte by byte.  A bucket holds ``BUCKET_RUNS`` runs at most in memory; windows of larger buckets are
counted by 128-bit hashes with map-side sums, wherever they lie.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardloom.session import write_and_read

LENGTH = 400
GRAM = 32
BUCKET_RUNS = 2_048
# Bytes hashed at once; longer texts go in pieces that overlap by a window.
PIECE = 1 << 20
PLACE_BITS = 24
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(base, -1, 1 << 64)
    out = []
    for x in (base, inverse):
        steps = np.full(n, x, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


class Hashes:
    """Polynomial hashes of any byte range, modulo 2^64, for a worker."""

    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, base: int = BASES[0]):
        n = len(data) + 1
        if base not in self.known or len(self.known[base][0]) < n:
            self.known[base] = _powers(base, max(n, PIECE + LENGTH + 1))
        powers, self.inverse = self.known[base]
        self.sums = np.zeros(n, np.uint64)
        np.cumsum((data.astype(np.uint64) + 1) * powers[: n - 1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def runs(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Runs of documents laid back to back, ending at ``ends``: first window, last window, sample, bucket, content hash."""
    n, width = len(data), length - gram + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none
    hashes = Hashes(data)
    grams = mixed((hashes.sums[gram:] - hashes.sums[:-gram]) * hashes.inverse[: n - gram + 1])
    low = np.uint64((1 << PLACE_BITS) - 1)
    keys = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    windows = n - length + 1
    padded = np.full(-(-len(keys) // width) * width, ~np.uint64(0))
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(backward[:windows], forward[width - 1 : width - 1 + windows])
    sample = (least & low).astype(np.int64)
    valid = np.zeros(windows + 1, bool)
    begin = 0
    for end in ends.tolist():
        valid[begin : max(begin, end - length + 1)] = True
        begin = end
    valid[windows] = False
    changed = np.flatnonzero(np.r_[True, (sample[1:] != sample[:-1]) | ~valid[: windows - 1]] & valid[:windows])
    stops = np.flatnonzero(valid[:windows] & np.r_[(sample[1:] != sample[:-1]) | ~valid[1:windows], True])
    place = sample[changed]
    content = hashes.of(changed, stops + length).view(np.int64)
    shape = mixed(((place - changed) * 1024 + stops - changed).astype(np.uint64)).view(np.int64)
    return changed, stops, place, grams[place].view(np.int64), content ^ shape


def _joined(texts: list[bytes]):
    """Groups of (first text, offset in it, bytes, ends): texts back to back, long ones in overlapping pieces."""
    first, held, size = 0, [], 0
    for k, text in enumerate(texts):
        if held and size + len(text) > PIECE:
            yield first, 0, held
            held, size = [], 0
        if len(text) > PIECE:
            for at in range(0, len(text) - LENGTH + 1, PIECE - LENGTH + 1):
                yield k, at, [text[at : at + PIECE]]
            first = k + 1
            continue
        if not held:
            first = k
        held.append(text)
        size += len(text)
    if held:
        yield first, 0, held


def _all_runs(rows: DataFrame) -> DataFrame:
    """``row, first, last, sample, bucket, content`` over (row, text)."""

    def find(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                numbers = part.column(0).to_numpy(zero_copy_only=False)
                texts = [(x or "").encode() for x in part.column(1).to_pylist()]
                for k, offset, held in _joined(texts):
                    ends = np.cumsum([len(x) for x in held])
                    first, last, place, bucket, content = runs(np.frombuffer(b"".join(held), np.uint8), ends)
                    if not len(first):
                        continue
                    of = np.searchsorted(ends, first, side="right")
                    shift = offset - (ends - [len(x) for x in held])[of]
                    arrays = [numbers[k + of], first + shift, last + shift, place + shift, bucket, content]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=names)

    names = ["row", "first", "last", "sample", "bucket", "content"]
    return rows.mapInArrow(find, ", ".join(f"{c} long" for c in names))


def ranks(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of byte strings and the common length of each with the one before."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    size = max(map(len, parts))
    table = np.frombuffer(b"".join(parts[k].ljust(size, b"\0") for k in order), np.uint8).reshape(len(parts), size)
    lengths = np.array([len(parts[k]) for k in order])
    differ = np.ones((len(parts) - 1, size + 1), bool)
    differ[:, :size] = table[1:] != table[:-1]
    common = np.minimum(differ.argmax(axis=1), np.minimum(lengths[1:], lengths[:-1]))
    return np.array(order), np.r_[0, common]


def sorted_bucket(texts: list[bytes], before: list[int], windows: list[int], length: int = LENGTH) -> np.ndarray:
    """For distinct runs of a bucket, which of their windows occur in another: (distance before the sample, run).

    ``before`` is the distance of a run's first window from the sample, ``windows`` their number.
    """
    m, most = len(texts), max(before) + 1
    right, common_right = ranks([t[b:] for t, b in zip(texts, before, strict=True)])
    left, common_left = ranks([t[:b][::-1] for t, b in zip(texts, before, strict=True)])
    distance = np.arange(most)[:, None]
    of_right, of_left = np.empty((most, m), np.int64), np.empty((most, m), np.int64)
    of_right[:, right] = np.cumsum(common_right[None, :] < length - distance, axis=1)
    of_left[:, left] = np.cumsum(common_left[None, :] < distance, axis=1)
    b, w = np.array(before), np.array(windows)
    present = (distance <= b) & (distance > b - w)
    pair = np.where(present, of_right * (m + 1) + of_left, -1 - np.arange(m))
    order = np.argsort(pair, axis=1, kind="stable")
    ranked = np.take_along_axis(pair, order, axis=1)
    tie = ranked[:, 1:] == ranked[:, :-1]
    same = np.zeros((most, m), bool)
    same[:, 1:] |= tie
    same[:, :-1] |= tie
    out = np.zeros((most, m), bool)
    np.put_along_axis(out, order, same, axis=1)
    return out & present


def _stretches(flags: np.ndarray) -> list[tuple[int, int]]:
    """(start, stop) of the true stretches."""
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _span_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["row", "start", "stop"])


def _bucket_spans(contexts: DataFrame, length: int = LENGTH) -> DataFrame:
    """Repeated spans of the distinct runs, one bucket in memory at a time."""

    def walk(batches):
        group, held = None, []

        def close():
            if len(held) < 2:
                return []
            found = sorted_bucket([r[4] for r in held], [r[3] for r in held], [r[2] for r in held], length)
            out = []
            for k, (row, first, _, before, _) in enumerate(held):
                for a, b in _stretches(found[::-1, k]):
                    # Distances fall along the text: the column read upwards starts at the largest.
                    start = first + before - (len(found) - 1 - a)
                    out.append((row, start, start + b - a - 1 + length))
            return out

        for batch in batches:
            rows = []
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r[0] != group:
                    rows += close()
                    group, held = r[0], []
                held.append(r[1:])
            yield _span_batch(rows)
        yield _span_batch(close())

    dealt = contexts.select("bucket", "row", "first", "windows", "before", "bytes")
    dealt = dealt.repartition("bucket").sortWithinPartitions("bucket", "row", "first")
    return dealt.mapInArrow(walk, "row long, start long, stop long")


def _window_spans(contexts: DataFrame, length: int = LENGTH) -> DataFrame:
    """Repeated spans in buckets too large for one task: windows counted by two 64-bit hashes."""

    def spread(batches):
        for batch in batches:
            for row, first, windows, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw, at = np.frombuffer(data, np.uint8), np.arange(windows)
                one, two = (Hashes(raw, b).of(at, at + length).view(np.int64) for b in BASES)
                columns = [pa.array(np.full(windows, row)), pa.array(at + first), pa.array(one), pa.array(two)]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "start", "one", "two"])

    every = contexts.select("row", "first", "windows", "bytes").mapInArrow(spread, "row long, start long, one long, two long")
    every = write_and_read(every, "dedup-windows")
    often = every.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("one", "two")
    return every.join(write_and_read(often, "dedup-often"), ["one", "two"]).select(
        "row", "start", (F.col("start") + length).alias("stop")
    )


def repeated_spans(rows: DataFrame) -> DataFrame:
    """``row, start, stop`` of byte spans, which may overlap, over (row, text)."""
    found = write_and_read(_all_runs(rows), "dedup-runs")
    buckets = found.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min("content").alias("least"), F.max("content").alias("most")
    )
    buckets = buckets.where("n > 1").select("bucket", (F.col("least") != F.col("most")).alias("mixed"))
    shared = write_and_read(found.join(write_and_read(buckets, "dedup-buckets"), "bucket"), "dedup-shared")
    whole = ["row", F.col("first").alias("start"), (F.col("last") + LENGTH).alias("stop")]
    alike = shared.where("not mixed").select(*whole)
    mixed_runs = shared.where("mixed").drop("mixed")
    distinct = mixed_runs.groupBy("bucket", "content").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "first", "last", "sample")).alias("one")
    )
    distinct = write_and_read(distinct, "dedup-distinct")
    copies = mixed_runs.join(distinct.where("n > 1").select("bucket", "content"), ["bucket", "content"]).select(*whole)
    sizes = distinct.groupBy("bucket").count()
    large = write_and_read(sizes.where(F.col("count") > BUCKET_RUNS).select("bucket", F.lit(True).alias("large")), "dedup-large")
    needed = distinct.join(large, "bucket", "left").select("bucket", F.coalesce("large", F.lit(False)).alias("large"), "one.*")
    per_row = needed.groupBy("row").agg(F.collect_list(F.struct("bucket", "large", "first", "last", "sample")).alias("runs"))

    def cut(batches):
        for batch in batches:
            for row, text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = text.encode()
                out = [
                    (r["bucket"], r["large"], row, r["first"], r["last"] - r["first"] + 1, r["sample"] - r["first"], data[r["first"] : r["last"] + LENGTH])
                    for r in wanted
                ]
                for a in range(0, len(out), 1_000):
                    columns = zip(*out[a : a + 1_000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    names = ["bucket", "large", "row", "first", "windows", "before", "bytes"]
    kinds = [pa.int64(), pa.bool_(), *[pa.int64()] * 4, pa.binary()]
    contexts = rows.join(per_row, "row").select("row", "text", "runs").mapInArrow(
        cut, "bucket long, large boolean, row long, first long, windows long, before long, bytes binary"
    )
    contexts = write_and_read(contexts, "dedup-contexts")
    # Each part is a table of its own, so that Spark can split the hot keys of its join.
    parts = [alike, copies, _bucket_spans(contexts.where("not large"))]
    if not large.isEmpty():
        parts.append(_window_spans(contexts.where("large")))
    return reduce(DataFrame.union, [write_and_read(part, "dedup-spans") for part in parts])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` of every row; ``kept`` are the remaining bytes.

    A null or empty text has no bytes; repeated rows repeat each other; null ids are kept; other
    columns are not read.  ``docs`` is read three times and must be a stored table, since its
    rows are told apart by their place in it.
    """
    source = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(f"`{id_col}`").alias("id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )
    spans = repeated_spans(source.select("row", "text"))
    per_row = spans.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    joined = source.join(per_row, "row", "left").select("id", "text", "spans.start", "spans.stop")

    def remove(batches):
        for batch in batches:
            ids, out = batch.column(0), []
            for text, starts, stops in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                data = text.encode()
                kept, at, n_spans = [], 0, 0
                until = -1
                for start, stop in zip(starts or (), stops or (), strict=True):
                    if start > until:
                        n_spans += 1
                        kept.append(data[at:start])
                    until = at = max(until, stop)
                kept.append(data[at:])
                rest = b"".join(kept)
                out.append((len(data), len(data) - len(rest), n_spans, rest))
            columns = list(zip(*out, strict=True)) or [()] * 4
            arrays = [ids, *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = joined.schema["id"].dataType.simpleString()
    found = joined.mapInArrow(remove, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
    return found.withColumnRenamed("id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The registered result."""
    return found.select(f"`{id_col}`", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
