"""Token-ID files with fixed-width bit packing.

A file holds the ids of consecutive documents.  Every id takes ``width`` bits, the fewest
that hold the largest id of the vocabulary, lowest bit first.  Ids are cut into blocks of
``BLOCK_IDS``, regardless of document ends; a block starts on a byte and is found by its
offset, so a reader unpacks any block with numpy alone.

    block 0, pad byte, block 1, pad byte, ..., footer, pad byte
    footer: ids of documents (8 bytes each), null marks (1 byte each), numbers of ids (8 bytes each),
            block offsets (8 bytes each), then the tail
    tail:   number of ids, documents, blocks, ids per block, width, MAGIC (8 bytes each, big-endian)

The pad byte is the record separator of the text sink, through which Spark commits the
records of a task as one file on any file system; lost tasks leave no half files.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazardloom.llm.chunks import encoder, small_slices

BLOCK_IDS = 65_536
MAGIC = 0x4944424C4F434B31
TAIL = struct.Struct(">6Q")
PAD = 1


def width_of(vocabulary: int) -> int:
    """Bits for the ids 0 .. vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bits of each id, back to back, lowest bit first."""
    raw = np.ascontiguousarray(ids, dtype="<u4")
    if width == 16:
        return raw.astype("<u2").tobytes()
    bits = np.unpackbits(raw.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return np.packbits(bits.reshape(-1), bitorder="little").tobytes()


def unpack(data, count: int, width: int) -> np.ndarray:
    """``count`` ids from packed bytes."""
    if width == 16:
        return np.frombuffer(data, "<u2", count).astype("<u4")
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=count * width, bitorder="little")
    wide = np.zeros((count, 32), np.uint8)
    wide[:, :width] = bits.reshape(count, width)
    return np.packbits(wide, axis=1, bitorder="little").reshape(-1).view("<u4")


def block_bytes(count: int, width: int) -> int:
    return (count * width + 7) // 8


class FileWriter:
    """Records of one file, in order; holds one block and the footer's numbers."""

    def __init__(self, width: int, block_ids: int = BLOCK_IDS):
        self.width, self.block_ids = width, block_ids
        self.docs, self.nulls, self.counts, self.offsets = [], [], [], []
        self.open, self.n_open, self.at = [], 0, 0

    def _block(self, ids: np.ndarray) -> bytes:
        data = pack(ids, self.width)
        self.offsets.append(self.at)
        self.at += len(data) + PAD
        return data

    def add(self, doc_id: int | None, ids: np.ndarray):
        """Yields the blocks that this document fills."""
        self.docs.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.counts.append(len(ids))
        self.open.append(ids)
        self.n_open += len(ids)
        if self.n_open >= self.block_ids:
            ready = np.concatenate(self.open)
            whole = len(ready) // self.block_ids * self.block_ids
            for at in range(0, whole, self.block_ids):
                yield self._block(ready[at : at + self.block_ids])
            self.open, self.n_open = [ready[whole:]], len(ready) - whole

    def finish(self):
        """Yields the last block and the footer."""
        if self.n_open:
            yield self._block(np.concatenate(self.open))
        numbers = [
            np.array(self.docs, "<i8").tobytes(),
            np.array(self.nulls, "u1").tobytes(),
            np.array(self.counts, "<i8").tobytes(),
            np.array(self.offsets, "<i8").tobytes(),
            TAIL.pack(sum(self.counts), len(self.docs), len(self.offsets), self.block_ids, self.width, MAGIC),
        ]
        yield b"".join(numbers)


class FileReader:
    """Random access to one file given as bytes or a memory map."""

    def __init__(self, data):
        self.data = memoryview(data)
        end = len(self.data) - PAD
        self.n_ids, docs, blocks, self.block_ids, self.width, magic = TAIL.unpack(self.data[end - TAIL.size : end])
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = end - TAIL.size - 8 * blocks - 17 * docs
        self.docs = np.frombuffer(self.data, "<i8", docs, at)
        self.nulls = np.frombuffer(self.data, "u1", docs, at + 8 * docs)
        self.counts = np.frombuffer(self.data, "<i8", docs, at + 9 * docs)
        self.offsets = np.frombuffer(self.data, "<i8", blocks, at + 17 * docs)
        self.starts = np.cumsum(self.counts) - self.counts

    def block(self, k: int) -> np.ndarray:
        count = min(self.block_ids, self.n_ids - k * self.block_ids)
        at = int(self.offsets[k])
        return unpack(self.data[at : at + block_bytes(count, self.width)], count, self.width)

    def ids(self, start: int, count: int) -> np.ndarray:
        """Ids ``start .. start + count`` of the file, as far as it goes, from the blocks that hold them."""
        count = min(count, self.n_ids - start)
        if count <= 0:
            return np.zeros(0, "<u4")
        first, last = start // self.block_ids, (start + count - 1) // self.block_ids
        joined = np.concatenate([self.block(k) for k in range(first, last + 1)])
        return joined[start - first * self.block_ids :][:count]

    def documents(self):
        """Ids of every document in order; each block is unpacked once."""
        k, held, n_held = 0, [np.zeros(0, "<u4")], 0
        for count in self.counts.tolist():
            while n_held < count:
                held.append(self.block(k))
                n_held += len(held[-1])
                k += 1
            joined = np.concatenate(held) if len(held) != 1 else held[0]
            yield joined[:count]
            held, n_held = [joined[count:]], n_held - count


def write_token_files(
    docs: DataFrame, folder: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encode every whole text, append ``end_id``, and write files in ascending order of ``id_col``.

    A null or empty text has the end id alone.  Null ids come first; rows with one id are
    ordered by a hash of their text; identical rows are all written.  ``id_col`` is an integer
    column; other columns are not read.  Range partitions on (id, text hash, row) stay even
    when one id has many rows.
    """
    from hazardloom.llm.chunks import load_tokenizer

    end = np.uint32(end_id).astype("<u4").tobytes()
    width = width_of(max(load_tokenizer(path).get_vocab_size(), end_id + 1))

    def records(batches):
        coder, writer = encoder(path, False), FileWriter(width)
        for batch in batches:
            for part in small_slices(batch):
                out = []
                texts = coder.of(part.column(1).to_pylist())
                for doc_id, data in zip(part.column(0).to_pylist(), texts, strict=True):
                    out += writer.add(doc_id, np.frombuffer(data + end, "<u4"))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
        if writer.docs:
            yield pa.RecordBatch.from_arrays([pa.array(list(writer.finish()), pa.binary())], names=["record"])

    order = ["id", "tie", "row"]
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.col(f"`{text_col}`").alias("text"),
        F.xxhash64(f"`{text_col}`").alias("tie"),
        F.monotonically_increasing_id().alias("row"),
    )
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    packed = ordered.mapInArrow(records, "record binary")
    sink = packed.select(F.col("record").cast("string").alias("value")).write.mode("error")
    sink.option("lineSep", "\n").option("compression", "none").option("maxRecordsPerFile", 0).text(folder)


def file_number(file: Column) -> Column:
    """The number of a part file.  Spark pads it to five digits, so names stop being in order at 100,000."""
    return F.regexp_extract(file, r"part-(\d+)", 1).cast("long")


def read_token_files(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document of a folder.

    ``start`` counts the ids of all documents before it over all files; ``ids`` are
    little-endian unsigned 32-bit integers.  An empty folder gives no rows.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).where("length > 0")
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")

    def documents(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                reader, rows, size = FileReader(content.as_buffer()), [], 0
                docs = zip(reader.docs.tolist(), reader.nulls, reader.starts.tolist(), reader.documents(), strict=True)
                for doc_id, null, start, ids in docs:
                    rows.append((file, None if null else doc_id, start, len(ids), ids.tobytes()))
                    size += len(ids)
                    if size > 1 << 20:
                        yield _doc_batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _doc_batch(rows)

    found = files.mapInArrow(documents, "file string, id long, local long, n_tokens long, ids binary")
    tail = F.expr(f"substring(content, -{TAIL.size + PAD}, 8)")
    totals = files.select("file", F.conv(F.hex(tail), 16, 10).cast("long").alias("n_ids"))
    # One row per file, so one task can add them up.
    before = Window.orderBy(file_number(F.col("file")), "file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("before"))
    return found.withColumn("crc", F.crc32("ids")).join(offsets, "file").select(
        F.col("id").alias(id_col),
        (F.col("before") + F.col("local")).alias("start"),
        "n_tokens",
        "ids",
        F.col("crc").alias("ids_crc32"),
    )


def _doc_batch(rows: list[tuple]) -> pa.RecordBatch:
    file, ids, local, n, data = zip(*rows, strict=True)
    columns = [
        pa.array(file, pa.string()),
        pa.array(ids, pa.int64()),
        pa.array(local, pa.int64()),
        pa.array(n, pa.int64()),
        pa.array(data, pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["file", "id", "local", "n_tokens", "ids"])
