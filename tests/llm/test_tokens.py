"""Token counts, token files and packing against the library."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hazardloom.llm import packing, token_counts, token_files
from hazardloom.llm.chunks import Encoder
from hazardloom.session import scratch_path

from .conftest import AWKWARD

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "a", " a", "a ", "  a  b", "a\n\nb", "it's 'S we'll x's", "née ſt ŉ ÿŸ", "1234 ²³¼", "a_b--c!!  ?", "\x1ca\x1d b",
    "<|endoftext|>", "x<|startoftext|>y <|endoftext|> z", "İx é é ́", "word,word.word", "中文 字 🙂🙂", "a b\u0085c", "Ⱥ ȿ ə",
]


@pytest.mark.parametrize("path, words", [(WORD, True), (BYTE, False)])
def test_chunks_encode_as_the_library_does(path, words, texts):
    tokenizer, coder = Tokenizer.from_file(path), Encoder(path, words)
    for text in [*ODD, *[t for _, t, _ in AWKWARD if t], *list(texts.values())[:60]]:
        expected = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(coder.of([text])[0], "<u4").tolist() == expected, text[:80]


def test_whole_tokens_are_proven():
    tokenizer, whole = Tokenizer.from_file(WORD), token_counts.whole_tokens(WORD)
    assert len(whole) > 30_000 and "the" in whole
    assert all(len(tokenizer.encode(s, add_special_tokens=False).ids) == 1 for s in list(whole)[:2000])


def test_token_counts(spark, awkward):
    tokenizer = Tokenizer.from_file(WORD)
    got = sorted(map(tuple, token_counts.token_counts(awkward, WORD, 2048).collect()), key=repr)
    expected = []
    for doc_id, text, _ in AWKWARD:
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        expected.append((doc_id, len((text or "").encode()), n, n > 2048))
    assert got == sorted(expected, key=repr)
    assert token_counts.token_counts(awkward.limit(0), WORD, 2048).count() == 0


@pytest.mark.parametrize("width", [1, 3, 11, 16, 17, 32])
def test_bits_round_trip(width):
    rng = np.random.default_rng(width)
    ids = rng.integers(0, 2**width, 1001, dtype=np.uint64).astype("<u4")
    data = token_files.pack(ids, width)
    assert len(data) == token_files.block_bytes(len(ids), width)
    assert (token_files.unpack(data, len(ids), width) == ids).all()
    assert len(token_files.pack(ids[:0], width)) == 0


def test_random_access_across_blocks():
    rng = np.random.default_rng(1)
    docs = [(k if k % 5 else None, rng.integers(0, 50_000, n).astype("<u4")) for k, n in enumerate([0, 1, 99, 100, 101, 250, 3])]
    writer = token_files.FileWriter(16, block_ids=100)
    records = [r for d, ids in docs for r in writer.add(d, ids)]
    data = b"".join(r + b"\n" for r in [*records, *writer.finish()])
    reader = token_files.FileReader(data)
    everything = np.concatenate([ids for _, ids in docs])
    for start in range(0, len(everything), 37):
        assert (reader.ids(start, 130) == everything[start : start + 130]).all()
    for (_, expected), found in zip(docs, reader.documents(), strict=True):
        assert (expected == found).all()
    assert reader.nulls.tolist() == [d is None for d, _ in docs]


def test_token_files(spark, awkward):
    tokenizer = Tokenizer.from_file(BYTE)
    folder = scratch_path(spark, "tokens")
    token_files.write_token_files(awkward, folder, BYTE, end_id=2)
    rows = sorted(token_files.read_token_files(spark, folder).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted((r[0] for r in AWKWARD), key=lambda i: (i is not None, i))
    at, left = 0, defaultdict(list)
    for doc_id, text, _ in AWKWARD:
        left[doc_id].append([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2])
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        left[r["doc_id"]].remove(ids)
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(bytes(r["ids"])))
        at += len(ids)
    folder = scratch_path(spark, "tokens")
    token_files.write_token_files(awkward.limit(0), folder, BYTE, end_id=2)
    assert token_files.read_token_files(spark, folder).count() == 0


def check_packing(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing(spark, awkward):
    tokenizer, capacity = Tokenizer.from_file(WORD), 64
    rows = packing.pack(awkward, WORD, 1, capacity=capacity, group_pieces=40).collect()
    n_bins = check_packing(rows, capacity)
    expected = []
    for doc_id, text, _ in AWKWARD:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            expected.append((doc_id, k, at, len(part), zlib.crc32(part.tobytes())))
    found = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows]
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    assert n_bins <= -(-sum(r["length"] for r in rows) // capacity) + 2
    assert packing.pack(awkward.limit(0), WORD, 1).count() == 0


def test_genetic_packing_beats_a_bad_start():
    lengths = [5, 5, 5, 5, 3, 3, 3, 3, 2, 2, 2, 2] * 5
    work = packing.Packing(lengths, 10, seed=3)
    start = [[i] for i in range(len(lengths))]
    best = work.evolve([start], 40)
    assert sorted(i for b in best for i in b) == list(range(len(lengths)))
    assert all(work.fill(b) <= 10 for b in best) and len(best) <= work.bound + 1
    child = work.cross(start, best)
    assert sorted(i for b in child for i in b) == list(range(len(lengths)))
    assert packing._as_bins(packing._as_bytes(best, len(lengths))) == [sorted(b) for b in best]


def test_files_are_ordered_by_number(spark):
    """Names of 100,000 files and more aren't in order as text."""
    numbers = [0, 7, 99_999, 100_000, 100_001, 1_234_567]
    names = spark.createDataFrame([(n, f"part-{n:05d}-a1b2-c000.txt") for n in numbers], "n long, file string")
    ordered = names.orderBy(token_files.file_number(F.col("file")), "file").collect()
    assert [r["n"] for r in ordered] == numbers
    assert sorted(r["file"] for r in ordered) != [r["file"] for r in ordered]
