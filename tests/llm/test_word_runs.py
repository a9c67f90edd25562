"""Periodic runs against the definition, word by word."""

import hashlib
import random
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from hazardloom.llm import queries, word_runs

SF_DIR = "/root/testdata/sf0.001"


def plain_runs(words):
    """Every lag, every stretch of matches, every smaller period."""
    n, runs = len(words), []
    for q in range(1, n // 3 + 1):
        at = q
        while at < n:
            end = at
            while end < n and words[end] == words[end - q]:
                end += 1
            start = at - q
            if end - start >= max(24, 3 * q) and not any(
                all(words[k] == words[k - r] for k in range(start + r, end)) for r in range(1, q)
            ):
                runs.append((start, end - start, q))
            at = max(end, at + 1)
    return sorted(runs, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    """The contract's row of one document, by its definition."""
    words = text.encode().translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).split(b" ") if text else []
    words = [w for w in words if w]
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def nested_words(rnd):
    """Words with repeats inside repeats, cut off at any place."""

    def block(depth):
        if depth == 0 or rnd.random() < 0.3:
            return [rnd.choice("ab" if rnd.random() < 0.5 else "abcdefgh") for _ in range(rnd.randint(1, 12))]
        inner = block(depth - 1) + (block(depth - 1) if rnd.random() < 0.5 else [])
        repeated = inner * rnd.randint(1, 7)
        return repeated[: len(repeated) - rnd.randint(0, min(len(inner), len(repeated) - 1))]

    return [w for _ in range(rnd.randint(1, 4)) for w in block(3)][:400]


def test_runs_by_definition():
    rnd, periods = random.Random(11), set()
    for _ in range(1500):
        words = nested_words(rnd)
        expected = plain_runs(words)
        assert word_runs.word_runs(words) == expected
        dropped = {i for s, length, q in expected for i in range(s + q, s + length)}
        assert word_runs.collapsed_words(words, expected) == [w for i, w in enumerate(words) if i not in dropped]
        periods |= {q for _, _, q in expected}
    assert {1, 2, 3, 15, 16, 17, 31, 32, 33} <= periods


@pytest.mark.parametrize("size", [23, 24, 25])
def test_least_length(size):
    assert word_runs.word_runs(["a"] * size) == ([(0, size, 1)] if size >= 24 else [])


def test_three_repeats_are_needed():
    block = [str(i) for i in range(40)]
    assert word_runs.word_runs(block * 3) == [(0, 120, 40)]
    assert word_runs.word_runs((block * 3)[:-1]) == []


def test_long_uniform_and_random_texts_take_linear_steps():
    assert word_runs.word_runs(["a"] * 200_000) == [(0, 200_000, 1)]
    assert word_runs.word_runs(["a", "b"] * 100_000) == [(0, 200_000, 2)]
    line = [f"w{i}" for i in range(20)]  # one line thousands of times, told apart by its end
    assert word_runs.word_runs([w for k in range(8000) for w in [*line, f"end{k}"]]) == []
    assert word_runs.word_runs([str(i) for i in range(50_000)] * 4) == [(0, 200_000, 50_000)]


def test_operator_on_awkward_rows(awkward):
    found = word_runs.periodic_runs(awkward, ["doc_id", "n_chars", "kept"]).collect()
    texts = awkward.select("doc_id", "text", "n_chars").collect()
    assert len(found) == len(texts)
    expected = sorted(
        (str(r.doc_id), len((r.text or "").encode().split()), [tuple(x) for x in word_runs.word_runs((r.text or "").encode().split())])
        for r in texts
    )
    assert sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs]) for r in found) == expected
    assert {r.kept for r in found} == {"clash"}
    assert all(r.collapsed == "" for r in found if r.n_words == 0)
    empty = word_runs.digest(word_runs.periodic_runs(awkward.limit(0), ["doc_id"]))
    assert empty.collect() == []


def test_query_equals_definition(spark, texts):
    found = {r.doc_id: tuple(r) for r in queries.op11_word_runs(spark, SF_DIR).collect()}
    assert found == {i: plain_row(i, t) for i, t in texts.items()}
    assert any(r[1] for r in found.values())


def test_contract_on_awkward_rows(awkward):
    found = word_runs.digest(word_runs.periodic_runs(queries.with_planted_runs(awkward), ["doc_id"]))
    expected = [plain_row(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)


def test_strongest_run_by_exact_fraction(spark):
    rows = [([(0, 24, 8), (3, 24, 8), (9, 48, 16)],), ([(5, 100, 33), (80, 200, 66)],), ([],)]
    df = spark.createDataFrame(rows, f"runs {word_runs.RUN_TYPE}")
    top = [r[0] for r in df.select(word_runs.strongest(F.col("runs"))).collect()]
    assert tuple(top[0]) == (0, 24, 8)  # the first of equals
    assert tuple(top[1]) == (5, 100, 33)
    assert top[2] is None
