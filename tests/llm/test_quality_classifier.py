"""The classifier's parts against plain loops, and its held-out accuracy."""

import math
import zlib

import numpy as np
import pytest

from hazardloom.llm import quality_classifier as qc
from hazardloom.llm import queries

SF_DIR = "/root/testdata/sf0.1"


def test_shapes_keep_signs_and_join_runs():
    assert qc.shapes("Hello, WORLD!! x1y22 ÉCOLE été a".encode()) == [b"Aa,", b"A!!", b"a0a0", b"aA", b"a", b"a"]
    assert qc.shapes(b"a" * 1001 + b" " + b"7" * 33) == [b"a", b"0"]


def test_features_by_counting():
    slots, values = qc.features("one two one two two")
    by_kind = {k: sorted((values[slots >> qc.BITS == k] ** 2 * n).round(4).tolist()) for k, n in ((0, 5), (1, 4), (2, 5), (3, 4))}
    # one x2, two x3; "one two" x2, "two one", "two two"; four plain shapes and a repeat; their pairs
    assert by_kind == {0: [2, 3], 1: [1, 1, 2], 2: [1, 4], 3: [1, 3]}
    assert len(set(slots.tolist())) == len(slots) and values[slots == qc.BIAS] == [1]
    for blank in (None, "", " \n\t "):
        assert qc.features(blank)[0].tolist() == [qc.BIAS]


def test_training_by_the_plain_rule():
    rows = [(1, "good words here"), (0, "BAD!! BAD!! words"), (1, "more good words"), (0, "BAD!! stuff")]
    z, n = {}, {}

    def weight(i):
        z_i, threshold = z.get(i, 0.0), 0 if i == qc.BIAS else qc.L1
        if abs(z_i) <= threshold:
            return 0.0
        return -(z_i - math.copysign(threshold, z_i)) / ((qc.BETA + math.sqrt(n.get(i, 0.0))) / qc.ALPHA + qc.L2)

    for _ in range(40):
        for label, text in rows:
            cells = list(zip(*(a.tolist() for a in qc.features(text)), strict=True))
            w = {i: weight(i) for i, _ in cells}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in cells)))
            for i, v in cells:
                g = (p - label) * v
                sigma = (math.sqrt(n.get(i, 0) + g * g) - math.sqrt(n.get(i, 0))) / qc.ALPHA
                z[i], n[i] = z.get(i, 0) + g - sigma * w[i], n.get(i, 0) + g * g
    weights = qc.train(rows, passes=40)
    assert {i: pytest.approx(weight(i), abs=1e-9) for i in z} == {i: weights[i] for i in z}
    assert np.count_nonzero(weights) == sum(weight(i) != 0 for i in z)
    assert qc.score(weights, "good words") > 0.5 > qc.score(weights, "BAD!! words BAD!!")


def test_one_kind_of_label_teaches_nothing():
    assert not qc.train([(1, "a b"), (1, "c")]).any()
    assert qc.score(np.zeros(qc.SIZE), "any text") == 0.5


@pytest.fixture(scope="module")
def found(spark):
    return {r.doc_id: r for r in queries.op12_quality_classifier(spark, SF_DIR).collect()}


def test_held_out_accuracy(spark, found):
    labels = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").select("doc_id", "quality").collect()]
    held = [(found[i], quality) for i, quality in labels if found[i].held_out]
    good = [r.score for r, q in held if q == 1]
    bad = [r.score for r, q in held if q == 0]
    assert len(bad) > 50
    # The area under the curve, by all pairs.
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad)) > 0.99
    assert sum(r.predicted == q for r, q in held) / len(held) > 0.98


def test_query_covers_every_row(spark, found):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id").collect()
    assert len(found) == len(rows)
    for r in found.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)


def test_hold_out_and_other_columns_do_not_matter(spark, awkward):
    """Neither labels of the hold-out nor columns other than the text change a score."""
    docs = spark.createDataFrame([(i, f"{'plain words' if i % 3 else 'JUNK!! ###'} number {i}") for i in range(300)], "doc_id long, text string")
    labels = [(i, int(i % 3 > 0)) for i in range(300)]
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q in labels]
    kind = "doc_id long, quality int"
    one, two = (
        {r.doc_id: r.score for r in qc.quality_scores(d, spark.createDataFrame(t, kind)).collect()}
        for d, t in ((docs.selectExpr("*", "'x' lang", "'y' score"), labels), (docs.repartition(7), flipped))
    )
    assert one == two
    assert one[1] > 0.5 > one[0]


def test_awkward_rows(spark, awkward):
    kind = "doc_id long, quality int, label string"
    none = qc.quality_scores(awkward, spark.createDataFrame([], kind)).collect()
    assert len(none) == awkward.count() and {r.score for r in none} == {0.5}
    labels = spark.createDataFrame([(6, 1, "a"), (6, 0, "a"), (8, 0, "b"), (9, 0, "b"), (None, 1, "c"), (7, None, "c"), (10, 1, "d")], kind)
    rows = qc.quality_scores(awkward, labels).collect()
    assert len(rows) == awkward.count()
    blank = {r.score for r in rows if r.doc_id in (1, 2, 3)}
    assert len(blank) == 1
    assert len({r.score for r in rows if r.doc_id == 4}) == 2  # the repeated row once, the other text
    assert not any(r.held_out for r in rows if r.doc_id is None)
    assert qc.quality_scores(awkward.limit(0), labels).collect() == []


def test_sample_is_bounded_by_rows(spark):
    """One id may hold most rows; the fit still reads its bound."""
    docs = spark.range(2000).selectExpr("if(id < 1500, id % 9, id) AS doc_id", "concat('text ', id) AS text")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 AS int) AS quality").distinct()
    taken = qc.sample(docs, labels, "doc_id", "text", "quality", rows=300)
    assert taken.count() == 300 and taken.rdd.getNumPartitions() == 1
