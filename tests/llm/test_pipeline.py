"""The stages in order, on given documents and on awkward ones."""

import re
from collections import defaultdict

import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F

from hazardloom.session import write_and_read

from .conftest import SF_DIR
from .test_text import plain_components, plain_fingerprint, plain_stats, lower
from .test_tokens import check_packing


def test_stages_against_a_plain_version(spark, documents):
    docs = documents
    stages = dict(pipeline.STAGES)
    assert [n for n, _ in pipeline.STAGES] == ["quality rules", "SimHash near-dedup", "benchmark decontamination", "PII", "best-fit packing"]
    kept = write_and_read(stages["quality rules"](spark, docs, SF_DIR), "t")
    assert kept.columns == docs.columns
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    after = {r["doc_id"] for r in kept.collect()}
    for doc_id, text in before.items():
        n, _, _, _, repeated = plain_stats(text)
        if n < 10 or 100 * repeated > 20 * n:
            assert doc_id not in after
    single = write_and_read(stages["SimHash near-dedup"](spark, kept, SF_DIR), "t")
    ids = sorted(after)
    groups = defaultdict(set)
    for doc_id, c in zip(ids, plain_components([plain_fingerprint(before[i]) for i in ids]), strict=True):
        groups[c].add(doc_id)
    left = {r["doc_id"] for r in single.collect()}
    assert all(len(g & left) == 1 for g in groups.values()) and len(left) == len(groups)
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t)) if w]
    windows = set()
    for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect():
        w = split(r["text"])
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}
    clean = write_and_read(stages["benchmark decontamination"](spark, single, SF_DIR), "t")
    hit = {d for d in left for w in [split(before[d])] if any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))}
    assert {r["doc_id"] for r in clean.collect()} == left - hit
    hidden = write_and_read(stages["PII"](spark, clean, SF_DIR), "t")
    rows = hidden.collect()
    assert hidden.columns == docs.columns and {r["doc_id"] for r in rows} == left - hit
    assert not any(re.search(r"[\w.]+@[\w-]+\.\w+", r["text"]) for r in rows)
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    packed = stages["best-fit packing"](spark, hidden, SF_DIR).collect()
    check_packing(packed, 4096)
    assert {r["doc_id"] for r in packed} == left - hit


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_awkward_rows(spark, awkward, empty):
    docs = awkward.limit(0) if empty else awkward
    docs = write_and_read(docs, "t")
    for name, stage in pipeline.STAGES[:-1]:
        out = write_and_read(stage(spark, docs, SF_DIR), "t")
        assert out.columns == docs.columns, name
        if name != "quality rules" and not empty:
            assert out.count()
        if name == "SimHash near-dedup" and not empty:
            assert out.where(F.col("text") == "One short line").count() == 1
    assert pipeline.best_fit_packing(spark, docs, SF_DIR).count() == (0 if empty else docs.count())
