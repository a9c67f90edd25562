"""Small tables with every awkward case, and plain versions of the definitions."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SF_DIR = "/root/testdata/sf0.001"

LONG = "the quick brown fox, jumps over the lazy dog and runs away from 12 angry bees; "
AWKWARD = [
    (1, None, "en"),
    (2, "", "en"),
    (3, " \t\n ", None),
    (4, "One short line", "de"),
    (4, "One short line", "de"),  # a repeated row
    (4, "Another text of the same id, with some words in it", "de"),
    (None, "A text without an id that is long enough to keep its eleven words", "en"),
    (None, None, None),
    (5, "née ÉCOLE straße, İstanbul ² ½ x́ 中文 🙂 <|endoftext|> it's we'll  two   spaces\r\n\ttabs\x1cend\x85x", "fr"),
    (6, LONG * 60, "en"),
    (7, LONG * 60 + "tail", "en"),
    (8, "x" * 3000, "en"),
    (9, "a b " * 700, "es"),
    (10, "mail bob.42@mail8.example.com or 4041 8949 7460 8795 from 10.0.255.1, +1 (988) 555-2485!", "en"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls, empty and long texts, repeated rows, and columns that clash with results."""
    rows = [(*r, "text" if r[1] is None else r[1][:5]) for r in AWKWARD]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    clashing = {c: F.lit("clash") for c in ("n_tokens", "start", "row", "id", "kept", "spans", "base", "n_words", "label", "group")}
    stored = df.withColumns(clashing).withColumn("n_chars", F.length("text").cast("long"))
    path = spark.conf.get("spark.checkpoint.dir") + "/awkward"
    stored.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}
