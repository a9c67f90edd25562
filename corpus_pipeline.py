"""Training-data pipeline: quality rules, near duplicates, decontamination, personal data, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's ``docs``.  All but the
last return the columns of ``docs``, whatever these are beside ``doc_id``, ``text`` and ``lang``.

Nulls, empty texts, repeated rows and empty tables are handled as the operators say: a null or
empty text fails the quality rules; of identical rows one stays.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardloom.llm import decontaminate, packing, pii, quality_rules, simhash
from hazardloom.session import scratch_path

ROW, DOC, TEXT = "__row", "__doc", "__text"


def _wrapped(docs: DataFrame) -> DataFrame:
    """The whole rows in one column, so that no name of theirs meets one of an operator."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(DOC))


def _numbered(docs: DataFrame) -> DataFrame:
    """Wrapped rows with their place in the stored table as a number."""
    return _wrapped(docs).withColumn(ROW, F.monotonically_increasing_id())


def _texts(docs: DataFrame) -> DataFrame:
    return _numbered(docs).select(ROW, F.col(f"{DOC}.text").alias("text"))


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` without the rows numbered in ``rows``."""
    return _numbered(docs).join(rows, ROW, "left_anti").select(f"{DOC}.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the certified cutoffs."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    # The text travels once, beside the other columns.
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias(DOC)
    found = quality_rules.quality_rules(docs.select(others, "doc_id", "lang", "text"), labels, more=(DOC, "text")).where("kept")
    return found.select(*["text" if c == "text" else F.col(f"{DOC}.`{c}`").alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate group."""
    found = simhash.near_duplicates(_texts(docs), id_col=ROW)
    return _without(docs, found.where(F.col(ROW) != F.col("component_id")).select(ROW))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word of a benchmark window."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contamination(_texts(docs), benchmark, id_col=ROW)
    return _without(docs, found.where("n_hit > 0").select(ROW))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every span replaced by its kind; ``n_chars`` follows where there is one."""
    found = pii.personal_data(_wrapped(docs).withColumn(TEXT, F.col(f"{DOC}.text")), TEXT)
    # Under a name that no result column has: a later column must not see the new text.
    text = pii.redacted(F.col(TEXT), F.col("spans"))
    new = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return found.select(*[new.get(c, F.col(f"{DOC}.`{c}`")).alias(c) for c in docs.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4,096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("best-fit packing", best_fit_packing),
]

# Exact binomial cutoffs, XXH64 fingerprints and tokenizer ids are beyond SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = scratch_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
