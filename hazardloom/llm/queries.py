"""Registered queries of the operators: name -> (query, SQL counterpart or None)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardloom.llm import (
    decontaminate,
    html_text,
    packing,
    pii,
    quality_classifier,
    quality_rules,
    simhash,
    suffix_dedup,
    suffix_tree_lm,
    token_counts,
    token_files,
    whitening,
    word_runs,
)
from hazardloom.session import computed_once, scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-files")
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    token_files.write_token_files(table(spark, sf_dir, "documents"), folder, vocabulary, end_id=2)
    return token_files.read_token_files(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.personal_data(table(spark, sf_dir, "documents")))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.without_repeats(table(spark, sf_dir, "documents")))


def op6_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_lm.scores(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_counts.token_counts(docs, public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.page_texts(table(spark, sf_dir, "pages"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """The query's texts: where a tenth of the ids says so, the words from one on repeat a few times."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g, n = F.floor(h / 10), F.size("__words")
    a = g % F.nullif(n, F.lit(0))
    p = 1 + F.floor((n - a) / (3 + g % 8))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)")))
    rows = computed_once(docs.select("doc_id", "text", words.alias("__words")), ["__words"])
    block = F.slice("__words", (a + 1).cast("int"), p.cast("int"))
    repeated = F.slice(F.flatten(F.array_repeat(block, F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
    changed = F.array_join(F.concat(F.slice("__words", F.lit(1), a.cast("int")), repeated), " ")
    return rows.select("doc_id", F.when(n > 0, changed).otherwise(F.col("text")).alias("text"))


def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_planted_runs(table(spark, sf_dir, "documents"))
    return word_runs.digest(word_runs.periodic_runs(docs, ["doc_id"]))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_classifier.quality_scores(docs, labels)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_token_files": (op1_token_files, None),
    "op2_best_fit_packing": (op2_best_fit_packing, None),
    "op3_personal_data": (op3_personal_data, None),
    "op4_quality_rules": (op4_quality_rules, None),
    "op5_suffix_dedup": (op5_suffix_dedup, None),
    "op6_suffix_tree_lm": (op6_suffix_tree_lm, None),
    "op7_token_counts": (op7_token_counts, None),
    "op8_decontamination": (op8_decontamination, decontaminate.ORACLE_SQL),
    "op9_html_text": (op9_html_text, None),
    "op10_simhash": (op10_simhash, None),
    "op11_word_runs": (op11_word_runs, None),
    "op12_quality_classifier": (op12_quality_classifier, None),
    "op13_whitening": (op13_whitening, None),
}
