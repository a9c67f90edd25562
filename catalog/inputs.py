"""Stand-ins: how the driver tables play the roles of the source tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardloom.operators.clean import ASSAYS
from hazardloom.rules import RuleBook

# One word of the part names per alert, in alert order.
WORDS = [
    "blue", "cold", "hot", "large", "new", "old", "red", "small",
    "anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget",
]
WORD_RULES = RuleBook.default().with_patterns([rf"\b{w}\b" for w in WORDS])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities: the words of a part are its structure text."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("entity"),
        F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("text"),
        "p_size",
        ((F.col("p_size") - 1) / F.lit(49.0)).alias("base_p"),
    )


def class_probabilities(size: str = "p_size") -> Column:
    """Five class probabilities made from a part size."""
    raw = F.array(*[(F.pmod(F.col(size) * (i + 3), F.lit(7)) + 1).cast("double") for i in range(5)])
    total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raw, lambda x: x / total)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixture components: the lines of an order."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("mix"),
        F.col("l_partkey").alias("entity"),
        (F.col("l_discount") * 10.0).alias("base_p"),
        "l_linenumber", "l_suppkey", "l_extendedprice", "l_shipdate",
    )


def line_order() -> list[Column]:
    return [F.col(c) for c in ("l_linenumber", "entity", "l_suppkey", "l_extendedprice", "l_shipdate")]


def assay_cells(doc_id: str = "doc_id") -> list[Column]:
    """Twelve 0/1 cells per labelled document, some missing."""
    cells = []
    for i, name in enumerate(ASSAYS):
        d = F.col(doc_id)
        hit = (F.pmod(d * 7 + i * 3 + F.col("quality") + F.col("toxic") * 2, F.lit(5)) == 0).cast("double")
        cells.append(F.when(F.pmod(d + i, F.lit(4)) != 0, hit).alias(name))
    return cells


def assays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assay table: labelled documents; the cells are missing where a label is."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("smiles"))
    labels = table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select("doc_id", "smiles", *assay_cells())


def assays_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assay cells of all documents: rows without a label have no tested cell."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", *assay_cells())


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Background library: all documents (so it overlaps the base), with properties."""
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("lib_id"),
        F.col("text").alias("smiles"),
        (n / 100.0).alias("logP"),
        F.when(F.pmod(n, F.lit(5)) != 0, F.pmod(n, F.lit(97)) / 97.0).alias("qed"),
        F.when(F.col("lang") != "fr", F.pmod(n, F.lit(11)).cast("double")).alias("SAS"),
    )


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurement table: events, their user naming a document; some values are no numbers."""
    e, d = table(spark, sf_dir, "events"), table(spark, sf_dir, "documents")
    docs = d.select(F.col("doc_id").alias("user_id"), F.col("text").alias("Smiles"))
    return e.join(docs, "user_id").select("Smiles", "event_type", raw_value().alias("value_text"))


def raw_value() -> Column:
    i = F.col("event_id")
    return (
        F.when(F.pmod(i, F.lit(7)) == 0, "n/a")
        .when(F.pmod(i, F.lit(11)) == 0, "NaN")
        .when(F.pmod(i, F.lit(13)) == 0, F.concat(F.lit("-"), F.col("value").cast("string")))
        .otherwise(F.col("value").cast("string"))
    )


def _word(shift: int) -> Column:
    words = F.array(*[F.lit(w) for w in WORDS])
    at = F.pmod(F.floor(F.col("o_orderkey") / (shift + 1)) + F.col("o_custkey") * (shift + 3), F.lit(16)).cast("int")
    return F.element_at(words, at + 1)


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upload table: order rows with a mixture text, a single text, both or neither."""
    k = F.pmod(F.col("o_orderkey"), F.lit(10))
    pair = F.concat(_word(0), F.lit(" "), _word(1))
    mixture = (
        F.when(k == 0, F.concat(pair, F.lit(", "), _word(2), F.lit(" ,"), _word(3)))
        .when(k == 1, F.concat(_word(0), F.lit("."), _word(4)))
        .when(k == 2, F.concat(F.lit(" Benzene,  ,"), pair))
        .when(k == 3, _word(2))
        .when(k == 4, F.concat_ws(",", *[_word(i) for i in range(12)]))
        .when(k == 5, F.lit("  "))
    )
    single = (
        F.when(k == 3, F.concat(_word(1), F.lit(" "), _word(5)))
        .when(k == 5, F.lit("ANILINE "))
        .when(k == 6, F.concat(pair, F.lit(", "), _word(3)))
        .when(k == 7, F.lit(" , "))
        .when(k == 8, F.concat(F.lit("\n"), pair, F.lit(" "), _word(6), F.lit(" ")))
    )
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey"), single.alias("smiles"), mixture.alias("mixture")
    )


def text_base(key: Column) -> Column:
    """Score that stands for a model's output on a component text."""
    return F.pmod(F.length(key) * 7, F.lit(20)) / 20.0


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-class truth and prediction per order, and five class scores."""
    orders = table(spark, sf_dir, "orders")
    price = F.floor(F.col("o_totalprice"))
    return orders.select(
        "o_orderkey",
        F.col("o_orderstatus").alias("model"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("y"),
        F.least(F.floor(F.col("o_totalprice") / 125000.0), F.lit(4)).cast("int").alias("yhat"),
        F.array(*[F.pmod(price, F.lit(1000 + c)) / F.lit(1000.0 + c) for c in range(5)]).alias("scores"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "embedding", F.pmod("label", F.lit(5)).cast("int").alias("cls")
    )
