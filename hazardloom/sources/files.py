"""CSV, JSON and Parquet files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazardloom.operators.clean import ASSAYS, PROPERTIES

ASSAY_SCHEMA = T.StructType(
    [T.StructField(a, T.DoubleType()) for a in ASSAYS] + [T.StructField("smiles", T.StringType())]
)
MEASUREMENT_SCHEMA = "Smiles string, `Standard Type` string, `Standard Value` string"
LIBRARY_SCHEMA = ", ".join(["smiles string", *[f"{p} double" for p in PROPERTIES]])


def scan_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, sep: str = ",", multi_line: bool = False
) -> DataFrame:
    """CSV with a header row; the columns of ``schema`` are taken by name, others are left out.

    A wanted column that is missing raises; a cell that isn't of the wanted type is NULL.
    Files of a folder must have the same header.  Without a schema all columns come with
    inferred types.  ``multi_line`` allows line breaks in quoted fields, but then a file
    can't be split between tasks.
    """
    reader = spark.read.options(
        header=True, sep=sep, multiLine=multi_line, quote='"', escape='"', enforceSchema=False, inferSchema=schema is None
    )
    raw = reader.csv(path)
    if schema is None:
        return raw
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    missing = [f.name for f in wanted.fields if f.name not in raw.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} in {path}; it has {', '.join(raw.columns)}")
    return raw.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in wanted.fields])


def scan_csv_semicolon(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = False
) -> DataFrame:
    return scan_csv(spark, path, schema, sep=";", multi_line=multi_line)


def sink_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """CSV with a header row and no index column, one file per partition."""
    df.write.options(header=True, sep=sep, quote='"', escape='"', emptyValue="").csv(path)


REPORT_TYPE = "map<string, struct<precision: double, recall: double, `f1-score`: double, support: double>>"
MODEL_METRICS_TYPE = (
    "struct<accuracy: double, precision: double, recall: double, f1_score: double, roc_auc: double, "
    f"confusion_matrix: array<array<bigint>>, classification_report: {REPORT_TYPE}>"
)
RUN_SCHEMA = (
    "best_model string, best_f1 double, n_classes int, n_features int, n_train bigint, n_test bigint, "
    f"feature_names_file string, scaler_file string, results map<string, {MODEL_METRICS_TYPE}>"
)


def scan_json_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Run metadata written by :func:`sink_json_metrics`; a missing file gives no rows."""
    try:
        return spark.read.schema(RUN_SCHEMA).option("multiLine", True).json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RUN_SCHEMA)


def sink_json_metrics(run: DataFrame, path: str) -> None:
    run.write.mode("overwrite").json(path)


def json_metrics_rows(df: DataFrame, document: str, keep: list[str], missing_auc: float = 0.0) -> DataFrame:
    """One row per model from a JSON column mapping model names to metrics."""
    parsed = F.from_json(F.col(document), f"map<string, {MODEL_METRICS_TYPE}>")
    return metrics_rows(df.withColumn("_results", parsed), "_results", keep, missing_auc)


def metrics_rows(df: DataFrame, results: str, keep: list[str], missing_auc: float = 0.0) -> DataFrame:
    rows = df.select(*keep, F.explode(results).alias("Model", "m"))
    return rows.select(
        *keep,
        "Model",
        F.col("m.accuracy").alias("Accuracy"),
        F.col("m.precision").alias("Precision"),
        F.col("m.recall").alias("Recall"),
        F.col("m.f1_score").alias("F1 Score"),
        F.coalesce("m.roc_auc", F.lit(missing_auc)).alias("ROC-AUC"),
    )


def persist_holdout(df: DataFrame, path: str) -> DataFrame:
    """Write the test part once and read it back for the later jobs."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def preview(df: DataFrame, order: list, n: int = 5) -> tuple[int, int, DataFrame]:
    """Row count, column count and the first rows in an explicit order."""
    return df.count(), len(df.columns), df.orderBy(*order).limit(n)


def source_counts(sources: dict[str, DataFrame]) -> DataFrame:
    """Row count of each named table."""
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("source"), "n") for name, df in sources.items()]
    result = rows[0]
    for row in rows[1:]:
        result = result.unionByName(row)
    return result
