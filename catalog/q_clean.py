"""Scans, scalar expressions, joins, aggregates and the master table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import inputs as inp
from catalog.sqlkit import confidence, label, level, nkey, pyround, rank, sql, strip, text_literal
from hazardloom.functions import labels as lab
from hazardloom.functions import numbers as num
from hazardloom.functions import scores as sco
from hazardloom.functions import text as txt
from hazardloom.operators import clean, lookups, ordered
from hazardloom.operators.features import standard_scale
from hazardloom.plans import master
from hazardloom.plans.scoring import detect_columns
from hazardloom.rules import RuleBook
from hazardloom.session import scratch_path
from hazardloom.sources import files

KEY = clean.KEY
ORDER_COLS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string"
DOC_COLS = "doc_id long, text string, source string"


def t(name):
    return lambda spark, sf: inp.table(spark, sf, name)


# --- files -----------------------------------------------------------------------------
def scan_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "orders-csv")
    cols = [c.split()[0] for c in ORDER_COLS.split(", ")]
    # Unwanted columns first and the wanted ones in another order: they are found by name.
    files.sink_csv(inp.table(spark, sf, "orders").select("o_orderdate", F.lit("x").alias("note"), *cols[::-1]), path)
    return files.scan_csv(spark, path, ORDER_COLS)


def scan_csv_semicolon(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "documents-csv")
    files.sink_csv(inp.table(spark, sf, "documents").select("lang", "text", "source", "doc_id"), path, sep=";")
    return files.scan_csv_semicolon(spark, path, DOC_COLS, multi_line=True)


def sink_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "measurements-csv")
    rows = inp.table(spark, sf, "events").select("event_id", "event_type", inp.raw_value().alias("value_text"))
    files.sink_csv(rows, path)
    return files.scan_csv(spark, path, rows.schema)


def detect(spark: SparkSession, sf: str) -> DataFrame:
    upload = inp.uploads(spark, sf)
    single, mixture = detect_columns(upload.columns)
    return upload.select("o_orderkey", F.col(single).alias("single"), F.col(mixture).alias("mixture_text"))


def preview_shape(spark: SparkSession, sf: str) -> DataFrame:
    n_rows, n_cols, first = files.preview(inp.table(spark, sf, "orders"), ["o_orderkey"])
    return first.select(
        "o_orderkey", "o_orderpriority", F.lit(n_rows).cast("long").alias("n_rows"), F.lit(n_cols).cast("long").alias("n_cols")
    )


def source_counts(spark: SparkSession, sf: str) -> DataFrame:
    return files.source_counts(
        {
            "base": inp.assays(spark, sf),
            "library": inp.library(spark, sf),
            "measurements": inp.table(spark, sf, "events"),
            "entities": inp.table(spark, sf, "part"),
        }
    )


# --- scalar expressions ----------------------------------------------------------------
def lines_select(**columns):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = inp.table(spark, sf, "lineitem")
        return rows.select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[c().alias(n) for n, c in columns.items()]
        )

    return run


def lines_sql(**columns: str) -> str:
    return "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, " + ", ".join(
        f"{c} AS {n}" for n, c in columns.items()
    ) + " FROM lineitem"


def priority_class():
    return F.substring("o_orderpriority", 1, 1).cast("int")


# Severity words by priority; 4-NOT SPECIFIED has none.
SEVERITY_OF_PRIORITY = {"1": "CRITICAL", "2": "HIGH", "3": "MODERATE", "4": "OTHER", "5": "LOW"}


def severity_rank(spark: SparkSession, sf: str) -> DataFrame:
    digit = F.substring("o_orderpriority", 1, 1)
    word = F.lit(None).cast("string")
    for d, w in SEVERITY_OF_PRIORITY.items():
        word = F.when(digit == d, w).otherwise(word)
    return inp.table(spark, sf, "orders").select("o_orderkey", lab.severity_rank(word).alias("rank"))


_priority_case = (
    "CASE substr(o_orderpriority, 1, 1) " + " ".join(f"WHEN '{d}' THEN '{w}'" for d, w in SEVERITY_OF_PRIORITY.items()) + " END"
)


def assay_rows(spark: SparkSession, sf: str) -> DataFrame:
    return clean.assay_counts(inp.assays_all(spark, sf))


def replace_nonfinite(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    x = (
        F.when(F.pmod(i, F.lit(9)) == 0, F.lit(float("nan")))
        .when(F.pmod(i, F.lit(10)) == 0, F.lit(float("inf")))
        .when(F.pmod(i, F.lit(11)) == 0, F.lit(float("-inf")))
        .otherwise(F.col("value"))
    )
    rows = inp.table(spark, sf, "events").select("event_id", x.alias("x"))
    return rows.select(
        "event_id", num.finite_or(F.col("x"), None).alias("training"), num.finite_or(F.col("x"), 0.0).alias("scoring")
    )


def sparse_vector(col: str = "embedding"):
    """Embedding with its small entries set to 0 and very small ones missing."""
    return F.transform(
        col, lambda v: F.when(F.abs(v) < 0.05, F.lit(0.0)).when(v < -0.25, F.lit(None)).otherwise(v.cast("double"))
    )


def split_mixture(spark: SparkSession, sf: str) -> DataFrame:
    rows = inp.uploads(spark, sf).select(
        "o_orderkey", txt.split_parts(F.col("mixture"), RuleBook.default().names).alias("parts")
    )
    return rows.select("o_orderkey", F.posexplode("parts").alias("pos", "part"))


# --- joins and cleaning -----------------------------------------------------------------
def measured(spark: SparkSession, sf: str) -> DataFrame:
    return clean.clean_measurements(
        inp.measurements(spark, sf), "Smiles", "event_type", "value_text", "purchase", digest=True
    )


def base(spark: SparkSession, sf: str) -> DataFrame:
    return master.clean_base(inp.assays(spark, sf), "smiles", [F.col("doc_id")], digest=True)


def lib(spark: SparkSession, sf: str) -> DataFrame:
    return master.clean_library(
        inp.library(spark, sf), "smiles", "lib_id", [F.col("lib_id")], sample=None, digest=True
    )


def left_enrich(spark: SparkSession, sf: str) -> DataFrame:
    joined = clean.left_enrich(base(spark, sf), clean.measurement_summary(measured(spark, sf)))
    return joined.select(KEY, F.round("pIC50", 6).alias("pIC50"), "IC50_nM")


def anti_join(spark: SparkSession, sf: str) -> DataFrame:
    return lib(spark, sf).join(base(spark, sf).select(KEY), KEY, "left_anti").select(KEY, "lib_id")


def lookup_fill(spark: SparkSession, sf: str) -> DataFrame:
    filled = clean.lookup_fill(base(spark, sf), lib(spark, sf))
    return filled.select("doc_id", *clean.PROPERTIES)


def named_customers(spark: SparkSession, sf: str) -> DataFrame:
    """Names in odd spelling, some unknown."""
    names = list(RuleBook.default().names)
    at = F.pmod("c_custkey", F.lit(60)).cast("int") + 1
    known = F.try_element_at(F.array(*[F.lit(n) for n in names]), at)
    raw = F.coalesce(F.concat(F.lit("  "), F.upper(known), F.lit(" ")), F.col("c_mktsegment"))
    return inp.table(spark, sf, "customer").select("c_custkey", raw.alias("raw_name"))


def name_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return lookups.name_lookup(named_customers(spark, sf), "raw_name", RuleBook.default().names_df(spark))


def group_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = inp.table(spark, sf, "events").where((F.col("event_type") == "purchase") & (F.col("value") > 0))
    rows = rows.select(
        F.col("user_id").cast("string").alias(KEY), F.col("value").alias("IC50_nM"), num.neg_log10_potency(F.col("value")).alias("pIC50")
    )
    return clean.measurement_summary(rows).select(
        KEY, F.round("pIC50", 6).alias("pIC50"), F.round("IC50_nM", 6).alias("IC50_nM"), "n_measurements"
    )


def median_impute(spark: SparkSession, sf: str) -> DataFrame:
    filled = clean.median_impute(inp.library(spark, sf))
    return filled.select("lib_id", *[F.round(c, 9).alias(c) for c in clean.PROPERTIES])


def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    rows = inp.classified(spark, sf).select("o_orderkey", "yhat")
    return clean.balanced_class_weights(rows, "yhat").select("o_orderkey", "yhat", F.round("weight", 9).alias("weight"))


def keep_first(spark: SparkSession, sf: str) -> DataFrame:
    keyed = clean.with_key(inp.table(spark, sf, "documents"), "text", "key", digest=True)
    return clean.keep_first(keyed, "key", [F.col("doc_id")]).select("doc_id", "key")


def sample_exact_n(spark: SparkSession, sf: str) -> DataFrame:
    """100 unique keys: 200 documents drawn first, then trimmed after deduplication."""
    return master.clean_library(
        inp.library(spark, sf), "smiles", "lib_id", [F.col("lib_id")], sample=100, digest=True
    ).select("lib_id")


def union_by_name(spark: SparkSession, sf: str) -> DataFrame:
    left = inp.table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    right = inp.table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return clean.stack(left, right)


def background_rows(spark: SparkSession, sf: str) -> DataFrame:
    return clean.background_rows(lib(spark, sf), base(spark, sf))


def built_master(spark: SparkSession, sf: str) -> DataFrame:
    return master.master_from_sources(
        inp.assays(spark, sf),
        inp.measurements(spark, sf),
        inp.library(spark, sf),
        assay_order=[F.col("doc_id")],
        measured_type="event_type",
        measured_value="value_text",
        wanted="purchase",
        library_id="lib_id",
        library_order=[F.col("lib_id")],
        sample=None,
        digest=True,
    )


def build_master(spark: SparkSession, sf: str) -> DataFrame:
    built = built_master(spark, sf)
    rounded = {c: F.round(c, 6) for c in ("pIC50", "IC50_nM", *clean.PROPERTIES)}
    return built.withColumns(rounded)


def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = inp.classified(spark, sf).select("o_orderkey", "yhat")
    return ordered.stratified_split(rows, "o_orderkey", "yhat").select("o_orderkey", "yhat", "is_test")


def holdout(spark: SparkSession, sf: str) -> DataFrame:
    split = ordered.stratified_split(inp.vectors(spark, sf), "vec_id", "cls")
    stored = files.persist_holdout(split.where("is_test").drop("is_test"), scratch_path(spark, "holdout"))
    return stored.select("vec_id", "cls", F.size("embedding").alias("n_features"))


def scaled(spark: SparkSession, sf: str) -> DataFrame:
    rows = standard_scale(inp.vectors(spark, sf), "embedding")
    return rows.select("vec_id", F.posexplode("scaled").alias("feature", "z")).select(
        "vec_id", "feature", F.round("z", 5).alias("z")
    )


_lib_props = ", ".join(f"round(coalesce({c}, (SELECT median({c}) FROM library)), 9) AS {c}" for c in ("logP", "qed", '"SAS"'))
_split = (
    "SELECT {id}, {cls}{more}, row_number() OVER (PARTITION BY {cls} ORDER BY md5('42:' || {id})) "
    "<= floor(count(*) OVER (PARTITION BY {cls}) * 0.2e0 + 0.5e0) AS is_test FROM {src}"
)
_assay_names = ", ".join(f'"{a}"' for a in clean.ASSAYS)
_class_sql = (
    "CASE WHEN {h} >= 7 OR {p} >= 7 THEN 4 WHEN {h} >= 5 OR {p} >= 6 THEN 3 "
    "WHEN {h} >= 3 OR {p} >= 5.5 THEN 2 WHEN {h} >= 1 OR {p} >= 5 THEN 1 ELSE 0 END"
)
_estimate = pyround("4e0 + {h} / 12e0 * 5e0", 3)
_name_list = ", ".join(text_literal(n) for n in RuleBook.default().names)

QUERIES: dict = {
    "scan_csv": (scan_csv, "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders"),
    "scan_csv_semicolon": (scan_csv_semicolon, "SELECT doc_id, text, source FROM documents"),
    "sink_csv": (sink_csv, sql("SELECT event_id, event_type, value_text FROM raw_events")),
    "persist_holdout": (
        holdout,
        sql("SELECT vec_id, cls, len(embedding)::INT AS n_features FROM ("
            + _split.format(id="vec_id", cls="cls", more=", embedding", src="vecs") + ") WHERE is_test"),
    ),
    "detect_columns": (detect, sql("SELECT o_orderkey, smiles AS single, mixture AS mixture_text FROM uploads")),
    "preview_shape": (
        preview_shape,
        "SELECT o_orderkey, o_orderpriority, (SELECT count(*) FROM orders) AS n_rows, 6::BIGINT AS n_cols "
        "FROM orders ORDER BY o_orderkey LIMIT 5",
    ),
    "source_counts": (
        source_counts,
        "SELECT 'base' AS source, count(*) AS n FROM documents JOIN labels USING (doc_id) UNION ALL "
        "SELECT 'library', count(*) FROM documents UNION ALL SELECT 'measurements', count(*) FROM events "
        "UNION ALL SELECT 'entities', count(*) FROM part",
    ),
    "normalize_key": (
        lambda s, d: inp.table(s, d, "documents").select("doc_id", txt.normalize_key(F.col("text")).alias("key")),
        f"SELECT doc_id, {nkey('text')} AS key FROM documents",
    ),
    "drop_null_keys": (
        lambda s, d: clean.with_key(
            inp.table(s, d, "documents").withColumn("raw", F.when(F.col("lang") != "fr", F.col("text"))), "raw", "key", digest=True
        ).select("doc_id", "key"),
        f"SELECT doc_id, sha256({nkey('text')}) AS key FROM documents WHERE lang <> 'fr' AND {nkey('text')} IS NOT NULL",
    ),
    "valid_key_filter": (
        lambda s, d: inp.table(s, d, "documents")
        .where(txt.is_usable_key(F.when(F.col("lang") == "de", F.lit(" \n ")).otherwise(F.col("text"))))
        .select("doc_id"),
        f"SELECT doc_id FROM documents WHERE {nkey(chr(40) + 'CASE WHEN lang = ' + text_literal('de') + ' THEN chr(32) || chr(10) ELSE text END)')} IS NOT NULL",
    ),
    "filter_type_eq": (
        lambda s, d: inp.table(s, d, "events").where(F.col("event_type") == "purchase").select("event_id", "user_id", "value"),
        "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase'",
    ),
    "coerce_numeric": (
        lambda s, d: inp.table(s, d, "events")
        .select("event_id", num.coerce_numeric(inp.raw_value()).alias("num"))
        .where("num IS NOT NULL"),
        sql("SELECT event_id, num FROM clean_events WHERE num IS NOT NULL"),
    ),
    "filter_positive": (
        lambda s, d: inp.table(s, d, "events")
        .select("event_id", num.coerce_numeric(inp.raw_value()).alias("num"))
        .where(F.col("num") > 0),
        sql("SELECT event_id, num FROM clean_events WHERE num > 0"),
    ),
    "neg_log10_potency": (
        lambda s, d: inp.table(s, d, "events").select(
            "event_id", F.round(num.neg_log10_potency(F.col("value") - 5), 9).alias("potency")
        ),
        "SELECT event_id, CASE WHEN value - 5 > 0 THEN round(-log10((value - 5) * 1e-9), 9) END AS potency FROM events",
    ),
    "hit_ratio_estimate": (
        lines_select(estimate=lambda: num.hit_ratio_estimate(F.col("l_linenumber"), F.col("l_quantity").cast("int") - 5)),
        lines_sql(estimate=pyround("4e0 + l_linenumber::DOUBLE / greatest(l_quantity::INT - 5, 1)::DOUBLE * 5e0", 3)),
    ),
    "rowwise_sum": (
        lambda s, d: assay_rows(s, d).select("doc_id", "assay_hits"),
        sql("SELECT doc_id, hits AS assay_hits FROM all_hits"),
    ),
    "rowwise_nonnull_count": (
        lambda s, d: assay_rows(s, d).select("doc_id", "assay_tested"),
        sql("SELECT doc_id, tested AS assay_tested FROM all_hits"),
    ),
    "binary_flag": (
        lambda s, d: assay_rows(s, d).select("doc_id", "tox_binary"),
        sql("SELECT doc_id, (hits > 0)::INT AS tox_binary FROM all_hits"),
    ),
    "derive_class": (
        lambda s, d: inp.table(s, d, "orders").select(
            "o_orderkey",
            lab.derive_class(
                F.pmod("o_custkey", F.lit(9)), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 60000.0)
            ).alias("cls"),
        ),
        "SELECT o_orderkey, " + _class_sql.format(h="(o_custkey % 9)", p="p") + " AS cls FROM (SELECT *, "
        "CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 60000e0 END AS p FROM orders)",
    ),
    "prob_to_label": (
        lines_select(label=lambda: lab.probability_label(F.col("l_discount") * 10)),
        lines_sql(label=label("(l_discount * 10)")),
    ),
    "class_to_label": (
        lambda s, d: lookups.label_lookup(
            inp.table(s, d, "orders").select("o_orderkey", priority_class().alias("cls")), "cls", RuleBook.default().labels_df(s)
        ),
        sql("SELECT o_orderkey, substr(o_orderpriority, 1, 1)::INT AS cls, coalesce(label, 'UNKNOWN') AS label "
            "FROM orders LEFT JOIN class_labels ON class = substr(o_orderpriority, 1, 1)::INT"),
    ),
    "score_to_level": (
        lambda s, d: inp.table(s, d, "orders").select("o_orderkey", lab.score_level(F.col("o_totalprice") / 5000).alias("level")),
        f"SELECT o_orderkey, {level('(o_totalprice / 5000)')} AS level FROM orders",
    ),
    "severity_rank": (severity_rank, f"SELECT o_orderkey, {rank(_priority_case)} AS rank FROM orders"),
    "fill_constants": (
        lambda s, d: clean.fill_constants(
            inp.assays_all(s, d).withColumn("IC50_nM", F.when(F.pmod("doc_id", F.lit(3)) == 0, F.col("doc_id") / 2.0))
        ),
        sql("SELECT doc_id, " + ", ".join(f'coalesce("{a}", 0e0) AS "{a}"' for a in clean.ASSAYS)
            + ", coalesce(CASE WHEN doc_id % 3 = 0 THEN doc_id / 2e0 END, 0e0) AS \"IC50_nM\" FROM assays_all"),
    ),
    "fill_from_estimate": (
        lambda s, d: clean.fill_potency(
            assay_rows(s, d).withColumn("pIC50", F.when(F.pmod("doc_id", F.lit(3)) == 0, F.lit(5.25)))
        ).select("doc_id", "pIC50"),
        sql("SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN 5.25e0 END, " + _estimate.format(h="hits") + ') AS "pIC50" FROM all_hits'),
    ),
    "replace_nonfinite": (
        replace_nonfinite,
        "SELECT event_id, x AS training, coalesce(x, 0e0) AS scoring FROM (SELECT event_id, CASE WHEN event_id % 9 <> 0 "
        "AND event_id % 10 <> 0 AND event_id % 11 <> 0 THEN value END AS x FROM events)",
    ),
    "confidence_score": (
        lines_select(
            confidence=lambda: sco.confidence_score(F.col("l_discount") * 10, F.col("l_linenumber"), F.col("l_quantity"), F.lit(50))
        ),
        lines_sql(confidence=confidence("(l_discount * 10)", "l_linenumber", "l_quantity", "50")),
    ),
    "nonzero_feature_count": (
        lambda s, d: inp.vectors(s, d).select("vec_id", sco.nonzero_feature_count(sparse_vector()).alias("n")),
        "SELECT vec_id, len(list_filter(embedding, lambda v: NOT (abs(v) < 0.05e0 OR v < -0.25e0)))::INT AS n FROM embeddings",
    ),
    "weighted_class_score": (
        lambda s, d: inp.parts(s, d)
        .withColumn("probs", inp.class_probabilities())
        .select(
            "entity",
            sco.weighted_class_score(F.col("probs")).alias("score"),
            sco.predicted_class(F.col("probs")).alias("cls"),
            sco.predicted_probability(F.col("probs")).alias("raw_p"),
        ),
        sql("SELECT entity, base AS score, cls, raw_p FROM class_score"),
    ),
    "potency_from_prob": (
        lines_select(potency=lambda: num.potency_from_probability(F.col("l_discount") * 10)),
        lines_sql(potency=pyround("4e0 + (l_discount * 10) * 5e0", 2)),
    ),
    "danger_level": (
        lines_select(
            single=lambda: sco.danger_level(F.col("l_discount") * 10, F.col("l_linenumber") - 1),
            mixture=lambda: sco.danger_level(F.col("l_discount") * 10, F.col("l_linenumber") - 1, lowest=1),
        ),
        lines_sql(
            single="least(10, greatest(0, trunc(l_discount * 10 * 10)::INT + l_linenumber - 1))",
            mixture="least(10, greatest(1, trunc(l_discount * 10 * 10)::INT + l_linenumber - 1))",
        ),
    ),
    "split_mixture": (
        split_mixture,
        sql("SELECT o_orderkey, (i - 1)::INT AS pos, mix_parts[i] AS part FROM upload_parts, range(1, len(mix_parts) + 1) r(i)"),
    ),
    "left_enrich": (
        left_enrich,
        sql(f'SELECT b.key AS {KEY}, round(p, 6) AS "pIC50", m AS "IC50_nM" FROM base b LEFT JOIN measured_stats s USING (key)'),
    ),
    "anti_join": (anti_join, sql(f"SELECT key AS {KEY}, lib_id FROM lib WHERE key NOT IN (SELECT key FROM base)")),
    "lookup_fill": (
        lookup_fill,
        sql('SELECT doc_id, l.logP AS "logP", l.qed AS qed, l."SAS" AS "SAS" FROM base b LEFT JOIN lib l USING (key)'),
    ),
    "name_lookup": (
        name_lookup,
        sql(f"SELECT c_custkey, raw_name, {nkey('coalesce(n.structure, raw_name)')} AS structure FROM (SELECT c_custkey, "
            f"coalesce('  ' || upper([{_name_list}][(c_custkey % 60)::INT + 1]) || ' ', c_mktsegment) AS raw_name FROM customer) c "
            f"LEFT JOIN names n ON lower({strip('raw_name')}) = n.name"),
    ),
    "group_mean_median_count": (
        group_stats,
        f"SELECT user_id::VARCHAR AS {KEY}, round(avg(-log10(value * 1e-9)), 6) AS \"pIC50\", round(median(value), 6) AS \"IC50_nM\", "
        "count(*) AS n_measurements FROM events WHERE event_type = 'purchase' AND value > 0 GROUP BY user_id",
    ),
    "class_counts": (
        lambda s, d: clean.class_counts(inp.classified(s, d), "yhat"),
        sql("SELECT yhat, count(*) AS n FROM classified GROUP BY yhat"),
    ),
    "profile_min_max": (
        lambda s, d: clean.profile(inp.table(s, d, "lineitem"), "l_extendedprice", F.col("l_returnflag") == "R"),
        "SELECT count(*) AS n, min(l_extendedprice) + 0e0 AS min_value, max(l_extendedprice) AS max_value, "
        "count(*) FILTER (l_returnflag = 'R') AS n_toxic, count(*) FILTER (l_returnflag <> 'R') AS n_non_toxic FROM lineitem",
    ),
    "median_impute": (median_impute, sql(f"SELECT lib_id, {_lib_props} FROM library")),
    "balanced_class_weights": (
        class_weights,
        sql("SELECT o_orderkey, yhat, round((SELECT count(*) FROM classified)::DOUBLE / ((SELECT count(DISTINCT yhat) FROM classified)::DOUBLE "
            "* count(*) OVER (PARTITION BY yhat)), 9) AS weight FROM classified"),
    ),
    "keep_first_dedup": (
        keep_first,
        f"SELECT min(doc_id) AS doc_id, key FROM (SELECT doc_id, sha256({nkey('text')}) AS key FROM documents) WHERE key IS NOT NULL GROUP BY key",
    ),
    "sample_exact_n": (
        sample_exact_n,
        sql("SELECT lib_id FROM (SELECT lib_id, key, row_number() OVER (PARTITION BY key ORDER BY lib_id) AS rn FROM "
            "(SELECT * FROM lib0 ORDER BY md5('42:' || lib_id) LIMIT 200) WHERE key IS NOT NULL) WHERE rn = 1 "
            "ORDER BY md5('42:' || key) LIMIT 100"),
    ),
    "stratified_split": (stratified_split, sql(_split.format(id="o_orderkey", cls="yhat", more="", src="classified"))),
    "union_by_name": (
        union_by_name,
        "SELECT c_name AS name, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer "
        "UNION ALL SELECT s_name, NULL, s_acctbal FROM supplier",
    ),
    "background_rows": (
        background_rows,
        sql(f'SELECT key AS {KEY}, logP AS "logP", qed, "SAS", 0 AS tox_binary, 0 AS assay_hits, 0 AS assay_tested, 4e0 AS "pIC50", '
            + ", ".join(f'0e0 AS "{a}"' for a in clean.ASSAYS)
            + " FROM lib WHERE key NOT IN (SELECT key FROM base)"),
    ),
    "standard_scale": (
        scaled,
        sql("SELECT vec_id, feature, round((x - avg(x) OVER w) / CASE WHEN stddev_pop(x) OVER w = 0 THEN 1e0 ELSE stddev_pop(x) OVER w END, 5) AS z "
            "FROM cells WINDOW w AS (PARTITION BY feature)"),
    ),
    "build_master": (
        build_master,
        sql(f"WITH m0 AS (SELECT b.key, {nkey('b.smiles')} AS {clean.TEXT}, (hits > 0)::INT AS tox_binary, hits AS assay_hits, tested AS assay_tested, {_assay_names}, "
            f"coalesce(s.p, {_estimate.format(h='hits')}) AS p, s.m AS ic FROM base_hits b LEFT JOIN measured_stats s USING (key)), "
            "m1 AS (SELECT m0.*, l.logP, l.qed, l.\"SAS\" AS sas FROM m0 LEFT JOIN lib l USING (key) UNION ALL "
            f"SELECT key, {nkey('smiles')}, 0, 0, 0, " + ", ".join("0e0" for _ in clean.ASSAYS)
            + ', 4e0, NULL, logP, qed, "SAS" FROM lib WHERE key NOT IN (SELECT key FROM base)) '
            f"SELECT key AS {KEY}, {clean.TEXT}, tox_binary, assay_hits, assay_tested, " + ", ".join(f'coalesce("{a}", 0e0) AS "{a}"' for a in clean.ASSAYS)
            + ', round(p, 6) AS "pIC50", round(coalesce(ic, 0e0), 6) AS "IC50_nM", '
            'round(coalesce(logP, (SELECT median(logP) FROM m1)), 6) AS "logP", round(coalesce(qed, (SELECT median(qed) FROM m1)), 6) AS qed, '
            'round(coalesce(sas, (SELECT median(sas) FROM m1)), 6) AS "SAS", '
            + _class_sql.format(h="assay_hits", p="p") + " AS toxicity_class FROM m1").replace("\nWITH m0", ",\nm0", 1),
    ),
}
