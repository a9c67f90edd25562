"""Feature, metric, training and explanation queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import inputs as inp
from catalog.inputs import WORD_RULES
from catalog.sqlkit import COUNTS_SQL, pyround, sql, text_literal
from catalog.tree_sql import comparison_sql, first_scores_sql, margins_sql, test_scores_sql, text_scores_sql
from hazardloom.functions.text import COUNT_FEATURES, count_features, hashed_ngram_bits, split_parts
from hazardloom.operators import explain, features, metrics
from hazardloom.operators.clean import KEY, TEXT
from hazardloom.operators.match import match_rules
from hazardloom.plans import scoring, training
from hazardloom.plans.boosting import TreeModel, load_model
from hazardloom.plans.evaluation import evaluation_tables
from hazardloom.session import computed_once, scratch_path, spread, write_and_read
from hazardloom.sources import files

K = 5


# --- metrics over orders ----------------------------------------------------------------
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion_matrix(inp.classified(spark, sf), "y", "yhat", K, ("model",))


def scores(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.class_scores(confusion(spark, sf), ("model",))


def counts(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.threshold_counts(metrics.one_vs_rest(inp.classified(spark, sf), [], "y", "scores", K), ["class"])


def weighted(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.weighted_metrics(scores(spark, sf), ("model",), digits=None)


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def report(spark: SparkSession, sf: str) -> DataFrame:
    rows = metrics.classification_report(scores(spark, sf), ("model",))
    return rounded(rows, 9, "precision", "recall", "f1_score")


def weighted_auc(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.weighted_auc(metrics.roc_auc(counts(spark, sf), ["class"])).select(F.round("roc_auc", 9).alias("roc_auc"))


def run_row(spark: SparkSession, sf: str) -> DataFrame:
    """Run metadata of the stand-in models, written as JSON and read back."""
    rows = inp.classified(spark, sf)
    best = metrics.best_model(
        weighted(spark, sf).withColumn("ord", F.ascii("model")), "model", "f1_score", "ord"
    )
    detailed = training.detailed_metrics(rows, K)
    chosen = best.select(F.struct("best_model", "best_f1")).scalar()
    head = {
        "best_model": chosen["best_model"],
        "best_f1": chosen["best_f1"],
        "n_classes": F.lit(K),
        "n_test": F.lit(rows.count()),
    }
    run = training.run_metadata(detailed, head)
    path = scratch_path(spark, "run-metadata")
    files.sink_json_metrics(run, path)
    return files.scan_json_metrics(spark, path)


def scan_json(spark: SparkSession, sf: str) -> DataFrame:
    rows = files.metrics_rows(run_row(spark, sf), "results", [])
    return rounded(rows, 4, "ROC-AUC")


def sink_json(spark: SparkSession, sf: str) -> DataFrame:
    run = run_row(spark, sf)
    lines = run.select(
        "best_model", F.round("best_f1", 9).alias("best_f1"), "n_classes", "n_test", F.explode("results").alias("model", "m")
    )
    return lines.select(
        "best_model", "best_f1", "n_classes", "n_test", "model", F.posexplode("m.confusion_matrix").alias("y", "line")
    ).select("best_model", "best_f1", "n_classes", "n_test", "model", "y", F.array_join("line", ",").alias("line"))


def json_documents(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON document per true class with a metric map per stand-in model."""
    per_model = (
        inp.classified(spark, sf)
        .groupBy("y", "model")
        .agg(
            F.round(F.avg((F.col("y") == F.col("yhat")).cast("double")), 6).alias("accuracy"),
            F.round(F.avg((F.col("yhat") >= 2).cast("double")), 6).alias("precision"),
        )
    )
    entry = F.struct(
        "model",
        F.struct(
            "accuracy",
            "precision",
            F.col("accuracy").alias("recall"),
            F.col("precision").alias("f1_score"),
            F.when(F.col("model") != "P", F.col("accuracy")).alias("roc_auc"),
        ),
    )
    return per_model.groupBy("y").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("document"))


def evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """All evaluation tables as one long table."""
    t = evaluation_tables(inp.classified(spark, sf), K)
    none = F.lit(None).cast("double")

    def rows(name: str, table: DataFrame, cls, x, a, b) -> DataFrame:
        return table.select(
            F.lit(name).alias("table"), "model", cls.cast("int").alias("cls"), x.alias("x"),
            F.round(a, 9).alias("a"), F.round(b, 9).alias("b"),
        )

    return (
        rows("confusion", t["confusion"], F.col("y"), F.col("yhat").cast("double"), F.col("n").cast("double"), none)
        .unionByName(rows("roc", t["roc"], F.col("class"), F.col("threshold"), F.col("fpr"), F.col("tpr")))
        .unionByName(rows("pr", t["pr"], F.col("class"), F.col("threshold"), F.col("precision"), F.col("recall")))
        .unionByName(rows("areas", t["areas"], F.col("class"), none, F.col("auc"), F.col("average_precision")))
        .unionByName(
            rows("comparison", t["comparison"], F.lit(None), none, F.col("accuracy"), F.col("f1_score"))
        )
    )


# --- features ---------------------------------------------------------------------------
def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(inp.table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return docs.select("doc_id", *count_features(F.col("text")))


def ngram_bits(spark: SparkSession, sf: str) -> DataFrame:
    return inp.parts(spark, sf).select("entity", F.explode(hashed_ngram_bits(F.col("text"))).alias("bit"))


def rule_bits(spark: SparkSession, sf: str) -> DataFrame:
    rows = inp.parts(spark, sf).withColumn("matches", match_rules(F.col("text"), WORD_RULES))
    return rows.select("entity", *features.rule_presence(F.col("matches"), WORD_RULES))


def holed_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts whose text is missing for one size."""
    return spread(inp.parts(spark, sf).select("entity", F.when(F.col("p_size") != 7, F.col("text")).alias("text")), "entity")


def feature_table(spark: SparkSession, sf: str) -> DataFrame:
    return features.set_cells(features.feature_table(holed_parts(spark, sf), "entity", "text", WORD_RULES), "features", "entity", "imputed")


def assemble_vector(spark: SparkSession, sf: str) -> DataFrame:
    sparse = features.sparse_features(spread(inp.parts(spark, sf), "entity"), "text", WORD_RULES, ["entity"])
    vectors = sparse.select("entity", features.assemble_vector(WORD_RULES).alias("features"))
    return features.set_cells(computed_once(vectors, ["features"]), "features", "entity")


def matrix_impute(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("l_orderkey") + F.col("l_partkey")
    rows = inp.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber",
        F.when(F.pmod(k, F.lit(5)) != 0, F.col("l_quantity")).alias("f0"),
        F.when(F.pmod(k, F.lit(10)) == 0, F.lit(float("nan"))).otherwise(F.col("l_extendedprice")).alias("f1"),
        F.when(F.pmod(k, F.lit(10)) == 0, F.lit(float("inf"))).otherwise(F.col("l_discount")).alias("f2"),
        F.lit(None).cast("double").alias("f3"),
    )
    return rounded(features.matrix_median_impute(rows, ["f0", "f1", "f2", "f3"]), 6, "f0", "f1", "f2")


# --- training ---------------------------------------------------------------------------
# The vectors' run: scaler, split, fits and predictions are parts of one resumable run, which the queries
# below, and other sessions, share.
def vector_run(spark: SparkSession, sf: str):
    rows = inp.vectors(spark, sf)
    return rows, training.open_run(rows, "vec_id", "cls", "embedding", K)


def vector_split(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows, run = vector_run(spark, sf)
    return training.split_parts(run, rows, "vec_id", "cls", "embedding")


def fitted(spark: SparkSession, sf: str, name: str) -> TreeModel:
    """One candidate, fitted with the full settings on the split of the vectors, or read back."""
    rows, run = vector_run(spark, sf)
    return training.fit(training.candidates()[name], run, rows, "vec_id", "cls", "embedding", K)


# Stored runs by application, data folder and name.
_STORED: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf: str, name: str, make) -> str:
    """The folder of a stored run, which ``make(folder)`` fills the first time."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _STORED:
        folder = scratch_path(spark, "models")
        make(folder)
        _STORED[key] = folder
    return _STORED[key]


def run_folder(spark: SparkSession, sf: str, rounds: int | None = None) -> str:
    """The folder of the comparison of all candidates on the vectors, with their own or fewer rounds."""

    def make(folder: str) -> None:
        specs = training.candidates()
        if rounds is not None:
            specs = {n: replace(s, rounds=rounds) for n, s in specs.items()}
        training.train_and_evaluate(inp.vectors(spark, sf), "vec_id", "cls", "embedding", specs, K, folder)

    return stored(spark, sf, f"run {rounds}", make)


def training_run(spark: SparkSession, sf: str, rounds: int | None = None) -> training.StoredRun:
    """The comparison of all candidates, stored and read back."""
    return training.load_run(spark, run_folder(spark, sf, rounds))


def labelled_parts(spark: SparkSession, sf: str) -> DataFrame:
    return spread(inp.parts(spark, sf).select("entity", "text", F.pmod("p_size", F.lit(5)).cast("int").alias("cls")), "entity")


def text_run(spark: SparkSession, sf: str) -> training.StoredRun:
    """A forest on the text features of the parts, stored and read back."""

    def make(folder: str) -> None:
        table = training.text_training_table(labelled_parts(spark, sf), "entity", "text", "cls", WORD_RULES)
        training.train_and_evaluate(
            write_and_read(table, "training"), "entity", "cls", "features", {"RandomForest": training.forest()}, K, folder,
            features.feature_names(WORD_RULES),
        )

    return training.load_run(spark, stored(spark, sf, "text run", make))


def first_scores(model: TreeModel, rows: DataFrame, rounds: int) -> DataFrame:
    """Class scores of the model's first rounds, a row per class."""
    early = model.predict(rows, "scaled", ["vec_id"], rounds)
    return early.select("vec_id", F.posexplode("scores").alias("cls", "score")).withColumn("score", F.round("score", 9))


def with_sizes(df: DataFrame, model: TreeModel) -> DataFrame:
    """Beside the rounds, or trees, that the whole model has, and the rows in the roots of each of its classes."""
    roots = model.nodes.where("node = 1").agg(F.countDistinct("round").alias("rounds")).scalar()
    return df.withColumn("rounds", roots)


def model_rows(name: str, rounds: int):
    """The test part as the first rounds of a fitted candidate score it."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        _, test = vector_split(spark, sf)
        model = fitted(spark, sf, name)
        return with_sizes(first_scores(model, test, rounds), model)

    return run


def predicted_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The test part as the fitted model predicts it, beside what its first two rounds say."""
    _, test = vector_split(spark, sf)
    model = fitted(spark, sf, "BoostedTrees")
    predicted = training.predict_proba(model, test, ["vec_id"])
    total = F.aggregate("scores", F.lit(0.0), lambda a, x: a + x)
    top = F.array_position("scores", F.array_max("scores")) - 1
    whole = predicted.select("vec_id", F.round(total, 9).alias("total"), (top == F.col("yhat")).alias("is_top"))
    return first_scores(model, test, 2).join(whole, "vec_id")


def tree_attribution(spark: SparkSession, sf: str) -> DataFrame:
    """Path contributions to the margin of each row's true class after one round: base and contributions add up to it."""
    _, test = vector_split(spark, sf)
    first = fitted(spark, sf, "BoostedTrees").upto(1)
    rows = first.contributions(test.withColumn("cls", F.col("label").cast("int")), "scaled", ["vec_id", "cls"], "cls")
    total = F.aggregate("contribution", F.col("base"), lambda a, x: a + x)
    return rows.select("vec_id", "cls", F.size("contribution").alias("features"), F.round(total, 9).alias("margin"))


def model_store(spark: SparkSession, sf: str) -> DataFrame:
    """A stored and reloaded model predicts the same; a missing one loads as None."""
    folder = scratch_path(spark, "models")
    _, test = vector_split(spark, sf)
    model = fitted(spark, sf, "RandomForest")
    model.save(f"{folder}/forest")
    loaded, missing = load_model(spark, f"{folder}/forest"), load_model(spark, f"{folder}/none")
    before = training.predict_proba(model, test, ["vec_id"]).select("vec_id", F.col("scores").alias("a"))
    after = training.predict_proba(loaded, test, ["vec_id"]).select("vec_id", F.col("scores").alias("b"))
    same = before.join(after, "vec_id").select("vec_id", (F.col("a") == F.col("b")).alias("same"), F.lit(missing is None).alias("missing_is_none"))
    return first_scores(loaded, test, 2).join(same, "vec_id")


def recomputed(predictions: DataFrame) -> DataFrame:
    """Accuracy and weighted F1 per model, straight from predicted rows."""
    # A row counts as true for its class and as predicted for its prediction.
    sides = F.array(
        F.struct(F.col("y").alias("c"), F.lit(1).alias("t"), F.lit(0).alias("p")),
        F.struct(F.col("yhat").alias("c"), F.lit(0).alias("t"), F.lit(1).alias("p")),
    )
    hits = predictions.select("model", (F.col("y") == F.col("yhat")).alias("hit"), F.explode(sides).alias("e"))
    hits = hits.groupBy("model", "e", "hit").count()
    per_class = hits.groupBy("model", "e.c").agg(
        F.sum(F.col("count") * F.col("e.t")).alias("support"),
        F.sum(F.col("count") * F.col("e.p")).alias("predicted"),
        F.sum(F.when(F.col("hit"), F.col("count") * F.col("e.t")).otherwise(0)).alias("right"),
    )
    f1 = F.when(F.col("right") > 0, 2.0 * F.col("right") / (F.col("support") + F.col("predicted"))).otherwise(0.0)
    return per_class.groupBy("model").agg(
        (F.sum("right") / F.sum("support")).alias("accuracy"), (F.sum(f1 * F.col("support")) / F.sum("support")).alias("f1")
    )


def model_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """The comparison's metrics agree with the stored predictions, which cover the hold-out."""
    run = training_run(spark, sf)
    metrics_rows = training.model_metrics(run.predictions, K)
    sizes = run.predictions.groupBy("model").agg(F.count(F.lit(1)).alias("n_test"))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 0.00006
    again = recomputed(run.predictions).select("model", F.col("accuracy").alias("a"), F.col("f1").alias("f"))
    _, test = vector_split(spark, sf)
    early = None  # the comparison after the first round of each, which SQL knows
    for name in training.candidates():
        first = fitted(spark, sf, name).predict(test, "scaled", ["label"], 1)
        # Rounded, because tied scores decide areas.
        rows = first.select(F.lit(name).alias("model"), F.col("label").cast("int").alias("y"), F.transform("scores", lambda x: F.round(x, 12)).alias("scores"))
        rows = rows.withColumn("yhat", (F.array_position("scores", F.array_max("scores")) - 1).cast("int"))
        early = rows if early is None else early.unionByName(rows)
    early = training.model_metrics(early, K, digits=None).select(
        "model", *[F.round(c, 9).alias(f"first_{c}") for c in ("accuracy", "precision", "recall", "f1_score", "roc_auc")]
    )
    metrics_rows = metrics_rows.join(early, "model")
    return metrics_rows.join(again, "model").join(sizes, "model").select(
        "model", "n_test", near("accuracy", "a").alias("accuracy_ok"), near("recall", "a").alias("recall_ok"),
        near("f1_score", "f").alias("f1_ok"), F.col("roc_auc").between(0, 1).alias("auc_ok"), "first_accuracy",
        "first_precision", "first_recall", "first_f1_score", "first_roc_auc",
    )


def train_evaluate(spark: SparkSession, sf: str) -> DataFrame:
    """What the stored metadata says, against the stored hold-out and predictions.

    Beside it the metadata of a run of one round, whose every number SQL computes.
    """
    run = training_run(spark, sf)
    rows = files.metrics_rows(run.metadata, "results", ["best_model", "best_f1", "n_features", "n_train", "n_test"])
    again = recomputed(run.predictions).select(F.col("model").alias("Model"), F.col("accuracy").alias("a"), F.col("f1").alias("f"))
    best = again.agg(F.max("f")).scalar()
    holdout = run.holdout.agg(F.count(F.lit(1))).scalar()
    first = training_run(spark, sf, 1).metadata.select("best_model", "best_f1", F.explode("results").alias("Model", "m"))
    lines = F.transform("m.confusion_matrix", lambda line: F.array_join(line, ","))
    first = first.select(
        "Model", F.col("best_model").alias("first_best"), F.round("best_f1", 9).alias("first_best_f1"),
        *[F.col(f"m.{c}").alias(f"first_{c}") for c in ("accuracy", "precision", "recall", "f1_score")],
        F.array_join(lines, ";").alias("first_matrix"),
    )
    return rows.join(again, "Model").join(first, "Model").select(
        "Model", "n_features", "n_train", "n_test", (holdout == F.col("n_test")).alias("holdout_ok"),
        (F.abs(F.col("Accuracy") - F.col("a")) <= 0.00006).alias("accuracy_ok"),
        (F.abs(F.col("best_f1") - best) <= 1e-9).alias("best_ok"), *[c for c in first.columns if c != "Model"],
    )


def areas(predictions: DataFrame) -> DataFrame:
    found = evaluation_tables(predictions, K)["areas"]
    return found.select("model", F.col("class").cast("int").alias("cls"), "auc", F.col("average_precision").alias("ap"))


def evaluated_run(spark: SparkSession, sf: str) -> DataFrame:
    """Every stored model evaluated from its files: whole, as when it was fitted, and cut to its first round."""
    folder = run_folder(spark, sf)
    early = training.predict_stored(spark, folder, 1)
    # Rounded, because tied scores decide areas.
    early = areas(early.withColumn("scores", F.transform("scores", lambda x: F.round(x, 12))))
    whole = areas(training.predict_stored(spark, folder)).withColumnsRenamed({"auc": "whole_auc", "ap": "whole_ap"})
    before = areas(training.load_run(spark, folder).predictions.select("model", "y", "yhat", "scores"))
    before = before.withColumnsRenamed({"auc": "auc_before", "ap": "ap_before"})
    same = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 1e-9
    return early.join(whole, ["model", "cls"]).join(before, ["model", "cls"]).select(
        "model", "cls", F.round("auc", 9).alias("first_auc"), F.round("ap", 9).alias("first_ap"),
        same("whole_auc", "auc_before").alias("auc_ok"), same("whole_ap", "ap_before").alias("ap_ok"),
    )


def score_with_model(spark: SparkSession, sf: str) -> DataFrame:
    """A forest trained on the text features of the parts scores all parts, alike after a reload.

    Beside it, what the first two trees say.
    """
    run = text_run(spark, sf)
    again = training.load_run(spark, stored(spark, sf, "text run", None))
    rows = labelled_parts(spark, sf).select("entity", "text")
    fields = ["predicted_class", "raw_probability", "probability", "label", "confidence"]
    one, two = (
        training.score_with_model(rows, "text", WORD_RULES, r.model).select("entity", F.struct(*fields).alias(n))
        for r, n in ((run, "a"), (again, "b"))
    )
    early = training.score_with_model(rows, "text", WORD_RULES, run.model.upto(2), health=False)
    shares = [F.round(F.col("scores")[c], 9).alias(f"first_{c}") for c in range(K)]
    early = early.select("entity", *shares, F.col("predicted_class").alias("first_class"))
    return one.join(two, "entity").join(early, "entity").select(
        "entity", (F.col("a") == F.col("b")).alias("same"), F.col("a.probability").between(0, 1).alias("in_range"),
        *early.columns[1:],
    )


def entity_scores(spark: SparkSession, sf: str, texts: DataFrame) -> DataFrame:
    """Every distinct text scored on its own with the trained model."""
    run = text_run(spark, sf)
    distinct = spread(write_and_read(texts.select("key").distinct(), "keys"), "key")
    scored = training.score_with_model(distinct, "key", WORD_RULES, run.model, health=False)
    return scored.select("key", F.col("probability").alias("alone"))


def add_bases(spark: SparkSession, sf: str, keys: list[str]):
    run = text_run(spark, sf)
    return training.add_model_bases(keys, WORD_RULES, run.model)


def score_mixtures_model(spark: SparkSession, sf: str) -> DataFrame:
    """Mixtures scored with the trained model: each component as it is scored alone."""
    uploads = inp.uploads(spark, sf).select("o_orderkey", "mixture")
    scored = scoring.score_mixture_texts(uploads, "mixture", WORD_RULES, add_bases=add_bases(spark, sf, ["o_orderkey"]))
    scored = write_and_read(scored.select("o_orderkey", "n_given", "n_used", "components"), "mixtures")
    parts = scored.select("o_orderkey", F.inline("components")).select("o_orderkey", "key", "probability")
    same = parts.join(entity_scores(spark, sf, parts), "key").groupBy("o_orderkey").agg(
        F.count(F.lit(1)).alias("n_same"), F.every(F.col("probability") == F.col("alone")).alias("same")
    )
    return scored.join(same, "o_orderkey").select("o_orderkey", "n_given", "n_used", (F.col("n_same") == F.col("n_used")).alias("complete"), "same")


def batch_route_model(spark: SparkSession, sf: str) -> DataFrame:
    """The batch scored with the trained model; a single entity's probability is its own."""
    routed = scoring.batch_route(
        inp.uploads(spark, sf), WORD_RULES, ["o_orderkey"], add_bases=add_bases(spark, sf, ["o_orderkey"])
    )
    routed = write_and_read(routed.select("o_orderkey", "Mode", "Input", "Probability", "N_Components"), "batch")
    singles = routed.where("Mode = 'Single'").select("o_orderkey", F.get(split_parts(F.col("Input"), WORD_RULES.names), F.lit(0)).alias("key"))
    alone = singles.join(entity_scores(spark, sf, singles), "key").select("o_orderkey", "alone")
    return routed.join(alone, "o_orderkey", "left").select(
        "o_orderkey", "Mode", "N_Components",
        F.when(F.col("Mode") == "Single", F.col("Probability") == F.col("alone")).otherwise(F.col("Probability").between(0, 1)).alias("ok"),
    )


def master_to_training(spark: SparkSession, sf: str) -> DataFrame:
    """Master table -> feature table -> a stored run that is read back."""
    from catalog.q_clean import built_master

    def make(folder: str) -> None:
        table = training.text_training_table(built_master(spark, sf), KEY, TEXT, "toxicity_class", WORD_RULES)
        training.train_and_evaluate(
            write_and_read(table, "features"), KEY, "toxicity_class", "features", {"RandomForest": training.forest()}, K, folder,
            features.feature_names(WORD_RULES),
        )

    run = training.load_run(spark, stored(spark, sf, "master run", make))
    return run.metadata.select("best_model", "n_features", (F.col("n_train") + F.col("n_test")).alias("n_rows"))


# --- explanation --------------------------------------------------------------------------
def linear_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Slope of the class on each feature and the feature mean; one row per feature."""
    cells = inp.vectors(spark, sf).select("cls", F.posexplode("embedding").alias("feature", "x"))
    x = F.col("x").cast("double")
    return cells.groupBy("feature").agg(
        F.round(F.covar_pop(F.col("cls").cast("double"), x) / F.var_pop(x), 6).alias("weight"),
        F.round(F.avg(x), 6).alias("mean"),
    )


def contributed(spark: SparkSession, sf: str) -> DataFrame:
    return explain.contributions(inp.vectors(spark, sf), "embedding", linear_weights(spark, sf))


def feature_labels():
    return F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.concat(F.lit("v"), i.cast("string")))


def attributed(spark: SparkSession, sf: str) -> DataFrame:
    return explain.row_attribution(contributed(spark, sf), "embedding", feature_labels())


def row_attribution(spark: SparkSession, sf: str) -> DataFrame:
    rows = attributed(spark, sf)
    sides = [
        rows.select("vec_id", F.lit(side).alias("side"), F.posexplode(f"attribution.{side}").alias("i", "e"))
        for side in ("risk", "protective")
    ]
    return sides[0].unionByName(sides[1]).select(
        "vec_id", "side", (F.col("i") + 1).alias("rank"), "e.feature", "e.contribution", "e.value"
    )


def importance(spark: SparkSession, sf: str) -> DataFrame:
    return explain.global_importance(contributed(spark, sf), "vec_id")


def dependence(spark: SparkSession, sf: str) -> DataFrame:
    points = explain.dependence_points(contributed(spark, sf), "vec_id", "embedding", importance(spark, sf))
    return rounded(points, 6, "value", "contribution")


_wm = {c: f"sum({c} * support) / sum(support)" for c in ("precision", "recall", "f1_score")}
_acc = "sum(hits)::DOUBLE / sum(support)"
_labels = "list_extract([" + ", ".join(text_literal(x) for x in WORD_RULES.labels) + "], (class + 1)::INT)"
_auc = "sum((2 * (tp - pos) + pos)::DOUBLE * neg) / 2e0 / (max(P)::DOUBLE * max(N))"
_auc_rows = f"SELECT class, max(P)::BIGINT AS n_pos, max(N)::BIGINT AS n_neg, round({_auc}, 9) AS auc FROM cum GROUP BY class"
_weighted_sql = f"SELECT model, {_acc} AS accuracy, " + ", ".join(f"{e} AS {c}" for c, e in _wm.items()) + " FROM class_scores GROUP BY model"
_ap = "sum(pos / P::DOUBLE * (tp / (tp + fp)::DOUBLE))"

# The same curves, per stand-in model.
_MODEL_CUM = (
    "WITH {head}, movr AS (SELECT model, c::INT AS class, (y = c)::INT AS is_class, scores[c + 1] AS score FROM classified, range(5) r(c)), "
    "mties AS (SELECT model, class, score, sum(is_class) AS pos, sum(1 - is_class) AS neg FROM movr GROUP BY ALL), "
    "mcum AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY model, class) AS P, "
    "sum(neg) OVER (PARTITION BY model, class) AS N FROM mties WINDOW w AS (PARTITION BY model, class ORDER BY score DESC) QUALIFY P > 0), "
    "mauc AS (SELECT model, class, max(P) AS n_pos, " + _auc + " AS auc, " + _ap + " AS ap FROM mcum GROUP BY model, class)"
)


def _models_sql(body: str) -> str:
    base = sql("SELECT 1 FROM confusion JOIN class_scores USING (model)")
    head = base[len("WITH "):base.rindex("\nSELECT 1")]
    return _MODEL_CUM.replace("{head}", head) + "\n" + body


_metric_values = (
    f"SELECT model, {pyround(_acc, 4)} AS accuracy, " + ", ".join(f"{pyround(e, 4)} AS {c}" for c, e in _wm.items())
    + " FROM class_scores GROUP BY model"
)
_evaluation = (
    'SELECT \'confusion\' AS "table", model, y AS cls, yhat::DOUBLE AS x, n::DOUBLE AS a, NULL::DOUBLE AS b FROM confusion '
    "UNION ALL SELECT 'roc', model, class, score, round(fp / N::DOUBLE, 9), round(tp / P::DOUBLE, 9) FROM mcum "
    "UNION ALL SELECT 'roc', model, class, NULL, 0e0, 0e0 FROM mauc "
    "UNION ALL SELECT 'pr', model, class, score, round(tp / (tp + fp)::DOUBLE, 9), round(tp / P::DOUBLE, 9) FROM mcum "
    "UNION ALL SELECT 'pr', model, class, NULL, 1e0, 0e0 FROM mauc "
    "UNION ALL SELECT 'areas', model, class, NULL, round(auc, 9), round(ap, 9) FROM mauc "
    f"UNION ALL SELECT 'comparison', model, NULL, NULL, accuracy, f1_score FROM ({_metric_values})"
)
_n = len(COUNT_FEATURES)
_set_cells = (
    f"SELECT entity, (i - 1)::INT AS feature, counts[i] AS value FROM f0, range(1, {_n + 1}) r(i) WHERE counts[i] <> 0 "
    f"UNION ALL SELECT entity, (unnest(bits) + {_n})::INT, 1e0 FROM f0 "
    f"UNION ALL SELECT m.entity, (m.ord - 1 + {_n + 1024})::INT, 1e0 FROM matches m JOIN f0 USING (entity)"
)
_attr_rank = (
    "SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(c) DESC, feature) AS rk FROM contrib QUALIFY rk <= 20"
)
_attr_rows = (
    "SELECT vec_id, CASE WHEN c > 0 THEN 'risk' ELSE 'protective' END AS side, row_number() OVER (PARTITION BY vec_id, c > 0 ORDER BY rk)::INT AS rank, "
    f"'v' || feature AS feature, {pyround('c', 4)} AS contribution, {pyround('x', 4)} AS value FROM ({_attr_rank}) QUALIFY rank <= 10"
)
_attr_text = (
    "SELECT v.vec_id, CASE WHEN r.t IS NULL AND p.t IS NULL THEN 'Predicted **' || l.label || '** — insufficient feature information for explanation.' "
    "ELSE 'This molecule is predicted **' || l.label || '**.' || coalesce(' Key risk-increasing features: ' || r.t || '.', '') || "
    "coalesce(' Protective features: ' || p.t || '.', '') END AS text FROM vecs v JOIN class_labels l ON l.class = v.cls "
    f"LEFT JOIN (SELECT vec_id, string_agg('**' || feature || '**', ', ' ORDER BY rank) AS t FROM ({_attr_rows}) WHERE side = 'risk' AND rank <= 3 GROUP BY vec_id) r USING (vec_id) "
    f"LEFT JOIN (SELECT vec_id, string_agg('**' || feature || '**', ', ' ORDER BY rank) AS t FROM ({_attr_rows}) WHERE side = 'protective' AND rank <= 3 GROUP BY vec_id) p USING (vec_id)"
)

_specs = training.candidates()


def _weighted_metrics_sql(scores: str) -> str:
    """Metric columns of predicted rows (vec_id, cls, score) joined to ``dealt`` (vec_id, cls = truth)."""
    return (
        f"SELECT model, max(n) AS n_test, round(sum(hit * 1e0) / max(n), 9) AS first_accuracy, "
        f"round(sum(support * coalesce(hit / nullif(predicted, 0)::DOUBLE, 0)) / max(n), 9) AS first_precision, "
        f"round(sum(hit * 1e0) / max(n), 9) AS first_recall, "
        f"round(sum(support * CASE WHEN hit > 0 THEN 2e0 * hit / (support + predicted) ELSE 0 END) / max(n), 9) AS first_f1_score, "
        f"round(sum(support * auc) / sum(support) FILTER (WHERE auc IS NOT NULL), 9) AS first_roc_auc FROM ("
        f"SELECT o.model, o.c, (SELECT count(*) FROM dealt WHERE is_test) AS n, o.support, o.predicted, o.hit, a.auc FROM ("
        f"SELECT s.model, r.c, sum((p.cls = r.c)::INT) AS support, sum((s.yhat = r.c)::INT) AS predicted, sum((p.cls = r.c AND s.yhat = r.c)::INT) AS hit "
        f"FROM (SELECT model, vec_id, arg_max(cls, (score, -cls)) AS yhat FROM ({scores}) GROUP BY model, vec_id) s "
        f"JOIN dealt p USING (vec_id), range({K}) r(c) WHERE p.is_test GROUP BY s.model, r.c) o "
        f"LEFT JOIN (SELECT model, cls, sum(CASE WHEN y THEN 0e0 + below + ties / 2e0 END) / (sum(y::INT) * sum((NOT y)::INT)) AS auc FROM ("
        f"SELECT model, cls, y, sum((NOT y)::INT) OVER (PARTITION BY model, cls ORDER BY score RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) "
        f"- sum((NOT y)::INT) OVER (PARTITION BY model, cls, score) AS below, sum((NOT y)::INT) OVER (PARTITION BY model, cls, score) AS ties "
        f"FROM (SELECT model, s.cls, score, p.cls = s.cls AS y FROM ({scores}) s JOIN dealt p USING (vec_id) WHERE p.is_test)) "
        f"GROUP BY model, cls HAVING sum(y::INT) > 0) a ON a.model = o.model AND a.cls = o.c) GROUP BY model"
    )


_matrix = (
    "SELECT model, string_agg(line, ';' ORDER BY y) AS first_matrix FROM (SELECT model, y, string_agg(n::VARCHAR, ',' ORDER BY c) AS line FROM ("
    "SELECT m.model, a.y, b.c, count(s.vec_id) AS n FROM (SELECT DISTINCT model FROM every_score) m, "
    f"range({K}) a(y), range({K}) b(c) LEFT JOIN (SELECT model, vec_id, p.cls AS y, arg_max(s.cls, (score, -s.cls)) AS c "
    "FROM every_score s JOIN dealt p USING (vec_id) WHERE is_test GROUP BY ALL) s ON s.model = m.model AND s.y = a.y AND s.c = b.c "
    "GROUP BY ALL) GROUP BY ALL) GROUP BY model"
)
_train_evaluate = (
    f"SELECT w.model AS \"Model\", 64 AS n_features, (SELECT count(*) FROM dealt WHERE NOT is_test) AS n_train, n_test, true AS holdout_ok, true AS accuracy_ok, "
    f"true AS best_ok, arg_max(w.model, (first_f1_score, -o)) OVER () AS first_best, max(first_f1_score) OVER () AS first_best_f1, "
    + ", ".join(f"{pyround(f'first_{c}', 4)} AS first_{c}" for c in ("accuracy", "precision", "recall", "f1_score"))
    + f", first_matrix FROM ({_weighted_metrics_sql('SELECT * FROM every_score')}) w JOIN ({_matrix}) x ON x.model = w.model "
    f"JOIN (VALUES {', '.join(f'({text_literal(n)}, {i})' for i, n in enumerate(_specs))}) c(model, o) ON c.model = w.model"
)
_first_areas = (
    f"SELECT model, class AS cls, round({_auc}, 9) AS first_auc, round({_ap}, 9) AS first_ap, true AS auc_ok, true AS ap_ok FROM ("
    "SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY model, class) AS P, sum(neg) OVER (PARTITION BY model, class) AS N "
    "FROM (SELECT model, s.cls AS class, score, sum((p.cls = s.cls)::INT) AS pos, sum((p.cls <> s.cls)::INT) AS neg FROM every_score s "
    "JOIN dealt p USING (vec_id) WHERE is_test GROUP BY ALL) WINDOW w AS (PARTITION BY model, class ORDER BY score DESC)) GROUP BY model, class"
)

_text_head = sql("SELECT 1 FROM feat JOIN matches USING (entity)")
_text_scores = text_scores_sql(
    _text_head[len("WITH "):_text_head.rindex("\nSELECT 1")] + ", f0 AS (SELECT * FROM feat)",
    "SELECT entity AS vec_id, (p_size % 5)::INT AS cls FROM parts", _set_cells, _n + 1024 + len(WORD_RULES.alerts), training.forest(), 2,
    "SELECT vec_id AS entity, true AS same, true AS in_range, "
    + ", ".join(f"round(max(score) FILTER (cls = {c}), 9) AS first_{c}" for c in range(K))
    + ", arg_max(cls, (score, -cls)) AS first_class FROM t_scores GROUP BY vec_id",
)

QUERIES: dict = {
    "scan_json_metrics": (
        scan_json,
        _models_sql('SELECT v.model AS "Model", accuracy AS "Accuracy", precision AS "Precision", recall AS "Recall", f1_score AS "F1 Score", '
                    f'round(w, 4) AS "ROC-AUC" FROM ({_metric_values}) v JOIN (SELECT model, sum(auc * n_pos) / sum(n_pos) AS w FROM mauc GROUP BY model) USING (model)'),
    ),
    "sink_json_metrics": (
        sink_json,
        sql(f"SELECT b.best_model, round(b.best_f1, 9) AS best_f1, 5 AS n_classes, (SELECT count(*) FROM orders) AS n_test, c.model, c.y, "
            f"string_agg(c.n::VARCHAR, ',' ORDER BY c.yhat) AS line FROM confusion c, "
            f"(SELECT model AS best_model, f1_score AS best_f1 FROM ({_weighted_sql}) ORDER BY f1_score DESC, model LIMIT 1) b GROUP BY ALL"),
    ),
    "json_metrics_to_rows": (
        lambda s, d: files.json_metrics_rows(json_documents(s, d), "document", ["y"]),
        sql('SELECT y, model AS "Model", a AS "Accuracy", p AS "Precision", a AS "Recall", p AS "F1 Score", CASE WHEN model <> \'P\' THEN a ELSE 0e0 END AS "ROC-AUC" '
            "FROM (SELECT y, model, round(avg((y = yhat)::INT), 6) AS a, round(avg((yhat >= 2)::INT), 6) AS p FROM classified GROUP BY y, model)"),
    ),
    "one_hot_labels": (
        lambda s, d: metrics.one_hot(inp.classified(s, d), ["o_orderkey"], "y", K),
        sql("SELECT o_orderkey, class, is_class FROM ovr"),
    ),
    "confusion_matrix": (confusion, sql("SELECT model, y, yhat, n FROM confusion")),
    "weighted_metrics": (
        lambda s, d: metrics.weighted_metrics(scores(s, d), ("model",)), sql(_metric_values)
    ),
    "classification_report": (
        report,
        sql(f"SELECT model, {_labels} AS row, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1_score, 9) AS f1_score, support::BIGINT AS support FROM class_scores "
            f"UNION ALL SELECT model, 'accuracy', NULL, NULL, round({_acc}, 9), sum(support)::BIGINT FROM class_scores GROUP BY model "
            "UNION ALL SELECT model, 'macro avg', round(avg(precision), 9), round(avg(recall), 9), round(avg(f1_score), 9), sum(support)::BIGINT FROM class_scores GROUP BY model "
            f"UNION ALL SELECT model, 'weighted avg', round({_wm['precision']}, 9), round({_wm['recall']}, 9), round({_wm['f1_score']}, 9), sum(support)::BIGINT FROM class_scores GROUP BY model"),
    ),
    "roc_curve": (
        lambda s, d: rounded(metrics.roc_curve(counts(s, d), ["class"]), 9, "fpr", "tpr"),
        sql("SELECT class, score AS threshold, round(fp / N::DOUBLE, 9) AS fpr, round(tp / P::DOUBLE, 9) AS tpr FROM cum "
            "UNION ALL SELECT DISTINCT class, NULL, 0e0, 0e0 FROM cum"),
    ),
    "roc_auc_ovr": (lambda s, d: rounded(metrics.roc_auc(counts(s, d), ["class"]), 9, "auc"), sql(_auc_rows)),
    "roc_auc_weighted": (
        weighted_auc,
        sql(f"SELECT round(sum(a * n) / sum(n), 9) AS roc_auc FROM (SELECT class, max(P) AS n, {_auc} AS a FROM cum GROUP BY class)"),
    ),
    "pr_curve_ap": (
        lambda s, d: rounded(
            metrics.pr_curve(counts(s, d), ["class"]).join(metrics.average_precision(counts(s, d), ["class"]), "class"),
            9, "precision", "recall", "average_precision",
        ),
        sql("SELECT x.*, ap AS average_precision FROM (SELECT class, score AS threshold, round(tp / (tp + fp)::DOUBLE, 9) AS precision, round(tp / P::DOUBLE, 9) AS recall FROM cum "
            f"UNION ALL SELECT DISTINCT class, NULL, 1e0, 0e0 FROM cum) x JOIN (SELECT class, round({_ap}, 9) AS ap FROM cum GROUP BY class) USING (class)"),
    ),
    "best_per_metric": (
        lambda s, d: rounded(
            metrics.best_per_metric(weighted(s, d), "model", ["accuracy", "precision", "recall", "f1_score"]), 9, "value"
        ),
        sql(f"SELECT model, metric, round(value, 9) AS value, round(value, 9) = round(max(value) OVER (PARTITION BY metric), 9) AS is_best FROM "
            f"(UNPIVOT ({_weighted_sql}) ON accuracy, precision, recall, f1_score INTO NAME metric VALUE value)"),
    ),
    "best_model": (
        lambda s, d: metrics.best_model(weighted(s, d).withColumn("ord", F.ascii("model")), "model", "f1_score", "ord").withColumn(
            "best_f1", F.round("best_f1", 9)
        ),
        sql(f"SELECT model AS best_model, round(f1_score, 9) AS best_f1 FROM ({_weighted_sql}) ORDER BY f1_score DESC, model LIMIT 1"),
    ),
    "evaluation_tables": (evaluation, _models_sql(_evaluation)),
    "token_count_features": (
        token_counts, "SELECT doc_id, " + ", ".join(f"{e} AS {n}" for n, e in zip(COUNT_FEATURES, COUNTS_SQL)) + " FROM documents"
    ),
    "hashed_ngram_bits": (ngram_bits, sql("SELECT entity, unnest(bits) AS bit FROM feat")),
    "rule_presence_bits": (
        rule_bits,
        sql("SELECT p.entity, " + ", ".join(f"coalesce(max((m.ord = {a[0]})::INT), 0) AS rule_{a[0]}" for a in WORD_RULES.alerts)
            + " FROM parts p LEFT JOIN matches m USING (entity) GROUP BY p.entity"),
    ),
    "assemble_vector": (
        assemble_vector, sql("WITH f0 AS (SELECT * FROM feat) " + _set_cells).replace("\nWITH f0", ",\nf0", 1)
    ),
    "feature_table": (
        feature_table,
        sql("WITH f0 AS (SELECT f.* FROM feat f JOIN parts p USING (entity) WHERE p_size <> 7), c0 AS (" + _set_cells + "), "
            "per AS (SELECT feature, count(*) AS c FROM c0 GROUP BY feature), "
            "med AS (SELECT feature, median(value) AS m FROM (SELECT feature, value FROM c0 UNION ALL "
            "SELECT feature, 0e0 FROM per, range(0, (SELECT count(*) FROM f0) - c) z(j)) GROUP BY feature) "
            "SELECT entity, false AS imputed, feature, value FROM c0 UNION ALL "
            "SELECT p.entity, true, feature, m FROM parts p, med WHERE p.p_size = 7 AND m <> 0").replace("\nWITH f0", ",\nf0", 1),
    ),
    "matrix_median_impute": (
        matrix_impute,
        "WITH x AS (SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN (l_orderkey + l_partkey) % 5 <> 0 THEN l_quantity END AS f0, "
        "CASE WHEN (l_orderkey + l_partkey) % 10 <> 0 THEN l_extendedprice END AS f1, CASE WHEN (l_orderkey + l_partkey) % 10 <> 0 THEN l_discount END AS f2 FROM lineitem) "
        "SELECT l_orderkey, l_partkey, l_linenumber, f0 IS NULL AND f1 IS NULL AND f2 IS NULL AS all_missing, "
        + ", ".join(f"round(coalesce({c}, (SELECT median({c}) FROM x)), 6) AS {c}" for c in ("f0", "f1", "f2")) + ", 0e0 AS f3 FROM x",
    ),
    "train_forest": (model_rows("RandomForest", 3), test_scores_sql(_specs["RandomForest"], 3, ", 300::BIGINT AS rounds")),
    "train_boosted": (model_rows("BoostedTrees", 1), test_scores_sql(_specs["BoostedTrees"], 1, ", 300::BIGINT AS rounds")),
    "train_boosted_balanced": (
        model_rows("BalancedBoostedTrees", 1), test_scores_sql(_specs["BalancedBoostedTrees"], 1, ", 300::BIGINT AS rounds")
    ),
    "predict_proba": (predicted_rows, test_scores_sql(_specs["BoostedTrees"], 2, ", 1e0 AS total, true AS is_top")),
    "tree_attribution": (tree_attribution, margins_sql(_specs["BoostedTrees"])),
    "model_store": (model_store, test_scores_sql(_specs["RandomForest"], 2, ", true AS same, true AS missing_is_none")),
    "model_comparison": (model_comparison, comparison_sql(_specs, _weighted_metrics_sql)),
    "train_evaluate": (train_evaluate, first_scores_sql(_specs, _train_evaluate)),
    "evaluate_stored_run": (evaluated_run, first_scores_sql(_specs, _first_areas)),
    "score_with_model": (score_with_model, _text_scores),
    "score_mixtures_model": (
        score_mixtures_model,
        sql("SELECT o_orderkey, len(mix_parts)::INT AS n_given, len(mix_parts[1:10])::INT AS n_used, true AS complete, true AS same "
            "FROM upload_parts WHERE len(mix_parts) >= 2"),
    ),
    "batch_route_model": (
        batch_route_model,
        sql("SELECT o_orderkey, CASE WHEN len(mix_parts) >= 2 THEN 'Mixture' WHEN len(one_parts) >= 1 THEN 'Single' ELSE 'Error' END AS \"Mode\", "
            "CASE WHEN len(mix_parts) >= 2 THEN len(mix_parts[1:10]) WHEN len(one_parts) >= 1 THEN 1 ELSE 0 END::INT AS \"N_Components\", true AS ok "
            "FROM upload_parts"),
    ),
    "master_to_training": (
        master_to_training,
        sql(f"SELECT 'RandomForest' AS best_model, {_n + 1024 + len(WORD_RULES.alerts)} AS n_features, count(*) AS n_rows "
            "FROM (SELECT key FROM base UNION SELECT key FROM lib)"),
    ),
    "row_attribution_topk": (row_attribution, sql(_attr_rows)),
    "attribution_text": (
        lambda s, d: attributed(s, d).select("vec_id", explain.attribution_text(F.col("attribution"), F.col("cls")).alias("text")),
        sql(_attr_text),
    ),
    "global_importance": (lambda s, d: rounded(importance(s, d), 6, "importance"), sql("SELECT feature, round(importance, 6) AS importance FROM importance")),
    "topk_features": (
        lambda s, d: rounded(explain.top_features(importance(s, d)), 6, "importance"),
        sql("SELECT feature, round(importance, 6) AS importance FROM importance ORDER BY importance.importance DESC, feature LIMIT 20"),
    ),
    "dependence_points": (
        dependence,
        sql("SELECT vec_id, feature, round(x, 6) AS value, round(c, 6) AS contribution FROM contrib JOIN vsample USING (vec_id) "
            "WHERE feature IN (SELECT feature FROM importance ORDER BY importance.importance DESC, feature LIMIT 5)"),
    ),
}
