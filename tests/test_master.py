"""Master table, file sources and sinks, training run."""

import hashlib
import statistics

import pytest
from pyspark.sql import functions as F

from hazardloom.operators.clean import ASSAYS, KEY, PROPERTIES, TEXT
from hazardloom.plans import master, training
from hazardloom.plans.boosting import load_model
from hazardloom.rules import RuleBook
from hazardloom.session import scratch_path, shared_dir, write_and_read
from hazardloom.sources import files


def assay_row(ord_, smiles, **cells):
    return (ord_, smiles, *[cells.get(a) for a in ASSAYS])


@pytest.fixture
def sources(spark):
    hit = dict.fromkeys(ASSAYS, 1.0)
    assay_rows = [
        assay_row(1, "A", **{ASSAYS[0]: 1.0, ASSAYS[1]: 0.0}),
        assay_row(2, " A\n", **hit),  # same key: dropped
        assay_row(3, "B", **hit),
        assay_row(4, "C"),  # nothing tested
        assay_row(5, None, **hit),
        assay_row(6, "  ", **hit),
        assay_row(7, "D", **{a: 1.0 for a in ASSAYS[:4]}),
    ]
    schema = "ord int, smiles string, " + ", ".join(f"`{a}` double" for a in ASSAYS)
    assays = spark.createDataFrame(assay_rows, schema)
    measurements = spark.createDataFrame(
        [("A", "IC50", "1000"), ("A ", "IC50", "10"), ("A", "IC50", "100"), ("A", "Ki", "1"), ("C", "IC50", "abc"),
         ("C", "IC50", "0"), ("C", "IC50", "-4"), ("C", "IC50", None), ("Z", "IC50", "5"), (None, "IC50", "5")],
        "Smiles string, `Standard Type` string, `Standard Value` string",
    )
    library = spark.createDataFrame(
        [(1, "B", 1.0, 0.1, None), (2, "E\n", 2.0, None, 3.0), (3, "F", None, 0.5, 4.0), (4, "E", 9.0, 9.0, 9.0), (5, "", 1.0, 1.0, 1.0)],
        "lib int, smiles string, logP double, qed double, SAS double",
    )
    return assays, measurements, library


def build(sources, **options):
    assays, measurements, library = sources
    return master.master_from_sources(
        assays, measurements, library, assay_order=[F.col("ord")], library_id="lib", library_order=[F.col("lib")], **options
    )


def test_master_by_hand(spark, sources):
    rows = {r[KEY]: r for r in build(sources, sample=None).collect()}
    assert set(rows) == {"A", "B", "C", "D", "E", "F"}
    a, b, c, d, e, f = (rows[k] for k in "ABCDEF")
    assert (a["assay_hits"], a["assay_tested"], a["tox_binary"]) == (1, 2, 1)
    assert a["pIC50"] == pytest.approx((6 + 8 + 7) / 3) and a["IC50_nM"] == 100.0
    assert a["toxicity_class"] == 4  # mean potency 7
    assert (b["assay_hits"], b["pIC50"], b["toxicity_class"]) == (12, 9.0, 4)
    assert (c["assay_hits"], c["assay_tested"], c["pIC50"], c["IC50_nM"], c["toxicity_class"]) == (0, 0, 4.0, 0.0, 0)
    assert d["pIC50"] == round(4 + 4 / 12 * 5, 3) and d["toxicity_class"] == 2
    assert (e["pIC50"], e["toxicity_class"], e["assay_tested"], e["logP"]) == (4.0, 0, 0, 2.0)
    assert b["logP"] == 1.0 and b["qed"] == 0.1  # filled from the library
    for name, known in zip(PROPERTIES, ([1.0, 2.0], [0.1, 0.5], [3.0, 4.0])):
        middle = statistics.median(known)
        assert c[name] == middle
    assert all(r[x] is not None for r in rows.values() for x in ASSAYS)


def test_master_sample_and_digest(spark, sources):
    sampled = build(sources, sample=2).collect()
    background = [r for r in sampled if r[KEY] in ("E", "F")]
    assert len(background) <= 2
    digest = {r[KEY]: r[TEXT] for r in build(sources, sample=None, digest=True).collect()}
    assert len(digest) == 6
    assert all(k == hashlib.sha256(t.encode()).hexdigest() for k, t in digest.items())


def test_csv_round_trip(spark):
    rows = [(1, 'a "quoted", text', 1.5), (2, "two\nlines; here", None), (3, None, 0.1), (4, "back\\slash", -2.0)]
    df = spark.createDataFrame(rows, "id int, t string, v double")
    for sep in (",", ";"):
        path = scratch_path(spark, "csv")
        files.sink_csv(df, path, sep)
        assert sorted(map(tuple, files.scan_csv(spark, path, df.schema, sep, multi_line=True).collect())) == rows


def test_csv_columns_by_name(spark):
    path = scratch_path(spark, "csv")
    files.sink_csv(spark.createDataFrame([("M1", "CCO", "x", 0.5), ("M2", "C", "1.5", 0.1)], "mol_id string, smiles string, logP string, SAS double"), path)
    wanted = "SAS double, smiles string, logP double"
    assert sorted(map(tuple, files.scan_csv(spark, path, wanted).collect())) == [(0.1, "C", 1.5), (0.5, "CCO", None)]
    with pytest.raises(ValueError, match="qed"):
        files.scan_csv(spark, path, "smiles string, qed double")
    assert dict(files.scan_csv(spark, path).dtypes)["SAS"] == "double"


def test_missing_files(spark):
    assert files.scan_json_metrics(spark, scratch_path(spark, "none")).count() == 0
    assert load_model(spark, scratch_path(spark, "none")) is None


def test_json_rows_default_the_missing_auc(spark):
    text = '{"m1": {"accuracy": 0.5, "precision": 0.4, "recall": 0.5, "f1_score": 0.45, "roc_auc": 0.7}, "m2": {"accuracy": 0.1}}'
    df = spark.createDataFrame([(1, text)], "id int, doc string")
    rows = {r["Model"]: r for r in files.json_metrics_rows(df, "doc", ["id"]).collect()}
    assert rows["m1"]["ROC-AUC"] == 0.7 and rows["m2"]["ROC-AUC"] == 0.0 and rows["m2"]["Recall"] is None


def test_preview_and_counts(spark):
    df = spark.range(20)
    n, columns, first = files.preview(df, ["id"])
    assert (n, columns, [r["id"] for r in first.collect()]) == (20, 1, [0, 1, 2, 3, 4])
    assert {r["source"]: r["n"] for r in files.source_counts({"a": df, "b": df.limit(3)}).collect()} == {"a": 20, "b": 3}


def test_shared_dir_is_the_configured_one(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_training_run_end_to_end(spark):
    """Two separable classes of vectors: models beat chance, are stored, and read back."""
    rows = [(i, [float(i % 2) * 3 + (i * 7 % 11) / 11, (i * 5 % 13) / 13], i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "k int, f array<double>, c int")
    small = training.candidates({"rounds": 5, "max_depth": 3}, {"rounds": 2, "max_depth": 2})
    folder = scratch_path(spark, "store")
    run = training.train_and_evaluate(df, "k", "c", "f", small, k=2, store=folder)
    assert run.sizes == {"n_train": 96, "n_test": 24, "n_features": 2}
    table = {r["model"]: r for r in run.metrics.collect()}
    assert set(table) == {"BoostedTrees", "RandomForest", "BalancedBoostedTrees"}
    assert all(r["f1_score"] == 1.0 and r["roc_auc"] == 1.0 for r in table.values())
    assert run.best == "BoostedTrees"  # first on ties
    for row in run.predictions.collect():
        assert sum(row["scores"]) == pytest.approx(1.0) and len(row["scores"]) == 2
    assert load_model(spark, run.paths["best"]).nodes.count() == run.models[run.best].nodes.count()
    assert load_model(spark, folder + "/none") is None
    assert spark.read.parquet(run.paths["feature_names"]).count() == 2
    assert len(spark.read.parquet(run.paths["scaler"]).first()["mean"]) == 2
    stored = files.scan_json_metrics(spark, run.paths["metadata"]).first()
    assert (stored["best_model"], stored["n_classes"], stored["n_test"]) == ("BoostedTrees", 2, 24)
    assert stored["results"]["RandomForest"]["confusion_matrix"] == [[12, 0], [0, 12]]
    assert stored["results"]["RandomForest"]["classification_report"]["macro avg"]["f1-score"] == 1.0


def test_scoring_with_a_trained_model(spark):
    """Texts with a ring are class 4, others class 0: the model's probabilities drive the score."""
    rules = RuleBook.default()
    chains = ["C" * n + tail for n in range(1, 21) for tail in ("O", "")]
    texts = chains + [f"c1ccccc1{c}" for c in chains]
    rows = [(i, t, 4 if t.startswith("c1") else 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "k int, t string, c int")
    table = write_and_read(training.text_training_table(df, "k", "t", "c", rules), "features")
    run = training.train_and_evaluate(
        table, "k", "c", "features", {"RandomForest": training.forest(rounds=10, max_depth=4)}
    )
    extra = spark.createDataFrame([(900, " ", 0), (901, None, 0)], df.schema)
    scored = training.score_with_model(df.union(extra), "t", rules, run.models["RandomForest"]).collect()
    assert len(scored) == len(rows)
    for r in scored:
        assert r["predicted_class"] == r["c"]
        assert (r["probability"] > 0.5) == (r["c"] == 4)
        assert r["raw_probability"] > 0.5
