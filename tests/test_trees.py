"""Histogram trees: both ways of fitting, resumed runs, walking and contributions against plain versions."""

import dataclasses
import math
import pathlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from hazardloom.operators import trees as T
from hazardloom.operators.trees import Forest, TreeSpec
from hazardloom.plans import training
from hazardloom.plans.boosting import fit_trees, load_model
from hazardloom.session import scratch_path
from hazardloom.sources.runs import RunStore, table_digest

LEVELS = TreeSpec("boosted", 7, max_depth=3, min_hessian=1.0, l2=1.0)
LEAVES = TreeSpec("boosted", 5, max_leaves=6, min_rows=5, min_hessian=1e-3)
TREES = TreeSpec("forest", 6, max_depth=6, min_rows=2, min_split_rows=5)
SPECS = pytest.mark.parametrize("spec", [LEVELS, LEAVES, TREES], ids=["levels", "leaves", "forest"])


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((700, 12)).round(2)
    x[:, 3] = 1.0  # no spread
    x[:, 4] = (x[:, 4] > 0).astype(float)
    y = (x[:, 0] > 0).astype(int) + (x[:, 1] * x[:, 2] > 0.3)
    rows = [(int(i), [float(v) for v in x[i]], int(y[i]), 1.0 + (i % 3) / 7) for i in range(700)]
    return spark.createDataFrame(rows, "k long, f array<double>, y int, w double")


def fitted(spark, table, spec, name=None, **ways):
    store = RunStore(spark, "trees", name or "t", scratch_path(spark, "runs"))
    return fit_trees(spec, table, "k", "y", "w", "f", 3, store, **ways)


def node_set(model):
    return sorted(map(str, model.nodes.select(sorted(model.nodes.columns)).collect()))


@SPECS
def test_both_ways_and_any_partitioning_grow_the_same_trees(spark, table, spec):
    near = fitted(spark, table, spec)
    far = fitted(spark, table.repartition(5, "k"), spec, local_bytes=0, block=2)
    assert node_set(near) == node_set(far)
    assert near.nodes.where("node = 1").count() == spec.rounds * (3 if spec.kind == "boosted" else 1)


def plain_walk(rows, x, k, spec):
    """Class scores of one row of cells, tree by tree."""
    by_tree = {}
    for r in rows:
        by_tree.setdefault((r["round"], r["cls"]), {})[r["node"]] = r
    margins, shares = [0.0] * k, []
    for (_, c), nodes in sorted(by_tree.items()):
        node = nodes[1]
        while node["feature"] is not None:
            node = nodes[node["left"] if x[node["feature"]] <= node["cell"] else node["right"]]
        if spec.kind == "boosted":
            margins[c] += node["value"][0]
        else:
            shares.append(node["value"])
    if spec.kind == "boosted":
        e = [math.exp(m) for m in margins]
        return [v / sum(e) for v in e]
    return [sum(s[c] for s in shares) / len(shares) for c in range(k)]


@SPECS
def test_predictions_by_walking_and_by_sql(spark, table, spec):
    """The node table is all there is to a model: plain loops and a recursive SQL query walk it to the same scores."""
    model = fitted(spark, table, spec)
    found = {r.k: r for r in model.predict(table, "f", ["k", "y"]).collect()}
    rows = [r.asDict() for r in model.nodes.collect()]
    _, low, high = model.arrays()
    data = table.collect()
    cells = T.cells(np.array([r.f for r in data]), low, high)
    for r, x in zip(data[:60], cells[:60], strict=True):
        assert found[r.k].scores == pytest.approx(plain_walk(rows, x, 3, spec), abs=1e-12)
    assert sum(r.yhat == r.y for r in found.values()) / len(found) > 0.8
    assert all(r.yhat == r.scores.index(max(r.scores)) for r in found.values())
    folder = scratch_path(spark, "model")
    model.save(folder)
    con = duckdb.connect()
    con.register("cells", __import__("pyarrow").table({"k": [r.k for r in data for _ in range(12)], "f": list(range(12)) * len(data), "cell": cells.ravel()}))
    walked = con.execute(
        f"WITH RECURSIVE nodes AS (SELECT * FROM read_parquet('{folder}/nodes/*.parquet')), walk AS ("
        "SELECT c.k, n.round, n.cls, n.node, n.feature, n.value FROM (SELECT DISTINCT k FROM cells) c, nodes n WHERE n.node = 1 UNION ALL "
        "SELECT w.k, w.round, w.cls, n.node, n.feature, n.value FROM walk w JOIN nodes p ON (p.round, p.cls, p.node) = (w.round, w.cls, w.node) "
        "JOIN cells c ON c.k = w.k AND c.f = w.feature JOIN nodes n ON (n.round, n.cls, n.node) = (w.round, w.cls, CASE WHEN c.cell <= p.cell THEN p.left ELSE p.right END)) "
        + ("SELECT k, cls, sum(value[1]) FROM walk WHERE feature IS NULL GROUP BY k, cls" if spec.kind == "boosted"
           else "SELECT k, c, avg(value[c + 1]) FROM walk, range(3) r(c) WHERE feature IS NULL GROUP BY k, c")
    ).fetchall()
    sums = {}
    for k, c, v in walked:
        sums.setdefault(k, {})[c] = v
    for k, by_class in sums.items():
        values = [by_class[c] for c in range(3)]
        if spec.kind == "boosted":
            e = [math.exp(v) for v in values]
            values = [v / sum(e) for v in e]
        assert found[k].scores == pytest.approx(values, abs=1e-12)


@SPECS
def test_contributions_add_up_to_the_prediction(spark, table, spec):
    model = fitted(spark, table, spec)
    predicted = model.predict(table, "f", ["k", "f"])
    rows = model.contributions(predicted, "f", ["k", "scores", "yhat"], "yhat").collect()
    forest, low, high = model.arrays()
    margins = {r.k: m for r, m in zip(table.collect(), forest.margins(T.cells(np.array([r.f for r in table.collect()]), low, high), 3), strict=True)} \
        if spec.kind == "boosted" else None
    for r in rows:
        wanted = margins[r.k][r.yhat] if margins else r.scores[r.yhat]
        assert r.base + sum(r.contribution) == pytest.approx(wanted, abs=1e-9)
        assert r.contribution[3] == 0  # no tree can cut a constant


def test_leaf_wise_growth_takes_the_best_leaf(spark, table):
    model = fitted(spark, table, LEAVES)
    leaves = model.nodes.where("feature is null").groupBy("round", "cls").count()
    assert leaves.agg(F.max("count")).first()[0] == 6
    # An unsplit leaf never had more to gain than a split one when it was passed over.
    deep = fitted(spark, table, dataclasses.replace(LEAVES, max_leaves=None, rounds=1))
    chosen = {(r.cls, r.node) for r in model.nodes.where("round = 0 and feature is not null").collect()}
    gains = {(r.cls, r.node): r.gain for r in deep.nodes.where("feature is not null").collect()}
    for cls in range(3):
        taken = {n for c, n in chosen if c == cls}
        assert len(taken) == 5
        open_nodes = {n for c, n in gains if c == cls and n not in taken and (n == 1 or n // 2 in taken)}
        last = min(gains[cls, n] for n in taken if 2 * n not in taken and 2 * n + 1 not in taken)
        assert all(gains[cls, n] <= last for n in open_nodes)


def test_first_split_by_brute_force(spark, table):
    model = fitted(spark, table, dataclasses.replace(LEVELS, rounds=1))
    data = table.collect()
    _, low, high = model.arrays()
    cells = T.cells(np.array([r.f for r in data]), low, high)
    y, w = np.array([r.y for r in data]), np.array([r.w for r in data])
    for c in range(3):
        g, h = (1 / 3 - (y == c)) * w, 2 * (1 / 3) * (2 / 3) * w
        root = model.nodes.where(f"node = 1 and cls = {c}").first()

        def worth(at):
            return g[at].sum() ** 2 / (h[at].sum() + 1)

        every = np.ones(len(y), bool)
        best = max(
            worth(left) + worth(~left) - worth(every)
            for f in range(12) for cut in np.unique(cells[:, f])[:-1]
            if (left := cells[:, f] <= cut).any() and h[left].sum() >= 1 and h[~left].sum() >= 1
        )
        # Bins can leave out a cut; here every feature has few enough values for its own bins or loses little.
        assert best * 0.97 <= root.gain <= best + 1e-4


def test_a_run_that_was_cut_off_goes_on(spark, table, monkeypatch):
    """A fit stopped after two blocks is finished by another one, which grows the rest only, to the same trees."""
    import hazardloom.plans.boosting as boosting

    root, made = scratch_path(spark, "runs"), []
    whole = fitted(spark, table, LEVELS, block=2)
    real = boosting.Trainer._near_block

    def stops(self, shared, earlier, first, count):
        if first >= 4 and len(made) < 3:
            made.append("stopped")
            raise KeyboardInterrupt
        made.append(first)
        return real(self, shared, earlier, first, count)

    monkeypatch.setattr(boosting.Trainer, "_near_block", stops)
    with pytest.raises(KeyboardInterrupt):
        fit_trees(LEVELS, table, "k", "y", "w", "f", 3, RunStore(spark, "trees", "t", root), block=2)
    model = fit_trees(LEVELS, table, "k", "y", "w", "f", 3, RunStore(spark, "trees", "t", root), block=2)
    assert made == [0, 2, "stopped", 4, 6]
    assert node_set(model) == node_set(whole)
    again = fit_trees(LEVELS, table, "k", "y", "w", "f", 3, RunStore(spark, "trees", "t", root), block=2)
    assert made == [0, 2, "stopped", 4, 6] and node_set(again) == node_set(whole)


def test_a_block_goes_on_from_the_margins_before(spark, table, monkeypatch):
    """Blocks leave the margins of all rows, also of repeated ones, so that later blocks walk no earlier trees."""
    import hazardloom.plans.boosting as boosting

    monkeypatch.setattr(boosting, "MARGIN_ROWS", 100)
    rows, root = table.union(table.limit(90)), scratch_path(spark, "runs")
    model = fit_trees(LEVELS, rows, "k", "y", "w", "f", 3, RunStore(spark, "trees", "t", root), block=2)
    (store,) = [p.parent for p in pathlib.Path(root).rglob("rounds-0-2")]
    parts = spark.read.parquet(f"{store}/rounds-0-2").where("margins is not null").orderBy("part").collect()
    assert [r["part"] for r in parts] == list(range(8))
    margins = np.frombuffer(b"".join(r["margins"] for r in parts)).reshape(-1, 3)
    scores = np.array([r["scores"] for r in model.predict(rows, "f", ["k"], 2).collect()])
    assert np.allclose(np.sort(T.softmax(margins), axis=0), np.sort(scores, axis=0))
    # A run whose first blocks keep no margins goes on to the same trees.
    other = scratch_path(spark, "runs")
    there = str(store).replace(root, other)
    for name in ("rounds-0-2", "rounds-2-2"):
        spark.read.parquet(f"{store}/{name}").where("node is not null").drop("part", "margins").write.parquet(f"{there}/{name}")
    again = fit_trees(LEVELS, rows, "k", "y", "w", "f", 3, RunStore(spark, "trees", "t", other), block=2)
    assert node_set(again) == node_set(model)


def test_runs_are_found_by_data_and_settings(spark, table):
    first = training.open_run(table, "k", "y", "f", 3)
    assert training.open_run(table.repartition(7), "k", "y", "f", 3).folder == first.folder
    assert training.open_run(table.where("k < 699"), "k", "y", "f", 3).folder != first.folder
    assert training.open_run(table.withColumn("y", F.when(F.col("k") == 5, 1 - F.col("y")).otherwise(F.col("y"))), "k", "y", "f", 3).folder != first.folder
    assert table_digest(table, ["k", "y"]) != table_digest(table, ["y", "k"])


def test_sums_of_siblings_and_sorted_rows_agree_with_histograms():
    rng = np.random.default_rng(2)
    bins = rng.integers(0, 40, (200, 6)).astype(np.uint8)
    for spec, measures in (
        (LEVELS, np.column_stack([rng.integers(-(2**24), 2**24, 200), rng.integers(1, 2**24, 200), np.ones(200, int)])),
        (TREES, np.column_stack([*(rng.integers(0, 3, (2, 200)) * 2**24 + 1), np.ones(200, int)])),
    ):
        order = np.argsort(bins.T, axis=1, kind="stable")
        one = T.best_split(spec, T.histogram(bins, measures), np.arange(6))
        two = T.sorted_split(spec, bins.T[np.arange(6)[:, None], order], measures[:, :-1].T.astype(float)[:, order], measures.sum(axis=0), np.arange(6))
        assert one == two


def test_degenerate_tables(spark):
    """One class, one row or constant features give models without cuts; missing values go to the first cell."""
    one = spark.createDataFrame([(i, [1.0, float("nan")], 0, 1.0) for i in range(30)] + [(99, [1.0, None], 0, 1.0)], "k long, f array<double>, y int, w double")
    for spec in (LEVELS, LEAVES, TREES):
        model = fitted(spark, one, spec)
        assert model.nodes.where("feature is not null").count() == 0
        scores = [r.scores for r in model.predict(one, "f", ["k"]).collect()]
        assert len(scores) == 31 and all(s[0] == max(s) for s in scores)
    assert load_model(spark, scratch_path(spark, "none")) is None
    assert Forest.from_rows([]).margins(np.zeros((2, 3), int), 3).tolist() == [[0.0] * 3] * 2


def test_sparse_vectors_train_and_score_like_dense_ones(spark, table):
    sparse = table.withColumn("i", F.expr("filter(sequence(0, 11), j -> f[j] <> 0)"))
    sparse = sparse.select("k", "y", "w", F.struct(F.lit(12).alias("size"), F.col("i").alias("indices"), F.expr("transform(i, j -> f[j])").alias("values")).alias("f"))
    for spec in (LEVELS, TREES):
        one, two = fitted(spark, table, spec), fitted(spark, sparse, spec)
        assert node_set(one) == node_set(two)
        assert sorted(one.predict(table, "f", ["k"]).collect()) == sorted(two.predict(sparse, "f", ["k"]).collect())


def test_every_stored_model_is_evaluated_from_its_files(spark, table):
    """Models loaded by name predict the stored hold-out as when they were fitted; a cut one as its first round did."""
    folder, specs = scratch_path(spark, "stored"), {"Levels": LEVELS, "Leaves": LEAVES, "Forest": TREES}
    run = training.train_and_evaluate(table, "k", "y", "f", specs, 3, folder, root=scratch_path(spark, "runs"))
    assert set(training.load_models(spark, folder)) == set(specs)
    fields = ["model", "y", "yhat", "scores"]
    again = training.predict_stored(spark, folder)
    assert sorted(again.select(fields).collect()) == sorted(run.predictions.select(fields).collect())
    first = training.predict_stored(spark, folder, 1).select(fields).collect()
    holdout = spark.read.parquet(f"{folder}/holdout")
    for name, model in run.models.items():
        expected = model.predict(holdout, "scaled", ["label"], 1).collect()
        assert sorted(r.scores for r in first if r.model == name) == sorted(r.scores for r in expected)
    assert training.load_run(spark, scratch_path(spark, "none")) is None
    assert training.load_models(spark, scratch_path(spark, "none")) == {}
    with pytest.raises(ValueError):
        training.predict_stored(spark, scratch_path(spark, "none"))


@SPECS
def test_a_large_model_is_applied_block_by_block(spark, table, spec, monkeypatch):
    from hazardloom.plans import boosting

    model = fitted(spark, table, spec)
    wanted = ["k", "yhat", "scores"]
    whole = sorted(map(str, model.predict(table, "f", ["k"]).select(wanted).collect()))
    assert len(model.blocks()) == 1
    seen = []
    arrays = boosting.TreeModel.arrays

    def watched(self):
        found = arrays(self)
        seen.append((len(found[0].feature), self.nodes.select("round").distinct().count()))
        return found

    monkeypatch.setattr(boosting, "NODE_BLOCK", 60)
    monkeypatch.setattr(boosting.TreeModel, "arrays", watched)
    parts = sorted(map(str, model.predict(table, "f", ["k"]).select(wanted).collect()))
    assert parts == whole
    assert len(seen) > 1 and all(n <= 60 or rounds == 1 for n, rounds in seen)


@SPECS
def test_columns_give_the_forest_of_rows(spark, table, spec):
    model = fitted(spark, table, spec)
    found, _, _ = model.arrays()
    plain = Forest.from_rows([r.asDict() for r in model.nodes.collect()])
    for name in ("roots", "of", "feature", "cell", "left", "right", "value", "n"):
        assert np.array_equal(getattr(found, name), getattr(plain, name)), name


def test_a_histogram_holds_a_slice_of_the_rows(monkeypatch):
    import tracemalloc

    rng = np.random.default_rng(3)
    bins = rng.integers(0, 256, (100_000, 64)).astype(np.uint8)
    measures = rng.integers(-(2**20), 2**20, (100_000, 3))
    tracemalloc.start()
    found = T.histogram(bins, measures)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60 << 20
    plain = np.zeros((3, 256), np.int64)
    for m in range(3):
        np.add.at(plain[m], bins[:, 5], measures[:, m])
    assert np.array_equal(found[:, 5], plain)


@pytest.mark.parametrize("rows", [120, 900])
def test_a_forests_nodes_are_split_together_as_each_alone(rows):
    """Two-valued and other features, nodes with more and with fewer rows than bins."""
    rng = np.random.default_rng(rows)
    bins = rng.integers(0, 2, (rows, 30)).astype(np.uint8) * 9
    bins[:, ::3], bins[:, 4] = rng.integers(0, 60, (rows, 10)), 7
    measures = np.column_stack([*(rng.integers(0, 3, (3, rows)) * 2**24 + 1), np.ones(rows, int)])
    grown = T.LocalTree(TREES, np.ascontiguousarray(bins.T), measures, 3)
    nodes = sorted(grown.tree.known)
    found = grown._forest_splits(nodes)
    assert len(nodes) > 3 and any(s.gain > 0 for s in found.values())
    for node in nodes:
        at, chosen = grown.rows(node), T.node_features(TREES.seed, 3, node, 30)
        alone = T.best_split(TREES, T.histogram(bins[at[:, None], chosen], measures[at]), chosen)
        assert (found[node].gain, found[node].total) == (alone.gain, alone.total)
        if alone.gain:
            assert found[node] == alone
    assert T.LocalTree(TREES, bins[:0].T, measures[:0]).tree.leaves == {1}


def test_earlier_rounds_are_walked_by_slices_of_rows(monkeypatch):
    """A block of rounds holds the places of a slice of the rows in the earlier trees, not of all rows."""
    import hazardloom.plans.boosting as boosting

    rng = np.random.default_rng(5)
    n = 3000
    block = boosting.Block(rng.integers(0, 3, n).astype(float), np.ones(n), np.arange(n), rng.integers(0, 256, (n, 4)).astype(np.uint8))
    cells = np.repeat(np.arange(256), 16)[None].repeat(4, 0).astype(np.uint8)
    first = boosting.boosted_rounds(LEVELS, block, 3, cells, [], 0, 2)
    seen, real = [], Forest.leaves
    monkeypatch.setattr(Forest, "leaves", lambda self, x: seen.append(len(x)) or real(self, x))
    later = boosting.boosted_rounds(LEVELS, block, 3, cells, first, 2, 1)
    assert sum(seen) == n and max(seen) <= T.WALK_ROWS < n
    assert first + later == boosting.boosted_rounds(LEVELS, block, 3, cells, [], 0, 3)


def test_binned_rows_are_read_without_a_copy():
    import hazardloom.plans.boosting as boosting
    import pyarrow as pa

    for kind in (pa.binary(), pa.large_binary()):
        column = pa.array([bytes([i, i + 1, 7]) for i in range(9)], kind)
        assert boosting._bytes_matrix(column.slice(2, 3)).tolist() == [[2, 3, 7], [3, 4, 7], [4, 5, 7]]
        assert boosting._bytes_matrix(column.slice(2, 0)).shape[0] == 0
        matrix = boosting._bytes_matrix(column)
        assert matrix.__array_interface__["data"][0] == column.buffers()[2].address


@pytest.fixture(scope="module")
def flags(spark):
    """Mostly two-valued features, one of them constant, and repeated rows."""
    rng = np.random.default_rng(11)
    x = (rng.random((203, 40)) < rng.random(40)).astype(float)
    x[:, 0], x[:, 1], x[:, 2] = rng.integers(0, 30, 203), rng.random(203), 4.0
    x[150:] = x[:53]
    y = (x[:, 3] + x[:, 4] > x[:, 5]).astype(int) + (x[:, 0] > 20)
    return spark.createDataFrame([(int(i), x[i].tolist(), int(y[i]), 1.0 + int(y[i]) / 7) for i in range(203)], "k long, f array<double>, y int, w double")


def test_a_forests_table_travels_packed(spark, flags, monkeypatch):
    """Features with two bins take a bit a row, so a table beyond the limit at a byte a cell still grows in tasks, to the same trees."""
    import hazardloom.plans.boosting as boosting

    spec = dataclasses.replace(TREES, rounds=3, max_depth=4)
    monkeypatch.setattr(boosting, "PACKED_ROWS", 13)
    far = fitted(spark, flags, spec, local_bytes=0, block=3)

    def never(self, first, count):
        raise AssertionError("histograms were summed where the rows are")

    monkeypatch.setattr(boosting.FarRows, "block", never)
    near = fitted(spark, flags.repartition(3), spec, local_bytes=203 * 40 - 1)
    assert node_set(near) == node_set(far)
    assert near.nodes.where("feature is not null").count() > 5
    with pytest.raises(AssertionError):
        fitted(spark, flags, spec, local_bytes=203 * 22)


def test_packed_columns_hold_the_bins():
    rng = np.random.default_rng(4)
    bins = rng.integers(0, 2, (6, 21)).astype(np.uint8) * 7 + 3
    bins[1], bins[4] = rng.integers(0, 200, 21), 9
    columns = T.Columns.pack(bins)
    assert columns.two.tolist() == [True, False, True, True, True, True]
    lower = np.unpackbits(columns.bits, axis=1, count=21, bitorder="little")
    for f in range(6):
        held = columns.rest[columns.place[f]] if f == 1 else np.where(lower[columns.place[f]], bins[f].min(), bins[f].max())
        assert np.array_equal(held, bins[f])


def test_large_nodes_are_split_in_groups_of_rows(monkeypatch):
    rng = np.random.default_rng(6)
    bins, spec = rng.integers(0, 2, (25, 900)).astype(np.uint8), dataclasses.replace(TREES, rounds=1)
    measures = np.column_stack([*(np.eye(3, dtype=int)[rng.integers(0, 3, 900)] * 2**24).T, np.ones(900, int)])
    whole, seen = T.LocalTree(spec, bins, measures), []
    real = T.LocalTree._splits_of
    monkeypatch.setattr(T, "ROWS_AT_ONCE", 100)
    monkeypatch.setattr(T.LocalTree, "_splits_of", lambda self, nodes: seen.append(sum(len(self.rows(n)) for n in nodes[:-1])) or real(self, nodes))
    assert T.LocalTree(spec, bins, measures).tree.known == whole.tree.known
    assert len(seen) > 5 and max(seen) <= 100


@pytest.mark.parametrize("spec", [LEVELS, TREES], ids=["levels", "forest"])
def test_far_histograms_are_sent_on_before_they_fill_the_memory(spark, flags, spec, monkeypatch):
    """A task holds ``SUMS_BYTES`` of histograms and sends the cells that have rows; the trees stay the same."""
    import hazardloom.plans.boosting as boosting

    spec = dataclasses.replace(spec, rounds=2, max_depth=3)
    near = fitted(spark, flags, spec)
    monkeypatch.setattr(boosting, "SUMS_BYTES", 0)
    far = fitted(spark, flags.repartition(3), spec, local_bytes=0, block=2)
    assert node_set(near) == node_set(far)


def test_rows_move_through_all_opened_nodes():
    rng = np.random.default_rng(9)
    bins = rng.integers(0, 9, (400, 5)).astype(np.uint8)
    measures = np.column_stack([*(np.eye(3, dtype=int)[rng.integers(0, 3, 400)] * 2**24).T, np.ones(400, int)])
    tree = T.LocalTree(dataclasses.replace(TREES, rounds=1), np.ascontiguousarray(bins.T), measures).tree
    at = T.moved(np.ones(400, np.int64), bins, tree)
    for row, node in enumerate(at.tolist()):
        n = 1
        while n in tree.opened:
            n = 2 * n + int(bins[row, tree.known[n].feature] > tree.known[n].bin)
        assert n == node
    assert len(set(at.tolist())) > 8
