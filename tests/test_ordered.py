"""Order statistics, running totals, sampling and splitting, with hot groups and ties."""

import hashlib
import random
import statistics
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from hazardloom.operators import clean, ordered


def hot_rows(seed=1, n=6000):
    """A third of the rows share one key; values repeat, change sign and spread widely."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else f"k{rng.randint(0, 400)}"
        value = rng.choice([rng.uniform(-5, 5), float(rng.randint(-3, 3)), rng.uniform(0, 1e6), 0.0])
        rows.append((key, value, float(i % 7)))
    rows += [("nulls", None, 1.0), ("nan", float("nan"), 1.0), ("one", 4.0, 2.0), ("two", 1.0, None), ("two", 2.0, 3.0)]
    return rows


def test_grouped_median_mean_and_count(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "k string, v double, w double").repartition(7)
    got = {
        r["k"]: r for r in ordered.grouped_median(df, ["k"], "v", "m", mean_of="w", count_into="c").collect()
    }
    groups = defaultdict(list)
    for k, v, w in rows:
        if v is not None and v == v:
            groups[k].append((v, w))
    assert set(got) == set(groups)
    for k, pairs in groups.items():
        assert got[k]["m"] == statistics.median(v for v, _ in pairs)
        present = [w for _, w in pairs if w is not None]
        assert got[k]["c"] == len(present)
        assert got[k]["w"] == pytest.approx(sum(present) / len(present))


def test_column_medians_skip_missing_and_empty_columns(spark):
    rng = random.Random(2)
    rows = [(rng.gauss(0, 100), None if i % 4 else float(i), None) for i in range(999)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = {r["column"]: r["median"] for r in ordered.column_medians(df, ["a", "b", "c"]).collect()}
    assert got == {"a": statistics.median(r[0] for r in rows), "b": statistics.median(r[1] for r in rows if r[1] is not None)}


def test_running_totals(spark):
    rng = random.Random(3)
    rows = [("x" if i % 3 else "y", rng.choice([0.0, -1.0, rng.random(), rng.uniform(-9, 9)]), rng.randint(0, 5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, s double, m int").repartition(5)
    for descending in (True, False):
        got = sorted(map(tuple, ordered.running_totals(df, ["g"], "s", ["m"], descending).collect()))
        expected = []
        for g in ("x", "y"):
            sums = Counter()
            for a, s, m in rows:
                if a == g:
                    sums[s + 0.0] += m
            running, total = 0, sum(sums.values())
            for s in sorted(sums, reverse=descending):
                running += sums[s]
                expected.append((g, s, sums[s], running, total))
        assert got == sorted(expected)


def test_narrow_ranges_are_spread_over_slices(spark):
    """A million scores just below one: no slice, so no task, holds more than a small share."""
    from hazardloom.functions.numbers import order_buckets

    scores = spark.range(1_000_000).select((F.lit(0.9994) + F.col("id") * 5e-10).alias("s"))
    bucket, inside = order_buckets(F.col("s"))
    sizes = scores.groupBy(bucket, inside).count()
    assert sizes.agg(F.max("count")).first()[0] <= 10_000
    totals = ordered.running_totals(scores.withColumn("m", F.lit(1)), [], "s", ["m"], descending=False)
    assert totals.agg(F.max("cum_m"), F.count("*")).first()[:] == (1_000_000, 1_000_000)
    assert ordered.grouped_median(scores.withColumn("g", F.lit(1)), ["g"], "s").first()["median"] == pytest.approx(0.99965, abs=1e-9)


def test_repeated_keys_that_should_be_unique_raise(spark):
    df = spark.createDataFrame([(1,)] * 50, "k int")
    with pytest.raises(Exception, match="keys repeat"):
        ordered.sample_exact(df, "k", 20, unique=True).collect()


@pytest.mark.parametrize("n", [0, 1, 20, 49, 50, 70])
def test_equal_rows_are_drawn_in_part(spark, n):
    df = spark.createDataFrame([(1, None)] * 50, "k int, x string").repartition(7)
    assert ordered.sample_exact(df, "k", n).count() == min(n, 50)


def test_repeated_keys_give_exact_samples(spark):
    """A key holds half the rows, some of them wholly equal; sizes are exact and choices don't depend on partitions."""
    rows = [(7, i % 40 if i % 2 else 0, "a") for i in range(1000)] + [(k, 0, "a" if k % 3 else "b") for k in range(100, 1100)]
    rows += [(None, 1, "b"), (None, 1, "b"), (5, 2, None)]
    df = spark.createDataFrame(rows, "k int, x int, c string").repartition(5)
    for n in (1, 100, 900, 1500, 2003):
        one = Counter(map(tuple, ordered.sample_exact(df, "k", n).collect()))
        assert sum(one.values()) == n and not one - Counter(rows)
        assert one == Counter(map(tuple, ordered.sample_exact(df.repartition(3, "x"), "k", n).collect()))
    for share in (0.2, 0.37, 0.5, 0.8):
        out = Counter(map(tuple, ordered.stratified_split(df, "k", "c", share).collect()))
        assert Counter({r: sum(n for o, n in out.items() if o[:3] == r) for r in set(rows)}) == Counter(rows)
        for c, size in Counter(r[2] for r in rows).items():
            tests = sum(n for o, n in out.items() if o[2] == c and o[3])
            assert tests == (int(size * share + 0.5) if c else 0)


def test_many_equal_rows_are_made_in_parts(spark, monkeypatch):
    monkeypatch.setattr(ordered, "COPIES", 64)
    df = spark.range(0, 1000, 1, 4).select(F.lit(3).alias("k"), F.lit("x").alias("c"))
    split = ordered.stratified_split(df, "k", "c", 0.35)
    assert {(r["is_test"], r["count"]) for r in split.groupBy("is_test").count().collect()} == {(True, 350), (False, 650)}


def test_no_job_before_an_action(spark):
    """Splits, weights and the master table are lazy plans."""
    df = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 3).alias("c"))
    spark.sparkContext.setJobGroup("lazy", "planning")
    ordered.stratified_split(df, "k", "c")
    clean.balanced_class_weights(df, "c")
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("lazy")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not list(jobs)


def order_of(keys, seed=42):
    return sorted(keys, key=lambda k: hashlib.md5(f"{seed}:{k}".encode()).hexdigest())


@pytest.mark.parametrize("n", [0, 1, 57, 1000, 5000])
def test_sample_exact(spark, n):
    df = spark.range(1000).withColumnRenamed("id", "k")
    got = {r["k"] for r in ordered.sample_exact(df, "k", n).collect()}
    assert got == set(order_of(range(1000))[:n])


def test_stratified_split_shares(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"c{i % 4}" if i % 100 else "rare") for i in range(2000)]
    rows.append((5000, "single"))
    df = spark.createDataFrame(rows, "k int, c string")
    out = ordered.stratified_split(df, "k", "c").collect()
    assert len(out) == len(rows)
    sizes, tests = Counter(r["c"] for r in out), Counter(r["c"] for r in out if r["is_test"])
    for c, n in sizes.items():
        assert tests[c] == int(n * 0.2 + 0.5)
    hot = [k for k, c in rows if c == "hot"]
    assert {r["k"] for r in out if r["is_test"] and r["c"] == "hot"} == set(order_of(hot)[: tests["hot"]])
    again = {r["k"] for r in ordered.stratified_split(df.repartition(3), "k", "c").collect() if r["is_test"]}
    assert again == {r["k"] for r in out if r["is_test"]}


def test_keep_first_on_a_hot_key(spark):
    rows = [("hot", i) for i in range(2000, 0, -1)] + [("a", 5), ("b", 9), ("b", 7)]
    df = spark.createDataFrame(rows, "k string, ord int").repartition(6)
    assert sorted(map(tuple, clean.keep_first(df, "k", [F.col("ord")]).collect())) == [("a", 5), ("b", 7), ("hot", 1)]


def test_balanced_class_weights(spark):
    df = spark.createDataFrame([(i, 0 if i < 6 else 1) for i in range(8)], "k int, c int")
    got = {r["c"]: r["weight"] for r in clean.balanced_class_weights(df, "c").collect()}
    assert got == {0: 8 / (2 * 6), 1: 8 / (2 * 2)}


def test_column_medians_of_any_shape(spark):
    """Ties, narrow and wide ranges, infinities, missing values and one-value columns, against the standard library."""
    rng = random.Random(17)
    rows = [
        (
            rng.gauss(0, 1),
            0.9994 + rng.random() * 1e-12,  # many values in one equal-ratio bin
            rng.choice([1e-300, -1e300, 0.0, -0.0, 5e-324, 3.5]),
            7.25 if rng.random() < 0.7 else None,
            float(rng.randint(0, 3)) if rng.random() < 0.5 else float("nan"),
            rng.choice([float("inf"), -float("inf"), 1.0]),
            None,
        )
        for _ in range(1001)
    ]
    names = list("abcdefg")
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names))
    for table, size in ((df, 1001), (df.limit(500), 500), (df.limit(1), 1)):
        data = table.collect()
        expected = {}
        for c in names:
            present = sorted(r[c] for r in data if r[c] is not None and r[c] == r[c])
            if present:
                expected[c] = (present[(len(present) - 1) // 2] + present[len(present) // 2]) / 2
        kept = spark.createDataFrame(data, df.schema).repartition(4)
        found = {r["column"]: r["median"] for r in ordered.column_medians(kept, names).collect()}
        assert len(data) == size and {k: str(v) for k, v in found.items()} == {k: str(v + 0.0) for k, v in expected.items()}
    assert ordered.column_medians(df.limit(0), names).collect() == []


def test_column_medians_shuffle_bins_not_rows(spark):
    """The rows that go through the shuffles don't grow with the table."""
    sizes = []
    for n in (20_000, 200_000):
        df = spark.range(0, n, 1, 4).select((F.pmod(F.col("id") * 7919, F.lit(10_007)) / 10_007.0).alias("x"))
        bins = df.groupBy(ordered.order_buckets(F.col("x"))[0]).count().count()
        sizes.append(bins)
        assert ordered.column_medians(df, ["x"]).first()["median"] == pytest.approx(0.5, abs=1e-3)
    assert sizes[0] == sizes[1]
