"""Rules looked up by required factors against trying every rule on every text."""

import random
import re

import pytest
from pyspark.sql import functions as F

from hazardloom.operators import match

KIND = "ord int, alert string, pattern string, severity int, boost double"


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize(
    ("pattern", "factor"),
    [
        (r"\bwidget\b", "widget"), ("abc", "abc"), ("ab", None), ("abcd?ef", "abc"), ("abcd*", "abc"), ("xabc+de", "xabc"),
        ("abc|def", None), ("(abc)", None), ("[abc]def", None), ("abc{0}", None), (r"a\.bcd", "bcd"), (r"\x41bcd", None),
        ("^start of$", "start of"), ("a.bcde.f", "bcde"), (r"\d+kilo", "kilo"), ("abcd+?e", "abcd"), ("abcd??e", "abc"), (r"\1abc", None),
        ("(?i)abc", None), (r"\Qa.b\E", None), ("", None), (r"nul\\abcd", "abcd"),
    ],
)
def test_required_factor(spark, pattern, factor):
    row = spark.createDataFrame([(pattern,)], "p string").select(match.required_factor(F.col("p")).alias("f")).first()
    assert row["f"] == factor


def test_index_equals_scan(spark):
    rng = random.Random(12)
    words = ["".join(rng.choice("abc ") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    forms = ["{}", r"\b{}\b", "{}?", "{}*b", "{}+", "^{}", "{}.{}", "{}|{}", "({})+", "[{}]", "a?{}c?", r"{}\s{}"]
    rules = []
    for i in range(600):
        pattern = rng.choice(forms).format(*rng.choices(words, k=2))
        try:
            re.compile(pattern)
        except re.error:
            continue
        if pattern and not re.search(r"[?*+]{2}|^[?*+]|\[\]", pattern):
            rules.append((i, f"rule {i}", pattern, i % 5 + 1, 0.1))
    texts = [(k, "".join(rng.choice("abc ") for _ in range(rng.randint(0, 25)))) for k in range(250)] + [(900, None), (901, ""), (3, "abc abc abc")]
    df = spark.createDataFrame(texts, "k int, t string").repartition(4)
    table = spark.createDataFrame(rules, KIND)
    found = rows_of(match.match_rule_table(df, ["k"], "t", table))
    assert found == rows_of(match.scan_rule_table(df, ["k"], "t", table))
    factored = table.where(match.required_factor(F.col("pattern")).isNotNull()).count()
    assert 50 < factored < len(rules) and len(found) > 1000


def test_many_rules_stay_out_of_the_plan(spark):
    """A hundred thousand rules are a side of a join; texts meet the few that share a piece with them."""
    table = spark.range(100_000).selectExpr("int(id) ord", "concat('r', id) alert", "concat('\\\\bkey', id, 'x\\\\b') pattern", "1 severity", "0.5D boost")
    df = spark.createDataFrame([(1, "key77x and key99999x, key77x"), (2, "nothing here"), (3, "akey5x key5x")], "k int, t string")
    found = match.match_rule_table(df, ["k"], "t", table)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 30_000 and "key99999x" not in plan
    assert sorted((r["k"], r["ord"], r["n"]) for r in found.collect()) == [(1, 77, 2), (1, 99_999, 1), (3, 5, 1)]


def test_empty_sides(spark):
    texts = spark.createDataFrame([(1, "abc")], "k int, t string")
    none = spark.createDataFrame([], KIND)
    assert match.match_rule_table(texts, ["k"], "t", none).collect() == []
    assert match.match_rule_table(texts.limit(0), ["k"], "t", spark.createDataFrame([(1, "r", "abc", 1, 0.1)], KIND)).collect() == []


@pytest.mark.parametrize("few", [0, 100])
def test_texts_are_never_broadcast(spark, tmp_path, monkeypatch, few):
    """A compressed table looks small to Spark before its texts are cut to pieces."""
    monkeypatch.setattr(match, "FEW_RULES", few, raising=False)
    spark.range(4000).selectExpr("id", "concat('text with widget and gizmo ', id % 7) as text").coalesce(1).write.parquet(f"{tmp_path}/texts")
    rules = spark.createDataFrame([(1, "a", "widget", 1, 0.1), (2, "b", "gizmo [3-5]", 2, 0.2)], KIND)
    found = match.match_rule_table(spark.read.parquet(f"{tmp_path}/texts"), ["id"], "text", rules)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan
    assert ("BuildRight" in plan.split("rule-pieces")[0]) == (few > 0)
    assert rows_of(found.groupBy("ord").agg(F.count("*"), F.sum("n"))) == [(1, 4000, 4000), (2, 1713, 1713)]
