"""Rule matching and everything that follows from the matches of one entity.

The matches of an entity sit in one array column next to it, in rule order, and are
bounded by the number of rules.  All further results are expressions over that array,
so matching and reporting are a single map stage: no join and no shuffle at any size.
``matches_long`` turns the array into rows where a row form is wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardloom.functions.numbers import round_exact_once
from hazardloom.rules import MAX_RULES, RuleBook
from hazardloom.session import write_and_read

# --- fixed values: probability floors, boost limits ---------------------------------
CRITICAL_SEVERITY = 5
HIGH_SEVERITY = 4
HIGHEST_PROBABILITY = 0.999


def match_rules(text: Column, rules: RuleBook) -> Column:
    """Array of (ord, alert, severity, boost, n) for the rules found in a text."""
    candidates = F.array(
        *[
            F.struct(
                F.lit(ord_).alias("ord"),
                F.lit(alert).alias("alert"),
                F.lit(severity).alias("severity"),
                F.lit(boost).alias("boost"),
                F.coalesce(F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), F.lit(0)).alias("n"),
            )
            for ord_, alert, pattern, severity, _, boost, _, _ in rules.alerts
        ]
    )
    return F.filter(candidates, lambda m: m["n"] > 0)


def compact(matches: Column) -> Column:
    """Rule numbers and counts only: what a mixture needs of its components' matches."""
    return F.transform(matches, lambda m: F.struct(m["ord"].alias("ord"), m["n"].alias("n")))


def matches_long(df: DataFrame, keys: list[str], matches: str = "matches") -> DataFrame:
    """One row per entity and matched rule."""
    # The filter keeps Spark from adding a size test on the column, which it would move
    # below the matching and so match every text twice.
    return df.select(*keys, F.inline(F.filter(matches, lambda m: m["n"] > 0)))


# Length of the text pieces that rules are looked up by.
GRAM = 3
# Up to this many rules of a table are sent to every task.
FEW_RULES = 10_000


def grams(text: Column) -> Column:
    """Distinct pieces of ``GRAM`` characters."""
    starts = F.when(F.length(text) >= GRAM, F.sequence(F.lit(1), F.length(text) - (GRAM - 1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, F.lit(GRAM))))


def required_factor(pattern: Column) -> Column:
    """The longest run of letters, digits and spaces that every match of a pattern contains; NULL where none is sure.

    Only plain sequences are read: a pattern with alternatives, groups, classes, counts or unusual
    escapes has no sure factor.  A character that may be missing ends a run.
    """
    known = F.regexp_replace(pattern, r"\\[bBdDwWsS]|\\[^A-Za-z0-9]", "\n")
    sure = ~known.rlike(r"[|(\[{\\]")
    runs = F.split(F.regexp_replace(known, r".[?*]", "\n"), "[^A-Za-z0-9 ]+")
    longest = F.array_max(F.transform(runs, lambda r: F.struct(F.length(r).alias("n"), r.alias("run"))))
    return F.when(sure & (longest["n"] >= GRAM), longest["run"])


def match_rule_table(df: DataFrame, keys: list[str], text: str, rules: DataFrame) -> DataFrame:
    """Match against a rule table kept in Spark: one row per entity and matched rule.

    Rules are looked up by a piece of their required factor, of its pieces the one that is rarest in the
    texts: a text meets a rule where it has that piece, and only then the expression runs.
    The chosen pieces are written once, so that their number is known: up to ``FEW_RULES`` rules are broadcast, more
    are joined by a shuffle.  The texts' pieces are never the broadcast side, though Spark may take them for
    small, since it doesn't count what exploding adds.  Rules without a
    sure factor are tried on every text (:func:`scan_rule_table`).  Equal to trying all.
    """
    columns = ["ord", "alert", "pattern", "severity", "boost"]
    factored = rules.select(*columns, required_factor(F.col("pattern")).alias("_factor"))
    scanned = scan_rule_table(df, keys, text, factored.where("_factor is null").select(*columns))
    pieces = df.select(*keys, F.col(text).alias("_text"), F.explode(grams(F.col(text))).alias("_gram"))
    offered = factored.where("_factor is not null").select("*", F.explode(grams(F.col("_factor"))).alias("_gram"))
    frequency = pieces.join(offered.select("_gram").distinct(), "_gram", "left_semi").groupBy("_gram").agg(F.count(F.lit(1)).alias("_times"))
    # A rule with a piece that no text has loses it here; the others it has decide nothing, so it goes.
    rule = [F.col(c) for c in [*columns, "_factor"]]
    seen = offered.join(frequency, "_gram", "left").groupBy(*rule).agg(
        F.min_by("_gram", F.struct(F.coalesce("_times", F.lit(0)), F.col("_gram"))).alias("_gram"), F.min(F.coalesce("_times", F.lit(0))).alias("_times")
    )
    chosen = write_and_read(seen.where("_times > 0"), "rule-pieces")
    chosen = F.broadcast(chosen) if chosen.count() <= FEW_RULES else chosen.hint("merge")
    near = pieces.join(chosen, "_gram").where(F.col("_text").contains(F.col("_factor")))
    count = F.coalesce(F.size(F.regexp_extract_all(F.col("_text"), F.col("pattern"), F.lit(0))), F.lit(0))
    found = near.select(*keys, "ord", "alert", "severity", "boost", count.alias("n")).where("n > 0")
    return scanned.unionByName(found)


def scan_rule_table(df: DataFrame, keys: list[str], text: str, rules: DataFrame) -> DataFrame:
    """Every text against every rule of a table: one row per entity and matched rule.

    The table becomes arrays of about ``MAX_RULES`` rules, as values of the plan, which every
    task goes through per text: the texts are read once however many rules there are, and
    nothing is shuffled.  For few rules.
    """
    columns = ["ord", "alert", "pattern", "severity", "boost"]
    rules = rules.select(*columns)
    batches = max(1, -(-rules.count() // MAX_RULES))
    number = F.pmod(F.xxhash64("ord", "alert"), F.lit(batches))

    def found(batch: str) -> Column:
        return F.filter(
            F.transform(
                F.col(batch),
                lambda r: F.struct(
                    r["ord"].alias("ord"),
                    r["alert"].alias("alert"),
                    r["severity"].alias("severity"),
                    r["boost"].alias("boost"),
                    F.coalesce(F.size(F.regexp_extract_all(F.col(text), r["pattern"], F.lit(0))), F.lit(0)).alias("n"),
                ),
            ),
            lambda m: m["n"] > 0,
        )

    def packed(i: int) -> Column:
        part = rules.where(number == i) if batches > 1 else rules
        return part.agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("rules")).scalar()

    names = [f"_rules_{i}" for i in range(batches)]
    attached = df.select(*keys, text, *[packed(i).alias(n) for i, n in enumerate(names)])
    return attached.select(*keys, F.inline(F.concat(*[found(n) for n in names])))


# --- aggregates over the matches of one entity ---------------------------------------
def n_alerts(matches: Column) -> Column:
    return F.size(matches)


def total_severity(matches: Column) -> Column:
    return F.aggregate(matches, F.lit(0).cast("long"), lambda a, m: a + m["severity"] * m["n"])


def has_critical(matches: Column) -> Column:
    return F.exists(matches, lambda m: m["severity"] >= HIGH_SEVERITY)


def max_severity(matches: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(matches, lambda m: m["severity"])), F.lit(0))


def override_floor(matches: Column) -> Column:
    """Probability floor set by severe matches; NULL when no condition holds."""
    critical = F.size(F.filter(matches, lambda m: m["severity"] >= CRITICAL_SEVERITY))
    high = F.size(F.filter(matches, lambda m: m["severity"] >= HIGH_SEVERITY))
    # --- fixed values: the floors ---
    return (
        F.when(critical >= 2, 0.95)
        .when(critical >= 1, 0.80)
        .when(high >= 3, 0.85)
        .when(high >= 2, 0.70)
        .when(total_severity(matches) >= 12, 0.65)
    )


def discounted_boost(matches: Column) -> Column:
    """Boosts from the largest down, the i-th (from 0) divided by 1 + i/2, summed.

    NULL without matches.
    """
    ranked = F.sort_array(F.transform(matches, lambda m: F.struct((-m["boost"]).alias("b"), m["ord"].alias("o"))))
    start = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("i"))

    def add(acc: Column, m: Column) -> Column:
        step = -m["b"] * (F.lit(1.0) / (F.lit(1.0) + acc["i"] * 0.5))
        return F.struct((acc["total"] + step).alias("total"), (acc["i"] + 1.0).alias("i"))

    return F.when(F.size(matches) > 0, F.aggregate(ranked, start, add, lambda acc: acc["total"]))


def boosted_probability(base: Column, boost: Column, override: Column) -> Column:
    """Base probability raised by the floor if there is one, else by the discounted boosts.

    ``boost`` is :func:`discounted_boost` and ``override`` :func:`override_floor` of the
    matches; both depend on the text only, so a dimension computes them once per text.
    A text without matches (NULL boost) keeps its base unrounded.
    """
    raised = F.least(round_exact_once(base + boost * (F.lit(1.0) - base), 4), F.lit(HIGHEST_PROBABILITY))
    return F.when(override.isNotNull(), F.greatest(base, override)).when(boost.isNull(), base).otherwise(raised)


def alert_explanation(matches: Column, rules: RuleBook) -> Column:
    """Sentence naming up to five alerts by severity and the mechanisms of the top two."""
    ranked = F.transform(
        F.array_sort(
            F.transform(
                matches,
                lambda m: F.struct((-m["severity"]).alias("s"), m["ord"].alias("ord"), m["alert"].alias("alert")),
            )
        ),
        lambda m: F.struct((-m["s"]).alias("severity"), m["ord"].alias("ord"), m["alert"].alias("alert")),
    )
    return _explanation_text(F.slice(ranked, 1, 5), rules)


def _explanation_text(top: Column, rules: RuleBook) -> Column:
    # --- fixed values: the sentence parts ---
    marked = F.transform(top, lambda m: F.concat(F.lit("**"), m["alert"], F.lit("**")))
    size = F.size(top)
    names = (
        F.when(size <= 2, F.array_join(marked, " and "))
        .otherwise(
            F.concat(
                F.array_join(F.slice(marked, F.lit(1), F.greatest(size - 1, F.lit(0))), ", "),
                F.lit(", and "),
                F.try_element_at(marked, F.lit(-1)),
            )
        )
    )
    degree = F.when(F.try_element_at(top, F.lit(1))["severity"] <= 3, "moderately").otherwise("highly")
    mechanisms = F.array_join(
        F.transform(F.slice(top, 1, 2), lambda m: rules.alert_attribute(m["ord"], "mechanism")), "; "
    )
    sentence = F.concat(
        F.lit("This molecule contains "),
        names,
        F.lit(", which are "),
        degree,
        F.lit(" associated with toxicity. Key mechanisms: "),
        mechanisms,
        F.lit("."),
    )
    return F.when(
        size == 0, F.lit("No known toxic structural alerts were detected in this molecule.")
    ).otherwise(sentence)


def alert_report(matches: Column, rules: RuleBook) -> Column:
    """Report of one entity as a struct; its counts and extremes are fields of it."""
    return F.struct(
        n_alerts(matches).alias("n_alerts"),
        total_severity(matches).alias("total_severity"),
        has_critical(matches).alias("has_critical"),
        max_severity(matches).alias("max_severity"),
        override_floor(matches).alias("override_probability"),
        alert_explanation(matches, rules).alias("explanation"),
    )


SEVERITY_MARK = "🔴"


def alert_summary_rows(df: DataFrame, keys: list[str], rules: RuleBook, matches: str = "matches") -> DataFrame:
    """One display row per match."""
    long = matches_long(df, keys, matches)
    severity = F.concat(
        F.repeat(F.lit(SEVERITY_MARK), F.least(F.col("severity"), F.lit(5))),
        F.format_string(" (%d/5)", "severity"),
    )
    return long.select(
        *keys,
        F.col("ord"),
        F.col("alert").alias("Alert"),
        severity.alias("Severity"),
        F.col("n").alias("Count"),
        rules.alert_attribute(F.col("ord"), "description").alias("Description"),
        F.concat(F.lit("+"), percent_text(F.col("boost"))).alias("Probability Boost"),
    )


def percent_text(p: Column) -> Column:
    """Whole percent, ties to even."""
    return F.concat(F.rint(p * 100.0).cast("int").cast("string"), F.lit("%"))
