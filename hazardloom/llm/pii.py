"""Personal data: base patterns, candidate spans, boosted trees and calibrated thresholds.

Base spans are what the fixed patterns and checks find.  High-recall generators then propose
spans beside them: addresses with at and dot spelled or bracketed in any way, any 7 to 15 digits
with common separators, cards in other groups or amid other digits, IP addresses with mixed
separators.  Gradient-boosted trees judge each from its format and context; the raw score's cutoff per kind is calibrated on
held-out rows for ``PRECISION``, and a kind without enough evidence adds nothing.

The trees learn from all of the documents' own base spans: rewritten in the
other formats they are positive, with their checks broken they are negative.  Finding and
judging are one map stage: the fitted trees become an expression over each row's candidates.
"""

from __future__ import annotations

import math
import re
from functools import partial

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardloom.llm.textcols import found_spans
from hazardloom.session import write_and_read

KINDS = ["email", "ip", "card", "phone"]
LEAST_SPANS = 20
# Distinct rows of features that one task learns from.
TASK_ROWS = 100_000
PRECISION = 0.98
CONTEXT = 24

# Fixed values of the definition: the base patterns, with possessive repeats where nothing could be given back.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A text without this can't match.
HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
# A dot or an at sign with any bracket, spelled in any case, or amid spaces.
_DOT = r"(?:\x20?[(\[{<]\x20?(?:\.|(?i:dot))\x20?[)\]}>]\x20?|\x20?\.\x20?|\x20(?i:dot)\x20)"
_AT = r"(?:\x20?[(\[{<]\x20?(?:@|(?i:at))\x20?[)\]}>]\x20?|\x20?@\x20?|\x20(?i:at)\x20)"
_HOST = rf"[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++"
LOOSE = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++{_AT}{_HOST}",
    "ip": rf"(?<![0-9])[0-9]{{1,3}}+(?:{_DOT}[0-9]{{1,3}}+){{3}}+",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20.-]?[0-9]{4}){2}[\x20.-]?[0-9]{1,4}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z.+\])}-])[+(]{0,2}[0-9](?:[\x20()./-]{0,3}[0-9]){6,14}(?![0-9])",
}
LOOSE_HINT = {
    "email": rf"{_AT}[A-Za-z0-9-]++{_DOT}[A-Za-z0-9-]",
    "ip": rf"[0-9]{_DOT}[0-9]{{1,3}}+{_DOT}[0-9]",
    "card": r"[0-9]{4}",
    "phone": r"[0-9](?:[\x20()./-]{0,3}[0-9]){6}",
}
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|address)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|from)\b",
    "card": r"(?i)\b(?:card|visa|credit|payment|account)\b",
    "phone": r"(?i)\b(?:phone|tel|call|fax|mobile|contact)\b",
}
AGAINST = r"(?i)(?:version|release|isbn|issn|order|invoice|license|no\.|\bid\b|https?:|\$)"


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a text of digits has a valid check digit."""
    value = F.reverse(digits)
    places = F.sequence(F.lit(1), F.greatest(F.char_length(value), F.lit(1)))

    def add(total: Column, at: Column) -> Column:
        d = F.coalesce(F.substring(value, at, F.lit(1)).try_cast("int"), F.lit(0))
        twice = d * 2
        return total + F.when(at % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def _octets(found: Column, gap: str) -> Column:
    return F.forall(F.split(found, gap), lambda p: p.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))


def _passes(kind: str, span: Column) -> Column:
    found = span["found"]
    n = F.char_length(_digits(found))
    if kind == "ip":
        return _octets(found, r"\.")
    if kind == "card":
        return F.when(n.between(12, 19), luhn(_digits(found))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


SPAN = "array<struct<start:int,kind:int,end:int,found:string>>"


def _of_kind(text: Column, kind: str, pattern: str, hint: str) -> Column:
    """Spans of one kind; the long way is only gone for texts that show the hint."""
    number = F.lit(KINDS.index(kind))
    spans = F.transform(
        found_spans(text, pattern),
        lambda s: F.struct(s["start"].alias("start"), number.alias("kind"), s["end"].alias("end"), s["found"].alias("found")),
    )
    return F.when(text.rlike(hint), spans).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """(start, kind, end, found) of the base matches that pass their checks, by start, then kind."""
    each = [F.filter(_of_kind(text, k, BASE[k], HINT[k]), partial(_passes, k)) for k in KINDS]
    return F.array_sort(F.concat(*each))


def candidates(text: Column) -> Column:
    """Proposed spans of all kinds; they may overlap."""
    return F.concat(*[_of_kind(text, k, LOOSE[k], LOOSE_HINT[k]) for k in KINDS])


FEATURES = ["email", "ip", "card", "phone", "digits", "length", "letters", "marks", "groups", "luhn", "octets", "name_end",
            "joined_before", "joined_after", "cue", "against", "bracketed", "spelled_dot", "prose", "zero",
            "zeros", "open", "year", "sound"]


def features(kind: Column, found: Column, before: Column, after: Column) -> Column:
    """The numbers ``FEATURES`` of a candidate from its format and its context."""

    def yes(c: Column) -> Column:
        return F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))

    digits = _digits(found)
    n = F.char_length(digits)
    cue = F.lit(False)
    for at, k in enumerate(KINDS):
        cue = cue | ((kind == at) & before.rlike(CUES[k]))
    said = found.rlike(r"(?i)\bdot\b")
    prose = found.rlike(r"\x20\.|\.\x20") | (found.rlike(r"(?i)\x20at\x20") & ~said)
    numbers = [
        *[yes(kind == at) for at in range(len(KINDS))],
        n,
        F.char_length(found),
        F.char_length(F.regexp_replace(found, "[^A-Za-z]", "")),
        F.char_length(F.regexp_replace(found, "[A-Za-z0-9]", "")),
        F.size(F.split(found, "[^0-9]+")),
        yes(n.between(12, 19) & luhn(digits)),
        yes(_octets(F.regexp_replace(found, "[^0-9]+", "."), r"\.")),
        yes(found.rlike("[A-Za-z]{2,}$")),
        yes(before.rlike(r"[0-9A-Za-z.+-]$")),
        yes(after.rlike("^[0-9A-Za-z-]")),
        yes(cue),
        yes(before.rlike(AGAINST)),
        yes(found.rlike(r"[(\[{<]\x20?(?:[.@]|(?i:at|dot))\x20?[)\]}>]")),
        yes(said),
        yes(prose),
        yes(found.rlike("^[(]?0")),
        yes(found.rlike("^00")),
        yes(found.rlike("^[(]")),
        yes(found.rlike("^(?:19|20)[0-9]{2}(?![0-9])")),
        # The check of the kind: a name at the end, parts up to 255, the check digit, a prefix.
        F.when(kind == 0, yes(found.rlike("[A-Za-z]{2,}$") & ~prose))
        .when(kind == 1, yes(_octets(F.regexp_replace(found, "[^0-9]+", "."), r"\.") & ~prose))
        .when(kind == 2, yes(n.between(12, 19) & luhn(digits)))
        .otherwise(yes(found.rlike("^[(]?0|^[(]") & n.between(7, 15))),
    ]
    return F.array(*[x.cast("double") for x in numbers])


def _judged(text: Column, span: Column) -> Column:
    start, end = span["start"], span["end"]
    left = F.greatest(start - CONTEXT, F.lit(0))
    before = F.substring(text, left + 1, start - left)
    return features(span["kind"], span["found"], before, F.substring(text, end + 1, F.lit(CONTEXT)))


def training_rows(spans: DataFrame) -> DataFrame:
    """``features, label, fold`` from (kind, found, before, after, h) of base spans."""
    found, digits, kind = F.col("found"), _digits(F.col("found")), F.col("kind")
    groups = F.concat_ws(".", *[F.substring(digits, 1 + 4 * k, 4) for k in range(3)], F.expr("substring(found_digits, 13)"))
    tail = F.regexp_replace(found, r"^\+[0-9]+[\x20.-]?", "")
    # The formats don't follow the folds, which are h % 3.
    way = F.floor(F.col("h") / 3).cast("int")

    def one_of(*ways: Column) -> Column:
        chosen = ways[-1]
        for at in range(len(ways) - 2, -1, -1):
            chosen = F.when(way % len(ways) == at, ways[at]).otherwise(chosen)
        return chosen

    name, host = F.regexp_extract(found, "^([^@]*)@(.*)$", 1), F.regexp_extract(found, "^([^@]*)@(.*)$", 2)

    def address(at: str, dot: str) -> Column:
        return F.concat(name, F.lit(at), F.regexp_replace(host, r"\.", dot))

    def dotted(of: Column, dot: str) -> Column:
        return F.regexp_replace(of, r"\.", dot)

    spelled = one_of(
        address(" (at) ", "."), address(" at ", " dot "), address("(AT)", "."), address(" [at] ", " [dot] "),
        address("{at}", "{dot}"), address(" (at) ", " (dot) "), address(" AT ", " DOT "), address("[AT]", "."),
    )
    half = F.regexp_replace(found, r"^([0-9]+)\.([0-9]+)\.", "$1[.]$2.")
    right = [
        spelled,
        one_of(dotted(found, "[.]"), dotted(found, "(.)"), half, dotted(found, " dot "), dotted(found, "[dot]")),
        F.when(F.col("h") % 2 == 0, digits).otherwise(groups),
        one_of(
            tail,
            F.regexp_replace(found, r"^\+", "00"),
            F.expr("concat('(0', substring(found_digits, 2, 2), ') ', substring(found_digits, 4))"),
            F.expr("concat('00', substring(found_digits, 1, 2), ' ', substring(found_digits, 3, 2), ' ', substring(found_digits, 5))"),
            F.expr("concat('0', substring(found_digits, 2, 2), '/', substring(found_digits, 4))"),
            F.expr("concat('0', substring(found_digits, 2, 2), ' ', substring(found_digits, 4, 3), ' ', substring(found_digits, 7))"),
        ),
    ]
    last = (F.substring(digits, -1, 1).cast("int") + 1 + F.col("h") % 8) % 10
    broken = F.concat(F.expr("substring(found_digits, 1, length(found_digits) - 1)"), last.cast("string"))
    beyond = F.concat(F.regexp_replace(found, r"\.[0-9]+$", "."), (F.col("h") + 256).cast("string"))
    wrong = [
        # An ending that is no name, or prose: a word, at, and the end of a sentence.
        one_of(
            F.concat(F.regexp_replace(spelled, r"[A-Za-z]+$", ""), F.lit("1")),
            address(" at ", "."),
            F.concat(address(" at ", "."), F.lit(". The")),
        ),
        # A part beyond 255, or numbers of a list.
        one_of(
            dotted(beyond, "[.]"), dotted(beyond, "(.)"), dotted(beyond, " dot "), dotted(found, ". "),
            F.concat_ws(". ", *[(F.col("h") % 9 + k).cast("string") for k in range(4)]), dotted(beyond, "[dot]"),
        ),
        broken,
        # Too many digits, dates, years, decimals, and plain numbers.
        one_of(
            F.concat(tail, F.lit("-"), F.col("h").cast("string"), F.lit("0")),
            F.format_string("20%02d-%02d-%02d", F.col("h") % 30, F.col("h") % 12 + 1, F.col("h") % 28 + 1),
            F.format_string("%d-%d", F.col("h") % 100 + 1900, F.col("h") % 70 + 1950),
            F.format_string("%d.%d", F.col("h") % 97 + 1, F.col("h") + 1234567),
            F.format_string("%02d/%02d/20%02d", F.col("h") % 28 + 1, F.col("h") % 12 + 1, F.col("h") % 30),
            F.format_string("%d", F.col("h") * 7919 + 1234567),
        ),
    ]

    def pick(of: list[Column]) -> Column:
        chosen = of[-1]
        for at in range(len(of) - 2, -1, -1):
            chosen = F.when(kind == at, of[at]).otherwise(chosen)
        return chosen

    rows = spans.withColumn("found_digits", digits).select(
        "kind", "before", "after", F.col("h"), F.inline(F.array(
            F.struct(pick(right).alias("found"), F.lit(1.0).alias("label")),
            F.struct(pick(wrong).alias("found"), F.lit(0.0).alias("label")),
        ))
    )
    made = features(F.col("kind"), F.col("found"), F.col("before"), F.col("after"))
    return rows.select("kind", made.alias("numbers"), "label", (F.col("h") % 3).alias("fold"))


def _tree(lines: list[str], numbers: Column) -> Column:
    """A fitted tree, as Spark prints it, as an expression."""
    line = lines.pop(0).strip()
    if line.startswith("Predict"):
        return F.lit(float(line.split(":")[1]))
    number, bound = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line).groups()
    low = _tree(lines, numbers)
    lines.pop(0)
    high = _tree(lines, numbers)
    return F.when(numbers[int(number)] <= float(bound), low).otherwise(high)


def score(model, numbers: Column) -> Column:
    """The raw score of boosted trees over an array of features."""
    total = F.lit(0.0)
    for weight, tree in zip(model.treeWeights, model.trees, strict=True):
        total = total + F.lit(weight) * _tree(tree.toDebugString.splitlines()[1:], numbers)
    return total


def learning_rows(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``kind, numbers, label, fold, weight`` from all distinct base spans of the texts.

    Rows alike in all of it are one, weighted by their number: features are small whole numbers, so formats decide
    how many there are, not the texts.
    """
    text = F.col(f"`{text_col}`")
    spans = docs.where(text.rlike(f"{HINT['email']}|{HINT['phone']}|{HINT['ip']}|{HINT['card']}")).select(
        text.alias("text"), F.explode(base_spans(text)).alias("s")
    )
    left = F.greatest(F.col("s.start") - CONTEXT, F.lit(0))
    spans = spans.select(
        "s.kind",
        "s.found",
        F.substring("text", left + 1, F.col("s.start") - left).alias("before"),
        F.substring("text", F.col("s.end") + 1, F.lit(CONTEXT)).alias("after"),
    )
    spans = spans.withColumn("order", F.xxhash64("kind", "found", "before", "after")).distinct()
    rows = training_rows(spans.withColumn("h", F.pmod("order", F.lit(1000)).cast("int")))
    return rows.groupBy("kind", "numbers", "label", "fold").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def fit(docs: DataFrame, text_col: str = "text"):
    """Boosted trees and the score from which each kind is selected; None where evidence is short."""
    rows = write_and_read(learning_rows(docs, text_col).withColumn("vector", array_to_vector("numbers")), "pii-rows")
    held, taught = F.when(F.col("fold") == 0, F.col("weight")), F.when(F.col("fold") > 0, F.col("weight"))
    per_fold = rows.groupBy("kind").agg(
        F.coalesce(F.sum(held), F.lit(0.0)).alias("held"), F.coalesce(F.sum(taught), F.lit(0.0)).alias("taught"), F.count(F.lit(1)).alias("n")
    ).collect()
    usable = [r["kind"] for r in per_fold if min(r["held"], r["taught"]) >= LEAST_SPANS]
    if not usable:
        return None, {}
    n = sum(r["n"] for r in per_fold)
    # Spark looks for cuts in a sample of more than maxBins ** 2 rows.
    bins = max(32, math.isqrt(n) + 1)
    trees = GBTClassifier(featuresCol="vector", labelCol="label", weightCol="weight", maxIter=8, maxDepth=3, stepSize=0.3, seed=7, maxBins=bins)
    dealt = rows.where("fold > 0").repartition(-(-n // TASK_ROWS), "numbers").sortWithinPartitions("kind", "numbers", "label", "fold")
    model = trees.fit(dealt)
    judged = rows.where("fold = 0").select("kind", "label", "weight", F.round(score(model, F.col("numbers")), 3).alias("score"))
    bins = judged.groupBy("kind", "score").agg(F.sum(F.col("label") * F.col("weight")).alias("right"), F.sum("weight").alias("rows"))
    cutoffs: dict[int, float] = {}
    above: dict[int, list[float]] = {}
    # Scores have three digits, and eight trees of at most eight leaves few sums.
    for r in bins.orderBy("kind", F.desc("score")).collect():
        sums = above.setdefault(r["kind"], [0.0, 0.0])
        sums[0] += r["right"]
        sums[1] += r["rows"]
        if r["kind"] in usable and sums[1] >= LEAST_SPANS / 2 and sums[0] >= PRECISION * sums[1]:
            cutoffs[r["kind"]] = r["score"] - 0.0005
    return model, cutoffs


def with_spans(docs: DataFrame, model, cutoffs: dict[int, float], text_col: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``spans``, arrays of (start, kind, end, found) by start, then kind.

    An added span overlaps no base span and no better added one.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    out = docs.withColumn("base", base_spans(text))
    if model is None or not cutoffs:
        return out.withColumn("spans", F.col("base"))
    least = F.create_map(*[F.lit(x) for pair in cutoffs.items() for x in pair])

    def meets(a: Column, b: Column) -> Column:
        return (a["start"] < b["end"]) & (b["start"] < a["end"])

    def apart(c: Column) -> Column:
        return ~F.exists("base", partial(meets, c))

    def ranked(c: Column) -> Column:
        worse = (-score(model, _judged(text, c))).alias("worse")
        return F.struct(worse, *[c[x].alias(x) for x in ("start", "kind", "end", "found")])

    def add(taken: Column, c: Column) -> Column:
        return F.when(F.exists(taken, partial(meets, c)), taken).otherwise(F.concat(taken, F.array(c)))

    new = F.transform(F.filter(candidates(text), apart), ranked)
    new = F.filter(new, lambda c: F.coalesce(-c["worse"] >= F.try_element_at(least, c["kind"]), F.lit(False)))
    none = F.array().cast("array<struct<worse:double,start:int,kind:int,end:int,found:string>>")
    new = F.aggregate(F.array_sort(new), none, add)
    new = F.transform(new, lambda c: F.struct(*[c[x].alias(x) for x in ("start", "kind", "end", "found")]))
    return out.withColumn("spans", F.array_sort(F.concat("base", new)))


def personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``spans``.

    A null or empty text has no spans; repeated rows each get theirs; columns of ``docs`` with
    these two names are replaced, all others stay.
    """
    model, cutoffs = fit(docs, text_col)
    return with_spans(docs, model, cutoffs, text_col)


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind; overlapping spans become one."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        mark = F.when(s["start"] >= acc["at"], F.get(names, s["kind"])).otherwise(F.lit(""))
        return F.struct(
            F.greatest(s["end"], acc["at"]).alias("at"), F.concat(acc["parts"], F.array(gap, mark)).alias("parts")
        )

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    rest = F.aggregate(
        spans, start, step,
        lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.char_length(text))),
    )
    return F.when(F.size(spans) > 0, rest).otherwise(text)


def _is_kind(number: int, span: Column) -> Column:
    return span["kind"] == number


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    each = F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"]))
    return F.array_join(each, ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The registered result: counts per kind, digest of the base spans, and all spans."""
    counts = [
        F.size(F.filter("base", partial(_is_kind, at))).cast("long").alias(f"n_{k}") for at, k in enumerate(KINDS)
    ]
    return found.select(
        F.col(f"`{id_col}`"), *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans")
    )
