"""Quality rules with risk-controlled thresholds.

Every rule is a percentage of a text's words or lines that rises with junk.  Cutoffs come
from labelled hold-out rows, per stratum: going from the loosest cutoff to tighter ones, a
cutoff is certified while the exact binomial test rejects "this cutoff rejects more than the
allowed share of good rows".  A rule's sequence stops at the first failure (fixed-sequence
testing, so the grid costs no level), and the level is divided by the number of rules and
strata (Bonferroni).  With confidence 1 - DELTA, no stratum loses more than ALPHA of its good
rows by all rules together.  Of the certified cutoffs, the one that rejects most bad rows net
of good ones is used; a stratum with too few labels certifies nothing and rejects nothing.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardloom.llm.chunks import small_slices
from hazardloom.session import write_and_read

ALPHA = 0.10
DELTA = 0.05
# Cutoffs in percent, loosest first.
GRID = [300, 250, 200, 150, 100, 90, 80, 70, 60, 50, 40, 35, 30, 25, 20, 15, 12, 10, 8, 6, 5]
RULES = {
    "symbols": "100 * n_symbols / n_words",
    "upper_case": "100 * n_upper / word_chars",
    "stutter": "100 * n_stutter / n_words",
    "dup_lines": "100 * n_dup_lines / n_lines",
}
CUTOFFS = [f"__cutoff_{r}" for r in RULES]

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_stutter", "n_lines"]
# Fixed values of the definition: white space and symbols.
SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
WINDOW = 5


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur at least twice, the first included."""
    total = len(words) - window + 1
    if total < 2:
        return 0
    windows = list(zip(*(words[k:] for k in range(window)), strict=False))
    if len(set(windows)) == total:
        return 0
    times = Counter(windows)
    covered = end = 0
    for at, key in enumerate(windows):
        if times[key] > 1:
            covered += at + window - max(at, end)
            end = at + window
    return covered


def text_stats(text: str | None) -> tuple[int, ...]:
    """The columns ``STATS`` of one text; a null text has none of anything."""
    if not text:
        return (0,) * len(STATS)
    data = text.encode()
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text) - (len(data) - len(data.translate(None, SPACES))),
        len(data) - len(data.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(data) - len(data.translate(None, UPPER)),
        sum(map(bytes.__eq__, words, words[1:])),
        len(lines),
    )


def stats(docs: DataFrame, columns: list[str], text_col: str = "text") -> DataFrame:
    """``columns`` of ``docs``, which may hold the text, beside the statistics of every whole text, in one map stage."""
    names = columns if text_col in columns else [*columns, text_col]
    at, own = names.index(text_col), len(columns)

    def measure(batches):
        for batch in batches:
            for part in small_slices(batch, 512):
                found = list(zip(*map(text_stats, part.column(at).to_pylist()), strict=True))
                numbers = [pa.array(x, pa.int64()) for x in found] or [pa.array([], pa.int64())] * len(STATS)
                arrays = [*part.columns[:own], *numbers]
                yield pa.RecordBatch.from_arrays(arrays, names=[*columns, *STATS])

    source = docs.select(*[F.col(f"`{c}`") for c in names])
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:own])
    return source.mapInArrow(measure, f"{kept}, {', '.join(f'{s} long' for s in STATS)}")


def log_binomial_tail(k: int, n: int, p: float) -> float:
    """Exact log P(X <= k) for X ~ Bin(n, p), summed from the largest term down."""
    if k >= n:
        return 0.0
    term = [
        math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
        for i in range(k, -1, -1)
    ]
    top = max(term)
    return min(0.0, top + math.log(sum(math.exp(t - top) for t in term)))


def certify(
    counts: dict[tuple[str, str, int], tuple[int, int]], good: dict[str, int], strata: int
) -> dict[tuple[str, str], int]:
    """Cutoff per (stratum, rule) from (good, bad) rows at or above each cutoff and good rows per stratum.

    ``strata`` is the number of all strata with good rows, which share the level.
    """
    level = math.log(DELTA / (len(RULES) * max(1, strata)))
    allowed, chosen = ALPHA / len(RULES), {}
    for stratum, n in good.items():
        for rule in RULES:
            best = 0
            for cutoff in GRID:
                lost, caught = counts.get((stratum, rule, cutoff), (0, 0))
                if lost > allowed * n or log_binomial_tail(lost, n, allowed) > level:
                    break
                if caught - lost > best:
                    best, chosen[stratum, rule] = caught - lost, cutoff
    return chosen


def _rule(name: str):
    return F.coalesce(F.expr(RULES[name]), F.lit(0.0))


def _base_failed():
    return F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")


def cutoffs(measured: DataFrame, labels: DataFrame, stratum: str, id_col: str) -> DataFrame:
    """``__stratum`` and a column per rule with its certified cutoff, a row for every stratum with good rows.

    ``labels`` has the id and ``quality`` (0 bad, 1 good).  Several labels of an id: good wins;
    null labels and null ids are no evidence.  Rows that fail the base rules are no evidence either.
    """
    known = labels.groupBy(F.col(f"`{id_col}`").alias("__id")).agg(F.max("quality").alias("__quality"))
    known = write_and_read(known.where("__id is not null and __quality is not null"), "labels")
    rows = measured.where(~_base_failed()).select(
        F.col(f"`{id_col}`").alias("__id"),
        F.coalesce(F.col(f"`{stratum}`").cast("string"), F.lit("")).alias("__stratum"),
        *[_rule(r).alias(r) for r in RULES],
    )
    held = rows.join(known, "__id")
    per_cutoff = [
        F.count_if((F.col(r) >= c) & (F.col("__quality") == q)).alias(f"{r}|{c}|{q}")
        for r in RULES
        for c in GRID
        for q in (1, 0)
    ]
    own = held.groupBy("__stratum").agg(F.count_if(F.col("__quality") == 1).alias("good"), *per_cutoff)
    own = write_and_read(own.where("good > 0"), "cutoff-counts")
    strata = own.count()

    def decide(batches):
        for batch in batches:
            for row in batch.to_pylist():
                name = row["__stratum"]
                counts = {(name, r, c): (row[f"{r}|{c}|1"], row[f"{r}|{c}|0"]) for r in RULES for c in GRID}
                found = certify(counts, {name: row["good"]}, strata)
                columns = [pa.array([name], pa.string()), *[pa.array([found.get((name, r))], pa.int32()) for r in RULES]]
                yield pa.RecordBatch.from_arrays(columns, names=["__stratum", *CUTOFFS])

    return write_and_read(own.mapInArrow(decide, f"__stratum string, {', '.join(f'{c} int' for c in CUTOFFS)}"), "cutoffs")


def verdicts(measured: DataFrame, found: DataFrame, stratum: str = "lang") -> DataFrame:
    """``measured`` with ``base_failed`` and ``kept``; a stratum that ``found`` lacks rejects by the base rules only."""
    rejected = F.lit(False)
    for rule, cutoff in zip(RULES, CUTOFFS, strict=True):
        rejected = rejected | F.coalesce(_rule(rule) >= F.col(cutoff), F.lit(False))
    keyed = measured.withColumn("__stratum", F.coalesce(F.col(f"`{stratum}`").cast("string"), F.lit("")))
    judged = keyed.join(found, "__stratum", "left")
    failed = _base_failed()
    return judged.withColumn("base_failed", failed).withColumn("kept", ~failed & ~rejected).drop("__stratum", *CUTOFFS)


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum: str = "lang",
    more: tuple[str, ...] = (),
) -> DataFrame:
    """Statistics, ``base_failed`` and ``kept`` of every row; ``more`` are other columns to carry.

    A null or empty text has no words and fails the base rules.  Repeated rows each get their
    verdict.  Without labels nothing is rejected but by the base rules.  The statistics are
    written once to the shared folder, because fitting and applying both read them.
    """
    columns = list(dict.fromkeys([id_col, stratum, *more]))
    measured = write_and_read(stats(docs, columns, text_col), "quality")
    return verdicts(measured, cutoffs(measured, labels, stratum, id_col), stratum)
