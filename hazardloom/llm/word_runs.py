"""Periodic runs of words by an online sparse diagonal DP.

Diagonal q of a text holds the matches of each word with the word q before it.  Going through
the text, every earlier occurrence of the current word lengthens the match on its diagonal by
one; a diagonal that stops matching ends, and is a run if its stretch is long enough for its
lag.  A run is a stretch of words with smallest period q, at least ``max(24, 3 * q)`` long, that
no neighbour extends.

The DP stays sparse because a diagonal opens late: one that becomes a run matches at least
K words in a row, with K = 16 for lags below 16, and otherwise K the power of two with
K / 2 <= q < K.  So a diagonal opens, with length K, where the last K words occurred q
words earlier.  Two facts about repeats in a window of K words leave one such lag below K:

- the nearest earlier occurrence, where it is K / 2 or more words back (two lags in the same
  half would make the window periodic with a shorter, nearer lag);
- or else, as the window then has a period r <= K / 2, the first occurrence outside its chain of
  steps r.  All lags inside the chain are multiples of r, so never a smallest period.

At most one opening per word and K makes O(n log n) of them for n words, whatever the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardloom.llm.chunks import small_slices

LEAST_LENGTH = 24
LEAST_REPEATS = 3
FIRST_WINDOW = 16

RUN_TYPE = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _occurrences(names: np.ndarray, window: int) -> np.ndarray:
    """For each window end, the lag of the diagonal it keeps open, or 0; see the module."""
    order = np.argsort(names, kind="stable")
    previous = np.full(len(names), -1)
    same = names[order[1:]] == names[order[:-1]]
    previous[order[1:][same]] = order[:-1][same]
    at = np.arange(len(names))
    near = (previous >= 0) & (at - previous < window // 2)
    # The first of each chain of near steps, by pointer jumping.
    first = np.where(near, previous, at)
    while True:
        jumped = first[first]
        if np.array_equal(jumped, first):
            break
        first = jumped
    outside = np.where(previous[first] >= 0, at - previous[first], 0)
    lags = np.where(outside < window, outside, 0)
    if window > FIRST_WINDOW:
        return np.where(lags >= window // 2, lags, 0)
    return lags


def _near_lags(names: np.ndarray) -> np.ndarray:
    """For the first window: the lag of the nearest earlier occurrence if it is below half the window, or 0."""
    order = np.argsort(names, kind="stable")
    lags = np.zeros(len(names), np.int64)
    step = order[1:] - order[:-1]
    same = (names[order[1:]] == names[order[:-1]]) & (step < FIRST_WINDOW // 2)
    lags[order[1:][same]] = step[same]
    return lags


def _doubled(names: np.ndarray, width: int) -> np.ndarray:
    """Names of the windows of ``2 * width`` words from those of ``width`` words, by window end."""
    pairs = names[width:].astype(np.int64) * (len(names) + width) + names[:-width]
    return np.unique(pairs, return_inverse=True)[1]


def _openings(words: np.ndarray):
    """Per window: its size and the window ends (word number, lag) at which a diagonal is open."""
    names, width = words, 1
    while width < FIRST_WINDOW and len(names) > width:
        names, width = _doubled(names, width), 2 * width
    n = len(words)
    while width >= FIRST_WINDOW and len(names) > 1:
        kinds = [_occurrences(names, width)] + ([_near_lags(names)] if width == FIRST_WINDOW else [])
        for lags in kinds:
            ends = np.flatnonzero(lags)
            yield width, ends + width - 1, lags[ends]
        # A run of the next window needs three of its shortest lags.
        if LEAST_REPEATS * width > n or int(names.max()) == len(names) - 1:
            return
        names, width = _doubled(names, width), 2 * width


def _primitive(block: np.ndarray) -> bool:
    """Whether a block of words is no repetition of a shorter one."""
    size = len(block)
    rest, factor = size, 2
    while rest > 1:
        if rest % factor == 0:
            step = size // factor
            if np.array_equal(block[step:], block[:-step]):
                return False
            while rest % factor == 0:
                rest //= factor
        factor = factor + 1 if factor * factor <= rest else max(rest, factor + 1)
    return True


def word_runs(words: list) -> list[tuple[int, int, int]]:
    """The runs (start, length, period) of a list of words, by start, then period."""
    n = len(words)
    if n < LEAST_LENGTH:
        return []
    numbers: dict = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    if len(numbers) > n - FIRST_WINDOW:  # a run repeats that many words
        return []
    runs: list[tuple[int, int, int]] = []

    def ended(lag: int, last: int, matched: int) -> None:
        length = matched + lag
        if length >= max(LEAST_LENGTH, LEAST_REPEATS * lag):
            start = last + 1 - length
            if _primitive(ids[start : start + lag]):
                runs.append((start, length, lag))

    for width, ends, lags in _openings(ids):
        active: dict[int, tuple[int, int]] = {}  # lag -> last word, matched words; two at most
        for at, lag in zip(ends.tolist(), lags.tolist(), strict=True):
            for over in [q for q, (last, _) in active.items() if last < at - 1]:
                ended(over, *active.pop(over))
            active[lag] = (at, active[lag][1] + 1 if lag in active else width)
        for lag, (last, matched) in active.items():
            ended(lag, last, matched)
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapsed_words(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run contains after its first period."""
    kept, end = [], 0
    for start, stop in sorted((start + period, start + length) for start, length, period in runs):
        if start > end:
            kept += words[end:start]
        end = max(end, stop)
    return kept + words[end:]


def periodic_runs(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of every row with ``n_words``, ``runs`` and the ``collapsed`` text.

    Words are what is between spaces, tabs and line ends.  ``runs`` has the start (word number),
    length and period of every run by start, then period; ``collapsed`` joins the words that
    are left by one space.  A null, empty or blank text has no words, no runs and an empty
    collapsed text.  Rows are independent of one another: repeated rows give repeated results, and an empty
    table gives an empty one.  One map stage over whole texts, nothing is shuffled.
    """

    def measure(batches):
        for batch in batches:
            for part in small_slices(batch):
                counts, found, texts = [], [], []
                for text in part.column(part.num_columns - 1).to_pylist():
                    words = text.encode().split() if text else []
                    runs = word_runs(words)
                    counts.append(len(words))
                    found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                    texts.append(b" ".join(collapsed_words(words, runs) if runs else words).decode())
                run_type = pa.list_(pa.struct([(f, pa.int64()) for f in ("start", "length", "period")]))
                results = [pa.array(counts, pa.int64()), pa.array(found, run_type), pa.array(texts, pa.string())]
                names = [*part.schema.names[:-1], "n_words", "runs", "collapsed"]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *results], names=names)

    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("__text"))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:-1])
    return source.mapInArrow(measure, f"{kept}n_words long, runs {RUN_TYPE}, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length / period; ties go to the smallest start, then period; null without runs."""

    def better(best: Column, run: Column) -> Column:
        # Fractions are compared by cross products; the runs come by start, then period.
        wins = best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"])
        return F.when(wins, run).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), better)


def digest(found: DataFrame) -> DataFrame:
    """Number of runs, the strongest one and digests of all runs and of the collapsed text."""
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    top = strongest(F.col("runs"))
    return found.withColumn("__top", top).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"__top.{f}").alias(f) for f in ("start", "length", "period")],
        F.expr("1000 * __top.length div __top.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
