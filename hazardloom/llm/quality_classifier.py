"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL.

A text's features are its word unigrams and bigrams, and the same of the words' shapes, in
which runs of letters and digits are one sign and a word equal to the one before is a sign of its
own; so the model also sees habits of words it never met.  Each n-gram is hashed to one of ``SIZE``
weights.  Training follows the regularised leader: steps per coordinate, an L1 threshold that
leaves rare n-grams at exactly zero, and an L2 term.  A score is the logistic of a sparse
dot product.

The fit reads at most ``SAMPLE_ROWS`` labelled rows, chosen by a hash, in one task; its ``SIZE``
weights are all that goes to the driver and to the scoring tasks.
"""

from __future__ import annotations

import string
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardloom.llm.chunks import small_slices
from hazardloom.session import write_and_read

# Slots of each of the four kinds of n-gram, and one for the bias.
BITS = 18
KINDS = 4
BIAS = KINDS << BITS
SIZE = BIAS + 1
# The bound of the fit: so many labelled rows are learned from, the same at every size of the input.
SAMPLE_ROWS = 5_000
PASSES = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.5, 1.0
THRESHOLD = 0.3
HOLD_OUT = 5

_LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
# Bytes beyond ASCII are parts of letters for the most part.
_SHAPES = bytes.maketrans(
    (string.ascii_letters + string.digits).encode() + bytes(range(128, 256)), b"a" * 26 + b"A" * 26 + b"0" * 10 + b"a" * 128
)
_REPEATED = 1  # the shape of a word that equals the one before
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def shapes(text: bytes) -> list[bytes]:
    """Per word its letters as ``a`` or ``A`` and its digits as ``0``, one for each run; other signs as they are."""
    text = text.translate(_SHAPES)
    for sign in (b"a", b"A", b"0"):
        while sign * 2 in text:
            text = text.replace(sign * 4, sign).replace(sign * 2, sign)
    return text.split()


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots and their values: an n-gram's is the root of its share of its kind, the bias has one.

    A null, empty or blank text has the bias only.
    """
    data = text.encode() if text else b""
    words = data.translate(_LOWER).split()
    if not words:
        return np.full(1, BIAS, np.int32), np.ones(1, np.float32)
    plain = np.fromiter(map(crc32, words), np.uint64, len(words))
    forms = np.fromiter(map(crc32, shapes(data)), np.uint64, len(words))
    forms[1:][plain[1:] == plain[:-1]] = _REPEATED
    grams = [plain, plain[1:] * _MIX[0] + plain[:-1], forms, forms[1:] * _MIX[0] + forms[:-1]]
    sizes = np.array([len(g) for g in grams])
    mixed = np.concatenate(grams) * _MIX[0]
    mixed ^= mixed >> np.uint64(29)
    slots = ((mixed * _MIX[1]) >> np.uint64(64 - BITS)).astype(np.int32) + np.repeat(np.arange(KINDS, dtype=np.int32) << BITS, sizes)
    found, times = np.unique(slots, return_counts=True)
    return np.append(found, np.int32(BIAS)), np.append(np.sqrt(times / sizes[found >> BITS]), 1).astype(np.float32)


def logistic(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def score(weights: np.ndarray, text: str | None) -> float:
    slots, values = features(text)
    return logistic(weights[slots] @ values)


class Learner:
    """State of a logistic regression that follows the regularised leader, one update per row."""

    def __init__(self):
        self.z, self.n = np.zeros(SIZE), np.zeros(SIZE)

    def weights(self, slots: np.ndarray) -> np.ndarray:
        z = self.z[slots]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - np.where(slots < BIAS, L1, 0), 0)
        return -shrunk / ((BETA + np.sqrt(self.n[slots])) / ALPHA + L2)

    def learn(self, label: int, slots: np.ndarray, values: np.ndarray) -> None:
        w = self.weights(slots)
        gradient = (logistic(w @ values) - label) * values.astype(np.float64)
        n = self.n[slots]
        sigma = (np.sqrt(n + gradient * gradient) - np.sqrt(n)) / ALPHA
        self.z[slots] += gradient - sigma * w
        self.n[slots] += gradient * gradient


def train(rows: list[tuple[int, str | None]], passes: int = PASSES) -> np.ndarray:
    """The weights after some passes over (label, text) rows, in the given order; zeros without both labels."""
    learner = Learner()
    known = [(label, *features(text)) for label, text in rows] if len({label for label, _ in rows}) > 1 else []
    for _ in range(passes):
        for row in known:
            learner.learn(*row)
    return learner.weights(np.arange(SIZE))


def held_out(id_col: Column) -> Column:
    """Rows that the fit doesn't see: a fifth of the ids; never a null id."""
    return F.coalesce(F.crc32(id_col.cast("string")) % HOLD_OUT == 0, F.lit(False))


def sample(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int = SAMPLE_ROWS
) -> DataFrame:
    """``label, text`` of at most ``rows`` labelled rows outside the hold-out, in one partition in the order of a hash."""
    key = F.col(f"`{id_col}`")
    known = labels.where(~held_out(key)).groupBy(key.alias("__id")).agg(F.max(f"`{label_col}`").alias("label"))
    known = known.where("__id is not null and label is not null")
    # Bounded by the sample's size, so small enough for every task; the texts never move for the join.
    chosen = known.orderBy(F.xxhash64(F.lit(1), "__id"), "__id").limit(rows)
    texts = docs.select(key.alias("__id"), F.col(f"`{text_col}`").alias("text"))
    found = texts.join(F.broadcast(chosen), "__id").withColumn("__order", F.xxhash64(F.lit(2), "__id", "text"))
    limited = found.orderBy("__order", "__id", "text").limit(rows)
    return limited.repartition(1).sortWithinPartitions("__order", "__id", "text").select("label", "text")


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> np.ndarray:
    """The trained weights, from one task over the sample; written to the shared folder and read back."""

    def learn(batches):
        rows = [(1 if r["label"] > 0 else 0, r["text"]) for batch in batches for r in batch.to_pylist()]
        weights = train(rows)
        slots = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(weights[slots])], names=["slot", "weight"])

    found = sample(docs, labels, id_col, text_col, label_col).mapInArrow(learn, "slot int, weight double")
    stored = write_and_read(found, "classifier").toPandas()  # at most SIZE rows
    weights = np.zeros(SIZE)
    weights[stored["slot"].to_numpy()] = stored["weight"].to_numpy()
    return weights


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> DataFrame:
    """The id, ``held_out``, ``score`` (0 to 1, higher where label 1 is likelier) and ``predicted`` of every row.

    Scores come from the text alone.  A null, empty or blank text gets the bias' score.  Repeated rows are
    each scored, alike.  Several labels of an id: the highest wins; null ids and labels aren't
    learned from.  Without labels of both kinds every score is 0.5.  An empty table gives an empty one.
    """
    weights = fit(docs, labels, id_col, text_col, label_col).astype(np.float32)

    def apply(batches):
        for batch in batches:
            for part in small_slices(batch, 512):
                found = [score(weights, t) for t in part.column(2).to_pylist()]
                arrays = [part.column(0), part.column(1), pa.array(found, pa.float64())]
                yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "held_out", "score"])

    key = F.col(f"`{id_col}`")
    source = docs.select(key, held_out(key).alias("held_out"), F.col(f"`{text_col}`").alias("__text"))
    kind = source.schema[id_col].dataType.simpleString()
    scored = source.mapInArrow(apply, f"`{id_col}` {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
