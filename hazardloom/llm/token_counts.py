"""Token counts by the whole-token shortcut.

``whole_tokens`` proves, once on the driver and with the tokenizer itself, which vocabulary
strings encode alone as exactly one token.  A pre-token in that set counts one; only the
rest goes through the merges of the library.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardloom.llm.chunks import BYTE_LETTERS, Encoder, load_tokenizer, small_slices


def whole_tokens(path: str) -> frozenset[str]:
    """Strings of the vocabulary that are one pre-token and encode alone as one token."""
    tokenizer = load_tokenizer(path)
    suffix = tokenizer.model.end_of_word_suffix or ""
    bytes_of = {chr(letter): byte for byte, letter in BYTE_LETTERS.items()}
    strings = []
    for token in tokenizer.get_vocab(with_added_tokens=False):
        letters = token.removesuffix(suffix) if suffix else token
        if letters and token.endswith(suffix) and all(x in bytes_of for x in letters):
            strings.append(bytes(bytes_of[x] for x in letters).decode("utf-8", "replace"))
    coder = Encoder(path, words=True)
    strings = sorted({s for s in strings if coder.pre_tokens(s) == [s]})
    proofs = tokenizer.encode_batch_fast(strings, add_special_tokens=False)
    return frozenset(s for s, proof in zip(strings, proofs, strict=True) if len(proof.ids) == 1)


class Counter(Encoder):
    """Numbers of tokens; proven pre-tokens count one without a merge."""

    def __init__(self, path: str, whole: frozenset[str]):
        super().__init__(path, words=True)
        self.whole = whole

    def of_ids(self, ids: list[int]) -> int:
        return len(ids)

    def joined(self, found) -> int:
        return sum(found)

    def merged(self, part: str) -> int:
        return 1 if part in self.whole else super().merged(part)


# The workers' counters by vocabulary file; their memos stay between tasks.
_COUNTERS: dict[str, Counter] = {}


def token_counts(
    docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row, in one map stage without a shuffle.

    A null or empty text has no tokens; repeated rows and null ids each give their row; other
    columns are not read.  Special strings in a text count as the library encodes them.  The
    broadcast set is bounded by the vocabulary of ``path``, which every worker reads itself.
    """
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))

    def count(batches):
        if path not in _COUNTERS:
            _COUNTERS[path] = Counter(path, whole.value)
        counter = _COUNTERS[path]
        for batch in batches:
            for part in small_slices(batch, 1024):
                totals = counter.of(part.column(2).to_pylist())
                columns = [part.column(0), part.column(1), pa.array(totals, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_bytes", "n_tokens"])

    source = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.coalesce(F.octet_length(f"`{text_col}`"), F.lit(0)).cast("long").alias("n_bytes"),
        F.col(f"`{text_col}`").alias("text"),
    )
    id_type = source.schema["id"].dataType.simpleString()
    counted = source.mapInArrow(count, f"id {id_type}, n_bytes long, n_tokens long")
    over = F.col("n_tokens") > F.lit(limit)
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", over.alias("over_limit"))
