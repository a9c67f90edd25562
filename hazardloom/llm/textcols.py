"""Column functions over texts that several operators share; built-in expressions only."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; all other characters as they are."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def found_spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as an array of (start, end, found), in code points, end exclusive.

    ``pattern`` has no capturing groups.  Each match is taken with the gap before it, tied by
    ``\\G`` to the end of the last match; the gaps' and matches' lengths add up to positions.
    """
    tied = F.lit(rf"(?s)\G(.*?)({pattern})")
    gaps, found = F.regexp_extract_all(text, tied, F.lit(1)), F.regexp_extract_all(text, tied, F.lit(2))
    none = F.array().cast("array<struct<start:int,end:int,found:string>>")

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.char_length(pair["gap"])
        end = start + F.char_length(pair["found"])
        span = F.struct(start.alias("start"), end.alias("end"), pair["found"].alias("found"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    pairs = F.zip_with(gaps, found, lambda g, f: F.struct(g.alias("gap"), f.alias("found")))
    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))
    return F.aggregate(pairs, start, step, lambda acc: acc["spans"])
