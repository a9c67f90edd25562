"""Text column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hazardloom.rules import constant

# --- fixed values: the white space that trimming removes, as a class and as characters ----
WHITESPACE = (
    r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
WHITESPACE_CHARS = "".join(
    chr(c)
    for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
              0x202F, 0x205F, 0x3000]
)
NOT_BLANK = WHITESPACE.replace("[", "[^", 1)


def strip(text: Column) -> Column:
    """Remove white space of every kind at both ends (plain ``trim`` removes blanks only).

    Looks at the ends only, whatever the length of the text.
    """
    return F.btrim(text, F.lit(WHITESPACE_CHARS))


def remove(text: Column, characters: str) -> Column:
    """Delete every occurrence of the given characters."""
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def normalize_key(text: Column) -> Column:
    """Trimmed text without line breaks; NULL when nothing usable is left."""
    return F.when(is_usable_key(text), remove(strip(text), "\n\r"))


def is_usable_key(text: Column) -> Column:
    """Whether :func:`normalize_key` gives a key: some character is not white space.

    The search stops at the first one, so a filter on it is much cheaper than one on the key.
    """
    return F.coalesce(text.rlike(NOT_BLANK), F.lit(False))


def resolve_name(text: Column, names: dict[str, str]) -> Column:
    """Structure of a listed name (any case), otherwise the normalised text itself."""
    listed = F.try_element_at(constant(names, "map<string, string>"), F.lower(strip(text)))
    return normalize_key(F.coalesce(listed, text))


def split_parts(text: Column, names: dict[str, str]) -> Column:
    """Ordered component list of a mixture text: on commas if any, else on dots.

    Empty parts are dropped; NULL or empty text gives an empty list.
    """
    stripped = strip(F.coalesce(text, F.lit("")))
    raw = F.when(stripped.contains(","), F.split(stripped, ",")).otherwise(F.split(stripped, r"\."))
    return F.array_compact(F.transform(raw, lambda part: resolve_name(part, names)))


def split_lines(text: Column, names: dict[str, str]) -> Column:
    """Component list of a multi-line input: the lines' lists pooled in order."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.flatten(F.transform(lines, lambda line: split_parts(line, names)))


# Count features of a text: 27 named numbers.  A feature counts single characters (given
# as text), the characters of a class, the matches of a pattern, or is special.
COUNT_FEATURES: dict[str, tuple[str, str]] = {
    "n_chars": ("special", r"(?s)."),
    "n_letters": ("class", r"[A-Za-z]"),
    "n_upper": ("class", r"[A-Z]"),
    "n_lower": ("class", r"[a-z]"),
    "n_digits": ("class", r"[0-9]"),
    "n_blanks": ("characters", " "),
    "n_words": ("pattern", r"[A-Za-z0-9]+"),
    "n_numbers": ("pattern", r"[0-9]+"),
    "n_non_ascii": ("class", r"[^\x00-\x7f]"),
    "n_round_open": ("characters", "("),
    "n_round_close": ("characters", ")"),
    "n_square_open": ("characters", "["),
    "n_square_close": ("characters", "]"),
    "n_double_marks": ("characters", "="),
    "n_triple_marks": ("characters", "#"),
    "n_plus": ("characters", "+"),
    "n_minus": ("characters", "-"),
    "n_slashes": ("characters", "/\\"),
    "n_at": ("characters", "@"),
    "n_dots": ("characters", "."),
    "n_commas": ("characters", ","),
    "n_vowels": ("class", r"[AEIOUaeiou]"),
    "n_hetero": ("class", r"[NOSPnosp]"),
    "n_halogen": ("pattern", r"F|Cl|Br|I"),
    "n_aromatic": ("class", r"[cnos]"),
    "n_distinct_words": ("special", r"[A-Za-z0-9]"),
    "longest_word": ("special", r"[A-Za-z0-9]"),
}


def count_features(text: Column) -> list[Column]:
    """The count features in their fixed order, as doubles; NULL text gives NULLs.

    Characters are counted by what deleting them takes off the length, which needs no
    list of matches.
    """
    words = F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9]+)"), F.lit(1))
    special = {
        "n_chars": F.length(text),
        "n_distinct_words": F.size(F.array_distinct(F.transform(words, F.lower))),
        "longest_word": F.coalesce(F.array_max(F.transform(words, F.length)), F.lit(0)),
    }
    columns = []
    for name, (kind, what) in COUNT_FEATURES.items():
        if kind == "special":
            count = special[name]
        elif kind == "characters":
            count = F.length(text) - F.length(remove(text, what))
        elif kind == "class":
            count = F.length(text) - F.length(F.regexp_replace(text, what + "+", ""))
        else:
            count = F.regexp_count(text, F.lit(what))
        columns.append(F.when(text.isNotNull(), count.cast("double")).alias(name))
    return columns


def n_present_counts(text: Column) -> Column:
    """Number of count features of a (non-NULL) text that are not zero."""
    present = F.lit(0)
    for kind, what in COUNT_FEATURES.values():
        if kind == "characters":
            found = text.contains(what[0])
            for c in what[1:]:
                found = found | text.contains(c)
        else:
            found = text.rlike(what)
        present = present + found.cast("int")
    return present


NGRAM_BITS = 1024


# A gram's number has its code points as digits of GRAM_BASE; one step of a multiplicative
# generator spreads the numbers over the bits.
GRAM_BASE, GRAM_PRIME, GRAM_FACTOR = 1_000_003, 2_147_483_647, 48_271


def ngram_numbers(text: Column, sizes: tuple[int, ...]) -> Column:
    """Numbers of all overlapping character n-grams, arithmetic on code points; no gram becomes a text."""

    def numbers(points: Column, n: int) -> Column:
        def number(at: Column) -> Column:
            value = F.get(points, at)
            for k in range(1, n):
                value = value * GRAM_BASE + F.get(points, at + k)
            return value

        starts = F.when(F.size(points) >= n, F.sequence(F.lit(0), F.size(points) - n)).otherwise(
            F.array().cast("array<int>")
        )
        return F.transform(starts, number)

    points = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long") + 1)
    # The points pass through a one-element array, so that they are computed once.
    return F.get(
        F.transform(F.array(points), lambda p: F.flatten(F.array(*[numbers(p, n) for n in sizes]))), F.lit(0)
    )


def hashed_ngram_bits(text: Column, sizes: tuple[int, ...] = (1, 2, 3), bits: int = NGRAM_BITS) -> Column:
    """Sorted distinct bit numbers set by the n-grams of a text; NULL text gives NULL."""
    return F.sort_array(_distinct_bits(text, sizes, bits))


def n_ngram_bits(text: Column, sizes: tuple[int, ...] = (1, 2, 3), bits: int = NGRAM_BITS) -> Column:
    """How many bits :func:`hashed_ngram_bits` sets, without sorting them."""
    return F.size(_distinct_bits(text, sizes, bits))


def _distinct_bits(text: Column, sizes: tuple[int, ...], bits: int) -> Column:
    present = F.when(text == "", F.array().cast("array<bigint>")).otherwise(ngram_numbers(text, sizes))
    spread = F.transform(
        present, lambda v: F.pmod(F.pmod(F.pmod(v, F.lit(GRAM_PRIME)) * GRAM_FACTOR, F.lit(GRAM_PRIME)), F.lit(bits)).cast("int")
    )
    return F.when(text.isNotNull(), F.array_distinct(spread))
