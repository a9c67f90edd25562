"""Encoding of texts chunk by chunk with bounded memos.

A chunk is a part of a text that the tokenizer encodes alike wherever it stands, and a
pre-token is what the tokenizer's own pattern cuts a chunk into before the merges.  Each
frequent chunk and pre-token is merged once per worker, by the library's model; the ids of a
text are those of its chunks in order.  A chunk with other than plain Latin characters is
encoded by the library whole, and so is a text that can't be cut safely.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

# Chunks, and pre-tokens, of a generation that one worker remembers; about 200 bytes each.
MEMO_ENTRIES = 200_000

# Characters str.split() takes for white space and the word tokenizer doesn't.
_SEPARATORS = re.compile("[\x1c-\x1f]")
# Latin letters, numbers and signs on which every Unicode version agrees.
_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-įı-ſ"
_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_PLAIN = re.compile("[\n !-~\xa1-\xac\xae-įı-ſ]+")
# The patterns of the two vocabularies for plain characters.
_WORD_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}]+")
_SPACE_PARTS = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^\s{_LETTERS}{_NUMBERS}]+|\s+(?!\S)|\s+"
)


def _byte_letters() -> dict[int, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return dict(zip(plain, plain, strict=True)) | {b: 256 + k for k, b in enumerate(others)}


BYTE_LETTERS = _byte_letters()


_SPACE_LETTER = chr(BYTE_LETTERS[32])
_LAST_LETTER, _DOTTED_I, _STOPS = "\u017f", "\u0130", (",", ".")


def byte_letters(text: str) -> str:
    return text.encode().decode("latin-1").translate(BYTE_LETTERS)


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    """The tokenizer of a vocabulary file, single-threaded; one per worker and file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Memo(dict):
    """A bounded dict that computes what it lacks.

    When it is full, its entries become the old generation; those that are asked for again
    return from there, so frequent ones are computed once.
    """

    def __init__(self, compute):
        self.compute, self.old = compute, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        self[key] = value
        return value

    def trim(self) -> None:
        if len(self) > MEMO_ENTRIES:
            self.old = dict(self)
            self.clear()


class Encoder:
    """What ``of_ids`` says of the token ids of texts, joined by ``joined``.

    ``words`` tells vocabularies that drop white space, whose chunks are the words, from
    byte-level ones, where a space that stands alone begins a chunk.
    """

    def __init__(self, path: str, words: bool):
        self.tokenizer, self.words = load_tokenizer(path), words
        self.merge = self.tokenizer.model.tokenize
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.parts = Memo(self.merged)
        self.chunks = Memo(self.of_chunk if words else self.of_first)
        self.spaced = self.chunks if words else Memo(self.of_spaced)

    def of_ids(self, ids: list[int]):
        return array("I", ids).tobytes()

    def joined(self, found):
        return b"".join(found)

    def pre_tokens(self, chunk: str) -> list[str] | None:
        """Pre-tokens of a plain chunk; None if the library has to see it whole."""
        if not _PLAIN.fullmatch(chunk) or ("<" in chunk and any(s in chunk for s in self.specials)):
            return None
        return _WORD_PARTS.findall(chunk.lower()) if self.words else _SPACE_PARTS.findall(chunk)

    def merged(self, part: str):
        """One pre-token, by the merges of the library's model."""
        if part.isascii() and part.isalnum():
            letters = part
        elif part[0] == " " and part[1:].isascii() and part[1:].isalnum():
            letters = _SPACE_LETTER + part[1:]
        else:
            letters = byte_letters(part)
        return self.of_ids([t.id for t in self.merge(letters)])

    def by_library(self, text: str):
        return self.of_ids(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def of_chunk(self, chunk: str):
        # Short ways for what is most frequent: a word, and a word with a stop or comma.
        bare = chunk[1:] if chunk[0] == " " else chunk
        word = bare[:-1] if bare[-1:] in _STOPS else bare
        if word.isalpha() and (word.isascii() or (max(word) <= _LAST_LETTER and _DOTTED_I not in word)):
            whole = chunk.lower() if self.words else chunk
            if word is bare:
                return self.parts[whole]
            return self.joined((self.parts[whole[:-1]], self.parts[whole[-1]]))
        cut = self.pre_tokens(chunk)
        if cut is None:
            return self.by_library(chunk)
        return self.parts[cut[0]] if len(cut) == 1 else self.joined([self.parts[x] for x in cut])

    def of_first(self, chunk: str):
        """The chunk before the first space; None if the text can't be cut at its spaces."""
        # Only a space between two other characters surely begins a pre-token.
        return None if not chunk or chunk[0].isspace() or chunk[-1].isspace() else self.of_chunk(chunk)

    def of_spaced(self, chunk: str):
        return None if not chunk or chunk[0].isspace() or chunk[-1].isspace() else self.of_chunk(" " + chunk)

    def of_text(self, text: str | None):
        """The joined result of a text; a null text is an empty one."""
        if not text:
            return self.joined(())
        if self.words:
            if _SEPARATORS.search(text):
                return self.by_library(text)
            return self.joined(map(self.chunks.__getitem__, text.split()))
        first, *rest = text.split(" ")
        found = [self.chunks[first], *map(self.spaced.__getitem__, rest)]
        try:
            return self.joined(found)
        except TypeError:  # a None among them
            return self.by_library(text)

    def of(self, texts: list[str | None]) -> list:
        for memo in (self.chunks, self.spaced, self.parts):
            memo.trim()
        return [self.of_text(t) for t in texts]


@lru_cache(maxsize=4)
def encoder(path: str, words: bool) -> Encoder:
    """The worker's encoder of ids as little-endian unsigned 32-bit bytes; its memos stay between tasks."""
    return Encoder(path, words)


def small_slices(batch, rows: int = 256):
    """Slices of an Arrow batch, so that a task holds the results of a few rows at a time."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
