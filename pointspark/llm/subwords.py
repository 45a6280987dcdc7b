"""Library tokenizers with a bounded memory of pieces of text, for use inside tasks.

A text is cut where no token can cross; each piece is encoded once by the
library's own normalizer, pre-tokenizer and model and then remembered, so
frequent words cost a dictionary look-up.  Long pieces are not remembered.

Defined results: a null or empty text has no pieces and no ids; equal texts
have equal results, whatever is remembered.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain

import numpy as np

MEMO = 600_000
PIECES = 1_000_000
LONG = 64
#: What lower case or normalization may treat otherwise than letter by letter: all beyond the Latin blocks, and a capital I with dot.
_BEYOND = re.compile("[\u0130\u0250-\U0010ffff]")
#: A full stop or comma after a letter or digit and before a space or the end.
_MARK = re.compile(r"([.,])(?= |\Z)(?<=[^\W_][.,])")
#: A space beside other white space or at an end; elsewhere, a space starts a byte-level token.
_ODD_SPACE = re.compile(r"\s |[ ]\s|\A | \Z")
#: White space that is neither a space nor a line end.
_OTHER_BLANK = re.compile(r"[^\S \n]")
_SAFE_CUT = re.compile(r"(?<=\S)(?= \S)")


@lru_cache(maxsize=4)
def load(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def added_strings(tokenizer) -> list[str]:
    return [x.content for x in tokenizer.get_added_tokens_decoder().values()]


def pretokens(tokenizer, text: str) -> list[tuple[str, tuple[int, int]]]:
    """The library's own pre-tokens of a text without added tokens."""
    if tokenizer.normalizer is not None:
        text = tokenizer.normalizer.normalize_str(text)
    return tokenizer.pre_tokenizer.pre_tokenize_str(text)


def byte_letters() -> dict[int, int]:
    """The printable character that byte-level models have for each byte: its own, or the next one from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in own)
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(rest)}


_LETTERS = byte_letters()


def is_plain(piece: str) -> bool:
    """Whether a piece is one pre-token by its characters alone: letters of the Latin blocks, whose lower case is one letter."""
    return piece.isalpha() and (piece.isascii() or (max(piece) < "\u0250" and "\u0130" not in piece))


def as_letters(word: str) -> str:
    """A word in the characters that byte-level models have for its bytes."""
    return word if word.isascii() else word.encode().decode("latin-1").translate(_LETTERS)


def ends_in_mark(piece: str) -> bool:
    """Whether a piece is a full stop or comma after a letter or digit: the mark is a pre-token of its own.

    Letters beyond the Latin blocks are left to the library, as normalization can end them in a mark.
    """
    return len(piece) > 1 and piece[-1] in ".," and piece[-2].isalnum() and piece[-2] < "\u0250" and piece[-2] != "\u0130"


class Ragged:
    """Rows of ids, end to end in one array."""

    def __init__(self):
        self.flat, self.ends = array("I"), array("q", [0])

    def append(self, row: Iterable[int]) -> None:
        self.flat.extend(row)
        self.ends.append(len(self.flat))

    def __len__(self) -> int:
        return len(self.ends) - 1

    def __getitem__(self, i: int) -> tuple[int, ...]:
        return tuple(self.flat[self.ends[i] : self.ends[i + 1]])


class IdMemo(dict):
    """Piece -> row of a ragged array of ids, for tokenizers that drop white space and case."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.added = added_strings(self.tokenizer)
        self.rows = Ragged()

    def pieces(self, text: str | None) -> list[str]:
        """What stands between spaces and line ends, in lower case and with marks apart where that changes no token."""
        if not text:
            return []
        text = text.replace("\n", " ")
        if text.isascii() or _BEYOND.search(text) is None:
            lower = text.lower()
            if not any(x.lower() in lower for x in self.added):
                text = _MARK.sub(r" \1", lower)
        return text.split(" ")

    def encode(self, piece: str) -> tuple[int, ...]:
        tokenizer = self.tokenizer
        if is_plain(piece):
            return tuple([x.id for x in tokenizer.model.tokenize(as_letters(piece.lower()))])
        if ends_in_mark(piece):
            return self.rows[self[piece[:-1]]] + self.rows[self[piece[-1]]]
        if any(x in piece for x in self.added):
            return tuple(tokenizer.encode(piece, add_special_tokens=False).ids)
        return tuple([x.id for word, _ in pretokens(tokenizer, piece) for x in tokenizer.model.tokenize(word)])

    def __missing__(self, piece: str) -> int:
        found = self.encode(piece)
        row = len(self.rows)
        self.rows.append(found)
        if len(piece) <= LONG:
            self[piece] = row
        return row

    def ids(self, pieces: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts (each given as its pieces), and how many each text has."""
        if len(self.rows) > PIECES:
            self.clear()
            self.rows = Ragged()
        row = np.fromiter(map(self.__getitem__, chain.from_iterable(pieces)), np.int64, sum(map(len, pieces)))
        if not len(self.rows.flat):
            return np.zeros(0, np.uint32), np.zeros(len(pieces), np.int64)
        flat, bounds = np.frombuffer(self.rows.flat, np.uint32), np.frombuffer(self.rows.ends, np.int64)
        starts = bounds[row]
        sizes = bounds[row + 1] - starts
        total = int(sizes.sum())
        at = np.arange(total) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
        per_text = np.add.reduceat(np.append(sizes, 0), np.minimum(_starts(pieces), len(sizes))) if pieces else np.zeros(0, np.int64)
        per_text = np.where(np.fromiter(map(len, pieces), np.int64, len(pieces)) > 0, per_text, 0)
        return flat[at], per_text


def _starts(pieces: list[list[str]]) -> np.ndarray:
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    return np.cumsum(sizes) - sizes


class CountMemo(dict):
    """Piece of a byte-level text that starts with a space (left out of the key) -> number of tokens."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.added = added_strings(self.tokenizer)
        first = self.tokenizer.pre_tokenizer.pre_tokenize_str(" a")[0][0]
        self.space = first[0]
        self.mark = len(self.tokenizer.model.tokenize("."))

    def count(self, piece: str) -> int:
        if any(x in piece for x in self.added):
            return len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        return sum(len(self.tokenizer.model.tokenize(word)) for word, _ in pretokens(self.tokenizer, piece))

    def __missing__(self, piece: str) -> int:
        if is_plain(piece):
            n = len(self.tokenizer.model.tokenize(self.space + as_letters(piece)))
        elif ends_in_mark(piece):
            n = self[piece[:-1]] + self.mark
        else:
            n = self.count(" " + piece)
        if len(piece) <= LONG:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = n
        return n


@lru_cache(maxsize=2)
def id_memo(path: str) -> IdMemo:
    """The memory of a Python worker, which its later tasks find again."""
    return IdMemo(path)


@lru_cache(maxsize=2)
def count_memo(path: str) -> CountMemo:
    return CountMemo(path)


def spaced_pieces(text: str) -> list[str]:
    """Cut at each space between two characters that are no white space, and drop that space.

    No alternative of the byte-level pattern goes from a character that is no
    white space over a following space, so such a space always starts a token.
    """
    if _OTHER_BLANK.search(text) is None:
        odd = "  " in text or "\n " in text or " \n" in text or text[:1] == " " or text[-1:] == " "
    else:
        odd = _ODD_SPACE.search(text) is not None
    if not odd:
        return text.split(" ")
    pieces = _SAFE_CUT.split(text)
    return [pieces[0], *[x[1:] for x in pieces[1:]]]


def blocks(texts: Iterable, limit: int = 2_000_000) -> Iterable[list]:
    """Consecutive texts in lists of about ``limit`` characters at most, so that pieces in memory are bounded."""
    held, n = [], 0
    for text in texts:
        held.append(text)
        n += len(text or "")
        if n >= limit:
            yield held
            held, n = [], 0
    if held:
        yield held
