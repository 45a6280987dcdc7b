"""Byte-level BPE encoding and decoding over a pair occurrence index.

The distinct words that a task has not met before are laid end to end as
symbols.  The index maps each pair of neighbouring symbols that has a merge rank
to all its positions.  The ranks that are active, that is have positions, are
applied in ascending order: all occurrences of the pair are merged from left to
right, and the lists of the pairs that a merge makes grow by its position.
Positions whose pair another merge has taken are passed over when their rank's
turn comes.  No merge crosses from one word into the next.

What a word is, the library's own pre-tokenizer decides; words are remembered
within bounds, so frequent ones are indexed once.  A text is cut at spaces that
always start a word (``subwords.spaced_pieces``), and strings of added tokens
are cut out before, as the library does.

Decoding joins the bytes of the tokens; bytes that are no UTF-8 become U+FFFD.

Defined results: a null text is an empty one, with no ids and an empty decoded
text; a null id is kept; repeated rows are repeated; an empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointspark.llm import subwords

#: Symbols are below this many bits.
BITS = 24
#: Pieces, and ids, that a worker remembers.
WORDS, IDS = 600_000, 8_000_000
#: Bytes of words that are indexed together.
INDEXED = 2_000_000
#: Added to the number of a piece that is a part of another.
PIECE = 1 << 40


class PairIndex:
    """Merge ranks of a byte-level model, and the merging of many words at once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        letters = subwords.byte_letters()
        self.byte_id = np.array([vocab[chr(letters[b])] for b in range(256)], np.int64)
        self.pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        self.rank = {a << BITS | b: r for r, (a, b, _) in reversed([*enumerate(self.pairs)])}
        self.first = np.full((256, 256), -1, np.int64)
        of_byte = {i: b for b, i in enumerate(self.byte_id.tolist())}
        for r, (a, b, _) in enumerate(self.pairs):
            if a in of_byte and b in of_byte:
                self.first[of_byte[a], of_byte[b]] = r

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all words, and how many each word has.  Words are not empty."""
        raw = np.frombuffer(b"".join(words), np.uint8)
        n = len(raw)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        after = np.arange(1, n + 1)
        after[ends - 1] = -1
        before = np.arange(-1, n - 1)
        before[np.concatenate([[0], ends[:-1]])] = -1
        rank = np.where(after[:-1] >= 0, self.first[raw[:-1], raw[1:]], -1)
        place = np.flatnonzero(rank >= 0)
        place = place[np.argsort(rank[place], kind="stable")]
        active, starts = np.unique(rank[place], return_index=True)
        index = dict(zip(active.tolist(), (x.tolist() for x in np.split(place, starts[1:])), strict=True)) if len(place) else {}
        symbols = self._merge(self.byte_id[raw].tolist(), after.tolist(), before.tolist(), index)
        found = np.array(symbols, np.int64)
        stay = found >= 0
        return found[stay].astype(np.uint32), np.add.reduceat(stay, np.concatenate([[0], ends[:-1]]), dtype=np.int64)

    def _merge(self, symbols: list[int], after: list[int], before: list[int], index: dict[int, list[int]]) -> list[int]:
        rank_of, pairs, turns = self.rank.get, self.pairs, list(index)
        heapify(turns)
        while turns:
            rank = heappop(turns)
            left, right, new = pairs[rank]
            for at in sorted(index.pop(rank)):
                if symbols[at] != left or (other := after[at]) < 0 or symbols[other] != right:
                    continue
                symbols[at], symbols[other] = new, -1
                after[at] = beyond = after[other]
                if beyond >= 0:
                    before[beyond] = at
                    if (made := rank_of(new << BITS | symbols[beyond])) is not None:
                        if made in index:
                            index[made].append(at)
                        else:
                            index[made] = [at]
                            heappush(turns, made)
                if (ahead := before[at]) >= 0 and (made := rank_of(symbols[ahead] << BITS | new)) is not None:
                    if made in index:
                        index[made].append(ahead)
                    else:
                        index[made] = [ahead]
                        heappush(turns, made)
        return symbols


class Encoder(dict):
    """Piece of a text -> its number; a piece that starts a text is kept under a line end and itself, any other without its space.

    A new piece gets the next number when it is first looked up, and its ids
    when all pieces of a block are known, so new words are indexed together.
    """

    def __init__(self, path: str):
        self.tokenizer = subwords.load(path)
        self.index = PairIndex(path)
        self.added = {x.content: i for i, x in self.tokenizer.get_added_tokens_decoder().items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self._forget()

    def _forget(self) -> None:
        self.clear()
        self.words: dict[bytes, int] = {}
        self.rows = subwords.Ragged()
        #: The row of each piece's ids, by the piece's number.
        self.row = array("q")
        self.new: list[str] = []
        self.numbers = 0

    def __missing__(self, piece: str) -> int:
        number = self[piece] = self.numbers
        self.numbers += 1
        self.new.append(piece)
        return number

    def _split(self, piece: str) -> list[bytes | int]:
        """The words of a piece in UTF-8, and the ids of added tokens in it."""
        text = piece[1:] if piece[0] == "\n" else " " + piece
        out: list[bytes | int] = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.added:
                out.append(self.added[part])
            elif part:
                out += [part[a:b].encode() for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(part)]
        return out

    def _learn(self) -> None:
        """Give all new pieces their ids; a piece of several words takes those of other pieces."""
        fresh: list[bytes] = []
        joined: list[tuple[int, list[int]]] = []
        size = 0

        def row(word: bytes) -> int:
            nonlocal size
            fresh.append(word)
            size += len(word)
            return len(self.rows) + len(fresh) - 1

        def part(word: bytes | int) -> int:
            """The row of a word, or PIECE and a piece's number, or -1 and less for an id."""
            if isinstance(word, int):
                return -1 - word
            text = word.decode()
            if text[0] == " " and subwords.is_plain(text[1:]):
                return PIECE + self[text[1:]]
            if word not in self.words:
                self.words[word] = row(word)
            return self.words[word]

        # Pieces that others are made of come to the end of the list while it is gone through.
        for piece in self.new:
            if subwords.is_plain(piece):
                self.row.append(row(b" " + piece.encode()))
            else:
                mark = subwords.ends_in_mark(piece) and subwords.is_plain(piece[:-1])
                joined.append((len(self.row), [part(x) for x in ([b" " + piece[:-1].encode(), piece[-1].encode()] if mark else self._split(piece))]))
                self.row.append(-1)
            if size >= INDEXED:
                self._index(fresh)
                size = 0
        self._index(fresh)
        rows, flat, ends = self.rows, self.rows.flat, self.rows.ends
        for number, parts in joined:
            whole = array("I")
            for x in parts:
                if x < 0:
                    whole.append(-1 - x)
                else:
                    at = self.row[x - PIECE] if x >= PIECE else x
                    whole += flat[ends[at] : ends[at + 1]]
            self.row[number] = len(rows)
            rows.append(whole)
        for known in (self, self.words):
            for x in [x for x in (self.new if known is self else known) if len(x) > subwords.LONG]:
                del known[x]
        self.new = []

    def _index(self, fresh: list[bytes]) -> None:
        if fresh:
            ids, sizes = self.index.encode(fresh)
            self.rows.flat.frombytes(ids.astype(np.uint32).tobytes())
            self.rows.ends.frombytes((np.cumsum(sizes) + self.rows.ends[-1]).tobytes())
            fresh.clear()

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, and how many each text has."""
        if len(self.row) > WORDS or len(self.rows.flat) > IDS:
            self._forget()
        pieces = []
        for text in texts:
            own = subwords.spaced_pieces(text) if text else []
            if own:
                own[0] = "\n" + own[0]
            pieces.append(own)
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        number = np.fromiter(map(self.__getitem__, chain.from_iterable(pieces)), np.int64, int(ends[-1]) if len(ends) else 0)
        del pieces
        self._learn()
        if not len(number) or not len(self.rows.flat):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        row = np.array(self.row, np.int64)[number]
        bounds = np.array(self.rows.ends, np.int64)
        starts = bounds[row]
        sizes = bounds[row + 1] - starts
        total = np.concatenate([[0], np.cumsum(sizes)])
        out = np.array(self.rows.flat, np.uint32)[np.arange(int(total[-1])) + np.repeat(starts - total[:-1], sizes)]
        return out, np.diff(total[np.concatenate([[0], ends])])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of a Python worker, which its later tasks find again."""
    return Encoder(path)


@lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id; an id that the model lacks has none."""
    tokenizer = subwords.load(path)
    byte_of = {chr(letter): b for b, letter in subwords.byte_letters().items()}
    known = tokenizer.get_vocab(with_added_tokens=True)
    out = [b""] * (max(known.values()) + 1)
    for token, i in known.items():
        out[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
    return out


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): the ids as little-endian unsigned 32-bit integers, end to end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path)
        for batch in batches:
            at = 0
            for texts in subwords.blocks(x.as_py() for x in batch.column(1)):
                ids, counts = own.ids(texts)
                bounds = np.concatenate([[0], np.cumsum(counts)]).tolist()
                raw = ids.astype("<u4").tobytes()
                packed = [raw[4 * a : 4 * b] for a, b in zip(bounds, bounds[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(counts, pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "n_tokens", "ids"])
                at += len(texts)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """The rows of ``encode`` with their decoded ``text``; ids that the model lacks stand for nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = []
                for ids in part.column(2):
                    known = np.frombuffer(ids.as_buffer(), "<u4")
                    if len(known) and int(known.max()) >= len(table):
                        known = known[known < len(table)]
                    texts.append(b"".join(map(table.__getitem__, known.tolist())).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(3)], pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids", "text"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, text string")
