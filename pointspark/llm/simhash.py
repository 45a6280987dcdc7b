"""SimHash near-dedup with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits.  If two
fingerprints differ in at most four bits, the segment with the most differing
bits has at least two of them, so the other two segments differ in at most two
bits each.  The perfect binary Golay code gives a 23-bit word one codeword, and
the codewords of the word and of its neighbours at one bit are one or six keys;
two words at most two bits apart have such a neighbour in common, hence a key.
The pairs of keys of two segments (three ways to choose them) are the join
keys; linked fingerprints meet under at least one.

Documents with equal fingerprints are one row from there on.  What shares a key
is verified by the number of differing bits in the sorted partition, and only a
spanning forest of each bucket's links is emitted, not its pairs.  A key with
more members than a task compares is dealt into blocks, whose pairs are groups
of their own.

Defined results: a null or blank text has fingerprint zero; a null document id
is in its component but never names it, unless all its ids are null; repeated
rows are repeated; an empty table gives an empty result; other columns are not
looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointspark.llm.common import UPPER, save
from pointspark.llm.components import connected_components
from pointspark.llm.similar import similar_duplicates

SHINGLE = 4
SEED = 42
MAX_BITS = 4
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: The generator polynomial of the binary Golay code of length 23.
GENERATOR = 0b110001110101
#: Buckets up to this size compare neighbours at growing distance; larger ones search by frontier.
SMALL = 64
#: Members of one key that a task compares; a key with more is cut into blocks, and each pair of blocks is a group of its own.
HELD = 100_000
#: Bytes of a text that are cut into words at a time.
PIECE = 1 << 20
#: Fingerprints that a task remembers as joined, so that it emits a link once.
REMEMBERED = 1_000_000

_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())


def _word_lists(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text in lists of about PIECE bytes, cut at blanks."""
    at = 0
    while at < len(raw):
        blank = _BLANK.search(raw, at + PIECE)
        end = blank.start() if blank else len(raw)
        yield raw[at:end].translate(_LOWER).split()  # at the blanks of _BLANK
        at = end


def _bit_counts(words: list[bytes], shingle: int) -> tuple[np.ndarray, int]:
    """(how often each bit is set, how many) of the hashes of the shingles of at least ``shingle`` words."""
    runs = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    hashes = np.frombuffer(b"".join(map(xxhash.xxh64_digest, runs, repeat(SEED))), np.uint8).reshape(-1, 8)
    return np.unpackbits(hashes, axis=1).sum(0, dtype=np.int64)[::-1], len(hashes)  # a digest has the highest bit first


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; a long text is gone through by pieces."""
    ones, n, words = np.zeros(64, np.int64), 0, []
    for more in _word_lists((text or "").encode()):
        words += more
        if len(words) >= shingle:
            own, number = _bit_counts(words, shingle)
            ones, n, words = ones + own, n + number, words[len(words) - shingle + 1 :]
    if not n:
        if not words:
            return 0
        ones, n = _bit_counts(words, len(words))
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(x.as_py(), shingle) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


@lru_cache(maxsize=1)
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits, and the error pattern of each syndrome."""

    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - 11)
        return word

    low = np.array([remainder(i) for i in range(1 << 12)])
    high = np.array([remainder(i << 12) for i in range(1 << 11)])
    errors = np.zeros(1 << 11, np.int64)
    for weight in range(4):
        for bits in combinations(range(23), weight):
            pattern = sum(1 << b for b in bits)
            errors[remainder(pattern)] = pattern
    return low, high, errors


def segment_keys(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, how many) of each word: the codeword numbers of it and of its neighbours at one bit, six at most."""
    low, high, errors = _golay()
    flips = np.concatenate([[0], 1 << np.arange(bits)])
    near = words[:, None] ^ flips
    found = (near ^ errors[low[near & 4095] ^ high[near >> 12]]) >> 11
    found.sort(axis=1)
    first = np.ones(found.shape, bool)
    first[:, 1:] = found[:, 1:] != found[:, :-1]
    number = first.sum(1)
    keys = np.zeros((len(words), int(number.max(initial=1))), np.int64)
    row, at = np.nonzero(first)
    keys[row, (np.cumsum(first, 1) - 1)[row, at]] = found[row, at]
    return keys, number


def _segments(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """``segment_keys`` of each segment of unsigned fingerprints."""
    return [segment_keys((fps >> np.uint64(start) & np.uint64((1 << bits) - 1)).astype(np.int64), bits) for start, bits in SEGMENTS]


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) pairs of unsigned fingerprints."""
    parts = _segments(fps)
    keys, rows = [], []
    for table, (x, y) in enumerate(combinations(range(3), 2)):
        (kx, nx), (ky, ny) = parts[x], parts[y]
        for i in range(kx.shape[1]):
            for j in range(ky.shape[1]):
                own = np.flatnonzero((nx > i) & (ny > j))
                keys.append(table << 24 | kx[own, i] << 12 | ky[own, j])
                rows.append(own)
    return np.concatenate(keys), np.concatenate(rows)


class _Joined:
    """Union-find that tells which links join something new; forgets when it is full."""

    def __init__(self) -> None:
        self.above: dict[int, int] = {}

    def find(self, x: int) -> int:
        above = self.above
        while (up := above.get(x, x)) != x:
            above[x] = x = above.get(up, up)
        return x

    def new(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        if len(self.above) > REMEMBERED:
            self.above.clear()
        out = []
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = self.find(x), self.find(y)
            if p != q:
                self.above[max(p, q)] = min(p, q)
                out.append((x, y))
        return out


def _near(a, b) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= MAX_BITS


def forest(members: np.ndarray) -> list[np.ndarray]:
    """A spanning forest (from, to arrays) of one bucket's links."""
    rest, links = members, []
    while len(rest):
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            at = frontier.pop()
            near = _near(rest, at)
            if near.any():
                found, rest = rest[near], rest[~near]
                links.append(np.stack([np.full(len(found), at, np.uint64), found]))
                frontier += found.tolist()
    return links


def bucket_links(batches: Iterator[pa.RecordBatch], most: int = HELD) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) sorted by key -> links (a, b), and the rows (key, fp) of keys with more than ``most`` members as they are."""
    joined = _Joined()
    names = ["a", "b", "again"]

    def rows(pairs: list[tuple[int, int]], again: bool) -> pa.RecordBatch:
        a, b = np.array(pairs, np.uint64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (a, b)] + [pa.array([again] * len(a), pa.bool_())], names)

    def whole(key: np.ndarray, fp: np.ndarray) -> list[tuple[int, int]]:
        """Links of complete buckets."""
        out = []
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(start, len(key)))
        for at, n in zip(start[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
            for a, b in forest(fp[at : at + n]):
                out += joined.new(a, b)
        small = np.repeat(size <= SMALL, size) & np.repeat(size > 1, size)
        key, fp = key[small], fp[small]
        at, d = np.arange(len(key)), 1
        while len(at):
            at = at[at + d < len(key)]
            at = at[key[at] == key[at + d]]
            hit = at[_near(fp[at], fp[at + d])]
            out += joined.new(fp[hit], fp[hit + d])
            d += 1
        return out

    key, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    heavy = None
    for batch in batches:
        key = np.concatenate([key, batch.column(0).to_numpy()])
        fp = np.concatenate([fp, batch.column(1).to_numpy().view(np.uint64)])
        if len(key) and heavy is None:
            cut = int(np.searchsorted(key, key[-1], "left"))
            if cut:
                yield rows(whole(key[:cut], fp[:cut]), False)
                key, fp = key[cut:], fp[cut:]
            heavy = int(key[0]) if len(key) > most else None
        while heavy is not None:
            n = int(np.searchsorted(key, heavy, "right"))
            yield rows([(heavy, x) for x in fp[:n].tolist()], True)
            key, fp = key[n:], fp[n:]
            if not len(key):
                break
            cut = int(np.searchsorted(key, key[-1], "left"))
            yield rows(whole(key[:cut], fp[:cut]), False)
            key, fp = key[cut:], fp[cut:]
            heavy = int(key[0]) if len(key) > most else None
    if len(key):
        yield rows(whole(key, fp), False)


def heavy_links(members: DataFrame, most: int) -> DataFrame:
    """(a, b): links of the members (key, fp) of keys with more than ``most``, by pairs of blocks.

    A key of n members is dealt into blocks of half of ``most``; a member goes to
    each pair that its block is in, so any two meet, and no group has more than
    about ``most``.
    """
    members = save(members, "heavy-keys")
    blocks = save(members.groupBy("key").agg(F.greatest(F.ceil(F.count("*") * 2 / most), F.lit(2)).cast("int").alias("blocks")), "heavy-blocks")
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = members.join(blocks, "key").select("key", "fp", "blocks", block.alias("block"))
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("block"))
    pairs = dealt.select("key", "fp", "block", F.explode(others).alias("other")).select("key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "fp")

    def link(table: pa.Table) -> pa.Table:
        found = forest(np.sort(table["fp"].to_numpy()).view(np.uint64))
        a, b = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.uint64)
        return pa.table([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return pairs.groupBy("key", "x", "y").applyInArrow(link, "a long, b long")


def keyed(fps: DataFrame) -> DataFrame:
    """(key, fp) of each fingerprint (fp) and key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(values), 2000):
                part = values[at : at + 2000]
                key, row = fuzzy_keys(part)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row].view(np.int64))], ["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def crowded_halves(fps: DataFrame, most: int) -> np.ndarray:
    """(3, 4096) booleans: which codewords of each segment more than ``most`` fingerprints have.

    A key is two codewords, so one with more members than ``most`` has two of
    these.  There are 3 * 4096 at most, which tasks add up before any move.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, 4096), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                for i, (keys, number) in enumerate(_segments(batch.column(0).slice(at, 2000).to_numpy().view(np.uint64))):
                    total[i] += np.bincount(keys[np.arange(keys.shape[1]) < number[:, None]], minlength=4096)
        half = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(half), pa.array(total.ravel()[half])], ["half", "n"])

    found = fps.select("fp").mapInArrow(run, "half long, n long").groupBy("half").agg(F.sum("n").alias("n")).where(F.col("n") > most)
    out = np.zeros(3 * 4096, bool)
    out[[r.half for r in found.select("half").collect()]] = True
    return out.reshape(3, 4096)


def heavy_keys(fps: DataFrame, most: int) -> DataFrame | None:
    """(key) of the keys with more than ``most`` members, counted before any member is moved; None if there can be none."""
    halves = crowded_halves(fps, most)
    if not any(halves[x].any() and halves[y].any() for x, y in combinations(range(3), 2)):
        return None
    pairs = list(combinations(range(3), 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                key, _ = fuzzy_keys(batch.column(0).slice(at, 2000).to_numpy().view(np.uint64))
                for table, (x, y) in enumerate(pairs):
                    own = key[key >> 24 == table]
                    own, n = np.unique(own[halves[x][own >> 12 & 4095] & halves[y][own & 4095]], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n.astype(np.int64))], ["key", "n"])

    counted = fps.select("fp").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    found = save(counted.where(F.col("n") > most).select("key"), "heavy-keys")
    return None if found.isEmpty() else found


def fingerprint_links(fps: DataFrame, most: int = HELD) -> DataFrame:
    """(a, b): links of distinct fingerprints (fp) that connect all that differ in at most four bits.

    Keys with more than ``most`` members go another way from the start, so that
    no exchange by key sees them.
    """
    spark = fps.sparkSession
    hot = heavy_keys(fps, most)
    rows, extra = keyed(fps), None
    if hot is not None:
        extra = save(heavy_links(rows.join(hot, "key", "left_semi"), most), "fp-links")
        rows = rows.join(hot, "key", "left_anti")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "key").sortWithinPartitions("key", "fp")
    found = save(dealt.mapInArrow(lambda batches: bucket_links(batches, most), "a long, b long, again boolean"), "fp-links")
    links = found.where("not again").select("a", "b")
    links = links if extra is None else links.union(extra)
    heavy = found.where("again").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    return links if heavy.isEmpty() else links.union(save(heavy_links(heavy, most), "fp-links"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, *, percent: int | None = None) -> DataFrame:
    """(doc_id, fp, fingerprint, component_id) of each row; component_id is the smallest document id reachable over links.

    With ``percent``, documents are linked that have so high a Jaccard
    similarity of shingles, in place of few differing bits: ``similar`` finds
    these, and the result is (doc_id, component_id).
    """
    if percent is not None:
        return similar_duplicates(docs, id_col, text_col, shingle=shingle, percent=percent)
    own = save(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = save(own.groupBy("fp").agg(F.min("doc_id").alias("smallest")), "distinct-fps")
    roots = connected_components(fingerprint_links(distinct))
    classes = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "smallest", F.coalesce("root", "fp").alias("root"))
    # Written tables, so that both sides of each join come from exchanges and a hot root or fingerprint is split.
    smallest = save(classes.groupBy("root").agg(F.min("smallest").alias("component_id")), "smallest")
    named = save(classes.join(smallest, "root").select("fp", "component_id"), "named-fps")
    return own.join(named, "fp").select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
