"""Token ids in Huffman-coded block files.

The ids of all documents are counted, a canonical code limited to ``MAX_BITS``
bits is made from the counts by package-merge, and documents are written in
ascending id order in independent blocks.  A block holds whole documents, their
ids' bits, and the bit length of every ``LANE`` ids (checkpoints), so all lanes
of many blocks are decoded side by side by table look-ups.

``path/blocks`` has a row for each block, ``path/codebook`` the code lengths.

Defined results: a null text has the end id alone; a null document id sorts
first; rows that repeat a document id are kept, in the order of their ids'
CRC-32; an empty table gives empty files; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointspark.llm import subwords
from pointspark.llm.common import save

MAX_BITS = 16
BLOCK = 65_536
LANE = 128
#: Ids that are counted together.
COUNTED = 1_000_000


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, crc, ids): ids of whole texts as little-endian unsigned 32- or 16-bit integers, whichever holds the vocabulary."""
    wide = subwords.load(tokenizer_path).get_vocab_size(with_added_tokens=True) > 65_536

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = subwords.id_memo(tokenizer_path)
        end = np.zeros(0, np.uint32) if end_id is None else np.array([end_id], np.uint32)
        for batch in batches:
            n, crc, out = [], [], []
            for texts in subwords.blocks(batch.column(1).to_pylist()):
                ids, sizes = memo.ids([memo.pieces(x) for x in texts])
                at = 0
                for size in sizes.tolist():
                    own = np.concatenate([ids[at : at + size], end])
                    at += size
                    n.append(len(own))
                    crc.append(zlib.crc32(own.astype("<u4").tobytes()))
                    out.append(own.astype("<u4" if wide else "<u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "n", "crc", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(encode, "doc_id long, n long, crc long, ids binary")


def _unpack(n: int, ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4")


def id_counts(tokens: DataFrame) -> DataFrame:
    """(id, n) over all documents: each task adds up its own ids, then the sums are added."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, n_held = np.zeros(0, np.int64), [], 0

        def add() -> None:
            nonlocal total, held, n_held
            found = np.bincount(np.concatenate(held), minlength=len(total))
            found[: len(total)] += total
            total, held, n_held = found, [], 0

        for batch in batches:
            for n, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append(_unpack(n, ids))
                n_held += n
                if n_held > COUNTED:
                    add()
        if held:
            add()
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    return tokens.select("n", "ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` (package-merge); counts are positive."""
    n = len(counts)
    if n > 1 << max_bits:
        raise ValueError(f"{n} ids don't fit into codes of {max_bits} bits")
    if n <= 1:
        return np.ones(n, np.int64)
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.int64)
    level, is_leaf = leaves, []
    for _ in range(max_bits):
        weights = level
        both = np.concatenate([leaves, weights]) if is_leaf else leaves
        rank = np.argsort(both, kind="stable")
        is_leaf.append(rank < n)
        merged = both[rank]
        level = merged[0 : len(merged) // 2 * 2 : 2] + merged[1 : len(merged) // 2 * 2 : 2]
    lengths, need = np.zeros(n, np.int64), 2 * n - 2
    for chosen in reversed(is_leaf):
        own = int(chosen[:need].sum())
        lengths[order[:own]] += 1
        need = 2 * (need - own)
    return lengths


def canonical_codes(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, lengths, codes) in code order: by length, then by id."""
    order = np.lexsort((ids, lengths))
    ids, lengths = ids[order], lengths[order]
    codes, code = np.zeros(len(ids), np.int64), 0
    for i, size in enumerate(lengths.tolist()):
        if i:
            code = (code + 1) << (size - int(lengths[i - 1]))
        codes[i] = code
    return ids, lengths, codes


def pack(ids: np.ndarray, code: np.ndarray, length: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits of ids, most significant first, and the bit length of every LANE ids."""
    size = length[ids]
    ends = np.cumsum(size)
    starts = ends - size
    word = starts >> 5
    placed = code[ids] << (64 - (starts & 31) - size).astype(np.uint64)
    n_words = int(ends[-1] + 31 >> 5) + 1 if len(ids) else 1
    bits = np.zeros(n_words + 1)
    bits[:n_words] += np.bincount(word, (placed >> np.uint64(32)).astype(np.float64), n_words)
    bits[1 : n_words + 1] += np.bincount(word, (placed & np.uint64(0xFFFFFFFF)).astype(np.float64), n_words)
    total = int(ends[-1]) if len(ids) else 0
    data = bits.astype(np.uint64).astype(">u4").tobytes()[: (total + 7) // 8]
    cuts = np.append(ends[LANE - 1 :: LANE], [] if len(ids) % LANE == 0 else ends[-1:]).astype(np.int64)
    return data, np.diff(cuts, prepend=0)


def unpack(blocks: list[tuple[bytes, np.ndarray, int]], table: np.ndarray, max_bits: int) -> list[np.ndarray]:
    """Ids of blocks given as (bits, lane bit lengths, number of ids); all lanes step together."""
    pos, left, base = [], [], 0
    for data, lanes, n in blocks:
        pos.append(np.cumsum(lanes) - lanes + 8 * base)
        left.append(np.minimum(LANE, n - LANE * np.arange(len(lanes))))
        base += len(data)
    raw = np.frombuffer(b"".join(x[0] for x in blocks) + bytes(8), np.uint8).astype(np.uint32)
    window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    pos, left = np.concatenate(pos), np.concatenate(left)
    out = np.zeros((LANE, len(pos)), np.uint32)
    full = bool((left == LANE).all())
    last = 8 * (len(window) - 1)
    for step in range(int(left.max(initial=0))):
        entry = table[window[pos >> 3] >> (32 - max_bits - (pos & 7)).astype(np.uint32) & ((1 << max_bits) - 1)]
        out[step] = entry >> 8
        pos += entry & 255
        if not full:
            np.minimum(pos, last, out=pos)
    lanes = out.T
    found, at = [], 0
    for _, sizes, n in blocks:
        found.append(lanes[at : at + len(sizes)].reshape(-1)[:n])
        at += len(sizes)
    return found


BLOCK_SCHEMA = "part int, block int, before long, doc_ids array<long>, sizes array<long>, lanes binary, bits binary"


def write_ids(tokens: DataFrame, path: str, max_bits: int = MAX_BITS) -> None:
    """Write tokens (doc_id, n, crc, ids) as block files in ascending doc_id order, with their codebook.

    ``tokens`` is read twice, so it should be a saved table.  The counts and the
    codebook are as long as the vocabulary, which is bounded.
    """
    spark = tokens.sparkSession
    counts = id_counts(tokens).toPandas()
    used = counts["id"].to_numpy(np.int64)
    ids, lengths, codes = canonical_codes(used, code_lengths(counts["n"].to_numpy(np.int64), max_bits))
    book = [(int(a), int(b)) for a, b in zip(ids, lengths, strict=True)]
    spark.createDataFrame(book, "id long, length int").coalesce(1).write.parquet(f"{path}/codebook")
    code = np.zeros(int(ids.max(initial=0)) + 1, np.uint64)
    length = np.zeros(len(code), np.int64)
    code[ids], length[ids] = codes, lengths
    shared = spark.sparkContext.broadcast((code, length))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, length = shared.value
        part, number, before = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            nonlocal number, before, held
            data, lanes = pack(np.concatenate([x[2] for x in held]), code, length)
            sizes = [x[1] for x in held]
            row = [part, number, before, [x[0] for x in held], sizes, lanes.astype("<u2").tobytes(), data]
            number, before, held = number + 1, before + sum(sizes), []
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], [x.split()[0] for x in BLOCK_SCHEMA.split(", ")])

        size = 0
        for batch in batches:
            for doc_id, n, ids in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                held.append((doc_id, n, _unpack(n, ids)))
                size += n
                if size >= BLOCK:
                    yield block()
                    size = 0
        if held:
            yield block()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = tokens.repartitionByRange(n, "doc_id", "crc").sortWithinPartitions("doc_id", "crc")
    ordered.select("doc_id", "n", "ids").mapInArrow(encode, BLOCK_SCHEMA).write.option("compression", "none").parquet(f"{path}/blocks")


def decode_table(ids: np.ndarray, lengths: np.ndarray, max_bits: int) -> np.ndarray:
    """For each ``max_bits`` bits: the id that they start with (shifted by 8) and its length."""
    table = np.zeros(1 << max_bits, np.uint32)
    ids, lengths, codes = canonical_codes(ids, lengths)
    first = codes << (max_bits - lengths)
    spans = 1 << (max_bits - lengths)
    at = np.repeat(first - (np.cumsum(spans) - spans), spans) + np.arange(int(spans.sum()))
    table[at] = np.repeat((ids << 8 | lengths).astype(np.uint32), spans)
    return table


def read_ids(spark: SparkSession, path: str, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of each document from its block file; ids as 32-bit integers."""
    book = spark.read.schema("id long, length int").parquet(f"{path}/codebook").toPandas()
    table = decode_table(book["id"].to_numpy(np.int64), book["length"].to_numpy(np.int64), max_bits)
    shared = spark.sparkContext.broadcast(table)
    names = ["part", "doc_id", "local", "n_tokens", "ids_crc32", "ids"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8):
                rows = batch.slice(at, 8).to_pylist()
                found = unpack([(r["bits"], np.frombuffer(r["lanes"], "<u2").astype(np.int64), sum(r["sizes"])) for r in rows], shared.value, max_bits)
                out = []
                for r, ids in zip(rows, found, strict=True):
                    ids, before = ids.astype("<u4"), 0
                    for doc_id, n in zip(r["doc_ids"], r["sizes"], strict=True):
                        own = ids[before : before + n].tobytes()
                        out.append((r["part"], doc_id, r["before"] + before, n, zlib.crc32(own), own))
                        before += n
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    # One row for each part, so the window over all of them is as short as the list of partitions.
    parts = blocks.groupBy("part").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(whole), F.lit(0)).alias("parts_before"))
    docs = blocks.mapInArrow(decode, "part int, doc_id long, local long, n_tokens long, ids_crc32 long, ids binary")
    return docs.join(F.broadcast(parts), "part").select(
        "doc_id", (F.col("parts_before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "ids"
    )


def write_documents(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenize whole texts once into a saved table, then write the block files."""
    write_ids(save(tokenize(docs, tokenizer_path, end_id, id_col, text_col), "ids"), path)
