"""Benchmark decontamination: size-partitioned MinHash containment search.

A test item is found in a document if at least ``percent`` per cent of the
item's distinct word shingles are among the document's.  Items are partitioned
by their number of shingles in powers of two.  The items of a partition have
bottom-k MinHash signatures, with k one more than the shingles that an item of
the partition's upper size may miss; so by the pigeonhole principle a document
that holds an item holds a shingle of its signature, whatever the document's
length.  Shingles that more than ``COMMON`` items have, such as a template's,
come last in a signature, so they are in it only where an item has hardly any
others.  Documents are probed whole for signature values, through a bitmap of
fixed size; a document meets an item if it has as many values of its signature
as it must, which is at least k less what the item may miss, and what meets is
verified by exact shingle containment.  The items that a document meets are
dealt over rows of bounded size.

Words are runs of ASCII letters, digits, ``_`` and all characters beyond
ASCII, of the text in lower case.  An item of fewer words than a shingle is
one shingle of that many words, and is found as that sequence.

Defined results: null and wordless texts are never found and hold nothing;
null ids are kept; repeated rows of documents or items count once; an empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointspark.llm.common import row_key, save

SHINGLE = 5
PERCENT = 80
#: Items that a shingle is in before signatures avoid it.
COMMON = 20
#: Items that are checked against a document at a time, on average.
TOGETHER = 200
#: Bits of the signature bitmap; its size does not depend on the items.
BITMAP_BITS = 26
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNDO = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WORDS = re.compile(r"[a-z0-9_\u0080-\U0010ffff]+")
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*b"abcdefghijklmnopqrstuvwxyz0123456789_", *range(128, 256)]] = True


def words(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


def shingle_strings(text: str | None, size: int) -> set[str]:
    found = words(text)
    return {" ".join(found[i : i + size]) for i in range(len(found) - size + 1)}


_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        grown = max(n, 65_536)
        _powers = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(grown, b)]), dtype=np.uint64) for b in (_BASE, _UNDO))
    return _powers


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(32)


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word, from one prefix sum over the text's bytes."""
    raw = np.frombuffer((text or "").lower().encode(), np.uint8)
    inside = np.concatenate([[False], _IS_WORD[raw], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    power, undo = _power(len(raw) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((raw + np.uint64(1)) * power[: len(raw)], dtype=np.uint64)])
    return _mix((sums[end] - sums[start]) * undo[start])


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, np.uint64(size))
    for i in range(size):
        total = total * _BASE + hashes[i : i + n]
    return _mix(total)


def missable(size: int, percent: int) -> int:
    """How many of ``size`` shingles may be missing."""
    return size - -(-percent * size // 100)


def item_shingles(items: DataFrame, shingle: int) -> DataFrame:
    """(item, width, size, upper, hashes) for rows (item, text): the words in a shingle, the distinct shingles, the upper size of their partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = word_hashes(text.as_py())
                if width := min(shingle, len(own)):
                    found = np.unique(shingle_hashes(own, width)).view(np.int64)
                    out.append((item, width, len(found), (1 << len(found).bit_length()) - 1, found))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["item", "width", "size", "upper", "hashes"])

    return items.select("item", "text").mapInArrow(run, "item string, width int, size long, upper long, hashes array<long>")


def missable_column(size, percent: int):
    """``missable`` of a column."""
    return size - F.ceil(size * percent / 100)


def signatures(items: DataFrame, shingle: int, percent: int, common: int = COMMON) -> DataFrame:
    """(item, width, hash, need) for rows (item, text): bottom-k signatures by size partition; a document that holds the item has ``need`` of its values at least."""
    own = save(item_shingles(items, shingle), "item-shingles")
    each = own.select("item", "width", "size", "upper", F.explode("hashes").alias("hash"))
    often = each.groupBy("width", "hash").agg(F.count("*").alias("n")).where(F.col("n") > common).select("width", "hash", F.lit(1).alias("often"))
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.coalesce("often", F.lit(0)), "hash"))
    k = F.least(missable_column(F.col("upper"), percent) + 1, F.col("size"))
    signed = each.join(often, ["width", "hash"], "left").withColumn("place", place).withColumn("k", k).where("place <= k")
    return signed.select("item", "width", "hash", F.greatest(F.col("k") - missable_column(F.col("size"), percent), F.lit(1)).alias("need"))


def _bitmap(signed: DataFrame) -> np.ndarray:
    """Which slots the signatures take: at most 2 ** (BITMAP_BITS - 6) words come to the driver."""
    slot = F.shiftrightunsigned("hash", 64 - BITMAP_BITS)
    word = signed.select(F.shiftrightunsigned(slot, 6).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - BITMAP_BITS}) & 63 as int))").alias("bit"))
    found = word.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    bits = np.zeros(1 << (BITMAP_BITS - 6), np.uint64)
    bits[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return bits


def probe(docs: DataFrame, signed: DataFrame) -> DataFrame:
    """(doc, text, hits) of the rows (doc, text) that hold values of the signatures' slots."""
    spark = docs.sparkSession
    widths = sorted(r.width for r in signed.select("width").distinct().collect())  # at most as many as words in a shingle
    shared = spark.sparkContext.broadcast(_bitmap(signed))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            keep, hits = [], []
            for i, text in enumerate(batch.column(1)):
                own = word_hashes(text.as_py())
                found = np.concatenate([shingle_hashes(own, w) for w in widths]) if widths else np.zeros(0, np.uint64)
                slot = found >> np.uint64(64 - BITMAP_BITS)
                found = found[(bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)]
                if len(found):
                    keep.append(i)
                    hits.append(np.unique(found).view(np.int64))
            taken = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), pa.array(hits, pa.list_(pa.int64()))], ["doc", "text", "hits"])

    return docs.select("doc", "text").mapInArrow(find, "doc string, text string, hits array<long>")


def verify(pairs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(doc, item, shared, size) of the rows (doc, text, items: array of item and text) with enough shingles in common.

    A document's text is split once for each width of shingles among its items.
    """
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64()]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, items in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                found: dict[int, set[str]] = {}
                for item in items:
                    width = min(shingle, len(words(item["text"])))
                    if width not in found:
                        found[width] = shingle_strings(text, width)
                    own = shingle_strings(item["text"], width)
                    shared = len(own & found[width])
                    if 100 * shared >= percent * len(own):
                        out.append((doc, item["item"], shared, len(own)))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc", "item", "shared", "size"])

    return pairs.select("doc", "text", "items").mapInArrow(check, "doc string, item string, shared long, size long")


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    *,
    shingle: int = SHINGLE,
    percent: int = PERCENT,
) -> DataFrame:
    """(doc, doc_id, item_id, shared, size, containment) of each pair found; doc is ``row_key`` of the document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("doc", row_key("doc_id", "text"))
    wanted = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("item_text"))
    wanted = save(wanted.withColumn("item", row_key("item_id", "item_text")).dropDuplicates(["item"]), "items")
    signed = save(signatures(wanted.select("item", F.col("item_text").alias("text")), shingle, percent), "signatures")
    held = save(probe(rows, signed), "probed")
    # A row of ``held`` that repeats a document has the same hits.
    hits = held.select("doc", "hits").dropDuplicates(["doc"]).select("doc", F.explode("hits").alias("hash"))
    met = hits.join(signed.select("hash", "item", "need"), "hash").groupBy("doc", "item").agg(F.count_distinct("hash").alias("n"), F.max("need").alias("need"))
    met = save(met.where(F.col("n") >= F.col("need")).select("doc", "item"), "met")
    # Items that one document meets come together in lots, so its text is moved and split once for each, and no row holds a whole benchmark.
    lots = met.groupBy("doc").agg(F.ceil(F.count("*") / TOGETHER).alias("lots"))
    lot = F.pmod(F.xxhash64("item"), F.col("lots"))
    items_met = met.join(lots, "doc").withColumn("lot", lot).join(wanted.select("item", "item_text"), "item").groupBy("doc", "lot").agg(F.collect_list(F.struct("item", F.col("item_text").alias("text"))).alias("items"))
    pairs = items_met.join(held.select("doc", "text").dropDuplicates(["doc"]), "doc")
    found = save(verify(pairs, shingle, percent), "contaminated")
    named = found.join(rows.select("doc", "doc_id").distinct(), "doc").join(wanted.select("item", "item_id"), "item")
    return named.select("doc", "doc_id", "item_id", "shared", "size", (F.col("shared") / F.col("size")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that hold no item, with the columns that they have."""
    bad = contaminated(docs, items, id_col, text_col).select(F.col("doc").alias("_doc")).distinct()
    key = row_key(F.col(id_col).cast("long"), F.col(text_col))
    return docs.join(bad, key == F.col("_doc"), "left_anti")
