"""Near-dedup by verified similarity: MinHash bands find candidates, exact Jaccard of shingles decides.

Words and shingles are those of ``decontaminate``; a text of fewer words than a
shingle is one shingle of all of them.  Documents with equal shingle sets are
one row from there on.  A pair meets if one of ``BANDS`` bands of ``ROWS``
minima is equal, which a pair at exactly 0.8 misses with probability
(1 - 0.8 ** 5) ** 25 = 0.00005, and a more similar one less often.

A bucket's members are first compared with its least and greatest member, which
settles buckets of up to three.  Where the members of a larger one still are in
several components, they are compared with each
other inside a task, which emits a spanning forest, not pairs; a large bucket
is dealt into blocks, whose pairs are groups of their own.  No pair is left
out.  A pair is linked by the 64-bit hashes of its shingles, in exact integers.

This is the way of ``simhash.near_duplicates`` where a similarity is asked
for: at a Jaccard similarity of 0.8 the fingerprints of a pair differ in about
ten bits, so keys that bridge four bits miss most pairs.

Defined results: wordless texts are alike; a null document id is in its
component but never names it, unless all its ids are null; repeated rows are
repeated; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointspark.llm.common import save
from pointspark.llm.components import connected_components
from pointspark.llm.decontaminate import shingle_hashes, word_hashes

SHINGLE = 5
PERCENT = 80
BANDS, ROWS = 25, 5
SEED = 42
#: Hashes of a bucket's sets that one task compares, and sets.
HELD, SETS = 4_000_000, 20_000
#: Members of a bucket whose pairs all have its least or its greatest member, with which all were compared.
SETTLED = 3
#: Shingles that meet all hash functions at a time.
BLOCK = 1024

_rng = np.random.default_rng(SEED)
#: The hash functions are of 32 bits, which processors multiply many at a time; what meets is verified by 64 bits.
_TIMES, _PLUS = (_rng.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32) for _ in range(2))
_TIMES |= np.uint32(1)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    hashes = word_hashes(text)
    return np.unique(shingle_hashes(hashes, min(shingle, len(hashes)))) if len(hashes) else np.zeros(0, np.uint64)


def bands(found: np.ndarray) -> list[int]:
    """A signed 64-bit key of each band; none without shingles."""
    if not len(found):
        return []
    found, least = found.astype(np.uint32), np.full(BANDS * ROWS, np.uint32(2**32 - 1))
    for at in range(0, len(found), BLOCK):
        values = found[at : at + BLOCK] * _TIMES
        values += _PLUS
        np.minimum(least, values.min(1), out=least)
    return [xxhash.xxh64_intdigest(row.tobytes(), i) - (1 << 63) for i, row in enumerate(least.reshape(BANDS, ROWS))]


def sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(doc_id, text, set, size, bands): ``set`` names the set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(x.as_py(), shingle) for x in batch.column(1)]
            names = pa.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) - (1 << 63) for x in found], pa.int64())
            columns = [batch.column(0), batch.column(1), names, pa.array([len(x) for x in found], pa.int64()), pa.array([bands(x) for x in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "set", "size", "bands"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, text string, set long, size long, bands array<long>")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, alike) of each pair; ``sets`` has set and the bytes of its sorted hashes."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = []
            for left, right in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (left, right))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                alike.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(alike, pa.bool_())], ["a", "b", "alike"])

    joined = pairs.join(sets.toDF("a", "left"), "a").join(sets.toDF("b", "right"), "b")
    return joined.select("a", "b", "left", "right").mapInArrow(check, "a long, b long, alike boolean")


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of rows that begin at ``starts`` with ``sizes``, end to end."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def forest(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest, as pairs of places, of the sets (sorted hashes) that are similar.

    With hashes ordered from rare to frequent, two similar sets have one in
    common among the first of each, of which there is one more than a set may
    miss.  An index of these leads from a set to those that it can be similar
    to, and their hashes in common are counted; so a hash that all sets hold
    leads nowhere.
    """
    if not sets:
        return []
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    codes, number = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    rank = np.empty(len(number), np.int64)
    rank[np.argsort(number, kind="stable")] = np.arange(len(number))
    of = np.repeat(np.arange(len(sets)), sizes)
    codes = rank[codes]
    codes = codes[np.lexsort((codes, of))]
    starts = np.cumsum(sizes) - sizes
    first = sizes - -(-percent * sizes // 100) + (sizes > 0)
    entry = _places(starts, first)
    owner = np.repeat(np.arange(len(sets)), first)
    order = np.argsort(codes[entry], kind="stable")
    held, owner = codes[entry][order], owner[order]
    low, high = np.searchsorted(held, np.arange(len(number))), np.searchsorted(held, np.arange(len(number)), "right")
    marked, rest, links = np.zeros(len(number), np.int64), np.ones(len(sets), bool), []
    for root in range(len(sets)):
        if not rest[root]:
            continue
        rest[root] = False
        frontier = [root]
        while frontier:
            at = frontier.pop()
            own = codes[starts[at] : starts[at] + sizes[at]]
            lead = own[: first[at]]
            met = np.unique(owner[_places(low[lead], high[lead] - low[lead])])
            met = met[rest[met]]
            met = met[100 * np.minimum(sizes[met], sizes[at]) >= percent * np.maximum(sizes[met], sizes[at])]
            if not len(met):
                continue
            marked[own] = 1
            shared = np.add.reduceat(marked[codes[_places(starts[met], sizes[met])]], np.cumsum(sizes[met]) - sizes[met])
            marked[own] = 0
            near = met[100 * shared >= percent * (sizes[met] + sizes[at] - shared)]
            rest[near] = False
            links += [(at, i) for i in near.tolist()]
            frontier += near.tolist()
    return links


def bucket_links(rest: DataFrame, sets: DataFrame, percent: int, most: int = HELD, many: int = SETS) -> DataFrame:
    """(a, b): links inside the buckets of rows (key, set, size), no group with much more than ``most`` hashes or ``many`` sets."""
    share = F.greatest(F.sum("size") / most, F.count("*") / many)
    blocks = save(rest.groupBy("key").agg(F.when(share <= 1, 1).otherwise(F.ceil(share * 2)).cast("int").alias("blocks")), "blocks")
    block = F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int")
    dealt = rest.join(blocks, "key").select("key", "set", "blocks", block.alias("block"))
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: (x != F.col("block")) | (F.col("blocks") == 1))
    pairs = dealt.select("key", "set", "block", F.explode(others).alias("other")).select("key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "set")

    def link(table: pa.Table) -> pa.Table:
        names = table["set"].to_numpy()
        found = forest([np.frombuffer(x.as_buffer(), np.uint64) for x in table["hashes"]], percent)
        a, b = np.array(found, np.int64).reshape(-1, 2).T
        return pa.table([pa.array(names[a]), pa.array(names[b])], ["a", "b"])

    return pairs.join(sets, "set").select("key", "x", "y", "set", "hashes").groupBy("key", "x", "y").applyInArrow(link, "a long, b long")


def similar_links(own: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(a, b): links of distinct sets that connect all that are similar, for rows of ``sketches``."""
    keys = save(own.dropDuplicates(["set"]).select("set", "size", F.explode("bands").alias("key")), "bands")
    ends = keys.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("set", "size")).alias("low"), F.max(F.struct("set", "size")).alias("high")).where("n > 1")
    members = save(keys.join(ends, "key"), "members")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(x.as_py(), shingle).tobytes() for x in batch.column(1)], pa.binary())], ["set", "hashes"])

    # Copies are one row before they are moved.
    texts = own.select("set", "text").dropDuplicates(["set"]).join(members.select("set").distinct(), "set", "left_semi")
    sets = save(texts.select("set", "text").mapInArrow(hashed, "set long, hashes binary"), "sets")
    # The smaller of two similar sets has at least ``percent`` of the larger.
    near = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    first = None
    for end in ("low", "high"):
        rows = members.where((F.col("set") != F.col(f"{end}.set")) & near(F.col("size"), F.col(f"{end}.size")))
        rows = rows.select(F.least("set", f"{end}.set").alias("a"), F.greatest("set", f"{end}.set").alias("b"))
        first = rows if first is None else first.union(rows)
    checked = save(verify(first.distinct(), sets, percent), "checked")
    links = checked.where("alike").select("a", "b")
    roots = connected_components(links).withColumnRenamed("node", "set")
    placed = members.where(F.col("n") > SETTLED).select("key", "set", "size").join(roots, "set", "left").withColumn("root", F.coalesce("root", "set"))
    # A bucket of one component has nothing more to tell, nor has one whose pairs all have an end.
    split = placed.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r < s").select("key")
    rest = save(placed.join(split, "key").select("key", "set", "size"), "split")
    return links.union(save(bucket_links(rest, sets, percent), "bucket-links"))


def similar_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, component_id) of each row; component_id is the smallest document id reachable over links."""
    own = save(sketches(docs, id_col, text_col, shingle), "sketches")
    roots = connected_components(similar_links(own, shingle, percent)).withColumnRenamed("node", "set")
    classes = own.groupBy("set").agg(F.min("doc_id").alias("smallest")).join(roots, "set", "left").select("set", "smallest", F.coalesce("root", "set").alias("root"))
    # Written tables, so that both sides of each join come from exchanges and a hot root or set is split.
    smallest = save(classes.groupBy("root").agg(F.min("smallest").alias("component_id")), "smallest")
    named = save(classes.join(smallest, "root").select("set", "component_id"), "named-sets")
    return own.select("doc_id", "set").join(named, "set").select("doc_id", "component_id")
