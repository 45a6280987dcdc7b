"""Ranked lexical search with per-term geometric blocking.

Documents become vectors of integer impacts over the terms of a block of
queries, and are dealt into segments of bounded size.  A segment holds, for each
term, a posting list that is cut into blocks of similar documents: the list's
documents are assigned to the nearest of a few of their own by a projection of
their vectors.  Each block has a summary, the coordinatewise maximum of its
documents' vectors.  A segment is built and searched in one task, as the vectors
are of one block of queries; only the k best of each query leave it.

Terms are numbered from the heaviest (rarest) to the lightest.  A query goes
through its lists in that order, so what is in a list and was not met before has
no earlier term of the query; the summary of a block of term t covers t and the
terms after it, and its inner product with the query is an exact upper bound of
the scores that the block can still bring.  A block is passed over only if this
bound is below the score of the k-th document so far; equal bounds are looked
at, as ties go by document id.  Documents that are met get their full score, so
the k best of each segment, and of all, are exact.

Terms are maximal runs of ASCII letters, digits and all characters beyond ASCII,
with A-Z in lower case.

Defined results: null and termless texts are no documents of the statistics and
are never found; queries without terms find nothing; repeated rows of documents
are documents of their own with ranks of their own; repeated rows of queries
count once; a null document id ranks behind all others of the same score (as
does the largest possible id, which comes back as null); an empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointspark.llm import subwords
from pointspark.llm.common import row_key, save

TOP = 10
#: Documents of a block, on average, and most of a segment.
BLOCK, SEGMENT = 64, 8_192
#: Terms of the queries that are searched together; a query with more is searched alone.
QUERY_TERMS = 65_536
#: Coordinates of the projection by which documents are compared.
SKETCH = 16
SEED = 42
#: Cells of summaries that are built together.
CELLS = 2_000_000
#: Blocks that are scored before the bound is looked at again.
STEP = 8
NO_ID = 2**63 - 1

_TABLE = bytearray(b" " * 128 + bytes(range(128, 256)))
for _b in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _TABLE[_b] = _b
for _b in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _TABLE[_b] = _b + 32
_TABLE = bytes(_TABLE)


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in UTF-8."""
    return (text or "").encode().translate(_TABLE).split()


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of rows that begin at ``starts`` with ``sizes``, end to end."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def query_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, item_id, block, term): the distinct terms of distinct queries, in blocks of about QUERY_TERMS."""
    rows = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).withColumn("item", row_key("item_id", "text")).dropDuplicates(["item"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(terms(x.as_py()))) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.binary()))], ["item", "item_id", "terms"])

    own = save(rows.select("item", "item_id", "text").mapInArrow(split, "item string, item_id long, terms array<binary>").where(F.size("terms") > 0), "query-terms")
    total = own.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-total // QUERY_TERMS))
    return own.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int")).select("item", "item_id", "block", F.explode("terms").alias("term"))


def count_terms(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """(doc_id, place, n, terms, counts): how often each document of rows (doc_id, text) holds terms of the vocabulary; n is of all its terms."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # at most QUERY_TERMS, or one query's

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, place = {t: i for i, t in enumerate(shared.value)}, 0
        size = max(1, len(number))
        for batch in batches:
            at = 0
            for texts in subwords.blocks(x.as_py() for x in batch.column(1)):
                found = [terms(x) for x in texts]
                n = np.fromiter(map(len, found), np.int64, len(found))
                own = np.concatenate([np.fromiter((number.get(t, -1) for t in x), np.int64, len(x)) for x in found])
                cell = (np.repeat(np.arange(len(found)), n) * size + own)[own >= 0]
                cell, count = np.unique(cell, return_counts=True)
                ends = pa.array(np.searchsorted(cell, np.arange(len(found) + 1) * size), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (cell % size, count)]
                places = pa.array(np.arange(place, place + len(found)), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(found)), places, pa.array(n, pa.int64()), *lists], ["doc_id", "place", "n", "terms", "counts"])
                at, place = at + len(found), place + len(found)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, place long, n long, terms array<int>, counts array<int>")


def blocks_of(sketch: np.ndarray) -> np.ndarray:
    """The block of each document of a posting list, by the nearest of some of them; blocks much larger than the others are cut."""
    n = len(sketch)
    wanted = -(-n // BLOCK)
    if wanted == 1:
        return np.zeros(n, np.int64)
    centres = sketch[np.arange(wanted) * n // wanted]
    nearest = np.argmax(sketch @ centres.T, axis=1)
    order = np.argsort(nearest, kind="stable")
    first = np.searchsorted(nearest[order], nearest[order])
    part = np.empty(n, np.int64)
    part[order] = (np.arange(n) - first) // (2 * BLOCK)
    return np.unique(nearest * (n + 1) + part, return_inverse=True)[1]


def build_segment(ids: np.ndarray, ends: np.ndarray, term: np.ndarray, impact: np.ndarray) -> dict[str, np.ndarray]:
    """The arrays of a segment of documents whose vectors are (term, impact), terms ascending, up to ``ends``.

    ``lists`` has the terms; list i has the blocks from ``list_blocks[i]`` to the
    next; a block's documents are ``members`` and its summary ``summary_terms``
    and ``summary_most``, each up to the block's end.
    """
    starts = ends - np.diff(ends, prepend=0)
    doc = np.repeat(np.arange(len(ids)), ends - starts)
    size = int(term.max(initial=-1)) + 1
    axes = np.random.default_rng(SEED).standard_normal((size, SKETCH), np.float32)
    sketch = np.zeros((len(ids), SKETCH), np.float32)
    for i in range(SKETCH):
        sketch[:, i] = np.bincount(doc, impact * axes[term, i], len(ids))
    sketch /= np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-9)
    order = np.argsort(term, kind="stable")
    lists, list_starts = np.unique(term[order], return_index=True)
    list_ends = np.append(list_starts[1:], len(order))
    out = {k: [] for k in ("block_ends", "members", "summary_ends", "summary_terms", "summary_most")}
    n_blocks, n_members, n_summary = [0], 0, 0
    for t, a, b in zip(lists.tolist(), list_starts.tolist(), list_ends.tolist(), strict=True):
        entry = order[a:b]  # places of the term in the vectors; the list's documents
        block = blocks_of(sketch[doc[entry]])
        entry, block = entry[o := np.argsort(block, kind="stable")], block[o]
        number = int(block[-1]) + 1
        out["members"].append(doc[entry])
        out["block_ends"].append(n_members + np.searchsorted(block, np.arange(number), "right"))
        n_members += len(entry)
        n_blocks.append(n_blocks[-1] + number)
        width = size - t
        at_once = max(1, CELLS // width)
        for low in range(0, number, at_once):
            x, y = np.searchsorted(block, [low, low + at_once])
            sizes = ends[doc[entry[x:y]]] - entry[x:y]
            tail = ragged(entry[x:y], sizes)  # from the term to the vector's end
            most = np.zeros(min(at_once, number - low) * width, np.int64)
            np.maximum.at(most, np.repeat(block[x:y] - low, sizes) * width + term[tail] - t, impact[tail] + 1)
            cell = np.flatnonzero(most)
            out["summary_terms"].append(cell % width + t)
            out["summary_most"].append(most[cell] - 1)
            out["summary_ends"].append(n_summary + np.searchsorted(cell, (np.arange(len(most) // width) + 1) * width))
            n_summary += len(cell)
    joined = {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}
    return joined | {"ids": ids, "row_ends": ends, "terms": term, "impacts": impact, "lists": lists, "list_blocks": np.array(n_blocks)}


class Segment:
    """A segment's arrays, and the search in it."""

    def __init__(self, columns: dict[str, np.ndarray], n_terms: int):
        self.__dict__.update(columns)
        self.row_starts = self.row_ends - np.diff(self.row_ends, prepend=0)
        self.block_starts = self.block_ends - np.diff(self.block_ends, prepend=0)
        self.summary_starts = self.summary_ends - np.diff(self.summary_ends, prepend=0)
        self.list_of = np.full(n_terms, -1)
        self.list_of[self.lists] = np.arange(len(self.lists))
        self.asked = np.zeros(n_terms, np.int64)
        self.scored = self.looked_at = 0

    def scores(self, docs: np.ndarray) -> np.ndarray:
        sizes = self.row_ends[docs] - self.row_starts[docs]
        at = ragged(self.row_starts[docs], sizes)
        return np.add.reduceat(self.impacts[at] * self.asked[self.terms[at]], np.cumsum(sizes) - sizes)

    def search(self, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k best of a query (ascending term numbers), by score and then id."""
        self.asked[query] = 1
        seen = np.zeros(len(self.ids), bool)
        best, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for t in query.tolist():
            own = self.list_of[t]
            if own < 0:
                continue
            low, high = self.list_blocks[own], self.list_blocks[own + 1]
            x, y = self.summary_starts[low], self.summary_ends[high - 1]
            bound = np.add.reduceat(self.summary_most[x:y] * self.asked[self.summary_terms[x:y]], self.summary_starts[low:high] - x)
            blocks = np.argsort(-bound, kind="stable")
            self.looked_at += len(blocks)
            for at in range(0, len(blocks), STEP):
                some = blocks[at : at + STEP]
                least = score[-1] if len(score) == k else 1
                some = some[bound[some] >= least] + low
                if not len(some):
                    break
                met = self.members[ragged(self.block_starts[some], self.block_ends[some] - self.block_starts[some])]
                met = met[~seen[met]]
                if not len(met):
                    continue
                seen[met] = True
                self.scored += len(met)
                new = self.scores(met)
                good = new >= least
                best, score = np.concatenate([best, met[good]]), np.concatenate([score, new[good]])
                order = np.lexsort((best, -score))[:k]  # documents are numbered by id
                best, score = best[order], score[order]
        self.asked[query] = 0
        return best, score


def search_segments(vectors: DataFrame, queries: list[np.ndarray], weights: np.ndarray, number: np.ndarray, n: int, length: int, segments: int, k: int) -> DataFrame:
    """(query, doc_id, score): the k best of each segment of the rows of ``count_terms`` for each query.

    ``number`` gives a term its place from heaviest to lightest; ``weights`` and
    ``queries`` have these places.
    """
    shared = vectors.sparkSession.sparkContext.broadcast((weights, number, queries))

    def run(table: pa.Table) -> pa.Table:
        weight, renumber, asked = shared.value
        ids = table["doc_id"].combine_chunks().fill_null(NO_ID).to_numpy()
        order = np.lexsort((table["place"].to_numpy(), ids))
        table, ids = table.take(pa.array(order)).combine_chunks(), ids[order]
        lists, counts = table["terms"].combine_chunks(), table["counts"].combine_chunks()
        sizes = lists.value_lengths().to_numpy()
        doc = np.repeat(np.arange(len(ids)), sizes)
        term = renumber[lists.flatten().to_numpy()]
        count = counts.flatten().to_numpy().astype(np.int64)
        damp = 100 - 90 + 90 * table["n"].to_numpy() * n // length
        impact = weight[term] * (1_000_000_000 * count // (1000 * count + 8 * damp[doc]))
        order = np.lexsort((term, doc))
        segment = Segment(build_segment(ids, np.cumsum(sizes, dtype=np.int64), term[order], impact[order]), len(weight))
        found = [segment.search(q, k) for q in asked]
        query = np.repeat(np.arange(len(found)), [len(d) for d, _ in found])
        docs, score = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"query": pa.array(query, pa.int32()), "doc_id": pa.array(ids[docs]), "score": pa.array(score)})

    segment = F.pmod(F.xxhash64("doc_id", "place"), F.lit(segments)).cast("int")
    held = vectors.where(F.size("terms") > 0).select("doc_id", "place", "n", "terms", "counts", segment.alias("segment"))
    return held.groupBy("segment").applyInArrow(run, "query int, doc_id long, score long")


def search(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, k: int = TOP
) -> DataFrame:
    """(item, item_id, rank, doc_id, score): the k documents of highest score above 0 for each query; item is ``row_key`` of the query."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    asked = save(query_terms(items, item_col, item_text_col), "queries")
    found = None
    for b in sorted(r.block for r in asked.select("block").distinct().collect()):
        own = asked.where(F.col("block") == b).select("item", "item_id", "term").collect()  # about QUERY_TERMS rows
        vocabulary = sorted({bytes(r.term) for r in own})
        vectors = save(count_terms(rows, vocabulary), "vectors")
        n_rows, n, length = vectors.agg(F.count("*"), F.count_if(F.col("n") > 0), F.sum("n")).first()
        if not length:
            continue
        held = dict(vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect())
        weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * held.get(i, 0) + 1))) for i in range(len(vocabulary))], np.int64)
        order = np.argsort(-weight, kind="stable")
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        segments = max(-(-n_rows // SEGMENT), min(parts, -(-n_rows * 8 // SEGMENT)))
        place, queries = {t: int(number[i]) for i, t in enumerate(vocabulary)}, {}
        for r in own:
            queries.setdefault((r.item, r.item_id), []).append(place[bytes(r.term)])
        names = [(i, *name) for i, name in enumerate(queries)]
        best = search_segments(vectors, [np.array(sorted(q)) for q in queries.values()], weight[order], number, n, length, segments, k)
        named = best.join(F.broadcast(spark.createDataFrame(names, "query int, item string, item_id long")), "query")
        found = named if found is None else found.unionByName(named)
    if found is None:
        return spark.createDataFrame([], "item string, item_id long, rank int, doc_id long, score long")
    # Spark keeps the k best of each task before rows are moved.
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
    top = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return top.select("item", "item_id", "rank", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score")
