"""Token counts of whole texts by overlap resynchronisation.

A text longer than ``chunk`` characters is cut into chunks that overlap, which
any task can encode on its own.  Each chunk tells, for the boundaries that it
finds in its two overlaps, how many of its tokens stand before them.  Two
neighbours are spliced at a boundary that both have; what they tell is sorted,
so a junction takes time in proportion to it.  A common boundary is proven
stable: the pattern of a byte-level tokenizer looks at nothing before the place
where a match starts, so from a pre-token boundary that both scans reach they go
on alike; and it must lie ``MARGIN`` characters before the left chunk's end, so
that neither look-ahead nor a special string cut off there matters.

A junction without such a boundary gets an overlap ``WIDEN`` times as wide; where
this would cover the right chunk, the left one takes it in.  Only the chunks on
either side of such junctions are encoded again.

Defined results: a null text has no bytes and no tokens; repeated rows are
repeated; a null id is kept; an empty table gives an empty result; other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointspark.llm import subwords
from pointspark.llm.common import row_key, save

CHUNK = 32_768
OVERLAP = 512
MARGIN = 64
WIDEN = 8
#: Chunks that leave ``cut`` together.
BATCH = 256


def scan(memo: subwords.CountMemo, text: str) -> tuple[np.ndarray, np.ndarray]:
    """(ends, tokens): where each piece of the text ends, and the tokens up to there.

    Ends are pre-token boundaries.  Pieces longer than a word are cut at the
    library's own pre-tokens, unless they hold an added token's string.
    """
    pieces = subwords.spaced_pieces(text)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1
    sizes[0] -= 1
    counts = np.fromiter(map(memo.__getitem__, pieces[1:]), np.int64, len(pieces) - 1)
    counts = np.concatenate([[memo.count(pieces[0]) if pieces[0] else 0], counts])
    ends, totals = np.cumsum(sizes), np.cumsum(counts)
    inner_ends, inner_totals = [], []
    for i in np.flatnonzero(sizes > subwords.LONG).tolist():
        piece = (" " if i else "") + pieces[i]
        if any(x in piece for x in memo.added):
            continue
        words = subwords.pretokens(memo.tokenizer, piece)
        inner = np.array([e for _, (_, e) in words[:-1]], np.int64) + (ends[i] - sizes[i])
        n = np.cumsum([len(memo.tokenizer.model.tokenize(w)) for w, _ in words[:-1]], dtype=np.int64) + (totals[i] - counts[i])
        inner_ends.append(inner)
        inner_totals.append(n)
    ends, totals = np.concatenate([ends, *inner_ends]), np.concatenate([totals, *inner_totals])
    order = np.argsort(ends, kind="stable")
    return ends[order], totals[order]


#: A chunk goes from ``begins`` to ``ends``; ``shared`` characters of it are its predecessor's too; its successor begins at ``next``.
SPAN = "row_key string, begins long, ends long, shared long, next long"
CHUNKS = f"{SPAN}, chunk long, last boolean, text string"
#: What a chunk tells: its tokens, and the boundaries (ascending) in what it shares with either neighbour, with the tokens up to there.
FACTS = f"{SPAN}, tokens long, head_at array<long>, head_n array<long>, tail_at array<long>, tail_n array<long>"


def whole_count(memo: subwords.CountMemo, text: str) -> int:
    pieces = subwords.spaced_pieces(text)
    return (memo.count(pieces[0]) if pieces[0] else 0) + sum(map(memo.__getitem__, pieces[1:]))


def whole_counts(texts: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of texts that are not cut."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = subwords.count_memo(tokenizer_path)
        for batch in batches:
            n = [whole_count(memo, x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.binary_length(batch.column(1)).cast(pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return texts.select("doc_id", "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    names = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, names, strict=True)], [n for n, _ in names])


def chunk_counts(chunks: DataFrame, tokenizer_path: str) -> DataFrame:
    """FACTS of rows of CHUNKS."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = subwords.count_memo(tokenizer_path)
        for batch in batches:
            rows = []
            for key, begins, end, shared, following, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                ends, n = scan(memo, text)
                at = ends + begins
                head = at <= begins + shared
                tail = (at > following) & (at < end - MARGIN) if following is not None else np.zeros(len(at), bool)
                rows.append((key, begins, end, shared, following, int(n[-1]), at[head], n[head], at[tail], n[tail]))
            yield _batch(rows, FACTS)

    return chunks.select(*[x.split()[0] for x in SPAN.split(", ")], "text").mapInArrow(count, FACTS)


def cut(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Rows (row_key, text) into overlapping chunks (CHUNKS), dealt over tasks by text and chunk.

    Each text is gone through once, and its chunks leave in batches, so that no
    more than the text itself is held.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                key, text = key.as_py(), text.as_py()
                begins = list(range(0, max(1, len(text) - overlap), chunk - overlap))
                for at in range(0, len(begins), BATCH):
                    some = zip(begins[at : at + BATCH], [*begins[at + 1 : at + BATCH + 1], *[None] * (at + BATCH >= len(begins))], strict=True)
                    yield _batch([(key, b, min(b + chunk, len(text)), overlap if b else 0, after, at + i, after is None, text[b : b + chunk]) for i, (b, after) in enumerate(some)], CHUNKS)

    return _dealt(texts.select("row_key", "text").mapInArrow(pieces, CHUNKS))


def _dealt(chunks: DataFrame) -> DataFrame:
    return chunks.repartition(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "row_key", "begins")


def junctions(facts: DataFrame) -> DataFrame:
    """(row_key, begins, lost) for each chunk that has a predecessor: the tokens that both count; null without a common boundary.

    Neighbours meet by an equi-join; their sorted boundaries are intersected.
    """
    left = facts.where("next is not null").select("row_key", F.col("next").alias("begins"), "tokens", "tail_at", "tail_n")
    right = facts.where("shared > 0").select("row_key", "begins", "head_at", "head_n")

    def splice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lost = []
            for tokens, *lists in zip(batch.column(2).to_pylist(), *[batch.column(i) for i in range(3, 7)], strict=True):
                tail_at, tail_n, head_at, head_n = (x.values.to_numpy() for x in lists)
                _, i, j = np.intersect1d(tail_at, head_at, return_indices=True)
                lost.append(int(tokens - tail_n[i[0]] + head_n[j[0]]) if len(i) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lost, pa.int64())], ["row_key", "begins", "lost"])

    return left.join(right, ["row_key", "begins"]).select("row_key", "begins", "tokens", "tail_at", "tail_n", "head_at", "head_n").mapInArrow(splice, "row_key string, begins long, lost long")


def widened(spans: list[tuple[int, int, int, bool]]) -> list[tuple[int, int, int, int | None, bool]]:
    """(begins, ends, shared, next, again) of a text's chunks (begins, ends, shared, failed), in order; ``again``: to be encoded again."""
    out: list[list] = []
    for begins, ends, shared, failed in spans:
        again = False
        if failed:
            wide = shared * WIDEN
            out[-1][4] = True
            if begins + wide >= ends:
                out[-1][1] = ends
                continue
            out[-1][1], shared, again = begins + wide, wide, True
        if out:
            out[-1][3] = begins
        out.append([begins, ends, shared, None, again])
    return [tuple(x) for x in out]


def widen(facts: DataFrame, failed: DataFrame) -> DataFrame:
    """Rows of SPAN and ``again`` for all chunks of the texts with a failed junction (row_key, begins); a text's chunks are a few numbers each."""
    own = facts.select("row_key", "begins", "ends", "shared").join(failed.select("row_key").distinct(), "row_key", "left_semi")
    marked = own.join(failed.select("row_key", "begins", F.lit(True).alias("failed")), ["row_key", "begins"], "left").withColumn("failed", F.coalesce("failed", F.lit(False)))

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*[table[c].to_pylist() for c in ("begins", "ends", "shared", "failed")], strict=True))
        found = widened(rows)
        columns = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), [*[pa.int64()] * 4, pa.bool_()], strict=True)]
        return pa.Table.from_arrays([pa.array([table["row_key"][0].as_py()] * len(found), pa.string()), *columns], ["row_key", "begins", "ends", "shared", "next", "again"])

    return marked.select("row_key", "begins", "ends", "shared", "failed").groupBy("row_key").applyInArrow(run, f"{SPAN}, again boolean")


def long_counts(texts: DataFrame, tokenizer_path: str, chunk: int, overlap: int) -> DataFrame:
    """(row_key, n_tokens) of long texts."""
    texts = save(texts, "long-texts")
    facts = save(chunk_counts(cut(texts, chunk, overlap), tokenizer_path), "chunk-counts")
    done = None
    while True:
        met = save(junctions(facts), "junctions")
        failed = save(met.where("lost is null").select("row_key", "begins"), "failed-junctions")
        rest = failed.select("row_key").distinct()
        lost = met.groupBy("row_key").agg(F.sum("lost").alias("lost"))
        good = facts.join(rest, "row_key", "left_anti").groupBy("row_key").agg(F.sum("tokens").alias("tokens")).join(lost, "row_key", "left")
        good = good.select("row_key", (F.col("tokens") - F.coalesce("lost", F.lit(0))).alias("n_tokens"))
        done = good if done is None else done.unionByName(good)
        if failed.isEmpty():
            return done
        spans = save(widen(facts, failed), "spans")
        again = spans.where("again").join(texts, "row_key").withColumn("text", F.substr("text", (F.col("begins") + 1).cast("int"), (F.col("ends") - F.col("begins")).cast("int")))
        told = chunk_counts(_dealt(again), tokenizer_path)
        # The others have told all already; where a chunk was taken in, its place as a neighbour has changed hands.
        names = [x.split()[0] for x in FACTS.split(", ")]
        kept = spans.where("not again").select("row_key", "begins", "ends", "shared", "next").join(facts.select("row_key", "begins", "tokens", "head_at", "head_n", "tail_at", "tail_n"), ["row_key", "begins"])
        facts = save(told.select(*names).unionByName(kept.select(*names)), "chunk-counts")


def count_tokens(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", *, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of each row."""
    if not MARGIN < overlap < chunk:
        raise ValueError("the overlap must be longer than the margin and shorter than a chunk")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = whole_counts(rows.where(F.length("text") <= chunk), tokenizer_path)
    long = rows.where(F.length("text") > chunk).withColumn("row_key", row_key("text"))
    counted = long_counts(long.select("row_key", "text").dropDuplicates(["row_key"]), tokenizer_path, chunk, overlap)
    wide = long.select("doc_id", "row_key", F.octet_length("text").cast("long").alias("n_bytes")).join(counted, "row_key")
    return found.unionByName(wide.select("doc_id", "n_bytes", "n_tokens"))
