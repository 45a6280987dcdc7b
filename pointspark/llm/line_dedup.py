"""Line dedup over levelled sorted runs of line hashes.

A run holds the line keys that one batch of documents was the first to have,
with the document that keeps the line and the number of the batch's documents
with it, in buckets by key that are sorted by key.  A batch's keys are written
in the same buckets and matched against the runs by merge joins that read both
sides as they lie, without moving or sorting them: keys that no run has yet
(left anti) are the batch's run; of the others only the count is kept.  Runs are
disjoint.  ``FANOUT`` runs of a level are compacted into one run of the next
level, by merge joins as well.  Batches go from the largest document ids to the
smallest, so the first batch that holds a key holds its largest document id.

Keys are compared by two 64-bit hashes with different seeds (128 bits).

Defined results: a null text is one empty line; a null document id counts as
one document that is smaller than any other; repeated rows of a document id are
one document; an empty table gives an empty result; other columns of the input
are not looked at.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointspark.llm.common import BLANKS, ascii_lower, new_path, save

BATCHES = 4
FANOUT = 2
MIN_CHARS = 20
MIN_DOCS = 3

#: Stands for a null document id inside the runs.
NO_ID = -(2**63)


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def line_hashes(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """A narrow row for each line: doc, text_hash, pos, h1, h2; no hashes where the key is short."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64(text).alias("text_hash"),
        F.posexplode(F.split(text, "\n")).alias("pos", "line"),
    )
    key = line_key(F.col("line"))
    long_key = F.when(F.length(key) >= min_chars, key)
    return lines.select(
        "doc",
        "text_hash",
        "pos",
        F.when(F.length(key) >= min_chars, F.xxhash64(key)).alias("h1"),
        F.when(long_key.isNotNull(), F.xxhash64(F.lit("second"), key)).alias("h2"),
    )


class LineRuns:
    """The levelled runs; ``levels[i]`` lists the runs of level i, ``again`` what later batches add to the counts of their keys.

    Runs are tables in the shared folder with names in the session's catalog,
    which ``close`` takes out.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = []
        self.again: list[DataFrame] = []
        self.names: list[str] = []

    def live(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def merged(self) -> DataFrame | None:
        """Every key with its number of documents and the document that keeps it."""
        runs = self.live()
        if not runs:
            return None
        whole = runs[0]
        for run in [*runs[1:], *self.again]:
            whole = whole.unionByName(run)
        return whole.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper"))

    def batch_keys(self, lines: DataFrame) -> DataFrame:
        """(h1, h2, n, keeper) of a batch of (doc, h1, h2), in sorted buckets."""
        keys = (
            lines.where(F.col("h1").isNotNull())
            .select("h1", "h2", "doc")
            .distinct()
            .groupBy("h1", "h2")
            .agg(F.count("*").alias("n"), F.max("doc").alias("keeper"))
        )
        return self._sorted_run(keys.repartition(self.buckets, "h1", "h2"))

    def fresh(self, keys: DataFrame) -> DataFrame:
        """The keys that no run has."""
        for run in self.live():
            keys = keys.hint("merge").join(run.select("h1", "h2"), ["h1", "h2"], "left_anti")
        return keys

    def add_batch(self, lines: DataFrame) -> DataFrame:
        """Match a batch of (doc, h1, h2) against the runs, add its run, compact; returns the keys that were new."""
        with as_they_lie(self.spark):
            run = keys = self.batch_keys(lines)
            if self.live():
                run = self._sorted_run(self.fresh(keys))
                known = keys.hint("merge").join(run.select("h1", "h2"), ["h1", "h2"], "left_anti")
                self.again.append(save(known.select("h1", "h2", "n", F.lit(None).cast("long").alias("keeper")), "line-counts"))
            self._push(run, 0)
        return run

    def _sorted_run(self, keys: DataFrame) -> DataFrame:
        """Write keys that are dealt by bucket already, a file for each bucket."""
        name = f"pointspark_run_{uuid.uuid4().hex}"
        writer = keys.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("compression", "zstd")
        writer.option("path", new_path(self.spark, "line-run")).saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def _push(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            whole, runs = self.levels[level][0], self.levels[level][1:]
            for other in runs:
                both = whole.hint("merge").join(other.withColumnsRenamed({"n": "n2", "keeper": "keeper2"}), ["h1", "h2"], "full")
                whole = self._sorted_run(both.select("h1", "h2", F.coalesce("n", "n2").alias("n"), F.coalesce("keeper", "keeper2").alias("keeper")))
            self.levels[level] = []
            self._push(whole, level + 1)

    def close(self) -> None:
        """Forget the names; results that are written do not need them."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


@contextmanager
def as_they_lie(spark: SparkSession) -> Iterator[None]:
    """Buckets of one file each are read in the order that they have, which Spark does not rely on by itself."""
    key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def dropped_lines(
    docs: DataFrame, id_col: str, text_col: str, *, min_chars: int, min_docs: int, batches: int, fanout: int
) -> DataFrame:
    """(doc, text_hash, dropped): the positions of the lines that each document loses."""
    shares = [i / batches for i in range(1, batches)]
    cuts = docs.approxQuantile(id_col, shares, 0.01) if shares else []
    batch = F.lit(0)
    for cut in sorted(set(cuts)):
        batch = batch + F.when(F.col("doc") > F.lit(int(cut)), 1).otherwise(0)
    lines = save(line_hashes(docs, id_col, text_col, min_chars).withColumn("batch", batch), "lines")
    runs = LineRuns(docs.sparkSession, fanout)
    for b in range(len(set(cuts)), -1, -1):
        runs.add_batch(lines.where(F.col("batch") == b))
    # A table of its own, so that both sides of the join come from exchanges and a hot line's rows can be split.
    frequent = save(runs.merged().where(F.col("n") >= min_docs).select("h1", "h2", "keeper"), "frequent-lines")
    runs.close()
    lost = lines.where(F.col("h1").isNotNull()).join(frequent, ["h1", "h2"]).where(F.col("doc") != F.col("keeper"))
    return lost.groupBy("doc", "text_hash").agg(F.collect_set("pos").alias("dropped"))


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    batches: int = BATCHES,
    fanout: int = FANOUT,
) -> DataFrame:
    """The input's columns and n_lines, n_dropped and kept (the text that stays).

    A line is dropped if its key has at least ``min_chars`` code points and is
    found in at least ``min_docs`` documents of which this is not the one with
    the largest id.
    """
    lost = dropped_lines(
        docs, id_col, text_col, min_chars=min_chars, min_docs=min_docs, batches=batches, fanout=fanout
    )
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = [F.col(c) for c in docs.columns]
    keyed = docs.select(
        F.struct(*own).alias("_row"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64(text).alias("text_hash"),
    )
    joined = keyed.join(lost, ["doc", "text_hash"], "left")
    lines = F.split(F.coalesce(F.col(f"_row.`{text_col}`"), F.lit("")), "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("dropped"))
    # Bound by an array of one, so that the text is split once and not for each line that stays.
    whole = F.get(F.transform(F.array(lines), lambda own: F.array_join(F.transform(stay, lambda i: F.get(own, i)), "\n")), F.lit(0))
    kept = F.when(F.col("dropped").isNotNull(), whole).otherwise(F.coalesce(F.col(f"_row.`{text_col}`"), F.lit("")))
    return joined.select(
        *[F.col(f"_row.`{c}`").alias(c) for c in docs.columns],
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        kept.alias("kept"),
    )
