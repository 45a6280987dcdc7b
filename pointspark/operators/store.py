"""A store of composed scenes that is written chunk by chunk, can be stopped and resumed, and is read by index.

A chunk is a folder of ``chunk_samples`` consecutive scenes.  Chunks are written
in lots, each a Spark job into a folder of its own (``run=``); when the job is
done, its chunks are entered in the manifest, a small table.  Readers see only
chunks of the manifest, so what a stopped job has left is never read, and a run
that starts again composes only the chunks that the manifest lacks.

Chunks need not be of one size.  The index has each chunk's number of samples
and the sum of those before, in order of chunk numbers; a sample's global index
leads to its chunk and position by that sum.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from pointspark.operators.compose import chunk_of
from pointspark.plans.config import ComposeConfig

MANIFEST = "run string, chunk_id long, samples long"
#: Chunks that are written by one job.
LOT = 256
#: Chunks whose sums are taken together.
RANGE = 4096


@dataclass(frozen=True)
class Progress:
    """Where a run is, after a lot: of this run's chunks, and what Spark observed while it wrote them."""

    chunks: int
    chunks_in_all: int
    scenes: int
    points: int
    seconds: float

    @property
    def scenes_a_second(self) -> float:
        return self.scenes / self.seconds if self.seconds else 0.0

    @property
    def seconds_left(self) -> float:
        return self.seconds / self.chunks * (self.chunks_in_all - self.chunks) if self.chunks else float("inf")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(run, chunk_id, samples) of the chunks that are written; of a chunk that two runs have entered, one run's."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)
    return rows.groupBy("chunk_id").agg(F.min_by("samples", "run").alias("samples"), F.min("run").alias("run")).select("run", "chunk_id", "samples")


def lacking(scenes: DataFrame, path: str, config: ComposeConfig) -> DataFrame:
    """(scene_id, chunk_id, position) of the scenes whose chunks are not written yet; position is a scene's place in its chunk."""
    place = F.row_number().over(Window.partitionBy("chunk_id").orderBy("scene_id")) - 1
    own = scenes.select(F.col("scene_id").cast("long").alias("scene_id")).distinct().withColumn("chunk_id", chunk_of("scene_id", config))
    rest = own.join(manifest(scenes.sparkSession, path), "chunk_id", "left_anti")
    return rest.withColumn("position", place).select("scene_id", "chunk_id", "position")


def write_store(
    scenes: DataFrame, compose: Callable[[DataFrame], DataFrame], path: str, config: ComposeConfig, *, lot: int = LOT, told: Callable[[Progress], None] = lambda progress: None
) -> int:
    """Write the chunks of ``scenes`` (scene_id, ...) that the store lacks; returns how many.

    ``compose`` makes the points (scene_id, point_idx, ...) of some of the
    scenes; it is called for each lot with those of the lot's chunks only.  After
    each lot ``told`` gets a Progress, whose counts are observed in the job that
    writes, without a second pass.  What ``told`` raises stops the run there.
    """
    spark = scenes.sparkSession
    rest = lacking(scenes, path, config)
    chunks = rest.groupBy("chunk_id").agg(F.count("*").alias("samples"))
    # Lots are ranges of chunk numbers; their bounds, not the chunks, come to the driver.
    ends = list(_bounds(chunks, lot))
    total = sum(n for *_, n in ends)
    began, done, all_scenes, points = time.perf_counter(), 0, 0, 0
    for low, high, n in ends:
        run = uuid.uuid4().hex
        some = F.col("chunk_id").between(low, high)
        wanted = rest.where(some)
        own = compose(scenes.join(wanted.select("scene_id"), "scene_id", "left_semi")).join(wanted, "scene_id")
        seen = Observation()
        watched = own.observe(seen, F.count("*").alias("points"), F.count_if(F.col("point_idx") == 0).alias("scenes"))
        watched.repartition("chunk_id").write.partitionBy("chunk_id").parquet(f"{path}/run={run}")
        counted = wanted.groupBy("chunk_id").agg(F.count("*").alias("samples")).select(F.lit(run).alias("run"), "chunk_id", "samples")
        counted.coalesce(1).write.mode("append").parquet(f"{path}/manifest")
        found = seen.get
        done, all_scenes, points = done + n, all_scenes + found["scenes"], points + found["points"]
        told(Progress(done, total, all_scenes, points, time.perf_counter() - began))
    return done


def _bounds(chunks: DataFrame, lot: int) -> Iterator[tuple[int, int, int]]:
    """(first, last, how many) chunk numbers of each lot: one row a lot is collected."""
    ranked = prefix_sums(chunks.withColumn("one", F.lit(1).cast("long")), "one")
    found = ranked.groupBy(F.floor(F.col("begins") / lot).alias("lot")).agg(F.min("chunk_id").alias("low"), F.max("chunk_id").alias("high"), F.count("*").alias("n"))
    for r in sorted(found.collect(), key=lambda r: r.low):
        yield r.low, r.high, r.n


def prefix_sums(chunks: DataFrame, value: str) -> DataFrame:
    """``begins``: the sum of ``value`` over all smaller chunk numbers.

    Sums of ranges of numbers come first, then those inside a range; so a window
    sees a range's chunks, or a row for each range.
    """
    ranged = chunks.withColumn("_range", F.floor(F.col("chunk_id") / RANGE))
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("_range").agg(F.sum(value).alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(upto), F.lit(0))).drop("_sum")
    inside = Window.partitionBy("_range").orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return own.join(before, "_range").withColumn("begins", F.col("_before") + F.col("_inside")).drop("_range", "_before", "_inside")


def chunk_index(chunks: DataFrame) -> DataFrame:
    """(chunk_id, samples, begins) of chunks (chunk_id, samples) of any sizes, in order of their numbers."""
    return prefix_sums(chunks.select("chunk_id", "samples"), "samples")


def locate(indices: DataFrame, index: DataFrame, config: ComposeConfig, column: str = "index") -> DataFrame:
    """The indices with chunk_id and position; one beyond the last sample has no row.

    A chunk is entered under each stretch of ``chunk_samples`` indices that it
    reaches into, so the search is an equi-join, checked exactly.
    """
    step = config.chunk_samples
    held = index.where("samples > 0").withColumn("_stretch", F.explode(F.sequence(F.floor(F.col("begins") / step), F.floor((F.col("begins") + F.col("samples") - 1) / step))))
    own = indices.withColumn("_stretch", F.floor(F.col(column) / step))
    inside = (F.col(column) >= F.col("begins")) & (F.col(column) < F.col("begins") + F.col("samples"))
    met = own.join(held, "_stretch").where(inside)
    return met.select(*[F.col(c) for c in indices.columns], "chunk_id", (F.col(column) - F.col("begins")).alias("position"))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The points of all chunks of the manifest, with chunk_id and position."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/run=*") if not manifest(spark, path).isEmpty() else None
    if rows is None:
        raise ValueError("the store has no chunks yet")
    return rows.join(manifest(spark, path).select("run", "chunk_id"), ["run", "chunk_id"], "left_semi").drop("run")


def read_sample(spark: SparkSession, path: str, index: int, config: ComposeConfig) -> DataFrame:
    """One scene by its global index: the index leads to its folder, a pushed filter to its rows."""
    known = manifest(spark, path)
    one = spark.createDataFrame([(index,)], "index long")
    found = locate(one, chunk_index(known), config).join(known.select("chunk_id", "run"), "chunk_id").first()
    if found is None:
        raise IndexError(index)
    return spark.read.parquet(f"{path}/run={found.run}/chunk_id={found.chunk_id}").where(F.col("position") == found.position)
