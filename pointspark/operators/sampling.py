"""Reproducible sampling, padding and splitting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointspark.functions.rng import random_key, ranked
from pointspark.operators.points import AXES, COLOURS


def downsample(points: DataFrame, keys: list[str], n: int, seed: int, index: str = "point_idx") -> DataFrame:
    """At most n random points of each sample, renumbered in random order."""
    placed = ranked(points, keys, seed, "downsample", *keys, index, most=n)
    return placed.withColumn(index, F.col("_rank") - 1).drop("_rank")


def pad_to_n(points: DataFrame, keys: list[str], n: int, index: str = "point_idx") -> DataFrame:
    """Zero points from each sample's size up to n, marked ``is_pad``; larger samples stay as they are."""
    sizes = points.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") < n)
    zeros = {c: F.lit(0.0) for c in (*AXES, *COLOURS) if c in points.columns}
    rest = sizes.withColumn(index, F.explode(F.sequence(F.col("_n"), F.lit(n - 1).cast("long")))).drop("_n").withColumns(zeros)
    return points.withColumn("is_pad", F.lit(False)).unionByName(rest.withColumn("is_pad", F.lit(True)), allowMissingColumns=True)


def top_random(rows: DataFrame, keys: list[str], n: int, seed: int, purpose: str) -> DataFrame:
    """The n rows with the smallest random keys: a distributed top-k, not a full sort."""
    return rows.withColumn("_key", random_key(seed, purpose, *keys)).orderBy("_key", *keys).limit(n).drop("_key")


def subsample_chunks(assigned: DataFrame, n: int, seed: int) -> DataFrame:
    """At most n points of each chunk; points keep their own index, so predictions stay with them."""
    chunk = ["scene_id", "ix", "iy", "iz"]
    return ranked(assigned, chunk, seed, "chunk", *chunk, "point_idx", most=n).drop("_rank")


def train_valid_split(samples: DataFrame, key: str, share_percent: int, seed: int) -> DataFrame:
    """Exactly floor(share * n) samples for training, chosen at random.

    Keys are dealt into 256 groups by their leading digits; counts of the
    groups give each group's first rank, so no task ranks all samples.
    """
    keyed = samples.withColumn("_key", random_key(seed, "split", key)).withColumn("_group", F.substring("_key", 1, 2))
    groups = keyed.groupBy("_group").agg(F.count("*").alias("_n"))
    # 256 groups at most.
    before = groups.alias("a").join(groups.alias("b"), F.col("b._group") < F.col("a._group"), "left")
    before = before.groupBy(F.col("a._group").alias("_group")).agg(F.coalesce(F.sum("b._n"), F.lit(0)).alias("_before"))
    total = groups.agg(F.sum("_n").alias("_total"))
    rank = F.row_number().over(Window.partitionBy("_group").orderBy("_key", key)) + F.col("_before")
    placed = keyed.join(F.broadcast(before), "_group").crossJoin(F.broadcast(total))
    is_train = rank <= F.floor(F.col("_total") * share_percent / 100)
    return placed.withColumn("part", F.when(is_train, "train").otherwise("valid")).select(*samples.columns, "part")
