"""Packing of samples into chunks and ragged batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointspark.functions.rng import ranked


def shuffle_batches(samples: DataFrame, group: list[str], key: str, size: int, seed: int, epoch: int) -> DataFrame:
    """batch and item numbers in a random order that the epoch changes."""
    numbered = ranked(samples, group, seed, f"epoch{epoch}", key).withColumn("_at", F.col("_rank") - 1)
    return numbered.withColumns({"batch": F.floor(F.col("_at") / size), "item": (F.col("_at") % size).cast("int")}).drop("_at", "_rank")


def batch_offsets(items: DataFrame, keys: list[str]) -> DataFrame:
    """offset: where each item's rows end in its batch."""
    upto = Window.partitionBy(*keys).orderBy("item").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return items.withColumn("offset", F.sum("n").over(upto))


def batch_index(items: DataFrame, keys: list[str], order: str) -> DataFrame:
    return items.withColumn("batch_index", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)


def drop_last(items: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Without the items of batches that are not full."""
    full = items.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") == size).drop("_n")
    return items.join(full, keys, "left_semi")


def chunk_pack(samples: DataFrame, index: str, size: int) -> DataFrame:
    """chunk_id and position of each sample index."""
    return samples.withColumns({"chunk_id": F.floor(F.col(index) / size), "position": F.pmod(F.col(index), F.lit(size))})
