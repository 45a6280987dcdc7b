"""Reproducible randomness: uniforms and ranks from md5 of a seed, a purpose and keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def random_key(seed: int, purpose: str, *ids) -> Column:
    """The md5 of seed:purpose:ids, the same on every engine and for any partitioning."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(purpose), *[F.col(i).cast("string") if isinstance(i, str) else i.cast("string") for i in ids]))


def uniform(seed: int, purpose: str, *ids) -> Column:
    """A number in [0, 1) from the first eight hexadecimal digits of the key."""
    return F.conv(F.substring(random_key(seed, purpose, *ids), 1, 8), 16, 10).cast("double") / 4294967296.0


def uniform_between(low: float, high: float, seed: int, purpose: str, *ids) -> Column:
    return F.lit(low) + uniform(seed, purpose, *ids) * F.lit(high - low)


def random_rank(partition: list, seed: int, purpose: str, *ids) -> Column:
    """1-based position in a random order inside each partition; ties of the key go by ids."""
    order = [random_key(seed, purpose, *ids), *[F.col(i) if isinstance(i, str) else i for i in ids]]
    return F.row_number().over(Window.partitionBy(*partition).orderBy(*order))


#: Ranks up to which Spark limits groups before it moves them (spark.sql.optimizer.windowGroupLimitThreshold).
LIMITED = 1000


def ranked(rows: DataFrame, keys: list[str], seed: int, purpose: str, *ids: str, most: int | None = None) -> DataFrame:
    """The rows with ``_rank``, as ``random_rank``, for groups of any size; with ``most``, only those of rank ``most`` or less.

    A group is dealt into 256 ranges by the first digits of its random keys; a
    row's rank is its position in its range after the sizes of the ranges
    before, of which a window sees 256 a group at most.  So no task sorts a
    whole group, and ranges that begin beyond ``most`` are not sorted at all.

    A small ``most`` needs no ranges: each task keeps the first of its rows of a
    group before they are moved, and one window ranks these.
    """
    if most is not None and most <= LIMITED:
        first = rows.withColumn("_key", random_key(seed, purpose, *ids))
        first = first.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("_key", *ids))).where(F.col("_rank") <= most)
        return first.select(*rows.columns, "_rank")
    keyed = rows.withColumn("_key", random_key(seed, purpose, *ids)).withColumn("_range", F.substring("_key", 1, 2))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = keyed.groupBy(*keys, "_range").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    before = before.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_range").alias("__range"), "_before")
    before = before if most is None else before.where(F.col("_before") < most)
    same = F.col("_range") == F.col("__range")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy("_key", *ids))
    placed = keyed.join(before, same).withColumn("_rank", inside + F.col("_before"))
    return placed.select(*rows.columns, "_rank") if most is None else placed.select(*rows.columns, "_rank").where(F.col("_rank") <= most)
