"""Projections and filters of point tables (key columns, x, y, z, r, g, b)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointspark.functions.columns import finite

AXES = ("x", "y", "z")
COLOURS = ("r", "g", "b")


def orientation_fix(points: DataFrame) -> DataFrame:
    """Half a turn about x; adding 0.0 avoids negative zeros."""
    return points.withColumns({"y": -F.col("y") + F.lit(0.0), "z": -F.col("z") + F.lit(0.0)})


def nan_to_num(points: DataFrame, columns=AXES) -> DataFrame:
    return points.withColumns({c: finite(F.col(c)) for c in columns})


def drop_nan(points: DataFrame) -> DataFrame:
    return points.where(~(F.isnan("x") | F.isnan("y") | F.isnan("z")))


def default_colours(points: DataFrame, grey: float = 0.5) -> DataFrame:
    return points.withColumns({c: F.coalesce(c, F.lit(grey)) for c in COLOURS})


def feature_fallback(points: DataFrame, names=("f0", "f1", "f2")) -> DataFrame:
    """Features are colours, and the coordinates of points without any."""
    bare = F.col("r").isNull() & F.col("g").isNull() & F.col("b").isNull()
    return points.withColumns({n: F.when(bare, F.col(a)).otherwise(F.col(c)) for n, a, c in zip(names, AXES, COLOURS, strict=True)})


def width_fix(rows: DataFrame, column: str = "features", width: int = 3) -> DataFrame:
    """An array of features cut to ``width``, or filled up with zeros; null is all zeros."""
    own = F.coalesce(F.col(column).cast("array<double>"), F.array().cast("array<double>"))
    return rows.withColumn(column, F.slice(F.concat(own, F.array_repeat(F.lit(0.0), width)), 1, width))


def nan_count(points: DataFrame, keys: list[str], columns=AXES) -> DataFrame:
    """(keys, nan_cells): how many cells, not rows, are NaN."""
    return points.groupBy(*keys).agg(F.sum(sum((F.isnan(c).cast("long") for c in columns[1:]), F.isnan(columns[0]).cast("long"))).alias("nan_cells"))


def box_filter(points: DataFrame, low, high) -> DataFrame:
    """Points in a box, its faces included; plain comparisons reach the scan as pushed filters."""
    keep = F.lit(True)
    for axis, a, b in zip(AXES, low, high, strict=True):
        keep = keep & F.col(axis).between(a, b)
    return points.where(keep)


def feature_scale(points: DataFrame, keys: list[str]) -> DataFrame:
    """Divide colours by 255 in the groups whose largest value is above 1.

    The maxima are aggregated and joined back, so a large group is never one
    task's; NaN does not count as large.
    """
    top = F.greatest(*[F.when(~F.isnan(c), F.col(c)) for c in COLOURS])
    most = points.groupBy(*keys).agg(F.max(top).alias("_most"))
    by = F.when(F.col("_most") > 1.0, 255.0).otherwise(1.0)
    return points.join(most, keys).withColumns({c: F.col(c) / by for c in COLOURS}).drop("_most")


#: The mean of a group on each axis, and its largest distance from it on any.
FRAME = (*[f"_m{a}" for a in AXES], "_far")


def frames(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ``FRAME``): one aggregation gives mean, least and largest; the largest distance from the mean follows from them."""
    stats = points.groupBy(*keys).agg(
        *[F.avg(a).alias(f"_m{a}") for a in AXES], *[F.min(a).alias(f"_l{a}") for a in AXES], *[F.max(a).alias(f"_h{a}") for a in AXES]
    )
    far = F.greatest(*[F.abs(F.col(f"_{s}{a}") - F.col(f"_m{a}")) for a in AXES for s in "lh"])
    return stats.select(*keys, *[f"_m{a}" for a in AXES], far.alias("_far"))


def in_frame(axis: str, frame: Callable[[str], Column], scale: float) -> Column:
    """A coordinate centred on its group's mean and divided by the largest distance, times ``scale``; ``frame`` gives what ``FRAME`` names."""
    return (F.col(axis) - frame(f"_m{axis}")) / (frame("_far") + 1e-6) * scale


def normalize(points: DataFrame, keys: list[str], scale: float) -> DataFrame:
    """Centre each group on its mean and divide by its largest absolute coordinate, times ``scale``."""
    return points.join(frames(points, keys), keys).withColumns({a: in_frame(a, F.col, scale) for a in AXES}).drop(*FRAME)


def zip_truncate(left: DataFrame, right: DataFrame, keys: list[str], index: str = "idx") -> DataFrame:
    """Rows that both sides have at an index: the longer side is cut."""
    return left.join(right, [*keys, index])
