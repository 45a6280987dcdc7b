"""Overlapping chunk grids and the assignment of points to chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointspark.functions.shared import looked_up
from pointspark.operators.points import AXES, FRAME, frames
from pointspark.plans.config import EvalConfig


def scene_bounds(points: DataFrame, key: str = "scene_id") -> DataFrame:
    return points.groupBy(key).agg(
        F.count("*").alias("n"), *[F.min(a).alias(f"min_{a}") for a in AXES], *[F.max(a).alias(f"max_{a}") for a in AXES]
    )


def scene_density(bounds: DataFrame) -> DataFrame:
    """Volume of the bounding box and points per volume, 1000 for a flat scene."""
    volume = F.lit(1.0)
    for a in AXES:
        volume = volume * (F.col(f"max_{a}") - F.col(f"min_{a}"))
    with_volume = bounds.withColumn("volume", volume)
    return with_volume.withColumn("density", F.when(F.col("volume") > 0, F.col("n") / F.nullif("volume", F.lit(0.0))).otherwise(1000.0))


#: Chunks are at least so far apart, however small or overlapping they are.
LEAST_STEP = 0.01


def chunk_sizes(density: DataFrame, config: EvalConfig) -> DataFrame:
    """The edge of a chunk: that of the configuration if it gives one; what holds about the target number of points, within the profile's bounds; or the profile's fixed one."""
    if config.chunk_size is not None:
        return density.withColumn("size", F.round(F.lit(float(config.chunk_size)), 6))
    size = config.profile.clamp(F.cbrt(config.target_points / F.col("density"))) if config.adaptive else F.lit(config.profile.fixed_chunk)
    return density.withColumn("size", F.round(size, 6))


def axis_steps(sized: DataFrame, config: EvalConfig) -> DataFrame:
    """How many chunk positions each axis has, at most ``max_steps`` if that is set."""
    step = F.greatest(F.col("size") * (1 - config.overlap), F.lit(LEAST_STEP))
    count = {f"k_{a}": F.ceil((F.col(f"max_{a}") - F.col(f"min_{a}")) / step) + 1 for a in AXES}
    if config.max_steps is not None:
        count = {k: F.least(v, F.lit(config.max_steps)) for k, v in count.items()}
    return sized.withColumns({k: v.cast("int") for k, v in count.items()})


def _position(axis: str, index):
    """Where chunk ``index`` of an axis begins: evenly from least to largest, the last exactly at the largest."""
    k, low, high = F.col(f"k_{axis}"), F.col(f"min_{axis}"), F.col(f"max_{axis}")
    return F.when((index == k - 1) & (k > 1), high).otherwise(low + index * (high - low) / F.greatest(k - 1, F.lit(1)))


def chunk_grid(steps: DataFrame) -> DataFrame:
    """A row for each chunk: scene_id, ix, iy, iz, lo_x, lo_y, lo_z, size."""
    grid = steps
    for a in AXES:
        grid = grid.withColumn(f"i{a}", F.explode(F.sequence(F.lit(0), F.col(f"k_{a}") - 1)))
    return grid.select("scene_id", *[f"i{a}" for a in AXES], *[_position(a, F.col(f"i{a}")).alias(f"lo_{a}") for a in AXES], "size")


#: The chunk positions that hold a point, from first to last of each axis.
RANGES = tuple(f"_{end}_{a}" for a in AXES for end in ("first", "last"))


def chunk_ranges(points: DataFrame, steps: DataFrame, how: str = "inner") -> DataFrame:
    """Each point with the chunk positions that hold it (``RANGES``), null on an axis where none does.

    Positions grow evenly with their index, so those that hold a coordinate are
    neighbours, and division tells between which two indices they begin and
    end; which of the two it is, an exact comparison says.  These are plain
    expressions, since functions over arrays are not compiled, and in steps,
    since Java does not compile what is too long.
    """
    gap = {f"_gap_{a}": F.nullif((F.col(f"max_{a}") - F.col(f"min_{a}")) / F.greatest(F.col(f"k_{a}") - 1, F.lit(1)), F.lit(0.0)) for a in AXES}
    own = steps.withColumns(gap).select("scene_id", "size", *[f"{p}_{a}" for p in ("min", "max", "k", "_gap") for a in AXES])
    out = points.join(looked_up(own), "scene_id", how)
    inside = lambda a, i: F.greatest(F.lit(0), F.least(F.col(f"k_{a}") - 1, i)).cast("int")
    near = lambda a, v: F.coalesce(F.floor((v - F.col(f"min_{a}")) / F.col(f"_gap_{a}") + 0.5), F.lit(0))
    at, first, last = ([F.col(p + a) for a in AXES] for p in ("", "_first_", "_last_"))
    size = F.col("size")
    out = out.withColumns({f"_first_{a}": inside(a, near(a, v - size)) for a, v in zip(AXES, at, strict=True)} | {f"_last_{a}": inside(a, near(a, v)) for a, v in zip(AXES, at, strict=True)})
    for a, v, low, high in zip(AXES, at, first, last, strict=True):
        out = out.withColumns({f"_first_{a}": F.when(_position(a, low) + size < v, inside(a, low + 1)).otherwise(low), f"_last_{a}": F.when(_position(a, high) > v, high - 1).otherwise(high)})
    for a, v, low, high in zip(AXES, at, first, last, strict=True):
        held = (low <= high) & (_position(a, high) <= v) & (v <= _position(a, low) + size)
        out = out.withColumns({f"_first_{a}": F.when(held, low), f"_last_{a}": F.when(held, high)})
    return out.select(*points.columns, *RANGES)


def held_by():
    """How many chunks hold a point, as a column; null if none does."""
    count = F.lit(1)
    for a in AXES:
        count = count * (F.col(f"_last_{a}") - F.col(f"_first_{a}") + 1)
    return count


def explode_ranges(ranged: DataFrame) -> DataFrame:
    """Each row once for each chunk of its ranges, as ix, iy and iz.

    An outer generator makes the optimizer infer no filter that finds the ranges again.
    """
    wide = {a: F.col(f"_last_{a}") - F.col(f"_first_{a}") + 1 for a in "yz"}
    i = F.col("_i")
    index = {"ix": F.col("_first_x") + F.floor(i / (wide["y"] * wide["z"])), "iy": F.col("_first_y") + F.floor(i / wide["z"]) % wide["y"], "iz": F.col("_first_z") + i % wide["z"]}
    out = ranged.withColumn("_i", F.explode_outer(F.sequence(F.lit(0), held_by() - 1))).where("_i is not null")
    return out.withColumns({name: v.cast("int") for name, v in index.items()}).drop("_i")


def assign_chunks(points: DataFrame, steps: DataFrame) -> DataFrame:
    """Each point once for each chunk that holds it: its columns, ix, iy and iz.

    No range join and no chunk table: see ``chunk_ranges``.
    """
    return explode_ranges(chunk_ranges(points, steps)).drop(*RANGES)


def chunk_frames(ranged: DataFrame) -> DataFrame:
    """(scene_id, ``RANGES``, chunks): of points in the same chunks, where each of these lies and what its frame is (see ``points.frames``).

    Such points are a small part of all, and their chunks are joined with the
    frames in their place; so no point is repeated to be normalised.
    """
    chunk = ["scene_id", "ix", "iy", "iz"]
    frame = frames(explode_ranges(ranged.select("scene_id", *AXES, *RANGES)), chunk)
    cells = explode_ranges(ranged.select("scene_id", *RANGES).where(" and ".join(f"{r} is not null" for r in RANGES)).distinct())
    both = cells.join(looked_up(frame), chunk)
    each = F.struct("ix", "iy", "iz", *FRAME)
    return both.groupBy("scene_id", *RANGES).agg(F.sort_array(F.collect_list(each)).alias("chunks"))


def with_frames(ranged: DataFrame, how: str) -> DataFrame:
    """Points and the frames of their chunks, in ``chunks``."""
    return ranged.join(looked_up(chunk_frames(ranged)), ["scene_id", *RANGES], how)
