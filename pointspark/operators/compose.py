"""Synthetic scenes: a target and its aliens, each moved at random."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointspark.functions.columns import affine, rotation
from pointspark.functions.rng import random_key, random_rank, uniform, uniform_between
from pointspark.operators.points import AXES, COLOURS
from pointspark.operators.sampling import top_random
from pointspark.plans.config import ComposeConfig


def aliens_of(objects: DataFrame, target: str) -> DataFrame:
    """All objects but the target."""
    return objects.join(objects.where(F.col("object_id") == target).select("object_id"), "object_id", "left_anti")


def find_object(names: DataFrame, part: str) -> DataFrame:
    """(object_id): the first object whose name holds ``part``; no row if none does."""
    return names.where(F.contains("object_id", F.lit(part))).agg(F.min("object_id").alias("object_id")).where("object_id is not null")


def cache_size(samples: DataFrame, aliens: DataFrame, values: int = 6, width: int = 8) -> DataFrame:
    """(objects, points, megabytes) of the aliens' points with so many values of so many bytes each."""
    own = samples.join(aliens.select("object_id").distinct(), "object_id", "left_semi")
    return own.agg(F.countDistinct("object_id").alias("objects"), F.count("*").alias("points"), (F.count("*") * (values * width) / (1024 * 1024)).alias("megabytes"))


def alien_subset(objects: DataFrame, target: str, config: ComposeConfig, most: int = 10) -> DataFrame:
    """The aliens that scenes may use: ``most`` random ones if there are more."""
    return top_random(aliens_of(objects, target), ["object_id"], max(most, config.aliens), config.seed, "alien_subset")


def augmentations(samples: DataFrame, config: ComposeConfig) -> DataFrame:
    """Each of the first samples once for each transform: scene_id counts them. The transforms are a short range."""
    few = samples.where(F.col("sample_idx") < config.samples)
    each = few.withColumn("transform", F.explode(F.sequence(F.lit(0), F.lit(config.transforms - 1))))
    return each.withColumn("scene_id", F.col("sample_idx").cast("long") * config.transforms + F.col("transform"))


def motion(config: ComposeConfig, *ids) -> tuple[list[list[Column]], list[Column]]:
    """A random rotation (angles in degrees about x, y, z) and translation for the ids."""
    angles = [uniform_between(-config.angle, config.angle, config.seed, f"angle_{a}", *ids) for a in AXES]
    shift = [uniform_between(*bounds, config.seed, f"shift_{a}", *ids) for a, bounds in zip(AXES, config.shift, strict=True)]
    return rotation(*angles), shift


def move(points: DataFrame, config: ComposeConfig, *ids) -> DataFrame:
    matrix, shift = motion(config, *ids)
    return points.withColumns(dict(zip(AXES, affine(matrix, shift, [F.col(a) for a in AXES]), strict=True)))


def scene_slots(scenes: DataFrame, aliens: DataFrame, counts: DataFrame, config: ComposeConfig) -> DataFrame:
    """(scene_id, slot, object_id, sample_idx): slot 0 is the scene's target, the others are aliens.

    With fewer aliens than slots they are taken again in turn.  ``aliens`` and
    ``counts`` (samples of each object) have at most ``most`` of alien_subset
    rows, so they are one short array in every row.
    """
    known = aliens.join(counts, "object_id").agg(F.sort_array(F.collect_list(F.struct("object_id", "n"))).alias("_aliens"))
    return _slots(scenes, scenes.crossJoin(F.broadcast(known)), config)


def scene_slots_of_all(scenes: DataFrame, counts: DataFrame, config: ComposeConfig, most: int = 10) -> DataFrame:
    """``scene_slots`` for scenes of any targets, each with the aliens that ``alien_subset`` has for its target.

    The first ``most`` + 1 objects in random order hold the first ``most`` of
    every target, so one short array serves all scenes.
    """
    most = max(most, config.aliens)
    key = random_key(config.seed, "alien_subset", "object_id")
    first = top_random(counts, ["object_id"], most + 1, config.seed, "alien_subset").select(key.alias("key"), "object_id", "n")
    known = first.agg(F.sort_array(F.collect_list(F.struct("key", "object_id", "n"))).alias("_known"))
    others = F.slice(F.filter("_known", lambda a: a.object_id != F.col("object_id")), 1, most)
    return _slots(scenes, scenes.crossJoin(F.broadcast(known)).withColumn("_aliens", others), config)


def _slots(scenes: DataFrame, known: DataFrame, config: ComposeConfig) -> DataFrame:
    """Slots of ``scenes``; ``known`` has the array _aliens (object_id, n) of each."""
    each = known.where(F.size("_aliens") > 0).select("scene_id", F.explode("_aliens").alias("alien"), F.size("_aliens").alias("_size"))
    ranked = each.select("scene_id", "_size", "alien.object_id", "alien.n", random_rank(["scene_id"], config.seed, "alien", "scene_id", "alien.object_id").alias("_rank"))
    slots = ranked.withColumn("slot", F.explode(F.sequence(F.col("_rank"), F.greatest(F.col("_rank"), F.lit(config.aliens)), F.col("_size")))).where(F.col("slot") <= config.aliens)
    pick = F.floor(uniform(config.seed, "sample", "scene_id", "slot") * F.col("n")).cast("int")
    chosen = slots.select("scene_id", F.col("slot").cast("int"), "object_id", pick.alias("sample_idx"))
    own = scenes.select("scene_id", F.lit(0).alias("slot"), "object_id", F.col("sample_idx").cast("int"))
    return own.unionByName(chosen)


def scene_points(slots: DataFrame, objects: DataFrame, config: ComposeConfig) -> DataFrame:
    """The points of all scenes, moved slot by slot; label 1 for the target.

    Objects stay packed, a row for each sample, until after the join; points
    are exploded last.
    """
    cloud = F.sort_array(F.collect_list(F.struct("point_idx", *AXES, *[c for c in COLOURS if c in objects.columns])))
    packed = objects.groupBy("object_id", "sample_idx").agg(cloud.alias("cloud"))
    joined = slots.join(packed, ["object_id", "sample_idx"])
    rows = joined.select("scene_id", "slot", "object_id", "sample_idx", F.inline("cloud"))
    moved = move(rows, config, "scene_id", "slot")
    numbered = moved.withColumn("point_idx", F.col("slot").cast("long") * config.points + F.col("point_idx"))
    return numbered.withColumn("label", F.when(F.col("slot") == 0, 1).otherwise(0))


def chunk_of(scene_id: str, config: ComposeConfig) -> Column:
    return F.floor(F.col(scene_id) / config.chunk_samples)


def write_scenes(scenes: DataFrame, path: str, config: ComposeConfig) -> None:
    """Scenes in folders of ``chunk_samples`` consecutive scenes."""
    placed = scenes.withColumn("chunk_id", chunk_of("scene_id", config))
    placed.repartition("chunk_id").write.partitionBy("chunk_id").parquet(path)


def read_scene(spark, path: str, index: int, config: ComposeConfig) -> DataFrame:
    """One scene by its index: partition pruning finds the folder, a pushed filter the rows."""
    return spark.read.parquet(path).where((F.col("chunk_id") == index // config.chunk_samples) & (F.col("scene_id") == index))
