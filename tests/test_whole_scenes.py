"""Composed scenes of every target, against a loop over the targets."""

from pyspark.sql import functions as F

from pointspark.operators import compose
from pointspark.plans import catalog
from pointspark.plans.config import ComposeConfig


def test_slots_of_all_targets_equal_those_of_each(spark):
    config = ComposeConfig(aliens=3, samples=5, transforms=10)
    counts = spark.createDataFrame([(f"o{i}", 2 + i) for i in range(13)], "object_id string, n long")
    scenes = spark.createDataFrame([(100 * i + s, f"o{i}", s) for i in range(13) for s in range(4)], "scene_id long, object_id string, sample_idx int")
    want = []
    for i in range(13):
        own = scenes.where(F.col("object_id") == f"o{i}")
        want += compose.scene_slots(own, compose.alien_subset(counts.select("object_id"), f"o{i}", config), counts, config).collect()
    got = compose.scene_slots_of_all(scenes, counts, config).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 13 * 4 * 4


def test_whole_queries_leave_nothing_out(spark, tmp_path):
    rows = [(i, i % 3, [float(i + d) for d in range(63)]) for i in range(3 * 7)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    cross = catalog.queries()["augmentation_cross_whole"](spark, str(tmp_path)).collect()
    assert {(r.object_id, r.sample_idx, r.transform) for r in cross} == {(str(o), s, t) for o in range(3) for s in range(7) for t in range(10)}
    assert len({r.scene_id for r in cross}) == len(cross) == 210
    union = catalog.queries()["scene_union_whole"](spark, str(tmp_path))
    sizes = union.groupBy("scene_id").agg(F.count("*").alias("n"), F.sum("label").alias("own")).collect()
    assert len(sizes) == 210 and {(r.n, r.own) for r in sizes} == {(210, 21)}
