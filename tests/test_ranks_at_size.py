"""A few random rows of each group: one pass over the rows, limited before they are moved."""

from pyspark.sql import functions as F

from pointspark.functions.rng import ranked


def test_few_ranks_take_one_limited_window(spark):
    own = spark.range(4000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("scene_id"), F.col("id").alias("point_idx"))
    few = ranked(own, ["scene_id"], 42, "t", "scene_id", "point_idx", most=20)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Join" not in plan and plan.count("Range (") == 1
    whole = ranked(own, ["scene_id"], 42, "t", "scene_id", "point_idx").where("_rank <= 20")
    assert sorted(map(tuple, few.collect()), key=str) == sorted(map(tuple, whole.collect()), key=str) and few.count() == 60
    many = ranked(own, ["scene_id"], 42, "t", "scene_id", "point_idx", most=1200)
    assert many.count() == 3600
