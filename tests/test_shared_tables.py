"""Tables in the shared folder go when their scope ends."""

import os

import pytest
from pyspark.sql import functions as F

from pointspark.functions.shared import save, scope, shared_dir
from pointspark.operators import clustering
from pointspark.plans.config import EvalConfig
from pointspark.streaming.watch import watch_scenes


def tables(spark):
    folder = f"{shared_dir(spark).removeprefix('file://')}/points"
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_a_scope_removes_its_own_tables_only(spark):
    kept = save(spark.range(3), "kept")
    before = tables(spark)
    with scope(spark):
        save(spark.range(4), "outer")
        with scope(spark):
            inner = save(spark.range(5), "inner")
            assert inner.count() == 5 and len(tables(spark)) == len(before) + 2
        assert len(tables(spark)) == len(before) + 1
        with pytest.raises(ZeroDivisionError), scope(spark):
            save(spark.range(6), "failed")
            raise ZeroDivisionError
    assert tables(spark) == before and kept.count() == 3


def test_clusters_in_a_scope(spark):
    own = spark.range(60).select(F.lit("a").alias("scene_id"), F.col("id").alias("point_idx"), (F.col("id") % 6 / 50).alias("x"), (F.col("id") % 7 / 50).alias("y"), F.lit(0.0).alias("z"))
    before = tables(spark)
    with scope(spark):
        found = clustering.dbscan(own, 0.05, 3).toPandas()
    assert len(found) == 60 and tables(spark) == before


def test_a_stream_of_ten_batches_leaves_no_tables(spark, tmp_path):
    schema = "scene_id string, point_idx long, x double, y double, z double"
    for i in range(10):
        rows = spark.range(20).select(F.lit(f"s{i}").alias("scene_id"), F.col("id").alias("point_idx"), *[(F.rand(i) * 2).alias(a) for a in "xyz"])
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    before, seen = tables(spark), []
    stream = watch_scenes(spark, str(tmp_path / "in"), schema, lambda df, n: seen.append((n, df.count())), str(tmp_path / "cp"), EvalConfig(), files=1, available_now=True)
    stream.awaitTermination(240)
    assert sorted(seen) == [(i, 20) for i in range(10)]
    assert tables(spark) == before
