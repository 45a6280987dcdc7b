"""Clusters of whole scenes: points are dealt once, and scenes that no task holds give the same by joins."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pointspark.operators import clustering, density
from pointspark.plans import catalog


def plans_of(monkeypatch, run):
    """The plans of the tables that are written."""
    plans, keep = [], clustering.save

    def save(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, name)

    monkeypatch.setattr(clustering, "save", save)
    run()
    return plans


@pytest.mark.parametrize("name", ["dbscan_labels", "cluster_sizes", "largest_cluster", "dbscan_core"])
def test_points_are_dealt_once(spark, monkeypatch, name):
    """The window that numbers them deals them by scene; nothing is sent or sorted again, and no table but the result is written."""
    plans = plans_of(monkeypatch, lambda: catalog.queries()[name](spark, "/root/testdata/sf0.001"))
    assert len(plans) == 1
    assert plans[0].count("Exchange") == 1 and plans[0].count("Sort ") == 1 and "Join" not in plans[0]


def clouds(spark, scenes, kind):
    rng, rows = random.Random(11), []
    for scene, n in enumerate(scenes):
        for i in range(n):
            ball = [rng.gauss(rng.choice((0, 1.3)), 0.25) for _ in range(3)] if i % 3 else [rng.uniform(-2, 2) for _ in range(3)]
            rows.append((f"s{scene}" if kind == "string" else scene, i, *ball))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, f"scene_id {kind}, point_idx long, x double, y double, z double")


@pytest.mark.parametrize("kind", ["long", "string"])
def test_scenes_that_no_task_holds_give_the_same(spark, monkeypatch, kind):
    points = clouds(spark, [400, 5, 260, 1, 130, 300], kind)
    results = []
    for most in (density.MOST, 250, 0):
        monkeypatch.setattr(clustering, "MOST", most)
        labels = sorted(map(tuple, clustering.dbscan(points, 0.35, 6).collect()))
        results.append((labels, sorted(map(tuple, clustering.core_points(points, 0.35, 6).collect()))))
    assert results[0] == results[1] == results[2] and len(results[0][0]) > len(results[0][1]) > 300


def test_small_blocks_give_the_same(monkeypatch):
    rng = np.random.default_rng(3)
    places = [np.concatenate([rng.normal(0, 0.05, 300), rng.uniform(-1, 1, 300)]) for _ in range(3)]
    scene, index = np.sort(rng.integers(0, 3, 600)), rng.permutation(600)
    run = lambda: sorted(zip(*(a.tolist() for a in density.clusters(scene, index, places, 0.2, 0.2 * 0.2, 5)), strict=True))
    whole = run()
    monkeypatch.setattr(density, "ROWS", 7)
    monkeypatch.setattr(density, "PAIRS", 13)
    assert whole and run() == whole


def test_far_scenes_and_points_keep_apart():
    """Cells whose numbers would pass 64 bits."""
    near = [0.0, 0.01, 0.02, 1e9, 1e9 + 0.25, 1e9 + 0.5, -1e9, -1e9, -1e9]
    places = [np.array(near * 2) for _ in range(3)]
    scene, index = np.repeat([0, 1], 9), np.tile(np.arange(9), 2)
    at, cluster = density.clusters(scene, index, places, 0.5, 0.25, 3)
    found = {(int(scene[a]), int(index[a])): int(c) for a, c in zip(at, cluster, strict=True)}
    own = dict.fromkeys(range(3), 0) | dict.fromkeys(range(3, 6), 4) | dict.fromkeys(range(6, 9), 6)
    assert found == {(s, i): c for s in (0, 1) for i, c in own.items()}


@pytest.mark.parametrize("most", [density.MOST, 0])
def test_points_that_are_no_numbers_are_near_none(spark, monkeypatch, most):
    monkeypatch.setattr(clustering, "MOST", most)
    rows = [(1, i, v, 0.0, 0.0) for i, v in enumerate([math.nan] * 4 + [math.inf] * 4 + [None] * 4 + [0.1] * 3)] + [(None, i, 0.0, 0.0, 0.0) for i in range(3)]
    points = spark.createDataFrame(rows, "scene_id long, point_idx long, x double, y double, z double")
    assert sorted(map(tuple, clustering.dbscan(points, 0.35, 3).collect())) == [(1, 12, 12), (1, 13, 12), (1, 14, 12)]
    assert sorted(map(tuple, clustering.core_points(points, 0.35, 3).collect())) == [(1, 12), (1, 13), (1, 14)]


def test_whole_scenes_in_a_stream():
    ids = [1] * 5 + [2] * 30 + [3] * 2 + [4] * 4 + [5] * 21
    tables = [pa.table({"scene_id": pa.array(ids[i : i + 4])}) for i in range(0, len(ids), 4)]
    got = {}
    for table, begins in density.whole_scenes(iter(tables), 6):
        values = table.column("scene_id").to_pylist()
        assert len(table) <= 6 + 4 + 30
        for begin, end in zip(begins.tolist(), [*begins.tolist()[1:], len(values)], strict=True):
            assert len(set(values[begin:end])) == 1 and values[begin] not in got
            got[values[begin]] = end - begin
    assert got == {1: 5, 2: 30, 3: 2, 4: 4, 5: 21}


def test_demotion_deals_points_once_and_by_joins_gives_the_same(spark, monkeypatch):
    """Votes are neither asked for twice nor joined with clusters, whatever other columns they carry."""
    points = clouds(spark, [400, 5, 260, 1, 130, 300], "string")
    voted = points.withColumns({"pred": (F.col("point_idx") % 7 != 0).cast("int"), "confidence": F.lit(0.9), "tags": F.array(F.col("point_idx"))})
    odd = spark.createDataFrame([(None, 1, 0.0, 0.0, 0.0), ("s0", 900, math.nan, 0.0, 0.0), ("s1", 901, None, 0.0, 0.0)], "scene_id string, point_idx long, x double, y double, z double")
    # Two clusters of one size: the lower number stays.
    ties = spark.createDataFrame([("ties", i, float(i % 2) * 5, 0.0, 0.0) for i in range(12)], odd.schema)
    voted = voted.unionByName(odd.union(ties).withColumns({"pred": F.lit(1), "confidence": F.lit(0.5), "tags": F.array(F.lit(1).cast("long"))}))
    voted = clustering.save(voted, "voted")
    plan = clustering.keep_largest(voted, 0.35, 6)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    results = []
    for most in (density.MOST, 250, 0):
        monkeypatch.setattr(clustering, "MOST", most)
        found = clustering.keep_largest(voted, 0.35, 6)
        assert found.columns == voted.columns
        results.append(sorted(map(str, found.collect())))
    assert results[0] == results[1] == results[2]
    kept = {(r.scene_id, r.point_idx): r.pred for r in clustering.keep_largest(voted, 0.35, 6).collect()}
    assert [kept["ties", i] for i in range(12)] == [1, 0] * 6 and (kept["s0", 900], kept["s1", 901], kept[None, 1]) == (0, 1, 1)
    assert 0 < sum(kept.values()) < voted.where("pred = 1").count()


def test_two_dense_balls_are_compared_until_they_are_linked(monkeypatch):
    rng, n, seen = np.random.default_rng(1), 4000, []
    places = [np.concatenate([rng.normal(0, 0.03, n), rng.normal(0.28, 0.03, n)]) for _ in range(3)]
    near = density._near
    monkeypatch.setattr(density, "PAIRS", 10_000)
    monkeypatch.setattr(density, "_near", lambda a, i, b, j, square: seen.append(len(i)) or near(a, i, b, j, square))
    at, cluster = density.clusters(np.zeros(2 * n, np.int64), np.arange(2 * n), places, 0.3, 0.09, 50)
    assert len(at) == 2 * n and set(cluster.tolist()) == {0} and sum(seen) < n * n / 4
