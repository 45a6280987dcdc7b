"""Evaluation without repeated points: compiled ranges of chunks, scores where points are, and the same results as chunk by chunk."""

import random
import re

import pytest

from pointspark.operators import chunks, votes
from pointspark.plans import catalog, evaluate
from pointspark.plans.config import V3, EvalConfig


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def cloud(spark, n=400):
    rng, rows = random.Random(7), []
    for i in range(n):
        x, y, z = (round(rng.random() * 4, 1) for _ in range(3))
        rows.append((None if i % 97 == 0 else i % 3, i, None if i % 41 == 0 else x, float("nan") if i == 5 else y, 0.0 if i % 3 == 1 else z))
    return spark.createDataFrame(rows, "scene_id long, point_idx long, x double, y double, z double")


@pytest.mark.parametrize("config", [EvalConfig(chunk_size=1.5, overlap=0.7), EvalConfig(profile=V3), EvalConfig(chunk_size=0.5, max_steps=3)])
def test_scores_in_place_are_those_of_chunks(spark, config):
    points = cloud(spark).where("not isnan(y)")
    want = votes.vote(points, evaluate.predict_points(points, config)).collect()
    got = evaluate.vote_points(points, config).collect()
    row = lambda r: (r.scene_id, r.point_idx, r.pred, round(r.confidence, 9), r.seen)
    assert len(got) == points.count() and sorted(map(row, got), key=str) == sorted(map(row, want), key=str)
    seen = {(r.scene_id, r.point_idx): r.seen for r in evaluate.seen_points(points, config).collect()}
    assert seen == {(r.scene_id, r.point_idx): r.seen for r in got}
    if config.overlap == 0.7:
        assert max(seen.values()) > votes.SLOTS
    assert min(seen.values()) == 0


def test_ranges_are_the_chunks_of_the_grid(spark):
    config = EvalConfig(chunk_size=0.7, overlap=0.65)
    points = cloud(spark).where("not isnan(y) and scene_id is not null")
    steps = evaluate.grid_steps(points, config)
    grid = [r.asDict() for r in chunks.chunk_grid(steps).collect()]
    inside = lambda p, g: all(p[a] is not None and g[f"lo_{a}"] <= p[a] <= g[f"lo_{a}"] + g["size"] for a in "xyz")
    want = {(p.point_idx, g["ix"], g["iy"], g["iz"]) for p in points.collect() for g in grid if g["scene_id"] == p.scene_id and inside(p, g)}
    found = chunks.assign_chunks(points, steps)
    assert {(r.point_idx, r.ix, r.iy, r.iz) for r in found.collect()} == want and found.count() == len(want)
    assert "lambda" not in plan_of(found)


@pytest.mark.parametrize("name", ["coverage", "scene_summary", "scene_summary_target_100", "export_target_only", "top_view", "vote_aggregate"])
def test_points_are_not_moved_by_their_index(spark, name):
    plan = plan_of(catalog.queries()[name](spark, "/root/testdata/sf0.001"))
    assert not [k for k in re.findall(r"hashpartitioning\((.*?)\)", plan) if "point_idx" in k]


def test_a_filter_on_the_class_scores_once(spark):
    points = cloud(spark).where("not isnan(y)")
    plan = plan_of(evaluate.only(evaluate.evaluate(points, EvalConfig(profile=V3)), "target"))
    assert all("EXP" not in line for line in plan.splitlines() if "Filter " in line)
