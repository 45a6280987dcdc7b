"""Scorers by ragged batches, the registry of models, and scenes that fail."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pointspark.operators import registry, scoring, votes
from pointspark.plans import evaluate
from pointspark.plans.config import V3, EvalConfig
from pointspark.sources import pcd, pcd_source

CONFIG = EvalConfig(profile=V3, chunk_size=0.8)


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(11)
    rows = [(f"s{s}", i, *map(float, rng.random(3) * (1 + s)), *map(float, rng.random(3))) for s in range(5) for i in range(60 + 40 * s)]
    own = spark.createDataFrame(rows, "scene_id string, point_idx long, x double, y double, z double, r double, g double, b double")
    own.write.mode("overwrite").format("noop").save()
    return own.repartition(3)


def whole_chunk(xyz, f=None):
    """Logits that depend on the whole chunk: distance from its mean, and its size."""
    away = np.abs(xyz - xyz.mean(0)).sum(1) + len(xyz) / 1000 + (0 if f is None else f[:, 0])
    return np.stack([np.full(len(xyz), 0.9), away], 1)


def by_chunks(xyz, *rest):
    *f, ends = rest
    return np.concatenate([whole_chunk(x, *y) for x, *y in zip(*(np.split(v, ends[:-1]) for v in (xyz, *f)), strict=True)])


def rows_of(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.mark.parametrize("features", [False, True])
def test_ragged_batches_of_any_size_predict_as_single_chunks(spark, points, features):
    want = rows_of(evaluate.predict_points(points, CONFIG, scoring.ChunkScorer(whole_chunk, features)))
    chunks = len({r[2:5] + r[:1] for r in want})
    calls = {}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size, arrow in ((1, "10000"), (50, "7"), (400, "100"), (10**9, "10000")):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", arrow)
        try:
            scorer = scoring.RaggedScorer(by_chunks, features, points=size)
            assert rows_of(evaluate.predict_points(points, CONFIG, scorer)) == want
            calls[size] = scorer.calls.value
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert calls[1] == chunks > calls[50] > calls[400] > calls[10**9]
    assert calls[10**9] <= 4  # one a task


def test_lots_hold_whole_chunks_and_little_more():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 30, 80)
    names = np.repeat(np.arange(80), sizes)
    table = pa.table({"scene_id": [None if i % 9 == 0 else f"s{i // 4}" for i in names], "ix": names % 4, "iy": names * 0, "iz": [None] * len(names), "point_idx": np.arange(len(names))})
    for most in (1, 20, 100, 10_000):
        for step in (1, 13, 5000):
            batches = [b for at in range(0, len(table), step) for b in table.slice(at, step).to_batches()]
            lots = list(scoring.packed(iter(batches), most))
            assert np.concatenate([t["point_idx"].to_numpy() for t, _ in lots]).tolist() == list(range(len(names)))
            assert [n for _, ends in lots for n in np.diff(ends, prepend=0).tolist()] == sizes.tolist()
            assert all(len(t) >= most for t, _ in lots[:-1]) and all(len(t) < most + 30 for t, _ in lots)
    assert list(scoring.packed(iter([]), 5)) == []


def test_wrong_logits_are_an_error(points):
    with pytest.raises(Exception, match="two a point are needed"):
        evaluate.predict_points(points, CONFIG, scoring.RaggedScorer(lambda xyz, ends: np.zeros((len(xyz), 3)))).collect()


def test_models_are_published_under_versions_and_found(tmp_path):
    root = f"file://{tmp_path}/models"
    assert registry.find(root, "head") is None
    first = registry.publish(root, "head", "linear", {"weights": np.eye(2, 3), "bias": [0, 1]})
    second = registry.publish(root, "head", "linear", {"weights": np.ones((2, 6)), "bias": [0, 0]}, places=3)
    assert (first.version, first.width, first.features) == (1, 2, False) and (second.version, second.features, second.places) == (2, True, 3)
    assert registry.find(root, "head") == second and registry.find(root, "head", 1) == first
    assert registry.find(root, "head", 7) is None and registry.find(root, "other") is None
    assert first(np.array([[1.0, 2, 3]])).tolist() == [[1, 3]]
    assert second(np.array([[1.0, 2, 3]]), np.array([[0.11111, 0, 0]])).tolist() == [[6.111, 6.111]]
    with pytest.raises(ValueError, match="three coordinates"):
        registry.publish(root, "head", "linear", {"weights": np.ones((2, 2)), "bias": [0, 0]})


def test_the_head_of_a_network_is_a_model(tmp_path):
    rng = np.random.default_rng(4)
    shapes = {"first_weights": (4, 3), "first_bias": 4, "mean": 4, "variance": 4, "gamma": 4, "beta": 4, "second_weights": (2, 4), "second_bias": 2}
    a = {k: rng.random(v) for k, v in shapes.items()}
    model = registry.publish(f"file://{tmp_path}", "mlp", "mlp", a)
    x = rng.random((5, 3))
    h = np.maximum((x @ a["first_weights"].T + a["first_bias"] - a["mean"]) / np.sqrt(a["variance"] + 1e-5) * a["gamma"] + a["beta"], 0)
    assert np.allclose(model(x), h @ a["second_weights"].T + a["second_bias"])


def test_a_worker_loads_a_model_once(spark, tmp_path, points):
    model = registry.publish(f"file://{tmp_path}/m", "once", "linear", {"weights": [[0.0, 0, 0], [0.8, -0.5, 0.3]], "bias": [0.0, 0.1]}, places=6)

    def told(batches):
        import os

        for batch in batches:
            for _ in range(3):
                model(np.zeros((batch.num_rows, 3)))
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([sum(m == model for m in registry.loaded)])], ["worker", "loads"])

    for _ in range(2):
        seen = points.repartition(8).mapInArrow(told, "worker long, loads long").collect()
        assert len(seen) >= 8 and {r.loads for r in seen} == {1}
    ragged = scoring.RaggedScorer(scoring.pointwise(model), model.features)
    assert rows_of(evaluate.predict_points(points, CONFIG, ragged)) == rows_of(evaluate.predict_points(points, CONFIG, scoring.LinearScorer()))


def raises_on_one_scene(points):
    """Chunk and ragged scorers that raise on the chunks which hold the mark of scene s2."""

    def chunk(xyz, f):
        if (f[:, 2] == 1.0).any():
            raise RuntimeError(f"marked chunk of {len(xyz)}")
        return whole_chunk(xyz)

    def ragged(xyz, f, ends):
        return np.concatenate([chunk(x, y) for x, y in zip(np.split(xyz, ends[:-1]), np.split(f, ends[:-1]), strict=True)])

    marked = points.withColumn("b", F.when((F.col("scene_id") == "s2") & (F.col("point_idx") == 7), 1.0).otherwise(F.col("b") * 0.9))
    return marked, [scoring.ChunkScorer(chunk, True, isolate=True), scoring.RaggedScorer(ragged, True, points=100, isolate=True)]


def test_a_scene_that_fails_is_one_row_and_the_others_go_on(spark, points):
    marked, scorers = raises_on_one_scene(points)
    want = rows_of(evaluate.evaluate(marked.where("scene_id <> 's2'"), CONFIG, scoring.ChunkScorer(lambda xyz, f: whole_chunk(xyz), True)))
    for scorer in scorers:
        classified, failures = evaluate.evaluate_isolated(marked, CONFIG, scorer)
        assert rows_of(classified) == want
        (failed,) = failures.collect()
        assert (failed.scene_id, failed.stage) == ("s2", "score") and failed.chunks >= 1 and failed.error.startswith("RuntimeError: marked chunk of ")


def test_without_isolation_the_run_ends(points):
    marked, scorers = raises_on_one_scene(points)
    for scorer in scorers:
        scorer.isolate = False
        with pytest.raises(Exception, match="marked chunk"):
            evaluate.predict_points(marked, CONFIG, scorer).collect()
        with pytest.raises(ValueError, match="isolate"):
            evaluate.evaluate_isolated(marked, CONFIG, scorer)


def test_files_that_cannot_be_read_are_failures_too(spark, points, tmp_path):
    pcd_source.save_pcd(points, str(tmp_path))
    (tmp_path / "torn.pcd").write_bytes(b"nothing of a cloud")
    for read in (pcd.read_pcd, pcd_source.load_pcd):
        scorer = scoring.RaggedScorer(by_chunks, isolate=True)
        classified, failures = evaluate.evaluate_isolated(read(spark, str(tmp_path)).drop("path"), CONFIG, scorer)
        (failed,) = failures.collect()
        assert (failed.scene_id, failed.stage, failed.chunks) == ("torn", "read", None) and "FIELDS" in failed.error
        assert votes.scene_summary(classified).count() == 5


def test_clusters_of_what_went_well(spark, points):
    marked, scorers = raises_on_one_scene(points)
    config = EvalConfig(profile=V3, chunk_size=0.8, cluster=True, eps=0.3, min_samples=4)
    classified, _ = evaluate.evaluate_isolated(marked, config, scorers[1])
    plain = evaluate.evaluate(marked.where("scene_id <> 's2'"), config, scoring.ChunkScorer(lambda xyz, f: whole_chunk(xyz), True))
    assert rows_of(classified) == rows_of(plain)


def test_free_chunk_size_and_least_step(spark):
    own = spark.createDataFrame([("a", i, i / 10, 0.0, 0.0) for i in range(11)], "scene_id string, point_idx long, x double, y double, z double")
    (r,) = evaluate.grid_steps(own, EvalConfig(profile=V3, chunk_size=0.5)).collect()
    assert (r["size"], r.k_x, r.k_y) == (0.5, 4, 1)
    (r,) = evaluate.grid_steps(own, EvalConfig(profile=V3, chunk_size=0.02, overlap=0.9)).collect()
    assert r.k_x == 100  # 101 at steps of 0.01, of which a hundred are kept
    (r,) = evaluate.grid_steps(own, EvalConfig(profile=V3, chunk_size=0.0, max_steps=None)).collect()
    assert r.k_x == 101
