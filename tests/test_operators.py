"""Small fixtures with answers worked out by hand."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pointspark.functions import columns as fn
from pointspark.functions.rng import ranked
from pointspark.operators import batches, chunks, clustering, compose, metrics, points, sampling, scoring, votes
from pointspark.plans import evaluate
from pointspark.plans.config import V2, V3, ComposeConfig, EvalConfig
from pointspark.sources import pcd
from pointspark.streaming.watch import watch_scenes


def cloud(spark, rows, scene=1):
    return spark.createDataFrame([(scene, i, *map(float, r), 0.1, 0.2, 0.3) for i, r in enumerate(rows)], "scene_id long, point_idx long, x double, y double, z double, r double, g double, b double")


def test_parse_mixed_lines(spark):
    lines = ["1 2 3 255 0 51", "1 2 3 16711680", "1 2 3 255 junk", "1 2 3", "", "1 2 3 4.2e+06", "1 2 3 255.0 0 0", "VERSION .7", "DATA ascii", " 4  5 nan 1 2 3 more "]
    rows = pcd.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r.x, r.r, r.g, r.b) for r in rows[:3]] == [(1, 1, 0, 0.2), (1, 1, 0, 0), (1, 0, 0, 1)]
    assert len(rows) == 4 and math.isnan(rows[3].z)


def test_unpack(spark):
    rows = spark.createDataFrame([(v,) for v in (16711680, 65280, 255, 4294901760)], "v long").select(*fn.unpack_rgb(F.col("v"))).collect()
    assert [tuple(r) for r in rows] == [(1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 0, 0)]


@pytest.mark.parametrize("n", [3, 4, 5])
def test_downsample_and_pad_edges(spark, n):
    own = cloud(spark, [(i, 0, 0) for i in range(n)])
    rows = sampling.pad_to_n(sampling.downsample(own, ["scene_id"], 4, 1), ["scene_id"], 4).collect()
    assert sorted(r.point_idx for r in rows) == [0, 1, 2, 3]
    assert len({r.x for r in rows if not r.is_pad}) == min(n, 4)
    assert sum(r.is_pad for r in rows) == max(0, 4 - n)


def test_rotation_order(spark):
    m = fn.rotation(*[F.lit(v) for v in (90.0, 0.0, 90.0)])
    (r,) = spark.range(1).select(*[m[i][j] for i in range(3) for j in range(3)]).collect()
    c, s = math.cos(math.pi / 2), math.sin(math.pi / 2)
    rx, rz = np.array([[1, 0, 0], [0, c, -s], [0, s, c]]), np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]])
    assert np.allclose(np.array(r).reshape(3, 3), rx @ rz)


def test_rotation_keeps_distances(spark):
    own = cloud(spark, np.random.default_rng(0).normal(size=(8, 3)))
    before = np.array([[r.x, r.y, r.z] for r in own.orderBy("point_idx").collect()])
    after = np.array([[r.x, r.y, r.z] for r in compose.move(own, ComposeConfig(), "scene_id").orderBy("point_idx").collect()])
    assert np.allclose(np.linalg.norm(before[:, None] - before, axis=2), np.linalg.norm(after[:, None] - after, axis=2))
    assert not np.allclose(before, after)


def test_padding_moves_with_its_object(spark):
    config = ComposeConfig(points=2, aliens=1, samples=1, transforms=1)
    objects = spark.createDataFrame([("t", 0, 0, 1.0, 2.0, 3.0), ("t", 0, 1, 0.0, 0.0, 0.0)], "object_id string, sample_idx int, point_idx long, x double, y double, z double")
    slots = spark.createDataFrame([(5, 0, "t", 0)], "scene_id long, slot int, object_id string, sample_idx int")
    rows = {r.point_idx: r for r in compose.scene_points(slots, objects, config).collect()}
    _, shift = compose.motion(config, "scene_id", "slot")
    (t,) = slots.select(*shift).collect()
    assert (rows[1].x, rows[1].y, rows[1].z) == pytest.approx(tuple(t)) and rows[1].label == 1


@pytest.mark.parametrize("n", [0, 5, 9, 12])
def test_nine_aliens(spark, n):
    config = ComposeConfig()
    names = spark.createDataFrame([("t",), *[(f"a{i:02}",) for i in range(n)]], "object_id string")
    aliens = compose.alien_subset(names, "t", config)
    assert aliens.count() == min(n, 10)
    scenes = spark.createDataFrame([(7, "t", 0), (8, "t", 0)], "scene_id long, object_id string, sample_idx int")
    rows = compose.scene_slots(scenes, aliens, names.withColumn("n", F.lit(3).cast("long")), config).collect()
    own = sorted((r.slot, r.object_id) for r in rows if r.scene_id == 7)
    assert [s for s, _ in own] == (list(range(10)) if n else [0])
    assert len({o for _, o in own[1:]}) == min(n, 9)
    assert all(0 <= r.sample_idx < 3 for r in rows)


def test_normalise_constant_and_nonfinite(spark):
    rows = points.normalize(cloud(spark, [(2, 2, 2)] * 3), ["scene_id"], 3.0).collect()
    assert all((r.x, r.y, r.z) == (0, 0, 0) for r in rows)
    rows = points.nan_to_num(cloud(spark, [(math.nan, math.inf, -math.inf)])).collect()
    assert (rows[0].x, rows[0].y, rows[0].z) == (0, 1, -1)


def test_normalise_is_bounded_and_ignores_shifts(spark):
    base = np.random.default_rng(1).normal(size=(30, 3))
    a, b = [np.array([[r.x, r.y, r.z] for r in points.normalize(cloud(spark, v), ["scene_id"], 2.0).orderBy("point_idx").collect()]) for v in (base, base + 5)]
    assert np.allclose(a, b) and abs(a).max() <= 2


@pytest.mark.parametrize(("top", "by"), [(1.0, 1), (1.01, 255)])
def test_colour_scale(spark, top, by):
    own = cloud(spark, [(0, 0, 0)] * 2).withColumn("r", F.when(F.col("point_idx") == 0, top).otherwise(0.5))
    assert sorted(r.r for r in points.feature_scale(own, ["scene_id"]).collect()) == [0.5 / by, top / by]


def test_flat_scene(spark):
    own = cloud(spark, [(0, 0, 1), (4, 4, 1), (2, 1, 1)])
    (r,) = evaluate.grid_steps(own, EvalConfig()).collect()
    assert (r.volume, r.density, r.k_z, r.size) == (0, 1000, 1, 2.0)
    (r,) = evaluate.grid_steps(own, EvalConfig(profile=V2)).collect()
    assert r.size == 4.8


def test_every_point_is_covered_and_assignment_equals_boxes(spark):
    rng = np.random.default_rng(3)
    own = cloud(spark, np.concatenate([rng.uniform(0, 5, (200, 3)), [[0, 0, 0], [5, 5, 5], [2, 2, 2]]]))
    config = EvalConfig(target_points=20)
    steps = evaluate.grid_steps(own, config)
    got = {(r.point_idx, r.ix, r.iy, r.iz) for r in chunks.assign_chunks(own, steps).collect()}
    rows, boxes = own.collect(), chunks.chunk_grid(steps).collect()
    want = {(p.point_idx, b.ix, b.iy, b.iz) for p in rows for b in boxes if all(b[f"lo_{a}"] <= p[a] <= b[f"lo_{a}"] + b["size"] for a in "xyz")}
    assert got == want
    assert {g[0] for g in got} == {p.point_idx for p in rows}


def test_step_cap_leaves_gaps_and_uncovered_points(spark):
    own = cloud(spark, [(i * 10.0, 0, 0) for i in range(101)])
    found = evaluate.evaluate(own, EvalConfig(max_steps=5))
    rows = found.collect()
    missed = [r for r in rows if r.seen == 0]
    assert missed and all((r.pred, r.confidence, r["class"]) == (0, 0.0, "background") for r in missed)
    assert votes.coverage(found).collect()[0].coverage_percent == pytest.approx(100 * (1 - len(missed) / 101))


def test_votes(spark):
    own = cloud(spark, [(0, 0, 0)] * 4)
    rows = [(1, 0, 1, 0.4, 0.6), (1, 0, 0, 0.7, 0.3), (1, 1, 1, 0.45, 0.55), (1, 1, 1, 0.45, 0.55), (1, 1, 0, 0.99, 0.01), (1, 2, 0, 0.8, 0.2)]
    got = {r.point_idx: r for r in votes.classify(votes.vote(own, spark.createDataFrame(rows, "scene_id long, point_idx long, pred int, p0 double, p1 double"))).collect()}
    assert got[0].pred == 0
    assert got[1].pred == 1 and got[1].confidence == pytest.approx((0.45 + 0.45 + 0.99) / 3)
    assert got[2]["class"] == "background" and got[2].confidence == 0.8
    assert (got[3].pred, got[3].confidence, got[3].seen) == (0, 0.0, 0)


def voted(spark, rows):
    return cloud(spark, [r[:3] for r in rows]).join(spark.createDataFrame([(i, r[3], r[4]) for i, r in enumerate(rows)], "point_idx long, pred int, confidence double"), "point_idx")


def test_demotion(spark):
    near = [(0.01 * i, 0, 0, 1, 0.6) for i in range(5)]
    far = [(5 + 0.01 * i, 0, 0, 1, 0.9) for i in range(3)]
    got = {r.point_idx: r["class"] for r in votes.classify(clustering.keep_largest(voted(spark, near + far + [(9, 9, 9, 1, 0.5)]), 0.05, 3)).collect()}
    assert [got[i] for i in range(9)] == ["target"] * 5 + ["alien"] * 3 + ["background"]
    same = clustering.keep_largest(voted(spark, far[:2] + [(0, 0, 0, 0, 0.9)]), 0.05, 3).collect()
    assert sum(r.pred for r in same) == 2
    none = clustering.keep_largest(voted(spark, [(0, 0, 0, 0, 0.9)]), 0.05, 3).collect()
    assert [r.pred for r in none] == [0]


def test_clusters_ties_and_shared_borders(spark):
    left, right = [(0.1 * i, 0, 0) for i in range(4)], [(1 + 0.1 * i, 0, 0) for i in range(4)]
    found = clustering.dbscan(cloud(spark, [*right, *left]), 0.11, 3)
    assert {r.point_idx: r.cluster for r in found.collect()} == dict.fromkeys(range(4), 1) | dict.fromkeys(range(4, 8), 5)
    assert clustering.largest_cluster(found).collect()[0].cluster == 1
    shared = cloud(spark, [(v, 0, 0) for v in (0.0, 0.01, 0.02, 0.1, 0.2, 0.3, 0.38, 0.39, 0.4)])
    labels = {r.point_idx: r.cluster for r in clustering.dbscan(shared, 0.105, 4).collect()}
    assert labels == dict.fromkeys(range(5), 0) | dict.fromkeys(range(5, 9), 5)


def test_iou_and_epochs(spark):
    pairs = lambda rows: spark.createDataFrame(rows, "pred int, label int")
    assert metrics.mean_iou(pairs([(0, 0), (0, 0)])).collect()[0][0] == 1
    assert metrics.mean_iou(pairs([(5, 6)])).collect()[0][0] == 0
    assert metrics.mean_iou(pairs([(1, 1), (1, 0), (0, 0)])).collect()[0][0] == 0.5
    rows = [(1, 0, 1, 1, 0.5), (1, 0, 0, 1, 0.5), (1, 1, 1, 1, math.nan)]
    (r,) = metrics.epoch_metrics(spark.createDataFrame(rows, "epoch int, batch int, pred int, label int, loss double")).collect()
    assert (r.loss, r.accuracy, r.iou) == (0.5, 0.5, 0.25)
    history = spark.createDataFrame(list(enumerate([0.0, 0.5, 0.5, 0.4, 0.6], 1)), "epoch int, iou double")
    assert [r.epoch for r in metrics.best_epochs(history).orderBy("epoch").collect()] == [2, 5]


def test_batches_and_split(spark):
    samples = spark.createDataFrame([(i,) for i in range(9)], "id int").withColumn("g", F.lit(0))
    dealt = batches.shuffle_batches(samples, ["g"], "id", 4, 1, 1)
    assert batches.drop_last(dealt, ["batch"], 4).select("batch").distinct().count() == 2
    items = spark.createDataFrame([(0, i, n) for i, n in enumerate((3, 1, 4))], "batch int, item int, n int")
    assert [r.offset for r in batches.batch_offsets(items, ["batch"]).orderBy("item").collect()] == [3, 4, 8]
    for n, want in ((1, 0), (4, 3), (5, 4), (9, 7)):
        parts = sampling.train_valid_split(spark.range(n), "id", 80, 3)
        assert parts.where("part = 'train'").count() == want and parts.count() == n


def test_rates(spark):
    step = [r[0] for r in spark.createDataFrame([(e,) for e in (1, 14, 15, 30)], "e int").select(fn.step_rate(F.col("e"), 1e-4, 15, 0.8)).collect()]
    assert step == pytest.approx([1e-4, 1e-4, 8e-5, 6.4e-5])
    (last,) = spark.range(1).select(fn.cosine_rate(F.lit(100), 6e-4, 100)).collect()
    assert last[0] == pytest.approx(6e-6)
    assert (V2.scale, V3.scale, V2.drop_last, V3.drop_last) == (3, 2, True, False)


def test_histogram_of_equal_values(spark):
    rows = votes.histogram(spark.createDataFrame([(3,), (3,)], "n int"), "n").orderBy("bin").collect()
    assert [(r.low, r.high, r.n) for r in rows] == [(2.5, 3.0, 0), (3.0, 3.5, 2)]


def test_chunk_scorer_sees_whole_chunks(spark):
    own = cloud(spark, np.random.default_rng(5).uniform(0, 1, (60, 3)))
    scorer = scoring.ChunkScorer(lambda xyz: np.stack([np.zeros(len(xyz)), np.full(len(xyz), len(xyz) - 30.0)], 1))
    config = EvalConfig(max_points=25)
    rows = evaluate.predict_points(own, config, scorer).collect()
    assert rows and {r.pred for r in rows} == {0}
    sizes = {}
    for r in rows:
        sizes[r.ix, r.iy, r.iz] = sizes.get((r.ix, r.iy, r.iz), 0) + 1
    assert max(sizes.values()) <= 25


def test_pcd_files(spark, tmp_path):
    (tmp_path / "box" / "one").mkdir(parents=True)
    body = "# note\nVERSION .7\nFIELDS x y z rgb\nSIZE 4 4 4 {}\nTYPE F F F {}\nCOUNT 1 1 1 1\nWIDTH 2\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS 2\nDATA {}\n"
    (tmp_path / "box" / "one" / "b.pcd").write_text(body.format(4, "U", "ascii") + "1 2 3 16711680\n4 5 6 255\n")
    raw = np.array([(1, 2, 3, 65280), (4, 5, 6, 255)], [("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("c", "<u4")])
    (tmp_path / "box" / "one" / "c.pcd").write_bytes(body.format(4, "F", "binary").encode() + raw.tobytes())
    (tmp_path / "box" / "one" / "a.pcd").write_text("nothing")
    rows = pcd.read_pcd(spark, str(tmp_path / "box"), recursive=True)
    good = rows.where("error is null").orderBy("path", "point_idx").collect()
    assert [(r.scene_id, r.point_idx, r.x, r.r, r.g, r.b) for r in good] == [("b", 0, 1, 1, 0, 0), ("b", 1, 4, 0, 0, 1), ("c", 0, 1, 0, 1, 0), ("c", 1, 4, 0, 0, 1)]
    bad = rows.where("error is not null").collect()
    assert [(r.scene_id, r.point_idx) for r in bad] == [("a", None)]
    samples = pcd.object_samples(rows).select("object_id", "scene_id", "sample_idx").distinct().collect()
    assert sorted(map(tuple, samples)) == [("one", "b", 0), ("one", "c", 1)]


def test_pcd_export_reads_back(spark, tmp_path):
    own = cloud(spark, [(0.125, -2, 3e-7), (1, 2, 3)], 4).unionByName(cloud(spark, [(7, 8, 9)], 5))
    pcd.write_pcd(own, str(tmp_path / "out"))
    for scene, n in ((4, 2), (5, 1)):
        (text,) = [p.read_bytes() for p in (tmp_path / "out" / f"scene_id={scene}").glob("*.txt")]
        found = pcd.decode_pcd(text)
        want = own.where(F.col("scene_id") == scene).orderBy("point_idx").collect()
        assert found["x"].tolist() == [r.x for r in want] and found["z"].tolist() == [r.z for r in want] and len(want) == n
        assert found["b"].tolist() == pytest.approx([r.b for r in want], abs=1 / 255)


def test_catalog_and_scene_store(spark, tmp_path):
    (tmp_path / "c.csv").write_text('object_name,category,ean,product_name,grasp_force_n,weight_g\ncan,food,0123456789012,Beans,07,088\nbox,food,"",none,,null\n')
    rows = {r.object_name: r for r in pcd.read_catalog(spark, str(tmp_path / "c.csv")).collect()}
    assert (rows["can"].ean, rows["can"].grasp_force_n, rows["can"].weight_g) == ("0123456789012", 7, 88)
    assert (rows["box"].ean, rows["box"].product_name, rows["box"].weight_g) == (None, None, None)
    config = ComposeConfig(chunk_samples=2)
    scenes = spark.createDataFrame([(i, i * 1.0) for i in range(5)], "scene_id long, x double")
    compose.write_scenes(scenes, str(tmp_path / "s"), config)
    one = compose.read_scene(spark, str(tmp_path / "s"), 3, config)
    assert [r.x for r in one.collect()] == [3.0]
    assert "PartitionFilters: [isnotnull(chunk_id" in one._jdf.queryExecution().executedPlan().toString()


def test_scenes_that_arrive(spark, tmp_path):
    own = cloud(spark, np.random.default_rng(2).uniform(0, 3, (40, 3)))
    folder, seen = str(tmp_path / "in"), []
    own.coalesce(1).write.parquet(folder)
    stream = watch_scenes(spark, folder, own.schema.simpleString()[7:-1].replace(":", " "), lambda df, n: seen.append(df.count()), str(tmp_path / "cp"), EvalConfig(), available_now=True)
    stream.awaitTermination(120)
    assert seen == [40]


def brute_dbscan(rows, eps, min_samples):
    """Cluster of each point (its least core index) or None, from all pairs."""
    near = [[j for j, b in enumerate(rows) if sum((x - y) * (x - y) for x, y in zip(a, b, strict=True)) <= eps * eps] for a in rows]
    core = [len(n) >= min_samples for n in near]
    label = [i if c else None for i, c in enumerate(core)]
    moved = True
    while moved:
        moved = False
        for i in range(len(rows)):
            if core[i]:
                least = min(label[j] for j in near[i] if core[j])
                moved, label[i] = moved or least < label[i], least
    return {i: min((label[j] for j in near[i] if core[j]), default=None) for i in range(len(rows)) if any(core[j] for j in near[i])}


@pytest.mark.parametrize(("seed", "eps", "min_samples"), [(1, 0.35, 8), (2, 0.2, 4), (3, 0.6, 30), (4, 0.1, 2), (5, 1.0, 400)])
def test_dbscan_equals_brute_force(spark, seed, eps, min_samples):
    """Dense balls, lines between them, lattices with ties at eps, repeated points and noise."""
    rng = np.random.default_rng(seed)
    balls = [rng.normal(c, s, (n, 3)) for c, s, n in ((0, 0.1, 150), (1.2, 0.3, 120), (-2, 0.02, 80))]
    line = np.stack([np.linspace(0, 3, 40), np.zeros(40), np.zeros(40)], 1)
    lattice = np.array([(5 + i * eps, j * eps, k * eps) for i in range(4) for j in range(3) for k in range(3)])
    rows = np.concatenate([*balls, line, lattice, lattice[:9], rng.uniform(-4, 4, (100, 3))])
    rows = rows[rng.permutation(len(rows))].tolist()
    found = {r.point_idx: r.cluster for r in clustering.dbscan(cloud(spark, rows), eps, min_samples).collect()}
    assert found == brute_dbscan(rows, eps, min_samples)


def test_dense_points_make_no_pairs(spark):
    """Twenty thousand points of one ball: what is written grows with the points, not with their pairs."""
    rng = np.random.default_rng(7)
    rows = np.concatenate([rng.normal(0, 0.02, (20_000, 3)), rng.normal(3, 0.02, (500, 3))])
    own = spark.createDataFrame(pd.DataFrame({"scene_id": 1, "point_idx": np.arange(len(rows)), "x": rows[:, 0], "y": rows[:, 1], "z": rows[:, 2]}))
    found = clustering.cluster_sizes(clustering.dbscan(own, 0.3, 50)).collect()
    assert sorted((r.cluster, r.n) for r in found) == [(0, 20_000), (20_000, 500)]


def test_demotion_changes_a_summary(spark):
    from pointspark.plans import catalog

    d = "/root/testdata/sf0.001"
    plain = {r.scene_id: r.target_points for r in catalog.summary(spark, d).collect()}
    kept = {r.scene_id: r.target_points for r in catalog.summary(spark, d, catalog.CLUSTERED).collect()}
    assert any(kept[s] < plain[s] for s in plain) and all(kept[s] <= plain[s] for s in plain)


def test_lines_are_split_once(spark):
    from pointspark.plans import catalog

    plan = catalog.queries()["pcd_ascii_parse"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("split(") == 1


def test_wide_scenes_are_covered_without_a_cap(spark):
    own = cloud(spark, [(i * 0.75, 0, 0) for i in range(400)])
    seen = lambda config: {r.point_idx for r in evaluate.predict_points(own, config).collect()}
    assert len(seen(EvalConfig(profile=V3, adaptive=False))) < 400
    assert len(seen(EvalConfig(profile=V3, adaptive=False, max_steps=None))) == 400


def test_pcd_fallback_counts_and_compression():
    text = b"no header at all\n1 2 3 255 0 51\nbroken 2 3 4 5 6\n4 5 6 16711680\n"
    found = pcd.decode_any(text)
    assert found["x"].tolist() == [1, 4] and found["r"].tolist() == [1, 1] and found["b"].tolist() == [0.2, 0]
    bare = b"VERSION .7\nFIELDS x y z\nSIZE 4 4 4\nTYPE F F F\nCOUNT 1 1 1\nPOINTS 1\nDATA ascii\n1 2 3\n"
    assert np.isnan(pcd.decode_any(bare)["r"]).all()
    with pytest.raises(KeyError):
        pcd.decode_any(b"nothing")
    head = b"VERSION .7\nFIELDS n x y z rgb\nSIZE 4 4 4 4 4\nTYPE F F F F U\nCOUNT 3 1 1 1 1\nWIDTH 2\nHEIGHT 1\nPOINTS 2\nDATA %s\n"
    layout = np.dtype([("n", "<f4", 3), ("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("rgb", "<u4")])
    table = np.array([((9, 9, 9), 1, 2, 3, 0xFF0000), ((8, 8, 8), 4, 5, 6, 255)], layout)
    columns = b"".join(np.ascontiguousarray(table[c]).tobytes() for c in layout.names)
    literals = b"".join(bytes([len(columns[i : i + 32]) - 1]) + columns[i : i + 32] for i in range(0, len(columns), 32))
    forms = [head % b"binary" + table.tobytes(), head % b"ascii" + b"9 9 9 1 2 3 16711680\n8 8 8 4 5 6 255\n"]
    forms.append(head % b"binary_compressed" + np.array([len(literals), len(columns)], "<u4").tobytes() + literals)
    for content in forms:
        found = pcd.decode_pcd(content)
        assert found["z"].tolist() == [3, 6] and found["r"].tolist() == [1, 0] and found["b"].tolist() == [0, 1]
    # Copies of 8 and of 7 + 5 + 2 bytes from two bytes back.
    assert pcd._unpack_lzf(b"\x01ab\xc0\x01", 10) == b"ab" * 5
    assert pcd._unpack_lzf(b"\x01ab\xe0\x05\x01", 16) == b"ab" * 8


def test_scorers_load_and_tell_their_width(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"weights": [1.0, 0.0, 0.0], "bias": -0.5}')
    loaded = scoring.LinearScorer.load(spark, str(tmp_path / "s.json"))
    assert (loaded.weights, loaded.bias, loaded.places) == ((1.0, 0.0, 0.0), -0.5, 6)
    assert scoring.LinearScorer.load(spark, str(tmp_path / "none.json")) is None
    assert scoring.probe(lambda xyz: np.zeros((len(xyz), 5))) == 5
    with pytest.raises(ValueError, match="5 logits"):
        scoring.ChunkScorer(lambda xyz: np.zeros((len(xyz), 5)))
    told = []

    class Conditional(scoring.LinearScorer):
        def __call__(self, points):
            told.extend(points.columns)
            return super().__call__(points)

    evaluate.predict_points(cloud(spark, [(0, 0, 0), (1, 1, 1)]), EvalConfig(condition="ScanNet"), Conditional())
    assert {"condition", "context"} <= set(told)


def test_find_object_and_empty_lookups(spark):
    names = spark.createDataFrame([("b_cup_9",), ("a_cup_1",), ("plate",)], "object_id string")
    assert compose.find_object(names, "cup").collect()[0].object_id == "a_cup_1"
    assert compose.find_object(names, "fork").collect() == []


def test_clusters_write_few_tables(spark, monkeypatch):
    """Seven tables and one for each round; twice as many before."""
    written = []
    monkeypatch.setattr(clustering, "save", lambda df, name, of=clustering.save: written.append(name) or of(df, name))
    rng = np.random.default_rng(5)
    own = cloud(spark, [tuple(map(float, x)) for x in rng.random((300, 3))])
    assert clustering.dbscan(own, 0.15, 4).count() > 0
    assert len([n for n in written if n not in ("roots", "links")]) <= 6 and written.count("links") <= 2


def test_ranges_beyond_the_sample_are_not_sorted(spark):
    own = spark.range(2000).select((F.col("id") % 2).alias("scene_id"), F.col("id").alias("point_idx"))
    whole = ranked(own, ["scene_id"], 42, "t", "scene_id", "point_idx").where("_rank <= 30")
    few = ranked(own, ["scene_id"], 42, "t", "scene_id", "point_idx", most=30)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, whole.collect())) and few.count() == 60
