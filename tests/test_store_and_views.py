"""The scene store: resumed runs, uneven chunks, progress; and top views."""

import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointspark.operators import store, views
from pointspark.plans.config import ComposeConfig

CONFIG = ComposeConfig(chunk_samples=4)


def make(scenes):
    """Three points a scene."""
    return scenes.select("scene_id", F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])).alias("point_idx")).withColumn("x", F.col("scene_id") * 10.0 + F.col("point_idx"))


@pytest.fixture(scope="module")
def scenes(spark):
    return spark.createDataFrame([(i,) for i in range(30) if i not in (9, 10, 17)], "scene_id long").repartition(3)


def rows_of(spark, path):
    return sorted(map(tuple, store.read_store(spark, path).select("chunk_id", "position", "scene_id", "point_idx", "x").collect()))


class Stop(Exception):
    pass


def test_a_run_that_is_stopped_and_resumed_equals_a_whole_one(spark, scenes, tmp_path):
    whole, parts = f"file://{tmp_path}/whole", f"file://{tmp_path}/parts"
    assert store.write_store(scenes, make, whole, CONFIG) == 8
    composed = []

    def counting(some):
        composed.append(sorted(r.scene_id for r in some.collect()))
        return make(some)

    def stop_after(n):
        def told(progress):
            if progress.chunks >= n:
                raise Stop

        return told

    for n in (2, 4):
        with pytest.raises(Stop):
            store.write_store(scenes, counting, parts, CONFIG, lot=2, told=stop_after(n))
    assert store.manifest(spark, parts).count() == 6
    assert store.write_store(scenes, counting, parts, CONFIG, lot=2) == 2
    assert store.write_store(scenes, counting, parts, CONFIG, lot=2) == 0
    assert rows_of(spark, parts) == rows_of(spark, whole)
    flat = [i for some in composed for i in some]
    assert sorted(flat) == sorted(r.scene_id for r in scenes.collect())  # none is composed twice
    assert len(rows_of(spark, whole)) == 27 * 3


def test_what_a_dead_job_left_is_not_read(spark, scenes, tmp_path):
    path = f"file://{tmp_path}/store"

    def dies(some):
        return make(some).withColumn("x", F.when(F.col("scene_id") >= 20, F.raise_error(F.lit("dead"))).otherwise(F.col("x")))

    with pytest.raises(Exception, match="dead"):
        store.write_store(scenes, dies, path, CONFIG, lot=3)
    assert store.manifest(spark, path).count() == 3
    # A job that has written its folder but died before it was entered.
    make(scenes).withColumns({"chunk_id": F.lit(0).cast("long"), "position": F.lit(0)}).write.partitionBy("chunk_id").parquet(f"{path}/run=orphan")
    assert len(rows_of(spark, path)) == (4 + 4 + 2) * 3
    store.write_store(scenes, make, path, CONFIG)
    assert len(rows_of(spark, path)) == 27 * 3


def test_a_chunk_that_two_runs_have_entered_is_read_once(spark, scenes, tmp_path):
    path = f"file://{tmp_path}/store"
    store.write_store(scenes, make, path, CONFIG)
    before = rows_of(spark, path)
    again = spark.createDataFrame([("zzz", 0, 4)], store.MANIFEST)
    again.write.mode("append").parquet(f"{path}/manifest")
    assert rows_of(spark, path) == before


def test_samples_by_index_with_a_short_chunk_in_the_middle(spark, scenes, tmp_path):
    path = f"file://{tmp_path}/store"
    store.write_store(scenes, make, path, CONFIG)
    order = sorted(r.scene_id for r in scenes.collect())
    want = {i: (s // 4, sum(o // 4 == s // 4 for o in order[:i])) for i, s in enumerate(order)}
    index = store.chunk_index(store.manifest(spark, path))
    found = store.locate(spark.range(-2, 40).withColumnRenamed("id", "index"), index, CONFIG).collect()
    assert {r["index"]: (r.chunk_id, r.position) for r in found} == want and len(found) == len(want)
    for i in (0, 9, 15, 26):
        assert {r.scene_id for r in store.read_sample(spark, path, i, CONFIG).collect()} == {order[i]}
    with pytest.raises(IndexError):
        store.read_sample(spark, path, 27, CONFIG)


def test_locate_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(store, "RANGE", 8)
    rng = np.random.default_rng(1)
    sizes = {int(c): int(n) for c, n in zip(rng.choice(200, 60, replace=False), rng.integers(0, 30, 60), strict=True)} | {300: 500}
    index = store.chunk_index(spark.createDataFrame(list(sizes.items()), "chunk_id long, samples long"))
    want = [(c, p) for c in sorted(sizes) for p in range(sizes[c])]
    begins = {r.chunk_id: r.begins for r in index.collect()}
    assert begins == {c: sum(n for o, n in sizes.items() if o < c) for c in sizes}
    found = store.locate(spark.range(len(want) + 5).withColumnRenamed("id", "index"), index, CONFIG).collect()
    assert [(r.chunk_id, r.position) for r in sorted(found, key=lambda r: r["index"])] == want


def test_progress_is_observed_while_chunks_are_written(spark, scenes, tmp_path):
    told, path = [], f"file://{tmp_path}/store"
    store.write_store(scenes, make, path, CONFIG, lot=3, told=told.append)
    assert [(p.chunks, p.chunks_in_all) for p in told] == [(3, 8), (6, 8), (8, 8)]
    assert (told[-1].scenes, told[-1].points) == (27, 81) and [p.scenes for p in told] == sorted(p.scenes for p in told)
    assert told[0].scenes == 10 and told[0].seconds_left > 0 and told[-1].seconds_left == 0 and told[-1].scenes_a_second > 0
    assert store.read_store(spark, path).count() == told[-1].points


def test_an_empty_store(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    none = spark.createDataFrame([], "scene_id long")
    assert store.write_store(none, make, path, CONFIG) == 0 and store.manifest(spark, path).collect() == []
    with pytest.raises(ValueError, match="no chunks"):
        store.read_store(spark, path)


def decode_png(data):
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, packed = 8, b""
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        assert struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + body)
        if kind == b"IHDR":
            width, height = struct.unpack(">II", body[:8])
        packed += body if kind == b"IDAT" else b""
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + 3 * width)
    assert (lines[:, 0] == 0).all()
    return lines[:, 1:].reshape(height, width, 3)


def classified(spark, n):
    rng = np.random.default_rng(3)
    kinds = ["background", "alien", "target"]
    rows = [(s, i, *map(float, rng.random(2)), *map(float, rng.random(3)), kinds[int(rng.integers(0, 30)) // 14]) for s in ("a", "b") for i in range(n)]
    return spark.createDataFrame([*rows, ("flat", 0, 1.0, 2.0, None, 0.0, 1.0, "target")], "scene_id string, point_idx long, x double, y double, r double, g double, b double, class string")


def test_a_raster_does_not_grow_with_its_points(spark):
    few, many = (views.top_raster(classified(spark, n), 16, 8) for n in (3000, 12000))
    assert few.count() == many.count() == 2 * 16 * 8 + 1
    assert many.agg(F.sum("points")).first()[0] == 24001


def test_pictures_show_the_scene_and_its_classes(spark, tmp_path):
    own = classified(spark, 60)
    seen = views.top_views(views.top_raster(own, 16, 8), 16, 8)
    found = {r.scene_id: r for r in seen.collect()}
    assert set(found) == {"a", "b", "flat"}
    points = [r for r in own.collect() if r.scene_id == "a"]
    low, high = [[f(r[k] for r in points) for k in "xy"] for f in (min, max)]
    cells = {}
    for r in points:
        col, row = (min(int((v - a) / (b - a) * k), k - 1) for v, a, b, k in zip((r.x, r.y), low, high, (16, 8), strict=True))
        cells.setdefault((7 - row, col), []).append(r)
    picture = decode_png(bytes(found["a"].picture))
    assert picture.shape == (8, 40, 3)
    for row in range(8):
        for col in range(16):
            held = cells.get((row, col))
            want = [255] * 3 if held is None else [round(255 * sum(r[c] for r in held) / len(held)) for c in "rgb"]
            assert np.abs(picture[row, col].astype(int) - want).max() <= 1
            kinds = {r["class"] for r in held or []}
            painted = [255, 0, 0] if "target" in kinds else [0, 0, 255] if "alien" in kinds else None
            assert picture[row, 24 + col].tolist() == (painted or picture[row, col].tolist())
    assert (found["flat"].targets, found["flat"].aliens) == (1, 0)
    assert decode_png(bytes(found["flat"].picture))[7, 0].tolist() == [128, 0, 255]
    files = views.save_views(seen, str(tmp_path / "views")).collect()
    assert sorted(os.listdir(tmp_path / "views")) == sorted(f"{s}_segmentation_analysis.png" for s in found) and len(files) == 3
    assert (tmp_path / "views" / "a_segmentation_analysis.png").read_bytes() == bytes(found["a"].picture)


def test_a_lot_without_points(spark, scenes, tmp_path):
    """Scenes of which nothing can be composed are chunks without rows, and progress counts none."""
    told, path = [], f"file://{tmp_path}/store"
    assert store.write_store(scenes, lambda some: make(some).where("scene_id < 0"), path, CONFIG, told=told.append) == 8
    assert [(p.chunks, p.scenes, p.points) for p in told] == [(8, 0, 0)]
