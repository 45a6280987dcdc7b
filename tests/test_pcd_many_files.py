"""Many small scenes: tasks and the driver's copies do not grow with their number."""

from pyspark.sql import functions as F

from pointspark.sources import pcd_source


def scenes(spark, n, points):
    return spark.range(n * points).select(
        F.expr(f"id div {points}").alias("scene_id"), F.expr(f"id % {points}").alias("point_idx"), *[(F.col("id") * k / 8).alias(a) for k, a in enumerate("xyz", 1)], *[(F.col("id") % 256 / 255).alias(c) for c in "rgb"]
    )


def test_ranges_of_many_files_share_tasks(tmp_path):
    for i in range(1500):
        (tmp_path / f"{i}.pcd").write_bytes(b"x" * 3000)
    parts = pcd_source.PcdReader({"path": str(tmp_path), "splitbytes": "1000"}, ["x"]).partitions()
    pieces = [p for part in parts for p in part.value]
    assert len(pieces) == len({(p.path, p.part) for p in pieces}) == 4500
    assert len(parts) <= 1.1 * pcd_source.SHARE


def test_a_scene_of_one_task_is_not_copied_by_the_driver(spark, tmp_path, monkeypatch):
    copied = []
    inner = pcd_source.PcdWriter._with_header

    def counted(self, system, files, n):
        copied.append(n)
        return inner(self, system, files, n)

    monkeypatch.setattr(pcd_source.PcdWriter, "_with_header", counted)
    for form in ("binary", "ascii"):
        own, path = scenes(spark, 60, 40), str(tmp_path / form)
        writer = pcd_source.PcdWriter({"path": path, "form": form}, False)
        system, root = pcd_source.opened(path)
        system.create_dir(f"{root}/{writer.staging}")
        batches = own.select(F.col("scene_id").cast("string").alias("scene_id"), "point_idx", *"xyzrgb").orderBy(F.col("scene_id").cast("int"), "point_idx").toArrow().to_batches(max_chunksize=700)
        # The first lot ends inside a scene; the two parts of that one are joined.
        first, second = [b.slice(0, 650) for b in batches[:1]], [batches[0].slice(650), *batches[1:]]
        copied.clear()
        writer.commit([writer.write(iter(first)), writer.write(iter(second))])
        assert copied == [40]
        found = pcd_source.load_pcd(spark, path, splitBytes=500)
        want = {(str(r.scene_id), r.point_idx, r.x, r.y, r.z) for r in own.collect()}
        rows = found.where("error is null").collect()
        assert len(rows) == 2400 and {(r.scene_id, r.point_idx, r.x, r.y, r.z) for r in rows} == want


def test_points_that_have_their_numbers_are_not_moved(spark, tmp_path):
    pcd_source.save_pcd(scenes(spark, 3, 200), str(tmp_path / "b"))
    found = pcd_source.load_pcd(spark, str(tmp_path / "b"), splitBytes=1000)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.point_idx for r in found.where("scene_id = '1'").collect()) == list(range(200))
