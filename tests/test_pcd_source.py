"""The pcd data source and sink: ranges of files, pruning, parts of scenes, aborts."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pointspark.sources import pcd, pcd_source

HEAD = "# .PCD v0.7\nVERSION 0.7\nFIELDS {fields}\nSIZE {sizes}\nTYPE {types}\nCOUNT {counts}\nWIDTH {n}\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS {n}\nDATA {form}\n"


def head(fields, sizes, types, n, form):
    return HEAD.format(fields=" ".join(fields), sizes=" ".join(map(str, sizes)), types=" ".join(types), counts=" ".join("1" for _ in fields), n=n, form=form).encode()


def rows_of(df):
    return sorted(((r.scene_id, r.point_idx, r.x, r.y, r.z, r.r, r.g, r.b, r.error) for r in df.collect()), key=str)


def ascii_cloud(n, fields=("x", "y", "z", "rgb")):
    lines = [f"{i} {i / 8} {-i}" + (f" {i * 77 % (1 << 24)}" if "rgb" in fields else "") for i in range(n)]
    return head(fields, [4] * len(fields), ["F", "F", "F", "U"][: len(fields)], n, "ascii") + ("\n".join(lines) + "\n").encode()


def binary_cloud(n):
    table = np.zeros(n, [("pad", "<f4"), ("x", "<f8"), ("y", "<f4"), ("z", "<i8"), ("t", "<u8"), ("rgb", "<u4")])
    table["x"], table["y"], table["z"], table["t"], table["rgb"] = np.arange(n), np.arange(n) / 8, -np.arange(n), 2**63, np.arange(n) * 77 % (1 << 24)
    return head(["pad", "x", "y", "z", "t", "rgb"], [4, 8, 4, 8, 8, 4], "FFFIUU", n, "binary") + table.tobytes()


def test_a_header_that_decodes_keeps_all_points():
    """Lines of other fields, one of whose values looks like a colour, are no text of points and colours."""
    normals = ["0.5 0 0.25", "0 0 1", "1 0.5 0", "0.1 0.2 0.3", "0.9 0.9 0.9"]
    content = head(["x", "y", "z", "normal_x", "normal_y", "normal_z"], [4] * 6, "FFFFFF", 5, "ascii") + "\n".join(f"{i} 0 0 {v}" for i, v in enumerate(normals)).encode()
    found = pcd.decode_any(content)
    assert found["x"].tolist() == [0, 1, 2, 3, 4] and np.isnan(found["r"]).all()
    content = head(["x", "y", "z", "intensity"], [4] * 4, "FFFF", 3, "ascii") + b"1 2 3 0.5\n4 5 6 1\n7 8 9 0.25\n"
    found = pcd.decode_any(content)
    assert found["x"].tolist() == [1, 4, 7] and np.isnan(found["g"]).all()


def test_broken_lines_go_and_the_others_stay():
    content = head(["x", "y", "z", "intensity"], [4] * 4, "FFFF", 4, "ascii") + b"1 2 3 1\n4 five 6 1\n7 8\n\n9 9 9 1\n"
    assert pcd.decode_any(content)["x"].tolist() == [1, 9]


def test_a_header_without_good_lines_is_read_as_text():
    content = head(["x", "y", "z", "a", "b", "c", "d"], [4] * 7, "FFFFFFF", 1, "ascii") + b"1 2 3 255 0 51\n"
    found = pcd.decode_any(content)
    assert found["x"].tolist() == [1] and found["b"].tolist() == [0.2]


def test_eight_byte_integers_and_short_files(spark, tmp_path):
    (tmp_path / "a.pcd").write_bytes(binary_cloud(5))
    (tmp_path / "b.pcd").write_bytes(binary_cloud(5)[:-3])
    found = pcd_source.load_pcd(spark, str(tmp_path))
    assert found.where("error is null").orderBy("point_idx").select("z").toPandas()["z"].tolist() == [0, -1, -2, -3, -4]
    (bad,) = found.where("error is not null").collect()
    assert bad.scene_id == "b" and "fewer points" in bad.error and bad.x is None


@pytest.mark.parametrize("split", [37, 64, 1000, 1 << 20])
def test_ranges_have_all_points_once(spark, tmp_path, split):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "one.pcd").write_bytes(ascii_cloud(301))
    (tmp_path / "in" / "two.pcd").write_bytes(binary_cloud(300))
    (tmp_path / "in" / "three.pcd").write_bytes(ascii_cloud(7, ("x", "y", "z")).rstrip(b"\n"))
    (tmp_path / "in" / "four.pcd").write_bytes(b"no header\n" + b"1 2 3 255 0 51\nbroken 1 2 3\n4 5 6 16711680\n" * 30)
    (tmp_path / "in" / "five.pcd").write_bytes(b"nothing")
    (tmp_path / "in" / "empty.pcd").write_bytes(ascii_cloud(0))
    (tmp_path / "in" / "deep" / "six.pcd").write_bytes(ascii_cloud(3))
    (tmp_path / "in" / "other.txt").write_bytes(ascii_cloud(3))
    path = str(tmp_path / "in")
    own = pcd_source.load_pcd(spark, path, recursive="true", splitBytes=split)
    found, want = rows_of(own), rows_of(pcd.read_pcd(spark, path, recursive=True))
    keep = lambda rows: [r for r in rows if r[0] != "five"]
    assert keep(found) == keep(want)
    # What holds nothing is an error where it is read whole, and no points where it is read by ranges of lines.
    assert [r[-1] is None for r in found if r[0] == "five"] == ([False] if split > 7 else [])
    if split < 100:
        assert spark.read.format("pcd").options(recursive="true", splitBytes=split).load(path).rdd.getNumPartitions() > 20


def test_lines_at_the_edges_of_ranges(tmp_path):
    """Each line is the one range's in which it begins, wherever the cuts are."""
    data = b"a\nbb\n\nccc\ndddd\n\n\ne"
    path = tmp_path / "lines"
    path.write_bytes(b"HEAD\n" + data)
    for step in range(1, len(data) + 2):
        for block in (1, 3, 1000):
            pcd_source.BLOCK, whole = block, pcd_source.BLOCK
            try:
                with pa.OSFile(str(path)) as stream:
                    found = []
                    for at in range(5, 5 + len(data), step):
                        found += pcd_source.lines_of(stream, pcd_source.Piece("", "text", None, at, min(at + step, 5 + len(data)), 5))
            finally:
                pcd_source.BLOCK = whole
            assert b"".join(found) == data, (step, block, found)


def test_a_schema_of_fewer_columns_and_a_glob(spark, tmp_path):
    (tmp_path / "one.pcd").write_bytes(ascii_cloud(5))
    (tmp_path / "two.pcd").write_bytes(binary_cloud(4))
    pcd_source.register(spark)
    few = spark.read.format("pcd").schema("z double, scene_id string").option("pathGlobFilter", "tw*").load(str(tmp_path))
    assert few.columns == ["z", "scene_id"] and sorted(r.z for r in few.collect()) == [-3, -2, -1, 0]
    assert {r.scene_id for r in few.collect()} == {"two"}
    with pytest.raises(Exception, match="no columns weight"):
        spark.read.format("pcd").schema("weight double").load(str(tmp_path)).collect()


def test_failfast_and_missing_folder(spark, tmp_path):
    (tmp_path / "bad.pcd").write_bytes(b"nothing")
    pcd_source.register(spark)
    with pytest.raises(Exception, match="FIELDS"):
        spark.read.format("pcd").option("mode", "FAILFAST").load(str(tmp_path)).collect()
    with pytest.raises(Exception, match="FileNotFound"):
        spark.read.format("pcd").load(str(tmp_path / "none")).collect()
    (tmp_path / "void").mkdir()
    assert pcd_source.load_pcd(spark, str(tmp_path / "void")).count() == 0


def scenes(spark, sizes):
    rows = [(s, i, i / 8, -i * 1.5, s * 1.0, (i % 256) / 255, 0.2, 1.0, "more") for s, n in enumerate(sizes) for i in range(n)]
    return spark.createDataFrame(rows, "scene_id long, point_idx long, x double, y double, z double, r double, g double, b double, extra string").repartition(5)


@pytest.mark.parametrize("form", ["binary", "ascii"])
def test_what_is_written_reads_back(spark, tmp_path, form):
    own = scenes(spark, [600, 40, 1, 300])
    path = str(tmp_path / "out")
    pcd_source.save_pcd(own, path, form=form)
    assert sorted(os.listdir(path)) == ["0.pcd", "1.pcd", "2.pcd", "3.pcd"]
    want = sorted((str(r.scene_id), r.point_idx, r.x, r.y, r.z, r.r, r.g, r.b, None) for r in own.collect())
    for found in (pcd_source.load_pcd(spark, path), pcd_source.load_pcd(spark, path, splitBytes=200), pcd.read_pcd(spark, path)):
        assert rows_of(found) == sorted(want, key=str)


def test_a_large_scene_is_several_tasks(spark, tmp_path):
    own = scenes(spark, [900, 30, 30, 30])
    pcd_source.save_pcd(own, str(tmp_path / "out"), layout="parts")
    names = sorted(os.listdir(tmp_path / "out"))
    of_first = [n for n in names if n.startswith("0-")]
    assert len(of_first) >= 3
    most = max(len(pcd.decode_pcd((tmp_path / "out" / n).read_bytes())["x"]) for n in of_first)
    assert most <= 500
    # The parts are in order of their points.
    whole = np.concatenate([pcd.decode_pcd((tmp_path / "out" / n).read_bytes())["x"] for n in of_first])
    assert whole.tolist() == [i / 8 for i in range(900)]


def test_names_nulls_and_missing_colours(spark, tmp_path):
    rows = [("a/b c", 0, 1.0, None, float("nan")), (None, 0, 2.0, 0.0, 0.0)]
    own = spark.createDataFrame(rows, "scene_id string, point_idx long, x double, y double, z double")
    pcd_source.save_pcd(own, str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == ["a%2Fb c.pcd", "null.pcd"]
    found = pcd.decode_pcd((tmp_path / "out" / "a%2Fb c.pcd").read_bytes())
    assert np.isnan(found["y"]).all() and np.isnan(found["z"]).all() and found["r"].tolist() == [pytest.approx(0.5, abs=1 / 255)]


def test_append_overwrite_and_empty(spark, tmp_path):
    path = str(tmp_path / "out")
    pcd_source.save_pcd(scenes(spark, [5, 6]), path)
    with pytest.raises(Exception, match="already written"):
        pcd_source.save_pcd(scenes(spark, [7]), path)
    assert pcd_source.load_pcd(spark, path).count() == 11 and not [n for n in os.listdir(path) if n.startswith("_")]
    pcd_source.save_pcd(scenes(spark, [7]), path, overwrite=True)
    assert os.listdir(path) == ["0.pcd"] and pcd_source.load_pcd(spark, path).count() == 7
    pcd_source.save_pcd(scenes(spark, []), str(tmp_path / "none"))
    assert not os.path.exists(tmp_path / "none") or os.listdir(tmp_path / "none") == []


@pytest.mark.parametrize("death", ["raises", "is killed"])
def test_a_task_that_ends_midway_leaves_no_file(spark, tmp_path, death):
    def fail(batches):
        for batch in batches:
            if "2" in batch.column(0).to_pylist():
                if death == "raises":
                    raise RuntimeError("midway")
                os._exit(3)
            yield batch

    pcd_source.register(spark)
    own = scenes(spark, [400, 100, 100]).select(F.col("scene_id").cast("string").alias("scene_id"), "point_idx", "x", "y", "z", "r", "g", "b")
    bad = own.repartition(4, "scene_id").sortWithinPartitions("scene_id", "point_idx").mapInArrow(fail, own.schema)
    with pytest.raises(Exception, match="midway|exited|crash|EOF|abort"):
        bad.write.format("pcd").mode("append").option("path", str(tmp_path / "out")).save()
    assert not os.path.exists(tmp_path / "out") or os.listdir(tmp_path / "out") == []
