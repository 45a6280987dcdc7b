"""Top views of scenes: rasters of fixed size by partial aggregation, and pictures made of them."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH, HEIGHT = 256, 256
#: Colours of the classes that are drawn over the scene's own.
PAINT = {"target": (255, 0, 0), "alien": (0, 0, 255)}


def _axis(axis: str, cells: int):
    """The cell of a coordinate; the largest belongs to the last cell, and a flat axis is the first."""
    low, high = F.col(f"min_{axis}"), F.col(f"max_{axis}")
    share = (F.col(axis) - low) / F.nullif(high - low, F.lit(0.0))
    return F.when(high > low, F.least(F.floor(share * cells), F.lit(cells - 1))).otherwise(0).cast("int")


def top_raster(classified: DataFrame, width: int = WIDTH, height: int = HEIGHT) -> DataFrame:
    """(scene_id, col, row, points, r, g, b, top) of the cells that hold points: mean colours, and the class that is drawn last.

    A target is drawn over an alien, and both over the rest, so a point of them
    is never hidden.  Cells are at most ``width`` times ``height`` a scene,
    whatever its points; points are added up where they are before any move.
    """
    span = classified.groupBy("scene_id").agg(*[f(a).alias(f"{n}_{a}") for a in "xy" for n, f in (("min", F.min), ("max", F.max))])
    placed = classified.join(span, "scene_id").withColumns({"col": _axis("x", width), "row": _axis("y", height)})
    held = lambda name: F.max((F.col("class") == name).cast("int"))
    colours = [F.avg(F.coalesce(c, F.lit(0.5))).alias(c) for c in "rgb"]
    cells = placed.groupBy("scene_id", "col", "row").agg(F.count("*").alias("points"), *colours, held("target").alias("_target"), held("alien").alias("_alien"))
    top = F.when(F.col("_target") == 1, "target").when(F.col("_alien") == 1, "alien").otherwise("background")
    return cells.withColumn("top", top).drop("_target", "_alien")


def png(pixels: np.ndarray) -> bytes:
    """An image (rows, columns, 3) of bytes as PNG."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = np.concatenate([np.zeros((len(pixels), 1), np.uint8), pixels.reshape(len(pixels), -1)], axis=1)
    head = struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def top_views(raster: DataFrame, width: int = WIDTH, height: int = HEIGHT) -> DataFrame:
    """(scene_id, targets, aliens, picture): the scene in its own colours at the left, with its classes painted at the right.

    x goes to the right and y upwards; cells without points are white.  A
    scene's cells are one task's, which the raster's size bounds.
    """

    def draw(table: pa.Table) -> pa.Table:
        row, col = height - 1 - table["row"].to_numpy(), table["col"].to_numpy()
        own = np.full((height, width, 3), 255, np.uint8)
        own[row, col] = np.rint(255 * np.clip(np.stack([table[c].to_numpy() for c in "rgb"], 1), 0, 1)).astype(np.uint8)
        painted, top = own.copy(), np.array(table["top"].to_pylist())
        for name, colour in PAINT.items():
            painted[row[top == name], col[top == name]] = colour
        gap = np.full((height, 8, 3), 255, np.uint8)
        count = [pa.array([int((top == name).sum())], pa.int64()) for name in PAINT]
        return pa.table([table["scene_id"].slice(0, 1), *count, pa.array([png(np.concatenate([own, gap, painted], axis=1))], pa.binary())], ["scene_id", "targets", "aliens", "picture"])

    kind = raster.schema["scene_id"].dataType.simpleString()
    return raster.groupBy("scene_id").applyInArrow(draw, f"scene_id {kind}, targets long, aliens long, picture binary")


def save_views(views: DataFrame, path: str) -> DataFrame:
    """Write each picture as ``<scene>_segmentation_analysis.png``, by its task; (scene_id, file) of what is written, once that is asked for."""
    kind = views.schema["scene_id"].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(path)
        system.create_dir(root)
        for batch in batches:
            files = []
            for scene, picture in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                files.append(f"{root}/{scene}_segmentation_analysis.png")
                with system.open_output_stream(files[-1]) as out:
                    out.write(picture.as_py())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.string())], ["scene_id", "file"])

    return views.select("scene_id", "picture").mapInArrow(write, f"scene_id {kind}, file string")
