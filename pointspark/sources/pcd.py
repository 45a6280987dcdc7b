"""Point cloud files: PCD in ascii and binary form, and object catalogues."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "path string, scene_id string, point_idx long, x double, y double, z double, r double, g double, b double, error string"
_KINDS = {("F", 4): "<f4", ("F", 8): "<f8", ("U", 1): "u1", ("U", 2): "<u2", ("U", 4): "<u4", ("I", 1): "i1", ("I", 2): "<i2", ("I", 4): "<i4", ("U", 8): "<u8", ("I", 8): "<i8"}

#: Fields that points are made of.
USED = {*"xyzrgb", "rgb", "rgba"}


def _unpack_lzf(data: bytes, size: int) -> bytes:
    """LZF: a control byte below 32 is a run of literals, any other a copy of what was put out before."""
    out, at = bytearray(), 0
    while at < len(data):
        control = data[at]
        at += 1
        if control < 32:
            out += data[at : at + control + 1]
            at += control + 1
            continue
        length = control >> 5
        if length == 7:
            length += data[at]
            at += 1
        back = ((control & 31) << 8 | data[at]) + 1
        at, length = at + 1, length + 2
        if back > len(out):
            raise ValueError("a compressed PCD copies from before its beginning")
        piece = bytes(out[-back:])[:length]
        out += (piece * (length // len(piece) + 1))[:length]
    if len(out) != size:
        raise ValueError("a compressed PCD does not have the size that it gives")
    return bytes(out)


@dataclass(frozen=True)
class Header:
    """What the header of a PCD file says, and where its data begins."""

    names: tuple[str, ...]
    kinds: tuple[str, ...]
    counts: tuple[int, ...]
    form: str
    points: int | None
    begins: int

    @property
    def record(self) -> np.dtype:
        """A point in the binary form."""
        return np.dtype([(x, t, (c,)) for x, t, c in zip(self.names, self.kinds, self.counts, strict=True)])


def read_header(content: bytes) -> Header:
    """The header at the beginning of a file; an error if there is none."""
    head, _, rest = content.partition(b"DATA ")
    form, _, data = rest.partition(b"\n")
    said = {k.decode(): v.split() for k, _, v in (line.strip().partition(b" ") for line in head.splitlines()) if k and not k.startswith(b"#")}
    names = tuple(x.decode() for x in said["FIELDS"])
    kinds = tuple(_KINDS[t.decode(), int(s)] for t, s in zip(said["TYPE"], said["SIZE"], strict=True))
    counts = tuple(int(c) for c in said.get("COUNT", [b"1"] * len(names)))
    if not {*"xyz"} <= {*names} or not len(names) == len(kinds) == len(counts):
        raise ValueError("the header does not describe points")
    form = form.strip().decode(errors="replace")
    if form not in ("ascii", "binary", "binary_compressed"):
        raise ValueError(f"PCD data form {form!r} is not supported")
    points = int(said["POINTS"][0]) if "POINTS" in said else None
    return Header(names, kinds, counts, form, points, len(content) - len(data))


def ascii_fields(header: Header, data: bytes) -> dict[str, np.ndarray]:
    """The fields of lines of text; lines that lack a value or hold no number are left out."""
    first = (np.cumsum(header.counts) - header.counts).tolist()
    wanted = [(n, i, float if t[-2] == "f" else np.int64) for n, i, t in zip(header.names, first, header.kinds, strict=True) if n in USED]
    width = first[-1] + header.counts[-1]
    rows = [line.split() for line in data.splitlines()]
    rows = [r for r in rows if len(r) >= width]

    def columns(rows: list[list[bytes]]) -> dict[str, np.ndarray]:
        return {n: np.array([r[i] for r in rows], "S").astype(kind) for n, i, kind in wanted}

    try:
        return columns(rows)
    except ValueError:
        good = []
        for r in rows:
            try:
                columns([r])
            except ValueError:
                continue
            good.append(r)
        return columns(good)


def as_points(found: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Columns x, y, z and r, g, b (in [0, 1], NaN without colours) of a file's fields."""
    n = len(found["x"])
    if "rgb" in found or "rgba" in found:
        packed = found["rgb"] if "rgb" in found else found["rgba"]
        packed = np.ascontiguousarray(packed).astype("<f4").view("<u4") if packed.dtype.kind == "f" else packed
        colours = {c: (packed.astype(np.int64) >> s & 255) / 255 for c, s in zip("rgb", (16, 8, 0), strict=True)}
    else:
        colours = {c: found[c] / 255 if c in found else np.full(n, np.nan) for c in "rgb"}
    return {a: found[a].astype(float) for a in "xyz"} | colours


def decode_pcd(content: bytes) -> dict[str, np.ndarray]:
    """Columns x, y, z and r, g, b (in [0, 1], NaN without colours) of a file in ascii, binary or compressed form.

    A field with a COUNT above 1 takes that many values; its first is used.
    """
    header = read_header(content)
    data = content[header.begins :]
    if header.form == "ascii":
        return as_points(ascii_fields(header, data))
    if header.points is None:
        raise ValueError("the header does not tell the number of points")
    if header.form == "binary":
        size = header.points * header.record.itemsize
        if len(data) < size:
            raise ValueError("a binary PCD holds fewer points than it tells")
        return as_points(binary_fields(header, data[:size]))
    packed, size = np.frombuffer(data, "<u4", 2).tolist()
    raw, at, found = _unpack_lzf(data[8 : 8 + packed], size), 0, {}
    for x, t, c in zip(header.names, header.kinds, header.counts, strict=True):
        found[x] = np.frombuffer(raw, t, header.points * c, at)[::c]
        at += header.points * c * np.dtype(t).itemsize
    return as_points(found)


def binary_fields(header: Header, data: bytes) -> dict[str, np.ndarray]:
    """The fields of whole records."""
    table = np.frombuffer(data, header.record)
    return {x: table[x][:, 0] for x in header.names if x in USED}


def parse_text(content: bytes) -> dict[str, np.ndarray]:
    """What ``parse_lines`` finds in a whole file, from after its ``DATA ascii`` line or, without one, from its start."""
    lines = content.decode("utf-8", "replace").splitlines()
    begin = next((i + 1 for i, line in enumerate(lines) if line.strip().startswith("DATA ascii")), 0)
    rows = []
    for line in lines[begin:]:
        parts = line.split()
        try:
            if len(parts) >= 6:
                colours = [int(p) for p in parts[3:6]]
            elif len(parts) >= 4:
                colours = [int(parts[3]) >> s & 255 for s in (16, 8, 0)]
            else:
                continue
            rows.append([*map(float, parts[:3]), *[c / 255 for c in colours]])
        except ValueError:
            continue
    table = np.array(rows, float).reshape(-1, 6)
    return {c: table[:, i] for i, c in enumerate("xyzrgb")}


def decode_any(content: bytes) -> dict[str, np.ndarray]:
    """``decode_pcd``; only where that fails or finds no points, what ``parse_text`` finds, if anything.

    A file whose header decodes keeps all its points, with or without colours:
    lines of other fields, such as normals, could pass for colours as text.
    """
    try:
        found, error = decode_pcd(content), None
        if len(found["x"]):
            return found
    except Exception as e:  # noqa: BLE001  any broken file is tried as text
        found, error = None, e
    plain = parse_text(content)
    if len(plain["x"]):
        return plain
    if found is None:
        raise error
    return found


def read_pcd(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """All points of the ``.pcd`` files of a folder, through Spark's own file access.

    A file that is no PCD, or holds no points as one, is read as lines of text,
    if it holds any points in that form.  A file that cannot be read is one row with
    ``error`` set and no point, so one bad scan does not end a run.  A file is a
    scan and is decoded whole.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pcd").option("recursiveFileLookup", str(recursive).lower()).load(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = re.sub(r"\.pcd$", "", where.rsplit("/", 1)[-1])
                try:
                    found, error = decode_any(content), None
                    n = len(found["x"])
                except Exception as e:  # noqa: BLE001  any broken file becomes a row
                    found, error, n = {c: np.zeros(1) for c in "xyzrgb"}, f"{type(e).__name__}: {e}", 1
                good = [pa.array(found[c], pa.float64(), mask=np.full(n, True) if error else np.isnan(found[c]) if c in "rgb" else None) for c in "xyzrgb"]
                index = pa.array([None] if error else np.arange(n), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([where] * n, pa.string()), pa.array([name] * n, pa.string()), index, *good, pa.array([error] * n, pa.string())], [c.split()[0] for c in SCHEMA.split(", ")])

    return files.select("path", "content").mapInArrow(decode, SCHEMA)


def object_samples(clouds: DataFrame) -> DataFrame:
    """object_id (the file's folder) and sample_idx (rank of the file among its folder's files with points)."""
    folder = F.element_at(F.split("path", "/"), -2)
    files = clouds.where("error is null").select("path").distinct().withColumn("object_id", folder)
    numbered = files.withColumn("sample_idx", F.row_number().over(Window.partitionBy("object_id").orderBy("path")) - 1)
    return clouds.where("error is null").join(numbered, "path")


def parse_lines(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """Points of text lines: ``x y z r g b`` or ``x y z rgb``; other and broken lines are left out.

    Colours are divided by 255.  Integers must be written as such.
    """
    # An outer generator of one row keeps the parts in a column, so each line is split once.
    parts = F.array(F.split(F.trim(F.col(text_col)), r"\s+"))
    part = lambda i, kind: F.get(F.col("_t"), F.lit(i)).try_cast(kind)
    rows = lines.select("*", F.explode_outer(parts).alias("_t")).withColumn("_n", F.size("_t")).where("_n >= 4")
    packed = part(3, "bigint")
    wide = F.col("_n") >= 6
    out = {a: part(i, "double") for i, a in enumerate("xyz")}
    for i, (c, shift) in enumerate(zip("rgb", (16, 8, 0), strict=True)):
        value = F.when(wide, part(3 + i, "int")).otherwise(F.shiftright(packed, shift).bitwiseAND(255).cast("int"))
        out[c] = value / 255.0
    keep = F.lit(True)
    for c in "xyzrgb":
        keep = keep & F.col(c).isNotNull()
    return rows.withColumns(out).where(keep).drop("_t", "_n")


def write_pcd(points: DataFrame, path: str) -> None:
    """Ascii PCD text, a folder and file for each scene; header first, points in order.

    Points of a scene are sorted within one task and streamed out.
    """
    colours = [F.greatest(F.lit(0), F.least(F.lit(255), F.round(F.coalesce(c, F.lit(0.5)) * 255).cast("int"))) for c in "rgb"]
    line = F.concat_ws(" ", *[F.col(a).cast("string") for a in "xyz"], *[c.cast("string") for c in colours])
    rows = points.select("scene_id", F.col("point_idx").alias("at"), line.alias("value"))
    head = points.groupBy("scene_id").agg(F.count("*").cast("string").alias("n"))
    header = F.concat(
        F.lit("VERSION .7\nFIELDS x y z r g b\nSIZE 8 8 8 1 1 1\nTYPE F F F U U U\nCOUNT 1 1 1 1 1 1\nWIDTH "), F.col("n"),
        F.lit("\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS "), F.col("n"), F.lit("\nDATA ascii"),
    )
    both = rows.unionByName(head.select("scene_id", F.lit(-1).cast("long").alias("at"), header.alias("value")))
    both.repartition("scene_id").sortWithinPartitions("scene_id", "at").select("scene_id", "value").write.partitionBy("scene_id").text(path)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """An object catalogue (CSV with a header): ids stay text, forces and weights are numbers, unknown values are null."""
    raw = spark.read.option("header", "true").schema("object_name string, category string, ean string, product_name string, grasp_force_n string, weight_g string").csv(path)
    return clean_catalog(raw)


def clean_catalog(raw: DataFrame) -> DataFrame:
    """Catalogue rows of text with unknown values as nulls and numbers as such."""
    unknown = lambda c: F.when(F.lower(F.trim(c)).isin("", "none", "null"), None).otherwise(F.trim(c))
    text = {c: unknown(F.col(c)) for c in ("object_name", "category", "ean", "product_name")}
    number = {c: unknown(F.col(c)).try_cast("int") for c in ("grasp_force_n", "weight_g")}
    return raw.withColumns(text | number)


def join_catalog(samples: DataFrame, catalog: DataFrame) -> DataFrame:
    """Samples (ean) with what the catalogue knows of their objects; an equi-join, so the catalogue may be of any size."""
    return samples.join(catalog, "ean", "left")
