"""PCD files as a Spark data source and sink: ``spark.read.format("pcd")`` and ``df.write.format("pcd")``.

Files are opened by ``pyarrow.fs``, on the driver and in tasks alike, so a path
is local or a URI of a store that it knows.  ``pcd.read_pcd`` reads through
Spark's own file access where that is not so.

Reading: a file of more than ``splitBytes`` is read by several tasks, each a
range of bytes; a range has the records, or the lines, that begin in it.  Small
files, and ranges of files where all are small, are packed into tasks, so their
number is bounded; the driver lists files and opens none.  A schema of fewer
columns makes only these.  A compressed file can't be cut and is one task's.

``point_idx`` counts the points of a file.  What a line's number is no range of
lines can know: there, ``part`` is the range's number and ``point_idx`` counts
in the range; ``number_points`` makes it the file's.

Writing: each task writes its rows of a scene as a part, so a scene of any size
is many tasks'; parts become files at the commit, after all tasks, and an abort
leaves nothing.  Joined, a scene is one file: that of its only part, which has
its header from the task, or a header and its parts in order of their points,
copied as streams by the driver.  With ``layout`` parts, each part is a file of
its own with a header, and nothing passes the driver.

Defined results: a file that can't be read is a row with ``error`` and no point,
unless ``mode`` is FAILFAST; a file without points has no rows; null coordinates
are NaN; missing colours are read as null and written as grey; a null scene is
written as ``null``; other columns are not written.
"""

from __future__ import annotations

import fnmatch
import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from pointspark.functions.shared import save
from pointspark.sources import pcd

SCHEMA = "path string, scene_id string, part int, point_idx long, x double, y double, z double, r double, g double, b double, error string"
KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
COLUMNS = {name: KINDS[kind] for name, kind in (x.split() for x in SCHEMA.split(", "))}
#: Bytes of a task, of a header at most, and of what is held at a time.
SPLIT, HEAD, BLOCK = 64 << 20, 1 << 16, 4 << 20
#: Ranges and files are packed until a task has this share of all bytes, or ``SPLIT``.
SHARE = 256
#: Scenes that are joined, and files that are moved, at a time.
JOINED = 8


@dataclass(frozen=True)
class Piece:
    """What a task reads of a file: all of it (no form), or what begins in a range of bytes.

    ``of`` asks for range ``part`` of so many; where it lies, the task reads from the header.
    """

    path: str
    form: str | None = None
    header: pcd.Header | None = None
    begin: int = 0
    end: int = 0
    starts: int = 0
    part: int = 0
    of: int = 0


class Pieces(InputPartition):
    def __init__(self, value: list[Piece]):
        self.value = value


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else (fs.LocalFileSystem(), path)


class PcdSource(DataSource):
    """Options: path, recursive, pathGlobFilter, splitBytes, mode; for writing path, form (binary, ascii) and layout (joined, parts)."""

    @classmethod
    def name(cls) -> str:
        return "pcd"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PcdReader:
        return PcdReader(dict(self.options), schema.fieldNames())

    def writer(self, schema, overwrite: bool) -> PcdWriter:
        writer = PcdWriter(dict(self.options), overwrite)
        # Here and not in tasks: one that comes late to a write that was aborted finds no folder and fails.
        system, root = opened(writer.path)
        system.create_dir(f"{root}/{writer.staging}")
        return writer


class PcdReader(DataSourceReader):
    def __init__(self, options: dict[str, str], names: list[str]):
        if unknown := [n for n in names if n not in COLUMNS]:
            raise ValueError(f"a PCD file has no columns {', '.join(unknown)}")
        self.names, self.path = names, options["path"]
        self.recursive = options.get("recursive", "false").lower() == "true"
        self.glob, self.split = options.get("pathglobfilter", "*.pcd"), int(options.get("splitbytes", SPLIT))
        self.failfast = options.get("mode", "PERMISSIVE").upper() == "FAILFAST"
        #: One row for each range of lines, with the number of its points as ``point_idx``, and nothing else.
        self.counting = options.get("counting", "false").lower() == "true"

    def partitions(self) -> list[Pieces]:
        system, root = opened(self.path)
        info = system.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.is_file else system.get_file_info(fs.FileSelector(root, recursive=self.recursive))
        files = sorted((f for f in files if f.is_file and fnmatch.fnmatch(f.base_name, self.glob)), key=lambda f: f.path)
        least = max(self.split, min(SPLIT, sum(f.size for f in files) // SHARE))
        out, held, size = [], [], 0
        for file in files:
            n = -(-file.size // self.split) if file.size > self.split else 1
            for i in range(n):
                held.append(Piece(file.path, part=i, of=n) if n > 1 else Piece(file.path))
                size += -(-file.size // n)
                if size >= least:
                    out.append(Pieces(held))
                    held, size = [], 0
        return [*out, Pieces(held)] if held or not out else out

    def _range(self, stream, piece: Piece) -> Piece | None:
        """Where the range of a large file lies; the first has all of a file that must be read whole, and the others nothing."""
        size = stream.size()
        head = stream.read(HEAD)
        try:
            header = pcd.read_header(head)
        except Exception:  # noqa: BLE001  read as text, from after its DATA line if it has one
            found = re.search(rb"^\s*DATA ascii[^\n]*\n", head, re.MULTILINE)
            header, form, begins = None, "text", found.end() if found else 0
        else:
            form, begins = header.form, header.begins
        if form == "binary_compressed" or form == "binary" and (header.points is None or begins + header.points * header.record.itemsize > size):
            stream.seek(0)
            return None if piece.part else Piece(piece.path)
        unit = header.record.itemsize if form == "binary" else 1
        end = begins + header.points * unit if form == "binary" else size
        step = max(1, -(-((end - begins) // unit) // piece.of)) * unit
        begin = begins + piece.part * step
        return Piece(piece.path, form, header, begin, min(begin + step, end), begins, piece.part) if begin < end else None

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.path)
        for piece in partition.value:
            try:
                yield from self._counts(system, piece) if self.counting else self._points(system, piece)
            except Exception as e:  # noqa: BLE001  any broken file becomes a row
                if self.failfast:
                    raise
                if self.counting:
                    continue
                yield self._batch(piece, None, 0, f"{type(e).__name__}: {e}")

    def _points(self, system: fs.FileSystem, piece: Piece) -> Iterator[pa.RecordBatch]:
        with system.open_input_file(piece.path) as stream:
            piece = self._range(stream, piece) if piece.of else piece
            if piece is None:
                return
            if piece.form is None:
                found = pcd.decode_any(stream.read())
                for at in range(0, len(found["x"]), BLOCK // 64):
                    yield self._batch(piece, {c: v[at : at + BLOCK // 64] for c, v in found.items()}, at)
            elif piece.form == "binary":
                unit = piece.header.record.itemsize
                stream.seek(piece.begin)
                first = (piece.begin - piece.starts) // unit
                for at in range(piece.begin, piece.end, size := max(1, BLOCK // unit) * unit):
                    found = pcd.as_points(pcd.binary_fields(piece.header, stream.read(min(size, piece.end - at))))
                    yield self._batch(piece, found, first)
                    first += len(found["x"])
            else:
                first = 0
                for found in self._lines(stream, piece):
                    yield self._batch(piece, found, first)
                    first += len(found["x"])

    def _lines(self, stream, piece: Piece) -> Iterator[dict[str, np.ndarray]]:
        for lines in lines_of(stream, piece):
            yield pcd.as_points(pcd.ascii_fields(piece.header, lines)) if piece.form == "ascii" else pcd.parse_text(lines)

    def _counts(self, system: fs.FileSystem, piece: Piece) -> Iterator[pa.RecordBatch]:
        if not piece.of:
            return
        with system.open_input_file(piece.path) as stream:
            piece = self._range(stream, piece)
            if piece is None or piece.form not in ("ascii", "text"):
                return
            n = sum(len(found["x"]) for found in self._lines(stream, piece))
        if n:
            yield self._batch(piece, {"x": np.zeros(1)}, n)

    def _batch(self, piece: Piece, found: dict[str, np.ndarray] | None, first: int, error: str | None = None) -> pa.RecordBatch:
        n = len(found["x"]) if found else 1
        same = {"path": piece.path, "scene_id": re.sub(r"\.pcd$", "", piece.path.rsplit("/", 1)[-1]), "part": piece.part if piece.form in ("ascii", "text") else None, "error": error}
        arrays = []
        for name in self.names:
            if name in same:
                arrays.append(pa.repeat(pa.scalar(same[name], COLUMNS[name]), n))
            elif found is None:
                arrays.append(pa.nulls(1, COLUMNS[name]))
            elif name == "point_idx":
                arrays.append(pa.array(np.arange(first, first + n), pa.int64()))
            else:
                arrays.append(pa.array(found[name], pa.float64(), mask=np.isnan(found[name]) if name in "rgb" else None))
        return pa.RecordBatch.from_arrays(arrays, self.names)


def lines_of(stream, piece: Piece) -> Iterator[bytes]:
    """Blocks of the whole lines that begin in the range."""
    at, held = piece.begin, b""
    stream.seek(at)
    if at > piece.starts:  # the line that goes over the range's beginning is the range's before, unless it ends just there
        stream.seek(at - 1)
        at -= 1
        while True:
            block = stream.read(BLOCK)
            cut = block.find(b"\n")
            if cut >= 0:
                held, at = block[cut + 1 :], at + cut + 1
                break
            at += len(block)
            if not block or at >= piece.end:
                return
    while at < piece.end:
        if at + len(held) >= piece.end:  # up to the end of the last line that begins in the range
            cut = held.find(b"\n", piece.end - 1 - at)
            if cut >= 0:
                yield held[: cut + 1]
                return
        block = stream.read(BLOCK)
        if not block:
            yield held
            return
        held += block
        cut = held.rfind(b"\n", 0, max(0, min(len(held), piece.end - 1 - at)))
        if cut >= 0:
            yield held[: cut + 1]
            held, at = held[cut + 1 :], at + cut + 1


@dataclass
class Parts(WriterCommitMessage):
    """(scene, first point, points, file, bytes of its header) of each part."""

    parts: list[tuple[str, int, int, str, int]]


class PcdWriter(DataSourceArrowWriter):
    RECORD = np.dtype([("x", "<f8"), ("y", "<f8"), ("z", "<f8"), ("rgb", "<u4")])

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.form, self.layout = options.get("form", "binary"), options.get("layout", "joined")
        if self.form not in ("binary", "ascii") or self.layout not in ("joined", "parts"):
            raise ValueError("form is binary or ascii, layout is joined or parts")
        # Hidden from Spark's readers; fixed here, so that tasks, commit and abort know it.
        self.staging = f"_pcd-{uuid.uuid4().hex}"

    def header(self, n: int) -> bytes:
        return (
            f"# .PCD v0.7\nVERSION 0.7\nFIELDS x y z rgb\nSIZE 8 8 8 4\nTYPE F F F U\nCOUNT 1 1 1 1\nWIDTH {n}\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS {n}\nDATA {self.form}\n"
        ).encode()

    def body(self, points: pa.Table) -> bytes:
        out = np.zeros(len(points), self.RECORD)
        for a in "xyz":
            out[a] = points[a].cast(pa.float64()).fill_null(float("nan")).to_numpy()
        for c, shift in zip("rgb", (16, 8, 0), strict=True):
            value = points[c].cast(pa.float64()).fill_null(0.5).to_numpy() if c in points.column_names else np.full(len(points), 0.5)
            value = np.where(np.isnan(value), 0.5, value)
            out["rgb"] |= np.clip(np.floor(value * 255 + 0.5), 0, 255).astype(np.uint32) << np.uint32(shift)
        if self.form == "binary":
            return out.tobytes()
        return "".join(f"{x!r} {y!r} {z!r} {c}\n" for x, y, z, c in out.tolist()).encode()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Parts:
        """A part that is small is a file with a header, written at once; a larger one is a stream without."""
        system, root = opened(self.path)
        folder = f"{root}/{self.staging}"
        parts: list[tuple[str, int, int, str, int]] = []
        stream, scene, file, first, n = None, None, "", 0, 0
        held: list[bytes] = []

        def close() -> None:
            head = b""
            if stream is None:
                head = self.header(n)
                with system.open_output_stream(file) as out:
                    out.write(b"".join([head, *held]))
            else:
                stream.close()
            parts.append((scene, first, n, file, len(head)))

        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                table = pa.Table.from_batches([batch])
                scenes = table["scene_id"].combine_chunks().dictionary_encode(null_encoding="encode")
                names = ["null" if s is None else str(s) for s in scenes.dictionary.to_pylist()]
                codes = scenes.indices.to_numpy()
                cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]
                body = self.body(table)
                marks = self._marks(body, cuts)
                for i, at in enumerate(cuts[:-1]):
                    if not file or names[codes[at]] != scene:
                        if file:
                            close()
                        scene, n, file, stream, held = names[codes[at]], 0, f"{folder}/{uuid.uuid4().hex}", None, []
                        first = table["point_idx"][at].as_py() if table["point_idx"][at].is_valid else -1
                    held.append(body[marks[i] : marks[i + 1]])
                    n += cuts[i + 1] - at
                    if stream is not None or sum(map(len, held)) > BLOCK:
                        stream = stream or system.open_output_stream(file)
                        stream.write(b"".join(held))
                        held = []
            if file:
                close()
        except BaseException:
            if stream is not None and not stream.closed:
                stream.close()
            raise
        if self.layout == "parts":
            parts = [(s, i, k, f if head else self._with_header(system, [(f, 0)], k), 1) for s, i, k, f, head in parts]
        return Parts(parts)

    def _marks(self, body: bytes, cuts: list[int]) -> list[int]:
        """Where the rows of ``cuts`` begin in their bytes."""
        if self.form == "binary":
            return [c * self.RECORD.itemsize for c in cuts]
        ends = np.append(0, np.flatnonzero(np.frombuffer(body, np.uint8) == ord("\n")) + 1)
        return ends[cuts].tolist()

    def _with_header(self, system: fs.FileSystem, files: list[tuple[str, int]], n: int) -> str:
        """A new file of a header and the files' bytes after their own."""
        whole = f"{files[0][0]}.pcd"
        with system.open_output_stream(whole) as out:
            out.write(self.header(n))
            for file, skipped in files:
                with system.open_input_file(file) as stream:
                    stream.seek(skipped)
                    while block := stream.read(BLOCK):
                        out.write(block)
                system.delete_file(file)
        return whole

    def commit(self, messages: list[Parts | None]) -> None:
        system, root = opened(self.path)
        scenes: dict[str, list[tuple[int, int, str, int]]] = {}
        for message in messages:
            for scene, first, n, file, head in message.parts if message else []:
                scenes.setdefault(scene, []).append((first, n, file, head))
        names = {}
        for scene, parts in scenes.items():
            parts.sort()
            name = f"{root}/{quote(scene, safe=' ()+,=@')}"
            names |= {f"{name}.pcd": parts} if self.layout == "joined" else {f"{name}-{i:05d}.pcd": [p] for i, p in enumerate(parts)}
        there = {f.path for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.is_file}
        if not self.overwrite and (twice := sorted(there & {*names})):
            self.abort(messages)
            raise FileExistsError(f"already written: {', '.join(twice[:3])}")

        def join(item: tuple[str, list[tuple[int, int, str, int]]]) -> tuple[str, str]:
            name, parts = item
            if len(parts) == 1 and parts[0][3]:  # it has its header
                return parts[0][2], name
            return self._with_header(system, [(f, head) for _, _, f, head in parts], sum(n for _, n, _, _ in parts)), name

        try:
            with ThreadPoolExecutor(JOINED) as pool:
                ready = list(pool.map(join, names.items()))
                if self.overwrite:
                    for file in there - {*names}:
                        if file.endswith(".pcd"):
                            system.delete_file(file)
                list(pool.map(lambda moved: system.move(*moved), ready))
        finally:
            self.abort(messages)

    def abort(self, messages: list[Parts | None]) -> None:
        """Remove what no reader sees; parts of tasks that ended badly are there too."""
        system, root = opened(self.path)
        folder = f"{root}/{self.staging}"
        if system.get_file_info(folder).type != fs.FileType.NotFound:
            system.delete_dir(folder)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PcdSource)


def number_points(points: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """``point_idx`` of each file's points over all its ranges.

    The ranges' points (path, part, n) are given, or counted by partial aggregation; only a few numbers a file meet in a window.
    """
    if counts is None:
        counts = points.where(F.col("part").isNotNull() & F.col("error").isNull()).groupBy("path", "part").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("path", "part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("_before"))
    return points.join(before, ["path", "part"], "left").select(*[(F.col(c) + F.coalesce("_before", F.lit(0))).alias(c) if c == "point_idx" else F.col(c) for c in points.columns])


def load_pcd(spark: SparkSession, path: str, **options) -> DataFrame:
    """All points of the files of a folder, as ``pcd.read_pcd`` has them, by ranges of large files.

    Ranges of lines are counted where they are read; where there is none, points
    have their numbers and none is moved for it.
    """
    register(spark)
    points = spark.read.format("pcd").options(**options).load(path)
    counts = spark.read.format("pcd").schema("path string, part int, point_idx long").options(**options, counting="true").load(path).withColumnRenamed("point_idx", "n")
    counts = save(counts, "pcd-counts")  # read twice, and counted once
    return (points if counts.isEmpty() else number_points(points, counts)).drop("part")


def save_pcd(points: DataFrame, path: str, *, form: str = "binary", layout: str = "joined", overwrite: bool = False) -> None:
    """Points (scene_id, point_idx, x, y, z and colours) as PCD files, a scene each, or several with ``layout`` parts.

    Rows are dealt by ranges of scene and point, so a large scene is several tasks'.
    """
    spark = points.sparkSession
    register(spark)
    own = points.select(F.col("scene_id").cast("string").alias("scene_id"), F.col("point_idx").cast("long").alias("point_idx"), *[F.col(a).cast("double").alias(a) for a in "xyz"], *[F.col(c).cast("double").alias(c) for c in "rgb" if c in points.columns])
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = own.repartitionByRange(n, "scene_id", "point_idx").sortWithinPartitions("scene_id", "point_idx")
    dealt.write.format("pcd").mode("overwrite" if overwrite else "append").options(path=path, form=form, layout=layout).save()
