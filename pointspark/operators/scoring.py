"""Scorers of points: column expressions where they can be, Arrow groups where a chunk must be seen whole."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointspark.functions.columns import nearest, softmax
from pointspark.operators.points import AXES

#: Columns of what a scorer with ``features`` gets besides coordinates.
FEATURES = ("f0", "f1", "f2")


class Scorer(Protocol):
    """Adds l0 and l1, the logits of background and target, to chunk-normalised points."""

    def __call__(self, points: DataFrame) -> DataFrame: ...


def probe(function: Callable[..., np.ndarray], features: bool = False) -> int:
    """How many logits a chunk function gives a point, by one call on two points at the origin."""
    zeros = np.zeros((2, 3))
    return int(np.asarray(function(*[zeros] * (1 + features))).shape[1])


class LinearScorer:
    """Logits linear in the coordinates; a deterministic stand-in for a trained network."""

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LinearScorer | None:
        """A scorer from a JSON file (weights, bias, places), read by Spark; None where there is no such file."""
        try:
            rows = spark.read.option("multiLine", "true").schema("weights array<double>, bias double, places int").json(path).limit(1).collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return cls(tuple(rows[0].weights), rows[0].bias, rows[0].places if rows[0].places is not None else 6) if rows else None

    def __init__(self, weights=(0.8, -0.5, 0.3), bias: float = 0.1, places: int = 6):
        self.weights, self.bias, self.places = weights, bias, places

    def logits(self, inputs: list[Column]) -> tuple[Column, Column]:
        """l0 and l1 as columns; a scorer that has this is asked where points are, and no point is repeated for each of its chunks."""
        total = F.lit(0.0)
        for w, x in zip(self.weights, inputs, strict=True):
            total = total + F.lit(w) * x
        return F.lit(0.0), nearest(total + F.lit(self.bias), self.places)

    def __call__(self, points: DataFrame) -> DataFrame:
        return points.withColumns(dict(zip(("l0", "l1"), self.logits([F.col(a) for a in AXES]), strict=True)))


def dense(inputs: list[Column], weights: list[list[float]], bias: list[float]) -> list[Column]:
    """A linear layer as columns."""
    out = []
    for row, b in zip(weights, bias, strict=True):
        total = F.lit(float(b))
        for w, x in zip(row, inputs, strict=True):
            total = total + F.lit(float(w)) * x
        out.append(total)
    return out


def mlp_head(inputs: list[Column], first, norm, second) -> list[Column]:
    """Linear, batch norm (mean, variance, gamma, beta), ReLU, linear: the segmentation head at inference."""
    hidden = dense(inputs, *first)
    mean, variance, gamma, beta = norm
    scaled = [(h - m) / (float(v) + 1e-5) ** 0.5 * g + b for h, m, v, g, b in zip(hidden, mean, variance, gamma, beta, strict=True)]
    return dense([F.greatest(F.lit(0.0), h) for h in scaled], *second)


CHUNK = ("scene_id", "ix", "iy", "iz")


def _takes(features: bool) -> tuple[tuple[str, ...], ...]:
    return (AXES, FEATURES) if features else (AXES,)


def _inputs(table: pa.Table, features: bool) -> list[np.ndarray]:
    """(n, 3) coordinates, and features if they are asked for."""
    return [np.stack([table.column(a).to_numpy() for a in names], 1) for names in _takes(features)]


def _checked(logits: np.ndarray, n: int) -> np.ndarray:
    logits = np.asarray(logits, np.float64)
    if logits.shape != (n, 2):
        raise ValueError(f"logits of shape {logits.shape} for {n} points; two a point are needed")
    return logits


def _with_logits(table: pa.Table, logits: np.ndarray | None, isolate: bool, error: str | None = None) -> pa.Table:
    """The points with l0 and l1, null where a chunk failed, and, if failures are isolated, its error."""
    n = len(table)
    for i in (0, 1):
        table = table.append_column(f"l{i}", pa.nulls(n, pa.float64()) if logits is None else pa.array(np.ascontiguousarray(logits[:, i])))
    return table.append_column("error", pa.repeat(pa.scalar(error, pa.string()), n)) if isolate else table


def _scored_schema(points: DataFrame, isolate: bool) -> str:
    return f"{points.schema.simpleString()[len('struct<') : -1]},l0:double,l1:double" + (",error:string" if isolate else "")


class ChunkScorer:
    """A scorer that needs each chunk whole: a NumPy function of (n, 3) coordinates to (n, 2) logits.

    With ``features`` the function also takes (n, 3) features: colours, or the
    normalised coordinates, by the profile (``evaluate.predict_points``).  A chunk's points are one task's; ``max_points`` of the configuration bounds them.
    With ``isolate`` a chunk for which the function raises has null logits and the message in ``error``; else the run ends there.
    """

    def __init__(self, function: Callable[..., np.ndarray], features: bool = False, *, isolate: bool = False):
        self.function, self.features, self.isolate = function, features, isolate
        if (n := probe(function, features)) != 2:
            raise ValueError(f"the function gives {n} logits a point; two are needed")

    def __call__(self, points: DataFrame) -> DataFrame:
        function, features, isolate = self.function, self.features, self.isolate

        def score(table: pa.Table) -> pa.Table:
            try:
                return _with_logits(table, _checked(function(*_inputs(table, features)), len(table)), isolate)
            except Exception as e:  # noqa: BLE001  whatever a model raises is its chunk's failure
                if not isolate:
                    raise
                return _with_logits(table, None, True, f"{type(e).__name__}: {e}")

        return points.groupBy(*CHUNK).applyInArrow(score, _scored_schema(points, isolate))


class RaggedScorer:
    """A scorer that sees several chunks a call: ragged batches of points, one after the other, and where each chunk ends.

    ``function`` takes (n, 3) coordinates, (n, 3) features with ``features``, and
    the offsets (k,) at which the chunks of the call end, and gives (n, 2) logits;
    ``pointwise`` makes one of a function that knows of no chunks, such as a
    registered model.

    Points are sorted by chunk and go by in a stream; a call gets whole chunks
    until they have ``points`` points, so a task holds a call's points and at
    most one chunk more, whatever comes.  With ``isolate``, the chunks of a call
    that raises are called one by one, and those that raise have null logits and
    the message in ``error``.

    ``calls`` counts the calls of a run, as Spark's accumulators do: a task that
    is repeated counts again.
    """

    def __init__(self, function: Callable[..., np.ndarray], features: bool = False, *, points: int = 65_536, isolate: bool = False):
        self.function, self.features, self.points, self.isolate = function, features, points, isolate
        self.calls = None

    def __call__(self, points: DataFrame) -> DataFrame:
        function, features, most, isolate = self.function, self.features, self.points, self.isolate
        self.calls = calls = points.sparkSession.sparkContext.accumulator(0)

        def call(table: pa.Table, ends: np.ndarray) -> pa.Table:
            calls.add(1)
            return _with_logits(table, _checked(function(*_inputs(table, features), ends), len(table)), isolate)

        def score(table: pa.Table, ends: np.ndarray) -> Iterator[pa.Table]:
            try:
                yield call(table, ends)
            except Exception as e:  # noqa: BLE001  whatever a model raises is its chunk's failure
                if not isolate:
                    raise
                if len(ends) == 1:
                    yield _with_logits(table, None, True, f"{type(e).__name__}: {e}")
                    return
                for begin, end in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True):
                    yield from score(table.slice(begin, end - begin), np.array([end - begin]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table, ends in packed(batches, most):
                for out in score(table, ends):
                    yield from out.to_batches()

        ordered = points.repartition(*CHUNK).sortWithinPartitions(*CHUNK, "point_idx")
        return ordered.mapInArrow(run, _scored_schema(points, isolate))


def pointwise(function: Callable[..., np.ndarray]) -> Callable[..., np.ndarray]:
    """A function of points as one of ragged batches, which need not look at the offsets."""
    return lambda *inputs: function(*inputs[:-1])


def chunk_ends(table: pa.Table) -> np.ndarray:
    """Where the chunks of sorted points end."""
    new = np.zeros(len(table), bool)
    for name in CHUNK:
        code = pc.dictionary_encode(table[name].combine_chunks(), null_encoding="encode").indices.to_numpy()
        new[1:] |= code[1:] != code[:-1]
    return np.append(np.flatnonzero(new), len(table))


def packed(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole chunks of the sorted points, and where each ends, in lots of at least ``most`` points but for the last."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < most:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        ends, begin = chunk_ends(table), 0
        whole = ends[:-1]  # the last chunk may go on in the next batch
        while len(whole) and whole[-1] - begin >= most:
            n = int(np.searchsorted(whole, begin + most)) + 1
            yield table.slice(begin, whole[n - 1] - begin), whole[:n] - begin
            begin, whole = int(whole[n - 1]), whole[n:]
        held = table.slice(begin).to_batches() if begin < len(table) else []
        size = len(table) - begin
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, chunk_ends(table)


def predict(scored: DataFrame) -> DataFrame:
    """Probabilities p0, p1 and the class of the larger logit; ties are class 0."""
    p0, p1 = softmax(F.col("l0"), F.col("l1"))
    return scored.withColumns({"p0": p0, "p1": p1, "pred": F.when(F.col("l1") > F.col("l0"), 1).otherwise(0)})
