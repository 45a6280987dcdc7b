"""Density clustering of points within scenes (DBSCAN) by grid cells, without storing pairs of points.

A scene of up to ``MOST`` points is clustered where its points are, by
``density``: they are dealt by scene once and sent nowhere else.  What follows
is for larger scenes, which no task holds.

Points of one cell of edge eps / sqrt(3) are all within eps of each other.  So
a cell with ``min_samples`` points has only core points, and the core points of
a cell are one node of the graph of clusters.  Neighbours are counted only for
points of sparser cells, of which a cell has fewer than ``min_samples``, so the
comparisons stay in proportion to the points, however dense they are.  Two
cells are linked if extreme points of theirs are near; pairs of points are
compared only between cells that this leaves in different clusters, and only
those near the other cell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from pointspark.functions.shared import grows, save
from pointspark.operators import density
from pointspark.operators.points import AXES

KEYS = ["scene_id", "point_idx"]
#: Points of a scene that one task clusters at most.
MOST = density.MOST
CELL = ["scene_id", *[f"q{a}" for a in AXES]]


def _square(left: str, right: str) -> Column:
    """The squared distance between the points of two prefixes."""
    one = lambda a: (F.col(f"{left}{a}") - F.col(f"{right}{a}")) * (F.col(f"{left}{a}") - F.col(f"{right}{a}"))
    return one("x") + one("y") + one("z")


def _square_of(eps: float | Decimal) -> float:
    """The square of eps; of a Decimal the decimal square, rounded once, as SQL has it of literals: that of doubles may fall on either side of it."""
    return float(eps**2) if isinstance(eps, Decimal) else eps * eps


def near_pairs(points: DataFrame, others: DataFrame, eps: float | Decimal) -> DataFrame:
    """(scene_id, point_idx, other): each point with the others within eps; an equi-join on the cells of edge 2 eps that a point reaches, two an axis.

    The reach is a little more than eps: a pair whose distance only rounding
    brings down to eps may lie further apart, and its cells too.
    """
    reach = float(eps) * (1 + 1e-9)
    edge = 2 * reach
    around = points.select(*KEYS, *AXES)
    for a in AXES:
        around = around.withColumn(f"c{a}", F.explode(F.sequence(F.floor((F.col(a) - reach) / edge), F.floor((F.col(a) + reach) / edge))))
    cell = {f"c{a}": F.floor(F.col(a) / edge) for a in AXES}
    there = others.withColumns(cell).select("scene_id", F.col("point_idx").alias("other"), *[F.col(a).alias(f"o{a}") for a in AXES], *cell)
    return around.join(grows(there), ["scene_id", *cell]).where(_square("", "o") <= _square_of(eps)).select(*KEYS, "other")


def eps_neighbors(points: DataFrame, eps: float | Decimal) -> DataFrame:
    """(scene_id, point_idx, other): all pairs within eps, self included."""
    return near_pairs(points, points, eps)


def core_points(points: DataFrame, eps: float | Decimal, min_samples: int) -> DataFrame:
    """(scene_id, point_idx) of the points with at least ``min_samples`` within eps, themselves included."""
    near, square = float(eps), _square_of(eps)

    def found(table: pa.Table, begins: np.ndarray) -> pa.Table:
        at, scene, places = density.arrays(table, begins)
        return table.select(KEYS).take(pa.array(at[density.core(scene, places, near, square, min_samples)]))

    small, large = _by_scene(points, found, KEYS, "core")
    return small if large is None else small.unionByName(_core_and_rest(large, eps, min_samples)[0].select(*KEYS))


def _sized(points: DataFrame) -> DataFrame:
    """Points in order of scenes, which tasks hold whole, with the scene's size in ``_n``.

    The window keeps scenes whole, whatever the plan below it is; points that
    are dealt by scene already are neither dealt nor sorted again.
    """
    return points.withColumn("_n", F.count("*").over(Window.partitionBy("scene_id")))


def _by_scene(points: DataFrame, found: Callable[[pa.Table, np.ndarray], pa.Table], columns: list[str], name: str) -> tuple[DataFrame, DataFrame | None]:
    """What ``found`` gives of the points of whole scenes, written; and the points of the scenes of more than ``MOST``, if there are any.

    The second of the columns is null in the row that stands for such a scene.
    """
    own, most = points.select(*KEYS, *AXES).where("scene_id is not null"), MOST
    kinds = {f.name: f.dataType for f in own.schema} | {"cluster": own.schema["point_idx"].dataType}
    schema = pa.schema([(c, to_arrow_type(kinds[c])) for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        large: list[pa.Array] = []

        def held() -> Iterator[pa.Table]:
            for batch in batches:
                table = pa.Table.from_batches([batch])
                fits = pc.less_equal(table.column("_n"), most)
                large.append(pc.unique(table.filter(pc.invert(fits)).column("scene_id")))
                if len(small := table.filter(fits).drop_columns("_n")):
                    yield small

        for table, begins in density.whole_scenes(held(), density.TAKE):
            yield from pa.Table.from_arrays(found(table, begins).select(columns).columns, schema=schema).to_batches()
        for scenes in large:
            yield pa.RecordBatch.from_arrays([scenes, *[pa.nulls(len(scenes), f.type) for f in list(schema)[1:]]], schema=schema)

    out = save(_sized(own).mapInArrow(run, StructType([StructField(c, kinds[c]) for c in columns])), name)
    large = out.where("point_idx is null").select("scene_id").distinct()
    small = out.where("point_idx is not null")
    if large.isEmpty():
        return small, None
    finite = " and ".join(f"abs({a}) < double('infinity')" for a in AXES)
    return small, own.where(finite).join(grows(large), "scene_id", "left_semi")


def _core_and_rest(points: DataFrame, eps: float | Decimal, min_samples: int) -> tuple[DataFrame, DataFrame]:
    """Core points and the others, both with their cells."""
    # A little less than eps / sqrt(3), so that rounding brings no two points of a cell apart.
    edge = float(eps) / 3**0.5 * (1 - 1e-9)
    placed = save(points.select(*KEYS, *AXES, *[F.floor(F.col(a) / edge).alias(f"q{a}") for a in AXES]), "placed")
    crowded = placed.groupBy(*CELL).agg(F.count("*").alias("n")).where(F.col("n") >= min_samples).select(*CELL, F.lit(True).alias("crowded"))
    told = placed.join(grows(crowded), CELL, "left")
    sparse = told.where("crowded is null").select(*placed.columns)
    counted = near_pairs(sparse, placed, eps).groupBy(*KEYS).agg(F.count("*").alias("n")).where(F.col("n") >= min_samples).select(*KEYS, F.lit(True).alias("counted"))
    # Written once: both its parts are read several times.
    marked = save(told.join(grows(counted), KEYS, "left").select(*placed.columns, F.coalesce("crowded", "counted", F.lit(False)).alias("core")), "marked")
    return marked.where("core").drop("core"), marked.where("not core").drop("core")


def _components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(scene_id, node, root): the least node reachable over links (scene_id, a, b); each round is written."""
    both = save(links.union(links.select("scene_id", "b", "a")).toDF("scene_id", "node", "other").distinct(), "links")
    # What the first round would give: the least of a node and its neighbours.
    first = both.groupBy("scene_id", "node").agg(F.min("other").alias("near"))
    labels = save(nodes.join(grows(first), ["scene_id", "node"], "left").select("scene_id", "node", F.least("node", "near").alias("root")), "roots")
    while True:
        seen = labels.select("scene_id", F.col("node").alias("other"), F.col("root").alias("near"))
        least = both.join(grows(seen), ["scene_id", "other"]).groupBy("scene_id", "node").agg(F.min("near").alias("near"))
        met = labels.join(grows(least), ["scene_id", "node"], "left").select("scene_id", "node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        above = labels.select("scene_id", F.col("node").alias("root"), F.col("root").alias("up"))
        step = met.join(grows(above), ["scene_id", "root"]).select("scene_id", "node", F.least("root", "up").alias("root"), (F.least("root", "up") < F.col("was")).alias("moved"))
        labels = save(step, "roots")
        if labels.where("moved").isEmpty():
            return labels.drop("moved")
        labels = labels.drop("moved")


def _cell_pairs(cells: DataFrame, eps: float | Decimal) -> DataFrame:
    """(scene_id, a, b, sure, boxes of both) of cells that may hold points within eps: sure, if extreme points of theirs are."""
    half = [d for d in product(range(-2, 3), repeat=3) if d > (0, 0, 0)]
    # Along the longest axis of the way, the first cell's extreme point on that side and the second's on the other.
    lead = [max(range(3), key=lambda i: (abs(d[i]), -i)) for d in half]
    side = [2 * i + (d[i] > 0) for d, i in zip(half, lead, strict=True)]
    ways = F.array(*[F.struct(*[F.lit(v).alias(f"d{a}") for a, v in zip(AXES, d, strict=True)], F.lit(s).alias("side")) for d, s in zip(half, side, strict=True)])
    box = [f"{w}{a}" for w in ("lo", "hi") for a in AXES]
    first = cells.select("*", F.explode(ways).alias("way"))
    tip = F.get("tips", F.col("way.side"))
    first = first.select("scene_id", F.col("node").alias("a"), *[(F.col(f"q{a}") + F.col(f"way.d{a}")).alias(f"q{a}") for a in AXES], "way.side", *[F.col(c).alias(f"a_{c}") for c in box], *[tip[a].alias(f"s{a}") for a in AXES])
    second = cells.select("scene_id", F.col("node").alias("b"), *CELL[1:], *[F.col(c).alias(f"b_{c}") for c in box], "tips")
    gap = sum((F.greatest(F.lit(0.0), F.col(f"b_lo{a}") - F.col(f"a_hi{a}"), F.col(f"a_lo{a}") - F.col(f"b_hi{a}")) ** 2 for a in AXES[1:]), F.greatest(F.lit(0.0), F.col("b_lox") - F.col("a_hix"), F.col("a_lox") - F.col("b_hix")) ** 2)
    # The box test leaves room for rounding; it only drops what can't be near.
    met = first.join(grows(second), CELL).where(gap <= _square_of(eps) * (1 + 1e-9))
    other = F.get("tips", F.col("side").bitwiseXOR(F.lit(1)))
    met = met.withColumns({f"t{a}": other[a] for a in AXES})
    return met.select("scene_id", "a", "b", (_square("s", "t") <= _square_of(eps)).alias("sure"), *[f"{w}_{c}" for w in "ab" for c in box])


def _core_clusters(core: DataFrame, eps: float | Decimal) -> DataFrame:
    """The core points with ``cluster``: the least index of the core points reachable."""
    ends = [f(F.struct(*AXES), F.col(a)) for a in AXES for f in (F.min_by, F.max_by)]
    cells = core.groupBy(*CELL).agg(F.min("point_idx").alias("node"), *[F.min(a).alias(f"lo{a}") for a in AXES], *[F.max(a).alias(f"hi{a}") for a in AXES], F.array(*ends).alias("tips"))
    cells = save(cells, "core-cells")
    pairs = save(_cell_pairs(cells, eps), "cell-pairs")
    roots = _components(cells, pairs.where("sure").select("scene_id", "a", "b"))
    root = lambda name: roots.select("scene_id", F.col("node").alias(name), F.col("root").alias(f"{name}_root"))
    open_ = pairs.where("not sure").join(grows(root("a")), ["scene_id", "a"]).join(grows(root("b")), ["scene_id", "b"]).where("a_root <> b_root")
    open_ = save(open_, "open-pairs")
    if not open_.isEmpty():
        members = core.join(grows(cells.select(*CELL, "node")), CELL).select("scene_id", "node", *AXES)

        def side(own: str, other: str, prefix: str) -> DataFrame:
            """The points of one cell of each pair that are within eps of the other cell's box, with room for rounding."""
            reach = float(eps) * (1 + 1e-9)
            rows = open_.join(grows(members.withColumnRenamed("node", own)), ["scene_id", own])
            keep = F.lit(True)
            for a in AXES:
                keep = keep & F.col(a).between(F.col(f"{other}_lo{a}") - reach, F.col(f"{other}_hi{a}") + reach)
            return rows.where(keep).select("scene_id", "a", "b", "a_root", "b_root", *[F.col(a).alias(f"{prefix}{a}") for a in AXES])

        both = side("a", "b", "s").join(grows(side("b", "a", "t").drop("a_root", "b_root")), ["scene_id", "a", "b"])
        more = both.where(_square("s", "t") <= _square_of(eps)).select("scene_id", F.col("a_root").alias("a"), F.col("b_root").alias("b"))
        top = _components(roots.select("scene_id", F.col("root").alias("node")).distinct(), more)
        roots = roots.join(grows(top.toDF("scene_id", "root", "cluster")), ["scene_id", "root"]).select("scene_id", "node", F.col("cluster").alias("root"))
    return core.join(grows(cells.join(grows(roots), ["scene_id", "node"]).select(*CELL, F.col("root").alias("cluster"))), CELL)


def dbscan(points: DataFrame, eps: float | Decimal, min_samples: int) -> DataFrame:
    """(scene_id, point_idx, cluster) of the points in a cluster; noise has no row.

    A cluster's number is its smallest core index; a border point belongs to
    the lowest-numbered cluster that reaches it.
    """
    near, square = float(eps), _square_of(eps)

    def found(table: pa.Table, begins: np.ndarray) -> pa.Table:
        at, scene, places = density.arrays(table, begins)
        index = table.column("point_idx").to_numpy()[at]
        position, cluster = density.clusters(scene, index, places, near, square, min_samples)
        return table.select(KEYS).take(pa.array(at[position])).append_column("cluster", pa.array(cluster))

    small, large = _by_scene(points, found, [*KEYS, "cluster"], "clusters")
    return small if large is None else small.unionByName(_dbscan_by_cells(large, eps, min_samples))


def _dbscan_by_cells(points: DataFrame, eps: float | Decimal, min_samples: int) -> DataFrame:
    """The same for scenes of any size, by joins of cells."""
    core, rest = _core_and_rest(points, eps, min_samples)
    core = save(_core_clusters(core, eps).select(*KEYS, *AXES, "cluster"), "core-clusters")
    reached = near_pairs(rest, core, eps).join(grows(core.select("scene_id", F.col("point_idx").alias("other"), "cluster")), ["scene_id", "other"])
    border = reached.groupBy(*KEYS).agg(F.min("cluster").alias("cluster"))
    return core.select(*KEYS, "cluster").unionByName(border)


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("scene_id", "cluster").agg(F.count("*").alias("n"))


def largest_cluster(clusters: DataFrame) -> DataFrame:
    """(scene_id, cluster, n): the largest of each scene, the lowest number on ties."""
    best = F.max_by(F.struct("cluster", "n"), F.struct("n", -F.col("cluster")))
    return cluster_sizes(clusters).groupBy("scene_id").agg(best.alias("best")).select("scene_id", "best.cluster", "best.n")


def keep_largest(voted: DataFrame, eps: float | Decimal, min_samples: int, points: DataFrame | None = None) -> DataFrame:
    """Demote target points outside the largest cluster of their scene; scenes without a cluster stay as they are.

    Demoted points keep their confidence, so a confident one becomes an alien.
    ``points`` are those that were voted on, if counting them is less work.
    """
    near, square = float(eps), _square_of(eps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begins in density.whole_scenes((pa.Table.from_batches([b]).drop_columns("_n") for b in batches), density.TAKE):
            target = pc.fill_null(pc.equal(table.column("pred"), 1), False)
            out = density.outside_largest(table, begins, np.asarray(target), near, square, min_samples)
            i = table.schema.get_field_index("pred")
            pred = pc.if_else(pa.array(out), pa.scalar(0, table.schema.field(i).type), table.column(i))
            yield from table.set_column(i, table.schema.field(i), pred).to_batches()

    large = save((voted if points is None else points).groupBy("scene_id").agg(F.count("*").alias("n")).where(F.col("n") > MOST).select("scene_id"), "large-scenes")
    if large.isEmpty():
        return _sized(voted).mapInArrow(run, voted.schema)
    rest = voted.join(grows(large), "scene_id", "left_anti")
    return _sized(rest).mapInArrow(run, voted.schema).unionByName(_keep_largest_by_joins(voted.join(grows(large), "scene_id", "left_semi"), eps, min_samples))


def _keep_largest_by_joins(voted: DataFrame, eps: float | Decimal, min_samples: int) -> DataFrame:
    """The same for scenes of any size."""
    clusters = dbscan(voted.where("pred = 1").select("scene_id", "point_idx", *AXES), eps, min_samples)
    best = largest_cluster(clusters).select("scene_id", F.col("cluster").alias("_best"))
    marked = voted.join(grows(clusters), ["scene_id", "point_idx"], "left").join(best, "scene_id", "left")
    out = (F.col("pred") == 1) & F.col("_best").isNotNull() & ~F.col("cluster").eqNullSafe(F.col("_best"))
    return marked.withColumn("pred", F.when(out, 0).otherwise(F.col("pred"))).drop("cluster", "_best")

