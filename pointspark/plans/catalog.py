"""The registered queries over the test tables, with their SQL."""

from __future__ import annotations

import math
import uuid
from decimal import Decimal

import numpy as np
from pyspark.sql import functions as F

from pointspark.functions import columns as fn
from pointspark.functions.rng import uniform_between
from pointspark.functions.shared import save, shared_dir
from pointspark.operators import batches, chunks, clustering, compose, metrics, points, registry, sampling, scoring, store, views, votes
from pointspark.plans import adapters, evaluate
from pointspark.plans.adapters import EPOCHS, OBJECTS, PAIRS, POINTS, key_sql, table, uniform_sql
from pointspark.plans.config import V2, V3, ComposeConfig, EvalConfig
from pointspark.sources import pcd, pcd_source

_QUERIES: dict = {}
_SQL: dict[str, str] = {}
COMPOSE = ComposeConfig(points=21)
EVAL = EvalConfig(profile=V3)
FINE = EvalConfig(profile=V3, target_points=100)
EPS, MIN_SAMPLES = 0.35, 8
#: The literal of the SQL is a decimal number, and so is its square.
EPS_DECIMAL = Decimal(repr(EPS))


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        _QUERIES[name or f.__name__] = f
        if sql:
            _SQL[name or f.__name__] = sql
        return f

    return register


def r4(*names: str) -> dict:
    return {n: fn.rounded(F.col(n)) for n in names}


def r4_sql(expression: str, name: str | None = None) -> str:
    return f"floor(({expression}) * 1e4 + 0.5) / 1e4 + 0.0 AS {name or expression}"


def longs(df, *names: str):
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def big(*names: str) -> str:
    return ", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in names)


XYZ = ("x", "y", "z")
KEYS = ("scene_id", "point_idx")

# Projections and filters


@query(f"SELECT scene_id, point_idx, x, -y + 0.0 AS y, -z + 0.0 AS z FROM {POINTS}")
def orientation_fix(spark, d):
    return points.orientation_fix(adapters.points(spark, d)).select(*KEYS, *XYZ)


@query("SELECT o_orderkey, ((v >> 16) & 255) / 255.0 AS r, ((v >> 8) & 255) / 255.0 AS g, (v & 255) / 255.0 AS b FROM (SELECT o_orderkey, o_orderkey * 7919 + 4278190080 AS v FROM orders)")
def rgb_unpack(spark, d):
    r, g, b = fn.unpack_rgb(F.col("o_orderkey") * 7919 + F.lit(4278190080))
    return table(spark, d, "orders").select("o_orderkey", r.alias("r"), g.alias("g"), b.alias("b"))


ODD_COLOURS = f"(SELECT scene_id, point_idx, r * k AS r, g * k AS g, b * k AS b FROM (SELECT *, CASE WHEN scene_id % 2 = 1 THEN 255.0 ELSE 1.0 END AS k FROM {POINTS}))"


@query(f"SELECT scene_id, point_idx, r / s AS r, g / s AS g, b / s AS b FROM (SELECT *, CASE WHEN max(greatest(r, g, b)) OVER (PARTITION BY scene_id) > 1.0 THEN 255.0 ELSE 1.0 END AS s FROM {ODD_COLOURS})")
def feature_scale(spark, d):
    k = F.when(F.col("scene_id") % 2 == 1, 255.0).otherwise(1.0)
    own = adapters.points(spark, d).withColumns({c: F.col(c) * k for c in "rgb"})
    return points.feature_scale(own, ["scene_id"]).select(*KEYS, *"rgb")


BROKEN = f"(SELECT scene_id, point_idx, CASE point_idx % 7 WHEN 0 THEN CAST('nan' AS DOUBLE) WHEN 1 THEN CAST('inf' AS DOUBLE) WHEN 2 THEN CAST('-inf' AS DOUBLE) ELSE x END AS x, y, z FROM {POINTS})"


def broken(spark, d):
    k = F.col("point_idx") % 7
    bad = F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 2, float("-inf")).otherwise(F.col("x"))
    return adapters.points(spark, d).withColumn("x", bad).select(*KEYS, *XYZ)


@query(f"SELECT scene_id, point_idx, CASE WHEN isnan(x) THEN 0.0 WHEN x = CAST('inf' AS DOUBLE) THEN 1.0 WHEN x = CAST('-inf' AS DOUBLE) THEN -1.0 ELSE x END AS x, y, z FROM {BROKEN}")
def nan_to_num(spark, d):
    return points.nan_to_num(broken(spark, d))


@query(f"SELECT scene_id, point_idx, y, z FROM {BROKEN} WHERE NOT isnan(x) AND NOT isnan(y) AND NOT isnan(z)")
def drop_nan(spark, d):
    return points.drop_nan(broken(spark, d)).drop("x")


@query(f"SELECT scene_id, CAST(sum(CAST(isnan(x) AS INT) + CAST(isnan(y) AS INT) + CAST(isnan(z) AS INT)) AS BIGINT) AS nan_cells FROM {BROKEN} GROUP BY scene_id")
def nan_count(spark, d):
    return points.nan_count(broken(spark, d), ["scene_id"])


# Points without colours: every third has none, every fifth no red.
BARE = f"(SELECT scene_id, point_idx, x, y, z, CASE WHEN point_idx % 3 = 0 OR point_idx % 5 = 0 THEN NULL ELSE r END AS r, CASE WHEN point_idx % 3 = 0 THEN NULL ELSE g END AS g, CASE WHEN point_idx % 3 = 0 THEN NULL ELSE b END AS b FROM {POINTS})"


def bare(spark, d):
    none = F.col("point_idx") % 3 == 0
    own = adapters.points(spark, d)
    return own.withColumns({"r": F.when(~(none | (F.col("point_idx") % 5 == 0)), F.col("r")), "g": F.when(~none, F.col("g")), "b": F.when(~none, F.col("b"))})


@query(f"SELECT scene_id, point_idx, coalesce(r, 0.5) AS r, coalesce(g, 0.5) AS g, coalesce(b, 0.5) AS b FROM {BARE}")
def default_colours(spark, d):
    return points.default_colours(bare(spark, d)).select(*KEYS, *"rgb")


@query(f"SELECT scene_id, point_idx, CASE WHEN n THEN x ELSE r END AS f0, CASE WHEN n THEN y ELSE g END AS f1, CASE WHEN n THEN z ELSE b END AS f2 FROM (SELECT *, r IS NULL AND g IS NULL AND b IS NULL AS n FROM {BARE})")
def feature_fallback(spark, d):
    return points.feature_fallback(bare(spark, d)).select(*KEYS, "f0", "f1", "f2")


@query("SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS f0, CASE WHEN k > 1 THEN CAST(embedding[2] AS DOUBLE) ELSE 0.0 END AS f1, CASE WHEN k > 2 THEN CAST(embedding[3] AS DOUBLE) ELSE 0.0 END AS f2 FROM (SELECT *, 1 + vec_id % 6 AS k FROM embeddings)")
def width_fix(spark, d):
    own = table(spark, d, "embeddings").select("vec_id", F.slice("embedding", F.lit(1), (1 + F.col("vec_id") % 6).cast("int")).alias("features"))
    return points.width_fix(own).select("vec_id", *[F.get("features", F.lit(i)).alias(f"f{i}") for i in range(3)])


def normalize_sql(source: str, keys: str, k: float) -> str:
    centred = f"(SELECT *, x - avg(x) OVER w AS cx, y - avg(y) OVER w AS cy, z - avg(z) OVER w AS cz FROM {source} WINDOW w AS (PARTITION BY {keys}))"
    far = f"(SELECT *, max(greatest(abs(cx), abs(cy), abs(cz))) OVER (PARTITION BY {keys}) AS far FROM {centred})"
    return f"(SELECT * EXCLUDE (x, y, z, cx, cy, cz, far), cx / (far + 1e-6) * {k} AS x, cy / (far + 1e-6) * {k} AS y, cz / (far + 1e-6) * {k} AS z FROM {far})"


def _normalize(profile):
    @query(f"SELECT scene_id, point_idx, {', '.join(r4_sql(a) for a in XYZ)} FROM {normalize_sql(POINTS, 'scene_id', profile.scale)}", f"normalize_{profile.name}")
    def run(spark, d):
        return points.normalize(adapters.points(spark, d), ["scene_id"], profile.scale).select(*KEYS, *XYZ).withColumns(r4(*XYZ))


_normalize(V2)
_normalize(V3)


@query("SELECT event_id, greatest(0, least(1, CAST(floor(value) AS INT) - 50)) AS label FROM events")
def label_clip(spark, d):
    return table(spark, d, "events").select("event_id", fn.clip_label(F.floor("value").cast("int") - 50, 2).alias("label"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 3 = 1 THEN 'target' WHEN o_custkey % 3 = 0 AND o_totalprice / 400000 > 0.8 THEN 'alien' ELSE 'background' END AS class FROM orders")
def three_way_class(spark, d):
    return table(spark, d, "orders").select("o_orderkey", fn.three_way_class(F.col("o_custkey") % 3, F.col("o_totalprice") / 400000).alias("class"))


@query("SELECT s_suppkey, 'Scene_' || replace(replace(replace('realworld_scene_' || s_suppkey || '_ascii_rgb.pcd', '.pcd', ''), 'realworld_scene_', ''), '_ascii_rgb', '') AS scene FROM supplier")
def scene_name(spark, d):
    file = F.concat(F.lit("realworld_scene_"), F.col("s_suppkey").cast("string"), F.lit("_ascii_rgb.pcd"))
    return table(spark, d, "supplier").select("s_suppkey", fn.scene_name(file).alias("scene"))


@query(f"SELECT scene_id, point_idx, x, y, z FROM {POINTS} WHERE x BETWEEN 1 AND 3 AND y BETWEEN 0.5 AND 2 AND z BETWEEN 0.2 AND 0.8")
def box_filter(spark, d):
    return points.box_filter(adapters.points(spark, d), (1, 0.5, 0.2), (3, 2, 0.8)).select(*KEYS, *XYZ)


@query("SELECT vec_id, CAST(i - 1 AS BIGINT) AS idx, CAST(embedding[i] AS DOUBLE) AS p, CAST(embedding[i + 32] AS DOUBLE) AS c FROM embeddings, range(1, 30) t(i) WHERE i <= 5 + label AND i <= 4 + vec_id % 9")
def zip_truncate(spark, d):
    own = table(spark, d, "embeddings")
    side = lambda first, n, name: own.select("vec_id", F.posexplode(F.slice("embedding", F.lit(first), n.cast("int"))).alias("idx", name))
    both = points.zip_truncate(side(1, 5 + F.col("label"), "p"), side(33, 4 + F.col("vec_id") % 9, "c"), ["vec_id"])
    return both.select("vec_id", F.col("idx").cast("long").alias("idx"), F.col("p").cast("double").alias("p"), F.col("c").cast("double").alias("c"))


LINES = """(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  CASE l_linenumber % 6
    WHEN 0 THEN n || '.5  ' || l_partkey || ' -3.25 ' || n || ' 7 255 extra'
    WHEN 1 THEN ' ' || n || ' 2.0 ' || l_suppkey || ' ' || l_partkey * 771
    WHEN 2 THEN n || ' 2 3 255.0 0 0'
    WHEN 3 THEN 'FIELDS x y z rgb'
    WHEN 4 THEN n || ' 1 2'
    ELSE n || ' 1 2 4294901760 junk' END AS value
  FROM (SELECT *, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS n FROM lineitem))"""


@query(f"""WITH t AS (SELECT *, string_split_regex(trim(value), '\\s+') AS t FROM {LINES}),
p AS (SELECT *, len(t) AS n, TRY_CAST(t[1] AS DOUBLE) AS x, TRY_CAST(t[2] AS DOUBLE) AS y, TRY_CAST(t[3] AS DOUBLE) AS z,
  CASE WHEN regexp_full_match(t[4], '[+-]?[0-9]+') THEN CAST(t[4] AS BIGINT) END AS a,
  CASE WHEN regexp_full_match(t[5], '[+-]?[0-9]+') THEN CAST(t[5] AS BIGINT) END AS b5,
  CASE WHEN regexp_full_match(t[6], '[+-]?[0-9]+') THEN CAST(t[6] AS BIGINT) END AS c6 FROM t),
q AS (SELECT *, CASE WHEN n >= 6 THEN a ELSE (a >> 16) & 255 END / 255.0 AS r, CASE WHEN n >= 6 THEN b5 ELSE (a >> 8) & 255 END / 255.0 AS g,
  CASE WHEN n >= 6 THEN c6 ELSE a & 255 END / 255.0 AS b FROM p WHERE n >= 4)
SELECT l_orderkey, l_linenumber, x, y, z, r, g, b FROM q WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND r IS NOT NULL AND g IS NOT NULL AND b IS NOT NULL""")
def pcd_ascii_parse(spark, d):
    n = F.col("l_quantity").cast("int").cast("string")
    word = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs])
    k = F.col("l_linenumber") % 6
    line = (
        F.when(k == 0, word(n, ".5  ", F.col("l_partkey"), " -3.25 ", n, " 7 255 extra"))
        .when(k == 1, word(" ", n, " 2.0 ", F.col("l_suppkey"), " ", F.col("l_partkey") * 771))
        .when(k == 2, word(n, " 2 3 255.0 0 0"))
        .when(k == 3, "FIELDS x y z rgb")
        .when(k == 4, word(n, " 1 2"))
        .otherwise(word(n, " 1 2 4294901760 junk"))
    )
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", line.alias("value"))
    return pcd.parse_lines(lines).drop("value")


def byte_sql(c: str) -> str:
    return f"greatest(0, least(255, floor({c} * 255 + 0.5))) / 255.0"


def stored_as_pcd(spark, d, form: str, layout: str):
    """All scenes written as PCD files by several tasks each, and read again by ranges of bytes."""
    path = f"{shared_dir(spark)}/points/pcd-{uuid.uuid4().hex}"
    own = adapters.points(spark, d)
    pcd_source.save_pcd(own, path, form=form, layout=layout)
    return pcd_source.load_pcd(spark, path, splitBytes=8192).where("error is null")


PCD_COLOURS = ", ".join(r4_sql(byte_sql(c), c) for c in "rgb")


@query(f"SELECT scene_id::VARCHAR AS scene_id, point_idx, {', '.join(r4_sql(a) for a in XYZ)}, {PCD_COLOURS} FROM {POINTS}")
def pcd_store(spark, d):
    return stored_as_pcd(spark, d, "binary", "joined").drop("path", "error").withColumns(r4(*XYZ, *"rgb"))


@query(f"SELECT scene_id::VARCHAR AS scene_id, count(*) AS points, CAST(max(point_idx) AS BIGINT) AS last, {', '.join(r4_sql(f'sum({a})', a) for a in XYZ)}, {', '.join(r4_sql(f'sum({byte_sql(c)})', c) for c in 'rgb')} FROM {POINTS} GROUP BY scene_id")
def pcd_store_ascii(spark, d):
    sums = [F.sum(c).alias(c) for c in (*XYZ, *"rgb")]
    return stored_as_pcd(spark, d, "ascii", "joined").groupBy("scene_id").agg(F.count("*").alias("points"), F.max("point_idx").alias("last"), *sums).withColumns(r4(*XYZ, *"rgb"))


def motion_sql(ids: tuple[str, ...], c: ComposeConfig) -> str:
    """Angles (radians) and shifts as columns a, b, g, tx, ty, tz."""
    turn = [f"({-c.angle} + {uniform_sql(c.seed, f'angle_{x}', *ids)} * {2 * c.angle}) * {math.pi!r} / 180.0 AS {n}" for x, n in zip(XYZ, "abg", strict=True)]
    shift = [f"{lo} + {uniform_sql(c.seed, f'shift_{x}', *ids)} * {hi - lo} AS t{x}" for x, (lo, hi) in zip(XYZ, c.shift, strict=True)]
    return ", ".join(turn + shift)


ROTATION = [
    ["cos(b)*cos(g)", "-cos(b)*sin(g)", "sin(b)"],
    ["sin(a)*sin(b)*cos(g)+cos(a)*sin(g)", "cos(a)*cos(g)-sin(a)*sin(b)*sin(g)", "-sin(a)*cos(b)"],
    ["sin(a)*sin(g)-cos(a)*sin(b)*cos(g)", "cos(a)*sin(b)*sin(g)+sin(a)*cos(g)", "cos(a)*cos(b)"],
]
MOVED = [f"({r[0]})*x + ({r[1]})*y + ({r[2]})*z + t{a}" for r, a in zip(ROTATION, XYZ, strict=True)]


@query(f"SELECT p_partkey, {', '.join(r4_sql(ROTATION[i][j], f'm{i}{j}') for i in range(3) for j in range(3))} FROM (SELECT p_partkey, {motion_sql(('p_partkey',), COMPOSE)} FROM part)")
def rotation_matrix(spark, d):
    matrix, _ = compose.motion(COMPOSE, "p_partkey")
    return table(spark, d, "part").select("p_partkey", *[fn.rounded(matrix[i][j]).alias(f"m{i}{j}") for i in range(3) for j in range(3)])


@query(f"SELECT object_id, sample_idx, point_idx, {', '.join(r4_sql(m, a) for m, a in zip(MOVED, XYZ, strict=True))} FROM (SELECT *, {motion_sql(('object_id', 'sample_idx'), COMPOSE)} FROM {OBJECTS})")
def affine_transform(spark, d):
    return compose.move(adapters.objects(spark, d), COMPOSE, "object_id", "sample_idx").withColumns(r4(*XYZ))


# Grids, votes and reports

BOUNDS = f"(SELECT scene_id, count(*) AS n, {', '.join(f'min({a}) AS min_{a}, max({a}) AS max_{a}' for a in XYZ)} FROM {POINTS} GROUP BY scene_id)"
DENSITY = f"(SELECT *, CASE WHEN volume > 0 THEN n / volume ELSE 1000.0 END AS density FROM (SELECT *, 1.0 * (max_x - min_x) * (max_y - min_y) * (max_z - min_z) AS volume FROM {BOUNDS}))"


def size_sql(c: EvalConfig) -> str:
    p = c.profile
    if c.chunk_size is not None:
        return f"(SELECT *, round(CAST({c.chunk_size!r} AS DOUBLE), 6) AS size FROM {DENSITY})"
    if not c.adaptive:
        return f"(SELECT *, round({p.fixed_chunk}, 6) AS size FROM {DENSITY})"
    return f"(SELECT *, round(greatest({p.smallest_chunk}, least({p.largest_chunk}, cbrt({c.target_points} / density))), 6) AS size FROM {DENSITY})"


def steps_sql(c: EvalConfig) -> str:
    most = c.max_steps if c.max_steps is not None else 2**31 - 1
    k = ", ".join(f"CAST(least(ceil((max_{a} - min_{a}) / greatest(size * {1 - c.overlap!r}, {chunks.LEAST_STEP})) + 1, {most}) AS INT) AS k_{a}" for a in XYZ)
    return f"(SELECT *, {k} FROM {size_sql(c)})"


def grid_sql(c: EvalConfig) -> str:
    at = lambda a: f"CASE WHEN i{a} = k_{a} - 1 AND k_{a} > 1 THEN max_{a} ELSE min_{a} + i{a} * (max_{a} - min_{a}) / greatest(k_{a} - 1, 1) END AS lo_{a}"
    return f"(SELECT scene_id, CAST(ix AS INT) AS ix, CAST(iy AS INT) AS iy, CAST(iz AS INT) AS iz, {', '.join(at(a) for a in XYZ)}, size FROM {steps_sql(c)}, LATERAL (SELECT unnest(range(k_x)) AS ix), LATERAL (SELECT unnest(range(k_y)) AS iy), LATERAL (SELECT unnest(range(k_z)) AS iz))"


def assign_sql(c: EvalConfig) -> str:
    inside = " AND ".join(f"p.{a} >= g.lo_{a} AND p.{a} <= g.lo_{a} + g.size" for a in XYZ)
    return f"(SELECT p.scene_id, p.point_idx, p.x, p.y, p.z, g.ix, g.iy, g.iz FROM {POINTS} p JOIN {grid_sql(c)} g ON p.scene_id = g.scene_id AND {inside})"


def predict_sql(c: EvalConfig) -> str:
    logit = f"(SELECT *, round(0.0 + 0.8 * x + -0.5 * y + 0.3 * z + 0.1, 6) AS l1 FROM {normalize_sql(assign_sql(c), 'scene_id, ix, iy, iz', c.profile.scale)})"
    return f"(SELECT *, CASE WHEN l1 > 0 THEN 1 ELSE 0 END AS pred, exp(0 - greatest(0, l1)) / (exp(0 - greatest(0, l1)) + exp(l1 - greatest(0, l1))) AS p0, exp(l1 - greatest(0, l1)) / (exp(0 - greatest(0, l1)) + exp(l1 - greatest(0, l1))) AS p1 FROM {logit})"


def vote_sql(c: EvalConfig) -> str:
    votes = f"(SELECT scene_id, point_idx, count(*) FILTER (WHERE pred = 1) AS v1, count(*) FILTER (WHERE pred = 0) AS v0, count(*) AS seen, avg(p0) AS p0, avg(p1) AS p1 FROM {predict_sql(c)} GROUP BY ALL)"
    return f"(SELECT p.*, CASE WHEN v1 > v0 THEN 1 ELSE 0 END AS pred, coalesce(greatest(p0, p1), 0.0) AS confidence, coalesce(seen, 0) AS seen FROM {POINTS} p LEFT JOIN {votes} v ON p.scene_id = v.scene_id AND p.point_idx = v.point_idx)"


CLASS = "CASE WHEN pred = 1 THEN 'target' WHEN confidence > 0.8 THEN 'alien' ELSE 'background' END AS class"


def class_sql(c: EvalConfig) -> str:
    return f"(SELECT *, {CLASS} FROM {vote_sql(c)})"


def summary_sql(c: EvalConfig) -> str:
    count = lambda k: f"count(*) FILTER (WHERE class = '{k}')"
    return f"(SELECT scene_id, count(*) AS total_points, {', '.join(f'{count(k)} AS {k}_points' for k in ('target', 'alien', 'background'))}, {', '.join(f'{count(k)} / count(*) * 100 AS {k}_rate' for k in ('target', 'alien'))} FROM {class_sql(c)} GROUP BY scene_id)"


@query(f"SELECT * FROM {BOUNDS}")
def scene_bounds(spark, d):
    return chunks.scene_bounds(adapters.points(spark, d))


@query(f"SELECT scene_id, {r4_sql('volume')}, {r4_sql('density')} FROM {DENSITY}")
def scene_density(spark, d):
    return chunks.scene_density(chunks.scene_bounds(adapters.points(spark, d))).select("scene_id", "volume", "density").withColumns(r4("volume", "density"))


def _sizes(name: str, c: EvalConfig):
    @query(f"SELECT scene_id, {r4_sql('size')} FROM {size_sql(c)}", name)
    def run(spark, d):
        bounds = chunks.scene_density(chunks.scene_bounds(adapters.points(spark, d)))
        return chunks.chunk_sizes(bounds, c).select("scene_id", "size").withColumns(r4("size"))


_sizes("chunk_size_v2", EvalConfig(profile=V2))
_sizes("chunk_size_v3", EVAL)
_sizes("chunk_size_v3_target_100", FINE)
_sizes("chunk_size_fixed", EvalConfig(profile=V3, adaptive=False))


@query(f"SELECT scene_id, ix, iy, iz, {', '.join(r4_sql(c) for c in ('lo_x', 'lo_y', 'lo_z', 'size'))} FROM {grid_sql(EVAL)}")
def chunk_grid(spark, d):
    return chunks.chunk_grid(evaluate.grid_steps(adapters.points(spark, d), EVAL)).withColumns(r4("lo_x", "lo_y", "lo_z", "size"))


def _assign(name: str, c: EvalConfig):
    @query(f"SELECT scene_id, point_idx, ix, iy, iz FROM {assign_sql(c)}", name)
    def run(spark, d):
        # Bounds need no numbers of points, so only the assignment numbers them.
        own = adapters.points(spark, d)
        return chunks.assign_chunks(own.select(*KEYS, *XYZ), evaluate.grid_steps(own, c)).drop(*XYZ)


_assign("chunk_assign", EVAL)
_assign("chunk_assign_target_100", FINE)
_assign("chunk_assign_free_size", EvalConfig(profile=V3, chunk_size=0.75, overlap=0.3))


def saved_points(spark, d):
    """The points as a written table: an evaluation reads them several times, and their indices come from a sort."""
    return save(adapters.points(spark, d), "points")


@query(f"SELECT scene_id, point_idx, pred, {r4_sql('confidence')}, seen FROM {vote_sql(EVAL)}")
def vote_aggregate(spark, d):
    return evaluate.vote_points(adapters.points(spark, d).select(*KEYS, *XYZ), EVAL).select(*KEYS, "pred", "confidence", "seen").withColumns(r4("confidence"))


@query(f"SELECT scene_id, avg(CAST(seen > 0 AS INT)) * 100 AS coverage_percent FROM {vote_sql(EVAL)} GROUP BY scene_id")
def coverage(spark, d):
    return votes.coverage(evaluate.seen_points(adapters.points(spark, d).select("scene_id", *XYZ), EVAL))


def summary(spark, d, c=EVAL):
    # Counts of classes need no numbers of points, so no sort gives them; clusters do.
    own = adapters.points(spark, d).select(*(KEYS if c.cluster else ["scene_id"]), *XYZ)
    return votes.scene_summary(evaluate.evaluate(own, c))


RATES = ", ".join(r4_sql(c) for c in ("target_rate", "alien_rate"))


def _summary(name: str, c: EvalConfig):
    @query(f"SELECT scene_id, total_points, target_points, alien_points, background_points, {RATES} FROM {summary_sql(c)}", name)
    def run(spark, d):
        return summary(spark, d, c).withColumns(r4("target_rate", "alien_rate"))


_summary("scene_summary", EVAL)
_summary("scene_summary_target_100", FINE)


@query(_SQL["scene_summary"])
def scene_summary_ragged(spark, d):
    """The same scorer as a registered model, called with ragged batches of chunks."""
    model = registry.publish(registry.models_dir(spark), "linear", "linear", {"weights": [[0.0, 0.0, 0.0], [0.8, -0.5, 0.3]], "bias": [0.0, 0.1]}, places=6)
    scorer = scoring.RaggedScorer(scoring.pointwise(model), model.features, points=4096)
    return votes.scene_summary(evaluate.evaluate(saved_points(spark, d), EVAL, scorer)).withColumns(r4("target_rate", "alien_rate"))


#: Points of a chunk that the scorer of the next two queries can't take.
TOO_MANY = 112


def overwhelmed(spark, d):
    """The evaluation by a scorer that raises on large chunks."""

    def score(xyz, ends):
        sizes = np.diff(ends, prepend=0)
        if (sizes > TOO_MANY).any():
            raise ValueError(f"a chunk of {sizes.max()} points")
        return np.stack([np.zeros(len(xyz)), np.round(xyz @ np.array([0.8, -0.5, 0.3]) + 0.1, 6)], 1)

    return evaluate.evaluate_isolated(saved_points(spark, d), EVAL, scoring.RaggedScorer(score, points=4096, isolate=True))


LARGE = f"(SELECT scene_id, ix, iy, iz, count(*) AS n FROM {assign_sql(EVAL)} GROUP BY ALL HAVING count(*) > {TOO_MANY})"


@query(f"SELECT scene_id, 'score' AS stage, count(*) AS chunks, min_by('ValueError: a chunk of ' || n || ' points', (ix, iy, iz)) AS error FROM {LARGE} GROUP BY scene_id")
def failed_scenes(spark, d):
    return overwhelmed(spark, d)[1]


@query(f"SELECT scene_id, total_points, target_points, alien_points, background_points, {RATES} FROM {summary_sql(EVAL)} WHERE scene_id NOT IN (SELECT scene_id FROM {LARGE})")
def scene_summary_isolated(spark, d):
    return votes.scene_summary(overwhelmed(spark, d)[0]).withColumns(r4("target_rate", "alien_rate"))


@query(f"SELECT 'Scene_' || scene_id AS Scene, total_points AS Total_Points, target_points AS Target_Points, alien_points AS Alien_Points, {r4_sql('target_rate', 'Target_Rate_Percent')}, {r4_sql('alien_rate', 'Alien_Rate_Percent')}, target_points > 0 AS Target_Detected, alien_points > 0 AS Alien_Detected FROM {summary_sql(EVAL)}")
def batch_summary(spark, d):
    return votes.batch_summary(summary(spark, d)).withColumns(r4("Target_Rate_Percent", "Alien_Rate_Percent"))


@query(f"SELECT count(*) AS scenes, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in ('total_points', 'target_points', 'alien_points'))}, count(*) FILTER (WHERE target_points > 0) AS scenes_with_target, count(*) FILTER (WHERE alien_points > 0) AS scenes_with_alien FROM {summary_sql(EVAL)}")
def run_totals(spark, d):
    return votes.run_totals(summary(spark, d))


@query("SELECT " + ", ".join(r4_sql(f"count(*) FILTER (WHERE {w}) / count(*) * 100", n) for n, w in (("target_rate", "target_points > 0"), ("alien_rate", "alien_points > 0"), ("any_rate", "target_points > 0 OR alien_points > 0"))) + f" FROM {summary_sql(EVAL)}")
def success_rates(spark, d):
    return votes.success_rates(summary(spark, d)).withColumns(r4("target_rate", "alien_rate", "any_rate"))


@query(f"""WITH s AS (SELECT min(n) AS a, max(n) AS b, least(count(*), 10) AS k FROM {BOUNDS}),
w AS (SELECT CASE WHEN a = b THEN a - 0.5 ELSE a END AS a, CASE WHEN a = b THEN b + 0.5 ELSE b END AS b, k FROM s),
c AS (SELECT CAST(least(floor((n - a) / ((b - a) / CAST(k AS DOUBLE))), k - 1) AS INT) AS bin, count(*) AS n FROM {BOUNDS}, w GROUP BY 1)
SELECT CAST(i AS INT) AS bin, {r4_sql('a + i * ((b - a) / CAST(k AS DOUBLE))', 'low')}, {r4_sql('a + (i + 1) * ((b - a) / CAST(k AS DOUBLE))', 'high')}, coalesce(c.n, 0) AS n
FROM w, LATERAL (SELECT unnest(range(k)) AS i) LEFT JOIN c ON c.bin = i""")
def points_histogram(spark, d):
    return votes.histogram(chunks.scene_bounds(adapters.points(spark, d)), "n").withColumns(r4("low", "high"))


def _export(name: str, where: str, paint: bool = False):
    colours = ", ".join(r4_sql(f"CASE class WHEN 'target' THEN {t} WHEN 'alien' THEN {a} ELSE {c} END", c) for c, t, a in (("r", 1.0, 0.0), ("g", 0.0, 0.0), ("b", 0.0, 1.0)))
    plain = ", ".join(r4_sql(c) for c in "rgb")

    @query(f"SELECT scene_id, point_idx, x, y, z, {colours if paint else plain} FROM {class_sql(FINE)} WHERE {where}", name)
    def run(spark, d):
        own = evaluate.evaluate(adapters.points(spark, d), FINE)
        kept = evaluate.segmented(own) if paint else evaluate.only(own, where.split("'")[1])
        return kept.select(*KEYS, *XYZ, *"rgb").withColumns(r4(*"rgb"))


_export("export_segmented", "true", paint=True)
_export("export_target_only", "class = 'target'")
_export("export_alien_only", "class = 'alien'")


@query(f"SELECT scene_id, point_idx, x, y, class FROM {class_sql(FINE)}")
def top_view(spark, d):
    return evaluate.evaluate(adapters.points(spark, d).select(*KEYS, *XYZ), FINE).select(*KEYS, "x", "y", "class")


CELLS = 48
AT = {a: f"CAST(CASE WHEN max_{a} > min_{a} THEN least(floor((v.{a} - min_{a}) / (max_{a} - min_{a}) * {CELLS}), {CELLS - 1}) ELSE 0 END AS INT)" for a in "xy"}


@query(f"""SELECT scene_id, {AT['x']} AS col, {AT['y']} AS row, count(*) AS points, {', '.join(r4_sql(f'avg({c})', c) for c in 'rgb')},
CASE WHEN bool_or(class = 'target') THEN 'target' WHEN bool_or(class = 'alien') THEN 'alien' ELSE 'background' END AS top
FROM {class_sql(FINE)} v JOIN (SELECT scene_id, min_x, max_x, min_y, max_y FROM {BOUNDS}) USING (scene_id) GROUP BY ALL""")
def top_raster(spark, d):
    return views.top_raster(evaluate.evaluate(adapters.points(spark, d).drop("point_idx"), FINE), CELLS, CELLS).withColumns(r4(*"rgb"))


# Metrics

IOU = "coalesce((coalesce(i0, 0) + coalesce(i1, 0)) / nullif(CAST(i0 IS NOT NULL AS INT) + CAST(i1 IS NOT NULL AS INT), 0), 0.0)"
IOUS = ", ".join(f"count(*) FILTER (WHERE pred = {k} AND label = {k}) / nullif(count(*) FILTER (WHERE pred = {k} OR label = {k}), 0) AS i{k}" for k in (0, 1))


@query(f"SELECT label, pred, count(*) AS n FROM {PAIRS} GROUP BY ALL")
def confusion(spark, d):
    return metrics.confusion(adapters.pairs(spark, d))


@query(f"SELECT {r4_sql('avg(CAST(pred = label AS INT))', 'accuracy')} FROM {PAIRS}")
def accuracy(spark, d):
    return metrics.accuracy(adapters.pairs(spark, d)).withColumns(r4("accuracy"))


@query(f"SELECT {r4_sql(IOU, 'mean_iou')} FROM (SELECT {IOUS} FROM {PAIRS})")
def mean_iou(spark, d):
    return metrics.mean_iou(adapters.pairs(spark, d)).withColumns(r4("mean_iou"))


HISTORY = f"(SELECT epoch, avg(loss) AS loss, avg(iou) AS iou, sum(ok) / sum(n) AS accuracy FROM (SELECT *, {IOU} AS iou FROM (SELECT epoch, batch, avg(loss) AS loss, count(*) FILTER (WHERE pred = label) AS ok, count(*) AS n, {IOUS} FROM {EPOCHS} GROUP BY epoch, batch)) WHERE NOT isnan(loss) GROUP BY epoch)"


@query(f"SELECT epoch, {', '.join(r4_sql(c) for c in ('loss', 'iou', 'accuracy'))} FROM {HISTORY}")
def epoch_metrics(spark, d):
    history = metrics.epoch_metrics(adapters.epochs(spark, d)).withColumn("loss", F.round("loss", 9))  # a mean that ends in a 5 rounds alike in any order of summing
    return history.withColumns(r4("loss", "iou", "accuracy"))


@query(f"SELECT epoch, {r4_sql('iou')} FROM (SELECT epoch, round(iou, 9) AS iou, max(round(iou, 9)) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM {HISTORY}) WHERE iou > coalesce(best, 0.0)")
def best_epochs(spark, d):
    history = metrics.epoch_metrics(adapters.epochs(spark, d)).select("epoch", F.round("iou", 9).alias("iou"))
    return metrics.best_epochs(history).withColumns(r4("iou"))


@query(f"SELECT {r4_sql('avg(-(0.9 * ln(CASE WHEN label = 1 THEN p ELSE 1 - p END) + 0.05 * (ln(p) + ln(1 - p))))', 'loss')} FROM (SELECT toxic AS label, 0.1 + 0.8 * quality - 0.001 * (doc_id % 50) AS p FROM labels)")
def smoothed_ce(spark, d):
    own = table(spark, d, "labels").withColumn("p", F.lit(0.1) + F.lit(0.8) * F.col("quality") - F.lit(0.001) * (F.col("doc_id") % 50))
    p, q = F.col("p"), 1 - F.col("p")
    loss = F.when(F.col("toxic") == 1, fn.smoothed_cross_entropy(p, q)).otherwise(fn.smoothed_cross_entropy(q, p))
    return own.agg(F.avg(loss).alias("loss")).withColumns(r4("loss"))


@query("SELECT DISTINCT e AS epoch, floor(1e-4 * pow(0.8, floor(e / 15)) * 1e10 + 0.5) / 1e10 + 0.0 AS lr FROM (SELECT CAST(day(ts) AS INT) AS e FROM events)")
def lr_step(spark, d):
    days = table(spark, d, "events").select(F.dayofmonth("ts").alias("epoch")).distinct()
    return days.withColumn("lr", fn.rounded(fn.step_rate(F.col("epoch"), 1e-4, 15, 0.8), 10))


@query(f"SELECT DISTINCT e AS epoch, floor((6e-6 + 5.94e-4 * (1 + cos({math.pi!r} * e / 100)) / 2) * 1e10 + 0.5) / 1e10 + 0.0 AS lr FROM (SELECT CAST(day(ts) AS INT) AS e FROM events)")
def lr_cosine(spark, d):
    days = table(spark, d, "events").select(F.dayofmonth("ts").alias("epoch")).distinct()
    return days.withColumn("lr", fn.rounded(fn.cosine_rate(F.col("epoch"), 6e-4, 100), 10))


# Sampling and composition


@query(f"SELECT scene_id, rank - 1 AS point_idx, x, y, z FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY {key_sql(42, 'downsample', 'scene_id', 'point_idx')}, scene_id, point_idx) AS rank FROM {POINTS}) WHERE rank <= 512")
def downsample(spark, d):
    return longs(sampling.downsample(adapters.points(spark, d).select(*KEYS, *XYZ), ["scene_id"], 512, 42), "point_idx")


@query(f"SELECT scene_id, point_idx, x, y, z, false AS is_pad FROM {POINTS} UNION ALL SELECT scene_id, i, 0.0, 0.0, 0.0, true FROM (SELECT scene_id, count(*) AS n FROM {POINTS} GROUP BY 1), LATERAL (SELECT unnest(range(n, 620)) AS i)")
def pad_to_n(spark, d):
    return sampling.pad_to_n(adapters.points(spark, d).select(*KEYS, *XYZ), ["scene_id"], 620)


@query(f"SELECT scene_id, point_idx, ix, iy, iz FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, ix, iy, iz ORDER BY {key_sql(42, 'chunk', 'scene_id', 'ix', 'iy', 'iz', 'point_idx')}, point_idx) AS rank FROM {assign_sql(EVAL)}) WHERE rank <= 20")
def chunk_subsample(spark, d):
    own = adapters.points(spark, d)
    assigned = chunks.assign_chunks(own.select(*KEYS, *XYZ), evaluate.grid_steps(own, EVAL))
    return sampling.subsample_chunks(assigned, 20, 42).drop(*XYZ)


@query(f"SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {key_sql(42, 'split', 'doc_id')}, doc_id) <= floor(count(*) OVER () * 80 / 100) THEN 'train' ELSE 'valid' END AS part FROM {PAIRS}")
def train_valid_split(spark, d):
    return sampling.train_valid_split(adapters.pairs(spark, d).select("doc_id"), "doc_id", 80, 42)


@query("SELECT DISTINCT CAST(label AS VARCHAR) AS object_id FROM embeddings WHERE label <> 3")
def alien_antijoin(spark, d):
    return compose.aliens_of(adapters.objects(spark, d).select("object_id").distinct(), "3")


@query(f"SELECT object_id FROM (SELECT 'part' || p_partkey AS object_id FROM part) WHERE object_id <> 'part3' ORDER BY {key_sql(42, 'alien_subset', 'object_id')}, object_id LIMIT 10")
def alien_subset(spark, d):
    names = table(spark, d, "part").select(F.concat(F.lit("part"), F.col("p_partkey").cast("string")).alias("object_id"))
    return compose.alien_subset(names, "part3", COMPOSE)


SCENES = "(SELECT object_id, sample_idx, transform, sample_idx * 10 + transform AS scene_id FROM (SELECT DISTINCT object_id, sample_idx FROM {objects} WHERE object_id = '3' AND sample_idx < 1200), range(10) t(transform))".format(objects=OBJECTS)
COUNTS = f"(SELECT object_id, count(DISTINCT sample_idx) AS n FROM {OBJECTS} GROUP BY 1)"
SLOTS = f"""(SELECT scene_id, 0 AS slot, object_id, sample_idx FROM {SCENES} UNION ALL
SELECT scene_id, slot, object_id, CAST(floor({uniform_sql(42, 'sample', 'scene_id', 'slot')} * n) AS BIGINT) AS sample_idx FROM (
  SELECT scene_id, a.object_id, n, row_number() OVER (PARTITION BY scene_id ORDER BY {key_sql(42, 'alien', 'scene_id', 'a.object_id')}, scene_id, a.object_id) AS slot
  FROM {SCENES} s, {COUNTS} a WHERE a.object_id <> '3') WHERE slot <= 9)"""
COMPOSED = f"(SELECT scene_id, slot, object_id, sample_idx, slot * 21 + point_idx AS point_idx, {', '.join(f'{m} AS {a}' for m, a in zip(MOVED, XYZ, strict=True))}, CAST(slot = 0 AS INT) AS label FROM (SELECT s.scene_id, s.slot, o.*, {motion_sql(('s.scene_id', 's.slot'), COMPOSE)} FROM {SLOTS} s JOIN {OBJECTS} o ON s.object_id = o.object_id AND s.sample_idx = o.sample_idx))"


def composed(spark, d):
    own = adapters.objects(spark, d)
    names = own.select("object_id").distinct()
    counts = own.groupBy("object_id").agg(F.countDistinct("sample_idx").alias("n"))
    scenes = compose.augmentations(own.where("object_id = '3'").select("object_id", "sample_idx").distinct(), COMPOSE)
    return scenes, compose.scene_slots(scenes, compose.alien_subset(names, "3", COMPOSE), counts, COMPOSE), own


@query(f"SELECT {big('scene_id', 'sample_idx', 'transform')} FROM {SCENES}")
def augmentation_cross(spark, d):
    return longs(composed(spark, d)[0], "scene_id", "sample_idx", "transform").drop("object_id")


@query(f"SELECT object_id, {big('scene_id', 'slot', 'sample_idx')} FROM {SLOTS}")
def scene_compose(spark, d):
    return longs(composed(spark, d)[1], "scene_id", "slot", "sample_idx")


@query(f"SELECT object_id, label, {big('scene_id', 'slot', 'sample_idx', 'point_idx')}, {', '.join(r4_sql(a) for a in XYZ)} FROM {COMPOSED}")
def scene_union(spark, d):
    _, slots, own = composed(spark, d)
    return longs(compose.scene_points(slots, own, COMPOSE), "scene_id", "slot", "sample_idx", "point_idx").withColumns(r4(*XYZ))


@query(f"SELECT {big('scene_id', 'point_idx')}, label, {', '.join(r4_sql(a) for a in XYZ)}, is_pad FROM (SELECT scene_id, point_idx, label, x, y, z, false AS is_pad FROM {COMPOSED} UNION ALL SELECT scene_id, i, 0, 0, 0, 0, true FROM {SCENES}, range(210, 220) t(i))")
def scene_pad(spark, d):
    _, slots, own = composed(spark, d)
    whole = compose.scene_points(slots, own, COMPOSE).select("scene_id", "point_idx", "label", *XYZ)
    padded = sampling.pad_to_n(whole, ["scene_id"], 220).withColumn("label", F.coalesce("label", F.lit(0)))
    return longs(padded, "scene_id", "point_idx").withColumns(r4(*XYZ))


# The same for all objects as targets; a scene's id carries its target.
WHOLE = ComposeConfig(points=21)
WHOLE_SCENES = "(SELECT object_id, sample_idx, transform, CAST(object_id AS BIGINT) * 12000 + sample_idx * 10 + transform AS scene_id FROM (SELECT DISTINCT object_id, sample_idx FROM {objects} WHERE sample_idx < 1200), range(10) t(transform))".format(objects=OBJECTS)


def whole_sql(sql: str) -> str:
    return sql.replace(SCENES, WHOLE_SCENES).replace("WHERE a.object_id <> '3'", "WHERE a.object_id <> s.object_id")


def composed_whole(spark, d):
    own = adapters.objects(spark, d)
    counts = own.groupBy("object_id").agg(F.countDistinct("sample_idx").alias("n"))
    scenes = compose.augmentations(own.select("object_id", "sample_idx").distinct(), WHOLE)
    scenes = scenes.withColumn("scene_id", F.col("object_id").cast("long") * (WHOLE.samples * WHOLE.transforms) + F.col("scene_id"))
    return scenes, compose.scene_slots_of_all(scenes, counts, WHOLE), own


@query(whole_sql(f"SELECT object_id, {big('scene_id', 'sample_idx', 'transform')} FROM {SCENES}"))
def augmentation_cross_whole(spark, d):
    return longs(composed_whole(spark, d)[0], "scene_id", "sample_idx", "transform")


@query(whole_sql(_SQL["scene_compose"]))
def scene_compose_whole(spark, d):
    return longs(composed_whole(spark, d)[1], "scene_id", "slot", "sample_idx")


@query(whole_sql(_SQL["scene_union"]))
def scene_union_whole(spark, d):
    _, slots, own = composed_whole(spark, d)
    return longs(compose.scene_points(slots, own, WHOLE), "scene_id", "slot", "sample_idx", "point_idx").withColumns(r4(*XYZ))


@query(whole_sql(_SQL["scene_pad"]))
def scene_pad_whole(spark, d):
    _, slots, own = composed_whole(spark, d)
    whole = compose.scene_points(slots, own, WHOLE).select("scene_id", "point_idx", "label", *XYZ)
    padded = sampling.pad_to_n(whole, ["scene_id"], 220).withColumn("label", F.coalesce("label", F.lit(0)))
    return longs(padded, "scene_id", "point_idx").withColumns(r4(*XYZ))


@query("SELECT p_type AS object_name, count(*) AS samples, CAST(min(p_size) AS INT) AS grasp_force_n, CAST(sum(l_quantity) AS BIGINT) AS points FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type")
def catalog_join(spark, d):
    text = {"object_name": "p_type", "category": "p_brand", "ean": "p_partkey", "product_name": "p_name", "grasp_force_n": "p_size", "weight_g": "p_retailprice"}
    catalog = pcd.clean_catalog(table(spark, d, "part").select(*[F.col(c).cast("string").alias(n) for n, c in text.items()]))
    samples = table(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("ean"), "l_quantity")
    joined = pcd.join_catalog(samples, catalog.select("ean", "object_name", "grasp_force_n")).where("object_name is not null")
    return joined.groupBy("object_name").agg(F.count("*").alias("samples"), F.min("grasp_force_n").alias("grasp_force_n"), F.sum("l_quantity").cast("long").alias("points"))


# Every hundredth customer's orders, each found by its chunk and position.
@query("SELECT o_orderkey, o_custkey, CAST(floor(o_orderkey / 100) AS BIGINT) AS chunk_id, o_orderkey % 100 AS position FROM orders WHERE o_custkey % 100 = 0")
def chunk_locate_many(spark, d):
    own = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    packed = batches.chunk_pack(own, "o_orderkey", 100)
    wanted = batches.chunk_pack(own.where(F.col("o_custkey") % 100 == 0).select("o_orderkey"), "o_orderkey", 100).select("chunk_id", "position")
    return packed.join(wanted, ["chunk_id", "position"])


@query(whole_sql(f"SELECT CAST(floor(scene_id / 100) AS BIGINT) AS chunk_id, CAST(scene_id AS BIGINT) AS scene_id, CAST(row_number() OVER (PARTITION BY floor(scene_id / 100) ORDER BY scene_id) - 1 AS INT) AS position, count(*) AS points, CAST(sum(label) AS BIGINT) AS target_points, {r4_sql('avg(x)', 'mean_x')} FROM {COMPOSED} GROUP BY scene_id"))
def scene_store(spark, d):
    """A store that is written in two goes: the first one stops after its first lot."""
    path = f"{shared_dir(spark)}/points/store-{uuid.uuid4().hex}"
    scenes, _, own = composed_whole(spark, d)
    counts = own.groupBy("object_id").agg(F.countDistinct("sample_idx").alias("n"))
    make = lambda some: compose.scene_points(compose.scene_slots_of_all(some, counts, WHOLE), own, WHOLE)

    class Stopped(Exception):
        pass

    def stop(progress):
        raise Stopped

    try:
        store.write_store(scenes, make, path, WHOLE, lot=16, told=stop)
    except Stopped:
        pass
    store.write_store(scenes, make, path, WHOLE)
    read = store.read_store(spark, path).groupBy("chunk_id", "scene_id", "position")
    return read.agg(F.count("*").alias("points"), F.sum("label").cast("long").alias("target_points"), F.avg("x").alias("mean_x")).withColumns({"chunk_id": F.col("chunk_id").cast("long")} | r4("mean_x"))


UNEVEN = "(SELECT o_custkey AS chunk_id, count(*) AS samples FROM orders GROUP BY 1)"
BEGINS = f"(SELECT *, coalesce(CAST(sum(samples) OVER (ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS begins FROM {UNEVEN})"


def uneven(spark, d):
    """Customers' orders as chunks of samples, of which no two need be of one size."""
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("chunk_id")).agg(F.count("*").alias("samples"))


@query(f"SELECT * FROM {BEGINS}")
def chunk_index(spark, d):
    return store.chunk_index(uneven(spark, d))


@query(f"SELECT o_orderkey, chunk_id, o_orderkey - begins AS position FROM orders JOIN {BEGINS} ON o_orderkey >= begins AND o_orderkey < begins + samples")
def chunk_locate_uneven(spark, d):
    return store.locate(table(spark, d, "orders").select("o_orderkey"), store.chunk_index(uneven(spark, d)), WHOLE, "o_orderkey")


@query("SELECT min(p_name) AS object_id FROM part WHERE contains(p_name, 'bolt') HAVING count(*) > 0")
def target_lookup(spark, d):
    return compose.find_object(table(spark, d, "part").select(F.col("p_name").alias("object_id")), "bolt")


@query(f"SELECT count(DISTINCT object_id) AS objects, count(*) AS points, {r4_sql('count(*) * 48 / (1024 * 1024)', 'megabytes')} FROM {OBJECTS} WHERE object_id <> '3'")
def alien_cache_size(spark, d):
    own = adapters.objects(spark, d)
    return compose.cache_size(own, compose.aliens_of(own.select("object_id").distinct(), "3")).withColumns(r4("megabytes"))


# Batches


def items(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).withColumns({"batch": F.floor(F.col("o_custkey") / 4), "item": F.col("o_custkey") % 4})


ITEMS = "(SELECT o_custkey, count(*) AS n, CAST(floor(o_custkey / 4) AS BIGINT) AS batch, o_custkey % 4 AS item FROM orders GROUP BY o_custkey)"


@query(f"SELECT o_custkey, n, batch, item, CAST(sum(n) OVER (PARTITION BY batch ORDER BY item ROWS UNBOUNDED PRECEDING) AS BIGINT) AS \"offset\" FROM {ITEMS}")
def batch_offsets(spark, d):
    return batches.batch_offsets(items(spark, d), ["batch"])


@query(f"SELECT o_custkey, batch, row_number() OVER (PARTITION BY batch ORDER BY item) - 1 AS batch_index FROM {ITEMS}")
def batch_index(spark, d):
    return longs(batches.batch_index(items(spark, d), ["batch"], "item").select("o_custkey", "batch", "batch_index"), "batch_index")


@query(f"SELECT o_custkey, batch FROM {ITEMS} WHERE batch IN (SELECT batch FROM {ITEMS} GROUP BY batch HAVING count(*) = 4)")
def drop_last(spark, d):
    return batches.drop_last(items(spark, d), ["batch"], 4).select("o_custkey", "batch")


@query(f"SELECT day, event_id, CAST(floor(pos / 4) AS BIGINT) AS batch, CAST(pos % 4 AS INT) AS item FROM (SELECT CAST(day(ts) AS INT) AS day, event_id, row_number() OVER (PARTITION BY day(ts) ORDER BY {key_sql(42, 'epoch3', 'event_id')}, event_id) - 1 AS pos FROM events)")
def shuffle_batches(spark, d):
    own = table(spark, d, "events").select(F.dayofmonth("ts").alias("day"), "event_id")
    return batches.shuffle_batches(own, ["day"], "event_id", 4, 42, 3)


@query("SELECT o_orderkey, CAST(floor(o_orderkey / 100) AS BIGINT) AS chunk_id, o_orderkey % 100 AS position FROM orders")
def chunk_pack(spark, d):
    return batches.chunk_pack(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 100)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE floor(o_orderkey / 100) = 7 AND o_orderkey % 100 BETWEEN 20 AND 29")
def chunk_locate(spark, d):
    packed = batches.chunk_pack(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 100)
    return packed.where((F.col("chunk_id") == 7) & F.col("position").between(20, 29)).select("o_orderkey", "o_custkey")


# Clusters

NEAR = f"(SELECT a.scene_id, a.point_idx, b.point_idx AS other FROM {POINTS} a JOIN {POINTS} b ON a.scene_id = b.scene_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= {EPS!r} * {EPS!r})"
DBSCAN = f"""WITH RECURSIVE near AS MATERIALIZED (SELECT * FROM {NEAR}),
core AS MATERIALIZED (SELECT scene_id, point_idx FROM near GROUP BY ALL HAVING count(*) >= {MIN_SAMPLES}),
links AS MATERIALIZED (SELECT n.* FROM near n SEMI JOIN core c ON n.scene_id = c.scene_id AND n.point_idx = c.point_idx SEMI JOIN core o ON n.scene_id = o.scene_id AND n.other = o.point_idx),
reach AS (SELECT scene_id, point_idx, point_idx AS cluster FROM core UNION SELECT l.scene_id, l.other, r.cluster FROM reach r JOIN links l ON l.scene_id = r.scene_id AND l.point_idx = r.point_idx WHERE r.cluster < l.other),
own AS MATERIALIZED (SELECT scene_id, point_idx, min(cluster) AS cluster FROM reach GROUP BY ALL),
c AS MATERIALIZED (SELECT n.scene_id, n.point_idx, min(o.cluster) AS cluster FROM near n JOIN own o ON n.scene_id = o.scene_id AND n.other = o.point_idx GROUP BY ALL)
"""
LARGEST = "(SELECT scene_id, cluster, n FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY n DESC, cluster) AS k FROM (SELECT scene_id, cluster, count(*) AS n FROM c GROUP BY ALL)) WHERE k = 1)"


@query(f"SELECT * FROM {NEAR}")
def eps_neighbors(spark, d):
    return clustering.eps_neighbors(adapters.points(spark, d), EPS_DECIMAL)


@query(f"SELECT scene_id, point_idx FROM {NEAR} GROUP BY ALL HAVING count(*) >= {MIN_SAMPLES}")
def dbscan_core(spark, d):
    return clustering.core_points(adapters.points(spark, d), EPS_DECIMAL, MIN_SAMPLES)


@query(DBSCAN + "SELECT * FROM c")
def dbscan_labels(spark, d):
    return clustering.dbscan(adapters.points(spark, d), EPS_DECIMAL, MIN_SAMPLES)


@query(DBSCAN + "SELECT scene_id, cluster, count(*) AS n FROM c GROUP BY ALL")
def cluster_sizes(spark, d):
    return clustering.cluster_sizes(clustering.dbscan(adapters.points(spark, d), EPS_DECIMAL, MIN_SAMPLES))


@query(DBSCAN + f"SELECT * FROM {LARGEST}")
def largest_cluster(spark, d):
    return clustering.largest_cluster(clustering.dbscan(adapters.points(spark, d), EPS_DECIMAL, MIN_SAMPLES))


CLUSTERED = EvalConfig(profile=V3, cluster=True, eps=EPS_DECIMAL, min_samples=MIN_SAMPLES)
DEMOTED = f"""SELECT v.* EXCLUDE (pred), CASE WHEN v.pred = 1 AND l.cluster IS NOT NULL AND c.cluster IS DISTINCT FROM l.cluster THEN 0 ELSE v.pred END AS pred
FROM voted v LEFT JOIN c ON v.scene_id = c.scene_id AND v.point_idx = c.point_idx LEFT JOIN {LARGEST} l ON v.scene_id = l.scene_id"""
COUNT_CLASSES = ", ".join([*(f"count(*) FILTER (WHERE class = '{k}') AS {k}_points" for k in ("target", "alien", "background")), *(r4_sql(f"count(*) FILTER (WHERE class = '{k}') / count(*) * 100", f"{k}_rate") for k in ("target", "alien"))])


@query(
    DBSCAN.replace("WITH RECURSIVE near", f"WITH RECURSIVE voted AS MATERIALIZED (SELECT * FROM {vote_sql(CLUSTERED)}), targets AS MATERIALIZED (SELECT * FROM voted WHERE pred = 1), near").replace(NEAR, NEAR.replace(POINTS, "targets"))
    + f"SELECT scene_id, count(*) AS total_points, {COUNT_CLASSES} FROM (SELECT *, {CLASS} FROM ({DEMOTED})) GROUP BY scene_id"
)
def scene_summary_clustered(spark, d):
    return summary(spark, d, CLUSTERED).withColumns(r4("target_rate", "alien_rate"))


# Models


@query(f"SELECT scene_id, point_idx, CASE WHEN x - y > z THEN 1 ELSE 0 END AS pred, {r4_sql('exp(z - greatest(z, x - y)) / (exp(z - greatest(z, x - y)) + exp(x - y - greatest(z, x - y)))', 'p0')}, {r4_sql('exp(x - y - greatest(z, x - y)) / (exp(z - greatest(z, x - y)) + exp(x - y - greatest(z, x - y)))', 'p1')} FROM {POINTS}")
def softmax_argmax(spark, d):
    scored = adapters.points(spark, d).withColumns({"l0": F.col("z"), "l1": F.col("x") - F.col("y")})
    return scoring.predict(scored).select(*KEYS, "pred", "p0", "p1").withColumns(r4("p0", "p1"))


HEAD = (([[0.5, -0.25, 1.0], [1.0, 0.5, -0.5]], [0.1, -0.2]), ([0.3, 0.4], [0.9, 1.1], [1.2, 0.8], [0.05, -0.05]), ([[0.7, -0.3], [-0.6, 0.9]], [0.0, 0.1]))
_H = [f"(0.1 + 0.5 * x + -0.25 * y + 1.0 * z - 0.3) / {(0.9 + 1e-5) ** 0.5!r} * 1.2 + 0.05", f"(-0.2 + 1.0 * x + 0.5 * y + -0.5 * z - 0.4) / {(1.1 + 1e-5) ** 0.5!r} * 0.8 + -0.05"]


@query(f"SELECT scene_id, point_idx, {r4_sql('0.7 * h0 + -0.3 * h1', 'l0')}, {r4_sql('0.1 + -0.6 * h0 + 0.9 * h1', 'l1')} FROM (SELECT scene_id, point_idx, greatest(0.0, {_H[0]}) AS h0, greatest(0.0, {_H[1]}) AS h1 FROM {POINTS})")
def mlp_head(spark, d):
    l0, l1 = scoring.mlp_head([F.col(a) for a in XYZ], *HEAD)
    return adapters.points(spark, d).select(*KEYS, l0.alias("l0"), l1.alias("l1")).withColumns(r4("l0", "l1"))


@query(f"SELECT p_partkey, {r4_sql(f'-0.25 + {uniform_sql(42, 'u', 'p_partkey')} * 0.5', 'u')} FROM part")
def uniform_draws(spark, d):
    return table(spark, d, "part").select("p_partkey", fn.rounded(uniform_between(-0.25, 0.25, 42, "u", "p_partkey")).alias("u"))


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
