"""Clustering on ties of eps as its SQL has them, with as few copies of points as cells need, and without broadcasts of what grows."""

import datetime
import random

import duckdb

from pointspark.operators import clustering
from pointspark.plans import catalog


def test_pairs_at_exactly_eps_are_those_of_the_sql(spark, tmp_path):
    """0.35 squared is 0.1225 in SQL's decimals and less than that in doubles; differences of 7000 in price are 0.35."""
    rng, rows = random.Random(5), []
    for scene in range(400):
        price, quantity, discount = rng.randint(90_000, 9_700_000) / 100, float(rng.randint(1, 47)), rng.randint(0, 9) / 100
        for i, (q, p, z) in enumerate([(0, 0, 0), (0, 7000, 0), (3, 3000, 1)]):
            rows.append((scene * 10 + i, i, i, scene, quantity + q, round(price + p, 2), round(discount + z / 100, 2), 0.02, datetime.datetime(1995, 1, 1)))
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = sorted(con.execute(catalog.oracle_sql()["eps_neighbors"]).fetchall())
    found = catalog.queries()["eps_neighbors"](spark, str(tmp_path)).collect()
    assert len(want) > len(rows) and sorted(map(tuple, found)) == want


def grid(spark, n):
    rng = random.Random(6)
    return spark.createDataFrame([(i % 3, i // 3, rng.random(), rng.random(), rng.random() / 10) for i in range(n)], "scene_id long, point_idx long, x double, y double, z double")


def test_a_point_goes_to_the_cells_that_it_reaches(spark):
    """Eight of them, not 27."""
    points = grid(spark, 300)
    joined = []
    inner = type(points).join

    def join(self, other, *args, **kwargs):
        joined.append(self.count())
        return inner(self, other, *args, **kwargs)

    type(points).join = join
    try:
        clustering.near_pairs(points, points, 0.05)
    finally:
        type(points).join = inner
    assert joined and joined[0] <= 8 * 300


def test_no_table_that_grows_is_broadcast(spark, monkeypatch):
    plans = []
    keep = clustering.save

    def save(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return keep(df, name)

    monkeypatch.setattr(clustering, "save", save)
    points = grid(spark, 600)
    found = clustering.dbscan(points, 0.05, 3)
    plans.append(("result", found._jdf.queryExecution().executedPlan().toString()))
    assert found.count() and not [name for name, plan in plans if "BroadcastHashJoin" in plan]
