"""Views of the test tables as points, objects, predictions and epochs, each in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as points: a supplier is a scene.

    Named after the window, so that its deal by supplier counts as one by scene, and its rows are those of the table.
    """
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate"]
    index = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*order)) - 1
    return table(spark, sf_dir, "lineitem").withColumn("point_idx", index.cast("long")).select(
        F.col("l_suppkey").alias("scene_id"), "point_idx",
        (F.col("l_quantity") / 10).alias("x"), (F.col("l_extendedprice") / 20000).alias("y"), (F.col("l_discount") * 10).alias("z"),
        (F.col("l_tax") * 10).alias("r"), (F.col("l_discount") * 8).alias("g"), (F.col("l_quantity") / 60).alias("b"),
    )


POINTS = """(SELECT l_suppkey AS scene_id,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate) - 1 AS point_idx,
  l_quantity / 10 AS x, l_extendedprice / 20000 AS y, l_discount * 10 AS z,
  l_tax * 10 AS r, l_discount * 8 AS g, l_quantity / 60 AS b FROM lineitem)"""


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as object samples of 21 points: a label is an object."""
    own = table(spark, sf_dir, "embeddings")
    index = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    value = lambda d: F.get("embedding", F.col("i") * 3 + d).cast("double")
    rows = own.select("label", "embedding", index.alias("sample_idx")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(20))))
    return rows.select(F.col("label").cast("string").alias("object_id"), "sample_idx", F.col("i").cast("long").alias("point_idx"), value(0).alias("x"), value(1).alias("y"), value(2).alias("z"))


OBJECTS = """(SELECT CAST(label AS VARCHAR) AS object_id, sample_idx, i AS point_idx,
  CAST(embedding[i * 3 + 1] AS DOUBLE) AS x, CAST(embedding[i * 3 + 2] AS DOUBLE) AS y, CAST(embedding[i * 3 + 3] AS DOUBLE) AS z
  FROM (SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS sample_idx FROM embeddings), range(21) t(i))"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("pred"), F.col("toxic").alias("label"))


PAIRS = "(SELECT doc_id, quality AS pred, toxic AS label FROM labels)"


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as scored points: a day is an epoch, an hour a batch; the loss of one batch an epoch is NaN."""
    own = table(spark, sf_dir, "events")
    bad = F.hour("ts") == F.dayofmonth("ts") % 24
    return own.select(
        F.dayofmonth("ts").alias("epoch"), F.hour("ts").alias("batch"), (F.col("value") > 50).cast("int").alias("pred"),
        (F.col("event_type") == "purchase").cast("int").alias("label"), F.when(bad, float("nan")).otherwise(F.col("value") / 100).alias("loss"),
    )


EPOCHS = """(SELECT CAST(day(ts) AS INT) AS epoch, CAST(hour(ts) AS INT) AS batch, CAST(value > 50 AS INT) AS pred,
  CAST(event_type = 'purchase' AS INT) AS label,
  CASE WHEN hour(ts) = day(ts) % 24 THEN CAST('nan' AS DOUBLE) ELSE value / 100 END AS loss FROM events)"""


def uniform_sql(seed: int, purpose: str, *ids: str) -> str:
    return f"(CAST('0x' || substr({key_sql(seed, purpose, *ids)}, 1, 8) AS BIGINT) / 4294967296.0)"


def key_sql(seed: int, purpose: str, *ids: str) -> str:
    return f"md5(concat_ws(':', '{seed}', '{purpose}', {', '.join(ids)}))"
