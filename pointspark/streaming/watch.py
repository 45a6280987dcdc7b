"""Scenes that arrive as text files are evaluated as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pointspark.functions.shared import scope
from pointspark.plans.config import EvalConfig
from pointspark.plans.evaluate import evaluate


def watch_scenes(spark: SparkSession, folder: str, schema: str, sink: Callable[[DataFrame, int], None], checkpoint: str, config: EvalConfig, files: int = 100, available_now: bool = False) -> StreamingQuery:
    """Evaluate each micro-batch of Parquet scene files and hand the classified points to ``sink``.

    A scene must come in one file, so scenes don't wait for each other and no
    state is kept; the checkpoint makes sure that each file is taken once.
    ``sink`` must write what it gets: the tables behind it go with the batch.
    """

    def handle(batch: DataFrame, number: int) -> None:
        with scope(spark):
            sink(evaluate(batch, config).withColumn("arrived", F.lit(number)), number)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
