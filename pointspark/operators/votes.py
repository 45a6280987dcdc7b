"""Votes of overlapping chunk predictions, classes and scene reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointspark.functions.columns import softmax, three_way_class


def vote(points: DataFrame, predictions: DataFrame) -> DataFrame:
    """Each point with pred, confidence and seen; ties go to class 0, unseen points are class 0 with confidence 0.

    The confidence is the larger mean probability, whichever class wins.
    """
    votes = predictions.groupBy("scene_id", "point_idx").agg(
        F.sum(F.when(F.col("pred") == 1, 1).otherwise(0)).alias("v1"),
        F.sum(F.when(F.col("pred") == 0, 1).otherwise(0)).alias("v0"),
        F.count("*").alias("seen"),
        F.avg("p0").alias("p0"),
        F.avg("p1").alias("p1"),
    )
    return _decided(points.join(votes, ["scene_id", "point_idx"], "left"))


def _decided(counted: DataFrame) -> DataFrame:
    return counted.withColumns(
        {
            "pred": F.when(F.col("v1") > F.col("v0"), 1).otherwise(0),
            "confidence": F.coalesce(F.greatest("p0", "p1"), F.lit(0.0)),
            "seen": F.coalesce("seen", F.lit(0)),
        }
    ).drop("v0", "v1", "p0", "p1")


#: So many chunks of a point are scored by compiled expressions, and what more it has by functions over arrays, which Spark interprets.
SLOTS = 8


def vote_in_place(points: DataFrame, logits: Callable[[Column], tuple[Column, Column]], chunks: str = "chunks") -> DataFrame:
    """The same of points that carry all their chunks in an array, null or empty if none holds them; ``logits`` gives l0 and l1 of a point in one."""
    size = F.coalesce(F.size(chunks), F.lit(0))
    own = points.withColumn("_size", F.greatest(size, F.lit(0)))
    slots = [(i, F.col("_size") > i) for i in range(SLOTS)]
    scored = {}
    for i, held in slots:
        l0, l1 = logits(F.get(chunks, F.lit(i)))
        scored |= {f"_l0_{i}": F.when(held, l0), f"_l1_{i}": F.when(held, l1)}

    def rest(chunk: Column) -> Column:
        l0, l1 = logits(chunk)
        return F.struct(l0.alias("l0"), l1.alias("l1"))

    more = F.when(F.col("_size") > SLOTS, F.transform(F.slice(chunks, F.lit(SLOTS + 1), F.col("_size") - SLOTS), rest))
    own = own.withColumns(scored | {"_more": more})
    power = lambda l, l0, l1: F.exp(l - F.greatest(l0, l1))  # noqa: E731, E741
    pair = lambda i: (F.col(f"_l0_{i}"), F.col(f"_l1_{i}"))
    own = own.withColumns({f"_e{k}_{i}": power(pair(i)[k], *pair(i)) for i, _ in slots for k in (0, 1)})
    own = own.withColumns({f"_p{k}_{i}": F.coalesce(F.col(f"_e{k}_{i}") / (F.col(f"_e0_{i}") + F.col(f"_e1_{i}")), F.lit(0.0)) for i, _ in slots for k in (0, 1)})

    def probability(k: int) -> Callable[[Column, Column], Column]:
        return lambda total, l: total + softmax(l["l0"], l["l1"])[k]  # noqa: E741

    further = lambda k: F.coalesce(F.aggregate("_more", F.lit(0.0), probability(k)), F.lit(0.0))
    counted = {f"_p{k}": sum((F.col(f"_p{k}_{i}") for i in range(1, SLOTS)), F.col(f"_p{k}_0")) + further(k) for k in (0, 1)}
    targets = [F.coalesce((pair(i)[1] > pair(i)[0]).cast("int"), F.lit(0)) for i, _ in slots]
    counted["v1"] = sum(targets[1:], targets[0]) + F.coalesce(F.size(F.filter("_more", lambda l: l["l1"] > l["l0"])), F.lit(0))  # noqa: E741
    own = own.withColumns(counted).withColumn("seen", F.nullif(F.col("_size").cast("long"), F.lit(0)))
    mean = [(F.col(f"_{p}") / F.col("seen")).alias(p) for p in ("p0", "p1")]
    return _decided(own.select(*points.drop(chunks).columns, "v1", (F.col("seen") - F.col("v1")).alias("v0"), "seen", *mean))


def classify(voted: DataFrame, alien_above: float = 0.8) -> DataFrame:
    return voted.withColumn("class", three_way_class(F.col("pred"), F.col("confidence"), alien_above))


def coverage(voted: DataFrame) -> DataFrame:
    """The share of each scene's points that some chunk saw, in per cent."""
    return voted.groupBy("scene_id").agg((F.avg((F.col("seen") > 0).cast("int")) * 100).alias("coverage_percent"))


def scene_summary(classified: DataFrame) -> DataFrame:
    count = lambda name: F.count_if(F.col("class") == name)
    totals = classified.groupBy("scene_id").agg(F.count("*").alias("total_points"), *[count(c).alias(f"{c}_points") for c in ("target", "alien", "background")])
    return totals.withColumns({f"{c}_rate": F.col(f"{c}_points") / F.col("total_points") * 100 for c in ("target", "alien")})


def batch_summary(summary: DataFrame) -> DataFrame:
    """The report table of a run: a row for each scene."""
    return summary.select(
        F.concat(F.lit("Scene_"), F.col("scene_id").cast("string")).alias("Scene"),
        F.col("total_points").alias("Total_Points"),
        F.col("target_points").alias("Target_Points"),
        F.col("alien_points").alias("Alien_Points"),
        F.col("target_rate").alias("Target_Rate_Percent"),
        F.col("alien_rate").alias("Alien_Rate_Percent"),
        (F.col("target_points") > 0).alias("Target_Detected"),
        (F.col("alien_points") > 0).alias("Alien_Detected"),
    )


def run_totals(summary: DataFrame) -> DataFrame:
    return summary.agg(
        F.count("*").alias("scenes"),
        F.sum("total_points").alias("total_points"),
        F.sum("target_points").alias("target_points"),
        F.sum("alien_points").alias("alien_points"),
        F.count_if(F.col("target_points") > 0).alias("scenes_with_target"),
        F.count_if(F.col("alien_points") > 0).alias("scenes_with_alien"),
    )


def success_rates(summary: DataFrame) -> DataFrame:
    """In per cent of the scenes: target found, alien found, either found."""
    rate = lambda keep: F.count_if(keep) / F.count("*") * 100
    target, alien = F.col("target_points") > 0, F.col("alien_points") > 0
    return summary.agg(rate(target).alias("target_rate"), rate(alien).alias("alien_rate"), rate(target | alien).alias("any_rate"))


def histogram(rows: DataFrame, column: str, most_bins: int = 10) -> DataFrame:
    """(bin, low, high, n) with equal widths, at most a bin for each row; the last bin is closed.

    If all values are equal, the range is widened by a half on either side.
    """
    span = rows.agg(F.min(column).cast("double").alias("a"), F.max(column).cast("double").alias("b"), F.least(F.count("*"), F.lit(most_bins)).alias("k"))
    flat = F.col("a") == F.col("b")
    span = span.select(F.when(flat, F.col("a") - 0.5).otherwise(F.col("a")).alias("a"), F.when(flat, F.col("b") + 0.5).otherwise(F.col("b")).alias("b"), "k")
    width = (F.col("b") - F.col("a")) / F.col("k")
    # ``span`` is one row.
    placed = rows.select(F.col(column).alias("v")).crossJoin(F.broadcast(span))
    counts = placed.select(F.least(F.floor((F.col("v") - F.col("a")) / width), F.col("k") - 1).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    bins = span.select("a", width.alias("w"), F.explode(F.sequence(F.lit(0), (F.col("k") - 1).cast("int"))).alias("bin"))
    return bins.join(counts, "bin", "left").select("bin", (F.col("a") + F.col("bin") * F.col("w")).alias("low"), (F.col("a") + (F.col("bin") + 1) * F.col("w")).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))
