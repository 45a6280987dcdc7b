"""Column expressions over points; all stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """NaN becomes 0, infinities become 1 and -1."""
    return F.when(F.isnan(c), 0.0).when(c == float("inf"), 1.0).when(c == float("-inf"), -1.0).otherwise(c)


def rounded(c: Column, places: int = 4) -> Column:
    """Half up, without a negative zero."""
    scale = float(10**places)
    return F.floor(c * scale + 0.5) / scale + F.lit(0.0)


def nearest(c: Column, places: int) -> Column:
    """Half away from zero, as SQL's round of doubles; Spark's writes each number as a decimal, which takes several times as long."""
    scale = float(10**places)
    return F.signum(c) * (F.floor(F.abs(c) * scale + 0.5) / scale)


def unpack_rgb(packed: Column) -> list[Column]:
    """Red, green and blue in [0, 1] of an integer r << 16 | g << 8 | b."""
    return [F.shiftright(packed, shift).bitwiseAND(255) / 255.0 for shift in (16, 8, 0)]


def clip_label(label: Column, classes: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(classes - 1), label))


def three_way_class(pred: Column, confidence: Column, alien_above: float = 0.8) -> Column:
    """target, alien (confident background class) or background."""
    return F.when(pred == 1, "target").when((pred == 0) & (confidence > alien_above), "alien").otherwise("background")


def class_colour(name: Column) -> list[Column]:
    """Red for targets, blue for aliens, null (keep the colour) for the rest."""
    pick = lambda target, alien: F.when(name == "target", target).when(name == "alien", alien)
    return [pick(1.0, 0.0), pick(0.0, 0.0), pick(0.0, 1.0)]


def scene_name(file_name: Column) -> Column:
    bare = F.replace(F.replace(F.replace(file_name, F.lit(".pcd"), F.lit("")), F.lit("realworld_scene_"), F.lit("")), F.lit("_ascii_rgb"), F.lit(""))
    return F.concat(F.lit("Scene_"), bare)


def rotation(a: Column, b: Column, g: Column) -> list[list[Column]]:
    """Rx(a) Ry(b) Rz(g) of angles in degrees, row by row."""
    turn = lambda angle: angle * F.lit(math.pi) / 180.0
    (sa, ca), (sb, cb), (sg, cg) = [(F.sin(turn(v)), F.cos(turn(v))) for v in (a, b, g)]
    return [
        [cb * cg, -cb * sg, sb],
        [sa * sb * cg + ca * sg, ca * cg - sa * sb * sg, -sa * cb],
        [sa * sg - ca * sb * cg, ca * sb * sg + sa * cg, ca * cb],
    ]


def affine(matrix: list[list[Column]], shift: list[Column], point: list[Column]) -> list[Column]:
    """Rotate, then translate."""
    return [row[0] * point[0] + row[1] * point[1] + row[2] * point[2] + t for row, t in zip(matrix, shift, strict=True)]


def softmax(l0: Column, l1: Column) -> tuple[Column, Column]:
    """Probabilities of two classes from their logits."""
    top = F.greatest(l0, l1)
    e0, e1 = F.exp(l0 - top), F.exp(l1 - top)
    return e0 / (e0 + e1), e1 / (e0 + e1)


def smoothed_cross_entropy(p_label: Column, p_other: Column, smoothing: float = 0.1) -> Column:
    """Cross-entropy of two classes with label smoothing."""
    return -(F.lit(1 - smoothing) * F.log(p_label) + F.lit(smoothing / 2) * (F.log(p_label) + F.log(p_other)))


def step_rate(epoch: Column, rate: float, every: int, factor: float) -> Column:
    return F.lit(rate) * F.pow(F.lit(factor), F.floor(epoch / every))


def cosine_rate(epoch: Column, rate: float, epochs: int, floor_share: float = 0.01) -> Column:
    low = rate * floor_share
    return F.lit(low) + F.lit(rate - low) * (1 + F.cos(F.lit(math.pi) * epoch / epochs)) / 2
