"""Run configuration; two profiles carry what differs between the model generations."""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal


@dataclass(frozen=True)
class Profile:
    name: str
    scale: float
    smallest_chunk: float
    largest_chunk: float
    fixed_chunk: float
    features: str
    drop_last: bool
    epochs: int
    rate: float

    def clamp(self, size):
        """Bounds of the adaptive chunk size, as a column."""
        from pyspark.sql import functions as F

        return F.greatest(F.lit(self.smallest_chunk), F.least(F.lit(self.largest_chunk), size))


# The smallest chunk of V2 is ten times its coarsest grid (0.48), above its largest, so its size never adapts.
V2 = Profile("v2", scale=3.0, smallest_chunk=4.8, largest_chunk=2.0, fixed_chunk=5.76, features="xyz", drop_last=True, epochs=50, rate=1e-4)
V3 = Profile("v3", scale=2.0, smallest_chunk=0.2, largest_chunk=2.0, fixed_chunk=0.6, features="rgb", drop_last=False, epochs=100, rate=6e-4)


@dataclass(frozen=True)
class EvalConfig:
    profile: Profile = V3
    target_points: int = 15_000
    overlap: float = 0.2
    adaptive: bool = True
    #: The edge of all chunks; None: adaptive, or the profile's fixed one.
    chunk_size: float | None = None
    #: Chunk positions of an axis at most; None: as many as cover the scene, however wide.
    max_steps: int | None = 100
    max_points: int | None = None
    alien_above: float = 0.8
    cluster: bool = False
    eps: float | Decimal = 0.05
    min_samples: int = 50
    seed: int = 42
    #: The data set that a scorer trained on several is told of; None: no such column.
    condition: str | None = None


@dataclass(frozen=True)
class ComposeConfig:
    points: int = 2048
    aliens: int = 9
    transforms: int = 10
    samples: int = 1200
    angle: float = 180.0
    shift: tuple = field(default=((-0.25, 0.25), (-0.25, 0.25), (0.0, 0.25)))
    chunk_samples: int = 100
    seed: int = 42
