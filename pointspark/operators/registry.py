"""Trained scorers in the shared folder, loaded once by each Python worker.

A model is a file of named arrays and of what a user must know before using it:
the kind of network head, how many logits it gives a point, whether it takes
features besides coordinates.  Files are written once, under a new version, and
opened by ``pyarrow.fs`` on the driver and in tasks.
"""

from __future__ import annotations

import io
import json
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyarrow import fs
from pyspark.sql import SparkSession

from pointspark.functions.shared import shared_dir

#: Models that a worker holds.
HELD = 8

#: The models that this process has read from files, in order.
loaded: list[Model] = []


@dataclass(frozen=True)
class Model:
    """Where a model is, and what it is; small, so tasks get this and not the arrays.

    Called with (n, 3) coordinates, and (n, f) features if it takes them, it
    gives (n, width) logits.
    """

    path: str
    name: str
    version: int
    kind: str
    width: int
    features: bool
    places: int | None = None

    def __call__(self, *inputs: np.ndarray) -> np.ndarray:
        logits = KINDS[self.kind](np.concatenate(inputs, axis=1), arrays_of(self))
        return logits if self.places is None else np.round(logits, self.places)


def _linear(x: np.ndarray, a: dict[str, np.ndarray]) -> np.ndarray:
    return x @ a["weights"].T + a["bias"]


def _mlp(x: np.ndarray, a: dict[str, np.ndarray]) -> np.ndarray:
    """Linear, batch norm, ReLU, linear: the segmentation head at inference."""
    hidden = x @ a["first_weights"].T + a["first_bias"]
    hidden = (hidden - a["mean"]) / np.sqrt(a["variance"] + 1e-5) * a["gamma"] + a["beta"]
    return np.maximum(hidden, 0) @ a["second_weights"].T + a["second_bias"]


KINDS = {"linear": _linear, "mlp": _mlp}
#: The array whose length is the number of logits, and the one whose second axis is the inputs.
ENDS = {"linear": ("bias", "weights"), "mlp": ("second_bias", "first_weights")}


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def models_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/points/models"


def publish(root: str, name: str, kind: str, arrays: dict[str, np.ndarray], places: int | None = None) -> Model:
    """Write a model under the next version; it is seen only when it is whole."""
    last, inputs = ENDS[kind]
    width, takes = len(arrays[last]), np.asarray(arrays[inputs]).shape[1]
    if takes < 3:
        raise ValueError("a model takes three coordinates at least")
    system, folder = _opened(root)
    known = _versions(system, f"{folder}/{name}")
    model = Model(f"{root}/{name}", name, (known[-1] if known else 0) + 1, kind, width, takes > 3, places)
    about = json.dumps({"kind": kind, "width": width, "features": takes > 3, "places": places})
    held = io.BytesIO()
    np.savez(held, about=np.array(about), **{k: np.asarray(v, np.float64) for k, v in arrays.items()})
    system.create_dir(f"{folder}/{name}")
    with system.open_output_stream(f"{folder}/{name}/_{model.version}") as out:
        out.write(held.getvalue())
    system.move(f"{folder}/{name}/_{model.version}", f"{folder}/{name}/{model.version}.npz")
    return model


def _versions(system: fs.FileSystem, folder: str) -> list[int]:
    files = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(int(f.base_name[:-4]) for f in files if f.base_name.endswith(".npz"))


def find(root: str, name: str, version: int | None = None) -> Model | None:
    """A published model, the latest unless a version is asked for; None if there is none."""
    system, folder = _opened(root)
    known = _versions(system, f"{folder}/{name}")
    if not known or version is not None and version not in known:
        return None
    version = version or known[-1]
    about = json.loads(str(_read(system, f"{folder}/{name}/{version}.npz")["about"]))
    return Model(f"{root}/{name}", name, version, about["kind"], about["width"], about["features"], about["places"])


def _read(system: fs.FileSystem, path: str) -> dict[str, np.ndarray]:
    with system.open_input_stream(path) as stream, np.load(io.BytesIO(stream.read()), allow_pickle=False) as held:
        return {k: held[k] for k in held.files}


@lru_cache(maxsize=HELD)
def arrays_of(model: Model) -> dict[str, np.ndarray]:
    """The model's arrays; a worker reads each path and version once."""
    system, folder = _opened(model.path)
    loaded.append(model)
    return _read(system, f"{folder}/{model.version}.npz")
