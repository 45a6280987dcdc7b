"""Density clusters (DBSCAN) of whole scenes in NumPy: what ``clustering`` does by joins of cells, for scenes that fit a task.

Several scenes go by at once, so a small one costs no call of its own.  Pairs
are compared in blocks, so memory stays in proportion to the points; cells of
edge eps / sqrt(3) keep the comparisons of dense points few, as in ``clustering``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Points of a call, if scenes are small; and points of a scene at most, which bounds a task's memory.
TAKE, MOST = 1 << 16, 1 << 18
#: Points whose neighbourhoods are looked up at once, and pairs that are compared at once.
ROWS, PAIRS = 1 << 14, 1 << 20


def whole_scenes(tables: Iterator[pa.Table], take: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole scenes, of ``take`` points or a scene more, and where each scene begins, of rows in order of scene_id."""
    held, rows, want = [], 0, take
    for table in tables:
        held.append(table)
        rows += len(table)
        if rows < want:
            continue
        table = pa.concat_tables(held)
        begins = _begins(table)
        last = int(begins[-1])
        if last:
            yield table.slice(0, last), begins[:-1]
        held, rows = [table.slice(last)], len(table) - last
        want = rows + take
    if rows:
        table = pa.concat_tables(held)
        yield table, _begins(table)


def _begins(table: pa.Table) -> np.ndarray:
    scene = pa.concat_arrays(table.column("scene_id").chunks)
    # Points of no scene are near none.
    changes = pc.fill_null(pc.not_equal(scene.slice(1), scene.slice(0, len(scene) - 1)), True).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(changes) + 1])


class _Grid:
    """Cells as whole numbers in order of scene, x, y and z; ``lines`` are the ways to the runs of cells along z that are near."""

    def __init__(self, scene: np.ndarray, places: list[np.ndarray], edge: float, wide: int):
        cells = [np.floor(p / edge) for p in places]
        self.wide = wide
        for dense in (True, False):
            x, y, z = (self._numbers(c, dense) for c in cells)
            x = scene * (int(x.max()) + 1 + wide) + x
            if not dense:
                x = self._numbers(x, False)
            # The room of ``wide`` beside each axis holds no points, so a way across an end meets none.
            ny, nz = int(y.max()) + 1 + wide, int(z.max()) + 1 + wide
            if (int(x.max()) + 1 + wide) * ny * nz < 1 << 62:
                break
        self.key = (x * ny + y) * nz + z
        reach = range(-wide, wide + 1)
        self.lines = [((dx * ny + dy) * nz - wide, (dx * ny + dy) * nz + wide) for dx in reach for dy in reach]
        # Each pair of different cells once.
        self.half = [(1, wide)] + [line for line, d in zip(self.lines, ((dx, dy) for dx in reach for dy in reach), strict=True) if d > (0, 0)]

    def _numbers(self, cells: np.ndarray, dense: bool) -> np.ndarray:
        """From 0, in order; where these get too many, gaps that are out of reach shrink to the least such gap."""
        low = cells.min()
        if dense and cells.max() - low < 1 << 20:
            return (cells - low).astype(np.int64)
        distinct, back = np.unique(cells, return_inverse=True)
        return np.concatenate([[0], np.cumsum(np.minimum(np.diff(distinct), self.wide + 1))]).astype(np.int64)[back]


def _runs(low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, position) for the positions low to high - 1 of each row, in blocks."""
    n = high - low
    some = np.flatnonzero(n > 0)
    ends = np.cumsum(n[some])
    begin = 0
    while begin < len(some):
        done = int(ends[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
        rows = some[begin:end]
        first = ends[begin:end] - n[rows] - done
        yield np.repeat(rows, n[rows]), np.arange(int(ends[end - 1]) - done) + np.repeat(low[rows] - first, n[rows])
        begin = end


def _around(keys: np.ndarray, there: np.ndarray, lines: list[tuple[int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of all keys and those of ``there``, in order, that lie on their lines, in blocks."""
    for begin in range(0, len(keys), ROWS):
        own = keys[begin : begin + ROWS]
        low = np.concatenate([np.searchsorted(there, own + a, "left") for a, _ in lines])
        high = np.concatenate([np.searchsorted(there, own + b, "right") for _, b in lines])
        for row, j in _runs(low, high):
            yield begin + row % len(own), j


def _near(a: list[np.ndarray], i: np.ndarray, b: list[np.ndarray], j: np.ndarray, square: float) -> np.ndarray:
    """Whether the squared distance is within the square of eps, summed in the order of the SQL."""
    x, y, z = (p[i] - q[j] for p, q in zip(a, b, strict=True))
    return x * x + y * y + z * z <= square


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels, each the least node of its part, after the links of a and b."""
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        apart = low < high
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        np.minimum.at(label, high[apart], low[apart])
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up


def core(scene: np.ndarray, places: list[np.ndarray], eps: float, square: float, min_samples: int) -> np.ndarray:
    """Which points have ``min_samples`` within eps, themselves included; scenes are numbers in order."""
    if not len(scene):
        return np.zeros(0, bool)
    small = _Grid(scene, places, eps / 3**0.5 * (1 - 1e-9), 2)
    _, cell, n = np.unique(small.key, return_inverse=True, return_counts=True)
    found = n[cell] >= min_samples
    grid = _Grid(scene, places, eps * (1 + 1e-9), 1)
    order = np.argsort(grid.key, kind="stable")
    there, at = grid.key[order], [p[order] for p in places]
    rest = np.flatnonzero(~found[order])
    count = np.zeros(len(order), np.int64)
    for i, j in _around(there[rest], there, grid.lines):
        i = rest[i]
        np.add(count, np.bincount(i[_near(at, i, at, j, square)], minlength=len(count)), out=count)
    found[order[rest]] = count[rest] >= min_samples
    return found


def _core_labels(scene: np.ndarray, places: list[np.ndarray], eps: float, square: float) -> np.ndarray:
    """A number of its cluster for each core point."""
    grid = _Grid(scene, places, eps / 3**0.5 * (1 - 1e-9), 2)
    order = np.argsort(grid.key, kind="stable")
    at = [p[order] for p in places]
    keys, begins, cell, n = np.unique(grid.key[order], return_index=True, return_inverse=True, return_counts=True)
    low = np.stack([np.minimum.reduceat(p, begins) for p in at])
    high = np.stack([np.maximum.reduceat(p, begins) for p in at])
    ends = begins + n
    # The first and the last point of each cell along each axis.
    sorts = [np.lexsort((p, cell)) for p in at]
    tips = np.stack([np.stack([s[begins], s[ends - 1]]) for s in sorts])
    label = np.arange(len(keys))

    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Cells of different labels whose boxes may hold points within eps, with room for rounding."""
        for a, b in _around(keys, keys, grid.half):
            apart = label[a] != label[b]
            a, b = a[apart], b[apart]
            gap = sum(np.maximum(0.0, np.maximum(low[k][b] - high[k][a], low[k][a] - high[k][b])) ** 2 for k in range(3))
            close = gap <= square * (1 + 1e-9)
            yield a[close], b[close]

    for a, b in pairs():
        way = (low[:, b] + high[:, b]) - (low[:, a] + high[:, a])
        axis = np.argmax(np.abs(way), 0)
        up = (way[axis, np.arange(len(a))] > 0).astype(np.int64)
        sure = _near(at, tips[axis, up, a], at, tips[axis, 1 - up, b], square)
        label = _merge(label, a[sure], b[sure])
    for a, b in pairs():
        # In parts, so that few points are held for pairs of large cells.
        size = np.cumsum(n[a] + n[b])
        for some in np.split(np.arange(len(a)), np.flatnonzero(np.diff(size // PAIRS)) + 1):
            some = some[label[a[some]] != label[b[some]]]
            if not len(some):
                continue
            # Points of either cell that are within eps of the other's box.
            left, s = _beside(begins, ends, a[some], b[some], at, low, high, square)
            right, t = _beside(begins, ends, b[some], a[some], at, low, high, square)
            first, last = np.searchsorted(right, left, "left"), np.searchsorted(right, left, "right")
            # Those next to the other's box come first, and once they link two cells, the rest is left out.
            for rows in np.split(np.arange(len(left)), np.flatnonzero(np.diff(np.cumsum(last - first) // PAIRS)) + 1):
                pair = some[left[rows]]
                rows = rows[label[a[pair]] != label[b[pair]]]
                for row, j in _runs(first[rows], last[rows]):
                    row = rows[row]
                    met = some[left[row[_near(at, s[row], at, t[j], square)]]]
                    label = _merge(label, a[met], b[met])
    out = np.empty(len(order), np.int64)
    out[order] = label[cell]
    return out


def _beside(begins, ends, own, other, at, low, high, square) -> tuple[np.ndarray, np.ndarray]:
    """(pair, point) of the points of each pair's own cell that are within eps of the other's box, with room for rounding, by pair and distance."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for pair, point in _runs(begins[own], ends[own]):
        box = other[pair]
        gap = sum(np.maximum(0.0, np.maximum(low[k][box] - at[k][point], at[k][point] - high[k][box])) ** 2 for k in range(3))
        keep = gap <= square * (1 + 1e-9)
        found.append((pair[keep], point[keep], gap[keep]))
    pair, point, gap = (np.concatenate(f) for f in zip(*found, strict=True))
    order = np.lexsort((gap, pair))
    return pair[order], point[order]


def clusters(scene: np.ndarray, index: np.ndarray, places: list[np.ndarray], eps: float, square: float, min_samples: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, cluster) of the points in a cluster: the least index of its core points; a border point has the least cluster that reaches it."""
    inner = core(scene, places, eps, square, min_samples)
    own, rest = np.flatnonzero(inner), np.flatnonzero(~inner)
    if not len(own):
        return own, index[own]
    label = _core_labels(scene[own], [p[own] for p in places], eps, square)
    least = np.full(len(own), np.iinfo(index.dtype).max, index.dtype)
    np.minimum.at(least, label, index[own])
    number = least[label]
    grid = _Grid(scene, places, eps * (1 + 1e-9), 1)
    order = own[np.argsort(grid.key[own], kind="stable")]
    rest = rest[np.argsort(grid.key[rest], kind="stable")]
    there = np.empty(len(scene), index.dtype)
    there[own] = number
    border, reached = np.full(len(rest), np.iinfo(index.dtype).max, index.dtype), np.zeros(len(rest), bool)
    for i, j in _around(grid.key[rest], grid.key[order], grid.lines):
        met = _near(places, rest[i], places, order[j], square)
        np.minimum.at(border, i[met], there[order[j[met]]])
        reached[i[met]] = True
    return np.concatenate([own, rest[reached]]), np.concatenate([number, border[reached]])


def arrays(table: pa.Table, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Positions of the points whose coordinates are numbers (others are near none, not even themselves), their scenes as numbers, and coordinates."""
    places = [table.column(a).to_numpy().astype(np.float64, copy=False) for a in ("x", "y", "z")]
    at = np.flatnonzero(np.logical_and.reduce([np.isfinite(p) for p in places]))
    number = np.zeros(len(table), np.int64)
    number[begins[1:]] = 1
    return at, np.cumsum(number)[at], [p[at] for p in places]


def outside_largest(table: pa.Table, begins: np.ndarray, target: np.ndarray, eps: float, square: float, min_samples: int) -> np.ndarray:
    """Which target points are outside the largest cluster of target points of their scene, the lowest-numbered on ties; none, if it has no cluster."""
    at, scene, places = arrays(table, begins)
    own = target[at]
    at, scene, places = at[own], scene[own], [p[own] for p in places]
    position, cluster = clusters(scene, table.column("point_idx").to_numpy()[at], places, eps, square, min_samples)
    order = np.lexsort((cluster, scene[position]))
    position, cluster = position[order], cluster[order]
    home = scene[position]
    first = np.flatnonzero(np.concatenate([[True], (home[1:] != home[:-1]) | (cluster[1:] != cluster[:-1])])) if len(home) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(home)))
    # By scene, the largest first; of equal ones that with the least number.
    ranked = np.lexsort((cluster[first], -n, home[first]))
    scenes, best = np.unique(home[first][ranked], return_index=True)
    kept = np.zeros(len(table), bool)
    largest = np.zeros(len(first), bool)
    largest[ranked[best]] = True
    kept[at[position[np.repeat(largest, n)]]] = True
    clustered = np.zeros(len(begins), bool)
    clustered[scenes] = True
    return target & ~kept & np.repeat(clustered, np.diff(np.append(begins, len(table))))
