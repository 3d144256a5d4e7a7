"""Sums of distances to whole cells of rows: a cell far away is replaced by few of its rows.

Seen from outside a ball around a cell, the distances to its rows are smooth and have a small numerical rank. ``stand_in``
picks rows of the cell and gives them weights so that the sum of distances to the cell is kept, to ``PRECISION`` of
the table's spread a row, at points all around the ball from ``REACH`` radii beyond it on; other points that took no part in the choice check it.
A cell whose rank is too large has no stand-in and meets its targets row by row. Nothing is assumed of the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from driftwell.functions.distances import distances

#: Distance from its ball, in radii, from which a cell's stand-in serves.
REACH = 8.0
#: Error of a distance as a part of the spread, a few times what a double's rounding leaves of a squared distance.
PRECISION = 1e-12
#: Rows of a stand-in, as a number and as a part of the rows it stands for.
MOST_KEPT, KEPT_SHARE = 192, 0.7
#: Points around a cell: those that a stand-in is made with, those that check it, and how much more error they may show.
POINTS, CHECKS, CHECKED_ERROR = 2 * MOST_KEPT, 64, 100.0
#: Distances of the points in reaches, in turn.
SHELLS = np.array([1.0, 1.0, 1.3, 1.8, 3.0, 6.0, 12.0, 40.0])


@dataclass
class Cell:
    """A ball around the rows of a cell and its stand-in (rows and their weights), if it has one."""

    centre: np.ndarray
    radius: float
    x: np.ndarray | None
    n: np.ndarray | None


@dataclass
class Tree:
    """A perfect binary tree of cuts: a row goes right where its product with the node's axis lies above the cut."""

    axes: np.ndarray
    cuts: np.ndarray
    depth: int

    @classmethod
    def of(cls, x: np.ndarray, depth: int) -> Tree:
        """Cuts at medians along the direction in which the rows of a node spread most."""
        n_nodes = 2**depth - 1
        axes, cuts = np.zeros((n_nodes, x.shape[1])), np.zeros(n_nodes)
        parts = [np.arange(len(x))]
        for node in range(n_nodes):
            rows = x[parts[node]]
            if len(rows) > 1:
                axes[node] = np.linalg.eigh(_covariance(rows))[1][:, -1]
                at = rows @ axes[node]
                cuts[node] = np.median(at)
                right = at > cuts[node]
            else:
                right = np.zeros(len(rows), bool)
            parts += [parts[node][~right], parts[node][right]]
        return cls(axes, cuts, depth)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (np.einsum("ij,ij->i", x, self.axes[node]) > self.cuts[node])
        return (node - (2**self.depth - 1)).astype(np.int32)


def _covariance(x: np.ndarray) -> np.ndarray:
    centred = x - x.mean(axis=0)
    return centred.T @ centred / len(x)


def _around(x: np.ndarray, centre: np.ndarray, radius: float, count: int, seed: int) -> np.ndarray:
    """Points on shells around a ball; every second direction leans to those in which the rows spread."""
    rng = np.random.default_rng(seed)
    u = rng.normal(size=(count, len(centre)))
    values, axes = np.linalg.eigh(_covariance(x))
    lean = np.sqrt(np.maximum(values, 0.0))
    u[1::2] = (u[1::2] * (lean / max(lean.max(), 1e-300)) ** rng.choice([0.5, 1.0], size=(len(u[1::2]), 1))) @ axes.T
    u /= np.maximum(np.sqrt(np.einsum("ij,ij->i", u, u)), 1e-300)[:, None]
    return centre + u * (radius * (1.0 + REACH * SHELLS[np.arange(count) // 2 % len(SHELLS)]))[:, None]


def _pick(a: np.ndarray, n: np.ndarray, tolerance: float, most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(columns, weights): columns of ``a`` whose sum by their weights is that of all columns by ``n``, chosen by pivoted
    orthogonalisation until no column keeps more than the tolerance; None if more than ``most`` are needed."""
    a = a.copy()
    norms = np.einsum("ij,ij->j", a, a)
    picked: list[int] = []
    rows = np.empty((most, a.shape[1]))
    while len(picked) < min(a.shape):
        j = int(norms.argmax())
        length = float(np.sqrt(a[:, j] @ a[:, j]))
        if length <= tolerance:
            break
        if len(picked) == most:
            return None
        q = a[:, j] / length
        r = np.matmul(q, a, out=rows[len(picked)])
        a -= np.multiply.outer(q, r)
        picked.append(j)
        # differences lose their digits in the end: the norms are taken anew from time to time
        norms = np.einsum("ij,ij->j", a, a) if len(picked) % 16 == 0 else norms - r * r
        norms[picked] = 0.0
    r = rows[: len(picked)]
    return np.array(picked), np.linalg.solve(r[:, picked], r @ n)


def stand_in(x: np.ndarray, n: np.ndarray, centre: np.ndarray, radius: float, tolerance: float) -> tuple[np.ndarray, np.ndarray] | None:
    """(rows, weights) in place of rows ``x`` with ``n`` copies each, within a ball."""
    if len(x) <= 2:
        return x, n
    points = _around(x, centre, radius, POINTS, 1)
    kept = _pick(distances(points, x), n, tolerance * np.sqrt(POINTS), min(MOST_KEPT, int(KEPT_SHARE * len(x))))
    if kept is None:
        return None
    at, weights = kept
    checks = _around(x, centre, radius, CHECKS, 2)
    off = np.abs(distances(checks, x) @ n - distances(checks, x[at]) @ weights).max()
    return (x[at], weights) if off <= CHECKED_ERROR * tolerance * np.abs(n).sum() else None


def leaf_cell(x: np.ndarray, n: np.ndarray, tolerance: float) -> Cell:
    """The cell of the rows of a leaf."""
    centre = (x.min(axis=0) + x.max(axis=0)) / 2
    radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1).max()))
    if radius == 0.0:
        return Cell(centre, 0.0, x[:1], n.sum(keepdims=True))
    found = stand_in(x, n, centre, radius, tolerance)
    return Cell(centre, radius, *(found or (None, None)))


def joined_cell(a: Cell | None, b: Cell | None, tolerance: float) -> Cell | None:
    """The cell of two, made of their stand-ins, whose balls lie inside its own."""
    if a is None or b is None:
        return b if a is None else a
    between = b.centre - a.centre
    apart = float(np.sqrt(between @ between))
    radius = max((a.radius + b.radius + apart) / 2, a.radius, b.radius)
    # the smallest ball around both
    centre = a.centre + between * ((radius - a.radius) / apart if apart > 0 else 0.0)
    if a.x is None or b.x is None:
        return Cell(centre, radius, None, None)
    x, n = np.concatenate([a.x, b.x]), np.concatenate([a.n, b.n])
    found = stand_in(x, n, centre, radius, tolerance) if radius > 0.0 else (x[:1], n.sum(keepdims=True))
    return Cell(centre, radius, *(found or (None, None)))


def joined_levels(cells: list[Cell | None], tolerance: float, levels: int) -> list[list[Cell | None]]:
    """``levels`` levels of a binary tree above ``cells``, the lowest first."""
    out = []
    for _ in range(levels):
        cells = [joined_cell(cells[i], cells[i + 1], tolerance) for i in range(0, len(cells), 2)]
        out.append(cells)
    return out


def meetings(levels: list[list[Cell | None]], centres: np.ndarray, radii: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each target ball the cells whose stand-ins serve it, numbered level by level from the leaves on, and the leaves
    that it meets row by row. ``levels`` begins with the leaves; a ball with a negative radius meets nothing."""
    first = np.cumsum([0] + [len(level) for level in levels])
    at = np.flatnonzero(radii >= 0)
    node = np.zeros(len(at), np.int64)
    far, near = [], []
    for number in range(len(levels) - 1, -1, -1):
        level = levels[number]
        held = np.array([c is not None for c in level])
        at, node = at[held[node]], node[held[node]]
        middle = np.array([c.centre if c is not None else np.zeros(centres.shape[1]) for c in level])
        radius = np.array([c.radius if c is not None else 0.0 for c in level])
        serves = np.array([c is not None and c.x is not None for c in level])
        gap = np.sqrt(((middle[node] - centres[at]) ** 2).sum(axis=1)) - radii[at] - radius[node]
        served = serves[node] & (gap >= REACH * radius[node])
        far.append((at[served], node[served] + first[number]))
        at, node = at[~served], node[~served]
        if number == 0:
            near.append((at, node))
        else:
            at, node = np.repeat(at, 2), np.stack([2 * node, 2 * node + 1], axis=1).ravel()
    return _by_target(far, len(radii)), _by_target(near, len(radii))


def _by_target(pairs: list[tuple[np.ndarray, np.ndarray]], n: int) -> list[np.ndarray]:
    at, what = (np.concatenate(part) for part in zip(*pairs, strict=True))
    order = np.argsort(at, kind="stable")
    return np.split(what[order], np.cumsum(np.bincount(at, minlength=n))[:-1])
