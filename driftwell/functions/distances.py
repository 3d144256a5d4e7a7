"""Pairwise distances of two row blocks inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

ROUNDING_RISK = 1e-5
#: The same where distances are only added up: a closer pair is off by 1e-11 of the rows' length at most.
SUM_RISK = 1e-9
#: Far above the rounding of a product, as a part of its scale; in single precision for each term of it, and the scales for which that holds.
SLACK = 1e-12
SINGLE_SLACK, SINGLE_SCALES = 2.0**-21, (1e-20, 1e30)
#: Rows and columns of a part of a distance matrix that stays in cache.
TILE_ROWS, TILE_COLUMNS = 128, 2048


class Products:
    """Squared distances to the rows of ``b`` in product form; what concerns these rows alone is made once."""

    def __init__(self, b: np.ndarray):
        self.centre = b.mean(axis=0) if len(b) else 0.0
        bc = b - self.centre
        nb = np.einsum("ij,ij->i", bc, bc)
        self.largest, self.right = nb.max(initial=0.0), np.vstack([-2.0 * bc.T, np.ones(len(b)), nb])

    def of(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The squared distances, and for each row of ``a`` the scale that their rounding grows with."""
        ac = a - self.centre
        na = np.einsum("ij,ij->i", ac, ac)
        return np.column_stack([ac, na, np.ones(len(a))]) @ self.right, na + self.largest


class RoughProducts:
    """Squared distances to the rows of a tile in product form, in single precision where the scale allows, and for
    each row asked a bound of their rounding. What concerns the tile alone is made once."""

    def __init__(self, b: np.ndarray):
        self.centre = b.mean(axis=0)
        bc = b - self.centre
        nb = np.einsum("ij,ij->i", bc, bc)
        self.largest = nb.max()
        with np.errstate(over="ignore", invalid="ignore"):
            self.single = np.vstack([-2.0 * bc.T, np.ones(len(b)), nb]).astype(np.float32)

    def of(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ac = a - self.centre
        na = np.einsum("ij,ij->i", ac, ac)
        scale = na + self.largest
        if not (SINGLE_SCALES[0] < scale.min() and scale.max() < SINGLE_SCALES[1]):
            d2, scale = Products(b).of(a)
            return d2, SLACK * scale
        d2 = np.column_stack([ac, na, np.ones(len(a))]).astype(np.float32) @ self.single
        return d2, SINGLE_SLACK * (a.shape[1] + 8) * scale


def by_differences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows that stand side by side."""
    diff = a - b
    return np.einsum("ij,ij->i", diff, diff)


def squared_distances(a: np.ndarray, b: np.ndarray, risk: float = ROUNDING_RISK, made: Products | None = None) -> np.ndarray:
    """All squared Euclidean distances of the rows of ``a`` and ``b``.

    The product form is fast but loses digits for rows that lie close together
    compared with their length; those pairs are computed again by differences,
    so equal rows are at distance exactly zero. ``made``: the products of ``b``, if the caller has them.
    """
    d2, scale = (made or Products(b)).of(a)
    flat = d2.reshape(-1)
    close = np.flatnonzero((d2 <= (risk * scale)[:, None]).reshape(-1))
    for start in range(0, len(close), 65536):
        at = close[start : start + 65536]
        flat[at] = by_differences(a[at // len(b)], b[at % len(b)])
    return d2  # what is left lies above the limit, so it is not negative


def distances(a: np.ndarray, b: np.ndarray, risk: float = ROUNDING_RISK) -> np.ndarray:
    d2 = squared_distances(a, b, risk)
    return np.sqrt(d2, out=d2)


def tiles(n_left: int, n_right: int) -> Iterator[tuple[slice, slice]]:
    """Parts of a matrix that stay in a processor's cache, all right parts of some left rows one after another."""
    for i in range(0, n_left, TILE_ROWS):
        for j in range(0, n_right, TILE_COLUMNS):
            yield slice(i, i + TILE_ROWS), slice(j, j + TILE_COLUMNS)


def distance_sums(a: np.ndarray, b: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """For each row of ``a`` the sum of its distances to the rows of ``b``, each counted ``copies`` times."""
    out = np.zeros(len(a))
    for start in range(0, len(b), TILE_COLUMNS):
        j = slice(start, start + TILE_COLUMNS)
        made = Products(b[j])
        for at in range(0, len(a), TILE_ROWS):
            i = slice(at, at + TILE_ROWS)
            d2 = squared_distances(a[i], b[j], SUM_RISK, made)
            out[i] += np.sqrt(d2, out=d2) @ copies[j]
    return out


def nearest(a: np.ndarray, b: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, distances) of the ``length`` nearest rows of ``b`` (all, if fewer) for each row of ``a``; NaN is
    farthest. After the first tile only what lies below a row's last distance so far is sorted."""
    top = min(length, len(b))
    at, best = np.zeros((len(a), top), np.int64), np.full((len(a), top), np.nan)
    rough: dict[int, RoughProducts] = {}
    for i, j in tiles(len(a), len(b)):
        if j.start < top:  # lists are not full yet
            d2 = squared_distances(a[i], b[j])
            joined = np.concatenate([best[i, : j.start], d2], axis=1)
            places = np.concatenate([at[i, : j.start], np.broadcast_to(np.arange(j.start, j.start + d2.shape[1]), d2.shape)], axis=1)
            pick = _smallest(joined, min(top, joined.shape[1]))
            width = pick.shape[1]
            best[i, :width], at[i, :width] = np.take_along_axis(joined, pick, 1), np.take_along_axis(places, pick, 1)
            continue
        if j.start not in rough:
            rough[j.start] = RoughProducts(b[j])
        d2, rounding = rough[j.start].of(a[i], b[j])
        last = best[i, -1]
        last = np.where(np.isnan(last), np.inf, last)
        found = np.flatnonzero((d2 < (last + rounding).astype(d2.dtype)[:, None]).reshape(-1))
        row, column = found // d2.shape[1], found % d2.shape[1]
        d = by_differences(a[i][row], b[j][column])
        nearer = np.flatnonzero(d < last[row])
        if not len(nearer):
            continue
        row, column, d = row[nearer], column[nearer], d[nearer]
        rows = np.unique(row)
        owner = np.concatenate([np.repeat(rows, top), row])
        d, place = np.concatenate([best[i][rows].ravel(), d]), np.concatenate([at[i][rows].ravel(), column + j.start])
        order = np.lexsort((d, owner))
        kept = order[np.searchsorted(owner[order], rows)[:, None] + np.arange(top)]
        best[i.start + rows], at[i.start + rows] = d[kept], place[kept]
    return at, np.sqrt(best, out=best)


def _smallest(d: np.ndarray, width: int) -> np.ndarray:
    """Columns of the ``width`` smallest values of each row, in rising order."""
    if not width:
        return np.zeros((len(d), 0), np.int64)
    pick = np.argpartition(d, width - 1, axis=1)[:, :width]
    order = np.argsort(np.take_along_axis(d, pick, 1), axis=1, kind="stable")
    return np.take_along_axis(pick, order, 1)
