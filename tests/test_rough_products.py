"""The single-precision filter of nearest rows never drops one, and its rounding stays within the bound it gives."""

from __future__ import annotations

import numpy as np
import pytest

from driftwell.functions.distances import RoughProducts, nearest


def squared(a, b):
    return ((a[:, None] - b[None]) ** 2).sum(-1)


@pytest.mark.parametrize(("width", "size"), [(2, 1.0), (30, 100.0), (64, 1e-6), (5, 1e12), (3, 1e-14), (3, 1e18)])
def test_rounding_is_bounded(width, size):
    rng = np.random.default_rng(width)
    a, b = rng.normal(size=(40, width)) * size + size, rng.normal(size=(300, width)) * size
    d2, rounding = RoughProducts(b).of(a, b)
    assert (np.abs(d2 - squared(a, b)) <= rounding[:, None]).all()
    assert d2.dtype == (np.float32 if 1e-9 < size < 1e14 else np.float64)


def test_close_rows_far_from_the_centre():
    """Distances a thousand times below what single precision tells apart at that distance from the tile's centre."""
    rng = np.random.default_rng(1)
    b = np.concatenate([rng.normal(size=(2500, 3)) * 1e3, 1e5 + rng.normal(size=(2500, 3)) * 1e-4])
    b = b[rng.permutation(len(b))]
    a = np.concatenate([b[:100], 1e5 + rng.normal(size=(100, 3)) * 1e-4])
    at, d = nearest(a, b, 7)
    full = squared(a, b)
    assert d == pytest.approx(np.sqrt(np.sort(full, 1)[:, :7]), rel=1e-9, abs=1e-12)
    assert np.take_along_axis(full, at, 1) == pytest.approx(d**2, rel=1e-9, abs=1e-20)


def test_no_number_is_farthest():
    rng = np.random.default_rng(2)
    b = rng.normal(size=(5000, 2))
    b[4000] = np.nan
    _, d = nearest(rng.normal(size=(10, 2)), b, 3)
    assert np.isfinite(d).all()


@pytest.mark.parametrize("width", [3, 70])
def test_sums_over_tiles_that_are_made_once(width, monkeypatch):
    """Rows of several tiles on both sides; a tile of the right side is prepared once, whatever the number of left tiles."""
    from driftwell.functions import distances

    rng = np.random.default_rng(width)
    a, b, copies = rng.normal(size=(300, width)), rng.normal(size=(4500, width)), rng.integers(1, 4, 4500).astype(float)
    made = []
    monkeypatch.setattr(distances, "Products", lambda tile, of=distances.Products: made.append(len(tile)) or of(tile))
    assert distances.distance_sums(a, b, copies) == pytest.approx(np.sqrt(squared(a, b)) @ copies, rel=1e-12)
    assert made == [2048, 2048, 404]
