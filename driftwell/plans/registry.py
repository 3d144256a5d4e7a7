"""Detectors by name, each a function of a domain and resample weights."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame

from driftwell.operators.columns import drifted_share
from driftwell.operators.detectors import weight_keys
from driftwell.operators.kernel_tests import lsdd_scores, mmd_scores
from driftwell.operators.neighbours import neighbour_kl_scores
from driftwell.operators.numbering import sample_rows
from driftwell.operators.projected import distance_scores
from driftwell.plans.domains import Domain
from driftwell.session import cut_lineage

Detector = Callable[..., DataFrame]

_DETECTORS: dict[str, Detector] = {}


def register_detector(name: str) -> Callable[[Detector], Detector]:
    """Decorator; the function takes (domain, weights, **parameters) and returns
    (keys..., score)."""

    def add(fn: Detector) -> Detector:
        _DETECTORS[name] = fn
        return fn

    return add


def available_detectors() -> list[str]:
    return list(_DETECTORS)


def get_detector(name: str, **parameters) -> Callable[[Domain, DataFrame], DataFrame]:
    """A detector with its parameters bound."""
    if name not in _DETECTORS:
        raise ValueError(f"Unknown detector '{name}'. Registered: {available_detectors()}")
    fn = _DETECTORS[name]
    inspect.signature(fn).bind(None, None, **parameters)
    return lambda domain, weights: fn(domain, weights, **parameters)


def detector_from_settings(name: str, settings: dict) -> Callable[[Domain, DataFrame], DataFrame]:
    """Like ``get_detector``, but settings the detector does not take are dropped."""
    if name not in _DETECTORS:
        raise ValueError(f"Unknown detector '{name}'. Registered: {available_detectors()}")
    known = list(inspect.signature(_DETECTORS[name]).parameters)[2:]
    return get_detector(name, **{k: v for k, v in settings.items() if k in known})


def enabled_detectors(settings: dict[str, dict] | None) -> list[str]:
    """Names not switched off by ``enabled: False``; all of them without settings."""
    if not settings:
        return available_detectors()
    return [n for n, s in settings.items() if s.get("enabled", True) and n in _DETECTORS]


def kernel_reference(reference: DataFrame, cap: int | None, seed: int) -> DataFrame:
    """The reference of the kernel tests: all of it, or ``cap`` sampled rows."""
    if cap is None:
        return reference
    return cut_lineage(sample_rows(reference, "row_id", cap, seed=seed, tag="kernel"))


@register_detector("mmd")
def mmd(domain: Domain, weights: DataFrame, *, n_permutations: int = 100, reference_cap: int | None = None, seed: int = 42):
    reference, pool = domain.numeric
    scored = mmd_scores(
        kernel_reference(reference, reference_cap, seed), pool, weights, n_permutations=n_permutations, seed=seed
    )
    return scored.select(*weight_keys(weights), "score")


@register_detector("lsdd")
def lsdd(
    domain: Domain,
    weights: DataFrame,
    *,
    n_permutations: int = 100,
    n_centres: int = 100,
    reference_cap: int | None = None,
    seed: int = 42,
):
    reference, pool = domain.numeric
    scored = lsdd_scores(
        kernel_reference(reference, reference_cap, seed),
        pool,
        weights,
        n_permutations=n_permutations,
        n_centres=n_centres,
        seed=seed,
    )
    return scored.select(*weight_keys(weights), "score")


@register_detector("kl")
def kl(domain: Domain, weights: DataFrame, *, n_neighbors: int = 5):
    reference, pool = domain.reduced
    return neighbour_kl_scores(reference, pool, weights, n_neighbors=n_neighbors)


@register_detector("distance")
def distance(domain: Domain, weights: DataFrame, *, n_components: int | None | str = "domain"):
    """``n_components``: as the domain says, a number, or None for the full width."""
    reference, pool = domain.numeric
    n_components = domain.n_components if n_components == "domain" else n_components
    return distance_scores(reference, pool, weights, n_components=n_components)


@register_detector("columns")
def columns(domain: Domain, weights: DataFrame, *, family: str = "distance", p_level: float = 0.05, distance_level: float = 0.1):
    reference, pool = domain.columns
    return drifted_share(reference, pool, weights, family=family, p_level=p_level, distance_level=distance_level)
