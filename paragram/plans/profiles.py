"""Constants of the tuned pipelines, one frozen profile each."""

from __future__ import annotations

from dataclasses import dataclass

from paragram.functions import lang as L


@dataclass(frozen=True)
class Expansion:
    """Sentence expansion: gates, scores and order of results."""

    name: str
    percentiles: tuple[float, float] | None
    noise: tuple[float, float, float]  # least and greatest character ratio, similarity
    common: tuple[str, ...] = L.ENGLISH_35
    english: tuple[int, float, int] = (3, 0.80, 2)  # hits for the third point, alpha ratio, its points
    hyphens: tuple[int, int, float] = (2, 2, 0.30)  # tokens, points, share
    centre: str = "ratio_med"
    near: tuple[tuple[float, int], ...] = ((0.5, 3), (1.0, 1))
    cut: int = 15
    least: tuple[int, int] = (6, 5)
    whole: bool = True
    at_least: int = 2


V4 = Expansion("v4", None, (0.2, 3.5, 0.85))
V41 = Expansion("v41", (0.05, 0.95), (0.25, 3.2, 0.80), english=(3, 0.75, 1), hyphens=(1, 1, 0.20), centre="ratio_avg", near=((0.75, 2), (1.25, 1)), cut=12, least=(5, 0))
V42 = Expansion("v42", (0.15, 0.85), (0.25, 3.2, 0.80))
V51 = Expansion("v51", (0.15, 0.85), (0.25, 3.2, 0.80), common=L.ENGLISH_44, english=(4, 0.78, 2), hyphens=(2, 2, 0.25), near=((0.6, 3), (1.0, 1)), cut=16, least=(5, 4), whole=False, at_least=1)
EXPANSIONS = {p.name: p for p in (V4, V41, V42, V51)}


@dataclass(frozen=True)
class Surface:
    """Detection of lines in the source language, and scoring of found pairs."""

    name: str
    percentiles: tuple[float, float]
    clamp: bool
    longest: int | None
    hyphen_share: float | None  # None: any hyphen
    coverage: tuple[float, ...]
    starters: int
    frequent: int
    frequent_ahead: int
    variants: bool
    english_penalty: bool
    window: int
    accept: float


V3 = Surface("v3", (0.05, 0.95), True, None, None, (0.5,), 50, 500, 0, False, False, 4, 0.72)
V31 = Surface("v31", (0.03, 0.97), False, 40, None, (0.40,), 75, 750, 3, False, False, 4, 0.58)
V32 = Surface("v32", (0.02, 0.98), False, 45, 0.20, (0.35, 0.55), 100, 1000, 4, True, True, 6, 0.40)
SURFACES = {p.name: p for p in (V3, V31, V32)}
