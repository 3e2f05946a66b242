"""Parameters of an outlier query."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class LofConfig:
    """k neighbours, the n largest scores, the metric, and whether a point is its own first neighbour.

    Only scores over ``threshold`` are reported. ``cell_points`` is the aim for a grid cell's population.
    """

    k: int = 6
    n: int = 10
    metric: str = "L2"
    include_self: bool = False
    threshold: float = 0.0
    cell_points: int = 12
