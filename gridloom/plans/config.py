"""Parameters of a grid and of what is built on it."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class GridConfig:
    """``parts`` strips in each dimension but the last, ``models`` columns, ``sigma`` knots each, pages of ``page_size`` points.

    Points live in ``[0, hi]`` in every dimension: the first strip starts at 0, so rescale other domains first.
    """

    dims: int = 2
    parts: int = 50
    models: int = 64
    sigma: int = 50
    page_size: int = 100
    eta: float = 0.01
    hi: float = 10000.0

    def __post_init__(self):
        if self.dims < 2:
            raise ValueError("a grid needs two dimensions or more")

    @property
    def axes(self) -> list[str]:
        return axes(self.dims)


def axes(dims: int) -> list[str]:
    return [f"x{k + 1}" for k in range(dims)]
