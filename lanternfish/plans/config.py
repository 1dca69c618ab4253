"""Parameters of forests and searches, and what their defaults resolve to."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

#: Points a tree covers, found by experiment; the least number of trees; the largest K that is explored by default.
POINTS_PER_TREE, LEAST_TREES, EXPLORED_K = 24913, 50, 32


def auto_trees(n_points: int, n_dims: int, min_leaf: int, max_leaf: int) -> int:
    return max(math.ceil(n_points * n_dims / ((min_leaf + max_leaf) / 2 * POINTS_PER_TREE)), LEAST_TREES)


@dataclass(frozen=True)
class ForestConfig:
    """-1 stands for a default that the data and K decide, see :meth:`resolved`.

    ``min_leaf`` and ``max_leaf`` bound the points of a leaf, ``explore`` is the
    number of rounds in which neighbours of neighbours are tried. ``split`` is
    ``points`` for planes between two points, ``projection`` for random directions.
    """

    seed: int = 0
    n_trees: int = -1
    min_leaf: int = -1
    max_leaf: int = -1
    max_depth: int = 5000
    explore: int = -1
    include_self: bool = True
    ensure_valid: bool = True
    random_motion: bool = False
    motion_force: float = 1.0
    split: str = "points"

    def resolved(self, k: int, n_points: int = 0, n_dims: int = 0) -> ForestConfig:
        if k < 1:
            raise ValueError("k must be at least 1")
        explore = self.explore if self.explore != -1 else int(k <= EXPLORED_K)
        min_leaf = self.min_leaf if self.min_leaf != -1 else k + 1
        if min_leaf < 1:
            raise ValueError("min_leaf must be at least 1")
        max_leaf = self.max_leaf if self.max_leaf != -1 else 2 * min_leaf
        if max_leaf < 2 * min_leaf:
            raise ValueError("max_leaf must be at least twice min_leaf")
        n_trees = self.n_trees if self.n_trees != -1 else auto_trees(n_points, n_dims, min_leaf, max_leaf)
        if n_trees < 1 or explore < 0 or self.max_depth < 1:
            raise ValueError("n_trees and max_depth must be positive, explore not negative")
        if self.split not in ("points", "projection"):
            raise ValueError("split must be points or projection")
        return replace(self, n_trees=n_trees, min_leaf=min_leaf, max_leaf=max_leaf, explore=explore)
