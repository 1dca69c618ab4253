"""Trees of hyperplanes in a task: how a node is parted, and how points come to its leaves.

Everything here is plain arithmetic over a node's members, which decide it
alone, however rows are dealt and wherever the node is grown.
"""

from __future__ import annotations

import hashlib
import heapq
from dataclasses import dataclass

import numpy as np

#: After so many levels that end a path alike, or so many in a row whose anchors are the same point, a node that
#: its plane doesn't part is looked at for copies: where more than a leaf holds are of one point, no plane ever parts
#: them, and it is halved by hash. All other nodes get new anchors a level, until a plane parts them.
STUCK, SAME = 8, 2
#: Added to the levels with equal anchors below a halved node, where all that a plane doesn't part for so long is halved.
HALVED = 1 << 20
#: After so many levels in a row that didn't part it, a node of a cell is tried with all pairs of its distinct points, if these are so few.
TRIED, DISTINCT = 64, 256


@dataclass(slots=True)
class Node:
    """A parted node: its plane, the members on either side, where a side was merged the other's letter, and which sides are leaves."""

    normal: np.ndarray
    offset: float
    n_left: int
    n_right: int
    merged: str | None
    left_leaf: bool
    right_leaf: bool
    halved: bool
    same: int

    def leaf(self, way: str) -> bool:
        return self.left_leaf if way == "L" else self.right_leaf


def key(seed: int, *parts) -> bytes:
    """The hash by which samples are ordered."""
    return hashlib.md5(":".join(map(str, (seed, *parts))).encode()).digest()


def least_two(seed: int, tree: int, path: str, ids: np.ndarray) -> list[tuple[bytes, int, int]]:
    """Key, id and place of the two members with the least keys."""
    base, found = hashlib.md5(f"{seed}:{tree}:{path}:".encode()), []
    for place, i in enumerate(ids.tolist()):
        h = base.copy()
        h.update(b"%d" % i)
        found.append((h.digest(), i, place))
    return heapq.nsmallest(2, found)


def halves(seed: int, path: str, ids: np.ndarray) -> np.ndarray:
    """Whether each member is on the left when a hash halves the node."""
    return np.array([key(seed, "half", path, i)[0] < 128 for i in ids.tolist()], bool)


def dots(x: np.ndarray, normal: np.ndarray) -> np.ndarray:
    """A row's product doesn't depend on the rows beside it."""
    return np.einsum("ij,j->i", x, normal)


def halfway(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """The plane halfway between two anchors."""
    normal = a - b
    return normal, float(dots((normal * ((a + b) / 2))[None, :], np.ones(len(a)))[0])


def direction(seed: int, tree: int, path: str, d: int) -> np.ndarray:
    """A direction with components from -1 to 1: hashes as fractions of their first 13 hex digits."""
    return np.array([2 * (int(key(seed, "direction", tree, path, i).hex()[:13], 16) / 16**13) - 1 for i in range(d)])


def stuck(path: str, same: int) -> bool:
    return same % HALVED >= SAME or (len(path) > STUCK and path[-STUCK:] in ("L" * STUCK, "R" * STUCK))


def equal_anchors(normal: np.ndarray, same: int) -> int:
    """Levels in a row, with this one, whose anchors are the same point."""
    return same + 1 if not normal.any() else same - same % HALVED


def doubtful(path: str, normal: np.ndarray, sides: tuple[int, int], same: int, least: int, most: int) -> bool:
    """Whether a node, whose plane doesn't part it, is to be looked at for copies."""
    return min(sides) < least and sum(sides) > most and stuck(path, equal_anchors(normal, same))


def point_keys(x: np.ndarray) -> np.ndarray:
    """The bytes of each point, which are equal for copies."""
    x = np.ascontiguousarray(x + 0.0)
    return x.view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel() if x.shape[1] else np.zeros(len(x), "V1")


def copied(x: np.ndarray, most: int) -> bool:
    """Whether one point has more copies than a leaf holds."""
    return int(np.unique(point_keys(x), return_counts=True)[1].max()) > most


def unpartable(x: np.ndarray, least: int) -> bool:
    """Whether no plane between two of the points leaves ``least`` on either side. Of many distinct points it is taken that one does."""
    first = np.sort(np.unique(point_keys(x), return_index=True)[1])
    if len(first) > DISTINCT:
        return False
    for a in first.tolist():
        for b in first.tolist():
            normal, offset = halfway(x[a], x[b])
            below = int((dots(x, normal) < offset).sum())
            if min(below, len(x) - below) >= least:
                return False
    return True


def decided(path: str, depth: int, normal: np.ndarray, offset: float, sides: tuple[int, int], halved: tuple[int, int] | None, same: int, least: int, most: int, max_depth: int) -> Node:
    """A node by the members on either side of its plane, or of a halving by hash."""
    same, half = equal_anchors(normal, same), halved is not None
    if half and same < HALVED:
        same += HALVED
    n_left, n_right = halved if half else sides
    merged = ("L" if n_left >= n_right else "R") if min(n_left, n_right) < least and not half else None
    whole, last = n_left + n_right <= most, depth + 1 >= max_depth
    left, right = (last or (whole if merged else n <= most - 2) for n in (n_left, n_right))
    return Node(normal, offset, n_left, n_right, merged, left, right, half, same)


def ways(node: Node, path: str, seed: int, ids: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether each point goes left: where it isn't below the plane, or as the node says."""
    if node.merged:
        return np.full(len(ids), node.merged == "L")
    if node.halved:
        return halves(seed, path, ids)
    return ~(dots(x, node.normal) < node.offset)


def grown(seed: int, tree: int, root: str, depth: int, same: int, ids: np.ndarray, x: np.ndarray, least: int, most: int, max_depth: int, split: str) -> tuple[list, list]:
    """Nodes (path, depth, node) and leaves (path, depth, places) of the subtree of a node over its members, which lie here."""
    nodes, leaves = [], []
    stack = [(root, depth, same, 0, np.arange(len(ids)))]
    while stack:
        path, depth, same, failed, at = stack.pop()
        own, points = ids[at], x[at]
        if split == "projection":
            normal = direction(seed, tree, path, x.shape[1])
            along = dots(points, normal)
            offset = float(np.partition(along, len(along) // 2)[len(along) // 2])
        else:
            two = least_two(seed, tree, path, own)
            normal, offset = halfway(points[two[0][2]], points[two[-1][2]])
        left = ~(dots(points, normal) < offset)
        sides = int(left.sum()), int((~left).sum())
        failed = failed + 1 if min(sides) < least else 0
        half = None
        if doubtful(path, normal, sides, same, least, most) and (same >= HALVED or copied(points, most)) or failed and sum(sides) > most and failed % TRIED == 0 and split == "points" and unpartable(points, least):
            left = halves(seed, path, own)
            half = int(left.sum()), int((~left).sum())
        node = decided(path, depth, normal, offset, sides, half, same, least, most, max_depth)
        if node.merged:
            left[:] = node.merged == "L"
        nodes.append((path, depth, node))
        for way, chosen in (("R", ~left), ("L", left)):
            if chosen.any():
                (leaves if node.leaf(way) else stack).append((path + way, depth + 1, at[chosen]) if node.leaf(way) else (path + way, depth + 1, node.same, failed, at[chosen]))
    return nodes, leaves


def routed(nodes: dict[str, Node], root: str, seed: int, ids: np.ndarray, x: np.ndarray) -> list[tuple[str, bool, np.ndarray]]:
    """Paths to which points come from ``root``, whether they are leaves or have no node here, and the places of the points."""
    found, stack = [], [(root, np.arange(len(ids)))]
    while stack:
        path, at = stack.pop()
        node = nodes.get(path)
        if node is None:
            found.append((path, False, at))
            continue
        left = ways(node, path, seed, ids[at], x[at])
        for way, chosen in (("R", ~left), ("L", left)):
            if chosen.any():
                if node.leaf(way):
                    found.append((path + way, True, at[chosen]))
                else:
                    stack.append((path + way, at[chosen]))
    return found
