"""Kernels on the points, boxes and masks of one group, which is by definition worked on in order or as a whole.

Each kernel is a plain numpy function; `per_group` runs one on every group through Arrow. Groups are instances, frames or
scans: their size is bounded by one recording and does not grow with the number of recordings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def per_group(df: DataFrame, keys: Sequence[str], kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    return df.groupBy(*keys).applyInPandas(kernel, schema)


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def nearest_distances(a: np.ndarray, b: np.ndarray, k: int = 1, block: int = 2048) -> np.ndarray:
    """Distances of each point of a to its k nearest of b, ascending."""
    out = [np.sort(np.partition(squared_distances(a[i : i + block], b), min(k, len(b)) - 1, axis=1)[:, :k], axis=1) for i in range(0, len(a), block)]
    return np.sqrt(np.concatenate(out)) if out else np.zeros((0, k))


def overlap_score(a: np.ndarray, b: np.ndarray, radius: float) -> tuple[float, float, float]:
    """(share of the smaller cloud that is matched, matched share of all points, mean distance of a to b)."""
    if not len(a) or not len(b):
        return 0.0, 0.0, float("inf")
    to_b, to_a = nearest_distances(a, b)[:, 0], nearest_distances(b, a)[:, 0]
    n_a, n_b = int((to_b < radius).sum()), int((to_a < radius).sum())
    return max(n_a, n_b) / min(len(a), len(b)) if max(n_a, n_b) <= min(len(a), len(b)) else 1.0, n_a / (len(a) + len(b) - n_a), float(to_b.mean())


def match_score(ratio: float, similarity: float, iou: float, distance: float) -> float:
    """0.3 ratio + 0.1 similarity + 0.3 overlap + 0.3 nearness; nearness is 0 for a distance up to 1e-3."""
    return 0.3 * ratio + 0.1 * similarity + 0.3 * iou + 0.3 * (np.exp(-2 * distance) if distance > 1e-3 else 0.0)


def accepted(ratio: float, iou: float, r: float = 0.1) -> bool:
    return ratio > min(0.8, 2 * r) or iou > r


def statistical_inliers(points: np.ndarray, k: int = 50, sigma: float = 1.0) -> np.ndarray:
    """Mask of the points whose mean distance to their k nearest is at most mean + sigma deviations."""
    if len(points) <= 2:
        return np.ones(len(points), bool)
    k = min(k, len(points) - 1)
    d = nearest_distances(points, points, k + 1)[:, 1:].mean(1)
    return d <= d.mean() + sigma * d.std(ddof=1)


def principal_box(points: np.ndarray, least: float = 1e-4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(center, size, rotation rows) of the box along the principal axes; along the axes of space for fewer than 4 points."""
    if len(points) < 4:
        low, high = points.min(0), points.max(0)
        return (low + high) / 2, np.maximum(high - low, least), np.eye(3)
    mean = points.mean(0)
    _, axes = np.linalg.eigh(np.cov((points - mean).T))
    axes = axes[:, ::-1]
    for i in range(2):  # the largest part of an axis is positive, and the axes are right-handed
        axes[:, i] *= np.sign(axes[np.abs(axes[:, i]).argmax(), i]) or 1
    axes[:, 2] = np.cross(axes[:, 0], axes[:, 1])
    own = (points - mean) @ axes
    low, high = own.min(0), own.max(0)
    return mean + axes @ ((low + high) / 2), np.maximum(high - low, least), axes


def rigid_fit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """4 x 4 transform that brings the points a nearest to the points b, by singular values."""
    ca, cb = a.mean(0), b.mean(0)
    u, _, vt = np.linalg.svd((a - ca).T @ (b - cb))
    flip = np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T)) or 1])
    t = np.eye(4)
    t[:3, :3] = vt.T @ flip @ u.T
    t[:3, 3] = cb - t[:3, :3] @ ca
    return t


def move(t: np.ndarray, points: np.ndarray) -> np.ndarray:
    return points @ t[:3, :3].T + t[:3, 3]


def ransac_fit(a: np.ndarray, b: np.ndarray, limit: float = 0.3, rounds: int = 1000, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(mask of the pairs that agree, transform from them): three pairs at a time are tried, the same ones on every run."""
    n = len(a)
    if n < 3:
        return np.ones(n, bool), np.eye(4)
    rng, best = np.random.default_rng(seed), np.zeros(n, bool)
    for _ in range(rounds):
        three = rng.choice(n, 3, replace=False)
        good = np.linalg.norm(move(rigid_fit(a[three], b[three]), a) - b, axis=1) < limit
        if good.sum() > best.sum():
            best = good
            if best.all():
                break
    return best, rigid_fit(a[best], b[best]) if best.sum() >= 3 else np.eye(4)


def icp(a: np.ndarray, b: np.ndarray, limit: float = 0.5, rounds: int = 30, start: np.ndarray | None = None) -> np.ndarray:
    """Transform that brings cloud a onto cloud b by pairing nearest points again and again."""
    t = np.eye(4) if start is None else start
    for _ in range(rounds):
        moved = move(t, a)
        d = squared_distances(moved, b)
        at = d.argmin(1)
        near = d[np.arange(len(a)), at] < limit * limit
        if near.sum() < 3:
            break
        step = rigid_fit(moved[near], b[at[near]])
        t = step @ t
        if np.abs(step - np.eye(4)).max() < 1e-9:
            break
    return t


def box_iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Overlap of boxes x0, y0, x1, y1, all against all."""
    low, high = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    inner = np.prod(np.maximum(high - low, 0), axis=2)
    size = lambda x: np.prod(np.maximum(x[:, 2:] - x[:, :2], 0), axis=1)
    return inner / np.maximum(size(a)[:, None] + size(b)[None, :] - inner, 1e-12)


def suppress(boxes: np.ndarray, scores: np.ndarray, limit: float = 0.5) -> np.ndarray:
    """Places of the boxes that stay: best first, none that overlaps a better one by more than the limit."""
    left, keep = np.lexsort((np.arange(len(scores)), -scores)), []
    while len(left):
        first, rest = left[0], left[1:]
        keep.append(first)
        left = rest[box_iou(boxes[[first]], boxes[rest])[0] <= limit] if len(rest) else rest
    return np.array(keep, int)


def place_circles(radii: Sequence[float], width: float, height: float, seed: int = 0, tries: int = 1000) -> np.ndarray:
    """Centers of circles that do not overlap, drawn one after the other; not a number where no place was found."""
    rng, out = np.random.default_rng(seed), np.full((len(radii), 2), np.nan)
    for i, r in enumerate(radii):
        for _ in range(tries):
            c = rng.uniform([r, r], [max(r, width - r), max(r, height - r)])
            done = ~np.isnan(out[:, 0])
            if not (np.linalg.norm(out[done] - c, axis=1) < np.asarray(radii)[done] + r).any():
                out[i] = c
                break
    return out


class Instance:
    """A global instance while the frames of a scan are gone through."""

    def __init__(self, number: int, points: np.ndarray, feature: np.ndarray, name: str | None, size: int):
        self.number, self.points, self.feature, self.name, self.largest, self.count = number, points, feature, name, size, 1

    def add(self, points: np.ndarray, feature: np.ndarray, name: str | None, size: int, thin_over: int) -> None:
        self.feature = (self.feature * self.count + feature) / (self.count + 1)
        self.count += 1
        if size > self.largest:
            self.largest, self.name = size, name
        self.points = np.concatenate([self.points, points])
        if len(self.points) > thin_over:
            self.points = self.points[::2]

    def absorb(self, other: Instance) -> None:
        n = self.count + other.count
        self.feature = (self.feature * self.count + other.feature * other.count) / n
        if other.largest > self.largest:
            self.largest, self.name = other.largest, other.name
        self.count, self.points = n, np.concatenate([self.points, other.points])


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    return float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b) + 1e-6))


def matched(a: np.ndarray, b: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Masks of the points of a and of b that have one of the other cloud nearer than the radius."""
    if len(a) * len(b) > 1 << 20:
        return nearest_distances(a, b)[:, 0] < radius, nearest_distances(b, a)[:, 0] < radius
    near = np.sqrt(squared_distances(a, b)) < radius
    return near.any(1), near.any(0)


def cloud_iou(a: np.ndarray, b: np.ndarray, radius: float) -> float:
    """Matched share of the points of both clouds."""
    in_a, in_b = matched(a, b, radius)
    return float((in_a.sum() + in_b.sum()) / (len(a) + len(b)))


class _Index:
    """Instances by the cells of their points, with features and bounding boxes as arrays.

    It only leaves out instances that cannot pass the tests of likeness and overlap, so the results are those of trying all.
    """

    SLACK = 1e-6  # more than rounding

    def __init__(self, radius: float, instances: Sequence[Instance] = ()):
        self.radius, self.n, self.cells = radius, 0, {}
        self.unit, self.low, self.high = np.zeros((0, 0)), np.zeros((0, 3)), np.zeros((0, 3))
        for i, g in enumerate(instances):
            self.put(i, g, g.points)

    def _cells(self, points: np.ndarray) -> set[tuple[int, int, int]]:
        return set(map(tuple, np.floor(points / (self.radius + self.SLACK)).astype(np.int64).tolist()))

    def put(self, at: int, g: Instance, added: np.ndarray) -> None:
        if at >= len(self.unit):
            more = max(64, 2 * len(self.unit))
            grown = [np.zeros((more, d)) for d in (len(g.feature), 3, 3)]
            for new, old in zip(grown, (self.unit, self.low, self.high) if self.n else ()):
                new[: self.n] = old[: self.n]
            self.unit, self.low, self.high = grown
        self.unit[at], self.low[at], self.high[at] = g.feature / (np.linalg.norm(g.feature) + 1e-9), g.points.min(0), g.points.max(0)
        self.n = max(self.n, at + 1)
        for cell in self._cells(added):
            self.cells.setdefault(cell, set()).add(at)

    def near(self, points: np.ndarray, start: int = 0) -> np.ndarray:
        """Places from start on, ascending, of the instances that may have a point within the radius of these."""
        around = {(x + i, y + j, z + k) for x, y, z in self._cells(points) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)}
        found = set().union(*(self.cells[c] for c in around if c in self.cells))
        at = np.fromiter(found, np.int64, len(found))
        at = np.sort(at[at >= start])
        gap = np.maximum(np.maximum(self.low[at] - points.max(0), points.min(0) - self.high[at]), 0)
        return at[(gap * gap).sum(1) <= self.radius**2 + self.SLACK]

    def alike(self, at: np.ndarray, feature: np.ndarray, least: float) -> np.ndarray:
        return at[self.unit[at] @ feature >= (least - self.SLACK) * np.linalg.norm(feature)] if len(at) else at


def resolve_entities(frames: Iterable[Sequence[tuple[int, np.ndarray, np.ndarray, str | None]]], alike: float = 0.8, overlap: float = 0.3, radius: float = 0.03, thin_over: int = 10_000) -> tuple[dict[int, int], list[Instance]]:
    """(detection -> instance, instances): each detection joins the best instance alike and overlapping enough, else begins one.

    frames: in order, the detections (number, points, feature, name) of each. The score is half likeness, half overlap; of
    equal scores the older instance counts. alike and overlap are above 0.
    """
    instances: list[Instance] = []
    index = _Index(radius)
    of: dict[int, int] = {}
    for frame in frames:
        for number, points, feature, name in frame:
            best, score = None, -1.0
            for g in (instances[i] for i in index.alike(index.near(points), feature, alike)):
                s = similarity(g.feature, feature)
                if s >= alike:
                    o = cloud_iou(g.points, points, radius)
                    if o >= overlap and 0.5 * s + 0.5 * o > score:
                        best, score = g, 0.5 * s + 0.5 * o
            if best is None:
                best = Instance(len(instances), points, feature, name, len(points))
                instances.append(best)
            else:
                best.add(points, feature, name, len(points), thin_over)
            index.put(best.number, best, points)
            of[number] = best.number
    return of, instances


def merge_instances(instances: Sequence[Instance], apart: float = 2.0, radius: float = 0.03) -> dict[int, int]:
    """instance -> instance it is merged into: later ones into earlier ones that are near, and overlap much or are alike and overlap some."""
    into: dict[int, int] = {}
    index = _Index(radius, instances)
    middle = [g.points.mean(0) for g in instances]
    for i, a in enumerate(instances):
        if a.number in into:
            continue
        after = i + 1
        while after is not None:  # a grows with every instance it absorbs, and those after that one meet the grown a
            rest, after = index.near(a.points, after), None
            for j in rest:
                b = instances[j]
                if b.number in into or np.linalg.norm(middle[i] - middle[j]) > apart:
                    continue
                in_a, in_b = matched(a.points, b.points, radius)
                o, s = (in_a.sum() + in_b.sum()) / (len(a.points) + len(b.points)), similarity(a.feature, b.feature)
                if o > 0.7 or (s > 0.7 and (o > 0.3 or in_b.mean() > 0.8)):
                    into[b.number] = a.number
                    a.absorb(b)
                    middle[i] = a.points.mean(0)
                    after = int(j) + 1
                    break
    return into
