"""NumPy helpers for one image or volume at a time; Spark deals the recordings out."""

from __future__ import annotations

import heapq
import itertools
import math

import numpy as np


def otsu_threshold(image: np.ndarray) -> float:
    """Value that parts the histogram best, the first of equals; a constant image gives its value."""
    values, counts = np.unique(image, return_counts=True)
    if len(values) < 2:
        return float(values[0])
    n0, s0 = np.cumsum(counts).astype(float), np.cumsum(counts * values.astype(float))
    n1, s1 = n0[-1] - n0[:-1], s0[-1] - s0[:-1]
    between = n0[:-1] * n1 * (s0[:-1] / n0[:-1] - s1 / n1) ** 2
    return float(values[int(np.argmax(between))])


def label_components(mask: np.ndarray, corners: bool = True) -> np.ndarray:
    """Numbers connected pixels from 1, in order of their first pixel, by sweeping minima along all neighbours and jumping pointers."""
    n = mask.size
    at = np.arange(n).reshape(mask.shape)
    links = []
    for shift in itertools.product((-1, 0, 1), repeat=mask.ndim):
        if shift <= (0,) * mask.ndim or (not corners and sum(map(abs, shift)) != 1):
            continue
        here = tuple(slice(max(0, -s), mask.shape[k] - max(0, s)) for k, s in enumerate(shift))
        there = tuple(slice(max(0, s), mask.shape[k] - max(0, -s)) for k, s in enumerate(shift))
        both = mask[here] & mask[there]
        links.append((at[here][both], at[there][both]))
    a, b = (np.concatenate([x[k] for x in links]) if links else np.zeros(0, int) for k in (0, 1))
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            break
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]
    out = np.zeros(n, int)
    inside = mask.ravel()
    _, out[inside] = np.unique(root[inside], return_inverse=True)
    out[inside] += 1
    return out.reshape(mask.shape)


def fill_holes(mask: np.ndarray) -> np.ndarray:
    """Background that the border doesn't reach becomes foreground."""
    outside = label_components(~mask, corners=False)
    edge = np.ones(mask.shape, bool)
    edge[tuple(slice(1, -1) for _ in mask.shape)] = False
    return mask | ~np.isin(outside, np.setdiff1d(np.unique(outside[edge]), 0)) & (outside > 0)


def drop_small(mask: np.ndarray, least: int) -> np.ndarray:
    labels = label_components(mask, corners=False)
    keep = np.bincount(labels.ravel()) >= least
    keep[0] = False
    return keep[labels]


def distance_squared(mask: np.ndarray) -> np.ndarray:
    """Squared Euclidean distance to the background, one axis after another; far off where there is none.

    Along the first axis by the last and the next background voxel; along the
    others offsets grow until no voxel is as far off as the offset alone.
    """
    far = float(sum(s * s for s in mask.shape) + 1)
    n = mask.shape[0]
    at = np.arange(n).reshape(-1, *[1] * (mask.ndim - 1))
    last = np.maximum.accumulate(np.where(mask, -1, at), axis=0)
    following = np.flip(np.minimum.accumulate(np.flip(np.where(mask, n, at), 0), axis=0), 0)
    steps = np.minimum(np.where(last < 0, n, at - last), np.where(following >= n, n, following - at)).astype(float)
    out = np.where((last < 0) & (following >= n), far, steps * steps)
    for axis in range(1, mask.ndim):
        lines = np.moveaxis(out, axis, 0)
        best, d = lines.copy(), 1
        while d < len(lines) and d * d < best.max():
            np.minimum(best[d:], lines[:-d] + d * d, out=best[d:])
            np.minimum(best[:-d], lines[d:] + d * d, out=best[:-d])
            d += 1
        out = np.moveaxis(best, 0, axis)
    return np.minimum(out, far)


def gaussian(image: np.ndarray, sigma: float, axis: int, order: int = 0) -> np.ndarray:
    """Gaussian (or its first derivative) along one axis, edges mirrored, to four standard deviations."""
    r = int(4 * sigma + 0.5)
    x = np.arange(-r, r + 1)
    w = np.exp(-(x**2) / (2 * sigma**2))
    w /= w.sum()
    if order:
        w = w * x / sigma**2
    padded = np.pad(image.astype(float), [(r, r) if k == axis else (0, 0) for k in range(image.ndim)], mode="symmetric")
    view = np.lib.stride_tricks.sliding_window_view(padded, 2 * r + 1, axis=axis)
    return view @ w


def smoothed(image: np.ndarray, sigma: float) -> np.ndarray:
    for axis in range(image.ndim):
        image = gaussian(image, sigma, axis)
    return image


def _neighbourhood_max(image: np.ndarray, r: int) -> np.ndarray:
    for axis in range(image.ndim):
        padded = np.pad(image, [(r, r) if k == axis else (0, 0) for k in range(image.ndim)], constant_values=-np.inf)
        image = np.lib.stride_tricks.sliding_window_view(padded, 2 * r + 1, axis=axis).max(axis=-1)
    return image


def seeds(height: np.ndarray, mask: np.ndarray, least: int) -> np.ndarray:
    """Local maxima of the mask, highest first, none within ``least`` of a higher one."""
    top = (height == _neighbourhood_max(np.where(mask, height, -np.inf), max(least, 1))) & mask & (height > 0)
    at = np.argwhere(top)
    at = at[np.argsort(-height[tuple(at.T)], kind="stable")]
    # kept ones by cells of ``least`` voxels, so that only those around are compared
    kept: dict[tuple, list[np.ndarray]] = {}
    out = []
    for p in at:
        cell = tuple(p // (least + 1))
        around = itertools.product(*[(c - 1, c, c + 1) for c in cell])
        if all(np.abs(p - q).max() > least for c in around for q in kept.get(c, ())):
            kept.setdefault(cell, []).append(p)
            out.append(p)
    return np.array(out, int).reshape(-1, mask.ndim)


def watershed(relief: np.ndarray, markers: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Floods from the markers within the mask, the lowest level that water stands at first, all its voxels at once.

    Voxels of one relief are a level, and wait in its bucket once water reaches
    them. A voxel gets the label of the first level that reaches it; where
    several of its neighbours are flooded at once, of the one that stands first
    row by row. Without equal reliefs that is the order of a queue of voxels.
    """
    shape = tuple(n + 2 for n in mask.shape)
    # a rim that is never flooded, so that neighbours are steps in the flat array
    free = np.pad(mask, 1).ravel()
    out = np.pad(np.where(mask, markers, 0), 1).ravel()
    level = np.zeros(free.size, int)
    _, level[free] = np.unique(np.pad(relief, 1).ravel()[free], return_inverse=True)
    jumps = np.array([s * math.prod(shape[k + 1 :]) for k in range(mask.ndim) for s in (-1, 1)])
    buckets: dict[int, list[np.ndarray]] = {}
    waiting: list[int] = []

    def fill(voxels: np.ndarray) -> None:
        levels = level[voxels]
        order = np.argsort(levels, kind="stable")
        cuts = np.flatnonzero(np.diff(levels[order])) + 1
        for part in np.split(voxels[order], cuts) if len(voxels) else ():
            at = int(level[part[0]])
            if at not in buckets:
                buckets[at] = []
                heapq.heappush(waiting, at)
            buckets[at].append(part)

    fill(np.flatnonzero(out))
    free &= out == 0
    while waiting:
        parts = buckets.pop(heapq.heappop(waiting))
        front = np.sort(np.concatenate(parts)) if len(parts) > 1 else parts[0]
        beside = (front[:, None] + jumps).ravel()
        dry = np.flatnonzero(free[beside])
        found, first = np.unique(beside[dry], return_index=True)
        out[found] = out[front[dry[first] // len(jumps)]]
        free[found] = False
        fill(found)
    return out.reshape(shape)[(slice(1, -1),) * mask.ndim]


def segment(image: np.ndarray, least: int = 30, separate: bool = True, distance: int = 10) -> np.ndarray:
    """Labels of what is above Otsu's threshold: holes filled, small parts dropped, touching objects parted."""
    mask = drop_small(fill_holes(image > otsu_threshold(image)), least)
    if not mask.any() or not separate:
        return label_components(mask)
    depth = np.sqrt(distance_squared(mask))
    found = seeds(smoothed(depth, 1.0), mask, distance)
    if not len(found):
        return label_components(mask)
    markers = np.zeros(mask.shape, int)
    markers[tuple(found.T)] = np.arange(1, len(found) + 1)
    grown = _neighbourhood_max(markers.astype(float), 1).astype(int)
    return watershed(-depth, np.where(mask, grown, 0), mask)


def outline_steps(mask: np.ndarray) -> np.ndarray:
    """What each border pixel adds to the outline: straight steps count 1, diagonal ones sqrt 2, corners their mean; 0 elsewhere."""
    m = np.pad(mask, 2).astype(int)
    inner = m[1:-1, 1:-1] & m[:-2, 1:-1] & m[2:, 1:-1] & m[1:-1, :-2] & m[1:-1, 2:]
    border = np.pad((m[1:-1, 1:-1] == 1) & (inner == 0), 1).astype(int)
    straight = border[:-2, 1:-1] + border[2:, 1:-1] + border[1:-1, :-2] + border[1:-1, 2:]
    diagonal = border[:-2, :-2] + border[:-2, 2:] + border[2:, :-2] + border[2:, 2:]
    on = border[1:-1, 1:-1] == 1
    # two neighbours: 1, sqrt 2, or one of each; more neighbours count by the straight ones
    length = np.where(straight >= 2, 1.0, np.where(diagonal >= 2, np.sqrt(2), (1 + np.sqrt(2)) / 2)) * ((straight + diagonal) >= 2)
    length = np.where((straight == 1) & (diagonal == 1), (1 + np.sqrt(2)) / 2, length)
    return np.where(on, length, 0.0)[1:-1, 1:-1]


def perimeter(mask: np.ndarray) -> float:
    """Length of the border pixels' outline."""
    return float(outline_steps(mask).sum())


def orientation_2d(image: np.ndarray, sigma: float = 1.0, around: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """Axial angle along the texture, in -pi/2..pi/2, and coherence, from the smoothed gradient tensor."""
    gx, gy = (smoothed_gradient(image, axis, sigma) for axis in (1, 0))
    xx, xy, yy = (smoothed(p, around) for p in (gx * gx, gx * gy, gy * gy))
    theta = 0.5 * np.arctan2(2 * xy, xx - yy) + np.pi / 2
    theta = np.mod(theta + np.pi / 2, np.pi) - np.pi / 2
    trace = xx + yy
    coherence = np.where(trace > 1e-12, np.sqrt((xx - yy) ** 2 + 4 * xy**2) / np.where(trace > 1e-12, trace, 1), 0.0)
    return theta, coherence


def smoothed_gradient(image: np.ndarray, axis: int, sigma: float) -> np.ndarray:
    """Gaussian derivative along one axis, of the image smoothed along the others."""
    out = gaussian(image, sigma, axis, order=1)
    for other in range(image.ndim):
        if other != axis:
            out = gaussian(out, sigma, other)
    return out


def orientation_3d(volume: np.ndarray, sigma: float = 1.0, around: float = 2.0, cut: int | tuple[slice, slice, slice] = 2) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors (z, y, x) of least gradient and fractional anisotropy, at every ``cut``-th voxel or in the slices of ``cut``."""
    g = [smoothed_gradient(volume, axis, sigma) for axis in range(3)]
    cut = (slice(None, None, cut),) * 3 if isinstance(cut, int) else cut
    tensor = np.stack([np.stack([smoothed(g[i] * g[j], around)[cut] for j in range(3)], -1) for i in range(3)], -1)
    values, vectors = np.linalg.eigh(tensor)
    norm = np.sqrt((values**2).sum(-1))
    spread = np.sqrt(((values - values.mean(-1, keepdims=True)) ** 2).sum(-1))
    return vectors[..., 0], np.where(norm > 1e-12, np.sqrt(1.5) * spread / np.where(norm > 1e-12, norm, 1), 0.0)


def outer_boundaries(labels: np.ndarray) -> np.ndarray:
    """Where a pixel differs from one beside it: of the background, and of labels where another one is among the eight around."""
    background, far = labels == 0, np.iinfo(np.int64).max
    low, high = (np.pad(labels.astype(np.int64), 1, mode="edge") for _ in range(2))
    filled = np.pad(np.where(background, far, labels.astype(np.int64)), 1, mode="edge")
    h, w = labels.shape
    part = lambda a, y, x: a[1 + y : 1 + y + h, 1 + x : 1 + x + w]
    cross, square = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)], [(y, x) for y in (-1, 0, 1) for x in (-1, 0, 1)]
    differs = np.max([part(high, *p) for p in cross], 0) != np.min([part(low, *p) for p in cross], 0)
    touching = np.max([part(high, *p) for p in square], 0) != np.min([part(filled, *p) for p in square], 0)
    return differs & (background | touching)
