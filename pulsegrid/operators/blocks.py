"""Images and volumes in blocks, each with a margin of its neighbours, so that no row holds more than a block.

``slices``: recording_id, frame_idx, height, width, pixels (numbers or uint8
bytes). An image is one slice; the slices of a volume are numbered from 0
without gaps. A block is told by its numbers k, j, i along z, y, x. Places
(``pos``) count the voxels of a recording row by row, slice by slice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.graphs import classes
from ..functions.ranks import ranked
from ..functions.stored import written
from . import pairs

KEYS = ["recording_id", "k", "j", "i"]


@dataclass(frozen=True)
class Shape:
    """Voxels of a block along z, y, x (0: all there are), and how many of its neighbours it sees on each side."""

    depth: int = 16
    height: int = 512
    width: int = 512
    margin: int = 0


def image_of(pixels, height: int, width: int) -> np.ndarray:
    """A frame whose pixels are numbers or uint8 bytes, as doubles."""
    flat = np.frombuffer(pixels, np.uint8) if isinstance(pixels, bytes | bytearray) else np.asarray(pixels)
    return flat.astype(float).reshape(height, width)


def _same(value, n: int) -> pd.Series:
    """A column of one value, as objects: so that strings become plain Arrow arrays."""
    return pd.Series([value] * n, dtype=object)


def _covers(n: int, size: int, margin: int) -> list[tuple[int, int, int]]:
    """Number, first and end (margins included) of the blocks along an axis of ``n`` voxels."""
    size = size or max(n, 1)
    return [(b, max(b * size - margin, 0), min((b + 1) * size + margin, n)) for b in range(-(-n // size))]


def _depths(z: int, depth: int, margin: int) -> range:
    """Numbers of the blocks that see slice ``z``."""
    return range(max(z - margin, 0) // depth, (z + margin) // depth + 1) if depth else range(1)


def cut(slices: DataFrame, shape: Shape) -> DataFrame:
    """recording_id, k, j, i, z, y, x, h, w, height, width, data: for each block the part of each slice that it sees, as doubles in bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                image, out = image_of(row.pixels, row.height, row.width), []
                for j, y0, y1 in _covers(row.height, shape.height, shape.margin):
                    for i, x0, x1 in _covers(row.width, shape.width, shape.margin):
                        data = image[y0:y1, x0:x1].tobytes()
                        out += [(row.recording_id, k, j, i, row.frame_idx, y0, x0, y1 - y0, x1 - x0, row.height, row.width, data) for k in _depths(row.frame_idx, shape.depth, shape.margin)]
                yield pd.DataFrame(out, columns=_PIECE, dtype=object)

    kind = slices.schema["recording_id"].dataType.simpleString()
    return slices.select("recording_id", "frame_idx", "height", "width", "pixels").mapInPandas(run, f"recording_id {kind}, k int, j int, i int, z int, y int, x int, h int, w int, height int, width int, data binary")


_PIECE = ["recording_id", "k", "j", "i", "z", "y", "x", "h", "w", "height", "width", "data"]


@dataclass
class Block:
    """Voxels that a block sees, the place of the first one, and which of them are its own (``core``)."""

    voxels: np.ndarray
    origin: tuple[int, int, int]
    core: tuple[slice, slice, slice]
    size: tuple[int, int]
    #: whether the last slice seen is the recording's last
    ends: bool
    margin: int

    def places(self) -> np.ndarray:
        z, y, x = (np.arange(n) + o for n, o in zip(self.voxels.shape, self.origin))
        return (z[:, None, None] * self.size[0] + y[None, :, None]) * self.size[1] + x[None, None, :]


def _block(key: tuple, pieces: pd.DataFrame, shape: Shape) -> Block | None:
    """The block of one group of ``cut``; null if it has no slice of its own, which is where a recording ends."""
    pieces = pieces.sort_values("z")
    first, z = pieces.iloc[0], pieces["z"].to_numpy()
    depth = shape.depth or len(z)
    k, j, i = key[-3:]
    if z[0] != max(k * depth - shape.margin, 0) or (np.diff(z) != 1).any():
        raise ValueError(f"slices of {key[0]!r} aren't numbered from 0 without gaps and repeats")
    voxels = np.stack([np.frombuffer(d, float).reshape(first.h, first.w) for d in pieces["data"]])
    origin = (int(z[0]), int(first.y), int(first.x))
    size = (int(first.height), int(first.width))
    at = (k * depth, j * (shape.height or size[0]), i * (shape.width or size[1]))
    lengths = (depth, shape.height or size[0], shape.width or size[1])
    core = tuple(slice(a - o, min(a - o + n, s)) for a, o, n, s in zip(at, origin, lengths, voxels.shape))
    return None if core[0].start >= voxels.shape[0] else Block(voxels, origin, core, size, int(z[-1]) < (k + 1) * depth + shape.margin - 1 or not shape.depth, shape.margin)


def over_blocks(slices: DataFrame, shape: Shape, fn: Callable[[Block], pd.DataFrame], schema: str) -> DataFrame:
    """recording_id, k, j, i and what ``fn`` gives for each block; each slice's parts are shuffled to the blocks that see them."""

    def run(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
        block = _block(key, pieces, shape)
        rows = fn(block) if block else pd.DataFrame([], columns=names)
        for at, (name, value) in enumerate(zip(KEYS, key)):
            rows.insert(at, name, _same(value, len(rows)))
        return rows

    names = [part.split()[0] for part in schema.split(", ")]
    kind = slices.schema["recording_id"].dataType.simpleString()
    return cut(slices, shape).groupBy(*KEYS).applyInPandas(run, f"recording_id {kind}, k int, j int, i int, {schema}")


# structure tensor of volumes


def texture_margin(sigma: float, around: float) -> int:
    """How far a voxel's tensor looks: the reach of both Gaussians."""
    return int(4 * sigma + 0.5) + int(4 * around + 0.5)


def _oriented(block: Block, sigma: float, around: float, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, unit vectors (z, y, x) and anisotropies of a block's own voxels whose numbers ``stride`` divides."""
    own = [slice(c.start + (-(o + c.start)) % stride, c.stop, stride) for c, o in zip(block.core, block.origin)]
    vectors, anisotropy = kernels.orientation_3d(block.voxels, sigma, around, tuple(own))
    return block.places()[tuple(own)].ravel(), vectors.reshape(-1, 3), anisotropy.ravel()


def orientation_3d(slices: DataFrame, sigma: float = 1.0, around: float = 2.0, stride: int = 2, shape: Shape = Shape(16, 256, 256)) -> DataFrame:
    """recording_id, pos, vz, vy, vx, anisotropy of every ``stride``-th voxel; the sign of a vector is free."""

    def fn(block: Block) -> pd.DataFrame:
        pos, v, fa = _oriented(block, sigma, around, stride)
        return pd.DataFrame({"pos": pos, "vz": v[:, 0], "vy": v[:, 1], "vx": v[:, 2], "anisotropy": fa})

    seen = Shape(shape.depth, shape.height, shape.width, texture_margin(sigma, around))
    return over_blocks(slices, seen, fn, "pos long, vz double, vy double, vx double, anisotropy double").drop("k", "j", "i")


SUMS = ("w", "zz", "zy", "zx", "yy", "yx", "xx")


def tensor_sums(slices: DataFrame, sigma: float = 1.0, around: float = 2.0, stride: int = 2, shape: Shape = Shape(16, 256, 256)) -> DataFrame:
    """recording_id, n, w, zz .. xx: of every ``stride``-th voxel the number, the summed anisotropy, and the vectors' products weighed by it.

    A block gives these sums over its own voxels.
    """

    def fn(block: Block) -> pd.DataFrame:
        _, v, fa = _oriented(block, sigma, around, stride)
        q = (v * fa[:, None]).T @ v
        return pd.DataFrame([(len(fa), fa.sum(), q[0, 0], q[0, 1], q[0, 2], q[1, 1], q[1, 2], q[2, 2])], columns=["n", *SUMS])

    seen = Shape(shape.depth, shape.height, shape.width, texture_margin(sigma, around))
    parts = over_blocks(slices, seen, fn, "n long, " + ", ".join(f"{k} double" for k in SUMS))
    return parts.groupBy("recording_id").agg(F.sum("n").alias("n"), *[F.sum(k).alias(k) for k in SUMS])


def texture_3d(slices: DataFrame, sigma: float = 1.0, around: float = 2.0, stride: int = 2, shape: Shape = Shape(16, 256, 256)) -> DataFrame:
    """texture_alignment_score_3d, texture_mean_direction_zyx and texture_mean_fractional_anisotropy of each volume; vectors weigh by anisotropy."""
    sums = tensor_sums(slices, sigma, around, stride, shape)
    q = lambda k: F.try_divide(3 * F.col(k) - (F.col("w") if k[0] == k[1] else 0), 2 * F.nullif(F.col("w"), F.lit(0.0)))
    aligned = pairs.nematic_of(sums.select("recording_id", "n", "w", *[q(k).alias(f"q_{k}") for k in SUMS[1:]]), ("recording_id", "n", "w"))
    return aligned.select(
        "recording_id", F.when(F.col("w") > 0, F.col("alignment_score_3d")).alias("texture_alignment_score_3d"), F.when(F.col("w") > 0, F.col("mean_direction_zyx")).alias("texture_mean_direction_zyx"),
        F.try_divide("w", "n").alias("texture_mean_fractional_anisotropy"),
    )


# labels


def histogram(slices: DataFrame) -> DataFrame:
    """recording_id, v, n: how often each value stands; counted slice by slice."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                v, n = np.unique(image_of(row.pixels, row.height, row.width), return_counts=True)
                yield pd.DataFrame({"recording_id": _same(row.recording_id, len(v)), "v": v, "n": n})

    kind = slices.schema["recording_id"].dataType.simpleString()
    return slices.select("recording_id", "height", "width", "pixels").mapInPandas(run, f"recording_id {kind}, v double, n long").groupBy("recording_id", "v").agg(F.sum("n").alias("n"))


_MASKED = "z0 int, y0 int, x0 int, dz int, dy int, dx int, core array<int>, height int, width int, ends boolean, margin int, mask binary, data binary"


def _masked(slices: DataFrame, shape: Shape) -> DataFrame:
    """Blocks with the voxels above the recording's threshold as ``mask``, written."""

    def fn(b: Block) -> pd.DataFrame:
        core = [v for s in b.core for v in (s.start, s.stop)]
        return pd.DataFrame([(*b.origin, *b.voxels.shape, core, *b.size, b.ends, b.margin, b.voxels.tobytes())], columns=["z0", "y0", "x0", "dz", "dy", "dx", "core", "height", "width", "ends", "margin", "data"])

    blocks = over_blocks(slices, shape, fn, _MASKED.replace(", mask binary", ""))

    @F.pandas_udf("binary")
    def above(data: pd.Series, threshold: pd.Series) -> pd.Series:
        return pd.Series([(np.frombuffer(d, float) > t).tobytes() for d, t in zip(data, threshold)])

    return written(blocks.join(pairs.otsu(histogram(slices)), "recording_id").withColumn("mask", above("data", "threshold")).drop("threshold"), "masked")


def _unpacked(mask, z0, y0, x0, dz, dy, dx, core, height, width, ends, margin) -> tuple[Block, np.ndarray]:
    grid = np.frombuffer(mask, bool).reshape(dz, dy, dx)
    return Block(grid, (z0, y0, x0), tuple(slice(core[a], core[a + 1]) for a in (0, 2, 4)), (height, width), ends, margin), grid


def _local(grid: np.ndarray, places: np.ndarray, background: bool, corners: bool) -> np.ndarray:
    """Of each voxel the place of the first one of its part in this block; -1 outside."""
    labels = kernels.label_components(~grid if background else grid, corners)
    flat, out = labels.ravel(), np.full(labels.size, -1)
    inside = np.flatnonzero(flat)
    _, first = np.unique(flat[inside], return_index=True)
    out[inside] = places.ravel()[inside[first]][flat[inside] - 1]
    return out.reshape(grid.shape)


_BLOCK = ["mask", "z0", "y0", "x0", "dz", "dy", "dx", "core", "height", "width", "ends", "margin"]


def parts(blocks: DataFrame, background: bool, corners: bool, flat: bool) -> DataFrame:
    """recording_id, k, j, i, node, root, n, outer: the parts of each block's mask, and the class of parts that each belongs to.

    A part's number is the place of its first voxel, so that a part which two
    blocks see in whole has one number. Blocks see voxels of their neighbours;
    where two have the same one, their parts are one class. root: the place of
    the class' first voxel, n: its voxels, outer: whether it touches the border,
    which an image (``flat``) has along y and x alone.
    """

    def found(*columns: pd.Series) -> pd.DataFrame:
        out = []
        for row in zip(*columns):
            block, grid = _unpacked(*row)
            places = block.places()
            node = _local(grid, places, background, corners)
            own, near, border = np.zeros(grid.shape, bool), np.zeros(grid.shape, bool), np.zeros(grid.shape, bool)
            own[block.core] = True
            for axis, (c, o, n) in enumerate(zip(block.core, block.origin, grid.shape)):
                side = lambda lo, hi, axis=axis: tuple(slice(lo, hi) if a == axis else slice(None) for a in range(3))
                # what other blocks see too: outside the core, and as far into it as they see
                if c.start:
                    near[side(0, c.start + block.margin)] = True
                if c.stop < n:
                    near[side(max(c.stop - block.margin, 0), None)] = True
                if axis or not flat:
                    if o == 0:
                        border[side(0, 1)] = True
                    if o + n == block.size[axis - 1] if axis else block.ends:
                        border[side(n - 1, n)] = True
            inside = node >= 0
            kinds, at = np.unique(node[inside], return_inverse=True)
            counts, edge = np.bincount(at, own[inside], len(kinds)).astype(int), np.bincount(at, border[inside], len(kinds)) > 0
            shared = inside & (near | ~own)
            out.append({"nodes": [{"node": a, "n": b, "outer": c} for a, b, c in zip(kinds.tolist(), counts.tolist(), edge.tolist())], "pos": places[shared].tolist(), "of": node[shared].tolist()})
        return pd.DataFrame(out, columns=["nodes", "pos", "of"])

    label = F.pandas_udf(found, "struct<nodes array<struct<node long, n long, outer boolean>>, pos array<long>, of array<long>>")
    local = written(blocks.select(*KEYS, label(*_BLOCK).alias("f")).select(*KEYS, "f.*"), "parts")
    shared = local.select("recording_id", F.inline(F.arrays_zip("pos", "of"))).toDF("recording_id", "pos", "node")
    met = shared.groupBy("recording_id", "pos").agg(F.min("node").alias("a"), F.collect_set("node").alias("all")).where(F.size("all") > 1)
    roots = classes(met.select("recording_id", "a", F.explode("all").alias("b")))
    nodes = local.select(*KEYS, F.inline("nodes")).join(roots, ["recording_id", "node"], "left").withColumn("root", F.coalesce("root", "node"))
    nodes = written(nodes, "nodes")
    whole = nodes.groupBy("recording_id", "root").agg(F.sum("n").alias("n"), F.max("outer").alias("outer"))
    return nodes.drop("n", "outer").join(whole, ["recording_id", "root"])


def _replaced(blocks: DataFrame, values: DataFrame, background: bool, corners: bool, kind: str, fn: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], bytes]) -> Column:
    """``blocks`` with ``made``: what ``fn`` makes of the mask, each voxel's part, and the parts' numbers with ``values`` (recording_id, k, j, i, node, value)."""
    listed = values.groupBy(*KEYS).agg(F.collect_list("node").alias("_nodes"), F.collect_list("value").alias("_values"))

    def run(nodes: pd.Series, given: pd.Series, *columns: pd.Series) -> pd.Series:
        out = []
        for n, v, *row in zip(nodes, given, *columns):
            block, grid = _unpacked(*row)
            n, v = (np.asarray([] if x is None else x, np.int64) for x in (n, v))
            order = np.argsort(n)
            out.append(fn(grid, _local(grid, block.places(), background, corners), n[order], v[order]))
        return pd.Series(out)

    return blocks.join(listed, KEYS, "left").withColumn("made", F.pandas_udf(run, kind)("_nodes", "_values", *_BLOCK)).drop("_nodes", "_values")


def _chosen(node: np.ndarray, nodes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Each voxel's value by its part, 0 where it has none."""
    if not len(nodes):
        return np.zeros(node.shape, np.int64)
    at = np.minimum(np.searchsorted(nodes, node), len(nodes) - 1)
    return np.where(nodes[at] == node, values[at], 0)


def labelled(slices: DataFrame, least: int, shape: Shape, flat: bool) -> DataFrame:
    """Blocks with ``labels`` (int in bytes) of what is above Otsu's threshold: holes filled, parts under ``least`` voxels dropped.

    The same labels as of the whole image or volume in one piece: numbers from 1
    in order of the first voxel. A hole is background that no face connects with
    the border; small parts are told by faces, labels by corners too. ``flat``:
    the slices are images. Blocks must have a margin.
    """
    if not shape.margin:
        raise ValueError("blocks must see a voxel of their neighbours at least")
    blocks = _masked(slices, shape)
    one = F.lit(1).cast("long").alias("value")
    holes = parts(blocks, True, False, flat).where("not outer").select(*KEYS, "node", one)
    blocks = written(_replaced(blocks, holes, True, False, "binary", lambda grid, node, n, v: (grid | (_chosen(node, n, v) > 0)).tobytes()).drop("mask").withColumnRenamed("made", "mask"), "filled")
    large = parts(blocks, False, False, flat).where(F.col("n") >= least).select(*KEYS, "node", one)
    blocks = written(_replaced(blocks, large, False, False, "binary", lambda grid, node, n, v: (_chosen(node, n, v) > 0).tobytes()).drop("mask").withColumnRenamed("made", "mask"), "large")
    final = parts(blocks, False, True, flat)
    numbers = ranked(final.select("recording_id", "root").distinct(), "root", ("recording_id",)).select("recording_id", "root", F.col("r").cast("long").alias("value"))
    named = final.join(numbers, ["recording_id", "root"]).select(*KEYS, "node", "value")
    return written(_replaced(blocks, named, False, True, "binary", lambda grid, node, n, v: _chosen(node, n, v).astype(np.int32).tobytes()).withColumnRenamed("made", "labels"), "labels")


def label_rows(blocks: DataFrame) -> DataFrame:
    """recording_id, label, p, z, y, x: the labelled voxels of ``labelled``, each once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                core = tuple(slice(row.core[a], row.core[a + 1]) for a in (0, 2, 4))
                grids = [np.frombuffer(v, t).reshape(row.dz, row.dy, row.dx)[core] for v, t in ((row.labels, np.int32), (row.data, float))]
                at = np.nonzero(grids[0])
                places = {name: a + s.start + o for name, a, s, o in zip("zyx", at, core, (row.z0, row.y0, row.x0))}
                yield pd.DataFrame({"recording_id": _same(row.recording_id, len(at[0])), "label": grids[0][at], "p": grids[1][at], **places})

    kind = blocks.schema["recording_id"].dataType.simpleString()
    return blocks.select("recording_id", "z0", "y0", "x0", "dz", "dy", "dx", "core", "labels", "data").mapInPandas(run, f"recording_id {kind}, label int, p double, z int, y int, x int")


def outline_lengths(blocks: DataFrame) -> DataFrame:
    """recording_id, label, perimeter of images labelled with a margin of two: each block adds up its own border pixels."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                grid, core = np.frombuffer(row.labels, np.int32).reshape(row.dy, row.dx), tuple(slice(row.core[a], row.core[a + 1]) for a in (2, 4))
                labels = np.setdiff1d(np.unique(grid[core]), 0)
                yield pd.DataFrame({"recording_id": _same(row.recording_id, len(labels)), "label": labels, "perimeter": [kernels.outline_steps(grid == n)[core].sum() for n in labels]})

    kind = blocks.schema["recording_id"].dataType.simpleString()
    rows = blocks.select("recording_id", "dy", "dx", "core", "labels").mapInPandas(run, f"recording_id {kind}, label int, perimeter double")
    return rows.groupBy("recording_id", "label").agg(F.sum("perimeter").alias("perimeter"))
