"""Images and volumes in blocks: the same as in one piece, for every size of block."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import graphs, kernels
from pulsegrid.operators import blocks, images
from pulsegrid.operators.blocks import Shape


def slices_of(spark, volumes):
    rows = [(name, z, *image.shape, image.astype(float).ravel().tolist(), 30.0) for name, volume in volumes.items() for z, image in enumerate(volume)]
    return spark.createDataFrame(rows, "recording_id string, frame_idx int, height int, width int, pixels array<double>, fps double").repartition(3)


def test_classes(spark):
    """Chains, stars and loops, in two groups whose nodes have the same numbers."""
    rng = np.random.default_rng(0)
    edges = [("a", k, k + 1) for k in range(40)] + [("b", 0, k) for k in range(1, 30)] + [("b", 100 + k, 100 + (k + 1) % 7) for k in range(7)] + [("c", *map(int, rng.integers(0, 60, 2))) for _ in range(45)]
    got = {(r.recording_id, r.node): r.root for r in graphs.classes(spark.createDataFrame(edges, "recording_id string, a long, b long")).collect()}
    parent = {}

    def root(n):
        while parent.setdefault(n, n) != n:
            n = parent[n]
        return n

    for g, a, b in edges:
        x, y = sorted((root((g, a)), root((g, b))))
        parent[y] = x
    want = {n: root(n)[1] for n in parent}
    assert got == {n: r for n, r in want.items() if n in got} and set(want) - set(got) <= {(g, a) for g, a, b in edges if a == b}


@pytest.fixture(scope="module")
def stack():
    rng = np.random.default_rng(3)
    z, y, x = np.mgrid[:21, :17, :19]
    return {"waves": 100 + 40 * np.sin(y * 0.8 + z * 0.3) + rng.normal(0, 3, z.shape), "noise": rng.normal(0, 1, (5, 9, 30)), "flat": np.full((3, 8, 8), 7.0)}


@pytest.mark.parametrize("shape", [Shape(1, 0, 0), Shape(0, 0, 0), Shape(4, 7, 5)])
def test_texture_of_slabs(spark, stack, shape):
    slices = slices_of(spark, stack)
    rows = {r.recording_id: r for r in blocks.texture_3d(slices, shape=shape).collect()}
    every = blocks.orientation_3d(slices, shape=shape).orderBy("recording_id", "pos").toPandas()
    for name, volume in stack.items():
        v, fa = kernels.orientation_3d(volume)
        own = every[every.recording_id == name]
        places = np.arange(volume.size).reshape(volume.shape)[::2, ::2, ::2]
        assert own.pos.tolist() == places.ravel().tolist() and np.abs(own.anisotropy - fa.ravel()).max() < 1e-9
        v, fa = v.reshape(-1, 3), fa.ravel()
        r = rows[name]
        assert abs(r.texture_mean_fractional_anisotropy - fa.mean()) < 1e-9
        if fa.sum() == 0:
            assert r.texture_alignment_score_3d is None and r.texture_mean_direction_zyx is None
            continue
        # the sign of a direction is free, and where two values are near, so is the direction
        along = np.abs((own[["vz", "vy", "vx"]].to_numpy() * v).sum(1))
        assert (along > 1 - 1e-6).mean() > 0.99
        values, vectors = np.linalg.eigh((3 * (v * fa[:, None]).T @ v - np.eye(3) * fa.sum()) / (2 * fa.sum()))
        assert abs(r.texture_alignment_score_3d - values[-1]) < 1e-6 and abs(np.dot(r.texture_mean_direction_zyx, vectors[:, -1])) > 1 - 1e-6


def test_no_row_is_larger_than_a_slab(spark, stack):
    """A slab carries its own slices and the margin, however long the stack is."""
    slices = slices_of(spark, {"waves": stack["waves"]})
    pieces = blocks.cut(slices, Shape(2, 6, 6, 1)).groupBy("k", "j", "i").agg(F.count("*").alias("n"), F.max("h").alias("h"), F.max("w").alias("w")).collect()
    assert max(r.n for r in pieces) == 4 and max(r.h for r in pieces) == max(r.w for r in pieces) == 8
    with pytest.raises(Exception, match="without gaps"):
        blocks.texture_3d(slices.where("frame_idx <> 4")).collect()


def drawn(rng, shape, share):
    """Noise that is smooth enough for parts with holes and long arms."""
    image = rng.random(shape)
    for axis in range(len(shape)):
        image = image + 0.7 * np.roll(image, 1, axis)
    return np.floor(255 * (image - image.min()) / np.ptp(image) + share)


def want_labels(image, least):
    mask = kernels.drop_small(kernels.fill_holes(image > kernels.otsu_threshold(image)), least)
    return kernels.label_components(mask)


@pytest.mark.parametrize("tile", [1, 7, 0])
def test_labels_of_tiles(spark, tile):
    rng = np.random.default_rng(tile)
    y, x = np.mgrid[:12, :15]
    rings = ((np.hypot(y - 6, x - 7) // 2) % 2) * 200.0
    pictures = {"noise": drawn(rng, (14, 11), 0), "rings": rings, "comb": np.where((x % 2 == 0) | (y == 11), 90.0, 3.0), "flat": np.full((4, 5), 9.0), "dot": np.eye(1) * 5}
    slices = slices_of(spark, {k: v[None] for k, v in pictures.items()})
    least = 9 if tile == 7 else 2
    tiles = blocks.labelled(slices, least, Shape(1, tile, tile, 2), True)
    found, lengths = blocks.label_rows(tiles).toPandas(), blocks.outline_lengths(tiles).collect()
    for name, image in pictures.items():
        want, own = want_labels(image, least), found[found.recording_id == name]
        got = np.zeros(image.shape, int)
        got[own.y, own.x] = own.label
        assert (got == want).all() and len(own) == (want > 0).sum() and (own.p == image[own.y, own.x]).all()
        measured = {r.label: r.perimeter for r in lengths if r.recording_id == name}
        assert set(measured) == set(np.unique(want)) - {0} and all(abs(v - kernels.perimeter(want == k)) < 1e-9 for k, v in measured.items())


@pytest.mark.parametrize("shape", [Shape(1, 0, 0, 1), Shape(0, 0, 0, 1), Shape(2, 3, 5, 1)])
def test_labels_of_slabs(spark, shape):
    rng = np.random.default_rng(8)
    z, y, x = np.mgrid[:9, :9, :9]
    shell = (np.abs(np.sqrt((z - 4) ** 2 + (y - 4) ** 2 + (x - 4) ** 2) - 3) < 0.8) * 100.0
    volumes = {"noise": drawn(rng, (7, 10, 8), 0), "shell": shell, "open": np.where(z == 0, 0.0, shell), "one": drawn(rng, (1, 8, 8), 0)}
    slices = slices_of(spark, volumes)
    found = blocks.label_rows(blocks.labelled(slices, 4, shape, False)).toPandas()
    for name, volume in volumes.items():
        own, got = found[found.recording_id == name], np.zeros(volume.shape, int)
        got[own.z, own.y, own.x] = own.label
        assert (got == want_labels(volume, 4)).all(), name
    with pytest.raises(ValueError, match="see a voxel"):
        blocks.labelled(slices, 4, Shape(2, 2, 2), False)


def test_objects_without_parting(spark):
    """The front door gives the same objects and summary as one piece, and an image without any."""
    y, x = np.mgrid[:40, :50]
    discs = np.any([np.hypot(y - a, x - b) <= r for a, b, r in ((9, 9, 6), (9, 20, 5), (28, 30, 8))], axis=0) * 120.0
    slices = slices_of(spark, {"discs": np.stack([discs, discs * 0.5]), "none": np.zeros((1, 6, 6))})
    objects, summary = images.morphology_2d(slices, separate=False)
    s = {r.recording_id: r for r in summary.collect()}
    assert sorted(r.area for r in objects.collect()) == sorted(np.bincount(want_labels(discs, 30).ravel())[1:].tolist())
    assert s["discs"].n_objects == 2 and s["none"].n_objects == 0 and s["none"].coverage_fraction == 0
    objects, summary = images.morphology_3d(slices_of(spark, {"v": np.stack([discs] * 4)}), separate=False, texture=True)
    assert objects.count() == summary.first().n_objects == 2 and summary.first().stack_shape_zyx == [4, 40, 50]
