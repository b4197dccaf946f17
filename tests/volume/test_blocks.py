import itertools
import math

import pytest
from gridloom.functions import transfer as tf
from gridloom.operators import blocks
from pyspark.sql import functions as F

DIMS = (10, 7, 9)


@pytest.fixture(scope="module")
def volume(spark):
    return blocks.procedural_volume(spark, DIMS, lambda x, y, z: (7 * x * x + 13 * y * y + 29 * z * z + x * y * z) % 256)


def value(x, y, z):
    return (7 * x * x + 13 * y * y + 29 * z * z + x * y * z) % 256


@pytest.mark.parametrize("halo", [0, 1, 3])
def test_bricks_hold_their_voxels_and_halo(volume, halo):
    for b in blocks.brick_arrays(volume, DIMS, 4, halo).collect():
        span = [range(max(4 * i - halo, 0), min(4 * i + 4 + halo, n)) for i, n in zip((b.bx, b.by, b.bz), DIMS, strict=True)]
        assert [b.x0, b.y0, b.z0] == [s[0] for s in span] and [b.nx, b.ny, b.nz] == [len(s) for s in span]
        assert b.data == [value(x, y, z) for z, y, x in itertools.product(*reversed(span))]


def test_jitter_stays_in_the_voxel(volume):
    rows = blocks.jittered_points(volume, DIMS).collect()
    assert len(rows) == math.prod(DIMS)
    assert all(value(int(r.px * 10), int(r.py * 7), int(r.pz * 9)) == r.v for r in rows)


def test_transfer_tables(spark):
    rows = tf.evenly(spark, [(0.0, 0.005), (0.5, 1.0), (1.0, 0.2)], 5).orderBy("i").collect()
    assert [round(r.a, 4) for r in rows] == [0.0, 0.5025, 1.0, 0.6, 0.2]
    coloured = tf.with_colours(tf.evenly(spark, [(0.0, 1.0), (1.0, 1.0)], 3), [(0, 0, 0), (1, 0.5, 0)]).orderBy("i").collect()
    assert [(r.r, r.g, r.b) for r in coloured] == [(0, 0, 0), (0.5, 0.25, 0), (1, 0.5, 0)]
    bumps = [r.a for r in tf.gaussians(spark, [(0.5, 0.1, 0.8), (0.5, 0.1, 0.8)], 11).orderBy("i").collect()]
    assert bumps[5] == 1.0 and bumps[0] < 0.01 and bumps == bumps[::-1] or max(abs(a - b) for a, b in zip(bumps, bumps[::-1], strict=True)) < 1e-9


def test_metrics(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0.5), ("a", 0.25)], "run string, seconds double")
    assert blocks.timing_summary(rows, "run").first()[1:] == (2, 0.75, 0.375, 2 / 0.75)
    for _ in range(2):
        blocks.append_metrics(rows, str(tmp_path / "log"))
    assert spark.read.option("header", True).csv(str(tmp_path / "log")).count() == 4
