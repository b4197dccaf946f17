"""Volumes that lack voxels: a last slice that is not full, and gaps."""

import math

import duckdb
import pytest
from gridloom.operators import blocks, lines, sampling
from gridloom.plans import volume_queries
from gridloom.sources import raw
from pyspark.sql import functions as F

#: Four by three voxels a slice; slices 2 and 3 are missing and the last one is not full.
PLACES = [(x, y, z) for z in (0, 1, 4) for y in range(3) for x in range(4) if z < 4 or (x + 4 * y) < 6]


def volume(spark, places=PLACES):
    return spark.createDataFrame([(x, y, z, x + 10.0 * y + 100.0 * z) for x, y, z in places], "x int, y int, z int, v double")


def test_raw_volumes_keep_what_is_missing(spark, tmp_path):
    rows = volume(spark).union(spark.createDataFrame([(3, 1, 4, None), (0, 2, 4, float("nan"))], "x int, y int, z int, v double"))
    path = str(tmp_path / "v")
    raw.write_raw_volume(rows, path, (4, 3))
    got = raw.read_written(spark, path, 4, 3)
    assert sorted(map(str, got.drop("t").collect())) == sorted(map(str, rows.collect()))
    drawn = raw.read_written(spark, path, 4, 3, fraction=3.0, replacement="true")
    assert drawn.drop("copy", "v").distinct().join(rows, ["x", "y", "z"], "left_anti").count() == 0
    assert drawn.filter("copy = 0 and z = 4").count() in (0, 8)
    raw.write_raw_series(volume(spark).withColumn("t", F.lit(3)), str(tmp_path / "s"))
    assert raw.read_written(spark, str(tmp_path / "s"), 4, 3, "t = 3 and z = 4").count() == 6


def test_raw_volumes_refuse_what_they_cannot_hold(spark, tmp_path):
    with pytest.raises(Exception, match="two voxels"):
        raw.write_raw_volume(volume(spark, [(0, 0, 0), (0, 0, 0)]), str(tmp_path / "a"), (4, 3))
    with pytest.raises(Exception, match="outside"):
        raw.write_raw_volume(volume(spark), str(tmp_path / "b"), (3, 3))
    raw.write_raw_volume(volume(spark), str(tmp_path / "c"), (4, 3))
    with pytest.raises(ValueError, match="slices of"):
        raw.read_written(spark, str(tmp_path / "c"), 5, 3)


def embeddings(spark, path, ids):
    rows = [(i, [((i * 7 + k * 3) % 17) / 17 - 0.5 for k in range(64)], 0) for i in ids]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


#: Vectors of a grid whose last slice is not full.
IDS = [*range(335), 336]


def equals_sql(spark, path, *names):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{path}/embeddings.parquet/*.parquet'")
    for name in names:
        df = volume_queries.queries()[name](spark, path)
        columns = sorted(df.columns)
        result = con.execute(volume_queries.oracle_sql()[name])
        at = [[d[0] for d in result.description].index(c) for c in columns]
        got, want = sorted(tuple(r[c] for c in columns) for r in df.collect()), sorted(tuple(r[i] for i in at) for r in result.fetchall())
        assert len(got) == len(want) and len(got) > 0, name
        assert all(x == y or math.isclose(x, y, abs_tol=2e-6) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True)), name


def test_formula_of_given_voxels(spark, tmp_path):
    equals_sql(spark, embeddings(spark, tmp_path, IDS), "s8_procedural")
    far = blocks.formula_values(spark.createDataFrame([(0, 0, 30_000)], "x int, y int, z int"), lambda x, y, z: 29 * z * z)
    assert far.first().v == 29 * 30_000**2


def test_slabs_decode_the_voxels_that_there_are(spark, tmp_path):
    equals_sql(spark, embeddings(spark, tmp_path, IDS), "a19_by_slabs")


def test_samples_keep_their_voxel(spark):
    """A place just below a border, which would be on it if it were scaled down and up again."""
    below = next(p for n in range(5, 600) for p in [math.nextafter(k, 0) for k in range(1, n)] if math.floor(p / n * n) != math.floor(p))
    n = next(n for n in range(5, 600) if math.floor(below / n * n) != math.floor(below))
    points = spark.createDataFrame([(0, below, 0.5, 0.5)], "point_id int, px double, py double, pz double")
    voxels = spark.range(n).selectExpr("cast(id as int) as x", "0 as y", "0 as z", "cast(id as double) as v")
    assert sampling.nearest(points, voxels, n, 1, 1, unit=False).first().v == math.floor(below)


def test_rounds_number_the_samples_that_there_are(spark, tmp_path):
    equals_sql(spark, embeddings(spark, tmp_path, IDS), "f7_frontier_opaque", "f7_frontier")


def test_stretches_of_rays_are_not_broadcast(spark):
    """Spark guesses that many rays from a small file are smaller than the cells they cross."""
    rays = lines.make_rays(spark, 4, 4, (80.0, 33.0, -9.0), (30.0, 9.0, 9.0), (0.1, 1.0, 0.2))
    cells = spark.range(100_000).selectExpr("cast(id as int) as cx", "0 as cy", "0 as cz", "0.5 as max_opacity")
    plan = lines.live_stretches(rays, cells, (64, 20, 18))._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan
