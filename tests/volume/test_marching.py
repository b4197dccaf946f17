"""Shadows, blended hash grids, raw volumes over older ones and streams of several files, on small volumes."""

import math

import pytest
from gridloom.functions import scalars as S
from gridloom.operators import lines, models, pyramid
from gridloom.sources import raw
from gridloom.streaming import summaries
from pyspark.sql import functions as F

DIMS = (18, 3, 5)


@pytest.fixture(scope="module")
def ones(spark):
    x, y, z = S.coordinates(F.col("id"), *DIMS[:2])
    return spark.range(math.prod(DIMS)).select(x.alias("x"), y.alias("y"), z.alias("z"), F.lit(1.0).alias("v")).cache()


def cells_of(spark, opacity):
    return spark.createDataFrame([(0, 0, 0, opacity), (1, 0, 0, opacity)], "cx int, cy int, cz int, max_opacity double")


def test_shadow_of_an_even_volume(spark, ones):
    """The light left is 0.7 to the power of the way through the volume, however it is cut into samples."""
    lights = [(0, 0.6, 0.0, 0.8, 0.75), (1, -1 / 3, 2 / 3, -2 / 3, 0.25)]
    given = spark.createDataFrame(lights, "light_id long, x double, y double, z double, intensity double")
    got = lines.shadow(ones, cells_of(spark, 0.3), given, DIMS, lambda v: v * 0.3, 2.0).collect()
    assert len(got) == math.prod(DIMS)
    for r in got:
        want = 0.0
        for _, *way, intensity in lights:
            ends = [((n if d > 0 else 0) - (p + 0.5)) / d for p, n, d in zip((r.x, r.y, r.z), DIMS, way, strict=True) if d]
            want += intensity * 0.7 ** min(ends)
        assert math.isclose(r.light, want, rel_tol=1e-9)


def test_shadow_without_matter_or_lights(spark, ones):
    given = lines.random_directions(spark, 3)
    assert {round(r.light, 9) for r in lines.shadow(ones, cells_of(spark, 0.0), given, DIMS, lambda v: v * 0.3).collect()} == {1.0}
    assert {r.light for r in lines.shadow(ones, cells_of(spark, 0.3), given.limit(0), DIMS, lambda v: v * 0.3).collect()} == {0.0}


def test_random_directions(spark):
    a, b = lines.random_directions(spark, 50).collect(), lines.random_directions(spark, 50).repartition(3).collect()
    assert sorted(a) == sorted(b) and a != lines.random_directions(spark, 50, 7).collect()
    assert all(math.isclose(r.x**2 + r.y**2 + r.z**2, 1.0) and r.intensity == 1 / 50 for r in a)


def test_blended_grid_keeps_an_even_volume(spark, ones, tmp_path):
    config = pyramid.Config(levels=2, base=4, log2_slots=6, blend=True)
    model = pyramid.fit(ones, DIMS, config)
    got = pyramid.reconstruct(ones, model, DIMS, config).collect()
    assert len(got) == math.prod(DIMS) and all(math.isclose(r.v, 1.0, abs_tol=1e-9) for r in got)
    models.save(model, str(tmp_path), "ones", DIMS, config)
    assert models.load(spark, str(tmp_path), "ones")[2] == config


def test_a_volume_takes_the_place_of_an_older_one(spark, ones, tmp_path):
    path = str(tmp_path / "v")
    raw.write_raw_volume(ones, path)
    raw.write_raw_volume(ones.filter("z < 2").withColumn("v", F.lit(3.0)), path)
    back = raw.read_written(spark, path, *DIMS[:2])
    assert back.agg(F.count("*"), F.min("v"), F.max("z")).first() == (18 * 3 * 2, 3.0, 1)
    assert raw.read_written(spark, path, *DIMS[:2], z_from=1).select("z").distinct().collect() == [(1,)]


def test_losses_of_several_batches(spark, tmp_path):
    for n, loss in enumerate((0.99, 0.97, 0.2)):
        spark.createDataFrame([("a", 6000 + n, loss), ("b", 6000 + n, 0.95)], "run string, step long, loss double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("run string, step long, loss double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    put = summaries.table_sink(str(tmp_path / "out"))

    def twice(batch, number):
        put(batch, number)
        put(batch, number)

    summaries.start_losses(stream, str(tmp_path / "c"), twice).awaitTermination()
    means = summaries.latest(spark.read.parquet(str(tmp_path / "out")), "run", "window")
    assert {(r.run, round(r.loss, 9), r.step) for r in means.collect()} == {("a", 0.72, 6002), ("b", 0.95, 6002)}
    assert [r.run for r in summaries.alerts(means).collect()] == ["b"]
