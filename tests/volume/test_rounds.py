"""Marching in rounds, sheared sweeps, brick sampling, scans, pushed conditions, streams with resets and slabs."""

import math
import random

import numpy as np
import pytest
from gridloom.functions import scalars as S
from gridloom.operators import blocks, brick_sampling, cells, frontier, isosurface, line_bricks, lines, pyramid, quality, sampling, scan, shear, slabs
from gridloom.sources import raw
from gridloom.sources.tables import forget, stored
from gridloom.streaming import fitting, resets, summaries
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual

DIMS = (18, 9, 13)


def volume_of(spark, formula):
    x, y, z = S.coordinates(F.col("id"), *DIMS[:2])
    rows = spark.range(math.prod(DIMS)).select(x.alias("x"), y.alias("y"), z.alias("z"))
    return rows.withColumn("v", formula(F.col("x"), F.col("y"), F.col("z")).cast("double"))


@pytest.fixture(scope="module")
def waves(spark):
    return volume_of(spark, lambda x, y, z: 0.5 + 0.5 * F.sin(x * 0.7 + y * 0.4) * F.cos(z * 0.5)).cache()


@pytest.fixture(scope="module")
def two(waves):
    return cells.stack_steps([waves, waves.withColumn("v", 1 - F.col("v"))]).cache()


def opaque_cells(voxels, *keys):
    return cells.macrocells(voxels, *DIMS, *keys).withColumn("max_opacity", F.col("vmax") * 0.4)


def rays(spark):
    rng = random.Random(4)
    rows = [(i, *(rng.uniform(-5, 25) for _ in "xyz"), *(rng.uniform(-1, 1) or 0.1 for _ in "xyz")) for i in range(60)]
    rows += [(100, 5.0, 4.0, -3.0, 0.0, 0.0, 1.0), (101, 50.0, 50.0, 50.0, 1.0, 0.0, 0.0)]
    return spark.createDataFrame(rows, "ray_id long, ox double, oy double, oz double, dx double, dy double, dz double")


@pytest.mark.parametrize(("first", "rate"), [(2, 6.0), (16, 0.5), (1000, 6.0)])
def test_rounds_give_the_picture_of_marching(spark, waves, first, rate):
    given, own = rays(spark), opaque_cells(waves)
    transfer = lambda v: v * 0.4
    colours = {"v": lambda v: v, "dark": lambda v: 1 - v}
    got = {r.ray_id: r for r in frontier.frontier_march(given, waves, own, DIMS, transfer, colours, 0.5, rate, first=first).collect()}
    samples = lines.march(given, waves, own, DIMS, transfer, 0.5, rate).withColumn("dark", 1 - F.col("v"))
    lit = lines.visible(lines.transmittance(samples, ["ray_id"], "k"))
    want = {r.ray_id: r for r in lines.composite(lit, ["ray_id"], ["v", "dark"]).collect()}
    every = {r.ray_id: r["count"] for r in samples.groupBy("ray_id").count().collect()}
    assert got.keys() == want.keys() and 100 in got and 101 not in got
    for i, r in got.items():
        assert all(math.isclose(r[c], want[i][c], abs_tol=1e-9) for c in ("v", "dark", "alpha"))
        assert math.isclose(r.clear, 1 - r.alpha, abs_tol=1e-9) and r.looked <= every[i]
    looked = sum(r.looked for r in got.values())
    assert looked < 0.8 * sum(every.values()) if (first, rate) == (2, 6.0) else looked <= sum(every.values())


def test_chunks():
    bounds = [16 * (2**c - 1) for c in range(12)]
    assert bounds[:4] == [0, 16, 48, 112]


def test_chunk_numbers(spark):
    rows = spark.range(3000).select("id", frontier.chunk_of(F.col("id"), 16).alias("c")).collect()
    assert all(16 * (2**r.c - 1) <= r.id < 16 * (2 ** (r.c + 1) - 1) for r in rows)


def test_rounds_of_series_and_of_nothing(spark, two):
    given, own, transfer = rays(spark), opaque_cells(two, "t"), lambda v: v * 0.4
    got = frontier.frontier_march(given, two, own, DIMS, transfer, {"v": lambda v: v}, 0.5, 2.0, first=4).collect()
    for t in (0, 1):
        alone = frontier.frontier_march(given, two.filter(f"t = {t}").drop("t"), own.filter(f"t = {t}").drop("t"), DIMS, transfer, {"v": lambda v: v}, 0.5, 2.0, first=4).collect()
        assert {r.ray_id: round(r.v, 9) for r in got if r.t == t} == {r.ray_id: round(r.v, 9) for r in alone}
    dark = own.withColumn("max_opacity", F.lit(0.0))
    assert frontier.frontier_march(given, two, dark, DIMS, transfer, {"v": lambda v: v}).collect() == []


WAYS = [(0, 0.6, 0.1, 0.8, 0.5), (1, -0.9, 0.3, -0.2, 0.3), (2, 0.2, -1.0, 0.4, 0.2)]


def test_sheared_sweeps_against_lines(spark, waves):
    """Each of three lights is swept along another axis; against lines with short steps the light differs by less than 0.01 on
    average and 0.06 anywhere."""
    lights = spark.createDataFrame(WAYS, "light_id long, x double, y double, z double, intensity double")
    transfer = lambda v: v * 0.4
    exact = lines.shadow(waves, opaque_cells(waves), spark.createDataFrame([(i, *(c / math.sqrt(x * x + y * y + z * z) for c in (x, y, z)), w) for i, x, y, z, w in WAYS], lights.schema), DIMS, transfer, 0.25, 0.3)
    got = shear.sheared_shadow(waves, lights, DIMS, transfer, 0.3).withColumnRenamed("light", "swept")
    off = exact.join(got, ["x", "y", "z"]).select(F.abs(F.col("light") - F.col("swept")).alias("e")).agg(F.avg("e"), F.max("e"), F.count("*")).first()
    assert off[2] == math.prod(DIMS) and off[0] < 0.01 and off[1] < 0.06


def test_sheared_sweep_along_an_axis_is_a_running_product(spark, waves):
    lights = spark.createDataFrame([(0, 0.0, 0.0, -2.0, 1.0)], "light_id long, x double, y double, z double, intensity double")
    got = {(r.x, r.y, r.z): r.light for r in shear.sheared_shadow(waves, lights, DIMS, lambda v: v * 0.4).collect()}
    values = {(r.x, r.y, r.z): r.v for r in waves.collect()}
    for (x, y, z), light in got.items():
        want = math.prod(1 - 0.4 * values[x, y, k] for k in range(z)) * math.sqrt(1 - 0.4 * values[x, y, z])
        assert math.isclose(light, want, rel_tol=1e-9)


def test_shadows_keep_steps_apart(spark, two):
    lights = spark.createDataFrame(WAYS[:1], "light_id long, x double, y double, z double, intensity double")
    own, transfer = opaque_cells(two, "t"), lambda v: v * 0.4
    kinds = {
        "lines": lambda v, c: lines.shadow(v, c, lights, DIMS, transfer, 2.0),
        "shear": lambda v, c: shear.sheared_shadow(v, lights, DIMS, transfer),
        "axis": lambda v, c: lines.axis_shadow(v.withColumn("a", F.col("v") * 0.4), spark.createDataFrame([("z", 1, 0.5), ("x", -1, 0.5)], "axis string, sign int, intensity double")),
    }
    for kind, light in kinds.items():
        both = light(two, own).collect()
        assert len(both) == 2 * math.prod(DIMS), kind
        for t in (0, 1):
            alone = light(two.filter(f"t = {t}").drop("t"), own.filter(f"t = {t}").drop("t")).collect()
            assert {(r.x, r.y, r.z): round(r.light, 9) for r in both if r.t == t} == {(r.x, r.y, r.z): round(r.light, 9) for r in alone}, kind


@pytest.mark.parametrize(("size", "crowd"), [(4, 7), (16, 100_000)])
def test_bricks_sample_like_the_join(spark, two, size, crowd):
    points = sampling.random_points(spark, 500, 3).withColumn("px", F.when(F.col("point_id") < 200, 0.51).otherwise(F.col("px")))
    gaps = two.filter("(x + 2 * y + 3 * z + t) % 4 > 0 and not (x < 5 and y < 5 and z < 5)")
    for voxels in (two, gaps):
        want = {(r.t, r.point_id): r.v for r in sampling.trilinear(points, voxels, *DIMS).collect()}
        got = {(r.t, r.point_id): r.v for r in brick_sampling.trilinear_by_bricks(points, voxels, *DIMS, size=size, crowd=crowd).collect()}
        assert got.keys() == want.keys() and all(math.isclose(v, want[k], abs_tol=1e-12) for k, v in got.items())
    one = points.withColumn("t", (F.col("point_id") % 2).cast("int"))
    assert brick_sampling.trilinear_by_bricks(one, two, *DIMS, size=size).count() == 500


@pytest.mark.parametrize(("size", "crowd"), [(16, 50), (64, 10**6)])
def test_lines_are_sampled_in_their_bricks(spark, two, size, crowd):
    gaps = two.filter("(x + 2 * y + 3 * z + t) % 5 > 0")
    boxed = lines.box_interval(rays(spark), (0, 0, 0), DIMS)
    samples = lines.samples_on_lines(lines.cells_on_lines(boxed, DIMS), 0.4)
    want = {(r.t, r.ray_id, r.k): (r.dist, r.v) for r in sampling.nearest(samples, gaps, *DIMS, unit=False).collect()}
    found = line_bricks.samples_by_bricks(boxed, gaps, DIMS, 0.4, blend=False, size=size, crowd=crowd)
    assert {(r.t, r.ray_id, r.k): (r.dist, r.v) for r in found.collect()} == want and len(want) > 100
    assert line_bricks.pieces_on_lines(boxed, DIMS, size).count() < samples.count() / 5

    live = opaque_cells(gaps, "t").filter("(cx + t) % 2 = 0")
    kept = lines.samples_on_lines(lines.live_stretches(rays(spark), live, DIMS), 0.4)
    want = {(r.t, r.ray_id, r.k): round(r.v, 9) for r in sampling.trilinear_by_corners(kept, sampling.corner_table(gaps), DIMS).collect()}
    found = line_bricks.samples_by_bricks(boxed, gaps, DIMS, 0.4, live, size=size, crowd=crowd)
    assert {(r.t, r.ray_id, r.k): round(r.v, 9) for r in found.collect()} == want and len(want) > 50


def test_shadows_send_no_samples(spark, waves, monkeypatch):
    lights = spark.createDataFrame(WAYS, "light_id long, x double, y double, z double, intensity double")
    own, transfer = opaque_cells(waves), lambda v: v * 0.4
    given = [lines.box_interval(waves.select("x", "y", "z", *[(F.col(a) + 0.5).alias(f"o{a}") for a in "xyz"], *[F.lit(float(w[1 + i])).alias(f"d{a}") for i, a in enumerate("xyz")], F.lit(w[4]).alias("shine")), (0, 0, 0), DIMS) for w in WAYS]
    lost = {}
    for each in given:
        ids = each.withColumn("ray_id", F.struct("x", "y", "z", "shine")).drop("x", "y", "z", "t0", "t1")
        for r in lines.line_transmittance(lines.march(ids, waves, own, DIMS, transfer, 2.0, adaptive=False), ["ray_id"]).collect():
            lost[r.ray_id[:3]] = lost.get(r.ray_id[:3], 0.0) + (1 - r.clear) * r.ray_id.shine
    monkeypatch.setattr(lines, "samples_on_lines", None)
    got = {(r.x, r.y, r.z): r.light for r in lines.shadow(waves, own, lights, DIMS, transfer, 2.0).collect()}
    assert len(got) == math.prod(DIMS)
    assert all(math.isclose(v, sum(w[4] for w in WAYS) - lost.get(k, 0.0), abs_tol=1e-9) for k, v in got.items())


def test_cells_are_put_together_in_bricks(spark, two, monkeypatch):
    gaps = two.filter("(x + y + z + t) % 7 > 0")
    there = {(r.t, r.x, r.y, r.z): r.v for r in gaps.collect()}
    want = {}
    for t, x, y, z in there:
        found = [there.get((t, x + a, y + b, z + c)) for a, b, c in isosurface.CORNERS]
        if None not in found:
            want[t, x, y, z] = found
    got = {(r.t, r.x, r.y, r.z): [r[f"f{k}"] for k in range(8)] for r in isosurface.corners(gaps, *DIMS, size=4).collect()}
    assert got == want and len(want) > 100
    kept, reads = isosurface.kept, []
    monkeypatch.setattr(isosurface, "kept", lambda rows, name: reads.append(name) or kept(rows, name))
    sums = isosurface.offsets(isosurface.active(isosurface.corners(gaps, *DIMS), 0.5), block=8)
    assert reads == ["cells"]  # the levels read what is kept
    rows = sorted((r.t, r.cell_id, r.n_verts, r.first) for r in sums.collect())
    assert all(b[3] == (a[3] + a[2] if a[0] == b[0] else 0) for a, b in zip(rows, rows[1:], strict=False)) and rows[0][3] == 0


def test_scan_in_levels(spark):
    rng = random.Random(2)
    rows = [(t, i, rng.randint(0, 5)) for t in (1, 2) for i in sorted(rng.sample(range(1000), 200))]
    df = spark.createDataFrame(rows, "t int, cell long, n long").repartition(3)
    assert scan.levels_for(999, 4) == 4 and scan.levels_for(None) == scan.levels_for(4095) == 0
    for block in (4, 4096):
        got = {(r.t, r.cell): r.first for r in scan.running_sums(df, "cell", "n", ["t"], block).collect()}
        assert got == {(t, i): sum(n for s, j, n in rows if s == t and j < i) for t, i, _ in rows}
    assert scan.running_sums(df.limit(0), "cell", "n", ["t"]).collect() == []


def test_meshes_of_a_series(spark, two, tmp_path):
    found = isosurface.active(isosurface.corners(two, *DIMS), 0.5)
    isosurface.write_obj(isosurface.vertices(found, 0.5), str(tmp_path / "obj"))
    for t in (0, 1):
        text = spark.read.text(str(tmp_path / "obj" / f"t={t}"))
        faces = text.filter("value like 'f %'").count()
        assert text.filter("value like 'v %'").count() == 3 * faces == found.filter(f"t = {t}").agg(F.sum("n_verts")).first()[0]
        assert text.filter("value = 'f 1 2 3'").count() == 1


def test_pushed_conditions(spark, tmp_path):
    dims = (4, 50, 40)
    for t in range(3):
        (np.arange(math.prod(dims), dtype="<f4") + 100_000 * t).tofile(tmp_path / f"s{t}.raw")
    paths = [str(tmp_path / f"s{t}.raw") for t in range(3)]
    options = {"path": ",".join(paths), "dims": "4,50,40", "slab": "8", "pushdown": "true"}

    def planned(*filters):
        reader = raw.PushedReader(options)
        assert list(reader.pushFilters(list(filters))) == list(filters)
        return len(reader.partitions()), reader.planned_bytes()

    whole = math.prod(dims) * 4
    assert planned() == (15, 3 * whole)
    assert planned(EqualTo(("t",), 1)) == (5, whole)
    assert planned(EqualTo(("t",), 1), GreaterThanOrEqual(("z",), 8), LessThan(("z",), 16)) == (1, whole // 5)
    assert planned(In(("t",), (1, 2)), GreaterThan(("y",), 9), LessThanOrEqual(("y",), 14)) == (10, 2 * whole // 10)
    assert planned(EqualTo(("t",), 9)) == (0, 0) and planned(LessThan(("v",), 5.0)) == (15, 3 * whole)
    condition = "t >= 1 and z >= 8 and z < 16 and y > 9 and y <= 14 and x = 2"
    part = raw.read_where(spark, paths, dims, condition, slab=8)
    assert part.rdd.getNumPartitions() == 2
    want = raw.read_raw_volume(spark, paths, dims).filter(condition)
    assert sorted(part.collect()) == sorted(want.collect()) and part.count() == 2 * 8 * 5
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")


def test_blocks_are_drawn_with_replacement(spark, tmp_path):
    dims = (8192, 3, 50)  # a row is a block
    np.arange(math.prod(dims), dtype="<f4").tofile(tmp_path / "v.raw")
    draws = raw.read_raw_volume(spark, str(tmp_path / "v.raw"), dims, fraction=2.0, replacement="true").filter("x = 7").groupBy("y", "z").agg(F.count("*").alias("n"), F.max("copy").alias("last"), F.min("v").alias("v")).collect()
    assert all(r.last == r.n - 1 and r.v == 7 + 8192 * (r.y + 3 * r.z) for r in draws)
    assert 220 < sum(r.n for r in draws) < 380 and max(r.n for r in draws) > 3 and len(draws) < 150
    shares = np.bincount([raw.times_drawn(u, 1.5) for u in np.linspace(0, 1, 20_001)[:-1]]) / 20_000
    assert np.allclose(shares[:4], [math.exp(-1.5) * 1.5**k / math.factorial(k) for k in range(4)], atol=1e-3)
    with pytest.raises(ValueError, match="mounted"):
        raw.plain_path("hdfs://host/volumes")


def test_mean_of_epoch_any_order(spark, tmp_path):
    rows = [("a", 0, 1.0), ("a", 1, 5.0), ("a", 0, 9.0), ("b", 0, 2.0), ("a", 1, 7.0), ("b", 0, None), ("c", None, 1.0)]
    for order in (rows, rows[::-1]):
        path = str(tmp_path / f"in{order[0][0]}")
        for row in order:
            spark.createDataFrame([row], "k string, epoch int, v double").coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema("k string, epoch int, v double").option("maxFilesPerTrigger", 1).parquet(path)
        resets.start_means(resets.mean_of_epoch(stream, ["k"]), f"{path}-log", summaries.table_sink(f"{path}-out"), "update").awaitTermination()
        last = summaries.latest(spark.read.parquet(f"{path}-out"), "k").select("k", "epoch", "mean", "frames")
        assert sorted(map(tuple, last.collect())) == [("a", 1, 6.0, 2), ("b", 0, 2.0, 1)]


def test_mean_between_reads(spark, tmp_path):
    path = str(tmp_path / "in")
    batches = [[("r", 1, 2.0, False), ("r", 2, 4.0, False)], [("r", 5, None, True), ("r", 3, 6.0, None), ("s", 1, 1.0, False), ("r", 6, 0.0, True), ("r", 7, 8.0, False)], [("r", 9, 0.0, True), ("s", 2, None, False), ("s", 3, 0.0, True)]]
    for batch in batches:
        spark.createDataFrame(batch, "run string, step long, loss double, is_read boolean").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("run string, step long, loss double, is_read boolean").option("maxFilesPerTrigger", 1).parquet(path)
    resets.start_means(resets.mean_between_reads(stream, ["run"]), str(tmp_path / "log"), summaries.table_sink(str(tmp_path / "out")), "append").awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("run", "step", "mean", "count").collect()))
    assert got == [("r", 5, 4.0, 3), ("r", 6, None, 0), ("r", 9, 8.0, 1), ("s", 3, 1.0, 1)]


@pytest.mark.parametrize("blend", [False, True])
def test_stream_fit_goes_on(spark, waves, tmp_path, blend):
    """A fit that fails midway goes on, and voxels that come later are fitted as if they had been there."""
    config = pyramid.Config(levels=2, base=4, log2_slots=7, blend=blend)
    source, path = str(tmp_path / "in"), str(tmp_path / "fit")
    read = lambda: spark.readStream.schema(waves.schema).option("maxFilesPerTrigger", 1).parquet(source)
    same = lambda a, b: {(r.level, r.slot): (round(r.mean, 9), r.n) for r in a.collect()} == {(r.level, r.slot): (round(r.mean, 9), r.n) for r in b.collect()}
    for part in ("z < 6", "z >= 6 and z < 9"):
        waves.filter(part).coalesce(1).write.mode("append").parquet(source)
    fitting.run_level(read, spark, 0, [], DIMS, config, f"{path}/level=0")  # and then it failed
    assert same(fitting.fit_stream(spark, read, DIMS, config, path), pyramid.fit(waves.filter("z < 9"), DIMS, config))
    waves.filter("z >= 9").coalesce(1).write.mode("append").parquet(source)
    assert same(fitting.fit_stream(spark, read, DIMS, config, path), pyramid.fit(waves, DIMS, config))


@pytest.mark.parametrize("blend", [False, True])
def test_grids_of_series(spark, two, blend):
    config = pyramid.Config(levels=2, base=4, log2_slots=7, blend=blend)
    model = pyramid.fit(two, DIMS, config)
    got = pyramid.reconstruct(two, model, DIMS, config).collect()
    for t in (0, 1):
        own = two.filter(f"t = {t}").drop("t")
        alone = pyramid.reconstruct(own, pyramid.fit(own, DIMS, config), DIMS, config).collect()
        assert {(r.x, r.y, r.z): round(r.v, 9) for r in got if r.t == t} == {(r.x, r.y, r.z): round(r.v, 9) for r in alone}
    wide = pyramid.reconstruct(two.filter("t = 0").drop("t"), model, DIMS, config)
    assert wide.count() == 2 * math.prod(DIMS)


def test_slabs_wrap_around(spark, waves, tmp_path):
    config = pyramid.Config(levels=2, base=4, log2_slots=7)
    model, path = pyramid.fit(waves, DIMS, config), str(tmp_path / "out")
    assert [slabs.decode_next(model, DIMS, config, path, thick=5) for _ in range(4)] == [0, 1, 2, 0]
    assert slabs.cursor(spark, path) == (4, 1)
    got = {(r.x, r.y, r.z): r.v for r in slabs.decoded(spark, path).collect()}
    assert got == {(r.x, r.y, r.z): r.v for r in pyramid.reconstruct(waves, model, DIMS, config).collect()}


def test_calls_decode_several_slabs(spark, waves, tmp_path):
    config = pyramid.Config(levels=2, base=4, log2_slots=7)
    model, path = pyramid.fit(waves, DIMS, config), str(tmp_path / "out")
    count = slabs.slab_count(DIMS[2], 2)
    firsts = [slabs.decode_next(model, DIMS, config, path, thick=2, voxels=cells.slabs(waves, 2).select("x", "y", "z", "slab"), slabs=3) for _ in range(-(-count // 3) + 1)]
    assert firsts == [*range(0, count, 3), 0] and slabs.cursor(spark, path) == (len(firsts), 3)
    got = {(r.x, r.y, r.z, r.slab): r.v for r in slabs.decoded(spark, path).collect()}
    assert got == {(r.x, r.y, r.z, r.z // 2): r.v for r in pyramid.reconstruct(waves, model, DIMS, config).collect()}
    assert slabs.slabs_per_call((64, 20, 30_000)) == 819 and slabs.slabs_per_call((2000, 2000, 2000)) == 1 and slabs.slabs_per_call((4, 4, 40)) == 3


def test_box_sums_on_a_grid_with_gaps(two):
    gaps = two.filter("(x + 2 * y + 3 * z + t) % 3 > 0").withColumn("v", F.round(F.col("v") * 100).cast("long"))
    there = {(r.t, r.x, r.y, r.z): r.v for r in gaps.collect()}
    got = {(r.t, r.x, r.y, r.z): r.v for r in quality.box_sums(gaps, ["v"], (1, 2, 0), sparse=True).collect()}
    assert got == {(t, x, y, z): sum(there.get((t, x + i, y + j, z), 0) for i in (-1, 0, 1) for j in range(-2, 3)) for t, x, y, z in there}


def test_jitter_of_copies_and_stored_tables(spark, two):
    drawn = two.filter("x < 3").withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    points = blocks.jittered_points(drawn, DIMS)
    assert points.columns == ["t", "px", "py", "pz", "v"] and points.distinct().count() == drawn.count()
    kept = stored(two, "kept")
    assert kept.count() == two.count()
    forget(kept)
    with pytest.raises(Exception, match="(?i)exist|not found"):
        kept.count()


def test_stacked_steps_must_be_alike(waves):
    assert cells.stack_steps([waves, waves], [DIMS, DIMS]).count() == 2 * math.prod(DIMS)
    for steps, dims in (([waves, waves.withColumn("v", F.col("v").cast("float"))], None), ([waves, waves.drop("v")], None), ([waves, waves], [DIMS, (1, 2, 3)]), ([waves, waves], [DIMS])):
        with pytest.raises(ValueError, match="differ"):
            cells.stack_steps(steps, dims)
