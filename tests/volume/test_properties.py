import itertools
import json
import math
import random

import numpy as np
import pytest
from gridloom.functions import scalars as S
from gridloom.operators import cells, isosurface, lines, models, pyramid, quality, sampling
from gridloom.sources import raw, scene
from gridloom.streaming import summaries
from pyspark.sql import functions as F

DIMS = (19, 7, 18)


@pytest.fixture(scope="module")
def volume(spark):
    nx, ny, nz = DIMS
    x, y, z = S.coordinates(F.col("id"), nx, ny)
    rows = spark.range(nx * ny * nz).select(x.alias("x"), y.alias("y"), z.alias("z"))
    return rows.withColumn("v", ((7 * F.col("x") * F.col("x") + 13 * F.col("y") * F.col("y") + 29 * F.col("z") + F.col("x") * F.col("y") * F.col("z")) % 256 / 256.0)).cache()


@pytest.fixture(scope="module")
def dense(volume):
    a = np.zeros(DIMS)
    for r in volume.collect():
        a[r.x, r.y, r.z] = r.v
    return a


def test_macrocells_cover_one_voxel_more(volume, dense):
    got = {(r.cx, r.cy, r.cz): (r.vmin, r.vmax) for r in cells.macrocells(volume, *DIMS).collect()}
    assert set(got) == set(itertools.product(*[range(S.cell_count(n)) for n in DIMS]))
    for c, span in got.items():
        part = dense[tuple(slice(max(16 * i - 1, 0), 16 * i + 17) for i in c)]
        assert span == (part.min(), part.max())


def test_trilinear_at_centres_is_the_voxel(spark, volume):
    points = volume.withColumn("point_id", S.linear_id(F.col("x"), F.col("y"), F.col("z"), *DIMS[:2])).select("point_id", *[S.centre(F.col(a), n).alias(f"p{a}") for a, n in zip("xyz", DIMS, strict=True)], F.col("v").alias("want"))
    rows = sampling.trilinear(points, volume, *DIMS).join(points, "point_id")
    assert rows.count() == math.prod(DIMS) and rows.filter(F.abs(F.col("v") - F.col("want")) > 1e-9).count() == 0


def test_a_field_of_the_user_and_repeatable_points(spark):
    a, b = sampling.random_points(spark, 100), sampling.random_points(spark, 100).repartition(3)
    assert sorted(a.collect()) == sorted(b.collect())
    got = sampling.sample_field(a, lambda x, y, z: x + 2 * y).collect()
    assert all(math.isclose(r.v, r.px + 2 * r.py) and 0 <= r.pz < 1 for r in got)
    with pytest.raises(ValueError):
        sampling.grid_points(spark, 1, 5, 5, nodes=True)


def test_equal_volumes(volume):
    same = quality.align(volume, volume, strict=True)
    assert quality.psnr(same).first().psnr == math.inf
    assert math.isclose(quality.ssim(volume, volume, DIMS).first().mssim, 1.0)
    with pytest.raises(Exception, match="grids differ"):
        quality.align(volume, volume.filter("x > 0"), strict=True).collect()


def test_isosurface_is_closed_and_on_the_surface(volume, dense):
    for case in range(256):
        edges = isosurface.case_edges(case)
        crossed = {i for i, (a, b) in enumerate(isosurface.EDGES) if (case >> a & 1) != (case >> b & 1)}
        assert set(edges) == crossed and len(edges) % 3 == 0
    active = isosurface.active(isosurface.corners(volume, *DIMS), 0.5)
    points = isosurface.vertices(active, 0.5)
    rows = isosurface.offsets(active).orderBy("cell_id").collect()
    assert [r.first for r in rows] == list(np.cumsum([0] + [r.n_verts for r in rows[:-1]])) and sum(r.n_verts for r in rows) == points.count()
    # an edge inside the grid belongs to two triangles, once in each direction
    near = {}
    for r in isosurface.triangles(active, 0.5).collect():
        corners = [tuple(round(r[p + a], 9) for a in "xyz") for p in "abc"]
        for a, b in zip(corners, corners[1:] + corners[:1], strict=True):
            near[a, b] = near.get((a, b), 0) + 1
    inside = lambda p: all(0.5 < c < n - 0.5 for c, n in zip(p, DIMS, strict=True))
    assert all(near.get((b, a)) == n for (a, b), n in near.items() if a != b and inside(a) and inside(b))


def test_lines_visit_each_cell_once(spark):
    data = [(0, 0.5, 0.5, -1.0, 0.3, 0.2, 1.0), (1, 16.0, 3.0, 0.0, 0.0, 0.0, 1.0), (2, -5.0, -5.0, -5.0, 1.0, 1.0, 1.0), (3, 30.0, 0.0, 0.0, 0.0, 1.0, 0.0)]
    rays = spark.createDataFrame(data, "ray_id long, ox double, oy double, oz double, dx double, dy double, dz double")
    box = lines.box_interval(rays, (0, 0, 0), (20, 20, 40))
    assert sorted(r.ray_id for r in box.collect()) == [0, 1, 2]
    steps = {}
    for r in lines.cells_on_lines(box, (20, 20, 40)).orderBy("ray_id", "step").collect():
        steps.setdefault(r.ray_id, []).append((r.cx, r.cy, r.cz))
    assert steps[2] == [(0, 0, 0), (1, 1, 1)] and steps[1] == [(1, 0, 0), (1, 0, 1), (1, 0, 2)] and len(steps[0]) == len(set(steps[0]))


def test_opaque_samples_end_a_line(spark):
    rows = spark.createDataFrame([(0, 0, 0.5), (0, 1, 1.0), (0, 2, 0.5)], "r int, k int, a double")
    seen = lines.transmittance(rows, ["r"], "k")
    assert [r.clear for r in seen.orderBy("k").collect()] == [1.0, 0.5, 0.0] and lines.visible(seen).count() == 2
    assert lines.line_transmittance(rows, ["r"]).first().clear == 0.0
    assert lines.composite(seen.withColumn("c", F.lit(1.0)), ["r"], ["c"]).first().alpha == 1.0


def test_pyramid_errors_fall_and_models_are_kept(spark, volume, tmp_path):
    errors = []
    for levels in (1, 2, 3):
        config = pyramid.Config(levels=levels, base=4, log2_slots=9)
        model = pyramid.fit(volume, DIMS, config)
        errors.append(quality.psnr(quality.align(volume, pyramid.reconstruct(volume, model, DIMS, config))).first().mse)
    assert errors[0] >= errors[1] >= errors[2]
    store = str(tmp_path)
    assert models.save(model, store, "m", DIMS, config, cells.macrocells(volume, *DIMS)) == 1
    assert models.save(model.filter("level = 0"), store, "m", DIMS, config) == 2
    back, dims, again, own = models.load(spark, store, "m", version=1)
    assert (dims, again) == (DIMS, config) and back.count() == model.count() and own.count() == 2 * 1 * 2
    assert models.load(spark, store, "m")[3] is None
    for bad in ({"dims": (1, 2, 3)}, {"version": 7}):
        with pytest.raises(ValueError):
            models.load(spark, store, "m", **bad)
    # an old format: no version, no dims, cells of eight voxels; and a model without parameters
    old = {"model": "old", "levels": 3, "base": 4, "scale": 2.0, "log2_slots": 9, "has_cells": True, "cell": 8}
    (tmp_path / "meta" / "old").mkdir()
    (tmp_path / "meta" / "old" / "row.json").write_text(json.dumps(old) + "\n" + json.dumps(old | {"model": "bare", "has_cells": False}))
    model.write.parquet(f"{store}/levels/model=old/version=1")
    eight = volume.groupBy(*[F.floor(F.col(a) / 8).cast("int").alias(f"c{a}") for a in "xyz"]).agg(F.min("v").alias("vmin"), F.max("v").alias("vmax"))
    eight.write.parquet(f"{store}/cells/model=old/version=1")
    with pytest.raises(ValueError):
        models.load(spark, store, "old")
    _, dims, again, own = models.load(spark, store, "old", dims=DIMS)
    assert (dims, again) == (DIMS, config)
    sixteen = volume.groupBy(*[F.floor(F.col(a) / 16).cast("int").alias(f"c{a}") for a in "xyz"]).agg(F.min("v").alias("vmin"), F.max("v").alias("vmax"))
    assert sorted(own.select("cx", "cy", "cz", "vmin", "vmax").collect()) == sorted(sixteen.collect())
    given = spark.createDataFrame([("old", *DIMS)], "model string, nx int, ny int, nz int")
    found = {r.model: r for r in models.describe(spark, store, given).collect()}
    assert [(found[m].version, found[m].has_dims, found[m].has_cells, found[m].has_parameters, found[m].corrected) for m in ("m", "old", "bare")] == [(2, True, False, True, False), (1, True, True, True, True), (1, False, False, False, False)]
    assert (found["old"].cx, found["old"].parameters, found["m"].whole, found["bare"].bytes) == (3, model.count(), True, 0)


@pytest.mark.parametrize("dtype", ["UNSIGNED_BYTE", "BYTE", "UNSIGNED_SHORT", "SHORT", "UNSIGNED_INT", "INT", "FLOAT", "DOUBLE"])
def test_raw_volumes(spark, tmp_path, dtype):
    rng = np.random.default_rng(0)
    for big in (False, True):
        kind = raw.value_type(dtype, big)
        data = (rng.random((6, 5, 4)) * 100).astype(kind)
        path = tmp_path / f"v{big}.raw"
        path.write_bytes(b"\0" * 24 + data.tobytes())
        got = {(r.x, r.y, r.z): r.v for r in raw.read_raw_volume(spark, str(path), (4, 5, 6), dtype, 24, big, slab=4).collect()}
        assert got == {(x, y, z): float(data[z, y, x]) for z in range(6) for y in range(5) for x in range(4)}


def test_raw_slabs_series_samples_and_writing(spark, volume, tmp_path):
    for t in range(3):
        (np.arange(4 * 5 * 40, dtype="<f4") + 1000 * t).tofile(tmp_path / f"s{t}.raw")
    paths = [str(tmp_path / f"s{t}.raw") for t in range(3)]
    df = raw.read_raw_volume(spark, paths, (4, 5, 40), slab=8)
    part = raw.read_region(spark, paths, (4, 5, 40), (0, 0, 8), (4, 5, 16), slab=8)
    assert part.rdd.getNumPartitions() == 3
    part = part.filter("t = 1")
    assert part.agg(F.min("v"), F.count("*")).first() == (1000 + 160, 160)
    few = raw.read_raw_volume(spark, paths, (4, 5, 40), fraction=0.3, seed=3)
    assert 0 < few.count() < df.count() and sorted(few.collect()) == sorted(few.collect())
    with pytest.raises(ValueError):
        raw.value_type("LONG", False)
    lo, hi = raw.write_raw_volume(volume, str(tmp_path / "out"))
    back = raw.read_written(spark, str(tmp_path / "out"), *DIMS[:2]).join(volume.withColumnRenamed("v", "w"), ["x", "y", "z"])
    assert back.count() == math.prod(DIMS) and back.filter("abs(v - w) > 1e-6").count() == 0
    assert math.isclose(lo, volume.agg(F.min("v")).first()[0], abs_tol=1e-6) and hi <= 1


def test_scenes(spark, tmp_path):
    good = {"dataSource": [{"format": "REGULAR_GRID_RAW_BINARY", "fileName": ["no.raw", "a.raw"], "dimensions": {"x": 4, "y": 5, "z": 6}, "type": "FLOAT"}], "view": {"volume": {"scalarMappingRangeUnnormalized": {"minimum": 1, "maximum": 2}}, "camera": {"eye": {"x": 1, "y": 2, "z": 3}, "center": {"x": 0, "y": 0, "z": 0}, "up": {"x": 0, "y": 1, "z": 0}, "fovy": 45}}}
    diva = {"version": "DIVA", "volume": {"dims": {"x": 1, "y": 2, "z": 3}, "range": {"x": 0, "y": 9}, "type": "BYTE", "filename": ["t0", "t1"], "bigendian": True}}
    (tmp_path / "a.json").write_text("// a comment\n" + json.dumps(good))
    (tmp_path / "b.json").write_text(json.dumps(diva))
    scenes = scene.read_scenes(spark, str(tmp_path))
    rows = {r.dtype: r for r in scene.choose_files(scene.volumes(scenes), spark.createDataFrame([("a.raw",), ("t0",), ("t1",)], "path string")).collect()}
    assert (rows["FLOAT"].path, rows["FLOAT"].offset, rows["FLOAT"].range_hi, rows["FLOAT"].big_endian) == ("a.raw", 0, 2.0, False)
    assert rows["BYTE"].big_endian and scene.volumes(scenes).count() == 3 and scene.cameras(scenes).first().fovy == 45
    for name, bad in (("v", good | {"version": "OTHER"}), ("f", {"dataSource": [good["dataSource"][0] | {"format": "X"}]})):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.json").write_text(json.dumps(bad))
        with pytest.raises(Exception, match="unknown"):
            scene.volumes(scene.read_scenes(spark, str(tmp_path / name))).collect()


def test_streams_equal_batches(spark, volume, tmp_path):
    points = volume.select(*[S.centre(F.col(a), n).alias(f"p{a}") for a, n in zip("xyz", DIMS, strict=True)], "v")
    points.repartition(4).write.parquet(str(tmp_path / "in"))
    state: dict = {}

    def sink(batch, number):
        state.update({(r.cx, r.cy, r.cz): (r.vmin, r.vmax, r.max_opacity) for r in batch.collect()})

    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    summaries.start_cells(stream, DIMS, str(tmp_path / "c1"), sink, [0.0, 0.5, 1.0]).awaitTermination()
    want = cells.max_opacity(cells.macrocells(volume, *DIMS), F.array(F.lit(0.0), F.lit(0.5), F.lit(1.0)), 3).collect()
    assert state == {(r.cx, r.cy, r.cz): (r.vmin, r.vmax, r.max_opacity) for r in want}

    steps = volume.withColumn("t", F.col("x") % 2)
    steps.write.partitionBy("t").parquet(str(tmp_path / "steps"))
    query = summaries.start_steps(spark.readStream.schema(steps.schema).parquet(str(tmp_path / "steps")), DIMS, str(tmp_path / "cells"), str(tmp_path / "c2"))
    query.awaitTermination()
    assert sorted(spark.read.parquet(str(tmp_path / "cells")).select("t", "cx", "cy", "cz", "vmin", "vmax").collect()) == sorted(cells.macrocells(steps, *DIMS, "t").collect())

    losses = spark.createDataFrame([("a", 6000, 0.95), ("a", 6001, 0.97), ("b", 6000, 0.1), ("c", 10, 0.99)], "run string, step long, loss double")
    assert [r.run for r in summaries.alerts(summaries.stream_loss(losses)).collect()] == ["a"]


def test_column_functions(spark):
    row = spark.range(1).select(
        S.normalize(F.lit(3.0), F.lit(3.0), F.lit(3.0)).alias("flat"),
        S.raw_value(F.lit("UNSIGNED_BYTE"), F.lit(0.5)).alias("half"),
        S.raw_value(F.lit("FLOAT"), F.lit(0.5)).alias("same"),
        S.cell_of(F.lit(-1)).alias("below"),
        S.pack_rgba(F.lit(1), F.lit(2), F.lit(3), F.lit(255)).alias("packed"),
        S.to_byte(F.lit(1.0)).alias("byte"),
        S.luminance(F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("white"),
        S.is_close(F.lit(1.0), F.lit(1.0 + 1e-7)).alias("close"),
        S.psnr_of_l1(F.lit(0.01)).alias("psnr"),
        *[c.alias(f"u{i}") for i, c in enumerate(S.unpack_rgba(F.lit(0xFF030201)))],
    ).first()
    assert (row.flat, row.half, row.same, row.below, row.packed, row.byte) == (0.0, 127.5, 0.5, -1, 0xFF030201, 255)
    assert math.isclose(row.white, 1.000001, abs_tol=1e-5) and row.close and math.isclose(row.psnr, 20.0) and [row.u0, row.u1, row.u2, row.u3] == [1, 2, 3, 255]
    m = [2.0, 0, 0, 1, 0, 3, 0, 2, 0, 0, 4, 3]
    there = S.affine((F.lit(1.0), F.lit(2.0), F.lit(3.0)), m)
    assert [round(x, 9) for x in spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(S.affine(there, S.inverse_affine(m)))]).first()] == [1.0, 2.0, 3.0]
    centre = lines.make_rays(spark, 3, 3, (0, 0, 5), (0, 0, 0), (0, 1, 0)).filter("ray_id = 4").first()
    assert math.isclose(centre.dz, -1.0) and abs(centre.dx) < 1e-12
    assert math.isclose(lines.ring_directions(spark, 8, 0.5).agg(F.sum("intensity")).first()[0], 1.0)


def test_obj(spark, volume, tmp_path):
    points = isosurface.vertices(isosurface.active(isosurface.corners(volume, *DIMS), 0.5), 0.5)
    isosurface.write_obj(points, str(tmp_path / "s.obj"))
    text = [x for f in sorted((tmp_path / "s.obj").glob("part-*")) for x in f.read_text().splitlines()]
    n = points.count()
    assert [x[0] for x in text] == ["v"] * n + ["f"] * (n // 3) and text[n] == "f 1 2 3"


def test_obj_computes_vertices_once(spark, volume, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    points = isosurface.vertices(isosurface.active(isosurface.corners(volume, *DIMS), 0.5), 0.5)
    n = points.count()
    isosurface.write_obj(points.mapInArrow(run, points.schema), str(tmp_path / "s.obj"))
    assert seen.value == n


def test_normals_point_to_lower_values(spark):
    rng = random.Random(5)
    for weights in ((1.0, 2.0, 3.0), (-1.0, 0.5, 0.25), (0.3, -2.0, -1.0)):
        voxels = spark.range(216).selectExpr("cast(id % 6 as int) x", "cast(id div 6 % 6 as int) y", "cast(id div 36 as int) z")
        voxels = voxels.withColumn("v", sum((F.col(a) * w for a, w in zip("xyz", weights)), F.lit(0.0)))
        iso = 2.5 * sum(weights) + 0.01 * rng.random()
        rows = isosurface.triangles(isosurface.active(isosurface.corners(voxels, 6, 6, 6), iso), iso).collect()
        dots = [r.nx * weights[0] + r.ny * weights[1] + r.nz * weights[2] for r in rows]
        assert len(dots) > 20 and max(dots) < 1e-9 and min(dots) < 0


def test_steps_and_gaps(spark):
    ones = spark.range(2 * 27).selectExpr("cast(id div 27 as int) t", "cast(id % 3 as int) x", "cast(id div 3 % 3 as int) y", "cast(id div 9 % 3 as int) z", "cast(1 + id div 27 as double) v")
    points = sampling.grid_points(spark, 2, 2, 2).drop("x", "y", "z")
    assert {(r.t, round(r.v, 9)) for r in sampling.trilinear(points, ones, 3, 3, 3).collect()} == {(0, 1.0), (1, 2.0)}
    holed = ones.filter("not (x = 1 and y = 1 and z = 1)")
    assert isosurface.active(isosurface.corners(holed, 3, 3, 3), 0.5).count() == 0
    assert isosurface.corners(ones, 3, 3, 3).count() == 16 and isosurface.corners(holed, 3, 3, 3).count() == 0
    line = spark.createDataFrame([(0, 0, 0, 1.0), (2, 0, 0, 5.0), (3, 0, 0, 6.0)], "x int, y int, z int, v double")
    got = {r.x: r.gx for r in sampling.gradient(line, 4, 1, 1).collect()}
    assert got == {0: 0.0, 2: 4.0, 3: 4.0}
    sums = {r.x: r.v for r in quality.box_sums(line.select("x", "y", "z", "v"), ["v"], 1).collect()}
    assert sums == {0: 1.0, 2: 11.0, 3: 11.0}
