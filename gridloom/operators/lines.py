"""Lines through a volume: rays, crossings of cells, samples, and what accumulates along them."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.scalars import CELL, adaptive_step, clamp, coordinates, even_steps, opacity
from gridloom.operators.line_bricks import samples_by_bricks
from gridloom.operators.sampling import corner_table, steps, trilinear_by_corners

OPAQUE, TRANSPARENT = 0.9999, 1e-6
AXES = ("x", "y", "z")


def make_rays(spark: SparkSession, width: int, height: int, eye: tuple, at: tuple, up: tuple, fovy: float = 60.0) -> DataFrame:
    """``ray_id, ox, oy, oz, dx, dy, dz``: one ray through each pixel centre."""
    minus = lambda a, b: tuple(x - y for x, y in zip(a, b, strict=True))
    cross = lambda a, b: (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
    unit = lambda a: tuple(x / math.sqrt(sum(y * y for y in a)) for x in a)
    d = unit(minus(at, eye))
    tall = 2 * math.tan(math.radians(fovy) / 2)
    h = tuple(tall * width / height * x for x in unit(cross(d, up)))
    v = tuple(tall * x for x in unit(cross(h, d)))
    i, j, _ = coordinates(F.col("id"), width, height)
    sx, sy = (i + 0.5) / width - 0.5, (j + 0.5) / height - 0.5
    way = [d[k] + sx * h[k] + sy * v[k] for k in range(3)]
    norm = F.sqrt(sum((w * w for w in way[1:]), way[0] * way[0]))
    return spark.range(width * height).select(F.col("id").alias("ray_id"), *[F.lit(float(e)).alias(f"o{a}") for a, e in zip(AXES, eye, strict=True)], *[(w / norm).alias(f"d{a}") for a, w in zip(AXES, way, strict=True)])


def box_interval(rays: DataFrame, lower: tuple, upper: tuple, t0: float = 0.0, t1: float = 1e20) -> DataFrame:
    """Rays that meet the box, with the interval ``t0, t1`` inside it. A ray that runs along an axis' planes is unbounded
    by them if its origin lies between them, and misses otherwise."""
    lo, hi = [F.lit(t0)], [F.lit(t1)]
    for a, b0, b1 in zip(AXES, lower, upper, strict=True):
        o, d = F.col(f"o{a}"), F.col(f"d{a}")
        p, q = (F.lit(float(b0)) - o) / F.nullif(d, F.lit(0.0)), (F.lit(float(b1)) - o) / F.nullif(d, F.lit(0.0))
        inside = (o >= b0) & (o <= b1)
        lo.append(F.when(d == 0, F.when(inside, F.lit(t0)).otherwise(F.lit(float("inf")))).otherwise(F.least(p, q)))
        hi.append(F.when(d == 0, F.when(inside, F.lit(t1)).otherwise(F.lit(float("-inf")))).otherwise(F.greatest(p, q)))
    return rays.withColumn("t0", F.greatest(*lo)).withColumn("t1", F.least(*hi)).filter("t1 > t0")


def cells_on_lines(rays: DataFrame, dims: tuple, size: int = CELL) -> DataFrame:
    """Every cell that a line crosses, in order: ``step, c0, c1, cx, cy, cz``. Lines carry their interval t0, t1 in voxel
    units. The crossings of each axis' planes that lie between its ends are listed, sorted together, and each stretch between
    two different ones belongs to the cell of its middle; lines that cross an edge take one step."""

    def crossings(axis: str, n: int) -> Column:
        o, d = F.col(f"o{axis}"), F.nullif(F.col(f"d{axis}"), F.lit(0.0))
        # a plane more on either side, as ends are rounded; a line lists no planes that it doesn't reach
        last = -(-n // size)
        ends = [clamp(o + F.col(t) * F.col(f"d{axis}"), 0.0, float(last * size)) / size for t in ("t0", "t1")]
        low, high = F.greatest(F.floor(F.least(*ends)).cast("int") - 1, F.lit(0)), F.least(F.floor(F.greatest(*ends)).cast("int") + 2, F.lit(last))
        planes = F.sequence(low * size, high * size, F.lit(size))
        return F.filter(F.transform(planes, lambda p: (p - o) / d), lambda t: (t > F.col("t0")) & (t < F.col("t1")))

    found = [crossings(a, n) for a, n in zip(AXES, dims, strict=True)]
    times = F.sort_array(F.array_distinct(F.concat(F.array("t0", "t1"), *found)))
    # lines are dealt to all tasks before they grow; so Spark also knows their size, and doesn't broadcast what they grow to by a guess
    rows = rays.repartition(*[f"{k}{a}" for k in "od" for a in AXES]).withColumn("times", times)
    pairs = F.transform(F.sequence(F.lit(1), F.size("times") - 1), lambda i: F.struct((i - 1).alias("step"), F.element_at("times", i).alias("c0"), F.element_at("times", i + 1).alias("c1")))
    rows = rows.withColumn("p", F.explode(pairs)).select(*rays.columns, "p.*")
    middle = (F.col("c0") + F.col("c1")) / 2
    return rows.select("*", *[F.floor((F.col(f"o{a}") + middle * F.col(f"d{a}")) / size).cast("int").alias(f"c{a}") for a in AXES])


def samples_on_lines(crossed: DataFrame, step: float = 1.0, adaptive: bool = False, jitter: Column | float = 0.5) -> DataFrame:
    """Samples of every crossed cell: ``k`` (order on the line), ``px, py, pz`` in voxel units, ``dist``, and the cell's time
    step if it has one. Adaptive steps grow in cells of low ``max_opacity``."""
    jitter = jitter if isinstance(jitter, Column) else F.lit(jitter)
    length = adaptive_step(step, F.col("max_opacity")) if adaptive else F.lit(step)
    n, ds = even_steps(F.col("c0"), F.col("c1"), length)
    rows = crossed.withColumn("dist", ds).withColumn("i", F.explode(F.sequence(F.lit(0), n - 1)))
    t = F.col("c0") + (F.col("i") + jitter) * F.col("dist")
    return rows.select(*steps(rows), "ray_id", (F.col("step").cast("long") * 100000 + F.col("i")).alias("k"), *[(F.col(f"o{a}") + t * F.col(f"d{a}")).alias(f"p{a}") for a in AXES], "dist")


def transmittance(samples: DataFrame, line: list[str], order: str, alpha: str = "a") -> DataFrame:
    """Adds ``clear``, the light left before each sample: the product of 1 - alpha of the samples before it. (``T`` would be the
    time step's name to Spark.)"""
    before = Window.partitionBy(*line).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    dark = F.coalesce(F.max(F.when(F.col(alpha) >= 1, 1).otherwise(0)).over(before), F.lit(0))
    left = F.exp(F.coalesce(F.sum(F.when(F.col(alpha) < 1, F.ln(1 - F.col(alpha)))).over(before), F.lit(0.0)))
    return samples.withColumn("clear", F.when(dark == 1, 0.0).otherwise(left))


def visible(samples: DataFrame) -> DataFrame:
    """Samples before the line has become opaque."""
    return samples.filter(1 - F.col("clear") < OPAQUE)


def composite(samples: DataFrame, line: list[str], colours: list[str], alpha: str = "a") -> DataFrame:
    """Front-to-back sums of the colours, and ``alpha``."""
    return samples.groupBy(*line).agg(*[F.sum(F.col("clear") * F.col(alpha) * F.col(c)).alias(c) for c in colours], F.sum(F.col("clear") * F.col(alpha)).alias("alpha"))


def line_transmittance(samples: DataFrame, line: list[str], alpha: str = "a") -> DataFrame:
    """Product of 1 - alpha over each line (``clear``)."""
    dark = F.max(F.when(F.col(alpha) >= 1, 1).otherwise(0)) == 1
    return samples.groupBy(*line).agg(F.when(dark, 0.0).otherwise(F.exp(F.coalesce(F.sum(F.when(F.col(alpha) < 1, F.ln(1 - F.col(alpha)))), F.lit(0.0)))).alias("clear"))


def peak(samples: DataFrame, line: list[str], order: str, carry: list[str], alpha: str = "a") -> DataFrame:
    """The sample of highest contribution clear * alpha on each line; of equals the first."""
    rank = F.struct(F.round(F.col("clear") * F.col(alpha), 12), -F.col(order))
    return samples.groupBy(*line).agg(F.max_by(F.struct(order, *carry), rank).alias("p")).select(*line, "p.*")


def axis_shadow(voxels: DataFrame, lights: DataFrame, alpha: str = "a") -> DataFrame:
    """Light that reaches each voxel from lights along the axes: ``lights`` has ``axis`` (x, y or z), ``sign`` and
    ``intensity``, a few rows. One running product for each axis and direction in use, and for each step of a series."""
    keys = [*steps(voxels), *AXES]
    found = None
    for light in lights.collect():  # a handful of lights, given by the user
        others = [k for k in keys if k != light.axis]
        rows = voxels.withColumn("along", F.col(light.axis) * light.sign)
        lit = transmittance(rows, others, "along", alpha).select(*keys, (F.col("clear") * F.lit(float(light.intensity))).alias("light"))
        found = lit if found is None else found.unionByName(lit)
    return found.groupBy(*keys).agg(F.sum("light").alias("light"))


def sampled(samples: DataFrame, corners: DataFrame, dims: tuple, transfer: Callable[[Column], Column], rate: float = 1.0) -> DataFrame:
    """Samples of lines with the volume's value ``v`` there and their opacity ``a``: that of the transfer function, for the
    sample's length. ``corners`` is the volume's corner table. Samples with a time step are looked up in it, others in every step of a
    series."""
    values = trilinear_by_corners(samples, corners, dims)
    return values.withColumn("a", opacity(transfer(F.col("v")), F.col("dist"), rate))


def live_stretches(rays: DataFrame, cells: DataFrame, dims: tuple) -> DataFrame:
    """The lines' stretches in cells that are not transparent, with ``max_opacity`` and the cells' time step."""
    crossed = cells_on_lines(box_interval(rays, (0, 0, 0), dims), dims)
    keys = [*(k for k in steps(cells) if k in rays.columns), "cx", "cy", "cz"]
    # by its guess of sizes Spark would broadcast the stretches, many for each ray; cells number 1/4096 of the voxels
    live = cells.filter(F.col("max_opacity") > TRANSPARENT).select(*steps(cells), "cx", "cy", "cz", "max_opacity")
    return crossed.join(F.broadcast(live), keys)


def march(rays: DataFrame, voxels: DataFrame, cells: DataFrame, dims: tuple, transfer: Callable[[Column], Column], step: float = 1.0, rate: float = 1.0, adaptive: bool = True) -> DataFrame:
    """``ray_id, k, dist, v, a``: the samples of all rays in the cells that are not transparent. ``cells`` has their
    ``max_opacity``; transparent ones are left out before a ray is cut into samples. In a series voxels and cells have ``t``,
    and so does the result: a ray is marched through every step, or through its own if it has ``t``."""
    return sampled(samples_on_lines(live_stretches(rays, cells, dims), step, adaptive), corner_table(voxels), dims, transfer, rate)


def shadow(voxels: DataFrame, cells: DataFrame, lights: DataFrame, dims: tuple, transfer: Callable[[Column], Column], step: float = 1.0, rate: float = 1.0) -> DataFrame:
    """``x, y, z, light``: the light that reaches the centre of each voxel from distant lights in any direction, for each step
    of a series. ``lights`` has ``light_id``, the direction ``x, y, z`` towards the light in voxel units, and ``intensity``.
    Each voxel sends a line to each light; a line without a sample that is not transparent is lit in full."""
    given = lights.collect()  # a handful of lights, given by the user
    keys = [*steps(voxels), *AXES]
    whole = F.lit(float(sum(light.intensity for light in given)))
    if not given:
        return voxels.select(*keys, whole.alias("light"))
    number = lambda v: F.lit(float(v))
    towards = F.array(*[F.struct(F.lit(n).alias("n"), *[number(light[a]).alias(f"d{a}") for a in AXES]) for n, light in enumerate(given)])
    rays = voxels.select(*keys, F.explode(towards).alias("to"))
    rays = rays.select(*keys, "to.n", *[(F.col(a) + 0.5).alias(f"o{a}") for a in AXES], *[f"to.d{a}" for a in AXES])
    live = cells.filter(F.col("max_opacity") > TRANSPARENT).select(*steps(cells), "cx", "cy", "cz")
    samples = samples_by_bricks(box_interval(rays, (0, 0, 0), dims), voxels, dims, step, live, carry=(*AXES, "n"))
    samples = samples.select(*keys, "n", opacity(transfer(F.col("v")), F.col("dist"), rate).alias("a"))
    # samples of a voxel's lines in one brick become one row before they are shuffled
    of = lambda n, x: F.when(F.col("n") == n, x)
    dark = [F.max(of(n, F.when(F.col("a") >= 1, 1).otherwise(0))).alias(f"dark{n}") for n in range(len(given))]
    logs = [F.sum(of(n, F.when(F.col("a") < 1, F.ln(1 - F.col("a"))))).alias(f"log{n}") for n in range(len(given))]
    found = samples.groupBy(*keys).agg(*dark, *logs)
    lost = [F.when(F.col(f"dark{n}") == 1, 1.0).otherwise(1 - F.exp(F.coalesce(f"log{n}", F.lit(0.0)))) * F.lit(float(light.intensity)) for n, light in enumerate(given)]
    found = found.select(*keys, sum(lost[1:], lost[0]).alias("lost"))
    return voxels.select(*keys).join(found, keys, "left").select(*keys, (whole - F.coalesce("lost", F.lit(0.0))).alias("light"))


def progressive_mean(frames: DataFrame, key: list[str], value: str) -> DataFrame:
    """Mean over frames for each key, as frames come in."""
    return frames.groupBy(*key).agg(F.avg(value).alias("mean"), F.count(value).alias("frames"))


def ring_directions(spark: SparkSession, n: int, theta: float, phi0: float = 0.0) -> DataFrame:
    """n directions on a ring, each of intensity 1/n."""
    phi = F.lit(phi0) + F.col("id") * (2 * math.pi / n)
    return spark.range(n).select(F.col("id").alias("light_id"), (math.sin(theta) * F.cos(phi)).alias("x"), (math.sin(theta) * F.sin(phi)).alias("y"), F.lit(math.cos(theta)).alias("z"), F.lit(1.0 / n).alias("intensity"))


def random_directions(spark: SparkSession, n: int, seed: int = 1337) -> DataFrame:
    """n random directions, each of intensity 1/n: two angles, one over the whole and one over half a turn. A direction
    depends on its number and the seed alone."""
    unit = lambda k: F.shiftrightunsigned(F.xxhash64(F.col("id"), F.lit(seed), F.lit(k)), 11) / float(1 << 53)
    theta, phi = 2 * math.pi * unit(0), math.pi * unit(1)
    return spark.range(n).select(F.col("id").alias("light_id"), (F.sin(theta) * F.cos(phi)).alias("x"), (F.sin(theta) * F.sin(phi)).alias("y"), F.cos(theta).alias("z"), F.lit(1.0 / n).alias("intensity"))
