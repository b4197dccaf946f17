"""Column functions over values, indices, points and colours of volumes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Storage types of raw volumes: name -> (numpy type, largest value of integer types or None).
DTYPES = {
    "UNSIGNED_BYTE": ("u1", 255),
    "BYTE": ("i1", 127),
    "UNSIGNED_SHORT": ("u2", 65535),
    "SHORT": ("i2", 32767),
    "UNSIGNED_INT": ("u4", 4294967295),
    "INT": ("i4", 2147483647),
    "FLOAT": ("f4", None),
    "DOUBLE": ("f8", None),
}

CELL_SHIFT = 4
CELL = 1 << CELL_SHIFT
#: Constants of relief shading.
AMBIENT, DIFFUSE, SPECULAR, SHININESS = 0.6, 0.9, 0.4, 40.0


def clamp(x: Column, lo, hi) -> Column:
    return F.least(F.greatest(x, F.lit(lo) if not isinstance(lo, Column) else lo), F.lit(hi) if not isinstance(hi, Column) else hi)


def as_value(x: Column) -> Column:
    """A stored value as a number to compute with."""
    return x.cast(DoubleType())


def normalize(v: Column, lo: Column, hi: Column) -> Column:
    """v on [lo, hi] mapped to [0, 1] and clamped; 0 for a constant volume."""
    return F.when(hi == lo, F.lit(0.0)).otherwise(clamp((v - lo) / F.nullif(hi - lo, F.lit(0.0)), 0.0, 1.0))


def raw_value(dtype: Column, fraction: Column) -> Column:
    """A fraction of an integer type's range as a raw value; floating-point types keep it."""
    most = F.lit(None).cast("double")
    for name, (_, top) in DTYPES.items():
        if top is not None:
            most = F.when(dtype == name, F.lit(float(top))).otherwise(most)
    return F.coalesce(most, F.lit(1.0)) * fraction


def linear_id(x: Column, y: Column, z: Column, nx: int, ny: int) -> Column:
    return x.cast("long") + F.lit(nx).cast("long") * (y.cast("long") + F.lit(ny).cast("long") * z.cast("long"))


def coordinates(i: Column, nx: int, ny: int) -> tuple[Column, Column, Column]:
    plane = nx * ny
    return ((i % nx).cast("int"), F.floor(i % plane / nx).cast("int"), F.floor(i / plane).cast("int"))


def centre(i: Column, n: Column | int) -> Column:
    """Centre of grid point i of n on [0, 1]."""
    return (i + 0.5) / n


def cell_centred(p: Column, size: int, lo: int) -> Column:
    """Position on [0, 1] -> cell-centred position within a box of ``size`` from ``lo``."""
    return clamp(p * (size + 1) + lo, lo + 0.5, lo + size + 0.5)


def node_centred(p: Column, size: int, lo: int) -> Column:
    return cell_centred(p, size, lo) - 0.5


def cell_of(x: Column) -> Column:
    """Macrocell of a voxel index; -1 belongs to cell -1."""
    return F.shiftright(x, CELL_SHIFT)


def cell_count(n: int) -> int:
    return -(-n // CELL)


def transfer(v: Column, knots: Column, n: Column | int, lo: Column | float = 0.0, hi: Column | float = 1.0) -> Column:
    """Piecewise-linear lookup in an array of n equally spaced knots over [lo, hi]."""
    lo, hi = (x if isinstance(x, Column) else F.lit(x) for x in (lo, hi))
    u = (clamp(v, lo, hi) - lo) / (hi - lo) * (n - 1)
    i = F.floor(u).cast("int")
    last = F.lit(n).cast("int") if not isinstance(n, Column) else n.cast("int")
    f = u - i
    return F.element_at(knots, i + 1) * (1 - f) + F.element_at(knots, F.least(i + 2, last)) * f


def opacity(a: Column, distance: Column | float, rate: Column | float) -> Column:
    """Opacity of a sample that stands for ``distance`` at ``rate`` samples per unit."""
    d, r = (x if isinstance(x, Column) else F.lit(x) for x in (distance, rate))
    return 1 - F.pow(1 - a, d * r)


def adaptive_step(base: Column | float, max_opacity: Column) -> Column:
    return (F.lit(base) if not isinstance(base, Column) else base) * (1 + 15 * F.pow(1 - clamp(max_opacity, 0.1, 1.0), 2))


def even_steps(t0: Column, t1: Column, step: Column) -> tuple[Column, Column]:
    """(number, length) of equal steps on [t0, t1] no longer than ``step``."""
    n = F.floor((t1 - t0) / step).cast("int") + 1
    return n, (t1 - t0) / n


def l1(a: Column, b: Column) -> Column:
    return F.abs(a - b)


def l2(a: Column, b: Column) -> Column:
    return (a - b) * (a - b)


def psnr_of_l1(loss: Column) -> Column:
    return -10 * F.log10(loss)


def is_close(a: Column, b: Column, relative: float = 10 * 1.1920928955078125e-07) -> Column:
    return F.abs(a - b) <= relative * F.greatest(F.abs(a), F.abs(b))


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.212671 * r + 0.715160 * g + 0.072169 * b


def to_byte(c: Column) -> Column:
    return F.floor(255.99 * clamp(c, 0.0, 1.0)).cast("int")


def pack_rgba(r: Column, g: Column, b: Column, a: Column) -> Column:
    """Four bytes in one number, red lowest."""
    return r.cast("long").bitwiseOR(F.shiftleft(g.cast("long"), 8)).bitwiseOR(F.shiftleft(b.cast("long"), 16)).bitwiseOR(F.shiftleft(a.cast("long"), 24))


def unpack_rgba(packed: Column) -> tuple[Column, Column, Column, Column]:
    return tuple(F.shiftright(packed, s).bitwiseAND(F.lit(255)).cast("int") for s in (0, 8, 16, 24))


def dot(a: tuple, b: tuple) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: tuple, b: tuple) -> tuple:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def length(a: tuple) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: tuple) -> tuple:
    """A vector of length 1, or zero for a zero vector."""
    n = F.nullif(length(a), F.lit(0.0))
    return tuple(F.coalesce(x / n, F.lit(0.0)) for x in a)


def triangle_normal(a: tuple, b: tuple, c: tuple) -> tuple:
    """Cross product of two unit edges, not scaled again."""
    return cross(unit(tuple(y - x for x, y in zip(a, b, strict=True))), unit(tuple(y - x for x, y in zip(a, c, strict=True))))


def relief(gradient: tuple, light: tuple[float, float, float], view: tuple[float, float, float]) -> Column:
    """Grey factor of a sample: half of it plain, half lit by one light from its gradient."""
    size = length(gradient)
    normal = tuple(F.when(size > 1e-6, g / F.nullif(size, F.lit(0.0))).otherwise(0.0) for g in gradient)
    norm = math.sqrt(sum(x * x for x in light))
    to_light = [x / norm for x in light]
    half = [a + b for a, b in zip(to_light, view, strict=True)]
    norm = math.sqrt(sum(x * x for x in half)) or 1.0
    facing = F.abs(dot(normal, to_light))
    shine = F.pow(F.abs(dot(normal, [x / norm for x in half])), F.lit(SHININESS))
    return F.lit(0.5) + 0.5 * (AMBIENT + DIFFUSE * facing + SPECULAR * shine)


def affine(p: tuple, m: list[float]) -> tuple:
    """Point through a 3 x 4 matrix in row order."""
    return tuple(m[4 * r] * p[0] + m[4 * r + 1] * p[1] + m[4 * r + 2] * p[2] + m[4 * r + 3] for r in range(3))


def inverse_affine(m: list[float]) -> list[float]:
    import numpy as np

    full = np.vstack([np.array(m, float).reshape(3, 4), [0, 0, 0, 1]])
    return np.linalg.inv(full)[:3].ravel().tolist()


def screen(p: tuple, eye: tuple, h: tuple, v: tuple) -> tuple[Column, Column]:
    """Position of a point on a screen spanned by h and v, in [0, 1] each."""
    d = tuple(a - b for a, b in zip(p, eye, strict=True))
    return tuple(dot(d, tuple(x / sum(y * y for y in axis) for x in axis)) + 0.5 for axis in (h, v))


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) that belongs to the parts' values: the first 52 bits of the md5 of their texts, joined by ``|``."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)
