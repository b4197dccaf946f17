"""Scene descriptions (JSON, two dialects) as tables, many files at once, or many scenes in the lines of a file.

A transfer function is described by ``resolution``, ``colorControls`` (``position, color {r, g, b}``), ``opacityControls``
(``position, opacity``) and ``gaussianObjects`` (``mean, sigma, heightFactor``), whose bumps are added to the opacity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.scalars import raw_value
from gridloom.functions.transfer import FAINT

XYZ = "struct<x:double,y:double,z:double>"
RANGE = "struct<minimum:double,maximum:double>"
SOURCE = "struct<format:string,fileName:string,dimensions:struct<x:int,y:int,z:int>,type:string,offset:bigint,endian:string,fileUpperLeft:boolean,id:int,name:string>"
COLOURS = "array<struct<position:double,color:struct<r:double,g:double,b:double>>>"
OPACITIES = "array<struct<position:double,opacity:double>>"
BUMPS = "array<struct<mean:double,sigma:double,heightFactor:double>>"
TRANSFER = f"struct<resolution:int,colorControls:{COLOURS},opacityControls:{OPACITIES},gaussianObjects:{BUMPS}>"
SCHEMA = (
    f"name string, version string, dataSource array<{SOURCE}>, "
    f"view struct<volume:struct<transferFunction:{TRANSFER},scalarMappingRangeUnnormalized:{RANGE},scalarMappingRange:{RANGE}>,camera:struct<eye:{XYZ},center:{XYZ},up:{XYZ},fovy:double>>, "
    "volume struct<range:struct<x:double,y:double>,dims:struct<x:int,y:int,z:int>,type:string,filename:string,bigendian:boolean>"
)
#: Knots of a transfer function that states no resolution.
KNOTS = 1024
REGULAR = "REGULAR_GRID_RAW_BINARY"
DIALECTS = ("VIDI3D", "DIVA")


def fail(message: Column) -> Column:
    return F.raise_error(message).cast("string")


def names(column: Column) -> Column:
    """A file name or a JSON list of them, as an array."""
    return F.when(F.startswith(column, F.lit("[")), F.from_json(column, "array<string>")).otherwise(F.array(column))


def read_scenes(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row for each scene: each file is one, or with ``lines`` each line of a file. ``scene`` is its name, or else its file's."""
    rows = spark.read.schema(SCHEMA).option("multiLine", not lines).option("allowComments", True).json(path)
    rows = rows.withColumn("scene", F.coalesce("name", F.input_file_name())).drop("name")
    version = F.coalesce("version", F.lit("VIDI3D"))
    return rows.withColumn("version", F.when(version.isin(*DIALECTS), version).otherwise(fail(F.concat(F.lit("unknown scene version "), version))))


def mapped_range(scene_volume: Column, dtype: Column) -> list[Column]:
    """The values that a scene maps to 0 and 1: as given, or a fraction of an integer type's range, or null."""
    plain, share = scene_volume["scalarMappingRangeUnnormalized"], scene_volume["scalarMappingRange"]
    return [F.coalesce(plain[end], raw_value(dtype, share[end])) for end in ("minimum", "maximum")]


def volumes(scenes: DataFrame) -> DataFrame:
    """``scene, volume_no, nx, ny, nz, dtype, range_lo, range_hi, offset, big_endian, candidates``: one row per volume or
    time step; optional keys take their defaults, and only raw regular grids are accepted."""
    diva = scenes.filter("version = 'DIVA'").select("scene", F.col("volume").alias("s")).select("scene", F.posexplode(names(F.col("s.filename"))).alias("volume_no", "file"), "s")
    diva = diva.select("scene", "volume_no", "s.dims.x", "s.dims.y", "s.dims.z", F.col("s.type").alias("dtype"), F.col("s.range.x").alias("range_lo"), F.col("s.range.y").alias("range_hi"), F.lit(0).cast("long").alias("offset"), F.coalesce("s.bigendian", F.lit(False)).alias("big_endian"), F.array("file").alias("candidates"))
    vidi = scenes.filter("version = 'VIDI3D'").select("scene", "view", F.posexplode("dataSource").alias("volume_no", "s"))
    checked = F.when(F.col("s.format") == REGULAR, F.col("s.type")).otherwise(fail(F.concat(F.lit("unknown volume format "), F.coalesce("s.format", F.lit("none")))))
    low, high = mapped_range(F.col("view.volume"), F.col("s.type"))
    vidi = vidi.select("scene", "volume_no", "s.dimensions.x", "s.dimensions.y", "s.dimensions.z", checked.alias("dtype"), low.alias("range_lo"), high.alias("range_hi"), F.coalesce("s.offset", F.lit(0)).alias("offset"), (F.coalesce("s.endian", F.lit("LITTLE_ENDIAN")) == "BIG_ENDIAN").alias("big_endian"), F.coalesce("s.fileUpperLeft", F.lit(False)).alias("upper_left"), names(F.col("s.fileName")).alias("candidates"))
    diva = diva.withColumn("upper_left", F.lit(False))
    return diva.unionByName(vidi).withColumnsRenamed({"x": "nx", "y": "ny", "z": "nz"})


def choose_files(volume_rows: DataFrame, listing: DataFrame) -> DataFrame:
    """The first candidate of each volume that the listing (one column ``path``) holds."""
    each = volume_rows.select("scene", "volume_no", F.posexplode("candidates").alias("n", "path"))
    found = each.join(listing.select("path"), "path", "left_semi").groupBy("scene", "volume_no").agg(F.min_by("path", "n").alias("path"))
    return volume_rows.drop("candidates").join(found, ["scene", "volume_no"], "left")


def cameras(scenes: DataFrame) -> DataFrame:
    camera = F.col("view.camera")
    return scenes.filter(camera.isNotNull()).select("scene", *[camera[part][a].alias(f"{part}_{a}") for part in ("eye", "center", "up") for a in "xyz"], F.coalesce(camera["fovy"], F.lit(60.0)).alias("fovy"))


def between(controls: Column, at: Column, value) -> Column:
    """The value at a position on the straight lines between controls (sorted), and the end controls' beyond them; null without any."""
    before = F.filter(controls, lambda c: c["position"] <= at)
    after = F.filter(controls, lambda c: c["position"] > at)
    a, b = F.try_element_at(before, F.lit(-1)), F.try_element_at(after, F.lit(1))
    share = (at - a["position"]) / (b["position"] - a["position"])
    return F.coalesce(value(a) + share * (value(b) - value(a)), value(a), value(b))


def transfer_functions(scenes: DataFrame) -> DataFrame:
    """``scene, i, n, r, g, b, a, lo, hi``: the transfer function of each scene that has one, on equally spaced knots, and the values
    that its ends stand for. Without colours it is white; end knots that are nearly transparent are wholly so."""
    t = F.col("view.volume.transferFunction")
    rows = scenes.filter(t.isNotNull()).select("scene", t.alias("t"), *[c.alias(e) for c, e in zip(mapped_range(F.col("view.volume"), F.try_element_at(F.col("dataSource.type"), F.lit(1))), ("lo", "hi"), strict=True)])
    rows = rows.select("scene", "lo", "hi", F.coalesce("t.resolution", F.lit(KNOTS)).alias("n"), F.array_sort("t.colorControls").alias("colours"), F.array_sort("t.opacityControls").alias("opacities"), F.coalesce("t.gaussianObjects", F.array().cast(BUMPS)).alias("bumps"))
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at = F.col("i") / F.greatest(F.col("n") - 1, F.lit(1))
    bumps = F.aggregate("bumps", F.lit(0.0), lambda s, b: s + b["heightFactor"] * F.exp(-F.pow(at - b["mean"], 2) / (2 * b["sigma"] * b["sigma"])))
    a = F.least(F.coalesce(between(F.col("opacities"), at, lambda c: c["opacity"]), F.lit(0.0)) + bumps, F.lit(1.0))
    ends = F.col("i").isin(0) | (F.col("i") == F.col("n") - 1)
    colour = [F.coalesce(between(F.col("colours"), at, lambda c, k=k: c["color"][k]), F.lit(1.0)).alias(k) for k in "rgb"]
    return rows.select("scene", "i", "n", *colour, F.when(ends & (a < FAINT), 0.0).otherwise(a).alias("a"), "lo", "hi")


def write_scenes(volume_rows: DataFrame, path: str) -> None:
    """Descriptors of derived volumes, one JSON object per row. Of the columns ``scene``, ``transfer`` (a struct of TRANSFER's form),
    ``range_lo, range_hi``, ``share_lo, share_hi`` (fractions of the type's range) and ``upper_left`` those that are there are written too; ``path`` is a name or a list of candidates."""
    has = volume_rows.columns
    dims = F.struct(F.col("nx").alias("x"), F.col("ny").alias("y"), F.col("nz").alias("z"))
    endian = F.when(F.col("big_endian"), "BIG_ENDIAN").otherwise("LITTLE_ENDIAN")
    fields = [dims.alias("dimensions"), endian.alias("endian"), F.col("path").alias("fileName"), F.lit(REGULAR).alias("format"), F.col("volume_no").alias("id"), F.col("offset"), F.col("dtype").alias("type")]
    fields += [F.col("upper_left").alias("fileUpperLeft")] if "upper_left" in has else []
    view = [F.col("transfer").alias("transferFunction")] if "transfer" in has else []
    view += [F.struct(F.col("share_lo").alias("minimum"), F.col("share_hi").alias("maximum")).alias("scalarMappingRange")] if "share_lo" in has else []
    view += [F.struct(F.col("range_lo").alias("minimum"), F.col("range_hi").alias("maximum")).alias("scalarMappingRangeUnnormalized")] if "range_lo" in has else []
    parts = [F.col("scene").alias("name")] if "scene" in has else []
    parts += [F.array(F.struct(*fields)).alias("dataSource")]
    parts += [F.struct(F.struct(*view).alias("volume")).alias("view")] if view else []
    volume_rows.select(F.to_json(F.struct(*parts)).alias("value")).write.mode("overwrite").text(path)
