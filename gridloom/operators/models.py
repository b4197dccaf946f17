"""A store of hash-grid models: all models' metadata in one table, their levels and cells in two others.

A model has a name and versions, and a version is there once its metadata row is written, which is last. Levels and cells
are parts ``model=…/version=…`` of their tables, so any number of models is described by one scan of each table.
Rows of older formats lack what was added later: format 1 has no version, blending or cell size, and may lack dims.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.scalars import CELL
from gridloom.operators.pyramid import AXES, Config
from gridloom.operators.sampling import steps

FORMAT = 2
META = (
    "model string, version int, format int, nx int, ny int, nz int, levels int, base int, scale double, log2_slots int, blend boolean, "
    "has_cells boolean, cell int, reference_cells boolean, parameters long"
)
LEVELS = "model string, version int, level int, slot long, mean double, n long"
CELLS = "model string, version int, cx int, cy int, cz int, vmin double, vmax double"


def meta_rows(spark: SparkSession, store: str) -> DataFrame:
    """Metadata of all versions, with what older formats lack filled in: the first version, no blending, cells of 16."""
    rows = spark.read.schema(META).json(f"{store}/meta/*")
    return rows.withColumns({"version": F.coalesce("version", F.lit(1)), "format": F.coalesce("format", F.lit(1)), "blend": F.coalesce("blend", F.lit(False)), "cell": F.when(F.col("has_cells"), F.coalesce("cell", F.lit(CELL)))})


def latest(rows: DataFrame) -> DataFrame:
    newest = Window.partitionBy("model").orderBy(F.desc("version"))
    return rows.withColumn("nth", F.row_number().over(newest)).filter("nth = 1").drop("nth")


def exists(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def save(model: DataFrame, store: str, name: str, dims: tuple, config: Config, cells: DataFrame | None = None, cell: int = CELL, reference_cells: bool = True) -> int:
    """Adds a version and returns its number. ``cells`` are blocks of ``cell`` voxels; ``reference_cells`` says whether they were
    made from the volume itself."""
    spark = model.sparkSession
    if steps(model):
        raise ValueError("a series has a model for each step: save them one by one")
    had = meta_rows(spark, store).filter(F.col("model") == name).agg(F.max("version")).first()[0] if exists(spark, f"{store}/meta") else None
    version = (had or 0) + 1
    part = f"model={name}/version={version}"
    model.select("level", "slot", "mean", "n").write.mode("overwrite").parquet(f"{store}/levels/{part}")
    if cells is not None:
        cells.select("cx", "cy", "cz", *[F.col(c).cast("double").alias(c) for c in ("vmin", "vmax")]).write.mode("overwrite").parquet(f"{store}/cells/{part}")
    row = (name, version, FORMAT, *dims, config.levels, config.base, config.scale, config.log2_slots, config.blend, cells is not None, cell if cells is not None else None, reference_cells, model.count())
    spark.createDataFrame([row], META).coalesce(1).write.mode("overwrite").json(f"{store}/meta/{name}-{version}")
    return version


def reshaped(cells: DataFrame, cell: Column | int, dims: tuple, *keys: str) -> DataFrame:
    """Ranges of blocks of ``cell`` voxels as those of blocks of CELL: each takes the union of the ranges of all blocks that
    it meets, so no value is outside."""
    cell = cell if isinstance(cell, Column) else F.lit(cell)
    rows = cells
    for a, n in zip(AXES, dims, strict=True):
        low, high = F.col(f"c{a}") * cell, F.least((F.col(f"c{a}") + 1) * cell, F.lit(n)) - 1
        rows = rows.withColumn(f"c{a}", F.explode(F.sequence(F.floor(low / CELL).cast("int"), F.floor(high / CELL).cast("int"))))
    return rows.groupBy(*keys, "cx", "cy", "cz").agg(F.min("vmin").alias("vmin"), F.max("vmax").alias("vmax"))


def load(spark: SparkSession, store: str, name: str, version: int | None = None, dims: tuple | None = None) -> tuple[DataFrame, tuple, Config, DataFrame | None]:
    """``(model, dims, config, cells)`` of a version, by default the latest. Other dims than those asked for are an error, dims
    that an old format lacks are taken from those asked for, and cells of another size are put together anew."""
    rows = meta_rows(spark, store).filter(F.col("model") == name)
    meta = (latest(rows) if version is None else rows.filter(F.col("version") == version)).first()
    if meta is None:
        raise ValueError(f"no model {name}" + ("" if version is None else f" of version {version}"))
    found = dims if meta.nx is None else (meta.nx, meta.ny, meta.nz)
    if found is None:
        raise ValueError(f"model {name} has no dims, and none are given")
    if dims is not None and tuple(dims) != tuple(found):
        raise ValueError(f"the model is for {found}, not {tuple(dims)}")
    own = (F.col("model") == name) & (F.col("version") == meta.version)
    model = spark.read.schema(LEVELS).parquet(f"{store}/levels").filter(own).drop("model", "version")
    cells = spark.read.schema(CELLS).parquet(f"{store}/cells").filter(own).drop("model", "version") if meta.has_cells else None
    if cells is not None and meta.cell != CELL:
        cells = reshaped(cells, meta.cell, found)
    return model, tuple(found), Config(meta.levels, meta.base, meta.scale, meta.log2_slots, meta.blend), cells


def describe(spark: SparkSession, store: str, dims: DataFrame | None = None, quality: DataFrame | None = None, value_bytes: int = 4) -> DataFrame:
    """One row for the latest version of each model: its dims, cell grid, configuration, which sections it has, and their sizes.
    ``dims`` (``model, nx, ny, nz``) fills in what old formats lack, and ``corrected`` says where; the columns of ``quality`` (``model`` and
    any measures) are joined in. One scan of each table, however many models there are."""
    rows = latest(meta_rows(spark, store))
    if dims is not None:
        given = dims.select("model", *[F.col(f"n{a}").alias(f"given_{a}") for a in AXES])
        rows = rows.join(given, "model", "left").withColumn("corrected", F.col("nx").isNull() & F.col("given_x").isNotNull())
        rows = rows.withColumns({f"n{a}": F.coalesce(f"n{a}", f"given_{a}") for a in AXES}).drop(*[f"given_{a}" for a in AXES])
    else:
        rows = rows.withColumn("corrected", F.lit(False))
    key = ["model", "version"]
    levels = spark.read.schema(LEVELS).parquet(f"{store}/levels").groupBy(*key).agg(F.count("*").alias("found"))
    out = rows.join(levels, key, "left")
    if exists(spark, f"{store}/cells"):
        out = out.join(spark.read.schema(CELLS).parquet(f"{store}/cells").groupBy(*key).agg(F.count("*").alias("cells")), key, "left")
    else:
        out = out.withColumn("cells", F.lit(None).cast("long"))
    grid = [F.ceil(F.col(f"n{a}") / F.coalesce("cell", F.lit(CELL))).cast("int").alias(f"c{a}") for a in AXES]
    sections = [F.col("nx").isNotNull().alias("has_dims"), F.col("cells").isNotNull().alias("has_cells"), F.col("found").isNotNull().alias("has_parameters")]
    out = out.select(*key, "format", "nx", "ny", "nz", *grid, "levels", "base", "scale", "log2_slots", "blend", "cell", *sections, F.coalesce("found", F.lit(0)).alias("parameters"), (F.coalesce("found", F.lit(0)) * value_bytes).alias("bytes"), F.coalesce("cells", F.lit(0)).alias("cells"), "corrected", (F.coalesce(F.col("parameters") == F.col("found"), F.lit(True))).alias("whole"))
    return out if quality is None else out.join(quality, "model", "left")
