"""Which tiles exist: rectangles of availability, probes, and fallbacks up the tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.functions import geo

RECT = T.StructType([T.StructField(n, T.LongType()) for n in ("startX", "startY", "endX", "endY")])
#: Rectangles wider or higher than this many cells of their level's grid of 64 by 32 are few and cover much.
GRID_Z = 5


def available(tiles: DataFrame, rects: DataFrame) -> DataFrame:
    """tiles (z, x, y, ...) that are in a rectangle (level, sx, sy, ex, ey) of their level; both roots always are.

    A range join of an equality and two intervals.  Rectangles are cut along a fixed grid of 64 by 32
    cells a level, so level and cell are an equi-join key: a level that holds a third of all tiles is dealt
    over its cells, and neither side needs to be small.
    """
    dz = F.greatest(F.col("z").cast("int") - GRID_Z, F.lit(0))
    rz = F.greatest(F.col("level").cast("int") - GRID_Z, F.lit(0))
    cell = lambda c: F.call_function("shiftright", F.col(c), rz)
    cut = rects.withColumn("__cx", F.explode(F.sequence(cell("sx"), cell("ex")))).withColumn("__cy", F.explode(F.sequence(cell("sy"), cell("ey"))))
    keyed = tiles.withColumn("__cx", F.call_function("shiftright", F.col("x"), dz)).withColumn("__cy", F.call_function("shiftright", F.col("y"), dz))
    a, b = keyed.alias("a"), cut.select("level", "sx", "sy", "ex", "ey", "__cx", "__cy").alias("b")
    on = (F.col("a.z") == F.col("b.level")) & (F.col("a.__cx") == F.col("b.__cx")) & (F.col("a.__cy") == F.col("b.__cy"))
    on = on & F.col("a.x").between(F.col("b.sx"), F.col("b.ex")) & F.col("a.y").between(F.col("b.sy"), F.col("b.ey"))
    root = (F.col("z") == 0) & F.col("x").isin(0, 1) & (F.col("y") == 0)
    return a.where("z > 0").join(b, on, "left_semi").select(*tiles.columns).unionByName(tiles.where(root))


def ancestors(tiles: DataFrame, own: bool = True, least: int = 0) -> DataFrame:
    """A row (az, ax, ay) for each ancestor of each tile, itself included if own."""
    top = F.col("z").cast("int") if own else F.col("z").cast("int") - 1
    levels = F.when(top >= least, F.sequence(top, F.lit(least), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    rows = tiles.withColumn("az", F.explode(levels))
    by = F.col("z") - F.col("az")
    return rows.withColumn("ax", geo.shift_right(F.col("x"), by)).withColumn("ay", geo.shift_right(F.col("y"), by))


def _deepest(found: DataFrame, key: list[str]) -> DataFrame:
    """The deepest of each key's rows (key, z, x, y of the tile, az): the level decides, so only numbers are aggregated."""
    best = found.groupBy(*key).agg(F.max("az").alias("az"), *(F.first(c).alias(c) for c in ("z", "x", "y")))
    by = F.col("z") - F.col("az")
    return best.select(*key, "az", geo.shift_right(F.col("x"), by).alias("ax"), geo.shift_right(F.col("y"), by).alias("ay"))


def nearest_real_ancestor(tiles: DataFrame, rects: DataFrame, key: list[str]) -> DataFrame:
    """The deepest ancestor (or self) of each tile, named by key, that is available."""
    own = [F.col(c).alias(f"__{c}") for c in "zxy"]
    up = ancestors(tiles).select(*key, *own, F.col("az").alias("z"), F.col("ax").alias("x"), F.col("ay").alias("y"))
    found = available(up, rects).select(*key, F.col("z").alias("az"), *(F.col(f"__{c}").alias(c) for c in "zxy"))
    return _deepest(found, key)


def imagery_fallback(tiles: DataFrame, existing: DataFrame, key: list[str], max_z: int = geo.IMAGERY_MAX_Z) -> DataFrame:
    """The deepest ancestor, at most at max_z, whose image exists (z, x, y); as-of join up the tree."""
    up = ancestors(tiles).where(F.col("az") <= max_z)
    have = existing.select(F.col("z").alias("az"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    return _deepest(up.join(have, ["az", "ax", "ay"], "left_semi").select(*key, "az", "z", "x", "y"), key)


def _cells(m, span, overzoom: int):
    """First and last cell of a level m that a span touches, and whether they are few enough."""
    (x0, y0), (x1, y1) = span
    n = geo.rows_at(m)
    at = lambda v, e: F.least(((v + e) * n).cast("long"), n - 1)
    cells = [at(x0, 1e-9), at(y0, 1e-9), at(x1, -1e-9), at(y1, -1e-9)]
    return cells, (cells[2] - cells[0] < (1 << overzoom)) & (cells[3] - cells[1] < (2 << overzoom))


def _span():
    west, south, east, north = geo.tile_rect(F.col("z"), F.col("x"), F.col("y"))
    return geo.mercator(west, south), geo.mercator(east, north)


def _levels(min_m: int, max_m: int, overzoom: int):
    cap = F.least(F.col("z").cast("int") + 1 + overzoom, F.lit(max_m))
    return F.when(cap >= min_m, F.sequence(F.lit(min_m), cap)).otherwise(F.array().cast("array<int>"))


def covers(tiles: DataFrame, min_m: int = 0, max_m: int = 19, overzoom: int = 0) -> DataFrame:
    """All mercator grids (m, tx0, ty0, tx1, ty1) that cover a tile with few enough cells."""
    rows = tiles.withColumn("m", F.explode(_levels(min_m, max_m, overzoom)))
    cells, fits = _cells(F.col("m"), _span(), overzoom)
    return rows.where(fits).select("*", *(c.alias(n) for c, n in zip(cells, ("tx0", "ty0", "tx1", "ty1"), strict=True)))


def mercator_cover(tiles: DataFrame, key: list[str], min_m: int = 0, max_m: int = 19, overzoom: int = 0) -> DataFrame:
    """The deepest cover of each tile that has one, found within its row: nothing is shuffled."""
    (x0, y0), (x1, y1) = _span()
    rows = tiles.select("*", x0.alias("__x0"), y0.alias("__y0"), x1.alias("__x1"), y1.alias("__y1"))
    span = (F.col("__x0"), F.col("__y0")), (F.col("__x1"), F.col("__y1"))
    rows = rows.withColumn("m", F.array_max(F.filter(_levels(min_m, max_m, overzoom), lambda m: _cells(m, span, overzoom)[1]))).where("m is not null")
    cells, _ = _cells(F.col("m"), span, overzoom)
    return rows.select(*key, "m", *(c.alias(n) for c, n in zip(cells, ("tx0", "ty0", "tx1", "ty1"), strict=True)))


def cover_cells(cover: DataFrame) -> DataFrame:
    """A row (m, tx, ty) for each cell of each cover."""
    rows = cover.withColumn("ty", F.explode(F.sequence("ty0", "ty1")))
    return rows.withColumn("tx", F.explode(F.sequence("tx0", "tx1")))


def complete_covers(cover: DataFrame, files: DataFrame, key: list[str], stitched: DataFrame | None = None) -> DataFrame:
    """Covers all of whose cells have a file (m, tx, ty), or that are stitched already as a whole."""
    grid = [*key, "m", "tx0", "ty0", "tx1", "ty1"]
    have = files.select("m", "tx", "ty").distinct().withColumn("have", F.lit(1))
    counted = cover_cells(cover).join(have, ["m", "tx", "ty"], "left").groupBy(*grid).agg(F.count(F.lit(1)).alias("n"), F.count("have").alias("got"))
    if stitched is not None:
        whole = stitched.select("m", "tx0", "ty0", "tx1", "ty1").distinct().withColumn("whole", F.lit(True))
        counted = counted.join(whole, ["m", "tx0", "ty0", "tx1", "ty1"], "left")
    else:
        counted = counted.withColumn("whole", F.lit(False))
    return counted.where((F.col("n") == F.col("got")) | F.coalesce("whole", F.lit(False))).select(*grid)


def cover_fallback(tiles: DataFrame, files: DataFrame, key: list[str], **limits: int) -> DataFrame:
    """The deepest complete cover of each tile."""
    best = complete_covers(covers(tiles, **limits).select(*key, "m", "tx0", "ty0", "tx1", "ty1"), files, key)
    return best.groupBy(*key).agg(F.max(F.struct("m", "tx0", "ty0", "tx1", "ty1")).alias("c")).select(*key, "c.*")


def offset_of(metadata: DataFrame) -> DataFrame:
    """For metadata (z, x, y, available array<array<rect>>) the level of its first entry less z.

    1 if all rectangles fit their levels' grids at that offset, else 0 if they do at that, else 1.
    """
    fits = lambda off: F.forall(
        F.transform("available", lambda rects, i: F.struct(rects.alias("rects"), (F.col("z") + off + i).alias("z"))),
        lambda e: F.forall(F.coalesce(e["rects"], F.array().cast(T.ArrayType(RECT))), lambda r: (r["endX"] < geo.columns_at(e["z"])) & (r["endY"] < geo.rows_at(e["z"]))),
    )
    return metadata.withColumn("level_offset", F.when(fits(1), 1).when(fits(0), 0).otherwise(1))


def ingest(metadata: DataFrame, absolute: bool = False, key: str = "z, x, y") -> DataFrame:
    """(level, sx, sy, ex, ey, ingest_seq) of metadata rows, each tile's once, the earliest by ingest_seq.

    absolute: entries are levels from 0 on (a layer description); no offset is looked for.
    """
    names = [k.strip() for k in key.split(",")]
    first = Window.partitionBy(*names).orderBy("ingest_seq")
    rows = metadata.where(F.size("available") > 0).withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    rows = rows.withColumn("base", F.lit(0)) if absolute else offset_of(rows).withColumn("base", F.col("z") + F.col("level_offset"))
    levels = rows.select("ingest_seq", "base", F.posexplode("available").alias("i", "rects"))
    return levels.select((F.col("base") + F.col("i")).cast("int").alias("level"), F.explode("rects").alias("r"), "ingest_seq").select("level", F.col("r.startX").alias("sx"), F.col("r.startY").alias("sy"), F.col("r.endX").alias("ex"), F.col("r.endY").alias("ey"), "ingest_seq")


def max_level(rects: DataFrame) -> DataFrame:
    """The deepest level of which anything is known to exist; 0 if nothing is."""
    return rects.agg(F.coalesce(F.max("level"), F.lit(0)).cast("int").alias("max_level"))


def coverage_center(rects: DataFrame) -> DataFrame:
    """Centre, in degrees, of the largest rectangle of the deepest level; the first ingested on a tie."""
    area = (F.col("ex") - F.col("sx") + 1) * (F.col("ey") - F.col("sy") + 1)
    best = rects.where("level > 0").withColumn("area", area).orderBy(F.desc("level"), F.desc("area"), "ingest_seq").limit(1)
    lon = (F.col("sx") + F.col("ex") + 1) / 2.0 / geo.columns_at(F.col("level")) * 360.0 - 180.0
    lat = (F.col("sy") + F.col("ey") + 1) / 2.0 / geo.rows_at(F.col("level")) * 180.0 - 90.0
    return best.select("level", "area", lat.alias("lat"), lon.alias("lon"))


def absent_lattice(rects: DataFrame, z: int, n: int) -> DataFrame:
    """The first n points of a coarse lattice of level z that no rectangle covers, row by row."""
    cols, rows = 2 << z, 1 << z
    spark = rects.sparkSession
    step = lambda size: f"sequence({size // 16}, {max(size - 1, size // 16)}, {max(size // 8, 1)})"
    grid = spark.range(1).select(F.explode(F.expr(step(cols))).alias("x")).withColumn("y", F.explode(F.expr(step(rows))))
    grid = grid.select(F.lit(z).alias("z"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))
    there = available(grid, rects)
    return grid.join(there, ["z", "x", "y"], "left_anti").orderBy("x", "y").limit(n).select("z", "x", "y")
