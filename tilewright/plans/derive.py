"""Views of the star-schema tables that stand in for geodata, each the same for any engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import geo


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def geo_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, lon, lat, h) in degrees and metres."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), ((k * 137.5077640500378) % 360 - 180).alias("lon"), ((k * 61.8033988749895) % 170 - 85).alias("lat"), F.col("c_acctbal").alias("h"))


def tile_hits(spark: SparkSession, sf_dir: str, levels: range = range(1, 10)) -> DataFrame:
    """The tile of each point at each level."""
    rows = geo_points(spark, sf_dir).withColumn("z", F.explode(F.array(*map(F.lit, levels))))
    x, y = geo.tile_at(F.col("z"), F.col("lon"), F.col("lat"))
    return rows.withColumn("x", x).withColumn("y", y)


def avail_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(level, sx, sy, ex, ey, ingest_seq): inclusive rectangles of tiles that exist."""
    k = F.col("s_suppkey")
    base = table(spark, sf_dir, "supplier").select(k.alias("ingest_seq"), (1 + k % 9).cast("int").alias("level"))
    cols, rows = geo.columns_at(F.col("level")), geo.rows_at(F.col("level"))
    base = base.withColumn("cols", cols).withColumn("rows", rows).withColumn("sx", (F.col("ingest_seq") * 37) % F.col("cols")).withColumn("sy", (F.col("ingest_seq") * 11) % F.col("rows"))
    return base.select(
        "level",
        "sx",
        "sy",
        F.least(F.col("sx") + F.greatest(F.expr("cols div 8"), F.lit(1)), F.col("cols") - 1).alias("ex"),
        F.least(F.col("sy") + F.greatest(F.expr("rows div 4"), F.lit(1)), F.col("rows") - 1).alias("ey"),
        "ingest_seq",
    )


def pyramid(spark: SparkSession, max_z: int) -> DataFrame:
    """All tiles of levels 0 to max_z."""
    n = 2 * (4 ** (max_z + 1) - 1) // 3
    z = F.floor(F.log2(F.col("id") * 1.5 + 1.0001) / 2.0)
    rows = spark.range(n).withColumn("z", z.cast("int"))
    rows = rows.withColumn("k", F.col("id") - (2 * (F.pow(F.lit(4.0), F.col("z")).cast("long") - 1) / 3).cast("long"))
    cols = geo.columns_at(F.col("z"))
    return rows.select("z", (F.col("k") % cols).alias("x"), F.expr("k div shiftleft(2L, z)").alias("y"))


def tile_states(tiles: DataFrame) -> DataFrame:
    """A life-cycle state for each tile (z, x, y), as if a session had run for a while."""
    k = (F.col("x") * 7 + F.col("y") * 13 + F.col("z") * 5) % 97
    state = F.when((F.col("z") < 3) | (k < 80), "built").when(k < 87, "queued").when(k < 91, "failed").when(k < 93, "fetching").when(k < 96, "decoded").otherwise("dead")
    return tiles.withColumn("state", state).withColumn("visible", (k % 3 == 0) & (F.col("state") == "built")).withColumn("last_wanted", (((F.col("x") * 31 + F.col("y") * 17 + F.col("z")) % 97) / 2.0))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of tile contents: a root, regions, nations (no content of their own), suppliers."""
    cast = "id long, parent long, depth int, error double, refine string, uri string, lo_x double, lo_y double, lo_z double, hi_x double, hi_y double, hi_z double, is_ready boolean"
    box = lambda half: [F.lit(-half), F.lit(-half), F.lit(-100.0), F.lit(half), F.lit(half), F.lit(300.0)]
    none = F.lit(None).cast("string")
    root = spark.range(1).select("id", F.lit(None), F.lit(0), F.lit(500_000.0), F.lit("REPLACE"), none, *box(40_000.0), F.lit(False))
    r, n, s = F.col("r_regionkey"), F.col("n_nationkey"), F.col("s_suppkey")
    regions = table(spark, sf_dir, "region").select(r + 1, F.lit(0), F.lit(1), F.lit(20_000.0), F.lit("REPLACE"), F.concat(F.lit("r"), r, F.lit(".b3dm")), *box(30_000.0), r >= 0)
    nations = table(spark, sf_dir, "nation").select(n + 100, F.col("n_regionkey") + 1, F.lit(2), F.lit(3000.0), F.when(n % 2 == 0, "ADD").otherwise("REPLACE"), F.when(n % 5 == 4, F.concat(F.lit("n"), n, F.lit(".glb"))), *box(25_000.0), n % 3 != 1)
    cx, cy = ((s * 7919) % 20001 - 10_000).cast("double"), ((s * 104_729) % 20001 - 10_000).cast("double")
    uri = F.when((F.col("s_nationkey") == 3) & (s % 4 == 0), F.concat(F.lit("x"), s, F.lit("/tileset.json?v=1"))).otherwise(F.concat(F.lit("s"), s, F.lit(".glb")))
    leaves = table(spark, sf_dir, "supplier").select(s + 10_000, F.col("s_nationkey") + 100, F.lit(3), F.lit(60.0), F.lit("REPLACE"), uri, cx - 200.0, cy - 200.0, F.lit(-50.0), cx + 200.0, cy + 200.0, F.lit(150.0), (F.col("s_nationkey") > 2) | (s % 2 == 1))
    fields = [c.split() for c in cast.split(", ")]
    tidy = lambda df: df.toDF(*(f for f, _ in fields)).select(*(F.col(f).cast(t).alias(f) for f, t in fields))
    return tidy(root).unionByName(tidy(regions)).unionByName(tidy(nations)).unionByName(tidy(leaves))


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq order: ts, event_id) requests with an outcome: ok, http, conn, dead."""
    kind = F.when(F.col("event_type") == "purchase", "ok").when(F.col("event_type") == "error", "conn").when(F.col("event_type") == "signup", "dead").otherwise("http")
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", kind.alias("outcome"), "value")
