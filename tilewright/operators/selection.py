"""Terrain selection: which tiles of a quadtree a camera sees at which detail.

A tile's own facts decide alone: whether it is visible, whether its error is small enough or it
can't be refined (stop), whether all its visible children are built (ready).  A tile is reached if
all its ancestors are visible, don't stop and are ready.  So selection is an anti join of
(tile, ancestor) with the ancestors that block, not a walk: `select_tiles` for a table of
candidate tiles, and `select_deep` level by level, from the roots, where levels are too many to
list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions import geo
from tilewright.functions.camera import Camera
from tilewright.operators.availability import ancestors, available

VALVE_TILES, VALVE_FACTOR, VALVE_PASSES = 400, 1.5, 4


def tile_boxes(tiles: DataFrame, frame: geo.Frame, n: int = 5, low: float = -1000.0, high: float = 9000.0) -> DataFrame:
    """Adds a box (lo_x .. hi_z) in the local frame around each tile, padded by the globe's bulge.

    Of an n x n grid at two heights; all within the row.
    """
    rect = geo.tile_rect(F.col("z"), F.col("x"), F.col("y"))
    return _boxes(tiles, tiles.columns, *rect, F.lit(low), F.lit(high), frame, n)


def _boxes(rows: DataFrame, key: list[str], west, south, east, north, low, high, frame: geo.Frame, n: int) -> DataFrame:
    c, steps = F.col, [i / (n - 1) for i in range(n)]
    ends = dict(zip(("__w", "__s", "__e", "__n", "__h0", "__h1"), (west, south, east, north, low.cast("double"), high.cast("double")), strict=True))
    at = rows.withColumns(ends)
    span = geo.A * F.greatest(c("__e") - c("__w"), c("__n") - c("__s")) / float(n - 1)
    # A point is r (a cos lon + b sin lon) + c z + d on each axis of the frame, r and z of its latitude and height alone
    # and r never negative: so the ends over longitudes are taken first, and then those over latitudes and heights.
    shift = frame.from_ecef_shift()
    turn, rise, ends = {"__margin": F.least(span * span / (2.0 * geo.A), F.lit(geo.A))}, {}, {}
    for i, t in enumerate(steps):
        lon, lat = c("__w") + t * (c("__e") - c("__w")), c("__s") + t * (c("__n") - c("__s"))
        turn |= {f"__cos{i}": F.cos(lon), f"__sin{i}": F.sin(lon), f"__lat{i}": lat}
        rise |= {f"__{name}{i}{k}": v for k in (0, 1) for name, v in zip("rz", geo.meridian(c(f"__lat{i}"), c(f"__h{k}")), strict=True)}
    for m, (x, y, _) in zip("xyz", frame.axes, strict=True):
        along = [x * c(f"__cos{i}") + y * c(f"__sin{i}") for i in range(n)]
        rise |= {f"__lo_{m}": F.least(*along), f"__hi_{m}": F.greatest(*along)}
    at = at.withColumns(turn).withColumns(rise)
    for m, (_, _, z), d in zip("xyz", frame.axes, shift, strict=True):
        for end, pick, sign in (("lo", F.least, -1.0), ("hi", F.greatest, 1.0)):
            points = [c(f"__r{j}{k}") * c(f"__{end}_{m}") + z * c(f"__z{j}{k}") for j in range(n) for k in (0, 1)]
            ends[f"{end}_{m}"] = pick(*points) + d + sign * c("__margin")
    return at.select(*key, *(ends[f"{end}_{m}"].alias(f"{end}_{m}") for end in ("lo", "hi") for m in "xyz"))


def region_boxes(rows: DataFrame, key: list[str], frame: geo.Frame) -> DataFrame:
    """Boxes of regions (west, south, east, north, h0, h1), radians and metres; no transform applies."""
    c = F.col
    return _boxes(rows, key, c("west"), c("south"), c("east"), c("north"), c("h0"), c("h1"), frame, 3)


def tile_facts(tiles: DataFrame, rects: DataFrame, camera: Camera, frame: geo.Frame, threshold: float, max_level: int, imagery_max_z: int = geo.IMAGERY_MAX_Z, planes=None) -> DataFrame:
    """Facts of candidate tiles (z, x, y, state[, geometric_error]), which hold the children of all that may refine.

    Adds dist, err, visible_now, stop, ready.  A tile that isn't listed counts as queued and unseen.
    """
    planes = planes or camera.planes()
    pos = [F.lit(float(v)) for v in camera.pos]
    lo, hi = [F.col(f"lo_{a}") for a in "xyz"], [F.col(f"hi_{a}") for a in "xyz"]
    limit = geo.horizon_limit(frame, *pos)
    z, x, y = F.col("z"), F.col("x"), F.col("y")
    own_error = F.coalesce(F.col("geometric_error"), geo.default_error(z)) if "geometric_error" in tiles.columns else geo.default_error(z)
    boxed = tile_boxes(tiles, frame).withColumn("dist", geo.box_distance(lo, hi, pos))
    error = F.greatest(own_error, geo.imagery_floor(z, x, y, imagery_max_z))
    # Always true, but not deterministic to Spark, so a filter on visible_now stays above the box's columns: below them it
    # would hold every point's terms again for each plane, millions of characters of code.
    stays = F.monotonically_increasing_id() >= 0
    seen = boxed.withColumn("visible_now", geo.box_in_planes(lo, hi, planes) & (F.col("dist") <= limit) & stays).withColumn("err", F.round(geo.sse(error, F.col("dist"), camera.height_px, camera.p11, camera.perspective), 6))
    there = available(seen.where(z > imagery_max_z).select("z", "x", "y").distinct(), rects).withColumn("real", F.lit(True))
    kids = seen.join(there, ["z", "x", "y"], "left").where("z > 0").select((z - 1).alias("z"), geo.shift_right(x, 1).alias("x"), geo.shift_right(y, 1).alias("y"), "visible_now", "state", (F.coalesce("real", F.lit(False)) | (z <= imagery_max_z)).alias("exists"))
    about = kids.groupBy("z", "x", "y").agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_and(F.col("exists") & (F.coalesce("state", F.lit("queued")) != "dead")).alias("good"),
        F.bool_and(~F.col("visible_now") | (F.coalesce("state", F.lit("queued")) == "built")).alias("ready"),
    )
    refinable = (z < max_level) & F.coalesce(F.col("good"), F.lit(False)) & (F.coalesce(F.col("n"), F.lit(0)) == 4)
    out = seen.join(about, ["z", "x", "y"], "left")
    return out.select(*seen.columns, ((F.col("err") <= threshold) | ~refinable).alias("stop"), F.coalesce("ready", F.lit(False)).alias("ready"))


def visited(facts: DataFrame) -> DataFrame:
    """Visible tiles all of whose ancestors pass: visible, not stopping, ready."""
    block = facts.where(~(F.col("visible_now") & ~F.col("stop") & F.col("ready"))).select(F.col("z").alias("az"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    seen = facts.where("visible_now")
    up = ancestors(seen.select("z", "x", "y"), own=False)
    blocked = up.join(block, ["az", "ax", "ay"], "left_semi").select("z", "x", "y").distinct()
    return seen.join(blocked, ["z", "x", "y"], "left_anti")


def render(facts: DataFrame) -> DataFrame:
    """(z, x, y) to show: visited tiles that stop or whose children aren't ready."""
    return visited(facts).where(F.col("stop") | ~F.col("ready")).select("z", "x", "y")


def load(facts: DataFrame) -> DataFrame:
    """(priority, z, x, y) to fetch, most urgent first by ascending priority.

    Visited tiles at their own error, and visible children of visited tiles that refine but
    aren't ready at their parent's; of those only queued and failed ones; each once, as a walk meets it.
    """
    reached = visited(facts)
    wanted = F.coalesce("state", F.lit("queued")).isin("queued", "failed")
    own = reached.where(wanted).select((-F.col("err")).alias("priority"), "z", "x", "y")
    parents = reached.where(~F.col("stop") & ~F.col("ready")).select(F.col("z").alias("pz"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("err").alias("perr"))
    kids = facts.where(F.col("visible_now") & wanted & (F.col("z") > 0)).select("z", "x", "y", (F.col("z") - 1).alias("pz"), geo.shift_right(F.col("x"), 1).alias("px"), geo.shift_right(F.col("y"), 1).alias("py"))
    below = kids.join(parents, ["pz", "px", "py"]).select((-F.col("perr")).alias("priority"), "z", "x", "y")
    # A visited tile is no child of a parent that isn't ready, so no tile is in both.
    return own.unionByName(below)


def keep_set(rendered: DataFrame) -> DataFrame:
    """Rendered tiles and all their ancestors."""
    return ancestors(rendered.select("z", "x", "y")).select(F.col("az").alias("z"), F.col("ax").alias("x"), F.col("ay").alias("y")).distinct()


def with_valve(facts: DataFrame, threshold: float, most: int = VALVE_TILES) -> tuple[DataFrame, float]:
    """render() at the first of the thresholds t, 1.5 t, 2.25 t, 3.375 t that shows at most `most` tiles, else at the last.

    facts need a column `refinable` or are made with stop at `threshold`; here stop is raised with
    the threshold.  Returns the threshold used.
    """
    used = threshold
    out = render(facts)
    for _ in range(VALVE_PASSES - 1):
        if out.limit(most + 1).count() <= most:
            break
        used *= VALVE_FACTOR
        out = render(facts.withColumn("stop", F.col("stop") | (F.col("err") <= used)))
    return out, used


def select_deep(rects: DataFrame, states: DataFrame, camera: Camera, frame: geo.Frame, threshold: float, max_level: int, imagery_max_z: int = geo.IMAGERY_MAX_Z, planes=None) -> DataFrame:
    """render() to any depth: a frontier of visited tiles, level by level, of which only visible ones go on.

    states (z, x, y, state) of known tiles.  At most max_level + 1 rounds; each level is written, so
    plans stay short and a lost executor costs one level.
    """
    from tilewright.sources.shared import written

    spark = states.sparkSession
    frontier = spark.createDataFrame([(0, 0, 0), (0, 1, 0)], "z int, x long, y long")
    out = None
    for _ in range(max_level + 1):
        kids = frontier.select(F.explode(geo.children(F.col("z"), F.col("x"), F.col("y"))).alias("k")).select("k.*")
        known = frontier.unionByName(kids).join(states.select("z", "x", "y", "state"), ["z", "x", "y"], "left")
        facts = written(tile_facts(known, rects, camera, frame, threshold, max_level, imagery_max_z, planes), "frontier")
        here = facts.join(frontier, ["z", "x", "y"], "left_semi").where("visible_now")
        shown = here.where(F.col("stop") | ~F.col("ready")).select("z", "x", "y")
        out = shown if out is None else out.unionByName(shown)
        parents = here.where(~F.col("stop") & F.col("ready")).select(F.col("z").alias("pz"), F.col("x").alias("px"), F.col("y").alias("py"))
        below = facts.where("visible_now and z > 0").select("z", "x", "y", (F.col("z") - 1).alias("pz"), geo.shift_right(F.col("x"), 1).alias("px"), geo.shift_right(F.col("y"), 1).alias("py"))
        frontier = written(below.join(parents, ["pz", "px", "py"], "left_semi").select(F.col("z").cast("int").alias("z"), "x", "y"), "frontier")
        if frontier.isEmpty():
            break
    return out
