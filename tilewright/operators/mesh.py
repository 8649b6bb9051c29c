"""Terrain meshes: running-sum decoders, sampling of triangle nets, resampling, projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions import geo
from tilewright.sources.shared import written

QUANT = 32767.0


def zigzag(v: Column) -> Column:
    return F.call_function("shiftright", v, F.lit(1)).bitwiseXOR(-v.bitwiseAND(F.lit(1)))


def zigzag_running(codes: DataFrame, part: list[str], order: list[str], code: str) -> DataFrame:
    """Adds `value`: the running sum of zig-zag deltas within each part."""
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return codes.withColumn("value", F.sum(zigzag(F.col(code).cast("long"))).over(w))


def highwater(codes: DataFrame, part: list[str], order: list[str], code: str) -> DataFrame:
    """Adds `index`: zeros strictly before, less the code."""
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    zero = (F.col(code) == 0).cast("long")
    return codes.withColumn("index", F.sum(zero).over(w) - zero - F.col(code))


def sample_net(points: DataFrame, triangles: DataFrame, vertices: DataFrame, mesh: str, point: str, cell: float) -> DataFrame:
    """Heights of points (mesh, point, px, py) on nets: (mesh, point, h, hit).

    triangles (mesh, tri, x1..h3), vertices (mesh, v, vx, vy, vh).  The first triangle, by tri, that
    holds the point gives a barycentric height; a point in none gets its nearest vertex's, the first by v
    on a tie.  Triangles are listed by the cells of a grid that their boxes touch, so the theta join is
    an equi join with a residual, and no mesh's points meet all its triangles.
    """
    eps = 1e-9
    span = lambda c: [F.col(f"{c}{i}") for i in (1, 2, 3)]
    at = lambda v: F.floor(v / cell).cast("long")
    cells = triangles.withColumn("cx", F.explode(F.sequence(at(F.least(*span("x")) - eps), at(F.greatest(*span("x")) + eps)))).withColumn("cy", F.explode(F.sequence(at(F.least(*span("y")) - eps), at(F.greatest(*span("y")) + eps))))
    pts = points.withColumn("cx", at(F.col("px"))).withColumn("cy", at(F.col("py")))
    c = F.col
    d = (c("y2") - c("y3")) * (c("x1") - c("x3")) + (c("x3") - c("x2")) * (c("y1") - c("y3"))
    # Hinted, as Spark takes an exploded frame to be as small as what it comes from and would broadcast it.
    met = pts.join(cells.hint("merge"), [mesh, "cx", "cy"]).withColumn("d", F.nullif(d, F.lit(0.0)))
    met = met.withColumn("w1", ((c("y2") - c("y3")) * (c("px") - c("x3")) + (c("x3") - c("x2")) * (c("py") - c("y3"))) / c("d"))
    met = met.withColumn("w2", ((c("y3") - c("y1")) * (c("px") - c("x3")) + (c("x1") - c("x3")) * (c("py") - c("y3"))) / c("d"))
    met = met.withColumn("w3", 1.0 - c("w1") - c("w2")).where((c("w1") >= -eps) & (c("w2") >= -eps) & (c("w3") >= -eps))
    height = c("w1") * c("h1") + c("w2") * c("h2") + c("w3") * c("h3")
    hits = met.groupBy(mesh, point).agg(F.min_by(height, "tri").alias("h")).withColumn("hit", F.lit(True))
    missed = points.join(hits.select(mesh, point).hint("merge"), [mesh, point], "left_anti").select(mesh, point, "px", "py")
    return hits.unionByName(nearest_vertex(missed, vertices, mesh, point, cell).withColumn("hit", F.lit(False)))


def nearest_vertex(points: DataFrame, vertices: DataFrame, mesh: str, point: str, cell: float) -> DataFrame:
    """(mesh, point, h) of each point's nearest vertex in its mesh, the first by v on a tie.

    By the cells of a grid, in rings that double: a vertex no farther than the ring's inner reach is the
    nearest one, so no point meets vertices far beyond its own.  Points of meshes without vertices have no row.
    """
    c = F.col
    at = lambda v: F.floor(v / cell).cast("long")
    cells = vertices.select(mesh, at(c("vx")).alias("cx"), at(c("vy")).alias("cy"), "vx", "vy", "vh", "v")
    left = written(points.join(vertices.select(mesh).distinct().hint("merge"), mesh, "left_semi").withColumn("cx", at(c("px"))).withColumn("cy", at(c("py"))), "missed")
    out, reach = None, 1
    apart = (c("vx") - c("px")) * (c("vx") - c("px")) + (c("vy") - c("py")) * (c("vy") - c("py"))
    while not left.isEmpty():
        ring = F.array(*(F.lit(i) for i in range(-1, 2)))
        # One coarser grid a ring, so that a point always meets nine cells.
        wide = lambda v: F.floor(v / reach).cast("long")
        here = left.withColumn("gx", F.explode(F.transform(ring, lambda i: wide(c("cx")) + i))).withColumn("gy", F.explode(F.transform(ring, lambda i: wide(c("cy")) + i)))
        there = cells.withColumns({"gx": wide(c("cx")), "gy": wide(c("cy"))}).drop("cx", "cy")
        best = here.join(there.hint("merge"), [mesh, "gx", "gy"]).groupBy(mesh, point).agg(F.min(F.struct(apart.alias("d"), c("v"), c("vh"))).alias("best"))
        found = written(best.where(c("best.d") <= (reach * cell) ** 2).select(mesh, point, c("best.vh").alias("h")), "nearest")
        out = found if out is None else out.unionByName(found)
        left = written(left.join(found.select(mesh, point).hint("merge"), [mesh, point], "left_anti"), "missed")
        reach *= 2
    return out if out is not None else points.join(vertices.select(mesh, F.col("vh").alias("h")), mesh).select(mesh, point, "h").limit(0)


def grid_points(requests: DataFrame, n: int) -> DataFrame:
    """Grid (i, j) over a descendant's square in its ancestor's units: requests (z, x, y, az, ax, ay)."""
    dz = (F.col("z") - F.col("az")).cast("int")
    scale = F.lit(1.0) / F.call_function("shiftleft", F.lit(1).cast("long"), dz)
    base = lambda v, a: (F.col(v) - F.call_function("shiftleft", F.col(a), dz)) * scale
    rows = requests.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return rows.withColumn("px", (base("x", "ax") + F.col("i") / (n - 1) * scale) * QUANT).withColumn("py", (base("y", "ay") + F.col("j") / (n - 1) * scale) * QUANT)


def requantized(samples: DataFrame, key: list[str]) -> DataFrame:
    """Heights in metres (h_m) to the tile's own range: adds min_h, max_h, hq (half to even)."""
    ends = samples.groupBy(*key).agg(F.min("h_m").alias("min_h"), F.max("h_m").alias("max_h"))
    share = (F.col("h_m") - F.col("min_h")) / F.nullif(F.col("max_h") - F.col("min_h"), F.lit(0.0))
    return samples.join(ends, key).withColumn("hq", F.coalesce(F.rint(share * QUANT), F.lit(0.0)).cast("int"))


def to_local(vertices: DataFrame, frame: geo.Frame) -> DataFrame:
    """Vertices (z, x, y, u, v, h quantized, min_h, max_h) with lon, lat, height and e, n, up."""
    west, south, east, north = geo.tile_rect(F.col("z"), F.col("x"), F.col("y"))
    rows = vertices.withColumn("lon", west + F.col("u") / QUANT * (east - west)).withColumn("lat", south + F.col("v") / QUANT * (north - south)).withColumn("height", F.col("min_h") + F.col("h") / QUANT * (F.col("max_h") - F.col("min_h")))
    e, n, u = frame.from_geodetic(F.col("lon"), F.col("lat"), F.col("height"))
    return rows.withColumn("e", e).withColumn("n", n).withColumn("up", u)


def uv_linear(u: Column, v: Column, scale: Column, u_off: Column, v_off: Column) -> tuple[Column, Column]:
    return u / QUANT * scale + u_off, v / QUANT * scale + v_off


def uv_mercator(lon: Column, lat: Column, rect: tuple[Column, Column, Column, Column]) -> tuple[Column, Column]:
    """Texture coordinates in a cover's normalized bounds, clipped to it."""
    x, y = geo.mercator(lon, lat)
    x0, y0, x1, y1 = rect
    clip = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    return clip((x - x0) / (x1 - x0)), clip((y - y0) / (y1 - y0))


def net(decoded: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(vertices, triangles) of decoded tiles, as sample_net() takes them; heights in metres."""
    c = F.col
    rows = decoded.where("error is null")
    metres = lambda q: c("min_h") + q / QUANT * (c("max_h") - c("min_h"))
    vertices = rows.select(*key, "min_h", "max_h", F.posexplode(F.arrays_zip("u", "v", "h")).alias("k", "p"))
    vertices = vertices.select(*key, c("k").cast("long").alias("v"), c("p.u").cast("double").alias("vx"), c("p.v").cast("double").alias("vy"), metres(c("p.h")).alias("vh"))
    corner = lambda name, i: F.element_at(c(name), (F.element_at("indices", (3 * c("tri") + i).cast("int")) + 1).cast("int"))
    with_any = rows.where(F.size("indices") >= 3).withColumn("tri", F.explode(F.sequence(F.lit(0), (F.size("indices") / 3).cast("int") - 1)))
    sides = [x for i in (1, 2, 3) for x in (corner("u", i).cast("double").alias(f"x{i}"), corner("v", i).cast("double").alias(f"y{i}"), metres(corner("h", i)).alias(f"h{i}"))]
    return vertices, with_any.select(*key, c("tri").cast("long").alias("tri"), *sides)


def grid_triangles(n: int) -> list[int]:
    """Corners of the triangles of an n x n grid by rows: two for each cell, turning from east to north."""
    cells = [j * n + i for j in range(n - 1) for i in range(n - 1)]
    return [v for at in cells for v in (at, at + 1, at + n + 1, at, at + n + 1, at + n)]


def grid_edges(n: int) -> dict[str, list[int]]:
    """The vertices on a grid's sides."""
    return {"west": list(range(0, n * n, n)), "south": list(range(n)), "east": list(range(n - 1, n * n, n)), "north": list(range(n * n - n, n * n))}


def upsample(requests: DataFrame, decoded: DataFrame, n: int = 33) -> DataFrame:
    """Tiles below their deepest real ancestors, resampled from these: requests (z, x, y, az, ax, ay), decoded with z, x, y.

    (z, x, y, min_h, max_h, u, v, h, indices, west, south, east, north): a grid of n x n vertices, heights
    quantized to the tile's own range.  Siblings sample the same points of their ancestor along a common side.
    """
    requests = requests.where("z > az")
    anchor = F.struct(F.col("az").cast("long").alias("z"), F.col("ax").cast("long").alias("x"), F.col("ay").cast("long").alias("y")).alias("mesh")
    number = F.struct("z", "x", "y", F.col("point").cast("long").alias("i")).alias("point")
    points = grid_points(requests, n).withColumn("point", F.col("j") * n + F.col("i")).select(anchor, number, "px", "py")
    own = F.struct(F.col("z").cast("long").alias("z"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).alias("mesh")
    vertices, triangles = net(decoded.withColumn("mesh", own), ["mesh"])
    heights = sample_net(points, triangles, vertices, "mesh", "point", QUANT / 8).select("point.z", "point.x", "point.y", F.col("point.i").alias("i"), F.col("h").alias("h_m"))
    # A tile's samples are n * n.
    tiles = heights.groupBy("z", "x", "y").agg(F.min("h_m").alias("min_h"), F.max("h_m").alias("max_h"), F.array_sort(F.collect_list(F.struct("i", "h_m"))).alias("at"))
    share = lambda p: (p["h_m"] - F.col("min_h")) / F.nullif(F.col("max_h") - F.col("min_h"), F.lit(0.0))
    h = F.transform("at", lambda p: F.coalesce(F.rint(share(p) * QUANT), F.lit(0.0)).cast("int"))
    place = [round(k / (n - 1) * QUANT) for k in range(n)]
    fixed = {"u": place * n, "v": [q for q in place for _ in range(n)], "indices": grid_triangles(n), **grid_edges(n)}
    whole = lambda v, kind: F.array(*map(F.lit, v)).cast(f"array<{kind}>")
    columns = [whole(v, "int" if name in "uv" else "long").alias(name) for name, v in fixed.items()]
    return tiles.select("z", "x", "y", "min_h", "max_h", h.alias("h"), *columns)


def tile_mesh(tiles: DataFrame, frame: geo.Frame, cover: bool = False) -> DataFrame:
    """Decoded tiles (z, x, y, u, v, h, indices, min_h, max_h) as meshes in the local frame, all within the row.

    positions array<struct<e, n, up: float>>, loops (a vertex for each corner), loop_uvs (u, v for each
    corner), n_triangles, lows and highs (of the exact positions).  Texture coordinates are linear (tiles
    have scale, u_off, v_off) or, of a cover, mercator ones in its bounds (x0, y0, x1, y1).
    """
    c = F.col
    west, south, east, north = geo.tile_rect(c("z"), c("x"), c("y"))
    rows = tiles.withColumns({"__w": west, "__s": south, "__e": east, "__n": north})
    lon = lambda p: c("__w") + p["u"] / QUANT * (c("__e") - c("__w"))
    lat = lambda p: c("__s") + p["v"] / QUANT * (c("__n") - c("__s"))
    height = lambda p: c("min_h") + p["h"] / QUANT * (c("max_h") - c("min_h"))

    def vertex(p):
        e, n, up = frame.from_geodetic(lon(p), lat(p), height(p))
        uv = uv_mercator(lon(p), lat(p), (c("x0"), c("y0"), c("x1"), c("y1"))) if cover else uv_linear(p["u"], p["v"], c("scale"), c("u_off"), c("v_off"))
        return F.struct(e.alias("e"), n.alias("n"), up.alias("up"), *(t.cast("float").alias(name) for t, name in zip(uv, "st", strict=True)))

    rows = rows.withColumn("__at", F.transform(F.arrays_zip("u", "v", "h"), vertex))
    axis = lambda a: F.transform("__at", lambda p: p[a])
    ends = {name: F.array(*(pick(axis(a)) for a in ("e", "n", "up"))) for name, pick in (("lows", F.array_min), ("highs", F.array_max))}
    out = {
        "positions": F.transform("__at", lambda p: F.struct(*(p[a].cast("float").alias(a) for a in ("e", "n", "up")))),
        "loops": c("indices").cast("array<int>"),
        "loop_uvs": F.flatten(F.transform("indices", lambda i: F.array(F.element_at("__at", (i + 1).cast("int"))["s"], F.element_at("__at", (i + 1).cast("int"))["t"]))),
        "n_triangles": (F.size("indices") / 3).cast("int"),
    }
    kept = [x for x in ("geometric_error", "metadata") if x in tiles.columns]
    return rows.withColumns({**out, **ends}).select("z", "x", "y", "min_h", "max_h", *kept, *out, *ends)


def ground_below(cameras: DataFrame, hits: DataFrame, tries: int = 4, drop: float = 3000.0) -> DataFrame:
    """(id, ground) of cameras (id, up): the highest of what lies straight below that isn't a slab.

    hits (id, h, slab): surfaces in each camera's vertical.  At most `tries` of them are looked at, from the
    top; if all are slabs, or there is none, the ground is thought to be `drop` below the camera.
    """
    w = Window.partitionBy("id").orderBy(F.desc("h"), F.desc("slab"))
    first = hits.where("h is not null").withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= tries)
    found = first.where("not slab").groupBy("id").agg(F.max("h").alias("h"))
    return cameras.join(found, "id", "left").select("id", F.coalesce("h", F.col("up") - drop).alias("ground"))
