"""One query for each operator, over views derived from the star-schema tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import geo, text
from tilewright.functions.camera import Camera
from tilewright.operators import availability as av
from tilewright.operators import lifecycle, mesh, selection, style, tree
from tilewright.plans import derive
from tilewright.plans.derive import table
from tilewright.sources.shared import written

FRAME = geo.Frame(46.55, 7.98)
CAMERA = Camera(pos=(0.0, 0.0, 2000.0), heading=20.0, pitch=-15.0)
#: High above the globe, for selection over whole levels.
HIGH = Camera(pos=(0.0, 0.0, 1_500_000.0), heading=20.0, pitch=-55.0)
THRESHOLD = 2.0
MAX_Z = 6
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _r(c, n: int = 6):
    # Adding zero turns a negative zero into the other one.
    return F.round(c, n) + F.lit(0.0)


def _hits(spark: SparkSession, sf: str, *names: str) -> DataFrame:
    return derive.tile_hits(spark, sf).select("id", F.col("z").cast("long").alias("z"), "x", "y", *names)


# Scalars -----------------------------------------------------------------------------------------


@query
def ecef(spark, sf):
    p = derive.geo_points(spark, sf)
    x, y, z = geo.ecef(F.radians("lon"), F.radians("lat"), F.col("h"))
    return p.select("id", _r(x, 3).alias("ex"), _r(y, 3).alias("ey"), _r(z, 3).alias("ez"))


@query
def enu(spark, sf):
    p = derive.geo_points(spark, sf)
    e, n, u = FRAME.from_geodetic(F.radians("lon"), F.radians("lat"), F.col("h"))
    return p.select("id", _r(e, 3).alias("e"), _r(n, 3).alias("n"), _r(u, 3).alias("u"))


@query
def tile_rect(spark, sf):
    rect = geo.tile_rect(F.col("z"), F.col("x"), F.col("y"))
    return _hits(spark, sf).select("id", "z", *(_r(c, 9).alias(n) for c, n in zip(rect, ("west", "south", "east", "north"), strict=True)))


@query
def children_parent(spark, sf):
    tiles = _hits(spark, sf).select("z", "x", "y").distinct()
    kids = tiles.select("z", "x", "y", F.explode(geo.children(F.col("z"), F.col("x"), F.col("y"))).alias("k"))
    return kids.select("z", "x", "y", F.col("k.z").alias("kz"), F.col("k.x").alias("kx"), F.col("k.y").alias("ky"), geo.shift_right(F.col("k.x"), 1).alias("px"), geo.shift_right(F.col("k.y"), 1).alias("py"))


@query
def lonlat_to_tile(spark, sf):
    return _hits(spark, sf)


@query
def uv_ancestor(spark, sf):
    uv = geo.ancestor_uv(F.col("z"), F.col("x"), F.col("y"), F.lit(4))
    cast = {"az": "long", "ax": "long", "ay": "long"}
    return _hits(spark, sf).select("id", "z", *(c.cast(cast.get(n, "double")).alias(n) for n, c in uv.items()))


@query
def merc_norm(spark, sf):
    x, y = geo.mercator(F.radians("lon"), F.radians("lat"))
    return derive.geo_points(spark, sf).select("id", _r(x, 9).alias("mx"), _r(y, 9).alias("my"))


@query
def quadkey(spark, sf):
    top = geo.rows_at(F.col("z")) * 2 - 1 - F.col("y")
    return _hits(spark, sf).select("id", "z", text.quadkey((F.col("z") + 1).cast("int"), F.col("x"), top).alias("qk"), ((F.col("x") + top) % 4).alias("sub"))


@query
def sse(spark, sf):
    d = F.abs(F.col("h")) * 10 + 1
    err = geo.sse(geo.default_error(F.col("z")), d, CAMERA.height_px, CAMERA.p11)
    flat = geo.sse(geo.default_error(F.col("z")), d, CAMERA.height_px, CAMERA.p11, perspective=False)
    return _hits(spark, sf, "h").select("id", "z", _r(err, 6).alias("err"), _r(flat, 6).alias("ortho"))


@query
def ge_floor(spark, sf):
    return _hits(spark, sf).select("id", "z", _r(geo.imagery_floor(F.col("z"), F.col("x"), F.col("y"), 8), 6).alias("least"))


@query
def horizon(spark, sf):
    p = derive.geo_points(spark, sf)
    limit = geo.horizon_limit(FRAME, F.col("lon") * 100, F.col("lat") * 100, F.abs("h"))
    return p.select("id", _r(limit, 2).alias("limit_m"))


@query
def frustum_planes(spark, sf):
    p = derive.geo_points(spark, sf)
    cells = [F.round(F.sin(F.col("id") * (i + 1)), 6) for i in range(16)]
    planes = geo.frustum_planes(F.col("m"))
    out = [_r(c, 6).alias(f"p{i}{'abcd'[j]}") for i, plane in enumerate(planes) for j, c in enumerate(plane)]
    return p.select("id", F.array(*cells).alias("m")).select("id", *out)


def _point_boxes(spark, sf):
    rows = derive.geo_points(spark, sf)
    c = F.col
    lo = [(c("lon") * 100).alias("lo_x"), (c("lat") * 100).alias("lo_y"), c("h").alias("lo_z")]
    hi = [(c("lon") * 100 + 500).alias("hi_x"), (c("lat") * 100 + 300).alias("hi_y"), (c("h") + 50).alias("hi_z")]
    return rows.select("id", *lo, *hi)


def _ends():
    return [F.col(f"lo_{a}") for a in "xyz"], [F.col(f"hi_{a}") for a in "xyz"]


@query
def frustum_cull(spark, sf):
    lo, hi = _ends()
    return _point_boxes(spark, sf).where(geo.box_in_planes(lo, hi, [tuple(round(v, 6) for v in p) for p in CAMERA.planes()])).select("id")


@query
def aabb_dist(spark, sf):
    lo, hi = _ends()
    d = geo.box_distance(lo, hi, [F.lit(v) for v in CAMERA.pos])
    return _point_boxes(spark, sf).select("id", _r(d, 6).alias("dist"))


# Sources, names ----------------------------------------------------------------------------------


@query
def tile_url(spark, sf):
    return _hits(spark, sf).select("id", "z", text.tile_url(F.lit("https://tiles.example/v1/{z}/{x}/{y}.terrain"), F.col("z"), F.col("x"), F.col("y")).alias("url"))


@query
def strip_html(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", F.length(text.strip_html(F.col("html"))).cast("long").alias("n"), F.md5(text.strip_html(F.col("html")).cast("binary")).alias("plain_md5"))


@query
def url_sha1(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.sha1("url").alias("url_sha1"))


@query
def url_namespace(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.url_namespace(F.col("url")).alias("namespace"))


@query
def sniff_ext(spark, sf):
    kinds = F.array(*(F.lit(bytes.fromhex(h)) for h in ("FFD8FFE0", "89504E470D0A", "49492A00", "4D4D002A", "00010203")))
    d = table(spark, sf, "documents")
    content = F.concat(F.element_at(kinds, (F.col("doc_id") % 5 + 1).cast("int")), F.coalesce("text", F.lit("")).cast("binary"))
    return d.select("doc_id", text.sniff_ext(content).alias("ext"))


@query
def content_kind(spark, sf):
    kinds = F.array(*map(F.lit, ("glTF", "b3dm", "cmpt", "pnts", "i3dm", "what")))
    d = table(spark, sf, "documents")
    content = F.concat(F.element_at(kinds, (F.col("doc_id") % 6 + 1).cast("int")), F.coalesce("text", F.lit(""))).cast("binary")
    return d.select("doc_id", text.content_kind(content).alias("kind"))


@query
def ext_priority(spark, sf):
    """Of a tile's files the one to use: .jpg, .png, .tif; others don't count."""
    files = sniff_ext(spark, sf).select((F.col("doc_id") % 97).alias("tile"), "ext")
    return files.groupBy("tile").agg(text.first_image(F.col("ext")).alias("ext")).where("ext is not null")


@query
def tile_names(spark, sf):
    key = [F.col(c) for c in "zxy"]
    return _hits(spark, sf).select("id", "z", text.object_name(*key).alias("object"), text.material_name("M", F.lit("img"), key).alias("material"))


@query
def resolve_uri(spark, sf):
    base = F.concat(F.regexp_replace("url", "[?#].*", ""), F.lit("?session=s"), F.col("page_id") % 7, F.lit("&key=k1&blank="))
    child = F.concat(F.lit("https://cdn.example/t/"), F.col("page_id"), F.when(F.col("page_id") % 3 == 0, ".glb?key=own").when(F.col("page_id") % 3 == 1, ".glb").otherwise(".json?v=2"))
    return table(spark, sf, "pages").select("page_id", text.inherited_query(base, child).alias("resolved"))


# Availability, covers ----------------------------------------------------------------------------


@query
def availability(spark, sf):
    return av.available(_hits(spark, sf), derive.avail_rects(spark, sf))


@query
def nearest_real_ancestor(spark, sf):
    hits = _hits(spark, sf).select("id", F.col("z").cast("int").alias("z"), F.col("z").alias("level"), "x", "y")
    out = av.nearest_real_ancestor(hits, derive.avail_rects(spark, sf), ["id", "level"])
    return out.select("id", "level", F.col("az").cast("long").alias("az"), "ax", "ay")


@query
def imagery_fallback(spark, sf):
    hits = _hits(spark, sf)
    have = hits.where((F.col("x") * 3 + F.col("y") * 5 + F.col("z")) % 4 == 0).select("z", "x", "y")
    out = av.imagery_fallback(hits.withColumn("level", F.col("z")).withColumn("z", F.col("z").cast("int")), have, ["id", "level"], 7)
    return out.select("id", "level", F.col("az").cast("long").alias("az"), "ax", "ay")


def _tiles(spark, sf):
    return _hits(spark, sf).select("z", "x", "y").distinct()


@query
def merc_cover(spark, sf):
    tiles = _tiles(spark, sf)
    out = av.mercator_cover(tiles, ["z", "x", "y"])
    return out.select("z", "x", "y", F.col("m").cast("long").alias("m"), "tx0", "ty0", "tx1", "ty1")


def _files(spark, sf):
    """Mercator tiles that are on disk: those of the covers, one in seven aside."""
    tiles = _tiles(spark, sf)
    cells = av.cover_cells(av.covers(tiles)).select("m", "tx", "ty").distinct()
    return cells.where((F.col("tx") * 3 + F.col("ty") * 5 + F.col("m")) % 7 != 0)


@query
def cover_complete(spark, sf):
    tiles = _tiles(spark, sf)
    out = av.complete_covers(av.mercator_cover(tiles, ["z", "x", "y"]), _files(spark, sf), ["z", "x", "y"])
    return out.select("z", "x", "y", F.col("m").cast("long").alias("m"))


@query
def cover_fallback(spark, sf):
    tiles = _tiles(spark, sf)
    out = av.cover_fallback(tiles, _files(spark, sf), ["z", "x", "y"])
    return out.select("z", "x", "y", F.col("m").cast("long").alias("m"), "tx0", "ty0", "tx1", "ty1")


@query
def coverage_center(spark, sf):
    out = av.coverage_center(derive.avail_rects(spark, sf))
    return out.select(F.col("level").cast("long").alias("level"), "area", _r("lat", 9).alias("lat"), _r("lon", 9).alias("lon"))


@query
def max_level(spark, sf):
    return av.max_level(derive.avail_rects(spark, sf)).select(F.col("max_level").cast("long").alias("max_level"))


@query
def absent_lattice(spark, sf):
    return av.absent_lattice(derive.avail_rects(spark, sf), 7, 20).select(F.col("z").cast("long").alias("z"), "x", "y")


def _metadata(spark, sf):
    """Metadata of tiles: two levels of one rectangle each, some of which fit only as absolute levels; all twice."""
    k = F.col("s_suppkey")
    rows = table(spark, sf, "supplier").select((k % 5 + 1).cast("int").alias("z"), (k % 4).alias("x"), ((k * 3) % 2).alias("y"), k.alias("ingest_seq"))
    top = F.when(F.col("ingest_seq") % 3 == 0, geo.columns_at(F.col("z") + 1) - 1).otherwise(geo.columns_at(F.col("z")) - 1)
    rect = lambda wide: F.struct(F.lit(0).cast("long").alias("startX"), F.lit(0).cast("long").alias("startY"), wide.alias("endX"), F.lit(0).cast("long").alias("endY"))
    wide = F.when(F.col("ingest_seq") % 7 == 0, geo.columns_at(F.col("z") + 2)).otherwise(top)
    return rows.withColumn("available", F.array(F.array(rect(top)), F.array(rect(wide))))


@query
def avail_offset(spark, sf):
    return av.offset_of(_metadata(spark, sf)).select("ingest_seq", F.col("z").cast("long").alias("z"), F.col("level_offset").cast("long").alias("level_offset"))


@query
def avail_ingest(spark, sf):
    return av.ingest(_metadata(spark, sf)).select(F.col("level").cast("long").alias("level"), "sx", "sy", "ex", "ey", "ingest_seq")


@query
def ingest_once(spark, sf):
    rows = _metadata(spark, sf).select("z", "x", "y", "ingest_seq")
    return lifecycle.first_of(rows, ["z", "x", "y"], "ingest_seq").select(F.col("z").cast("long").alias("z"), "x", "y", "ingest_seq")


# Boxes, selection --------------------------------------------------------------------------------

_BOX = [f"{e}_{a}" for e in ("lo", "hi") for a in "xyz"]


@query
def tile_aabb(spark, sf):
    tiles = _tiles(spark, sf)
    return selection.tile_boxes(tiles, FRAME).select("z", "x", "y", *(_r(c, 2).alias(c) for c in _BOX))


@query
def bv_region(spark, sf):
    c = F.col
    rows = derive.geo_points(spark, sf).select("id", F.radians("lon").alias("west"), F.radians("lat").alias("south"), F.radians(c("lon") + 0.5).alias("east"), F.radians(c("lat") + 0.25).alias("north"), c("h").alias("h0"), (c("h") + 100).alias("h1"))
    return selection.region_boxes(rows, ["id"], FRAME).select("id", *(_r(c, 2).alias(c) for c in _BOX))


def _volumes(spark, sf):
    """Boxes and spheres in tile coordinates under a transform that turns, scales and moves."""
    p = derive.geo_points(spark, sf)
    x, y, z = geo.ecef(F.radians("lon"), F.radians("lat"), F.col("h"))
    world = F.array(*(F.lit(v) for v in (0.0, -2.0, 0.0)), x, *(F.lit(v) for v in (2.0, 0.0, 0.0)), y, *(F.lit(v) for v in (0.0, 0.0, 2.0)), z, *(F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)))
    box = F.array(*(F.lit(float(v)) for v in (1, 2, 3, 10, 0, 1, 0, 20, 0, 2, 0, 30)))
    sphere = F.array(*(F.lit(float(v)) for v in (1, 2, 3)), F.abs("h") + 1)
    return p.select("id", world.alias("world"), box.alias("box"), sphere.alias("sphere"))


def _bounds_query(rows, bounds):
    low, high = bounds
    return rows.select("id", *(_r(c, 2).alias(n) for c, n in zip([*low, *high], _BOX, strict=True)))


@query
def bv_box(spark, sf):
    from tilewright.sources import tilesets

    return _bounds_query(_volumes(spark, sf), tilesets.box_bounds(F.col("box"), F.col("world"), FRAME))


@query
def bv_sphere(spark, sf):
    from tilewright.sources import tilesets

    return _bounds_query(_volumes(spark, sf), tilesets.sphere_bounds(F.col("sphere"), F.col("world"), FRAME))


def _facts(spark, sf, threshold: float = THRESHOLD):
    tiles = derive.tile_states(derive.pyramid(spark, MAX_Z + 1))
    planes = [tuple(round(v, 6) for v in p) for p in HIGH.planes()]
    facts = selection.tile_facts(tiles, derive.avail_rects(spark, sf), HIGH, FRAME, threshold, MAX_Z, imagery_max_z=5, planes=planes)
    # Every step of a selection reads the facts; samples of tiles are taken once.
    return written(facts.select("z", "x", "y", "state", "err", "visible_now", "stop", "ready"), "facts")


def _key(df):
    return df.select(F.col("z").cast("long").alias("z"), "x", "y")


@query
def lod_select(spark, sf):
    return _key(selection.render(_facts(spark, sf)))


@query
def lod_load(spark, sf):
    rows = selection.load(_facts(spark, sf))
    return rows.select(F.col("z").cast("long").alias("z"), "x", "y", _r("priority", 3).alias("priority"))


@query
def lod_valve(spark, sf):
    rows, used = selection.with_valve(_facts(spark, sf, 0.5), 0.5, most=60)
    return _key(rows).withColumn("threshold", F.lit(used))


@query
def keep_set(spark, sf):
    return _key(selection.keep_set(selection.render(_facts(spark, sf))))


@query
def visibility_diff(spark, sf):
    shown = _key(derive.tile_states(derive.pyramid(spark, MAX_Z)).where("visible"))
    return lifecycle.visibility_diff(lod_select(spark, sf), shown, ["z", "x", "y"]).select("z", "x", "y", "action")


@query
def single_tile(spark, sf):
    """The tile at a level that holds the frame's origin, and its imagery ancestor."""
    row = spark.range(1).select(F.lit(10).alias("z"), F.lit(FRAME.lon).alias("lon"), F.lit(FRAME.lat).alias("lat"))
    x, y = geo.tile_at(F.col("z"), F.col("lon"), F.col("lat"))
    uv = geo.ancestor_uv(F.lit(10), x, y, F.lit(8))
    return row.select(F.col("z").cast("long").alias("z"), x.alias("x"), y.alias("y"), uv["ax"].alias("ax"), uv["ay"].alias("ay"), uv["scale"].alias("scale"))


def _node_facts(spark, sf):
    planes = [tuple(round(v, 6) for v in p) for p in CAMERA.planes()]
    return tree.node_facts(derive.nodes(spark, sf), CAMERA, 16.0, max_dist=60_000.0, falloff=2000.0, planes=planes)


@query
def tileset_select(spark, sf):
    out = tree.select_nodes(_node_facts(spark, sf))
    return out.select("id", "render", "load", _r("priority", 3).alias("priority"), "keep")


@query
def graft(spark, sf):
    nodes = derive.nodes(spark, sf)
    mounts = nodes.where(F.coalesce(text.is_tileset_uri(F.col("uri")), F.lit(False))).select(F.col("id").alias("node_id"), (F.col("id") * 100).alias("root_id"))
    root = mounts.select(F.col("root_id").alias("id"), F.lit(None).cast("long").alias("parent"), F.lit(0).alias("depth"), F.lit("root.glb").alias("uri"), F.col("root_id").alias("tree"))
    kids = mounts.select((F.col("root_id") + 1).alias("id"), F.col("root_id").alias("parent"), F.lit(1).alias("depth"), F.lit("kid.glb").alias("uri"), F.col("root_id").alias("tree"))
    external = root.unionByName(kids).select("*", F.lit(9.0).alias("error"), F.lit("ADD").alias("refine"), *(F.lit(1.0).alias(c) for c in _BOX), F.lit(False).alias("is_ready"))
    return tree.graft(nodes, mounts, external).select("id", "parent", F.col("depth").cast("long").alias("depth"), "uri", "grafted", "lo_x")


# Meshes ------------------------------------------------------------------------------------------


def _codes(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.col("l_linenumber").cast("long").alias("code"))


_CODE_ORDER = ["l_partkey", "l_suppkey", "code"]


@query
def zigzag(spark, sf):
    return mesh.zigzag_running(_codes(spark, sf), ["l_orderkey"], _CODE_ORDER, "code").select("l_orderkey", *_CODE_ORDER, "value")


@query
def highwater(spark, sf):
    rows = _codes(spark, sf).withColumn("code", F.col("code") % 3)
    return mesh.highwater(rows, ["l_orderkey"], [*_CODE_ORDER], "code").select("l_orderkey", *_CODE_ORDER, "index")


def _net(spark, sf):
    """Meshes of 9 x 9 vertices, heights from part prices, two triangles a cell; the last mesh may end early."""
    k = F.col("p_partkey") - 1
    v = table(spark, sf, "part").select(F.floor(k / 81).cast("long").alias("mesh"), (k % 81).alias("v"), F.col("p_retailprice").alias("vh"))
    v = v.withColumn("vx", (F.col("v") % 9) * 4000.0).withColumn("vy", F.floor(F.col("v") / 9) * 4000.0)
    low = v.where("v % 9 < 8 and v < 72").select("mesh", F.col("v").alias("a"))
    tris = low.select("mesh", (F.col("a") * 2).alias("tri"), F.array("a", F.col("a") + 1, F.col("a") + 10).alias("i")).unionByName(low.select("mesh", (F.col("a") * 2 + 1).alias("tri"), F.array("a", F.col("a") + 10, F.col("a") + 9).alias("i")))
    for k in (1, 2, 3):
        corner = v.select("mesh", F.col("v").alias("corner"), F.col("vx").alias(f"x{k}"), F.col("vy").alias(f"y{k}"), F.col("vh").alias(f"h{k}"))
        tris = tris.withColumn("corner", F.element_at("i", k)).join(corner, ["mesh", "corner"]).drop("corner")
    return v, tris


@query
def tin_sample(spark, sf):
    v, tris = _net(spark, sf)
    meshes = max(1, -(-table(spark, sf, "part").count() // 81))
    pts = derive.geo_points(spark, sf).select((F.col("id") % meshes).alias("mesh"), F.col("id").alias("point"), ((F.col("lon") + 180) / 360 * 33_000).alias("px"), ((F.col("lat") + 85) / 170 * 33_000).alias("py"))
    return mesh.sample_net(pts, tris, v, "mesh", "point", 4000.0).select("mesh", "point", _r("h", 4).alias("h"), "hit")


@query
def upsample(spark, sf):
    v, tris = _net(spark, sf)
    odd = F.col("mesh") % 2
    key = lambda even, other: F.when(odd == 0, even).otherwise(other)
    want = v.where("v = 0").select("mesh", key(6, 7).alias("z"), key(21, 43).cast("long").alias("x"), key(20, 40).cast("long").alias("y"), F.lit(5).alias("az"), F.lit(10).cast("long").alias("ax"), F.lit(10).cast("long").alias("ay"))
    grid = mesh.grid_points(want, 9).withColumn("point", F.col("j") * 9 + F.col("i"))
    # The net spans 0 .. 32000, so units are scaled to it.
    pts = grid.select("mesh", F.col("point").cast("long").alias("point"), (F.col("px") / mesh.QUANT * 32_000).alias("px"), (F.col("py") / mesh.QUANT * 32_000).alias("py"))
    h = mesh.sample_net(pts, tris, v, "mesh", "point", 4000.0).select("mesh", "point", _r("h", 4).alias("h_m"))
    return mesh.requantized(h, ["mesh"]).select("mesh", "point", _r("min_h", 4).alias("min_h"), _r("max_h", 4).alias("max_h"), F.col("hq").cast("long").alias("hq"))


def _vertices(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    return p.select(k, F.lit(6).alias("z"), (k % 128).alias("x"), (k % 64).alias("y"), ((k * 37) % 32_768).alias("u"), ((k * 101) % 32_768).alias("v"), ((k * 211) % 32_768).alias("h"), F.lit(0.0).alias("min_h"), F.col("p_retailprice").alias("max_h"))


@query
def mesh_enu(spark, sf):
    return mesh.to_local(_vertices(spark, sf), FRAME).select("p_partkey", _r("e", 2).alias("e"), _r("n", 2).alias("n"), _r("up", 2).alias("up"))


@query
def mesh_uv(spark, sf):
    rows = mesh.to_local(_vertices(spark, sf), FRAME)
    uv = geo.ancestor_uv(F.col("z"), F.col("x"), F.col("y"), F.lit(4))
    u, v = mesh.uv_linear(F.col("u"), F.col("v"), uv["scale"], uv["u_off"], uv["v_off"])
    rect = geo.tile_rect(F.col("z"), F.col("x"), F.col("y"))
    x0, y0 = geo.mercator(rect[0], rect[1])
    x1, y1 = geo.mercator(rect[2], rect[3])
    span = F.greatest(y1 - y0, F.lit(1e-9))
    mu, mv = mesh.uv_mercator(F.col("lon"), F.col("lat"), (x0, y0, x1, y0 + span))
    return rows.select("p_partkey", _r(u, 7).alias("u"), _r(v, 7).alias("v"), _r(mu, 6).alias("mu"), _r(mv, 6).alias("mv"))


@query
def mesh_aabb(spark, sf):
    rows = mesh.to_local(_vertices(spark, sf), FRAME)
    ends = [f(c) for c in ("e", "n", "up") for f in (lambda c: _r(F.min(c), 2).alias(f"lo_{c}"), lambda c: _r(F.max(c), 2).alias(f"hi_{c}"))]
    return rows.groupBy("x", "y").agg(*ends)


# Life cycle --------------------------------------------------------------------------------------


def _session(spark, sf):
    """Tiles of a session: those that points hit, with states."""
    tiles = _hits(spark, sf).select("z", "x", "y").distinct()
    return derive.tile_states(tiles)


@query
def state_counts(spark, sf):
    return lifecycle.state_counts(_session(spark, sf))


@query
def node_stats(spark, sf):
    k = F.col("id")
    state = F.when(k % 11 < 7, "built").when(k % 11 < 9, "fetching").when(k % 11 < 10, "dead").otherwise("queued")
    return lifecycle.node_stats(derive.nodes(spark, sf).select(state.alias("state"), (k % 3).alias("n_objects")))


@query
def request_tally(spark, sf):
    return lifecycle.request_tally(derive.request_log(spark, sf))


@query
def elev_range(spark, sf):
    k = (F.col("x") + F.col("y")) % 50
    rows = _session(spark, sf).withColumn("min_h", F.when(k > 3, k * 10.0)).withColumn("max_h", k * 30.0)
    return lifecycle.elevation_range(rows)


@query
def load_topk(spark, sf):
    k = F.col("x") * 7 + F.col("y") * 3 + F.col("z")
    rows = _session(spark, sf).withColumn("priority", -((k % 1000) / 8.0)).withColumn("next_retry", (k % 40) / 2.0)
    return lifecycle.admit(rows, now=10.0, in_flight=3, most=16).select("priority", "z", "x", "y", "state")


@query
def lru_evict(spark, sf):
    keep = _session(spark, sf).where("z <= 3").select("z", "x", "y")
    return lifecycle.lru_victims(_session(spark, sf), keep, ["z", "x", "y"], budget=400, now=50.0, grace=10.0, cap=lifecycle.EVICT_TERRAIN)


@query
def lru_evict_nodes(spark, sf):
    k = F.col("id")
    rows = derive.nodes(spark, sf).select("id", F.when(k % 4 < 3, "built").otherwise("queued").alias("state"), (k % 5 == 0).alias("visible"), ((k * 13) % 50).cast("double").alias("last_wanted"))
    keep = rows.where("id < 110").select("id")
    return lifecycle.lru_victims(rows, keep, ["id"], budget=20, now=50.0, grace=10.0, cap=lifecycle.EVICT_NODES)


@query
def retry_schedule(spark, sf):
    log = derive.request_log(spark, sf).where("outcome in ('http', 'conn')").select("user_id", "event_id", F.col("event_id").cast("double").alias("at"))
    return lifecycle.retry_schedule(log, ["user_id"], "at", ["event_id"]).select("user_id", "event_id", F.col("retry").cast("long").alias("retry"), "state", "next_retry")


@query
def breaker(spark, sf):
    order = ["ts", "event_id"]
    log = lifecycle.deal(derive.request_log(spark, sf), order, rows=5000)
    return lifecycle.breaker(log, order, F.col("part"))


@query
def breaker_state(spark, sf):
    """Each user's log as a session's, some of its requests as probes."""
    kind = F.when(F.col("event_id") % 29 == 0, "probe_ok").when(F.col("event_id") % 31 == 0, "probe_failed").when((F.col("outcome") == "http") & (F.col("event_id") % 2 == 0), "conn").otherwise(F.col("outcome"))
    log = derive.request_log(spark, sf).select((F.col("user_id") % 20).alias("session"), "event_id", kind.alias("outcome"))
    return lifecycle.breaker_state(log, ["session"], ["event_id"]).select("session", "event_id", F.col("n_failures").cast("long").alias("n_failures"), "is_open")


@query
def set_intersect(spark, sf):
    """Tiles that are hit and are also at the corners of what is available."""
    corners = derive.avail_rects(spark, sf).select(F.col("level").cast("long").alias("z"), F.col("sx").alias("x"), F.col("sy").alias("y"))
    return lifecycle.both(_hits(spark, sf), corners, ["z", "x", "y"])


@query
def ground_ray(spark, sf):
    p = derive.geo_points(spark, sf)
    cameras = p.select("id", (F.col("h") + 5000).alias("up"))
    surfaces = F.transform(F.sequence(F.lit(0), (F.col("id") % 7).cast("int")), lambda i: F.struct((F.col("h") - i * 10).alias("h"), (((F.col("id") + i) % 3) != 0).alias("slab")))
    hits = p.select("id", F.explode(surfaces).alias("s")).select("id", "s.h", "s.slab")
    return mesh.ground_below(cameras, hits).select("id", _r("ground", 4).alias("ground"))


@query
def imagery_url(spark, sf):
    """Both kinds of imagery service."""
    z, x, y = F.col("z"), F.col("x"), F.col("y")
    hosts = F.array(*map(F.lit, ("t0", "t1", "t2")))
    quad = text.quadkey_tile_url(F.lit("https://{subdomain}.example/a{quadkey}.jpeg?g=1"), hosts, z, x, y)
    return _hits(spark, sf).select("id", "z", text.map_tile_url(F.lit("https://m.example/tiles/"), z, x, y, F.lit(".png")).alias("map_url"), quad.alias("quad_url"))


@query
def need_select(spark, sf):
    log = table(spark, sf, "events").select("user_id", "event_id", F.floor(F.col("value") / 20).cast("long").alias("signature"), F.floor(F.col("event_id") / 500).cast("long").alias("generation"), (F.col("event_id") / 400.0).alias("at"))
    return lifecycle.need_select(log, ["user_id"], ["event_id"]).select("event_id", "need_select")


@query
def stale_generation(spark, sf):
    """Results of an older generation than their tile's are dropped; the tile goes back to the queue."""
    log = table(spark, sf, "events").select("event_id", "user_id", (F.col("event_id") % 7).alias("generation"))
    now = log.groupBy("user_id").agg(F.max("generation").alias("current"))
    out = log.join(now, "user_id")
    return out.select("event_id", F.when(F.col("generation") == F.col("current"), "used").otherwise("queued").alias("result"))


@query
def sweep_unused(spark, sf):
    blocks = table(spark, sf, "part").select(F.col("p_partkey").alias("block"))
    users = table(spark, sf, "lineitem").select((F.col("l_partkey") - F.col("l_partkey") % 3).alias("block"))
    return lifecycle.sweep_unused(blocks, users, "block")


@query
def restore_key(spark, sf):
    """The image of each object: by its stored key, else by the one its tile implies."""
    hits = _hits(spark, sf)
    own = text.material_name("I", F.lit("m"), [F.least(F.col("z"), F.lit(7)), geo.shift_right(F.col("x"), F.greatest(F.col("z") - 7, F.lit(0))), geo.shift_right(F.col("y"), F.greatest(F.col("z") - 7, F.lit(0)))])
    return hits.select("id", "z", style.image_key(F.when(F.col("id") % 4 == 0, F.concat(F.lit("stored_"), F.col("id"))), own).alias("image_key"))


@query
def fsm_replay(spark, sf):
    from tilewright.streaming import fsm

    log = derive.request_log(spark, sf).select(F.col("user_id").alias("tile"), F.col("event_id").alias("seq"), "outcome", F.col("event_id").cast("double").alias("at"))
    return fsm.replay(log).select("tile", "state", F.col("retries").cast("long").alias("retries"), "next_retry")


@query
def fsm_full(spark, sf):
    from tilewright.streaming import fsm

    kinds = ("fetch", "ok", "built", "http", "conn", "build_failed", "evict", "stale", "stop", "late", "graft_drawable", "graft_done", "nothing", "dead")
    kind = F.element_at(F.array(*map(F.lit, kinds)), F.when(F.col("event_id") % 97 == 0, 14).otherwise(F.col("event_id") * 7 % 13 + 1).cast("int"))
    log = table(spark, sf, "events").select(F.col("user_id").alias("tile"), F.col("event_id").alias("seq"), kind.alias("outcome"), F.col("event_id").cast("double").alias("at"))
    return fsm.replay_full(log).select("tile", "state", F.col("retries").cast("long").alias("retries"), "next_retry")


# Styling -----------------------------------------------------------------------------------------


@query
def relief(spark, sf):
    p = derive.geo_points(spark, sf)
    e = style.true_elevation(F.col("lon") * 1000, F.col("lat") * 1000, F.col("h"))
    r, g, b = style.relief(F.col("e"), 0.0, 4000.0, F.abs(F.cos(F.col("id"))), 250.0)
    return p.select("id", _r(e, 6).alias("e")).select("id", "e", _r(r, 6).alias("r"), _r(g, 6).alias("g"), _r(b, 6).alias("b"))


@query
def cloud_profile(spark, sf):
    p = derive.geo_points(spark, sf)
    d = style.cloud_density((F.col("lon") + 180) / 360, (F.col("lat") + 85) / 170, F.abs(F.sin(F.col("id"))), 0.5, 0.8)
    return p.select("id", _r(d, 9).alias("density"))


# Binary and recursive formats --------------------------------------------------------------------


def _tiles_of_bytes(spark, sf):
    from tilewright.sources import samples, terrain

    part = lambda i: F.regexp_extract("path", r"(\d+)/(\d+)/(\d+)\.terrain$", i).cast("long")
    return terrain.decode(samples.tiles(spark, sf)).withColumns({"z": part(1).cast("int"), "x": part(2), "y": part(3)})


@query
def qm_decode(spark, sf):
    out = _tiles_of_bytes(spark, sf)
    count = F.when(F.col("error").isNull(), F.size("u").cast("long"))
    return out.select("path", F.col("error").isNotNull().alias("damaged"), "min_h", "max_h", count.alias("n_vertices"), F.when(F.col("error").isNull(), (F.size("indices") / 3).cast("long")).alias("n_triangles"), "geometric_error")


@query
def mesh_from_bytes(spark, sf):
    """Decoded tiles as meshes: a row for each vertex."""
    whole = {"scale": F.lit(0.5), "u_off": F.lit(0.25), "v_off": F.lit(0.125)}
    out = mesh.tile_mesh(_tiles_of_bytes(spark, sf).where("error is null").withColumns(whole), FRAME)
    corner = F.element_at("loop_uvs", -1).cast("double")
    rows = out.select("x", "y", "n_triangles", _r(corner, 6).alias("last_v"), _r(F.element_at("lows", 3), 2).alias("low_up"), F.posexplode("positions").alias("i", "p"))
    return rows.select("x", "y", F.col("n_triangles").cast("long").alias("n_triangles"), "last_v", "low_up", F.col("i").cast("long").alias("i"), *(_r(F.col(f"p.{a}").cast("double"), 1).alias(a) for a in ("e", "n", "up")))


@query
def upsample_mesh(spark, sf):
    """Of each decoded tile its child in the north-west, resampled: a row for each vertex."""
    tiles = written(_tiles_of_bytes(spark, sf).where("error is null"), "decoded")
    below = tiles.select((F.col("z") + 1).alias("z"), (F.col("x") * 2).alias("x"), (F.col("y") * 2 + 1).alias("y"), F.col("z").alias("az"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    out = mesh.upsample(below, tiles, n=5)
    rows = out.select("x", "y", _r("min_h", 4).alias("min_h"), _r("max_h", 4).alias("max_h"), F.size("indices").cast("long").alias("n_loops"), F.element_at("east", 2).alias("second_east"), F.posexplode(F.arrays_zip("u", "v", "h")).alias("i", "p"))
    return rows.select("x", "y", "min_h", "max_h", "n_loops", "second_east", F.col("i").cast("long").alias("i"), *(F.col(f"p.{c}").cast("long").alias(c) for c in "uvh"))


def _parsed(spark, sf):
    from tilewright.sources import samples, tilesets

    return tilesets.parse(samples.documents(spark, sf))


@query
def tileset_parse(spark, sf):
    return _parsed(spark, sf).select("url", "error", "id", "parent", F.col("depth").cast("long").alias("depth"), "geometric_error", "refine", "volume", "uri", F.element_at("world", 4).alias("moved_x"))


@query
def tileset_boxes(spark, sf):
    from tilewright.sources import tilesets

    out = tilesets.with_boxes(_parsed(spark, sf).where("error is null"), FRAME)
    return out.select("url", "id", *(_r(c, 2).alias(c) for c in _BOX))


@query
def unwrap_content(spark, sf):
    from tilewright.sources import samples, tilesets

    out = tilesets.unwrap(samples.contents(spark, sf), "VENDOR_RTC")
    return out.select("url", F.col("error").isNotNull().alias("damaged"), F.col("part").cast("long").alias("part"), F.length("model").cast("long").alias("n_bytes"), F.element_at("center", 1).alias("center_x"))


@query
def resolve_uri_full(spark, sf):
    base = F.concat(F.regexp_replace("url", "[?#].*", ""), F.lit("?session=a%20b&key=k"))
    return table(spark, sf, "pages").select("page_id", text.resolved(base, F.concat(F.lit("../sub/./"), F.col("page_id"), F.lit(".glb"))).alias("resolved"))
