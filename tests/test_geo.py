import math

import pytest
from pyspark.sql import functions as F

from tilewright.functions import geo, text
from tilewright.functions.camera import ACCEPT_ALL, Camera
from tilewright.operators import availability as av
from tilewright.operators import lifecycle, selection, tree


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_earth_centred_points(spark):
    lit = lambda *v: [F.lit(float(x)) for x in v]
    assert one(spark, *geo.ecef(*lit(0, 0, 0))) == pytest.approx((geo.A, 0, 0), abs=1e-6)
    assert one(spark, *geo.ecef(*lit(math.pi / 2, 0, 0))) == pytest.approx((0, geo.A, 0), abs=1e-6)
    b = geo.A * (1 - geo.FLATTENING)
    assert one(spark, *geo.ecef(*lit(0, math.pi / 2, 0))) == pytest.approx((0, 0, b), abs=1e-6)


def test_local_frame(spark):
    frame = geo.Frame(-2.0, -65.0)
    here = [F.radians(F.lit(-65.0)), F.radians(F.lit(-2.0))]
    assert one(spark, *frame.from_geodetic(*here, F.lit(0.0))) == pytest.approx((0, 0, 0), abs=1e-6)
    assert one(spark, *frame.from_geodetic(*here, F.lit(100.0))) == pytest.approx((0, 0, 100), abs=1e-6)
    _, n, _ = one(spark, *frame.from_geodetic(here[0], F.radians(F.lit(-1.0)), F.lit(0.0)))
    assert 110_000 < n < 111_500


@pytest.mark.parametrize(("z", "dims"), [(0, (2, 1)), (1, (4, 2)), (10, (2048, 1024))])
def test_level_dims(spark, z, dims):
    assert one(spark, geo.columns_at(F.lit(z)), geo.rows_at(F.lit(z))) == dims


@pytest.mark.parametrize(("lon", "lat", "tile"), [(-65.0, -2.0, (0, 0)), (65.0, -2.0, (1, 0)), (180.0, 90.0, (1, 0)), (-180.0, -90.0, (0, 0))])
def test_tile_of_a_point(spark, lon, lat, tile):
    assert one(spark, *geo.tile_at(F.lit(0), F.lit(lon), F.lit(lat))) == tile


@pytest.mark.parametrize(("key", "want"), [((13, 5000, 3000), (13, 5000, 3000, 1.0, 0.0, 0.0)), ((14, 1001, 501), (13, 500, 250, 0.5, 0.5, 0.5)), ((16, 4000, 2001), (13, 500, 250, 0.125, 0.0, 0.125))])
def test_place_in_an_ancestor(spark, key, want):
    z, x, y = (F.lit(v).cast("long") for v in key)
    assert one(spark, *geo.ancestor_uv(z, x, y, F.lit(13)).values()) == want


def test_quadkey(spark):
    assert one(spark, text.quadkey(F.lit(3), F.lit(3).cast("long"), F.lit(5).cast("long")), text.quadkey(F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long"))) == ("213", "")


def test_mercator(spark):
    at = lambda lon, lat: one(spark, *geo.mercator(F.lit(lon), F.lit(lat)))
    assert at(-math.pi, 0.0) == pytest.approx((0, 0.5), abs=1e-12)
    assert at(0.0, math.pi / 2)[1] == pytest.approx(1) and at(0.0, -math.pi / 2)[1] == pytest.approx(0)


def test_screen_space_error(spark):
    assert one(spark, geo.sse(F.lit(100.0), F.lit(1000.0), 1000, 1.0), geo.sse(F.lit(100.0), F.lit(500.0), 1000, 1.0)) == (50.0, 100.0)


@pytest.mark.parametrize(("pos", "want"), [((0.5, 0.5, 0.5), 0), ((3, 0.5, 0.5), 2), ((3, 3, 0.5), math.sqrt(8))])
def test_box_distance(spark, pos, want):
    lits = lambda v: [F.lit(float(x)) for x in v]
    assert one(spark, geo.box_distance(lits((0, 0, 0)), lits((1, 1, 1)), lits(pos)))[0] == pytest.approx(want)


def test_frustum(spark):
    down = Camera(pos=(0.0, 0.0, 1000.0), pitch=-90.0, far=5000.0)
    box = lambda x, z: ([F.lit(x - 1.0), F.lit(-1.0), F.lit(z - 1.0)], [F.lit(x + 1.0), F.lit(1.0), F.lit(z + 1.0)])
    seen = lambda x, z: one(spark, geo.box_in_planes(*box(x, z), down.planes()))[0]
    assert seen(0.0, 0.0) and not seen(0.0, 2000.0) and not seen(50_000.0, 0.0)


def test_horizon(spark):
    frame = geo.Frame(28.61, 77.20)
    at = lambda h: one(spark, geo.horizon_limit(frame, F.lit(0.0), F.lit(0.0), F.lit(h)))[0]
    ground = at(0.0)
    assert at(2000.0) - ground == pytest.approx(159_740, rel=0.01) and at(5000.0) > at(2000.0) > ground


def test_availability(spark):
    rects = spark.createDataFrame([(1, 1, 1, 3, 1, 0)], "level int, sx long, sy long, ex long, ey long, ingest_seq long")
    tiles = spark.createDataFrame([(1, 1, 1), (1, 2, 0), (0, 0, 0), (0, 1, 0), (0, 2, 0)], "z int, x long, y long")
    assert {tuple(r) for r in av.available(tiles, rects).collect()} == {(1, 1, 1), (0, 0, 0), (0, 1, 0)}


def test_offset_prefers_the_subtree(spark):
    rect = lambda x, y: {"startX": 0, "startY": 0, "endX": x, "endY": y}
    schema = "z int, x long, y long, ingest_seq long, available array<array<struct<startX: long, startY: long, endX: long, endY: long>>>"
    rows = [(0, 0, 0, 1, [[rect(3, 1)]]), (1, 0, 0, 2, [[rect(1, 0)]]), (0, 0, 0, 3, [[rect(3, 1)]]), (2, 0, 0, 4, [])]
    df = spark.createDataFrame(rows, schema)
    assert [r["level_offset"] for r in av.offset_of(df).orderBy("ingest_seq").collect()][:2] == [1, 1]
    got = av.ingest(df).orderBy("level").collect()
    assert [(r["level"], r["ingest_seq"]) for r in got] == [(1, 1), (2, 2)]
    absolute = av.ingest(df.where("ingest_seq = 1"), absolute=True).collect()
    assert absolute[0]["level"] == 0


def test_cover_never_has_more_than_two_rows(spark):
    tiles = spark.createDataFrame([(z, (2 << z) * 7 // 10, (1 << z) * 6 // 10) for z in range(1, 14)], "z int, x long, y long")
    got = av.mercator_cover(tiles, ["z", "x", "y"]).collect()
    assert len(got) == 13
    for r in got:
        assert r["tx0"] == r["tx1"] and r["ty1"] - r["ty0"] <= 1 and r["m"] <= r["z"] + 1


def test_eviction(spark):
    rows = [(10, i, 0, "built", False, 100.0 - i) for i in range(4)] + [(10, 4, 0, "built", False, 10.0), (10, 5, 0, "built", False, 20.0)]
    tiles = spark.createDataFrame(rows, "z int, x long, y long, state string, visible boolean, last_wanted double")
    none = tiles.select("z", "x", "y").limit(0)
    got = lifecycle.lru_victims(tiles, none, ["z", "x", "y"], budget=2, now=105.0, grace=10.0, cap=24).collect()
    assert [r["x"] for r in got] == [4, 5]
    assert lifecycle.lru_victims(tiles, none, ["z", "x", "y"], budget=2, now=20.0, grace=100.0, cap=24).count() == 0


def _walk(facts):
    """The walk that selection's joins stand for, on rows by key."""
    by = {(r["z"], r["x"], r["y"]): r for r in facts}
    out, stack = set(), [(0, 0, 0), (0, 1, 0)]
    while stack:
        k = stack.pop()
        r = by[k]
        if not r["visible_now"]:
            continue
        if r["stop"] or not r["ready"]:
            out.add(k)
            continue
        z, x, y = k
        stack += [(z + 1, 2 * x + i, 2 * y + j) for i in (0, 1) for j in (0, 1)]
    return out


def test_selection_is_the_walk(spark, sf):
    from tilewright.plans import queries

    facts = queries._facts(spark, sf)
    got = {tuple(r) for r in selection.render(facts).select("z", "x", "y").collect()}
    assert got == _walk(facts.collect()) and got


def test_deep_selection_agrees(spark, sf):
    from tilewright.plans import derive, queries

    planes = [tuple(round(v, 6) for v in p) for p in queries.HIGH.planes()]
    rects = derive.avail_rects(spark, sf)
    states = derive.tile_states(derive.pyramid(spark, 5))
    wide = selection.render(selection.tile_facts(states, rects, queries.HIGH, queries.FRAME, 4.0, 4, 5, planes))
    deep = selection.select_deep(rects, states, queries.HIGH, queries.FRAME, 4.0, 4, 5, planes)
    assert {tuple(r) for r in wide.collect()} == {tuple(r) for r in deep.collect()}


def test_filters_on_visible_tiles_leave_boxes_alone(spark, sf):
    from tilewright.plans import derive, queries

    tiles = spark.createDataFrame([(0, 0, 0, "built"), (0, 1, 0, "built")], "z int, x long, y long, state string")
    facts = selection.tile_facts(tiles, derive.avail_rects(spark, sf), queries.HIGH, queries.FRAME, 4.0, 4, 5)
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    assert size(facts.where("visible_now")) < 2 * size(facts)


def _nodes(spark, rows):
    schema = "id long, parent long, depth int, error double, refine string, uri string, is_ready boolean"
    df = spark.createDataFrame(rows, schema)
    return df.select("*", *(F.lit(-1.0).alias(f"lo_{a}") for a in "xyz"), *(F.lit(1.0).alias(f"hi_{a}") for a in "xyz"))


def _select(spark, rows, threshold=16.0, pos=(0.0, 0.0, 100.0)):
    facts = tree.node_facts(_nodes(spark, rows), Camera(pos=pos, height_px=1000), threshold, planes=ACCEPT_ALL)
    return {r["id"]: r for r in tree.select_nodes(facts).collect()}


def test_tree_replace_waits_for_all_children(spark):
    rows = [(1, None, 0, 100.0, "REPLACE", "r.glb", True), (2, 1, 1, 0.0, "REPLACE", "a.glb", True), (3, 1, 1, 0.0, "REPLACE", "b.glb", False)]
    got = _select(spark, rows)
    assert got[1]["render"] and not got[1]["load"] and got[3]["load"] and not got[3]["render"] and 2 not in got
    got = _select(spark, [*rows[:2], (3, 1, 1, 0.0, "REPLACE", "b.glb", True)])
    assert {i for i, r in got.items() if r["render"]} == {2, 3}


def test_tree_far_camera_stops_at_the_root(spark):
    rows = [(1, None, 0, 100.0, "REPLACE", "r.glb", True), (2, 1, 1, 0.0, "REPLACE", "a.glb", True)]
    got = _select(spark, rows, pos=(0.0, 0.0, 1e6))
    assert {i for i, r in got.items() if r["render"]} == {1}


def test_tree_refines_what_has_no_content(spark):
    rows = [(1, None, 0, 0.0, "REPLACE", None, False), (2, 1, 1, 0.0, "REPLACE", None, False), (3, 2, 2, 0.0, "REPLACE", "a.glb", True)]
    assert {i for i, r in _select(spark, rows).items() if r["render"]} == {3}


def test_tree_add_renders_both_and_external_sets_are_fetched(spark):
    rows = [(1, None, 0, 100.0, "ADD", "r.glb", True), (2, 1, 1, 0.0, "REPLACE", "a.glb", True), (3, 1, 1, 5.0, "REPLACE", "x/set.JSON?k=1", False)]
    got = _select(spark, rows)
    assert got[1]["render"] and got[2]["render"] and got[3]["load"] and not got[3]["render"]


def test_tree_empty(spark):
    # No root, so nothing is reached.
    assert _select(spark, [(1, 9, 3, 1.0, "ADD", "r.glb", True)]) == {}
    assert tree.select_nodes(tree.node_facts(_nodes(spark, []), Camera(), 16.0)).count() == 0
