import gzip
import json
import math
import os
import struct
import urllib.parse

import pytest
from pyspark.sql import functions as F

from tilewright.functions import geo, text
from tilewright.settings import Settings
from tilewright.operators import mesh
from tilewright.sources import services, terrain, tilesets


def plane(min_h=0.0, max_h=200.0, **more):
    return terrain.encode_tile([0, 32767, 0, 32767], [0, 0, 32767, 32767], [0, 32767, 0, 32767], [(0, 1, 2), (2, 1, 3)], min_h, max_h, **more)


def test_tile_round_trip():
    got = terrain.decode_tile(plane(metadata={"geometricerror": "7.5"}, edges=((0, 2), (0, 1), (1, 3), (2, 3))))
    assert got["u"].tolist() == [0, 32767, 0, 32767] and got["indices"].tolist() == [0, 1, 2, 2, 1, 3]
    assert got["geometric_error"] == 7.5 and got["west"].tolist() == [0, 2] and got["max_h"] == 200.0


def test_tile_packed_and_with_a_cut_extension():
    assert terrain.decode_tile(gzip.compress(plane()))["max_h"] == 200.0
    assert terrain.decode_tile(plane() + struct.pack("<BI", 4, 500) + b"{}")["metadata"] is None
    assert terrain.decode_tile(plane() + b"\x04")["metadata"] is None
    assert terrain.decode_tile(plane() + struct.pack("<BI", 2, 1) + b"\xff")["water_mask"] == b"\xff"


@pytest.mark.parametrize("data", [b"\0" * 50, b"\xff" * 200, b"", plane()[:100], b"\x1f\x8b" + b"x" * 100])
def test_damaged_tiles(data):
    with pytest.raises(terrain.TileError):
        terrain.decode_tile(data)


def test_read_and_write_tiles(spark, tmp_path):
    for z, x, y in ((1, 2, 1), (3, 0, 5)):
        os.makedirs(tmp_path / f"in/{z}/{x}", exist_ok=True)
        (tmp_path / f"in/{z}/{x}/{y}.terrain").write_bytes(plane() if z == 1 else b"bad")
    rows = {(r["z"], r["x"], r["y"]): r for r in terrain.read_tiles(spark, str(tmp_path / "in")).collect()}
    assert rows[1, 2, 1]["error"] is None and rows[3, 0, 5]["error"] and rows[3, 0, 5]["u"] is None
    terrain.write_cache(spark.createDataFrame([(1, 2, 3, b"x")], "z int, x long, y long, content binary"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).first()["content"] == b"x"


def test_tree_document():
    """Three levels: transforms accumulate, refinement is inherited and overridden, ids go depth first."""
    turn = [0, 1, 0, 0, -1, 0, 0, 0, 0, 0, 1, 0, 100, -40, 7, 1]
    move = lambda *t: [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, *t, 1]
    leaf = {"transform": move(0, 2.5, 0), "refine": "Replace", "content": {"uri": "leaf.glb"}, "boundingVolume": {"sphere": [0, 0, 0, 4]}}
    doc = {"root": {"refine": "add", "transform": turn, "children": [{"transform": move(6, 0, -7), "content": {"url": "mid.b3dm"}, "children": [leaf]}, {"geometricError": 3}]}}
    root, mid, low, last = tilesets.flatten(doc)
    assert [(t["id"], t["parent"], t["depth"], t["refine"]) for t in (root, mid, low, last)] == [(1, None, 0, "ADD"), (2, 1, 1, "ADD"), (3, 2, 2, "REPLACE"), (4, 1, 1, "ADD")]
    # A quarter turn takes x to y and y to -x.
    assert [mid["world"][i] for i in (3, 7, 11)] == [100, -34, 0] and [low["world"][i] for i in (3, 7, 11)] == [97.5, -34, 0]
    assert (mid["uri"], low["uri"], low["volume"], low["bounds"], last["geometric_error"]) == ("mid.b3dm", "leaf.glb", "sphere", [0, 0, 0, 4], 3.0)
    for bad in ({}, {"root": {"transform": [1, 2]}}):
        with pytest.raises(tilesets.TilesetError):
            list(tilesets.flatten(bad))
    deep = {}
    for _ in range(70):
        deep = {"children": [deep]}
    with pytest.raises(tilesets.TilesetError):
        list(tilesets.flatten({"root": deep}))


def test_bad_documents_are_rows(spark):
    df = spark.createDataFrame([("a", "{"), ("b", json.dumps({"root": {}})), ("c", None)], "url string, doc string")
    got = {r["url"]: r["error"] for r in tilesets.parse(df).collect()}
    assert got["a"] and got["b"] is None and got["c"]


def glb(center=None, name="VENDOR_RTC"):
    chunk = json.dumps({"extensions": {"OTHER_RTC": {"center": [9, 9, 9]}, name: {"center": center}}} if center else {}).encode()
    return b"glTF" + struct.pack("<II", 2, 20 + len(chunk)) + struct.pack("<I", len(chunk)) + b"JSON" + chunk


def b3dm(model, table=b""):
    return b"b3dm" + struct.pack("<6I", 1, 28 + len(table) + len(model), len(table), 0, 0, 0) + table + model


def composite(*parts, count=None):
    body = b"".join(parts)
    return b"cmpt" + struct.pack("<3I", 1, 16 + len(body), len(parts) if count is None else count) + body


def test_models_and_their_centres():
    read = lambda data: tilesets.models(data, "VENDOR_RTC")
    assert read(glb([1, 2, 3])) == [(glb([1, 2, 3]), [1.0, 2.0, 3.0])]
    assert read(b3dm(glb([4, 5, 6])))[0][1] == [4.0, 5.0, 6.0]
    # A batch's own centre goes before its model's; what isn't three numbers is none.
    assert read(b3dm(glb([4, 5, 6]), json.dumps({"RTC_CENTER": [7, 8, 9]}).encode()))[0][1] == [7.0, 8.0, 9.0]
    assert read(b3dm(glb(), b"{broken"))[0][1] is None and read(glb([1, "x", 3]))[0][1] is None and read(glb([1, 2]))[0][1] is None
    # Only the named extension counts.
    assert tilesets.models(glb([1, 2, 3], name="MORE_RTC"), "VENDOR_RTC")[0][1] is None and tilesets.models(glb([1, 2, 3]))[0][1] is None


def test_composites():
    part, points = b3dm(glb()), b"pnts" + struct.pack("<II", 1, 28) + b"\0" * 16
    assert len(tilesets.models(composite(part, part))) == 2
    # Nested ones are opened in order, points have no model, and a part that is cut ends the list.
    nested = composite(glb([1, 0, 0]), composite(b3dm(glb([2, 0, 0])), points), glb([3, 0, 0]))
    assert [c for _, c in tilesets.models(nested, "VENDOR_RTC")] == [[1, 0, 0], [2, 0, 0], [3, 0, 0]]
    assert len(tilesets.models(composite(part, part, count=5))) == 2 and len(tilesets.models(composite(part, part)[:-3])) == 1
    assert tilesets.models(composite()) == [] and tilesets.models(points) == []


@pytest.mark.parametrize("bad", [b"what" + b"\0" * 20, b"glTF", b"", b3dm(b""), b3dm(b"none of it"), composite(b"what" + struct.pack("<II", 1, 16) + b"\0" * 4), b"b3dm" + b"\0" * 10])
def test_damaged_contents(bad):
    with pytest.raises(tilesets.TilesetError):
        tilesets.models(bad)


@pytest.mark.parametrize(
    ("base", "uri", "want"),
    [
        ("https://a.example/r/set.json?session=s&key=k", "c/d.glb", "https://a.example/r/c/d.glb?session=s&key=k"),
        ("https://a.example/set.json?session=s&key=k", "/d.glb?key=own", "https://a.example/d.glb?key=own&session=s"),
        ("https://a.example/set.json", "d.glb?x=1", "https://a.example/d.glb?x=1"),
        ("https://a.example/set.json?blank=", "d.glb", "https://a.example/d.glb"),
        ("https://a.example/a/b/c.json?k=a%20b%2Fc", "../../../x/./y/..", "https://a.example/x/?k=a+b%2Fc"),
        ("https://a.example/a/b.json?k=1", "https://b.example/z.glb", "https://b.example/z.glb?k=1"),
        ("https://a.example/a/b.json?k=1", "//b.example/z.glb#part", "https://b.example/z.glb?k=1#part"),
        ("https://a.example?k=~*", "z.glb", "https://a.example/z.glb?k=~%2A"),
    ],
)
def test_uris(spark, base, uri, want):
    assert spark.range(1).select(text.resolved(F.lit(base), F.lit(uri))).first()[0] == want


@pytest.mark.parametrize("uri", ["g", "./g", "g/", "/g", "g?y", "g;x", "..", "../g", "../..", "../../g", "../../../g", "./../g", "g/./h", "g/../h", "?y", "#s", "", "http:g:h"])
def test_references_as_the_standard_resolves_them(spark, uri):
    base = "http://a/b/c/d;p?q"
    want = uri if uri.startswith("http:") else urllib.parse.urljoin(base, uri)
    assert spark.range(1).select(text.absolute(F.lit(base), F.lit(uri))).first()[0] == want


def test_nodes_of_documents(spark):
    """From a document to boxes and absolute places."""
    frame = geo.Frame(10.0, 20.0)
    x, y, z = frame.origin
    move = [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, x, y, z, 1]
    doc = {"root": {"transform": move, "refine": "ADD", "geometricError": 50, "boundingVolume": {"sphere": [0, 0, 0, 30]}, "content": {"uri": "a.glb"}, "children": [{"boundingVolume": {"box": [0, 0, 0, 5, 0, 0, 0, 5, 0, 0, 0, 5]}, "content": {"uri": "sub/set.json"}}, {}]}}
    region = {"root": {"boundingVolume": {"region": [math.radians(v) for v in (20, 10, 20.01, 10.01)] + [0, 100]}}}
    docs = spark.createDataFrame([("https://a.example/t/s.json?k=1", json.dumps(doc)), ("https://a.example/r.json", json.dumps(region)), ("bad", "{")], "url string, doc string")
    rows = tilesets.tree_nodes(tilesets.parse(docs), frame).collect()
    by_uri = {r["uri"]: r for r in rows if r["uri"]}
    root, kid = by_uri["https://a.example/t/a.glb?k=1"], by_uri["https://a.example/t/sub/set.json?k=1"]
    assert root["parent"] is None and kid["parent"] == root["id"] == root["tree"] == kid["tree"] and root["error"] == 50
    assert [root[c] for c in tilesets.BOX] == pytest.approx([-30] * 3 + [30] * 3, abs=1e-6)
    assert max(abs(kid[c]) for c in tilesets.BOX) == pytest.approx(5 * 3**0.5, abs=2) and len(rows) == 4
    assert sum(r["lo_x"] is None for r in rows) == 1
    wide = next(r for r in rows if r["uri"] is None and r["lo_x"] is not None)
    assert wide["lo_z"] < 0 < 100 <= wide["hi_z"] and 1000 < wide["hi_x"] < 1300 and wide["hi_y"] > 1000


@pytest.mark.parametrize(("url", "want"), [("http://10.0.0.1:81/api/terrain/", "10.0.0.1_81_api_terrain"), ("https://a.example.com/x", "a.example.com_x"), ("", "server")])
def test_namespace(spark, url, want):
    assert spark.range(1).select(text.url_namespace(F.lit(url))).first()[0] == want


def test_service_documents(spark):
    layer = {"tiles": ["{z}/{x}/{y}.terrain?v={version}"], "version": "1.2.0", "available": [[{"startX": 0, "startY": 0, "endX": 1, "endY": 0}]]}
    got = services.layer(spark.createDataFrame([("https://a.example/t/", json.dumps(layer))], "base_url string, doc string")).first()
    assert got["template"] == "https://a.example/t/{z}/{x}/{y}.terrain?v=1.2.0" and got["max_zoom"] == 19
    xml = "<TileMap><SRS>EPSG:{}</SRS><TileFormat extension='jpg'/><TileSets><TileSet order='0'/><TileSet order='13'/></TileSets></TileMap>"
    rows = services.tile_map(spark.createDataFrame([("a", xml.format(4326)), ("b", xml.format(3857))], "base_url string, doc string")).orderBy("base_url").collect()
    assert [(r["extension"], r["mercator"], r["max_zoom"]) for r in rows] == [("jpg", False, 13), ("jpg", True, 12)]
    quad = {"resourceSets": [{"resources": [{"imageUrl": "u", "imageUrlSubdomains": ["t0"], "zoomMin": 0, "zoomMax": 21}]}]}
    assert tuple(services.quadkey_service(spark.createDataFrame([(json.dumps(quad),)], "doc string")).first()) == ("u", ["t0"], 1, 21)
    asset = {"type": "TERRAIN", "url": "https://b.example/", "accessToken": "t", "attributions": [{"html": "<a>x</a>"}, {"html": " "}]}
    got = services.hosted_asset(spark.createDataFrame([(json.dumps(asset),)], "doc string")).first()
    assert (got["url"], got["token"], got["attributions"]) == ("https://b.example", "t", ["x"])


def test_tileset_root(spark):
    at = lambda url, hosted, key: spark.range(1).select(services.tileset_root(F.lit(url), F.lit(hosted), F.lit(key).cast("string"))).first()[0]
    assert at("https://a.example/x", True, None) == "https://a.example/x/tileset.json"
    assert at("https://a.example/root.json", True, "k") == "https://a.example/root.json?key=k"
    assert at("https://a.example/x", False, "k") == "https://a.example/x"


def _fake_get(url, headers):
    if headers.get("token") != "new":
        return "unauthorized", None
    return ("dead", None) if "none" in url else ("ok", url.encode())


def test_read_through(spark):
    want = spark.createDataFrame([("u1",), ("u2",), ("none",), ("u2",)], "url string")
    cache = spark.createDataFrame([("u1", b"kept")], "url string, content binary")
    got = {r["url"]: (r["outcome"], r["content"]) for r in services.read_through(want, cache, headers={"token": "old"}, refresh=lambda: {"token": "new"}, get=_fake_get).collect()}
    assert got == {"u1": ("ok", b"kept"), "u2": ("ok", b"u2"), "none": ("dead", None)}


def test_terrain_assets_that_are_none(spark):
    docs = [{"type": "TERRAIN", "url": "u"}, {"type": "IMAGERY", "url": "u"}, {"url": "u"}, {"type": "TERRAIN", "externalType": "MAPS", "options": {"url": "v"}}]
    rows = services.terrain_asset(spark.createDataFrame([(json.dumps(d),) for d in docs], "doc string")).collect()
    assert [r["error"] is None for r in rows] == [True, False, False, False] and "MAPS" in rows[3]["error"]


def _image_get(url, headers):
    return "ok", {"jpg": b"\xff\xd8\xff\xe0", "text": b"no tile here"}[url]


def test_images(spark):
    want = spark.createDataFrame([("jpg",), ("text",)], "url string")
    got = {r["url"]: (r["outcome"], r["ext"], r["content"] is None) for r in services.fetch_images(want, spark.createDataFrame([], "url string, content binary"), get=_image_get).collect()}
    assert got == {"jpg": ("ok", ".jpg", False), "text": ("dead", None, True)}


def _counted_get(url, headers):
    return ("http", None) if url == "bad" else ("ok", url.encode())


def test_what_was_fetched_is_kept(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    ask = lambda *urls: spark.createDataFrame([(u,) for u in urls], "url string")
    first = {r["url"]: r["outcome"] for r in services.cached(ask("a", "bad"), path, get=_counted_get).collect()}
    assert first == {"a": "ok", "bad": "http"} and [r["url"] for r in spark.read.parquet(path).collect()] == ["a"]
    services.cached(ask("a", "b"), path, get=_counted_get)
    assert sorted(r["url"] for r in spark.read.parquet(path).collect()) == ["a", "b"]


def test_choice_of_sources():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 2:
            raise OSError("once")
        return "ground"

    def broken():
        raise OSError("gone")

    got = services.connect_sources(Settings(), {"url": flaky}, {"url": broken})
    assert (got.terrain, got.imagery, got.note) == ("ground", None, "imagery off: gone")
    assert services.connect_sources(Settings(terrain_source="none"), {}, {}).note == "no terrain"
    assert services.connect_sources(Settings(imagery_source="none"), {"url": lambda: 1}, {}) == services.Connected(1)
    with pytest.raises(OSError):
        services.connect_sources(Settings(), {"url": broken}, {"url": lambda: 1})
    with pytest.raises(ValueError):
        services.connect_sources(Settings(imagery_source="asset"), {"url": lambda: 1}, {"asset": lambda: 1})


def test_places_in_a_cache(spark):
    path = lambda kind, *key: spark.range(1).select(text.cache_path(F.lit("/c"), F.lit("ns"), kind, [F.lit(k) for k in key], F.lit(".png"))).first()[0]
    assert path("imagery", 3, 1, 2) == "/c/ns/imagery/3/1/2.png" and path("stitched", 3, 0, 0, 1, 1) == "/c/ns/stitched/3_0_0_1_1.png"


def test_meshes_from_bytes(spark):
    """A plane from 0 to 200 m over (5, 10, 10), resampled to its children, and as a mesh."""
    u, v, h = [0, 32767, 0, 32767], [0, 0, 32767, 32767], [0, 32767, 0, 32767]
    data = terrain.encode_tile(u, v, h, [(0, 1, 2), (2, 1, 3)], 0.0, 200.0, metadata={"geometricerror": 12})
    tile = terrain.decode(spark.createDataFrame([("p", data)], "path string, content binary")).withColumns({"z": F.lit(5), "x": F.lit(10).cast("long"), "y": F.lit(10).cast("long")})
    ask = [(6, 21, 20), (6, 20, 20), (7, 43, 40), (5, 10, 10)]
    requests = spark.createDataFrame([(*k, 5, 10, 10) for k in ask], "z int, x long, y long, az int, ax long, ay long")
    got = {(r["z"], r["x"], r["y"]): r for r in mesh.upsample(requests, tile, n=9).collect()}
    assert set(got) == set(ask[:3])
    assert [(got[k]["min_h"], got[k]["max_h"]) for k in ask[:3]] == [pytest.approx(e) for e in ((100, 200), (0, 100), (150, 200))]
    for r in got.values():
        assert len(r["u"]) == len(r["h"]) == 81 and len(r["indices"]) == 3 * 2 * 8 * 8 and max(r["indices"]) == 80
        assert r["west"][1] == 9 and r["east"][0] == 8 and r["south"][-1] == 8 and r["north"][0] == 72
    # Siblings agree along their common side.
    metres = lambda r, i: r["min_h"] + r["h"][i] / mesh.QUANT * (r["max_h"] - r["min_h"])
    right, left = got[6, 21, 20], got[6, 20, 20]
    assert all(abs(metres(left, a) - metres(right, b)) < 0.02 for a, b in zip(left["east"], right["west"], strict=True))
    frame = geo.Frame(-30.0, -62.0)
    whole = {"scale": F.lit(1.0), "u_off": F.lit(0.0), "v_off": F.lit(0.0), "x0": F.lit(0.0), "y0": F.lit(0.0), "x1": F.lit(1.0), "y1": F.lit(1.0)}
    made = mesh.tile_mesh(tile.withColumns(whole), frame).first()
    assert made["n_triangles"] == 2 and made["loops"] == [0, 1, 2, 2, 1, 3] and made["geometric_error"] == 12
    assert made["loop_uvs"] == [0, 0, 1, 0, 0, 1, 0, 1, 1, 0, 1, 1]
    ends = [f(p[a] for p in made["positions"]) for f in (min, max) for a in ("e", "n", "up")]
    assert [*made["lows"], *made["highs"]] == pytest.approx(ends, rel=1e-6) and len(made["positions"]) == 4
    assert all(0 <= t <= 1 for t in mesh.tile_mesh(tile.withColumns(whole), frame, cover=True).first()["loop_uvs"])


def test_nearest_vertices_far_away(spark):
    vertices = spark.createDataFrame([(1, i, 100.0 * i, 0.0, float(i)) for i in range(5)] + [(1, 5, 0.0, 0.0, 9.0)], "mesh int, v long, vx double, vy double, vh double")
    points = spark.createDataFrame([(1, 0, 10.0, 5.0), (1, 1, 5000.0, -7000.0), (1, 2, 0.0, 0.0), (2, 3, 0.0, 0.0)], "mesh int, point long, px double, py double")
    got = {r["point"]: r["h"] for r in mesh.nearest_vertex(points, vertices, "mesh", "point", 50.0).collect()}
    assert got == {0: 0.0, 1: 4.0, 2: 0.0}
    assert mesh.nearest_vertex(points.where("mesh = 2"), vertices, "mesh", "point", 50.0).count() == 0


def test_nets_are_not_broadcast(spark):
    """A triangle's cells are many times what Spark takes them for; broadcast, they would fill the driver."""
    points = spark.createDataFrame([(1, 1, 0.2, 0.2), (1, 2, 5.0, 5.0)], "mesh long, point long, px double, py double")
    triangles = spark.createDataFrame([(1, 0, 0.0, 0.0, 1.0, 1.0, 0.0, 2.0, 0.0, 1.0, 3.0)], "mesh long, tri long, x1 double, y1 double, h1 double, x2 double, y2 double, h2 double, x3 double, y3 double, h3 double")
    vertices = spark.createDataFrame([(1, 0, 0.0, 0.0, 1.0), (1, 1, 1.0, 0.0, 2.0), (1, 2, 0.0, 1.0, 3.0)], "mesh long, v long, vx double, vy double, vh double")
    found = mesh.sample_net(points, triangles, vertices, "mesh", "point", 0.25)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r["point"], round(r["h"], 6), r["hit"]) for r in found.collect()} == {(1, 1.6, True), (2, 2.0, False)}
