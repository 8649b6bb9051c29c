import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.engine import Engine
from tilewright.functions import geo
from tilewright.functions.camera import ACCEPT_ALL, Camera
from tilewright.node_session import NodeSession
from tilewright.operators import imagery, lifecycle
from tilewright.settings import Settings
from tilewright.sources import services, tilesets


def test_settings_are_held_within_bounds():
    s = Settings(sse_threshold=500.0, tile_budget=1, max_level=30)
    assert (s.sse_threshold, s.tile_budget, s.max_level) == (128.0, 50, 19)
    assert Settings().but(max_requests=0).max_requests == 1
    with pytest.raises(ValueError):
        Settings(terrain_source="disk")
    with pytest.raises(ValueError):
        Settings().but(nothing=1)


def test_session(spark):
    engine = Engine(spark, Settings(origin_lat=46.55, origin_lon=7.98, sse_threshold=16.0, max_level=4))
    rect = lambda x, y: [{"startX": 0, "startY": 0, "endX": x, "endY": y}]
    layer = json.dumps({"tiles": ["{z}/{x}/{y}.terrain"], "available": [rect((2 << z) - 1, (1 << z) - 1) for z in range(6)]})
    assert engine.connect(spark.createDataFrame([("http://a.example", layer)], "base_url string, doc string")).first()["max_zoom"] == 19
    assert engine.coverage_center().first()["level"] == 5
    assert engine.tile_at_origin(10) == (10, 1069, 776)
    camera = Camera(pos=(0.0, 0.0, 50_000.0), pitch=-90.0)
    for now in range(1, 6):
        picked = engine.select(camera, planes=ACCEPT_ALL)
        begun = engine.admit(picked["load"], float(now))
        assert begun.count() <= engine.settings.max_requests
        results = begun.select("z", "x", "y", F.lit("ok").alias("outcome"))
        engine.advance(results, picked, float(now))
    status = {r["state"]: r["n"] for r in engine.status().collect()}
    assert status["built"] > 4
    assert engine.tiles.where("visible").count() > 0
    generation = engine.generation
    engine.set_origin(0.0, 0.0)
    assert engine.generation == generation + 1
    engine.clear()
    assert engine.tiles.count() == 2


RESULT = "z int, x long, y long, outcome string, generation int"


def _idle(spark):
    none = spark.createDataFrame([], "z int, x long, y long")
    return {"render": none, "load": none.withColumn("priority", F.lit(0.0)), "keep": none}


def _states(engine):
    return {r["x"]: r["state"] for r in engine.tiles.where("z = 0").collect()}


def test_requests_decode_and_build_in_steps(spark):
    engine = Engine(spark, Settings())
    load = spark.createDataFrame([(0, 0, 0, -1.0), (0, 1, 0, -2.0)], "z int, x long, y long, priority double")
    assert [r["x"] for r in engine.admit(load, 0.0).collect()] == [1, 0] and set(_states(engine).values()) == {"fetching"}
    assert engine.admit(load, 0.0).count() == 0
    done = spark.createDataFrame([(0, 0, 0, "conn", 0), (0, 0, 0, "ok", 0), (0, 1, 0, "ok", 0)], RESULT)
    engine.advance(done, _idle(spark), 1.0, builds=1)
    assert engine.tiles.count() == 2 and sorted(_states(engine).values()) == ["built", "decoded"]
    none = done.limit(0)
    engine.advance(none, _idle(spark), 90.0, builds=0)
    assert sorted(_states(engine).values()) == ["built", "queued"]


def test_late_results_and_dead_tiles(spark):
    engine = Engine(spark, Settings())
    load = spark.createDataFrame([(0, 0, 0, -1.0)], "z int, x long, y long, priority double")
    engine.admit(load, 0.0)
    engine.set_origin(1.0, 1.0)
    engine.advance(spark.createDataFrame([(0, 0, 0, "ok", 0), (0, 1, 0, "dead", 1)], RESULT), _idle(spark), 1.0)
    assert _states(engine) == {0: "queued", 1: "dead"}
    engine.advance(spark.createDataFrame([(0, 1, 0, "ok", 1)], RESULT), _idle(spark), 2.0)
    assert _states(engine)[1] == "dead"


def test_breaker_of_a_session(spark):
    engine = Engine(spark, Settings())
    lost = spark.createDataFrame([(4, x, 0, "conn", 0) for x in range(8)], RESULT)
    load = spark.createDataFrame([(0, 0, 0, -1.0)], "z int, x long, y long, priority double")
    engine.advance(lost, _idle(spark), 100.0)
    assert engine.breaker.is_open and engine.admit(load, 100.0).count() == 0
    engine.advance(spark.createDataFrame([(0, 1, 0, "ok", 0)], RESULT), _idle(spark), 101.0)
    # A good result sets the count back, but only a good probe closes it.
    assert engine.breaker.is_open and engine.breaker.failures == 0 and not engine.breaker.probe_due(105.0) and engine.breaker.probe_due(110.0)
    engine.breaker.probed(False, 110.0)
    assert engine.breaker.is_open and not engine.breaker.probe_due(115.0)
    engine.breaker.probed(True, 120.0)
    assert not engine.breaker.is_open and engine.admit(load, 120.0).count() == 1
    engine.stop()
    assert _states(engine)[0] == "queued" and engine.admit(load, 121.0).count() == 0


def test_node_session(spark):
    """Documents are read, selected from, loaded, grafted and shown."""
    frame = geo.Frame(0.0, 0.0)
    x, y, z = frame.origin
    move = [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, x, y, z, 1]
    ball = {"sphere": [0, 0, 0, 50]}
    root = {"root": {"transform": move, "geometricError": 200, "boundingVolume": ball, "children": [{"geometricError": 0, "boundingVolume": ball, "content": {"uri": "a.glb"}}, {"geometricError": 10, "boundingVolume": ball, "content": {"uri": "more/set.json"}}]}}
    inner = {"root": {"transform": move, "geometricError": 100, "boundingVolume": ball, "children": [{"geometricError": 0, "boundingVolume": ball, "content": {"uri": "b.glb"}}]}}
    session = NodeSession(spark, Settings(origin_lat=0.0, origin_lon=0.0))
    bad = session.connect(spark.createDataFrame([("https://a.example/s.json", json.dumps(root)), ("x", "{")], "url string, doc string"))
    assert [r["url"] for r in bad.collect()] == ["x"] and session.nodes.count() == 3
    camera = Camera(pos=(0.0, 0.0, 200.0), pitch=-90.0)
    picked = session.select(camera, planes=ACCEPT_ALL)
    assert session.admit(picked, 0.0).count() == 0  # not started
    session.start()
    begun = {r["uri"]: r for r in session.admit(picked, 0.0).collect()}
    assert set(begun) == {"https://a.example/a.glb", "https://a.example/more/set.json"} and begun["https://a.example/more/set.json"]["external"]
    ids = {u: r["id"] for u, r in begun.items()}
    results = spark.createDataFrame([(ids["https://a.example/a.glb"], "ok", 1, session.generation), (ids["https://a.example/a.glb"], "dead", 0, -1)], "id long, outcome string, objects int, generation int")
    documents = spark.createDataFrame([(ids["https://a.example/more/set.json"], "https://a.example/more/set.json", json.dumps(inner))], "id long, url string, doc string")
    session.advance(results, picked, 1.0, documents)
    assert session.nodes.where("grafted").count() == 1 and session.nodes.where("uri like '%more/b.glb'").count() == 1
    picked = session.select(camera, planes=ACCEPT_ALL)
    begun = session.admit(picked, 2.0).collect()
    assert [r["uri"] for r in begun] == ["https://a.example/more/b.glb"]
    session.advance(spark.createDataFrame([(begun[0]["id"], "ok", 2, session.generation)], "id long, outcome string, objects int, generation int"), picked, 3.0)
    picked = session.select(camera, planes=ACCEPT_ALL)
    shown = session.advance(results.limit(0), picked, 4.0)
    assert session.states.where("visible").count() == 2 and {r["action"] for r in shown.collect()} <= {"show"}
    assert session.status().first()["built"] == 2
    nodes, generation = session.nodes.count(), session.generation
    session.set_origin(1.0, 1.0)
    assert session.nodes.count() == nodes and session.states.count() == 0 and session.generation == generation + 1
    session.stop()
    session.clear()
    assert session.nodes.count() == 0 and not session.running


def test_failures_back_off_and_die(spark):
    engine = Engine(spark, Settings())
    none = spark.createDataFrame([], "z int, x long, y long")
    picked = {"render": none, "load": none.withColumn("priority", F.lit(0.0)), "keep": none}
    due = []
    for now in (0.0, 10.0, 20.0, 30.0):
        engine.advance(spark.createDataFrame([(0, 0, 0, "conn")], "z int, x long, y long, outcome string"), picked, now)
        due.append(tuple(engine.tiles.where("x = 0").select("state", "next_retry").first()))
    assert due == [("failed", 1.0), ("failed", 14.0), ("failed", 35.0), ("dead", 35.0)]


def test_stitch(spark):
    image = lambda v, w=2, h=1: (w, h, bytes([v] * (w * h * 4)))
    cells = spark.createDataFrame([(3, 0, 0, 1, 1, x, y) for x in (0, 1) for y in (0, 1)] + [(4, 0, 0, 0, 1, 0, y) for y in (0, 1)], "m int, tx0 long, ty0 long, tx1 long, ty1 long, tx long, ty long")
    images = spark.createDataFrame([(3, x, y, *image(10 * y + x)) for x in (0, 1) for y in (0, 1)] + [(4, 0, 0, *image(1)), (4, 0, 1, *image(1, 3))], "m int, tx long, ty long, width int, height int, pixels binary")
    got = {r["m"]: r for r in imagery.stitch(cells, images).collect()}
    grid = np.frombuffer(got[3]["pixels"], np.uint8).reshape(2, 4, 4)[:, :, 0]
    assert grid.tolist() == [[0, 0, 1, 1], [10, 10, 11, 11]] and (got[3]["width"], got[3]["height"]) == (4, 2)
    assert got[4]["pixels"] is None


def test_small_operators(spark):
    rows = spark.createDataFrame([(1, 0, 0, "decoded", 0.0), (1, 1, 0, "decoded", 50.0), (1, 2, 0, "built", 0.0)], "z int, x long, y long, state string, decoded_at double")
    assert [r["state"] for r in lifecycle.requeue_stale(rows, 70.0).orderBy("x").collect()] == ["queued", "decoded", "built"]
    assert [r["x"] for r in lifecycle.build_batch(rows, 1).collect()] == [0]
    nodes = spark.createDataFrame([("a.glb", 2), ("b.json", 2), (None, 1)], "uri string, retries int")
    assert [(r["state"], r["retries"]) for r in lifecycle.after_graft(nodes).collect()] == [("queued", 0), ("built", 2), ("built", 1)]
    late = spark.createDataFrame([(1,), (2,)], "generation int")
    assert lifecycle.accept(late, 2).count() == 1
    sign = lambda v: lifecycle.camera_signature(F.array(F.lit(v), F.lit(-0.0)), F.lit(10), F.lit(20))
    a, b, c = spark.range(1).select(sign(1.0), sign(1.0 + 1e-12), sign(1.1)).first()
    assert a == b != c


def test_content_matrix(spark):
    frame = geo.Frame(10.0, 20.0)
    world = np.eye(4)
    world[:3, 3] = [1, 2, 3]
    want = np.array(frame.matrix()) @ world @ np.array([[1, 0, 0, 7], [0, 1, 0, 8], [0, 0, 1, 9], [0, 0, 0, 1]])
    got = spark.range(1).select(tilesets.content_matrix(F.array(*map(F.lit, world.reshape(-1).tolist())), frame, F.array(*map(F.lit, (7.0, 8.0, 9.0))))).first()[0]
    assert np.allclose(np.array(got).reshape(4, 4), want, atol=1e-6) and math.isfinite(got[0])


def _get(url, headers):
    return "ok", b"{}" if url == "good" else b"{"


def test_fetch_json(spark):
    want = spark.createDataFrame([("good",), ("bad",)], "url string")
    cache = spark.createDataFrame([], "url string, content binary")
    got = {r["url"]: (r["outcome"], r["doc"]) for r in services.fetch_json(want, cache, get=_get).collect()}
    assert got == {"good": ("ok", "{}"), "bad": ("http", None)}
