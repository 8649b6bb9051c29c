"""Selection over an explicit tree of nodes with boxes, contents and two kinds of refinement.

nodes: id, parent, depth, error, refine (REPLACE or ADD), uri, lo_x .. hi_z, is_ready[, grafted].
Readiness of subtrees goes up from the leaves, one join a level; which nodes are reached
comes down from the root the same way.  Levels are few (at most `MAX_DEPTH`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions import geo
from tilewright.functions.camera import Camera
from tilewright.functions.text import is_tileset_uri
from tilewright.sources.shared import written

MAX_DEPTH = 64
READY_DEPTH = 10


def node_facts(nodes: DataFrame, camera: Camera, threshold: float, max_dist: float = float("inf"), falloff: float = 600.0, planes=None) -> DataFrame:
    """Adds dist, err, thr, seen, external (a tileset not grafted yet), drawable, wants_children."""
    pos = [F.lit(float(v)) for v in camera.pos]
    lo, hi = [F.col(f"lo_{a}") for a in "xyz"], [F.col(f"hi_{a}") for a in "xyz"]
    rows = nodes if "grafted" in nodes.columns else nodes.withColumn("grafted", F.lit(False))
    rows = rows.withColumn("dist", geo.box_distance(lo, hi, pos))
    rows = rows.withColumn("seen", F.col("lo_x").isNotNull() & geo.box_in_planes(lo, hi, planes or camera.planes()) & (F.col("dist") <= max_dist))
    err = F.when(F.col("error") <= 0, 0.0).otherwise(geo.sse(F.col("error"), F.col("dist"), camera.height_px, camera.p11, camera.perspective))
    rows = rows.withColumn("err", F.round(err, 6)).withColumn("thr", F.round(threshold * (1.0 + F.col("dist") / max(falloff, 1.0)), 6))
    is_set = F.coalesce(is_tileset_uri(F.col("uri")), F.lit(False))
    rows = rows.withColumn("tileset", is_set).withColumn("drawable", (F.coalesce("uri", F.lit("")) != "") & ~is_set)
    parents = rows.where("parent is not null").select(F.col("parent").alias("id")).distinct().withColumn("has_kids", F.lit(True))
    rows = rows.join(parents, "id", "left").withColumn("has_kids", F.coalesce("has_kids", F.lit(False)))
    return rows.withColumn("wants_children", ((F.col("err") > F.col("thr")) | ~F.col("drawable")) & (F.col("has_kids") | F.col("tileset")))


def select_nodes(facts: DataFrame) -> DataFrame:
    """(id, render, load, priority, keep) of the nodes that any of these is true for."""
    used = ["id", "parent", "depth", "refine", "is_ready", "seen", "err", "tileset", "grafted", "has_kids", "wants_children"]
    base = written(facts.select(*used, (F.coalesce("uri", F.lit("")) != "").alias("has_uri")), "node-facts")
    deepest = base.agg(F.max("depth")).first()[0]
    if deepest is None:
        return base.select("id", F.lit(False).alias("render"), F.lit(False).alias("load"), F.lit(0.0).alias("priority"), F.lit(False).alias("keep"))
    # Up: whether a subtree may take its parent's place.
    ready = every = None
    for depth in range(deepest, -1, -1):
        level = base.where(F.col("depth") == depth)
        if ready is None:
            level = level.withColumn("kids_ready", F.lit(True))
        else:
            below = ready.groupBy("parent").agg(F.bool_and(~F.col("seen") | F.col("subtree_ready")).alias("kids_ready")).withColumnRenamed("parent", "id")
            level = level.join(below, "id", "left").withColumn("kids_ready", F.coalesce("kids_ready", F.lit(True)))
        ready = level.withColumn("subtree_ready", F.when(F.col("has_uri"), ~F.col("tileset") & F.col("is_ready")).otherwise(F.col("kids_ready")))
        # A few levels are one plan; deeper trees are cut, so plans stay short.
        if (deepest - depth) % 4 == 3:
            ready = written(ready, "node-levels")
        every = ready if every is None else every.unionByName(ready)
    every = written(every, "nodes")
    # Down: reached nodes, and frontiers that a gated parent waits for.
    reached = every.where("depth = 0 and seen").withColumn("wait", F.lit(None).cast("double"))
    out = None
    for depth in range(deepest + 1):
        walk = reached.where("wait is null")
        external = F.col("tileset") & ~F.col("grafted")
        leaf = ~F.col("wants_children") | ~F.col("has_kids")
        add = F.col("refine") == "ADD"
        gated = ~external & ~add & ~leaf & ~F.col("kids_ready")
        shown = ~external & F.col("has_uri")
        # A gated parent shows but isn't fetched itself.
        fetched = external | (shown & ~gated & ~F.col("is_ready"))
        passes = shown & (add | leaf | gated)
        rows = walk.select("id", passes.alias("render"), (external | (fetched & passes)).alias("load"), (-F.col("err")).alias("priority"), F.lit(True).alias("keep"))
        waiting = reached.where("wait is not null")
        rows = rows.unionByName(waiting.select("id", F.lit(False).alias("render"), (F.col("has_uri") & ~F.col("is_ready")).alias("load"), F.col("wait").alias("priority"), (~F.col("has_uri")).alias("keep")))
        out = rows if out is None else out.unionByName(rows)
        if depth == deepest:
            break
        go = walk.where(~external & F.col("wants_children") & (add | ~leaf)).select(F.col("id").alias("parent"), F.when(gated, -F.col("err")).alias("wait"))
        on = waiting.where(~F.col("has_uri")).select(F.col("id").alias("parent"), "wait")
        # Children of ADD nodes are tested when they are met; all others only if seen, which is the same.
        reached = written(every.where((F.col("depth") == depth + 1) & F.col("seen")).join(go.unionByName(on), "parent"), "node-front")
    best = out.groupBy("id").agg(F.bool_or("render").alias("render"), F.bool_or("load").alias("load"), F.min(F.when(F.col("load"), F.col("priority"))).alias("priority"), F.bool_or("keep").alias("keep"))
    return best.where("render or load or keep")


def graft(nodes: DataFrame, mounts: DataFrame, external: DataFrame) -> DataFrame:
    """Puts external trees in the place of the nodes that name them.

    mounts (node_id, root_id); external: nodes of the fetched trees, ids distinct from all others,
    with a column tree, their root's id, and depths from that root.
    The root's content, children and box (if it has one) become the node's; the root itself stays as
    an orphan, as ids are never reused.
    """
    node = nodes if "grafted" in nodes.columns else nodes.withColumn("grafted", F.lit(False))
    root = external.join(mounts, external["id"] == mounts["root_id"]).select(F.col("node_id").alias("id"), F.col("uri").alias("new_uri"), *(F.col(f"{e}_{a}").alias(f"new_{e}_{a}") for e in ("lo", "hi") for a in "xyz"), F.lit(True).alias("mounted"))
    boxes = [f"{e}_{a}" for e in ("lo", "hi") for a in "xyz"]
    kept = node.join(root, "id", "left")
    own = kept.select(*(
        F.when(F.col("mounted"), F.col("new_uri")).otherwise(F.col("uri")).alias(c) if c == "uri"
        else F.coalesce(f"new_{c}", c).alias(c) if c in boxes
        else F.coalesce("mounted", "grafted").alias(c) if c == "grafted"
        else F.col(c)
        for c in node.columns
    ))
    # Children that the node had before go with its old content.
    own = own.join(mounts.select(F.col("node_id").alias("parent")), "parent", "left_anti")
    at = mounts.join(node.select(F.col("id").alias("node_id"), F.col("depth").alias("up")), "node_id").withColumnRenamed("root_id", "tree")
    ext = external if "grafted" in external.columns else external.withColumn("grafted", F.lit(False))
    moved = ext.join(at, "tree")
    moved = moved.withColumn("parent", F.when(F.col("parent") == F.col("tree"), F.col("node_id")).otherwise(F.col("parent"))).withColumn("depth", (F.col("depth") + F.col("up")).cast("int"))
    return own.select(*node.columns).unionByName(moved.select(*node.columns))
