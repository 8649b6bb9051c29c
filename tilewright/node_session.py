"""A session over trees of contents: their nodes, what is known of each, and what to do next.

The tree (nodes with boxes) and the states (id, state, retries, next_retry, n_objects, visible, last_wanted,
decoded_at) are tables; select() reads them, advance() writes the next ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import geo
from tilewright.functions.camera import Camera
from tilewright.functions.text import is_tileset_uri
from tilewright.operators import lifecycle, tree
from tilewright.settings import Settings
from tilewright.sources import tilesets
from tilewright.sources.shared import written

STATE = "id long, state string, retries int, next_retry double, n_objects int, visible boolean, last_wanted double"
MOUNTS = "node_id long, root_id long"


class NodeSession:
    """connect() to documents, start(), then any number of select(), admit() and advance()."""

    def __init__(self, spark: SparkSession, settings: Settings | None = None):
        self.spark, self.settings = spark, settings or Settings()
        self.generation, self.running, self.breaker = 0, False, lifecycle.Breaker()
        self.clear()

    @property
    def frame(self) -> geo.Frame:
        return geo.Frame(self.settings.origin_lat, self.settings.origin_lon)

    def clear(self) -> None:
        """Forgets trees and contents; results on their way are stale."""
        self.generation += 1
        self.parsed = self.spark.createDataFrame([], tilesets.NODES)
        self.mounts = self.spark.createDataFrame([], MOUNTS)
        self.states = self.spark.createDataFrame([], STATE)
        self.nodes = self._boxed()

    def connect(self, docs: DataFrame) -> DataFrame:
        """Root documents (url, doc) in the place of what there was; returns those that can't be read (url, error)."""
        self.clear()
        found = written(tilesets.parse(docs), "documents")
        self.parsed = found.where("error is null")
        self.nodes = self._boxed()
        return found.where("error is not null").select("url", "error")

    def start(self) -> None:
        self.running = True

    def stop(self) -> None:
        """Nothing more is begun, and what was begun goes back to the queue."""
        self.running = False
        self._after(self.states.where("state = 'fetching'").select("id", F.lit("stop").alias("outcome")), 0.0)

    def set_origin(self, lat: float, lon: float) -> None:
        """Moves the frame: contents go, the tree stays and its boxes are taken anew."""
        self.settings = self.settings.but(origin_lat=lat, origin_lon=lon)
        self.generation += 1
        self.states = self.spark.createDataFrame([], STATE)
        self.nodes = self._boxed()

    def _boxed(self) -> DataFrame:
        """All trees read so far, those that are mounted in their places."""
        every = written(tilesets.tree_nodes(self.parsed, self.frame), "nodes")
        inner = every.join(self.mounts.select(F.col("root_id").alias("tree")), "tree", "left_semi")
        outer = every.join(self.mounts.select(F.col("root_id").alias("tree")), "tree", "left_anti").drop("tree")
        nodes = outer.withColumn("grafted", F.lit(False))
        # A tree may hang on one that was mounted itself: one round for each such storey.
        left = self.mounts
        while not left.isEmpty():
            now = written(left.join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi"), "mounts")
            if now.isEmpty():
                break
            nodes = written(tree.graft(nodes, now, inner.join(now.select(F.col("root_id").alias("tree")), "tree", "left_semi")), "nodes")
            left = written(left.join(now, ["node_id", "root_id"], "left_anti"), "mounts")
        return nodes

    def select(self, camera: Camera, max_dist: float = float("inf"), planes=None) -> DataFrame:
        """(id, render, load, priority, keep) for a camera."""
        known = self.states.select("id", (F.col("state") == "built").alias("built"))
        nodes = self.nodes.join(known, "id", "left").withColumn("is_ready", F.coalesce("built", F.lit(False))).drop("built")
        s = self.settings
        return written(tree.select_nodes(tree.node_facts(nodes, camera, s.sse_threshold, max_dist, s.node_falloff, planes)), "selected")

    def admit(self, selected: DataFrame, now: float) -> DataFrame:
        """(id, uri, external) of the loads that begin, most urgent first; none while stopped or the breaker is open."""
        wanted = selected.where("load").join(self.states.select("id", "state", "next_retry"), "id", "left")
        wanted = wanted.withColumns({"state": F.coalesce("state", F.lit("queued")), "next_retry": F.coalesce("next_retry", F.lit(0.0))})
        due = (F.col("state") == "queued") | ((F.col("state") == "failed") & (F.col("next_retry") <= now))
        busy = self.states.where("state = 'fetching'").count()
        most = max(0, self.settings.node_requests - busy) if self.running and not self.breaker.is_open else 0
        begun = written(wanted.where(due).orderBy("priority", "id").limit(most).select("id", "priority"), "begun")
        self._after(begun.select("id", F.lit("fetch").alias("outcome")), now)
        return begun.join(self.nodes.select("id", "uri"), "id").orderBy("priority", "id").select("id", "uri", is_tileset_uri(F.col("uri")).alias("external"))

    def _after(self, outcomes: DataFrame, now: float) -> None:
        got = outcomes if "objects" in outcomes.columns else outcomes.withColumn("objects", F.lit(None).cast("int"))
        rows = self.states.join(got, "id", "full")
        state, retries, due = lifecycle.after(F.coalesce("state", F.lit("queued")), F.coalesce("retries", F.lit(0)), F.coalesce("next_retry", F.lit(0.0)), F.col("outcome"), F.lit(float(now)))
        rows = rows.select("id", state.alias("state"), retries.cast("int").alias("retries"), due.alias("next_retry"), F.coalesce("objects", "n_objects", F.lit(0)).cast("int").alias("n_objects"), F.coalesce("visible", F.lit(False)).alias("visible"), F.coalesce("last_wanted", F.lit(0.0)).alias("last_wanted"))
        self.states = written(rows, "node-states")

    def _graft(self, docs: DataFrame) -> DataFrame:
        """Mounts fetched documents (id, url, doc); what came of each (id, outcome)."""
        read = written(tilesets.parse(docs), "documents")
        bad = read.where("error is not null").select("url").distinct()
        good = docs.select("id", "url").join(bad, "url", "left_anti")
        have = self.parsed.select("url").distinct()
        self.parsed = written(self.parsed.unionByName(read.where("error is null").join(have, "url", "left_anti")), "documents")
        mounts = good.select(F.col("id").alias("node_id"), F.xxhash64("url", F.lit(1).cast("long")).alias("root_id"))
        self.mounts = written(self.mounts.unionByName(mounts).distinct(), "mounts")
        self.nodes = self._boxed()
        now = self.nodes.join(good.select("id"), "id", "left_semi")
        drawable = (F.coalesce("uri", F.lit("")) != "") & ~is_tileset_uri(F.col("uri"))
        fine = now.select("id", F.when(drawable, "graft_drawable").otherwise("graft_done").alias("outcome"))
        return fine.unionByName(docs.join(bad, "url", "left_semi").select("id", F.lit("http").alias("outcome")))

    def advance(self, results: DataFrame, selected: DataFrame, now: float, documents: DataFrame | None = None) -> DataFrame:
        """The next states, and what to show and hide (id, action).

        results (id, outcome[, objects][, generation]): those of an older generation are dropped, of several for a node
        an ok counts; a model that came is built at once.  documents (id, url, doc): external trees that came.
        """
        got = results.where(F.col("generation") == self.generation) if "generation" in results.columns else results
        got = got if "objects" in got.columns else got.withColumn("objects", F.lit(None).cast("int"))
        outcome = F.when(F.col("outcome") == "ok", "built").otherwise(F.col("outcome"))
        got = got.select("id", outcome.alias("outcome"), "objects").withColumn("rank", F.struct(F.col("outcome") != "built", "outcome"))
        got = written(lifecycle.first_of(got, ["id"], "rank").drop("rank"), "results")
        seen = got.agg(F.count_if(F.col("outcome") == "built").alias("ok"), F.count_if(F.col("outcome") == "conn").alias("conn")).first()
        self.breaker.seen(seen["ok"], seen["conn"], now)
        if documents is not None:
            grafted = self._graft(written(documents.select("id", "url", "doc"), "documents"))
            got = got.join(grafted, "id", "left_anti").unionByName(grafted.withColumn("objects", F.lit(0)))
        self._after(got, now)
        built = self.states.where("state = 'built' and n_objects > 0").select("id")
        shown = selected.where("render").join(built, "id", "left_semi")
        diff = written(lifecycle.visibility_diff(shown, self.states.where("visible"), ["id"]).drop("step"), "visibility")
        turned = diff.select("id", (F.col("action") == "show").alias("now_visible"))
        wanted = selected.where("load or keep").select("id", F.lit(True).alias("wanted"))
        rows = self.states.join(turned, "id", "left").join(wanted, "id", "left")
        rows = rows.withColumns({"visible": F.coalesce("now_visible", "visible"), "last_wanted": F.when(F.col("wanted"), now).otherwise(F.col("last_wanted"))}).drop("now_visible", "wanted")
        rows = written(rows, "node-states")
        gone = lifecycle.lru_victims(rows, selected.where("keep").select("id"), ["id"], self.settings.node_budget, now, 10.0, lifecycle.EVICT_NODES)
        # At most EVICT_NODES rows.
        gone = F.broadcast(gone.select("id", F.lit("queued").alias("evicted")))
        rows = rows.join(gone, "id", "left").withColumns({"state": F.coalesce("evicted", "state"), "n_objects": F.when(F.col("evicted").isNotNull(), 0).otherwise(F.col("n_objects"))})
        self.states = written(rows.select(*(c.split()[0] for c in STATE.split(", "))), "node-states")
        return diff

    def status(self) -> DataFrame:
        return lifecycle.node_stats(self.nodes.select("id").join(self.states, "id", "left").withColumns({"state": F.coalesce("state", F.lit("queued")), "n_objects": F.coalesce("n_objects", F.lit(0))}))
