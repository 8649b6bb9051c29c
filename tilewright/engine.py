"""A session over one world: what exists, what is known of each tile, and what to do next.

State is a table (z, x, y, state, visible, last_wanted, retries, next_retry, geometric_error, decoded_at);
calls read it and return frames, and `admit` and `advance` write the next one.  Nothing is kept by tile on the
driver: there are a generation and a circuit breaker only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import geo
from tilewright.functions.camera import Camera
from tilewright.operators import availability, lifecycle, selection
from tilewright.settings import Settings
from tilewright.sources import services
from tilewright.sources.shared import written

STATE = "z int, x long, y long, state string, visible boolean, last_wanted double, retries int, next_retry double, geometric_error double, decoded_at double"
KEY = ["z", "x", "y"]


class Engine:
    """connect(), then any number of select() and advance()."""

    def __init__(self, spark: SparkSession, settings: Settings | None = None):
        self.spark, self.settings = spark, settings or Settings()
        self.generation, self.running, self.breaker = 0, True, lifecycle.Breaker()
        self.rects: DataFrame = spark.createDataFrame([], "level int, sx long, sy long, ex long, ey long, ingest_seq long")
        self.clear()

    @property
    def frame(self) -> geo.Frame:
        return geo.Frame(self.settings.origin_lat, self.settings.origin_lon)

    def connect(self, layer_docs: DataFrame) -> DataFrame:
        """Layer documents (base_url, doc): their templates and depths; their rectangles are what exists."""
        found = services.layer(layer_docs)
        meta = found.select(F.lit(0).alias("z"), F.lit(0).cast("long").alias("x"), F.xxhash64("base_url").alias("y"), F.lit(0).cast("long").alias("ingest_seq"), "available")
        self.rects = written(availability.ingest(meta, absolute=True), "rects")
        return found.select("base_url", "template", "max_zoom")

    def ingest(self, metadata: DataFrame) -> None:
        """Rectangles that tiles' own metadata add (z, x, y, ingest_seq, available)."""
        self.rects = written(self.rects.unionByName(availability.ingest(metadata)), "rects")
        self.generation += 1

    def coverage_center(self) -> DataFrame:
        return availability.coverage_center(self.rects)

    def set_origin(self, lat: float, lon: float) -> None:
        """Moves the frame: results on their way are stale, and boxes are taken anew."""
        self.settings = self.settings.but(origin_lat=lat, origin_lon=lon)
        self.generation += 1

    def clear(self) -> None:
        """Forgets all tiles but the roots."""
        roots = [(0, x, 0, "queued", False, 0.0, 0, 0.0, 77067.0, None) for x in (0, 1)]
        self.tiles = self.spark.createDataFrame(roots, STATE)

    def start(self) -> None:
        self.running = True

    def stop(self) -> None:
        """Nothing more is begun, and what was begun goes back to the queue."""
        self.running = False
        state = F.when(F.col("state") == "fetching", "queued").otherwise(F.col("state"))
        self.tiles = written(self.tiles.withColumn("state", state), "tiles")

    def tile_at_origin(self, z: int = 10) -> tuple[int, int, int]:
        row = self.spark.range(1).select(*geo.tile_at(F.lit(z), F.lit(self.settings.origin_lon), F.lit(self.settings.origin_lat))).first()
        return z, row[0], row[1]

    def select(self, camera: Camera, planes=None) -> dict[str, DataFrame]:
        """render, load and keep for a camera, over known tiles and their children."""
        s = self.settings
        kids = self.tiles.select(F.explode(geo.children(F.col("z"), F.col("x"), F.col("y"))).alias("k")).select("k.*")
        every = self.tiles.select(*KEY).unionByName(kids).distinct()
        known = self.tiles.select(*KEY, "state", "geometric_error")
        facts = selection.tile_facts(every.join(known, KEY, "left"), self.rects, camera, self.frame, s.sse_threshold, s.max_level, s.imagery_max_z, planes)
        facts = written(facts, "facts")
        shown, used = selection.with_valve(facts, s.sse_threshold)
        return {"render": shown, "load": selection.load(facts), "keep": selection.keep_set(shown), "threshold": used}

    def admit(self, load: DataFrame, now: float, in_flight: int | None = None) -> DataFrame:
        """The loads that begin, most urgent first; none while stopped or while the breaker is open.

        in_flight: requests on their way; those of fetching tiles if not told.
        """
        rows = load.join(self.tiles.select(*KEY, "state", "next_retry"), KEY, "left")
        rows = rows.withColumn("state", F.coalesce("state", F.lit("queued"))).withColumn("next_retry", F.coalesce("next_retry", F.lit(0.0)))
        most = self.settings.max_requests if self.running and not self.breaker.is_open else 0
        busy = self.tiles.where("state = 'fetching'").count() if in_flight is None else in_flight
        begun = written(lifecycle.admit(rows, now, busy, most), "begun")
        known = begun.select(*KEY, F.lit("fetch").alias("outcome"))
        self.tiles = self._after(known, now, "tiles")
        return begun.orderBy("priority", *KEY)

    def _after(self, outcomes: DataFrame, now: float, name: str) -> DataFrame:
        """The state table after outcomes (z, x, y, outcome[, own_error]), one for a tile."""
        got = outcomes if "own_error" in outcomes.columns else outcomes.withColumn("own_error", F.lit(None).cast("double"))
        rows = self.tiles.join(got, KEY, "full")
        old = F.coalesce("state", F.lit("queued"))
        # A result of an older generation only sends back what is still on its way.
        outcome = F.when((F.col("outcome") == "late") & (old != "fetching"), None).otherwise(F.col("outcome"))
        state, retries, due = lifecycle.after(old, F.coalesce("retries", F.lit(0)), F.coalesce("next_retry", F.lit(0.0)), outcome, F.lit(float(now)))
        rows = rows.select(
            *KEY,
            state.alias("state"),
            (F.coalesce("visible", F.lit(False)) & (state == "built")).alias("visible"),
            F.coalesce("last_wanted", F.lit(0.0)).alias("last_wanted"),
            retries.cast("int").alias("retries"),
            due.alias("next_retry"),
            F.coalesce("own_error", "geometric_error", geo.default_error(F.col("z"))).alias("geometric_error"),
            F.when(state == "decoded", F.when(old == "decoded", F.col("decoded_at")).otherwise(now)).alias("decoded_at"),
        )
        return written(rows, name)

    def advance(self, results: DataFrame, selected: dict[str, DataFrame], now: float, builds: int = 3) -> DataFrame:
        """The next state, and what to show and hide.

        results (z, x, y, outcome[, geometric_error][, generation]) come in, those of an older generation as late and
        one for a tile (an ok before others); of decoded tiles the oldest `builds` are built, and those left for
        a minute queued again; what is wanted is stamped, and what is over the budget goes.
        """
        got = results if "geometric_error" in results.columns else results.withColumn("geometric_error", F.lit(None).cast("double"))
        late = (F.col("generation") != self.generation) if "generation" in results.columns else F.lit(False)
        got = got.select(*KEY, F.when(late, "late").otherwise(F.col("outcome")).alias("outcome"), F.when(~late, F.col("geometric_error")).alias("own_error"))
        rank = F.when(F.col("outcome") == "ok", 0).when(F.col("outcome") == "late", 2).otherwise(1)
        got = written(lifecycle.first_of(got.withColumn("rank", F.struct(rank, "outcome")), KEY, "rank").drop("rank"), "results")
        seen = got.agg(F.count_if(F.col("outcome") == "ok").alias("ok"), F.count_if(F.col("outcome") == "conn").alias("conn")).first()
        self.breaker.seen(seen["ok"], seen["conn"], now)
        self.tiles = self._after(got, now, "tiles")
        decoded = self.tiles.where("state = 'decoded'")
        made = lifecycle.build_batch(decoded, builds).select(*KEY, F.lit("built").alias("outcome"))
        old = decoded.where(now - F.col("decoded_at") > 60.0).join(made, KEY, "left_anti").select(*KEY, F.lit("stale").alias("outcome"))
        next_ = self._after(made.unionByName(old), now, "tiles")
        wanted = selected["load"].select(*KEY).unionByName(selected["keep"].select(*KEY)).distinct().withColumn("wanted", F.lit(True))
        fresh = next_.join(wanted, KEY, "full")
        defaults = {"state": F.lit("queued"), "visible": F.lit(False), "last_wanted": F.lit(0.0), "retries": F.lit(0), "next_retry": F.lit(0.0), "geometric_error": geo.default_error(F.col("z"))}
        fresh = fresh.withColumns({c: F.coalesce(c, v) for c, v in defaults.items()}).withColumn("last_wanted", F.when(F.col("wanted"), now).otherwise(F.col("last_wanted"))).drop("wanted")
        shown = selected["render"].join(next_.where("state = 'built'").select(*KEY), KEY, "left_semi")
        diff = written(lifecycle.visibility_diff(shown, next_.where("visible"), KEY), "visibility")
        turned = diff.select(*KEY, (F.col("action") == "show").alias("now_visible"))
        fresh = written(fresh.join(turned, KEY, "left").withColumn("visible", F.coalesce("now_visible", "visible")).drop("now_visible"), "tiles")
        gone = lifecycle.lru_victims(fresh, selected["keep"], KEY, self.settings.tile_budget, now, 10.0, lifecycle.EVICT_TERRAIN)
        # At most EVICT_TERRAIN rows.
        gone = F.broadcast(gone.select(*KEY, F.lit("queued").alias("evicted")))
        self.tiles = written(fresh.join(gone, KEY, "left").withColumn("state", F.coalesce("evicted", "state")).select(*(c.split()[0] for c in STATE.split(", "))), "tiles")
        return diff

    def status(self) -> DataFrame:
        return lifecycle.state_counts(self.tiles)
