"""The life of tiles: counts, admission, retries, the circuit breaker, eviction, visibility."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions.text import is_tileset_uri
from tilewright.sources.shared import written

#: Seconds until the first, second and third retry; after that a tile is dead.
BACKOFF = (1.0, 4.0, 15.0)
BREAKER_FAILURES = 8
#: Seconds between an open breaker's probes.
PROBE_EVERY = 10.0
#: What counts as a failure, and what sends a tile back to the queue.
FAILURES = ("http", "conn", "build_failed")
BACK = ("evict", "stale", "stop", "late", "graft_drawable")
EVICT_TERRAIN, EVICT_NODES = 24, 16
SELECT_AGE = 0.5


def state_counts(tiles: DataFrame) -> DataFrame:
    return tiles.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.count_if("visible").alias("n_visible"), F.coalesce(F.max("z"), F.lit(0)).cast("long").alias("max_level"))


def node_stats(nodes: DataFrame) -> DataFrame:
    """One row about nodes (state, n_objects, retries)."""
    count = lambda c: F.count_if(c)
    return nodes.agg(count((F.col("state") == "built") & (F.col("n_objects") > 0)).alias("built"), count(F.col("state") == "fetching").alias("fetching"), count(F.col("state") == "dead").alias("dead"), F.count(F.lit(1)).alias("known"))


def request_tally(log: DataFrame) -> DataFrame:
    kind = F.col("outcome")
    return log.agg(F.count(F.lit(1)).alias("total"), F.count_if(kind == "ok").alias("ok"), F.count_if(kind == "dead").alias("not_found"), F.count_if(kind == "http").alias("http_error"), F.count_if(kind == "conn").alias("conn_error"))


def elevation_range(tiles: DataFrame) -> DataFrame:
    """(low, high) over visible tiles with heights; at least 200 m apart; 0 and 4000 if there are none."""
    found = tiles.where("visible and min_h is not null and max_h is not null").agg(F.min("min_h").alias("a"), F.max("max_h").alias("b"))
    return found.select(F.coalesce("a", F.lit(0.0)).alias("low"), F.when(F.col("a").isNull(), 4000.0).when(F.col("b") - F.col("a") < 200.0, F.col("a") + 200.0).otherwise(F.col("b")).alias("high"))


def admit(wanted: DataFrame, now: float, in_flight: int, most: int) -> DataFrame:
    """The most urgent tiles (priority, z, x, y, state, next_retry) that free request slots take."""
    due = (F.col("state") == "queued") | ((F.col("state") == "failed") & (F.col("next_retry") <= now))
    return wanted.where(due).orderBy("priority", "z", "x", "y").limit(max(0, most - in_flight))


def lru_victims(tiles: DataFrame, keep: DataFrame, key: list[str], budget: int, now: float, grace: float, cap: int) -> DataFrame:
    """Hidden built tiles outside keep to evict, least recently wanted first.

    As many as there are more built ones than the budget, at most cap: a count, then a top-k, so
    no task sorts all tiles.
    """
    built = tiles.where("state = 'built'")
    over = max(0, built.count() - budget)
    free = built.where(~F.col("visible") & (now - F.col("last_wanted") > grace)).join(keep, key, "left_anti")
    return free.orderBy("last_wanted", *key).limit(min(over, cap)).select(*key, "last_wanted")


def visibility_diff(rendered: DataFrame, visible: DataFrame, key: list[str]) -> DataFrame:
    """(key, action): what to show (1) and then what to hide (2)."""
    show = rendered.select(*key).join(visible.select(*key), key, "left_anti").withColumn("action", F.lit("show")).withColumn("step", F.lit(1))
    hide = visible.select(*key).join(rendered.select(*key), key, "left_anti").withColumn("action", F.lit("hide")).withColumn("step", F.lit(2))
    return show.unionByName(hide)


def first_of(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each key: ingest once, single flight, load once."""
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def retry_schedule(failures: DataFrame, key: list[str], time: str, order: list[str]) -> DataFrame:
    """For each failure its ordinal, the state after it and when to retry; counts never reset."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    rows = failures.withColumn("retry", n)
    wait = F.when(F.col("retry") <= len(BACKOFF), F.element_at(F.array(*map(F.lit, BACKOFF)), F.least(F.col("retry"), F.lit(len(BACKOFF)))))
    return rows.withColumn("state", F.when(F.col("retry") <= len(BACKOFF), "failed").otherwise("dead")).withColumn("next_retry", F.col(time) + wait)


def after(state: Column, retries: Column, next_retry: Column, outcome: Column, now: Column) -> tuple[Column, Column, Column]:
    """(state, retries, next_retry) of a tile after an outcome; null: none.  Dead tiles stay dead.

    fetch, ok, built: fetching, decoded, built; dead: dead; FAILURES: failed until the next retry, dead
    at the fourth; BACK: queued, a grafted node that can be drawn with no failures counted; graft_done: built.
    """
    bad, live = outcome.isin(*FAILURES), (state != "dead") & outcome.isNotNull()
    tries = F.when(~live, retries).when(outcome == "graft_drawable", 0).otherwise(retries + bad.cast("int"))
    fatal = (outcome == "dead") | (bad & (tries > len(BACKOFF)))
    plain = F.create_map(*[F.lit(x) for pair in (("fetch", "fetching"), ("ok", "decoded"), ("built", "built"), ("graft_done", "built"), *((x, "failed") for x in FAILURES), *((x, "queued") for x in BACK)) for x in pair])
    wait = F.element_at(F.array(*map(F.lit, BACKOFF)), F.least(F.greatest(tries, F.lit(1)), F.lit(len(BACKOFF))).cast("int"))
    then = F.when(~live, state).when(fatal, "dead").otherwise(F.coalesce(F.element_at(plain, outcome), state))
    return then, tries, F.when(live & bad & ~fatal, now + wait).otherwise(next_retry)


def breaker(log: DataFrame, order: list[str], part: Column, failures: int = BREAKER_FAILURES) -> DataFrame:
    """(max_run, openings) of connection failures since the last ok, of a log that has one order.

    The log is cut into ranges of its order, which Spark makes equal in rows whatever the hours are like.
    Each range is reduced, in a stream, to four numbers: failures before its first ok and after its
    last, the longest run between, and how many of those reach the limit; only these are put in order.
    part: the number of a row's range, as deal() gives it.
    """
    w = Window.partitionBy("part").orderBy(*order)
    rows = log.select(*order, "outcome", part.alias("part"))
    rows = rows.withColumn("oks", F.count_if(F.col("outcome") == "ok").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    islands = rows.groupBy("part", "oks").agg(F.count_if(F.col("outcome") == "conn").alias("n"))
    ends = islands.groupBy("part").agg(F.sum(F.when(F.col("oks") == 0, F.col("n")).otherwise(0)).alias("head"), F.max_by("n", "oks").alias("tail"), F.max("oks").alias("oks"))
    inner = islands.join(ends.select("part", F.col("oks").alias("most")), "part").where("oks > 0 and oks < most")
    inside = inner.agg(F.coalesce(F.max("n"), F.lit(0)).alias("m"), F.count_if(F.col("n") >= failures).alias("o"))
    # One short row for each range, in one window.
    chained = ends.withColumn("g", F.sum((F.col("oks") > 0).cast("int")).over(Window.orderBy("part")))
    # Group g: the tail of the range that began it, then whole ranges without an ok, then the next one's head.
    begun = chained.select("g", F.when(F.col("oks") > 0, F.col("tail")).otherwise(F.col("head")).alias("n"))
    ended = chained.where("oks > 0").select((F.col("g") - 1).alias("g"), F.col("head").alias("n"))
    cross = begun.unionByName(ended).groupBy("g").agg(F.sum("n").alias("n"))
    outside = cross.agg(F.coalesce(F.max("n"), F.lit(0)).alias("m"), F.count_if(F.col("n") >= failures).alias("o"))
    return inside.unionByName(outside).agg(F.max("m").cast("long").alias("max_run"), F.sum("o").cast("long").alias("openings"))


def deal(log: DataFrame, order: list[str], rows: int = 100_000) -> DataFrame:
    """The log with `part`, the number of its range of about so many rows in this order, written."""
    parts = max(1, -(-log.count() // rows))
    dealt = log.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    return written(dealt, "log-ranges")


def breaker_state(log: DataFrame, key: list[str], order: list[str], failures: int = BREAKER_FAILURES) -> DataFrame:
    """Adds n_failures and is_open, after each row of a session's log (outcome also probe_ok, probe_failed).

    Connection failures since the last ok or good probe open the breaker; other failures don't count.  An ok
    zeroes the count, but only a good probe closes what is open.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    zero, closes = F.col("outcome").isin("ok", "probe_ok"), F.col("outcome") == "probe_ok"
    rows = log.withColumn("__run", F.count_if(zero).over(so_far)).withColumn("__spell", F.count_if(closes).over(so_far))
    in_run = Window.partitionBy(*key, "__run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("n_failures", F.count_if(F.col("outcome") == "conn").over(in_run))
    in_spell = Window.partitionBy(*key, "__spell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("is_open", F.max(F.col("n_failures") >= failures).over(in_spell)).drop("__run", "__spell")


@dataclass
class Breaker:
    """The breaker of a running session: a few numbers on the driver, fed with counts."""

    failures: int = 0
    is_open: bool = False
    probed_at: float = 0.0

    def seen(self, ok: int, conn: int, now: float) -> None:
        """Results of one step.  Their order isn't known: an ok counts as before the failures."""
        self.failures = conn + (0 if ok else self.failures)
        if self.failures >= BREAKER_FAILURES and not self.is_open:
            self.is_open, self.probed_at = True, now

    def probe_due(self, now: float) -> bool:
        return self.is_open and now - self.probed_at >= PROBE_EVERY

    def probed(self, ok: bool, now: float) -> None:
        self.probed_at = now
        if ok:
            self.is_open, self.failures = False, 0


def both(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """The keys that are in both frames, each once."""
    return a.select(*key).intersect(b.select(*key))


def need_select(log: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """For each camera sample (signature, generation, at) whether to select anew: it moved, data came, or it is old."""
    w = Window.partitionBy(*key).orderBy(*order)
    last = lambda c: F.lag(c).over(w)
    changed = last("signature").isNull() | (last("signature") != F.col("signature")) | (last("generation") != F.col("generation"))
    return log.withColumn("need_select", changed | (F.col("at") - last("at") > SELECT_AGE))


def sweep_unused(blocks: DataFrame, users: DataFrame, key: str) -> DataFrame:
    """Data blocks that nothing uses any more."""
    return blocks.join(users.select(key).distinct(), key, "left_anti")


def requeue_stale(tiles: DataFrame, now: float, older: float = 60.0) -> DataFrame:
    """Decoded tiles (decoded_at) that were not built in time go back to the queue."""
    stale = (F.col("state") == "decoded") & (now - F.col("decoded_at") > older)
    return tiles.withColumn("state", F.when(stale, "queued").otherwise(F.col("state")))


def build_batch(decoded: DataFrame, most: int = 3) -> DataFrame:
    """The decoded tiles to build in one tick, oldest first (one for models, three for terrain)."""
    return decoded.where("state = 'decoded'").orderBy("decoded_at", "z", "x", "y").limit(most)


def after_graft(nodes: DataFrame) -> DataFrame:
    """Grafted nodes that can now be drawn are fetched, with no failures counted; others are done."""
    drawable = (F.coalesce("uri", F.lit("")) != "") & ~is_tileset_uri(F.col("uri"))
    return nodes.withColumn("state", F.when(drawable, "queued").otherwise("built")).withColumn("retries", F.when(drawable, 0).otherwise(F.col("retries")))


def accept(results: DataFrame, generation: int) -> DataFrame:
    """Results of the current generation; late ones are dropped."""
    return results.where(F.col("generation") == generation)


def camera_signature(matrix: Column, width: Column, height: Column) -> Column:
    """Equal for views that agree to nine decimals."""
    return F.xxhash64(F.transform(matrix, lambda v: F.round(v, 9) + F.lit(0.0)), width, height)
