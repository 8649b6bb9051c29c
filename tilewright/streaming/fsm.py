"""The life cycle of a tile as a state machine: replayed over a log, or kept by a stream.

Short form: queued -> built on ok; -> failed with back-off, at the fourth failure dead, on http or conn; -> dead
on dead.  Full form, with fetching, decoding, building, eviction, grafts and late results: lifecycle.after().
A dead tile stays dead; failures count for good, but where a graft sets them back.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from tilewright.operators.lifecycle import BACK, BACKOFF, FAILURES, after, lru_victims

OUTPUT = StructType([StructField("tile", LongType()), StructField("seq", LongType()), StructField("state", StringType()), StructField("retries", IntegerType()), StructField("next_retry", DoubleType())])
STATE = StructType([StructField("state", StringType()), StructField("retries", IntegerType()), StructField("next_retry", DoubleType())])


def step(state: str, retries: int, next_retry: float, outcome: str, at: float) -> tuple[str, int, float]:
    """What an outcome makes of a tile whose fetching, decoding and building are one (ok: built)."""
    return step_full(state, retries, next_retry, "built" if outcome == "ok" else outcome, at)


def step_full(state: str, retries: int, next_retry: float, outcome: str, at: float) -> tuple[str, int, float]:
    """What an outcome makes of a tile: as lifecycle.after(), for a stream."""
    if state == "dead":
        return state, retries, next_retry
    if outcome in FAILURES:
        retries += 1
        return ("dead", retries, next_retry) if retries > len(BACKOFF) else ("failed", retries, at + BACKOFF[retries - 1])
    if outcome in BACK:
        return "queued", 0 if outcome == "graft_drawable" else retries, next_retry
    return {"fetch": "fetching", "ok": "decoded", "built": "built", "graft_done": "built", "dead": "dead"}.get(outcome, state), retries, next_retry


def replay(log: DataFrame) -> DataFrame:
    """(tile, state, retries, next_retry) after a log (tile, seq, outcome, at).

    The machine is closed-form: failures are counted by a running sum, the first death cuts the log, and
    the last row before it decides; so a tile's log is a window, not a Python loop.
    """
    w = Window.partitionBy("tile").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    bad = F.col("outcome").isin("http", "conn")
    rows = log.withColumn("retries", F.sum(bad.cast("int")).over(w))
    ends = (F.col("outcome") == "dead") | (bad & (F.col("retries") > len(BACKOFF)))
    rows = rows.withColumn("deaths", F.sum(ends.cast("int")).over(w)).where((F.col("deaths") == 0) | ((F.col("deaths") == 1) & ends))
    state = F.when(F.col("deaths") > 0, "dead").when(F.col("outcome") == "ok", "built").otherwise("failed")
    live = bad & (F.col("retries") <= len(BACKOFF))
    due = F.when(live, F.col("at") + F.element_at(F.array(*map(F.lit, BACKOFF)), F.greatest(F.least("retries", F.lit(len(BACKOFF))), F.lit(1)).cast("int")))
    return rows.withColumn("state", state).withColumn("due", due).groupBy("tile").agg(F.max_by("state", "seq").alias("state"), F.max("retries").cast("int").alias("retries"), F.coalesce(F.max_by("due", F.when(F.col("due").isNotNull(), F.col("seq"))), F.lit(0.0)).alias("next_retry"))


def replay_full(log: DataFrame) -> DataFrame:
    """(tile, state, retries, next_retry) after a log of all outcomes (tile, seq, outcome, at).

    Closed-form like replay(): failures are counted since the last graft that set them back, the first death
    cuts the log, and the last row that changes anything decides.
    """
    w = Window.partitionBy("tile").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    bad, known = F.col("outcome").isin(*FAILURES), ["fetch", "ok", "built", "graft_done", "dead", *FAILURES, *BACK]
    rows = log.where(F.col("outcome").isin(*known)).withColumn("spell", F.count_if(F.col("outcome") == "graft_drawable").over(w))
    counted = Window.partitionBy("tile", "spell").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("retries", F.count_if(bad).over(counted).cast("int"))
    ends = (F.col("outcome") == "dead") | (bad & (F.col("retries") > len(BACKOFF)))
    rows = rows.withColumn("deaths", F.count_if(ends).over(w)).where((F.col("deaths") == 0) | ((F.col("deaths") == 1) & ends))
    # What the row before was doesn't matter, once the dead are out and failures are counted.
    state, _, due = after(F.lit("queued"), F.col("retries") - bad.cast("int"), F.lit(None).cast("double"), F.col("outcome"), F.col("at"))
    rows = rows.withColumn("state", state).withColumn("due", due)
    last = F.max_by("due", F.when(F.col("due").isNotNull(), F.col("seq")))
    return rows.groupBy("tile").agg(F.max_by("state", "seq").alias("state"), F.max_by("retries", "seq").alias("retries"), F.coalesce(last, F.lit(0.0)).alias("next_retry"))


def _advance(machine):
    def run(key: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        state, retries, due = kept.get if kept.exists else ("queued", 0, 0.0)
        for batch in batches:
            rows = []
            for seq, outcome, at in batch.sort_values("seq")[["seq", "outcome", "at"]].itertuples(index=False):
                state, retries, due = machine(state, retries, due, outcome, at)
                rows.append((key[0], seq, state, retries, due))
            yield pd.DataFrame(rows, columns=OUTPUT.names)
        kept.update((state, retries, due))

    return run


def stream(log: DataFrame, machine=step) -> DataFrame:
    """The same over a stream: a row for each event with the state it leads to; state is a few bytes a tile."""
    return log.groupBy("tile").applyInPandasWithState(_advance(machine), OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


#: Seconds between two steps of a session: (busy, idle) for terrain and for nodes.
STEPS = {"terrain": (0.05, 0.1), "nodes": (0.05, 0.15)}


def trigger(kind: str = "terrain", busy: bool = True) -> dict[str, str]:
    """The trigger of a session's stream, for writeStream.trigger(**trigger(...))."""
    return {"processingTime": f"{round(1000 * STEPS[kind][0 if busy else 1])} milliseconds"}


def stream_counts(log: DataFrame, late: str = "10 seconds", every: str = "5 seconds") -> DataFrame:
    """Outcomes of a stream of requests (ts, outcome) in windows of event time; later rows than the watermark go."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", every), "outcome").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "outcome", "n")


def evict_in_batches(path_of_tiles: str, budget: int, cap: int, every: float = 2.0):
    """A foreachBatch function: the least recently wanted tiles beyond the budget of a micro-batch's snapshot.

    At most once in `every` seconds of the tiles' own time; tiles wanted in the last ten are left alone.
    """
    done_at = [float("-inf")]

    def run(batch: DataFrame, epoch: int) -> None:
        now = batch.agg(F.max("last_wanted")).first()[0] or 0.0
        if now - done_at[0] < every:
            return
        done_at[0] = now
        none = batch.select("z", "x", "y").limit(0)
        lru_victims(batch, none, ["z", "x", "y"], budget, now, 10.0, cap).withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(path_of_tiles)

    return run
