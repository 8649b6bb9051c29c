import random

from pyspark.sql import functions as F

from tilewright.operators import lifecycle
from tilewright.streaming import fsm


def _log(spark):
    kinds = ["http", "conn", "ok", "http", "http", "ok", "dead", "ok"]
    rows = [(t, i, kinds[(i * 3 + t) % 8], float(i)) for t in range(6) for i in range(t * 3)]
    return spark.createDataFrame(rows, "tile long, seq long, outcome string, at double"), rows


def _by_hand(rows):
    out = {}
    for tile, _, outcome, at in sorted(rows):
        out[tile] = fsm.step(*out.get(tile, ("queued", 0, 0.0)), outcome, at)
    return out


def test_replay_is_the_machine(spark):
    log, rows = _log(spark)
    got = {r["tile"]: (r["state"], r["retries"], r["next_retry"]) for r in fsm.replay(log).collect()}
    assert got == _by_hand(rows)


def test_stream_is_the_machine(spark, tmp_path):
    log, rows = _log(spark)
    log.where("seq < 7").repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
    q = fsm.stream(stream).writeStream.format("memory").queryName("fsm_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    log.where("seq >= 7").write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    q.stop()
    last = spark.table("fsm_out").groupBy("tile").agg(F.max_by(F.struct("state", "retries", "next_retry"), "seq").alias("s")).select("tile", "s.*").collect()
    assert {r["tile"]: (r["state"], r["retries"], r["next_retry"]) for r in last} == _by_hand(rows)


def test_eviction_batches_and_counts(spark, tmp_path):
    tiles = spark.createDataFrame([(5, i, 0, "built", False, float(i)) for i in range(40)], "z int, x long, y long, state string, visible boolean, last_wanted double")
    fsm.evict_in_batches(str(tmp_path / "gone"), budget=30, cap=24)(tiles, 3)
    got = spark.read.parquet(str(tmp_path / "gone")).orderBy("x").collect()
    assert [r["x"] for r in got] == list(range(10)) and got[0]["epoch"] == 3
    log = spark.createDataFrame([("2024-01-01 00:00:01", "ok"), ("2024-01-01 00:00:02", "ok"), ("2024-01-01 00:00:07", "conn")], "t string, outcome string").select(F.to_timestamp("t").alias("ts"), "outcome")
    assert sorted((r["outcome"], r["n"]) for r in fsm.stream_counts(log).collect()) == [("conn", 1), ("ok", 2)]


OUTCOMES = ["fetch", "ok", "built", "dead", "graft_done", "nothing", *lifecycle.FAILURES, *lifecycle.BACK]


def test_full_machine_replayed_is_the_machine_stepped(spark):
    rng = random.Random(7)
    rows = [(tile, seq, rng.choice(OUTCOMES if tile % 3 else OUTCOMES[6:]), float(seq) / 2) for tile in range(60) for seq in range(rng.randint(1, 14))]
    want = {}
    for tile, _, outcome, at in rows:
        want[tile] = fsm.step_full(*want.get(tile, ("queued", 0, 0.0)), outcome, at)
    log = spark.createDataFrame(rows, "tile long, seq long, outcome string, at double")
    got = {r["tile"]: (r["state"], r["retries"], r["next_retry"]) for r in fsm.replay_full(log).collect()}
    # A tile of which nothing is known but "nothing" has no row.
    known = {t for t, _, o, _ in rows if o != "nothing"}
    assert got == {t: s for t, s in want.items() if t in known}


def test_states_after_outcomes_as_columns(spark):
    rows = [(state, tries, outcome) for state in ("queued", "fetching", "built", "dead") for tries in (0, 3) for outcome in (*OUTCOMES, None)]
    df = spark.createDataFrame(rows, "state string, tries int, outcome string")
    state, tries, due = lifecycle.after(F.col("state"), F.col("tries"), F.lit(0.5), F.col("outcome"), F.lit(10.0))
    got = [tuple(r) for r in df.select(state, tries, due).collect()]
    assert got == [fsm.step_full(s, t, 0.5, o, 10.0) if o else (s, t, 0.5) for s, t, o in rows]


def test_triggers():
    assert fsm.trigger("terrain") == fsm.trigger("nodes") == {"processingTime": "50 milliseconds"}
    assert fsm.trigger("terrain", busy=False) == {"processingTime": "100 milliseconds"} and fsm.trigger("nodes", busy=False) == {"processingTime": "150 milliseconds"}


def test_eviction_keeps_its_cadence(spark, tmp_path):
    rows = [(3, i, 0, "built", False, float(i)) for i in range(40)]
    tiles = spark.createDataFrame(rows, "z int, x long, y long, state string, visible boolean, last_wanted double")
    evict = fsm.evict_in_batches(f"file://{tmp_path}/gone", budget=35, cap=24)
    for epoch, newest in enumerate((30, 31, 39)):
        evict(tiles.where(F.col("last_wanted") <= newest), epoch)
    gone = spark.read.parquet(f"file://{tmp_path}/gone").collect()
    assert {r["epoch"] for r in gone} == {2} and sorted(r["x"] for r in gone) == [0, 1, 2, 3, 4]
