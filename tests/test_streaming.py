"""Streams over a folder of Parquet files, one file a batch, and results written by batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from sylvatica.operators import trials
from sylvatica.sources import readers, sinks
from sylvatica.streaming import telemetry

EVENTS = "session string, event_id long, at timestamp, payload string"
RESULTS = "id long, answer string, trial_id string"


def put(spark, path, part, rows, schema=EVENTS):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(path / part))


def run(spark, tmp_path, keep, name):
    stream = spark.readStream.schema(EVENTS).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    last = telemetry.last_events(stream, payload=["at", "payload"], keep=keep)
    out = str(tmp_path / "out")

    def write(batch, number):
        sinks.append_results(batch.withColumn("half", F.lit("all")), out, str(number), "half")

    query = telemetry.started(spark, lambda: last.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    query.awaitTermination(180)
    assert query.exception() is None
    return telemetry.newest_states(readers.read_results(spark, out, f"{EVENTS}, half string")).orderBy("session", "event_id")


def test_last_events_over_a_restart(spark, tmp_path):
    import datetime

    stamp = lambda n: datetime.datetime(2024, 1, 1, 0, n)
    before = spark.conf.get(telemetry.STATE_STORE[0], None)
    for n in range(2):
        put(spark, tmp_path / "in", f"part{n}", [("a", 10 * n + i, stamp(n), f"a{10 * n + i}") for i in range(4)] + [("b", n, stamp(n), None)])
    assert [r.event_id for r in run(spark, tmp_path, 5, "x").collect() if r.session == "a"] == [3, 10, 11, 12, 13]
    put(spark, tmp_path / "in", "part2", [("a", 20 + i, stamp(2), f"a{20 + i}") for i in range(3)] + [("a", 13, None, None), ("c", None, None, None), ("c", None, stamp(1), "x")])
    rows = run(spark, tmp_path, 5, "y").collect()
    assert [r.event_id for r in rows if r.session == "a"] == [13, 13, 20, 21, 22]
    assert [(r.event_id, r.at, r.payload) for r in rows if r.session == "b"] == [(0, stamp(0), None), (1, stamp(1), None)]
    assert sorted(str(r.payload) for r in rows if r.session == "c") == ["None", "x"]
    assert {r.at for r in rows if r.session == "a" and r.event_id > 13} == {stamp(2)}  # an event's own stamp
    assert spark.conf.get(telemetry.STATE_STORE[0], None) == before


def test_resumed_stream_has_each_result_once(spark, tmp_path):
    out = str(tmp_path / "out")
    sinks.append_results(spark.createDataFrame([(1, "done", "t"), (7, "other", "u")], RESULTS), out, "earlier")
    put(spark, tmp_path / "in", "part0", [(1, "t"), (2, "t"), (2, "t"), (3, "t")], "id long, trial_id string")
    seen = []

    def work(batch):
        seen.append(sorted(r.id for r in batch.collect()))
        return batch.withColumn("answer", F.lit("new"))

    def resume(checkpoint):
        tasks = spark.readStream.schema("id long, trial_id string").option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        telemetry.resume_stream(tasks, out, RESULTS, work, ["id"], str(tmp_path / checkpoint)).awaitTermination(120)
        return sorted((r.id, r.answer) for r in readers.read_results(spark, out, RESULTS).collect())

    expected = [(1, "done"), (2, "new"), (3, "new"), (7, "other")]
    assert resume("cp") == expected and seen == [[2, 3]]
    numbers = [str(p.name) for p in (tmp_path / "out").iterdir() if p.name.startswith("batch=")]
    assert len(numbers) == 2 and all("None" not in n for n in numbers)
    assert resume("lost") == expected and seen == [[2, 3], []]  # another query's batches count as done
    for committed in (tmp_path / "cp" / "commits").glob("*0*"):  # as if the first query had ended before it told of its batch
        committed.unlink()
    assert resume("cp") == expected and seen == [[2, 3], [], [2, 3]]  # worked off again, it replaces itself
    put(spark, tmp_path / "in", "part1", [(3, "t"), (4, "t")], "id long, trial_id string")
    assert resume("cp") == [*expected[:3], (4, "new"), expected[3]] and seen[-1] == [4]


def test_a_batch_written_again_replaces_itself(spark, tmp_path):
    out = str(tmp_path / "out")
    for rows in ([(1, "a", "t"), (2, "b", "u")], [(1, "c", "t")]):
        sinks.append_results(spark.createDataFrame(rows, RESULTS), out, "b1")
    sinks.append_results(spark.createDataFrame([(2, "d", "u")], RESULTS), out, "b2")
    results = readers.read_results(spark, out, RESULTS)
    assert sorted(map(tuple, results.select("id", "answer", "trial_id", "batch").collect())) == [(1, "c", "t", "b1"), (2, "d", "u", "b2")]
    own = readers.results_of(results, spark.createDataFrame([("u",)], "trial_id string"))
    assert [r.id for r in own.collect()] == [2] and "PartitionFilters: [isnotnull(trial_id" in own._jdf.queryExecution().toString()
    assert readers.read_results(spark, str(tmp_path / "none"), RESULTS).count() == 0


def test_results_of_two_schemas_are_read_as_one(spark, tmp_path):
    out = str(tmp_path / "out")
    newest = f"{RESULTS}, committed boolean"
    sinks.append_results(spark.createDataFrame([(1, "a", "t")], RESULTS), out, "old")
    sinks.append_results(spark.createDataFrame([(2, "b", "t", True)], newest), out, "new")
    both = readers.read_results(spark, out, newest)
    assert sorted((r.id, r.committed) for r in both.collect()) == [(1, None), (2, True)]
    assert trials.remaining(spark.createDataFrame([(1,), (3,)], "id long"), both, ["id"]).collect()[0].id == 3
