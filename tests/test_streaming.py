from listingloom.operators import resolve
from listingloom.streaming.finalize import finalize_batches

FIELDS = "n long, id string, url string, title string, start string, host string, raw_keys array<string>"


def test_runs_arrive_as_micro_batches(spark, tmp_path):
    rows = [(1, "a", "https://v.org/jazz-night", "Jazz Night", "2026-08-01T20:00:00-04:00", "Anna", []), (2, "b", "https://x.org/other-place", "Jazz Night", "2026-08-01T20:10:00-04:00", "Anna", [])]
    spark.createDataFrame(rows[:1], FIELDS).write.parquet(f"{tmp_path}/in/run=1")
    spark.createDataFrame(rows[1:], FIELDS).write.parquet(f"{tmp_path}/in/run=2")
    store = {"events": resolve.prepared(spark.createDataFrame([], FIELDS)).drop("n", "raw_keys"), "aliases": spark.createDataFrame([], "event_id string, canonical_url string, url string, source_id string, first_seen string, last_seen string")}
    outcomes = []

    def write(events, aliases, result, epoch):
        for name, table in (("events", events), ("aliases", aliases)):
            table.write.parquet(f"{tmp_path}/{name}-{epoch}")
            store[name] = spark.read.parquet(f"{tmp_path}/{name}-{epoch}")
        outcomes.append([r.outcome for r in result.collect()])

    run = finalize_batches(lambda: (store["events"], store["aliases"]), write, lambda epoch: f"2026-08-0{epoch + 1}")
    stream = spark.readStream.schema(FIELDS + ", run int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").drop("run")
    query = stream.writeStream.foreachBatch(run).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/check").start()
    query.awaitTermination(200)
    assert [o for o in outcomes if o] == [["new"], ["updated"]] and store["events"].count() == 1
    assert store["aliases"].count() == 2
