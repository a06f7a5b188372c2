import datetime as dt

from pyspark.sql import functions as F

from corpusloom.streaming import windows as W


def rows(spark, folder):
    base = dt.datetime(2024, 1, 1)
    data = [(base + dt.timedelta(minutes=7 * i), i % 3, float(i)) for i in range(60)]
    spark.createDataFrame(data, "ts timestamp, k int, value double").repartition(3).write.parquet(folder)
    return spark.read.parquet(folder)


def drained(spark, frame, name, mode="complete"):
    frame.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def test_streams_equal_tables(spark, tmp_path):
    table = rows(spark, f"{tmp_path}/e")
    stream = lambda: W.read_events(spark, f"{tmp_path}/e", "ts timestamp, k int, value double", 1)
    for name, f in (("a", lambda d: W.tumbling(d, "1 hour", ["k"], "30 days")), ("b", lambda d: W.sliding(d, "1 hour", "20 minutes", ["k"], "30 days")), ("c", lambda d: W.sessions(d, "15 minutes", ["k"], "30 days"))):
        assert sorted(map(str, drained(spark, f(stream()), f"w_{name}").collect())) == sorted(map(str, f(table).collect()))


def test_upserts_and_state(spark, tmp_path):
    spark.createDataFrame([(1, 0, "a"), (1, 2, "c"), (2, 0, "x"), (1, 1, "b")], "dialogue_id long, turn long, utterance string").coalesce(1).write.parquet(f"{tmp_path}/t")
    schema = "dialogue_id long, turn long, utterance string"
    state = drained(spark, W.running_dialogues(spark.readStream.schema(schema).parquet(f"{tmp_path}/t")), "dialogues", "update")
    assert {(r.dialogue_id, r.turns, r.last_utterance) for r in state.collect()} == {(1, 3, "c"), (2, 1, "x")}
    got = []
    W.upsert_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/t"), lambda d: d.where(F.col("turn") > 0), lambda d: got.extend(d.collect()), f"{tmp_path}/c").awaitTermination()
    assert len(got) == 2
    days = spark.createDataFrame([("A", dt.datetime(2024, 1, 1)), ("A", dt.datetime(2024, 1, 1)), ("B", dt.datetime(2024, 1, 2))], "name string, edited timestamp")
    days.write.parquet(f"{tmp_path}/d")
    once = W.changed_only(spark.readStream.schema("name string, edited timestamp").parquet(f"{tmp_path}/d"), "name", "edited")
    assert drained(spark, once, "changed", "append").count() == 2
