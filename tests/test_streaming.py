from oracle import SMALL
from marlstone.streaming import events


def test_stream_equals_batch(spark, tmp_path):
    table = spark.read.parquet(f"{SMALL}/events.parquet")
    source = str(tmp_path / "in")
    table.orderBy("ts").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(table.schema).parquet(source)
    query = events.run_available(events.tumbling(stream, "1 day"), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {tuple(r) for r in events.tumbling(table, "1 day").collect()}
    assert got and got <= want
    last = max(w[0] for w in want)
    assert {w for w in want if w[0] < last} <= got


def test_upsert_keeps_the_newest(spark):
    held = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "k long, t long, v string")
    new = spark.createDataFrame([(1, 2, "c"), (2, 4, "d"), (3, 1, "e")], "k long, t long, v string")
    assert {tuple(r) for r in events.upsert(new, held, "k", "t").collect()} == {(1, 2, "c"), (2, 5, "b"), (3, 1, "e")}
