from pyspark.sql import functions as F

from lodestone.operators import ledger
from lodestone.streaming import stateful


def drain(stream, name, mode, tmp_path):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_streams_agree_with_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartitionByRange(2, "ts").sortWithinPartitions("ts").write.parquet(f"{tmp_path}/events")
    stream = stateful.read_table_stream(spark, f"{tmp_path}/events", events, 10)
    got = drain(stateful.journal_windows(stream), "journal", "complete", tmp_path).collect()
    want = stateful.journal_windows(events).collect()
    assert sorted((r["start"], r["queries"], r["errors"]) for r in got) == sorted((r["start"], r["queries"], r["errors"]) for r in want)

    attempts = lambda e: e.select(F.pmod("user_id", F.lit(5)).alias("login"), F.unix_timestamp("ts").alias("ts"), (F.col("event_type") == "purchase").alias("ok"))
    got = drain(stateful.throttle(attempts(stream)), "throttle", "append", tmp_path)
    want = ledger.lockouts(attempts(events))
    assert got.groupBy("outcome").count().orderBy("outcome").collect() == want.groupBy("outcome").count().orderBy("outcome").collect()
