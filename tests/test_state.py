"""Kept tables, snapshots, the growing index and sessions on a stream."""

import time

import pytest
from pyspark.sql import functions as F

from lodestone.operators import retrieve, store
from lodestone.operators.sessions import sessions
from lodestone.streaming import stateful
from lodestone.streaming.index import TermIndex, index_stream
from lodestone.streaming.sessions import expired_sessions


def test_admission_and_backfill(spark):
    new = spark.createDataFrame([(1, "k1", " a ", "<p>the court and the order of the state was for the defendant in this case as it is</p>"), (2, "k9", "b", "x")], "i int, case_id string, name string, text string")
    cases = spark.createDataFrame([("k1",), ("k1",), ("k2",)], "case_id string")
    (row,) = store.admit(new, cases).collect()
    assert row["text"].startswith("the court") and row["lang"] == "en" and row["name"] == "a" and row["detail"].endswith("language: en)")
    assert [r["i"] for r in store.refused(new, cases).collect()] == [2]
    docs = spark.createDataFrame([(1, row["text"], None, None), (2, row["text"], "", None), (3, row["text"], "pl", 0.5)], "i int, text string, lang string, confidence double")
    once = store.backfill_language(docs)
    assert [r["lang"] for r in once.orderBy("i").collect()] == ["en", "en", "pl"]
    assert sorted(once.collect()) == sorted(store.backfill_language(once).collect())


def test_schema_grows_with_defaults(spark, tmp_path):
    kept = store.GrowingTable(spark, f"file://{tmp_path}/t")
    assert kept.migrate([("id", "bigint", None), ("name", "string", None)]) == 1
    kept.append(spark.createDataFrame([(1, "a")], "id long, name string"))
    wider = [("id", "bigint", None), ("name", "string", None), ("level", "int", "3"), ("note", "string", None)]
    assert kept.migrate(wider) == 2 and kept.migrate(wider) == 2
    kept.append(spark.createDataFrame([(2, "b", None)], "id long, name string, level int"))
    kept.append(spark.createDataFrame([(3,)], "id long"))
    assert kept.read().columns == ["id", "name", "level", "note"]
    assert sorted(map(tuple, kept.read().collect()), key=lambda r: r[0]) == [(1, "a", 3, None), (2, "b", None, None), (3, None, 3, None)]
    with pytest.raises(ValueError, match="unknown columns"):
        kept.append(spark.createDataFrame([(1, 2)], "id long, odd int"))
    with pytest.raises(ValueError, match="is int"):
        kept.migrate([("level", "string", None)])


def test_snapshots_restore_and_survive_damage(spark, tmp_path):
    import glob
    import os

    kept = store.Snapshots(spark, f"file://{tmp_path}/s")
    assert kept.live() is None and kept.numbers() == []
    one, two = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), spark.createDataFrame([(1, "z")], "id int, v string")
    assert kept.take({"rows": one}) == 1 and kept.take({"rows": two}) == 2
    kept.restore(1)
    kept.restore(2)
    assert kept.table("rows").count() == 1 and kept.table("rows", back=1).count() == 2
    for part in glob.glob(f"{tmp_path}/s/1/rows/part-*"):
        os.remove(part)
    spark.createDataFrame([(7, "q"), (8, "r")], "id int, v string").write.mode("append").parquet(f"file://{tmp_path}/s/1/rows")  # same count, other rows
    assert [r["same"] for r in kept.verify(1).collect()] == [False]
    with pytest.raises(RuntimeError, match="damaged"):
        kept.restore(1)
    assert kept.live() == 2 and kept.table("rows").first()["v"] == "z"
    for _ in range(3):
        kept.take({"rows": one})
    assert kept.prune(keep=1) == [3, 4] and kept.numbers() == [1, 2, 5]


def test_index_of_a_stream_ranks_like_one_of_all_rows(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs.repartition(3).write.parquet(f"{tmp_path}/docs")
    index = TermIndex(spark, f"file://{tmp_path}/index", "en", buckets=4)
    stream = stateful.read_table_stream(spark, f"{tmp_path}/docs", docs)
    query = index_stream(stream, index, f"{tmp_path}/check")
    query.awaitTermination(180)
    assert query.lastProgress is not None and index.documents().select("batch").distinct().count() == 3
    index.add(docs.where("doc_id < 0"), 99)  # an empty batch
    last = index.documents().agg(F.max("batch")).first()[0]
    asked = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text")
    want = retrieve.top_k(retrieve.bm25(docs, "doc_id", asked, "item_id", "en"), "item_id", "score", 5, "doc_id")
    columns = ("item_id", "doc_id", "rank", "score")
    rows = lambda df: sorted(tuple(r) for r in df.select(*columns).collect())
    expected = rows(want)
    assert rows(index.search(asked, "item_id", 5)) == expected
    again = spark.read.parquet(f"{tmp_path}/docs").join(index.documents().where(F.col("batch") == last), "doc_id").select("doc_id", "text")
    index.add(spark.createDataFrame(again.collect(), "doc_id long, text string"), last)  # delivered once more
    index.add(docs.limit(20), 100)  # known documents
    assert rows(index.search(asked, "item_id", 5)) == expected


def test_sessions_expire_on_a_stream_as_in_batch(spark, sf, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.pmod("user_id", F.lit(3)).alias("login"), F.col("ts").cast("timestamp").alias("at"))
    cuts = [0, *events.selectExpr("unix_timestamp(at) as s").approxQuantile("s", [0.3, 0.7], 0.0), 1 << 40]
    for low, high in zip(cuts, cuts[1:], strict=False):  # the source reads files in the order of their times
        events.where((F.unix_timestamp("at") > low) & (F.unix_timestamp("at") <= high)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
        time.sleep(1.1)
    stream = stateful.read_table_stream(spark, f"{tmp_path}/events", events, 1)
    out = expired_sessions(stream)
    query = out.writeStream.format("memory").queryName("expired").outputMode("append").option("checkpointLocation", f"{tmp_path}/expired").trigger(availableNow=True).start()
    query.awaitTermination(240)
    got = {tuple(r) for r in spark.table("expired").collect()}
    want = {tuple(r) for r in sessions(events.select("login", F.unix_timestamp("at").alias("ts"))).collect()}
    open_still = {max((r for r in want if r[0] == login), key=lambda r: r[1]) for login in range(3)}
    assert got and want - open_still <= got <= want
