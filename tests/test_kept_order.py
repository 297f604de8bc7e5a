import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import ledger, metrics, retrieve
from lodestone.sources import files
from lodestone.streaming import stateful
from lodestone.streaming.progress import Progress, StreamProgress


def test_blocks_of_vectors_equal_one_product(spark):
    rng = np.random.default_rng(3)
    unit = rng.normal(size=(300, 8))
    unit[250:] = unit[:50]  # equal vectors: ties by id
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(unit)] + [(999, None)], "vec_id long, embedding array<double>")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    want = {}
    for q in range(0, 300, 20):
        score = np.round(unit @ unit[q], 6)
        want[q] = [i for i in sorted(range(300), key=lambda i: (-score[i], i)) if i != q][:7]
    for block in (64, 10_000):
        found = retrieve.vector_top_k(vectors, asked, 7, block).collect()
        got = {q: [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q] for q in want}
        assert got == want
    assert retrieve.vector_top_k(vectors, asked.where("false"), 7).count() == 0


def test_percentiles_by_index(spark):
    rows = spark.createDataFrame([("a", float(x)) for x in (3, 1, 2, 2, 9)] + [("a", None), ("b", None), (None, 4.0)], "lang string, s double")
    got = {r["lang"]: tuple(r)[1:] for r in metrics.index_percentiles(rows, "lang", F.col("s"), {"p50": 0.5, "p90": 0.9}).collect()}
    assert got == {"a": (2.0, 9.0, 9.0), "b": (0.0, 0.0, None), None: (4.0, 4.0, 4.0)}


def test_newest_rows_of_a_whole_table(spark):
    rows = spark.range(100).withColumn("k", F.col("id") % 3)
    assert sorted(r["id"] for r in ledger.keep_newest(rows, None, "id", 4).collect()) == [96, 97, 98, 99]
    assert "Window" not in ledger.keep_newest(rows, None, "id", 4)._jdf.queryExecution().toString()


def test_chain_goes_on_over_batches_and_replays(spark, tmp_path):
    entries = spark.createDataFrame([(i, f"t{i}", "c", "op", f"d{i}") for i in range(9)], "id long, ts string, case_id string, op string, detail string")
    write = stateful.append_chain(spark, f"{tmp_path}/log")
    write(entries.where("id < 3"), 0)
    write(entries.where("false"), 1)
    write(entries.where("id between 3 and 6"), 2)
    write(entries.where("id between 3 and 6"), 2)  # delivered again
    write(entries.where("id > 6"), 3)
    stored = spark.read.parquet(f"{tmp_path}/log/entries").withColumn("chain", F.lit(0))
    assert sorted(r["id"] for r in stored.collect()) == list(range(9))
    assert [r["first_broken"] for r in ledger.verify_chain(stored).collect()] == [None]


def _pdf(images: int) -> bytes:
    pixels = zlib.compress(b"\x00\x7f\xff\x10")
    body = b"%PDF-1.4\n1 0 obj << /Type /Page >> endobj\n"
    for n in range(images):
        body += b"%d 0 obj << /Subtype /Image /Width 2 /Height 3 /Filter /DCTDecode >> stream\n\xff\xd8page%d\xff\xd9\nendstream endobj\n" % (n + 2, n)
    return body + b"900 0 obj << /Subtype /Image /Width 2 /Height 2 /Filter /FlateDecode >> stream\n" + pixels + b"\nendstream endobj\n%%EOF"


def test_images_leave_a_pdf_and_their_text_comes_back(spark):
    rows = [("/a/scan.pdf", _pdf(2)), ("/a/many.PDF", _pdf(45)), ("/a/locked.pdf", b"%PDF /Encrypt 1 0 R"), ("/a/note.txt", b"A plain note. " * 20), ("/a/big.pdf", None)]
    raw = spark.createDataFrame(rows, "path string, content binary")
    found = files.images_for_ocr(raw).collect()
    scan = sorted((r for r in found if r["path"] == "/a/scan.pdf"), key=lambda r: r["place"])
    assert [(r["kind"], r["width"], r["height"], bytes(r["image"])) for r in scan] == [
        ("jpeg", 2, 3, b"\xff\xd8page0\xff\xd9"), ("jpeg", 2, 3, b"\xff\xd8page1\xff\xd9"), ("raw", 2, 2, b"\x00\x7f\xff\x10"),
    ]
    many = [r for r in found if r["path"] == "/a/many.PDF"]
    assert sum(r["image"] is not None for r in many) == 40 and [r["error"] for r in many if r["error"]] == ["6 images over the limit of 40"]
    assert {r["path"]: r["error"] for r in found if r["error"]}["/a/locked.pdf"] == "encrypted PDF"
    loaded = files.load_files(raw)
    assert {r["path"]: r["error"] for r in loaded.collect()}["/a/big.pdf"] == "file over 40 MB"
    read = spark.createDataFrame([("/a/scan.pdf", 1, "second page"), ("/a/scan.pdf", 0, "first page"), ("/a/note.txt", 0, "x"), ("/a/many.PDF", 0, " ")], "path string, place int, text string")
    after = {r["path"]: r for r in files.with_recognised(loaded, read).collect()}
    assert after["/a/scan.pdf"]["text"] == "first page\n\nsecond page" and not after["/a/scan.pdf"]["needs_ocr"]
    assert after["/a/many.PDF"]["needs_ocr"] and after["/a/note.txt"]["text"].startswith("A plain note.")
    assert files.with_recognised(loaded, read).columns == loaded.columns


def test_progress_of_jobs_and_streams(spark, sf, tmp_path):
    progress = Progress(spark, f"{tmp_path}/progress")
    with progress.stage("load", "files", 0, 2):
        spark.range(3).count()
    with pytest.raises(ValueError), progress.stage("load", "index", 1, 2):
        raise ValueError("broken")
    with progress.stage("other", "all", 0, 1):
        pass
    got = {r["job"]: (r["stage"], r["done"], r["total"], r["state"]) for r in progress.newest().collect()}
    assert got == {"load": ("index", 1, 2, "failed"), "other": ("all", 1, 1, "finished")}
    assert [r["job"] for r in progress.newest(1).collect()] == ["other"]
    listener = StreamProgress(progress)
    spark.streams.addListener(listener)
    try:
        events = spark.read.parquet(f"{sf}/events.parquet")
        events.write.parquet(f"{tmp_path}/events")
        stream = stateful.read_table_stream(spark, f"{tmp_path}/events", events, 100)
        run = stream.writeStream.format("noop").queryName("copy").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        assert run.awaitTermination(120)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    assert listener.rows and sum(listener.rows.values()) == events.count()
    assert {r["job"]: r["state"] for r in progress.newest().collect()}["copy"] == "finished"


def test_summary_keeps_refusals_and_misses_apart(spark):
    rows = [(True, True, "answer", True, 2), (True, False, "answer", True, 0), (True, False, "vote", False, 1), (False, False, "answer", True, 0), (False, False, "retrieval", False, 0)]
    cases = spark.createDataFrame(rows, "answerable boolean, hit boolean, stage string, reached boolean, occurrences long")
    assert metrics.summary(cases).first().asDict() == {
        "cases": 5, "correct": 2, "hit_rate": 0.333333, "j3_right_refusal": 0.5, "uncovered": 2, "false_answers": 1, "false_refusals": 1,
        "wrong_answers": 1, "retrieval_recall": 0.666667, "mean_occurrences": 1.0, "without_occurrences": 1,
    }
    assert {tuple(r) for r in metrics.stage_histograms(cases).collect()} == {
        ("all", "answer", 3), ("all", "vote", 1), ("all", "retrieval", 1), ("false_refusals", "vote", 1)
    }
    none = metrics.summary(cases.where("false")).first()
    assert none["cases"] == 0 and none["hit_rate"] == 0 and none["mean_occurrences"] == 0
    missed = spark.createDataFrame([(True, ["b", "a"]), (True, ["b"]), (False, ["c"]), (True, [])], "harmful boolean, missing array<string>")
    assert [tuple(r) for r in metrics.harmful_anchors(missed).collect()] == [("b", 2), ("a", 1)]


def test_exports_and_snapshots(spark, tmp_path):
    from lodestone.sources import export

    questions = spark.createDataFrame([(1, "Who <signed>?"), (2, "When?")], "question_id int, question string")
    findings = spark.createDataFrame([(1, 2, "B", 7, 5, 9, "x & y"), (1, 1, " A ", 7, 0, 4, "told")], "question_id int, number int, text string, doc_id int, start int, `end` int, quoted string")
    rejected = spark.createDataFrame([(1, 3, "C", "vote")], "question_id int, number int, text string, reason string")
    pages = {r["question_id"]: r["document"] for r in export.to_markdown(questions, findings, rejected).collect()}
    assert pages[1].index("**1.** A") < pages[1].index("> told") < pages[1].index("**2.** B") < pages[1].index("- C (vote)") and "characters 5–9" in pages[1]
    assert "None: the documents do not answer this." in pages[2] and "Rejected" not in pages[2]
    pages = {r["question_id"]: r["document"] for r in export.to_html(questions, findings, rejected).collect()}
    assert "Who &lt;signed&gt;?" in pages[1] and "x &amp; y" in pages[1] and "<signed>" not in pages[1]

    tables = {"q": questions, "f": findings}
    ledger.write_snapshot(tables, f"{tmp_path}/snap")
    assert all(r["same"] for r in ledger.compare_snapshot(spark, tables, f"{tmp_path}/snap").collect())
    less = {"q": questions.limit(1), "f": findings}
    assert {r["table"]: (r["expected"], r["found"], r["same"]) for r in ledger.compare_snapshot(spark, less, f"{tmp_path}/snap").collect()} == {"q": (1, 2, False), "f": (2, 2, True)}
