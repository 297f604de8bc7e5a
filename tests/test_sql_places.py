"""Places of passages against the SQL of their queries, where texts hold the words in other spellings too."""

import duckdb
import pytest

from lodestone import registry

WORDS = "the court of the plaintiff heard it"
DOCS = [
    (1, "The  Court of the\nplaintiff HEARD it."), (2, f"So {WORDS.upper()} and {WORDS}; {WORDS}."), (3, f"x {WORDS}"), (4, None), (5, ""),
    (6, "he said „words” – that is all ΟΔΟΣ"), (7, 'he said "words" - that is all οδοσ'), (8, "a b c"), (9, "section  THE clerk of it"), (10, "section the clerk of it"),
    (11, " edge "), (12, "first İstanbul then"), (13, "SECTION edge  "), (14, f"Section {WORDS} {WORDS}"),
]
ITEMS = [
    (0, WORDS), (4, 'said "words" - that'), (8, "a b"), (12, " edge "), (16, "no such words at all"), (20, None), (24, ""), (28, "İstanbul"),
    (1, WORDS), (2, WORDS), (3, "the clerk of it"), (7, WORDS), (11, ""), (32, "ΟΔΟΣ"),
]


@pytest.mark.parametrize("name", ["passage_locate", "statute_match"])
def test_places_equal_the_sql_where_spellings_differ(spark, tmp_path, name):
    spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    found = registry.queries()[name](spark, str(tmp_path))
    result = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(repr(tuple(r[c] for c in names)) for r in found.collect()) == sorted(map(repr, result.fetchall()))


def test_shared_dates_take_little_room_in_files(spark, tmp_path):
    """All pairs of one day's orders: the rows come in an order that files store in a fraction of a byte each."""
    n = 6000
    orders = spark.range(n).selectExpr("id AS o_orderkey", "DATE'1995-03-20' AS o_orderdate", "CAST(100 + id AS double) AS o_totalprice")
    orders.coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    found = registry.queries()["anchor_overlap"](spark, str(tmp_path))
    found.write.parquet(f"{tmp_path}/out")
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == n // 20 * (n - 1) and out.distinct().count() == out.count()
    assert out.where("asked % 20 <> 0 OR asked = found OR value <> '1995-03-20'").isEmpty()
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 0.25 * n // 20 * (n - 1)
