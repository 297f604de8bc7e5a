"""Pieces the corpus operators share: scratch tables, text normal forms, hashes."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_OWN_DIRS: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where the setting is absent a temporary folder is made, but only for a local master: on a cluster
    the executors could not see it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lodestone-')}"
        spark.conf.set("spark.checkpoint.dir", found)
        if not _OWN_DIRS:
            atexit.register(_clear)
        _OWN_DIRS.append((spark, found.removeprefix("file://")))
    return found.rstrip("/")


def _clear() -> None:
    import shutil

    for _, path in _OWN_DIRS:
        shutil.rmtree(path, ignore_errors=True)


def scratch(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone-scratch/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files behind a scratch table that no later plan reads."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        if "/lodestone-scratch/" in f:
            path = jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(conf).delete(path, True)


#: Bits of the table of probable keys: 4 MB, however many keys there are.
TABLE_BITS = 1 << 25


def probable_rows(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``key`` (a long) is not in ``keys``: it spares a join their shuffle.

    The keys' places in a bit table of fixed size are broadcast (at most TABLE_BITS / 64 rows of 16 bytes, a proven
    bound); rows at other places go. As the table fills up with many keys it only spares less.
    """
    word, mask = unused("table_word", rows), unused("table_mask", rows)
    place = F.pmod(F.xxhash64(key), F.lit(TABLE_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))
    table = keys.select(F.floor(place / 64).alias(word), bit.alias(mask)).groupBy(word).agg(F.bit_or(mask).alias(mask))
    near = rows.withColumn(word, F.floor(place / 64)).join(F.broadcast(table), word).where(F.col(mask).bitwiseAND(bit) != 0)
    return near.select(*[rows[c] for c in rows.columns])


#: Bytes of text that a Python worker turns into objects at once; a longer text comes alone.
TEXT_BYTES = 4 << 20


def by_bytes(batch: pa.RecordBatch, column: str | int, most: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of at most ``most`` bytes of ``column``; a longer value is a slice of its own."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        done = int(size[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(size, done + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def text_or_empty(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all other characters as they are."""
    return F.translate(text, UPPER, LOWER)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def held_out(doc_id: Column) -> Column:
    """The fifth of the documents that models never learn labels from; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def unused(name: str, df: DataFrame) -> str:
    """``name``, lengthened until no column of ``df`` has it (names differ beyond letter case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
