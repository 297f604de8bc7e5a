"""The kept tables: admission of documents, language back-fill, additive schema changes, snapshots that can be restored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import text as txt


def admit(documents: DataFrame, cases: DataFrame) -> DataFrame:
    """``documents`` (case_id, name, text, ...) whose case exists, ready to be appended.

    Texts are composed and cleaned before they are stored, since citations are offsets into what is stored; the language
    is recognised once. Adds lang, confidence and the ``detail`` of the audit entry. The others are ``refused``.
    """
    known = documents.join(cases.select("case_id").distinct(), "case_id", "left_semi")
    stored = known.withColumn("text", txt.clean_html(txt.nfc(F.col("text")))).withColumn("found", txt.language(F.col("text")))
    stored = stored.withColumn("lang", F.col("found.lang")).withColumn("confidence", F.round("found.confidence", 3)).drop("found").withColumn("name", F.trim("name"))
    return stored.withColumn("detail", F.concat("name", F.lit(" ("), F.length("text"), F.lit(" characters, language: "), "lang", F.lit(")")))


def refused(documents: DataFrame, cases: DataFrame) -> DataFrame:
    """``documents`` whose case does not exist."""
    return documents.join(cases.select("case_id").distinct(), "case_id", "left_anti")


def backfill_language(documents: DataFrame) -> DataFrame:
    """``documents`` (text, lang, confidence) with the language where it is null or empty; run again, nothing changes."""
    bare = F.col("lang").isNull() | (F.col("lang") == "")
    found = documents.withColumn("found", F.when(bare, txt.language(F.col("text"))))
    filled = found.withColumn("confidence", F.when(bare, F.round("found.confidence", 3)).otherwise(F.col("confidence")))
    return filled.withColumn("lang", F.when(bare, F.col("found.lang")).otherwise(F.col("lang"))).drop("found")


class GrowingTable:
    """A Parquet table whose schema only grows; what was written before a column came reads as that column's default.

    Rows lie in a folder for each version of the schema. Versions are small one-row files, each with all columns so far, so a
    change is one atomic write and a reader sees the old version or the new one.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[tuple[int, str, dict[str, str], dict[str, int]]]:
        try:
            rows = self.spark.read.parquet(f"{self.path}/versions").orderBy("version").collect()  # a row a version
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            return []
        return [(r["version"], r["fields"], r["defaults"], r["since"]) for r in rows]

    def migrate(self, columns: list[tuple[str, str, str | None]]) -> int:
        """Add those of ``columns`` (name, type, default as text) that are missing; returns the version in force.

        A column that is there keeps its type: another one is an error, and nothing is ever removed.
        """
        versions = self._versions()
        number, fields, defaults, since = versions[-1] if versions else (0, None, {}, {})
        schema = T._parse_datatype_string(fields) if fields else T.StructType()
        for name, kind, _ in columns:
            wanted = T._parse_datatype_string(kind)
            if name in schema.names and schema[name].dataType != wanted:
                raise ValueError(f"column {name!r} is {schema[name].dataType.simpleString()}, not {kind}")
        fresh = [c for c in columns if c[0] not in schema.names]
        if not fresh:
            return number
        number += 1
        listed = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), *(f"`{n}` {k}" for n, k, _ in fresh)])
        row = (number, listed, dict(defaults) | {n: d for n, _, d in fresh if d is not None}, dict(since) | {n: number for n, _, _ in fresh})
        one = self.spark.createDataFrame([row], "version int, fields string, defaults map<string,string>, since map<string,int>")
        one.coalesce(1).write.parquet(f"{self.path}/versions/part_version={number}")
        return number

    def append(self, rows: DataFrame) -> None:
        """``rows`` under the present version; columns they lack get their defaults."""
        number, fields, defaults, _ = self._versions()[-1]
        schema = T._parse_datatype_string(fields)
        extra = set(rows.columns) - set(schema.names)
        if extra:
            raise ValueError(f"unknown columns {sorted(extra)}: migrate first")
        columns = [(F.col(f.name) if f.name in rows.columns else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name) for f in schema]
        rows.select(*columns).write.mode("append").parquet(f"{self.path}/rows/version={number}")

    def read(self) -> DataFrame:
        """All rows with the columns of the present version."""
        number, fields, defaults, since = self._versions()[-1]
        schema = T._parse_datatype_string(fields)
        rows = self.spark.read.schema(T.StructType([*schema.fields, T.StructField("version", T.IntegerType())])).parquet(f"{self.path}/rows")

        def value(f: T.StructField) -> Column:
            return F.when(F.col("version") < since[f.name], F.lit(defaults.get(f.name)).cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name)

        return rows.select(*[value(f) for f in schema])


class Snapshots:
    """Snapshots of a set of tables, checked before they count, and a live version that a restore replaces in one step.

    ``path/<number>/<table>`` holds a snapshot, ``path/<number>/manifest`` its counts and sums, written last: a
    snapshot without one does not exist. ``path/live/<step>`` are pointers; the newest names the live snapshot, the one
    before it stays what it was.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _described(self, tables: dict[str, DataFrame]) -> DataFrame:
        whole = None
        for name in sorted(tables):
            df = tables[name]
            sums = F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)]).cast("decimal(38,0)"))
            one = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(sums, F.lit(0).cast("decimal(38,0)")).cast("string").alias("sums")).select(F.lit(name).alias("name"), "n", "sums")
            whole = one if whole is None else whole.unionByName(one)
        return whole

    def take(self, tables: dict[str, DataFrame]) -> int:
        """A new snapshot; its number."""
        number = max(self.numbers(), default=0) + 1
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.path}/{number}/{name}")
        saved = {name: self.spark.read.parquet(f"{self.path}/{number}/{name}") for name in tables}
        wrong = self._described(tables).exceptAll(self._described(saved)).collect()  # a row a table
        if wrong:
            raise RuntimeError(f"snapshot {number} differs from its tables: {[r['name'] for r in wrong]}")
        self._described(saved).coalesce(1).write.parquet(f"{self.path}/{number}/manifest")
        return number

    def _folders(self, path: str) -> list[str]:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(path)
        fs = folder.getFileSystem(conf)
        return [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []

    def _has(self, path: str) -> bool:
        return "_SUCCESS" in self._folders(path)

    def numbers(self) -> list[int]:
        """Numbers of the snapshots that are complete, ascending."""
        return sorted(int(f) for f in self._folders(self.path) if f.isdigit() and self._has(f"{self.path}/{f}/manifest"))

    def verify(self, number: int) -> DataFrame:
        """(name, expected, found, same) of every table in the snapshot."""
        manifest = self.spark.read.parquet(f"{self.path}/{number}/manifest")
        names = [r[0] for r in manifest.select("name").collect()]  # a row a table
        found = self._described({n: self.spark.read.parquet(f"{self.path}/{number}/{n}") for n in names})
        both = manifest.join(found.select("name", F.col("n").alias("found"), F.col("sums").alias("found_sums")), "name", "left")
        return both.select("name", F.col("n").alias("expected"), "found", ((F.col("n") == F.col("found")) & (F.col("sums") == F.col("found_sums"))).alias("same"))

    def restore(self, number: int) -> None:
        """Make a snapshot the live version, if every table in it is as its manifest says."""
        broken = [r["name"] for r in self.verify(number).where("not coalesce(same, false)").collect()]
        if broken:
            raise RuntimeError(f"snapshot {number} is damaged: {broken}; the live version stays")
        step = max(self._steps(), default=0) + 1
        self.spark.createDataFrame([(number,)], "number int").coalesce(1).write.parquet(f"{self.path}/live/{step}")

    def _steps(self) -> list[int]:
        return sorted(int(f) for f in self._folders(f"{self.path}/live") if f.isdigit() and self._has(f"{self.path}/live/{f}"))

    def live(self, back: int = 0) -> int | None:
        """The number of the live snapshot, or of the one that was live ``back`` restores ago."""
        steps = self._steps()
        return self.spark.read.parquet(f"{self.path}/live/{steps[-1 - back]}").first()[0] if len(steps) > back else None

    def table(self, name: str, back: int = 0) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self.live(back)}/{name}")

    def prune(self, keep: int = 14) -> list[int]:
        """Delete all but the newest ``keep`` snapshots and those that the last two pointers name."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        gone = [n for n in self.numbers()[:-keep] if n not in (self.live(), self.live(1))]
        for n in gone:
            folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}")
            folder.getFileSystem(conf).delete(folder, True)
        return gone
