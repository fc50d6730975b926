"""A store of experiment tables as Parquet folders, with export, import, upsert and cascading delete.

Parquet has no merge: each change writes a new version of a table beside the old one and moves the pointer (the name of
the newest folder in `_current`), so readers never see half a table and a lost executor only costs its tasks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialforge.sources.schemas import KEYS, SCHEMAS, VERSION, conform, empty


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _pointer(self, table: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{table}/_current")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def read(self, table: str) -> DataFrame:
        fs, path = self._pointer(table)
        if not fs.exists(path):
            return empty(self.spark, table)
        stream = fs.open(path)
        name = self.spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream).decode().strip()
        stream.close()
        return conform(self.spark.read.option("mergeSchema", "true").parquet(f"{self.folder}/{table}/{name}"), table)

    def write(self, table: str, df: DataFrame) -> None:
        name = f"v-{uuid.uuid4().hex}"
        conform(df, table).write.parquet(f"{self.folder}/{table}/{name}")
        fs, path = self._pointer(table)
        # Written beside the pointer and moved over it: a reader sees the old name or the new one.
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        beside = path.suffix(f".{uuid.uuid4().hex}")
        out = fs.create(beside, True)
        out.writeBytes(name + "\n")
        out.close()
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(beside, path, how)

    def initialise(self) -> None:
        self.write("schema_version", self.spark.createDataFrame([(VERSION, None)], SCHEMAS["schema_version"]))

    def version(self) -> int | None:
        return self.read("schema_version").agg(F.max("version")).first()[0]

    def counts(self) -> DataFrame:
        """table_name, rows of each table."""
        return row_counts({t: self.read(t) for t in SCHEMAS if t != "schema_version"})

    def upsert(self, table: str, rows: DataFrame) -> None:
        self.write(table, upserted(self.read(table), conform(rows, table), KEYS[table]))

    def delete_runs(self, run_ids: DataFrame) -> None:
        """Removes the runs in run_ids (column run_id) and all that hangs on them."""
        for table, df in without_runs({t: self.read(t) for t in ("runs", "designs", "reviews", "evaluations", "scores_median", "coherence_checks", "traces")}, run_ids).items():
            self.write(table, df)

    def export(self, folder: str, kind: str = "json") -> list[str]:
        """Writes tables that have rows; their names."""
        done = []
        for table in SCHEMAS:
            df = self.read(table)
            if not df.isEmpty():
                writer = df.write.mode("overwrite")
                writer.json(f"{folder}/{table}.json") if kind == "json" else writer.option("header", True).csv(f"{folder}/{table}.csv")
                done.append(table)
        return done

    def load(self, folder: str, tables: list[str] | None = None, kind: str = "json", clear: bool = False) -> dict[str, tuple[int, int]]:
        """Insert-or-ignore, parents first; loaded and skipped rows of each table."""
        out = {}
        for table in tables or list(SCHEMAS):
            reader = self.spark.read.schema(SCHEMAS[table])
            fs, _ = self._pointer(table)
            path = f"{folder}/{table}.{kind}"
            if not fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)):
                continue
            rows = reader.json(path) if kind == "json" else reader.option("header", True).csv(path)
            old = empty(self.spark, table) if clear else self.read(table)
            new = inserted(old, rows, KEYS[table])
            n, before, given = new.count(), old.count(), rows.count()
            self.write(table, new)
            out[table] = (n - before, given - (n - before))
        return out


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def newest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row of each key: the first in `order`."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Insert-or-replace: rows of new (one of each key) take the place of rows of old."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.dropDuplicates(keys))


def inserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Insert-or-ignore: rows of new whose key old lacks are added."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def merged(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Tables of several nodes as one: columns by name, the first part's row where keys meet."""
    out = None
    for i, df in enumerate(parts):
        one = df.withColumn("_part", F.lit(i))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return newest(out, keys, [F.col("_part")]).drop("_part")


def without_runs(tables: dict[str, DataFrame], run_ids: DataFrame) -> dict[str, DataFrame]:
    """The tables less what belongs to the runs in run_ids."""
    doomed = run_ids.select("run_id").distinct()
    designs = tables["designs"].join(doomed, "run_id", "left_semi").select("design_id")
    out = {}
    for name, df in tables.items():
        out[name] = df.join(doomed, "run_id", "left_anti") if "run_id" in df.columns else df.join(designs, "design_id", "left_anti")
        if name == "reviews":
            out[name] = out[name].join(designs, "design_id", "left_anti")
    return out


def without_results(tables: dict[str, DataFrame], designs: DataFrame, results: tuple[str, ...] = ("evaluations", "scores_median")) -> dict[str, DataFrame]:
    """The tables with the results of some designs (design_id) taken out, so that they can be made again; all else stays."""
    doomed = designs.select("design_id").distinct()
    return {name: df.join(doomed, "design_id", "left_anti") if name in results else df for name, df in tables.items()}


def found_runs(spark: SparkSession, pattern: str, column: str = "run_id", unknown: str = "unknown") -> DataFrame:
    """file, run_id of each JSON file that the pattern meets; a file without the field has `unknown`."""
    lines = spark.read.text(pattern, wholetext=True).select(F.input_file_name().alias("file"), F.get_json_object("value", f"$.{column}").alias("run_id"))
    return lines.select("file", F.coalesce("run_id", F.lit(unknown)).alias("run_id"))
