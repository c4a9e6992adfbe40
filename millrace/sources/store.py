"""The metadata store: typed tables in a folder, with inserts, updates and deletes.

A table is a folder of versions, each of them a Parquet folder; the newest version that
was written to its end is the table.  Appends add files to it.  An update or delete writes
the next version beside it and only then drops the older ones, so there is a whole table
at any moment and a lost job leaves the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT = T.StringType()
_TIME = T.TimestampType()
ENTRY = T.StructType(
    [T.StructField("id", _TEXT, False), T.StructField("code", _TEXT, False), T.StructField("language", _TEXT, False)]
    + [T.StructField(n, _TEXT) for n in ("function_name", "project", "file_path")]
    + [T.StructField("created_at", _TIME, False), T.StructField("updated_at", _TIME, False), T.StructField("metadata", _TEXT)]
)
CONVERSION = T.StructType([T.StructField(n, _TEXT, False) for n in ("id", "source_id", "original_code", "converted_code", "conversion_type", "status")] + [T.StructField("error_message", _TEXT), T.StructField("created_at", _TIME, False), T.StructField("metadata", _TEXT)])
ANALYSIS = T.StructType([T.StructField(n, _TEXT, False) for n in ("id", "code_id", "analysis_type", "result")] + [T.StructField("score", T.DoubleType()), T.StructField("created_at", _TIME, False)])
VECTOR = T.StructType([T.StructField("id", _TEXT, False), T.StructField("embedding", T.ArrayType(T.FloatType()))] + [T.StructField(n, _TEXT) for n in ("code", "language", "function_name", "project", "file_path")] + [T.StructField("timestamp", _TIME), T.StructField("batch_num", T.LongType())])
SCHEMAS = {"code_entries": ENTRY, "conversion_results": CONVERSION, "analysis_results": ANALYSIS, "vectors": VECTOR}
#: Settings that a new store begins with.
DEFAULT_SETTINGS = {"similarity_threshold": "0.7", "embedding_dim": "1024", "retry_limit": "3", "concurrency": "5", "chunk_size": "100000", "log_level": "info"}


class MetadataStore:
    """Tables of SCHEMAS under one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    # --- tables
    def _versions(self, name: str) -> list[int]:
        """Numbers of the versions that were written to their end, rising."""
        make, fs = self._fs()
        at = make(f"{self.folder}/{name}")
        if not fs.exists(at):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(at)]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(make(f"{self.folder}/{name}/{n}/_SUCCESS")))

    def path(self, name: str, version: int | None = None) -> str:
        """Folder of a version of a table; of the newest one if none is named."""
        if version is None:
            version = (self._versions(name) or [0])[-1]
        return f"{self.folder}/{name}/v{version:08}"

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.folder)
        return jvm.org.apache.hadoop.fs.Path, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def bootstrap(self) -> None:
        """Create what is missing; a second call changes nothing."""
        for name, schema in SCHEMAS.items():
            if not self._versions(name):
                self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(self.path(name, 0))

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(self.path(name))

    def views(self) -> None:
        """Temporary views of all tables, for SQL."""
        for name in SCHEMAS:
            self.read(name).createOrReplaceTempView(name)

    def recreate(self, name: str) -> None:
        self._swap(name, self.spark.createDataFrame([], SCHEMAS[name]))

    def _append(self, name: str, rows: DataFrame) -> None:
        cols = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in SCHEMAS[name].fields]
        rows.select(*cols).write.mode("append").parquet(self.path(name))

    def _swap(self, name: str, rows: DataFrame) -> None:
        """Write ``rows`` as the next version, then drop the older ones."""
        make, fs = self._fs()
        before = self._versions(name)
        new = self.path(name, (before or [-1])[-1] + 1)
        # what a lost job may have left there is overwritten
        rows.select(*[f.name for f in SCHEMAS[name].fields]).write.mode("overwrite").parquet(new)
        for v in before:
            fs.delete(make(self.path(name, v)), True)

    def compact(self, name: str, files: int = 1) -> None:
        """The same rows in fewer files."""
        self._swap(name, self.read(name).coalesce(files))

    # --- inserts
    @staticmethod
    def _stamped(rows: DataFrame, times: list[str]) -> DataFrame:
        have = F.col("id") if "id" in rows.columns else F.lit(None).cast("string")
        rows = rows.withColumn("id", F.coalesce(F.nullif(F.trim(have), F.lit("")), F.uuid()))
        return rows.withColumns({t: F.current_timestamp() for t in times})

    def insert_entries(self, rows: DataFrame) -> None:
        """Blank ids are made, times set, and absent language and project get their defaults."""
        col = lambda n, d: F.coalesce(F.col(n), F.lit(d)) if n in rows.columns else F.lit(d)
        filled = rows.withColumns({"language": col("language", "c"), "project": col("project", "default"), "code": col("code", "")})
        self._append("code_entries", self._stamped(filled, ["created_at", "updated_at"]))

    def insert_conversions(self, rows: DataFrame) -> None:
        """Rows whose source exists; others are left out."""
        known = self.read("code_entries").select(F.col("id").alias("source_id"))
        self._append("conversion_results", self._stamped(rows.join(known, "source_id", "left_semi"), ["created_at"]))

    def insert_analyses(self, rows: DataFrame) -> None:
        self._append("analysis_results", self._stamped(rows, ["created_at"]))

    def upsert_vectors(self, rows: DataFrame) -> None:
        """Points by id: new ones replace old ones; repeated new ones count once (greatest embedding)."""
        new = rows.groupBy("id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "id"]), F.col("embedding").cast("string")).alias("p")).select("id", "p.*")
        cols = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in new.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in VECTOR.fields]
        kept = self.read("vectors").join(new.select("id"), "id", "left_anti")
        self._swap("vectors", kept.unionByName(new.select(*cols)))

    def insert_interfaces(self, rows: DataFrame) -> None:
        """Entries with their vectors under one id, in two appends of one set of rows."""
        from millrace.runtime import materialise

        keyed = materialise(self._stamped(rows, ["timestamp"]), "interfaces")
        self.insert_entries(keyed.drop("embedding", "timestamp"))
        self._append("vectors", keyed.where("embedding IS NOT NULL"))

    def create_project(self, name: str, path: str, description: str | None = None) -> None:
        row = self.spark.range(1).select(
            F.lit(description or "").alias("code"), F.lit("project").alias("language"), F.lit(name).alias("function_name"), F.lit(name).alias("project"),
            F.to_json(F.struct(F.lit("project").alias("type"), F.lit(name).alias("name"), F.lit(path).alias("path"))).alias("metadata"),
        )
        self.insert_entries(row)

    def set_setting(self, key: str, value: str) -> None:
        """Settings are appended; the newest counts."""
        row = self.spark.range(1).select(
            F.lit(f"{key}={value}").alias("code"), F.lit("config").alias("language"), F.lit(key).alias("function_name"), F.lit("system").alias("project"),
            F.to_json(F.struct(F.lit(key).alias("key"), F.lit(value).alias("value"))).alias("metadata"),
        )
        self.insert_entries(row)

    def seed_settings(self) -> None:
        """Default settings whose key is not there yet."""
        wanted = self.spark.createDataFrame(sorted(DEFAULT_SETTINGS.items()), "key string, value string")
        have = self.read("code_entries").where("language = 'config'").select(F.get_json_object("metadata", "$.key").alias("key"))
        rows = wanted.join(have, "key", "left_anti")
        self.insert_entries(rows.select(F.concat("key", F.lit("="), "value").alias("code"), F.lit("config").alias("language"), F.col("key").alias("function_name"), F.lit("system").alias("project"), F.to_json(F.struct("key", "value")).alias("metadata")))

    # --- updates and deletes
    def update_entries(self, changes: DataFrame) -> int:
        """Overwrite the given columns of entries by id; returns how many ids were not found.

        Of several changes for one id the greatest row counts.
        """
        changes = changes.groupBy("id").agg(F.max(F.struct(*[c for c in changes.columns if c != "id"])).alias("_c")).select("id", "_c.*")
        fields = [f.name for f in ENTRY.fields if f.name in changes.columns and f.name != "id"]
        c = changes.select("id", F.lit(True).alias("_hit"), *(F.col(n).alias(f"_{n}") for n in fields))
        joined = self.read("code_entries").join(c, "id", "left")
        missing = changes.join(self.read("code_entries").select("id"), "id", "left_anti").count()
        new = {n: F.when(F.col("_hit"), F.coalesce(f"_{n}", n)).otherwise(F.col(n)) for n in fields} | {"updated_at": F.when(F.col("_hit"), F.current_timestamp()).otherwise(F.col("updated_at"))}
        self._swap("code_entries", joined.withColumns(new))
        return missing

    def delete_entries(self, ids: DataFrame, vectors: bool = True) -> None:
        """Entries with their analyses, conversions and, unless told otherwise, vectors."""
        ids = ids.select("id").distinct()
        for name, key in (("analysis_results", "code_id"), ("conversion_results", "source_id"), *([("vectors", "id")] if vectors else []), ("code_entries", "id")):
            t = self.read(name)
            self._swap(name, t.join(ids.withColumnRenamed("id", key), key, "left_anti"))

    def clear_project(self, project: str) -> None:
        """Entries of a project with their analyses and conversions; vectors stay."""
        self.delete_entries(self.read("code_entries").where(F.col("project") == project), vectors=False)

    def store_facts(self, facts: DataFrame, kind: str, project: str) -> None:
        """Extracted facts (columns name, file, result) as pairs of entry and analysis."""
        from millrace.runtime import materialise

        keyed = materialise(facts.withColumn("id", F.uuid()), "facts")
        self.insert_entries(keyed.select("id", F.col("result").alias("code"), F.lit("c").alias("language"), F.col("name").alias("function_name"), F.lit(project).alias("project"), F.col("file").alias("file_path")))
        self.insert_analyses(keyed.select(F.col("id").alias("code_id"), F.lit(kind).alias("analysis_type"), "result"))
