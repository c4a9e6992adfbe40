"""Inserts, updates and deletes as functions from tables to tables.

The store writes what these return; as plain DataFrames they can be checked and
composed like any other operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.metadata import json_field
from millrace.runtime import table


def with_defaults(rows: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Rows whose absent or blank fields have their defaults."""
    have = {n: F.coalesce(F.nullif(F.trim(n), F.lit("")), F.lit(v)) if n in rows.columns else F.lit(v) for n, v in defaults.items()}
    return rows.withColumns(have)


def inserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new rows; columns that the new ones lack are null."""
    return old.unionByName(new.select(*[c for c in new.columns if c in old.columns]), allowMissingColumns=True)


def updated(old: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Old rows with the non-null fields of the change of the same key, and ``was_updated``.

    ``changes`` has one row for each key; keys that no row has change nothing.
    """
    fields = [c for c in changes.columns if c != key and c in old.columns]
    c = changes.select(key, F.lit(True).alias("_hit"), *(F.col(f).alias(f"_new_{f}") for f in fields))
    joined = old.join(c, key, "left")
    out = [F.coalesce(f"_new_{f}", f).alias(f) if f in fields else F.col(f) for f in old.columns]
    return joined.select(*out, F.coalesce("_hit", F.lit(False)).alias("was_updated"))


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows, and the old ones whose key is not among them."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def cascade(ids: DataFrame, tables: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """What is left of each table without the rows that belong to ``ids`` (column id)."""
    gone = ids.select("id").distinct()
    return {name: df.join(gone.withColumnRenamed("id", key), key, "left_anti") for name, (df, key) in tables.items()}


def missing_settings(entries: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """key, value of the defaults whose key is not set yet."""
    wanted = entries.sparkSession.createDataFrame(sorted(defaults.items()), "key string, value string")
    have = entries.where(F.lower(F.trim("language")) == "config").select(json_field(F.col("metadata"), "key").alias("key")).distinct()
    return wanted.join(have, "key", "left_anti")


def merged_headers(entries: DataFrame) -> DataFrame:
    """id, text of each C source with the texts of its header (same project, folder and stem) before it."""
    named = entries.where("file_path IS NOT NULL AND code IS NOT NULL").withColumn("stem", F.regexp_replace("file_path", r"\.[^./\\]*$", ""))
    heads = named.where(F.col("file_path").rlike(r"\.(?:h|hpp)$")).groupBy("project", "stem").agg(F.min_by("code", "id").alias("head"))
    sources = named.where(F.col("file_path").rlike(r"\.(?:c|cpp)$"))
    return sources.join(heads, (sources.project.eqNullSafe(heads.project)) & (sources.stem == heads.stem), "left").select("id", F.concat_ws("\n", "head", "code").alias("text"))


def _after_delete(s, d):
    e = table(s, d, "code_entries")
    rest = cascade(e.where("project = 'hexwire'"), {"code_entries": (e, "id"), "conversion_results": (table(s, d, "conversion_results"), "source_id"), "translation_results": (table(s, d, "translation_results"), "source_id")})
    out = None
    for name, df in sorted(rest.items()):
        one = df.select(F.lit(name).alias("table_name"), F.col("id"))
        out = one if out is None else out.unionAll(one)
    return out


def _update(s, d):
    best = table(s, d, "conversion_results").where("status = 'success' AND converted_code <> ''").groupBy(F.col("source_id").alias("id")).agg(F.max_by("converted_code", F.struct("created_at", "id")).alias("code"))
    return updated(table(s, d, "code_entries").select("id", "code", "project"), best)


def _insert(s, d):
    new = with_defaults(table(s, d, "translation_results").select(F.col("id"), F.col("rust_code").alias("code")), {"language": "c", "project": "default", "code": ""})
    return inserted(table(s, d, "code_entries").select("id", "code", "language", "project", "function_name"), new)


def _upsert(s, d):
    v = table(s, d, "embeddings")
    return upserted(v, v.where("vec_id % 3 = 0").withColumn("label", F.lit(99).cast(v.schema["label"].dataType)), "vec_id").groupBy("label").agg(F.count("*").alias("n_vectors"))


#: Settings that a store begins with (two of them, to be told apart from others in tests).
_DEFAULTS = {"log_level": "info", "not_set_yet": "1"}
QUERIES = {
    "sink_insert": _insert,
    "sink_update": _update,
    "sink_delete": _after_delete,
    "sink_upsert": _upsert,
    "sink_seed": lambda s, d: missing_settings(table(s, d, "code_entries"), _DEFAULTS),
    "fn_merged_headers": lambda s, d: merged_headers(table(s, d, "code_entries")),
}
ORACLE_SQL = {
    "sink_insert": "SELECT id, code, language, project, function_name FROM code_entries UNION ALL SELECT id, coalesce(nullif(trim(rust_code), ''), ''), 'c', 'default', NULL FROM translation_results",
    "sink_update": """SELECT e.id, coalesce(c.code, e.code) AS code, e.project, c.id IS NOT NULL AS was_updated FROM code_entries e LEFT JOIN (SELECT source_id AS id, arg_max(converted_code, (created_at, id)) AS code
        FROM conversion_results WHERE status = 'success' AND converted_code <> '' GROUP BY 1) c ON c.id = e.id""",
    "sink_delete": """WITH g AS (SELECT id FROM code_entries WHERE project = 'hexwire') SELECT 'code_entries' AS table_name, id FROM code_entries WHERE id NOT IN (SELECT id FROM g)
        UNION ALL SELECT 'conversion_results', id FROM conversion_results WHERE source_id NOT IN (SELECT id FROM g) UNION ALL SELECT 'translation_results', id FROM translation_results WHERE source_id NOT IN (SELECT id FROM g)""",
    "sink_upsert": "SELECT CASE WHEN vec_id % 3 = 0 THEN 99 ELSE label END AS label, count(*) AS n_vectors FROM embeddings GROUP BY 1",
    "sink_seed": """SELECT * FROM (VALUES ('log_level', 'info'), ('not_set_yet', '1')) t(key, value) WHERE key NOT IN (SELECT json_extract_string(metadata, '$.key') FROM code_entries
        WHERE lower(trim(language)) = 'config' AND json_valid(metadata) AND json_extract_string(metadata, '$.key') IS NOT NULL)""",
    "fn_merged_headers": r"""WITH n AS (SELECT *, regexp_replace(file_path, '\.[^./\\]*$', '') AS stem FROM code_entries WHERE file_path IS NOT NULL AND code IS NOT NULL),
        h AS (SELECT project, stem, arg_min(code, id) AS head FROM n WHERE regexp_matches(file_path, '\.(?:h|hpp)$') GROUP BY ALL)
        SELECT n.id, concat_ws(chr(10), h.head, n.code) AS text FROM n LEFT JOIN h ON h.project IS NOT DISTINCT FROM n.project AND h.stem = n.stem WHERE regexp_matches(n.file_path, '\.(?:c|cpp)$')""",
}
