"""Metadata warehouse: lookups, filtered search, joins, roll-ups and JSON fields.

Null handling follows SQL: an equality on a null never holds; an absent filter
(None) holds always.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.runtime import table


# --- filters -------------------------------------------------------------------------------
def all_of(df: DataFrame, **wanted) -> DataFrame:
    """Conjunction of the given equalities; None leaves a column free."""
    for name, value in wanted.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def search_entries(entries: DataFrame, language: str | None = None, project: str | None = None, function_name: str | None = None, limit: int | None = None) -> DataFrame:
    """Matching entries, newest first (ties by id)."""
    found = all_of(entries, language=language, project=project, function_name=function_name).orderBy(F.col("updated_at").desc_nulls_last(), "id")
    return found.limit(limit) if limit is not None else found


def lookup(entries: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Point lookup of many ids at once."""
    return entries.join(keys.select(F.col(key).alias("id")).distinct(), "id", "left_semi")


def raw_query(spark: SparkSession, sql: str, args: list | dict | None = None) -> DataFrame:
    """A SQL text with bound parameters."""
    return spark.sql(sql, args=args) if args else spark.sql(sql)


def path_matches(path: Column, name: str) -> Column:
    """The path itself or, whatever its case, any path that ends in it; ``_`` and ``%`` stand for themselves."""
    escaped = name.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return (path == name) | path.ilike(f"%{escaped}")


def mark_text_matches(entries: DataFrame, text: str) -> DataFrame:
    """Every row; rows whose code holds the text get its name and position as well."""
    hit = F.contains(F.col("code"), F.lit(text))
    return entries.select("id", F.coalesce(hit, F.lit(False)).alias("matches"), F.when(hit, F.col("function_name")).alias("matched_name"), F.when(hit, F.instr("code", text)).alias("matched_at"))


def row_json(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows as JSON objects, nulls kept."""
    return df.select("id", F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("row"))


def json_field(col: Column, field: str) -> Column:
    """A member of JSON text; null where the text is no JSON."""
    return F.get_json_object(col, f"$.{field}")


def projects(entries: DataFrame) -> DataFrame:
    """id, name, path of the bookkeeping rows that stand for projects."""
    return entries.where(json_field(F.col("metadata"), "type") == "project").select("id", json_field(F.col("metadata"), "name").alias("name"), json_field(F.col("metadata"), "path").alias("path"))


def latest_settings(entries: DataFrame) -> DataFrame:
    """key, value of each setting as last written (ties: greatest id)."""
    rows = entries.where(F.lower(F.trim("language")) == "config")
    newest = F.struct("updated_at", "id")
    return rows.groupBy(json_field(F.col("metadata"), "key").alias("key")).agg(F.max_by(json_field(F.col("metadata"), "value"), newest).alias("value"))


# --- joins ---------------------------------------------------------------------------------
def conversions_of(entries: DataFrame, conversions: DataFrame, conversion_type: str) -> DataFrame:
    """Conversions with their entries, of one type."""
    c = conversions.where(F.col("conversion_type") == conversion_type).select(F.col("id").alias("conversion_id"), "source_id", "status")
    return c.join(entries.select(F.col("id").alias("source_id"), "language", "project", "function_name"), "source_id")


def newest_conversion(entries: DataFrame, conversions: DataFrame, status: str) -> DataFrame:
    """Every entry with its newest conversion of a status, or none."""
    c = conversions.where(F.col("status") == status).groupBy("source_id").agg(F.max_by("id", F.struct("created_at", "id")).alias("conversion_id"))
    return entries.select("id").join(c.withColumnRenamed("source_id", "id"), "id", "left")


def with_source(conversions: DataFrame, entries: DataFrame) -> DataFrame:
    """Conversions whose source exists."""
    return conversions.join(entries.select(F.col("id").alias("source_id")), "source_id", "left_semi")


def without_source(conversions: DataFrame, entries: DataFrame) -> DataFrame:
    return conversions.join(entries.select(F.col("id").alias("source_id")), "source_id", "left_anti")


def namesakes(entries: DataFrame) -> DataFrame:
    """function_name, project, n: how often a name is defined within a project; blank names are left out."""
    named = entries.where("function_name IS NOT NULL AND function_name <> ''")
    return named.groupBy(F.lower("function_name").alias("function_name"), "project").agg(F.count("*").alias("n_entries"), F.min("id").alias("first_id"))


def interface_context(entries: DataFrame, limit: int = 10) -> DataFrame:
    """Up to ``limit`` nameless entries of each path: file_path, position, id."""
    nameless = entries.where("(function_name = '' OR function_name IS NULL) AND file_path IS NOT NULL")
    w = Window.partitionBy("file_path").orderBy(F.col("updated_at").desc_nulls_last(), "id")
    return nameless.select("file_path", "id", F.row_number().over(w).alias("position")).where(F.col("position") <= limit)


# --- roll-ups ------------------------------------------------------------------------------
def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in sorted(tables.items()):
        one = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = one if out is None else out.unionAll(one)
    return out


def file_info(entries: DataFrame) -> DataFrame:
    """file_path, language, project, n_entries: the largest group of each path (ties: first by name)."""
    counts = entries.where("file_path IS NOT NULL").groupBy("file_path", "language", "project").agg(F.count("*").alias("n_entries"))
    w = Window.partitionBy("file_path").orderBy(F.col("n_entries").desc(), F.col("language").asc_nulls_first(), F.col("project").asc_nulls_first())
    return counts.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def file_info_or_default(entries: DataFrame, mappings: DataFrame) -> DataFrame:
    """Information of every mapped target, or a default row where nothing is known."""
    m = mappings.select("mapping_id", F.regexp_extract("source_path", r"([^/\\]*)$", 1).alias("name"))
    known = entries.where("file_path IS NOT NULL").groupBy(F.regexp_extract("file_path", r"([^/\\]*)$", 1).alias("name")).agg(F.min("language").alias("language"), F.count("*").alias("n"))
    return m.join(known, "name", "left").select("mapping_id", F.coalesce("language", F.lit("unknown")).alias("language"), F.coalesce("n", F.lit(0)).cast("long").alias("n_entries"))


def status_counts(conversions: DataFrame) -> DataFrame:
    """Successes and failures of each conversion type."""
    return conversions.groupBy("conversion_type").agg(
        F.count_if(F.col("status") == "success").alias("n_success"), F.count_if(F.col("status") != "success").alias("n_other"), F.count("*").alias("n_rows")
    )


def system_status(tables: dict[str, DataFrame]) -> DataFrame:
    """One row: the number of rows of each table."""
    counts = table_counts(tables)
    return counts.agg(F.sum("n_rows").cast("long").alias("total_rows"), F.count_if(F.col("n_rows") > 0).alias("filled_tables"), F.count("*").alias("n_tables"))


def match_summary(entries: DataFrame, translations: DataFrame) -> DataFrame:
    """Share of entries of each language that have a translation, in percent; 0 when there is none."""
    have = translations.select(F.col("source_id").alias("id")).distinct().withColumn("hit", F.lit(1))
    e = entries.select("id", F.lower(F.trim("language")).alias("language")).join(have, "id", "left")
    return e.groupBy("language").agg(F.count("*").alias("n_entries"), F.count("hit").alias("n_matched")).withColumn("match_rate", F.coalesce(F.round(F.try_divide(F.col("n_matched") * 100.0, F.col("n_entries")), 2), F.lit(0.0)))


_CORE = ["code_entries", "conversion_results", "translation_results", "file_mappings"]


def _q_lookup(s, d):
    return lookup(table(s, d, "code_entries"), table(s, d, "conversion_results"), "source_id").select("id", "language", "project")


def _q_search(s, d):
    return search_entries(table(s, d, "code_entries"), "c", "hexwire").select("id", "function_name", F.unix_micros("updated_at").alias("updated_us"))


def _q_newest(s, d):
    return search_entries(table(s, d, "code_entries"), limit=20).select("id", F.unix_micros("updated_at").alias("updated_us"))


def _q_raw(s, d):
    table(s, d, "code_entries").createOrReplaceTempView("millrace_entries")
    return raw_query(s, "SELECT language, count(*) AS n_rows FROM millrace_entries WHERE project = ? AND length(code) > ? GROUP BY language", ["hexwire", 1000])


def _q_like(s, d):
    return table(s, d, "code_entries").where(path_matches(F.col("file_path"), ".RS")).select("id", "file_path")


QUERIES = {
    "scan_lookup": _q_lookup,
    "scan_search": _q_search,
    "top_newest": _q_newest,
    "scan_raw_query": _q_raw,
    "filter_path": _q_like,
    "filter_mark_text": lambda s, d: mark_text_matches(table(s, d, "code_entries"), "malloc("),
    "json_rows": lambda s, d: row_json(table(s, d, "code_entries"), ["id", "language", "function_name", "project"]),
    "json_projects": lambda s, d: projects(table(s, d, "code_entries")),
    "json_fields": lambda s, d: table(s, d, "code_entries").select("id", json_field(F.col("metadata"), "domain").alias("domain"), F.coalesce(json_field(F.col("metadata"), "return_type"), F.lit("void")).alias("return_type")),
    "window_latest_setting": lambda s, d: latest_settings(table(s, d, "code_entries")),
    "join_conversions": lambda s, d: conversions_of(table(s, d, "code_entries"), table(s, d, "conversion_results"), "c_to_rust"),
    "join_newest_conversion": lambda s, d: newest_conversion(table(s, d, "code_entries"), table(s, d, "conversion_results"), "success"),
    "join_guard": lambda s, d: with_source(table(s, d, "conversion_results"), table(s, d, "code_entries")).select("id", "source_id"),
    "join_orphans": lambda s, d: without_source(table(s, d, "conversion_results"), table(s, d, "code_entries")).select("id", "source_id"),
    "join_namesakes": lambda s, d: namesakes(table(s, d, "code_entries")),
    "join_interface_context": lambda s, d: interface_context(table(s, d, "code_entries")),
    "agg_table_counts": lambda s, d: table_counts({t: table(s, d, t) for t in _CORE}),
    "agg_system_status": lambda s, d: system_status({t: table(s, d, t) for t in _CORE}),
    "agg_file_info": lambda s, d: file_info(table(s, d, "code_entries")),
    "join_file_default": lambda s, d: file_info_or_default(table(s, d, "code_entries"), table(s, d, "file_mappings")),
    "agg_status": lambda s, d: status_counts(table(s, d, "conversion_results")),
    "agg_match_rate": lambda s, d: match_summary(table(s, d, "code_entries"), table(s, d, "translation_results")),
}

_MEMBER = "CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.{}') END"
ORACLE_SQL = {
    "scan_lookup": "SELECT id, language, project FROM code_entries WHERE id IN (SELECT source_id FROM conversion_results)",
    "scan_search": "SELECT id, function_name, epoch_us(updated_at) AS updated_us FROM code_entries WHERE language = 'c' AND project = 'hexwire'",
    "top_newest": "SELECT id, epoch_us(updated_at) AS updated_us FROM code_entries ORDER BY updated_at DESC NULLS LAST, id LIMIT 20",
    "scan_raw_query": "SELECT language, count(*) AS n_rows FROM code_entries WHERE project = 'hexwire' AND length(code) > 1000 GROUP BY language",
    "filter_path": "SELECT id, file_path FROM code_entries WHERE file_path ILIKE '%.RS'",
    "filter_mark_text": """SELECT id, coalesce(contains(code, 'malloc('), false) AS matches, CASE WHEN contains(code, 'malloc(') THEN function_name END AS matched_name,
        CASE WHEN contains(code, 'malloc(') THEN instr(code, 'malloc(')::INT END AS matched_at FROM code_entries""",
    "json_rows": "SELECT id, to_json({'id': id, 'language': language, 'function_name': function_name, 'project': project})::VARCHAR AS row FROM code_entries",
    "json_projects": f"SELECT id, {_MEMBER.format('name')} AS name, {_MEMBER.format('path')} AS path FROM code_entries WHERE {_MEMBER.format('type')} = 'project'",
    "json_fields": f"SELECT id, {_MEMBER.format('domain')} AS domain, coalesce({_MEMBER.format('return_type')}, 'void') AS return_type FROM code_entries",
    "window_latest_setting": f"""SELECT key, value FROM (SELECT {_MEMBER.format('key')} AS key, {_MEMBER.format('value')} AS value,
        row_number() OVER (PARTITION BY {_MEMBER.format('key')} ORDER BY updated_at DESC, id DESC) AS rn FROM code_entries WHERE lower(trim(language)) = 'config') WHERE rn = 1""",
    "join_conversions": """SELECT c.id AS conversion_id, c.source_id, c.status, e.language, e.project, e.function_name FROM conversion_results c JOIN code_entries e ON c.source_id = e.id
        WHERE c.conversion_type = 'c_to_rust'""",
    "join_newest_conversion": """SELECT e.id, c.id AS conversion_id FROM code_entries e LEFT JOIN (SELECT source_id, id FROM (SELECT source_id, id,
        row_number() OVER (PARTITION BY source_id ORDER BY created_at DESC, id DESC) AS rn FROM conversion_results WHERE status = 'success') WHERE rn = 1) c ON c.source_id = e.id""",
    "join_guard": "SELECT id, source_id FROM conversion_results WHERE source_id IN (SELECT id FROM code_entries)",
    "join_orphans": "SELECT id, source_id FROM conversion_results c WHERE NOT EXISTS (SELECT 1 FROM code_entries e WHERE e.id = c.source_id)",
    "join_namesakes": "SELECT lower(function_name) AS function_name, project, count(*) AS n_entries, min(id) AS first_id FROM code_entries WHERE function_name <> '' GROUP BY 1, 2",
    "join_interface_context": """SELECT file_path, id, position FROM (SELECT file_path, id, row_number() OVER (PARTITION BY file_path ORDER BY updated_at DESC NULLS LAST, id)::INT AS position
        FROM code_entries WHERE (function_name = '' OR function_name IS NULL) AND file_path IS NOT NULL) WHERE position <= 10""",
    "agg_table_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in _CORE),
    "agg_system_status": "SELECT sum(n)::BIGINT AS total_rows, count(*) FILTER (n > 0) AS filled_tables, count(*) AS n_tables FROM (" + " UNION ALL ".join(f"SELECT count(*) AS n FROM {t}" for t in _CORE) + ")",
    "agg_file_info": """SELECT file_path, language, project, n_entries FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY n_entries DESC, language NULLS FIRST, project NULLS FIRST) AS rn
        FROM (SELECT file_path, language, project, count(*) AS n_entries FROM code_entries WHERE file_path IS NOT NULL GROUP BY ALL)) WHERE rn = 1""",
    "join_file_default": r"""WITH k AS (SELECT regexp_extract(file_path, '([^/\\]*)$', 1) AS name, min(language) AS language, count(*) AS n FROM code_entries WHERE file_path IS NOT NULL GROUP BY 1)
        SELECT m.mapping_id, coalesce(k.language, 'unknown') AS language, coalesce(k.n, 0) AS n_entries FROM file_mappings m LEFT JOIN k ON regexp_extract(m.source_path, '([^/\\]*)$', 1) = k.name""",
    "agg_status": "SELECT conversion_type, count(*) FILTER (status = 'success') AS n_success, count(*) FILTER (status <> 'success') AS n_other, count(*) AS n_rows FROM conversion_results GROUP BY 1",
    "agg_match_rate": """SELECT language, n_entries, n_matched, round(n_matched * 100.0 / n_entries, 2)::DOUBLE AS match_rate FROM (SELECT lower(trim(e.language)) AS language, count(*) AS n_entries, count(t.source_id) AS n_matched
        FROM code_entries e LEFT JOIN (SELECT DISTINCT source_id FROM translation_results) t ON t.source_id = e.id GROUP BY 1)""",
}
