"""The metadata store and the project sources at work: whole rounds over the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.slices import canonical_project
from millrace.runtime import scratch_dir, table
from millrace.sources import files
from millrace.sources.store import DEFAULT_SETTINGS, MetadataStore


def store_round(spark: SparkSession, folder: str) -> DataFrame:
    """What a store holds after inserts, upserts, updates, deletes, a cleared project, settings and a compaction: table_name, n_rows, n_ids."""
    store = MetadataStore(spark, f"{scratch_dir(spark)}/millrace-store-{uuid.uuid4().hex}")
    entries, conversions, vectors = (table(spark, folder, t) for t in ("code_entries", "conversion_results", "embeddings"))
    store.bootstrap()
    store.insert_entries(entries.select("id", "code", F.coalesce("language", F.lit("c")).alias("language"), "function_name", "project", "file_path", "metadata"))
    store.insert_conversions(conversions)
    store.insert_analyses(entries.select(F.col("id").alias("code_id"), F.lit("function_definition").alias("analysis_type"), F.lit("{}").alias("result")))
    points = vectors.select(F.col("vec_id").cast("string").alias("id"), "embedding")
    store.upsert_vectors(points)
    store.upsert_vectors(points.where("cast(id as int) % 2 = 0").unionAll(points.where("id = '1'").select(F.lit("new").alias("id"), "embedding")))
    store.update_entries(entries.where(F.endswith("id", F.lit("1"))).select("id", F.lit("changed").alias("function_name")))
    store.delete_entries(entries.where(F.endswith("id", F.lit("0"))).select("id"))
    store.clear_project("hexwire")
    store.seed_settings()
    store.seed_settings()
    store.compact("code_entries")
    out = None
    for name, key in (("code_entries", "id"), ("conversion_results", "id"), ("analysis_results", "code_id"), ("vectors", "id")):
        one = store.read(name).agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows"), F.countDistinct(key).alias("n_ids"))
        out = one if out is None else out.unionAll(one)
    changed = store.read("code_entries").where("function_name = 'changed'").agg(F.lit("changed").alias("table_name"), F.count("*").alias("n_rows"), F.countDistinct("id").alias("n_ids"))
    return out.unionAll(changed)


def build_commands(spark: SparkSession, folder: str) -> DataFrame:
    """mapping_id, include_dirs, link_libs of a command line made for each mapped file."""
    m = table(spark, folder, "file_mappings").where("source_path IS NOT NULL").select("mapping_id", canonical_project(F.col("project")).alias("p"))
    commands = m.select(F.col("mapping_id").alias("file"), F.concat(F.lit("/w/"), "p").alias("directory"), F.concat(F.lit("cc -Iinclude -I /usr/inc -L"), "p", F.lit(" -lm -l"), "p", F.lit(" -c 'a b.c'")).alias("command"))
    got = files.command_flags(commands, "/w")
    return got.select(F.col("file").alias("mapping_id"), F.array_join("include_dirs", ",").alias("include_dirs"), F.array_join("link_dirs", ",").alias("link_dirs"), F.array_join("link_libs", ",").alias("link_libs"))


def manifest_dependencies(spark: SparkSession, folder: str) -> DataFrame:
    """record_id, dependencies of a manifest made of each translation's declared ones."""
    t = table(spark, folder, "translation_results").where("cargo_dependencies IS NOT NULL")
    body = F.array_join(F.transform(F.array_distinct("cargo_dependencies"), lambda x: F.concat(F.lit('"'), x, F.lit('" = "1"'))), "\n")
    texts = t.select("id", F.concat(F.lit('[package]\nname = "x"\n[dependencies]\n'), body, F.lit("\n")).alias("text"))
    return files.manifests(texts, "id", "text").select("record_id", F.array_join("dependencies", ",").alias("dependencies"), "has_bin")


QUERIES = {"sink_store": store_round, "scan_commands": build_commands, "scan_manifests": manifest_dependencies}
_LEFT = "NOT ends_with(id, '0') AND coalesce(project, 'default') <> 'hexwire'"
ORACLE_SQL = {
    "sink_store": f"""WITH e AS (SELECT * FROM code_entries WHERE {_LEFT}), h AS (SELECT DISTINCT CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.key') END AS key FROM e WHERE language = 'config'),
        s AS (SELECT count(*) AS n FROM (SELECT unnest([{', '.join(repr(k) for k in sorted(DEFAULT_SETTINGS))}]) AS key) WHERE key NOT IN (SELECT key FROM h WHERE key IS NOT NULL))
        SELECT 'code_entries' AS table_name, (SELECT count(*) FROM e) + n AS n_rows, (SELECT count(*) FROM e) + n AS n_ids FROM s
        UNION ALL SELECT 'conversion_results', count(*), count(DISTINCT id) FROM conversion_results WHERE source_id IN (SELECT id FROM e)
        UNION ALL SELECT 'analysis_results', count(*), count(DISTINCT id) FROM e
        UNION ALL SELECT 'vectors', count(*) + 1, count(DISTINCT vec_id) + 1 FROM embeddings
        UNION ALL SELECT 'changed', count(*), count(*) FROM e WHERE ends_with(id, '1')""",
    "scan_commands": r"""SELECT mapping_id, '/usr/inc,/w/' || p || '/include' AS include_dirs, '/w/' || p || '/' || p AS link_dirs, CASE WHEN p < 'm' THEN p || ',m' WHEN p = 'm' THEN 'm' ELSE 'm,' || p END AS link_libs
        FROM (SELECT mapping_id, coalesce(nullif(regexp_extract(regexp_replace(regexp_replace(lower(trim(project)), '[\\/]+', '/', 'g'), '/+$', ''), '([^/]*)$', 1), ''), 'unknown') AS p FROM file_mappings WHERE source_path IS NOT NULL)""",
    "scan_manifests": "SELECT id AS record_id, array_to_string(list_sort(list_distinct(cargo_dependencies)), ',') AS dependencies, false AS has_bin FROM translation_results WHERE cargo_dependencies IS NOT NULL",
}
