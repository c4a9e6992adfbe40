"""Whole pipelines of the command line, as compositions of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import code as C
from millrace.operators import chunking, facts, graph, paths
from millrace.runtime import table


def analyze(entries: DataFrame) -> DataFrame:
    """Symbols of every entry with its profile: id, n_functions, n_types, n_macros, n_includes, complexity, n_tokens."""
    counts = facts.symbol_counts(entries)
    more = entries.where("code IS NOT NULL").select("id", F.round(C.complexity(F.col("code")), 4).alias("complexity"), chunking.token_estimate(F.col("code")).alias("n_tokens"))
    return counts.join(more, "id")


def preprocess(mappings: DataFrame) -> DataFrame:
    """Categories of mapped files with their headers: group_key, path, category, header_path."""
    files = mappings.select(F.coalesce("project", F.lit("")).alias("group_key"), F.col("source_path").alias("path"))
    pairs = paths.pair_headers(files).select("group_key", F.col("source_path").alias("path"), "header_path")
    return paths.pairing_categories(files).join(pairs, ["group_key", "path"], "left")


def schedule(relations: DataFrame) -> DataFrame:
    """Order in which folders can be translated: relation_id, folder, level, outcome."""
    nodes, edges = graph.include_graph(relations)
    lifted = graph.folder_edges(graph.resolve_includes(nodes, edges, ["", "include", "src", "lib"]))
    return graph.topological_levels(nodes.select("relation_id", paths.parent(F.col("path")).alias("folder")).distinct(), lifted, ["relation_id", "folder"])


def file_prompts(entries: DataFrame, conversions: DataFrame, guide: str = "Convert to safe code.") -> DataFrame:
    """id, prompt: sections in a fixed order, those without content left out."""
    code = F.col("code")
    prior = conversions.where("status = 'success'").groupBy(F.col("source_id").alias("id")).agg(F.max_by("converted_code", F.struct("created_at", "id")).alias("prior"))
    calls = F.array_join(F.filter(C.distinct_names(code, C.CALL_NAME), lambda x: ~C.is_system_name(x)), ", ")
    e = entries.where("code IS NOT NULL").join(prior, "id", "left")
    sections = [
        ("File", F.coalesce("file_path", F.lit("unknown"))), ("Functions", F.array_join(C.all_names(code, C.C_FUNCTION), ", ")), ("Includes", F.array_join(C.all_names(code, C.INCLUDE_LOOSE), ", ")),
        ("Calls", calls), ("Earlier", F.coalesce("prior", F.lit(""))), ("Guide", F.lit(guide)),
    ]
    texts = [F.when(v != "", F.concat(F.lit(f"## {n}\n"), v)) for n, v in sections]
    return e.select("id", F.concat_ws("\n\n", *texts).alias("prompt"))


_ORACLE = facts.ORACLE_SQL["agg_symbols"]
QUERIES = {
    "plan_analyze": lambda s, d: analyze(table(s, d, "code_entries")),
    "plan_preprocess": lambda s, d: preprocess(table(s, d, "file_mappings")),
    "plan_schedule": lambda s, d: schedule(table(s, d, "relation_files")),
    "plan_prompts": lambda s, d: file_prompts(table(s, d, "code_entries"), table(s, d, "conversion_results")),
}
ORACLE_SQL = {
    "plan_preprocess": f"""SELECT c.group_key, c.path, c.category, p.header_path FROM ({paths.ORACLE_SQL["set_pairing"]}) c LEFT JOIN ({paths.ORACLE_SQL["join_pair_headers"]}) p ON p.group_key = c.group_key AND p.source_path = c.path""",
    "plan_prompts": f"""WITH q AS (SELECT source_id AS id, arg_max(converted_code, (created_at, id)) AS prior FROM conversion_results WHERE status = 'success' GROUP BY source_id),
        x AS (SELECT e.id, coalesce(file_path, 'unknown') AS f, array_to_string({facts._all(C.C_FUNCTION)}, ', ') AS fs, array_to_string({facts._all(C.INCLUDE_LOOSE)}, ', ') AS i,
            array_to_string(list_filter({facts._all(C.CALL_NAME)}, lambda n, k: list_position({facts._all(C.CALL_NAME)}, n) = k AND NOT {facts._SYS.format("n")}), ', ') AS cs, coalesce(q.prior, '') AS p FROM code_entries e LEFT JOIN q ON q.id = e.id WHERE code IS NOT NULL)
        SELECT id, concat_ws(chr(10) || chr(10), '## File' || chr(10) || nullif(f, ''), '## Functions' || chr(10) || nullif(fs, ''), '## Includes' || chr(10) || nullif(i, ''), '## Calls' || chr(10) || nullif(cs, ''),
            '## Earlier' || chr(10) || nullif(p, ''), '## Guide' || chr(10) || 'Convert to safe code.') AS prompt FROM x""",
    "plan_schedule": graph.ORACLE_SQL["graph_levels"],
    "plan_analyze": f"""SELECT s.*, c.complexity, ceil(length(e.code) / 2.5::DOUBLE)::BIGINT AS n_tokens FROM ({_ORACLE}) s JOIN ({facts.ORACLE_SQL["fn_complexity"]}) c USING (id) JOIN code_entries e USING (id)""".replace("s.*", "s.id, n_functions, n_types, n_macros, n_includes"),
}
