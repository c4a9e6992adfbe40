"""Facts of code: names, calls, signatures, counts and ordered summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import code as C
from millrace.runtime import table


def call_edges(entries: DataFrame) -> DataFrame:
    """caller (id), callee: each name called in an entry, without system names."""
    calls = entries.select(F.col("id").alias("caller"), F.explode(C.distinct_names(F.col("code"), C.CALL_NAME)).alias("callee"))
    return calls.where(~C.is_system_name(F.col("callee")))


def important_functions(functions: DataFrame) -> DataFrame:
    """No reserved prefix, up to five parameters, no pointer to a function returned."""
    return functions.where(~F.startswith("name", F.lit("__")) & (F.size("parameters") <= 5) & ~F.contains(F.coalesce("return_type", F.lit("")), F.lit("(*")))


def with_parameter_type(functions: DataFrame, part: str) -> DataFrame:
    return functions.where(F.exists("parameters", lambda p: F.contains(p["type"], F.lit(part))))


def returning(functions: DataFrame, part: str) -> DataFrame:
    return functions.where(F.contains("return_type", F.lit(part)))


def symbol_counts(entries: DataFrame) -> DataFrame:
    """id, n_functions, n_types, n_macros, n_includes of each entry."""
    code = F.col("code")
    return entries.where("code IS NOT NULL").select(
        "id",
        F.size(C.all_names(code, C.C_FUNCTION)).alias("n_functions"),
        F.size(C.all_names(code, C.TYPE_NAME)).alias("n_types"),
        F.size(C.all_names(code, C.MACRO_NAME)).alias("n_macros"),
        F.size(C.all_names(code, C.INCLUDE_LOOSE)).alias("n_includes"),
    )


def source_profile(entries: DataFrame) -> DataFrame:
    """id, functions, includes, complexity, related (up to five names of the project that hold the entry's name)."""
    code = F.col("code")
    base = entries.where("code IS NOT NULL").select("id", "project", "function_name", C.all_names(code, C.C_FUNCTION).alias("functions"), C.all_names(code, C.INCLUDE_LOOSE).alias("includes"), F.round(C.complexity(code), 4).alias("complexity"))
    names = entries.where("function_name <> '' AND project IS NOT NULL").select("project", F.lower("function_name").alias("key"), F.col("id").alias("related"))
    w = Window.partitionBy("project", "key").orderBy("related")
    five = names.withColumn("rn", F.row_number().over(w)).where("rn <= 5").groupBy("project", "key").agg(F.array_sort(F.collect_list("related")).alias("related"))
    keyed = base.withColumn("key", F.lower("function_name"))
    return keyed.join(five, ["project", "key"], "left").select("id", "functions", "includes", "complexity", "related")


def include_lists(entries: DataFrame) -> DataFrame:
    """file_path, includes: sorted set of everything a file's entries include."""
    return entries.where("file_path IS NOT NULL").select("file_path", F.explode(C.all_names(F.col("code"), C.INCLUDE_ANCHORED, 2)).alias("include")).groupBy("file_path").agg(F.array_sort(F.collect_set("include")).alias("includes"))


def top_called(entries: DataFrame, k: int = 20) -> DataFrame:
    return call_edges(entries).groupBy("callee").agg(F.count("*").alias("n_callers")).orderBy(F.desc("n_callers"), "callee").limit(k)


def top_complex(entries: DataFrame, k: int = 20) -> DataFrame:
    scored = entries.where("code IS NOT NULL").select("id", F.round(C.complexity(F.col("code")), 4).alias("complexity"))
    return scored.orderBy(F.desc("complexity"), "id").limit(k)


def dependency_union(translations: DataFrame) -> DataFrame:
    """dependency, n_records: each declared dependency once, with the constant version."""
    return translations.select(F.explode("cargo_dependencies").alias("dependency")).groupBy("dependency").agg(F.count("*").alias("n_records")).select("dependency", F.lit("*").alias("version"), "n_records")


def project_report(entries: DataFrame) -> DataFrame:
    """project, report: one line of text about each project, languages in order of their names."""
    counts = entries.groupBy("project", F.lower(F.trim("language")).alias("language")).agg(F.count("*").alias("n"))
    parts = F.array_sort(F.collect_list(F.struct("language", "n")))
    text = F.array_join(F.transform(parts, lambda p: F.concat(p["language"], F.lit("="), p["n"].cast("string"))), ", ")
    return counts.groupBy("project").agg(parts.alias("p"), F.sum("n").alias("total")).select("project", F.concat(F.coalesce("project", F.lit("-")), F.lit(": "), F.col("total").cast("string"), F.lit(" entries; "), F.array_join(F.transform("p", lambda p: F.concat(p["language"], F.lit("="), p["n"].cast("string"))), ", ")).alias("report"))


def first_members(entries: DataFrame, n: int = 3) -> DataFrame:
    """id, shown, more: the first names of macros and how many follow."""
    macros = C.all_names(F.col("code"), C.MACRO_NAME)
    return entries.where("code IS NOT NULL").select("id", F.slice(macros, 1, n).alias("shown"), F.greatest(F.size(macros) - n, F.lit(0)).alias("more"))


def ordered_summary(entries: DataFrame) -> DataFrame:
    """file_path, names: a file's function names in order of id, joined by commas."""
    named = entries.where("function_name <> '' AND file_path IS NOT NULL").select("file_path", F.struct("id", "function_name").alias("x"))
    return named.groupBy("file_path").agg(F.array_sort(F.collect_list("x")).alias("l")).select("file_path", F.array_join(F.transform("l", lambda x: x["function_name"]), ", ").alias("names"))


def solution_title(text):
    """First heading of one or two marks, else a first line of 11 to 99 bytes, else a constant."""
    heading = F.regexp_extract(text, r"(?dm)^[ \t]*##? (.*)$", 1)
    first = F.trim(F.regexp_replace(F.split(text, "\n")[0], r"^[ \t\r]+|[ \t\r]+$", ""))
    size = F.octet_length(first)
    has = text.rlike(r"(?dm)^[ \t]*##? .*$")
    return F.when(has, F.regexp_replace(heading, r"[ \t\r]+$", "")).when((size > 10) & (size < 100), first).otherwise("Rust Error Solution")


def _e(s, d):
    return table(s, d, "code_entries")


_CODE = F.col


QUERIES = {
    "fn_c_functions": lambda s, d: _e(s, d).select("id", C.all_names(F.col("code"), C.C_FUNCTION).alias("names")),
    "fn_includes": lambda s, d: _e(s, d).select("id", C.all_names(F.col("code"), C.INCLUDE_ANCHORED, 2).alias("anchored"), C.all_names(F.col("code"), C.INCLUDE_LOOSE).alias("loose")),
    "fn_context_names": lambda s, d: _e(s, d).select("id", C.all_names(F.col("code"), C.TYPE_NAME).alias("types"), C.all_names(F.col("code"), C.MACRO_NAME).alias("macros")),
    "fn_calls": lambda s, d: table(s, d, "conversion_results").select("id", C.distinct_names(F.col("converted_code"), C.CALL_NAME).alias("calls")).distinct(),
    "fn_complexity": lambda s, d: _e(s, d).select("id", C.line_count(F.col("code")).cast("long").alias("n_lines"), F.round(C.complexity(F.col("code")), 4).alias("complexity")),
    "fn_target": lambda s, d: table(s, d, "conversion_results").select("id", C.rust_target(F.col("converted_code")).alias("rust_target"), C.c_target(F.col("original_code")).alias("c_target")).distinct(),
    "fn_solution_title": lambda s, d: table(s, d, "documents").where("text IS NOT NULL").select("doc_id", solution_title(F.col("text")).alias("title")),
    "filter_system_names": lambda s, d: _e(s, d).select(F.explode(C.distinct_names(F.col("code"), C.CALL_NAME)).alias("name")).distinct().select("name", C.is_system_name(F.col("name")).alias("is_system")),
    "filter_call_edges": lambda s, d: call_edges(_e(s, d)),
    "fn_function_facts": lambda s, d: C.function_facts(_e(s, d)).select("id", "language", "position", "name", "return_type", F.size("parameters").alias("n_parameters")),
    "fn_signatures": lambda s, d: C.function_facts(_e(s, d)).select("id", "language", "name", "line", C.signature(F.col("return_type"), F.col("name"), F.col("parameters")).alias("signature")),
    "fn_struct_facts": lambda s, d: C.struct_facts(_e(s, d)).select("id", "position", "name", F.size("members").alias("n_members")),
    "fn_symbol_facts": lambda s, d: C.symbol_facts(table(s, d, "translation_results"), "id", "rust_code"),
    "filter_important": lambda s, d: important_functions(C.function_facts(_e(s, d))).select("id", "position", "name"),
    "filter_parameter_type": lambda s, d: with_parameter_type(C.function_facts(_e(s, d)), "uint8_t").select("id", "position", "name"),
    "filter_return_type": lambda s, d: returning(C.function_facts(_e(s, d)), "char").select("id", "name", "return_type"),
    "agg_symbols": lambda s, d: symbol_counts(_e(s, d)),
    "agg_functions_by_language": lambda s, d: C.function_facts(_e(s, d)).groupBy("language").agg(F.count("*").alias("n_functions"), F.countDistinct("id").alias("n_entries")),
    "fn_profile": lambda s, d: source_profile(_e(s, d)),
    "set_includes": lambda s, d: include_lists(_e(s, d)),
    "top_called": lambda s, d: top_called(_e(s, d)),
    "top_complex": lambda s, d: top_complex(_e(s, d)),
    "agg_dependencies": lambda s, d: dependency_union(table(s, d, "translation_results")),
    "agg_report": lambda s, d: project_report(_e(s, d)),
    "top_first_members": lambda s, d: first_members(_e(s, d)),
    "agg_ordered_names": lambda s, d: ordered_summary(_e(s, d)),
}


def _all(pattern: str, group: int = 1, col: str = "code") -> str:
    return f"regexp_extract_all({col}, '{pattern.replace(chr(39), chr(39) * 2)}', {group})"


_LINES = "CASE WHEN {0} = '' THEN 0 ELSE length({0}) - length(replace({0}, chr(10), '')) + CASE WHEN ends_with({0}, chr(10)) THEN 0 ELSE 1 END END".format("code")
_WORDS = " + ".join(f"(length(code) - length(replace(code, '{w}', ''))) // {len(w)}" for w in C.COMPLEXITY_WORDS)
_COMPLEX = f"round(({_LINES} + len({_all(C.C_FUNCTION)}) * 2.0 + ({_WORDS}) * 1.5) / 10.0, 4)::DOUBLE"
_SYS = "(lower({0}) IN (" + ", ".join(f"'{x}'" for x in C.SYSTEM_NAMES) + ") OR " + " OR ".join(f"starts_with(lower({{0}}), '{p}')" for p in C.SYSTEM_PREFIXES) + ")"
_EDGES = f"SELECT caller, callee FROM (SELECT DISTINCT id AS caller, unnest({_all(C.CALL_NAME)}) AS callee FROM code_entries) WHERE NOT {_SYS.format('callee')}"
# functions of C texts (parentheses nest once there) and of Rust texts, written out
_C_HEAD = r"(\w+)((?:\s*\*)+\s*|\s+)(\w+)\s*\(((?:[^(){};]|\([^(){};]*\))*)\)\s*[{;]"
_RUST_HEAD = r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe|extern\s+\"[^\"]*\")\s+)*fn\s+(\w+)\s*(?:<[^>(]*>)?\s*\(([^)]*)\)\s*(?:->\s*([^{;]+?))?\s*(?:where[^{;]*)?[{;]"
_LANG = "CASE WHEN lower(trim(language)) IN ('c', 'c99', 'c11', 'c17', 'ansi c') THEN 'c' WHEN lower(trim(language)) IN ('cpp', 'c++', 'cxx', 'cc') THEN 'cpp' WHEN lower(trim(language)) IN ('rust', 'rs') THEN 'rust' END"
_FUNCTIONS = f"""WITH e AS (SELECT id, {_LANG} AS language, code FROM code_entries WHERE code IS NOT NULL),
    h AS (SELECT id, language, unnest(regexp_extract_all(code, '{_C_HEAD}', 1)) AS t, unnest(regexp_extract_all(code, '{_C_HEAD}', 2)) AS stars, unnest(regexp_extract_all(code, '{_C_HEAD}', 3)) AS name, unnest(regexp_extract_all(code, '{_C_HEAD}', 4)) AS ps, unnest(range(10000)) AS k FROM e WHERE language IN ('c', 'cpp')
        UNION ALL SELECT id, language, unnest(regexp_extract_all(code, '{_RUST_HEAD}', 3)), '', unnest(regexp_extract_all(code, '{_RUST_HEAD}', 1)), unnest(regexp_extract_all(code, '{_RUST_HEAD}', 2)), unnest(range(10000)) FROM e WHERE language = 'rust'),
    f AS (SELECT id, language, row_number() OVER (PARTITION BY id ORDER BY k)::INT AS position, name, CASE WHEN language = 'rust' THEN coalesce(nullif(trim(t), ''), '()') ELSE t || CASE WHEN contains(stars, '*') THEN ' ' || regexp_replace(stars, '\\s', '', 'g') ELSE '' END END AS return_type,
            list_filter(list_transform(string_split(CASE WHEN language = 'rust' THEN ps ELSE regexp_replace(ps, '\\([^()]*\\)', '', 'g') END, ','), lambda p: trim(p, ' ' || chr(9) || chr(10) || chr(13))), lambda p: p <> '' AND (p <> 'void' OR language = 'rust')) AS ps
        FROM h WHERE name IS NOT NULL AND (language = 'rust' OR (t NOT IN ('return', 'else', 'goto', 'case', 'sizeof') AND NOT regexp_full_match(t, '\\d+'))))"""
_STRUCT = r"\bstruct\s*(\w*)\s*\{((?:[^{}]|\{[^{}]*\})*)\}\s*(\w*)\s*;"
ORACLE_SQL = {
    "fn_function_facts": f"{_FUNCTIONS} SELECT id, language, position, name, return_type, len(ps)::INT AS n_parameters FROM f",
    "filter_important": f"{_FUNCTIONS} SELECT id, position, name FROM f WHERE NOT starts_with(name, '__') AND len(ps) <= 5 AND NOT contains(return_type, '(*')",
    "filter_return_type": f"{_FUNCTIONS} SELECT id, name, return_type FROM f WHERE contains(return_type, 'char')",
    "filter_parameter_type": f"{_FUNCTIONS} SELECT id, position, name FROM f WHERE len(list_filter(ps, lambda p: contains(CASE WHEN language = 'rust' THEN CASE WHEN contains(p, ':') THEN p[strpos(p, ':') + 1 :] ELSE 'Self' END ELSE CASE WHEN regexp_matches(p, '\\s') THEN regexp_replace(p, '\\s+\\S+$', '') ELSE p END END, 'uint8_t'))) > 0",
    "agg_functions_by_language": f"{_FUNCTIONS} SELECT language, count(*) AS n_functions, count(DISTINCT id) AS n_entries FROM f GROUP BY language",
    "fn_struct_facts": f"""SELECT id, row_number() OVER (PARTITION BY id ORDER BY k)::INT AS position, name, (length(body) - length(replace(body, ';', '')))::INT AS n_members FROM (SELECT id, k, coalesce(nullif(a, ''), nullif(z, '')) AS name, regexp_replace(regexp_replace(body, '(?s)//[^\\n]*|/\\*.*?\\*/', '', 'g'), '\\{{[^{{}}]*\\}}', '', 'g') AS body FROM
        (SELECT id, unnest(regexp_extract_all(code, '{_STRUCT}', 1)) AS a, unnest(regexp_extract_all(code, '{_STRUCT}', 2)) AS body, unnest(regexp_extract_all(code, '{_STRUCT}', 3)) AS z, unnest(range(10000)) AS k FROM code_entries WHERE {_LANG} IN ('c', 'cpp'))) WHERE name IS NOT NULL""",
    "fn_c_functions": f"SELECT id, {_all(C.C_FUNCTION)} AS names FROM code_entries",
    "fn_includes": f"SELECT id, {_all(C.INCLUDE_ANCHORED, 2)} AS anchored, {_all(C.INCLUDE_LOOSE)} AS loose FROM code_entries",
    "fn_context_names": f"SELECT id, {_all(C.TYPE_NAME)} AS types, {_all(C.MACRO_NAME)} AS macros FROM code_entries",
    "fn_calls": f"SELECT DISTINCT id, list_filter(l, lambda x, i: list_position(l, x) = i) AS calls FROM (SELECT id, {_all(C.CALL_NAME, 1, 'converted_code')} AS l FROM conversion_results)",
    "fn_complexity": f"SELECT id, ({_LINES})::BIGINT AS n_lines, {_COMPLEX} AS complexity FROM code_entries",
    "fn_target": """SELECT DISTINCT id, CASE WHEN contains(converted_code, 'fn main(') THEN 'bin' WHEN contains(converted_code, 'pub fn') OR contains(converted_code, 'pub struct') OR contains(converted_code, 'pub trait') THEN 'lib'
        ELSE 'bin' END AS rust_target, CASE WHEN contains(lower(original_code), 'main(') THEN 'bin' ELSE 'lib' END AS c_target FROM conversion_results""",
    "fn_solution_title": r"""SELECT doc_id, CASE WHEN regexp_matches(text, '(?m)^[ \t]*##? .*$') THEN regexp_replace(regexp_extract(text, '(?m)^[ \t]*##? (.*)$', 1), '[ \t\r]+$', '')
        WHEN strlen(f) > 10 AND strlen(f) < 100 THEN f ELSE 'Rust Error Solution' END AS title FROM (SELECT doc_id, text, regexp_replace(string_split(text, chr(10))[1], '^[ \t\r]+|[ \t\r]+$', '', 'g') AS f FROM documents WHERE text IS NOT NULL)""",
    "filter_system_names": f"SELECT name, {_SYS.format('name')} AS is_system FROM (SELECT DISTINCT unnest({_all(C.CALL_NAME)}) AS name FROM code_entries)",
    "filter_call_edges": _EDGES,
    "agg_symbols": f"SELECT id, len({_all(C.C_FUNCTION)})::INT AS n_functions, len({_all(C.TYPE_NAME)})::INT AS n_types, len({_all(C.MACRO_NAME)})::INT AS n_macros, len({_all(C.INCLUDE_LOOSE)})::INT AS n_includes FROM code_entries WHERE code IS NOT NULL",
    "fn_profile": f"""WITH n AS (SELECT project, lower(function_name) AS key, id, row_number() OVER (PARTITION BY project, lower(function_name) ORDER BY id) AS rn FROM code_entries WHERE function_name <> '' AND project IS NOT NULL),
        r AS (SELECT project, key, list(id ORDER BY id) AS related FROM n WHERE rn <= 5 GROUP BY ALL)
        SELECT e.id, {_all(C.C_FUNCTION)} AS functions, {_all(C.INCLUDE_LOOSE)} AS includes, {_COMPLEX} AS complexity, r.related FROM code_entries e LEFT JOIN r ON r.project = e.project AND r.key = lower(e.function_name) WHERE code IS NOT NULL""",
    "set_includes": f"SELECT file_path, list(DISTINCT include ORDER BY include) AS includes FROM (SELECT file_path, unnest({_all(C.INCLUDE_ANCHORED, 2)}) AS include FROM code_entries WHERE file_path IS NOT NULL) GROUP BY file_path",
    "top_called": f"SELECT callee, count(*) AS n_callers FROM ({_EDGES}) GROUP BY callee ORDER BY n_callers DESC, callee LIMIT 20",
    "top_complex": f"SELECT id, {_COMPLEX} AS complexity FROM code_entries ORDER BY complexity DESC, id LIMIT 20",
    "agg_dependencies": "SELECT dependency, '*' AS version, count(*) AS n_records FROM (SELECT unnest(cargo_dependencies) AS dependency FROM translation_results) GROUP BY dependency",
    "agg_report": """SELECT project, coalesce(project, '-') || ': ' || sum(n)::BIGINT || ' entries; ' || string_agg(language || '=' || n, ', ' ORDER BY language) AS report
        FROM (SELECT project, lower(trim(language)) AS language, count(*) AS n FROM code_entries GROUP BY ALL) GROUP BY project""",
    "top_first_members": f"SELECT id, {_all(C.MACRO_NAME)}[1:3] AS shown, greatest(len({_all(C.MACRO_NAME)}) - 3, 0)::INT AS more FROM code_entries WHERE code IS NOT NULL",
    "agg_ordered_names": "SELECT file_path, string_agg(function_name, ', ' ORDER BY id) AS names FROM code_entries WHERE function_name <> '' AND file_path IS NOT NULL GROUP BY file_path",
}
