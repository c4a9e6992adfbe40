"""Compiler messages and answers about them: codes, categories, scores, keywords, sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import code as C
from millrace.operators.web import _first_of, has
from millrace.runtime import table

#: Error codes and texts with the category they stand for, in order.
CODE_CATEGORIES = {"E0382": "ownership", "E0277": "trait_bound", "E0621": "lifetime", "E0308": "type_mismatch", "E0499": "borrow_checker", "E0425": "undefined_identifier"}
TEXT_CATEGORIES = [("moved", "ownership"), ("ownership", "ownership"), ("trait", "trait_bound"), ("bound", "trait_bound"), ("lifetime", "lifetime")]
#: Phrases that make a message recognisable.
KNOWN_PHRASES = ["move occurs because", "trait bound", "lifetime", "cannot borrow", "type mismatch", "cannot find", "use of moved value"]
#: Parts of a keyword and its category, in order.
KEYWORD_CATEGORIES = [
    ("trait", ["trait", "send", "sync", "display", "debug", "clone", "copy"]),
    ("concept", ["ownership", "borrow", "lifetime", "move", "reference"]),
    ("solution", ["fix", "solve", "solution", "resolve", "how to"]),
    ("library", ["tokio", "async", "await", "std", "vec", "string"]),
]
#: Technical terms with category and relevance.
TERMS = [
    ("E0382", "error_code", 1.0), ("E0277", "error_code", 1.0), ("E0621", "error_code", 1.0), ("ownership", "concept", 0.9), ("borrow checker", "concept", 0.9), ("lifetime", "concept", 0.9),
    ("trait bound", "trait", 0.9), ("Send trait", "trait", 0.8), ("Display trait", "trait", 0.8), ("move semantics", "concept", 0.8), ("Rust error", "general", 0.7), ("compilation error", "general", 0.7),
]
#: Parts of a solution's text and the kind of fix, in order.
FIX_TYPES = [("cargo", "DependencyUpdate"), ("dependency", "DependencyUpdate"), ("rustc", "CompilerFlag"), ("flag", "CompilerFlag"), ("config", "Configuration"), ("toml", "Configuration"), ("refactor", "Architecture"), ("redesign", "Architecture")]
RESOURCE_TYPES = [("doc.rust-lang.org", "OfficialDoc"), ("stackoverflow.com", "StackOverflow"), ("blog", "BlogPost")]


def any_of(text: Column, parts: list[str]) -> Column:
    hit = F.lit(False)
    for p in parts:
        hit = hit | has(text, p)
    return hit


def error_code(message: Column) -> Column:
    return F.nullif(F.regexp_extract(message, r"error\[(E\d{4})\]", 1), F.lit(""))


def error_category(message: Column) -> Column:
    code, low = error_code(message), F.lower(message)
    by_text = _first_of([(has(low, p), c) for p, c in TEXT_CATEGORIES] + [(has(low, "type") & has(low, "mismatch"), "type_mismatch"), (has(low, "borrow"), "borrow_checker")], "unknown")
    return _first_of([(F.coalesce(code, F.lit("")) == k, v) for k, v in CODE_CATEGORIES.items()], by_text)


def error_confidence(message: Column) -> Column:
    """0.5, and 0.3 for a code, 0.2 for a place with a bar, 0.1 for a known phrase; up to 1."""
    points = F.lit(0.5) + F.when(error_code(message).isNotNull(), 0.3).otherwise(0.0) + F.when(has(message, "-->") & has(message, "|"), 0.2).otherwise(0.0) + F.when(any_of(F.lower(message), KNOWN_PHRASES), 0.1).otherwise(0.0)
    return F.round(F.least(points, F.lit(1.0)), 4)


def keyword_category(word: Column) -> Column:
    low = F.lower(word)
    return _first_of([(F.startswith(low, F.lit("e0")) | has(low, "error["), "error_code")] + [(any_of(low, parts), c) for c, parts in KEYWORD_CATEGORIES], "general")


def keyword_relevance(word: Column) -> Column:
    low = F.lower(word)
    points = F.lit(0.7) + F.when(F.startswith(low, F.lit("e0")), 0.3).otherwise(0.0) + F.when(any_of(low, ["ownership", "borrow", "lifetime", "trait"]), 0.2).otherwise(0.0) + F.when(any_of(low, ["fix", "solve", "solution"]), 0.1).otherwise(0.0) - F.when(F.octet_length(word) > 50, 0.2).otherwise(0.0)
    return F.round(F.greatest(F.least(points, F.lit(1.0)), F.lit(0.1)), 4)


def technical_terms(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, keyword, category, relevance of each term a text holds, whatever the case."""
    terms = F.array(*(F.struct(F.lit(t).alias("keyword"), F.lit(c).alias("category"), F.lit(r).alias("relevance")) for t, c, r in TERMS))
    low = F.lower(text_col)
    held = F.filter(terms, lambda t: F.contains(low, F.lower(t["keyword"])))
    return df.where(F.col(text_col).isNotNull()).select(F.col(id_col), F.explode(held).alias("t")).select(id_col, "t.*")


def parse_keywords(df: DataFrame, id_col: str, text_col: str, most: int = 10) -> DataFrame:
    """id, position, keyword, category, relevance of an answer about keywords.

    Lines ``keyword|category|relevance``; without any, quoted phrases of over three
    bytes; without any, technical terms; without any, a constant.  Each keyword
    once, best first, ties by keyword.
    """
    base = df.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("t"))
    lines = F.filter(F.transform(F.split("t", "\n"), F.trim), lambda x: x.rlike(r"^[^|]*\|[^|]*\|") & ~x.rlike(r"^(?:#|//)"))
    kind = "array<struct<keyword: string, category: string, relevance: double>>"

    def row(keyword, category, relevance):
        return F.struct(keyword.alias("keyword"), category.alias("category"), relevance.cast("double").alias("relevance"))

    def structured(x):
        word = F.regexp_replace(F.regexp_replace(F.trim(F.split_part(x, F.lit("|"), F.lit(1))), r'^"+|"+$', ""), r"^`+|`+$", "")
        return row(word, F.trim(F.split_part(x, F.lit("|"), F.lit(2))), F.coalesce(F.trim(F.regexp_replace(x, r"^[^|]*\|[^|]*\|", "")).try_cast("double"), F.lit(1.0)))

    one = F.filter(F.transform(lines, structured), lambda r: r["keyword"] != "")
    quoted = F.concat(F.regexp_extract_all("t", F.lit(r'"([^"]+)"'), F.lit(1)), F.regexp_extract_all("t", F.lit(r"`([^`]+)`"), F.lit(1)))
    two = F.transform(F.filter(F.transform(quoted, F.trim), lambda x: F.octet_length(x) > 3), lambda x: row(x, keyword_category(x), keyword_relevance(x)))
    terms = F.array(*(F.struct(F.lit(t).alias("keyword"), F.lit(c).alias("category"), F.lit(r).alias("relevance")) for t, c, r in TERMS))
    three = F.filter(terms, lambda t: F.contains(F.lower("t"), F.lower(t["keyword"])))
    four = F.array(row(F.lit("Rust compilation error"), F.lit("fallback"), F.lit(0.5)))
    chosen = F.coalesce(*(F.when(F.size(x) > 0, x.cast(kind)) for x in (one, two, three, four)))
    w = Window.partitionBy("id", "keyword").orderBy("pos")
    rows = base.select("id", F.posexplode(chosen).alias("pos", "k")).select("id", "pos", "k.*").withColumn("rn", F.row_number().over(w)).where("rn = 1")
    best = Window.partitionBy("id").orderBy(F.desc("relevance"), "keyword")
    return rows.withColumn("position", F.row_number().over(best)).where(F.col("position") <= most).select("id", "position", "keyword", "category", "relevance")


def search_query(keywords: DataFrame) -> DataFrame:
    """id, query: the five best keywords, quoted where their category asks for it."""
    quoted = F.concat(F.lit('"'), F.col("keyword"), F.lit('"'))
    part = F.when(F.col("category") == "error_code", quoted).when(F.col("category") == "solution", F.concat(quoted, F.lit(" solution"))).otherwise(F.col("keyword"))
    top = keywords.where("position <= 5").select("id", F.struct("position", part.alias("part")).alias("p"))
    return top.groupBy("id").agg(F.array_sort(F.collect_list("p")).alias("ps")).select("id", F.array_join(F.transform("ps", lambda p: p["part"]), " ").alias("query"))


def fix_type(text: Column) -> Column:
    low = F.lower(text)
    return _first_of([(has(low, p), k) for p, k in FIX_TYPES], "CodeChange")


def difficulty(score: Column) -> Column:
    return F.when(score > 0.8, "Beginner").when(score > 0.6, "Intermediate").otherwise("Advanced")


def resource_type(url: Column) -> Column:
    return _first_of([(has(url, p), k) for p, k in RESOURCE_TYPES], "Tutorial")


def confidence_level(mean: Column) -> Column:
    return F.when(mean >= 0.9, "VeryHigh").when(mean >= 0.7, "High").when(mean >= 0.5, "Medium").otherwise("Low")


def mean_confidence(df: DataFrame, key: str, score: str) -> DataFrame:
    """key, mean, level; 0 where no score is known."""
    g = df.groupBy(key).agg(F.coalesce(F.round(F.avg(score), 6), F.lit(0.0)).alias("mean"))
    return g.select(key, "mean", confidence_level(F.col("mean")).alias("level"))


def answer_scores(text: Column) -> Column:
    """confidence and relevance that a text states, clamped to [0, 1]; 0.7 and 0.8 where it does not."""

    def stated(name: str, default: float):
        got = F.nullif(F.regexp_extract(text, rf"(?i){name}[:\s]*([0-9]*\.?[0-9]+)", 1), F.lit("")).try_cast("double")
        return F.coalesce(F.greatest(F.least(got, F.lit(1.0)), F.lit(0.0)), F.lit(default))

    return F.struct(stated("confidence", 0.7).alias("confidence"), stated("relevance", 0.8).alias("relevance"))


def sections(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, section_no, heading, content: a text cut at headings of one or two marks; what stands before the first has none."""
    text = F.concat(F.lit("\n"), F.col(text_col))
    parts = F.split(text, r"\n[ \t]*(?=##? )", -1)
    rows = df.where(F.col(text_col).isNotNull()).select(F.col(id_col), F.posexplode(parts).alias("section_no", "part"))
    heading = F.when(F.col("section_no") > 0, F.trim(F.regexp_replace(F.split_part("part", F.lit("\n"), F.lit(1)), "\r", "")))
    content = F.when(F.col("section_no") > 0, F.regexp_replace("part", r"^[^\n]*\n?", "")).otherwise(F.regexp_replace("part", r"^\n", ""))
    return rows.select(id_col, "section_no", heading.alias("heading"), content.alias("content")).where("section_no > 0 OR content <> ''")


def rust_code_of(response: Column) -> Column:
    """Rust code of an answer: member of a JSON object, of a chat envelope, of fenced JSON; a fenced block; else the text itself."""
    trimmed = F.trim(response)
    unfenced = F.trim(F.regexp_replace(F.regexp_replace(trimmed, r"^```(?:json)?", ""), r"```\z", ""))
    fenced = F.nullif(F.regexp_extract(response, r"(?s)```rust\n?(.*?)\n```", 1), F.lit(""))
    generic = F.nullif(F.regexp_extract(response, r"(?s)```\w*\n(.*?)\n```", 1), F.lit(""))
    partial = F.nullif(F.regexp_extract(response, r'(?s)"rust_code"\s*:\s*"((?:[^"\\]|\\.)*)', 1), F.lit(""))
    unescaped = F.replace(F.replace(F.replace(F.replace(partial, F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t")), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    return F.coalesce(F.get_json_object(trimmed, "$.rust_code"), F.get_json_object(trimmed, "$.choices[0].message.content"), F.get_json_object(unfenced, "$.rust_code"), fenced, unescaped, generic, response)


def answer_json(response: Column) -> Column:
    """What of an answer may be JSON: a fenced block of JSON, else all of it; without line numbers."""
    fenced = F.regexp_extract(response, r"(?s)```json(.*?)```", 1)
    return C.strip_line_numbers(F.when(response.rlike(r"(?s)```json.*?```"), fenced).otherwise(response))


def answer_confidence(response: Column) -> Column:
    """0.8 for an answer that is JSON of any kind, fenced or not; 0.6 for one in another form."""
    return F.when(F.try_parse_json(answer_json(response)).isNotNull(), 0.8).otherwise(0.6)


def _conv(s, d):
    return table(s, d, "conversion_results").dropDuplicates(["id"])


_MSG = F.col


def _keywords(s, d):
    return parse_keywords(_conv(s, d).where("error_message IS NOT NULL").select("id", F.concat(F.lit('"'), F.col("error_message"), F.lit('" and `E0382 moved`')).alias("t")), "id", "t")


QUERIES = {
    "error_codes": lambda s, d: _conv(s, d).where("error_message IS NOT NULL").select("id", error_code(F.col("error_message")).alias("code"), error_category(F.col("error_message")).alias("category"), error_confidence(F.col("error_message")).alias("confidence")),
    "error_terms": lambda s, d: technical_terms(table(s, d, "documents"), "doc_id", "text"),
    "error_keyword_scores": lambda s, d: table(s, d, "code_entries").where("function_name <> ''").select(F.col("function_name").alias("keyword")).distinct().select("keyword", keyword_category(F.col("keyword")).alias("category"), keyword_relevance(F.col("keyword")).alias("relevance")),
    "error_keywords": _keywords,
    "error_search_query": lambda s, d: search_query(_keywords(s, d)),
    "error_fix_types": lambda s, d: table(s, d, "documents").where("text IS NOT NULL").select("doc_id", fix_type(F.col("text")).alias("fix_type"), answer_scores(F.col("text"))["confidence"].alias("confidence"), difficulty(answer_scores(F.col("text"))["confidence"]).alias("difficulty")),
    "error_resources": lambda s, d: table(s, d, "web_pages").select("page_id", resource_type(F.coalesce("url", F.lit(""))).alias("resource_type")),
    "error_sections": lambda s, d: sections(table(s, d, "documents"), "doc_id", "text"),
    "agg_confidence": lambda s, d: mean_confidence(table(s, d, "translation_results"), "compilation_status", "confidence_score"),
    "json_answers": lambda s, d: _conv(s, d).select("id", rust_code_of(F.col("converted_code")).alias("rust_code"), answer_confidence(F.col("converted_code")).alias("confidence")),
}


def _any(col: str, parts) -> str:
    return "(" + " OR ".join(f"contains(lower({col}), '{p}')" for p in parts) + ")"


def _case(col: str, rules, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({col}), '{p}') THEN '{v}'" for p, v in rules) + f" ELSE '{otherwise}' END"


_CODE = "nullif(regexp_extract(error_message, 'error\\[(E\\d{4})\\]', 1), '')"
_D = "(SELECT DISTINCT ON (id) * FROM conversion_results)"
_CONF = "nullif(regexp_extract(text, '(?i)confidence[:\\s]*([0-9]*\\.?[0-9]+)', 1), '')"
_STATED = f"coalesce(greatest(least(try_cast({_CONF} AS DOUBLE), 1.0), 0.0), 0.7)::DOUBLE"
ORACLE_SQL = {
    "error_codes": f"""SELECT id, {_CODE} AS code, CASE {' '.join(f"WHEN {_CODE} = '{k}' THEN '{v}'" for k, v in CODE_CATEGORIES.items())} {' '.join(f"WHEN contains(lower(error_message), '{p}') THEN '{v}'" for p, v in TEXT_CATEGORIES)}
        WHEN contains(lower(error_message), 'type') AND contains(lower(error_message), 'mismatch') THEN 'type_mismatch' WHEN contains(lower(error_message), 'borrow') THEN 'borrow_checker' ELSE 'unknown' END AS category,
        round(least(0.5 + CASE WHEN {_CODE} IS NOT NULL THEN 0.3 ELSE 0 END + CASE WHEN contains(error_message, '-->') AND contains(error_message, '|') THEN 0.2 ELSE 0 END + CASE WHEN {_any('error_message', KNOWN_PHRASES)} THEN 0.1 ELSE 0 END, 1.0), 4)::DOUBLE AS confidence
        FROM {_D} WHERE error_message IS NOT NULL""",
    "error_terms": " UNION ALL ".join(f"SELECT doc_id, '{t}' AS keyword, '{c}' AS category, {r}::DOUBLE AS relevance FROM documents WHERE contains(lower(text), '{t.lower()}')" for t, c, r in TERMS),
    "error_keyword_scores": f"""SELECT keyword, CASE WHEN starts_with(lower(keyword), 'e0') OR contains(lower(keyword), 'error[') THEN 'error_code' {' '.join(f"WHEN {_any('keyword', ps)} THEN '{c}'" for c, ps in KEYWORD_CATEGORIES)} ELSE 'general' END AS category,
        round(greatest(least(0.7 + CASE WHEN starts_with(lower(keyword), 'e0') THEN 0.3 ELSE 0 END + CASE WHEN {_any('keyword', ['ownership', 'borrow', 'lifetime', 'trait'])} THEN 0.2 ELSE 0 END + CASE WHEN {_any('keyword', ['fix', 'solve', 'solution'])} THEN 0.1 ELSE 0 END
        - CASE WHEN strlen(keyword) > 50 THEN 0.2 ELSE 0 END, 1.0), 0.1), 4)::DOUBLE AS relevance FROM (SELECT DISTINCT function_name AS keyword FROM code_entries WHERE function_name <> '')""",
    "error_fix_types": f"""SELECT doc_id, {_case('text', FIX_TYPES, 'CodeChange')} AS fix_type, {_STATED} AS confidence, CASE WHEN {_STATED} > 0.8 THEN 'Beginner' WHEN {_STATED} > 0.6 THEN 'Intermediate' ELSE 'Advanced' END AS difficulty FROM documents WHERE text IS NOT NULL""",
    "error_resources": "SELECT page_id, " + "CASE " + " ".join(f"WHEN contains(coalesce(url, ''), '{p}') THEN '{v}'" for p, v in RESOURCE_TYPES) + " ELSE 'Tutorial' END AS resource_type FROM web_pages",
    "agg_confidence": """SELECT compilation_status, mean, CASE WHEN mean >= 0.9 THEN 'VeryHigh' WHEN mean >= 0.7 THEN 'High' WHEN mean >= 0.5 THEN 'Medium' ELSE 'Low' END AS level
        FROM (SELECT compilation_status, coalesce(round(avg(confidence_score::DOUBLE), 6), 0.0)::DOUBLE AS mean FROM translation_results GROUP BY 1)""",
    "error_sections": r"""WITH l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
        n AS (SELECT doc_id, pos, line, regexp_matches(line, '^[ \t]*##? ') AS head, sum(regexp_matches(line, '^[ \t]*##? ')::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM l)
        SELECT * FROM (SELECT doc_id, section::INT AS section_no, max(CASE WHEN head THEN trim(replace(regexp_replace(line, '^[ \t]*', ''), chr(13), '')) END) AS heading, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT head), '') AS content
        FROM n GROUP BY doc_id, section) WHERE section_no > 0 OR content <> ''""",
    "json_answers": r"""WITH a AS (SELECT id, converted_code AS r, trim(converted_code) AS t, trim(regexp_replace(regexp_replace(trim(converted_code), '^```(?:json)?', ''), '```\z', '')) AS u FROM (SELECT DISTINCT ON (id) * FROM conversion_results))
        SELECT id, coalesce(CASE WHEN json_valid(t) THEN t->>'$.rust_code' END, CASE WHEN json_valid(t) THEN t->>'$.choices[0].message.content' END, CASE WHEN json_valid(u) THEN u->>'$.rust_code' END,
            nullif(regexp_extract(r, '(?s)```rust\n?(.*?)\n```', 1), ''), replace(replace(replace(replace(nullif(regexp_extract(r, '(?s)"rust_code"\s*:\s*"((?:[^"\\]|\\.)*)', 1), ''), '\n', chr(10)), '\t', chr(9)), '\"', '"'), '\\', '\'),
            nullif(regexp_extract(r, '(?s)```\w*\n(.*?)\n```', 1), ''), r) AS rust_code, CASE WHEN json_valid(regexp_replace(regexp_replace(CASE WHEN regexp_matches(r, '(?s)```json.*?```') THEN regexp_extract(r, '(?s)```json(.*?)```', 1) ELSE r END, '(?m)^\s*\d+\s+', '', 'g'), '^\s+|\s+\z', '', 'g')) THEN 0.8 ELSE 0.6 END::DOUBLE AS confidence FROM a""",
}
_CATEGORY = f"""CASE WHEN starts_with(lower(keyword), 'e0') OR contains(lower(keyword), 'error[') THEN 'error_code' {' '.join(f"WHEN {_any('keyword', ps)} THEN '{c}'" for c, ps in KEYWORD_CATEGORIES)} ELSE 'general' END"""
_RELEVANCE = f"""round(greatest(least(0.7 + CASE WHEN starts_with(lower(keyword), 'e0') THEN 0.3 ELSE 0 END + CASE WHEN {_any('keyword', ['ownership', 'borrow', 'lifetime', 'trait'])} THEN 0.2 ELSE 0 END + CASE WHEN {_any('keyword', ['fix', 'solve', 'solution'])} THEN 0.1 ELSE 0 END
    - CASE WHEN strlen(keyword) > 50 THEN 0.2 ELSE 0 END, 1.0), 0.1), 4)::DOUBLE"""
_KEYWORDS = rf"""WITH b AS (SELECT DISTINCT id, '"' || error_message || '" and `E0382 moved`' AS t FROM conversion_results WHERE error_message IS NOT NULL),
    l AS (SELECT id, trim(unnest(string_split(t, chr(10)))) AS x, unnest(range(10000)) AS pos FROM b),
    o AS (SELECT id, pos, regexp_replace(regexp_replace(trim(split_part(x, '|', 1)), '^"+|"+$', '', 'g'), '^`+|`+$', '', 'g') AS keyword, trim(split_part(x, '|', 2)) AS category, coalesce(try_cast(trim(regexp_replace(x, '^[^|]*\|[^|]*\|', '')) AS DOUBLE), 1.0) AS relevance
        FROM l WHERE regexp_matches(x, '^[^|]*\|[^|]*\|') AND NOT regexp_matches(x, '^(#|//)')),
    q AS (SELECT id, trim(unnest(regexp_extract_all(t, '"([^"]+)"', 1) || regexp_extract_all(t, '`([^`]+)`', 1))) AS keyword, unnest(range(10000)) AS pos FROM b),
    k AS (SELECT id, pos, keyword, category, relevance FROM o WHERE keyword <> '' UNION ALL SELECT id, pos, keyword, {_CATEGORY}, {_RELEVANCE} FROM q WHERE strlen(keyword) > 3 AND id NOT IN (SELECT id FROM o WHERE keyword <> '')),
    f AS (SELECT *, row_number() OVER (PARTITION BY id, keyword ORDER BY pos) AS rn FROM k),
    p AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY relevance DESC, keyword)::INT AS position, keyword, category, relevance FROM f WHERE rn = 1)"""
ORACLE_SQL |= {
    "error_keywords": f"{_KEYWORDS} SELECT * FROM p WHERE position <= 10",
    "error_search_query": f"""{_KEYWORDS} SELECT id, string_agg(CASE WHEN category = 'error_code' THEN '"' || keyword || '"' WHEN category = 'solution' THEN '"' || keyword || '" solution' ELSE keyword END, ' ' ORDER BY position) AS query FROM p WHERE position <= 5 GROUP BY id""",
}
