"""Texts as sequences of 1-based lines: ranges, edits, context, diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import code as C
from millrace.operators.chunking import line_array
from millrace.runtime import table


def read_range(text: Column, first: int, last: int) -> Column:
    """Lines first to last; null where the text has fewer than ``last``."""
    lines = line_array(text)
    return F.when((F.lit(first) >= 1) & (F.lit(first) <= last) & (F.size(lines) >= last), F.array_join(F.slice(lines, first, last - first + 1), "\n"))


def replace_range(text: Column, first: int, last: int, new: str) -> Column:
    """Text with lines first to last replaced; null where the range is not in it.  A final line feed is lost."""
    lines = line_array(text)
    tail = F.slice(lines, last + 1, F.greatest(F.size(lines) - last, F.lit(0)))
    body = F.concat(F.slice(lines, 1, first - 1), F.split(F.lit(new), "\n"), tail)
    return F.when(F.size(lines) >= last, F.array_join(body, "\n"))


def insert_at(text: Column, at: int, new: str) -> Column:
    """Text with lines inserted before line ``at``; null where it has fewer than at - 1 lines."""
    lines = line_array(text)
    tail = F.slice(lines, at, F.greatest(F.size(lines) - at + 1, F.lit(0)))
    return F.when(F.size(lines) >= at - 1, F.array_join(F.concat(F.slice(lines, 1, at - 1), F.split(F.lit(new), "\n"), tail), "\n"))


def delete_range(text: Column, first: int, last: int) -> Column:
    lines = line_array(text)
    tail = F.slice(lines, last + 1, F.greatest(F.size(lines) - last, F.lit(0)))
    return F.when(F.size(lines) >= last, F.array_join(F.concat(F.slice(lines, 1, first - 1), tail), "\n"))


def add_dependency(manifest: Column, name: str, version: str) -> Column:
    """Manifest text with a dependency, unless it is there: under its section, or with a new one at the end."""
    entry = f'{name} = "{version}"'
    have = manifest.rlike(rf"(?dm)^\s*{name}\s*=")
    section = manifest.rlike(r"(?dm)^\[dependencies\]\s*$")
    return F.when(have, manifest).when(section, F.regexp_replace(manifest, r"(?dm)^(\[dependencies\][ \t\r]*)$", f"$1\n{entry}")).otherwise(F.concat(manifest, F.lit(f"\n[dependencies]\n{entry}\n")))


def key_errors(output: Column) -> Column:
    """Error headers and, once one was seen, place and bar lines; the whole output where there is no error."""
    lines = F.split(output, "\n", -1)
    empty = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("seen"))

    def step(acc, ln):
        head = F.contains(ln, F.lit("error[E")) | F.contains(ln, F.lit("error:"))
        place = F.trim(ln).startswith("-->") | F.trim(ln).startswith("|")
        return F.struct(F.when(head | (acc["seen"] & place), F.concat(acc["kept"], F.array(ln))).otherwise(acc["kept"]).alias("kept"), (acc["seen"] | head).alias("seen"))

    kept = F.aggregate(lines, empty, step)["kept"]
    return F.when(F.size(kept) > 0, F.array_join(kept, "\n")).otherwise(output)


def error_line(message: Column) -> Column:
    """Line number of the first ``:n:`` in a message; null without one."""
    return F.nullif(F.regexp_extract(message, C.ERROR_LINE, 1), F.lit("")).try_cast("int")


def around(text: Column, line: Column, context: int = 5) -> Column:
    """Numbered lines around a line, clipped to the text."""
    lines = line_array(text)
    first = F.greatest(line - context, F.lit(1))
    last = F.least(line + context, F.size(lines))
    picked = F.slice(lines, first, F.greatest(last - first + 1, F.lit(0)))
    return F.array_join(F.transform(picked, lambda x, i: F.concat(F.lpad((first + i).cast("string"), 4, " "), F.lit(": "), x)), "\n")


def error_location(rows: DataFrame, message: str, text: str, context: int = 3) -> DataFrame:
    """Rows with ``line``, the first place their message names, and ``context``, the numbered lines around it."""
    placed = rows.withColumn("line", error_line(F.col(message)))
    return placed.withColumn("context", F.when(F.col("line").isNotNull(), around(F.col(text), F.col("line"), context)))


def include_lines(entries: DataFrame) -> DataFrame:
    """id, line, include: where each include stands."""
    lines = entries.where("code IS NOT NULL").select("id", F.posexplode(line_array(F.col("code"))).alias("pos", "text"))
    found = lines.select("id", (F.col("pos") + 1).alias("line"), F.regexp_extract("text", r'^\s*#\s*include\s*[<"]([^>"]+)[>"]', 1).alias("include"))
    return found.where("include <> ''")


def next_starts(entries: DataFrame) -> DataFrame:
    """id, start_line, end_line of each one-line function head: a function ends before the next begins."""
    head = C.C_FUNCTION.replace("(?m)", "")
    lines = entries.where("code IS NOT NULL").select("id", F.size(line_array(F.col("code"))).alias("n"), F.posexplode(line_array(F.col("code"))).alias("pos", "text"))
    starts = lines.where(F.col("text").rlike(head)).select("id", "n", (F.col("pos") + 1).alias("start_line"))
    w = Window.partitionBy("id").orderBy("start_line")  # a group is one text
    return starts.select("id", "start_line", F.coalesce(F.lead("start_line").over(w) - 1, F.col("n")).alias("end_line"))


def recent(rows: DataFrame, key: str, order: str, tie: str, n: int = 3) -> DataFrame:
    """The last ``n`` rows of each key: key, tie, back (1 is the newest).

    The rank filter runs before the shuffle too, so a hot key sends n rows from each task.
    """
    w = Window.partitionBy(key).orderBy(F.col(order).desc_nulls_last(), F.col(tie).desc())
    return rows.select(key, tie, F.row_number().over(w).alias("back")).where(F.col("back") <= n)


def _code(s, d):
    return table(s, d, "code_entries").where("code IS NOT NULL")


QUERIES = {
    "line_read": lambda s, d: _code(s, d).select("id", read_range(F.col("code"), 2, 4).alias("text")),
    "line_replace": lambda s, d: _code(s, d).select("id", replace_range(F.col("code"), 2, 4, "first\nsecond").alias("text")),
    "line_insert": lambda s, d: _code(s, d).select("id", insert_at(F.col("code"), 2, "new line").alias("text")),
    "line_delete": lambda s, d: _code(s, d).select("id", delete_range(F.col("code"), 2, 4).alias("text")),
    "line_count": lambda s, d: _code(s, d).select("id", C.line_count(F.col("code")).cast("long").alias("n_lines")),
    "line_unnumbered": lambda s, d: _code(s, d).select("id", C.strip_line_numbers(C.numbered_lines(F.col("code"))).alias("text")),
    "line_around": lambda s, d: _code(s, d).select("id", around(F.col("code"), F.lit(10)).alias("context")),
    "line_error_location": lambda s, d: error_location(table(s, d, "conversion_results").dropDuplicates(["id"]).select("id", "original_code", F.concat(F.lit("src/x.rs:"), (F.length("original_code") % 40 + 1).cast("string"), F.lit(":5")).alias("m")), "m", "original_code").select("id", "line", "context"),
    "line_manifest": lambda s, d: table(s, d, "conversion_results").select("id", add_dependency(F.col("converted_code"), "libc", "0.2").alias("text")).distinct(),
    "window_includes": lambda s, d: include_lines(table(s, d, "code_entries")),
    "window_next_start": lambda s, d: next_starts(table(s, d, "code_entries")),
    "window_recent": lambda s, d: recent(table(s, d, "documents"), "source", "created_at", "doc_id"),
    "window_key_errors": lambda s, d: table(s, d, "conversion_results").where("error_message IS NOT NULL").select("id", key_errors(F.concat(F.lit("note\n --> a\n"), F.col("error_message"), F.lit("\n  --> b:12:3\n text\n | x"))).alias("text")).distinct(),
    "fn_error_line": lambda s, d: table(s, d, "conversion_results").select("id", error_line(F.concat(F.col("error_message"), F.lit(" --> src/a.rs:35:5"))).alias("line")).distinct(),
}
_L = "string_split(regexp_replace(code, '\\n\\z', ''), chr(10))"
_INCL = r"""'^\s*#\s*include\s*[<"]([^>"]+)[>"]'"""
ORACLE_SQL = {
    "line_read": f"SELECT id, CASE WHEN len(l) >= 4 THEN array_to_string(l[2:4], chr(10)) END AS text FROM (SELECT id, {_L} AS l FROM code_entries)",
    "line_replace": f"SELECT id, CASE WHEN len(l) >= 4 THEN array_to_string(l[1:1] || ['first', 'second'] || l[5:], chr(10)) END AS text FROM (SELECT id, {_L} AS l FROM code_entries)",
    "line_insert": f"SELECT id, array_to_string(l[1:1] || ['new line'] || l[2:], chr(10)) AS text FROM (SELECT id, {_L} AS l FROM code_entries)",
    "line_delete": f"SELECT id, CASE WHEN len(l) >= 4 THEN array_to_string(l[1:1] || l[5:], chr(10)) END AS text FROM (SELECT id, {_L} AS l FROM code_entries)",
    "line_count": "SELECT id, (CASE WHEN code = '' THEN 0 ELSE length(code) - length(replace(code, chr(10), '')) + CASE WHEN ends_with(code, chr(10)) THEN 0 ELSE 1 END END)::BIGINT AS n_lines FROM code_entries",
    "line_unnumbered": f"SELECT id, regexp_replace(regexp_replace(array_to_string(list_transform(range(1, len(l) + 1), lambda i: '   ' || i || ' ' || l[i]), chr(10)), '(?m)^\\s*\\d+\\s+', '', 'g'), '^\\s+|\\s+\\z', '', 'g') AS text FROM (SELECT id, string_split(code, chr(10)) AS l FROM code_entries WHERE code IS NOT NULL)",
    "line_error_location": "SELECT id, line, array_to_string(list_transform(range(greatest(line - 3, 1), least(line + 3, len(l)) + 1), lambda i: lpad(i::VARCHAR, 4, ' ') || ': ' || l[i]), chr(10)) AS context FROM (SELECT DISTINCT id, (length(original_code) % 40 + 1)::INT AS line, string_split(regexp_replace(original_code, '\\n\\z', ''), chr(10)) AS l FROM conversion_results)",
    "line_manifest": r"""SELECT DISTINCT id, CASE WHEN regexp_matches(converted_code, '(?m)^\s*libc\s*=') THEN converted_code WHEN regexp_matches(converted_code, '(?m)^\[dependencies\]\s*$') THEN regexp_replace(converted_code, '(?m)^(\[dependencies\][ \t\r]*)$', '\1' || chr(10) || 'libc = "0.2"', 'g')
        ELSE converted_code || chr(10) || '[dependencies]' || chr(10) || 'libc = "0.2"' || chr(10) END AS text FROM conversion_results""",
    "line_around": f"SELECT id, array_to_string(list_transform(range(5, least(15, len(l)) + 1), lambda i: lpad(i::VARCHAR, 4, ' ') || ': ' || l[i]), chr(10)) AS context FROM (SELECT id, {_L} AS l FROM code_entries)",
    "window_includes": f"SELECT id, line::INT AS line, regexp_extract(text, {_INCL}, 1) AS include FROM (SELECT id, unnest(l) AS text, unnest(range(1, len(l) + 1)) AS line FROM (SELECT id, {_L} AS l FROM code_entries)) WHERE regexp_extract(text, {_INCL}, 1) <> ''",
    "window_next_start": f"""SELECT id, line::INT AS start_line, coalesce(lead(line) OVER (PARTITION BY id ORDER BY line) - 1, n)::INT AS end_line FROM (SELECT id, len(l) AS n, unnest(l) AS text, unnest(range(1, len(l) + 1)) AS line
        FROM (SELECT id, {_L} AS l FROM code_entries)) WHERE regexp_matches(text, '{C.C_FUNCTION.replace("(?m)", "")}')""",
    "window_recent": "SELECT source, doc_id, back FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY created_at DESC NULLS LAST, doc_id DESC)::INT AS back FROM documents) WHERE back <= 3",
    "window_key_errors": """SELECT DISTINCT id, CASE WHEN contains(error_message, 'error[E') OR contains(error_message, 'error:') THEN error_message || chr(10) || '  --> b:12:3' || chr(10) || ' | x'
        ELSE 'note' || chr(10) || ' --> a' || chr(10) || error_message || chr(10) || '  --> b:12:3' || chr(10) || ' text' || chr(10) || ' | x' END AS text FROM conversion_results WHERE error_message IS NOT NULL""",
    "fn_error_line": "SELECT DISTINCT id, try_cast(nullif(regexp_extract(error_message || ' --> src/a.rs:35:5', ':(\\d+):', 1), '') AS INT) AS line FROM conversion_results",
}
