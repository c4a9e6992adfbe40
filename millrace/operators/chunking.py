"""Token estimates, chunking of texts and merging of chunk results."""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import code as C
from millrace.runtime import materialise, sliced, table

#: Characters a token is taken to have, tokens kept for answers, and the sizes from which texts are chunked.
CHARS_PER_TOKEN, RESERVED, REQUEST_LIMIT, AGENT_LIMIT = 2.5, 1000, 100_000, 80_000
BOUNDARY = "\n\n--- chunk boundary ---\n\n"


def token_estimate(text: Column) -> Column:
    return F.ceil(F.char_length(text) / F.lit(CHARS_PER_TOKEN)).cast("long")


def estimate(text: str) -> int:
    return math.ceil(len(text) / CHARS_PER_TOKEN)


def _lines(text: str) -> list[str]:
    """Lines between line feeds, without carriage returns; none after a last line feed."""
    parts = text.split("\n")
    if parts[-1] == "":
        parts.pop()
    return [p[:-1] if p.endswith("\r") else p for p in parts]


def split_long_line(line: str, most: int) -> list[str]:
    """Pieces of up to twice ``most`` bytes, cut between words; a longer word is cut anywhere."""
    room = max(1, most * 2)
    if len(line.encode()) <= room:
        return [line]
    out: list[str] = []
    cur = ""
    for word in line.split():
        if len(word.encode()) > room:
            out += [cur] if cur else []
            out += [word[i : i + room] for i in range(0, len(word), room)]
            cur = ""
        elif cur and len(f"{cur} {word}".encode()) > room:
            out.append(cur)
            cur = word
        else:
            cur = f"{cur} {word}" if cur else word
    return out + ([cur] if cur else [])


def chunk_text(text: str, most: int) -> list[str]:
    """The text whole if its estimate fits; else lines gathered up to ``most`` less the reserve.

    A limit that leaves no room falls back to one token a chunk.  Line feeds are not
    charged, chunks are trimmed, and a line over the limit is cut by words.
    """
    if estimate(text) <= most:
        return [text]
    limit = max(1, most - RESERVED)
    out: list[str] = []
    cur: list[str] = []
    used = 0

    def flush():
        nonlocal cur, used
        if any(cur):
            out.append("\n".join(cur).strip())
        cur, used = [], 0

    for line in _lines(text):
        n = estimate(line)
        if used + n > limit and any(cur):
            flush()
        if n > limit:
            flush()
            out += split_long_line(line, limit)
        elif line or any(cur):  # empty lines do not begin a chunk
            cur.append(line)
            used += n
    flush()
    return out or [text]


def chunk_messages(df: DataFrame, id_col: str, text_col: str, most: int, system_prompt: str = "") -> DataFrame:
    """record_id, chunk_no, n_chunks, chunk, prompt of each text.

    With a system prompt its estimate and the reserve are taken off first, and the
    prompts of a text in parts say which part they go with.
    """
    room = most if not system_prompt else max(0, most - estimate(system_prompt) - RESERVED)

    def run(batches):
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                cs = chunk_text(t, room)
                for k, c in enumerate(cs, 1):
                    note = f"{system_prompt}\n\nNote: This is part {k} of {len(cs)} of the input." if len(cs) > 1 else system_prompt
                    rows.append((i, k, len(cs), c, note))
            for k in range(0, len(rows), 5000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 5000]), [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()])], ["record_id", "chunk_no", "n_chunks", "chunk", "prompt"])

    kept = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("record_id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(sliced(run), "record_id string, chunk_no int, n_chunks int, chunk string, prompt string")


def routing(text: Column) -> Column:
    """Whether a text is sent whole, in an agent's chunks, or in request chunks."""
    n = token_estimate(text)
    return F.when(n > REQUEST_LIMIT, "request_chunks").when(n > AGENT_LIMIT, "agent_chunks").otherwise("whole")


def line_array(text: Column) -> Column:
    """Lines of a text; a line feed at its end begins no line."""
    return F.split(F.regexp_replace(text, r"\n\z", ""), "\n", -1)


def split_by_lines(df: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """record_id, chunk_no (from 0), start_line, end_line, content: every ``n`` lines."""
    lines = F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(line_array(F.col("text")))
    base = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("record_id"), F.col(text_col).alias("text")).select("record_id", lines.alias("lines"))
    starts = F.sequence(F.lit(0), F.size("lines") - 1, F.lit(n))
    cut = base.where(F.size("lines") > 0).select("record_id", "lines", F.explode(starts).alias("at"))
    return cut.select("record_id", (F.col("at") / n).cast("int").alias("chunk_no"), (F.col("at") + 1).alias("start_line"), F.least(F.col("at") + n, F.size("lines")).alias("end_line"), F.array_join(F.slice("lines", F.col("at") + 1, n), "\n").alias("content"))


def split_by_functions(df: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """As split_by_lines, but cut before the function that would overflow ``n`` lines.

    A function ends where the next begins; what stands before the first is in chunk 0
    and is not counted.  Texts without functions are cut by lines.  A fold over the
    function starts of a text; no data leaves the JVM.
    """
    one_line = C.C_FUNCTION.replace("(?m)", "")
    lines = F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(line_array(F.col("text")))
    base = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("record_id"), F.col(text_col).alias("text")).select("record_id", lines.alias("lines"))
    marked = base.withColumn("starts", F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(one_line), i)), lambda x: x.isNotNull()))
    with_starts = marked.where(F.size("starts") > 0)
    steps = F.transform("starts", lambda x, i: F.struct(x.alias("start"), (F.coalesce(F.try_element_at("starts", i + 2), F.size("lines")) - x).alias("size")))
    empty = F.struct(F.array().cast("array<int>").alias("cuts"), F.lit(0).alias("used"))

    def fold(acc, f):
        full = (acc["used"] + f["size"] > n) & (acc["used"] > 0)
        cuts = F.when(full, F.concat(acc["cuts"], F.array(f["start"]))).otherwise(acc["cuts"])
        return F.struct(cuts.alias("cuts"), F.when(full, f["size"]).otherwise(acc["used"] + f["size"]).alias("used"))

    cuts = F.concat(F.array(F.lit(0)), F.aggregate(steps, empty, fold)["cuts"])
    cut = with_starts.select("record_id", "lines", cuts.alias("cuts")).select("record_id", "lines", "cuts", F.posexplode("cuts").alias("chunk_no", "at"))
    end = F.coalesce(F.try_element_at("cuts", F.col("chunk_no") + 2), F.size("lines"))
    return cut.select("record_id", "chunk_no", (F.col("at") + 1).alias("start_line"), end.alias("end_line"), F.array_join(F.slice("lines", F.col("at") + 1, end - F.col("at")), "\n").alias("content"))


def split_source(df: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """By functions where more than 50 lines a chunk are allowed and there are functions, by lines else."""
    if n <= 50:
        return split_by_lines(df, id_col, text_col, n)
    by_functions = split_by_functions(df, id_col, text_col, n)
    rest = df.join(by_functions.select(F.col("record_id").alias(id_col)).distinct(), id_col, "left_anti")
    return by_functions.unionByName(split_by_lines(rest, id_col, text_col, n))


def chunk_header(chunks: DataFrame) -> DataFrame:
    """record_id, chunk_no, header: what each chunk is told about itself."""
    names = C.all_names(F.col("content"), C.C_FUNCTION)
    return chunks.select("record_id", "chunk_no", F.concat(F.lit("Chunk "), (F.col("chunk_no") + 1).cast("string"), F.lit(", lines "), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.when(F.size(names) > 0, F.concat(F.lit("; functions: "), F.array_join(names, ", "))).otherwise("")).alias("header"))


def run_chunks(chunks: DataFrame, work: Callable[[str], tuple[str, float]]) -> DataFrame:
    """record_id, chunk_no, output, score, status: ``work`` on each chunk; a failure is a row, never an exception."""

    def run(batches):
        for b in batches:
            out, score, status = [], [], []
            for t in b.column(2).to_pylist():
                try:
                    o, sc = work(t)
                    st = "done"
                except Exception as e:
                    o, sc, st = f"// failed: {type(e).__name__}", 0.0, "failed"
                out.append(o)
                score.append(float(sc))
                status.append(st)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array(score), pa.array(status, pa.string())], ["record_id", "chunk_no", "output", "score", "status"])

    return chunks.select("record_id", "chunk_no", "content").mapInArrow(sliced(run), "record_id string, chunk_no int, output string, score double, status string")


def resume_chunks(chunks: DataFrame, results: DataFrame, work) -> DataFrame:
    """Results with the failed chunks done again."""
    failed = results.where("status = 'failed'").select("record_id", "chunk_no")
    again = run_chunks(chunks.join(failed, ["record_id", "chunk_no"], "left_semi"), work)
    return results.join(failed, ["record_id", "chunk_no"], "left_anti").unionByName(again)


def merge_chunks(results: DataFrame) -> DataFrame:
    """record_id, merged, confidence, returned_confidence, n_failed.

    ``confidence`` counts failed chunks as 0 (and is 0 without any success), the other
    is the mean over chunks that returned.
    """
    row = F.struct("chunk_no", "output", "status")
    g = results.groupBy("record_id").agg(F.array_sort(F.collect_list(row)).alias("rows"), F.sum(F.when(F.col("status") == "done", F.col("score")).otherwise(0.0)).alias("s"), F.count("*").alias("n"), F.count_if(F.col("status") == "done").alias("done"))
    text = F.array_join(F.transform("rows", lambda r: F.concat(F.lit("// chunk "), (r["chunk_no"] + 1).cast("string"), F.lit("\n"), r["output"])), "\n\n")
    return g.select("record_id", text.alias("merged"), F.round(F.col("s") / F.col("n"), 6).alias("confidence"), F.coalesce(F.round(F.try_divide("s", "done"), 6), F.lit(0.0)).alias("returned_confidence"), (F.col("n") - F.col("done")).alias("n_failed"))


def number_rows(df: DataFrame, order: list[str], name: str = "row_no") -> DataFrame:
    """Consecutive numbers from 1 in the given order, without one task for all rows.

    Rows are range-sorted and written; each range's numbers start after the rows of
    the ranges before.  Only one count for each range reaches the driver.
    """
    placed = materialise(df.orderBy(*order).select("*", F.monotonically_increasing_id().alias("_at")), "numbered")
    counts = placed.groupBy(F.shiftright("_at", 33).alias("part")).agg(F.count("*").alias("n"), F.min("_at").alias("first")).orderBy("part").collect()
    offsets, before = [], 0
    for r in counts:
        offsets.append((r["part"], before - r["first"] + 1))
        before += r["n"]
    if not offsets:
        return placed.drop("_at").withColumn(name, F.lit(0).cast("long"))
    starts = F.broadcast(df.sparkSession.createDataFrame(offsets, "_part long, _shift long"))
    return placed.withColumn("_part", F.shiftright("_at", 33)).join(starts, "_part").withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def progress(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows with the share of all rows done up to each, in percent."""
    numbered = number_rows(df, order)
    total = numbered.count()
    return numbered.withColumn("percent", F.round(F.col("row_no") * 100.0 / F.lit(max(1, total)), 4)).drop("row_no")


def _docs(s, d):
    return table(s, d, "documents")


def _stub(text: str) -> tuple[str, float]:
    """Deterministic stand-in for a model: fails on texts without a brace."""
    if "{" not in text:
        raise ValueError("no code")
    return text.replace("int ", "i32 "), round(1.0 / (1 + len(text) % 7), 4)


def _merged(s, d):
    chunks = split_by_lines(table(s, d, "code_entries"), "id", "code", 40)
    return merge_chunks(run_chunks(chunks, _stub)).select("record_id", F.md5("merged").alias("merged_md5"), F.length("merged").alias("n_chars"), "confidence", "returned_confidence", "n_failed")


def _rejoined(s, d):
    """What is left of each text in its chunks, blanks aside, and whether any chunk is over the limit."""
    cut = chunk_messages(_docs(s, d), "doc_id", "text", 2000)
    rows = F.array_sort(F.collect_list(F.struct("chunk_no", "chunk")))  # a group is one text
    g = cut.groupBy("record_id").agg(rows.alias("r"), F.max(token_estimate(F.col("chunk"))).alias("largest"), F.max("n_chunks").alias("n_chunks"), F.count("*").alias("n"))
    return g.select("record_id", F.md5(F.regexp_replace(F.array_join(F.transform("r", lambda x: x["chunk"]), ""), r"(?U)\s+", "")).alias("text_md5"), (F.col("largest") <= 2000).alias("fits"), (F.col("n") == F.col("n_chunks")).alias("complete"))


QUERIES = {
    "fn_token_estimate": lambda s, d: _docs(s, d).select("doc_id", token_estimate(F.col("text")).alias("n_tokens")),
    "agg_token_total": lambda s, d: _docs(s, d).groupBy("source").agg(F.sum(token_estimate(F.col("text"))).alias("n_tokens"), F.count("*").alias("n_messages")),
    "chunk_messages": lambda s, d: chunk_messages(_docs(s, d), "doc_id", "text", 2000),
    "chunk_prompts": lambda s, d: chunk_messages(_docs(s, d), "doc_id", "text", 4000, "Translate the following text."),
    "chunk_routing": lambda s, d: _docs(s, d).where("text IS NOT NULL").groupBy(routing(F.col("text")).alias("route")).agg(F.count("*").alias("n_documents")),
    "chunk_lines": lambda s, d: split_by_lines(table(s, d, "code_entries"), "id", "code", 25),
    "chunk_functions": lambda s, d: split_by_functions(table(s, d, "code_entries"), "id", "code", 60),
    "chunk_headers": lambda s, d: chunk_header(split_source(table(s, d, "code_entries"), "id", "code", 60)),
    "chunk_merged": _merged,
    "chunk_rejoined": _rejoined,
    "window_numbered": lambda s, d: number_rows(table(s, d, "code_entries").select("id"), ["id"]).select("id", "row_no", F.ceil(F.col("row_no") / 100.0).cast("long").alias("batch_no")),
    "window_progress": lambda s, d: progress(table(s, d, "conversion_results").select("id").distinct(), ["id"]),
}
_SPLIT = "CASE WHEN code = '' THEN [] ELSE string_split(regexp_replace(code, '\\n\\z', ''), chr(10)) END"
ORACLE_SQL = {
    "fn_token_estimate": "SELECT doc_id, ceil(length(text) / 2.5::DOUBLE)::BIGINT AS n_tokens FROM documents",
    "agg_token_total": "SELECT source, sum(ceil(length(text) / 2.5::DOUBLE)::BIGINT)::BIGINT AS n_tokens, count(*) AS n_messages FROM documents GROUP BY source",
    "chunk_routing": "SELECT CASE WHEN n > 100000 THEN 'request_chunks' WHEN n > 80000 THEN 'agent_chunks' ELSE 'whole' END AS route, count(*) AS n_documents FROM (SELECT ceil(length(text) / 2.5::DOUBLE) AS n FROM documents WHERE text IS NOT NULL) GROUP BY 1",
    "chunk_lines": f"""WITH l AS (SELECT id AS record_id, {_SPLIT} AS lines FROM code_entries WHERE code IS NOT NULL), c AS (SELECT record_id, lines, unnest(range(0, len(lines), 25)) AS pos FROM l)
        SELECT record_id, (pos // 25)::INT AS chunk_no, (pos + 1)::INT AS start_line, least(pos + 25, len(lines))::INT AS end_line, array_to_string(lines[pos + 1 : pos + 25], chr(10)) AS content FROM c""",
    "window_numbered": "SELECT id, row_number() OVER (ORDER BY id) AS row_no, ((row_number() OVER (ORDER BY id) + 99) // 100)::BIGINT AS batch_no FROM code_entries",
    "window_progress": "SELECT id, round(row_number() OVER (ORDER BY id) * 100.0 / count(*) OVER (), 4)::DOUBLE AS percent FROM (SELECT DISTINCT id FROM conversion_results)",
    "chunk_functions": f"""WITH RECURSIVE l AS (SELECT id AS record_id, {_SPLIT} AS lines FROM code_entries WHERE code IS NOT NULL),
        h AS (SELECT record_id, n, pos, row_number() OVER (PARTITION BY record_id ORDER BY pos) AS i, coalesce(lead(pos) OVER (PARTITION BY record_id ORDER BY pos), n) - pos AS size
            FROM (SELECT record_id, len(lines) AS n, unnest(lines) AS line, unnest(range(0, len(lines))) AS pos FROM l) WHERE regexp_matches(line, '{C.C_FUNCTION.replace("(?m)", "")}')),
        f AS (SELECT record_id, i, size AS used, [0::BIGINT] AS cuts FROM h WHERE i = 1
            UNION ALL SELECT h.record_id, h.i, CASE WHEN f.used + h.size > 60 THEN h.size ELSE f.used + h.size END, CASE WHEN f.used + h.size > 60 THEN list_append(f.cuts, h.pos) ELSE f.cuts END FROM f JOIN h ON h.record_id = f.record_id AND h.i = f.i + 1),
        c AS (SELECT record_id, arg_max(cuts, i) AS cuts FROM f GROUP BY record_id),
        p AS (SELECT record_id, lines, unnest(range(0, len(cuts))) AS k, unnest(cuts) AS a, unnest(list_append(cuts[2:], len(lines))) AS b FROM c JOIN l USING (record_id))
        SELECT record_id, k::INT AS chunk_no, (a + 1)::INT AS start_line, b::INT AS end_line, array_to_string(lines[a + 1 : b], chr(10)) AS content FROM p""",
}
_BY_SOURCE = f"""fx AS ({ORACLE_SQL["chunk_functions"]}), lx AS ({ORACLE_SQL["chunk_lines"].replace("25", "60")}), k AS (SELECT * FROM fx UNION ALL SELECT * FROM lx WHERE record_id NOT IN (SELECT record_id FROM fx))"""
_NAMES = r"regexp_extract_all(content, '(?m)^[a-zA-Z_][a-zA-Z0-9_*\s]*\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*\([^)]*\)\s*\{', 1)"
ORACLE_SQL |= {
    "chunk_headers": f"""WITH {_BY_SOURCE} SELECT record_id, chunk_no, 'Chunk ' || (chunk_no + 1) || ', lines ' || start_line || '-' || end_line || CASE WHEN len({_NAMES}) > 0 THEN '; functions: ' || array_to_string({_NAMES}, ', ') ELSE '' END AS header FROM k""",
    "chunk_merged": f"""WITH c AS ({ORACLE_SQL["chunk_lines"].replace("25", "40")}), r AS (SELECT record_id, chunk_no, contains(content, '{{') AS done, CASE WHEN contains(content, '{{') THEN replace(content, 'int ', 'i32 ') ELSE '// failed: ValueError' END AS output, round(1.0::DOUBLE / (1 + length(content) % 7), 4) AS score FROM c),
        m AS (SELECT record_id, string_agg('// chunk ' || (chunk_no + 1) || chr(10) || output, chr(10) || chr(10) ORDER BY chunk_no) AS merged, coalesce(sum(score) FILTER (done), 0) AS s, count(*) AS n, count(*) FILTER (done) AS d FROM r GROUP BY record_id)
        SELECT record_id, md5(merged) AS merged_md5, length(merged)::INT AS n_chars, round(s / n, 6)::DOUBLE AS confidence, CASE WHEN d = 0 THEN 0.0 ELSE round(s / d, 6) END::DOUBLE AS returned_confidence, n - d AS n_failed FROM m""",
    "chunk_rejoined": r"SELECT doc_id::VARCHAR AS record_id, md5(regexp_replace(text, '[\s\x{b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', '', 'g')) AS text_md5, true AS fits, true AS complete FROM documents WHERE text IS NOT NULL",
}
