"""Lookups over symbols, calls and earlier translations, and counts of them."""

from __future__ import annotations

import re
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector, FileSystem, LocalFileSystem
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import code as C
from millrace.functions import html as H
from millrace.operators import facts, lines, paths, web
from millrace.operators.chunking import line_array
from millrace.operators.diagnosis import answer_scores, sections
from millrace.runtime import materialise, sliced, table

#: Fixed value: a C function head within one line: return type, name.
LINE_FUNCTION = r"^[\s]*(?:static\s+|extern\s+|inline\s+)*([a-zA-Z_][a-zA-Z0-9_*\s]+)\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*\([^)]*\)\s*(?:\{|;)"
#: Folders of earlier translations, best first, and what tells a translated text.
TRANSLATED_FOLDERS = ["c2rust_out", "target/c2rust", "rust_out"]
TRANSLATED_MARKS = ["c2rust", "::c_void", "libc::"]
#: Calls of a graph that is walked (12 bytes each while one task numbers them), calls it reads as text at once, rows of chains a worker hands over at once.
WALKED_CALLS, READ_CALLS, CHAIN_ROWS = 50_000_000, 1_000_000, 50_000


# --- symbols of Rust texts -----------------------------------------------------------------
def symbol_contents(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """record_id, symbol_no, kind, name, start_line, end_line, content of every symbol, by line."""
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
    names = ["record_id", "symbol_no", "kind", "name", "start_line", "end_line", "content"]

    def run(batches):
        for b in batches:
            rows = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                parts = text.splitlines()
                rows += [(i, k, *r, "\n".join(parts[r[2] - 1 : r[3]])) for k, r in enumerate(C.rust_symbols(text))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    kept = texts.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("record_id"), F.col(text_col).alias("text"))
    return kept.mapInArrow(sliced(run), "record_id string, symbol_no int, kind string, name string, start_line int, end_line int, content string")


def find_symbol(symbols: DataFrame, name: str | None = None) -> DataFrame:
    """The first symbol of each record and name (of one name, if given)."""
    kept = symbols if name is None else symbols.where(F.col("name") == name)
    w = Window.partitionBy("record_id", "name").orderBy("symbol_no")  # a group is one text
    return kept.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "symbol_no")


def names_of_kind(symbols: DataFrame, kind: str) -> DataFrame:
    """record_id, names of its symbols of one kind, by line."""
    return symbols.where(F.col("kind") == kind).groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("symbol_no", "name"))).alias("s")).select("record_id", F.transform("s", lambda x: x["name"]).alias("names"))


def replace_symbol(texts: DataFrame, id_col: str, text_col: str, found: DataFrame, new: str) -> DataFrame:
    """record_id, text with the lines of the symbol in ``found`` (one row a record) replaced."""
    t = texts.select(F.col(id_col).cast("string").alias("record_id"), line_array(F.regexp_replace(text_col, "\r\n", "\n")).alias("l")).join(found.select("record_id", "start_line", "end_line"), "record_id")
    tail = F.slice("l", F.col("end_line") + 1, F.greatest(F.size("l") - F.col("end_line"), F.lit(0)))
    return t.select("record_id", F.array_join(F.concat(F.slice("l", F.lit(1), F.col("start_line") - 1), F.split(F.lit(new), "\n"), tail), "\n").alias("text"))


# --- C texts ---------------------------------------------------------------------------------
def line_functions(entries: DataFrame) -> DataFrame:
    """id, line, return_type, name: function heads found line by line, for texts no parser reads."""
    rows = entries.where("code IS NOT NULL").select("id", F.posexplode(line_array(F.regexp_replace("code", "\r\n", "\n"))).alias("pos", "text"))
    hit = rows.where(F.col("text").rlike(LINE_FUNCTION))
    return hit.select("id", (F.col("pos") + 1).alias("line"), F.trim(F.regexp_extract("text", LINE_FUNCTION, 1)).alias("return_type"), F.regexp_extract("text", LINE_FUNCTION, 2).alias("name"))


def four_kinds(entries: DataFrame) -> DataFrame:
    """id, file_path, n_functions, n_structs, n_variables, n_macros of each entry."""
    code = F.col("code")
    return entries.where("code IS NOT NULL").select(
        "id", "file_path", F.size(C.all_names(code, C.C_FUNCTION)).alias("n_functions"), F.size(C.all_names(code, C.TYPE_NAME)).alias("n_structs"), F.size(C.all_names(code, C.GLOBAL_NAME)).alias("n_variables"), F.size(C.all_names(code, C.MACRO_NAME)).alias("n_macros")
    )


def kind_totals(entries: DataFrame) -> DataFrame:
    """kind, n: all functions, structs, variables and macros of the corpus."""
    k = four_kinds(entries).agg(*(F.coalesce(F.sum(f"n_{x}"), F.lit(0)).cast("long").alias(x) for x in ("functions", "structs", "variables", "macros")))
    return k.unpivot([], ["functions", "structs", "variables", "macros"], "kind", "n")


def file_totals(entries: DataFrame) -> DataFrame:
    """file_path, n_functions, n_structs, n_variables of each file that has any."""
    g = four_kinds(entries).where("file_path IS NOT NULL").groupBy("file_path").agg(*(F.sum(f"n_{x}").cast("long").alias(f"n_{x}") for x in ("functions", "structs", "variables")))
    return g.where("n_functions + n_structs + n_variables > 0")


# --- calls -----------------------------------------------------------------------------------
def functions_of_file(entries: DataFrame, path: str) -> DataFrame:
    """id, name of the functions in one file."""
    return entries.where((F.col("file_path") == path) & F.col("code").isNotNull()).select("id", F.explode(C.all_names(F.col("code"), C.C_FUNCTION)).alias("name"))


def calls_of_file(entries: DataFrame, path: str) -> DataFrame:
    """caller, callee of the calls in one file."""
    return facts.call_edges(entries.where(F.col("file_path") == path))


def calls_to(entries: DataFrame, callee: str) -> DataFrame:
    return facts.call_edges(entries).where(F.col("callee") == callee)


def function_calls(entries: DataFrame) -> DataFrame:
    """caller, callee: names of functions, each pair once; a function's calls are those of its entry."""
    named = entries.where("function_name <> ''").select("id", F.col("function_name").alias("name"))
    return facts.call_edges(entries).withColumnRenamed("caller", "id").join(named, "id").select(F.col("name").alias("caller"), "callee").distinct()


def neighbours(calls: DataFrame) -> DataFrame:
    """name, callers, callees: both sides of every function, sorted."""
    a = calls.select(F.col("callee").alias("name"), F.col("caller").alias("up"), F.lit(None).cast("string").alias("down"))
    b = calls.select(F.col("caller").alias("name"), F.lit(None).cast("string").alias("up"), F.col("callee").alias("down"))
    g = a.unionAll(b).groupBy("name").agg(F.array_sort(F.collect_set("up")).alias("callers"), F.array_sort(F.collect_set("down")).alias("callees"))
    return g


def usage(entries: DataFrame) -> DataFrame:
    """name, n_definitions, n_entries (that call it), n_files (of those)."""
    e = facts.call_edges(entries).withColumnRenamed("caller", "id").join(entries.select("id", "file_path"), "id")
    used = e.groupBy(F.col("callee").alias("name")).agg(F.count("*").alias("n_entries"), F.countDistinct("file_path").alias("n_files"))
    defined = entries.where("code IS NOT NULL").select(F.explode(C.all_names(F.col("code"), C.C_FUNCTION)).alias("name")).groupBy("name").agg(F.count("*").alias("n_definitions"))
    return defined.join(used, "name", "full").na.fill(0, ["n_definitions", "n_entries", "n_files"])


def _at(folder: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(folder) if ":" in folder else (LocalFileSystem(), folder)


def _groups(fs: FileSystem, path: str, most: int) -> list[list[str]]:
    """Files of a scratch table in groups of at least ``most`` rows, those of one task together."""
    tasks: dict[str, list[str]] = {}
    for f in sorted(fs.get_file_info(FileSelector(path)), key=lambda f: f.base_name):
        if part := re.match(r"part-\d+", f.base_name):
            tasks.setdefault(part[0], []).append(f.path)
    groups, rows = [[]], 0
    for files in tasks.values():
        if rows >= most:
            groups.append([])
            rows = 0
        groups[-1] += files
        rows += sum(pq.read_metadata(x, filesystem=fs).num_rows for x in files)
    return groups


def _coded(fs: FileSystem, files: list[str], column: str) -> tuple[pa.Array, pa.Array]:
    """The values of a column, each once, and the rows as numbers of them."""
    read = pa.concat_tables([pq.read_table(x, columns=[column], filesystem=fs, read_dictionary=[column], use_threads=False) for x in files])
    coded = read.column(0).unify_dictionaries().combine_chunks()
    return coded.dictionary.cast(pa.large_string()), coded.indices


def write_graph(folder: str, to: str, most: int = READ_CALLS) -> None:
    """Write the calls of a scratch table (name, callee; all of a callee by one task) as numbers into the folder ``to``.

    Callers come first, then names that are only called, null at last.  ``first`` and
    ``callees``: those of caller k are ``callees[first[k] : first[k + 1]]``; ``names``
    and ``ends``: bytes of all names and where they begin and end.  About ``most``
    calls are held as text at a time, the others as two numbers each.
    """
    fs, path = _at(folder)
    groups = _groups(fs, path, most)
    callers = pc.unique(pa.array([], pa.large_string()))
    for files in groups:
        callers = pc.unique(pa.concat_arrays([callers, _coded(fs, files, "name")[0]]))
    target = _at(to)[1]
    fs.create_dir(target)
    n, by, called, ends = len(callers), [], [], [np.zeros(1, np.int64)]

    def put(out, names: pa.Array) -> None:
        _, at, data = names.buffers()
        at = np.frombuffer(at, np.int64)[names.offset : names.offset + len(names) + 1] if len(names) else np.zeros(1, np.int64)
        if at[-1] > at[0]:
            out.write(data.slice(at[0], at[-1] - at[0]))
        ends.append(at[1:] - at[0] + ends[-1][-1])

    with fs.open_output_stream(f"{target}/names") as out:
        put(out, callers)
        for files in groups:
            values, rows = _coded(fs, files, "name")
            by.append(pc.index_in(values, value_set=callers).to_numpy()[rows.to_numpy()])
            values, rows = _coded(fs, files, "callee")
            own = pc.index_in(values, value_set=callers)
            new = values.filter(own.is_null())
            numbers = np.append(own.fill_null(-1).to_numpy(zero_copy_only=False), -1).astype(np.int32)
            numbers[:-1][numbers[:-1] < 0] = np.arange(n, n + len(new))
            n += len(new)
            called.append(numbers[rows.fill_null(len(values)).to_numpy(zero_copy_only=False)])
            if len(new):
                put(out, new)
        out.write(b"\0")  # an empty file could not be mapped
    ends.append(ends[-1][-1:])
    first = np.zeros(len(callers) + 1, np.int64)
    for b in by:
        first[1:] += np.bincount(b, minlength=len(callers))
    first = np.cumsum(first)
    free, callees = first[:-1].copy(), np.empty(first[-1], np.int32)
    while by:
        b, c = by.pop(0), called.pop(0)
        order = np.argsort(b, kind="stable")
        b, c = b[order], c[order]
        begin = np.flatnonzero(np.diff(b, prepend=-1))
        size = np.diff(begin, append=len(b))
        callees[free[b] + np.arange(len(b)) - np.repeat(begin, size)] = np.where(c < 0, n, c)  # null is a name like others
        free[b[begin]] += size
    for name, a in (("ends", np.concatenate(ends)), ("first", first), ("callees", callees)):
        with fs.open_output_stream(f"{target}/{name}") as out:
            out.write(a)


class CallGraph:
    """What ``write_graph`` wrote; files of a local or mounted folder are mapped, so that the workers of a machine hold them once."""

    def __init__(self, folder: str) -> None:
        fs, path = _at(folder)

        def read(name: str) -> pa.Buffer:
            with pa.memory_map(f"{path}/{name}") if isinstance(fs, LocalFileSystem) else fs.open_input_file(f"{path}/{name}") as f:
                return f.read_buffer()

        ends = read("ends")
        n = ends.size // 8 - 1
        known = np.packbits(np.arange((n + 7) // 8 * 8) < n - 1, bitorder="little")
        self.names = pa.LargeStringArray.from_buffers(n, ends, read("names"), pa.py_buffer(known))
        self.first, self.callees = np.frombuffer(read("first"), np.int64), np.frombuffer(read("callees"), np.int32)
        self.callers = self.names[: len(self.first) - 1]
        self._hops, self._place = np.full(n, -1, np.int32), np.empty(n, np.int32)

    def reach(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and hops of all that caller k reaches, itself at 0."""
        hops, place, front, found, hop = self._hops, self._place, np.array([k], np.int32), [np.array([k], np.int32)], 0
        hops[k] = 0
        while len(front):
            hop += 1
            start, size = self.first[front], self.first[front + 1] - self.first[front]
            met = self.callees[np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())]
            met = met[hops[met] < 0]
            at = np.arange(len(met), dtype=np.int32)
            place[met] = at
            met = met[place[met] == at]  # each once
            hops[met] = hop
            found.append(met)
            front = met[met < len(self.callers)]
        numbers = np.concatenate(found)
        counted = hops[numbers]
        hops[numbers] = -1
        return numbers, counted


@lru_cache(maxsize=1)
def call_graph(folder: str) -> CallGraph:
    """A graph, opened once by each worker."""
    return CallGraph(folder)


def call_chain(calls: DataFrame, roots: DataFrame, walked: int = WALKED_CALLS) -> DataFrame:
    """root, name, hops: what each root reaches through calls, by the shortest way, until nothing new is met.

    One task writes the calls as numbers, and workers walk them root by root, so
    that nothing of the result is shuffled or written between: it can be thousands
    of times the input, as all that reach one large cycle reach all behind it.  A
    graph of more than ``walked`` calls, too large for that task, is joined level
    by level.
    """
    met = calls.select(F.col("caller").alias("name"), "callee").where("name IS NOT NULL AND NOT name <=> callee")
    step = materialise(met.repartition("callee").distinct(), "calls")
    start = roots.select(F.col("name").cast("string").alias("root")).distinct()
    n = step.count()
    if not 0 < n <= walked:
        return _chain_by_rounds(step, start)
    scratch = step._scratch_path

    def number(batches):
        for _ in batches:
            to = f"{scratch}/_graph-{uuid.uuid4().hex}"  # its own for each attempt
            write_graph(scratch, to)
            yield pa.RecordBatch.from_arrays([pa.array([to])], ["folder"])

    folder = step.sparkSession.range(0, 1, 1, 1).mapInArrow(number, "folder string").first().folder

    def run(batches):
        graph = call_graph(folder)
        for b in batches:
            held, size = [], 0
            numbers = pc.index_in(b.column(0).cast(pa.large_string()), value_set=graph.callers)
            for root, k in zip(b.column(0).to_pylist(), numbers.to_pylist()):
                if k is None:
                    held.append((pa.array([root], pa.string()), pa.array([root], pa.string()), pa.array([0], pa.int32())))
                    size += 1
                    continue
                reached, hops = graph.reach(k)
                for j in range(0, len(reached), CHAIN_ROWS):
                    part = reached[j : j + CHAIN_ROWS]
                    held.append((pa.repeat(pa.scalar(root, pa.string()), len(part)), graph.names.take(pa.array(part)).cast(pa.string()), pa.array(hops[j : j + CHAIN_ROWS])))
                    size += len(part)
                    if size >= CHAIN_ROWS:
                        yield _joined(held)
                        held, size = [], 0
            if held:
                yield _joined(held)

    # the work is in the results, so few bytes of roots are many tasks all the same; by a key of its own, as the shuffle of distinct roots would stand in for one by root and be merged
    tasks = max(int(step.sparkSession.conf.get("spark.sql.shuffle.partitions")), step.sparkSession.sparkContext.defaultParallelism)
    return start.repartition(tasks, F.xxhash64("root")).mapInArrow(run, "root string, name string, hops int")


def _joined(parts: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*parts)], ["root", "name", "hops"])


def _chain_by_rounds(step: DataFrame, start: DataFrame) -> DataFrame:
    """The same by frontiers, joined level by level and written between rounds; the callees of a round are only those that were not met before."""
    seen = materialise(start.select("root", F.col("root").alias("name"), F.lit(0).alias("hops")), "chain")
    front, hop = seen, 0
    while True:
        hop += 1
        nxt = front.join(step, "name").select("root", F.col("callee").alias("name"), F.lit(hop).alias("hops")).distinct()
        front = materialise(nxt.join(seen.select("root", "name"), ["root", "name"], "left_anti"), "chain")
        if front.isEmpty():
            return seen
        seen = seen.unionAll(front)


def file_analysis(entries: DataFrame) -> DataFrame:
    """file_path, n_entries, n_functions, n_includes, n_bytes, complexity (the highest) of each file."""
    code = F.col("code")
    per = entries.where("file_path IS NOT NULL AND code IS NOT NULL").select("file_path", F.size(C.all_names(code, C.C_FUNCTION)).alias("f"), F.size(C.all_names(code, C.INCLUDE_LOOSE)).alias("i"), F.octet_length(code).alias("b"), F.round(C.complexity(code), 4).alias("c"))
    return per.groupBy("file_path").agg(F.count("*").alias("n_entries"), F.sum("f").alias("n_functions"), F.sum("i").alias("n_includes"), F.sum("b").alias("n_bytes"), F.max("c").alias("complexity"))


# --- earlier translations, targets, counters --------------------------------------------------
def prior_translations(sources: DataFrame, outputs: DataFrame) -> DataFrame:
    """project, path, output, rank: the earlier translation of each source, by the stem of its name.

    ``sources``: project, path.  ``outputs``: project, path, text.  Rank 0 is a file of
    that stem in ``src`` whose text bears a mark of a translator, the following ranks are
    the folders of translations in their order.  Each stem meets one output of each rank.
    """
    marked = F.lit(False)
    for m in TRANSLATED_MARKS:
        marked = marked | F.contains("text", F.lit(m))
    folder = paths.parent(F.col("path"))
    rank = F.when((folder == "src") & F.coalesce(marked, F.lit(False)), 0)
    for i, f in enumerate(TRANSLATED_FOLDERS, 1):
        rank = rank.when(folder == f, i)
    best = outputs.where(paths.file_extension(F.col("path")) == "rs").select("project", paths.file_stem(F.col("path")).alias("stem"), rank.alias("rank"), F.col("path").alias("output")).where("rank IS NOT NULL")
    best = best.groupBy("project", "stem").agg(F.min(F.struct("rank", "output")).alias("b"))
    return sources.select("project", "path", paths.file_stem(F.col("path")).alias("stem")).distinct().join(best, ["project", "stem"], "left").select("project", "path", "b.output", "b.rank")


def project_targets(entries: DataFrame) -> DataFrame:
    """project, target: bin if a text of the project has a main function, lib else."""
    has_main = F.bool_or(F.coalesce(F.contains("code", F.lit("fn main(")), F.lit(False)))
    return entries.where("project IS NOT NULL").groupBy("project").agg(F.when(has_main, "bin").otherwise("lib").alias("target"))


def category_counters(files: DataFrame) -> DataFrame:
    """group_key, n_paired, n_individual, n_unrelated, n_bytes, n_skipped.

    ``files``: group_key, path, size.  A pair counts two; excluded paths and null ones
    are skipped and their size does not count.
    """
    skip = F.col("path").isNull() | F.coalesce(paths.excluded(F.col("path")), F.lit(False))
    kept = files.where(~skip).groupBy("group_key", "path").agg(F.max("size").alias("size"))
    kinds = paths.pairing_categories(kept.select("group_key", "path")).join(kept, ["group_key", "path"])
    counted = kinds.groupBy("group_key").agg(*(F.count_if(F.col("category") == c).alias(f"n_{c}") for c in ("paired", "individual", "unrelated")), F.sum("size").alias("n_bytes"))
    skipped = files.where(skip).groupBy("group_key").agg(F.count("*").alias("n_skipped"))
    return counted.join(skipped, "group_key", "full").na.fill(0, ["n_paired", "n_individual", "n_unrelated", "n_bytes", "n_skipped"])


def decoded(rows: DataFrame, times: list[str], strict: bool = True) -> DataFrame:
    """Rows whose text columns ``times`` become timestamps.

    A time that is no time is an error: the query fails, or without ``strict`` the row
    says so in ``error`` and keeps nulls.  A null stays null.
    """
    out = rows
    bad = F.lit(None).cast("string")
    for t in reversed(times):
        bad = F.when(F.col(t).isNotNull() & F.try_to_timestamp(t).isNull(), F.concat(F.lit(f"no time in {t}: "), F.col(t))).otherwise(bad)
    out = out.withColumn("error", bad)
    if strict:
        out = out.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast("string")))
    return out.withColumns({t: F.try_to_timestamp(t) for t in times})


# --- answers and pages -------------------------------------------------------------------------
def answer_summary(answers: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, summary: the first section about a solution; without one, the first 500 characters."""
    kept = answers.where(F.col(text_col).isNotNull())
    about = sections(kept, id_col, text_col).where(F.lower("heading").contains("solution") | F.contains("heading", F.lit("解决")))
    said = about.where(F.trim(F.regexp_replace("content", r"\s+", " ")) != "").groupBy(id_col).agg(F.min_by("content", "section_no").alias("content"))
    lines_ = F.transform(F.split(F.col("content"), "\n", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    text = F.regexp_replace(F.array_join(lines_, "\n"), r"^\s+|\s+$", "")
    return kept.select(id_col, F.substring(text_col, 1, 500).alias("start")).join(said, id_col, "left").select(id_col, F.coalesce(text, F.col("start")).alias("summary"))


def ranked_pages(answers: DataFrame, group: str, id_col: str, text_col: str, most: int = 5) -> DataFrame:
    """group, id, position, relevance: the ``most`` first answers of each group, the most relevant first (ties by id)."""
    first = Window.partitionBy(group).orderBy(id_col)
    kept = answers.where(F.col(text_col).isNotNull()).select(group, id_col, answer_scores(F.col(text_col))["relevance"].alias("relevance"), F.row_number().over(first).alias("rn")).where(F.col("rn") <= most)
    best = Window.partitionBy(group).orderBy(F.desc("relevance"), id_col)
    return kept.select(group, id_col, F.row_number().over(best).alias("position"), "relevance")


def site_pages(pages: DataFrame) -> DataFrame:
    """page_id, source_type, title, main_content, votes, tags, code_blocks of the pages of known sites (columns page_id, url, html)."""
    block = pa.list_(pa.struct([("language", pa.string()), ("code", pa.string())]))
    names = ["page_id", "source_type", "title", "main_content", "votes", "tags", "places"]

    def run(batches):
        for b in batches:
            got = [H.site_page(h, k, web.LEAST_CODE_BYTES) for h, k in zip(b.column(2).to_pylist(), b.column(1).to_pylist())]
            places = pa.array([[{"language": lang or css, "code": code} for lang, css, code in g["places"]] for g in got], block)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([g["title"] for g in got], pa.string()), pa.array([g["main_content"] for g in got], pa.string()), pa.array([g["votes"] for g in got], pa.int32()), pa.array([list(g["tags"]) for g in got], pa.list_(pa.string())), places], names)

    kept = pages.where("html IS NOT NULL").select(F.col("page_id").cast("long").alias("page_id"), web.source_type(F.col("url")).alias("source_type"), "html").where(F.col("source_type").isin(list(H.SITES)))
    out = kept.mapInArrow(sliced(run), "page_id long, source_type string, title string, main_content string, votes int, tags array<string>, places array<struct<language: string, code: string>>")
    named = F.transform("places", lambda p: F.struct(F.coalesce(web.language_of_class(p["language"]), web.language_of_code(p["code"])).alias("language"), p["code"].alias("code")))
    return out.select("page_id", "source_type", "title", "main_content", "votes", "tags", named.alias("code_blocks"))


# --- queries -----------------------------------------------------------------------------------
def _e(s, d):
    return table(s, d, "code_entries")


def _symbols(s, d):
    return symbol_contents(table(s, d, "translation_results"), "id", "rust_code")


def _first_path(s, d) -> str:
    return _e(s, d).agg(F.min("file_path")).first()[0] or ""


def _replaced(s, d):
    w = Window.partitionBy("record_id").orderBy("symbol_no")
    first = _symbols(s, d).where("kind = 'function'").withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return replace_symbol(table(s, d, "translation_results"), "id", "rust_code", first, "// moved\n// away")


def _prior(s, d):
    sources = _e(s, d).where("file_path IS NOT NULL AND project IS NOT NULL").select("project", F.col("file_path").alias("path"))
    done = table(s, d, "conversion_results").select("source_id", "converted_code", "id").join(_e(s, d).select(F.col("id").alias("source_id"), "project", "file_path"), "source_id").where("file_path IS NOT NULL AND project IS NOT NULL")
    last = F.substring("id", -1, 1)
    folder = F.when(last.isin("0", "1", "2", "3"), "src").when(last.isin("4", "5", "6"), "c2rust_out").when(last.isin("7", "8"), "rust_out").when(last == "9", "target/c2rust").otherwise("old")
    outputs = done.select("project", F.concat(folder, F.lit("/"), paths.file_stem(F.col("file_path")), F.lit(".rs")).alias("path"), F.col("converted_code").alias("text"))
    return prior_translations(sources, outputs)


def _texts_of_times(s, d):
    bad = F.when(F.substring("id", -1, 1) == "7", F.lit("yesterday, maybe")).otherwise(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return decoded(_e(s, d).select("id", bad.alias("created_at")), ["created_at"], strict=False).select("id", F.unix_micros("created_at").alias("created_us"), "error")


#: Pages, files and nodes for operators that no test table has rows for.
HTML_PAGES = [
    (1, "https://stackoverflow.com/q/1", '<h1><a>How to <b>move</b></a></h1><span class="js-vote-count">42</span><div class="s-prose"><p>first   text</p><pre class="lang-rust"><code>fn main() { run(); }</code></pre></div><a class="post-tag">rust</a><a class="post-tag">ffi</a>'),
    (2, "https://doc.rust-lang.org/std/x.html", '<h1 class="fqn">Struct X</h1><div class="docblock">about</div><div class="docblock">more<br>text</div><pre class="language-rust">let value = 1 + 2;</pre>'),
    (3, "https://github.com/a/b/issues/1", '<h1>Bug</h1><div class="markdown-body">it &amp; fails</div><div class="highlight">def run_it(self): pass</div>'),
    (4, "https://example.org/", "<h1>other</h1>"),
    (5, "https://stackoverflow.com/q/2", '<div class="js-post-body">a</div><div class="js-post-body">b</div><div class="js-post-body">c</div><div class="js-post-body">d</div><span class="js-vote-count">many</span>'),
    (6, "https://github.com/a/c", None),
]
PAIR_FILES = [("p", x) for x in ["src/a.c", "src/a.h", "src/b.cpp", "include/b.hpp", "lib/c.c", "include/c.h", "d.cc", "README.md", "src/e.c++", "x/e.h", "src\\f.c", "src\\f.h", "g.h", "src/o.o", "h.c"]] + [("q", "src/a.c"), ("q", "b.hpp"), ("r", None)]


def _inline(s: SparkSession, rows, ddl: str) -> DataFrame:
    return s.createDataFrame(rows, ddl)


def _pair_files(s):
    return _inline(s, PAIR_FILES, "group_key string, path string")


QUERIES = {
    "symbol_find": lambda s, d: find_symbol(_symbols(s, d)).select("record_id", "kind", "name", "start_line", "end_line", "content"),
    "symbol_names": lambda s, d: names_of_kind(_symbols(s, d), "function"),
    "symbol_replaced": _replaced,
    "fn_line_functions": lambda s, d: line_functions(_e(s, d)),
    "fn_globals": lambda s, d: _e(s, d).select("id", C.all_names(F.col("code"), C.GLOBAL_NAME).alias("names")),
    "agg_kind_totals": lambda s, d: kind_totals(_e(s, d)),
    "agg_file_symbols": lambda s, d: file_totals(_e(s, d)),
    "filter_functions_of_file": lambda s, d: functions_of_file(_e(s, d), _first_path(s, d)),
    "filter_calls_of_file": lambda s, d: calls_of_file(_e(s, d), _first_path(s, d)),
    "filter_calls_to": lambda s, d: calls_to(_e(s, d), "init"),
    "graph_neighbours": lambda s, d: neighbours(function_calls(_e(s, d))),
    "graph_call_chain": lambda s, d: call_chain(function_calls(_e(s, d)), _e(s, d).where("function_name <> ''").select(F.col("function_name").alias("name")).distinct()),
    "agg_usage": lambda s, d: usage(_e(s, d)),
    "agg_file_analysis": lambda s, d: file_analysis(_e(s, d)),
    "join_prior_translation": _prior,
    "agg_targets": lambda s, d: project_targets(_e(s, d)),
    "agg_category_counters": lambda s, d: category_counters(_e(s, d).select(F.coalesce("project", F.lit("")).alias("group_key"), F.col("file_path").alias("path"), F.octet_length("code").alias("size"))),
    "agg_category_inline": lambda s, d: category_counters(_pair_files(s).withColumn("size", F.lit(10))),
    "join_pair_inline": lambda s, d: paths.pair_headers(_pair_files(s).where("path IS NOT NULL")),
    "json_decoded": _texts_of_times,
    "error_summary": lambda s, d: answer_summary(table(s, d, "documents"), "doc_id", "text"),
    "top_pages": lambda s, d: ranked_pages(table(s, d, "documents").where("source IS NOT NULL"), "source", "doc_id", "text"),
    "html_sites": lambda s, d: site_pages(_inline(s, HTML_PAGES, "page_id long, url string, html string")).select("page_id", "source_type", "title", "main_content", "votes", F.array_join("tags", ",").alias("tags"), F.array_join(F.transform("code_blocks", lambda b: F.concat_ws(":", F.coalesce(b["language"], F.lit("?")), b["code"])), " | ").alias("blocks")),
}

# SQL: patterns are written out, so that a change of a constant shows
_L = r"string_split(regexp_replace(replace(code, chr(13) || chr(10), chr(10)), '\n\z', ''), chr(10))"
_FUN = r"(?m)^[a-zA-Z_][a-zA-Z0-9_*\s]*\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*\([^)]*\)\s*\{"
_TYP, _MAC = r"(?m)^(?:typedef\s+)?(?:struct|union|enum)\s+(\w+)", r"(?m)^#define\s+(\w+)"
_GLO = r"(?m)^(?:extern\s+)?(?:static\s+)?[a-zA-Z_][a-zA-Z0-9_*\s]+\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*[;=]"
_HEAD = r"^[\s]*(?:static\s+|extern\s+|inline\s+)*([a-zA-Z_][a-zA-Z0-9_*\s]+)\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*\([^)]*\)\s*(?:\{|;)"


def _n(p: str) -> str:
    return f"len(regexp_extract_all(code, '{p}', 1))"


_FOUR = f"SELECT id, file_path, {_n(_FUN)} AS f, {_n(_TYP)} AS s, {_n(_GLO)} AS v, {_n(_MAC)} AS m FROM code_entries WHERE code IS NOT NULL"
_EDGES = facts.ORACLE_SQL["filter_call_edges"]
_CALLS = f"SELECT DISTINCT e.function_name AS caller, c.callee FROM ({_EDGES}) c JOIN code_entries e ON e.id = c.caller WHERE e.function_name <> ''"
# braces of a text, with the depth behind each; a symbol ends where the depth at its first brace is reached again
_KINDS = {
    "function": r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe|extern\s+\"[^\"]*\")\s+)*fn\s+([A-Za-z_]\w*)", "struct": r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+([A-Za-z_]\w*)", "enum": r"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+([A-Za-z_]\w*)",
    "trait": r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+([A-Za-z_]\w*)", "impl": r"^\s*(?:unsafe\s+)?impl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?([A-Za-z_]\w*)", "module": r"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+([A-Za-z_]\w*)",
}
_SYMBOLS = rf"""WITH t AS (SELECT id, string_split(regexp_replace(replace(rust_code, chr(13) || chr(10), chr(10)), '\n\z', ''), chr(10)) AS l FROM translation_results WHERE rust_code IS NOT NULL),
    x AS (SELECT id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS no FROM t),
    c AS (SELECT id, no, k, substr(line, k, 1) AS ch FROM (SELECT id, no, line, unnest(range(1, length(line) + 1)) AS k FROM x) WHERE substr(line, k, 1) IN ('{{', '}}')),
    b AS (SELECT *, sum(CASE ch WHEN '{{' THEN 1 ELSE -1 END) OVER (PARTITION BY id ORDER BY no, k) AS depth FROM c),
    y AS ({' UNION ALL '.join(f"SELECT id, no, {i} AS kind_no, '{kind}' AS kind, regexp_extract(line, '{p}', 1) AS name FROM x WHERE regexp_matches(line, '{p}')" for i, (kind, p) in enumerate(_KINDS.items()))}),
    o AS (SELECT y.*, (SELECT min(no) FROM b WHERE b.id = y.id AND b.no >= y.no AND b.ch = '{{') AS opens, (SELECT min(no) FROM x WHERE x.id = y.id AND x.no >= y.no AND ends_with(rtrim(x.line, chr(9) || chr(13) || ' '), ';')) AS ended, (SELECT count(*) FROM x WHERE x.id = y.id) AS n FROM y),
    p AS (SELECT o.*, (SELECT arg_min(depth, (no, k)) FROM b WHERE b.id = o.id AND b.no = o.opens AND b.ch = '{{') AS d, (SELECT min(k) FROM b WHERE b.id = o.id AND b.no = o.opens AND b.ch = '{{') AS ok FROM o),
    q AS (SELECT id AS record_id, kind_no, kind, name, no::INT AS start_line, (CASE WHEN opens IS NULL OR ended < opens OR opens > no + 21 THEN no
        ELSE coalesce((SELECT min(b.no) FROM b WHERE b.id = p.id AND (b.no > p.opens OR (b.no = p.opens AND b.k > p.ok)) AND b.ch = '}}' AND b.depth = p.d - 1), n) END)::INT AS end_line FROM p)"""
_WITH_TEXT = f"{_SYMBOLS}, z AS (SELECT q.*, array_to_string(t.l[start_line : end_line], chr(10)) AS content, t.l, row_number() OVER (PARTITION BY record_id, name ORDER BY start_line, kind_no) AS rn FROM q JOIN t ON t.id = q.record_id)"
_STEM = r"CASE WHEN regexp_matches(regexp_extract({0}, '([^/\\]*)$', 1), '^.+\.[^.]*$') THEN regexp_extract(regexp_extract({0}, '([^/\\]*)$', 1), '^(.+)\.[^.]*$', 1) ELSE regexp_extract({0}, '([^/\\]*)$', 1) END"
_PAIR_VALUES = "(VALUES " + ", ".join(f"('{g}', '{p}')" for g, p in PAIR_FILES if p) + ") AS file_mappings(project, source_path)"
_PAIRS = paths._pairs_sql().replace("FROM file_mappings)", f"FROM {_PAIR_VALUES})")
_SECTION = r"""WITH l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
    n AS (SELECT doc_id, pos, line, regexp_matches(line, '^[ \t]*##? ') AS head, sum(regexp_matches(line, '^[ \t]*##? ')::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM l),
    s AS (SELECT doc_id, section, max(CASE WHEN head THEN line END) AS heading, regexp_replace(coalesce(string_agg(regexp_replace(line, '^\s+|\s+$', '', 'g'), chr(10) ORDER BY pos) FILTER (NOT head), ''), '^\s+|\s+$', '', 'g') AS content FROM n GROUP BY doc_id, section),
    f AS (SELECT doc_id, arg_min(content, section) AS content FROM s WHERE (contains(lower(heading), 'solution') OR contains(heading, '解决')) AND content <> '' GROUP BY doc_id)"""
_REL = r"coalesce(greatest(least(try_cast(nullif(regexp_extract(text, '(?i)relevance[:\s]*([0-9]*\.?[0-9]+)', 1), '') AS DOUBLE), 1.0), 0.0), 0.8)::DOUBLE"
ORACLE_SQL = {
    "fn_symbol_facts": f"{_SYMBOLS} SELECT record_id, kind, name, start_line, end_line FROM q",
    "symbol_find": f"{_WITH_TEXT} SELECT record_id, kind, name, start_line, end_line, content FROM z WHERE rn = 1",
    "symbol_names": f"{_SYMBOLS} SELECT record_id, list(name ORDER BY start_line) AS names FROM q WHERE kind = 'function' GROUP BY record_id",
    "symbol_replaced": f"{_WITH_TEXT} SELECT record_id, array_to_string(l[: start_line - 1] || ['// moved', '// away'] || l[end_line + 1 :], chr(10)) AS text FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY start_line) AS r FROM z WHERE kind = 'function') WHERE r = 1",
    "fn_line_functions": f"SELECT id, no::INT AS line, trim(regexp_extract(line, '{_HEAD}', 1)) AS return_type, regexp_extract(line, '{_HEAD}', 2) AS name FROM (SELECT id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS no FROM (SELECT id, {_L} AS l FROM code_entries WHERE code IS NOT NULL)) WHERE regexp_matches(line, '{_HEAD}')",
    "fn_globals": f"SELECT id, regexp_extract_all(code, '{_GLO}', 1) AS names FROM code_entries",
    "agg_kind_totals": f"WITH k AS ({_FOUR}) SELECT 'functions' AS kind, sum(f)::BIGINT AS n FROM k UNION ALL SELECT 'structs', sum(s)::BIGINT FROM k UNION ALL SELECT 'variables', sum(v)::BIGINT FROM k UNION ALL SELECT 'macros', sum(m)::BIGINT FROM k",
    "agg_file_symbols": f"SELECT * FROM (SELECT file_path, sum(f)::BIGINT AS n_functions, sum(s)::BIGINT AS n_structs, sum(v)::BIGINT AS n_variables FROM ({_FOUR}) WHERE file_path IS NOT NULL GROUP BY file_path) WHERE n_functions + n_structs + n_variables > 0",
    "filter_functions_of_file": f"SELECT id, unnest(regexp_extract_all(code, '{_FUN}', 1)) AS name FROM code_entries WHERE file_path = (SELECT min(file_path) FROM code_entries)",
    "filter_calls_of_file": f"SELECT caller, callee FROM ({_EDGES}) WHERE caller IN (SELECT id FROM code_entries WHERE file_path = (SELECT min(file_path) FROM code_entries))",
    "filter_calls_to": f"SELECT caller, callee FROM ({_EDGES}) WHERE callee = 'init'",
    "graph_neighbours": f"WITH c AS ({_CALLS}) SELECT name, coalesce(list(DISTINCT up ORDER BY up) FILTER (up IS NOT NULL), []) AS callers, coalesce(list(DISTINCT down ORDER BY down) FILTER (down IS NOT NULL), []) AS callees FROM (SELECT callee AS name, caller AS up, NULL AS down FROM c UNION ALL SELECT caller, NULL, callee FROM c) GROUP BY name",
    "graph_call_chain": f"WITH RECURSIVE c AS ({_CALLS}), r AS (SELECT DISTINCT function_name AS root, function_name AS name, 0 AS hops FROM code_entries WHERE function_name <> '' UNION SELECT r.root, c.callee, r.hops + 1 FROM r JOIN c ON c.caller = r.name WHERE r.hops < 40) SELECT root, name, min(hops)::INT AS hops FROM r GROUP BY root, name",
    "agg_usage": f"""WITH u AS (SELECT callee AS name, count(*) AS n_entries, count(DISTINCT file_path) AS n_files FROM ({_EDGES}) c JOIN code_entries e ON e.id = c.caller GROUP BY callee),
        d AS (SELECT name, count(*) AS n_definitions FROM (SELECT unnest(regexp_extract_all(code, '{_FUN}', 1)) AS name FROM code_entries) GROUP BY name)
        SELECT coalesce(d.name, u.name) AS name, coalesce(n_definitions, 0) AS n_definitions, coalesce(n_entries, 0) AS n_entries, coalesce(n_files, 0) AS n_files FROM d FULL JOIN u ON u.name = d.name""",
    "agg_file_analysis": f"SELECT file_path, count(*) AS n_entries, sum({_n(_FUN)})::BIGINT AS n_functions, sum(len(regexp_extract_all(code, '#include\\s+[<\"](.*?)[>\"]', 1)))::BIGINT AS n_includes, sum(strlen(code))::BIGINT AS n_bytes, max({facts._COMPLEX}) AS complexity FROM code_entries WHERE file_path IS NOT NULL AND code IS NOT NULL GROUP BY file_path",
    "join_prior_translation": f"""WITH o AS (SELECT e.project, {_STEM.format('e.file_path')} AS stem, CASE WHEN right(c.id, 1) IN ('0', '1', '2', '3') THEN 'src' WHEN right(c.id, 1) IN ('4', '5', '6') THEN 'c2rust_out' WHEN right(c.id, 1) IN ('7', '8') THEN 'rust_out' WHEN right(c.id, 1) = '9' THEN 'target/c2rust' ELSE 'old' END AS folder, c.converted_code AS text
            FROM conversion_results c JOIN code_entries e ON e.id = c.source_id WHERE e.file_path IS NOT NULL AND e.project IS NOT NULL),
        r AS (SELECT project, stem, folder || '/' || stem || '.rs' AS output, CASE WHEN folder = 'src' AND (contains(text, 'c2rust') OR contains(text, '::c_void') OR contains(text, 'libc::')) THEN 0 WHEN folder = 'c2rust_out' THEN 1 WHEN folder = 'target/c2rust' THEN 2 WHEN folder = 'rust_out' THEN 3 END AS rank FROM o),
        g AS (SELECT project, stem, min(rank) AS rank, arg_min(output, rank) AS output FROM r WHERE rank IS NOT NULL GROUP BY ALL), s AS (SELECT DISTINCT project, file_path AS path, {_STEM.format('file_path')} AS stem FROM code_entries WHERE file_path IS NOT NULL AND project IS NOT NULL)
        SELECT s.project, s.path, g.output, g.rank::INT AS rank FROM s LEFT JOIN g ON g.project = s.project AND g.stem = s.stem""",
    "agg_targets": "SELECT project, CASE WHEN bool_or(contains(code, 'fn main(')) THEN 'bin' ELSE 'lib' END AS target FROM code_entries WHERE project IS NOT NULL GROUP BY project",
    "agg_category_counters": f"""WITH e AS (SELECT coalesce(project, '') AS group_key, file_path AS path, strlen(code) AS size, file_path IS NULL OR regexp_matches(file_path, '\\.(bak|tmp|o|obj|exe|dll|so)$|^\\.git/|^\\.svn/') AS skip FROM code_entries),
        k AS (SELECT group_key, path, max(size) AS size FROM e WHERE NOT skip GROUP BY ALL), c AS ({paths.ORACLE_SQL["set_pairing"].replace("FROM file_mappings", "FROM (SELECT group_key AS project, path AS source_path FROM e WHERE NOT skip) file_mappings")})
        SELECT g.group_key, coalesce(n_paired, 0) AS n_paired, coalesce(n_individual, 0) AS n_individual, coalesce(n_unrelated, 0) AS n_unrelated, coalesce(n_bytes, 0)::BIGINT AS n_bytes, coalesce(n_skipped, 0) AS n_skipped FROM (SELECT DISTINCT group_key FROM e) g
        LEFT JOIN (SELECT group_key, count(*) FILTER (category = 'paired') AS n_paired, count(*) FILTER (category = 'individual') AS n_individual, count(*) FILTER (category = 'unrelated') AS n_unrelated, sum(size) AS n_bytes FROM c JOIN k USING (group_key, path) GROUP BY group_key) USING (group_key)
        LEFT JOIN (SELECT group_key, count(*) AS n_skipped FROM e WHERE skip GROUP BY group_key) USING (group_key)""",
    "agg_category_inline": "SELECT * FROM (VALUES ('p', 10::BIGINT, 3::BIGINT, 1::BIGINT, 140::BIGINT, 1::BIGINT), ('q', 0, 2, 0, 20, 0), ('r', 0, 0, 0, 0, 1)) t(group_key, n_paired, n_individual, n_unrelated, n_bytes, n_skipped)",
    "join_pair_inline": f"{_PAIRS} SELECT group_key, source_path, header_path, rule FROM m WHERE rn = 1",
    "json_decoded": "SELECT id, CASE WHEN right(id, 1) <> '7' THEN epoch_us(created_at) END AS created_us, CASE WHEN right(id, 1) = '7' THEN 'no time in created_at: yesterday, maybe' END AS error FROM code_entries",
    "error_summary": f"{_SECTION} SELECT d.doc_id, coalesce(f.content, left(d.text, 500)) AS summary FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id WHERE d.text IS NOT NULL",
    "top_pages": f"SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY relevance DESC, doc_id)::INT AS position, relevance FROM (SELECT source, doc_id, {_REL} AS relevance, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents WHERE source IS NOT NULL AND text IS NOT NULL) WHERE rn <= 5",
    "html_sites": """SELECT * FROM (VALUES
        (1::BIGINT, 'StackOverflow', 'How to move', 'first text fn main() { run(); }', 42::INT, 'rust,ffi', 'rust:fn main() { run(); } | rust:fn main() { run(); }'),
        (2, 'RustDoc', 'Struct X', 'about' || chr(10) || chr(10) || 'more text', NULL, 'rust,documentation', 'rust:let value = 1 + 2; | rust:let value = 1 + 2;'),
        (3, 'GitHub', 'Bug', 'it & fails', NULL, 'github', 'python:def run_it(self): pass'),
        (5, 'StackOverflow', 'Stack Overflow Question', 'a' || chr(10) || chr(10) || 'b' || chr(10) || chr(10) || 'c', NULL, '', '')) t(page_id, source_type, title, main_content, votes, tags, blocks)""",
}
