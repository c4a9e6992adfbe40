"""Paths and files: classes, pairs, mappings, sizes."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.runtime import table

#: Extensions of sources and headers.
SOURCE_EXTENSIONS = ["c", "cc", "cpp", "cxx", "c++"]
HEADER_EXTENSIONS = ["h", "hpp", "hh", "hxx"]
#: What scans leave out.
EXCLUDE = ["*.bak", "*.tmp", ".git/*", ".svn/*", "*.o", "*.obj", "*.exe", "*.dll", "*.so"]
#: Source pattern and header pattern of each pairing rule, in order.
PAIRING_RULES = [
    (r"(.+)\.c", r"\1.h"),
    (r"(.+)\.cc", r"\1.h"),
    (r"(.+)\.cpp", r"\1.h"),
    (r"(.+)\.cpp", r"\1.hpp"),
    (r"(.+)\.cxx", r"\1.h"),
    (r"(.+)\.c\+\+", r"\1.h"),
    (r"src/(.+)\.c", r"include/\1.h"),
    (r"src/(.+)\.cpp", r"include/\1.h"),
    (r"src/(.+)\.cpp", r"include/\1.hpp"),
]


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def file_stem(path: Column) -> Column:
    """Name without the last extension; a leading dot begins no extension."""
    name = file_name(path)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name)


def file_extension(path: Column) -> Column:
    return F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1)


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)[/\\][^/\\]*$", 1)


def file_class(path: Column) -> Column:
    ext = F.lower(file_extension(path))
    return F.when(ext.isin(SOURCE_EXTENSIONS), "source").when(ext.isin(HEADER_EXTENSIONS), "header").otherwise("unrelated")


def relative_to(path: Column, root: Column) -> Column:
    """The path without its root; unchanged where it does not begin with it."""
    prefix = F.concat(F.regexp_replace(root, r"/+$", ""), F.lit("/"))
    return F.when(F.startswith(path, prefix), F.substring(path, F.length(prefix) + 1, F.length(path))).otherwise(path)


def excluded(path: Column, globs: list[str] = EXCLUDE) -> Column:
    """True for paths that a glob covers (``*`` crosses folders)."""
    pattern = "|".join(fnmatch.translate(g).replace("(?s:", "(?:").replace(r"\Z", "").replace(r"\z", "") for g in globs)
    return path.rlike(f"^(?:{pattern})$")


def human_size(n: Column) -> Column:
    """Bytes on base 1024 with two decimals, halves to even."""
    x = n.cast("double")

    def of(unit: str, power: int):
        return F.format_string(f"%.2f {unit}", F.bround(x / float(1 << power), 2))

    return F.when(n >= 1 << 30, of("GB", 30)).when(n >= 1 << 20, of("MB", 20)).when(n >= 1 << 10, of("KB", 10)).otherwise(F.format_string("%d B", n.cast("long")))


def categories(files: DataFrame, key: str, path: str) -> DataFrame:
    """Classes with sizes: file_class, n_files, n_projects."""
    return files.groupBy(file_class(F.col(path)).alias("file_class")).agg(F.count("*").alias("n_files"), F.countDistinct(key).alias("n_keys"))


def pair_headers(files: DataFrame) -> DataFrame:
    """group_key, source_path, header_path, rule: the first rule and, within it, the first header that fits.

    ``files`` has group_key and path.  A header fits if its path ends, at a folder's
    bound, in the expected path (its extension may be longer than ``.h``), or if its
    name is the expected name.  Both sides meet on keys that have one header each
    (the least path), so equal names do not multiply.
    """
    kind, norm = file_class(F.col("path")), F.replace(F.col("path"), F.lit("\\"), F.lit("/"))
    sources = files.where(kind == "source").select("group_key", F.col("path").alias("source_path"), norm.alias("norm")).distinct()
    headers = files.where(kind == "header").select("group_key", F.col("path").alias("header_path"), norm.alias("norm")).distinct()
    parts = F.split("norm", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    cut = F.transform(ends, lambda x: F.regexp_replace(x, r"\.h(?:pp|h|xx)$", ".h"))
    by_end = headers.select("group_key", "header_path", F.explode(F.array_union(ends, cut)).alias("expected")).groupBy("group_key", "expected").agg(F.min("header_path").alias("by_end"))
    by_name = headers.groupBy("group_key", file_name(F.col("norm")).alias("name")).agg(F.min("header_path").alias("by_name"))
    tried = []
    for i, (source, header) in enumerate(PAIRING_RULES):
        before, _, after = header.partition(r"\1")
        expected = F.when(F.col("norm").rlike(source), F.concat(F.lit(before), F.regexp_extract("norm", source, 1), F.lit(after)))
        tried.append(F.struct(F.lit(i).alias("rule"), expected.alias("expected")))
    wanted = sources.select("group_key", "source_path", F.explode(F.array(*tried)).alias("t")).select("group_key", "source_path", "t.rule", "t.expected").where("expected IS NOT NULL")
    met = wanted.join(by_end, ["group_key", "expected"], "left").withColumn("name", file_name(F.col("expected"))).join(by_name, ["group_key", "name"], "left")
    best = met.withColumn("header_path", F.least("by_end", "by_name")).where("header_path IS NOT NULL")
    return best.groupBy("group_key", "source_path").agg(F.min(F.struct("rule", "header_path")).alias("f")).select("group_key", "source_path", "f.header_path", "f.rule")


def pairing_categories(files: DataFrame) -> DataFrame:
    """group_key, path, category: paired sources and headers, individual ones, unrelated files."""
    pairs = pair_headers(files)
    paired = pairs.select("group_key", F.explode(F.array("source_path", "header_path")).alias("path")).distinct().withColumn("hit", F.lit(True))
    all_files = files.select("group_key", "path").distinct().join(paired, ["group_key", "path"], "left")
    kind = file_class(F.col("path"))
    return all_files.select("group_key", "path", F.when(F.col("hit"), "paired").when(kind != "unrelated", "individual").otherwise("unrelated").alias("category"))


def resolve_paths(paths: DataFrame, mappings: DataFrame) -> DataFrame:
    """path, resolved, rank: the source path that a path stands for.

    Ranks: 0 mapped target, 1 already a source, 2 same file name, 3 same stem and
    extension among targets, 4 same stem among targets, 5 a source of the stem with
    the extension swapped, 6 nothing but the name.  Each rank is one equi-join with a
    table that has one row for each key (the least source path), so no key multiplies.
    """
    m = mappings.where("source_path IS NOT NULL").select("source_path", "target_path")
    name_s, name_t = file_name(F.col("source_path")), file_name(F.col("target_path"))
    names = m.select(name_s.alias("k"), "source_path").unionAll(m.where("target_path IS NOT NULL").select(name_t.alias("k"), "source_path"))
    by = {
        0: (m.where("target_path IS NOT NULL").select(F.col("target_path").alias("k"), "source_path"), F.col("path")),
        1: (m.select(F.col("source_path").alias("k"), "source_path"), F.col("path")),
        2: (names, file_name(F.col("path"))),
        3: (m.where("target_path IS NOT NULL").select(F.concat_ws("|", file_stem(F.col("target_path")), F.lower(file_extension(F.col("target_path")))).alias("k"), "source_path"), F.concat_ws("|", file_stem(F.col("path")), F.lower(file_extension(F.col("path"))))),
        4: (m.where("target_path IS NOT NULL").select(file_stem(F.col("target_path")).alias("k"), "source_path"), file_stem(F.col("path"))),
        5: (m.select(file_stem(F.col("source_path")).alias("k"), "source_path"), file_stem(F.col("path"))),
    }
    out = paths.select("path").distinct()
    for rank, (pairs, key) in by.items():
        least = pairs.groupBy("k").agg(F.min("source_path").alias(f"r{rank}"))
        out = out.withColumn("k", key).join(least, "k", "left").drop("k")
    swapped = F.concat(F.regexp_replace("r5", r"\.[^./\\]*$", ""), F.lit("."), F.lower(file_extension(F.col("path"))))
    out = out.withColumn("r5", F.when(F.col("r5").isNotNull() & (file_extension(F.col("path")) != ""), swapped))
    rank = F.lit(6)
    for i in reversed(range(6)):
        rank = F.when(F.col(f"r{i}").isNotNull(), i).otherwise(rank)
    return out.select("path", F.coalesce(*(f"r{i}" for i in range(6)), file_name(F.col("path"))).alias("resolved"), rank.alias("rank"))


def parent_folders(paths: DataFrame) -> DataFrame:
    """Distinct folders that hold a .c or .h file."""
    return paths.where(F.lower(file_extension(F.col("path"))).isin("c", "h")).select(parent(F.col("path")).alias("folder")).distinct()


def throughput(files: DataFrame) -> DataFrame:
    """n_files, total_bytes, human, bytes_per_second (over the span of creation; 0 without one) of each project."""
    span = (F.max(F.unix_micros("created_at")) - F.min(F.unix_micros("created_at"))) / 1e6
    g = files.groupBy("project").agg(F.count("*").alias("n_files"), F.sum(F.octet_length("code")).alias("total_bytes"), span.alias("seconds"))
    return g.select("project", "n_files", "total_bytes", human_size(F.col("total_bytes")).alias("human"), F.coalesce(F.round(F.try_divide(F.col("total_bytes").cast("double"), F.col("seconds")), 4), F.lit(0.0)).alias("bytes_per_second"))


def _files(s, d):
    return table(s, d, "file_mappings").select(F.coalesce("project", F.lit("")).alias("group_key"), F.col("source_path").alias("path"))


_NAME, _STEM, _EXT = r"regexp_extract({0}, '([^/\\]*)$', 1)", r"CASE WHEN regexp_matches({0}, '^.+\.[^.]*$') THEN regexp_extract({0}, '^(.+)\.[^.]*$', 1) ELSE {0} END", r"regexp_extract({0}, '^.+\.([^.]*)$', 1)"


def _n(c):
    return _NAME.format(c)


def _st(c):
    return "(" + _STEM.format(_n(c)) + ")"


def _ex(c):
    return _EXT.format(_n(c))


_CLASS = f"CASE WHEN lower({{}}) IN ({', '.join(repr(x) for x in SOURCE_EXTENSIONS)}) THEN 'source' WHEN lower({{}}) IN ({', '.join(repr(x) for x in HEADER_EXTENSIONS)}) THEN 'header' ELSE 'unrelated' END"
_HUMAN = """CASE WHEN {0} >= 1073741824 THEN printf('%.2f GB', {0} / 1073741824.0) WHEN {0} >= 1048576 THEN printf('%.2f MB', {0} / 1048576.0)
    WHEN {0} >= 1024 THEN printf('%.2f KB', {0} / 1024.0) ELSE printf('%d B', {0}) END"""


def _class_sql(col):
    return _CLASS.format(_ex(col), _ex(col))


def _pairs_sql():
    rules = []
    for i, (source, header) in enumerate(PAIRING_RULES):
        before, _, after = header.partition(r"\1")
        rules.append(f"SELECT {i} AS rule, group_key, path AS source_path, '{before}' || regexp_extract(norm, '{source}', 1) || '{after}' AS expected FROM f WHERE kind = 'source' AND regexp_matches(norm, '{source}')")
    return rf"""WITH f AS (SELECT DISTINCT coalesce(project, '') AS group_key, source_path AS path, replace(source_path, '\', '/') AS norm, {_class_sql('source_path')} AS kind FROM file_mappings),
        w AS ({' UNION ALL '.join(rules)}),
        m AS (SELECT w.group_key, w.source_path, h.path AS header_path, w.rule, row_number() OVER (PARTITION BY w.group_key, w.source_path ORDER BY w.rule, h.path) AS rn
            FROM w JOIN f h ON h.kind = 'header' AND h.group_key = w.group_key AND (ends_with('/' || h.norm, '/' || w.expected)
                OR ends_with('/' || regexp_replace(h.norm, '\.h(pp|h|xx)$', '.h'), '/' || w.expected) OR {_n('h.norm')} = {_n('w.expected')}))"""


QUERIES = {
    "fn_path_parts": lambda s, d: table(s, d, "file_mappings").select("mapping_id", file_name(F.col("source_path")).alias("name"), file_stem(F.col("source_path")).alias("stem"), file_extension(F.col("source_path")).alias("extension"), parent(F.col("source_path")).alias("folder")),
    "filter_extension": lambda s, d: table(s, d, "file_mappings").where(file_class(F.col("source_path")) == "header").select("mapping_id", "source_path"),
    "filter_excluded": lambda s, d: table(s, d, "code_entries").where(excluded(F.coalesce("file_path", F.lit("")), ["*.min.js", "third_party/*", "*.h"])).select("id", "file_path"),
    "fn_relative_path": lambda s, d: table(s, d, "file_mappings").select("mapping_id", relative_to(F.col("source_path"), F.lit("/srv/checkouts/")).alias("relative")),
    "fn_human_size": lambda s, d: table(s, d, "code_entries").select("id", human_size(F.octet_length("code")).alias("size")),
    "agg_categories": lambda s, d: categories(table(s, d, "file_mappings"), "project", "source_path"),
    "join_pair_headers": lambda s, d: pair_headers(_files(s, d)),
    "set_pairing": lambda s, d: pairing_categories(_files(s, d)),
    "join_resolve_paths": lambda s, d: resolve_paths(table(s, d, "code_entries").where("file_path IS NOT NULL").select(F.col("file_path").alias("path")), table(s, d, "file_mappings")),
    "agg_parent_folders": lambda s, d: parent_folders(table(s, d, "file_mappings").select(F.col("source_path").alias("path"))),
    "agg_throughput": lambda s, d: throughput(table(s, d, "code_entries")),
}
ORACLE_SQL = {
    "fn_path_parts": rf"SELECT mapping_id, {_n('source_path')} AS name, {_st('source_path')} AS stem, {_ex('source_path')} AS extension, regexp_extract(source_path, '^(.*)[/\\][^/\\]*$', 1) AS folder FROM file_mappings",
    "filter_extension": f"SELECT mapping_id, source_path FROM file_mappings WHERE {_class_sql('source_path')} = 'header'",
    "filter_excluded": "SELECT id, file_path FROM code_entries WHERE file_path GLOB '*.min.js' OR file_path GLOB 'third_party/*' OR file_path GLOB '*.h'",
    "fn_relative_path": "SELECT mapping_id, CASE WHEN starts_with(source_path, '/srv/checkouts/') THEN substr(source_path, 16) ELSE source_path END AS relative FROM file_mappings",
    "fn_human_size": f"SELECT id, {_HUMAN.format('strlen(code)')} AS size FROM code_entries",
    "agg_categories": f"SELECT {_class_sql('source_path')} AS file_class, count(*) AS n_files, count(DISTINCT project) AS n_keys FROM file_mappings GROUP BY 1",
    "join_pair_headers": _pairs_sql() + " SELECT group_key, source_path, header_path, rule::INT AS rule FROM m WHERE rn = 1",
    "set_pairing": _pairs_sql() + """, p AS (SELECT group_key, source_path AS path FROM m WHERE rn = 1 UNION SELECT group_key, header_path FROM m WHERE rn = 1)
        SELECT f.group_key, f.path, CASE WHEN p.path IS NOT NULL THEN 'paired' WHEN kind <> 'unrelated' THEN 'individual' ELSE 'unrelated' END AS category FROM f LEFT JOIN p USING (group_key, path)""",
    "join_resolve_paths": rf"""WITH x AS (SELECT DISTINCT file_path AS path FROM code_entries WHERE file_path IS NOT NULL),
        y AS (SELECT path, (SELECT min(source_path) FROM file_mappings WHERE target_path = path) AS r0, (SELECT min(source_path) FROM file_mappings WHERE source_path = path) AS r1,
            (SELECT min(source_path) FROM file_mappings WHERE {_n('source_path')} = {_n('path')} OR {_n('target_path')} = {_n('path')}) AS r2,
            (SELECT min(source_path) FROM file_mappings WHERE {_st('target_path')} = {_st('path')} AND lower({_ex('target_path')}) = lower({_ex('path')})) AS r3,
            (SELECT min(source_path) FROM file_mappings WHERE {_st('target_path')} = {_st('path')}) AS r4,
            (SELECT CASE WHEN {_ex('path')} <> '' THEN regexp_replace(min(source_path), '\.[^./\\]*$', '') || '.' || lower({_ex('path')}) END FROM file_mappings WHERE {_st('source_path')} = {_st('path')}) AS r5 FROM x)
        SELECT path, coalesce(r0, r1, r2, r3, r4, r5, {_n('path')}) AS resolved, CASE WHEN r0 IS NOT NULL THEN 0 WHEN r1 IS NOT NULL THEN 1 WHEN r2 IS NOT NULL THEN 2 WHEN r3 IS NOT NULL THEN 3
            WHEN r4 IS NOT NULL THEN 4 WHEN r5 IS NOT NULL THEN 5 ELSE 6 END::INT AS rank FROM y""",
    "agg_parent_folders": rf"SELECT DISTINCT regexp_extract(source_path, '^(.*)[/\\][^/\\]*$', 1) AS folder FROM file_mappings WHERE lower({_ex('source_path')}) IN ('c', 'h')",
    "agg_throughput": f"""SELECT project, n_files, total_bytes, {_HUMAN.format('total_bytes')} AS human, coalesce(round(total_bytes / nullif(seconds, 0), 4), 0.0) AS bytes_per_second FROM (SELECT project, count(*) AS n_files,
        sum(strlen(code))::BIGINT AS total_bytes, (max(epoch_us(created_at)) - min(epoch_us(created_at))) / 1e6 AS seconds FROM code_entries GROUP BY project)""",
}
