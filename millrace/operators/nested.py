"""Deeply nested records to related flat tables (problem 4).

Each JSON text is read once by an event parser that yields path-value-ordinal
triples.  Paths are grouped by their repeated ancestor, and every group is pivoted
into one table; child rows carry the keys of their parents.

What repeats is found from the record itself: the elements of an array, and the
members of an object keyed by data, that is, one whose values are all objects and of
whose names at least one is no identifier (``src/a.c``), or which bears one of the
names ``keyed``.  A group is named by the members that lead to it (``files[]``,
``files{}.includes[]``); a group that repeats within itself, as folders within
folders, is one group.  Every scalar of the record becomes a field of its nearest
repeated ancestor, so nothing that a writer adds is lost; the tables of relations,
nodes, includes and build settings are views of the groups.

A record is held until its last character is read: a broken one gives no rows.

Defined results: a null, blank or broken text gives no rows in any table; a
node without ``path`` takes its key; an include list that is missing or null
gives no includes, a bare string one, an object its ``path``; repeated values
stay in the include table (``ordinal`` tells them apart) and are one row in
``distinct_includes``; repeated input rows give repeated keys only once, and of texts
that differ under one id the greatest value of each field.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.runtime import materialise, sliced, table

_TOKEN = re.compile(
    r'[ \t\r\n]*(?:(?P<s>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(?P<p>[{}\[\]:,])'
    r"|(?P<n>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)(?![0-9A-Za-z.])|(?P<w>true|false|null)(?![0-9A-Za-z]))"
)
_ESCAPE = re.compile(r'\\(?:u([0-9a-fA-F]{4})|(.))')
#: The short escapes of JSON.
_SHORT = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}


def _unquote(raw: str) -> str:
    body = raw[1:-1]
    if "\\" not in body:
        return body
    out = _ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] else _SHORT.get(m[2], m[2]), body)
    # join surrogate pairs, replace lone halves
    return out.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def stream_triples(text: str) -> Iterator[tuple[tuple, str | None, str]]:
    """Yield ``(path, value, kind)`` for each scalar, and for each opened container
    (kind ``object`` or ``array``), in document order.

    ``path`` holds names of members and ordinals of array elements.  Raises
    ``ValueError`` at the first character that is no JSON.
    """
    pos, end = 0, len(text)
    path: list = []
    stack: list[str] = []  # "{" or "["
    state = "value"  # value, key (or close), comma (or close), value_or_close, key_only
    while True:
        m = _TOKEN.match(text, pos)
        if not m:
            if text[pos:].strip(" \t\r\n") == "" and not stack and state == "done":
                return
            raise ValueError(f"no JSON at {pos} of {end}")
        pos = m.end()
        kind, tok = m.lastgroup, m[m.lastgroup]
        if state == "done":
            raise ValueError("text after the value")
        if kind == "p" and tok in "}]":
            if not stack or {"{": "}", "[": "]"}[stack[-1]] != tok or state not in ("comma", "key", "value_or_close"):
                raise ValueError(f"stray {tok}")
            if state == "value_or_close" or (state == "comma" and stack[-1] == "[") or (state == "comma" and stack[-1] == "{"):
                path.pop()
            stack.pop()
            state = "comma" if stack else "done"
        elif kind == "p" and tok == ",":
            if state != "comma":
                raise ValueError("stray comma")
            if stack[-1] == "[":
                path[-1] += 1
                state = "value"
            else:
                path.pop()
                state = "key_only"
        elif state in ("key", "key_only"):
            if kind != "s":
                raise ValueError("a name is missing")
            path.append(_unquote(tok))
            m = re.compile(r"[ \t\r\n]*:").match(text, pos)
            if not m:
                raise ValueError("a colon is missing")
            pos = m.end()
            state = "value"
        elif state in ("value", "value_or_close"):
            if kind == "p":
                if tok not in "{[":
                    raise ValueError(f"stray {tok}")
                yield tuple(path), None, "object" if tok == "{" else "array"
                stack.append(tok)
                if tok == "[":
                    path.append(0)
                    state = "value_or_close"
                else:
                    state = "key"
            else:
                value = _unquote(tok) if kind == "s" else None if tok == "null" else tok
                yield tuple(path), value, "string" if kind == "s" else "null" if tok == "null" else "scalar"
                state = "comma" if stack else "done"
        else:
            raise ValueError("a comma is missing")


#: An object with such a member name and values that are objects may still be a plain record.
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_-]*\Z")
#: Members of objects under these names are rows, whatever the members are called.
KEYED = ("files",)


def _pointer(path: tuple) -> str:
    """Key of a row within its record: the steps that lead to it, each after a slash."""
    return "".join("/" + (str(p) if isinstance(p, int) else p.replace("~", "~0").replace("/", "~1")) for p in path)


def group_triples(text: str | None, keyed: tuple[str, ...] = KEYED) -> list[tuple]:
    """``(grp, row, parent_grp, parent, ordinal, key, field, value, kind)`` of one record, in document order.

    ``row`` is the repeated ancestor of the value, ``parent`` that of the row; the record
    itself is row ``""`` of group ``record``.  Each row has one triple without field, whose
    kind is that of the element.
    """
    if text is None or not text.strip():
        return []
    try:
        triples = list(stream_triples(text))
    except ValueError:
        return []
    arrays: set[tuple] = set()
    objects: dict[tuple, list[bool]] = {}  # values are objects or null, some object, a name or the object's own tells data
    for p, _, kind in triples:
        if p and (o := objects.get(p[:-1])) is not None:
            o[0] &= kind in ("object", "null")
            o[1] |= kind == "object"
            o[2] |= not _IDENTIFIER.match(p[-1])
        if kind == "array":
            arrays.add(p)
        elif kind == "object":
            objects[p] = [True, False, bool(p) and p[-1] in keyed]
    out: list[tuple] = []
    # prefix -> (steps of the group, row, parent group, parent, ordinal, key, fields so far)
    where: dict[tuple, tuple] = {}
    for p, value, kind in triples:
        if not p:
            here = ((), "", None, None, 0, None, ())
            new = True
        else:
            steps, row, up_grp, up, ordinal, key, fields = where[p[:-1]]
            new = p[:-1] in arrays or all(objects[p[:-1]])
            if new:
                step = ".".join(fields) + ("{}" if p[:-1] in objects else "[]")
                again = next((k for k, s in enumerate(steps) if s == step or s.endswith("." + step)), None)
                inner = (*steps, step) if again is None else steps[: again + 1]
                place = p[-1] if isinstance(p[-1], int) else 0
                here = (inner, _pointer(p), ".".join(steps) or "record", row, place, p[-1] if isinstance(p[-1], str) else None, ())
            else:
                here = (steps, row, up_grp, up, ordinal, key, (*fields, p[-1]))
        steps, row, up_grp, up, ordinal, key, fields = here
        head = (".".join(steps) or "record", row, up_grp, up, ordinal, key)
        if kind in ("object", "array"):
            where[p] = here
            if new:
                out.append((*head, None, None, kind))
        else:
            if new:
                out.append((*head, None, None, kind))
            out.append((*head, ".".join(fields) or "value", value, kind))
    return out


_COLUMNS = "grp string, row string, parent_grp string, parent string, ordinal int, key string, field string, value string, kind string"


def flatten_records(df: DataFrame, id_col: str, text_col: str, keyed: tuple[str, ...] = KEYED) -> DataFrame:
    """``id_col``, grp, row, parent_grp, parent, ordinal, key, field, value, kind of all records."""
    id_type = df.schema[id_col].dataType.simpleString()
    names = [c.split()[0] for c in _COLUMNS.split(", ")]
    types = [pa.int32() if n == "ordinal" else pa.string() for n in names]

    def run(batches):
        for b in batches:
            at, rows = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                got = group_triples(text, keyed)
                at += [i] * len(got)
                rows += got
                if len(rows) > 50_000:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], ["doc", *names])
                    at, rows = [], []
            if rows:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], ["doc", *names])

    kept = df.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    return kept.mapInArrow(sliced(run), f"doc {id_type}, {_COLUMNS}").withColumnRenamed("doc", id_col)


def _field(name: str) -> Column:
    return F.max(F.when(F.col("field") == name, F.col("value")))


def group_table(triples: DataFrame, id_col: str, grp: str, fields: list[str], rest: bool = False) -> DataFrame:
    """One row for each row of the group: ``id_col``, row, parent, ordinal, key and its fields.

    Fields that would clash with these names get an underscore behind.  With ``rest``, all
    other fields come in a map of that name.
    """
    taken = {id_col, "row", "parent", "ordinal", "key", "rest"}
    cols = [_field(f).alias(f + "_" if f in taken else f) for f in fields]
    if rest:
        other = F.col("field").isNotNull() & ~F.coalesce(F.col("field").isin(fields), F.lit(False))
        # one value for each field: a repeated record repeats its triples
        pairs = F.array_distinct(F.array_sort(F.collect_list(F.when(other, F.struct("field", "value")))))
        cols.append(F.map_from_entries(F.filter(pairs, lambda x: ~F.exists(pairs, lambda y: (y["field"] == x["field"]) & (y["value"] > x["value"])))).alias("rest"))
    return triples.where(F.col("grp") == grp).groupBy(id_col, "row").agg(F.first("parent").alias("parent"), F.max("ordinal").alias("ordinal"), F.max("key").alias("key"), *cols)


def group_tables(triples: DataFrame, id_col: str, most_fields: int = 500) -> dict[str, DataFrame]:
    """group -> its table, for all groups of the records.

    The names of groups and fields come to the driver, at most ``most_fields`` of each
    group and as many groups, the most frequent ones; further fields are in the map
    ``rest``, and the rows of further groups together in a table ``others`` as triples.
    """
    named = triples.where("field IS NOT NULL").groupBy("grp", "field").agg(F.count("*").alias("n"))
    order = Window.partitionBy("grp").orderBy(F.desc("n"), "field")
    listed = named.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most_fields + 1)
    sizes = triples.where("field IS NULL").groupBy("grp").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "grp").limit(most_fields + 1)
    groups = [r["grp"] for r in sizes.collect()]
    fields: dict[str, list[str]] = {g: [] for g in groups[:most_fields]}
    for r in listed.where(F.col("grp").isin(groups[:most_fields])).orderBy("grp", "k").collect():
        fields[r["grp"]].append(r["field"])
    out = {g: group_table(triples, id_col, g, names[:most_fields], len(names) > most_fields) for g, names in fields.items()}
    if len(groups) > most_fields:
        out["others"] = triples.where(~F.col("grp").isin(groups[:most_fields])).distinct()
    return out


_NODE = r"(?:^|\.)files(?:\[\]|\{\})$"
_INCLUDE = r"(?:^|\.)files(?:\[\]|\{\})\.(local|system)_includes\[\]$"
_BARE = r"^(local|system)_includes(?:\.path)?$"


def relation_triples(df: DataFrame, id_col: str = "relation_id", text_col: str = "relation") -> DataFrame:
    """The triples of relation files, with ``relation_id`` as a number."""
    return flatten_records(df.select(F.col(id_col).cast("long").alias("relation_id"), F.col(text_col).alias("relation")), "relation_id", "relation")


def _deepest(name: str) -> Column:
    """A text of the record under ``name``, within an envelope or not."""
    hit = F.col("field").rlike(rf"(?:^|\.){name}$") & (F.col("kind") == "string")
    return F.max_by(F.when(hit, F.col("value")), F.when(hit, F.length("field"))).alias(name)


def relation_table(triples: DataFrame) -> DataFrame:
    """One row for each well-formed record: relation_id, workspace, generated_at."""
    return triples.where("grp = 'record'").groupBy("relation_id").agg(_deepest("workspace"), _deepest("generated_at"))


def node_table(triples: DataFrame) -> DataFrame:
    """One row for each file node: relation_id, node, path, size."""
    got = triples.where(F.col("grp").rlike(_NODE)).groupBy("relation_id", F.col("row").alias("node")).agg(_field("path").alias("path"), F.max("key").alias("key"), _field("size").alias("size"), F.bool_or(F.col("field").isNull() & (F.col("kind") == "object")).alias("is_node"))
    return got.where("is_node").select("relation_id", "node", F.coalesce("path", "key").alias("path"), F.expr("try_cast(size AS bigint)").alias("size"))


def _included() -> tuple[Column, Column, Column]:
    """(kind, node, is an include) of a triple."""
    listed = F.regexp_extract("grp", _INCLUDE, 1)
    bare = F.when(F.col("grp").rlike(_NODE), F.regexp_extract("field", _BARE, 1)).otherwise("")
    in_list = (listed != "") & F.col("field").isin("value", "path")
    return F.when(in_list, listed).otherwise(bare), F.when(listed != "", F.col("parent")).otherwise(F.col("row")), (F.col("kind") == "string") & F.col("field").isNotNull() & (in_list | (bare != ""))


def include_table(triples: DataFrame) -> DataFrame:
    """One row for each include as stored: relation_id, node, include_kind, ordinal, include."""
    kind, node, is_include = _included()
    ordinal = F.when(F.col("grp").rlike(_NODE), F.lit(0)).otherwise(F.col("ordinal"))
    return triples.where(is_include).select("relation_id", node.alias("node"), kind.alias("include_kind"), ordinal.alias("ordinal"), F.col("value").alias("include")).distinct()


def build_table(triples: DataFrame) -> DataFrame:
    """One row for each build setting: relation_id, setting, ordinal, value."""
    setting = F.regexp_extract("grp", r"(?:^|\.)build\.([^.]+)\[\]$", 1)
    return triples.where((setting != "") & (F.col("field") == "value") & (F.col("kind") == "string")).select("relation_id", setting.alias("setting"), "ordinal", "value").distinct()


def distinct_includes(df: DataFrame) -> DataFrame:
    """relation_id, path, include_kind, include: each distinct include of each node.

    Node paths and their includes are pivoted out of one pass over the triples:
    grouping by node puts both on one row, so no join is needed.
    """
    t = relation_triples(df).where(F.col("grp").rlike(_NODE) | F.col("grp").rlike(_INCLUDE))
    kind, node, is_include = _included()
    of_node = F.col("grp").rlike(_NODE)
    pair = F.struct(kind.alias("include_kind"), F.col("value").alias("include"))
    per_node = t.groupBy("relation_id", node.alias("node")).agg(
        F.max(F.when(of_node & (F.col("field") == "path"), F.col("value"))).alias("path"),
        F.max(F.when(of_node, F.col("key"))).alias("key"),
        F.collect_set(F.when(is_include, pair)).alias("includes"),
    )
    flat = per_node.select("relation_id", F.coalesce("path", "key").alias("path"), F.explode("includes").alias("i"))
    return flat.select("relation_id", "path", "i.include_kind", "i.include").where("path IS NOT NULL").distinct()


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return distinct_includes(table(spark, folder, "relation_files"))


def _triples(spark: SparkSession, folder: str) -> DataFrame:
    return relation_triples(table(spark, folder, "relation_files"))


def p4_relations(spark: SparkSession, folder: str) -> DataFrame:
    return relation_table(_triples(spark, folder))


def p4_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return node_table(_triples(spark, folder))


def p4_includes(spark: SparkSession, folder: str) -> DataFrame:
    return include_table(_triples(spark, folder))


def p4_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Every row of every group with its parent and its number of fields."""
    return _triples(spark, folder).groupBy("relation_id", "row", "parent").agg(F.count("field").alias("n_fields"), F.coalesce(F.sum(F.when(F.col("kind") == "string", F.length("value"))), F.lit(0)).alias("n_chars"))


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of each table the records fall into."""
    tables = group_tables(materialise(_triples(spark, folder), "triples"), "relation_id")
    counts = [t.agg(F.lit(g).alias("grp"), F.count("*").alias("n_rows")) for g, t in tables.items()]
    return reduce(DataFrame.unionAll, counts) if counts else spark.createDataFrame([], "grp string, n_rows long")


def scan_build(spark: SparkSession, folder: str) -> DataFrame:
    return build_table(_triples(spark, folder))


QUERIES = {"scan_build": scan_build, "p4_found": p4_found, "p4_relations": p4_relations, "p4_nodes": p4_nodes, "p4_includes": p4_includes, "p4_rows": p4_rows, "p4_groups": p4_groups}

_TREE = """WITH v AS (SELECT DISTINCT relation_id, relation FROM relation_files WHERE json_valid(relation)), t AS (SELECT v.relation_id, j.key, j.type, j.id, j.parent, j.atom->>'$' AS text FROM v, json_tree(v.relation) j),
    l AS (SELECT * FROM t WHERE key IN ('local_includes', 'system_includes')),
    i AS (SELECT relation_id, parent, key, text FROM l WHERE type = 'VARCHAR'
        UNION ALL SELECT l.relation_id, l.parent, l.key, c.text FROM l JOIN t c ON c.relation_id = l.relation_id AND c.parent = l.id WHERE c.type = 'VARCHAR'
        UNION ALL SELECT l.relation_id, l.parent, l.key, p.text FROM l JOIN t c ON c.relation_id = l.relation_id AND c.parent = l.id JOIN t p ON p.relation_id = c.relation_id AND p.parent = c.id
            WHERE c.type = 'OBJECT' AND p.key = 'path' AND p.type = 'VARCHAR')"""
# rows are elements of arrays and members of objects keyed by data; each value belongs to the nearest row above it
_ROWS = f"""{_TREE.replace('WITH v AS', 'WITH RECURSIVE v AS', 1)}, o AS (SELECT t.relation_id, t.id, t.type = 'ARRAY' OR (t.type = 'OBJECT' AND count(*) FILTER (c.type = 'OBJECT') > 0 AND count(*) FILTER (c.type NOT IN ('OBJECT', 'NULL')) = 0
        AND (coalesce(t.key = 'files', false) OR count(*) FILTER (NOT regexp_full_match(c.key, '[A-Za-z_][A-Za-z0-9_-]*')) > 0)) AS holds FROM t JOIN t c ON c.relation_id = t.relation_id AND c.parent = t.id GROUP BY t.relation_id, t.id, t.type, t.key),
    w AS (SELECT relation_id, id, type, text, '' AS at, '' AS "row", NULL::VARCHAR AS parent, NULL::VARCHAR AS row_key, type AS row_type, NULL::VARCHAR AS field, 0 AS ordinal FROM t WHERE parent IS NULL
        UNION ALL SELECT t.relation_id, t.id, t.type, t.text, w.at || '/' || replace(replace(t.key, '~', '~0'), '/', '~1'), CASE WHEN o.holds THEN w.at || '/' || replace(replace(t.key, '~', '~0'), '/', '~1') ELSE w."row" END,
            CASE WHEN o.holds THEN w."row" ELSE w.parent END, CASE WHEN NOT o.holds THEN w.row_key WHEN w.type = 'OBJECT' THEN t.key END, CASE WHEN o.holds THEN t.type ELSE w.row_type END,
            CASE WHEN o.holds THEN NULL ELSE concat_ws('.', w.field, t.key) END, CASE WHEN NOT o.holds THEN w.ordinal WHEN w.type = 'ARRAY' THEN t.key::INT ELSE 0 END
        FROM t JOIN w ON w.relation_id = t.relation_id AND w.id = t.parent JOIN o ON o.relation_id = t.relation_id AND o.id = t.parent)"""
_FILE_NODE = """(SELECT w.* FROM w JOIN t x ON x.relation_id = w.relation_id AND x.id = w.id JOIN t f ON f.relation_id = x.relation_id AND f.id = x.parent AND f.key = 'files' JOIN o ON o.relation_id = f.relation_id AND o.id = f.id AND o.holds WHERE w.type = 'OBJECT')"""
ORACLE_SQL = {
    "scan_build": f"""{_TREE} SELECT DISTINCT b.relation_id, k.key AS setting, c.key::INT AS ordinal, c.text AS value FROM t b JOIN t k ON k.relation_id = b.relation_id AND k.parent = b.id JOIN t c ON c.relation_id = k.relation_id AND c.parent = k.id
        WHERE b.key = 'build' AND k.type = 'ARRAY' AND c.type = 'VARCHAR'""",
    "p4_relations": """SELECT DISTINCT relation_id, coalesce(relation->>'$.workspace', relation->>'$.payload.relation.workspace') AS workspace, coalesce(relation->>'$.generated_at', relation->>'$.payload.relation.generated_at') AS generated_at
        FROM relation_files WHERE json_valid(relation)""",
    "p4_found": f"""{_TREE} SELECT DISTINCT i.relation_id, coalesce(p.text, n.key) AS path, replace(i.key, '_includes', '') AS include_kind, i.text AS include FROM i JOIN t n ON n.relation_id = i.relation_id AND n.id = i.parent
        LEFT JOIN t p ON p.relation_id = n.relation_id AND p.parent = n.id AND p.key = 'path' AND p.type = 'VARCHAR'""",
    "p4_nodes": f"""{_ROWS}, n AS {_FILE_NODE} SELECT n.relation_id, n."row" AS node, coalesce(max(w.text) FILTER (w.field = 'path'), any_value(n.row_key)) AS path, try_cast(max(w.text) FILTER (w.field = 'size') AS BIGINT) AS size
        FROM n JOIN w ON w.relation_id = n.relation_id AND w."row" = n."row" GROUP BY ALL""",
    "p4_includes": f"""{_ROWS}, n AS {_FILE_NODE}, g AS (SELECT n.relation_id, n."row" AS node, l.id, l.key, l.type, l.text FROM n JOIN l ON l.relation_id = n.relation_id AND l.parent = n.id)
        SELECT DISTINCT * FROM (SELECT relation_id, node, replace(key, '_includes', '') AS include_kind, 0 AS ordinal, text AS include FROM g WHERE type = 'VARCHAR'
        UNION ALL SELECT g.relation_id, g.node, replace(g.key, '_includes', ''), c.key::INT, c.text FROM g JOIN t c ON c.relation_id = g.relation_id AND c.parent = g.id WHERE g.type = 'ARRAY' AND c.type = 'VARCHAR'
        UNION ALL SELECT g.relation_id, g.node, replace(g.key, '_includes', ''), c.key::INT, p.text FROM g JOIN t c ON c.relation_id = g.relation_id AND c.parent = g.id JOIN t p ON p.relation_id = c.relation_id AND p.parent = c.id WHERE g.type = 'ARRAY' AND p.key = 'path' AND p.type = 'VARCHAR')""",
    "p4_rows": f"""{_ROWS} SELECT relation_id, "row", any_value(parent) AS parent, count(*) FILTER (type NOT IN ('OBJECT', 'ARRAY')) AS n_fields, coalesce(sum(length(text)) FILTER (type = 'VARCHAR'), 0)::BIGINT AS n_chars FROM w GROUP BY relation_id, "row" """,
}
