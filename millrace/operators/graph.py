"""Include graphs: edges, resolution, folders, topological levels, reachability, build flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.code import shell_words
from millrace.operators import nested
from millrace.operators.paths import parent
from millrace.runtime import discard, materialise, table


def include_graph(relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: relation_id, path; edges: relation_id, path, include_kind, include), written once."""
    triples = materialise(nested.relation_triples(relations), "triples")
    nodes = nested.node_table(triples).where("path IS NOT NULL")
    edges = nested.include_table(triples).join(nodes.select("relation_id", "node", "path"), ["relation_id", "node"]).select("relation_id", "path", "include_kind", "include").distinct()
    return nodes.select("relation_id", "path").distinct(), edges


def resolve_includes(nodes: DataFrame, edges: DataFrame, roots: list[str]) -> DataFrame:
    """relation_id, path, include, resolved: beside the includer first, then under each root in order; null if it is none of the nodes."""
    folder = parent(F.col("path"))
    places = [F.when(folder == "", F.col("include")).otherwise(F.concat(folder, F.lit("/"), F.col("include")))]
    places += [F.col("include") if not r else F.concat(F.lit(r + "/"), F.col("include")) for r in roots]
    tried = edges.where("include_kind = 'local'").select("relation_id", "path", "include", F.posexplode(F.array(*places)).alias("rank", "candidate"))
    known = nodes.select("relation_id", F.col("path").alias("candidate"), F.lit(True).alias("exists"))
    met = tried.join(known, ["relation_id", "candidate"], "left")
    best = F.min(F.when(F.col("exists"), F.struct("rank", "candidate"))).alias("b")
    return met.groupBy("relation_id", "path", "include").agg(best).select("relation_id", "path", "include", F.col("b.candidate").alias("resolved"))


def folder_edges(resolved: DataFrame) -> DataFrame:
    """relation_id, folder, needs: file edges lifted to folders; unresolved files and edges within a folder are left out."""
    e = resolved.where("resolved IS NOT NULL").select("relation_id", parent(F.col("path")).alias("folder"), parent(F.col("resolved")).alias("needs"))
    return e.where("folder <> needs").distinct()


def in_degrees(edges: DataFrame) -> DataFrame:
    """relation_id, folder, n_needs: distinct dependencies of each folder."""
    return edges.groupBy("relation_id", "folder").agg(F.countDistinct("needs").alias("n_needs"))


def topological_levels(nodes: DataFrame, edges: DataFrame, keys: list[str], failed: DataFrame | None = None) -> DataFrame:
    """keys, level, outcome of every node of ``nodes`` (keys = group and node columns).

    ``edges`` has the keys and ``needs``.  A node is ready when all it needs are
    done; what failed (same keys) is processed but frees nothing.  Nodes never ready,
    as in a cycle or behind a failure, come out with level null as ``blocked``.  Each
    round takes the ready nodes off what waits for them and writes the state once; it
    ends when no node is ready, however deep the graph.
    """
    group, node = keys
    step = materialise(edges.select(group, F.col(node).alias("n"), "needs").distinct(), "steps")
    waits = step.groupBy(group, "n").agg(F.count("*").alias("waits"))
    bad = (failed.select(group, F.col(node).alias("n")).distinct() if failed is not None else nodes.select(group, F.col(node).alias("n")).limit(0)).withColumn("bad", F.lit(True))
    start = nodes.select(group, F.col(node).alias("n")).distinct().join(waits, [group, "n"], "left").join(bad, [group, "n"], "left")
    state = materialise(start.select(group, "n", F.coalesce("waits", F.lit(0)).alias("waits"), F.coalesce("bad", F.lit(False)).alias("bad"), F.when(F.coalesce("waits", F.lit(0)) == 0, 0).alias("level")), "state")
    level = 0
    while not state.where(F.col("level") == level).isEmpty():
        freed = state.where((F.col("level") == level) & ~F.col("bad")).select(group, F.col("n").alias("needs"))
        less = step.join(freed, [group, "needs"], "left_semi").groupBy(group, "n").agg(F.count("*").alias("less"))
        level += 1
        left = F.col("waits") - F.coalesce("less", F.lit(0))
        new = materialise(state.join(less, [group, "n"], "left").select(group, "n", left.alias("waits"), "bad", F.when((left == 0) & F.col("level").isNull(), level).otherwise(F.col("level")).alias("level")), "state")
        discard(state)
        state = new
    outcome = F.when(F.col("level").isNull(), "blocked").when(F.col("bad"), "failed").otherwise("done")
    return state.select(group, F.col("n").alias(node), "level", outcome.alias("outcome"))


def reachable(edges: DataFrame, start: DataFrame, group: str, depth: int | None = None) -> DataFrame:
    """group, root, node, hops: what each root reaches, by the shortest way; within ``depth`` steps if that is given."""
    step = materialise(edges.select(group, F.col("folder").alias("node"), "needs").distinct(), "steps")
    seen = materialise(start.select(group, F.col("folder").alias("root"), F.col("folder").alias("node"), F.lit(0).alias("hops")).distinct(), "seen")
    front, hop = seen, 0
    while depth is None or hop < depth:
        hop += 1
        nxt = front.join(step, [group, "node"]).select(group, "root", F.col("needs").alias("node"), F.lit(hop).alias("hops")).distinct()
        front = materialise(nxt.join(seen.select(group, "root", "node"), [group, "root", "node"], "left_anti"), "front")
        if front.isEmpty():
            break
        seen = seen.unionAll(front)
    return seen


def build_flags(command: str | None, root: str) -> dict[str, list[str]]:
    """include_dirs, link_dirs, link_libs of a command line; an operand is joined to its flag or follows it, relative folders are anchored."""
    out: dict[str, set[str]] = {"include_dirs": set(), "link_dirs": set(), "link_libs": set()}
    kinds = {"-I": "include_dirs", "-L": "link_dirs", "-l": "link_libs"}
    words = iter(shell_words(command or ""))
    for w in words:
        kind = kinds.get(w[:2])
        if kind is None:
            continue
        value = w[2:] or next(words, None)
        if value:
            out[kind].add(value if kind == "link_libs" or value.startswith("/") else f"{root.rstrip('/')}/{value}")
    return {k: sorted(v) for k, v in out.items()}


def _graph(s, d):
    return include_graph(table(s, d, "relation_files"))


def _resolved(s, d):
    nodes, edges = _graph(s, d)
    return nodes, resolve_includes(nodes, edges, ["", "include", "src", "lib"])


def _folders(s, d):
    nodes, r = _resolved(s, d)
    return nodes.select("relation_id", parent(F.col("path")).alias("folder")).distinct(), folder_edges(r)


def _levels(s, d):
    nodes, edges = _folders(s, d)
    return topological_levels(nodes, edges, ["relation_id", "folder"])


def _failed_levels(s, d):
    """Levels where every folder whose name ends in r fails."""
    nodes, edges = _folders(s, d)
    return topological_levels(nodes, edges, ["relation_id", "folder"], nodes.where(F.endswith("folder", F.lit("r"))))


def _edge_counts(s, d):
    _, edges = _graph(s, d)
    return edges.groupBy("relation_id").agg(F.count("*").alias("n_edges"), F.count_if(F.col("include_kind") == "local").alias("n_local"))


def _top_needed(s, d):
    _, r = _resolved(s, d)
    g = r.where("resolved IS NOT NULL").groupBy("relation_id", "resolved").agg(F.count("*").alias("n_users"))
    w = Window.partitionBy("relation_id").orderBy(F.desc("n_users"), "resolved")
    return g.withColumn("position", F.row_number().over(w)).where("position <= 5")


def _reach(s, d):
    nodes, edges = _folders(s, d)
    return reachable(edges, nodes, "relation_id")


QUERIES = {
    "graph_edges": lambda s, d: _graph(s, d)[1],
    "graph_resolved": lambda s, d: _resolved(s, d)[1],
    "graph_folder_edges": lambda s, d: _folders(s, d)[1],
    "graph_in_degrees": lambda s, d: in_degrees(_folders(s, d)[1]),
    "graph_levels": _levels,
    "graph_outcome": lambda s, d: _levels(s, d).groupBy("outcome").agg(F.count("*").alias("n_folders")),
    "graph_failed": _failed_levels,
    "graph_reachable": _reach,
    "agg_include_edges": _edge_counts,
    "top_needed": _top_needed,
}

# the same graph out of DuckDB's tree of JSON values; nodes lie under a "files" list, or under a "files" object that is no tree of folders
_NODES = f"""{nested._TREE}, n AS (SELECT DISTINCT x.relation_id, coalesce(p.text, x.key) AS path FROM t x JOIN t f ON f.relation_id = x.relation_id AND f.id = x.parent AND f.key = 'files'
        LEFT JOIN t p ON p.relation_id = x.relation_id AND p.parent = x.id AND p.key = 'path' AND p.type = 'VARCHAR'
        WHERE x.type = 'OBJECT' AND (f.type = 'ARRAY' OR NOT EXISTS (SELECT 1 FROM t y WHERE y.relation_id = f.relation_id AND y.parent = f.id AND y.key = 'dirs'))),
    e AS (SELECT DISTINCT i.relation_id, coalesce(p.text, x.key) AS path, replace(i.key, '_includes', '') AS include_kind, i.text AS include FROM i JOIN t x ON x.relation_id = i.relation_id AND x.id = i.parent
        LEFT JOIN t p ON p.relation_id = x.relation_id AND p.parent = x.id AND p.key = 'path' AND p.type = 'VARCHAR')"""
_FOLDER = r"regexp_extract({}, '^(.*)[/\\][^/\\]*$', 1)"
_RESOLVED = f"""{_NODES}, c AS (SELECT relation_id, path, include, unnest([0, 1, 2, 3, 4]) AS rank, unnest([CASE WHEN {_FOLDER.format('path')} = '' THEN include ELSE {_FOLDER.format('path')} || '/' || include END,
        include, 'include/' || include, 'src/' || include, 'lib/' || include]) AS candidate FROM e WHERE include_kind = 'local'),
    r AS (SELECT c.relation_id, c.path, c.include, arg_min(n.path, c.rank) FILTER (n.path IS NOT NULL) AS resolved FROM c LEFT JOIN n ON n.relation_id = c.relation_id AND n.path = c.candidate GROUP BY ALL)"""
_LIFTED = f"{_RESOLVED}, g AS (SELECT DISTINCT relation_id, {_FOLDER.format('path')} AS folder, {_FOLDER.format('resolved')} AS needs FROM r WHERE resolved IS NOT NULL AND {_FOLDER.format('path')} <> {_FOLDER.format('resolved')})"
# what lies on or behind a cycle is blocked; the rest has the length of its longest chain
_CLOSURE = f"""{_LIFTED.replace('WITH v AS', 'WITH RECURSIVE v AS', 1)}, d AS (SELECT DISTINCT relation_id, {_FOLDER.format('path')} AS folder FROM n),
    w AS (SELECT relation_id, folder, needs FROM g UNION SELECT w.relation_id, w.folder, g.needs FROM w JOIN g ON g.relation_id = w.relation_id AND g.folder = w.needs),
    b AS (SELECT DISTINCT relation_id, folder FROM w WHERE folder = needs UNION SELECT w.relation_id, w.folder FROM w JOIN (SELECT relation_id, folder FROM w WHERE folder = needs) z ON z.relation_id = w.relation_id AND z.folder = w.needs),
    h AS (SELECT relation_id, folder, 0 AS level FROM d UNION SELECT g.relation_id, g.folder, h.level + 1 FROM h JOIN g ON g.relation_id = h.relation_id AND g.needs = h.folder
        WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.relation_id = g.relation_id AND b.folder = g.folder)),
    o AS (SELECT d.relation_id, d.folder, CASE WHEN b.folder IS NULL THEN max(h.level) END::INT AS level, CASE WHEN b.folder IS NULL THEN 'done' ELSE 'blocked' END AS outcome
        FROM d JOIN h USING (relation_id, folder) LEFT JOIN b USING (relation_id, folder) GROUP BY d.relation_id, d.folder, b.folder)"""
ORACLE_SQL = {
    "graph_edges": f"{_NODES} SELECT * FROM e",
    "graph_resolved": f"{_RESOLVED} SELECT * FROM r",
    "graph_folder_edges": f"{_LIFTED} SELECT * FROM g",
    "graph_in_degrees": f"{_LIFTED} SELECT relation_id, folder, count(*) AS n_needs FROM g GROUP BY ALL",
    "graph_levels": f"{_CLOSURE} SELECT * FROM o",
    "graph_outcome": f"{_CLOSURE} SELECT outcome, count(*) AS n_folders FROM o GROUP BY 1",
    "graph_failed": f"""{_CLOSURE}, x AS (SELECT relation_id, folder FROM b UNION SELECT w.relation_id, w.folder FROM w WHERE ends_with(w.needs, 'r')),
        y AS (SELECT d.relation_id, d.folder, x.folder IS NOT NULL AS blocked FROM d LEFT JOIN x USING (relation_id, folder))
        SELECT y.relation_id, y.folder, CASE WHEN NOT blocked THEN o.level END AS level, CASE WHEN blocked THEN 'blocked' WHEN ends_with(y.folder, 'r') THEN 'failed' ELSE 'done' END AS outcome FROM y JOIN o USING (relation_id, folder)""",
    "graph_reachable": f"""{_CLOSURE}, q AS (SELECT relation_id, folder AS root, folder AS node, 0 AS hops FROM d UNION SELECT q.relation_id, q.root, g.needs, q.hops + 1 FROM q JOIN g ON g.relation_id = q.relation_id AND g.folder = q.node WHERE q.hops < 100)
        SELECT relation_id, root, node, min(hops)::INT AS hops FROM q GROUP BY ALL""",
    "agg_include_edges": f"{_NODES} SELECT relation_id, count(*) AS n_edges, count(*) FILTER (include_kind = 'local') AS n_local FROM e GROUP BY 1",
    "top_needed": f"""{_RESOLVED} SELECT relation_id, resolved, n_users, position FROM (SELECT relation_id, resolved, count(*) AS n_users, row_number() OVER (PARTITION BY relation_id ORDER BY count(*) DESC, resolved)::INT AS position
        FROM r WHERE resolved IS NOT NULL GROUP BY 1, 2) WHERE position <= 5""",
}
