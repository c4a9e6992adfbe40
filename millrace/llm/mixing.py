"""Mixing sources to target weights (problem 9).

Method: min-cost flow for overlapping sources.  A text can stand in several
sources.  Distinct texts are aggregated by membership pattern (the set of target
sources they stand in); token capacity flows from patterns through layers (first
use, second use, ...) to source quotas, where each further use costs more; then
texts are taken in a seeded order until each routed amount is reached.

The flow network has one node for each pattern and layer, never one for each
document.  The total defaults to the largest at which every quota can be filled.

Defined results: null and empty texts have no tokens and are never taken; equal
texts of one source are one item, under its least doc_id; a target source
without tokens reaches a share of 0, and the other targets keep their
proportions; without any capacity the mix is empty.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.slices import canonical_source
from millrace.llm.vocab import TOKENIZER_DIR, count_tokens
from millrace.runtime import materialise, sliced

#: Each pattern's seeded order is cut into this many ranges, so that no window is over a whole source.
RANGES = 4096


def min_cost_flow(arcs: list[tuple], source, sink) -> tuple[float, dict[int, float]]:
    """Largest flow of least cost: arcs (from, to, capacity, cost); returns (flow, flow by arc number)."""
    graph = defaultdict(list)
    edges: list[list] = []
    for u, v, cap, cost in arcs:
        graph[u].append(len(edges))
        edges.append([u, v, float(cap), float(cost)])
        graph[v].append(len(edges))
        edges.append([v, u, 0.0, -float(cost)])
    total, eps = 0.0, 1e-9 * (1 + max((a[2] for a in arcs), default=0))
    while True:
        dist, via, queue, queued = {source: 0.0}, {}, [source], {source}
        while queue:  # Bellman-Ford with a queue
            u = queue.pop(0)
            queued.discard(u)
            for e in graph[u]:
                _, v, cap, cost = edges[e]
                if cap > eps and dist[u] + cost < dist.get(v, float("inf")) - 1e-12:
                    dist[v], via[v] = dist[u] + cost, e
                    if v not in queued:
                        queue.append(v)
                        queued.add(v)
        if sink not in dist:
            return total, {i: edges[2 * i + 1][2] for i in range(len(arcs))}
        path, v = [], sink
        while v != source:
            path.append(via[v])
            v = edges[via[v]][0]
        amount = min(edges[e][2] for e in path)
        for e in path:
            edges[e][2] -= amount
            edges[e ^ 1][2] += amount
        total += amount


def _network(patterns: dict[tuple, float], targets: dict[str, tuple[float, int]], total: float) -> list[tuple]:
    arcs = []
    for p, tokens in sorted(patterns.items()):
        for k in range(1, max(targets[s][1] for s in p if s in targets) + 1):
            arcs.append(("in", (p, k), tokens, float((k - 1) ** 2)))
            arcs += [((p, k), s, tokens, 0.0) for s in p if s in targets and targets[s][1] >= k]
    return arcs + [(s, "out", share * total, 0.0) for s, (share, _) in sorted(targets.items())]


def route(patterns: dict[tuple, float], targets: dict[str, tuple[float, int]], total: float | None = None) -> tuple[float, dict[tuple, float]]:
    """(total, tokens by (pattern, layer, source)); sources without capacity are left out."""
    reached = {s for p in patterns if patterns[p] > 0 for s in p}
    live = {s: t for s, t in targets.items() if s in reached and t[0] > 0 and t[1] > 0}
    patterns = {p: v for p, v in patterns.items() if v > 0 and any(s in live for s in p)}
    scale = sum(t[0] for t in live.values())
    if not live or not patterns:
        return 0.0, {}
    live = {s: (share / scale, m) for s, (share, m) in live.items()}
    if total is None:
        low, high = 0.0, sum(v * max(live[s][1] for s in p if s in live) for p, v in patterns.items())
        for _ in range(60):
            mid = (low + high) / 2
            if min_cost_flow(_network(patterns, live, mid), "in", "out")[0] >= mid * (1 - 1e-6):
                low = mid
            else:
                high = mid
        total = low
    arcs = _network(patterns, live, total)
    _, flow = min_cost_flow(arcs, "in", "out")
    return total, {(*a[0], a[1]): f for a, f in zip(arcs, flow.values()) if isinstance(a[0], tuple) and f > 0}


def mix_items(documents: DataFrame, targets: list[str], tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """text_key, n_tokens, homes (sorted array of source, doc_id) of each distinct text of the target sources."""

    def run(batches):
        for b in batches:
            n = count_tokens(b.column(3).to_pylist(), tokenizer, folder)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(n, pa.int64())], names=["doc_id", "source", "text_key", "n_tokens"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), canonical_source(F.col("source")).alias("source"), F.md5("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    rows = rows.where(F.col("source").isin(targets) & F.col("text").isNotNull() & (F.col("text") != ""))
    counted = rows.mapInArrow(sliced(run), "doc_id long, source string, text_key string, n_tokens long")
    # equal texts shrink before the shuffle; then a text has at most one row for each source
    homes = counted.groupBy("text_key", "source").agg(F.min("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"))
    return homes.groupBy("text_key").agg(F.max("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("source", "doc_id"))).alias("homes"))


def mix(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 7, **tokens) -> DataFrame:
    """doc_id, source, n_tokens, n_uses of each document taken into the mix.

    ``targets`` is the short table source, target_share, max_repeats.
    """
    spark = documents.sparkSession
    goal = {r["source"]: (float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in targets.select(canonical_source(F.col("source")).alias("source"), "target_share", "max_repeats").collect()}
    unit = F.pmod(F.xxhash64("text_key", F.lit(seed)), F.lit(RANGES)).cast("int")
    items = materialise(mix_items(documents, sorted(goal), **tokens).withColumns({"pattern": F.transform("homes", lambda h: h["source"]), "range": unit}), "items")
    # at most (number of patterns) * RANGES rows
    ranges = items.groupBy("pattern", "range").agg(F.sum("n_tokens").alias("tokens"))
    capacity = {tuple(r["pattern"]): float(r["tokens"]) for r in ranges.groupBy("pattern").agg(F.sum("tokens").alias("tokens")).collect()}
    _, flows = route(capacity, goal, total_tokens)
    slots = []  # of a pattern's tokens in seeded order, [low, high) goes to a source in a layer
    at: dict[tuple, float] = defaultdict(float)
    for (p, k, s), f in sorted(flows.items()):
        slots.append((list(p), s, at[(p, k)], at[(p, k)] + f))
        at[(p, k)] += f
    plan = spark.createDataFrame(slots, "pattern array<string>, source string, low double, high double")
    before = ranges.withColumn("base", F.sum("tokens").over(Window.partitionBy("pattern").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)))
    inside = F.sum("n_tokens").over(Window.partitionBy("pattern", "range").orderBy("text_key").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = items.withColumn("inside", inside).join(before.select("pattern", "range", "base"), ["pattern", "range"])
    # a text belongs where its middle lies
    middle = F.coalesce("base", F.lit(0)) + F.col("inside") - F.col("n_tokens") / 2
    taken = placed.withColumn("middle", middle).join(F.broadcast(plan), "pattern").where("middle >= low AND middle < high")
    uses = taken.groupBy("text_key", "source").agg(F.count("*").alias("n_uses"), F.first("n_tokens").alias("n_tokens"), F.first("homes").alias("homes"))
    home = F.filter("homes", lambda h: h["source"] == F.col("source"))[0]["doc_id"]
    return uses.select(home.alias("doc_id"), "source", "n_tokens", "n_uses")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, max_repeats, n_documents, most_uses, mixed_tokens, actual_share."""
    got = mixed.groupBy("source").agg(F.count("*").alias("n_documents"), F.max("n_uses").alias("most_uses"), F.sum(F.col("n_tokens") * F.col("n_uses")).alias("mixed_tokens"))
    zero = F.lit(0).cast("long")
    out = targets.select(canonical_source(F.col("source")).alias("source"), "target_share", "max_repeats").join(got, "source", "left").select(
        "source", "target_share", "max_repeats", *(F.coalesce(c, zero).alias(c) for c in ("n_documents", "most_uses", "mixed_tokens"))
    )
    whole = F.sum("mixed_tokens").over(Window.partitionBy())  # one row for each target
    return out.withColumn("actual_share", F.coalesce(F.try_divide(F.col("mixed_tokens").cast("double"), whole), F.lit(0.0)))
