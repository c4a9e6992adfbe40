"""Near-duplicate code by meet-in-the-middle ball hashing (problem 3).

Two entries are near-duplicates if they have at least ``share`` of the lines of
the longer one in common, in any order, without comments, blank lines,
indentation and line ends.

Lines are hashed; the k-th repeat of a line within a text gets its own hash, so
that multisets become sets.  Texts with equal line sets form one class and only
its representative goes on.

Method: the lines of a text are dealt into buckets by their hash.  The
fingerprint of a bucket is the sum of its line hashes.  Each bucket emits every
variant within half the radius, which is the fingerprint itself and the
fingerprint less one line; two texts that differ by up to one line on either
side of some bucket (radius two) meet on a common variant.  The number of
buckets exceeds a quarter of the lines, so by the pigeonhole principle texts
over the threshold have such a bucket.  Variants are shuffled, collisions
deduplicated, and each colliding pair is verified on the whole line sets.

A variant is emitted only if an informative line is left in it: one that occurs
in at most ``common`` of all texts (or in 16).  There are at most (lines per text /
``common``) other lines, which bounds the table of them that is broadcast.  A
text of which fewer than half the lines are informative counts all lines as
informative, so large groups of near-copies still meet.

The bucket of the pigeonhole principle may hold no informative line that both
texts share, and then its variants are not emitted.  Each text therefore emits
its first lines as well, in one order of all lines (rarest first) that is the
same for every text: of texts that share at least ceil(3n/4) lines, the first
n - ceil(3n/4) + k lines have k in common, whatever their buckets hold.  Pairs
of up to ``SHORT`` lines are candidates with k = 1, longer ones with k =
``LEAST_MET``.  The candidates are exact by these keys; all of them are informative
lines unless fewer than half of a text's lines are.

Defined results: rows whose code is null, or has no line left, are in no pair; a
null language counts as code; repeated ids count once.  Line hashes have 64 bits; texts
are equal if two hashes of 64 bits over all their lines are, and a key that two
unequal texts share is replaced by one of both hashes.

A variant on which very many texts meet is no single task: the adaptive skew join deals
its partition over many.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.slices import canonical_language, is_code
from millrace.runtime import discard, materialise, sliced

SHARE_NUM, SHARE_DEN = 3, 4
COMMON, COMMON_LEAST = 1e-4, 16
#: Pairs whose longer text has more than SHORT lines must meet on LEAST_MET of their rarest lines.
SHORT, LEAST_MET = 15, 3

_C_LIKE = re.compile(r'//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\[^\n]{1,8}?)\'', re.S)
_PYTHON = re.compile(r'#[^\n]*|"""(?:[^\\]|\\.)*?"""|\'\'\'(?:[^\\]|\\.)*?\'\'\'|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'', re.S)
_LINE_END = re.compile(r"\r\n?|\n")


def code_lines(code: str, language: str) -> list[str]:
    """Lines of code without comments, blank lines, indentation and line ends."""
    if language == "python":
        if "#" in code:
            code = _PYTHON.sub(lambda m: "" if m[0][0] == "#" else m[0], code)
    elif "//" in code or "/*" in code:
        code = _C_LIKE.sub(lambda m: "" if m[0][0] == "/" else m[0], code)
    return [s for ln in _LINE_END.split(code) if (s := ln.strip())]


def line_set(code: str, language: str) -> list[int]:
    seen: dict[str, int] = {}
    out = []
    h = xxhash.xxh3_64_intdigest
    for ln in code_lines(code, language):
        k = seen[ln] = seen.get(ln, -1) + 1
        out.append(h(ln, k))
    return out


def entry_lines(entries: DataFrame) -> DataFrame:
    """id, text_key, check, n_lines, lines (sorted 64-bit hashes) of every row that is code."""

    def run(batches):
        for b in batches:
            flat, sizes, keys, checks = [], [], [], []
            for code, lang in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                got = np.array(line_set(code, lang), np.uint64)
                got.sort()
                keys.append(xxhash.xxh3_64_intdigest(got.tobytes()))
                checks.append(xxhash.xxh3_64_intdigest(got.tobytes(), 1))
                flat.append(got.view(np.int64))
                sizes.append(len(got))
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat) if flat else np.array([], np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(np.array(checks, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), lists], ["id", "text_key", "check", "n_lines", "lines"])

    kept = entries.where(is_code(F.col("language")) & F.col("code").isNotNull() & F.col("id").isNotNull())
    return kept.select(F.col("id").cast("string").alias("id"), F.col("code").cast("string").alias("code"), canonical_language(F.col("language")).alias("language")).mapInArrow(sliced(run), "id string, text_key long, check long, n_lines int, lines array<long>").where("n_lines > 0")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def rungs(n: int, num: int = SHARE_NUM, den: int = SHARE_DEN) -> list[int]:
    """Numbers of buckets under which a text of ``n`` lines emits.

    Rung k serves pairs whose longer text has 2**k .. 2**(k+1)-1 lines; a text is
    in the rungs of every length that the longer partner may have.
    """
    longest = n * den // num
    out = []
    for k in range(n.bit_length() - 1, longest.bit_length()):
        top = min(longest, 2 ** (k + 1) - 1)
        if top >= max(n, 2**k):
            # a bucket fails only if a side has two odd lines in it; each side has at most top/4 of them
            out.append((k, (2 ** (k + 1) - 1) * (den - num) // den + 1))
    return [b for _, b in out]


def ball_variants(keys: np.ndarray, sizes: np.ndarray, lines: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(variant, text key) of every bucket fingerprint and of it less one line."""
    if not len(keys):
        return np.array([], np.int64), np.array([], np.int64)
    doc = np.repeat(np.arange(len(keys)), sizes)
    known = np.ones(len(lines), bool)
    if len(common):
        at = np.minimum(np.searchsorted(common, lines), len(common) - 1)
        known = common[at] != lines
    poor = np.bincount(doc, known, len(keys)) * 2 < sizes
    known |= poor[doc]
    u = lines.view(np.uint64)
    h, deal = _mix(u), _mix(u + np.uint64(0x632BE59BD9B4E019))
    by_size = {n: rungs(n) for n in set(sizes.tolist())}
    most = max(map(len, by_size.values()))
    variants, owners = [], []
    for r in range(most):
        b_of_doc = np.array([by_size[n][r] if r < len(by_size[n]) else 0 for n in sizes.tolist()], np.uint64)
        b = b_of_doc[doc]
        use = b > 0
        if not use.any():
            continue
        d, hh, kk, b = doc[use], h[use], known[use], b[use]
        bucket = deal[use] % b
        group = (d.astype(np.uint64) << np.uint64(24)) | bucket
        order = np.argsort(group, kind="stable")
        group, d, hh, kk, b, bucket = group[order], d[order], hh[order], kk[order], b[order], bucket[order]
        first = np.concatenate(([0], np.flatnonzero(group[1:] != group[:-1]) + 1))
        sums = np.add.reduceat(hh, first)
        informative = np.add.reduceat(kk.astype(np.int64), first)
        salt = _mix(b[first] * np.uint64(1 << 20) + bucket[first] + np.uint64(1))
        run = np.repeat(np.arange(len(first)), np.diff(np.concatenate((first, [len(group)]))))
        whole = informative > 0
        variants.append(_mix(sums[whole] + salt[whole]))
        owners.append(keys[d[first[whole]]])
        less = informative[run] - kk > 0
        variants.append(_mix(sums[run[less]] - hh[less] + salt[run[less]]))
        owners.append(keys[d[less]])
    if not variants:
        return np.array([], np.int64), np.array([], np.int64)
    return np.concatenate(variants).view(np.int64), np.concatenate(owners)


def prefix_keys(keys: np.ndarray, sizes: np.ndarray, lines: np.ndarray, common: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(variant, text key) of the rarest lines of each text, as many as a pair over the threshold cannot all miss.

    Lines that are not ``common`` come first, by their hash; the others by their ``counts``.
    Variants for pairs of up to SHORT lines are odd, as those of buckets are; the
    others are even, and a pair must meet on LEAST_MET of them.
    """
    if not len(keys):
        return np.array([], np.int64), np.array([], np.int64)
    doc = np.repeat(np.arange(len(keys)), sizes)
    rank = np.zeros(len(lines), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, lines), len(common) - 1)
        rank = np.where(common[at] == lines, counts[at], 0)
    order = np.lexsort((lines, rank, doc))
    need = -(-sizes * SHARE_NUM // SHARE_DEN)  # lines that any partner must share
    place = np.arange(len(lines)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    size = np.repeat(sizes, sizes)
    short = order[(size <= SHORT) & (place < np.repeat(sizes - need + 1, sizes))]
    long = order[(size * SHARE_DEN // SHARE_NUM > SHORT) & (place < np.repeat(sizes - need + LEAST_MET, sizes))]
    variants = np.concatenate((_mix(lines[short].view(np.uint64)) | np.uint64(1), _mix(lines[long].view(np.uint64)) & ~np.uint64(1)))
    return variants.view(np.int64), keys[doc[np.concatenate((short, long))]]


def _list_parts(col) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of an Arrow list column without nulls."""
    offsets = col.offsets.to_numpy()
    return col.values.to_numpy()[offsets[0] : offsets[-1]], np.diff(offsets)


def meetings(balls: DataFrame) -> DataFrame:
    """variant, key_a, key_b (key_a < key_b) of all keys that share a variant (``balls``: variant, key).

    Both sides are the same exchange, which is written once; its partitions are those of
    a join, so that the adaptive skew join deals one that a hot variant fills over many
    tasks, each with a part of one side.
    """
    a, b = balls.alias("a"), balls.alias("b")
    met = a.join(b, (F.col("a.variant") == F.col("b.variant")) & (F.col("a.key") < F.col("b.key")))
    return met.select(F.col("a.variant").alias("variant"), F.col("a.key").alias("key_a"), F.col("b.key").alias("key_b"))


def near_pairs(texts: DataFrame, common: float = COMMON) -> DataFrame:
    """key_a, key_b (key_a < key_b) of all near-duplicate pairs of distinct texts.

    ``texts`` has one row for each text_key, with n_lines and lines.
    """
    spark = texts.sparkSession
    n_texts = texts.count()
    most = max(COMMON_LEAST, int(common * n_texts))
    # at most (mean lines of a text) / common rows
    frequent = texts.select(F.explode("lines").alias("line")).groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") > most).toPandas().sort_values("line")
    shared = spark.sparkContext.broadcast((frequent["line"].to_numpy(np.int64), frequent["n"].to_numpy(np.int64)))

    def emit(batches):
        for b in batches:
            keys, sizes = b.column(0).to_numpy(), b.column(1).to_numpy()
            for k in range(0, len(keys), 1000):
                lines, n = _list_parts(b.column(2).slice(k, 1000))
                v, o = ball_variants(keys[k : k + 1000], n, lines, shared.value[0])
                for v, o in ((v | 1, o), prefix_keys(keys[k : k + 1000], n, lines, *shared.value)):
                    yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(o)], ["variant", "key"])

    balls = texts.select("text_key", "n_lines", "lines").mapInArrow(sliced(emit), "variant long, key long")
    met = meetings(balls).groupBy("key_a", "key_b").agg(F.sum(F.when(F.col("variant") % 2 == 0, 1).otherwise(LEAST_MET)).alias("n_met"))
    met = met.where(F.col("n_met") >= LEAST_MET).select("key_a", "key_b")
    # only texts that met another go on to the verification
    met = materialise(met, "met")
    keys = met.select(F.explode(F.array("key_a", "key_b")).alias("text_key")).distinct()
    side = materialise(texts.join(keys.hint("merge"), "text_key", "left_semi").select("text_key", "n_lines", "lines"), "involved")
    # the same plan at every size: pairs and texts both grow with the data
    pairs = met.join(side.toDF("key_a", "n_a", "lines_a").hint("merge"), "key_a").join(side.toDF("key_b", "n_b", "lines_b").hint("merge"), "key_b")
    overlap = F.size(F.array_intersect("lines_a", "lines_b"))
    return pairs.where(overlap * SHARE_DEN >= F.greatest("n_a", "n_b") * SHARE_NUM).select("key_a", "key_b", (overlap / F.greatest("n_a", "n_b")).alias("similarity"))


def classes(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members: id, text_key; texts: text_key, n_lines, lines), both written once."""
    rows = unique_keys(materialise(entry_lines(entries), "lines"))
    members = rows.select("id", "text_key").distinct()
    texts = rows.groupBy("text_key").agg(F.first("n_lines").alias("n_lines"), F.first("lines").alias("lines"))  # equal within a key
    return members, materialise(texts, "texts")


def unique_keys(rows: DataFrame) -> DataFrame:
    """``rows`` without ``check``: a text_key that several checks share is replaced by a hash of both."""
    shared = rows.groupBy("text_key").agg(F.min("check").alias("low"), F.max("check").alias("high")).where("low <> high").select("text_key", F.lit(True).alias("shared"))
    if shared.isEmpty():
        return rows.drop("check")
    return rows.join(shared, "text_key", "left").withColumn("text_key", F.when(F.col("shared"), F.xxhash64("text_key", "check")).otherwise(F.col("text_key"))).drop("shared", "check")


def found_pairs(entries: DataFrame) -> DataFrame:
    """id_a, id_b (id_a < id_b) of all pairs of entries, equal texts included."""
    members, texts = classes(entries)
    near = near_pairs(texts).select("key_a", "key_b")
    left, right = members.toDF("id_a", "key_a"), members.toDF("id_b", "key_b")
    across = near.join(left, "key_a").join(right, "key_b").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    same = left.join(right, F.col("key_a") == F.col("key_b")).where("id_a < id_b").select("id_a", "id_b")
    return across.unionAll(same).where("id_a < id_b").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, label (least node of its component) for every node of ``edges``.

    Each round hooks every node to the least label around it and halves the paths;
    the lineage is cut by written tables.  Only counts reach the driver.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = materialise(both.unionAll(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "edges")
    labels = materialise(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")), "labels")
    while True:
        heard = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("heard"))
        hooked = labels.join(heard, "node").select("node", F.least("label", "heard").alias("low"), "label")
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        new = materialise(hooked.join(jump, "low", "left").select("node", F.least("low", F.coalesce("far", "low")).alias("label"), F.col("label").alias("old")), "labels")
        moved = not new.where("label <> old").isEmpty()
        discard(labels)
        labels = new
        if not moved:  # labels only fall, so this comes
            return labels.select("node", "label")


def duplicate_groups(entries: DataFrame) -> DataFrame:
    """id, group_id, n_links: one row for each entry that is code.

    ``group_id`` names the connected component of the entry (the least text key in
    it), ``n_links`` the number of distinct texts its text is linked with.
    """
    members, texts = classes(entries)
    near = materialise(near_pairs(texts).select("key_a", "key_b"), "near")
    label = components(near, "key_a", "key_b").select(F.col("node").alias("text_key"), "label")
    links = near.select(F.explode(F.array("key_a", "key_b")).alias("text_key")).groupBy("text_key").agg(F.count("*").alias("n_links"))
    return members.join(label, "text_key", "left").join(links, "text_key", "left").select("id", F.coalesce("label", "text_key").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
