"""Reading level of documents (problem 10).

Method: a Rasch-style latent model.  Document d has a level t_d, word w a
difficulty b_w and an ease a_w, and w occurs in d at a rate proportional to
exp(a_w + b_w * t_d).  Both sides are estimated by alternating optimisation:
given the levels, each word's parameters are fitted from its counts by level;
given the words, a document's level is where the expected difficulty of its
words equals their mean difficulty.  Documents that an editor labelled are
anchors: their level is fixed while words are fitted.

Words are kept in Spark tables at every step.  Only curves over a fixed grid of
levels and a histogram of the labelled documents' levels come to the driver.

Code (fenced, inline, indented) and numbers are no words.  The levels 1, 2, 3
come from cuts between the labelled documents' own estimated levels.

Defined results: documents of another language or domain, null and empty texts
and those of fewer than 20 words give no row; repeated ids give one row, for the
text that sorts first; a document without a known word gets the middle level;
without any label, mean word length stands in for the anchors.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.runtime import materialise, sliced

#: Domains of running text.
DOMAINS = ["tutorial", "forum_answer", "design_note", "api_doc"]
LEAST_WORDS = 20
ROUNDS = 4
GRID = np.linspace(-2.0, 2.0, 41)
PRIOR = 1.5  # standard deviation of a word's difficulty
#: Words with at least this share of all occurrences are joined by broadcast; there are at most 1 / HOT_SHARE.
HOT_SHARE = 1e-4

_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_INLINE = re.compile(r"`[^`\n]*`")
_CODE_LINE = re.compile(r"^(?: {4}|\t)|[{};]\s*$")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")


def prose_words(text: str) -> list[str]:
    text = _INLINE.sub(" ", _FENCE.sub("\n", text))
    kept = " ".join(ln for ln in text.splitlines() if not _CODE_LINE.search(ln))
    return [w for w in _WORD.findall(kept.lower()) if "_" not in w]


def english_prose(documents: DataFrame) -> DataFrame:
    """doc_id, text of the documents that get a level."""
    kept = documents.where((F.lower(F.trim("lang")) == "en") & F.lower(F.trim("domain")).isin(DOMAINS) & F.col("text").isNotNull())
    kept = kept.where(F.size(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")) >= LEAST_WORDS).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # texts are not shuffled: only those whose id does recur are compared
    again = materialise(kept.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated-ids")
    if again.isEmpty():
        return kept
    one = kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    return kept.join(again, "doc_id", "left_anti").unionByName(one)


def word_pairs(texts: DataFrame) -> DataFrame:
    """doc_id, word, n; a document without words has one row with an empty word."""

    def run(batches):
        for b in batches:
            doc, word, n = [], [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for w, k in (Counter(prose_words(t)) or {"": 0}).items():
                    doc.append(d)
                    word.append(w)
                    n.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(word, pa.string()), pa.array(n, pa.int32())], ["doc_id", "word", "n"])

    return texts.mapInArrow(sliced(run), "doc_id long, word string, n int")


def fit_words(counts: DataFrame, exposure: np.ndarray) -> DataFrame:
    """word, n, ease, difficulty from counts by grid level (column ``by_level``, a map)."""
    total = exposure.sum()

    def run(batches):
        for b in batches:
            maps = b.column(1).to_pylist()
            x = np.zeros((len(maps), len(GRID)))
            for i, m in enumerate(maps):
                for k, v in m:
                    x[i, k] = v
            n = x.sum(1)
            s = x @ GRID
            ease = np.log(np.maximum(n, 0.5) / total)
            diff = np.zeros(len(n))
            for _ in range(25):  # damped Newton steps for all words at once
                rate = exposure * np.exp(np.clip(ease[:, None] + diff[:, None] * GRID, -40, 5))
                r0, r1, r2 = rate.sum(1), rate @ GRID, rate @ GRID**2
                ga, gb = n - r0, s - r1 - diff / PRIOR**2
                haa, hab, hbb = r0 + 1e-6, r1, r2 + 1 / PRIOR**2
                det = haa * hbb - hab**2
                ease += np.clip((hbb * ga - hab * gb) / det, -1, 1)
                diff += np.clip((haa * gb - hab * ga) / det, -1, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(ease), pa.array(diff)], names=["word", "n", "ease", "difficulty"])

    return counts.mapInArrow(sliced(run), "word string, n double, ease double, difficulty double")


def _join_words(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """pairs with the words' difficulty; frequent words by broadcast, so that no shuffle key is hot."""
    total = words.agg(F.sum("n")).first()[0] or 0.0
    split = max(1.0, total * HOT_SHARE)
    slim = words.select("word", "n", "difficulty")
    hot = F.broadcast(slim.where(F.col("n") >= split).select("word", F.col("difficulty").alias("hot")))
    marked = pairs.join(hot, "word", "left")
    rare = marked.where("hot IS NULL").select("doc_id", "word", "n").join(slim.where(F.col("n") < split).drop("n"), "word", "left")
    return marked.where("hot IS NOT NULL").select("doc_id", "n", F.col("hot").alias("difficulty")).unionAll(rare.select("doc_id", "n", "difficulty"))


def _level_of(column, curve: np.ndarray):
    """Level at which the expected difficulty (rising over GRID) equals ``column``."""
    mu = np.maximum.accumulate(curve)
    out = F.lit(float(GRID[-1]))
    for i in range(len(GRID) - 1, 0, -1):
        lo, hi = float(mu[i - 1]), float(mu[i])
        step = float(GRID[i] - GRID[i - 1])
        inside = F.lit(float(GRID[i - 1])) + (column - lo) * (step / (hi - lo)) if hi > lo else F.lit(float(GRID[i - 1]))
        out = F.when(column <= hi, inside).otherwise(out)
    return F.when(column <= float(mu[0]), F.lit(float(GRID[0]))).otherwise(out)


def fit_levels(texts: DataFrame, anchors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, level (latent, about -1 to 1) of every text.

    ``anchors``: doc_id, anchor (level of labelled documents).
    """
    pairs = materialise(word_pairs(texts), "word-pairs")
    sizes = materialise(pairs.groupBy("doc_id").agg(F.sum("n").cast("double").alias("size")).join(anchors, "doc_id", "left"), "doc-sizes")
    nearest = F.least(F.greatest(F.round((F.col("level") - float(GRID[0])) / float(GRID[1] - GRID[0])), F.lit(0)), F.lit(len(GRID) - 1)).cast("int")
    levels = sizes.where("anchor IS NOT NULL").select("doc_id", "size", F.col("anchor").alias("level"))
    partition = np.ones(len(GRID))  # sum of the word rates at each level
    for turn in range(rounds):
        binned = levels.select("doc_id", "size", nearest.alias("bin"))
        exposure = np.zeros(len(GRID))
        for r in binned.groupBy("bin").agg(F.sum("size").alias("size")).collect():  # one row for each grid level
            exposure[r["bin"]] = r["size"]
        exposure = exposure / partition
        by_bin = pairs.where("word <> ''").join(binned.select("doc_id", "bin"), "doc_id").groupBy("word", "bin").agg(F.sum("n").cast("double").alias("n"))
        counts = by_bin.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("by_level"))
        words = materialise(fit_words(counts, exposure), "words")
        rates = [F.exp(F.col("ease") + F.col("difficulty") * float(g)) for g in GRID]
        curves = words.agg(*(F.sum(r) for r in rates), *(F.sum(r * F.col("difficulty")) for r in rates)).first()
        z = np.array([v or 1e-9 for v in curves[: len(GRID)]])
        curve = np.array([v or 0.0 for v in curves[len(GRID) :]]) / z
        partition = z
        means = _join_words(pairs, words).groupBy("doc_id").agg((F.sum(F.col("n") * F.coalesce("difficulty", F.lit(0.0))) / F.greatest(F.sum(F.when(F.col("difficulty").isNotNull(), F.col("n")).otherwise(0)), F.lit(1))).alias("mean"))
        own = materialise(means.select("doc_id", _level_of(F.col("mean"), curve).alias("own")).join(sizes, "doc_id"), "levels")
        levels = own.select("doc_id", "size", F.coalesce("anchor", "own").alias("level"))
    return own.select("doc_id", F.col("own").alias("level"), "anchor")


def best_cut(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> float:
    """Value that best separates two weighted samples on rising ``values``; the middle of the widest best gap."""
    if not low.sum() or not high.sum():
        below, above = values[low > 0], values[high > 0]
        return float((below.max() if len(below) else -1) + (above.min() if len(above) else 1)) / 2
    cuts = np.concatenate(([values[0] - 1], (values[1:] + values[:-1]) / 2, [values[-1] + 1]))
    over = 1 - np.concatenate(([0], np.cumsum(low))) / low.sum()
    under = np.concatenate(([0], np.cumsum(high))) / high.sum()
    errors = over + under
    best = cuts[errors <= errors.min() + 1e-12]
    return float(np.median(best))


def reading_levels(documents: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, reading_level (1 to 3) of each document of running English text."""
    texts = materialise(english_prose(documents), "prose")
    known = labels.where("reading_level IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("reading_level").alias("reading_level"))
    anchors = known.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("reading_level") - 2.0).alias("anchor")).join(texts.select("doc_id"), "doc_id", "left_semi")
    if anchors.isEmpty():
        length = F.length(F.regexp_replace("text", r"\s", "")) / F.size(F.split("text", r"\s+"))
        spread = texts.select(length.alias("x")).agg(F.avg("x").alias("m"), F.stddev("x").alias("s")).first()
        anchors = texts.select("doc_id", F.least(F.greatest((length - (spread["m"] or 0.0)) / (2 * (spread["s"] or 1.0)), F.lit(-1.5)), F.lit(1.5)).alias("anchor"))
        fitted, low, high = fit_levels(texts, anchors, rounds), -0.5, 0.5
    else:
        fitted = fit_levels(texts, anchors, rounds)
        # a histogram of at most 401 levels for each label
        judged = fitted.where("anchor IS NOT NULL").groupBy(F.round("level", 2).alias("level"), "anchor").agg(F.count("*").alias("n")).toPandas()
        values = np.unique(judged.level.to_numpy(float))
        by = {k: np.array([judged.n[(judged.level == v) & (judged.anchor == k)].sum() for v in values], float) for k in (-1.0, 0.0, 1.0)}
        low, high = best_cut(values, by[-1.0], by[0.0]), best_cut(values, by[0.0], by[1.0])
    level = F.when(F.col("level") <= low, 1).when(F.col("level") <= high, 2).otherwise(3)
    return fitted.select("doc_id", level.cast("long").alias("reading_level"))
