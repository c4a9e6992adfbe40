"""Token budget per source, language and domain (problem 1).

Method: for each language a linear regression predicts tokens from bytes, words,
digits, punctuation, line breaks and script counts.  It is fitted on a bounded
sample of tokenized rows, applied to every row, and its bias is corrected by the
ratio of true to predicted tokens on a tokenized holdout.

The sample (``fit_rows`` for each language, by hash of the id, half of it held
out) is the only bounded part; counts and estimates cover every row and the whole of
every text.  Every language with ``LEAST_FIT`` rows or more has a model of its own,
however many languages there are: models are fitted group by group in Spark and meet
the slices, not the rows, since the estimate of a slice is linear in its summed counts.

Defined results: null and empty texts count as records with 0 tokens; languages
with fewer than ``LEAST_FIT`` texts share one model, fitted on a sample of them, or of all
texts where they are fewer than that together; slices with a null key come out as
``unknown``; repeated rows count as often as they stand in the table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.slices import canonical_language, canonical_project, canonical_source, is_code, metadata_field
from millrace.llm.vocab import TOKENIZER_DIR, count_tokens
from millrace.runtime import materialise, sliced

FEATURES = ["bytes", "words", "digits", "punct", "spaces", "breaks", "upper", "latin", "cjk", "other"]
FIT_ROWS = 600
LEAST_FIT = 40
#: Key of the model that languages with fewer texts than LEAST_FIT share.
POOLED = ""
#: Tables of counts by language of up to so many rows are broadcast to the texts; larger ones are joined.
BROADCAST_LANGUAGES = 50_000

# byte classes: 1 small letter or underscore, 2 capital, 3 digit, 4 punctuation, 5 space, 6 line break, 7-9 lead bytes by script, 0 others
_CLASS = np.zeros(256, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
for _c in range(33, 127):
    if not _CLASS[_c]:
        _CLASS[_c] = 4
_CLASS[[32, 9]] = 5
_CLASS[[10, 13]] = 6
_CLASS[0xC2:0xE0] = 7
_CLASS[0xE0:0xF0] = 8
_CLASS[0xF0:0xF8] = 9


def text_features(texts: pa.Array) -> np.ndarray:
    """Counts of FEATURES for each text, from the UTF-8 bytes of the whole column."""
    texts = pa.concat_arrays([texts.cast(pa.large_string())])
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    lo, hi = int(offsets[0]), int(offsets[-1])
    out = np.zeros((len(texts), len(FEATURES)))
    if hi == lo:
        return out
    cls = _CLASS[np.frombuffer(texts.buffers()[2], np.uint8)[lo:hi]]
    at = offsets - lo

    def per_text(mask: np.ndarray) -> np.ndarray:
        # sums over [at[i], at[i+1]); an offset past the end and empty texts need care
        total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return total[at[1:]] - total[at[:-1]]

    letter = (cls == 1) | (cls == 2)
    starts = letter.copy()
    starts[1:] &= ~letter[:-1]
    begins = at[:-1][at[:-1] < len(letter)]
    starts[begins] = letter[begins]  # a word does not run on from the text before
    indent = cls == 5
    runs = indent.copy()
    runs[1:] &= ~indent[:-1]
    out[:, 0] = np.diff(at)
    for k, mask in enumerate((starts, cls == 3, cls == 4, runs, cls == 6, cls == 2, cls == 7, cls == 8, cls == 9), 1):
        out[:, k] = per_text(mask)
    return out


def _with_features(df: DataFrame, keys: list[str], tokenize: tuple[str, str] | None = None) -> DataFrame:
    """keys + FEATURES (+ tokens) of column ``text``."""
    fields = [df.schema[k] for k in keys]
    ddl = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in fields), *(f"{f} double" for f in FEATURES), *(["tokens long"] if tokenize else [])])

    def run(batches):
        for b in batches:
            col = b.column(len(keys)).fill_null("")
            x = text_features(col)
            arrays = [b.column(i) for i in range(len(keys))] + [pa.array(x[:, i]) for i in range(len(FEATURES))]
            if tokenize:
                arrays.append(pa.array(count_tokens(col.to_pylist(), *tokenize), pa.int64()))
            yield pa.RecordBatch.from_arrays(arrays, names=[*keys, *FEATURES, *(["tokens"] if tokenize else [])])

    return df.select(*keys, "text").mapInArrow(sliced(run), ddl)


def _nonnegative(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Least squares with coefficients of at least 0, by projected coordinate descent."""
    g, c = x.T @ x, x.T @ y
    g[np.diag_indices_from(g)] += 1e-9 * (1 + np.trace(g) / len(g))
    w = np.zeros(x.shape[1])
    for _ in range(3000):
        before = w.copy()
        for j in range(len(w)):
            w[j] = max(0.0, w[j] + (c[j] - g[j] @ w) / g[j, j])
        if np.max(np.abs(w - before)) < 1e-9 * (1 + np.max(np.abs(w))):
            break
    return w


def fit_model(part: pd.DataFrame) -> dict:
    """weights, bias, holdout_error, rows from tokenized rows in the order of ``u``: even ones fit, odd ones are held out."""
    x, y = part[FEATURES].to_numpy(float), part["tokens"].to_numpy(float)
    fit, hold = np.arange(0, len(part), 2), np.arange(1, len(part), 2)
    if len(part) < 4:
        fit = hold = np.arange(len(part))
    scale = 1 / np.sqrt(np.maximum(1.0, y[fit]))  # errors grow with the length
    w = _nonnegative(x[fit] * scale[:, None], y[fit] * scale)
    guess = x[hold] @ w
    bias = float(y[hold].sum() / guess.sum()) if guess.sum() > 0 else 1.0
    return {"weights": w.tolist(), "bias": bias, "holdout_error": float(np.abs(guess * bias - y[hold]).sum() / max(1.0, y[hold].sum())), "rows": len(part)}


def fit_models(df: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR, fit_rows: int = FIT_ROWS) -> DataFrame:
    """language, weights, bias, holdout_error, rows: one row for each language with LEAST_FIT texts, one for all others (POOLED).

    ``df`` has id, language, text.  At most about ``2 * fit_rows`` rows of each model are tokenized.
    """
    full = df.where("text IS NOT NULL AND text <> ''").withColumn("language", F.coalesce("language", F.lit("unknown")))
    counts = materialise(full.groupBy("language").agg(F.count("*").alias("n")), "language-counts")
    total = counts.agg(F.count("*").alias("languages"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("n") < LEAST_FIT, F.col("n"))), F.lit(0)).alias("rare")).first()
    # rare languages are sampled as one; too few of them are filled up with rows of all
    fill = min(1.0, 2.0 * fit_rows / total["n"]) if 0 < total["rare"] < LEAST_FIT else 0.0
    rare = F.col("n") < LEAST_FIT
    shares = counts.select("language", F.when(rare, POOLED).otherwise(F.col("language")).alias("model"), F.least(F.lit(1.0), F.lit(2.0 * fit_rows) / F.when(rare, F.lit(max(1, total["rare"]))).otherwise(F.col("n"))).alias("share"))
    shares = F.broadcast(shares) if total["languages"] <= BROADCAST_LANGUAGES else shares
    unit = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = full.withColumn("u", unit).join(shares, "language")
    serves = F.filter(F.array(F.when(F.col("u") < F.col("share"), F.col("model")), F.when((F.col("u") < fill) & (F.col("model") != POOLED), F.lit(POOLED))), lambda m: m.isNotNull())
    sample = _with_features(drawn.withColumn("models", serves).where(F.size("models") > 0), ["models", "u"], (tokenizer, folder))

    def fitted(key, part):
        m = fit_model(part.sort_values(["u", "bytes"]))
        return pd.DataFrame([{"language": key[0], **m}])

    # a group is one model's sample
    rows = sample.select(F.explode("models").alias("model"), "u", *FEATURES, "tokens")
    return materialise(rows.groupBy("model").applyInPandas(fitted, "language string, weights array<double>, bias double, holdout_error double, rows long"), "models")


def sum_features(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_records and the sums of FEATURES over the rows of each."""
    return _with_features(df, keys).groupBy(*keys).agg(F.count("*").alias("n_records"), *(F.sum(f).alias(f) for f in FEATURES))


def estimate_tokens(df: DataFrame, keys: list[str], models: DataFrame) -> DataFrame:
    """keys, n_records, n_bytes, est_tokens of each slice of ``df`` (which has language and text)."""
    cols = list(dict.fromkeys([*keys, "language"]))
    sums = sum_features(df, cols).withColumn("_lang", F.coalesce("language", F.lit("unknown")))
    own = models.select(F.col("language").alias("_lang"), F.col("weights").alias("_own"), F.col("bias").alias("_bias"))
    pooled = models.where(F.col("language") == POOLED).first()
    weights = F.array(*(F.lit(float(w)) for w in pooled["weights"])) if pooled else F.array(*(F.lit(0.0) for _ in FEATURES))
    joined = sums.join(own, "_lang", "left")
    w, bias = F.coalesce("_own", weights), F.coalesce("_bias", F.lit(float(pooled["bias"]) if pooled else 1.0))
    est = sum((F.col(f) * w[i] for i, f in enumerate(FEATURES)), F.lit(0.0)) * bias
    return joined.select(*cols, "n_records", F.col("bytes").cast("long").alias("n_bytes"), est.alias("est_tokens")).groupBy(*keys).agg(F.sum("n_records").alias("n_records"), F.sum("n_bytes").alias("n_bytes"), F.sum("est_tokens").alias("est_tokens"))


def code_slices(entries: DataFrame) -> DataFrame:
    """id, source, language, domain, text of the rows of code_entries that are code."""
    return entries.where(is_code(F.col("language"))).select(
        F.col("id").cast("string").alias("id"), canonical_project(F.col("project")).alias("source"), canonical_language(F.col("language")).alias("language"), metadata_field(F.col("metadata"), "domain").alias("domain"), F.col("code").cast("string").alias("text")
    )


def document_slices(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.col("doc_id").cast("string").alias("id"), canonical_source(F.col("source")).alias("source"), canonical_language(F.col("lang")).alias("language"), canonical_source(F.col("domain")).alias("domain"), F.col("text").cast("string").alias("text")
    )


def token_budget(slices: DataFrame, record_table: str, **fit) -> DataFrame:
    """record_table, source, language, domain, n_records, n_bytes, est_tokens for each slice."""
    est = estimate_tokens(slices, ["source", "language", "domain"], fit_models(slices, **fit))
    return est.select(F.lit(record_table).alias("record_table"), "source", "language", "domain", "n_records", "n_bytes", F.round("est_tokens", 1).alias("est_tokens"))
