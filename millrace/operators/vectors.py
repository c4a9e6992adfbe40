"""Exact nearest neighbours by cosine, filtered, and joined back to metadata.

Dimension is a property of the data: vectors of another length than the query's,
null and zero vectors have no cosine and are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.runtime import table

#: Queries and rows of one block pair, which is one task's matrix product.
QUERY_BLOCK, ROW_BLOCK = 1024, 32_768


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def cosine(v: Column, query: list[float]) -> Column:
    """Cosine with a fixed vector; null for null, zero or other-sized vectors."""
    q = F.array(*(F.lit(float(x)) for x in query))
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, x: a + x)
    size = float(np.sqrt(sum(float(x) ** 2 for x in query)))
    return F.when(F.size(v) == len(query), F.try_divide(dot, norm(v) * F.lit(size)))


def by_id(vectors: DataFrame, vec_id: int) -> DataFrame:
    """The vector of one id; no row where there is none."""
    return vectors.where(F.col("vec_id") == vec_id)


def by_ids(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """The vectors of many ids (column vec_id)."""
    return vectors.join(ids.select("vec_id").distinct(), "vec_id", "left_semi")


def search(vectors: DataFrame, query: list[float], k: int | None = 10, threshold: float | None = None, **payload) -> DataFrame:
    """The k best rows (None: all) for one vector: vec_id, label, score.  Payload filters come before scoring."""
    for name, value in payload.items():
        if value is not None:
            vectors = vectors.where(F.col(name) == value)
    scored = vectors.select("vec_id", "label", cosine(F.col("embedding"), query).alias("score")).where("score IS NOT NULL")
    if threshold is not None:
        scored = scored.where(F.col("score") >= threshold)
    ranked = scored.orderBy(F.col("score").desc(), "vec_id")
    return ranked if k is None else ranked.limit(k)


def search_all(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k best rows for each query: query_id, vec_id, score, position.

    Queries are taken in blocks of about QUERY_BLOCK against blocks of about ROW_BLOCK
    rows; a block pair is one matrix product and hands on k rows for each query.
    """
    n_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    r_blocks = max(1, -(-vectors.count() // ROW_BLOCK))
    q = queries.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int").alias("q_block"))
    q = q.withColumn("r_block", F.explode(F.sequence(F.lit(0), F.lit(r_blocks - 1))))
    r = vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(r_blocks)).cast("int").alias("r_block"))
    r = r.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def unit(pdf):
        if not len(pdf):
            return {}
        kept = pdf[pdf.v.notna()]
        rows = [(i, np.asarray(v, float)) for i, v in zip(kept.id, kept.v)]
        by_dim: dict[int, list] = {}
        for i, v in rows:
            n = np.sqrt(v @ v)
            if n > 0:
                by_dim.setdefault(len(v), []).append((i, v / n))
        return {d: (np.array([i for i, _ in x]), np.array([v for _, v in x])) for d, x in by_dim.items()}

    def best(left, right):
        a, b = unit(left), unit(right)
        out = []
        for d in a.keys() & b.keys():
            (qi, qv), (ri, rv) = a[d], b[d]
            s = qv @ rv.T
            for row, i in zip(s, qi):
                order = np.lexsort((ri, -row))[:k]
                out.append(pd.DataFrame({"query_id": i, "vec_id": ri[order], "score": row[order]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    local = q.groupBy("q_block", "r_block").cogroup(r.groupBy("q_block", "r_block")).applyInPandas(best, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "vec_id")
    return local.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def join_hits(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """Hits with the documents they stand for; hits without one drop out, and a hit meets one document (ids that several share: the least language)."""
    one = documents.where("lang IS NOT NULL").groupBy("doc_id").agg(F.min("lang").alias("lang"))
    return hits.join(one, hits.vec_id == one.doc_id)


def _every_fiftieth(s, d):
    v = table(s, d, "embeddings")
    return search_all(v, v.where("vec_id % 50 = 0"))


def _one(s, d, **kw):
    v = table(s, d, "embeddings")
    first = v.orderBy("vec_id").select("embedding").first()
    return search(v, list(first["embedding"]) if first else [0.0], **kw).select("vec_id", "label", F.round("score", 6).alias("score"))


def _stand_ins(s, d):
    """Documents under the ids of vectors: the tables share none at small sizes.  Some vectors have none, some several."""
    return table(s, d, "documents").withColumn("doc_id", F.pmod(F.col("doc_id"), F.lit(700)))


QUERIES = {
    "vector_top_k": lambda s, d: _every_fiftieth(s, d).select("query_id", "vec_id", "position", F.round("score", 6).alias("score")),
    "vector_filtered": lambda s, d: _one(s, d, k=10, label=3),
    "vector_threshold": lambda s, d: _one(s, d, k=None, threshold=0.1),
    "vector_by_id": lambda s, d: by_id(table(s, d, "embeddings"), 7).select("vec_id", "label", F.posexplode("embedding").alias("position", "x")).select("vec_id", "label", "position", F.round(F.col("x").cast("double"), 6).alias("x")),
    "vector_by_ids": lambda s, d: by_ids(table(s, d, "embeddings"), table(s, d, "embeddings").where("label = 3").select("vec_id")).select("vec_id", "label", F.round(norm(F.col("embedding")), 6).alias("norm")),
    "vector_labels": lambda s, d: table(s, d, "embeddings").groupBy("label").agg(F.count("*").alias("n_vectors"), F.max(F.size("embedding")).alias("dimension")),
    "vector_join": lambda s, d: join_hits(_every_fiftieth(s, d), _stand_ins(s, d)).select("query_id", "vec_id", "position", "lang"),
}
_TOP = """SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS s,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) DESC, e.vec_id)::INT AS position
    FROM (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q, embeddings e"""
_ONE = "SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1)), 6) AS score FROM embeddings"
ORACLE_SQL = {
    "vector_top_k": f"SELECT query_id, vec_id, position, round(s, 6) AS score FROM ({_TOP}) WHERE position <= 10",
    "vector_filtered": f"{_ONE} WHERE label = 3 ORDER BY score DESC, vec_id LIMIT 10",
    "vector_threshold": f"SELECT * FROM ({_ONE}) WHERE score >= 0.1",
    "vector_by_id": "SELECT vec_id, label, unnest(range(0, len(embedding)))::INT AS position, round(unnest(embedding)::DOUBLE, 6) AS x FROM embeddings WHERE vec_id = 7",
    "vector_by_ids": "SELECT vec_id, label, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings WHERE label = 3",
    "vector_labels": "SELECT label, count(*) AS n_vectors, max(len(embedding))::INT AS dimension FROM embeddings GROUP BY label",
    "vector_join": f"SELECT query_id, vec_id, position, lang FROM ({_TOP}) t JOIN (SELECT doc_id % 700 AS doc_id, min(lang) AS lang FROM documents WHERE lang IS NOT NULL GROUP BY 1) ON doc_id = vec_id WHERE position <= 10",
}
