"""Encoding of a whole corpus by a public tokenizer (problem 8).

Method: global distinct-word shuffle.  Each text is cut into pre-tokens with
positions; every distinct pre-token of the corpus is encoded once; ids are
joined back and put together by position.  Decoding takes the bytes of each id from
the vocabulary, which every worker reads, by index instead of a join.

Words that make up at least ``hot_share`` of all occurrences number at most
``1 / hot_share``, whatever the corpus; they are broadcast with their ids, so
that the shuffle carries only rare words and no key of it is hot.

Defined results: empty and null texts give an empty list.  Identical rows come
out as often as they come in.  A text of any length is encoded whole.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.vocab import TOKENIZER_DIR, encoding, pretokens, ranks
from millrace.runtime import materialise, sliced

#: A worker passes its counts on when it holds this many distinct words.
FLUSH_WORDS = 200_000


def word_counts(texts: DataFrame) -> DataFrame:
    """word, n: occurrences of each distinct pre-token of column ``text``."""

    def run(batches):
        seen: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(pretokens(t))
                if len(seen) > FLUSH_WORDS:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    return texts.mapInArrow(sliced(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def encode_words(words: DataFrame, tokenizer: str, folder: str) -> DataFrame:
    """Add ``ids`` to a table of distinct pre-tokens."""

    def run(batches):
        encode = encoding(tokenizer, folder).encode_ordinary  # a pre-token is cut no further
        for b in batches:
            ids = [encode(w) for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int32()))], ["word", "n", "ids"])

    return words.mapInArrow(sliced(run), "word string, n long, ids array<int>")


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices starts[0], starts[0]+1, ... of ``sizes[0]`` elements, then those of the next."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _lists(sizes: np.ndarray, values: np.ndarray) -> pa.ListArray:
    """A list column of int from the sizes of its lists and their values."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(values.astype(np.int32)))


def encode_corpus(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR, hot_share: float = 1e-4
) -> DataFrame:
    """``id_col`` and ``ids`` of each row of ``df``; other columns are left out."""
    spark = df.sparkSession
    base = df.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    full = base.where("text IS NOT NULL AND text <> ''").select("text")
    words = materialise(encode_words(word_counts(full), tokenizer, folder), "words")
    total = words.agg(F.sum("n")).first()[0] or 0
    least = max(2, int(total * hot_share))
    hot = {r["word"]: r["ids"] for r in words.where(F.col("n") >= least).select("word", "ids").collect()}  # at most 1 / hot_share rows
    shared = spark.sparkContext.broadcast(hot)

    doc_type = base.schema["doc"].dataType.simpleString()
    names = ["doc", "text_key", "word", "positions", "lengths", "ids"]

    def cut(batches):
        """One row for each text with its frequent words encoded, one for each rare word of a text."""
        words_known = pa.array(list(shared.value.keys()), pa.string())
        sizes = np.array([len(x) for x in shared.value.values()], np.int64)
        starts = np.concatenate(([0], np.cumsum(sizes)))
        known_ids = np.fromiter(chain.from_iterable(shared.value.values()), np.int32)
        for b in batches:
            pieces = [pretokens(t) for t in b.column(2).to_pylist()]
            n = np.fromiter(map(len, pieces), np.int64, len(pieces))
            flat = pa.array(list(chain.from_iterable(pieces)), pa.string())
            doc = np.repeat(np.arange(len(n)), n)
            pos = (np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
            at = pc.index_in(flat, value_set=words_known).fill_null(-1).to_numpy()
            hot = at >= 0
            long = sizes[at[hot]]
            each = np.bincount(doc[hot], minlength=len(n))
            total_ids = np.bincount(doc[hot], long, len(n)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.nulls(len(n), pa.string()), _lists(each, pos[hot]), _lists(each, long), _lists(total_ids, known_ids[_ragged(starts[at[hot]], long)])], names
            )
            coded = flat.filter(pa.array(~hot)).dictionary_encode()
            code, doc, pos = coded.indices.to_numpy(), doc[~hot], pos[~hot]
            order = np.lexsort((pos, code, doc))
            code, doc, pos = code[order], doc[order], pos[order]
            first = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])))) if len(code) else np.zeros(0, np.int64)
            rows, none = pa.array(doc[first]), np.zeros(len(first), np.int64)
            each = np.diff(np.concatenate((first, [len(code)])))
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), coded.dictionary.take(pa.array(code[first])), _lists(each, pos), _lists(none, none[:0]), _lists(none, none[:0])], names)

    # the hash of the text keeps rows apart that share an id by mistake
    pieces = base.select("doc", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text").mapInArrow(
        sliced(cut), f"doc {doc_type}, text_key long, word string, positions array<int>, lengths array<int>, ids array<int>"
    )
    pieces = materialise(pieces, "pieces")
    cold = words.where(F.col("n") < least).select("word", F.col("ids").alias("word_ids"))
    rare = pieces.where("word IS NOT NULL").select("doc", "text_key", "word", "positions").join(cold, "word")
    parts = pieces.where("word IS NULL").select("doc", "text_key", F.struct("positions", "lengths", "ids").alias("part")).unionAll(
        rare.select("doc", "text_key", F.struct("positions", F.lit(None).cast("array<int>").alias("lengths"), F.col("word_ids").alias("ids")).alias("part"))
    )
    # a group is one text: bounded by its length
    grouped = parts.groupBy("doc", "text_key").agg(F.collect_list("part").alias("parts")).select("doc", "parts")

    def assemble(batches):
        """Ids of each text in the order of their positions, for all texts of a slice at once."""
        for b in batches:
            n_docs = b.num_rows
            outer = b.column(1).offsets.to_numpy()
            positions, lengths, ids = b.column(1).values.slice(outer[0], outer[-1] - outer[0]).flatten()
            doc_of_part = np.repeat(np.arange(n_docs), np.diff(outer))
            at, ids_at = positions.offsets.to_numpy().astype(np.int64), ids.offsets.to_numpy().astype(np.int64)
            is_hot = lengths.is_valid().to_numpy(zero_copy_only=False)
            n = np.diff(at)
            part = np.repeat(np.arange(len(n)), n)
            pos = positions.values.to_numpy()[at[0] : at[-1]]
            hot = is_hot[part]
            # a rare word has the same ids at each place; those of frequent words follow each other
            size, start = np.diff(ids_at)[part], ids_at[:-1][part]
            size[hot] = lengths.flatten().to_numpy()
            done = np.cumsum(size[hot]) - size[hot]
            begins = np.concatenate(([0], np.cumsum(n[is_hot])))[:-1]
            base = np.append(done, 0)[begins] if len(begins) else np.zeros(0, np.int64)
            start[hot] += done - np.repeat(base, n[is_hot])
            doc = doc_of_part[part]
            order = np.lexsort((pos, doc))
            doc, pos, size, start = doc[order], pos[order], size[order], start[order]
            copies = np.bincount(doc_of_part[is_hot], minlength=n_docs)
            if (copies != 1).any():  # repeated rows: each position once
                keep = np.concatenate(([True], (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1]))) if len(doc) else np.zeros(0, bool)
                doc, size, start = doc[keep], size[keep], start[keep]
            out = _lists(np.bincount(doc, size, n_docs).astype(np.int64), ids.values.to_numpy()[_ragged(start, size)])
            rows = pa.array(np.repeat(np.arange(n_docs), copies))
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), out.take(rows)], ["doc", "ids"])

    return grouped.mapInArrow(sliced(assemble), f"doc {doc_type}, ids array<int>").withColumnRenamed("doc", id_col)


def decode_corpus(ids: DataFrame, id_col: str = "doc_id", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """``id_col`` and ``text``: join each id with the token-byte table, concatenate by position.

    The table has one row for each id of the vocabulary, so every worker holds it and
    the join is a take by index: the bytes of a slice of rows come out in the order of
    their ids, and the rows' bounds cut them.  Nothing is shuffled.  Unknown ids have
    no bytes; bytes that are no UTF-8 become replacement characters.
    """

    def run(batches):
        by_id = {i: b for b, i in ranks(tokenizer, folder).items()}
        known = pa.array([by_id.get(i, b"") for i in range(max(by_id) + 2)], pa.large_binary())
        for b in batches:
            lists = b.column(1).fill_null([]) if b.column(1).null_count else b.column(1)
            at = lists.offsets.to_numpy()
            picked = lists.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]]
            picked = np.where((picked < 0) | (picked >= len(known) - 1), len(known) - 1, picked)
            joined = known.take(pa.array(picked, pa.int64()))
            ends = np.frombuffer(joined.buffers()[1], np.int64)[: len(joined) + 1] if len(joined) else np.zeros(1, np.int64)
            data = memoryview(joined.buffers()[2]) if len(joined) and joined.buffers()[2] else memoryview(b"")
            bounds = ends[at - at[0]].tolist()
            texts = [bytes(data[i:j]).decode("utf-8", "replace") for i, j in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc", "text"])

    doc_type = ids.schema[id_col].dataType.simpleString()
    plain = ids.select(F.col(id_col).alias("doc"), F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return plain.mapInArrow(sliced(run), f"doc {doc_type}, text string").withColumnRenamed("doc", id_col)
