"""Source files that do not parse (problem 2).

Every text is ranked by its tokens over all supported languages and parsed against each
of their grammars in that order; all that accept it are recorded.  Of a text that is no
Rust 2021, a foreign parse means that it is of another language, failure everywhere that
it is corrupt.

Defined results: null, blank and comment-only texts have verdict ``empty`` and
are no case, whatever status is stored; rows delivered twice count once (by
record id), and if their texts differ the worst verdict holds (corrupt, foreign, ok,
empty); a record whose source is unknown has project and language ``unknown``.  Texts
of any length are parsed whole, nested as deep as memory allows (about 150,000 levels;
beyond that a text counts as corrupt).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.slices import canonical_language, canonical_project
from millrace.llm import foreign, rustparse
from millrace.runtime import sliced


#: Verdicts from the least to the worst.
VERDICTS = ["empty", "ok", "foreign", "corrupt"]


def verdict(text: str | None) -> tuple[str, str | None, list[str], str | None]:
    """(one of VERDICTS; likeliest language it parses in; all of them, likeliest first; error as Rust)."""
    if text is None or not text.strip():
        return "empty", None, [], None
    ranked = foreign.rank_languages(text)
    code, error = rustparse.examine(text)
    if not code and error is None:
        return "empty", None, [], None
    accepts = [lang for lang in ranked if (error is None if lang == "rust" else foreign.parses_as(text, lang))]
    if error is None:
        return "ok", "rust", accepts, None
    return ("foreign", accepts[0], accepts, error) if accepts else ("corrupt", None, [], error)


def check_syntax(df: DataFrame, id_col: str, text_col: str, others: list[str] = []) -> DataFrame:
    """record_id, verdict, parses_as, accepts, error of each row, and the columns ``others``."""
    fields = [df.schema[c] for c in others]
    ddl = ", ".join(["record_id string", *(f"{f.name} {f.dataType.simpleString()}" for f in fields), "verdict string", "parses_as string", "accepts array<string>", "error string"])

    def run(batches):
        for b in batches:
            out = [verdict(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(b.column(i + 2) for i in range(len(others))), *(pa.array([o[k] for o in out], pa.list_(pa.string()) if k == 2 else pa.string()) for k in range(4))], names=["record_id", *others, "verdict", "parses_as", "accepts", "error"])

    return df.select(F.col(id_col).cast("string").alias("record_id"), F.col(text_col).cast("string").alias("text"), *others).mapInArrow(sliced(run), ddl)


def checked_records(conversions: DataFrame, translations: DataFrame) -> DataFrame:
    """record_table, record_id, source_id, verdict, parses_as, accepts, error: the worst verdict of each record id."""
    one = check_syntax(conversions, "id", "converted_code", ["source_id"]).withColumn("record_table", F.lit("conversion_results"))
    two = check_syntax(translations, "id", "rust_code", ["source_id"]).withColumn("record_table", F.lit("translation_results"))
    rank = F.array_position(F.array(*map(F.lit, VERDICTS)), F.col("verdict"))
    # texts stay behind: verdicts are short
    worst = F.max(F.struct(rank.alias("rank"), "verdict", "parses_as", "accepts", "error", F.col("source_id").cast("string").alias("source_id"))).alias("w")
    return one.unionByName(two).groupBy("record_table", "record_id").agg(worst).select("record_table", "record_id", "w.source_id", "w.verdict", "w.parses_as", "w.accepts", "w.error")


def unparsed_records(conversions: DataFrame, translations: DataFrame) -> DataFrame:
    """record_table, record_id, verdict, parses_as, accepts, error of each record that is no Rust; each id once."""
    return checked_records(conversions, translations).where(F.col("verdict").isin("foreign", "corrupt")).drop("source_id").where("record_id IS NOT NULL")


def failure_rates(conversions: DataFrame, translations: DataFrame, entries: DataFrame) -> DataFrame:
    """record_table, project, language, n_records, n_foreign, n_corrupt, failure_rate.

    Records without text count in none of the numbers.
    """
    checked = checked_records(conversions, translations).where("verdict <> 'empty'")
    known = entries.select(F.col("id").cast("string").alias("source_id"), canonical_project(F.col("project")).alias("project"), canonical_language(F.col("language")).alias("language")).dropDuplicates(["source_id"])
    joined = checked.join(known, "source_id", "left").select("record_table", F.coalesce("project", F.lit("unknown")).alias("project"), F.coalesce("language", F.lit("unknown")).alias("language"), "verdict")
    counted = joined.groupBy("record_table", "project", "language").agg(F.count("*").alias("n_records"), F.count_if(F.col("verdict") == "foreign").alias("n_foreign"), F.count_if(F.col("verdict") == "corrupt").alias("n_corrupt"))
    return counted.withColumn("failure_rate", (F.col("n_foreign") + F.col("n_corrupt")) / F.col("n_records"))
