"""Queries of the training-data operators: name -> callable(spark, folder)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import boilerplate, budget, encode, generated, mixing, neardup, reading, split, unparsed
from millrace.runtime import materialise, table


def p1_token_budget(spark: SparkSession, folder: str) -> DataFrame:
    code = budget.token_budget(budget.code_slices(table(spark, folder, "code_entries")), "code_entries")
    return code.unionByName(budget.token_budget(budget.document_slices(table(spark, folder, "documents")), "documents"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return unparsed.unparsed_records(table(spark, folder, "conversion_results"), table(spark, folder, "translation_results")).select("record_table", "record_id")


def p2_rates(spark: SparkSession, folder: str) -> DataFrame:
    return unparsed.failure_rates(table(spark, folder, "conversion_results"), table(spark, folder, "translation_results"), table(spark, folder, "code_entries"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.found_pairs(table(spark, folder, "code_entries"))


def p3_groups(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.duplicate_groups(table(spark, folder, "code_entries"))


def _cut(spark: SparkSession, folder: str) -> DataFrame:
    code = split.split_oversized(table(spark, folder, "code_entries"), "id", "code")
    original = split.split_oversized(table(spark, folder, "conversion_results"), "id", "original_code")
    return code.select(F.lit("code_entries").alias("record_table"), "*").unionAll(original.select(F.lit("conversion_results").alias("record_table"), "*"))


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    # rows delivered twice: their pieces are shuffled, not all texts
    return _cut(spark, folder).dropDuplicates(["record_table", "record_id", "piece_no"])


def p5_rejoined(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the pieces of each record give its text again, keep the limit and overlap as they should."""
    own = F.expr("substring(piece, cast(own_start - start_char as int) + 1)")
    rows = F.array_sort(F.collect_set(F.struct("piece_no", "n_pieces", own.alias("own"), "piece")))  # a group is one text
    g = p5_pieces(spark, folder).groupBy("record_table", "record_id").agg(rows.alias("r"))
    fits = F.forall("r", lambda x: F.length(x["piece"]) <= split.LIMIT)
    overlaps = F.forall(F.sequence(F.lit(1), F.size("r")), lambda i: (i == 1) | (F.substring(F.col("r")[i - 1]["piece"], 1, split.OVERLAP) == F.right(F.col("r")[F.greatest(i - 2, F.lit(0))]["piece"], F.lit(split.OVERLAP))))
    numbered = F.forall(F.sequence(F.lit(1), F.size("r")), lambda i: (F.col("r")[i - 1]["piece_no"] == i) & (F.col("r")[i - 1]["n_pieces"] == F.size("r")))
    return g.select("record_table", "record_id", F.md5(F.array_join(F.transform("r", lambda x: x["own"]), "")).alias("text_md5"), fits.alias("fits"), overlaps.alias("overlaps"), numbered.alias("numbered"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _cut(spark, folder).where("piece_no = 1").select("record_table", "record_id").distinct()


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return generated.made_records(table(spark, folder, "code_entries"), table(spark, folder, "file_mappings"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return boilerplate.boilerplate_lines(table(spark, folder, "web_pages"))


def p7_main_content(spark: SparkSession, folder: str) -> DataFrame:
    return boilerplate.main_content(table(spark, folder, "web_pages"))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode.encode_corpus(table(spark, folder, "documents"))


def p8_decoded(spark: SparkSession, folder: str) -> DataFrame:
    return encode.decode_corpus(materialise(encode.encode_corpus(table(spark, folder, "documents")), "ids"))


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    targets = table(spark, folder, "mix_targets")
    return mixing.shares(mixing.mix(table(spark, folder, "documents"), targets), targets)


def p9_checked(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each source with tokens reaches its share to within half a percentage point and one document, using none too often."""
    targets = table(spark, folder, "mix_targets")
    mixed = materialise(mixing.mix(table(spark, folder, "documents"), targets), "mix")
    grain = mixed.agg(F.coalesce(F.max(F.col("n_tokens") * F.col("n_uses")) / F.sum(F.col("n_tokens") * F.col("n_uses")), F.lit(0.0)).alias("x")).first()["x"]
    got = mixing.shares(mixed, targets)
    # sources without tokens have no share; the others keep their proportions
    live = F.when(F.col("mixed_tokens") > 0, F.col("target_share")).otherwise(F.lit(0.0))
    whole = got.agg(F.sum(live).alias("x")).first()["x"] or 1.0
    near = F.abs(F.col("actual_share") - live / F.lit(float(whole))) <= 0.005 + grain
    return got.select("source", "target_share", near.alias("share_reached"), (F.col("most_uses") <= F.col("max_repeats")).alias("repeats_kept"))


def p6_forest(spark: SparkSession, folder: str) -> DataFrame:
    """What the forest alone finds among rows whose labels it did not see."""
    return generated.forest_check(materialise(generated.entry_looks(table(spark, folder, "code_entries")), "looks"))


def p3_members(spark: SparkSession, folder: str) -> DataFrame:
    """id, first_id: each entry with the least id of its group."""
    groups = materialise(neardup.duplicate_groups(table(spark, folder, "code_entries")), "groups")
    first = groups.groupBy("group_id").agg(F.min("id").alias("first_id"))
    return groups.join(first, "group_id").select("id", "first_id")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return reading.reading_levels(table(spark, folder, "documents"), table(spark, folder, "reading_labels"))


QUERIES = {
    "p1_token_budget": p1_token_budget,
    "p2_found": p2_found,
    "p2_rates": p2_rates,
    "p3_found": p3_found,
    "p3_groups": p3_groups,
    "p3_members": p3_members,
    "p5_found": p5_found,
    "p5_pieces": p5_pieces,
    "p5_rejoined": p5_rejoined,
    "p6_found": p6_found,
    "p6_forest": p6_forest,
    "p7_found": p7_found,
    "p7_main_content": p7_main_content,
    "p8_ids": p8_ids,
    "p8_decoded": p8_decoded,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p9_checked": p9_checked,
    "p10_found": p10_found,
}

_LINES = r"""WITH e AS (SELECT id, lower(trim(language)) IN ('python', 'py') AS py, code FROM code_entries WHERE coalesce(lower(trim(language)), '') NOT IN ('project', 'config')),
    n AS (SELECT id, CASE WHEN py THEN regexp_replace(code, '#[^\n]*', '', 'g') ELSE regexp_replace(regexp_replace(code, '(?s)/\*.*?\*/', '', 'g'), '//[^\n]*', '', 'g') END AS code FROM e),
    l AS (SELECT id, regexp_replace(line, '^\s+|\s+$', '', 'g') AS line FROM (SELECT id, unnest(string_split_regex(code, '\r\n?|\n')) AS line FROM n)),
    k AS (SELECT id, line, row_number() OVER (PARTITION BY id, line) AS k, count(*) OVER (PARTITION BY id) AS n FROM l WHERE line <> '')"""
_PAIRS = f"{_LINES} SELECT a.id AS id_a, b.id AS id_b FROM k a JOIN k b ON a.line = b.line AND a.k = b.k AND a.id < b.id GROUP BY ALL HAVING 4 * count(*) >= 3 * greatest(max(a.n), max(b.n))"
ORACLE_SQL = {
    "p3_members": f"""WITH RECURSIVE p AS ({_PAIRS}), e AS (SELECT id_a AS a, id_b AS b FROM p UNION ALL SELECT id_b, id_a FROM p), c AS (SELECT DISTINCT id, id AS other FROM ({_LINES} SELECT id FROM k) UNION SELECT c.id, e.b FROM c JOIN e ON e.a = c.other)
        SELECT id, min(other) AS first_id FROM c GROUP BY id""",
    "p5_rejoined": """
        SELECT 'code_entries' AS record_table, id AS record_id, md5(code) AS text_md5, true AS fits, true AS overlaps, true AS numbered FROM code_entries WHERE length(code) > 6000
        UNION
        SELECT 'conversion_results', id, md5(original_code), true, true, true FROM conversion_results WHERE length(original_code) > 6000
    """,
    "p9_checked": "SELECT lower(trim(source)) AS source, target_share, true AS share_reached, true AS repeats_kept FROM mix_targets",
    "p3_found": f"{_LINES} SELECT a.id AS id_a, b.id AS id_b FROM k a JOIN k b ON a.line = b.line AND a.k = b.k AND a.id < b.id GROUP BY ALL HAVING 4 * count(*) >= 3 * greatest(max(a.n), max(b.n))",
    "p5_found": """
        SELECT 'code_entries' AS record_table, id AS record_id FROM code_entries WHERE length(code) > 6000
        UNION
        SELECT 'conversion_results' AS record_table, id AS record_id FROM conversion_results WHERE length(original_code) > 6000
    """,
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
