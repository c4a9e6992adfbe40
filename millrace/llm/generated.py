"""Generated, minified, vendored and data files among source code (problem 6).

Method: a random forest over the look of the code alone (compression ratio, token
entropy, identifier lengths, comment density, line lengths, spaces, digits, lines
without names).  Its labels are hidden from the features: header notices, which are
cut out of the text with all comments, file names by convention, which are no
feature, and runs of more literals than anyone types, whose share is no feature.
Both classes weigh the same, so that unlabelled files of a labelled look do not
outvote it.  Labelled rows keep their label, the forest decides all others;
``forest_check`` measures it on halves whose labels it did not see.

Notices alone would not do as labels: where generators write code that looks like any
other, a forest labelled by notices only finds nothing at all, minified files and data
included.  Vendored copies look hand-written too; they are told by their path or by a
notice of their origin.  A file (project and path) is judged as a
whole: one telling piece, or its path, decides for all records of it, in code_entries
and in file_mappings.

The forest is fitted on at most about ``2 * FIT_ROWS`` rows, ``FIT_ROWS`` of each
class, chosen by hash; features, labels and verdicts cover every row and whole texts.

Defined results: rows whose language is ``project`` or ``config`` are no case; a
null code is judged by its path alone, a null path by its code alone; a mapping
without a path, or of an unknown file, is judged by its path; repeated rows give
each id once; where all rows have the same label, or there is none, no forest is fitted.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from math import log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.slices import canonical_language, canonical_project, is_code
from millrace.runtime import materialise, sliced

FIT_ROWS = 3000
FEATURES = ["compression", "entropy", "ident_len", "short_idents", "comment_density", "line_len", "longest_line", "digit_share", "space_share", "ident_variety", "bare_share"]
#: A line of more characters than this that holds no name is bare.
BARE_LINE = 20
#: Label of data: this share of the characters of a text is runs of more literals, or longer encoded strings, than anyone types.
TABLE_SHARE, TABLE_RUN, TABLE_CHARS = 0.1, 64, 200
#: Share of the trees' votes, where both classes weigh the same, from which a text is made.
VOTE = 0.75
#: Unlabelled rows with this share of the votes of a first forest are left out of the sample.
DOUBT = 0.5

#: Notices of generated files and of copies, in comments.
GENERATED_NOTICE = re.compile(
    r"""code\ generated\ by|@generated\b|\bauto-?\s?generated\b|automatically\ (?:generated|produced|created)|(?:generated|produced|created)\ automatically
    |do\ not\ (?:edit|modify)(?:\ (?:by\ hand|manually|this\ file|directly))?\s*(?:[.,;:!]|$)|changes?\ will\ be\ (?:lost|overwritten)|edits?\ (?:is|are|will\ be)\ overwritten
    |machine[-\ ](?:written|generated)|edit\ the\ template|emitted\ by\ .*(?:compiler|generator)|this\ file\ (?:is|was)\ generated
    |diese\ datei\ .*(?:erzeugt|generiert)|nicht\ von\ hand|自动生成|generado\ (?:automáticamente|por)|généré\ (?:automatiquement|par)""",
    re.I | re.X | re.M,
)
HAND_NOTICE = re.compile(r"written by hand|hand-written", re.I)
COPY_NOTICE = re.compile(
    r"\bupstream\s*:|\bupstream\s+at\b|fixes\s+upstream|imported\s+unchanged\s+from|\bbundled\b.*\b(?:authors|kept|copy)\b|\bamalgamation\s+of\b|single-file\s+copy|local\s+copy,\s+synced|vendored\s+from",
    re.I,
)
#: Folders and names that by convention hold copies or made files (lower case).
VENDOR_FOLDER = r"(?:third[_-]?party|3rd[_-]?party|vendor|vendored|vendors|external|externals|extern|deps|node_modules|subprojects|bower_components|site-packages|godeps|pods)"
PACKAGE_FOLDER = r"[a-z][a-z0-9_+.]*-(?:v?\d+\.\d+(?:\.\d+)*(?:[-.]?[a-z]+\d*)?|(?=[0-9a-f]*\d)[0-9a-f]{7,40})"
MADE_FOLDER = r"(?:build|out|dist|target|autogen|generated|__generated__|__pycache__|bindgen_out|cmake-build-[a-z]+|[a-z0-9_.-]+_autogen)"
MADE_NAME = (
    r"(?:.*\.min\.(?:js|css)|.*\.bundle\.js|.*\.pb(?:-c)?\.(?:c|cc|cpp|h|go|rs)|.*_pb2(?:_grpc)?\.py|.*_pb\.rs|.*_bindings\.rs|.*\.(?:yy|tab|lex)\.(?:c|cc|cpp|h)|lex\..*\.(?:c|cc|cpp)"
    r"|mocs?[_.].*\.(?:c|cc|cpp)|qrc_.*\.cpp|ui_.*\.h|.*\.(?:gen|generated|g)\.[a-z]+|.*_(?:auto)?generated\.[a-z]+)"
)
PATH_PATTERN = f"(?:^|/)(?:{VENDOR_FOLDER}|{PACKAGE_FOLDER}|{MADE_FOLDER})/|(?:^|/){MADE_NAME}$"

_COMMENT = re.compile(r'//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\[^\n]{1,8}?)\'|`(?:[^`\\]|\\.)*`', re.S)
_PY_COMMENT = re.compile(r'#[^\n]*|"""(?:[^\\]|\\.)*?"""|\'\'\'(?:[^\\]|\\.)*?\'\'\'|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'', re.S)
_LINE_MARK = re.compile(r'^[ \t]*(?://)?[ \t]*#[ \t]*line[ \t]+\d+[ \t]+"[^"\n]*\.(?:y|l|yy|ll|re|rl|lex|ragel|ypp|lpp)"', re.M)
_TABLE = re.compile(r"(?:[-+]?(?:0[xX][0-9a-fA-F]+|\d[\d.]*|'(?:[^'\\\n]|\\.){1,6}')[uUlLfF]*\s*,\s*){%d,}" % TABLE_RUN)
_ENCODED = re.compile(r"[A-Za-z0-9+/]{%d,}={0,2}|(?:\\x[0-9a-fA-F]{2}){%d,}|(?:\\[0-7]{1,3}){%d,}" % (TABLE_RUN, TABLE_RUN // 2, TABLE_RUN // 2))
_STRING = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'')
_NAME = re.compile(r"(?<![\w.])[A-Za-z_]\w*")
_TOKEN = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.){1,8}\'|`(?:[^`\\]|\\.)*`|[^\W\d]\w*|\d[\w.]*|[^\w\s]')


def look(code: str, language: str) -> tuple[list[float], bool, bool, bool]:
    """(features, generated by notice, copy by notice, data by its literals) of one text."""
    notes: list[str] = []

    def strip(m):
        s = m[0]
        if s[0] in "/#":
            notes.append(s)
            return " "
        return s

    pattern = _PY_COMMENT if language == "python" else _COMMENT
    body = pattern.sub(strip, code)
    said = "\n".join(notes)
    shown = [x for x in notes if not GENERATED_NOTICE.search(x) and not COPY_NOTICE.search(x)]
    generated = bool(_LINE_MARK.search(code)) or bool(GENERATED_NOTICE.search(said)) and any(GENERATED_NOTICE.search(x) and not HAND_NOTICE.search(x) for x in notes)
    copied = bool(COPY_NOTICE.search(" ".join(said.split())))
    raw = body.encode("utf-8", "replace")
    n = max(1, len(body))
    counts = Counter(_TOKEN.findall(body))
    total = max(1, sum(counts.values()))
    entropy = -sum(c / total * log2(c / total) for c in counts.values())
    idents = [(t, c) for t, c in counts.items() if t[0].isalpha() or t[0] == "_"]
    n_idents = max(1, sum(c for _, c in idents))
    lines = body.split("\n")
    features = [
        len(zlib.compress(raw, 1)) / max(1, len(raw)),
        entropy,
        sum(len(t) * c for t, c in idents) / n_idents,
        sum(c for t, c in idents if len(t) == 1) / n_idents,
        sum(map(len, shown)) / max(1, len(code)),
        n / len(lines),
        float(max(map(len, lines))),
        sum(map(body.count, "0123456789")) / n,
        sum(map(body.count, " \n\t\r")) / n,
        len(idents) / n_idents,
        sum(len(ln) for ln in lines if len(ln) > BARE_LINE and not _NAME.search(_STRING.sub("0", ln))) / n,
    ]
    # a run of literals has a comma for each, an encoded string is one token
    tables = sum(len(m[0]) for m in _TABLE.finditer(body)) if counts[","] >= TABLE_RUN else 0
    encoded = sum(len(m[0]) * c for t, c in counts.items() if len(t) >= TABLE_RUN for m in _ENCODED.finditer(t))
    data = len(code) >= TABLE_CHARS and tables + encoded >= TABLE_SHARE * n
    return features, generated, copied, data


def file_key(path: Column) -> Column:
    """A path with one kind of separator, in lower case, without what leads to it."""
    unified = F.regexp_replace(F.lower(F.trim(path)), r"[\\/]+", "/")
    return F.regexp_replace(unified, r"^(?:\./|/)+", "")


def entry_looks(entries: DataFrame) -> DataFrame:
    """id, project, path, FEATURES, by_notice, by_copy, by_data, by_path, by_name of each row that is code."""
    marks = ["by_notice", "by_copy", "by_data"]
    ddl = "id string, project string, path string, " + ", ".join([*(f"{f} double" for f in FEATURES), *(f"{m} boolean" for m in marks)])

    def run(batches):
        for b in batches:
            rows = [look(code or "", lang) for code, lang in zip(b.column(3).to_pylist(), b.column(4).to_pylist())]
            feats = [pa.array([r[0][i] for r in rows], pa.float64()) for i in range(len(FEATURES))]
            said = [pa.array([r[i] for r in rows], pa.bool_()) for i in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *feats, *said], names=["id", "project", "path", *FEATURES, *marks])

    kept = entries.where(is_code(F.col("language")) & F.col("id").isNotNull())
    slim = kept.select(F.col("id").cast("string").alias("id"), canonical_project(F.col("project")).alias("project"), file_key(F.col("file_path")).alias("path"), F.col("code").cast("string").alias("code"), canonical_language(F.col("language")).alias("language"))
    return slim.mapInArrow(sliced(run), ddl).withColumn("by_path", F.coalesce(F.col("path").rlike(PATH_PATTERN), F.lit(False))).withColumn("by_name", made_by_name(F.col("path")))


def made_by_name(path: Column) -> Column:
    return F.coalesce(path.rlike(f"(?:^|/){MADE_NAME}$"), F.lit(False))


def _unit(seed: int) -> Column:
    """A number of 0 up to 1 for each id."""
    return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def forest_votes(known: DataFrame, asked: DataFrame, fit_rows: int = FIT_ROWS, seed: int = 11) -> DataFrame:
    """``asked`` with ``by_look``: the verdict of the forest fitted on ``known`` for each row."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    labelled = known.where("NOT by_copy").withColumn("label", (F.col("by_notice") | F.col("by_data") | F.col("by_name")).cast("double"))
    n = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return asked.withColumn("by_look", F.lit(False))
    share = F.when(F.col("label") == 1.0, F.lit(min(1.0, fit_rows / n[1.0]))).otherwise(F.lit(min(1.0, fit_rows / n[0.0])))
    sample = materialise(labelled.where(_unit(seed) < share).dropDuplicates(["id"]).select(*FEATURES, "label"), "forest-sample")
    drawn = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(drawn) < 2:
        return asked.withColumn("by_look", F.lit(False))
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="x")

    def fit(rows: DataFrame, made: int, other: int):
        weighed = vectors.transform(rows.withColumn("weight", F.when(F.col("label") == 1.0, F.lit(1.0)).otherwise(F.lit(made / max(1, other)))).coalesce(1).sortWithinPartitions(*FEATURES))
        return RandomForestClassifier(featuresCol="x", labelCol="label", weightCol="weight", numTrees=40, maxDepth=6, minInstancesPerNode=8, seed=seed).fit(weighed)

    # an unlabelled row of a labelled look says nothing: it is no example of hand-written code
    first = fit(sample, drawn[1.0], drawn[0.0]).transform(vectors.transform(sample))
    clear = materialise(first.where((F.col("label") == 1.0) | (vector_to_array("probability")[1] < DOUBT)).select(*FEATURES, "label"), "forest-clear")
    forest = fit(clear, drawn[1.0], clear.where("label = 0").count())
    voted = forest.transform(vectors.transform(asked))
    return voted.withColumn("by_look", vector_to_array("probability")[1] >= VOTE).drop("x", "rawPrediction", "probability", "prediction")


def forest_check(looks: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """evidence, n_records, n_found: what the forest alone finds in the half of the rows whose labels it did not see.

    One row for each kind of evidence (the first that holds): data, notice, name, copy, path, none.
    """
    halves = _unit(5) < 0.5
    votes = forest_votes(looks.where(halves), looks.where(~halves), fit_rows).unionByName(forest_votes(looks.where(~halves), looks.where(halves), fit_rows))
    kind = F.lit("none")
    for k in ("path", "copy", "name", "notice", "data"):
        kind = F.when(F.col(f"by_{k}"), k).otherwise(kind)
    return votes.groupBy(kind.alias("evidence")).agg(F.count("*").alias("n_records"), F.count_if("by_look").alias("n_found"))


def judged_entries(entries: DataFrame) -> DataFrame:
    """id, project, path, is_made of each row that is code, by itself."""
    looks = materialise(entry_looks(entries), "looks")
    return forest_votes(looks, looks).select("id", "project", "path", (F.col("by_look") | F.col("by_notice") | F.col("by_data") | F.col("by_copy") | F.col("by_path")).alias("is_made"))


def made_records(entries: DataFrame, mappings: DataFrame) -> DataFrame:
    """record_table, record_id of each record of a file that is not hand-written source."""
    judged = materialise(judged_entries(entries), "judged")
    # made files: pre-aggregated, at most one row for a file
    files = judged.where("is_made AND path IS NOT NULL").select("project", "path").distinct()
    by_file = judged.where("NOT is_made AND path IS NOT NULL").join(files, ["project", "path"], "left_semi").select("id")
    own = judged.where("is_made").select("id").unionAll(by_file).distinct().select(F.lit("code_entries").alias("record_table"), F.col("id").alias("record_id"))

    path = file_key(F.col("source_path"))
    mapped = mappings.select(F.col("mapping_id").cast("string").alias("record_id"), canonical_project(F.col("project"), "").alias("project"), path.alias("full"))
    # every folder of the path may be the project's: try each, unless the project is stored
    parts = F.split("full", "/")
    splits = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.struct(parts[i - 1].alias("base"), F.array_join(F.slice(parts, i + 1, F.size(parts)), "/").alias("rest")))
    tried = mapped.where("full IS NOT NULL AND full <> ''").select("record_id", "project", F.explode(splits).alias("s")).select("record_id", F.col("s.base").alias("base"), F.col("s.rest").alias("rest"), "project")
    fits = tried.where((F.col("project") == "") | (F.col("project") == F.col("base"))).where("rest <> ''")
    # a path inside the project tells by convention; what leads to the project does not
    first = fits.groupBy("record_id").agg(F.max_by("rest", F.length("rest")).alias("inside"))
    known = judged.where("path IS NOT NULL").select("project", "path").distinct()
    sure = fits.select("record_id", F.col("base").alias("project"), F.col("rest").alias("path")).join(known, ["project", "path"], "left_semi")
    by_content = sure.join(files, ["project", "path"], "left_semi").select("record_id")
    # files whose entries have no project go by their path
    loose = fits.select("record_id", F.col("rest").alias("path")).join(sure.select("record_id").distinct(), "record_id", "left_anti")
    by_loose = loose.join(files.where("project = 'unknown'").select("path"), "path", "left_semi").select("record_id")
    unknown = first.join(sure.select("record_id").distinct(), "record_id", "left_anti").where(F.col("inside").rlike(PATH_PATTERN)).select("record_id")
    other = by_content.unionAll(by_loose).unionAll(unknown).distinct().select(F.lit("file_mappings").alias("record_table"), "record_id")
    return own.unionAll(other)
