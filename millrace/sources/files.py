"""Project files, compilation databases, manifests, configuration, templates; file sinks."""

from __future__ import annotations

import json
import os
import re
import tomllib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.graph import build_flags
from millrace.operators.paths import EXCLUDE, excluded, file_class, file_extension
from millrace.runtime import sliced

#: Extensions of C and C++ files; those of scanned projects; folders of build output.
C_EXTENSIONS = ["c", "h", "cc", "hh", "cpp", "hpp", "cxx"]
SCAN_EXTENSIONS = ["c", "h", "cpp", "hpp", "cc", "cxx", "hxx", "rs"]
BUILD_FOLDERS = ["target", "build", ".git", "node_modules", ".vscode", "cmake-build-debug"]
#: Fixed value: name of a project's compilation database.
COMMANDS = "compile_commands.json"


def scan(spark: SparkSession, root: str, globs: list[str] = EXCLUDE, recursive: bool = True, with_content: bool = False) -> DataFrame:
    """path (below root), size, modified (, content) of the files of a folder, without what the globs cover."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    base = os.path.abspath(root).rstrip("/") + "/"
    path = F.regexp_replace("path", f"^(?:file:)?/*{re.escape(base.lstrip('/'))}", "")
    cols = [path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")]
    if with_content:
        cols.append(F.decode("content", "UTF-8").alias("content"))
    return df.select(*cols).where(~excluded(F.col("path"), globs))


def scan_c(spark: SparkSession, root: str, **kw) -> DataFrame:
    return scan(spark, root, **kw).where(F.lower(file_extension(F.col("path"))).isin(C_EXTENSIONS))


def scan_sources(spark: SparkSession, root: str, **kw) -> DataFrame:
    """Files in C, C++ and Rust outside of build folders."""
    inside = "(?:^|/)(?:" + "|".join(re.escape(b) for b in BUILD_FOLDERS) + ")/"
    return scan(spark, root, **kw).where(F.lower(file_extension(F.col("path"))).isin(SCAN_EXTENSIONS) & ~F.col("path").rlike(inside))


def has_c_files(spark: SparkSession, root: str) -> bool:
    return not scan(spark, root).where(F.lower(file_extension(F.col("path"))).isin("c", "h")).limit(1).isEmpty()


def scan_totals(files: DataFrame) -> DataFrame:
    """file_class, n_files, n_bytes of scanned files."""
    return files.groupBy(file_class(F.col("path")).alias("file_class")).agg(F.count("*").alias("n_files"), F.sum("size").alias("n_bytes"))


def compile_commands(spark: SparkSession, path: str) -> DataFrame:
    """file, directory, command of a compilation database; arguments are joined where there is no command."""
    raw = spark.read.schema("file string, directory string, command string, arguments array<string>").option("multiLine", "true").json(path)
    return raw.select("file", "directory", F.coalesce("command", F.array_join("arguments", " ")).alias("command")).where("file IS NOT NULL")


def command_of(commands: DataFrame, file: str) -> DataFrame:
    return commands.where(F.col("file") == file).limit(1)


def command_flags(commands: DataFrame, root: str) -> DataFrame:
    """file, include_dirs, link_dirs, link_libs of each command."""
    lists = pa.list_(pa.string())

    def run(batches):
        for b in batches:
            got = [build_flags(c, d or root) for d, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([g[k] for g in got], lists) for k in ("include_dirs", "link_dirs", "link_libs"))], ["file", "include_dirs", "link_dirs", "link_libs"])

    return commands.select("file", "directory", "command").mapInArrow(sliced(run), "file string, include_dirs array<string>, link_dirs array<string>, link_libs array<string>")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document of many lines under a declared schema; records that are no JSON are left out."""
    return spark.read.schema(schema + ", _bad string").option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path).where("_bad IS NULL").drop("_bad")


def find_upwards(start: str, name: str, most: int = 10) -> str | None:
    """The nearest file of that name in a folder or up to ``most`` folders above it."""
    at = os.path.abspath(start)
    for _ in range(most + 1):
        if os.path.isfile(os.path.join(at, name)):
            return os.path.join(at, name)
        above = os.path.dirname(at)
        if above == at:
            return None
        at = above
    return None


def templates(spark: SparkSession, folder: str) -> DataFrame:
    """name, text of the templates of a folder."""
    df = spark.read.option("wholetext", "true").text(folder).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("name"), F.col("value").alias("text"))
    return df


def manifest_facts(text: str | None) -> dict:
    """dependencies, members, has_bin of a manifest; what is no TOML has none."""
    try:
        doc = tomllib.loads(text or "")
    except tomllib.TOMLDecodeError:
        return {"dependencies": [], "members": [], "has_bin": False}
    members = doc.get("workspace", {}).get("members", []) if isinstance(doc.get("workspace"), dict) else []
    deps = doc.get("dependencies", {})
    return {"dependencies": sorted(deps) if isinstance(deps, dict) else [], "members": [m for m in members if isinstance(m, str)], "has_bin": isinstance(doc.get("bin"), list)}


def manifests(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """record_id, dependencies, members, has_bin."""
    lists = pa.list_(pa.string())

    def run(batches):
        for b in batches:
            got = [manifest_facts(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g["dependencies"] for g in got], lists), pa.array([g["members"] for g in got], lists), pa.array([g["has_bin"] for g in got])], ["record_id", "dependencies", "members", "has_bin"])

    return df.select(F.col(id_col).cast("string").alias("record_id"), text_col).mapInArrow(sliced(run), "record_id string, dependencies array<string>, members array<string>, has_bin boolean")


def load_config(places: list[str], root: str | None = None) -> dict:
    """The first configuration file that exists; a relative database path is anchored at ``root``."""
    for place in places:
        place = os.path.expanduser(place)
        if os.path.isfile(place):
            with open(place, "rb") as f:
                doc = tomllib.load(f)
            db = doc.get("sqlite", {})
            if isinstance(db, dict) and isinstance(db.get("path"), str) and not os.path.isabs(db["path"]):
                db["path"] = os.path.join(root or os.path.dirname(os.path.abspath(place)), db["path"])
            return doc
    return {}


def config_issues(config: dict, rules: list[tuple[str, str, str, object]]) -> list[dict]:
    """Issues (level, field, message) of a configuration under rules (field, level, kind, bound).

    kind: required, type, min, max, choice.
    """
    out = []
    for field, level, kind, bound in rules:
        at = config
        for part in field.split("."):
            at = at.get(part) if isinstance(at, dict) else None
        number = isinstance(at, (int, float)) and not isinstance(at, bool)
        said = None
        if kind == "required" and at is None:
            said = "is missing"
        elif kind == "type" and at is not None and not isinstance(at, bound):
            said = "has another type"
        elif kind == "min" and number and at < bound:
            said = f"is under {bound}"
        elif kind == "max" and number and at > bound:
            said = f"is over {bound}"
        elif kind == "choice" and at is not None and at not in bound:
            said = "is no known choice"
        if said:
            out.append({"level": level, "field": field, "message": said})
    return out


def ast_facts(dump: str | None) -> list[tuple[str, str, int | None]]:
    """(kind, name, line) of functions, records, variables and typedefs of a compiler's JSON tree, of any depth."""
    kinds = {"FunctionDecl": "function", "RecordDecl": "record", "VarDecl": "variable", "TypedefDecl": "typedef"}
    try:
        todo = [json.loads(dump or "")]
    except ValueError:
        return []
    out = []
    while todo:
        node = todo.pop()
        if isinstance(node, dict):
            if node.get("kind") in kinds and node.get("name"):
                loc = node.get("loc")
                out.append((kinds[node["kind"]], node["name"], loc.get("line") if isinstance(loc, dict) else None))
            todo += reversed(node.get("inner") or [])
    return out


def write_report(df: DataFrame, path: str, pretty: bool = False) -> None:
    """Rows as JSON lines, or as indented objects."""
    if pretty:
        df.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value")).write.mode("overwrite").text(path)
    else:
        df.write.mode("overwrite").json(path)


def write_by_category(df: DataFrame, path: str) -> None:
    """Files laid out by their category."""
    df.write.mode("overwrite").partitionBy("category").parquet(path)
