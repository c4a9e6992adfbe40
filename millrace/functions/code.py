"""Facts of source text as Column expressions, and a symbol finder for what needs state.

Patterns are fixed values: they must find what the engine's users expect.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.runtime import sliced

#: Patterns. Group 1 (or the one named beside it) is the name.
C_FUNCTION = r"(?m)^[a-zA-Z_][a-zA-Z0-9_*\s]*\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*\([^)]*\)\s*\{"
INCLUDE_LOOSE = r'#include\s+[<"](.*?)[>"]'
INCLUDE_ANCHORED = r'(?m)^\s*#\s*include\s*([<"])([^>"]+)[>"]'
TYPE_NAME = r"(?m)^(?:typedef\s+)?(?:struct|union|enum)\s+(\w+)"
MACRO_NAME = r"(?m)^#define\s+(\w+)"
GLOBAL_NAME = r"(?m)^(?:extern\s+)?(?:static\s+)?[a-zA-Z_][a-zA-Z0-9_*\s]+\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*[;=]"
CALL_NAME = r"([a-zA-Z_][a-zA-Z0-9_]*)\s*\("
ERROR_LINE = r":(\d+):"
#: Names of the C library and of compilers that are no functions of a project.
SYSTEM_NAMES = [
    "malloc", "free", "calloc", "realloc", "memcpy", "memmove", "memset", "memcmp", "strcpy", "strncpy", "strcat", "strncat",
    "strcmp", "strncmp", "strlen", "strchr", "strrchr", "strstr", "printf", "fprintf", "sprintf", "snprintf", "scanf", "fscanf",
    "sscanf", "puts", "putchar", "fputs", "fputc", "gets", "getchar", "fgets", "open", "read", "write", "close",
    "lseek", "stat", "fopen", "fread", "fwrite", "fclose", "fseek", "ftell", "rewind", "perror", "exit", "abort",
    "qsort", "bsearch", "time", "localtime", "gmtime", "mktime", "ctime", "sleep", "usleep", "nanosleep", "clock_gettime", "gettimeofday",
    "rand", "srand", "atoi", "atol", "atof", "strtol", "strtoul", "strtod", "getenv", "setenv", "unsetenv",
]
SYSTEM_PREFIXES = ["__", "__builtin_", "llvm.", "pthread_"]
COMPLEXITY_WORDS = ["if", "while", "for", "switch", "goto"]


def _java(pattern: str) -> str:
    """Line anchors at line feeds only, as in other dialects."""
    return pattern.replace("(?m)", "(?dm)")


def all_names(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(_java(pattern)), F.lit(group))


def distinct_names(text: Column, pattern: str) -> Column:
    """Names in the order of their first place."""
    return F.array_distinct(all_names(text, pattern))


def line_count(text: Column) -> Column:
    """Lines; a line feed at the end begins no line."""
    feeds = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(text == "", 0).otherwise(feeds + F.when(F.endswith(text, F.lit("\n")), 0).otherwise(1))


def occurrences(text: Column, word: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / F.lit(len(word))).cast("int")


def complexity(text: Column) -> Column:
    """(lines + 2 * functions + 1.5 * occurrences of branching words, inside words too) / 10."""
    words = sum((occurrences(text, w) for w in COMPLEXITY_WORDS), F.lit(0))
    return (line_count(text) + F.size(all_names(text, C_FUNCTION)) * 2.0 + words * 1.5) / 10.0


def is_system_name(name: Column) -> Column:
    """Blank, a compiler's or the C library's name; the last part of a qualified one decides."""
    last = F.lower(F.trim(F.element_at(F.split(name, "::"), -1)))
    by_prefix = F.lit(False)
    for p in SYSTEM_PREFIXES:
        by_prefix = by_prefix | F.startswith(last, F.lit(p))
    return F.coalesce((name == "") | by_prefix | last.isin(SYSTEM_NAMES), F.lit(True))


def rust_target(text: Column) -> Column:
    """bin or lib, by the text of a Rust file."""
    return F.when(F.contains(text, F.lit("fn main(")), "bin").when(F.contains(text, F.lit("pub fn")) | F.contains(text, F.lit("pub struct")) | F.contains(text, F.lit("pub trait")), "lib").otherwise("bin")


def c_target(text: Column) -> Column:
    return F.when(F.contains(F.lower(text), F.lit("main(")), "bin").otherwise("lib")


def strip_line_numbers(text: Column) -> Column:
    """Text without the numbers, and the blanks behind them, that some tools put before lines; trimmed."""
    return F.regexp_replace(F.regexp_replace(text, r"(?dm)^\s*\d+\s+", ""), r"^\s+|\s+\z", "")


def numbered_lines(text: Column) -> Column:
    """Text with the number of each line before it."""
    return F.array_join(F.transform(F.split(text, "\n", -1), lambda x, i: F.concat(F.lit("   "), (i + 1).cast("string"), F.lit(" "), x)), "\n")


def signature(return_type: Column, name: Column, parameters: Column) -> Column:
    """``type name(type a, type b)`` from parts; parameters is an array of structs with type and name."""
    listed = F.array_join(F.transform(parameters, lambda p: F.concat_ws(" ", F.coalesce(p["type"], F.lit("?")), F.coalesce(p["name"], F.lit("param")))), ", ")
    return F.concat(F.coalesce(return_type, F.lit("void")), F.lit(" "), name, F.lit("("), listed, F.lit(")"))


# --- what needs state ----------------------------------------------------------------------
_CALLED = re.compile(r"(\w+)\s*\(")
_TYPE_BEFORE = re.compile(r"(\w+)((?:\s*\*)+\s*|\s+)\Z")
_STRUCT_OPEN = re.compile(r"\bstruct\s*(\w*)\s*\{")
_ALIAS = re.compile(r"\s*(\w*)\s*;")
_NOTES = re.compile(r"//[^\n]*|/\*.*?\*/", re.S)
_NOT_TYPES = frozenset("return else goto case sizeof".split())
_RUST_FN = re.compile(r"(?m)^[ \t]*(pub(?:\([^)]*\))?\s+)?((?:const|async|unsafe|extern\s+\"[^\"]*\")\s+)*fn\s+(\w+)\s*(?:<[^>(]*>)?\s*\(([^)]*)\)\s*(?:->\s*([^{;]+?))?\s*(?:where[^{;]*)?[{;]")
#: Kinds of symbols and what introduces them.
SYMBOLS = {
    "function": r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe|extern\s+\"[^\"]*\")\s+)*fn\s+([A-Za-z_]\w*)",
    "struct": r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+([A-Za-z_]\w*)",
    "enum": r"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+([A-Za-z_]\w*)",
    "trait": r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+([A-Za-z_]\w*)",
    "impl": r"^\s*(?:unsafe\s+)?impl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?([A-Za-z_]\w*)",
    "module": r"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+([A-Za-z_]\w*)",
}
_SYMBOLS = [(k, re.compile(p)) for k, p in SYMBOLS.items()]


def split_parameters(text: str) -> list[str]:
    """Parameters of a C function; commas inside parentheses do not split."""
    out, depth, begin = [], 0, 0
    for i, ch in enumerate(text):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append(text[begin:i].strip())
            begin = i + 1
    out.append(text[begin:].strip())
    return [x for x in out if x and x != "void"]


def _typed(word: str, missing: str) -> tuple[str, str]:
    parts = word.split()
    if len(parts) < 2:
        return (parts[0] if parts else ""), missing
    return " ".join(parts[:-1]), parts[-1].strip("[]*&;")


def closing(text: str, at: int, ends: str = "") -> int:
    """Place of the bracket that closes the one at ``at``; -1 where there is none, or where one of ``ends`` comes before."""
    opens, closes = text[at], {"(": ")", "{": "}", "[": "]"}[text[at]]
    depth = 0
    for i in range(at, len(text)):
        ch = text[i]
        if ch == opens:
            depth += 1
        elif ch == closes:
            depth -= 1
            if not depth:
                return i
        elif ch in ends:
            return -1
    return -1


def c_functions(code: str) -> list[tuple[str, int, str, list[tuple[str, str]]]]:
    """(name, line, return type, [(type, name)]) of each function of C text, declared or defined.

    A name behind a type, its parentheses, and a brace or a semicolon behind them.
    """
    out = []
    for m in _CALLED.finditer(code):
        kind = _TYPE_BEFORE.search(code, max(0, m.start() - 200), m.start())
        if not kind or kind[1] in _NOT_TYPES or kind[1].isdigit():
            continue
        end = closing(code, m.end() - 1, "{;")
        behind = code[end + 1 :].lstrip()[:1] if end > 0 else ""
        if behind and behind in "{;":
            stars = "".join(kind[2].split())
            inside = code[m.end() : end]
            out.append((m[1], code.count("\n", 0, kind.start(1)) + 1, kind[1] + (" " + stars if stars else ""), [_typed(p, "param") for p in split_parameters(inside)]))
    return out


def c_structs(code: str) -> list[tuple[str, int, list[tuple[str, str]]]]:
    """(name or alias, line, [(type, name)]) of each struct with a body; nameless ones are left out.

    Members are what semicolons end on the body's own level; a struct within a struct
    is a member, and a struct of its own if it has a name.
    """
    out = []
    for m in _STRUCT_OPEN.finditer(code):
        end = closing(code, m.end() - 1)
        alias = _ALIAS.match(code, end + 1) if end > 0 else None
        name = m[1] or (alias[1] if alias else "")
        if not alias or not name:
            continue
        members, depth, begin = [], 0, m.end()
        body = _NOTES.sub(lambda n: " " * len(n[0]), code[m.end() : end])
        begin = 0
        for i, ch in enumerate(body):
            depth += (ch in "{(") - (ch in "})")
            if ch == ";" and not depth:
                members.append(_typed(body[begin:i].strip(), "unnamed"))
                begin = i + 1
        out.append((name, code.count("\n", 0, m.start()) + 1, members))
    return out


def rust_functions(code: str) -> list[tuple[str, int, str, list[tuple[str, str]]]]:
    out = []
    for m in _RUST_FN.finditer(code):
        params = []
        for p in m[4].split(","):
            name, colon, kind = p.partition(":")
            if p.strip():
                params.append((kind.strip() if colon else "Self", name.strip()))
        out.append((m[3], code.count("\n", 0, m.start(3)) + 1, (m[5] or "()").strip(), params))
    return out


def block_end(lines: list[str], start: int) -> int:
    """1-based line on which the block that begins at ``start`` (0-based) closes; the start's own line without a brace, the last line without an end."""
    depth, opened = 0, False
    for i in range(start, len(lines)):
        for ch in lines[i]:
            if ch == "{":
                depth += 1
                opened = True
            elif ch == "}" and opened:
                depth -= 1
                if not depth:
                    return i + 1
        if not opened and (lines[i].rstrip().endswith(";") or i > start + 20):
            return start + 1
    return len(lines) if opened else start + 1


def rust_symbols(code: str) -> list[tuple[str, str, int, int]]:
    """(kind, name, first line, last line) of each symbol, by first line."""
    lines = code.splitlines()
    return [(kind, m[1], i + 1, block_end(lines, i)) for i, ln in enumerate(lines) for kind, p in _SYMBOLS if (m := p.match(ln))]


def shell_words(text: str) -> list[str]:
    """Words of a command line; quotes group, a backslash frees the next character, an open quote ends with the text."""
    out: list[str] = []
    word, quote, free = "", "", False
    for ch in text:
        if free:
            word, free = word + ch, False
        elif ch == "\\":
            free = True
        elif quote:
            word, quote = (word, "") if ch == quote else (word + ch, quote)
        elif ch in "'\"":
            quote = ch
        elif ch.isspace():
            out += [word] if word else []
            word = ""
        else:
            word += ch
    return out + ([word] if word else [])


def function_facts(entries: DataFrame) -> DataFrame:
    """id, language, position, name, line, return_type, parameters of every function in C, C++ and Rust text."""
    part = pa.list_(pa.struct([("type", pa.string()), ("name", pa.string())]))

    def run(batches):
        for b in batches:
            rows = []
            for i, lang, code in zip(*(b.column(k).to_pylist() for k in range(3))):
                found = rust_functions(code) if lang == "rust" else c_functions(code)
                rows += [(i, lang, k, n, ln, r, [{"type": t, "name": x} for t, x in ps]) for k, (n, ln, r, ps) in enumerate(found, 1)]
            cols = list(zip(*rows)) if rows else [()] * 7
            types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), part]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["id", "language", "position", "name", "line", "return_type", "parameters"])

    from millrace.functions.slices import canonical_language

    kept = entries.select("id", canonical_language(F.col("language")).alias("language"), "code").where(F.col("language").isin("c", "cpp", "rust") & F.col("code").isNotNull())
    return kept.mapInArrow(sliced(run), "id string, language string, position int, name string, line int, return_type string, parameters array<struct<type: string, name: string>>")


def struct_facts(entries: DataFrame) -> DataFrame:
    """id, position, name, line, members of every struct of C and C++ text."""
    part = pa.list_(pa.struct([("type", pa.string()), ("name", pa.string())]))

    def run(batches):
        for b in batches:
            rows = [(i, k, n, ln, [{"type": t, "name": x} for t, x in ms]) for i, code in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for k, (n, ln, ms) in enumerate(c_structs(code), 1)]
            cols = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string(), pa.int32(), pa.string(), pa.int32(), part])], ["id", "position", "name", "line", "members"])

    from millrace.functions.slices import canonical_language

    kept = entries.where(canonical_language(F.col("language")).isin("c", "cpp") & F.col("code").isNotNull()).select("id", "code")
    return kept.mapInArrow(sliced(run), "id string, position int, name string, line int, members array<struct<type: string, name: string>>")


def symbol_facts(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """record_id, kind, name, start_line, end_line of every symbol of Rust text."""

    def run(batches):
        for b in batches:
            rows = [(i, *r) for i, code in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in rust_symbols(code)]
            cols = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()])], ["record_id", "kind", "name", "start_line", "end_line"])

    kept = texts.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("record_id"), F.col(text_col).alias("text"))
    return kept.mapInArrow(sliced(run), "record_id string, kind string, name string, start_line int, end_line int")
