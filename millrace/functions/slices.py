"""Canonical spellings of languages, sources and project names (Column expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of one language, by canonical name.
LANGUAGE_SPELLINGS = {
    "c": ["c", "c99", "c11", "c17", "ansi c"],
    "cpp": ["cpp", "c++", "cxx", "cc"],
    "rust": ["rust", "rs"],
    "python": ["python", "py", "python3"],
    "javascript": ["javascript", "js", "node"],
}

#: Rows of code_entries with these languages are bookkeeping, not code.
BOOKKEEPING = ["project", "config"]


def canonical_language(col: Column, missing: str = "unknown") -> Column:
    """One name per language; unknown spellings are kept trimmed and in lower case."""
    low = F.lower(F.trim(col))
    out = low
    for name, spellings in LANGUAGE_SPELLINGS.items():
        out = F.when(low.isin(spellings), F.lit(name)).otherwise(out)
    return F.when(low.isNull() | (low == ""), F.lit(missing)).otherwise(out)


def is_code(language: Column) -> Column:
    """True for rows of code_entries that hold code (a null language counts as code)."""
    return ~F.coalesce(F.lower(F.trim(language)).isin(BOOKKEEPING), F.lit(False))


def canonical_source(col: Column, missing: str = "unknown") -> Column:
    low = F.lower(F.trim(col))
    return F.when(low.isNull() | (low == ""), F.lit(missing)).otherwise(low)


def canonical_project(col: Column, missing: str = "unknown") -> Column:
    """Base name in lower case of a project stored as name, checkout path or in another case."""
    unified = F.regexp_replace(F.lower(F.trim(col)), r"[\\/]+", "/")
    base = F.regexp_extract(F.regexp_replace(unified, r"/+$", ""), r"([^/]*)$", 1)
    return F.when(base.isNull() | (base == ""), F.lit(missing)).otherwise(base)


def metadata_field(col: Column, field: str, missing: str = "unknown") -> Column:
    """A string field of JSON metadata that may be null or cut off (then read by pattern)."""
    parsed = F.get_json_object(col, f"$.{field}")
    matched = F.regexp_extract(col, rf'"{field}"\s*:\s*"([^"\\]*)"', 1)
    value = F.lower(F.trim(F.coalesce(parsed, matched)))
    return F.when(value.isNull() | (value == ""), F.lit(missing)).otherwise(value)
