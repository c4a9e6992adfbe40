"""Which other language is a text?  Token-based ranking, then one parser for each language.

JSON, TOML and Python are parsed by the standard library, C, C++ and JavaScript by the
parsers of ``cparse`` and ``jsparse``.
"""

from __future__ import annotations

import ast
import json
import re
import tomllib
import warnings
from collections import Counter

from millrace.llm import jsparse
from millrace.llm.cparse import CParser
from millrace.llm.rustparse import Malformed, deep_enough
from millrace.llm.rustparse import error_in as rust_error

#: Words that speak for a language, with the punctuation that does.
SIGNS = {
    "c": "#include #define typedef struct static const unsigned int char void sizeof NULL switch goto uint8_t size_t -> ;",
    "cpp": "#include namespace class template typename public private virtual nullptr std :: new delete auto using bool ;",
    "javascript": "function const let var => === !== async await undefined null this export import require console typeof new ;",
    "python": "def class self None True False elif except lambda import from raise yield with pass in not : #",
    "json": '": { } [ ] true false null ,',
    "toml": "[package] [dependencies] version edition name = [",
    "rust": "fn let mut pub impl use crate match unsafe -> :: => usize u32 Some None Ok Err ;",
}
_SIGN_SETS = {k: frozenset(v.split()) for k, v in SIGNS.items()}
#: A sign that several languages share speaks less for each.
_SHARED = Counter(s for signs in _SIGN_SETS.values() for s in signs)
_SIGN = re.compile(r'#include|#define|\[package\]|\[dependencies\]|":|===|!==|=>|->|::|[A-Za-z_]\w*|[^\w\s]')


def rank_languages(text: str) -> list[str]:
    """Languages by the share of the text's tokens that speak for them, likeliest first."""
    seen = Counter(_SIGN.findall(text))
    score = {lang: sum(seen[s] / _SHARED[s] for s in signs if s in seen) / (1 + len(signs)) ** 0.5 for lang, signs in _SIGN_SETS.items()}
    return sorted(score, key=lambda k: (-score[k], k))


def parses_as(text: str, lang: str) -> bool:
    """Is the text well-formed in the language?  Bare words and numbers count for none."""
    try:
        if lang == "json":
            return isinstance(json.loads(text), (dict, list))
        if lang == "toml":
            return bool(tomllib.loads(text))
        if lang == "python":
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                tree = ast.parse(text)
            return any(not isinstance(x, ast.Expr) for x in tree.body)
        if lang == "rust":
            return rust_error(text) is None
        deep_enough(len(text))
        if lang == "javascript":
            jsparse.parse(text)
        else:
            CParser(text, lang == "cpp").file()
        return True
    except (Malformed, ValueError, SyntaxError, RecursionError, MemoryError, IndexError):
        return False


def accepting_languages(text: str) -> list[str]:
    """All supported languages in which the text is well-formed, likeliest by its tokens first."""
    return [lang for lang in rank_languages(text) if parses_as(text, lang)]


def foreign_language(text: str, own: str = "rust") -> str | None:
    """The likeliest other language in which the text is well-formed; None if there is none."""
    return next((lang for lang in rank_languages(text) if lang != own and parses_as(text, lang)), None)
