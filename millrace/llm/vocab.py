"""Public tokenizers, loaded once for each worker process from a folder given as parameter."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

#: Folder of the vocabulary files, on every machine.
TOKENIZER_DIR = "/opt/tokenizers"
#: Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def ranks(name: str, folder: str) -> dict[bytes, int]:
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def encoding(name: str, folder: str):
    import tiktoken

    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks(name, folder), special_tokens={})


@lru_cache(maxsize=1)
def splitter():
    import regex

    return regex.compile(PATTERN)


_SPACE = r"[\t\n\x0b\x0c\r ]"
#: PATTERN where all characters are ASCII.
_ASCII = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^A-Za-z0-9\t\n\x0b\x0c\r ]+|{_SPACE}+(?![^\t\n\x0b\x0c\r ])|{_SPACE}+")


def pretokens(text: str | None) -> list[str]:
    """The pieces that PATTERN cuts a text into; none of a null one."""
    if not text:
        return []
    return _ASCII.findall(text) if text.isascii() else splitter().findall(text)


def count_tokens(texts: list[str], name: str, folder: str) -> list[int]:
    """Tokens of each text; 0 for null."""
    enc = encoding(name, folder)
    return [len(enc.encode_ordinary(t)) if t else 0 for t in texts]
