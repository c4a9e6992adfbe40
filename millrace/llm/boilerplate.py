"""Page boilerplate and main content (problem 7).

Method: site template removal.  A page's text is cut into elements (a code block is one
element, any other line is one).  Elements are hashed as they stand and as templates:
with numbers and camel-case names open, and a short line also by its first and its last
words and by the parts it is put together from (a menu, a breadcrumb).  The hashes are
counted per host in Spark, and what recurs across many pages of a host is deleted.  A
run of short lines below a deleted one is the subtree of that head and goes with it, as
the changing teasers under "Related".

Many sites are seen once, where nothing can recur.  The deletions on sites with
several pages therefore label the templates of the corpus: a template that was mostly
deleted where it could be judged is deleted everywhere.

Own text is what is left of sentences and code, the page's own title, and short lines
between them.  What is left before the first or after the last of them, with no
template that vouches for it, is no part of the body.  Pages on which nothing but a
title and a refusal is left have no own text.

Defined results: null and empty contents give no lines; a null or broken url
makes the page a site of its own; a null title is the line that the breadcrumb ends
in, or without one the last of three words or more before the first sentence.  Repeated
page ids give repeated rows only once; if their texts differ, one of them is judged (the
one with the least hash).
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.runtime import materialise, sliced

#: An element is a site's template if it stands on so many of its pages and on this share of them.
LEAST_PAGES, LEAST_SHARE = 3, 0.03
#: Sites with fewer pages judge nothing.
JUDGES = 8
#: A shape is template if this share of its judged occurrences was deleted.
DELETED_SHARE, LEAST_JUDGED = 0.5, 3
#: A page whose only text is up to so many sentences, each standing on this share of all pages (and on two at least), is a refusal.
REFUSAL_LINES, REFUSAL_SHARE = 4, 0.002

_DIGITS = re.compile(r"\d+")
_CAMEL = re.compile(r"\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\b")
_SEPARATED = re.compile(r"\s*(?:[›»>|·/•]|\s{2,})\s*")
_CRUMB = re.compile(r"\s+[›»>/]\s+")
_CODE = re.compile(r"^\s+\S|[;{}]\s*$|^\s*[#@}]|\w\(.*\)\s*(?:->.*)?[{:]?\s*$|^(?:def|class|fn|pub|use|static|const|let|var|import|from|return|struct|enum|impl|async|export|typedef|unsigned|int|void)\b.*[;{(:,=)]\s*$")
_CLOSED = re.compile(r"[.?!。？！…:][\"'”’)`]*\s*$")
_BULLET = re.compile(r"^\s*(?:[-*•→▸]|\d+[.)])\s+")


def shape(line: str) -> str:
    """A line with numbers and camel-case names left open."""
    return _CAMEL.sub("§", _DIGITS.sub("9", line.strip()))


def _hash(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s) - (1 << 63)


def templates(kind: str, s: str) -> list[int]:
    """Hashes of an element of shape ``s``: as it stands, then its templates."""
    words = s.split()
    out = [s]
    if kind in "IN":
        if kind == "N":
            parts = [p for p in _SEPARATED.split(s) if p]
            out += [f"first {min(3, len(parts))} {parts[0]}", *("part " + p for p in parts)]
        if len(words) >= 4:
            out += ["head " + " ".join(words[:2]), "tail " + " ".join(words[-2:])]
    elif kind == "S" and len(words) >= 6:
        out += ["head " + " ".join(words[:4]), "tail " + " ".join(words[-3:]), "ends " + " ".join(words[:2] + words[-2:])]
    return [_hash(x) for x in out]


def title_of(title: str | None) -> str | None:
    if not title or not title.strip():
        return None
    return title.rsplit(" - ", 1)[0].strip() or None


def crumb_of(lines: list[str]) -> str | None:
    """Last part of the first breadcrumb: where the page stands, maybe cut short."""
    for ln in lines:
        parts = [p for p in _CRUMB.split(ln.strip()) if p]
        if len(parts) > 2 and len(parts[-1].split()) > 2 and all(len(p.split()) < 4 for p in parts[:-1]) and not _CLOSED.search(ln):
            return parts[-1]
    return None


def page_elements(title: str | None, text: str) -> list[tuple[int, str, str]]:
    """(line_no, kind, shape) of each non-blank line.

    Kinds: C code, S sentence text, T the page's title, N several parts in one
    line, I other short text.  The shape of a code line is that of its block.
    """
    own = title_of(title)
    lines = text.split("\n")
    crumb = None if own else crumb_of(lines)
    out: list[tuple[int, str, str]] = []
    block: list[int] = []
    depth = 0

    def close():
        nonlocal block, depth
        if block:
            s = "\n".join(lines[i].strip() for i in block)
            out.extend((i + 1, "C", s) for i in block)
        block, depth = [], 0

    for i, ln in enumerate(lines):
        s = ln.strip()
        if not s:
            if depth <= 0:
                close()
            continue
        if own and s == own or crumb and s.startswith(crumb):
            close()
            out.append((i + 1, "T", shape(s)))
            continue
        bullet = _BULLET.match(s)
        sentence = bool(_CLOSED.search(s))
        code = bool(_CODE.search(ln.rstrip())) and not (bullet and sentence) and not (sentence and not ln[:1].isspace() and len(s.split()) > 3 and not s.endswith(":"))
        if code or (block and depth > 0 and not sentence):
            block.append(i)
            depth += s.count("{") - s.count("}")
            continue
        if block and depth > 0 and len(s.split()) <= 3:
            block.append(i)
            continue
        close()
        parts = [p for p in _SEPARATED.split(s) if p]
        kind = "S" if sentence else "N" if len(parts) > 1 and not bullet else "I"
        out.append((i + 1, kind, shape(s)))
    close()
    return out


def own_lines(lines: list[tuple[int, str, bool, int, bool, bool]], titled: bool) -> set[int]:
    """Numbers of the lines that are the page's own text.

    ``lines``: (line_no, kind, template, words, wide, exact) in order; wide lines stand on
    many pages of the corpus, exact ones are templates as they stand, with no word open.
    """
    own = {no for no, kind, template, *_ in lines if kind in "CS" and not template}
    if not own:
        return set()
    body = [(kind, wide) for no, kind, _, _, wide, _ in lines if no in own]
    if len(body) <= REFUSAL_LINES and all(kind == "S" and wide for kind, wide in body):
        return set()
    first, last = min(own), max(own)
    titles = {no for no, kind, *_ in lines if kind == "T"}
    if not titled:
        before = [no for no, kind, _, w, _, exact in lines if no < first and kind == "I" and not exact and w >= 3]
        titles |= set(before[-1:])
    # short lines: those in the subtree of a deleted line go with it, the rest within the body stays
    within, below, ends = set(), False, None
    for no, kind, template, *_ in lines:
        if kind in "IN":
            below = template or below and no == ends
            ends = no + 1
            if not below and first < no < last:
                within.add(no)
        else:
            below = kind == "S" and template
            ends = no + 1 if below else None
    return own | titles | within


def page_rows(pages: DataFrame) -> DataFrame:
    """One row for each page: page_id, site, titled, line numbers, kinds, numbers of words, hashes of each line, marks.

    ``marks`` are the hashes that are counted on the site: all of a short line, the first of any other.
    """
    names = ["page_id", "site", "titled", "nos", "kinds", "words", "hashes", "marks"]
    longs = pa.list_(pa.int64())
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int32()), pa.string(), pa.list_(pa.int32()), pa.list_(longs), longs]

    def run(batches):
        for b in batches:
            rows = []
            for pid, site, title, text in zip(*(b.column(i).to_pylist() for i in range(4))):
                titled = title_of(title) is not None or crumb_of(text.split("\n")) is not None
                found = page_elements(title, text)
                known: dict[tuple[str, str], list[int]] = {}
                hashes = []
                marks: set[int] = set()
                for _, kind, s in found:
                    h = known.get((kind, s))
                    if h is None:
                        h = known[kind, s] = templates(kind, s)
                        marks.update(h if kind in "IN" else h[:1])
                    hashes.append(h)
                rows.append((pid, site, titled, [x[0] for x in found], "".join(x[1] for x in found), [len(x[2].split()) for x in found], hashes, list(marks)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    site = F.when(F.coalesce(host, F.lit("")) == "", F.concat(F.lit("page "), F.col("page_id").cast("string"))).otherwise(host)
    kept = pages.where("main_content IS NOT NULL AND main_content <> '' AND page_id IS NOT NULL").select(F.col("page_id").cast("long").alias("page_id"), F.xxhash64(site).alias("site"), F.col("title").cast("string").alias("title"), F.col("main_content").cast("string").alias("main_content"), F.xxhash64("url", "title", "main_content").alias("copy"))
    # texts are not shuffled: only rows of ids that do recur are sorted out
    repeated = materialise(kept.groupBy("page_id").agg(F.count("*").alias("n"), F.min("copy").alias("copy")).where("n > 1"), "repeated-pages")
    if not repeated.isEmpty():
        once = kept.join(repeated.select("page_id"), "page_id", "left_anti")
        again = kept.join(repeated.select("page_id", "copy"), ["page_id", "copy"], "left_semi").dropDuplicates(["page_id"])
        kept = once.unionByName(again)
    return kept.select("page_id", "site", "title", "main_content").mapInArrow(sliced(run), "page_id long, site long, titled boolean, nos array<int>, kinds string, words array<int>, hashes array<array<long>>, marks array<long>")


def _hits(marks: DataFrame, table: DataFrame, keys: list[str], name: str) -> DataFrame:
    """page_id and the hashes of ``marks`` (page_id, site, hash) that are in ``table``."""
    # a group is one page
    return marks.join(table, keys, "left_semi").groupBy("page_id").agg(F.collect_list("hash").alias(name))


def boilerplate_lines(pages: DataFrame) -> DataFrame:
    """page_id, line_no of each non-blank line that is not the page's own text."""
    spark = pages.sparkSession
    rows = materialise(page_rows(pages), "page-rows")
    sizes = rows.groupBy("site").agg(F.count("*").alias("n_pages"))
    marks = rows.select("page_id", "site", F.explode("marks").alias("hash"))
    counts = materialise(marks.groupBy("site", "hash").agg(F.count("*").alias("n_with")), "mark-counts")
    template = counts.where(F.col("n_with") >= LEAST_PAGES).join(sizes, "site").where(F.col("n_with") >= F.col("n_pages") * LEAST_SHARE).select("site", "hash")
    n_pages = sizes.agg(F.sum("n_pages")).first()[0] or 0
    # at most marks of a page / REFUSAL_SHARE rows
    wide = counts.groupBy("hash").agg(F.sum("n_with").alias("n")).where(F.col("n") >= max(2.0, REFUSAL_SHARE * n_pages)).select("hash").toPandas()
    everywhere = spark.sparkContext.broadcast(frozenset(wide["hash"].tolist()))
    judges = sizes.select("site", (F.col("n_pages") >= JUDGES).alias("judge"))
    judged = materialise(rows.join(_hits(marks, template, ["site", "hash"], "on_site"), "page_id", "left").join(judges, "site").select("page_id", "judge", "titled", "nos", "kinds", "words", "hashes", "on_site"), "judged-pages")

    def vote(batches):
        """(hash, times seen, times deleted) on sites that judge, added up for each batch."""
        for b in batches:
            seen: Counter = Counter()
            deleted: Counter = Counter()
            for kinds, hashes, hits in zip(*(b.column(i).to_pylist() for i in range(3))):
                hits = frozenset(hits or ())
                for kind, hs in zip(kinds, hashes):
                    if kind in "INS":
                        seen.update(hs)
                        if any(h in hits for h in (hs if kind != "S" else hs[:1])):
                            deleted.update(hs)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64()), pa.array([deleted[h] for h in seen], pa.int64())], ["hash", "n", "hits"])

    votes = judged.where("judge").select("kinds", "hashes", "on_site").mapInArrow(sliced(vote), "hash long, n long, hits long")
    model = votes.groupBy("hash").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).where((F.col("n") >= LEAST_JUDGED) & (F.col("hits") >= F.col("n") * DELETED_SHARE)).select("hash")
    asked = judged.select("page_id", F.explode(F.array_except(F.array_distinct(F.flatten("hashes")), F.coalesce("on_site", F.array().cast("array<long>")))).alias("hash"))
    known = judged.join(_hits(asked, model, ["hash"], "learned"), "page_id", "left")

    def decide(batches):
        for b in batches:
            page, out = [], []
            for pid, titled, nos, kinds, words, hashes, on_site, learned in zip(*(b.column(i).to_pylist() for i in range(8))):
                on_site, learned = frozenset(on_site or ()), frozenset(learned or ())
                lines = []
                for no, kind, w, hs in zip(nos, kinds, words, hashes):
                    gone = any(h in on_site for h in (hs if kind in "IN" else hs[:1])) or kind in "INS" and any(h in learned for h in hs)
                    lines.append((no, kind, gone, w, hs[0] in everywhere.value, hs[0] in on_site or hs[0] in learned))
                own = own_lines(lines, titled)
                drop = [x[0] for x in lines if x[0] not in own]
                page += [pid] * len(drop)
                out += drop
            yield pa.RecordBatch.from_arrays([pa.array(page, pa.int64()), pa.array(out, pa.int64())], ["page_id", "line_no"])

    return known.select("page_id", "titled", "nos", "kinds", "words", "hashes", "on_site", "learned").mapInArrow(sliced(decide), "page_id long, line_no long")


def main_content(pages: DataFrame) -> DataFrame:
    """page_id, main_content with the page's own lines only (blank lines between them are kept)."""
    drop = boilerplate_lines(pages).groupBy("page_id").agg(F.collect_set("line_no").alias("drop"))
    kept = pages.select("page_id", "main_content").join(drop, "page_id", "left")
    lines = F.split("main_content", "\n", -1)
    own = F.filter(lines, lambda x, i: ~F.coalesce(F.array_contains("drop", (i + 1).cast("long")), F.lit(False)))
    return kept.select("page_id", F.trim(F.regexp_replace(F.array_join(own, "\n"), r"\n{3,}", "\n\n"), F.lit("\n")).alias("main_content"))
