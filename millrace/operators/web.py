"""Pages: source types, HTML extraction, code blocks and their languages, search results."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.runtime import sliced, table

#: Parts of a URL and the source type they stand for, in order.
SOURCE_TYPES = [("stackoverflow.com", "StackOverflow"), ("doc.rust-lang.org", "RustDoc"), ("github.com", "GitHub"), ("reddit.com", "Forum"), ("discourse", "Forum"), ("blog", "Blog"), ("medium.com", "Blog")]
#: Parts of a class attribute and the language they stand for, in order.
CLASS_LANGUAGES = [("rust", "rust"), ("rs", "rust"), ("javascript", "javascript"), ("js", "javascript"), ("python", "python"), ("py", "python"), ("cpp", "cpp"), ("c++", "cpp")]
#: Words of a snippet and the language they stand for, in order.
CONTENT_LANGUAGES = [
    ("rust", ["fn ", "let ", "mut ", "impl ", "use ", "struct ", "enum "]),
    ("javascript", ["function", "const ", "var "]),
    ("python", ["def ", "import ", "class "]),
]
#: Where a page's title and body are looked for, in order ("." a class, "#" an id).
TITLE_PLACES = ["h1", "title", ".title", "#title"]
BODY_PLACES = ["main", "article", ".content", ".post", ".entry", "body"]
LEAST_CODE_BYTES = 10


def _first_of(rules: list[tuple[Column, str]], otherwise) -> Column:
    out = F.lit(otherwise) if not isinstance(otherwise, Column) else otherwise
    for condition, value in reversed(rules):
        out = F.when(condition, value).otherwise(out)
    return out


def has(text: Column, part: str) -> Column:
    return F.contains(text, F.lit(part))


def source_type(url: Column) -> Column:
    low = F.lower(url)
    return _first_of([(has(low, part), kind) for part, kind in SOURCE_TYPES], "Unknown")


def language_of_class(css: Column) -> Column:
    low = F.lower(css)
    named = F.nullif(F.regexp_extract(low, r"language-([^ ]*)", 1), F.lit(""))
    return _first_of([(has(low, part), lang) for part, lang in CLASS_LANGUAGES], named)


def language_of_code(code: Column) -> Column:
    low = F.lower(code)
    rules = []
    for lang, words in CONTENT_LANGUAGES:
        hit = F.lit(False)
        for w in words:
            hit = hit | has(low, w)
        rules.append((hit, lang))
    return _first_of(rules, F.lit(None).cast("string"))


def is_substantial(code: Column) -> Column:
    return F.octet_length(F.trim(F.regexp_replace(code, r"^\s+|\s+$", ""))) > LEAST_CODE_BYTES


def code_blocks(pages: DataFrame) -> DataFrame:
    """page_id, position, language (stored, else by content), code of each substantial block."""
    b = pages.select("page_id", F.posexplode("code_blocks").alias("position", "b")).where("b IS NOT NULL")
    lang = F.coalesce(F.nullif(F.lower("b.language"), F.lit("")), language_of_code(F.col("b.code")))
    return b.where(is_substantial(F.col("b.code"))).select("page_id", "position", lang.alias("language"), F.col("b.code").alias("code"))


def page_metadata(pages: DataFrame) -> DataFrame:
    """page_id, source_type, votes, n_tags, first_tag of each page."""
    m = F.col("metadata")
    return pages.select("page_id", F.coalesce(m["source_type"], source_type(F.col("url"))).alias("source_type"), F.coalesce(m["vote_score"], F.lit(0)).alias("votes"), F.coalesce(F.array_size(m["tags"]), F.lit(0)).alias("n_tags"), F.try_element_at(m["tags"], F.lit(1)).alias("first_tag"))


class _Page(HTMLParser):
    """Text under the elements of interest, and code blocks, in one pass."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, str, str]] = []
        self.found: dict[str, list[str]] = {}
        self.open: list[tuple[str, int, list[str]]] = []
        self.blocks: list[tuple[str | None, str]] = []
        self.code: list[tuple[int, str, str, list[str]]] = []
        self.mute = 0

    def handle_starttag(self, tag, attrs):
        if tag in self.VOID:
            return
        a = dict(attrs)
        css, ident = a.get("class") or "", a.get("id") or ""
        self.stack.append((tag, css, ident))
        if tag in ("script", "style"):
            self.mute += 1
        names = {tag, *("." + c for c in css.split()), "#" + ident}
        for place in (*TITLE_PLACES, *BODY_PLACES):
            if place in names and place not in self.found and not any(p == place for p, _, _ in self.open):
                self.open.append((place, len(self.stack), []))
        if tag in ("pre", "code"):
            self.code.append((len(self.stack), tag, css, []))

    def handle_endtag(self, tag):
        if not any(t == tag for t, _, _ in self.stack):
            return
        while self.stack:
            depth = len(self.stack)
            for item in [o for o in self.open if o[1] == depth]:
                self.found.setdefault(item[0], item[2])
                self.open.remove(item)
            for item in [c for c in self.code if c[0] == depth]:
                # a code element inside a pre is told once by each, as the selectors overlap
                self.blocks.append((item[2], "".join(item[3])))
                self.code.remove(item)
            closed = self.stack.pop()
            if closed[0] in ("script", "style"):
                self.mute -= 1
            if closed[0] == tag:
                break

    def handle_data(self, data):
        if self.mute:
            return
        for _, _, parts in self.open:
            parts.append(data)
        for c in self.code:
            c[3].append(data)

    def finish(self):
        for place, _, parts in self.open:
            self.found.setdefault(place, parts)


def page_from_html(html: str) -> tuple[str | None, str | None, list[tuple[str | None, str]]]:
    """(title, body text, [(class, code)]) of a whole page; the fetch source cuts what it fetches."""
    p = _Page()
    p.feed(html)
    p.close()
    p.finish()

    def text(places):
        for place in places:
            if place in p.found and (t := " ".join("".join(p.found[place]).split())):
                return t
        return None

    return text(TITLE_PLACES), text(BODY_PLACES), [(css or None, code) for css, code in p.blocks if len(code.strip().encode()) > LEAST_CODE_BYTES]


def extract_pages(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, title, main_content, code_blocks of HTML pages."""
    block = pa.list_(pa.struct([("class", pa.string()), ("code", pa.string())]))

    def run(batches):
        for b in batches:
            got = [page_from_html(h) for h in b.column(1).to_pylist()]
            blocks = [[{"class": c, "code": x} for c, x in g[2]] for g in got]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string()), pa.array(blocks, block)], ["page_id", "title", "main_content", "code_blocks"])

    kept = df.where(F.col(html_col).isNotNull()).select(F.col(id_col).cast("long").alias("page_id"), html_col)
    return kept.mapInArrow(sliced(run), "page_id long, title string, main_content string, code_blocks array<struct<class: string, code: string>>")


def search_results(responses: DataFrame, text_col: str, most: int = 10) -> DataFrame:
    """id, title, url, snippet, score of a search engine's JSON: abstract, then up to ``most``/2 of two sections."""
    item = "array<struct<Text: string, FirstURL: string>>"
    j = responses.select("id", F.from_json(text_col, f"AbstractText string, AbstractURL string, RelatedTopics {item}, Results {item}").alias("j"))
    abstract = F.struct(F.lit("Abstract").alias("title"), F.coalesce("j.AbstractURL", F.lit("")).alias("url"), F.col("j.AbstractText").alias("snippet"), F.lit(0.9).alias("score"))

    def section(name: str, prefix: str, score: float):
        rows = F.filter(F.slice(F.coalesce(f"j.{name}", F.array().cast(item)), 1, most // 2), lambda x: x["Text"].isNotNull() & x["FirstURL"].isNotNull())
        return F.transform(rows, lambda x: F.struct(F.concat(F.lit(prefix), F.split_part(x["Text"], F.lit(" - "), F.lit(1))).alias("title"), x["FirstURL"].alias("url"), x["Text"].alias("snippet"), F.lit(score).alias("score")))

    own = F.when(F.coalesce("j.AbstractText", F.lit("")) != "", F.array(abstract)).otherwise(F.array().cast("array<struct<title: string, url: string, snippet: string, score: double>>"))
    rows = F.concat(own, section("RelatedTopics", "Related: ", 0.7), section("Results", "", 0.8))
    return j.select("id", F.explode(rows).alias("r")).select("id", "r.title", "r.url", "r.snippet", "r.score")


def _pages(s, d):
    return table(s, d, "web_pages")


QUERIES = {
    "html_source_type": lambda s, d: _pages(s, d).select("page_id", source_type(F.col("url")).alias("source_type")),
    "html_code_blocks": lambda s, d: code_blocks(_pages(s, d)),
    "html_class_language": lambda s, d: _pages(s, d).select("page_id", F.explode("code_blocks").alias("b")).select("page_id", language_of_class(F.col("b.language")).alias("language")).groupBy("page_id", "language").agg(F.count("*").alias("n_blocks")),
    "html_metadata": lambda s, d: page_metadata(_pages(s, d)),
    "html_title": lambda s, d: _pages(s, d).select("page_id", F.split_part("title", F.lit(" - "), F.lit(1)).alias("short_title"), F.url_encode(F.split_part("title", F.lit(" - "), F.lit(1))).alias("encoded")),
}


def _has(col: str, rules, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({col}), '{p}') THEN '{v}'" for p, v in rules) + f" ELSE {otherwise} END"


_BY_CODE = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(code), '{w}')" for w in ws) + f" THEN '{lang}'" for lang, ws in CONTENT_LANGUAGES) + " END"
_BLOCKS = "SELECT page_id, unnest(range(0, len(code_blocks)))::INT AS position, unnest(code_blocks) AS b FROM web_pages"
ORACLE_SQL = {
    "html_source_type": f"SELECT page_id, {_has('url', SOURCE_TYPES, chr(39) + 'Unknown' + chr(39))} AS source_type FROM web_pages",
    "html_code_blocks": f"""SELECT page_id, position, coalesce(nullif(lower(language), ''), {_BY_CODE}) AS language, code FROM (SELECT page_id, position, b.language AS language, b.code AS code FROM ({_BLOCKS}))
        WHERE strlen(regexp_replace(code, '^\\s+|\\s+$', '', 'g')) > 10""",
    "html_class_language": f"SELECT page_id, {_has('language', CLASS_LANGUAGES, 'nullif(regexp_extract(lower(language), ' + chr(39) + 'language-([^ ]*)' + chr(39) + ', 1), ' + chr(39) * 2 + ')')} AS language, count(*) AS n_blocks FROM (SELECT page_id, b.language AS language FROM ({_BLOCKS})) GROUP BY 1, 2",
    "html_metadata": f"SELECT page_id, coalesce(metadata.source_type, {_has('url', SOURCE_TYPES, chr(39) + 'Unknown' + chr(39))}) AS source_type, coalesce(metadata.vote_score, 0)::INT AS votes, coalesce(len(metadata.tags), 0)::INT AS n_tags, metadata.tags[1] AS first_tag FROM web_pages",
    "html_title": "SELECT page_id, split_part(title, ' - ', 1) AS short_title, replace(url_encode(split_part(title, ' - ', 1)), '%20', '+') AS encoded FROM web_pages",
}
