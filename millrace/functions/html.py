"""A small tree of HTML elements and what is read from it: titles, bodies, code, votes, tags."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements of the known sites, by kind of source: title, bodies, how many bodies, title where there is none.
SITES = {
    "StackOverflow": (["h1 a", ".question-hyperlink"], [".js-post-body", ".s-prose"], 3, "Stack Overflow Question"),
    "RustDoc": (["h1.fqn", "h1.main-heading"], [".docblock", ".rustdoc"], None, "Rust Documentation"),
    "GitHub": (["h1", ".js-issue-title"], [".comment-body", ".markdown-body"], 5, "GitHub Content"),
}
#: Elements that hold code, with the language they stand for, in the order they are told.
CODE_PLACES = [("pre code", None), ("pre", None), (".highlight", None), (".language-rust", "rust"), (".language-rs", "rust"), ('code[class*="language-"]', None)]
#: Tags that pages of a kind bear by themselves.
SITE_TAGS = {"RustDoc": ["rust", "documentation"], "GitHub": ["github"]}


class Node:
    __slots__ = ("tag", "classes", "css", "parent", "children")

    def __init__(self, tag: str, css: str, parent: Node | None):
        self.tag, self.css, self.parent = tag, css, parent
        self.classes = frozenset(css.split())
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """The elements below, in document order; no recursion, so that nesting has no bound."""
        stack = [iter(self.children)]
        while stack:
            for c in stack[-1]:
                if isinstance(c, Node):
                    yield c
                    stack.append(iter(c.children))
                    break
            else:
                stack.pop()

    def texts(self) -> list[str]:
        """Pieces of text below, in document order."""
        out: list[str] = []
        stack = [iter(self.children)]
        while stack:
            for c in stack[-1]:
                if isinstance(c, str):
                    out.append(c)
                else:
                    stack.append(iter(c.children))
                    break
            else:
                stack.pop()
        return out

    def matches(self, selector: str) -> bool:
        """Whether one of ``tag``, ``.class``, ``tag.class``, ``tag[class*="x"]``, ``tag tag`` fits."""
        *above, last = selector.split(" ")
        if '[class*="' in last:
            tag, _, part = last.partition('[class*="')
            here = self.tag == tag and part.rstrip('"]') in self.css
        else:
            tag, _, name = last.partition(".")
            here = (not tag or self.tag == tag) and (not name or name in self.classes)
        if not here or not above:
            return here
        at = self.parent
        while at is not None:
            if at.matches(above[0]):
                return True
            at = at.parent
        return False


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", "", None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, dict(attrs).get("class") or "", self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def select(root: Node, selectors: list[str]) -> list[Node]:
    return [n for n in root.walk() if any(n.matches(s) for s in selectors)]


def code_places(root: Node, least_bytes: int) -> list[tuple[str | None, str, str]]:
    """(language of the place, class, code) for each place in turn: an element that fits several is told by each."""
    out = []
    nodes = list(root.walk())
    for selector, language in CODE_PLACES:
        for n in nodes:
            if n.matches(selector):
                code = "".join(n.texts()).strip()
                if len(code.encode()) > least_bytes:
                    out.append((language, n.css, code))
    return out


def site_page(html: str, kind: str, least_bytes: int) -> dict:
    """title, main_content, votes, tags and code places of a page of a known site."""
    root = parse(html)
    titles, bodies, most, missing = SITES[kind]
    title = select(root, titles)[:1]
    found = select(root, bodies)
    texts = [" ".join(" ".join(n.texts()).split()) for n in (found if most is None else found[:most])]
    votes = None
    if kind == "StackOverflow":
        counts = select(root, [".js-vote-count"])[:1]
        said = "".join(counts[0].texts()[:1]).strip() if counts else ""
        votes = int(said) if said.lstrip("+-").isdecimal() and said.isascii() else None
    tags = ["".join(n.texts()) for n in select(root, [".post-tag"])] if kind == "StackOverflow" else SITE_TAGS.get(kind, [])
    return {"title": " ".join("".join(title[0].texts()).split()) if title else missing, "main_content": "\n\n".join(texts), "votes": votes, "tags": tags, "places": code_places(root, least_bytes)}
