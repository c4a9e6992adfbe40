"""Syntax of Rust 2021: does a text parse as a source file?

A lexer and a recursive-descent parser without a tree.  Names, types and missing
crates do not matter; what a parser accepts before it is rejected by later
checks (a constant without a value, a free function without a body) is accepted.
"""

from __future__ import annotations

import re
import sys


class Malformed(ValueError):
    """The text is no source file of the language."""


#: The strict and reserved keywords of the language.
KEYWORDS = frozenset(
    "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while"
    " abstract become box do final macro override priv try typeof unsized virtual yield".split()
)
_ESC = r"\\(?:[nrt\\0'\"]|x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]{1,8}\}|\r?\n)"
_LEX = re.compile(
    r"\s*("
    r"//[^\n]*|/\*(?:[^*/]|\*(?!/)|/(?!\*))*\*/|/\*"
    r"|[bc]?r\"[^\"]*\"|[bc]?r#\"(?:[^\"]|\"(?!#))*\"#|[bc]?r##\"(?:[^\"]|\"(?!##))*\"##|[bc]?r###\"(?:[^\"]|\"(?!###))*\"###"
    rf"|[bc]?\"(?:[^\"\\]|{_ESC})*\""
    rf"|b?'(?:[^'\\\n\r\t]|{_ESC})'"
    r"|'(?:r#)?[^\W\d]\w*(?!')"
    r"|r#[^\W\d]\w*|[^\W\d]\w*[\"']?"
    r"|0x[0-9a-fA-F_]*[0-9a-fA-F]\w*|0b[01_]*[01][01_]*(?:[iu]\w+)?|0o[0-7_]*[0-7][0-7_]*(?:[iu]\w+)?"
    r"|[0-9][0-9_]*(?:\.[0-9][0-9_]*|\.(?![.\w]))?(?:[eE][+-]?_*[0-9][0-9_]*)?(?:[iuf](?:8|16|32|64|128|size))?(?!\w)"
    r"|<<=|>>=|\.\.\.|\.\.=|::|->|=>|[=!<>+\-*/%^&|]=|&&|\|\||<<|>>|\.\.|[-+*/%^!&|=<>@.,;:#$?~(){}\[\]]"
    r"|\S)",
    re.S,
)
_PUNCT = frozenset("<<= >>= ... ..= :: -> => == != <= >= += -= *= /= %= ^= &= |= && || << >> .. - + * / % ^ ! & | = < > @ . , ; : # $ ? ~ ( ) { } [ ]".split())
_CLOSE = {"(": ")", "[": "]", "{": "}"}


class _Kinds(dict):
    """Token text -> kind; '' for comments.  Forgets all when it grows too large."""

    def __missing__(self, tok: str) -> str:
        c = tok[0]
        if len(self) > 100_000:
            self.clear()
            self.update(_FIXED)
        if c == "/":
            if tok == "/*":
                kind = "nested"
            elif tok.startswith("//"):
                kind = "doc" if tok.startswith("///") and not tok.startswith("////") else "idoc" if tok.startswith("//!") else ""
            else:
                kind = "doc" if tok.startswith("/**") and len(tok) > 4 and tok[3] != "*" else "idoc" if tok.startswith("/*!") else ""
            return kind
        if tok[-1] in "\"'" and (c.isidentifier() and tok[-2:-1] not in "\"'" and "\"" not in tok[:-1] and "'" not in tok[:-1]):
            return "bad"  # reserved prefix before a quote, or a quote that never closes
        if c == '"' or (len(tok) > 1 and tok[-1] in "\"#" and c in "bcr" and '"' in tok):
            return "str" if len(tok) > 1 else "bad"
        if c == "'" or (c == "b" and tok[1:2] == "'"):
            kind = "str" if tok[-1] == "'" and len(tok) > 2 else "life" if len(tok) > 1 else "bad"
            return kind
        if c.isdigit():
            kind = "num"
        elif c == "r" and tok.startswith("r#"):
            kind = "id"
        elif c.isidentifier():
            kind = "id"
        else:
            return "bad"
        self[tok] = kind
        return kind


_FIXED = {w: w for w in KEYWORDS | _PUNCT} | {"_": "_"}
_KINDS = _Kinds(_FIXED)
_WEAK = {"union", "macro_rules", "auto", "default", "safe", "raw"}


def _nested_comments_out(text: str) -> str:
    """Replace block comments, nested ones too, by a space (doc ones by a plain doc comment)."""
    out, pos = [], 0
    skip = re.compile(r"//[^\n]*|[bc]?r(#*)\"|[bc]?\"(?:[^\"\\]|\\.)*\"|b?'(?:[^'\\\n]|\\.[^'\n]*)'|/\*", re.S)
    mark = re.compile(r"/\*|\*/")
    while m := skip.search(text, pos):
        if m[0] == "/*":
            out.append(text[pos : m.start()])
            depth, at = 1, m.end()
            while depth:
                n = mark.search(text, at)
                if not n:
                    raise Malformed("unterminated block comment")
                depth += 1 if n[0] == "/*" else -1
                at = n.end()
            body = text[m.start() : at]
            out.append("/** doc */" if body.startswith("/**") and len(body) > 4 and body[3] not in "*/" else "/*! doc */" if body.startswith("/*!") else " ")
            pos = at
        elif m[0].endswith('"') and m[1] is not None:
            end = text.find('"' + m[1], m.end())
            if end < 0:
                raise Malformed("unterminated raw string")
            end += 1 + len(m[1])
            if len(m[1]) > 255:
                raise Malformed("too many # around a raw string")
            # more than three # are as good as one
            out.append(text[pos:end] if len(m[1]) < 4 else text[pos : m.start()] + m[0].partition("#")[0] + '""')
            pos = end
        else:
            out.append(text[pos : m.end()])
            pos = m.end()
    out.append(text[pos:])
    return "".join(out)


def tokens(text: str) -> tuple[list[str], list[str]]:
    """(kinds, texts) without plain comments."""
    if text.startswith("\ufeff"):
        text = text[1:]
    if text.startswith("#!") and not re.match(r"#!\s*\[", text):
        text = text.partition("\n")[2]
    if '####"' in text:
        text = _nested_comments_out(text)
    toks = _LEX.findall(text)
    kinds = [_KINDS[t] for t in toks]
    if "nested" in kinds:
        toks = _LEX.findall(_nested_comments_out(text))
        kinds = [_KINDS[t] for t in toks]
    if "" in kinds:
        pairs = [(k, t) for k, t in zip(kinds, toks) if k]
        kinds, toks = [k for k, _ in pairs], [t for _, t in pairs]
    if "bad" in kinds or "nested" in kinds:
        raise Malformed("no token at " + toks[kinds.index("bad" if "bad" in kinds else "nested")][:20])
    return kinds, toks


_ASSIGN = frozenset("= += -= *= /= %= ^= &= |= <<= >>=".split())
_BINARY = {"||": 3, "&&": 4, "==": 5, "!=": 5, "<": 5, ">": 5, "<=": 5, ">=": 5, "|": 6, "^": 7, "&": 8, "<<": 9, ">>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11}
_ENDS_EXPR = frozenset(") ] } , ; => end else".split())
_PATH_START = frozenset("id self Self super crate ::".split())
_SEGMENT = frozenset("id self Self super crate".split())
_LITERAL = frozenset("num str true false".split())
_ITEM = frozenset("fn struct enum use mod static type trait impl extern pub const unsafe async".split())


class Parser:
    """Walks over the kinds of a token list; raises Malformed at the first error."""

    def __init__(self, kinds: list[str], toks: list[str]):
        self.k = [*kinds, "end", "end", "end", "end"]
        self.t = [*toks, "", "", "", ""]
        self.p = 0
        match: dict[int, int] = {}
        stack: list[int] = []
        for i, x in enumerate(kinds):
            if x in _CLOSE:
                stack.append(i)
            elif x in (")", "]", "}"):
                if not stack or _CLOSE[kinds[stack[-1]]] != x:
                    raise Malformed("unbalanced " + x)
                match[stack.pop()] = i
        if stack:
            raise Malformed("unclosed " + kinds[stack[-1]])
        self.match = match

    # helpers
    def fail(self, what: str = "unexpected"):
        raise Malformed(f"{what} at {' '.join(self.t[self.p : self.p + 4])}")

    def need(self, kind: str):
        if self.k[self.p] != kind:
            self.fail("wanted " + kind)
        self.p += 1

    def got(self, kind: str) -> bool:
        if self.k[self.p] == kind:
            self.p += 1
            return True
        return False

    def weak(self, word: str, at: int = 0) -> bool:
        return self.k[self.p + at] == "id" and self.t[self.p + at] == word

    def close_angle(self):
        k = self.k[self.p]
        if k == ">":
            self.p += 1
        elif k in (">>", ">=", ">>="):
            self.k[self.p] = k[1:]
        else:
            self.fail("wanted >")

    def open_angle(self) -> bool:
        k = self.k[self.p]
        if k == "<":
            self.p += 1
            return True
        if k == "<<":
            self.k[self.p] = "<"
            return True
        return False

    def tree(self):
        """A delimited token tree."""
        if self.k[self.p] not in _CLOSE:
            self.fail("wanted a token tree")
        self.p = self.match[self.p] + 1

    def attrs(self, inner: bool = False) -> bool:
        """Attributes; True if there was an outer one."""
        k, outer = self.k, False
        while True:
            x = k[self.p]
            if x == "doc":
                self.p += 1
                outer = True
            elif x == "idoc":
                if not inner:
                    self.fail("inner doc comment")
                self.p += 1
            elif x == "#":
                if k[self.p + 1] == "!" and k[self.p + 2] == "[":
                    if not inner or outer:
                        self.fail("inner attribute")
                    self.p += 2
                elif k[self.p + 1] == "[":
                    self.p += 1
                    outer = True
                else:
                    self.fail("attribute")
                if k[self.p + 1] not in _PATH_START and k[self.p + 1] != "unsafe":
                    self.fail("attribute")
                self.tree()
            else:
                return outer

    def commas(self, close: str, one):
        """``one`` repeated, with commas between and maybe one after, then the close."""
        k = self.k
        while k[self.p] != close:
            one()
            if not self.got(","):
                break
        self.need(close)

    # files and items
    def file(self):
        self.attrs(inner=True) and self.item_after_attrs()
        while self.k[self.p] != "end":
            self.item()

    def item(self):
        self.attrs()
        self.item_after_attrs()

    def item_after_attrs(self, where: str = "file"):
        """One item; ``where``: file, assoc (trait and impl) or foreign."""
        k = self.k
        if where == "assoc" and self.weak("default") and k[self.p + 1] not in ("!", "::"):
            self.p += 1
        self.visibility()
        if where == "assoc" and self.weak("default") and k[self.p + 1] not in ("!", "::"):
            self.p += 1
        x = k[self.p]
        if x == "fn" or (x in ("const", "async", "unsafe", "extern") or self.weak("safe")) and self.fn_ahead():
            self.fn()
        elif x == "use":
            self.p += 1
            self.use_tree()
            self.need(";")
        elif x == "const":
            self.p += 1
            self.got("mut")
            if not self.got("_"):
                self.need("id")
            if k[self.p] == "<":
                self.generics()
            if self.got(":"):
                self.type()
            if self.got("="):
                self.expr()
            self.need(";")
        elif x == "static" or (x == "unsafe" or self.weak("safe")) and k[self.p + 1] == "static":
            if x != "static":
                self.p += 1
            self.p += 1
            self.got("mut")
            self.need("id")
            if self.got(":"):
                self.type()
            if self.got("="):
                self.expr()
            self.need(";")
        elif x == "type":
            self.p += 1
            self.need("id")
            self.generics()
            if self.got(":"):
                self.bounds()
            self.where()
            if self.got("="):
                self.type()
                self.where()
            self.need(";")
        elif x == "struct":
            self.p += 1
            self.need("id")
            self.generics()
            self.where()
            if k[self.p] == "(":
                self.p += 1
                self.commas(")", self.tuple_field)
                self.where()
                self.need(";")
            elif self.got("{"):
                self.commas("}", self.field)
            else:
                self.need(";")
        elif x == "enum":
            self.p += 1
            self.need("id")
            self.generics()
            self.where()
            self.need("{")
            self.commas("}", self.variant)
        elif x == "mod" or x == "unsafe" and k[self.p + 1] == "mod":
            self.p += 1 + (x == "unsafe")
            self.need("id")
            if not self.got(";"):
                self.need("{")
                self.attrs(inner=True) and self.item_after_attrs()
                while not self.got("}"):
                    self.item()
        elif x == "extern" or x == "unsafe" and k[self.p + 1] == "extern":
            self.got("unsafe")
            self.p += 1
            if self.got("crate"):
                if not self.got("self"):
                    self.need("id")
                if self.got("as") and not self.got("_"):
                    self.need("id")
                self.need(";")
            else:
                self.got("str")
                self.members("foreign")
        elif x == "trait" or x == "unsafe" and (k[self.p + 1] == "trait" or self.weak("auto", 1)) or self.weak("auto") and k[self.p + 1] == "trait":
            self.got("unsafe")
            if self.weak("auto"):
                self.p += 1
            self.need("trait")
            self.need("id")
            self.generics()
            if self.got(":"):
                self.bounds()
            if self.got("="):
                self.bounds()
                self.where()
                self.need(";")
            else:
                self.where()
                self.members("assoc")
        elif x == "impl" or x == "unsafe" and k[self.p + 1] == "impl":
            self.got("unsafe")
            self.p += 1
            if k[self.p] == "<" and (k[self.p + 1] in ("id", "life", "const", ">", "#", "doc")) and not (k[self.p + 1] == "id" and k[self.p + 2] in ("as", "::")):
                self.generics()
            self.got("const")
            self.got("!")
            self.type()
            if self.got("for"):
                self.type()
            self.where()
            self.members("assoc")
        elif x == "id" and self.t[self.p] == "union" and k[self.p + 1] == "id":
            self.p += 2
            self.generics()
            self.where()
            self.need("{")
            self.commas("}", self.field)
        elif x == "id" and self.t[self.p] == "macro_rules" and k[self.p + 1] == "!" and k[self.p + 2] == "id":
            self.p += 3
            brace = k[self.p] == "{"
            self.rules()
            if not brace:
                self.need(";")
        elif x == "macro" and k[self.p + 1] == "id":
            self.p += 2
            if k[self.p] == "(":
                self.tree()
            if k[self.p] != "{":
                self.fail()
            self.tree()
        elif x in _PATH_START:
            self.simple_path()
            self.need("!")
            brace = k[self.p] == "{"
            self.tree()
            if not brace:
                self.need(";")
        elif x == ";" and where != "file":
            self.fail("stray ;")
        else:
            self.fail("no item")

    def rules(self):
        """Rules of macro_rules: matcher => body, separated by semicolons."""
        k = self.k
        if k[self.p] not in _CLOSE:
            self.fail("wanted rules")
        end = self.match[self.p]
        self.p += 1
        while self.p < end:
            self.tree()
            self.need("=>")
            self.tree()
            if not self.got(";"):
                break
        if self.p != end:
            self.fail("rules")
        self.p += 1

    def members(self, where: str):
        self.need("{")
        self.attrs(inner=True) and self.item_after_attrs(where)
        while not self.got("}"):
            self.attrs()
            self.item_after_attrs(where)

    def visibility(self):
        if self.k[self.p] == "pub":
            self.p += 1
            if self.k[self.p] == "(":
                if self.k[self.p + 1] in ("crate", "self", "super") and self.k[self.p + 2] == ")":
                    self.p += 3
                elif self.k[self.p + 1] == "in":
                    self.p += 2
                    self.simple_path()
                    self.need(")")

    def simple_path(self):
        self.got("::")
        while True:
            if self.k[self.p] not in _SEGMENT:
                self.fail("path")
            self.p += 1
            if self.k[self.p] != "::":
                return
            self.p += 1

    def use_tree(self):
        k = self.k
        self.got("::")
        while True:
            if self.got("*"):
                return
            if self.got("{"):
                self.commas("}", self.use_tree)
                return
            if k[self.p] not in _SEGMENT:
                self.fail("use")
            self.p += 1
            if self.got("::"):
                continue
            if self.got("as") and not self.got("_"):
                self.need("id")
            return

    def tuple_field(self):
        self.attrs()
        self.visibility()
        self.type()

    def field(self):
        self.attrs()
        self.visibility()
        self.need("id")
        self.need(":")
        self.type()

    def variant(self):
        self.attrs()
        self.visibility()
        self.need("id")
        if self.got("("):
            self.commas(")", self.tuple_field)
        elif self.got("{"):
            self.commas("}", self.field)
        if self.got("="):
            self.expr()

    def fn_ahead(self) -> bool:
        """From qualifiers: does a function follow?"""
        k, i = self.k, self.p
        while True:
            if k[i] in ("const", "async", "unsafe") or k[i] == "id" and self.t[i] == "safe":
                i += 1
            elif k[i] == "extern":
                i += 1 + (k[i + 1] == "str")
            else:
                return k[i] == "fn"

    def fn(self):
        k = self.k
        self.got("const")
        self.got("async")
        if not self.got("unsafe") and self.weak("safe"):
            self.p += 1
        if self.got("extern"):
            self.got("str")
        self.need("fn")
        self.need("id")
        self.generics()
        self.need("(")
        self.commas(")", self.param)
        if self.got("->"):
            self.type()
        self.where()
        if k[self.p] == "{":
            self.block()
        else:
            self.need(";")

    def param(self):
        k = self.k
        self.attrs()
        if self.got("..."):
            return
        # self in its forms
        i = self.p
        if k[i] == "&":
            i += 1
            if k[i] == "life":
                i += 1
        if k[i] == "mut":
            i += 1
        if k[i] == "self" and k[i + 1] != "::":
            self.p = i + 1
            if self.got(":"):
                self.type()
            return
        self.pattern(top=False)
        self.need(":")
        if not self.got("..."):
            self.type()

    def generics(self):
        if self.k[self.p] != "<":
            return
        self.p += 1
        k = self.k
        while k[self.p] not in (">", ">=", ">>"):
            self.attrs()
            if self.got("life"):
                if self.got(":"):
                    self.lifetimes()
            elif self.got("const"):
                self.need("id")
                self.need(":")
                self.type()
                if self.got("="):
                    self.const_arg()
            else:
                self.need("id")
                if self.got(":"):
                    self.bounds()
                if self.got("="):
                    self.type()
            if not self.got(","):
                break
        self.close_angle()

    def const_arg(self):
        if self.k[self.p] == "{":
            self.block()
        elif self.got("-"):
            self.need("num")
        elif self.k[self.p] in _LITERAL or self.k[self.p] == "id":
            self.p += 1
        else:
            self.fail("const argument")

    def lifetimes(self):
        while self.got("life"):
            if not self.got("+"):
                return

    def where(self):
        k = self.k
        if not self.got("where"):
            return
        while k[self.p] not in ("{", ";", "=", "end"):
            if self.got("life"):
                self.need(":")
                self.lifetimes()
            else:
                self.for_lifetimes()
                self.type(bounds=False)
                self.need(":")
                self.bounds()
            if not self.got(","):
                return

    def for_lifetimes(self):
        if self.k[self.p] == "for" and self.k[self.p + 1] == "<":
            self.p += 1
            self.generics()

    def bounds(self):
        k = self.k
        while True:
            x = k[self.p]
            if x == "life":
                self.p += 1
            elif x == "(":
                self.p += 1
                self.bound()
                self.need(")")
            elif x in ("?", "for", "~", "const", "async", "!") or x in _PATH_START or x in ("<", "<<"):
                if x == "id" and self.t[self.p] == "use" or x == "use":
                    break
                self.bound()
            elif x == "use" and k[self.p + 1] == "<":
                self.p += 1
                self.generics()
            else:
                return
            if not self.got("+"):
                return

    def bound(self):
        self.got("?")
        self.got("!")
        if self.got("~"):
            self.need("const")
        else:
            self.got("const")
        self.got("async")
        self.for_lifetimes()
        self.got("?")
        self.type_path()

    # types
    def type(self, bounds: bool = True):
        k = self.k
        x = k[self.p]
        if x in _PATH_START or x == "<" or x == "<<":
            self.type_path()
            if k[self.p] == "!" and k[self.p + 1] in _CLOSE:
                self.p += 1
                self.tree()
            elif bounds and k[self.p] == "+":
                self.p += 1
                self.bounds()
        elif x == "&" or x == "&&":
            self.p += 1
            self.got("life")
            self.got("mut")
            self.type(bounds=False)
        elif x == "(":
            self.p += 1
            self.commas(")", self.type)
            if bounds and k[self.p] == "+":
                self.p += 1
                self.bounds()
        elif x == "[":
            self.p += 1
            self.type()
            if self.got(";"):
                self.expr()
            self.need("]")
        elif x == "*":
            self.p += 1
            if not self.got("const"):
                self.need("mut")
            self.type(bounds=False)
        elif x == "!" or x == "_":
            self.p += 1
        elif x in ("fn", "unsafe", "extern"):
            self.fn_type()
        elif x == "impl" or x == "dyn":
            self.p += 1
            at = self.p
            self.bounds() if bounds else (self.for_lifetimes(), self.one_bound())
            if self.p == at:
                self.fail("bound")
        elif x == "for":
            self.for_lifetimes()
            if k[self.p] in ("fn", "unsafe", "extern"):
                self.fn_type()
            else:
                self.type_path()
                if bounds and self.got("+"):
                    self.bounds()
        elif x in ("?", "life") and bounds:
            self.bounds()
        else:
            self.fail("no type")

    def one_bound(self):
        if self.got("life"):
            return
        if self.got("("):
            self.bound()
            self.need(")")
            return
        self.bound()

    def fn_type(self):
        self.got("unsafe")
        if self.got("extern"):
            self.got("str")
        self.need("fn")
        self.need("(")
        self.commas(")", self.fn_type_param)
        if self.got("->"):
            self.type(bounds=False)

    def fn_type_param(self):
        self.attrs()
        if self.got("..."):
            return
        if self.k[self.p] in ("id", "_") and self.k[self.p + 1] == ":":
            self.p += 2
        self.type()

    def type_path(self):
        k = self.k
        if self.open_angle():
            self.type()
            if self.got("as"):
                self.type_path()
            self.close_angle()
            self.need("::")
        else:
            self.got("::")
        while True:
            if k[self.p] not in _SEGMENT:
                self.fail("type path")
            self.p += 1
            x = k[self.p]
            if x == "::" and k[self.p + 1] in ("<", "<<", "("):
                self.p += 1
                x = k[self.p]
            if x == "<" or x == "<<":
                self.generic_args()
            elif x == "(":
                self.p += 1
                self.commas(")", self.type)
                if self.got("->"):
                    self.type(bounds=False)
            if k[self.p] != "::":
                return
            self.p += 1

    def generic_args(self):
        self.open_angle()
        k = self.k
        while k[self.p] not in (">", ">>", ">=", ">>="):
            x = k[self.p]
            if x == "life":
                self.p += 1
            elif x in _LITERAL or x == "-":
                self.got("-")
                self.p += 1
            elif x == "{":
                self.block()
            elif x == "const":
                self.p += 1
                self.block()
            else:
                self.type()
                if self.got("="):
                    if k[self.p] in _LITERAL or k[self.p] in ("{", "-"):
                        self.const_arg()
                    else:
                        self.type()
                elif self.got(":"):
                    self.bounds()
            if not self.got(","):
                break
        self.close_angle()

    # patterns
    def pattern(self, top: bool = True):
        if top:
            self.got("|")
        self.one_pattern()
        if top:
            while self.got("|"):
                self.one_pattern()

    def one_pattern(self):
        k = self.k
        x = k[self.p]
        if x == "id" and k[self.p + 1] not in ("::", "(", "{", "!", "..", "..=", "...", "<"):
            self.p += 1
            if self.got("@"):
                self.one_pattern()
        elif x == "ref" or x == "mut":
            self.got("ref")
            self.got("mut")
            if not self.got("id"):
                self.need("self")
            if self.got("@"):
                self.one_pattern()
        elif x == "_":
            self.p += 1
        elif x in _LITERAL or x == "-":
            self.got("-") and (k[self.p] == "num" or self.fail("pattern"))
            self.p += 1
            self.range_rest()
        elif x == "&" or x == "&&":
            self.p += 1
            self.got("mut") if k[self.p + 1] not in ("id",) or k[self.p] == "mut" else None
            self.one_pattern()
        elif x == "(":
            self.p += 1
            self.commas(")", self.attr_pattern)
        elif x == "[":
            self.p += 1
            self.commas("]", self.attr_pattern)
        elif x == "..":
            self.p += 1
            if self.range_end_ahead():
                self.range_end()
        elif x == "..=":
            self.p += 1
            self.range_end()
        elif x == "box":
            self.p += 1
            self.one_pattern()
        elif x == "const" and k[self.p + 1] == "{":
            self.p += 1
            self.block()
            self.range_rest()
        elif x in _PATH_START or x in ("<", "<<"):
            self.expr_path()
            x = k[self.p]
            if x == "!":
                self.p += 1
                self.tree()
            elif x == "(":
                self.p += 1
                self.commas(")", self.attr_pattern)
            elif x == "{":
                self.p += 1
                self.commas("}", self.field_pattern)
            else:
                self.range_rest()
        else:
            self.fail("no pattern")

    def attr_pattern(self):
        self.attrs()
        self.pattern()

    def field_pattern(self):
        self.attrs()
        if self.got(".."):
            if self.k[self.p] != "}":
                self.fail("rest")
            return
        if self.k[self.p] in ("id", "num") and self.k[self.p + 1] == ":":
            self.p += 2
            self.pattern()
            return
        self.got("box")
        self.got("ref")
        self.got("mut")
        self.need("id")

    def range_end_ahead(self) -> bool:
        x = self.k[self.p]
        return x in _LITERAL or x == "-" or x in _PATH_START or x == "<"

    def range_end(self):
        if self.got("-"):
            self.need("num")
        elif self.k[self.p] in _LITERAL:
            self.p += 1
        else:
            self.expr_path()

    def range_rest(self):
        if self.k[self.p] in ("..=", "..."):
            self.p += 1
            self.range_end()
        elif self.k[self.p] == "..":
            self.p += 1
            if self.range_end_ahead():
                self.range_end()

    # statements
    def block(self):
        k = self.k
        self.need("{")
        outer = self.attrs(inner=True)
        while True:
            if k[self.p] == "}" and not outer:
                self.p += 1
                return
            self.statement(outer)
            outer = False

    def statement(self, had_attrs: bool = False):
        k = self.k
        had_attrs = self.attrs() or had_attrs
        x = k[self.p]
        if x == ";":
            if had_attrs:
                self.fail("attribute of nothing")
            self.p += 1
            return
        if x == "let":
            self.p += 1
            self.pattern()
            if self.got(":"):
                self.type()
            if self.got("="):
                self.expr()
                if self.got("else"):
                    self.block()
            self.need(";")
            return
        if x in _ITEM and self.item_ahead() or x == "id" and self.t[self.p] in _WEAK and self.weak_item_ahead():
            self.item_after_attrs()
            return
        if x in _PATH_START and k[self.p + 1] == "!" and k[self.p + 2] == "{":
            self.p += 2
            self.tree()
            if k[self.p] not in (".", "?"):
                self.got(";")
                return
            self.postfix()
            self.binary_rest(1, False)
        elif x in ("if", "match", "while", "for", "loop", "{", "unsafe", "life") or x in ("async", "const") or x == "try" and k[self.p + 1] == "{":
            if self.block_like():
                if k[self.p] not in (".", "?"):
                    self.got(";")
                    return
                self.postfix()
                self.binary_rest(1, False)
            else:
                self.expr()
        else:
            self.expr()
        if not self.got(";") and k[self.p] != "}":
            self.fail("wanted ;")

    def item_ahead(self) -> bool:
        k, x = self.k, self.k[self.p]
        y = k[self.p + 1]
        if x == "const":
            return y in ("id", "_", "mut") or self.fn_ahead()
        if x == "unsafe":
            return y in ("impl", "trait", "extern", "mod", "static") or self.fn_ahead() or self.weak("auto", 1)
        if x == "async":
            return self.fn_ahead()
        if x == "static":
            return y in ("id", "mut") and not (y == "id" and k[self.p + 2] in ("|", "||"))
        return True

    def weak_item_ahead(self) -> bool:
        t, y = self.t[self.p], self.k[self.p + 1]
        if t == "union":
            return y == "id"
        if t == "macro_rules":
            return y == "!" and self.k[self.p + 2] == "id"
        if t == "auto":
            return y == "trait"
        return t == "safe" and y in ("fn", "extern", "static")

    def block_like(self) -> bool:
        """A block-like expression, if one is here."""
        k = self.k
        x = k[self.p]
        if x == "life":
            if k[self.p + 1] != ":":
                self.fail("label")
            self.p += 2
            x = k[self.p]
            if x not in ("while", "for", "loop", "{"):
                self.fail("label")
        if x == "{":
            self.block()
        elif x == "if":
            self.p += 1
            self.expr(False)
            self.block()
            while self.got("else"):
                if self.got("if"):
                    self.expr(False)
                    self.block()
                else:
                    self.block()
                    break
        elif x == "match":
            self.p += 1
            self.expr(False)
            self.need("{")
            self.attrs(inner=True)
            while not self.got("}"):
                self.attrs()
                self.pattern()
                if self.got("if"):
                    self.expr()
                self.need("=>")
                if k[self.p] == "{" and k[self.match[self.p] + 1] not in (".", "?") and k[self.match[self.p] + 1] not in _BINARY and k[self.match[self.p] + 1] not in _ASSIGN and k[self.match[self.p] + 1] != "as":
                    self.block()
                    self.got(",")
                else:
                    block = k[self.p] in ("if", "match", "while", "for", "loop", "unsafe", "{", "life")
                    at = self.p
                    if block and self.block_like() and (k[self.p] == "," or k[self.p] == "}" or not self.arm_goes_on()):
                        self.got(",")
                        continue
                    self.p = at
                    self.expr()
                    if not self.got(",") and k[self.p] != "}":
                        self.fail("wanted , after an arm")
        elif x == "while":
            self.p += 1
            self.expr(False)
            self.block()
        elif x == "for":
            if k[self.p + 1] == "<":
                return False
            self.p += 1
            self.pattern()
            self.need("in")
            self.expr(False)
            self.block()
        elif x == "loop":
            self.p += 1
            self.block()
        elif x == "unsafe" or x == "const" or x == "try":
            if k[self.p + 1] != "{":
                if x == "const" and k[self.p + 1] in ("|", "||", "move"):
                    return False
                self.fail()
            self.p += 1
            self.block()
        elif x == "async":
            at = self.p
            self.p += 1
            self.got("move")
            if k[self.p] != "{":
                self.p = at
                return False
            self.block()
        else:
            return False
        return True

    def arm_goes_on(self) -> bool:
        x = self.k[self.p]
        return x in (".", "?", "as") or x in ("+", "/", "%", "^", "==", "!=", "<=", ">=", "..", "..=", "=") or x in ("||", "&&") and False

    # expressions
    def expr(self, struct: bool = True):
        self.binary(1, struct)

    def binary(self, least: int, struct: bool):
        k = self.k
        x = k[self.p]
        if x == ".." or x == "..=":
            if least > 2:
                self.fail("range")
            self.p += 1
            y = k[self.p]
            if y not in _ENDS_EXPR and not (y == "{" and not struct):
                self.binary(3, struct)
            elif x == "..=":
                self.fail("range without end")
        else:
            self.unary(struct)
        self.binary_rest(least, struct)

    def binary_rest(self, least: int, struct: bool):
        k = self.k
        compared = False
        while True:
            x = k[self.p]
            n = _BINARY.get(x)
            if n is not None:
                if n < least:
                    return
                if n == 5:
                    if compared:
                        self.fail("chained comparison")
                    compared = True
                else:
                    compared = False
                self.p += 1
                self.binary(n + 1, struct)
            elif x == "as":
                if least > 12:
                    return
                self.p += 1
                self.type(bounds=False)
            elif x in _ASSIGN:
                if least > 1:
                    return
                self.p += 1
                self.binary(1, struct)
            elif x == ".." or x == "..=":
                if least > 2:
                    return
                self.p += 1
                y = k[self.p]
                if y not in _ENDS_EXPR and not (y == "{" and not struct):
                    self.binary(3, struct)
                elif x == "..=":
                    self.fail("range without end")
            else:
                return

    def unary(self, struct: bool):
        k = self.k
        while True:
            x = k[self.p]
            if x == "-" or x == "!" or x == "*":
                self.p += 1
            elif x == "&" or x == "&&":
                self.p += 1
                if self.weak("raw") and k[self.p + 1] in ("const", "mut") and not (k[self.p + 1] == "const" and k[self.p + 2] == "{"):
                    self.p += 2
                else:
                    self.got("mut")
            else:
                break
        self.primary(struct)
        self.postfix()

    def postfix(self):
        k = self.k
        while True:
            x = k[self.p]
            if x == ".":
                self.p += 1
                y = k[self.p]
                if y == "id":
                    self.p += 1
                    if k[self.p] == "::":
                        self.p += 1
                        if k[self.p] not in ("<", "<<"):
                            self.fail("method arguments")
                        self.generic_args()
                        if k[self.p] != "(":
                            self.fail("method call")
                elif y == "await":
                    self.p += 1
                elif y == "num" and re.fullmatch(r"[0-9]+(?:\.[0-9]*)?", self.t[self.p]):
                    self.p += 1
                else:
                    self.fail("field")
            elif x == "(":
                self.p += 1
                self.commas(")", self.argument)
            elif x == "[":
                self.p += 1
                self.expr()
                self.need("]")
            elif x == "?":
                self.p += 1
            else:
                return

    def argument(self):
        if self.k[self.p] in ("#", "doc"):
            self.attrs()
        self.binary(1, True)

    def primary(self, struct: bool):
        k = self.k
        x = k[self.p]
        if x == "id" and k[self.p + 1] not in ("::", "!", "{"):
            self.p += 1
            return
        if x in _LITERAL or x == "_":
            self.p += 1
            return
        if x in _PATH_START or x in ("<", "<<"):
            self.expr_path()
            y = k[self.p]
            if y == "!" and k[self.p + 1] in _CLOSE:
                self.p += 1
                self.tree()
            elif y == "{" and struct:
                self.struct_literal()
            return
        if x == "(":
            self.p += 1
            self.attrs(inner=True)
            self.commas(")", self.argument)
        elif x == "[":
            self.p += 1
            if self.got("]"):
                return
            self.argument()
            if self.got(";"):
                self.expr()
                self.need("]")
            elif self.got(","):
                self.commas("]", self.argument)
            else:
                self.need("]")
        elif x in ("if", "match", "while", "loop", "{", "unsafe", "life"):
            self.block_like()
        elif x in ("|", "||", "move", "static") or x in ("async", "for", "const", "try"):
            if x in ("async", "for", "const", "try") and self.block_like():
                return
            self.closure(struct)
        elif x == "return" or x == "yield" or x == "become":
            self.p += 1
            self.maybe_expr(struct)
        elif x == "break":
            self.p += 1
            self.got("life")
            self.maybe_expr(struct)
        elif x == "continue":
            self.p += 1
            self.got("life")
        elif x == "let":
            self.p += 1
            self.pattern()
            self.need("=")
            self.binary(5, False)
        elif x == "#" or x == "doc":
            self.attrs()
            self.unary(struct)
        else:
            self.fail("no expression")

    def maybe_expr(self, struct: bool):
        x = self.k[self.p]
        if x in _ENDS_EXPR or (x == "{" and not struct) or x in ("=", "?", "."):
            return
        self.binary(1, struct)

    def closure(self, struct: bool):
        k = self.k
        self.for_lifetimes()
        self.got("const")
        self.got("static")
        self.got("async")
        self.got("move")
        if not self.got("||"):
            self.need("|")
            while k[self.p] != "|":
                self.attrs()
                self.pattern(top=False)
                if self.got(":"):
                    self.type()
                if not self.got(","):
                    break
            self.need("|")
        if self.got("->"):
            self.type(bounds=False)
            self.block()
        else:
            self.binary(1, struct)

    def expr_path(self):
        k = self.k
        if self.open_angle():
            self.type()
            if self.got("as"):
                self.type_path()
            self.close_angle()
            self.need("::")
        else:
            self.got("::")
        while True:
            if k[self.p] not in _SEGMENT:
                self.fail("path")
            self.p += 1
            if k[self.p] != "::":
                return
            self.p += 1
            if k[self.p] in ("<", "<<"):
                self.generic_args()
                if k[self.p] != "::":
                    return
                self.p += 1

    def struct_literal(self):
        k = self.k
        self.need("{")
        while k[self.p] != "}":
            self.attrs()
            if self.got(".."):
                if k[self.p] != "}":
                    self.expr()
                break
            if k[self.p] == "num" and k[self.p + 1] == ":":
                self.p += 2
                self.expr()
            else:
                self.need("id")
                if self.got(":"):
                    self.expr()
            if not self.got(","):
                break
        self.need("}")


#: Calls that may be open at once: some per level of nesting, of which a text has fewer than characters.
CALLS_A_LEVEL, MOST_CALLS = 12, 2_000_000


def deep_enough(levels: int) -> None:
    """Let a parser go as deep as a text of so many tokens or characters may be nested."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), min(MOST_CALLS, 2000 + CALLS_A_LEVEL * levels)))


def examine(text: str) -> tuple[bool, str | None]:
    """(whether there is any code, what keeps the text from being a Rust 2021 source file).

    Texts without a token other than comments have no code and no error.
    """
    try:
        kinds, toks = tokens(text)
        if all(x in ("doc", "idoc") for x in kinds):
            return False, None
        deep_enough(len(toks))
        Parser(kinds, toks).file()
    except Malformed as e:
        return True, str(e)[:120]
    except RecursionError:
        return True, "nested too deeply"
    return True, None


def error_in(text: str) -> str | None:
    return examine(text)[1]
