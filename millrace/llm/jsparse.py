"""A recursive-descent parser for JavaScript source files (2022 edition, scripts and modules)."""

from __future__ import annotations

import re

from millrace.llm.rustparse import Malformed

_LEX = re.compile(
    r"(?://[^\n]*|/\*.*?\*/|\s)*("
    r'"(?:[^"\\\n]|\\.|\\\r?\n)*"|\'(?:[^\'\\\n]|\\.|\\\r?\n)*\''
    r"|(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?)n?(?![\w$])"
    r"|#?(?:[^\W\d]|\$)(?:\w|\$)*"
    r"|>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|\*\*|\?\?|\?\.(?![0-9])|\+\+|--|&&|\|\||[-+*/%&|^=!<>]=|<<|>>|[-+*/%&|^=!<>?:;,.(){}\[\]~@`]"
    r"|\S)?",
    re.S,
)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*")
#: Reserved words and operators of the language.
_WORDS = frozenset("break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split())
#: Words that another name may follow, or that may follow one, on a line.
_LEADING = _WORDS | frozenset("async await yield let of get set static from as".split())
_BEFORE_VALUE = frozenset("return typeof case do else in instanceof new void delete throw yield await of".split())
_BINARY = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "in": 8, "instanceof": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
_ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
_TEMPLATE, _PATTERN = "`", "/"


def tokens(text: str, at: int = 0, inner: bool = False) -> tuple[list[str], list[bool], int]:
    """(texts, whether a line end stands before, place behind); templates and patterns are one token."""
    out: list[str] = []
    breaks: list[bool] = []
    depth = 0
    if not at and text.startswith("#!"):
        at = (text + "\n").find("\n")
    while True:
        m = _LEX.match(text, at)
        x = m[1]
        if x is None:
            if m.end() < len(text) and not inner:
                raise Malformed("no token at " + text[m.end() : m.end() + 8])
            if inner:
                raise Malformed("unterminated template")
            return out, breaks, m.end()
        gap = text[at : m.start(1)]
        at = m.end()
        last = out[-1] if out else ""
        if x in ("/", "/=") and (not last or last in _BEFORE_VALUE or not (last[-1].isalnum() or last[-1] in "_$)]\"'`/" or last in ("++", "--"))):
            if last != _PATTERN:
                r = _REGEX.match(text, m.start(1))
                if not r:
                    raise Malformed("unterminated pattern")
                x, at = _PATTERN + "re", r.end()
        elif x == "`":
            at = template(text, at)
        elif x in ('"', "'", "\\", "@") or x == "#" or len(x) == 1 and not (x.isalnum() or x in "_$" or x in "-+*/%&|^=!<>?:;,.(){}[]~"):
            raise Malformed("no token at " + x)
        elif x == "{":
            depth += 1
        elif x == "}":
            if inner and not depth:
                return out, breaks, at
            depth -= 1
        broken = "\n" in gap
        if not broken and last and (last[0].isalpha() or last[0] in "_$") and last not in _LEADING and (x[0].isalpha() or x[0] in "_$") and x not in _WORDS and x not in _LEADING:
            raise Malformed(f"unexpected {last} {x}")
        out.append(x)
        breaks.append(broken)


def template(text: str, at: int) -> int:
    """Place behind the template whose inside begins at ``at``."""
    while at < len(text):
        c = text[at]
        if c == "\\":
            at += 2
        elif c == "`":
            return at + 1
        elif c == "$" and text[at + 1 : at + 2] == "{":
            toks, breaks, at = tokens(text, at + 2, True)
            p = JsParser(toks, breaks)
            p.expr()
            if p.p < p.n:
                p.fail()
        else:
            at += 1
    raise Malformed("unterminated template")


class JsParser:
    """Walks over the tokens of one file; raises Malformed at the first error."""

    def __init__(self, toks: list[str], breaks: list[bool]):
        self.n = len(toks)
        self.t = [*toks, "", "", "", ""]
        self.line = [*breaks, True, True, True, True]
        self.p = 0
        self.no_in = False
        self.match: dict[int, int] = {}
        pairs, stack = {"(": ")", "[": "]", "{": "}"}, []
        for i, x in enumerate(toks):
            if x in pairs:
                stack.append(i)
            elif x in (")", "]", "}"):
                if not stack or pairs[toks[stack[-1]]] != x:
                    raise Malformed("stray " + x)
                self.match[stack.pop()] = i
        if stack:
            raise Malformed("unclosed " + toks[stack[-1]])

    def fail(self):
        raise Malformed("unexpected " + " ".join(self.t[self.p : self.p + 4]))

    def got(self, x: str) -> bool:
        if self.t[self.p] == x:
            self.p += 1
            return True
        return False

    def need(self, x: str):
        if not self.got(x):
            self.fail()

    def is_word(self, at: int = 0) -> bool:
        x = self.t[self.p + at]
        return bool(x) and (x[0].isalpha() or x[0] in "_$") or len(x) > 1 and x[0] == "#"

    def is_name(self, at: int = 0) -> bool:
        return self.is_word(at) and self.t[self.p + at] not in _WORDS and self.t[self.p + at][0] != "#"

    def name(self):
        if not self.is_name():
            self.fail()
        self.p += 1

    def end(self):
        if not self.got(";") and self.t[self.p] != "}" and not self.line[self.p]:
            self.fail()

    def file(self):
        if not self.n:
            self.fail()
        while self.p < self.n:
            self.statement()

    def block(self):
        self.need("{")
        while not self.got("}"):
            self.statement()

    def body(self):
        saved, self.no_in = self.no_in, False
        self.block()
        self.no_in = saved

    # statements

    def statement(self):
        x = self.t[self.p]
        if x == "{":
            self.block()
        elif x == ";":
            self.p += 1
        elif x in ("if", "while", "with"):
            self.p += 1
            self.head()
            self.statement()
            if x == "if" and self.got("else"):
                self.statement()
        elif x == "for":
            self.loop()
        elif x == "do":
            self.p += 1
            self.statement()
            self.need("while")
            self.head()
            self.got(";")
        elif x == "switch":
            self.p += 1
            self.head()
            self.need("{")
            while not self.got("}"):
                if self.got("case"):
                    self.expr()
                else:
                    self.need("default")
                self.need(":")
                while self.t[self.p] not in ("case", "default", "}"):
                    self.statement()
        elif x == "try":
            self.p += 1
            self.block()
            caught = self.got("catch")
            if caught:
                if self.got("("):
                    self.pattern()
                    self.need(")")
                self.block()
            if self.got("finally"):
                self.block()
            elif not caught:
                self.fail()
        elif x in ("return", "throw"):
            self.p += 1
            if self.t[self.p] not in (";", "}", "") and not self.line[self.p]:
                self.expr()
            elif x == "throw":
                self.fail()
            self.end()
        elif x in ("break", "continue"):
            self.p += 1
            if self.is_name() and not self.line[self.p]:
                self.p += 1
            self.end()
        elif x == "debugger":
            self.p += 1
            self.end()
        elif x in ("var", "const") or x == "let" and (self.is_name(1) or self.t[self.p + 1] in ("[", "{")):
            self.variables(x == "const")
            self.end()
        elif x == "function" or x == "async" and self.t[self.p + 1] == "function" and not self.line[self.p + 1]:
            self.function(True)
        elif x == "class":
            self.class_(True)
        elif x == "import" and self.t[self.p + 1] not in ("(", "."):
            self.import_()
        elif x == "export":
            self.export()
        elif self.is_name() and self.t[self.p + 1] == ":":
            self.p += 2
            self.statement()
        else:
            self.expr()
            self.end()

    def head(self):
        self.need("(")
        self.expr()
        self.need(")")

    def variables(self, valued: bool = False):
        self.p += 1
        while True:
            open_pattern = self.t[self.p] in ("[", "{")
            self.pattern()
            if self.got("="):
                self.assignment()
            elif (valued or open_pattern) and not self.no_in:
                self.fail()
            if not self.got(","):
                return

    def loop(self):
        self.need("for")
        self.got("await")
        self.need("(")
        if not self.got(";"):
            self.no_in = True
            x = self.t[self.p]
            if x in ("var", "const") or x == "let" and (self.is_name(1) or self.t[self.p + 1] in ("[", "{")):
                self.variables()
            else:
                self.expr()
            self.no_in = False
            if self.t[self.p] in ("of", "in"):
                self.p += 1
                self.expr()
                self.need(")")
                return self.statement()
            self.need(";")
        if self.t[self.p] != ";":
            self.expr()
        self.need(";")
        if self.t[self.p] != ")":
            self.expr()
        self.need(")")
        self.statement()

    def source(self):
        if self.t[self.p][:1] not in ("'", '"') or not self.t[self.p]:
            self.fail()
        self.p += 1
        if self.t[self.p] in ("with", "assert") and self.t[self.p + 1] == "{":
            self.p += 1
            self.object()

    def specifiers(self):
        self.need("{")
        while self.t[self.p] != "}":
            if not self.is_word() and self.t[self.p][:1] not in ("'", '"'):
                self.fail()
            self.p += 1
            if self.got("as"):
                self.p += 1
            if not self.got(","):
                break
        self.need("}")

    def import_(self):
        self.p += 1
        if self.t[self.p][:1] not in ("'", '"'):
            if self.is_name():
                self.p += 1
                if not self.got(",") and self.t[self.p] != "from":
                    self.fail()
            if self.got("*"):
                self.need("as")
                self.name()
            elif self.t[self.p] == "{":
                self.specifiers()
            self.need("from")
        self.source()
        self.end()

    def export(self):
        self.p += 1
        x = self.t[self.p]
        if self.got("default"):
            if self.t[self.p] in ("function", "class") or self.t[self.p] == "async" and self.t[self.p + 1] == "function":
                self.class_(False) if self.t[self.p] == "class" else self.function(False)
            else:
                self.assignment()
                self.end()
        elif self.got("*"):
            if self.got("as"):
                self.p += 1
            self.need("from")
            self.source()
            self.end()
        elif x == "{":
            self.specifiers()
            if self.got("from"):
                self.source()
            self.end()
        elif x in ("var", "let", "const", "function", "class", "async"):
            self.statement()
        else:
            self.fail()

    def pattern(self):
        """A name, or an array or object of patterns."""
        if self.got("["):
            while self.t[self.p] != "]":
                if not self.got(","):
                    self.got("...")
                    self.with_default()
                    if self.t[self.p] != "]":
                        self.need(",")
            self.need("]")
        elif self.got("{"):
            while self.t[self.p] != "}":
                if self.got("..."):
                    self.name()
                else:
                    shorthand = self.is_name()
                    self.property_name()
                    if self.got(":"):
                        self.with_default()
                    elif not shorthand:
                        self.fail()
                    elif self.got("="):
                        self.assignment()
                if not self.got(","):
                    break
            self.need("}")
        else:
            self.name()

    def with_default(self):
        self.pattern()
        if self.got("="):
            self.assignment()

    def property_name(self):
        x = self.t[self.p]
        if self.got("["):
            saved, self.no_in = self.no_in, False
            self.assignment()
            self.no_in = saved
            self.need("]")
        elif self.is_word() or x[:1].isdigit() or x[:1] in ("'", '"', ".") and len(x) > 1:
            self.p += 1
        else:
            self.fail()

    def parameters(self):
        self.need("(")
        saved, self.no_in = self.no_in, False
        while self.t[self.p] != ")":
            self.got("...")
            self.with_default()
            if not self.got(","):
                break
        self.no_in = saved
        self.need(")")

    def function(self, named: bool):
        self.got("async")
        self.need("function")
        self.got("*")
        if self.is_name():
            self.p += 1
        elif named:
            self.fail()
        self.parameters()
        self.body()

    def class_(self, named: bool):
        self.need("class")
        if self.is_name():
            self.p += 1
        elif named:
            self.fail()
        if self.got("extends"):
            self.unary()
        self.need("{")
        while not self.got("}"):
            if self.got(";"):
                continue
            if self.got("static") and self.t[self.p] == "{":
                self.body()
                continue
            if self.t[self.p] in ("(", "=", ";", "}"):  # a member of the name static
                self.p -= 1
            while self.t[self.p] in ("get", "set", "async", "*") and self.t[self.p + 1] not in ("(", "=", ";", "}"):
                self.p += 1
            self.property_name()
            if self.t[self.p] == "(":
                self.parameters()
                self.body()
            else:
                if self.got("="):
                    self.assignment()
                self.end()

    # expressions

    def expr(self):
        self.assignment()
        while self.got(","):
            self.assignment()

    def arrow_ahead(self) -> bool:
        at = self.p + (self.t[self.p] == "async" and self.t[self.p + 1] not in ("=>", ")", ",", "=", ".", ";") and not self.line[self.p + 1])
        x = self.t[at]
        after = self.match[at] + 1 if x == "(" else at + 1 if x and (x[0].isalpha() or x[0] in "_$") and x not in _WORDS else None
        return after is not None and self.t[after] == "=>" and not self.line[after]

    def assignment(self):
        x = self.t[self.p]
        if self.arrow_ahead():
            if x == "async" and self.t[self.p + 1] != "=>":
                self.p += 1
            if self.t[self.p] == "(":
                self.parameters()
            else:
                self.name()
            self.need("=>")
            return self.body() if self.t[self.p] == "{" else self.assignment()
        if x == "yield":
            self.p += 1
            if self.got("*") or not self.line[self.p] and self.t[self.p] not in (")", "]", "}", ",", ";", ":", ""):
                self.assignment()
            return
        self.binary(1)
        if self.got("?"):
            saved, self.no_in = self.no_in, False
            self.assignment()
            self.no_in = saved
            self.need(":")
            self.assignment()
        elif self.t[self.p] in _ASSIGN:
            if self.t[self.p - 1] not in (")", "]", "}") and not self.is_word(-1):
                self.fail()
            self.p += 1
            self.assignment()

    def binary(self, least: int):
        if len(self.t[self.p]) > 1 and self.t[self.p][0] == "#" and self.t[self.p + 1] == "in":
            self.p += 2
        self.unary()
        while True:
            x = self.t[self.p]
            n = _BINARY.get(x)
            if n is None or n < least or x == "in" and self.no_in:
                return
            self.p += 1
            self.binary(n + (x != "**"))

    def unary(self):
        while self.t[self.p] in ("delete", "void", "typeof", "+", "-", "~", "!", "++", "--") or self.t[self.p] == "await" and (self.is_word(1) or self.t[self.p + 1][:1] in ("(", "[", "`", "{", "'", '"')) and not self.line[self.p + 1]:
            self.p += 1
        self.member()
        if self.t[self.p] in ("++", "--") and not self.line[self.p]:
            self.p += 1

    def arguments(self):
        self.need("(")
        saved, self.no_in = self.no_in, False
        while self.t[self.p] != ")":
            self.got("...")
            self.assignment()
            if not self.got(","):
                break
        self.no_in = saved
        self.need(")")

    def member(self):
        news = 0
        while self.t[self.p] == "new":
            self.p += 1
            if self.got("."):
                self.need("target")
                break
            news += 1
        else:
            self.primary()
        while True:
            x = self.t[self.p]
            if x == "(":
                self.arguments()
            elif x == "[":
                self.p += 1
                saved, self.no_in = self.no_in, False
                self.expr()
                self.no_in = saved
                self.need("]")
            elif x == "." or x == "?.":
                self.p += 1
                if x == "?." and self.t[self.p] in ("(", "["):
                    continue
                if not self.is_word():
                    self.fail()
                self.p += 1
            elif x == "`":
                self.p += 1
            else:
                return

    def primary(self):
        x = self.t[self.p]
        if not x:
            self.fail()
        if x == "function" or x == "async" and self.t[self.p + 1] == "function" and not self.line[self.p + 1]:
            self.function(False)
        elif x == "class":
            self.class_(False)
        elif x == "(":
            self.p += 1
            saved, self.no_in = self.no_in, False
            self.expr()
            self.no_in = saved
            self.need(")")
        elif x == "[":
            self.p += 1
            saved, self.no_in = self.no_in, False
            while self.t[self.p] != "]":
                if not self.got(","):
                    self.got("...")
                    self.assignment()
                    if self.t[self.p] != "]":
                        self.need(",")
            self.no_in = saved
            self.need("]")
        elif x == "{":
            self.object()
        elif x == "import" and self.t[self.p + 1] in ("(", "."):
            self.p += 1
        elif x == "super" and self.t[self.p + 1] in ("(", ".", "["):
            self.p += 1
        elif x in ("this", "null", "true", "false") or self.is_name() or x[0].isdigit() or x in ("`", _PATTERN + "re") or x[0] in "\"'" or x[0] == "." and x[1:2].isdigit():
            self.p += 1
        else:
            self.fail()

    def object(self):
        self.need("{")
        saved, self.no_in = self.no_in, False
        while self.t[self.p] != "}":
            if self.got("..."):
                self.assignment()
            else:
                while self.t[self.p] in ("get", "set", "async", "*") and self.t[self.p + 1] not in ("(", ":", ",", "}", "="):
                    self.p += 1
                shorthand = self.is_name()
                self.property_name()
                if self.t[self.p] == "(":
                    self.parameters()
                    self.body()
                elif self.got(":"):
                    self.assignment()
                elif not shorthand:
                    self.fail()
                elif self.got("="):  # default of a destructured name
                    self.assignment()
            if not self.got(","):
                break
        self.no_in = saved
        self.need("}")


def parse(text: str) -> None:
    toks, breaks, _ = tokens(text)
    JsParser(toks, breaks).file()
