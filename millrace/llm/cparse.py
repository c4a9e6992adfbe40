"""A recursive-descent parser for C and C++ source files.

It knows no names: a text is well-formed if some reading of its identifiers as types or
values makes it one.  Where a piece may be a declaration or an expression, both are
tried.  Of conditional branches of the preprocessor the first one that is not ``#if 0``
is read; directives must be known and nested properly.
"""

from __future__ import annotations

import re
from functools import lru_cache

from millrace.llm.rustparse import Malformed

_DIRECTIVE = re.compile(r"(?m)^[ \t]*#(?:[^\n\\]|\\.|\\\r?\n)*")
#: Directives of the preprocessor.
_DIRECTIVES = frozenset("include include_next import define undef if ifdef ifndef elif elifdef elifndef else endif error warning pragma line ident".split())
_COMMENT = re.compile(r'//(?:[^\n\\]|\\.|\\\r?\n)*|/\*.*?\*/|(?:u8|[uUL])?R"([^()\\\s]{0,16})\(.*?\)\1"|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|/\*', re.S)
_LEX = re.compile(
    r"\s*("
    r'(?:u8|[uUL])?R"([^()\\\s]{0,16})\(.*?\)\2"|(?:u8|[uUL])?"(?:[^"\\\n]|\\.)*"|(?:u8|[uUL])?\'(?:[^\'\\\n]|\\.)+\''
    r"|(?:0[xX](?:[0-9a-fA-F']+\.?[0-9a-fA-F]*|\.[0-9a-fA-F]+)(?:[pP][+-]?[0-9]+)?|0[bB][01']+|(?:[0-9][0-9']*\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)(?:[A-Za-z_]\w*)?(?!\w)"
    r"|[A-Za-z_$]\w*"
    r"|\.\.\.|<=>|->\*|<<=|\.\*|->|\+\+|--|&&|\|\||::|##|<<|[-+*/%&|^=!<>]=|[-+*/%&|^=!<>?:;,.(){}\[\]~#@]"
    r"|\S)",
    re.S,
)
#: The keywords of the languages, by what they do.
_QUALIFIERS = frozenset("const volatile restrict __restrict __restrict__ _Atomic static extern register inline __inline __inline__ _Noreturn _Thread_local __thread typedef __extension__ signed unsigned __signed__ __volatile__ __const".split())
_CPP_QUALIFIERS = frozenset("constexpr consteval constinit mutable virtual explicit friend typename thread_local".split())
_BUILTIN = frozenset("void char short int long float double signed unsigned _Bool bool _Complex __int128 wchar_t char16_t char32_t".split())
_STATEMENT = frozenset("if else while for do switch case default return break continue goto".split())
_C_KEYWORDS = _STATEMENT | (_QUALIFIERS - {"__extension__"}) | (_BUILTIN - {"bool", "wchar_t", "char16_t", "char32_t"}) | frozenset("struct union enum sizeof".split())
_CPP_KEYWORDS = (
    _C_KEYWORDS - {"restrict"} | _CPP_QUALIFIERS | frozenset("bool wchar_t class namespace template public private protected using new delete try catch throw operator auto decltype static_assert noexcept requires concept co_await co_return co_yield".split())
)
_CASTS = frozenset("static_cast dynamic_cast reinterpret_cast const_cast".split())
#: Words of other languages that no source file uses for a type.
_NO_TYPES = frozenset("fn let impl pub function var def".split())
_ATTRIBUTES = frozenset("__attribute__ __attribute __declspec alignas _Alignas".split())
_ASM = frozenset("asm __asm__ __asm".split())
_BINARY = {"*": 12, "/": 12, "%": 12, "+": 11, "-": 11, "<<": 10, ">>": 10, "<=>": 9, "<": 8, ">": 8, "<=": 8, ">=": 8, "==": 7, "!=": 7, "&": 6, "^": 5, "|": 4, "&&": 3, "||": 2, ".*": 13, "->*": 13}
_ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>=".split())
_OPERATORS = frozenset("+ - * / % ^ & | ~ ! = < > += -= *= /= %= ^= &= |= << <<= == != <= >= <=> && || ++ -- , ->* ->".split())


def preprocessed(text: str) -> str:
    """The text without comments and directives, one branch of each condition."""
    text = _COMMENT.sub(lambda m: m[0] if m[0][0] != "/" else " " if len(m[0]) > 2 else "\0", text)
    if "\0" in text:
        raise Malformed("unterminated comment")
    out, pos = [], 0
    open_ifs: list[list[bool]] = []  # [this branch is read, a branch was read, else was seen]
    for m in _DIRECTIVE.finditer(text):
        if all(o[0] for o in open_ifs):
            out.append(text[pos : m.start()])
        pos = m.end()
        word = re.match(r"[ \t]*#[ \t]*(\w*)[ \t]*(.*)", m[0], re.S)
        name, rest = word[1], word[2].strip()
        if name in ("if", "ifdef", "ifndef"):
            if not rest:
                raise Malformed(f"#{name} without condition")
            on = not (name == "if" and rest in ("0", "false"))
            open_ifs.append([on, on, False])
        elif name.startswith("el"):
            if not open_ifs or open_ifs[-1][2] or name not in _DIRECTIVES:
                raise Malformed(f"stray #{name}")
            o = open_ifs[-1]
            o[0], o[1], o[2] = not o[1], True, name == "else"
        elif name == "endif":
            if not open_ifs:
                raise Malformed("stray #endif")
            open_ifs.pop()
        elif name and name not in _DIRECTIVES and not name.isdigit():
            raise Malformed(f"no directive #{name}")
    if open_ifs:
        raise Malformed("unterminated #if")
    out.append(text[pos:])
    return "\n".join(out)


@lru_cache(maxsize=2)
def _lexed(text: str) -> tuple[list[str], list[int], str | None]:
    """(texts, places behind them, error)."""
    t, close, last = [], [], ""
    try:
        for m in _LEX.finditer(preprocessed(text)):
            x = m[1]
            if x in ('"', "'", "\\", "`", "@", "#"):
                return [], [], "no token at " + x
            if last in _NO_TYPES and (x[0].isalpha() or x[0] == "_"):
                return [], [], f"no type {last}"
            t.append(x)
            close.append(m.end())
            last = x
    except Malformed as e:
        return [], [], str(e)
    return t + [""] * 4, close + [-1] * 4, None


def tokens(text: str) -> tuple[list[str], list[int]]:
    """(texts, places behind them) with four empty tokens at the end; C and C++ share them."""
    t, close, error = _lexed(text)
    if error:
        raise Malformed(error)
    return t, close


class CParser:
    """Walks over the tokens of one file; raises Malformed at the first error."""

    def __init__(self, text: str, cpp: bool):
        self.cpp = cpp
        self.words = _CPP_KEYWORDS if cpp else _C_KEYWORDS
        self.qualifiers = _QUALIFIERS | _CPP_QUALIFIERS if cpp else _QUALIFIERS
        self.t, self.close = tokens(text)
        self.n = len(self.t) - 4
        self.p = 0
        self.no_gt = 0
        self.done: dict[int, int] = {}  # blocks that were read: place of { -> place behind }

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

    def is_name(self, at: int = 0) -> bool:
        x = self.t[self.p + at]
        return bool(x) and (x[0].isalpha() or x[0] in "_$") and x not in self.words and x[-1] not in "\"'"

    def is_string(self, at: int = 0) -> bool:
        return self.t[self.p + at][-1:] == '"'

    def tried(self, what, *args) -> bool:
        """Reads ``what`` if it is there."""
        start, gt = self.p, self.no_gt
        try:
            what(*args)
            return True
        except Malformed:
            self.p, self.no_gt = start, gt
            return False

    def group(self):
        """A balanced group whose inside is not read."""
        pairs, stack = {"(": ")", "[": "]", "{": "}"}, []
        while True:
            x = self.t[self.p]
            if not x:
                self.fail()
            if x in pairs:
                stack.append(pairs[x])
            elif x in ")]}":
                if not stack or stack.pop() != x:
                    self.fail()
            self.p += 1
            if not stack:
                return

    def file(self):
        if not self.n:
            self.fail()
        while self.p < self.n:
            self.external("file")

    # declarations

    def attributes(self):
        while True:
            if self.t[self.p] in _ATTRIBUTES and self.t[self.p + 1] == "(":
                self.p += 1
                self.group()
            elif self.t[self.p] == "[" and self.t[self.p + 1] == "[":
                self.group()
            else:
                return

    def external(self, where: str):
        x = self.t[self.p]
        if x == ";":
            self.p += 1
        elif x in _ASM:
            self.statement()
        elif x in ("static_assert", "_Static_assert") and self.t[self.p + 1] == "(":
            self.p += 1
            self.group()
            self.need(";")
        elif x == "extern" and self.is_string(1):
            self.p += 2
            if self.got("{"):
                while not self.got("}"):
                    self.external("file")
            else:
                self.external("file")
        elif self.cpp and self.cpp_external(x, where):
            return
        else:
            self.declaration(where)

    def cpp_external(self, x: str, where: str) -> bool:
        if x in ("namespace", "inline") and (x == "namespace" or self.t[self.p + 1] == "namespace"):
            self.p += 1 if x == "namespace" else 2
            self.attributes()
            if self.is_name():
                self.p += 1
                while self.got("::"):
                    self.got("inline")
                    if not self.is_name():
                        self.fail()
                    self.p += 1
            if self.got("="):
                self.qualified()
                self.need(";")
                return True
            self.need("{")
            while not self.got("}"):
                if not self.t[self.p]:
                    self.fail()
                self.external("file")
        elif x == "template":
            self.p += 1
            if self.t[self.p] != "<":
                self.declaration(where)
                return True
            self.template_parameters()
            if self.got("requires"):
                self.binary(2)
            if self.got("concept"):
                self.p += self.is_name()
                self.need("=")
                self.expr()
                self.need(";")
            else:
                self.external(where)
        elif x == "using":
            self.p += 1
            if self.got("namespace"):
                self.qualified()
            else:
                self.got("typename")
                self.qualified()
                self.attributes()
                if self.got("="):
                    self.type_name()
                while self.got(","):
                    self.qualified()
            self.need(";")
        elif x in ("public", "private", "protected") and where == "class":
            self.p += 1
            if self.is_name():
                self.p += 1  # slots and signals of a framework
            self.need(":")
        else:
            return False
        return True

    def template_parameters(self):
        self.need("<")
        while self.t[self.p] != ">":
            if self.t[self.p] in ("typename", "class") and (self.is_name(1) or self.t[self.p + 1] in (">", ",", "=", "...")) and self.t[self.p + 2] != "::":
                self.p += 1
                self.got("...")
                self.p += self.is_name()
                if self.got("="):
                    self.template_argument()
            elif self.t[self.p] == "template":
                self.p += 1
                self.template_parameters()
                self.p += 1  # class or typename
                self.p += self.is_name()
            else:
                self.specifiers("parameter")
                self.got("...")
                self.declarator(True)
                if self.got("="):
                    self.template_argument()
            if not self.got(","):
                break
        self.need(">")

    def template_argument(self):
        self.no_gt += 1
        start = self.p
        if not (self.tried(self.type_name) and self.t[self.p] in (",", ">", "...")):
            self.p = start
            self.binary(2)
        self.got("...")
        self.no_gt -= 1

    def template_arguments(self):
        self.need("<")
        gt, self.no_gt = self.no_gt, 0
        if self.t[self.p] != ">":
            self.template_argument()
            while self.got(","):
                self.template_argument()
        self.no_gt = gt
        self.need(">")

    def qualified(self, type_only: bool = False):
        """A name with its scopes and template arguments."""
        self.got("::")
        while True:
            self.got("template")
            if not type_only and self.t[self.p] == "operator":
                return self.operator_name()
            if self.got("~"):
                if not self.is_name():
                    self.fail()
                self.p += 1
                return
            if not self.is_name():
                self.fail()
            self.p += 1
            if self.cpp and self.t[self.p] == "<":
                self.tried(self.arguments_of_name, type_only)
            if not self.cpp or self.t[self.p] != "::" or self.t[self.p + 1] == "*":
                return
            self.p += 1

    def arguments_of_name(self, type_only: bool):
        self.template_arguments()
        x = self.t[self.p]
        # a name or number behind > means that < was a comparison
        if not type_only and x and (x[0].isdigit() or x[0] == '"' or self.is_name() and self.t[self.p - 2] not in (">", "*", "&") and not self.is_name(-2) and self.t[self.p - 2] not in _BUILTIN):
            self.fail()

    def operator_name(self):
        self.need("operator")
        x = self.t[self.p]
        if x in ("(", "[") and self.t[self.p + 1] == (")" if x == "(" else "]"):
            self.p += 2
        elif x in ("new", "delete", "co_await"):
            self.p += 1
            if self.t[self.p] == "[":
                self.p += 2
        elif x == ">":
            self.p += 1
            while self.t[self.p] in (">", ">="):
                self.p += 1
        elif x in _OPERATORS:
            self.p += 1
        elif x.startswith('""'):
            self.p += 1
            self.p += self.is_name()
        elif self.specifiers("parameter"):
            while self.t[self.p] in ("*", "&", "&&", "const"):
                self.p += 1
        else:
            self.fail()

    def specifiers(self, where: str) -> bool:
        """Words of a type; true if there is one."""
        typed = named = False
        start = self.p
        while True:
            self.attributes()
            x = self.t[self.p]
            if x in _BUILTIN and not (x in ("wchar_t", "char16_t", "char32_t", "bool") and typed):
                typed = True
                self.p += 1
            elif x in self.qualifiers:
                self.p += 1
                if x in ("explicit", "_Atomic") and self.t[self.p] == "(":
                    self.group()
                    typed |= x == "_Atomic"
            elif x in ("struct", "union", "enum") or x == "class" and self.cpp:
                if typed:
                    self.fail()
                self.enum() if x == "enum" else self.record()
                typed = True
            elif x in ("typeof", "__typeof__", "decltype", "__typeof") and self.t[self.p + 1] == "(" and not typed:
                self.p += 1
                self.group()
                typed = True
            elif x == "auto" and not typed:
                self.p += 1
                typed = True
            elif not typed and (self.is_name() or x == "::" and self.cpp):
                if x in _NO_TYPES:
                    self.fail()
                if x.isupper() and (self.is_name(1) and (self.is_name(2) or self.t[self.p + 2] in ("*", "&")) or self.t[self.p + 1] in _BUILTIN or self.t[self.p + 1] in self.qualifiers or self.t[self.p + 1] in ("struct", "enum", "union")):
                    self.p += 1  # a macro before the type
                    continue
                if where in ("class", "file") and self.t[self.p + 1] == "(" and not (self.t[self.p + 2] == "*" and not self.cpp):
                    break  # a constructor, or a function without type
                if self.cpp and where in ("class", "file"):
                    at = self.p
                    if self.tried(self.qualified) and (self.t[self.p] == "(" and "::" in self.t[at : self.p] or self.t[self.p - 2] == "~" or "operator" in self.t[at : self.p]):
                        self.p = at
                        break
                    self.p = at
                if self.t[self.p + 1] == ":" and where == "block":
                    break
                self.qualified(True)
                typed = named = True
            elif named and x in _BUILTIN:
                self.p += 1
            else:
                break
        return self.p > start

    def record(self):
        self.p += 1
        self.attributes()
        if self.is_name() and self.is_name(1) and self.t[self.p + 2] in ("{", ":", "final"):
            self.p += self.t[self.p + 1] != "final"  # an export macro
        if self.is_name():
            self.qualified(True)
        elif self.t[self.p] != "{":
            self.fail()
        self.got("final")
        if self.cpp and self.t[self.p] == ":" and self.t[self.p + 1] != ":":
            self.p += 1
            while True:
                while self.t[self.p] in ("public", "private", "protected", "virtual"):
                    self.p += 1
                self.qualified(True)
                self.got("...")
                if not self.got(","):
                    break
            if self.t[self.p] != "{":
                self.fail()
        if self.t[self.p] == "{":
            self.once(self.members)
        self.attributes()

    def members(self):
        self.need("{")
        while not self.got("}"):
            if not self.t[self.p]:
                self.fail()
            self.external("class")

    def once(self, read):
        """Reads what begins at {, but only once for each place."""
        start = self.p
        if start in self.done:
            self.p = self.done[start]
            return
        gt, self.no_gt = self.no_gt, 0
        read()
        self.no_gt = gt
        self.done[start] = self.p

    def enum(self):
        self.p += 1
        if self.cpp and self.t[self.p] in ("class", "struct"):
            self.p += 1
        self.attributes()
        named = self.is_name()
        if named:
            self.qualified(True)
        if self.t[self.p] == ":" and (self.cpp or self.t[self.p + 1] in _BUILTIN):
            self.p += 1
            self.specifiers("parameter")
        if self.got("{"):
            while not self.got("}"):
                if not self.is_name():
                    self.fail()
                self.p += 1
                self.attributes()
                if self.got("="):
                    self.binary(2)
                if not self.got(","):
                    self.need("}")
                    break
        elif not named:
            self.fail()

    def declaration(self, where: str):
        typed = self.specifiers(where)
        if self.got(";"):
            if not typed:
                self.fail()
            return
        first = True
        while True:
            if where == "class" and self.t[self.p] == ":":
                function = False  # a bit field without name
            else:
                function = self.declarator(False, typed)
            if not typed and not function:
                self.fail()
            self.attributes()
            if self.t[self.p] in _ASM:
                self.p += 1
                self.group()
                self.attributes()
            while function and self.is_name() and self.t[self.p].isupper():
                self.p += 1  # a macro behind a function
                if self.t[self.p] == "(":
                    self.group()
            if function and first and where != "block":
                if not self.cpp and self.t[self.p] not in ("{", ";", ",", "=", ""):
                    while self.t[self.p] != "{":
                        self.declaration("block")
                if self.cpp and self.t[self.p] == "try":
                    self.p += 1
                if self.cpp and self.t[self.p] == ":":
                    self.member_initializers()
                if self.t[self.p] == "{":
                    self.block()
                    while self.cpp and self.t[self.p] == "catch":
                        self.catch()
                    return
            if self.got(":"):
                self.binary(2)
            if self.got("="):
                if self.cpp and self.t[self.p] in ("default", "delete"):
                    self.p += 1
                else:
                    self.initializer()
            elif self.cpp and self.t[self.p] == "{" and not function:
                self.initializer()
            if not self.got(","):
                break
            first = False
        self.need(";")

    def member_initializers(self):
        self.need(":")
        while True:
            self.qualified(True)
            if self.t[self.p] == "{":
                self.initializer()
            else:
                self.arguments()
            self.got("...")
            if not self.got(","):
                return

    def declarator(self, abstract: bool, typed: bool = True) -> bool:
        """A declared name with what stands around it; true for that of a function."""
        while True:
            x = self.t[self.p]
            if x in ("*", "&", "&&", "^") or x in ("const", "volatile", "restrict", "__restrict", "__restrict__", "_Atomic", "__const"):
                self.p += 1
            elif x in _ATTRIBUTES:
                self.attributes()
            elif self.cpp and self.is_name() and self.t[self.p + 1] == "::" and self.t[self.p + 2] == "*":
                self.p += 3
            else:
                break
        self.got("...")
        function = False
        if self.t[self.p] == "(" and not (abstract and (self.t[self.p + 1] == ")" or not (self.t[self.p + 1] in ("*", "&", "&&", "^", "(") or self.is_name(1) and self.t[self.p + 2] in (")", "[", "::")))):
            self.p += 1
            self.attributes()
            self.declarator(abstract)
            self.need(")")
        elif self.cpp and typed and not abstract and self.t[self.p] == "[" and self.t[self.p - 1] in ("auto", "&", "&&", "const"):
            self.p += 1
            while self.is_name():
                self.p += 1
                if not self.got(","):
                    break
            self.need("]")
            return False
        elif self.is_name() or self.cpp and self.t[self.p] in ("operator", "~", "::"):
            self.qualified()
        elif not abstract:
            self.fail()
        while True:
            x = self.t[self.p]
            if x == "[" and self.t[self.p + 1] != "[":
                self.p += 1
                while self.t[self.p] in ("static", "const", "restrict", "volatile"):
                    self.p += 1
                if self.t[self.p] == "*" and self.t[self.p + 1] == "]":
                    self.p += 1
                if self.t[self.p] != "]":
                    self.expr()
                self.need("]")
            elif x == "(":
                if self.tried(self.parameters):
                    function = True
                elif self.cpp and typed and not abstract:
                    self.arguments()
                else:
                    self.fail()
            else:
                return function

    def parameters(self):
        self.need("(")
        gt, self.no_gt = self.no_gt, 0
        if not self.got(")"):
            while True:
                if self.got("..."):
                    break
                if not self.specifiers("parameter"):
                    self.fail()
                self.declarator(True)
                self.attributes()
                if self.is_name() and self.t[self.p].isupper():
                    self.p += 1
                if self.cpp and self.got("="):
                    self.initializer()
                if not self.got(","):
                    self.got("...")
                    break
            self.need(")")
        self.no_gt = gt
        while self.cpp:
            x = self.t[self.p]
            if x in ("const", "volatile", "&", "&&", "override", "final", "mutable", "constexpr"):
                self.p += 1
            elif x in ("noexcept", "throw", "requires"):
                self.p += 1
                if self.t[self.p] == "(":
                    self.group()
            elif x == "->":
                self.p += 1
                self.type_name()
            elif x == "[" and self.t[self.p + 1] == "[":
                self.group()
            else:
                return

    def type_name(self):
        if not self.specifiers("parameter"):
            self.fail()
        self.declarator(True)

    def initializer(self):
        if self.t[self.p] != "{":
            return self.binary(1)
        self.p += 1
        gt, self.no_gt = self.no_gt, 0
        while not self.got("}"):
            designated = False
            while self.t[self.p] == "." and self.is_name(1) or not self.cpp and self.t[self.p] == "[":
                designated = True
                if self.got("."):
                    self.p += 1
                else:
                    self.p += 1
                    self.binary(2)
                    if self.got("..."):
                        self.binary(2)
                    self.need("]")
            if not self.cpp and self.is_name() and self.t[self.p + 1] == ":":
                self.p += 2
            elif designated and not (self.cpp and self.t[self.p] == "{"):
                self.need("=")
            self.initializer()
            self.got("...")
            if not self.got(","):
                self.need("}")
                break
        self.no_gt = gt

    # statements

    def block(self):
        self.once(self._block)

    def _block(self):
        self.need("{")
        while not self.got("}"):
            if not self.t[self.p]:
                self.fail()
            self.statement()

    def catch(self):
        self.need("catch")
        self.need("(")
        if not self.got("..."):
            self.specifiers("parameter")
            self.declarator(True)
        self.need(")")
        self.block()

    def condition(self):
        self.need("(")
        if self.cpp and self.t[self.p] != ";":
            at = self.p
            if self.tried(self.simple_declaration) and self.got(";"):
                pass
            else:
                self.p = at
                if self.tried(self.expr) and self.got(";"):
                    pass
                else:
                    self.p = at
            at = self.p
            if self.tried(self.simple_declaration) and self.got(")"):
                return
            self.p = at
        self.expr()
        self.need(")")

    def simple_declaration(self):
        """A declaration without its semicolon."""
        if not self.specifiers("block"):
            self.fail()
        while True:
            self.declarator(False)
            if self.got("="):
                self.initializer()
            elif self.cpp and self.t[self.p] == "{":
                self.initializer()
            if not self.got(","):
                return

    def statement(self):
        x = self.t[self.p]
        if x == "{":
            self.block()
        elif x == ";":
            self.p += 1
        elif x in ("if", "while", "switch"):
            self.p += 1
            if self.cpp and x == "if":
                self.got("constexpr")
            self.condition()
            self.attributes()
            self.statement()
            if x == "if" and self.got("else"):
                self.statement()
        elif x == "for":
            self.p += 1
            self.need("(")
            at = self.p
            if self.cpp and self.tried(self.range_head):
                self.statement()
                return
            self.p = at
            if not self.got(";"):
                if not (self.tried(self.simple_declaration) and self.t[self.p] == ";"):
                    self.p = at
                    self.expr()
                self.need(";")
            if self.t[self.p] != ";":
                self.expr()
            self.need(";")
            if self.t[self.p] != ")":
                self.expr()
            self.need(")")
            self.statement()
        elif x == "do":
            self.p += 1
            self.statement()
            self.need("while")
            self.need("(")
            self.expr()
            self.need(")")
            self.need(";")
        elif x in ("return", "co_return"):
            self.p += 1
            if self.t[self.p] != ";":
                self.initializer()
                while self.got(","):
                    self.binary(1)
            self.need(";")
        elif x in ("break", "continue"):
            self.p += 1
            self.need(";")
        elif x == "goto":
            self.p += 1
            if self.got("*"):
                self.expr()
            elif self.is_name():
                self.p += 1
            else:
                self.fail()
            self.need(";")
        elif x == "case":
            self.p += 1
            self.binary(2)
            if self.got("..."):
                self.binary(2)
            self.need(":")
            if self.t[self.p] != "}":
                self.statement()
        elif x == "default":
            self.p += 1
            self.need(":")
            if self.t[self.p] != "}":
                self.statement()
        elif x in _ASM:
            self.p += 1
            while self.t[self.p] in ("volatile", "__volatile__", "goto", "inline"):
                self.p += 1
            if self.t[self.p] != "(":
                self.fail()
            self.group()
            self.need(";")
        elif self.cpp and x == "try":
            self.p += 1
            self.block()
            if self.t[self.p] != "catch":
                self.fail()
            while self.t[self.p] == "catch":
                self.catch()
        elif self.is_name() and self.t[self.p + 1] == ":":
            self.p += 2
            self.attributes()
            if self.t[self.p] != "}":
                self.statement()
        elif x in ("static_assert", "_Static_assert") or self.cpp and x in ("using", "template") or self.cpp and x == "namespace":
            self.external("block")
        else:
            at = self.p
            if (self.is_name() or x in self.words or x in ("[", "::")) and x not in _STATEMENT and self.tried(self.declaration, "block"):
                return
            self.p = at
            self.expr()
            self.need(";")

    def range_head(self):
        if self.got("("):
            self.fail()
        if not self.specifiers("parameter"):
            self.fail()
        self.declarator(False)
        self.need(":")
        self.initializer()
        self.need(")")

    # expressions

    def expr(self):
        self.binary(1)
        while self.got(","):
            self.binary(1)

    def operator(self) -> tuple[str, int]:
        """The operator at this place and its number of tokens."""
        x = self.t[self.p]
        if x != ">":
            return x, 1
        y = self.t[self.p + 1]
        joined = self.close[self.p + 1] == self.close[self.p] + len(y)
        if y == ">" and joined:
            return ">>", 2
        if y == ">=" and joined:
            return ">>=", 2
        return x, 1

    def binary(self, least: int):
        if self.cpp and self.t[self.p] == "throw":
            self.p += 1
            if self.t[self.p] not in (";", ")", ":", ","):
                self.binary(1)
            return
        self.unary()
        while True:
            x, size = self.operator()
            if x[:1] == ">" and self.no_gt:
                return
            if x == "?" and least <= 2:
                self.p += 1
                if self.t[self.p] != ":":
                    self.expr()
                self.need(":")
                self.binary(1)
            elif x in _ASSIGN and least <= 1:
                self.p += size
                self.initializer() if self.cpp else self.binary(1)
            elif x in _BINARY and _BINARY[x] >= least:
                self.p += size
                if self.cpp and self.got("..."):
                    continue
                self.binary(_BINARY[x] + 1)
            else:
                return

    def unary(self):
        while True:
            x = self.t[self.p]
            if x in ("-", "+", "!", "~", "*", "&", "&&", "++", "--", "__extension__", "co_await", "__real__", "__imag__"):
                self.p += 1
            elif x in ("sizeof", "alignof", "_Alignof", "__alignof__"):
                self.p += 1
                self.got("...")
                if self.t[self.p] == "(":
                    at = self.p
                    self.p += 1
                    if self.tried(self.type_name) and self.got(")"):
                        if self.t[self.p] == "{":
                            self.initializer()
                        if self.t[self.p] not in (".", "->", "[", "("):
                            return
                    self.p = at
            elif self.cpp and (x == "new" or x == "::" and self.t[self.p + 1] == "new"):
                self.p += 1 + (x == "::")
                if self.t[self.p] == "(" :
                    self.arguments()
                if self.t[self.p] == "(":
                    self.group()
                else:
                    if not self.specifiers("parameter"):
                        self.fail()
                    while self.t[self.p] in ("*", "&", "const"):
                        self.p += 1
                    while self.got("["):
                        if self.t[self.p] != "]":
                            self.expr()
                        self.need("]")
                if self.t[self.p] == "(":
                    self.arguments()
                elif self.t[self.p] == "{":
                    self.initializer()
                return
            elif self.cpp and (x == "delete" or x == "::" and self.t[self.p + 1] == "delete"):
                self.p += 1 + (x == "::")
                if self.got("["):
                    self.need("]")
            elif x == "(" and self.cast():
                if self.t[self.p] == "{":
                    self.initializer()
                    return self.postfix()
            else:
                break
        self.primary()
        self.postfix()

    def cast(self) -> bool:
        """Reads (type) if a value follows."""
        at = self.p
        self.p += 1
        if self.tried(self.type_name) and self.t[self.p] == ")":
            inside = self.t[at + 1 : self.p]
            sure = inside[-1] in ("*", "&") or any(w in _BUILTIN or w in ("struct", "union", "enum", "const", "unsigned") for w in inside)
            self.p += 1
            x = self.t[self.p]
            value = self.is_name() or x[:1].isdigit() or x[:1] in ('"', "'") and x or x[-1:] in ('"', "'") or x in ("{", "sizeof", "new", "!", "~") or x[:1] == "." and x[1:2].isdigit()
            if x and (value or sure and x in ("(", "-", "+", "*", "&", "++", "--", "&&", "[", "::", "delete")):
                return True
        self.p = at
        return False

    def arguments(self):
        self.need("(")
        gt, self.no_gt = self.no_gt, 0
        while self.t[self.p] != ")":
            at = self.p
            if not (self.tried(self.initializer if self.cpp or self.t[self.p] == "{" else self.binary, *(() if self.cpp or self.t[self.p] == "{" else (1,))) and self.t[self.p] in (",", ")", "...")):
                self.p = at
                self.type_name()
            self.got("...")
            if not self.got(","):
                break
            if self.t[self.p] == ")":
                self.fail()
        self.no_gt = gt
        self.need(")")

    def primary(self):
        x = self.t[self.p]
        if x == "(":
            self.p += 1
            gt, self.no_gt = self.no_gt, 0
            if self.t[self.p] == "{":
                self.block()
            else:
                if self.cpp and self.got("..."):
                    self.p += 1
                self.expr_or_fold()
            self.no_gt = gt
            self.need(")")
        elif x[:1].isdigit() or x[:1] == "." and x[1:2].isdigit() or x[-1:] == "'" and x:
            self.p += 1
        elif x[-1:] == '"':
            while self.is_string() or self.is_name() and self.t[self.p] not in _ASM:
                self.p += 1
        elif self.cpp and x == "[":
            self.lambda_expression()
        elif self.cpp and (x in _BUILTIN or x == "typename" or x == "decltype"):
            self.specifiers("parameter")
            if self.t[self.p] not in ("(", "{"):
                self.fail()
            if self.t[self.p] == "{":
                self.initializer()
        elif self.cpp and x in ("noexcept", "requires") and self.t[self.p + 1] == "(":
            self.p += 1
            self.group()
        elif self.cpp and x in _CASTS:
            self.p += 1
            self.need("<")
            self.type_name()
            self.need(">")
            if self.t[self.p] != "(":
                self.fail()
        elif x == "_Generic" and self.t[self.p + 1] == "(":
            self.p += 1
            self.group()
        elif self.is_name() or self.cpp and x in ("::", "operator", "~"):
            self.qualified()
            if self.is_string():  # a macro before a string
                self.p += 1
                while self.is_string() or self.is_name():
                    self.p += 1
            if self.cpp and self.t[self.p] == "{":
                self.initializer()
        else:
            self.fail()

    def expr_or_fold(self):
        self.binary(1)
        while self.got(","):
            if self.cpp and self.got("..."):
                return
            self.binary(1)

    def lambda_expression(self):
        self.need("[")
        while self.t[self.p] != "]":
            self.got("&") or self.got("=")
            self.got("*")
            if self.is_name():
                self.p += 1
                if self.got("="):
                    self.initializer()
                elif self.t[self.p] == "{":
                    self.initializer()
            self.got("...")
            if not self.got(","):
                break
        self.need("]")
        if self.t[self.p] == "<":
            self.template_parameters()
        if self.t[self.p] == "(":
            self.parameters()
        elif self.got("->"):
            self.type_name()
        self.got("mutable")
        self.block()

    def postfix(self):
        while True:
            x = self.t[self.p]
            if x == "(":
                self.arguments()
            elif x == "[" and self.t[self.p + 1] != "]":
                self.p += 1
                gt, self.no_gt = self.no_gt, 0
                self.expr()
                self.no_gt = gt
                self.need("]")
            elif x in (".", "->"):
                self.p += 1
                if self.cpp:
                    self.qualified()
                elif self.is_name():
                    self.p += 1
                else:
                    self.fail()
            elif x in ("++", "--"):
                self.p += 1
            else:
                return
