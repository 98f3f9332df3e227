"""Source files that do not parse: minimum-cost syntax repair by an error-correcting chart.

A file is cut into token kinds. Bracket groups (in Python also the lines of a block) are read from the inside out: the
content of a group is charted by the rules of its language, and the group becomes one kind that says what it can be read
as. A file is valid if the chart needs no edit for it; else its cost is that of

- brackets to delete, insert or exchange, the least number by a chart over them (``balance``), lines of merge conflicts to
  delete, each 1, and
- for each statement (each group that holds none) that can't be read, the least cost of edits by ``chart.Grammar``: token
  edits cost 1, group edits as stated there, and a statement that fewer edits can't mend is dropped for ``DROP``.

Cost flags the file, the places of the edits tell the sort of damage. No language's own parser takes part.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrata.llm import grammars as g
from docstrata.llm.chart import DROP, GROUP, LONG, MEMO, Grammar

BAD, CONFLICT_KIND, LINE_KIND = "!", "X", "\n"
CONFLICT = r"(?m:^(?:<{7}|={7}|>{7}|\|{7})(?![<=>|]).*)"
PAIRS = {"(": ")", "[": "]", "{": "}", "<": ">"}
CLOSES = {b: a for a, b in PAIRS.items()}
_BRACKETS = re.compile(r"([()\[\]{}<>])")


class _Kinds(dict):
    """Token -> kind, filled as tokens are met, and emptied before it grows large."""

    def __init__(self, kind: Callable[[str], str]):
        super().__init__()
        self.kind = kind

    def __missing__(self, token: str) -> str:
        if len(self) > 200_000:
            self.clear()
        found = self[token] = self.kind(token)
        return found


@dataclass
class Token:
    text: str
    kind: str
    place: int


class Language:
    """Tokens, rules and layout of one language; the rules are compiled when first used."""

    def __init__(self, tokens: str, file: str, rules: str, lists: dict[str, str], classes: dict[str, str], words: str, kind: Callable, end: str = ""):
        self.pattern, self.file = re.compile(tokens), file
        self._made = (rules, lists, classes, words, kind, end)
        self._grammar: Grammar | None = None

    @property
    def grammar(self) -> Grammar:
        if self._grammar is None:
            rules, lists, classes, words, kind, end = self._made
            grammar = self._grammar = Grammar(rules, lists)
            grammar.end_mark = grammar.code(end) if end else ""
            fixed = {w: grammar.code(name) for name, ws in classes.items() for w in ws.split()} | {w: grammar.code(w) for w in words.split()}
            self.kinds = _Kinds(lambda token: kind(token, fixed, grammar.code))
            self._groups: dict[str, str] = {}
        return self._grammar

    def tokens(self, text: str) -> list[Token]:
        """The tokens that have a kind, with their places."""
        self.grammar  # noqa: B018  (compiles the rules)
        return [Token(m[0], k, m.start()) for m in self.pattern.finditer(text) if (k := self.kinds[m[0]])]

    def clean(self, text: str) -> str:
        return text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")

    def layout(self, tokens: list[Token]) -> list[Token]:
        """The tokens as the rules see them: what line ends and indents mean is put in."""
        return tokens

    def variants(self, tokens: list[Token]) -> Iterator[list[Token]]:
        """The texts a file may stand for."""
        yield tokens

    def accepts(self, tokens: list[Token]) -> bool:
        return any(self.reads("".join([t.kind for t in self.layout(v)])) for v in self.variants(tokens))

    def group(self, bracket: str, content: str) -> str:
        """The kind of a group that some rule reads, else ''."""
        key = bracket + content
        known = self._groups.get(key)
        if known is None:
            if len(self._groups) > MEMO:
                self._groups.clear()
            g = self.grammar
            read = {rule: 0 for rule in g.inside[bracket] if g.reads(content, rule)}
            known = g.group(bracket, read) if read else ""
            if len(content) <= LONG:
                self._groups[key] = known
        return known

    def reads(self, kinds: str) -> bool:
        """Whether every group and the file follow the rules."""
        if BAD in kinds or CONFLICT_KIND in kinds:
            return False
        stack, here = [], ""
        for part in _BRACKETS.split(kinds):
            if part in CLOSES:
                if not stack or stack[-1][0] != CLOSES[part]:
                    return False
                kind = self.group(CLOSES[part], here)
                if not kind:
                    return False
                here = stack.pop()[1] + kind
            elif part in PAIRS:
                stack.append((part, here))
                here = ""
            else:
                here += part
        return not stack and self.grammar.reads(here, self.file)


# C and C++ -----------------------------------------------------------------------------------------------------------
# The preprocessor's directives, and numbers of C, C++ and JavaScript.
C_DIRECTIVES = "include include_next define undef if ifdef ifndef elif elifdef elifndef else endif line error warning pragma embed import ident".split()
C_NUMBER = re.compile(
    r"0[xX](?:[0-9a-fA-F']+\.?[0-9a-fA-F']*|\.[0-9a-fA-F]+)(?:[pP][-+]?\d+)?\w{0,4}|0[bB][01']+\w{0,4}|0[0-7']*[uUlLzZ]{0,3}"
    r"|[1-9][\d']*[uUlLzZ]{0,3}|(?:\d[\d']*\.[\d']*|\.\d[\d']*)(?:[eE][-+]?\d+)?[fFlLdDbB\d]{0,4}|\d[\d']*[eE][-+]?\d+[fFlL]?"
)
C_TOKENS = (
    r"//(?:[^\n\\]|\\.|\\\n)*|/\*[\s\S]*?\*/|/\*|" + CONFLICT + r"""|(?m:^[ \t]*\#(?:[^\n\\/]|\\[\s\S]|/\*[\s\S]*?\*/|/)*)"""
    r"""|(?:u8|[uUL])?R"\([\s\S]*?\)"|(?:u8|[uUL])?"(?:[^"\\\n]|\\[\s\S])*"|(?:u8|[uUL])?'(?:[^'\\\n]|\\[^\n])+'"""
    r"""|\.?\d(?:[eEpP][-+]|'?[\w.])*|[^\W\d]\w*|<=>|<<=|>>=|\.\.\.|->\*?|\.\*|::|\+\+|--|&&|\|\||[-+*/%&|^!=<>]=|<<|\S"""
)


def _c_kind(cpp: bool) -> Callable[[str, dict[str, str], Callable[[str], str]], str]:
    def kind(token: str, fixed: dict[str, str], code: Callable[[str], str]) -> str:
        first = token[0]
        if token in fixed:
            return fixed[token]
        if token in "()[]{}":
            return token
        if token[:2] == "//" or token[:2] == "/*" and len(token) > 3:
            return ""
        if first in " \t#" and "#" in token:
            name = re.match(r"[ \t]*#[ \t]*(\w*)", token)[1]
            return LINE_KIND if not name or name in C_DIRECTIVES or name.isdigit() else BAD
        if token[-1] == '"' and len(token) > 1:
            return code("STRING")
        if token[-1] == "'" and len(token) > 1:
            return code("NUMBER")
        if first.isalpha() or first == "_":
            macro = "__" in token or len(token) > 1 and token.upper() == token
            return code("MACRO" if macro else "NAME") if token.isidentifier() else BAD
        if first.isdigit() or first == "." and len(token) > 1:
            return code("NUMBER") if C_NUMBER.fullmatch(token) or cpp and re.fullmatch(r"\d+_\w+", token) else BAD
        if re.match(r"<{7}|={7}|>{7}|\|{7}", token):
            return CONFLICT_KIND
        return BAD

    return kind


class CFamily(Language):
    def variants(self, tokens: list[Token]) -> Iterator[list[Token]]:
        """The text with all branches of ``#if``, then with only the first of each, then with only the last."""
        yield [t for t in tokens if t.kind != LINE_KIND]
        branches = [(i, re.match(r"\s*#\s*(\w*)", t.text)[1]) for i, t in enumerate(tokens) if t.kind == LINE_KIND]
        if any(name.startswith("el") for _, name in branches):
            for last in (False, True):
                yield [t for t in _branch(tokens, dict(branches), last) if t.kind != LINE_KIND]


def _branch(tokens: list[Token], directives: dict[int, str], last: bool) -> list[Token]:
    """The tokens without those of other branches than the first (or the last) of each conditional."""
    kept: list[Token] = []
    open_: list[tuple[int, bool]] = []  # where the branch begins in ``kept``, whether what follows is left out
    out = 0
    for i, t in enumerate(tokens):
        name = directives.get(i, "")
        if name in ("if", "ifdef", "ifndef"):
            open_.append((len(kept), False))
        elif name.startswith("el") and open_:
            start, skipped = open_.pop()
            if last:
                del kept[start:]
            elif not skipped:
                out += 1
            open_.append((start, not last))
        elif name == "endif" and open_:
            out -= open_.pop()[1]
        if not out or name:
            kept.append(t)
    return kept


# JavaScript ----------------------------------------------------------------------------------------------------------
JS_NUMBER = re.compile(r"0[xX][\da-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][-+]?[\d_]+)?|\d[\d_]*n")
JS_TOKENS = (
    r"//[^\n]*|/\*[\s\S]*?\*/|/\*|\A\#![^\n]*|" + CONFLICT + r"""|"(?:[^"\\\n]|\\[\s\S])*"|'(?:[^'\\\n]|\\[\s\S])*'|`(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(?:`|\$\{)"""
    r"""|(?:(?<=[(,=:\[!&|?{};\n+])|(?<=return)|(?<=typeof)|(?<=case)|(?<=[(,=:\[!&|?{};\n+] ))[ \t]*/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*"""
    r"""|\.?\d(?:[eE][-+]|[\w.])*|\#?[^\W\d$]?[\w$]+|\n|>>>=|\*\*=|&&=|\|\|=|\?\?=|===|!==|>>>|<<=|>>=|\.\.\.|=>|\?\.(?!\d)|\?\?|\*\*|\+\+|--|&&|\|\||[-+*/%&|^!=<>]=|<<|>>|[^ \t\r\f\v\u00a0\ufeff]"""
)
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{)")


def _js_kind(token: str, fixed: dict[str, str], code: Callable[[str], str]) -> str:
    token = token.lstrip(" \t") or token
    first = token[0]
    if token in fixed:
        return fixed[token]
    if token in "()[]{}\n":
        return token
    if first == "#" and len(token) > 1 and token[1] not in "!0123456789":
        return code("PRIVATE")
    if first.isalpha() or first in "_$":
        return code("NAME")
    if first.isdigit() or first == "." and len(token) > 1:
        return code("NUMBER") if JS_NUMBER.fullmatch(token) else BAD
    if len(token) > 1:
        if token[:2] in ("//", "#!"):
            return ""
        if token[:2] == "/*":
            return BAD if token == "/*" else LINE_KIND if "\n" in token else ""
        if re.match(r"<{7}|={7}|>{7}|\|{7}", token):
            return CONFLICT_KIND
        if first in "\"'":
            return code("STRING")
        if first == "`":
            return code("`")
        if first == "/":
            return code("REGEX")
    return BAD


class JavaScript(Language):
    def tokens(self, text: str) -> list[Token]:
        """A template's ``${ }`` becomes a bracket group after the template."""
        if "${" not in text:
            return super().tokens(text)
        self.grammar  # noqa: B018
        found, at, depth, inside = [], 0, 0, []
        while m := self.pattern.search(text, at):
            token, at = m[0], m.end()
            if token == "}" and inside and inside[-1] == depth:
                inside.pop()
                found.append(Token("}", ")", m.start()))
                rest = _TEMPLATE.match(text, at)
                if not rest:
                    found.append(Token("`", BAD, at))
                    continue
                at = rest.end()
                token = "`" + rest[0]
            elif kind := self.kinds[token]:
                depth += (token == "{") - (token == "}")
                found.append(Token(token, kind, m.start()))
            if token[0] == "`" and token.endswith("${"):
                inside.append(depth)
                found.append(Token("${", "(", at - 2))
        return found

    def layout(self, tokens: list[Token]) -> list[Token]:
        """Line ends become semicolons where the next token can't go on with the statement, and vanish elsewhere."""
        code = self.grammar.code
        semicolon = code(";")
        ends = {")", "]", "}", *map(code, ("NAME", "SOFT", "NUMBER", "STRING", "CONST", "PRIVATE", "REGEX", "`", "STEP", "return", "throw", "break", "continue", "debugger", "yield", "async", "static", "of", "let", "await"))}
        begins = {"{", *map(code, ("NAME", "SOFT", "NUMBER", "STRING", "CONST", "PRIVATE", "STEP", "NOT", "PREFIX"))} | {
            code(w) for w in g.JS_WORDS.split() if w.isalpha() and w not in ("in", "of", "instanceof", "else", "catch", "finally", "extends")
        }
        heads, dots = {code(w) for w in ("if", "while", "for", "with")}, {code("."), code("?.")}
        found: list[Token] = []
        stack: list[bool] = []
        pending: Token | None = None
        header = False  # whether the last token closes the head of a statement
        for t in tokens:
            if t.kind == LINE_KIND:
                pending = pending or t
                continue
            if pending is not None and found:
                last = found[-1].kind
                if len(found) > 1 and found[-2].kind in dots:
                    last = code("NAME")
                if last in ends and not header and (t.kind in begins and (t.kind != "{" or last != ")") or t.text == "else" and last != "}"):
                    found.append(Token("", semicolon, pending.place))
            pending = None
            header = False
            if t.kind == "(":
                stack.append(bool(found) and found[-1].kind in heads and (len(found) < 2 or found[-2].kind not in dots))
            elif t.kind == ")" and stack:
                header = stack.pop()
            found.append(t)
        return found


# JSON ----------------------------------------------------------------------------------------------------------------
def _json_kind(token: str, fixed: dict[str, str], code: Callable[[str], str]) -> str:
    if token in fixed:
        return fixed[token]
    if token in "[]{}":
        return token
    if token[0] == '"' and len(token) > 1:
        return code("STRING") if re.fullmatch(r'"(?:[^"\\\x00-\x1f]|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*"', token) else BAD
    if re.match(r"<{7}|={7}|>{7}|\|{7}", token):
        return CONFLICT_KIND
    return code("NUMBER") if re.fullmatch(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?", token) else BAD


class Json(Language):
    def clean(self, text: str) -> str:
        return text


# Python --------------------------------------------------------------------------------------------------------------
_BRACED = r"\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\}"
PY_TOKENS = (
    CONFLICT
    + rf"""|\#[^\n]*|(?:[fF][rR]?|[rR][fF])(?:\"{{3}}(?:[^\\{{]|\\[\s\S]|\{{\{{|{_BRACED})*?\"{{3}}|'{{3}}(?:[^\\{{]|\\[\s\S]|\{{\{{|{_BRACED})*?'{{3}}|"(?:[^"\\\n{{]|\\[\s\S]|\{{\{{|{_BRACED})*"|'(?:[^'\\\n{{]|\\[\s\S]|\{{\{{|{_BRACED})*')"""
    r"""|[rbuRBU]{0,2}(?:\"{3}(?:[^\\]|\\[\s\S])*?\"{3}|'{3}(?:[^\\]|\\[\s\S])*?'{3}|"(?!"")(?:[^"\\\n]|\\[\s\S])*"|'(?!'')(?:[^'\\\n]|\\[\s\S])*')"""
    r"""|\.\.\.|\.?\d(?:[eE][-+](?=\d)|[\w.])*|[^\W\d]\w*|\\\n|\*\*=|//=|>>=|<<=|\*\*|//|->|:=|[-+*/%&|^!=<>@]=|<<|>>|\n[ \t\f]*|[^ \t\f]"""
)
PY_NUMBER = re.compile(
    r"0[xX](?:_?[\da-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:0(?:_?0)*|[1-9](?:_?\d)*)|(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.)(?:[eE][-+]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*(?:[eE][-+]?\d(?:_?\d)*)?[jJ]|\d(?:_?\d)*[eE][-+]?\d(?:_?\d)*"
)
_ESCAPES = re.compile(r"\\(?:x(?![\da-fA-F]{2})|u(?![\da-fA-F]{4})|U(?!00(?:0[\da-fA-F]|10)[\da-fA-F]{4})|N(?!\{[^}]+\}))")


def _fields(text: str) -> list[str] | None:
    """The expressions of an f-string's replacement fields, those of their format specifications too; None if braces don't close."""
    found, at = [], 0
    while at < len(text):
        c = text[at]
        if text[at : at + 2] in ("{{", "}}"):
            at += 2
        elif c == "}":
            return None
        elif c == "{":
            depth, end, quote, colon = 0, at + 1, "", -1
            while end < len(text) and (quote or depth or text[end] != "}"):
                d = text[end]
                if quote:
                    quote = "" if d == quote else quote
                elif d in "'\"":
                    quote = d
                elif colon < 0 and d in "([{":
                    depth += 1
                elif colon < 0 and d in ")]}":
                    depth -= 1
                elif colon < 0 and d == ":" and not depth:
                    colon = end
                elif colon >= 0 and d == "{":
                    depth += 1
                elif colon >= 0 and d == "}":
                    depth -= 1
                end += 1
            if end >= len(text):
                return None
            expression = text[at + 1 : colon if colon >= 0 else end]
            expression = re.sub(r"![rsa]\s*$", "", expression)
            found.append(expression)
            if colon >= 0:
                inner = _fields(text[colon + 1 : end])
                if inner is None:
                    return None
                found += inner
            at = end + 1
        else:
            at += 1
    return found


class Python(Language):
    def tokens(self, text: str) -> list[Token]:
        found = super().tokens("\n" + text)
        for t in found:
            t.place = max(0, t.place - 1)
        return found

    def string(self, token: str, code: Callable[[str], str]) -> str:
        """The kind of a string token: its escapes, bytes and replacement fields are looked at."""
        prefix = re.match(r"[a-zA-Z]*", token)[0].lower()
        body = token[len(prefix) :]
        quotes = 3 if body[:3] in ('"""', "'''") and len(body) >= 6 else 1
        inner = body[quotes:-quotes]
        if prefix not in ("", "r", "b", "u", "f", "br", "rb", "fr", "rf"):
            return BAD
        if "b" in prefix and not token.isascii():
            return BAD
        if "r" not in prefix and "\\" in inner:
            plain = inner.replace("\\\\", "")
            if "b" in prefix and re.search(r"\\x(?![\da-fA-F]{2})", plain) or "b" not in prefix and _ESCAPES.search(plain):
                return BAD
            names = re.findall(r"\\N\{([^}]+)\}", plain) if "b" not in prefix else []
            for name in names:
                try:
                    unicodedata.lookup(name)
                except KeyError:
                    return BAD
        if "f" in prefix:
            fields = _fields(re.sub(r"\\N\{[^}]*\}", "", inner) if "r" not in prefix else inner)
            if fields is None or not all(self.field(f) for f in fields):
                return BAD
        return code("BYTES" if "b" in prefix else "STRING")

    def field(self, expression: str) -> bool:
        kinds = "".join(t.kind for t in self.tokens("(" + expression + ")") if t.text[0] != "\n")
        return kinds[:1] == "(" and kinds[-1:] == ")" and self.balanced(kinds) and self.reads_field(kinds[1:-1])

    @staticmethod
    def balanced(kinds: str) -> bool:
        depth = 0
        for k in kinds[:-1]:
            depth += (k in "([{") - (k in ")]}")
            if depth < 1:
                return False
        return True

    def reads_field(self, kinds: str) -> bool:
        file, self.file = self.file, "FIELD"
        try:
            return self.reads(kinds)
        finally:
            self.file = file

    def layout(self, tokens: list[Token]) -> list[Token]:
        """Line ends within brackets vanish, others end a line; a deeper line begins a block, a shallower one ends it."""
        code = self.grammar.code
        line_end = code("NL")
        found: list[Token] = []
        depth, stack, line = 0, [(0, 0)], "\n"
        fresh, place = True, 0  # whether a line begins here, and the place of its end
        for t in tokens:
            if t.kind == LINE_KIND:
                if not depth:
                    if not fresh:
                        found.append(Token("", line_end, t.place))
                    fresh, line = True, t.text
                place = t.place
                continue
            if fresh:
                fresh = False
                width = _width(line)
                if width > stack[-1]:
                    if width[1] <= stack[-1][1]:
                        found.append(Token("", BAD, t.place))  # tabs and blanks disagree
                    stack.append(width)
                    found.append(Token("", "<", t.place))
                else:
                    while width < stack[-1]:
                        stack.pop()
                        found.append(Token("", ">", t.place))
                    if width != stack[-1]:
                        found.append(Token("", BAD, t.place))
            if t.kind in "([{":
                depth += 1
            elif t.kind in ")]}":
                depth = max(0, depth - 1)
            found.append(t)
        end = tokens[-1].place if tokens else place
        if not fresh:
            found.append(Token("", line_end, end))
        found += [Token("", ">", end) for _ in stack[1:]]
        return found


def _width(line: str) -> tuple[int, int]:
    """How far a line is indented, with tabs of eight columns and of one."""
    wide = narrow = 0
    for c in line[1:]:
        if c == "\f":
            wide = narrow = 0
        else:
            wide = (wide // 8 + 1) * 8 if c == "\t" else wide + 1
            narrow += 1
    return wide, narrow


def _py_kind(token: str, fixed: dict[str, str], code: Callable[[str], str]) -> str:
    first = token[0]
    if token in fixed:
        return fixed[token]
    if token in "()[]{}":
        return token
    if first == "\n":
        return LINE_KIND
    if first == "#" or token == "\\\n":
        return ""
    if token[-1] in "\"'" and len(token) > 1:
        return LANGUAGES["python"].string(token, code)
    if re.match(r"<{7}|={7}|>{7}|\|{7}", token):
        return CONFLICT_KIND
    if first.isdigit() or first == "." and len(token) > 1:
        return code("NUMBER") if PY_NUMBER.fullmatch(token) else BAD
    return code("NAME") if unicodedata.normalize("NFKC", token).isidentifier() else BAD


_C_LISTS = {"BLOCK": "STMT", "MEMBERS": "MEMBER", "TOPS": "TOP"}
LANGUAGES: dict[str, Language] = {
    "c": CFamily(C_TOKENS, "TOPS", g.C_RULES, _C_LISTS, g.C_CLASSES, g.C_WORDS, _c_kind(False)),
    "cpp": CFamily(C_TOKENS, "TOPS", g.CPP_RULES, _C_LISTS, g.CPP_CLASSES, g.CPP_WORDS, _c_kind(True)),
    "javascript": JavaScript(JS_TOKENS, "BLOCK", g.JS_RULES, {"BLOCK": "STMT", "CLASS": "MEMBER", "CASES": "CASE"}, g.JS_CLASSES, g.JS_WORDS, _js_kind, "END"),
    "json": Json(CONFLICT + r"""|"(?:[^"\\\n]|\\.)*"|-?[\w.+-]+|[^ \t\n\r]""", "FILE", g.JSON_RULES, {}, {"CONST": "true false null"}, ", :", _json_kind),
    "python": Python(PY_TOKENS, "BLOCK", g.PY_RULES, {"BLOCK": "STMT", "CASES": "CASE"}, g.PY_CLASSES, g.PY_WORDS, _py_kind),
}


# Repair --------------------------------------------------------------------------------------------------------------
def balance(brackets: str) -> tuple[int, dict[int, str]]:
    """The least number of edits that balance ``brackets``, and the edits: '' deletes the bracket at a place, another one
    stands in its place. Brackets left open (a bracket is deleted or gets a partner, which costs the same) are deleted here.

    Adjacent pairs that match are cancelled, and closers before all openers and openers after all closers, which nothing
    can match, put aside. The rest is charted from its end, whatever its length: for each opener, what is saved from there up
    to before each closer. It is deleted, or matched with a later closer of its shape, which saves 2, or of another, which
    saves 1. A closer needs a try only if matching it saves more, up to there, than all closers before it do: else it
    saves no more further on either. Closers in a row go on alike, so they are tried at once. Rows stay, packed, for the
    way back.
    """
    rest: list[int] = []
    for i, b in enumerate(brackets):
        if rest and PAIRS.get(brackets[rest[-1]]) == b:
            rest.pop()
        else:
            rest.append(i)
    edits = {i: "" for i in rest}
    first = next((k for k, i in enumerate(rest) if brackets[i] in PAIRS), len(rest))
    last = next((k + 1 for k in range(len(rest) - 1, -1, -1) if brackets[rest[k]] in CLOSES), 0)
    openers = [i for i in rest[first:last] if brackets[i] in PAIRS]
    closers = [i for i in rest[first:last] if brackets[i] in CLOSES]
    if not openers:
        return len(rest), edits
    n = len(closers)
    shapes = np.array(["([{<".index(CLOSES[brackets[i]]) for i in closers], dtype=np.int8)
    before = np.searchsorted(closers, openers)  # closers before each opener
    following = np.searchsorted(openers, closers)  # the opener that follows each closer
    ends = np.append(before, n)[following]  # the end of each closer's run
    rows: list[tuple[_Row, np.ndarray]] = [(_Row(np.zeros(1)), np.zeros(0))] * len(openers)  # with the tries that saved more
    start, row = n, np.zeros(1, dtype=np.int32)  # what is saved up to before each closer from ``start`` on, and in all
    for o in range(len(openers) - 1, -1, -1):
        row = np.concatenate([np.zeros(start - before[o], dtype=np.int32), row])
        start = int(before[o])
        values = row[:-1] + 1 + (shapes[start:] == "([{<".index(brackets[openers[o]]))
        better, tried, at = row.copy(), np.zeros(n - start, dtype=bool), 0
        while len(more := np.flatnonzero(values[at:] > better[at + 1 :])[:1]):
            at += int(more[0])
            end = int(ends[start + at]) - start
            run, most = values[at:end], np.maximum.accumulate(values[at:end])
            tried[at:end] = (run > better[at + 1 : end + 1]) & (run > np.append(0, most[:-1]))
            np.maximum(better[at + 1 : end + 1], most, out=better[at + 1 : end + 1])
            if end < len(values):
                np.maximum(better[end:], most[-1] + rows[following[start + at]][0].all(), out=better[end:])
            at = end
        rows[o] = _Row(better), np.packbits(tried)
        row = better

    def saves(o: int, end: int) -> int:
        return rows[o][0].up_to(end - int(before[o])) if o < len(openers) and before[o] < end else 0

    todo = [(0, n)]
    while todo:
        o, end = todo.pop()
        saved = saves(o, end)
        if saved == saves(o + 1, end):
            if saved:
                todo.append((o + 1, end))
            continue
        tries = np.flatnonzero(np.unpackbits(rows[o][1])[: end - before[o]])
        values = rows[o][0].all()[tries + 1]
        tries += before[o]
        for next_ in np.unique(following[tries]):
            hit = np.flatnonzero((following[tries] == next_) & (values == saved - saves(next_, end)))
            if len(hit):
                k = int(tries[hit[0]])
                break
        del edits[openers[o]]
        if CLOSES[brackets[closers[k]]] == brackets[openers[o]]:
            del edits[closers[k]]
        else:
            edits[closers[k]] = PAIRS[brackets[openers[o]]]
        todo += [(o + 1, k), (int(next_), end)]
    return len(rest) - int(row[-1]), edits


class _Row:
    """Ascending numbers from 0 in steps of at most 2, two bits each."""

    def __init__(self, row: np.ndarray):
        step = np.diff(row)
        self.n, self.bits = len(step), (np.packbits(step > 0), np.packbits(step > 1))

    def all(self) -> np.ndarray:
        found = np.zeros(self.n + 1, dtype=np.int32)
        np.cumsum(sum(np.unpackbits(b, count=self.n) for b in self.bits), out=found[1:])
        return found

    def up_to(self, n: int) -> int:
        full, more = divmod(n, 8)
        return sum(int(np.bitwise_count(b[:full]).sum()) + (more and (int(b[full]) >> (8 - more)).bit_count()) for b in self.bits)


def _mend(language: Language, tokens: list[Token]) -> tuple[int, list[tuple[int, int, int]], int]:
    """Cost, edits (place, cost, place of what the statement ends with) and number of statements of a text whose brackets
    are balanced."""
    grammar = language.grammar
    edits: list[tuple[int, int, int]] = []
    statements = 0

    def content(bracket: str, kinds: str, places: list[int], closing: int) -> str:
        """Mends what a group holds (the file: no bracket) by the rule that needs least; returns its kind."""
        nonlocal statements
        rules = grammar.inside[bracket] if bracket else [language.file]
        if bracket and (known := language.group(bracket, kinds)):
            if bracket in "{<":
                statements += kinds.count(grammar.codes.get(";", LINE_KIND)) + 1
            return known
        costs: dict[str, int] = {}
        least = DROP if not any(rule in grammar.lists for rule in rules) else len(kinds) + DROP
        for rule in sorted(rules, key=lambda r: r not in grammar.lists):
            limit = least + GROUP if rule in grammar.lists else min(least + GROUP, DROP)
            costs[rule] = grammar.least(kinds, rule, limit)
            least = min(least, costs[rule])
        rule = min(costs, key=costs.get)
        if rule in grammar.lists:
            starts, bad = grammar.pieces(kinds, rule)
            statements += len(starts)
            edits.extend((places[_look(grammar, kinds, a, b, rule)], grammar.statement(kinds[a:b], rule), places[b - 1]) for a, b in bad)
        elif costs[rule]:
            statements += 1
            look = grammar.longest(kinds, 0, rule)[1]
            edits.append((places[look] if look < len(places) else closing, costs[rule], closing))
        return grammar.group(bracket, {r: c - least for r, c in costs.items()}) if bracket else ""

    stack: list[tuple[str, str, list[int]]] = []
    here, places = "", []
    for t in tokens:
        if t.kind in PAIRS:
            stack.append((t.kind, here, places))
            here, places = "", []
        elif t.kind in CLOSES:
            kind = content(CLOSES[t.kind], here, places, t.place)
            _, before, held = stack.pop()
            here, places = before + kind, [*held, t.place]
        else:
            here += t.kind
            places.append(t.place)
    content("", here, places, tokens[-1].place if tokens else 0)
    return sum(e[1] for e in edits), edits, statements


def _look(grammar: Grammar, kinds: str, a: int, b: int, rule: str) -> int:
    """Where the statement from ``a`` to ``b`` goes wrong."""
    return min(max(a, b - 1), max(a, grammar.longest(kinds, a, grammar.lists[rule])[1]))


def repair(text: str, lang: str) -> tuple[int, str, int]:
    """``(cost, damage, line)`` of a text: 0 and '' if no edit is needed, else the cost, the sort of damage and the first edit's line.

    Conflict markers among the edits tell a conflict; edits only near the end or to the statement there a truncation; more
    than a quarter of the statements dropped, or more than half of them edited, another language than the extension's; the
    rest is local damage. What is left open is closed at the end, unless to delete the bracket saves more edits than brackets.
    """
    language = LANGUAGES[lang]
    text = language.clean(text)
    tokens = language.tokens(text)
    if not tokens and lang != "json" or language.accepts(tokens):
        return 0, "", 0
    marks = [t.place for t in tokens if t.kind == CONFLICT_KIND]
    tokens = [t for t in next(language.variants(tokens)) if t.kind != CONFLICT_KIND]
    end = tokens[-1].place if tokens else 0
    brackets = [i for i, t in enumerate(tokens) if t.kind in "()[]{}"]
    cost, changes = balance("".join(tokens[i].kind for i in brackets))
    changed = {brackets[i]: kind for i, kind in changes.items()}
    mended = [Token(t.text, changed.get(i, t.kind), t.place) for i, t in enumerate(tokens) if changed.get(i, t.kind)]
    lost = [tokens[i].place for i in changed]
    found = (*_mend(language, language.layout(mended)), lost)
    open_ = [i for i in changed if tokens[i].kind in PAIRS and not changed[i]]
    after = [i for i in changed if tokens[i].kind in CLOSES]
    if open_ and not (after and max(after) > max(open_)):  # what is left open may also be closed at the end
        closers = "".join(PAIRS[tokens[i].kind] for i in reversed(open_))
        shape = changed | {i: tokens[i].kind for i in open_}
        closed = [Token(t.text, shape.get(i, t.kind), t.place) for i, t in enumerate(tokens) if shape.get(i, t.kind)]
        if _nests(closed, closers):
            closed += [Token("", k, end) for k in closers]
            other = (*_mend(language, language.layout(closed)), [p for i, p in zip(changed, lost, strict=True) if i not in open_] + [end] * len(open_))
            found = other if other[0] <= found[0] + len(open_) else found
    more, edits, statements, places = found
    cost += more + len(marks)
    bad = sorted([e[0] for e in edits] + places + marks) or [end]
    dropped = sum(e[1] >= DROP for e in edits)
    if marks:
        damage = "conflict"
    elif all(p >= 0.9 * end for p in places) and all(at >= 0.9 * end or last >= end and c < DROP for at, c, last in edits):
        damage = "truncation"
    elif 4 * dropped > statements or 2 * len(edits) > statements:
        damage = "mismatch"
    else:
        damage = "local"
    return cost, damage, text.count("\n", 0, bad[0]) + 1


def _nests(tokens: list[Token], closers: str) -> bool:
    stack: list[str] = []
    for k in [t.kind for t in tokens if t.kind in "()[]{}"] + list(closers):
        if k in PAIRS:
            stack.append(PAIRS[k])
        elif not stack or stack.pop() != k:
            return False
    return not stack


def syntax_errors(documents: DataFrame) -> DataFrame:
    """``doc_id, source, file_lang, cost, damage, line``: one row per file that needs repair to parse.

    ``documents`` needs ``doc_id, source, file_lang, text``. Rows whose ``file_lang`` is null or none of LANGUAGES, and
    null or empty texts, are left out. Each file is judged alone and whole, where it is read: nothing is shuffled.
    """

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (d, s, lang, *found)
                for d, s, lang, text in zip(batch.doc_id, batch.source, batch.file_lang, batch.text, strict=True)
                if (found := repair(text, lang))[0]
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "source", "file_lang", "cost", "damage", "line"])

    types = dict(documents.dtypes)
    return (
        documents.select("doc_id", "source", "file_lang", "text")
        .where(F.col("file_lang").isin(*LANGUAGES) & (F.col("text") != ""))
        .mapInPandas(judge, f"doc_id {types['doc_id']}, source {types['source']}, file_lang string, cost int, damage string, line int")
    )


def syntax_rates(documents: DataFrame, errors: DataFrame) -> DataFrame:
    """``source, file_lang, files, broken, rate`` over the non-empty code files; counted per task before the shuffle."""
    files = documents.where(F.col("file_lang").isin(*LANGUAGES) & (F.col("text") != "")).select(
        "source", "file_lang", F.lit(1).alias("files"), F.lit(0).alias("broken")
    )
    broken = errors.select("source", "file_lang", F.lit(0).alias("files"), F.lit(1).alias("broken"))
    return (
        files.union(broken)
        .groupBy("source", "file_lang")
        .agg(F.sum("files").alias("files"), F.sum("broken").alias("broken"))
        .withColumn("rate", F.col("broken") / F.col("files"))
    )
