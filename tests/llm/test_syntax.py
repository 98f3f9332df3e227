import ast
import itertools
import json
import random
import re
import time
import warnings

import pytest

from docstrata.llm.chart import DROP, GROUP, Grammar
from docstrata.llm.syntax import LANGUAGES, balance, repair, syntax_errors, syntax_rates

GOOD = {
    "c": [
        "#include <x.h>\n#define A (1)\nstatic const int t[] = { 1, 2, [3] = 4 };\nint f(int a, const char *b)\n{\n  for (int i = 0; i < 3; i++) { if (a) b++; else return (int)a; }\n  do { a--; } while (a > 0);\n  switch (a) { case 1: break; default: a = b ? 1 : 2; }\n  return sizeof(int) + f(a, \"x\" \"y\");\n}\n",
        "typedef struct s { int a : 3; struct s *next; } s_t;\nenum e { A, B = 2 };\nextern int g(void);\nint (*h)(int);\n/* only ' a comment */\n",
        "union u { float f; unsigned char b[4]; };\nvoid z(void) { label: goto label; ; }\n",
        "",
    ],
    "cpp": [
        "namespace a { class B : public C { public: B() : x_(0) {} ~B(); virtual int f() const override; private: int x_; }; }\n",
        "template <typename T> T max(T a, T b) { return a > b ? a : b; }\nusing std::string;\nauto f = [&](int a) { return a + 1; };\n",
        "class A final : public B { void f() const noexcept override; void g() override {} };\nint f(int final) { if (final > 3) final += 1; return final; }\n",
        "int main() { std::vector<int> v{1, 2}; for (auto &x : v) std::cout << x << std::endl; try { throw 1; } catch (...) {} return 0; }\n",
    ],
    "javascript": [
        "'use strict';\nconst a = require('x')\nfunction f(a, b = 2, ...c) {\n  let x = a > b ? { k: 1, [a]: 2, m() { return 1; } } : [1, , 2]\n  return x\n}\nmodule.exports = { f, a: 1, };\n",
        "!function(){var e=function(a,b){for(;a<1;)b++};if(e)e();else{}}();\nclass A extends B { #p = 1; static get x() { return /a[/]b/g.test(`t${1}`); } async *g() {} }\n",
        "import x, { y as z } from 'q';\nexport default async (a) => { await a?.b; };\n[1, 2].forEach((q) => {\n  q ^= 1;\n});\n",
    ],
    "json": ['{"a": [1, -2.5e3, true, null, {}], "b": "x\\n"}', "3"],
    "python": [
        "@d\nclass A(B, metaclass=C):\n    x: int = 1\n    async def f[T](self, /, a=1, *b, c, **d) -> int:\n        async with a as b, c: pass\n        return [x async for x in y if z]\n",
        "try:\n    a, *b = c = d[1:2, ...]\nexcept* E as e:\n    raise X from e\nelse: pass\nfinally:\n    del a, b[0]\n",
        "x = f'{a!r:>{w}} {b[\"k\"]}' \"y\" if (n := 1) else lambda *a, k=2: (yield)\nmatch p:\n    case A(x=1, y=[*_]) | {'k': 1, **r} if r: pass\n    case _: ...\n",
        "def f(a, *, b=1):\n    return {a: [b]}\n", "match x:\n    case 1: pass\n"],
}
BAD = {
    "c": [("int f(void) {\n  return 1;\n", "truncation"), ("<<<<<<< HEAD\nint a;\n=======\nint b;\n>>>>>>> x\n", "conflict"), ("# Heading\n\nSome “prose” here, that’s no code.\n", None), ('{ "a": 1 }', None), ("int a = ;", None), ("namespace a { int b; }", None), ("int f(int a) { return a }", None), ("/* open", None), ("void f(void) { else x(); }", None), ("int a b;", None), ("void f(void) { do x(); }", None), ("int a = 09;", None)],
    "cpp": [("class A { int f( ; };", None), ("def f(a):\n    return a\n", None), ("void f() { try { g(); } }", None)],
    "javascript": [("else;", None), ("const a;", None), ("try { }", None), ('{ "a": 1 }', None), ("x = `a${1 +}`", None), ("function f() {\n  return 1;\n", "truncation"), ("#include <x.h>\nint a;", None), ("let a = ;", None), ("f(1, 2", None), ("if (a { b }", None)],
    "json": [('{"a": 1,}', None), ("{'a': 1}", None), ('{"a": NaN}', None), ('{"a": [1, 2', "truncation"), ("a: 1\nb: 2\n", None)],
    "python": [("def f(:\n  pass", None), ("if x:\n", None), ("x = (1,\n", None), ("  x = 1\n", None), ("f(a=1, b)\n", None), ("f() = 1\n", None), ("x = f'{a b}'\n", None), ("b'é'\n", None), ("if x:\n    a\n  b\n", None), ("a + not b\n", None), ("0777\n", None), ("a\n<<<<<<< HEAD\nb\n", "conflict")],
}


@pytest.mark.parametrize(("lang", "text"), [(k, t) for k, ts in GOOD.items() for t in ts])
def test_valid_files_need_no_repair(lang, text):
    assert repair(text, lang) == (0, "", 0)


@pytest.mark.parametrize(("lang", "text", "damage"), [(k, t, d) for k, ts in BAD.items() for t, d in ts])
def test_invalid_files_do(lang, text, damage):
    cost, found, line = repair(text, lang)
    assert cost > 0 and line > 0 and found in ("truncation", "conflict", "mismatch", "local")
    assert damage in (None, found)


def least_edits(s):
    """Least edits to balance ``s`` where a bracket is deleted or takes another's shape, by search."""
    pairs = {"(": ")", "[": "]", "{": "}"}
    memo = {"": 0}

    def best(s):
        if s not in memo:
            found = 1 + best(s[1:])
            for k in range(1, len(s) if s[0] in pairs else 0):
                if s[k] not in pairs:
                    found = min(found, (pairs[s[0]] != s[k]) + best(s[1:k]) + best(s[k + 1 :]))
            memo[s] = found
        return memo[s]

    return best(s)


def test_brackets_need_the_fewest_edits():
    for n in range(7):
        for s in itertools.product("()[}", repeat=n):
            s = "".join(s)
            cost, edits = balance(s)
            assert cost == least_edits(s) == len(edits)
            left = "".join(edits.get(i, b) for i, b in enumerate(s))
            assert balance(left) == (0, {})
    assert balance("(" * 5_000)[0] == 5_000


def test_many_brackets_need_the_fewest_edits_too():
    for n in (900, 1_500, 4_000):
        assert balance("(" * n + "[" + ")" * n) == (1, {n: ""})
    for n in (2, 1_500):
        text = "([)]" * n
        cost, edits = balance(text)
        assert cost == len(edits) == 3 * n // 2 and balance("".join(edits.get(i, b) for i, b in enumerate(text))) == (0, {})
    assert least_edits("([)]" * 2) == 3
    assert repair("int a = " + "(" * 1_200 + "[" + "1" + ")" * 1_200 + ";", "c")[0] == 1


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_chart_costs_are_least():
    """Against the edit distance to all short sentences of a grammar that is ambiguous, nested and recursive."""
    grammar = Grammar("S = E ';'\nE = T ('+' T)*\nT = 'n' | '-' T | 'l' E 'r' | E '!'\n", {})
    a = {t: grammar.code(t) for t in (";", "+", "n", "-", "l", "r", "!")}
    names = {c: t for t, c in a.items()}
    sentences, todo = set(), {("S",)}
    rules = {"S": ["E;"], "E": ["T", "T+E"], "T": ["n", "-T", "lEr", "E!"]}
    while todo:
        new = set()
        for s in todo:
            at = next((i for i, x in enumerate(s) if x in rules), None)
            if at is None:
                sentences.add("".join(s))
                continue
            for right in rules[s[at]]:
                t = s[:at] + tuple(right) + s[at + 1 :]
                if len(t) <= 7:
                    new.add(t)
        todo = new - todo
    rnd = random.Random(7)
    for _ in range(300):
        text = "".join(rnd.choice(list(a)) for _ in range(rnd.randrange(1, 5)))
        want = min(DROP, min(distance(text, s) for s in sentences))
        assert grammar.least("".join(a[t] for t in text), "S", DROP) == want, (text, names)


def test_groups_are_mended_inside_or_replaced_whole():
    assert repair("int f(void) { int a = ; g(1 2); }", "c")[0] == 2
    assert repair("void f(void) { if (int a, int b) g(); }", "c")[0] == GROUP


def test_in_spark(spark):
    rows = [(1, "s", "c", "int a;", 0), (2, "s", "c", "int a", 0), (3, "s", None, "x(", 0), (4, "s", "c", None, 0), (5, "s", "c", "", 0), (6, None, "rust", "x(", 0), (2, "s", "c", "int a", 0)]
    table = spark.createDataFrame(rows, "doc_id long, source string, file_lang string, text string, cost int")
    found = syntax_errors(table)
    assert [r.doc_id for r in found.collect()] == [2, 2]
    assert [tuple(r) for r in syntax_rates(table, found).collect()] == [("s", "c", 3, 2, 2 / 3)]
    assert syntax_errors(table.limit(0)).count() == 0
    assert set(LANGUAGES) == {"c", "cpp", "javascript", "json", "python"}


def test_long_and_deep_texts():
    assert repair("int a;\n" * 20_000, "c")[0] == 0
    assert repair("x = " + "(" * 3_000 + ")" * 3_000, "python")[0] == 0
    assert repair("(" * 3_000, "javascript")[0] > 0
    assert repair("x = " + "[" * 500 + "]" * 500, "json")[0] > 0
    assert repair("int a[] = {" + "1, -2, " * 30_000 + "};", "c")[0] == 0
    assert repair("int a[] = {" + "1, -2, " * 3_000 + "1 2};", "c")[0] == 1


def test_broken_files_take_little_time():
    for lang, text in [
        ("c", "void f(void)\n{\n" + "  f(x);\n" * 1_000 + "  int a = ;\n}\n"),
        ("cpp", "void f()\n{\n" + "  f(x);\n" * 1_000 + "  a::b<c> d = ;\n}\n"),
        ("javascript", "function f() {\n" + "  f(x)\n" * 1_000 + "  let a = ;\n}\n"),
        ("c", "word and word, then (more) words. " * 1_000),
        ("python", "word and word, then (more) words. " * 300),
    ]:
        start = time.time()
        assert repair(text, lang)[0] > 0
        assert time.time() - start < 5


def parses(text, lang):
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text) if lang == "python" else json.loads(text, parse_constant=lambda name: int(name))
    except (SyntaxError, ValueError):
        return False
    return True


def test_edited_files_are_judged_as_parsers_do():
    """Files of the standard library's tests of itself, and JSON, with one token lost, doubled, moved or all after it cut."""
    rnd = random.Random(3)
    sources = [("python", open(f.__file__, encoding="utf-8").read()[:20_000]) for f in (ast, json, random, re)]
    sources = [(lang, text[: text.rindex("\ndef ")] if "\ndef " in text else text) for lang, text in sources]
    sources.append(("json", json.dumps({"a": [1, -2.5, None, {"b": "x\\n"}], "c": {}}, indent=1)))
    for lang, text in sources:
        assert parses(text, lang) == (repair(text, lang)[0] == 0)
        tokens = list(re.finditer(r"\w+|\S|\n *", text))
        for kind in [0, 1, 2, 3] * 12:
            m, other = rnd.choice(tokens), rnd.choice(tokens)
            changed = text[: m.start()] + ("", f"{m[0]} {m[0]}", other[0], "")[kind] + (text[m.end() :] if kind < 3 else "")
            assert parses(changed, lang) == (repair(changed, lang)[0] == 0), changed[max(0, m.start() - 80) : m.start() + 80]


def test_every_statement_to_mend_counts():
    assert repair("int a = ;\n" * 5, "c") == (5, "mismatch", 1)
    assert repair("int f(void)\n{\n  int a = ;\n" + "  f();\n" * 20 + "  int b = ;\n  return a;\n}\n", "c") == (2, "local", 3)
    assert repair("int a = ;\n" + "int b;\n" * 20 + "int f(void) {\n", "c")[0] == 2
    assert repair('{"a": 1, "b" 2, "c": [1, , 2]}', "json")[0] == 2
    assert repair("let a = ;\n" + "f(1)\n" * 20 + "let b = ;\n", "javascript")[0] == 2
    assert repair("def f(a):\n    return a\n" + "x = y in z\n" * 20 + "say it out loud\n", "python")[0] == 2


def test_branches_of_the_preprocessor():
    assert repair("void f(void) {\n#ifdef A\n  if (a) {\n#else\n  if (b) {\n#endif\n    g();\n  }\n}\n", "c")[0] == 0
    assert repair("#if A\nint a = ;\n#else\nint a = ;\n#endif\n", "c")[0] == 2
