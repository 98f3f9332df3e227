from hypothesis import given, settings
from hypothesis import strategies as st

from docstrata.functions.chunking import chunk_code, chunk_text, chunked, functions, sizes
from docstrata.functions.diff import apply, diff_pairs, hunks, patched

TEXTS = st.text(alphabet="ab \n한😀", max_size=400)


def test_consecutive_chunks_repeat_two_lines():
    text = "".join(f"REG_{i:03d} = 0x{i:04X} ; a register with a comment\n" for i in range(150))
    chunks = chunk_text(text)
    assert len(chunks) > 2
    for (_, _, end), (_, start, _) in zip(chunks, chunks[1:]):
        assert start == end - 1
    assert all(len(c) <= 1800 for c, _, _ in chunks)


def test_long_line_is_lossless():
    text = "x" * 4500
    chunks = chunk_text(text)
    assert "".join(c for c, _, _ in chunks) == text
    assert {(a, b) for _, a, b in chunks} == {(1, 1)}


def test_wide_text_is_cut_smaller_and_pairs_stay_whole():
    text = ("한국어 문장 😀 " * 40 + "\n") * 6
    assert sizes(text) == (600, 700)
    for c, _, _ in chunk_text(text):
        assert len(c.encode("utf-16-le")) // 2 <= 700
        c.encode("utf-8")


@settings(max_examples=80, deadline=None)
@given(TEXTS)
def test_every_line_is_in_a_chunk(text):
    lines = text.split("\n")
    held = set()
    for c, a, b in chunk_text(text):
        held |= set(range(a, b + 1))
        assert c.strip()
    assert {i for i, x in enumerate(lines, 1) if x.strip()} <= held


def test_functions_are_chunked_apart():
    code = "#include <x.h>\n\nstatic int f(int a)\n{\n  return a; /* } */\n}\n\nvoid g(void) {\n}\n"
    assert [n for _, _, n in functions(code)] == ["f", "g"]
    assert [(s, a) for _, a, _, s in chunk_code(code)] == [(None, 1), ("f", 3), ("g", 8)]
    assert functions("int f() { {") is None
    nested = "namespace a {\nnamespace b {\nT C::f(int (*g)(int), U<int> u) const noexcept {\n  if (u) { g(1); }\n}\n}\n}\nextern \"C\" {\nvoid h(void)\n{\n}\n}\n"
    assert [n for _, _, n in functions(nested)] == ["f", "h"]
    others = "struct s { int (*f)(int); };\nint t[] = { 1, 2 };\nauto l = [](int a) { return a; };\nenum e { A };\nbool C::operator==(const C &c) { return true; }\nA::A(int b) : b_(b) {}\n"
    assert [n for _, _, n in functions(others)] == ["A"]
    assert functions("word and word " * 20_000) == []


def test_chunked_edges(spark):
    rows = [(1, None, "c", 9), (2, "", "c", 9), (3, " \n ", None, 9), (4, "one", None, 9), (4, "one", None, 9)]
    got = chunked(spark.createDataFrame(rows, "doc_id long, text string, file_lang string, ordinal int")).collect()
    assert [(r.doc_id, r.ordinal, r.text) for r in got] == [(4, 0, "one")] * 2


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=14), st.lists(st.sampled_from("abc"), max_size=14))
def test_hunks_give_the_second_text_with_fewest_edits(a, b):
    before, after = "\n".join(a), "\n".join(b)
    found, method = hunks(before, after)
    assert method == "myers"
    assert apply(before, found) == after
    a, b = before.split("\n"), after.split("\n")
    common = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            common[i + 1][j + 1] = common[i][j] + 1 if x == y else max(common[i][j + 1], common[i + 1][j])
    assert sum(len(h[2]) + len(h[3]) for h in found) == len(a) + len(b) - 2 * common[-1][-1]


def test_hunk_places_and_numbers():
    found, _ = hunks("head\nbaud 115200\ntail", "head\nbaud 921600 bps\nmore\ntail")
    assert found == [(2, 2, ["baud 115200"], ["baud 921600 bps", "more"], ["115200"], ["921600 bps"])]
    assert hunks("", "") == ([], "myers")
    assert hunks("a", "a\nb")[0] == [(2, 2, [], ["b"], [], [])]


def test_dense_change_is_one_replacement():
    a, b = "\n".join(f"a{i}" for i in range(11_000)), "\n".join(f"b{i}" for i in range(11_000))
    found, method = hunks(a, b)
    assert method == "bounded_replace" and len(found) == 1 and apply(a, found) == b


def test_pairs_in_spark(spark):
    rows = spark.createDataFrame([(1, "a\nb", "a\nc"), (2, None, "x"), (3, "x", None), (4, None, None)], "id int, before string, after string")
    done = diff_pairs(rows).join(rows, "id")
    assert {r.id: r.after for r in patched(done).collect()} == {1: "a\nc", 2: "x", 3: "", 4: ""}
