"""Line-accurate chunks of text and of C functions."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame

_CJK = re.compile("[　-鿿가-힯]")
_LINE = re.compile(r"[^\n]*\n|[^\n]+$")
#: Lengths are counted in UTF-16 units; the share of CJK in the first SAMPLE units decides the sizes.
SAMPLE, WIDE_SHARE, WIDE, NARROW = 16_384, 0.15, (600, 700), (1_400, 1_800)


def _units(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-16-le", "surrogatepass")) // 2


def _cut(text: str, units: int) -> str:
    """The longest start of ``text`` of at most ``units`` UTF-16 units."""
    if len(text) * 2 <= units or text.isascii():
        return text[:units]
    taken = 0
    for i, c in enumerate(text):
        taken += 1 + (c > "￿")
        if taken > units:
            return text[:i]
    return text


def sizes(text: str) -> tuple[int, int]:
    """Target and limit of a text's chunks."""
    sample = _cut(text, SAMPLE)
    return WIDE if len(_CJK.findall(sample)) / max(_units(sample), 1) >= WIDE_SHARE else NARROW


def pieces(text: str, target: int) -> list[tuple[str, int, bool, bool]]:
    """Lines as ``(text, line, begins, ends)``; a line longer than ``target`` is cut into pieces of that length."""
    out = []
    for number, match in enumerate(_LINE.finditer(text)):
        rest, first = match[0], True
        while rest:
            head = _cut(rest, target)
            rest = rest[len(head) :]
            out.append((head, number, first, not rest))
            first = False
    return out


def chunk_text(text: str, first_line: int = 1) -> list[tuple[str, int, int]]:
    """``(text, start line, end line)`` of consecutive chunks.

    A chunk takes pieces until it has the target length or the next one would pass the limit, at least one. The next
    chunk repeats the last two lines if they are whole, shorter than the target, leave room for one more piece, and are
    not all of the chunk. Blank chunks are left out.
    """
    target, limit = sizes(text)
    units = pieces(text, target)
    lines = [u[1] for u in units]
    upto = [0, *accumulate(_units(u[0]) for u in units)]  # length before each piece
    n, out, start = len(units), [], 0
    while start < n:
        reached = bisect_left(upto, upto[start] + target)
        within = bisect_right(upto, upto[start] + limit) - 1
        end = min(n, max(start + 1, min(reached, within)))
        body = "".join(u[0] for u in units[start:end])
        if body.strip():
            out.append((body, lines[start] + first_line, lines[end - 1] + first_line))
        two = bisect_left(lines, lines[end - 1] - 1)  # where the last two lines begin
        again = upto[end] - upto[two]
        room = end < n and again < target and upto[end + 1] - upto[two] <= limit
        start = two if room and two > start and units[two][2] and units[end - 1][3] else end
    return out


_SKIP = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|(?m:^[ \t]*\#(?:[^\n\\]|\\\n|\\.)*)")
_MARK = re.compile(r"[{}();=]")
_NAME = re.compile(r"(~?[A-Za-z_]\w*)\s*$")
#: Words before a bracket that don't name a function, and what opens a block whose functions count.
NO_NAMES = frozenset("if while for switch return sizeof catch do else defined alignof decltype __attribute__ __declspec".split())
_HOLDER = re.compile(r"^\s*(?:inline\s+)?namespace\b[^()]*$|^\s*extern\s*$")


def functions(text: str) -> list[tuple[int, int, str]] | None:
    """``(start, end, name)`` of the C or C++ functions outside of other blocks, but for namespaces and ``extern "C"``; None
    if brackets don't close (then lines are used).

    One pass over brackets and semicolons: what stands between the end of the last declaration and a block is its head, and
    the head of a function names it before its first bracket and assigns nothing.
    """
    plain = _SKIP.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    out: list[tuple[int, int, str]] = []
    blocks: list[tuple[str, int, str]] = []  # what each open block is, where its head begins, its name
    head, round_, name = 0, 0, ""
    for m in _MARK.finditer(plain):
        mark, at = m[0], m.start()
        inside = bool(blocks) and blocks[-1][0] != "holder"
        if mark == "{":
            begin = head + len(plain[head:at]) - len(plain[head:at].lstrip())
            kind = "inner" if inside or round_ else "holder" if _HOLDER.match(plain[head:at]) else "function" if name and name != "=" else "other"
            blocks.append((kind, begin, name))
            head, name = at + 1, ""
        elif mark == "}":
            if not blocks or round_ and not inside:
                return None
            kind, begin, named = blocks.pop()
            if kind == "function":
                out.append((begin, at + 1, named))
            if not blocks or blocks[-1][0] == "holder":
                head, name, round_ = at + 1, "", 0
        elif inside:
            continue
        elif mark == "(":
            if not round_ and not name:
                found = _NAME.search(plain, head, at)
                name = found[1] if found and found[1] not in NO_NAMES else ""
            round_ += 1
        elif mark == ")":
            round_ = max(0, round_ - 1)
        elif not round_:
            if mark == "=" and not plain.endswith("operator", head, at):
                name = "="  # an initializer, no function
            elif mark == ";":
                head, name = at + 1, ""
    return None if blocks else sorted(out)


def chunk_code(text: str) -> list[tuple[str, int, int, str | None]]:
    """``(text, start line, end line, symbol)``: functions and what stands between them are chunked apart."""
    found = functions(text)
    if not found:
        return [(*c, None) for c in chunk_text(text)]
    out, at = [], 0
    for start, end, name in [*found, (len(text), len(text), "")]:
        for a, b, symbol in ((at, start, None), (start, end, name or None)):
            if text[a:b].strip():
                out += [(*c, symbol) for c in chunk_text(text[a:b], text.count("\n", 0, a) + 1)]
        at = end
    return out


def chunked(documents: DataFrame) -> DataFrame:
    """``doc_id, ordinal, text, start_line, end_line, symbol`` of ``documents`` (``doc_id, text, file_lang``).

    C and C++ are chunked by function, everything else by lines. Null, empty and blank texts have no chunks.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (d, i, *chunk)
                for d, text, lang in zip(batch.doc_id, batch.text, batch.file_lang, strict=True)
                if text
                for i, chunk in enumerate(chunk_code(text) if lang in ("c", "cpp") else [(*c, None) for c in chunk_text(text)])
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "ordinal", "text", "start_line", "end_line", "symbol"])

    kind = dict(documents.dtypes)["doc_id"]
    schema = f"doc_id {kind}, ordinal int, text string, start_line int, end_line int, symbol string"
    return documents.select("doc_id", "text", "file_lang").mapInPandas(run, schema)
