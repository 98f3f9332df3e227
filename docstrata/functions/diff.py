"""Line differences between two texts: shortest edit scripts, as hunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from docstrata.functions.text import NUMBER

#: Beyond so many changed lines, edits or steps a text is one replaced hunk: the work for a pair is bounded.
LINES, EDITS, STEPS = 20_000, 1_000, 500_000
_NUMBER = re.compile(NUMBER)
HUNK = (
    "struct<before_start:int,after_start:int,removed:array<string>,added:array<string>,"
    "numbers_before:array<string>,numbers_after:array<string>>"
)


def _frontier(a: list[str], b: list[str]) -> list[dict[int, int]] | None:
    """Myers' furthest reaching points by number of edits, up to the one that ends both texts; None if too dense."""
    reach, history, steps = {1: 0}, [], 0
    for edits in range(min(len(a) + len(b), EDITS) + 1):
        history.append(dict(reach))
        for diagonal in range(-edits, edits + 1, 2):
            down = diagonal == -edits or diagonal != edits and reach.get(diagonal - 1, -1) < reach.get(diagonal + 1, -1)
            x = reach.get(diagonal + 1, 0) if down else reach.get(diagonal - 1, 0) + 1
            start = x
            while x < len(a) and x - diagonal < len(b) and a[x] == b[x - diagonal]:
                x += 1
            steps += 1 + x - start
            if steps > STEPS:
                return None
            reach[diagonal] = x
            if x >= len(a) and x - diagonal >= len(b):
                return history
    return None


def _kept(a: list[str], b: list[str]) -> list[tuple[int, int]] | None:
    """The pairs of equal lines that a shortest edit script keeps, or None if the texts differ too densely."""
    history = _frontier(a, b)
    if history is None:
        return None
    pairs, x, y = [], len(a), len(b)
    for edits in range(len(history) - 1, -1, -1):
        reach, diagonal = history[edits], x - y
        down = diagonal == -edits or diagonal != edits and reach.get(diagonal - 1, -1) < reach.get(diagonal + 1, -1)
        origin = diagonal + 1 if down else diagonal - 1
        before = reach.get(origin, 0) if edits else 0
        floor = (before if down else before + 1) if edits else 0
        while x > floor:
            x, y = x - 1, y - 1
            pairs.append((x, y))
        if edits:
            x, y = before, before - origin
    return pairs[::-1]


def hunks(before: str, after: str) -> tuple[list[tuple], str]:
    """``(hunks, method)``: each hunk is first line before and after (from 1), lines removed and added, and their numbers.

    Equal ends are set aside first. Method is ``myers``, or ``bounded_replace`` where the rest is one replaced hunk.
    """
    if before == after:
        return [], "myers"
    a, b = before.split("\n"), after.split("\n")
    head = next((i for i, (p, q) in enumerate(zip(a, b, strict=False)) if p != q), min(len(a), len(b)))
    most = min(len(a), len(b)) - head
    tail = next((i for i in range(most) if a[-1 - i] != b[-1 - i]), most)
    left, right = a[head : len(a) - tail], b[head : len(b) - tail]
    kept = _kept(left, right) if len(left) + len(right) <= LINES else None
    method = "bounded_replace" if kept is None else "myers"
    out, i, j = [], 0, 0
    for x, y in [*(kept or []), (len(left), len(right))]:
        if x > i or y > j:
            removed, added = left[i:x], right[j:y]
            out.append((head + i + 1, head + j + 1, removed, added, _numbers(removed), _numbers(added)))
        i, j = x + 1, y + 1
    return out, method


def _numbers(lines: list[str]) -> list[str]:
    return list(dict.fromkeys(_NUMBER.findall("\n".join(lines))))


def apply(before: str, changes: list[tuple]) -> str:
    """The text after the hunks."""
    lines, out, at = before.split("\n"), [], 0
    for start, _, removed, added, *_ in changes:
        out += lines[at : start - 1] + list(added)
        at = start - 1 + len(removed)
    return "\n".join(out + lines[at:])


def diff_pairs(pairs: DataFrame) -> DataFrame:
    """``id, hunks, method`` of ``pairs`` (``id, before, after``); a null side counts as an empty text.

    Each pair is compared where it is: no shuffle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [hunks(a or "", b or "") for a, b in zip(batch.before, batch.after, strict=True)]
            yield pd.DataFrame({"id": batch.id, "hunks": [h for h, _ in found], "method": [m for _, m in found]})

    kind = dict(pairs.dtypes)["id"]
    return pairs.select("id", "before", "after").mapInPandas(run, f"id {kind}, hunks array<{HUNK}>, method string")


def patched(pairs: DataFrame) -> DataFrame:
    """``id, after`` of ``pairs`` (``id, before, hunks``): the texts after their hunks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [apply(a or "", [tuple(h.values()) for h in hs]) for a, hs in zip(batch.before, batch.hunks, strict=True)]
            yield pd.DataFrame({"id": batch.id, "after": texts})

    return pairs.select("id", "before", "hunks").mapInPandas(run, f"id {dict(pairs.dtypes)['id']}, after string")
