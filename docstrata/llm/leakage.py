"""Evaluation passages inside documents: BM25 retrieval of test items by block-max WAND, then verification of question and
passage apart."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
K1, B = 1.2, 0.75
#: Items per block.
BLOCK = 16
#: The index is sent to every executor, so the items of one index may hold at most so many characters (its size is linear
#: in them, about eight times as many bytes); more items are indexed in several parts, each asked with all documents.
INDEX_CHARS = 4_000_000
#: Passages whose answers a task remembers, and that are looked up at once.
MEMO, PASSAGES = 200_000, 1_000


def words(text: str) -> list[str]:
    """Maximal runs of letters, digits or underscores, in lower case."""
    return WORD.findall(text.lower())


def question_words(text: str) -> int:
    """How many words of an item are its question: those up to the first end of a sentence that more text follows."""
    end = re.search(r"[.?!:](?=\s+\w)", text)
    return len(words(text[: end.end()])) if end else 0


def _spread(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges from ``begins`` to ``ends``, and which range each is of."""
    sizes = ends - begins
    which = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + begins[which], which


@dataclass
class ItemIndex:
    """Inverted index of test items with BM25 impacts: posting lists, and over them lists of block maxima.

    ``terms`` numbers the words from 1 (0: in no item). Term ``t`` has the items ``item[at[t]:at[t+1]]`` with their score
    shares ``impact``, and the blocks of BLOCK items ``block[block_at[t]:block_at[t+1]]`` with their largest shares
    ``block_max``; ``upper[t]`` is the largest of all. ``need[i]`` is the least score of a passage that holds ``run``
    consecutive words of item i, the threshold at which retrieval is complete. Items are ordered by it, so that a block's
    first need fits all of its items. Items of fewer words can't leak and are left out.
    """

    run: int
    terms: dict[str, int]
    at: np.ndarray
    item: np.ndarray
    impact: np.ndarray
    block_at: np.ndarray
    block: np.ndarray
    block_max: np.ndarray
    #: Term and item, term and block of each place in one number, ascending.
    item_key: np.ndarray
    block_key: np.ndarray
    upper: np.ndarray
    need: np.ndarray
    ids: list[int]
    #: Word numbers of all items one after the other, where each item's begin, and how many are its question's.
    numbers: np.ndarray
    begins: np.ndarray
    asked: np.ndarray

    @classmethod
    def build(cls, rows: list[tuple[int, str]], run: int) -> ItemIndex:
        kept = sorted((i, w, question_words(t)) for i, t in rows if t is not None and len(w := words(t)) >= run)
        average = sum(len(w) for _, w, _ in kept) / max(1, len(kept))
        terms: dict[str, int] = {}
        numbered = [np.array([terms.setdefault(x, len(terms) + 1) for x in w], dtype=np.int32) for _, w, _ in kept]
        counts = [np.unique(n, return_counts=True) for n in numbered]
        held = np.zeros(len(terms) + 2)
        for t, _ in counts:
            held[t] += 1
        idf = np.log(1 + (len(kept) - held + 0.5) / (held + 0.5))
        share = np.zeros(len(terms) + 1)
        items = []
        for (ident, w, asked), n, (t, tf) in zip(kept, numbered, counts, strict=True):
            share[t] = impact = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / average))
            along = np.concatenate([[0.0], np.cumsum(share[n])])
            items.append((float((along[run:] - along[:-run]).min()) * (1 - 1e-6), ident, t, impact.astype(np.float32), n, asked))
        items.sort(key=lambda x: x[:2])
        term = np.concatenate([[0], *[x[2] for x in items]]).astype(np.int64)[1:]
        place = np.repeat(np.arange(len(items)), [len(x[2]) for x in items])
        impact = np.concatenate([np.zeros(1, np.float32), *[x[3] for x in items]])[1:]
        order = np.lexsort((place, term))
        term, place, impact = term[order], place[order], impact[order]
        first = np.flatnonzero(np.diff(term, prepend=-1) | np.diff(place // BLOCK, prepend=-1))
        maxima = np.maximum.reduceat(impact, first) if len(first) else impact
        upper = np.zeros(len(terms) + 1)
        np.maximum.at(upper, term, impact)
        numbers = range(len(terms) + 2)
        return cls(
            run, terms, np.searchsorted(term, numbers), place, impact, np.searchsorted(term[first], numbers), place[first] // BLOCK, maxima,
            term * len(items) + place, term[first] * -(-len(items) // BLOCK) + place[first] // BLOCK, upper,
            np.array([x[0] for x in items]), [x[1] for x in items], np.concatenate([np.zeros(0, np.int32), *[x[4] for x in items]]),
            np.concatenate([[0], np.cumsum([len(x[4]) for x in items])]).astype(np.int64), np.array([x[5] for x in items]),
        )

    def retrieved(self, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(passage, item)`` places of the items whose score for a passage (a row of terms) reaches their need: block-max
        WAND, for many passages at once.

        A passage's terms are taken in the order of their upper bounds; those whose bounds together stay below the least
        need of all can't bring an item in alone, so only blocks in the lists of the other terms (from the pivot on) are
        looked at. Of these only blocks whose maxima reach their need are scored, item by item.
        """
        upper = self.upper[passages]
        order = np.argsort(upper, axis=1, kind="stable")
        ranked = np.take_along_axis(passages, order, axis=1)
        wanted = np.cumsum(np.take_along_axis(upper, order, axis=1), axis=1) >= self.need[0]
        row, column = np.nonzero(wanted)
        place, which = _spread(self.block_at[ranked[row, column]], self.block_at[ranked[row, column] + 1])
        blocks = -(-len(self.need) // BLOCK)
        pairs = np.unique(row[which] * blocks + self.block[place])
        row, block = pairs // blocks, pairs % blocks
        lists = passages[row] * blocks + block[:, None]
        at = np.minimum(np.searchsorted(self.block_key, lists), len(self.block_key) - 1)
        bound = np.where(self.block_key[at] == lists, self.block_max[at], 0).sum(axis=1)
        kept = bound >= self.need[block * BLOCK] * (1 - 1e-6)
        row, block = row[kept], block[kept]
        lists = (passages[row] * len(self.need) + block[:, None] * BLOCK).ravel()
        ends = np.minimum(block * BLOCK + BLOCK, len(self.need))
        place, which = _spread(np.searchsorted(self.item_key, lists), np.searchsorted(self.item_key, (passages[row] * len(self.need) + ends[:, None]).ravel()))
        pair = which // passages.shape[1]
        score = np.bincount(pair * BLOCK + self.item[place] % BLOCK, self.impact[place], minlength=len(row) * BLOCK).reshape(-1, BLOCK)
        need = np.append(self.need, np.full(BLOCK, np.inf))[block[:, None] * BLOCK + np.arange(BLOCK)]
        pair, inner = np.nonzero(score >= need)
        return row[pair], block[pair] * BLOCK + inner

    def overlap(self, item: int, passage: np.ndarray) -> int:
        """Where a passage stands in an item: 1 in its question, 2 in what follows, 3 across or in both, 0 nowhere."""
        low, high = self.begins[item], self.begins[item + 1]
        found = 0
        for i in (low + np.flatnonzero(self.numbers[low : high - self.run + 1] == passage[0])).tolist():
            if np.array_equal(self.numbers[i : i + self.run], passage):
                begin, end, asked = i - low, i - low + self.run, self.asked[item]
                found |= 1 if end <= asked else 2 if begin >= asked else 3
        return found

    def leaks(self, text: str, memo: dict[bytes, list[tuple[int, int]]] | None = None) -> dict[int, int]:
        """The items of which ``text`` holds ``run`` consecutive words, with where (see ``overlap``).

        Every ``run`` words of the text are a query; one with a word that no item has can't be an item's run, nor one whose
        upper bounds together don't reach the least need. The items that the rest retrieve are verified word by word,
        question and passage apart.
        """
        get = self.terms.get
        terms = np.array([get(w, 0) for w in words(text)], dtype=np.int64)
        if len(terms) < self.run or not len(self.need):
            return {}
        total = np.concatenate([[0.0], np.cumsum(self.upper[terms])])
        known = np.concatenate([[0], np.cumsum(terms > 0)])
        right = (known[self.run :] - known[: -self.run] == self.run) & (total[self.run :] - total[: -self.run] >= self.need[0] * (1 - 1e-9))
        memo = {} if memo is None else memo
        if len(memo) > MEMO:
            memo.clear()
        passages = np.lib.stride_tricks.sliding_window_view(terms, self.run)[right]
        keys = [p.tobytes() for p in passages]
        new = {key: i for i, key in enumerate(keys) if key not in memo}
        fresh = list(new.values())
        for some in (fresh[i : i + PASSAGES] for i in range(0, len(fresh), PASSAGES)):
            for i in some:
                memo[keys[i]] = []
            for row, item in zip(*map(np.ndarray.tolist, self.retrieved(passages[some])), strict=True):
                if where := self.overlap(item, passages[some[row]]):
                    memo[keys[some[row]]].append((self.ids[item], where))
        out: dict[int, int] = {}
        for key in keys:
            for ident, where in memo[key]:
                out[ident] = out.get(ident, 0) | where
        return out


def _parts(items: DataFrame, chars: int) -> list[list[tuple[int, str]]]:
    """The items, in parts of at most ``chars`` characters (or one item), read one part at a time by id range."""
    size = F.coalesce(F.length("text"), F.lit(0))
    total = items.agg(F.sum(size)).first()[0] or 0
    if total <= chars:
        return [[(r.item_id, r.text) for r in items.select("item_id", "text").collect()]]
    n = -(-2 * total // chars)
    cuts = items.approxQuantile("item_id", [i / n for i in range(1, n)], 0.0)
    edges = [None, *sorted(set(cuts)), None]
    parts = []
    for low, high in zip(edges, edges[1:], strict=False):
        part = items if low is None else items.where(F.col("item_id") > low)
        part = part if high is None else part.where(F.col("item_id") <= high)
        parts.append([(r.item_id, r.text) for r in part.select("item_id", "text").collect()])
    return parts


def leaked_items(documents: DataFrame, items: DataFrame, run: int = 12, index_chars: int = INDEX_CHARS) -> DataFrame:
    """``doc_id, item_id, in_question, in_passage``: the documents that hold at least ``run`` consecutive words of an item's
    text, the item, and whether such words stand in its question and in what follows it.

    Every passage of ``run`` words of every document is a query against the BM25 index of the items. All items are
    retrieved whose score is at least the least score that any run of their own words brings, so retrieval loses none,
    and each is verified on its words. Documents are not shuffled: the index goes to them, in parts of bounded size.

    Null and empty texts hold nothing; items shorter than ``run`` words can't leak; items of equal text all come out;
    rows of one doc_id count together. Empty inputs give an empty result.
    """
    spark, out = documents.sparkSession, None
    id_type = dict(documents.dtypes)["doc_id"]
    texts = documents.select("doc_id", "text").where("text IS NOT NULL")
    for part in _parts(items.where("item_id IS NOT NULL"), index_chars):
        index = spark.sparkContext.broadcast(ItemIndex.build(part, run))

        def search(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            memo: dict[bytes, list[tuple[int, int]]] = {}
            for batch in batches:
                rows = [(d, i, bool(w & 1), bool(w & 2)) for d, t in zip(batch.doc_id, batch.text, strict=True) for i, w in sorted(index.value.leaks(t, memo).items())]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "in_question", "in_passage"])

        found = texts.mapInPandas(search, f"doc_id {id_type}, item_id {dict(items.dtypes)['item_id']}, in_question boolean, in_passage boolean")
        out = found if out is None else out.union(found)
    return out.groupBy("doc_id", "item_id").agg(F.max("in_question").alias("in_question"), F.max("in_passage").alias("in_passage"))
