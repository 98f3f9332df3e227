"""Keyword answers to a whole table of questions at once, without a shuffle of hits."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docstrata.common import cut_lineage
from docstrata.functions.text import fold, query_words, tokens
from docstrata.operators.search import BLOCK, K1, LEAST_IDF, TITLE_WEIGHT, B

#: Different words whose beginnings a task remembers, and rows of hits that it hands on at once.
MEMO, SENT = 500_000, 200_000
#: What ``_frequencies`` adds to a chunk.
COUNTED = ["dl", "prefixes", "f"]


class Asked:
    """Questions (``query``, ``text``) against all of ``chunks`` (``chunk_id``, unique, ``title``, ``text`` and what else goes along).

    Scores are those of ``search.answers``, but no index is written and nothing of the size of the hits is shuffled: a
    chunk's words are counted once where it is read, ``rows`` keeps of them what some question asks for, and questions go
    to the rows in blocks. The driver sees the questions' words and one number for each different word.
    """

    def __init__(self, chunks: DataFrame, questions: DataFrame):
        words = questions.select("query", F.explode(query_words(fold(F.coalesce("text", F.lit(""))))).alias("prefix")).distinct().toArrow()
        query, prefix = _encoded(words["query"]), _encoded(words["prefix"])
        asker = query.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(asker, kind="stable")
        self.spark, self.query_type, self.queries = chunks.sparkSession, dict(questions.dtypes)["query"], query.dictionary
        self.asked = prefix.indices.to_numpy(zero_copy_only=False)[order]
        self.begins = np.searchsorted(asker[order], np.arange(len(self.queries) + 1))
        self.rows = cut_lineage(_frequencies(chunks, prefix.dictionary.to_pylist()))
        total = self.rows.agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("words")).first()
        self.mean = (total.words or 0) / max(1, total.n) or 1.0
        d = np.zeros(len(prefix.dictionary))
        held = self.rows.select(F.explode("prefixes").alias("p")).groupBy("p").count().toArrow()
        d[held["p"].to_numpy()] = held["count"].to_numpy()
        self.idf = np.maximum(np.log((total.n - d + 0.5) / (d + 0.5)), LEAST_IDF) if total.n else d

    def hits(self) -> DataFrame:
        """Every hit: ``query, score`` and the chunk's columns."""
        return self._scored(self.rows, None).drop("place_score")

    def best(self, k: int, *order: str, rows: DataFrame | None = None) -> DataFrame:
        """The first ``k`` hits of each question with their ``rank``: by score, then ``order``, columns of ``rows`` (``self.rows``,
        maybe joined with others). A task hands on ``k`` hits of each question."""
        rows = (self.rows if rows is None else rows).sortWithinPartitions(*order)
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("place_score"), *order))
        return self._scored(rows, k).withColumn("rank", rank).where(F.col("rank") <= k).drop("place_score")

    def _scored(self, rows: DataFrame, k: int | None) -> DataFrame:
        kept = [c for c in rows.columns if c not in COUNTED]
        schema = ", ".join([f"query {self.query_type}", "score double", "place_score double", *_columns(rows, kept)])
        found = []
        for a in range(0, len(self.queries), BLOCK):
            begins = self.begins[a : a + BLOCK + 1]
            block = (self.queries[a : a + BLOCK], begins - begins[0], self.asked[begins[0] : begins[-1]], self.idf, self.mean)
            shared = self.spark.sparkContext.broadcast(block)
            found.append(rows.select(*kept, *COUNTED).mapInArrow(_scorer(shared, k), schema))
        return reduce(DataFrame.union, found) if found else self.spark.createDataFrame([], schema)


def _encoded(column: pa.ChunkedArray) -> pa.DictionaryArray:
    return pa.concat_arrays([pa.array([], column.type), *column.chunks]).dictionary_encode(null_encoding="encode")


def _columns(df: DataFrame, names: list[str]) -> list[str]:
    types = dict(df.dtypes)
    return [f"`{c}` {types[c]}" for c in names]


def _nth(many: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of so many things."""
    return np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)


def _frequencies(chunks: DataFrame, prefixes: list[str]) -> DataFrame:
    """``chunks`` without their texts, with ``dl``, the numbers of those ``prefixes`` that some word begins with, and the
    frequency ``f`` of each. Chunks that hold none stay, since they count for the statistics."""
    shared = chunks.sparkSession.sparkContext.broadcast(prefixes)
    kept = [c for c in chunks.columns if c not in ("title", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {p: i for i, p in enumerate(shared.value)}
        lengths, size = sorted({len(p) for p in number}), max(1, len(number))
        known: dict[str, list[int]] = {}
        for batch in batches:
            words = batch.column("words")
            dl = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            titled = batch.column("titled").to_numpy(zero_copy_only=False)
            terms = words.flatten().dictionary_encode()
            if len(known) > MEMO:
                known.clear()
            begun = []
            for t in terms.dictionary.to_pylist():
                found = known.get(t)
                if found is None:
                    found = known[t] = [number[t[:n]] for n in lengths if n <= len(t) and t[:n] in number]
                begun.append(found)
            code = terms.indices.to_numpy(zero_copy_only=False)
            many = np.array([len(b) for b in begun], dtype=np.int64)
            flat = np.array([p for b in begun for p in b], dtype=np.int64)
            starts = np.cumsum(many) - many
            row = np.repeat(np.arange(len(dl)), dl)
            weight = np.where(_nth(dl) < titled[row], TITLE_WEIGHT, 1.0)
            used = np.flatnonzero(many[code])
            many, starts = many[code[used]], starts[code[used]]
            prefix = flat[np.repeat(starts, many) + _nth(many)]
            keys, which = np.unique(np.repeat(row[used], many) * size + prefix, return_inverse=True)
            f = np.bincount(which, weights=np.repeat(weight[used], many), minlength=len(keys))
            ends = pa.array(np.searchsorted(keys, np.arange(len(dl) + 1) * size).astype(np.int32))
            counted = [pa.array(dl.astype(np.int32)), pa.ListArray.from_arrays(ends, pa.array((keys % size).astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(f))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *counted], [*kept, *COUNTED])

    schema = ", ".join([*_columns(chunks, kept), "dl int", "prefixes array<int>", "f array<double>"])
    return (
        chunks.select(*kept, tokens(F.col("title")).alias("t"), tokens(F.col("text")).alias("x"))
        .select(*kept, F.size("t").alias("titled"), F.concat("t", "x").alias("words"))
        .mapInArrow(run, schema)
    )


def _scorer(shared, k: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Scores rows against a block of questions. With ``k``, rows come in the order that decides ties."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, begins, asked, idf, mean = shared.value
        top = _Top(len(queries), k) if k else None
        asker = np.repeat(np.arange(len(queries)), np.diff(begins))
        for batch in batches:
            if not batch.num_rows:
                continue
            rest = batch.drop_columns(COUNTED)
            many, share = _shares(batch, idf, mean)
            found = np.flatnonzero(many[asked])
            held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            waiting = 0
            for words in np.split(found, np.flatnonzero(np.diff(asker[found])) + 1) if len(found) else []:
                score = np.zeros(batch.num_rows)
                for p in asked[words]:
                    where, what = share(p)
                    score[where] += what
                q = asker[words[0]]
                if top:
                    top.add(q, score)
                    continue
                hit = np.flatnonzero(score)
                held.append((np.full(len(hit), q), hit, score[hit]))
                waiting += len(hit)
                if waiting >= SENT:
                    yield _sent(queries, rest, *map(np.concatenate, zip(*held, strict=True)))
                    held, waiting = [], 0
            if held:
                yield _sent(queries, rest, *map(np.concatenate, zip(*held, strict=True)))
            if top:
                top.next(rest)
        if top and top.rows:
            rows = pa.Table.from_batches(top.rows).combine_chunks().to_batches()[0]
            q, place = np.nonzero(top.score)
            for a in range(0, len(q), SENT):
                at = q[a : a + SENT], place[a : a + SENT]
                yield _sent(queries, rows, at[0], top.row[at], top.score[at])

    return run


def _nine(score: np.ndarray) -> np.ndarray:
    """Scores to nine places, by which hits are ordered."""
    return np.floor(score * 1e9 + 0.5) / 1e9


def _sent(queries: pa.Array, rows: pa.RecordBatch, q: np.ndarray, row: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    columns = [queries.take(pa.array(q)), pa.array(score), pa.array(_nine(score)), *[c.take(pa.array(row)) for c in rows.columns]]
    return pa.RecordBatch.from_arrays(columns, ["query", "score", "place_score", *rows.schema.names])


def _shares(batch: pa.RecordBatch, idf: np.ndarray, mean: float) -> tuple[np.ndarray, Callable[[int], tuple]]:
    """How many of the rows hold each prefix, and what it gives to which of them (to all, if many do)."""
    n, held = batch.num_rows, batch.column("prefixes")
    prefix = held.flatten().to_numpy(zero_copy_only=False)
    f = batch.column("f").flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(n), held.value_lengths().to_numpy(zero_copy_only=False))
    norm = K1 * (1 - B + B * batch.column("dl").to_numpy(zero_copy_only=False) / mean)
    share = idf[prefix] * f * (K1 + 1) / (f + norm[row])
    order = np.argsort(prefix, kind="stable")
    row, share = row[order], share[order]
    many = np.bincount(prefix, minlength=len(idf))
    ends = np.cumsum(many)
    whole: dict[int, np.ndarray] = {}

    def of(p: int) -> tuple:
        a, b = ends[p] - many[p], ends[p]
        if 8 * (b - a) < n:
            return row[a:b], share[a:b]
        if p not in whole:
            whole[p] = np.zeros(n)
            whole[p][row[a:b]] = share[a:b]
        return slice(None), whole[p]

    return many, of


class _Top:
    """The best ``k`` rows of each question so far; of equal scores the earlier row is better."""

    def __init__(self, questions: int, k: int):
        self.k, self.rows, self.base = k, [], 0
        self.score, self.row = np.zeros((questions, k)), np.zeros((questions, k), dtype=np.int64)

    def add(self, q: int, score: np.ndarray) -> None:
        least = _nine(self.score[q, -1])
        some = np.flatnonzero(score > max(0.0, least - 1e-8))
        if len(some) > self.k:
            nine = _nine(score[some])
            some = some[nine >= np.partition(nine, len(some) - self.k)[len(some) - self.k]]
        if not len(some):
            return
        before = np.count_nonzero(self.score[q])
        scores = np.concatenate([self.score[q, :before], score[some]])
        rows = np.concatenate([self.row[q, :before], some + self.base])
        order = np.argsort(-_nine(scores), kind="stable")[: self.k]
        self.score[q, : len(order)], self.row[q, : len(order)] = scores[order], rows[order]

    def next(self, rows: pa.RecordBatch) -> None:
        self.rows.append(rows)
        self.base += rows.num_rows
