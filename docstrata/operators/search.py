"""Keyword and vector retrieval, and their fusion."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from docstrata.common import written_once
from docstrata.functions.text import TOKEN, cosine, fold, fold_word, query_words, tokens

#: BM25's parameters, the weight of the title against the text, and the least weight of a word.
K1, B, TITLE_WEIGHT, LEAST_IDF = 1.2, 0.75, 3.0, 1e-6
KEYWORD_HITS, VECTOR_HITS, RRF = 40, 48, 60


def postings(chunks: DataFrame) -> DataFrame:
    """``term, chunk_id, tf_title, tf_text, dl``: the inverted index; ``dl`` is the number of words of the whole chunk.

    A chunk's words are counted where it is read, so the shuffle carries one row per different word of a chunk.
    """
    words = chunks.select("chunk_id", tokens(F.col("title")).alias("t"), tokens(F.col("text")).alias("x"))
    terms = words.select("chunk_id", F.size("t").alias("titled"), (F.size("t") + F.size("x")).alias("dl"), F.posexplode(F.concat("t", "x")).alias("place", "term"))
    in_title = (F.col("place") < F.col("titled")).cast("long")
    return terms.groupBy("term", "chunk_id", "dl").agg(F.sum(in_title).alias("tf_title"), F.sum(1 - in_title).alias("tf_text")).select(
        "term", "chunk_id", "tf_title", "tf_text", "dl"
    )


def write_postings(chunks: DataFrame, path: str) -> None:
    """Written sorted by term, a prefix search reads only the row groups whose range holds the prefix."""
    postings(chunks).repartitionByRange("term").sortWithinPartitions("term", "chunk_id").write.mode("overwrite").parquet(path)


def write_index(chunks: DataFrame, path: str) -> None:
    """Writes postings, terms and totals of ``chunks`` below ``path``, for ``search_index`` and ``answers``."""
    spark = chunks.sparkSession
    write_postings(chunks, f"{path}/postings")
    held = spark.read.parquet(f"{path}/postings")
    held.groupBy("term").agg(F.count(F.lit(1)).alias("chunks")).write.mode("overwrite").parquet(f"{path}/terms")
    words = held.agg(F.sum(F.col("tf_title") + F.col("tf_text")).alias("words"))
    kind = dict(chunks.dtypes)["chunk_id"]
    words.select("words", F.lit(chunks.count()).alias("n"), F.lit(kind).alias("kind")).coalesce(1).write.mode("overwrite").parquet(f"{path}/totals")


def _open_index(spark: SparkSession, path: str) -> tuple[Row, DataFrame, DataFrame]:
    """Totals, postings and terms of an index. Schemas are given, so that opening reads the one row of totals only."""
    total = spark.read.schema("words long, n long, kind string").parquet(f"{path}/totals").first()
    postings_schema = f"term string, chunk_id {total.kind}, tf_title long, tf_text long, dl int"
    return total, spark.read.schema(postings_schema).parquet(f"{path}/postings"), spark.read.schema("term string, chunks long").parquet(f"{path}/terms")


def index_of(chunks: DataFrame, name: str) -> str:
    """The path of the index of ``chunks`` (``chunk_id, title, text``, straight from a table), written when first asked for."""
    return written_once(chunks, f"index-{name}", lambda path: write_index(chunks, path))


def _shares(by_chunk: DataFrame, held: DataFrame, n: int, words: int) -> DataFrame:
    """``prefix, chunk_id, share``: what each prefix gives to the score of each chunk (``f`` its frequency there)."""
    mean = words / n if words else 1.0
    idf = F.greatest(F.log((n - F.col("d") + 0.5) / (F.col("d") + 0.5)), F.lit(LEAST_IDF))
    share = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("dl") / mean))
    return by_chunk.join(held, "prefix").select("prefix", "chunk_id", share.alias("share"))


def _held(by_chunk: DataFrame) -> DataFrame:
    """``prefix, d``: how many chunks hold each prefix. It asks for all columns of ``by_chunk``, so that Spark makes that
    shuffle once for this and for the shares."""
    return by_chunk.groupBy("prefix").agg(F.sum(F.when(F.col("f").isNotNull() & F.col("dl").isNotNull(), 1)).alias("d"))


def _by_chunk(found: DataFrame) -> DataFrame:
    return found.groupBy("prefix", "chunk_id").agg(F.sum(TITLE_WEIGHT * F.col("tf_title") + F.col("tf_text")).alias("f"), F.first("dl").alias("dl"))


def search_index(spark: SparkSession, path: str, queries: dict[str, list[str]]) -> DataFrame:
    """``query, chunk_id, score`` as ``bm25_many`` gives them, from a written index; for questions at hand.

    Prefixes reach the scan as filters on the sorted term column, so only the row groups that hold them are read; all
    words of all queries are read in one scan. Frequencies are sums over the matching postings.
    """
    total, terms, _ = _open_index(spark, path)
    asked = sorted({(q, fold_word(w)) for q, words in queries.items() for w in words})
    prefixes = sorted({p for _, p in asked})
    if not prefixes or not total.n:
        return terms.select(F.lit("").alias("query"), "chunk_id", F.lit(0.0).alias("score")).limit(0)
    found = terms.where(reduce(lambda a, b: a | b, [F.col("term").startswith(p) for p in prefixes])).select(
        "chunk_id",
        F.explode(F.array_compact(F.array(*[F.when(F.col("term").startswith(p), F.lit(p)) for p in prefixes]))).alias("prefix"),
        "tf_title",
        "tf_text",
        "dl",
    )
    by_chunk = _by_chunk(found)
    held = _held(by_chunk)
    wanted = spark.createDataFrame(asked, "query string, prefix string")
    shares = _shares(by_chunk, F.broadcast(held), total.n, total.words)  # at most a row a word asked for
    return shares.join(F.broadcast(wanted), "prefix").groupBy("query", "chunk_id").agg(F.sum("share").alias("score"))


def answers(spark: SparkSession, path: str, questions: DataFrame) -> DataFrame:
    """``query, chunk_id, score``: every hit of every question of a table (``query``, ``text``), from a written index.

    A question's words are ``query_words`` of its text, folded, each a prefix. Words meet the index's terms by an equi-join
    on all beginnings of the terms (one row a term, not a posting), terms meet the postings, and what a prefix gives a
    chunk is worked out once however many questions hold it. Common words are long lists that AQE's skew join splits.
    Questions without words, and an empty index, have no hits.
    """
    total, postings_, terms_ = _open_index(spark, path)
    words = questions.select("query", F.explode(query_words(fold(F.coalesce("text", F.lit(""))))).alias("prefix")).distinct()
    terms = terms_.select(
        "term", F.explode(F.transform(F.sequence(F.lit(1), F.length("term")), lambda i: F.substring(F.col("term"), F.lit(1), i))).alias("prefix")
    )
    pairs = terms.join(words.select("prefix").distinct(), "prefix")
    by_chunk = _by_chunk(postings_.join(pairs, "term"))
    held = _held(by_chunk)
    shares = _shares(by_chunk, held, max(1, total.n), total.words or 0)
    return words.join(shares, "prefix").groupBy("query", "chunk_id").agg(F.sum("share").alias("score"))


def best(hits: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """The first ``k`` hits of each query with their ``rank``: by score, then ``order``. Spark cuts each task's rows to ``k``
    a query before they are shuffled."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), *order))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def _count(folded: Column, prefix: str) -> Column:
    """How many words of a folded text begin with ``prefix``: found literally, then checked for a word's beginning."""
    p = re.escape(prefix)
    return F.regexp_count(folded, F.lit(rf"{p}(?<=(?<![\p{{L}}\p{{N}}_]){p})"))


def bm25(chunks: DataFrame, words: list[str]) -> DataFrame:
    """``chunk_id, score`` of the chunks that hold a word beginning with one of ``words``.

    ``chunks`` needs ``chunk_id, title, text``. Words are prefixes, joined by OR; frequencies count all words with the
    prefix, three times in the title. N, mean length and document frequencies are those of all chunks: one aggregate of
    a fixed number of sums (the only thing that reaches the driver), then one narrow pass that scores. No words or no
    chunks give no hits.
    """
    return bm25_many(chunks, {"": words}).select("chunk_id", "score")


def bm25_many(chunks: DataFrame, queries: dict[str, list[str]]) -> DataFrame:
    """``query, chunk_id, score`` for several questions at once: the texts are read twice, however many there are."""
    spark = chunks.sparkSession
    folded = {w: fold_word(w) for words in queries.values() for w in words}
    places = {p: i for i, p in enumerate(dict.fromkeys(folded.values()))}
    empty = spark.createDataFrame([], f"query string, chunk_id {dict(chunks.dtypes)['chunk_id']}, score double")
    if not places:
        return empty
    read = chunks.select("chunk_id", *[fold(F.coalesce(c, F.lit(""))).alias(n) for c, n in (("title", "t"), ("text", "x"))])
    counted = read.select(
        "chunk_id",
        (F.regexp_count("t", F.lit(TOKEN)) + F.regexp_count("x", F.lit(TOKEN))).alias("dl"),
        *[(TITLE_WEIGHT * _count(F.col("t"), p) + _count(F.col("x"), p)).alias(f"f{i}") for p, i in places.items()],
    )
    sums = [F.sum((F.col(f"f{i}") > 0).cast("long")).alias(f"d{i}") for i in places.values()]
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("mean"), *sums).first()
    if not stats.n:
        return empty
    shares = {}
    for p, i in places.items():
        held = stats[f"d{i}"]
        idf = F.greatest(F.log(F.lit((stats.n - held + 0.5) / (held + 0.5))), F.lit(LEAST_IDF))
        f = F.col(f"f{i}")
        norm = K1 * (1 - B + B * F.col("dl") / F.lit(stats["mean"] or 1.0))
        shares[p] = F.when(f > 0, idf * f * (K1 + 1) / (f + norm)).otherwise(0.0)
    scores = F.array(
        *[
            F.struct(F.lit(q).alias("query"), sum((shares[folded[w]] for w in dict.fromkeys(words)), F.lit(0.0)).alias("score"))
            for q, words in queries.items()
        ]
    )
    # Rows without a hit are dropped by their score: an earlier filter would be pushed below and count twice.
    return (
        counted.select("chunk_id", F.explode(scores).alias("s"))
        .select("s.query", "chunk_id", "s.score")
        .where("score > 0")
    )


def occurrences(hits: DataFrame, chunks: DataFrame, files: DataFrame) -> DataFrame:
    """The files in which hit chunks occur: ``hits`` joined with ``chunks`` and ``files`` by ``parsed_key``."""
    places = chunks.select("chunk_id", "parsed_key", "ordinal")
    return hits.join(places, "chunk_id").join(files.select("file_id", "parsed_key", "path"), "parsed_key")


def keyword_hits(scored: DataFrame, k: int = KEYWORD_HITS) -> DataFrame:
    """The best ``k`` occurrences: by score, path, place in the file, file."""
    return scored.orderBy(F.desc(F.round("score", 9)), "path", "ordinal", "file_id").limit(k)


def vector_hits(vectors: DataFrame, query: list[float], k: int = VECTOR_HITS) -> DataFrame:
    """``vec_id, score``: the ``k`` vectors of greatest cosine with ``query``, exactly, ties by id.

    Vectors without length or with another dimension score nothing.
    """
    target = F.array(*[F.lit(float(x)) for x in query])
    score = F.when(F.size("embedding") == len(query), cosine(F.col("embedding"), target))
    return vectors.select("vec_id", score.alias("score")).where("score IS NOT NULL").orderBy(F.desc(F.round("score", 9)), "vec_id").limit(k)


#: Query vectors that are sent to all tasks at once.
BLOCK = 10_000


def vector_answers(vectors: DataFrame, queries: DataFrame, k: int = VECTOR_HITS, block: int = BLOCK) -> DataFrame:
    """``query, vec_id, score, rank``: for each row of ``queries`` (``query, embedding``) the ``k`` vectors of greatest
    cosine, exactly, ties by id.

    Queries go out in blocks of about ``block`` by a hash of their id, each multiplied with all vectors where they are
    read; a task keeps ``k`` of each query and batch. Null and zero vectors, and those of another dimension, score nothing.
    """
    id_type, query_type = dict(vectors.dtypes)["vec_id"], dict(queries.dtypes)["query"]
    blocks = max(1, -(-queries.count() // block))
    found = []
    for b in range(blocks):
        asked = queries.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).where("embedding IS NOT NULL").toPandas()
        for size, some in asked.groupby(asked.embedding.map(len)):
            found.append(_block_hits(vectors, some["query"].to_numpy(), _unit(some.embedding.tolist()), int(size), k, id_type, query_type))
    if not found:
        return vectors.select(F.lit(None).cast(query_type).alias("query"), "vec_id", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    return best(reduce(DataFrame.union, found), k, "vec_id")


def _unit(rows: list) -> np.ndarray:
    """Rows of length 1; those without length become NaN."""
    m = np.asarray(rows, dtype=np.float64)
    with np.errstate(invalid="ignore", divide="ignore"):
        return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _block_hits(vectors: DataFrame, names: np.ndarray, matrix: np.ndarray, size: int, k: int, id_type: str, query_type: str) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast((names, matrix))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, matrix = shared.value
        for batch in batches:
            batch = batch.sort_values("vec_id", kind="stable")
            scores = _unit(batch.embedding.tolist()) @ matrix.T
            ids = batch.vec_id.to_numpy()
            for q, name in enumerate(names):
                right = np.flatnonzero(~np.isnan(scores[:, q]))
                order = right[np.argsort(-np.round(scores[right, q], 9), kind="stable")[:k]]
                yield pd.DataFrame({"query": [name] * len(order), "vec_id": ids[order], "score": scores[order, q]})

    return (
        vectors.select("vec_id", "embedding")
        .where(F.size("embedding") == size)
        .mapInPandas(run, f"query {query_type}, vec_id {id_type}, score double")
    )


def fuse(keyword: DataFrame, vector: DataFrame, key: str, k: int = 8) -> DataFrame:
    """``query, key, score, channels, place``: reciprocal-rank fusion of two rankings (``query, key, rank`` from 1), the best
    ``k`` of each query.

    A hit of both channels gets both shares; ties go by key. An empty side leaves the other's order.
    """
    a = keyword.select("query", key, F.col("rank").alias("ka"))
    b = vector.select("query", key, F.col("rank").alias("vb"))
    share = lambda c: F.coalesce(F.lit(1.0) / (F.lit(RRF) + F.col(c)), F.lit(0.0))
    fused = a.join(b, ["query", key], "full_outer").select(
        "query",
        key,
        (share("ka") + share("vb")).alias("score"),
        F.array_compact(F.array(F.when(F.col("ka").isNotNull(), F.lit("keyword")), F.when(F.col("vb").isNotNull(), F.lit("vector")))).alias("channels"),
    )
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 12)), key))
    return fused.withColumn("place", place).where(F.col("place") <= k)


def context(hits: DataFrame, per_document: int = 2, most: int = 5, budget: int = 2_900) -> DataFrame:
    """``hits`` (``query, document, rank, tokens``) that fit a prompt: per document the first few, in all ``most``, and only
    while they fit the budget; a hit that doesn't fit is skipped, not the end.

    The running budget is a fold over the few ranked hits of a query, done as one array expression.
    """
    first = hits.withColumn("_n", F.row_number().over(Window.partitionBy("query", "document").orderBy("rank"))).where(F.col("_n") <= per_document)
    rows = F.array_sort(F.collect_list(F.struct("rank", "document", "tokens")))
    nothing = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("taken"))
    taken = F.aggregate(
        rows,
        nothing,
        lambda s, r: F.when(
            (F.size(s["taken"]) < most) & (s["used"] + r["tokens"] <= budget),
            F.struct((s["used"] + r["tokens"]).cast("long").alias("used"), F.concat(s["taken"], F.array(r["rank"].cast("int"))).alias("taken")),
        ).otherwise(s),
    )
    chosen = first.groupBy("query").agg(taken["taken"].alias("taken")).select("query", F.explode("taken").alias("rank"))
    return hits.join(chosen, ["query", "rank"], "left_semi")
