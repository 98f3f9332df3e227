"""Groups of near-duplicate records: MinHash banding, verified on the full shingle sets, closed over links."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docstrata.common import cut_lineage, small_side

WORD = re.compile(r"\w+")
#: Buckets with more distinct texts than this are linked star-wise first; what that leaves apart is completed, exactly, by
#: the rarest shingles of their texts instead of all pairs.
LARGE_BUCKET = 1000


@dataclass(frozen=True)
class Likeness:
    """How two texts are compared: shingle kind and length, the threshold, and the banding.

    ``rows`` is the number of MinHash values per band; the number of bands follows from it, so that two texts exactly at
    the threshold meet in a band with probability ``recall`` (more similar ones meet more surely).
    """

    unit: str = "word"
    length: int = 5
    threshold: float = 0.8
    rows: int = 8
    recall: float = 0.995
    name: str = ""

    @property
    def bands(self) -> int:
        return math.ceil(math.log(1 - self.recall) / math.log(1 - self.threshold**self.rows))


def _words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class _Shingler:
    """64-bit ids of a text and of its shingles.

    Up to three characters are their own id, which is exact and, sorted, compresses well; other shingles are random
    multiples of their units' ids, summed and mixed.
    """

    def __init__(self, like: Likeness):
        self.like, self.ids = like, {}
        self.seed = xxhash.xxh64_intdigest(like.name)
        random = np.random.default_rng(self.seed)
        self.factors = random.integers(1, 2**63, like.length, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.exact = like.unit == "char" and like.length <= 3
        self.packed = np.array([1 << 21 * i for i in range(min(like.length, 3))], dtype=np.uint64)
        self.by, self.mix = np.uint64(32), np.uint64(0x9E3779B97F4A7C15)

    def node(self, words: list[str]) -> int:
        return xxhash.xxh3_64_intdigest(" ".join(words), self.seed) - 2**63

    def _id(self, word: str) -> int:
        if len(self.ids) > 500_000:
            self.ids.clear()
        return self.ids.setdefault(word, xxhash.xxh64_intdigest(word))

    def shingles(self, words: list[str]) -> np.ndarray:
        """One id for each place of a shingle: repeated ones are repeated."""
        if self.like.unit == "word":
            known = self.ids.get
            units = np.array([known(w) or self._id(w) for w in words], dtype=np.uint64)
        else:
            units = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        n = len(units) - self.like.length + 1
        if n <= 0 or not words:
            return np.empty(0, dtype=np.uint64)
        factors = self.packed if self.exact else self.factors
        ids = units[:n] * factors[0]
        for i in range(1, self.like.length):
            ids += units[i : i + n] * factors[i]
        return ids if self.exact else self.mixed(ids)

    def mixed(self, ids: np.ndarray) -> np.ndarray:
        ids = ids ^ ids >> self.by
        ids *= self.mix
        ids ^= ids >> self.by
        return ids


def _membership(like: Likeness):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = _Shingler(like)
        for batch in batches:
            batch = batch.dropna()
            yield pd.DataFrame({"id": batch.id, "node": [shingler.node(_words(t)) for t in batch.text]}, dtype=object)

    return run


def _once(batches: Iterator[pd.DataFrame], shingler: _Shingler) -> Iterator[list[tuple[int, list[str]]]]:
    """The distinct texts of each batch, as node and words."""
    for batch in batches:
        yield list({shingler.node(w): w for w in map(_words, batch.text.dropna())}.items())


def _shingle_sets(like: Likeness):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = _Shingler(like)
        for texts in _once(batches, shingler):
            sets = [(n, np.unique(s).view(np.int64)) for n, w in texts if len(s := shingler.shingles(w))]
            yield pd.DataFrame(sets, columns=["node", "shingles"])

    return run


def _bands(like: Likeness):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = _Shingler(like)
        random = np.random.default_rng(shingler.seed + 1)
        k = like.bands * like.rows
        factor, shift = (random.integers(0, 2**31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1) for _ in "ab")
        fold = random.integers(0, 2**63, like.rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        salt = random.integers(0, 2**63, like.bands, dtype=np.uint64)
        by, mix = np.uint64(31), np.uint64(0xBF58476D1CE4E5B9)
        for texts in _once(batches, shingler):
            out = []
            for node, words in texts:
                shingles = shingler.shingles(words)
                shingles = (shingler.mixed(shingles) if shingler.exact else shingles).astype(np.uint32)[:, None]
                if len(shingles):
                    least = np.full(k, 2**32 - 1, dtype=np.uint32)
                    for at in range(0, len(shingles), 128):  # in blocks that fit the processor's cache
                        values = shingles[at : at + 128] * factor
                        values += shift
                        np.minimum(least, values.min(axis=0), out=least)
                    x = (least.reshape(like.bands, like.rows) * fold).sum(axis=1, dtype=np.uint64)
                    x ^= x >> by
                    x *= mix
                    out.append((node, (x ^ salt).view(np.int64)))
            yield pd.DataFrame(out, columns=["node", "bands"])

    return run


def nodes(records: DataFrame, like: Likeness) -> DataFrame:
    """``id, node``: equal nodes are texts with equal words (a 64-bit hash of them). Null texts have none."""
    return records.select("id", "text").mapInPandas(_membership(like), f"id {dict(records.dtypes)['id']}, node long")


def _buckets(records: DataFrame, like: Likeness) -> DataFrame:
    """``band, node, n, least``: the distinct texts of each band bucket that holds at least two, its size and least node.

    One shuffle, on the band hash; the copies of a text collapse within a batch before it and within the bucket after it.
    """
    rows = (
        records.select("text")
        .mapInPandas(_bands(like), "node long, bands array<long>")
        .select("node", F.explode("bands").alias("band"))
    )
    bucket = Window.partitionBy("band")
    seen = F.lag("node").over(bucket.orderBy("node"))
    return (
        rows.select("band", "node", seen.alias("seen"))
        .where("seen IS NULL OR seen <> node")
        .select("band", "node", F.count(F.lit(1)).over(bucket).alias("n"), F.min("node").over(bucket).alias("least"))
        .where("n > 1")
    )


def candidates(records: DataFrame, like: Likeness) -> DataFrame:
    """``a, b, large``: pairs ``a < b`` of nodes that share a band bucket.

    Buckets of up to LARGE_BUCKET texts give all their pairs. Larger ones give each member's pair with the bucket's least
    node, marked ``large``: ``links`` completes them once it is known which members are already connected.
    """
    large = F.col("n") > LARGE_BUCKET
    return (
        _buckets(records, like)
        .groupBy("band", "least", large.alias("large"), F.when(large, F.col("node")).alias("one"))
        .agg(F.collect_list("node").alias("nodes"))
        .select(F.explode(F.when(F.col("large"), F.array("least")).otherwise(F.col("nodes"))).alias("a"), "nodes", "large")
        .select("a", F.explode("nodes").alias("b"), "large")
        .where("a < b")
        .groupBy("a", "b")
        .agg(F.max("large").alias("large"))
    )


def _verified(pairs: DataFrame, records: DataFrame, like: Likeness) -> DataFrame:
    """Those pairs whose full shingle sets reach the threshold. The sets cross the network once, by node."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = (
        records.select("text")
        .mapInPandas(_shingle_sets(like), "node long, shingles array<long>")
        .join(small_side(wanted), "node", "left_semi")
        .dropDuplicates(["node"])
    )
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b"
    )
    na, nb, common = F.size("sa"), F.size("sb"), F.size(F.array_intersect("sa", "sb"))
    long_enough = F.least(na, nb) >= F.greatest(na, nb) * like.threshold - 1e-9
    return both.where(long_enough).where(common >= (na + nb - common) * like.threshold - 1e-9).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """``node, group``: the least node of each node's component, for every node of a link.

    Alternating large-star and small-star steps: each round is two grouped minima and joins, with lineage cut in the
    shared checkpoint folder, and the number of rounds is logarithmic in the longest chain. A node's neighbours are
    never collected, so a hot node is only a skewed join key, which AQE splits.
    """
    links = cut_lineage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("l"))
            .select("l.a", "l.b")
            .where("a <> b")
            .distinct()
        )
        small = cut_lineage(small)
        # Done when every node has one link and no least node is itself linked to a lesser one.
        twice = small.groupBy("a").count().where("count > 1").select("a")
        if twice.unionByName(small.select("a").join(small.select(F.col("b").alias("a")), "a", "left_semi")).isEmpty():
            return small.select(F.col("a").alias("node"), F.col("b").alias("group")).union(small.select("b", "b").distinct())
        links = small


def _rare_pairs(members: DataFrame, records: DataFrame, like: Likeness) -> DataFrame:
    """``a, b``: of the texts of ``members`` (``node, group``) all pairs of different groups that can reach the threshold.

    Two sets that do share one of the rarest ``n - ceil(threshold * n) + 1`` shingles of each, so a join on these loses no
    link; unlike texts meet in common shingles only, and those aren't among the rarest. Shingles are counted over all
    members; a text's own are ranked in one window group.
    """
    sets = (
        records.select("text")
        .mapInPandas(_shingle_sets(like), "node long, shingles array<long>")
        .join(small_side(members), "node")
        .dropDuplicates(["node"])
        .select("node", "group", F.size("shingles").alias("size"), F.explode("shingles").alias("shingle"))
    )
    each = cut_lineage(sets)
    held = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("held"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("held", "shingle"))
    rare = each.join(held, "shingle").withColumn("place", place).where(F.col("place") <= F.col("size") - F.ceil(F.col("size") * like.threshold - 1e-9) + 1)
    x, y = (rare.select("shingle", F.col("node").alias(n), F.col("group").alias(f"g{n}"), F.col("size").alias(f"n{n}")) for n in "ab")
    fits = F.least("na", "nb") >= F.greatest("na", "nb") * like.threshold - 1e-9
    return x.join(y, "shingle").where("a < b AND ga <> gb").where(fits).select("a", "b").distinct()


def links(records: DataFrame, like: Likeness) -> DataFrame:
    """``a, b``: links between the nodes of ``records`` (``id, text``) that connect all texts of a group.

    Every pair that shares a band is verified, except within buckets of more than LARGE_BUCKET texts: there each text is
    verified against the least one, and afterwards against those texts of large buckets that it can be like and isn't yet
    connected to.
    """
    pairs = cut_lineage(candidates(records, like))
    first = cut_lineage(_verified(pairs, records, like))
    if pairs.where("large").isEmpty():
        return first
    large = pairs.where("large").select(F.explode(F.array("a", "b")).alias("node")).distinct()
    members = cut_lineage(large.join(components(first), "node", "left").select("node", F.coalesce("group", "node").alias("group")))
    rest = _rare_pairs(members, records, like).join(pairs, ["a", "b"], "left_anti")
    return first.union(_verified(cut_lineage(rest), records, like))


def near_duplicates(records: DataFrame, like: Likeness) -> DataFrame:
    """``id, node, group``, one row per record with a non-null text: its text's id and its group's.

    ``records`` needs ``id, text``; other columns are ignored. Texts with equal words share a node (they are linked
    whatever their length); texts too short for any shingle are linked to equal ones only. A group of one node and one
    record is a record without near-duplicates. Empty input gives an empty result.
    """
    found = components(links(records, like))
    return (
        nodes(records, like).join(found, "node", "left").select("id", "node", F.coalesce("group", "node").alias("group"))
    )
