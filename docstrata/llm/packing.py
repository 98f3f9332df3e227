"""Filling token containers: documents are dealt to the cheapest sequence with room, longest first."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrata.common import cut_lineage

#: Rank file of a public tokenizer; a path that every executor sees.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the rank file's tokenizer splits text before merging (a fixed value of that vocabulary).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Containers that one task fills at a time.
SHARD = 512
#: Width of the model whose cost is balanced: attention costs length**2 / (6 * WIDTH) beside length for the rest.
WIDTH = 4096


@functools.cache
def _encoding(ranks: str):
    import tiktoken

    with open(ranks, "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=merges, special_tokens={})


def token_counts(documents: DataFrame, ranks: str = RANKS) -> DataFrame:
    """``doc_id, tokens`` of each row whose text is neither null nor empty; whole texts, one row each."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(ranks).encode_ordinary
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch.doc_id, "tokens": [len(encode(t)) for t in batch.text]})

    texts = documents.select("doc_id", "text").where("text IS NOT NULL AND text <> ''")
    return texts.mapInPandas(count, f"doc_id {dict(documents.dtypes)['doc_id']}, tokens long")


def cost(length: np.ndarray | float) -> np.ndarray | float:
    """Estimated training cost of a piece of text, in units of a token's linear part: attention stays within the piece."""
    return length + length * length / (6 * WIDTH)


def deal(sizes: np.ndarray, capacity: int, containers: int, spill: bool) -> tuple[np.ndarray, np.ndarray]:
    """Container and offset of each size: descending, each to the container of least cost that has room.

    What fits nowhere gets container -1 if ``spill``, else another container is opened for it.
    """
    room, load = np.full(containers, capacity, dtype=np.int64), np.zeros(containers)
    place, offset = np.full(len(sizes), -1, dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        c = int(np.argmin(np.where(room >= n, load, np.inf))) if len(room) else -1
        if c < 0 or room[c] < n:
            if spill:
                continue
            c, room, load = len(room), np.append(room, capacity), np.append(load, 0.0)
        place[i], offset[i] = c, capacity - room[c]
        room[c] -= n
        load[c] += cost(n)
    return place, offset


def _filler(capacity: int, last: bool):
    columns = ["item", "doc_id", "part", "token_start", "token_end", "place", "container_offset", "shard"]

    def fill(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values("item", ignore_index=True)
        sizes = (pieces.token_end - pieces.token_start).to_numpy()
        full = int(sizes.sum()) // capacity
        short = last and full * capacity < sizes.sum()
        pieces["place"], pieces["container_offset"] = deal(sizes, capacity, full + short, not last)
        return pieces[columns]

    return fill


def pack(sizes: DataFrame, capacity: int, shard: int = SHARD) -> DataFrame:
    """``container, position, doc_id, part, token_start, token_end, container_offset`` for ``sizes`` (``doc_id, tokens``).

    Documents longer than ``capacity`` are cut at multiples of it, others stay whole. Pieces are dealt at random to
    shards of about ``shard`` containers' tokens, each of which opens only as many containers as its tokens surely fill;
    what fits nowhere goes into the next round with all other shards' rest, until the rest fits one shard. So a task
    holds a bounded number of tokens, and the containers exceed the least possible number by a few in all. Rows of equal
    ``doc_id`` are packed one by one. ``container`` is unique but not dense; ``position`` is the 0-based place in it.
    Null or zero sizes are left out. No rows give no containers.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    id_type = dict(sizes.dtypes)["doc_id"]
    parts = (
        sizes.where("tokens > 0")
        .select("doc_id", "tokens", F.explode(F.sequence(F.lit(0), ((F.col("tokens") - 1) / capacity).cast("int"))).alias("part"))
        .select(
            "doc_id",
            "part",
            (F.col("part") * F.lit(capacity)).cast("long").alias("token_start"),
            F.least("tokens", (F.col("part").cast("long") + 1) * capacity).cast("long").alias("token_end"),
        )
    )
    rest = cut_lineage(parts.withColumn("item", F.monotonically_increasing_id()))
    schema = (
        f"item long, doc_id {id_type}, part int, token_start long, token_end long, place long, container_offset long, shard long"
    )
    out, first = None, 0
    while True:
        total = rest.agg(F.sum(F.col("token_end") - F.col("token_start"))).first()[0] or 0
        shards = max(1, total // (capacity * shard))
        last = shards == 1

        done = cut_lineage(
            rest.select("item", "doc_id", "part", "token_start", "token_end", F.pmod(F.xxhash64("item"), F.lit(shards)).alias("shard"))
            .groupBy("shard")
            .applyInPandas(_filler(capacity, last), schema)
        )
        stride = (done.agg(F.max("place")).first()[0] or 0) + 1
        placed = done.where("place >= 0").select(
            (F.lit(first) + F.col("shard") * stride + F.col("place")).alias("container"),
            "doc_id",
            "part",
            "token_start",
            "token_end",
            "container_offset",
        )
        out = placed if out is None else out.union(placed)
        first += shards * stride
        if last:
            break
        rest = done.where("place < 0").select("item", "doc_id", "part", "token_start", "token_end")
    order = F.array_sort(F.collect_list(F.struct("container_offset", "doc_id", "part", "token_start", "token_end")))
    return (
        out.groupBy("container")
        .agg(order.alias("pieces"))
        .select("container", F.posexplode("pieces").alias("position", "p"))
        .select("container", "position", "p.doc_id", "p.part", "p.token_start", "p.token_end", "p.container_offset")
    )
