"""Embeddings of chunks: which are missing, and a deterministic offline embedder."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What an embedding model takes at most, and to what a longer text is cut.
MOST_TOKENS, CUT_TOKENS, TRIES = 1_900, 1_800, 16
Embedder = Callable[[list[str]], list[np.ndarray]]


def cut_to(text: str, tokens: Callable[[str], int], most: int = MOST_TOKENS, goal: int = CUT_TOKENS) -> str:
    """The start of ``text`` that has at most ``most`` tokens, shortened in proportion until it fits."""
    for _ in range(TRIES):
        size = tokens(text)
        if size <= most:
            return text
        text = text[: min(len(text) - 1, max(1, len(text) * goal // size))]
    raise ValueError("the text can't be cut to fit")


def estimated_tokens(text: str) -> int:
    return max(1, math.ceil(len(text) / 3))


def hashing_embedder(dim: int = 768) -> Embedder:
    """Signed feature hashing of words and word pairs, of unit length; blank texts give zeros."""

    def embed(texts: list[str]) -> list[np.ndarray]:
        out = []
        for text in texts:
            words = re.findall(r"\w+", text.lower())
            vector = np.zeros(dim, dtype=np.float32)
            for feature in [*words, *map(" ".join, zip(words, words[1:], strict=False))]:
                h = zlib.crc32(feature.encode())
                vector[h % dim] += 1.0 if h >> 31 else -1.0
            length = float(np.linalg.norm(vector))
            out.append(vector / length if length else vector)
        return out

    return embed


def pending(chunks: DataFrame, state: DataFrame, model: str) -> DataFrame:
    """The chunks (``chunk_id, membership``) whose vectors ``state`` (``chunk_id, model, membership``) hasn't as they are now."""
    done = state.where(F.col("model") == model).select("chunk_id", "membership")
    return chunks.join(done, ["chunk_id", "membership"], "left_anti")


def embedded(chunks: DataFrame, embedder: Embedder | None = None, batch: int = 16) -> DataFrame:
    """``input_hash, vector`` of the distinct inputs of ``chunks`` (``title, text``): equal inputs are embedded once.

    The embedder is called per task with small batches; null texts have no vector.
    """
    from docstrata.functions.text import embedding_input

    embed = embedder or hashing_embedder()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), batch):
                some = rows.iloc[at : at + batch]
                vectors = embed([cut_to(t, estimated_tokens) for t in some.input])
                yield pd.DataFrame({"input_hash": some.input_hash, "vector": [v.tolist() for v in vectors]})

    inputs = chunks.where("text IS NOT NULL").select(embedding_input(F.col("title"), F.col("text")).alias("input"))
    distinct = inputs.select(F.sha2("input", 256).alias("input_hash"), "input").dropDuplicates(["input_hash"])
    return distinct.mapInPandas(run, "input_hash string, vector array<float>")
