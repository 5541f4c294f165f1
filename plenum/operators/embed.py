"""Embeddings of texts: an encoder's token vectors, mean over the mask, unit length.

The encoder is a function from a list of texts to a pair of arrays: token vectors (texts, tokens, dimensions) and
the mask (texts, tokens) of what is no padding. A neural model takes the place of the one given here by the same signature.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Encoder = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]

#: Texts that an encoder gets at once, and tokens of a text that it looks at.
BATCH, TOKENS = 32, 128


def pooled(vectors: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Means of the token vectors that the mask has, of unit length; zero where it has none."""
    total = (vectors * mask[..., None]).sum(1)
    mean = total / np.maximum(mask.sum(1, keepdims=True), 1e-9)
    return mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)


def letter_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A stand-in for a model: for each of the first words its length, its letters e and a one."""
    words = [t.lower().split()[:TOKENS] for t in texts]
    most = max(map(len, words), default=0)
    vectors, mask = np.zeros((len(texts), most, 3)), np.zeros((len(texts), most))
    for i, own in enumerate(words):
        for j, w in enumerate(own):
            vectors[i, j], mask[i, j] = (len(w), w.count("e"), 1), 1
    return vectors, mask


def embeddings(texts: DataFrame, id_col: str, text_col: str, encoder: Encoder = letter_counts, batch: int = BATCH) -> DataFrame:
    """id and embedding of each text; a null text is empty."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), batch):
                part = f.iloc[at : at + batch]
                yield pd.DataFrame({"id": part["id"], "embedding": list(pooled(*encoder(part["t"].tolist())))})

    return texts.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).mapInPandas(run, "id string, embedding array<double>")
