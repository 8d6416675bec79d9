"""Representations: deterministic vectors without meaning, for plumbing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def unit_vector(text: str, width: int) -> np.ndarray:
    """Digests of digests, two bytes a component (big end first) scaled to -0.5..0.5, then length 1."""
    chain, digest = [], text.encode()
    for _ in range(-(-width // 16)):
        digest = hashlib.sha256(digest).digest()
        chain.append(digest)
    v = np.frombuffer(b"".join(chain), ">u2")[:width] / 65535 - 0.5
    return v / (np.linalg.norm(v) or 1.0)


def fake_embedding(texts: DataFrame, width: int = 1536) -> DataFrame:
    """(item, v) of ``texts`` (item, text); null text has no vector."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[pdf.text.notna()]
            yield pd.DataFrame({"item": pdf["item"], "v": pd.Series([unit_vector(x, width) for x in pdf.text], index=pdf.index, dtype=object)})

    return texts.select("item", "text").mapInPandas(run, f"item {texts.schema['item'].dataType.simpleString()}, v array<double>")
