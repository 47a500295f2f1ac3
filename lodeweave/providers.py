"""Providers: what a hosted model would do, as functions from columns to a column; deterministic ones for tests.

An embedding provider is a function (text column) -> array<float> column, a generation provider (prompt column) -> string
column, a rerank provider (question, text) -> double column. Calls to a hosted model belong into a pandas UDF that takes
BATCH texts at a time, cuts them to EMBEDDED_CHARS, halves a refused text, and waits 2 ** n seconds when told to slow down;
``calling`` wraps such a client.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions.udf import lazy_pandas_udf

BATCH, EMBEDDED_CHARS, SHORTEST, DIMENSIONS = 90, 1200, 200, 8


def embed_text(text: str | None, known: dict[str, int] | None = None) -> list[float]:
    """Counts of character trigrams by the first byte of their SHA-256 modulo 8, of unit length; zeros below three characters."""
    low, out = (text or "").lower(), np.zeros(DIMENSIONS)
    known = {} if known is None else known
    for i in range(len(low) - 2):
        t = low[i : i + 3]
        if t not in known:
            known[t] = hashlib.sha256(t.encode()).digest()[0] % DIMENSIONS
        out[known[t]] += 1
    n = np.linalg.norm(out)
    return (out / n if n else out).tolist()


@lazy_pandas_udf("array<float>")
def deterministic_embedding(texts: pd.Series) -> pd.Series:
    known: dict[str, int] = {}
    return texts.map(lambda t: embed_text(t, known))


def embedded_text(text: Column) -> Column:
    """What of a text is embedded; the whole text is stored."""
    return F.substring(text, 1, EMBEDDED_CHARS)


@lazy_pandas_udf("string")
def deterministic_answer(prompt: pd.Series) -> pd.Series:
    """JSON with a fixed answer that cites the first passage, for runs without a model."""
    return prompt.map(lambda p: '{"answer": "See [d1].", "claims": [{"text": "See the first passage.", "citation_ids": ["d1"]}]}' if "[d1]" in (p or "") else '{"answer": "I don\'t know.", "claims": []}')


class TooManyRequests(Exception):
    pass


class Refused(Exception):
    pass


def calling(client: Callable[[list[str]], list[list[float]]], retries: int = 5, sleep: Callable[[float], None] = time.sleep) -> Callable[[Column], Column]:
    """An embedding provider of a client that embeds a list of texts; errors beyond the retries give null vectors."""

    def batch(texts: list[str]) -> list[list[float] | None]:
        for n in range(retries):
            try:
                return client(texts)
            except TooManyRequests:
                sleep(2**n)
            except Refused:
                if len(texts) > 1:
                    return [v for t in texts for v in batch([t])]
                if len(texts[0]) < 2 * SHORTEST:
                    return [None]
                texts = [texts[0][: len(texts[0]) // 2]]
        return [None] * len(texts)

    @lazy_pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        values = [(t or "")[:EMBEDDED_CHARS] for t in texts]
        return pd.Series([v for a in range(0, len(values), BATCH) for v in batch(values[a : a + BATCH])])

    return run
