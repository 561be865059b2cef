"""Turning text into vectors with a function the caller supplies."""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.functions import text as T

Embedder = Callable[[list[str]], np.ndarray]


class _Numbers(dict):
    """First 32 bits of the MD5 of words, kept for as many as fit."""

    limit = 1 << 18

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        number = self[word] = int.from_bytes(hashlib.md5(word.encode()).digest()[:4])
        return number


_numbers = _Numbers()


class HashedWords:
    """Deterministic stand-in for a model: counts of words hashed into ``dim`` components
    (first 32 bits of the MD5, modulo ``dim``), scaled to unit length."""

    name = "hashed-words"

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, texts: list[str]) -> np.ndarray:
        found = [re.findall(r"[^\W_]+", text.lower()) for text in texts]
        words = [word for part in found for word in part]
        row = np.repeat(np.arange(len(texts)), [len(part) for part in found])
        slot = np.fromiter(map(_numbers.__getitem__, words), dtype=np.int64, count=len(words)) % self.dim
        out = np.bincount(row * self.dim + slot, minlength=len(texts) * self.dim)
        out = out.reshape(len(texts), self.dim).astype(np.float64)
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, size, out=out, where=size > 0)


class RateLimited(Exception):
    """Raised by an embedder that must be asked again later."""


def _with_retries(ask: Callable[[], np.ndarray], retries: int, delay: float) -> np.ndarray:
    """Ask up to ``retries`` times; the pause doubles when the model was too busy."""
    for attempt in range(retries):
        try:
            return ask()
        except RateLimited:
            pause = delay * 2**attempt
            if attempt == retries - 1:
                raise
        except Exception:
            pause = delay
            if attempt == retries - 1:
                raise
        time.sleep(pause)


def embed_batch(
    model: Embedder, texts: list[str], dim: int, retries: int = 3, delay: float = 1.0
) -> tuple[list[np.ndarray], list[str | None]]:
    """Vectors and errors of one batch. A model that stays busy fails the whole batch; after
    any other error the texts are tried one by one, with as many retries, and only those that fail
    again get a zero vector. The error is kept either way."""
    zero = np.zeros(dim, dtype=np.float32)
    try:
        found = _with_retries(lambda: model(texts), retries, delay)
        return list(np.asarray(found, dtype=np.float32)), [None] * len(texts)
    except RateLimited as error:
        return [zero] * len(texts), [str(error)] * len(texts)
    except Exception:
        vectors, errors = [], []
        for text in texts:
            try:
                # blank text is not sent on its own
                ask = lambda text=text: model([text])[0]
                one = _with_retries(ask, retries, delay) if text.strip() else zero
                vectors.append(np.asarray(one, dtype=np.float32))
                errors.append(None)
            except Exception as error:
                vectors.append(zero)
                errors.append(str(error))
        return vectors, errors


def embed(
    df: DataFrame,
    text_col: str = "content",
    embedder: Embedder | None = None,
    batch_size: int = 100,
    dim: int = 64,
    retries: int = 3,
    delay: float = 1.0,
) -> DataFrame:
    """Add ``embedding``, ``embedding_error``, ``embedding_model``, ``embedding_generated_at``.

    Text is cut at the model's limit and blank text becomes an empty string. Texts go to the
    embedder ``batch_size`` at a time, see ``embed_batch`` for failures.
    """
    model = embedder or HashedWords(dim)
    size = getattr(model, "dim", dim)
    schema = "embedding array<float>, embedding_error string"

    @F.arrow_udf(schema)
    def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found, errors = [], []
            for at in range(0, len(texts), batch_size):
                part = texts.slice(at, batch_size).to_pylist()
                more, wrong = embed_batch(model, part, size, retries, delay)
                found.extend(more)
                errors.extend(wrong)
            ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
            values = np.concatenate([np.zeros(0, np.float32), *found])
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
            yield pa.StructArray.from_arrays([lists, pa.array(errors, pa.string())], ["embedding", "embedding_error"])

    prepared = embedding_text(F.col(text_col))
    return df.withColumn("_v", vectors(prepared)).select(
        *df.columns,
        "_v.embedding",
        "_v.embedding_error",
        F.lit(getattr(model, "name", "custom")).alias("embedding_model"),
        F.current_timestamp().alias("embedding_generated_at"),
    )


def embedding_text(col):
    """Text as the embedder sees it: cut at the limit, blank or missing becomes empty."""
    cut = F.substring(col, 1, T.EMBED_MAX_CHARS)
    return F.when(col.isNull() | T.is_blank(col), "").otherwise(cut)
