"""Embedding backends: the interface of models, and a deterministic stand-in for tests.

A backend is sent to executors as it was made, without its model; each task loads one, embeds Arrow batches and cleans up, also when it fails.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Clip:
    """A stretch of a media file, in seconds."""

    source: str
    start: float
    end: float


class Backend(ABC):
    """Makes vectors of texts and of clips in one space; ``load`` runs once in each task and ``cleanup`` at its end."""

    dims: int

    def load(self) -> None: ...

    @abstractmethod
    def embed(self, inputs: list[str]) -> np.ndarray:
        """A row for each text."""

    def embed_clips(self, clips: list[Clip]) -> np.ndarray:
        """A row for each clip; a backend of texts only has none."""
        raise NotImplementedError(f"{type(self).__name__} embeds texts only")

    def cleanup(self) -> None: ...


class HashBackend(Backend):
    """Unit vectors that depend on the input alone."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def embed(self, inputs: list[str]) -> np.ndarray:
        import zlib

        v = np.stack([np.random.default_rng(zlib.crc32(x.encode())).normal(size=self.dims) for x in inputs]) if inputs else np.zeros((0, self.dims))
        return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)

    def embed_clips(self, clips: list[Clip]) -> np.ndarray:
        return self.embed([f"{c.source} {c.start!r} {c.end!r}" for c in clips])


def _mapped(df: DataFrame, backend: Backend, vectors, into: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend.load()
        try:
            for b in batches:
                found = vectors(b)
                if found.shape != (len(b), backend.dims):
                    raise ValueError(f"the backend gave {found.shape} for {len(b)} inputs of {backend.dims} numbers")
                yield b.assign(**{into: list(found)})
        finally:
            backend.cleanup()

    return df.mapInPandas(run, T.StructType([*[f for f in df.schema.fields if f.name != into], T.StructField(into, T.ArrayType(T.FloatType()))]))


def embedded(df: DataFrame, column: str, backend: Backend, into: str = "embedding") -> DataFrame:
    """``df`` with a vector of each row's text in ``column``; null texts count as empty."""
    return _mapped(df.drop(into), backend, lambda b: backend.embed(b[column].fillna("").tolist()), into)


def embedded_clips(df: DataFrame, backend: Backend, into: str = "embedding") -> DataFrame:
    """``df`` (source, start, end) with a vector of each row's clip; rows without a source, a start or a later end have none and go."""
    d = df.drop(into).where(F.col("source").isNotNull() & (F.col("start") < F.col("end")))
    return _mapped(d, backend, lambda b: backend.embed_clips([Clip(s, float(x), float(y)) for s, x, y in zip(b["source"], b["start"], b["end"], strict=True)]), into)
