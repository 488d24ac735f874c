"""Plug-in points: registries of named transforms, pipelines of them, scorers and embedders."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Registry:
    """Named DataFrame transforms (chunkers, parsers, priorities, rerankers)."""

    def __init__(self, kind: str):
        self.kind, self._known = kind, {}

    def register(self, name: str):
        def add(f: Callable) -> Callable:
            self._known[name] = f
            return f

        return add

    def get(self, name: str) -> Callable:
        if name not in self._known:
            raise KeyError(f"no {self.kind} named {name}; known: {', '.join(sorted(self._known))}")
        return self._known[name]


class Pipeline:
    """Transforms in order, as one lazy plan."""

    def __init__(self, *steps: Callable[[DataFrame], DataFrame]):
        self.steps = steps

    def __call__(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = df.transform(step)
        return df


def embed_once(df: DataFrame, text_col: str, model: Callable[[list[str]], list[list[float]]], batch: int = 64) -> DataFrame:
    """``df`` with ``embedding``; each different text is embedded once, in batches.

    The model is any picklable function of a list of texts."""

    def task(batches):
        for pdf in batches:
            out = []
            texts = pdf[text_col].to_list()
            for i in range(0, len(texts), batch):
                out += model(texts[i : i + batch])
            yield pd.DataFrame({text_col: texts, "embedding": out})

    texts = df.select(text_col).filter(F.col(text_col).isNotNull()).distinct()
    return df.join(texts.mapInPandas(task, f"`{text_col}` string, embedding array<double>"), text_col, "left")


def evaluate(search: Callable[[DataFrame], DataFrame], queries: DataFrame, judgments: DataFrame, k: int) -> DataFrame:
    """Metrics of an injected search: a function from (query_id, ...) to (query_id, rank, chunk_id)."""
    from .evaluation import query_metrics

    return query_metrics(search(queries), judgments, k)
