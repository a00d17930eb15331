"""Steps that call an outside service, with the client passed in.

A client is any picklable object; one call takes a batch. Each item fails on its own: the row says so
and the others stay. Everything that can be decided without a call is filtered first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import doubles
from ..operators.extract import unfenced
from ..operators.route import complexity, is_level2_candidate

EMBED_BATCH = 20


def embedded(rows: DataFrame, embed: Callable[[list[str]], list[list[float]]], text_col: str = "text", vector_col: str = "vector", batch: int = EMBED_BATCH, dimensions: int | None = None) -> DataFrame:
    """Adds vectors by batches in order; a vector of another length than ``dimensions`` is an error."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema.fields)}, `{vector_col}` array<float>"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            vectors = []
            for first in range(0, len(part), batch):
                vectors += embed(part[text_col].iloc[first : first + batch].fillna("").tolist())
            if dimensions is not None and any(len(v) != dimensions for v in vectors):
                raise ValueError(f"the model's vectors do not have {dimensions} components")
            yield part.assign(**{vector_col: vectors})

    return rows.mapInPandas(run, schema)


def described(flows: DataFrame, ask: Callable[[str, str], str], prompt_col: str = "prompt", body_col: str = "body") -> DataFrame:
    """path, status (generated or failed), answer of the flows that need a description; ``ask`` gets a
    tier (high or normal) and the prompt."""
    todo = flows.filter(is_level2_candidate(F.col(body_col))).select("path", complexity(F.col(body_col)).alias("tier"), F.col(prompt_col).alias("prompt"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for path, tier, prompt in part.itertuples(index=False):
                try:
                    out.append((path, "generated", ask(tier, prompt)))
                except Exception:  # one item's failure is its own result
                    out.append((path, "failed", None))
            yield pd.DataFrame(out, columns=["path", "status", "answer"])

    return todo.mapInPandas(run, "path string, status string, answer string").withColumn("answer", unfenced(F.col("answer")))


def normalised(rows: DataFrame, vector_col: str = "vector") -> DataFrame:
    """Vectors of length one, so that a cosine is a product; zero vectors stay."""
    v = doubles(F.col(vector_col))
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return rows.withColumn(vector_col, F.transform(v, lambda x: F.when(length > 0, x / length).otherwise(x)))
