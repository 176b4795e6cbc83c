"""Where models plug in. Each hook maps a DataFrame to a DataFrame, so a model is
loaded once per worker inside mapInPandas and sees Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from codexflow.functions.text import tokens

BatchFn = Callable[[pd.DataFrame], pd.DataFrame]


def per_batch(load: Callable[[], BatchFn], added: str) -> Callable[[DataFrame], DataFrame]:
    """``load`` runs once per task and returns the batch function; ``added`` is
    the DDL of the columns that function adds.

    Where a batch raises, its rows are tried one by one; a row that raises again
    keeps NULL in the added columns and says why in ``error``.
    """
    def hook(df: DataFrame) -> DataFrame:
        extra = [f.name for f in StructType.fromDDL(added).fields]

        def attempt(fn, pdf):
            try:
                return fn(pdf.copy()).assign(error=None)
            except Exception as problem:  # whatever a model raises is that row's error
                if len(pdf) == 1:
                    return pdf.assign(**dict.fromkeys(extra), error=f"{type(problem).__name__}: {problem}")
                return pd.concat([attempt(fn, pdf.iloc[i:i + 1]) for i in range(len(pdf))])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            fn = load()
            for pdf in batches:
                yield attempt(fn, pdf)

        own = df.drop("error", *extra)
        return own.mapInPandas(run, StructType([*own.schema.fields, *StructType.fromDDL(added).fields, StructField("error", StringType())]))

    return hook


def fit_hashing(df: DataFrame, text: str = "text", dims: int = 64) -> Callable[[DataFrame], DataFrame]:
    """Default embedding without a model: hashed term counts, IDF learned from
    ``df``, unit length. Returns the embedder, which adds ``embedding``."""
    from pyspark.ml.feature import IDF, HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    def counted(rows):
        words = rows.withColumn("_toks", tokens(F.coalesce(F.col(text), F.lit(""))))
        return HashingTF(inputCol="_toks", outputCol="_tf", numFeatures=dims).transform(words)

    idf = IDF(inputCol="_tf", outputCol="_idf").fit(counted(df))

    def embedder(rows):
        unit = Normalizer(inputCol="_idf", outputCol="_unit", p=2.0).transform(idf.transform(counted(rows)))
        return unit.withColumn("embedding", vector_to_array("_unit", "float32")).drop("_toks", "_tf", "_idf", "_unit")

    return embedder


def embed_hashing(df: DataFrame, text: str = "text", dims: int = 64) -> DataFrame:
    return fit_hashing(df, text, dims)(df)
