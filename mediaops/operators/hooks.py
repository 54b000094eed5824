"""Places where a user supplies a model: batch scoring and text embedding."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer, Tokenizer
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaops.operators.segments import strip_text


def score_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema, batch: int | None = None) -> DataFrame:
    """Apply ``fn`` to batches of rows; ``batch`` bounds the rows per call."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            step = batch or max(1, len(pdf))
            for start in range(0, len(pdf), step):
                yield fn(pdf.iloc[start : start + step].reset_index(drop=True))

    return df.mapInPandas(run, schema)


def score_with_model(
    df: DataFrame, load: Callable[[], Callable[..., np.ndarray]], inputs: list[str], out: str = "score", kind=None, batch: int = 1024
) -> DataFrame:
    """Add the prediction of a model for the columns ``inputs``.

    ``load`` reads the model and returns its predict function; it runs once in every Python worker, not for each batch.
    Predict gets an array per input, of at most ``batch`` rows.  Rows with a null input
    are shown as zeros and get null.
    """
    model = predict_batch_udf(load, return_type=kind or T.DoubleType(), batch_size=batch)
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in inputs])
    shown = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in inputs]
    return df.withColumn(out, F.when(whole, model(*shown)))


def embed(
    df: DataFrame, text: str, out: str = "embedding", fn: Callable[[list[str]], np.ndarray] | None = None, dim: int = 384
) -> DataFrame:
    """Add a vector per text: ``fn`` on batches of texts, or hashed word counts of length one.

    Blank and missing texts get a zero vector.
    """
    if fn is None:
        rows = df.withColumn("_t", F.coalesce(text, F.lit("")))
        tf = HashingTF(inputCol="_w", outputCol="_h", numFeatures=dim)
        rows = Normalizer(inputCol="_h", outputCol="_u").transform(
            tf.transform(Tokenizer(inputCol="_t", outputCol="_w").transform(rows))
        )
        blank = strip_text(F.col("_t")) == ""
        vector = F.when(blank, F.array_repeat(F.lit(0.0), dim)).otherwise(vector_to_array("_u"))
        return rows.withColumn(out, vector.cast("array<float>")).drop("_t", "_w", "_h", "_u")

    @F.pandas_udf("array<float>")
    def model(texts: pd.Series) -> pd.Series:
        clean = texts.fillna("")
        live = clean.str.strip() != ""
        vectors = np.zeros((len(clean), dim), dtype=np.float32)
        if live.any():
            vectors[live.to_numpy()] = np.asarray(fn(clean[live].tolist()), dtype=np.float32)
        return pd.Series(list(vectors))

    return df.withColumn(out, model(F.col(text)))


def embed_text(spark, text: str, fn=None, dim: int = 384) -> list[float] | None:
    """Vector of one query text, None for a blank one."""
    if not text.strip():
        return None
    one = spark.range(1).select(F.lit(text).alias("text"))
    return [float(x) for x in embed(one, "text", fn=fn, dim=dim).first()["embedding"]]
