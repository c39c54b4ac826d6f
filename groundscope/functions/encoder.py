"""pluggable text encoders as Column functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from groundscope.functions import text

DIMENSIONS = 128


def l2_normalize(vector) -> Column:
    """Unit length; a zero vector stays zero."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.zip_with(vector, F.array_repeat(norm, F.size(vector)), lambda x, n: x.cast("double") / F.greatest(n, F.lit(1e-12)))


def hashed_terms(value) -> Column:
    """Words and character trigrams, the features of the default encoder."""
    return F.concat(text.identifier_tokens(value), text.char_ngrams(value))


def hashed_encoder(value, dimensions: int = DIMENSIONS) -> Column:
    """Default encoder: signed feature hashing of words and trigrams, without any model."""
    signed = F.transform(
        hashed_terms(value),
        lambda t: F.struct(F.pmod(F.xxhash64(t), F.lit(dimensions)).alias("slot"), F.when(F.xxhash64(t, F.lit(1)) % 2 == 0, 1.0).otherwise(-1.0).alias("sign")),
    )
    return _accumulate(signed, dimensions)


def _accumulate(signed: Column, dimensions: int) -> Column:
    @F.pandas_udf("array<float>")
    def fill(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            rows = []
            for entries in batch:
                vector = np.zeros(dimensions, dtype=np.float32)
                for entry in entries:
                    vector[entry["slot"]] += entry["sign"]
                rows.append(vector / max(float(np.linalg.norm(vector)), 1e-12))
            yield pd.Series(rows)

    return fill(signed)


def encoder(encode: Callable[[list[str]], np.ndarray] | object) -> Callable[[Column], Column]:
    """Wrap a callable(list of texts) -> matrix, or an object with ``encode``, as a Column function.

    Texts arrive in Arrow batches; rows of the matrix are normalised.
    """
    function = encode if callable(encode) and not hasattr(encode, "encode") else encode.encode

    @F.pandas_udf("array<float>")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            matrix = np.asarray(function(batch.tolist()), dtype=np.float32)
            norms = np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
            yield pd.Series(list(matrix / norms))

    return apply


def dot(left, right) -> Column:
    """Inner product of two vectors."""
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)
