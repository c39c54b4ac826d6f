"""Operator 10: language of a text by a string kernel with Nystroem landmarks and ridge regression.

The kernel is the blended spectrum in its presence form: the n-grams of 1 to 3 characters of the whole
lower-cased text, hashed into ``WIDTH`` cells, |A & B| / sqrt(|A| |B|). Landmarks are texts of the learning
rows; with K of the landmarks, features are k(x) K^-1/2, and one ridge regression per language is fitted on
them. A batch of texts is scored by two matrix products.

Learning reads text and language of at most about ``PER_LANG`` rows of each language, chosen by a digest
over all learnable rows; what reaches the driver are their n-gram bits (``WIDTH`` / 8 bytes each).

Defined results: null texts and texts without a letter are ``und`` with score 0; a table without learnable
rows predicts ``und`` for all; ties go to the smallest language name; repeated rows repeat the result; only
``doc_id``, ``text`` and ``lang`` are read.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundscope.llm.common import balanced_sample, chunks, held_out, learnable, table
from groundscope.llm.registry import query

#: Cells of the hashed n-grams, learning rows and landmarks of a language, and the ridge.
WIDTH, PER_LANG, LANDMARKS, RIDGE = 8192, 600, 40, 1e-3
_M1, _M2, _M3 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)
_SHIFT = np.uint32(32 - WIDTH.bit_length() + 1)


def presence(text: str) -> np.ndarray:
    """Which cells the 1- to 3-grams of the text hit."""
    found = np.zeros(WIDTH, dtype=bool)
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    one = c * _M1
    found[(one ^ (one >> np.uint32(15))) * _M2 >> _SHIFT] = True
    if len(c) > 1:
        two = (one[:-1] ^ (one[:-1] >> np.uint32(13))) * _M2 + c[1:] * _M3
        found[(two ^ (two >> np.uint32(15))) * _M1 >> _SHIFT] = True
        if len(c) > 2:
            three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * _M1 + c[2:] * _M2
            found[(three ^ (three >> np.uint32(15))) * _M3 >> _SHIFT] = True
    return found


def kernel(rows: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Normalised presence kernel of float rows against landmark columns that are already normalised."""
    size = np.sqrt(np.maximum(rows.sum(axis=1), 1.0))
    return (rows @ landmarks) / size[:, None]


def _bits(batches):
    for batch in batches:
        for part, texts in chunks([batch], "text"):
            packed = [np.packbits(presence(t)).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary())], ["lang", "bits"])


def fit(docs: DataFrame, per_lang: int = PER_LANG) -> dict | None:
    """Languages (sorted), normalised landmark columns and regression weights; None without learnable rows."""
    rows = docs.filter(learnable(F.col("doc_id")) & F.col("lang").isNotNull() & F.coalesce("text", F.lit("")).rlike(r"\p{L}"))
    sample = balanced_sample(rows.select("doc_id", "lang", "text"), "lang", per_lang).select("lang", "text")
    frame = sample.mapInArrow(_bits, "lang string, bits binary").toPandas()
    if frame.empty:
        return None
    frame = frame.sort_values(["lang", "bits"], kind="stable").reset_index(drop=True)
    langs = sorted(frame["lang"].unique())
    x = np.unpackbits(np.frombuffer(b"".join(frame["bits"]), dtype=np.uint8).reshape(len(frame), -1), axis=1).astype(np.float32)
    chosen = np.concatenate([
        np.random.default_rng(7).permutation(np.flatnonzero(frame["lang"] == k))[:LANDMARKS] for k in langs
    ])
    marks = (x[chosen] / np.sqrt(np.maximum(x[chosen].sum(axis=1), 1.0))[:, None]).T.astype(np.float32)
    k_mm = marks.T.astype(np.float64) @ marks
    value, vector = np.linalg.eigh(k_mm)
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    phi = kernel(x, marks).astype(np.float64) @ root
    target = np.where(frame["lang"].to_numpy()[:, None] == np.array(langs)[None], 1.0, -1.0)
    # Each language weighs the same.
    weight = 1.0 / frame.groupby("lang")["lang"].transform("size").to_numpy()
    phi1 = np.hstack([phi, np.ones((len(phi), 1))])
    gram = (phi1 * weight[:, None]).T @ phi1 + RIDGE * np.eye(phi1.shape[1])
    beta = np.linalg.solve(gram, (phi1 * weight[:, None]).T @ target)
    return {"langs": langs, "marks": marks, "weights": (root @ beta[:-1]).astype(np.float32), "bias": beta[-1].astype(np.float32)}


def scores(model: dict, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Index of the predicted language and its score in 0..1."""
    best, sure = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts))
    for at in range(0, len(texts), 256):
        rows = np.stack([presence(t) for t in texts[at : at + 256]]).astype(np.float32)
        out = kernel(rows, model["marks"]) @ model["weights"] + model["bias"]
        e = np.exp(4.0 * (out - out.max(axis=1, keepdims=True)))
        best[at : at + 256] = out.argmax(axis=1)
        sure[at : at + 256] = e.max(axis=1) / e.sum(axis=1)
    return best, sure


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    def run(batches):
        for batch in batches:
            for part, texts in chunks([batch], "text"):
                # Letters are those of the Unicode category L, as in learning.
                some = np.array([any(map(str.isalpha, t)) for t in texts])
                names, sure = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
                if model is not None and some.any():
                    best, s = scores(model, [t for t, ok in zip(texts, some) if ok])
                    names[some], sure[some] = np.array(model["langs"], dtype=object)[best], s
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(sure, pa.float64())],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


@query("op10_language_id")
def op10_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))
