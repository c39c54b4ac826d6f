"""Operator 5: toxicity by a convolutional text classifier over hashed word embeddings.

A word's vector is the mean of the hashed vectors of the word itself and of its first and last letters, so
unseen forms of a stem still have a meaning. Filters of ``SPANS`` words slide over the whole text, each
filter keeps its maximum, and a linear layer on the maxima gives the logit. Because a filter is linear, its
value at a place is a sum of one row of a per-word table for each covered word: scoring gathers and adds
rows, it needs no product per word. Everything is trained with Adam in numpy; only the place of a maximum
gets a gradient.

Thresholds are calibrated by language on a third of the learning rows that took no part in the fitting. The
language is guessed from function words of the text (the table's language is never read). The logit is
shifted so that a language's threshold becomes the score 0.7.

Learning rows: at most about ``PER_CLASS`` rows of each label, chosen by a digest over all learnable labels.

Defined results: null text is scored as the empty text; without learnable labels all scores are 0; repeated
rows repeat the result; conflicting labels of an id take the larger; only ``doc_id`` and ``text`` are read
from the documents.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundscope.llm.common import chunks, held_out, learnable, sigmoid, table
from groundscope.llm.quality import labelled
from groundscope.llm.registry import query

#: Hashed cells, vector length, filter widths in words, filters of a width, learning rows of a label, steps of 48 texts.
CELLS, DIM, SPANS, FILTERS, PER_CLASS, STEPS = 1 << 16, 16, (1, 2, 3), 8, 3000, 560
#: Share of word pieces dropped in training, decay of the touched vectors.
DROP, DECAY = 0.4, 1e-5
CUT = 0.7
#: Words remembered by a task at once.
REMEMBERED = 200_000
WORD = re.compile(r"\w+")
#: Function words that tell a language.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was with as be by this are from at have not which".split(),
    "de": "der die und das ist nicht den von mit dem für als ein eine auf im zu sich des wird".split(),
    "fr": "le la les et des est du dans que pour une qui sur pas par au avec ne ce plus".split(),
    "es": "el los las y del se por un con una su para es al lo como más pero sus ha".split(),
}
LANGS = [*FUNCTION_WORDS, "other"]
_HINT = {w: i for i, words in enumerate(FUNCTION_WORDS.values()) for w in words}
PIECES = 6


def pieces(word: str) -> list[int]:
    """Cells of the word and of its first 3, 4, 5 and last 3, 4 letters."""
    parts = ("w" + word, "a" + word[:3], "b" + word[:4], "c" + word[:5], "y" + word[-3:], "z" + word[-4:])
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) % CELLS for p in parts]


class Words:
    """Numbers words as they come: 0 is the gap between texts. Keeps their cells and language hints."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.cells = array("i", [0] * PIECES)
        self.hints: list[int] = [len(FUNCTION_WORDS)]

    def numbers(self, text: str) -> np.ndarray:
        words = WORD.findall(text.lower())
        for w in set(words).difference(self.known):
            self.known[w] = len(self.hints)
            self.cells.extend(pieces(w))
            self.hints.append(_HINT.get(w, len(FUNCTION_WORDS)))
        return np.fromiter(map(self.known.__getitem__, words), dtype=np.int32, count=len(words))

    def table(self, done: int = 0) -> np.ndarray:
        """The cells of the words from number ``done`` on, one row each."""
        return np.array(self.cells[done * PIECES :], dtype=np.int32).reshape(-1, PIECES)


def language(numbers: list[np.ndarray], hints: np.ndarray) -> np.ndarray:
    """Index into LANGS: most function words, the first at a tie, 'other' without any."""
    found = np.zeros(len(numbers), dtype=np.int64)
    for i, n in enumerate(numbers):
        counts = np.bincount(hints[n], minlength=len(LANGS))[:-1]
        found[i] = counts.argmax() if counts.any() else len(LANGS) - 1
    return found


def layout(numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The texts in one row of word numbers, each followed by gaps so that no filter spans two of them."""
    pad = max(SPANS)
    sizes = np.array([len(n) + pad for n in numbers])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    line = np.zeros(starts[-1] + pad, dtype=np.int32)
    for n, s in zip(numbers, starts):
        line[s : s + len(n)] = n
    return line, starts[:-1]


def vectors(model: dict, cells: np.ndarray) -> np.ndarray:
    out = model["e"][cells].mean(axis=1)
    out[0] = 0.0
    return out


def maxima(model: dict, tables: list[np.ndarray], line: np.ndarray, starts: np.ndarray, places: bool = False):
    """The maximum of each filter over each text, and where it is."""
    top, where = [], []
    for k, span in enumerate(SPANS):
        n = len(line) - max(SPANS)
        value = tables[k][0][line[:n]]
        for j in range(1, span):
            value = value + tables[k][j][line[j : n + j]]
        sizes = np.diff(np.concatenate([starts, [n]]))
        for j in range(1, span):  # a filter that starts in the last gaps would reach into the next text
            value[starts + sizes - j] = -np.inf
        best = np.maximum.reduceat(value, starts, axis=0)
        top.append(best)
        if places:
            hit = value == np.repeat(best, sizes, axis=0)
            at = np.where(hit, np.arange(n)[:, None], n)
            where.append(np.minimum.reduceat(at, starts, axis=0))
    raw = np.hstack(top) + model["b"]
    return np.maximum(raw, 0.0), raw, where


def word_tables(model: dict, x: np.ndarray) -> list[list[np.ndarray]]:
    return [[x @ model[f"f{span}"][j] for j in range(span)] for span in SPANS]


def logits(model: dict, numbers: list[np.ndarray], tables: list) -> np.ndarray:
    line, starts = layout(numbers)
    return maxima(model, tables, line, starts)[0] @ model["u"] + model["c"]


class Adam:
    def __init__(self, model: dict, rate: float):
        self.m = {k: np.zeros_like(v) for k, v in model.items()}
        self.s = {k: np.zeros_like(v) for k, v in model.items()}
        self.rate, self.t = rate, 0

    def step(self, model: dict, grads: dict) -> None:
        self.t += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, (rows, g) in grads.items():
            m, s = self.m[k], self.s[k]
            m[rows] = 0.9 * m[rows] + 0.1 * g
            s[rows] = 0.999 * s[rows] + 0.001 * g * g
            model[k][rows] -= scale * m[rows] / (np.sqrt(s[rows]) + 1e-7)


def train(cells: np.ndarray, numbers: list[np.ndarray], y: np.ndarray, steps: int = STEPS) -> dict:
    rng = np.random.default_rng(11)
    model = {"e": rng.normal(0, 0.3, (CELLS, DIM)), "u": rng.normal(0, 0.3, FILTERS * len(SPANS)), "c": np.zeros(1), "b": np.zeros(FILTERS * len(SPANS))}
    for span in SPANS:
        model[f"f{span}"] = rng.normal(0, 0.5 / span, (span, DIM, FILTERS))
    adam, everything = Adam(model, 0.004), slice(None)
    while adam.t < steps:
        order = rng.permutation(len(y))
        for at in range(0, len(order), 48):
            pick = order[at : at + 48]
            line, starts = layout([numbers[i] for i in pick])
            used, line = np.unique(line, return_inverse=True)
            if used[0] != 0:
                raise AssertionError("a layout has gaps")
            # Pieces drop out at random, so that no rare form is learned by heart.
            mask = (rng.random((len(used), PIECES)) >= DROP) / (1 - DROP) / PIECES
            mask[0] = 0.0
            x = np.einsum("npd,np->nd", model["e"][cells[used]], mask)
            top, raw, where = maxima(model, word_tables(model, x), line, starts, places=True)
            error = (sigmoid(top @ model["u"] + model["c"]) - y[pick]) / len(pick)
            grads = {"u": (everything, top.T @ error), "c": (everything, np.array([error.sum()]))}
            back = error[:, None] * model["u"] * (raw > 0)
            grads["b"] = (everything, back.sum(axis=0))
            dx = np.zeros_like(x)
            for k, span in enumerate(SPANS):
                g = back[:, k * FILTERS : (k + 1) * FILTERS]
                df = np.zeros_like(model[f"f{span}"])
                for j in range(span):
                    words = line[where[k] + j]
                    df[j] = np.einsum("tf,tfd->df", g, x[words])
                    np.add.at(dx, words.ravel(), (g[:, :, None] * model[f"f{span}"][j].T[None]).reshape(-1, DIM))
                grads[f"f{span}"] = (everything, df)
            dx[0] = 0.0
            moved = np.flatnonzero(np.abs(dx).any(axis=1))
            rows, place = np.unique(cells[used[moved]].ravel(), return_inverse=True)
            de = np.zeros((len(rows), DIM))
            np.add.at(de, place.ravel(), (dx[moved][:, None, :] * mask[moved][:, :, None]).reshape(-1, DIM))
            de += DECAY * model["e"][rows]
            grads["e"] = (rows, de)
            adam.step(model, grads)
    return {k: v.astype(np.float32) for k, v in model.items()}


def threshold(raw: np.ndarray, y: np.ndarray, clean: float) -> float:
    """The logit with the best F1, halfway to the next lower one; each clean row stands for ``clean`` rows."""
    order = np.argsort(-raw, kind="stable")
    hits = np.cumsum(y[order])
    false = np.cumsum(1 - y[order]) * clean
    f1 = 2 * hits / (hits + false + y.sum())
    at = int(f1.argmax())
    last = raw[order[at]]
    below = raw[order[at + 1]] if at + 1 < len(y) else last - 2.0
    return float((last + below) / 2)


def _text_cells(batches):
    for batch in batches:
        for part, texts in chunks([batch], "text"):
            packed = []
            for t in texts:
                packed.append("\x00".join(WORD.findall(t.lower())))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.string())], ["label", "words"])


def _odds(labels: DataFrame, column: str) -> float:
    known = labels.filter(learnable(F.col("doc_id")) & F.col(column).isNotNull())
    n = {r[0]: r[1] for r in known.groupBy(F.col(column).cast("int")).count().collect()}
    return n.get(0, 0) / max(1, n.get(1, 0))


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", per_class: int = PER_CLASS) -> dict | None:
    frame = labelled(docs, labels, column, per_class).mapInArrow(_text_cells, "label int, words string").toPandas()
    if frame.empty or frame["label"].nunique() < 2:
        return None
    frame = frame.sort_values(["label", "words"], kind="stable").reset_index(drop=True)
    words = Words()
    numbers = [words.numbers(w) for w in frame["words"]]
    cells, hints, y = words.table(), np.array(words.hints), frame["label"].to_numpy(dtype=float)
    spare = np.random.default_rng(5).random(len(y)) < 1 / 3
    model = train(cells, [n for n, s in zip(numbers, spare) if not s], y[~spare])
    tables = word_tables(model, vectors(model, cells))
    raw = np.concatenate([logits(model, numbers[a : a + 64], tables) for a in range(0, len(y), 64)])
    # The sample balances the labels; thresholds are for their shares in all learnable rows.
    clean = _odds(labels, column) / max(1e-9, (y == 0).sum() / (y == 1).sum())
    common = threshold(raw[spare], y[spare], clean) if y[spare].any() else 0.0
    langs = language(numbers, hints)
    cut = np.full(len(LANGS), common)
    for k in range(len(LANGS)):
        own = spare & (langs == k)
        if y[own].sum() >= 20 and (y[own] == 0).sum() >= 20:
            cut[k] = threshold(raw[own], y[own], clean)
    # Few calibration rows must not pull the threshold far below even odds.
    model["cut"] = np.maximum(cut, -1.5)
    return model


class Scorer:
    """Scores of texts; the word tables grow with the words that come and start anew when they are many."""

    def __init__(self, model: dict | None):
        self.model, self.words, self.tables = model, Words(), None

    def __call__(self, texts: list[str]) -> np.ndarray:
        if self.model is None:
            return np.zeros(len(texts))
        if len(self.words.hints) > REMEMBERED:
            self.words.clear()
            self.tables = None
        numbers = [self.words.numbers(t) for t in texts]
        done = 0 if self.tables is None else len(self.tables[0][0])
        fresh = self.words.table(done)
        if len(fresh):
            x = self.model["e"][fresh].mean(axis=1)
            if not done:
                x[0] = 0.0
            more = word_tables(self.model, x)
            self.tables = more if self.tables is None else [
                [np.concatenate(p) for p in zip(old, new)] for old, new in zip(self.tables, more)
            ]
        raw = logits(self.model, numbers, self.tables).astype(float)
        cut = self.model["cut"][language(numbers, np.array(self.words.hints))]
        return sigmoid(raw - cut + np.log(CUT / (1 - CUT)))


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; 0.7 is the calibrated threshold of the text's language."""
    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            for part, texts in chunks([batch], "text", 1 << 20):
                p = scorer(texts)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array(p, pa.float64()), pa.array((p >= CUT).astype(np.int32)),
                ], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def clean(docs: DataFrame, model: dict | None) -> DataFrame:
    """The documents below the threshold, all their columns; a pure filter of rows."""
    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            for part, texts in chunks([batch], "text", 1 << 20):
                yield part.filter(pa.array(scorer(texts) < CUT))

    return docs.mapInArrow(run, docs.schema)


@query("op5_toxicity")
def op5_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
