"""Operator 12: periodic runs of words by multi-scale minimizers.

A run is a stretch of words with smallest period q and at least ``max(12, 2 * q)`` words that no neighbouring
word extends. Texts are split into words and numbered per slice of a batch; a slice is one array of word
numbers in which a number of its own separates the texts, so no match leaves a text.

* Periods below ``SHORT`` are found by direct lag scans: stretches of equal words q apart.
* Scale Q finds the periods from Q to 2Q - 1. A run of such a period holds two equal windows of Q/2 words, q
  apart, so the least gram hash of these windows (grams of Q/4 words, Q/4 grams a window) stands in both, q
  apart. Pairs of equal minimizers Q to 2Q - 1 apart are the seeds; each is extended word by word in both
  directions, and what is long enough is a run. Hash collisions only cost an extension.
* Grams that have a period of at most Q/16 themselves stand at every period of a run that smaller scales have
  found and would seed all pairs within it; they are left out. Equal grams that remain are more than Q/16
  apart, so a minimizer has a bounded number of partners. Only a run whose first q words lie inside one such
  short-period run and the rest inside the next of the same period, overlapping it, has no seed then; these are
  seeded from the border of the two.

Stretches found by a multiple of their period have the same ends as the run of the smallest period: of equal
ends the smallest period stays.

Defined results: a null text or one without words has no run and an empty collapsed text; repeated rows and
ids give a row each; a null id is carried along; texts of any length are read whole, each by one task; other
columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundscope.llm.common import chunks, table
from groundscope.llm.registry import query

#: Fewest words of a run; periods below this are scanned lag by lag, and the first scale begins here.
LEAST, SHORT = 12, 64
#: Bytes of text in one array.
SLICE = 4 << 20
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
RUNS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary"


def lag_runs(x: np.ndarray, q: int) -> np.ndarray:
    """(start, end, q) of the stretches of at least ``max(LEAST, 2q)`` words with period q."""
    if len(x) <= q:
        return np.empty((0, 3), dtype=np.int64)
    same = np.zeros(len(x) - q + 2, dtype=np.int8)
    same[1:-1] = x[q:] == x[:-q]
    edges = np.flatnonzero(same[1:] != same[:-1])
    starts, ends = edges[::2], edges[1::2] + q
    long = ends - starts >= max(LEAST, 2 * q)
    return np.column_stack([starts[long], ends[long], np.full(int(long.sum()), q)])


def smallest(found: list[np.ndarray]) -> np.ndarray:
    """Of rows with equal ends the one of the smallest period, by start and period."""
    rows = np.concatenate(found) if found else np.empty((0, 3), dtype=np.int64)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), dtype=bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[first]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def gram_hashes(x: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the grams of ``size`` words, a power of two, at each place."""
    h = (x.astype(np.int64).view(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    span = 1
    while span < size:
        h = h[:-span] * np.uint64(0xD6E8FEB86659FD93) + h[span:]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        span *= 2
    return h


def minimizers(values: np.ndarray, window: int) -> np.ndarray:
    """Places that hold the leftmost least value of some window; ``window`` is a power of two."""
    best, place = values, np.arange(len(values))
    span = 1
    while span < window:
        if len(best) <= span:
            return place[:0]
        later = best[span:] < best[:-span]
        best = np.where(later, best[span:], best[:-span])
        place = np.where(later, place[span:], place[:-span])
        span *= 2
    place = place[best != NONE]
    return place[np.diff(place, prepend=-1) > 0]


def seeds(x: np.ndarray, known: np.ndarray, scale: int) -> np.ndarray:
    """(period, place) pairs of equal minimizers ``scale`` to ``2 * scale - 1`` apart."""
    gram = scale // 4
    if len(x) < 2 * scale:
        return np.empty((0, 2), dtype=np.int64)
    values = gram_hashes(x, gram)
    values[values == NONE] = 0
    periodic = known[(known[:, 2] <= gram // 4) & (known[:, 1] - known[:, 0] >= gram)]
    if len(periodic):
        cover = np.zeros(len(values) + 1, dtype=np.int64)
        np.add.at(cover, periodic[:, 0], 1)
        np.add.at(cover, periodic[:, 1] - gram + 1, -1)
        values[np.cumsum(cover[:-1]) > 0] = NONE
    place = minimizers(values, gram)
    order = np.argsort(values[place], kind="stable")
    place, value = place[order], values[place][order]
    found, apart = [], 1
    while apart < len(place):
        far = place[apart:] - place[:-apart]
        near = (value[apart:] == value[:-apart]) & (far < 2 * scale)
        if not near.any():
            break
        near &= far >= scale
        found.append(np.column_stack([far[near], place[:-apart][near]]))
        apart += 1
    return np.concatenate(found) if found else np.empty((0, 2), dtype=np.int64)


def border_seeds(x: np.ndarray, known: np.ndarray, scale: int) -> np.ndarray:
    """(period, place) of runs that lie in two overlapping runs of one much smaller period."""
    rows = known[(known[:, 2] <= scale // 16) & (known[:, 1] - known[:, 0] >= scale)]
    rows = rows[np.lexsort((rows[:, 0], rows[:, 2]))]
    found = []
    for (start, end, p), (begin, stop, other) in zip(rows[:-1].tolist(), rows[1:].tolist()):
        if p != other or begin > end:
            continue
        word = x[begin : begin + p]
        shift = next((d for d in range(p) if np.array_equal(x[end - p - d : end - d], word)), None)
        if shift is None:
            continue
        least = begin - (end - p - shift)
        periods = np.arange(scale + (least - scale) % p, min(2 * scale, min(end - start, stop - begin) + 1), p)
        found.append(np.column_stack([periods, np.maximum(start, begin - periods)]))
    return np.concatenate(found) if found else np.empty((0, 2), dtype=np.int64)


def reach(x: np.ndarray, place: int, q: int) -> tuple[int, int]:
    """The longest stretch of places around ``place`` with equal words q apart; separators end it."""
    if x[place] != x[place + q]:
        return place, place
    end, step = place, 64
    while True:
        b = x[end + q : end + q + step]
        differ = x[end : end + len(b)] != b
        if differ.any():
            end += int(differ.argmax())
            break
        end += len(b)
        step *= 2
    start, step = place, 64
    while True:
        low = max(0, start - step)
        differ = x[low:start] != x[low + q : start + q]
        if differ.any():
            start -= int(differ[::-1].argmax())
            break
        start, step = low, step * 2
    return start, end


def extended(x: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Runs of the seeds, each stretch extended once."""
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    found = []
    for q, first, last in zip(*grouped(pairs[:, 0])):
        places, at = pairs[first:last, 1], 0
        while at < len(places):
            start, end = reach(x, int(places[at]), q)
            if end - start >= max(q, LEAST - q):
                found.append((start, end + q, q))
            at = max(at + 1, int(np.searchsorted(places, end)))
    return np.array(found, dtype=np.int64).reshape(-1, 3)


def grouped(values: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """The distinct values of a sorted array with the first and the last place (exclusive) of each."""
    first = np.flatnonzero(np.diff(values, prepend=-1))
    return values[first].tolist(), first.tolist(), np.append(first[1:], len(values)).tolist()


def find_runs(texts: list[np.ndarray]) -> np.ndarray:
    """(text, start, length, period) of all runs of the texts, which hold word numbers from 0."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    x, begins = joined(texts, np.arange(len(texts)))
    rows = smallest([lag_runs(x, q) for q in range(1, SHORT)])
    text = np.searchsorted(begins, rows[:, 0], side="right") - 1
    out = np.column_stack([text, rows[:, 0] - begins[text], rows[:, 1] - begins[text], rows[:, 2]])
    scale = SHORT
    while len(sizes) and 2 * scale <= sizes.max():
        chosen = np.flatnonzero(sizes >= 2 * scale)
        x, begins = joined(texts, chosen)
        number = np.full(len(texts), -1)
        number[chosen] = np.arange(len(chosen))
        part = out[number[out[:, 0]] >= 0]
        shift = begins[number[part[:, 0]]]
        known = np.column_stack([part[:, 1] + shift, part[:, 2] + shift, part[:, 3]])
        new = extended(x, np.concatenate([seeds(x, known, scale), border_seeds(x, known, scale)]))
        if len(new):
            at = np.searchsorted(begins, new[:, 0], side="right") - 1
            more = np.column_stack([chosen[at], new[:, 0] - begins[at], new[:, 1] - begins[at], new[:, 2]])
            out = np.concatenate([out, more])
            out = out[np.lexsort((out[:, 3], out[:, 2], out[:, 1], out[:, 0]))]
            first = np.ones(len(out), dtype=bool)
            first[1:] = (out[1:, :3] != out[:-1, :3]).any(axis=1)
            out = out[first]
        scale *= 2
    out = out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]
    out[:, 2] -= out[:, 1]
    return out


def joined(texts: list[np.ndarray], chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One array of the chosen texts, a negative number of its own before each and one at the end, and where each begins."""
    parts, begins, at = [], [], 0
    for number, i in enumerate(chosen.tolist()):
        parts += [np.array([-1 - number], dtype=np.int32), texts[i]]
        begins.append(at + 1)
        at += 1 + len(texts[i])
    parts.append(np.array([-1 - len(chosen)], dtype=np.int32))
    return np.concatenate(parts), np.array(begins, dtype=np.int64)


def collapse(docs: DataFrame, prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): all runs by start and period, and the text without what repeats in them.

    A word of a run behind its first ``period`` words is dropped; the rest is joined by one space.
    ``prepare`` may change the words of a text first.
    """

    def slices(batches):
        for part, texts in chunks(batches, "text", SLICE):
            ids = part.column(0).to_pylist()
            number = defaultdict(count().__next__)
            words = [(t or b"").split() for t in texts]
            if prepare is not None:
                words = [prepare(i, w) for i, w in zip(ids, words)]
            runs = find_runs([np.fromiter(map(number.__getitem__, w), dtype=np.int32, count=len(w)) for w in words])
            edges = np.searchsorted(runs[:, 0], np.arange(len(words) + 1))
            kept = []
            for i, w in enumerate(words):
                own = runs[edges[i] : edges[i + 1]]
                if len(own):
                    cover = np.zeros(len(w) + 1, dtype=np.int64)
                    np.add.at(cover, own[:, 1] + own[:, 3], 1)
                    np.add.at(cover, own[:, 1] + own[:, 2], -1)
                    w = compress(w, (np.cumsum(cover[:-1]) == 0).tolist())
                kept.append(b" ".join(w))
            fields = [pa.array(runs[:, c], pa.int64()) for c in (1, 2, 3)]
            lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(w) for w in words], pa.int64()), lists, pa.array(kept, pa.binary())],
                ["doc_id", "n_words", "runs", "collapsed"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(slices, RUNS)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a document whose id asks for it, made periodic from some word on."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    cycle = words[a : a + p]
    return words[:a] + (cycle * (-(-(n - a) // p)))[: n - a]


@query("op12_runs")
def op12_runs(spark, sf_dir):
    found = collapse(table(spark, sf_dir, "documents"), planted)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")
    best = found.withColumns({"best": longest, "listed": listed})
    length, period = F.col("best.length"), -F.col("best.period")
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(F.lit(1000) * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.col("listed").cast("binary"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
