"""Operator 11: ranked lexical search, term at a time with a limited set of accumulators.

The items are the queries, all documents are searched. Items are taken in blocks of about ``ITEM_BYTES``, so
neither the driver nor a task ever holds more of them; each block is one run over the documents:

1. Index: every document is split into terms once. Each task inverts its documents into blocks of about
   ``BLOCK_POSTINGS`` postings (term, document, occurrences) of the terms that the items use, and counts the terms
   of all its documents, used or not. The blocks are written to the shared folder.
2. Statistics over all documents: how many have a term at all, how many terms they have together, and for each
   used term how many hold it; from these the weights.
3. Search: in each index block an item's terms are taken rarest first. While accumulators may be created, a
   term adds its gains to all documents that hold it. As soon as the sum of the greatest gains of the terms still
   to come cannot reach the k-th greatest partial score - or the k-th score that the task has found in earlier
   blocks - no accumulator is created any more, those that cannot reach it are given up, and the others get the
   gains of the remaining terms exactly. A task returns its k best documents of an item; the last step merges
   them.

All scores are 64-bit integers; a document is only given up if it stays below the k-th score, so ties are kept and
go to the smaller id.

Defined results: a null or empty text has no terms; documents without an id take no part, neither do items
without one; repeated items (same id and text) count once, and an item id with several texts is ranked for
each of them; a document id that repeats is a document for each row; other columns are not read. Texts of any
length are read whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundscope.llm.common import chunks, shelve, table
from groundscope.llm.registry import query
from groundscope.operators.ranking import top_k

#: Documents of an item; share of the document length in a score, in hundredths; bytes of items of a run; postings and documents of an index block.
K, LENGTH_SHARE, ITEM_BYTES, BLOCK_POSTINGS, BLOCK_DOCS = 10, 75, 8 << 20, 1 << 20, 1 << 15
#: ASCII characters other than digits and letters part the terms; A to Z become a to z.
FOLD = bytes(c if c >= 128 or chr(c).isalnum() and not 65 <= c <= 90 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
INDEX = "ids binary, sizes binary, terms binary, starts binary, places binary, counts binary, n_docs long, n_terms long"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def item_blocks(items: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """The items by id and text, in lists of about ``ITEM_BYTES``; one list at a time is on the driver."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    rows = rows.filter("item_id IS NOT NULL AND text IS NOT NULL").distinct().orderBy("item_id", "text")
    block, held = [], 0
    for item_id, text in rows.toLocalIterator():
        block.append((item_id, bytes(text)))
        held += len(text) + 64
        if held >= ITEM_BYTES:
            yield block
            block, held = [], 0
    if block:
        yield block


def inverted(ids: list[int], sizes: list[int], places: list[np.ndarray], words: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Postings by term and document: the terms, where each begins, documents and occurrences."""
    width = max(1, len(ids))
    pairs = np.concatenate(words) * width + np.concatenate(places) if words else np.empty(0, dtype=np.int64)
    pairs, counts = np.unique(pairs, return_counts=True)
    word, place = pairs // width, pairs % width
    terms, starts = np.unique(word, return_index=True)
    return (np.array(ids, np.int64), np.array(sizes, np.int64), terms, np.append(starts, len(word)), place, counts.astype(np.int64))


def build_index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Index blocks of the documents for the terms of the vocabulary, with the counts over all terms."""

    def run(batches):
        ids, sizes, places, words, held = [], [], [], [], 0

        def block():
            arrays = [pa.array([a.astype(np.int64).tobytes()], pa.binary()) for a in inverted(ids, sizes, places, words)]
            numbers = [pa.array([n], pa.int64()) for n in (sum(s > 0 for s in sizes), sum(sizes))]
            return pa.RecordBatch.from_arrays(arrays + numbers, names=["ids", "sizes", "terms", "starts", "places", "counts", "n_docs", "n_terms"])

        for part, texts in chunks(batches, "text"):
            for doc_id, text in zip(part.column(0).to_pylist(), texts):
                split = terms_of(text or b"")
                known = np.fromiter(map(vocabulary.get, split, repeat(-1)), dtype=np.int64, count=len(split))
                known = known[known >= 0]
                places.append(np.full(len(known), len(ids)))
                words.append(known)
                ids.append(doc_id)
                sizes.append(len(split))
                held += len(known)
                if held >= BLOCK_POSTINGS or len(ids) >= BLOCK_DOCS:
                    yield block()
                    ids, sizes, places, words, held = [], [], [], [], 0
        if ids:
            yield block()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).filter("doc_id IS NOT NULL")
    return rows.mapInArrow(run, INDEX)


def document_counts(index: DataFrame) -> dict[int, int]:
    """For each used term how many documents hold it."""

    def run(frames):
        for frame in frames:
            for terms, starts in zip(frame["terms"], frame["starts"]):
                yield pd.DataFrame({"term": np.frombuffer(terms, np.int64), "held": np.diff(np.frombuffer(starts, np.int64))})

    counted = index.select("terms", "starts").mapInPandas(run, "term long, held long").groupBy("term").agg(F.sum("held").alias("held"))
    return {r["term"]: r["held"] for r in counted.collect()}


class Block:
    """An index block with the gains of its postings for a term of weight 1."""

    def __init__(self, ids, sizes, terms, starts, places, counts, vocabulary: int, n_docs: int, n_terms: int):
        self.ids, sizes, self.terms, self.starts, self.places, counts = (np.frombuffer(x, np.int64) for x in (ids, sizes, terms, starts, places, counts))
        length = 100 - LENGTH_SHARE + (LENGTH_SHARE * sizes * n_docs) // n_terms
        self.gains = (1_000_000_000 * counts) // (1000 * counts + 8 * length[self.places])
        self.peaks = np.maximum.reduceat(self.gains, self.starts[:-1]) if len(self.terms) else np.empty(0, np.int64)
        self.at = np.full(vocabulary, -1)
        self.at[self.terms] = np.arange(len(self.terms))

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(document places, scores) of at least ``floor``: the k best. ``terms`` are rarest first."""
        at = self.at[terms]
        weights, at = weights[at >= 0], at[at >= 0]
        bounds = weights * self.peaks[at]
        rest = np.append(np.cumsum(bounds[::-1])[::-1], 0)
        none = np.empty(0, np.int64)
        if rest[0] < floor:
            return none, none
        score = np.zeros(len(self.ids), dtype=np.int64)
        known, alive = floor, None
        for j, (term, weight) in enumerate(zip(at.tolist(), weights.tolist())):
            first, last = self.starts[term], self.starts[term + 1]
            held, gains = self.places[first:last], self.gains[first:last]
            if alive is not None:
                mine = alive[held]
                held, gains = held[mine], gains[mine]
            score[held] += weight * gains
            if alive is None:
                if len(score) >= k and rest[j + 1] < score.max():
                    known = max(known, int(np.partition(score, len(score) - k)[len(score) - k]))
                if rest[j + 1] < known:
                    alive = score + rest[j + 1] >= known
        best = np.flatnonzero(score >= known)
        return best, score[best]


def search_index(index: DataFrame, asked: list[tuple[np.ndarray, np.ndarray]], vocabulary: int, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, doc_id, score): each task's k best documents of each item, given as terms and weights."""

    def run(frames):
        best = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(asked)
        for frame in frames:
            for row in frame.itertuples(index=False):
                block = Block(*row, vocabulary, n_docs, n_terms)
                for i, (terms, weights) in enumerate(asked):
                    ids, scores = best[i]
                    floor = max(1, int(scores[-1])) if len(scores) == k else 1
                    places, more = block.search(terms, weights, k, floor)
                    if len(places):
                        ids, scores = np.append(ids, block.ids[places]), np.append(scores, more)
                        order = np.lexsort((ids, -scores))[:k]
                        best[i] = ids[order], scores[order]
        for i, (ids, scores) in enumerate(best):
            if len(ids):
                yield pd.DataFrame({"item": i, "doc_id": ids, "score": scores})

    return index.select("ids", "sizes", "terms", "starts", "places", "counts").mapInPandas(run, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of greatest score of each item."""
    spark = docs.sparkSession
    out = []
    for block in item_blocks(items):
        words = [Counter(terms_of(text)) for _, text in block]
        vocabulary = {t: i for i, t in enumerate(sorted(set().union(*words)))}
        index = shelve(build_index(docs, vocabulary))
        n_docs, n_terms = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        if not n_docs:
            continue
        held = document_counts(index)
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in held.items()}
        asked = []
        for found in words:
            used = sorted((held[vocabulary[t]], vocabulary[t], n) for t, n in found.items() if vocabulary[t] in held)
            asked.append((np.array([t for _, t, _ in used], np.int64), np.array([n * weight[t] for _, t, n in used], np.int64)))
        near = search_index(index, asked, len(vocabulary), n_docs, n_terms, k)
        ranked = top_k(near, ["item"], [F.col("score").desc(), F.col("doc_id")], k)
        ids = spark.createDataFrame(list(enumerate(i for i, _ in block)), "item long, item_id long")
        out.append(shelve(ranked.join(ids, "item").select("item_id", "rank", "doc_id", "score")))
    whole = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for part in out:
        whole = whole.union(part)
    return whole


TERMS = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
ORACLE = f"""
WITH said AS (SELECT doc_id, {TERMS} AS term FROM documents),
sizes AS (SELECT doc_id, count(*) AS n FROM said GROUP BY doc_id),
whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
asked AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, {TERMS} AS term FROM benchmark) GROUP BY item_id, term),
held AS (SELECT doc_id, term, count(*) AS tf FROM said WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM held GROUP BY term), whole),
gains AS (SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)) AS gain
  FROM held JOIN sizes USING (doc_id), whole),
scores AS (SELECT item_id, doc_id, CAST(sum(c * w * gain) AS BIGINT) AS score
  FROM asked JOIN gains USING (term) JOIN weights USING (term) GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0
) WHERE rank <= 10
"""


@query("op11_lexical", ORACLE)
def op11_lexical(spark, sf_dir):
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
