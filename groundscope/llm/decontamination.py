"""Operator 3: benchmark passages in documents, within an error budget, by pigeonhole edit matching.

Texts are compared as their lower-case words (letters, digits, underscore) with one space between. An item
of n characters may differ by ``RATE`` * n edits, rounded down. It is cut into budget + 1 pieces: whoever has
at most that many edits keeps one piece whole. All pieces of a block of items are found in one pass over a
document; hits of an item on near diagonals form one window. A window whose trigrams cannot reach the bound
(an edit destroys three at most) is dropped, the rest is verified by Myers' bit-parallel distance, forwards
for the end and backwards for the start of the best place.

Documents are never shuffled and never cut. Items are taken in blocks of at most about ``BLOCK_CHARS``
characters; only one block at a time is on the driver and with the tasks, so the benchmark may grow.

Defined results: null and empty texts and items match nothing; items of fewer than ``SHORT`` characters have
no budget and match whole words only; equal items are reported each; of several places of an item in a
document the best is reported, the first at a tie; repeated documents are reported each; an empty table
gives no rows; only ``doc_id``/``text`` and ``item_id``/``text`` are read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from groundscope.llm.common import table
from groundscope.llm.registry import query

RATE, SHORT, BLOCK_CHARS = 0.08, 25, 4_000_000
WORD = re.compile(r"\w+")


def normal(text: str | None) -> str:
    return " ".join(WORD.findall((text or "").lower()))


def myers(pattern: str, text: str) -> tuple[int, int]:
    """Smallest edit distance of the pattern to any substring of the text, and the first end of such one."""
    m = len(pattern)
    peq: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        peq[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    get = peq.get
    for j, c in enumerate(text, 1):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, end = score, j
    return best, end


class Matcher:
    """The pieces of one block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick

        self.items = [(i, t, int(len(t) * RATE) if len(t) >= SHORT else 0) for i, t in items if t]
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (_, text, budget) in enumerate(self.items):
            for k in range(budget + 1):
                a, b = len(text) * k // (budget + 1), len(text) * (k + 1) // (budget + 1)
                places[text[a:b]].append((n, a))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()
        self.trigrams: dict[int, list[str]] = {}

    def matches(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(item number, distance, start, end) of the best place of each item in a normalised text."""
        if not self.items or not text:
            return
        found: dict[int, set[int]] = {}
        for end, (length, where) in self.automaton.iter(text):
            for n, a in where:
                found.setdefault(n, set()).add(end + 1 - length - a)
        for n, diagonals in found.items():
            best = None
            for low, high in self._windows(n, sorted(diagonals)):
                got = self._verify(n, text, low, high)
                if got and (best is None or got[0] < best[0]):
                    best = got
            if best:
                yield (n, *best)

    def _windows(self, n: int, diagonals: list[int]) -> Iterator[tuple[int, int]]:
        _, item, budget = self.items[n]
        low = high = diagonals[0]
        for d in diagonals[1:]:
            if d - high > max(budget, 1):
                yield low - budget, high + len(item) + budget
                low = d
            high = d
        yield low - budget, high + len(item) + budget

    def _verify(self, n: int, text: str, low: int, high: int) -> tuple[int, int, int] | None:
        _, item, budget = self.items[n]
        low = max(0, low)
        window = text[low:high]
        if not budget:
            at = f" {text} ".find(f" {item} ", low)
            return (0, at, at + len(item)) if 0 <= at <= high else None
        at = window.find(item)
        if at >= 0:
            return 0, low + at, low + at + len(item)
        if n not in self.trigrams:
            self.trigrams[n] = [item[i : i + 3] for i in range(len(item) - 2)]
        grams = self.trigrams[n]
        if sum(map(window.__contains__, grams)) < len(grams) - 3 * budget:
            return None
        distance, end = myers(item, window)
        if distance > budget:
            return None
        _, back = myers(item[::-1], window[:end][::-1])
        return distance, low + end - back, low + end


def item_blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Normalised items, a bounded block at a time."""
    items = items.select("item_id", "text").filter(F.col("text").isNotNull())
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // BLOCK_CHARS))
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        yield sorted(((r["item_id"], normal(r["text"])) for r in rows), key=lambda r: (r[0] is None, r[0], r[1]))


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, distance, start, end): places in the normalised text."""
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, distance int, start int, end int"
    item_type, found = to_arrow_type(items.schema["item_id"].dataType), None
    for block in item_blocks(items):
        def run(batches, block=block):
            matcher = Matcher(block)
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    for n, distance, start, end in matcher.matches(normal(text.as_py())):
                        rows.append((doc_id, matcher.items[n][0], distance, start, end))
                names = ["doc_id", "item_id", "distance", "start", "end"]
                columns = list(zip(*rows)) or [[]] * 5
                types = [batch.schema.field(0).type, item_type, pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        part = docs.select("doc_id", "text").mapInArrow(run, schema)
        found = part if found is None else found.union(part)
    return found


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without any match, all their columns; a pure filter of rows."""
    place = docs.columns.index("text")
    for block in item_blocks(items):
        def run(batches, block=block):
            matcher = Matcher(block)
            for batch in batches:
                keep = [next(matcher.matches(normal(t.as_py())), None) is None for t in batch.column(place)]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


@query("op3_decontamination")
def op3_decontamination(spark, sf_dir):
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
