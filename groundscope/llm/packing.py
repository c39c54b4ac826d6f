"""Operator 1: pack documents into sequences by hierarchical residual best-fit packing.

Each scan partition tokenises its documents and packs their pieces best-fit, longest first. Bins that are
nearly full are done. Bins with more room go on as items to the next round, where several partitions are
merged into one and packed best-fit again, and so on up to a single partition. A round never gives one task
more than ``TASK_BINS`` open bins: with more than that the rounds keep that many partitions and end when the
number of open bins stops to fall. What counts as nearly full loosens with each round, so the rounds shrink.

Every round sorts its items by length and key before it packs and is written to the shared checkpoint
folder, so a lost executor recomputes the same bins.

Tokenising: white space always separates words of the vocabulary, and so does the edge between letters and
signs where a text has no digits, apostrophes or rare characters. A worker encodes each distinct word once and
joins the ids; odd chunks between white space are encoded as they are, and texts that hold the start of a
special token or the four ASCII separators that the vocabulary does not treat as white space are encoded whole.

Defined results: null text is the empty text, whose only id is the end id 1; documents above the capacity
are cut into pieces of the capacity, the last may be shorter; repeated rows are packed as often as they
occur; an empty table gives no sequence; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import re
import sys
import types
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundscope.llm.common import shelve, table
from groundscope.llm.registry import query

CAPACITY, END_ID = 4096, 1
#: Words remembered by a worker at once, open bins of a task of a merge round.
REMEMBERED, TASK_BINS = 500_000, 50_000
#: Room in tokens that a bin may have after each round to count as nearly full; partitions merged by a round.
NEARLY, MERGE = (8, 16, 32, 64, 128, 256), 8
#: Lower-case texts of Latin-1 letters and ASCII signs without apostrophes: their words are runs of either.
PLAIN = re.compile("[a-zß-öø-ÿ!-&(-/:-@[-`{-~ \t\n\r]*")
RUNS = re.compile("[a-zß-öø-ÿ]+|[!-&(-/:-@[-`{-~]+")
#: White space for Python but not for the vocabulary.
SEPARATORS = re.compile("[\x1c-\x1f]")


class Encoder:
    """Ids of whole texts, little-endian unsigned 32-bit, by a cache of words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, number in vocabulary.items():
            self.last[number] = token.endswith("</w>")
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, runs: list[str]) -> None:
        """Encode distinct runs in one call; each is one word, which ends at its only word-end token."""
        ids = np.array(self.tokenizer.encode(" ".join(runs), add_special_tokens=False).ids, dtype="<u4")
        ends = 4 * (np.flatnonzero(self.last[ids]) + 1)
        raw, starts = ids.tobytes(), [0, *ends[:-1].tolist()]
        self.known.update((r, raw[a:b]) for r, a, b in zip(runs, starts, ends.tolist(), strict=True))

    def encode(self, text: str) -> bytes:
        low = text.lower()
        if "<|" in text:
            return self.whole(text)
        if PLAIN.fullmatch(low):
            parts = RUNS.findall(low)
        elif SEPARATORS.search(text):
            return self.whole(text)
        else:
            parts = []
            for chunk in text.split():
                if PLAIN.fullmatch(small := chunk.lower()):
                    parts += RUNS.findall(small)
                else:
                    # A marked key: the chunk as it is, never a run of its lower-case form.
                    parts.append("\n" + chunk)
        if len(self.known) > REMEMBERED:
            self.known = {}
        fresh = set(parts).difference(self.known)
        if fresh:
            runs = []
            for p in fresh:
                if p[0] == "\n":
                    self.known[p] = self.whole(p[1:])
                else:
                    runs.append(p)
            if runs:
                self.learn(runs)
        return b"".join(map(self.known.__getitem__, parts))


def encoder(path: str) -> Encoder:
    """The encoder of this worker process, which later tasks of the process use again."""
    held = sys.modules.setdefault("_groundscope_encoders", types.ModuleType("_groundscope_encoders")).__dict__
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each item, in the given order; the tightest open bin takes an item."""
    bins, offsets = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    some, made = 0, 0  # bit r of ``some``: a bin with room r exists
    for i, size in enumerate(sizes.tolist()):
        fitting = some >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            number = free[room].pop()
            if not free[room]:
                some ^= 1 << room
        else:
            room, number = capacity, made
            made += 1
        bins[i], offsets[i] = number, capacity - room
        left = room - size
        if left:
            free[left].append(number)
            some |= 1 << left
    return bins, offsets


KEY = ["doc_id", "piece", "start", "ids_crc32"]


def pack(items: pd.DataFrame, base: int, nearly: int) -> pd.DataFrame:
    """One round over the items of a task: rows are pieces, ``bin`` groups them, ``at`` is the place in it."""
    items = items.sort_values([*KEY, "length", "bin", "at"], kind="stable", ignore_index=True)
    number, first = pd.factorize(items["bin"])
    sizes = np.bincount(number, items["length"], minlength=len(first)).astype(np.int64)
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    bins[order], offsets[order] = best_fit(sizes[order])
    fill = np.bincount(bins, sizes) if len(bins) else np.zeros(0)
    items["at"] = items["at"].to_numpy() + offsets[number]
    items["bin"] = base + bins[number]
    items["done"] = fill[bins[number]] >= CAPACITY - nearly
    return items


def _base(round_number: int) -> int:
    """First bin number of the running task in this round."""
    from pyspark import TaskContext

    return (round_number << 56) | (TaskContext.get().partitionId() << 32)


COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "at", "done"]


def pieces(batches, tokenizer: str):
    """Pieces of the documents of a partition, packed locally."""
    encode, rows = encoder(tokenizer).encode, []
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = encode(text.as_py() or "") + END_ID.to_bytes(4, "little")
            for piece, start in enumerate(range(0, len(ids) // 4, CAPACITY)):
                part = ids[4 * start : 4 * (start + CAPACITY)]
                rows.append((doc_id, piece, start, len(part) // 4, zlib.crc32(part)))
    items = pd.DataFrame(rows, columns=COLUMNS[:5])
    items["bin"], items["at"] = np.arange(len(items)), 0
    return items


def pack_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): one row per piece."""
    kind = docs.schema["doc_id"].dataType
    schema = f"doc_id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long, bin long, at long, done boolean"

    def to_batches(items: pd.DataFrame):
        items["doc_id"] = items["doc_id"].astype(object).where(items["doc_id"].notna(), None)
        arrow = pa.Table.from_pandas(items[COLUMNS], schema=arrow_schema, preserve_index=False)
        yield from arrow.to_batches(max_chunksize=20_000)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow_schema = to_arrow_schema(StructType.fromDDL(schema))

    def first(batches):
        yield from to_batches(pack(pieces(batches, tokenizer), _base(0), NEARLY[0]))

    def again(number: int, nearly: int):
        def run(batches):
            held = [b for b in batches if b.num_rows]
            if held:
                items = pa.Table.from_batches(held).to_pandas(integer_object_nulls=True)
                yield from to_batches(pack(items, _base(number), nearly))

        return run

    state = shelve(docs.select("doc_id", "text").mapInArrow(first, schema))
    finished = state.filter("done")
    parts, number, before = max(1, state.rdd.getNumPartitions()), 0, None
    while True:
        still = state.filter("not done")
        bins = still.select("bin").distinct().count()
        if not bins:
            break
        least = -(-bins // TASK_BINS)
        parts = max(least, -(-parts // MERGE))
        number += 1
        alone = parts == 1 or (before is not None and parts == least and bins > 0.9 * before)
        before = bins
        nearly = CAPACITY if alone else NEARLY[min(number, len(NEARLY) - 1)]
        state = shelve(still.repartition(parts, "bin").mapInArrow(again(number, nearly), schema))
        finished = finished.union(state.filter("done"))
    return finished.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))


@query("op1_packing")
def op1_packing(spark, sf_dir):
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
