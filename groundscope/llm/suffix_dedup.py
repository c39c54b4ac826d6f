"""Operator 6: remove repeated strings of ``LENGTH`` bytes by blockwise suffix sorting with a cover sample.

Units. Texts are strings of bytes and, if asked for, strings of words as well, each word being one unit: a run
of letters, digits and bytes above 127, or another byte by itself; white space only parts them. Both kinds are
sampled, sorted and compared alike, and a text loses what either kind finds.

Cover sample. Each string of ``LENGTH`` bytes chooses a place inside it: the one of its ``GRAM``-byte grams
with the smallest hash; of several equal ones the first, or the last if only the end of such a run lies in the
string, so that runs of a repeated phrase are anchored at their ends. Equal strings choose the same place:
the property of a difference cover, for the strings that matter here, with one place in about 170 bytes
instead of one in eleven. (A periodic cover of that length needs nine places in a hundred, and the names of
all of them exceed the disk limit of the check.) Neighbouring strings that choose one place form a row; places
are named by their gram. Names are counted first, by themselves: those that occur once in the corpus end there, and
with them their strings. The sample is then made a second time, and only rows with a repeated name are written.

Buckets. The strings of one name form a bucket. A bucket is sorted by itself: the members' bytes right of the
place and, reversed, left of it, each with the common lengths of neighbours. Two strings that
start o bytes left of the place are equal if and only if their members agree in o bytes to the left and
``LENGTH`` - o to the right, so the ranks of the two sorted sides, cut at these depths, resolve all ties
without comparing the strings again. Members whose strings are all equal are counted before the shuffle; one
of them represents them in the bucket. Buckets of more than ``BUCKET`` different members are
split: their strings are hashed one by one and counted.

Decisions on strings of bytes are exact inside buckets, those on words compare 64 bits of hash for each of the
words; names and surroundings are compared by two 64-bit digests that must both agree.

Defined results: null text is the empty text; texts shorter than ``LENGTH`` bytes keep all; overlapping
occurrences count, also within a text; rows that occur twice are repeats of each other; an empty table gives
no rows; documents are told apart by id and text; other columns are carried and never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundscope.llm.common import shelve, table
from groundscope.llm.registry import query

LENGTH, BUCKET = 400, 20_000
UNIT = {False: 1, True: 8}  # bytes of a unit of either kind
_rng = np.random.default_rng(1234567)
BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Classes of bytes: 0 white space, 1 part of a word, 2 a word by itself.
CLASS = np.full(256, 2, dtype=np.uint8)
CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
CLASS[[9, 10, 11, 12, 13, 32]] = 0
WORD = np.uint64(0xD6E8FEB86659FD93)  # tells the names of words from those of bytes
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def gram_size(length: int) -> int:
    return max(1, length // 6)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _C1
    h = (h ^ (h >> np.uint64(27))) * _C2
    return h ^ (h >> np.uint64(31))


class Powers:
    """Powers of the base and of its inverse modulo 2^64, as long as the longest text so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def reach(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 2 * len(self.up), 1 << 14)
            self.up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, BASE))])
            self.down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, INVERSE))])


def prefix_hash(units: np.ndarray, powers: Powers) -> np.ndarray:
    powers.reach(len(units) + 1)
    out = np.zeros(len(units) + 1, dtype=np.uint64)
    np.cumsum(units * powers.up[: len(units)], out=out[1:])
    return out


def encoded(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)


def word_edges(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words start and end."""
    kind = CLASS[raw]
    joined = (kind[1:] == 1) & (kind[:-1] == 1)
    starts = np.flatnonzero((kind > 0) & ~np.concatenate([[False], joined]))
    ends = np.flatnonzero((kind > 0) & ~np.concatenate([joined, [False]])) + 1
    return starts, ends


def word_units(raw: np.ndarray, powers: Powers) -> np.ndarray:
    """A 64-bit digest of every word."""
    if not len(raw):
        return np.zeros(0, dtype=np.uint64)
    starts, ends = word_edges(raw)
    sums = prefix_hash(BYTE[raw], powers)
    return mix((sums[ends] - sums[starts]) * powers.down[starts] + (ends - starts).astype(np.uint64)) | np.uint64(1)


def sliding(values: np.ndarray, width: int, fold: np.ufunc, fill) -> np.ndarray:
    """fold over each run of ``width`` values, by running folds within blocks from both sides."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, fill, dtype=values.dtype)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    left = fold.accumulate(grid, axis=1).ravel()
    right = fold.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return fold(right[: n - width + 1], left[width - 1 : n])


LOW = np.uint64(0xFFFFFFFF)


def gram_names(units: np.ndarray, length: int, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """The names of all grams, and the sums they come from."""
    k = gram_size(length)
    sums = prefix_hash(units, powers)
    return mix((sums[k:] - sums[:-k]) * powers.down[: len(units) - k + 1]), sums


def cover(units: np.ndarray, length: int, powers: Powers) -> tuple[np.ndarray, ...]:
    """Rows of the sample: first and last start of the strings, their place, its name, a digest of the strings."""
    width = length - gram_size(length) + 1
    names, sums = gram_names(units, length, powers)
    n = len(units)
    at = np.arange(len(names), dtype=np.uint64)
    # The upper half of the hash decides, the lower half holds the place, counted from either side.
    high = names & ~LOW
    most = np.iinfo(np.uint64).max
    left = (sliding(high | at, width, np.minimum, most) & LOW).astype(np.int64)
    right = (LOW - (sliding(high | (LOW - at), width, np.minimum, most) & LOW)).astype(np.int64)
    start = np.arange(n - length + 1)
    place = left
    if (right > left).any():
        # The distance from the first of several equal grams to the next one tells which end of a run is inside.
        order = np.argsort(high, kind="stable")
        after = np.zeros(len(high), dtype=np.int64)
        same = high[order[1:]] == high[order[:-1]]
        after[order[:-1][same]] = order[1:][same]
        gap = after[left] - left
        place = np.where((right > left) & (left - gap < start) & (right + gap < start + width), right, left)
    edge = np.flatnonzero(place[1:] != place[:-1]) + 1
    first, last = np.concatenate([[0], edge]), np.concatenate([edge - 1, [n - length]])
    place = place[first]
    whole = (sums[last + length] - sums[first]) * powers.down[first]
    shape = (place - first).astype(np.uint64) * np.uint64(1 << 32) + (last - first).astype(np.uint64)
    return first, last, place, names[place], mix(mix(whole) + shape * _C2)


def _covers(text: str | None, length: int, words: int, powers: Powers) -> Iterator[tuple[bool, tuple[np.ndarray, ...]]]:
    """The sample of a text by kind of units; words follow bytes."""
    raw = encoded(text)
    if len(raw) >= length:
        yield False, cover(BYTE[raw], length, powers)
    if words and len(raw) >= words:
        units = word_units(raw, powers)
        if len(units) >= words:
            first, last, place, names, strings = cover(units, words, powers)
            yield True, (first, last, place, names ^ WORD, strings)


def _names(length: int, words: int) -> Callable:
    """The names of the sample alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            found = [rows[3] for text in batch.column(0) for _, rows in _covers(text.as_py(), length, words, powers)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["name"])

    return run


def _sample(length: int, words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            found, rows, kinds = [], [], []
            for i, text in enumerate(batch.column(2)):
                for kind, columns in _covers(text.as_py(), length, words, powers):
                    found.append(columns)
                    rows.append(np.full(len(columns[0]), i))
                    kinds.append(np.full(len(columns[0]), kind))
            if found:
                take = pa.array(np.concatenate(rows))
                first, last, place, names, strings = (np.concatenate(c) for c in zip(*found))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(take), batch.column(1).take(take), pa.array(np.concatenate(kinds)),
                    *(pa.array(c.astype(np.int32)) for c in (first, last, place)), pa.array(names.view(np.int64)), pa.array(strings.view(np.int64)),
                ], ["doc_id", "h", "worded", "first", "last", "place", "name", "strings"])

    return run


def _surroundings(length: int, words: int) -> Callable:
    """The units left and right of the places that a bucket needs, ``UNIT`` bytes each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            rows = []
            for doc_id, h, text, places in zip(*(batch.column(i).to_pylist() for i in range(4))):
                raw = encoded(text)
                sides = {False: raw.tobytes()}
                if any(p["worded"] for p in places):
                    sides[True] = word_units(raw, powers).tobytes()
                for p in places:
                    side, unit, size = sides[p["worded"]], UNIT[p["worded"]], words if p["worded"] else length
                    a, middle, b = unit * p["first"], unit * p["place"], unit * (p["last"] + size)
                    rows.append((doc_id, h, p["worded"], p["place"], p["name"], p["hot"], side[a:middle], side[middle:b]))
            types = [batch.schema.field(0).type, pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
            columns = list(zip(*rows)) or [[]] * 8
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "h", "worded", "place", "name", "hot", "left", "right"]
            )

    return run


def common(sides: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of the strings, and how many bytes each has in common with the one before it."""
    order = sorted(range(len(sides)), key=sides.__getitem__)
    sizes = np.array([len(s) for s in sides])
    width = int(sizes.max())
    grid = np.zeros((len(sides), width + 1), dtype=np.uint8)
    for row, i in enumerate(order):
        grid[row, : sizes[i]] = np.frombuffer(sides[i], dtype=np.uint8)
    grid[:, width] = np.arange(len(sides)) & 1  # a difference behind the end
    shared = np.zeros(len(sides), dtype=np.int64)
    at = np.array(order)
    shared[1:] = np.minimum((grid[1:] != grid[:-1]).argmax(axis=1), np.minimum(sizes[at[1:]], sizes[at[:-1]]))
    return at, shared


def repeated(left: list[bytes], right: list[bytes], length: int, unit: int = 1) -> np.ndarray:
    """For each member and o: does the string that starts o units left of its place occur in another member?"""
    reach = length - gram_size(length)
    n, o = len(left), np.arange(reach + 1)
    ranks = []
    for sides, depth in (([s[::-1] for s in left], o), (right, length - o)):
        at, shared = common(sides)
        rank = np.zeros((n, reach + 1), dtype=np.int64)
        rank[at] = np.cumsum(shared[:, None] // unit < depth[None, :], axis=0)
        ranks.append(rank)
    key = ranks[0] * (n + 1) + ranks[1]
    fits = (np.array([len(s) for s in left])[:, None] >= unit * o) & (np.array([len(s) for s in right])[:, None] >= unit * (length - o))
    key = np.where(fits, key, -1 - np.arange(n)[:, None])
    order = np.argsort(key, axis=0, kind="stable")
    ordered = np.take_along_axis(key, order, axis=0)
    same = ordered[1:] == ordered[:-1]
    twin = np.zeros(key.shape, dtype=bool)
    twin[1:] |= same
    twin[:-1] |= same
    out = np.zeros(key.shape, dtype=bool)
    np.put_along_axis(out, order, twin, axis=0)
    return out & fits


def _sort_buckets(length: int, words: int) -> Callable:
    """Buckets in a sorted partition, one at a time; a bucket may go on in the next batch."""
    names = ["doc_id", "h", "worded", "place", "starts"]

    def solve(worded: bool, bucket: list[tuple]) -> list[tuple]:
        found, n = [], len(bucket)
        if n > 1:
            hit = repeated([b[3] for b in bucket], [b[4] for b in bucket], words if worded else length, UNIT[worded])
            for (doc_id, h, place, _, _), row in zip(bucket, hit):
                if row.any():
                    found.append((doc_id, h, worded, place, np.packbits(row).tobytes()))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, bucket, types = None, [], None
        for batch in batches:
            types = [batch.schema.field(0).type, pa.int64(), pa.bool_(), pa.int32(), pa.binary()]
            rows = []
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("name", "worded", "doc_id", "h", "place", "left", "right")]
            for name, worded, *member in zip(*columns):
                if (name, worded) != last and bucket:
                    rows += solve(last[1], bucket)
                    bucket = []
                last = name, worded
                bucket.append(tuple(member))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 5, types)], names)
        if bucket:
            rows = solve(last[1], bucket)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 5, types)], names)

    return run


def _strings(length: int, words: int) -> Callable:
    """Every string around the places of split buckets, as digests."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, h, worded, place, left, right in zip(*(
                batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "h", "worded", "place", "left", "right")
            )):
                unit, size = UNIT[worded], words if worded else length
                both, before, after = left + right, len(left) // unit, len(right) // unit
                for o in range(max(0, size - after), min(size - gram_size(size), before) + 1):
                    a = unit * (before - o)
                    rows.append((doc_id, h, worded, place, o, hashlib.blake2b(both[a : a + unit * size], digest_size=16).digest()))
            types = [batch.schema.field(0).type, pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 6, types)], ["doc_id", "h", "worded", "place", "o", "digest"]
            )

    return run


def covered(size: int, places: list[dict], length: int) -> list[list[int]]:
    """The runs of units, from first to behind the last, that repeated strings of one kind cover."""
    starts = np.zeros(size + 1, dtype=bool)
    for p in places:
        if p["starts"] is None:
            starts[p["first"] : p["last"] + 1] = True
        else:
            starts[p["first"] - np.flatnonzero(np.unpackbits(np.frombuffer(p["starts"], dtype=np.uint8)))] = True
    edge = np.flatnonzero(np.diff(np.concatenate([[0], starts.astype(np.int8), [0]])))
    return united([a, b + length - 1] for a, b in edge.reshape(-1, 2).tolist())


def united(runs: Iterable[list[int]]) -> list[list[int]]:
    """Runs in order of their starts, those that overlap or touch made one."""
    out: list[list[int]] = []
    for a, b in runs:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def removed(raw: bytes, places: list[dict], length: int, words: int = 0) -> list[list[int]]:
    """The byte runs of a text that its repeated strings of both kinds cover."""
    runs = covered(len(raw), [p for p in places if not p["worded"]], length)
    worded = [p for p in places if p["worded"]]
    if worded:
        starts, ends = word_edges(np.frombuffer(raw, dtype=np.uint8))
        runs = united(sorted(runs + [[int(starts[a]), int(ends[b - 1])] for a, b in covered(len(starts), worded, words)]))
    return runs


HASH, PLACES = "_dedup_hash", "_dedup_places"


def mark(docs: DataFrame, length: int = LENGTH, words: int = 0) -> DataFrame:
    """The rows of ``docs`` with ``_dedup_places``: where repeated strings start, for ``removed``.

    Strings of ``length`` bytes and, unless 0, those of ``words`` words.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    # One frame of texts serves both joins. Both read all its columns, used or not, so that they share one exchange.
    full = docs.withColumn(HASH, F.xxhash64("text", F.lit(1)))
    slim = full.select("doc_id", F.col(HASH).alias("h"), "text")
    # Most names occur once and end here: names alone are counted, combined before they are shuffled. Written first, so
    # that its measured size decides on the join, and a very frequent name on the other side can be split.
    names = slim.select("text").mapInArrow(_names(length, words), "name long")
    often = shelve(names.groupBy("name").agg(F.count("*").alias("total")).filter("total > 1").select("name"))
    row = f"doc_id {kind}, h long, worded boolean, first int, last int, place int, name long, strings long"
    again = shelve(slim.mapInArrow(_sample(length, words), row).join(often, "name", "left_semi"))
    mine = F.xxhash64("doc_id", "h", "worded", "first", "last")
    equal = again.groupBy("name", "strings").agg(F.count("*").alias("n"), F.min(mine).alias("one"))
    kinds = again.select("name", "strings").distinct().groupBy("name").agg(F.count("*").alias("kinds"))
    known = shelve(equal.join(kinds, "name"))
    found = shelve(again.join(known, ["name", "strings"]).select(
        "doc_id", "h", "worded", "first", "last", "place", "name", (F.col("n") > 1).alias("settled"),
        ((F.col("kinds") > 1) & ((F.col("n") == 1) | (F.col("one") == mine))).alias("ship"), (F.col("kinds") > BUCKET).alias("hot"),
    ))
    needed = found.filter("ship").groupBy("doc_id", "h").agg(F.collect_set(F.struct("worded", "first", "last", "place", "name", "hot")).alias("places"))

    def with_texts(side: DataFrame, how: str) -> DataFrame:
        return full.join(side.hint("merge"), full["doc_id"].eqNullSafe(side["doc_id"]) & (full[HASH] == side["h"]), how)

    rest = [full[c] for c in docs.columns if c not in ("doc_id", "text")]
    shipped = with_texts(needed, "inner").select(full["doc_id"], full[HASH], full["text"], needed["places"].alias(PLACES), *rest).mapInArrow(
        _surroundings(length, words), f"doc_id {kind}, h long, worded boolean, place int, name long, hot boolean, left binary, right binary"
    )
    bucketed = shipped.filter("not hot").repartition("name").sortWithinPartitions("name", "worded")
    solved = bucketed.mapInArrow(_sort_buckets(length, words), f"doc_id {kind}, h long, worded boolean, place int, starts binary")
    if found.filter("ship and hot").limit(1).count():
        solved = solved.unionByName(_split(shelve(shipped.filter("hot")), length, words, kind))
    solved = solved.select("doc_id", "h", "worded", F.col("place").alias("first"), F.lit(-1).alias("last"), "starts")
    settled = found.filter("settled").select("doc_id", "h", "worded", "first", "last", F.lit(None).cast("binary").alias("starts"))
    places = settled.unionByName(solved).groupBy("doc_id", "h").agg(F.collect_set(F.struct("worded", "first", "last", "starts")).alias(PLACES))
    return with_texts(places, "left").select(*[full[c] for c in docs.columns], places[PLACES])


def _split(shipped: DataFrame, length: int, words: int, kind: str) -> DataFrame:
    """Buckets with very many members: their strings are counted by digest, combined before the shuffle."""
    strings = shelve(shipped.mapInArrow(_strings(length, words), f"doc_id {kind}, h long, worded boolean, place int, o int, digest binary"))
    # A string around two places of its text is listed at both; at one distance it is listed once.
    twice = strings.groupBy("worded", "o", "digest").agg(F.count("*").alias("n")).filter("n > 1")
    offsets = strings.join(twice, ["worded", "o", "digest"]).groupBy("doc_id", "h", "worded", "place").agg(F.collect_set("o").alias("o"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for o in batch.column(4).to_pylist():
                row = np.zeros(max(length, words), dtype=bool)
                row[o] = True
                packed.append(np.packbits(row).tobytes())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(4)), pa.array(packed, pa.binary())], ["doc_id", "h", "worded", "place", "starts"]
            )

    return offsets.mapInArrow(pack, f"doc_id {kind}, h long, worded boolean, place int, starts binary")


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed) of every row; ``removed`` tells whether anything was."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, places in zip(batch.column(1), batch.column(2)):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                spans = removed(raw, places.as_py(), length) if places.is_valid else []
                gone = sum(b - a for a, b in spans)
                rows.append((len(raw), gone, len(spans), hashlib.sha256(kept(raw, spans)).hexdigest()))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            columns = [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 4, types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return mark(docs.select("doc_id", "text"), length).mapInArrow(run, schema).withColumn("removed", F.col("n_removed") > 0)


def kept(raw: bytes, spans: list[list[int]]) -> bytes:
    if not spans:
        return raw
    edges = [0, *(x for span in spans for x in span), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))


def without_repeats(docs: DataFrame, length: int = LENGTH, words: int = 0) -> DataFrame:
    """The documents without their repeated strings of ``length`` bytes and of ``words`` words (none if 0).

    Runs of fewer than ``words`` words between white space and ``LENGTH`` bytes stay. A cut inside a character drops the rest of it. ``n_chars`` follows the text if the column exists.
    """
    marked = mark(docs, length, words)
    at, n = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, texts = batch.columns[:-1], []
            for text, places in zip(batch.column(at), batch.columns[-1]):
                text = text.as_py()
                if places.is_valid:
                    raw = text.encode("utf-8", "surrogatepass")
                    spans = removed(raw, places.as_py(), length, words)
                    spans = [(a, b) for a, b in spans if b - a >= LENGTH or len(raw[a:b].split()) >= words]
                    if spans:
                        text = kept(raw, spans).decode("utf-8", "ignore")
                texts.append(text)
            columns[at] = pa.array(texts, columns[at].type)
            if n is not None:
                old = columns[n].to_pylist()
                sizes = [o if new == was else len(new) for o, new, was in zip(old, texts, batch.column(at).to_pylist())]
                columns[n] = pa.array(sizes, columns[n].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return marked.mapInArrow(run, docs.schema)


@query("op6_suffix_dedup")
def op6_suffix_dedup(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents"))
