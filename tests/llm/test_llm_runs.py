"""Operator 12 against runs found by definition."""

import hashlib

import numpy as np
import pytest

from cases import no_documents, odd_documents

from groundscope.llm import runs


def smallest_period(x):
    return next(q for q in range(1, len(x) + 1) if all(x[i] == x[i + q] for i in range(len(x) - q)))


def by_definition(x):
    """(start, length, period) of all runs, lag by lag."""
    found = set()
    for q in range(1, len(x) // 2 + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j - i >= q and j + q - i >= 12 and smallest_period(x[i : j + q]) == q:
                found.add((i, j + q - i, q))
            i = max(j, i) + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def samples():
    rng = np.random.default_rng(5)
    for letters in (1, 2, 3, 50):
        for n in (0, 1, 11, 12, 13, 40, 300):
            yield rng.integers(0, letters, n)
    for q, n in ((64, 128), (64, 129), (65, 400), (100, 260), (127, 254), (128, 256), (128, 700), (200, 400), (200, 399)):
        for letters in (2, 1000):
            yield np.concatenate([rng.integers(0, letters, 37), np.resize(rng.integers(0, letters, q), n), rng.integers(0, letters, 21)])
    # Periods whose own words are periodic, with and without a word of another kind between.
    for q in (70, 71, 135, 140, 201):
        for p in (2, 3, 4, 5):
            word = np.resize(np.arange(p), q)
            yield np.concatenate([word, word])
            yield np.concatenate([[9], word, word, word[: q // 3], [8]])
            yield np.concatenate([word, [7], word, [7], word, [7]])
    for p in (2, 3):
        yield np.concatenate([np.resize(np.arange(p), 301), np.resize(np.arange(p), 260)])
    line = rng.integers(0, 30, 10)
    yield np.concatenate([np.tile(line, 30), [99], np.tile(line, 30)])
    yield np.tile(np.concatenate([np.zeros(40, dtype=int), [1]]), 12)


@pytest.mark.parametrize("together", [False, True])
def test_runs_equal_their_definition(together):
    every = [x.astype(np.int32) for x in samples()]
    for group in [every] if together else [[x] for x in every]:
        found = runs.find_runs(group)
        for i, x in enumerate(group):
            assert [tuple(r) for r in found[found[:, 0] == i, 1:].tolist()] == by_definition(x.tolist()), (i, len(x))


def test_every_gram_hash_equal_still_gives_the_runs(monkeypatch):
    # Hash collisions seed what is no repeat; the extension must refuse it.
    monkeypatch.setattr(runs, "gram_hashes", lambda x, size: np.zeros(len(x) - size + 1, dtype=np.uint64))
    rng = np.random.default_rng(6)
    x = rng.integers(0, 500, 400).astype(np.int32)
    assert len(runs.find_runs([x])) == 0


def expected(doc_id, text):
    words = runs.planted(doc_id, (text or "").encode().split())
    found = by_definition(words)
    drop = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in drop)
    digests = (hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())
    return (doc_id, len(found), *(best or (None, None, None)), best and 1000 * best[1] // best[2], *digests)


def test_query_equals_the_definition(spark, tmp_path):
    odd = odd_documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in odd.collect() if r["doc_id"] != 9]
    rows += [(1000 + i, " ".join(f"w{(i * j) % 7}" for j in range(40 + i))) for i in range(60)]
    rows += [(5, "a b c d \x1c e\v\f\tf"), (6, "a " * 30), (6, "a " * 30), (None, "x y " * 20), (7, None), (8, ""), (9, " \n")]
    frame = spark.createDataFrame([(a, b, "clash", 1) for a, b in rows], "doc_id long, text string, runs string, n_words int")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    found = [tuple(r) for r in runs.op12_runs(spark, str(tmp_path)).collect()]
    assert sorted(found, key=repr) == sorted((expected(*r) for r in rows), key=repr)


def test_planted_words_follow_the_rule():
    hit = next(i for i in range(1000) if runs.zlib.crc32(str(i).encode()) % 10 == 0)
    words = [b"%d" % i for i in range(50)]
    g = runs.zlib.crc32(str(hit).encode()) // 10
    a = g % 50
    p = 1 + (50 - a) // (3 + g % 8)
    assert runs.planted(hit, words) == [words[i] if i < a else words[a + (i - a) % p] for i in range(50)]


def test_empty_table(spark, tmp_path):
    no_documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    assert runs.op12_runs(spark, str(tmp_path)).collect() == []
