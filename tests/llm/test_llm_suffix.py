import hashlib
import random
import re
from collections import Counter

import pytest

from groundscope.llm import suffix_dedup as S
from cases import no_documents, odd_documents


def brute(texts, length):
    counts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return out


def compare(spark, rows, length):
    got = sorted(((r["doc_id"] if r["doc_id"] is not None else -1), *r[1:5]) for r in S.digests(spark.createDataFrame(rows, "doc_id long, text string"), length).collect())
    wanted = brute([(t or "").encode() for _, t in rows], length)
    assert got == sorted((-1 if d is None else d, *w) for (d, _), w in zip(rows, wanted))


def mixed(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdé ") for _ in range(300)) for _ in range(5)]
    rows = []
    for i in range(90):
        parts = []
        for _ in range(rng.randint(0, 5)):
            a, b = rng.randint(0, 250), rng.choice(base)
            parts.append(b[a : a + rng.randint(1, 120)] if rng.random() < 0.7 else "".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 90))))
        rows.append((i, "".join(parts)))
    rows += [(200, None), (201, ""), (202, "a" * 500), (203, "ab" * 100), (204, "x" * 39), (205, "x" * 40), (206, "x" * 41), (207, "twice " * 30), (207, "twice " * 30), (None, "ab" * 60)]
    return rows


@pytest.mark.parametrize("length, bucket", [(40, 20_000), (9, 20_000), (40, 1)])
def test_equals_brute_force(spark, monkeypatch, length, bucket):
    monkeypatch.setattr(S, "BUCKET", bucket)
    compare(spark, mixed(length), length)


def cut_words(texts, words):
    """Every window of ``words`` words is counted as it stands; stretches of words that repeated windows cover are cut."""
    places = [list(re.finditer(rb"[0-9A-Za-z\x80-\xff]+|[^\s0-9A-Za-z\x80-\xff]", t)) for t in texts]
    windows = [[tuple(m.group() for m in p[i : i + words]) for i in range(len(p) - words + 1)] for p in places]
    counts, out = Counter(w for ws in windows for w in ws), []
    for text, p, ws in zip(texts, places, windows):
        gone = {j for i, w in enumerate(ws) if counts[w] > 1 for j in range(i, i + words)}
        left, at = [], 0
        for i in sorted(gone):
            if i - 1 not in gone:
                a = p[i].start()
            if i + 1 not in gone and len(text[a : p[i].end()].split()) >= words:
                left.append(text[at:a])
                at = p[i].end()
        out.append(b"".join(left) + text[at:])
    return out


@pytest.mark.parametrize("bucket", [20_000, 1])
def test_words_equal_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(S, "BUCKET", bucket)
    rng = random.Random(7)
    vocabulary = ["a", "the", "cat", "né", "x-y", "3.5", "—", "don't", "(so)", "end."]
    base = [[rng.choice(vocabulary) for _ in range(60)] for _ in range(4)]
    texts = [None, "", "a", "a " * 40]
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(0, 4)):
            a, some = rng.randint(0, 50), rng.choice(base)
            parts += some[a : a + rng.randint(1, 30)] if rng.random() < 0.7 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 20))]
        texts.append("".join(p + rng.choice([" ", "  ", "\n"]) for p in parts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    # No string of 5,000 bytes exists: words alone decide.
    got = {r["doc_id"]: r["text"] for r in S.without_repeats(docs, 5000, 12).collect()}
    wanted = cut_words([(t or "").encode() for t in texts], 12)
    assert [got[i] or "" for i in range(len(texts))] == [w.decode("utf-8", "ignore") for w in wanted]
    assert sum(len(w) < len((t or "").encode()) for w, t in zip(wanted, texts)) > 10


def test_tables_equal_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    compare(spark, rows, 400)


def test_defined_results(spark):
    docs = odd_documents(spark)
    assert S.digests(docs).count() == 14 and S.digests(no_documents(spark)).count() == 0
    left = S.without_repeats(docs, 20, 5)
    assert left.columns == docs.columns
    by = {}
    for r in left.collect():
        by.setdefault(r["doc_id"], []).append((r["text"], r["n_chars"]))
    assert by[1] == [(None, None)] and by[7] == [("", 0)] and by[8] == [("", 0)] * 2 and by[6] == [("one", None)]
    kept = S.without_repeats(docs, 20, 50)
    assert {r["text"] for r in kept.filter("doc_id = 8").collect()} == {"The cat and the dog are in the house."}
