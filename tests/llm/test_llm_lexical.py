"""Operator 11 against scores computed document by document."""

import math
import re
from collections import Counter

import numpy as np
from cases import no_documents, odd_documents

from groundscope.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def brute(docs, items, k=10):
    said = [(i, Counter(TERM.findall((t or "").translate(UPPER)))) for i, t in docs if i is not None]
    n_docs, n_terms = sum(bool(c) for _, c in said), sum(sum(c.values()) for _, c in said)
    held = Counter(t for _, c in said for t in c)
    out = []
    for item_id, text in sorted({(i, t) for i, t in items if i is not None and t is not None}):
        scores = []
        for doc_id, c in said:
            if not c:
                continue
            m = 25 + 75 * sum(c.values()) * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
                for t in TERM.findall(text.translate(UPPER)) if c[t]
            )
            if score > 0:
                scores.append((-score, doc_id))
        out += [(item_id, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def found(docs, items, **more):
    return sorted(tuple(r) for r in lexical.search(docs, items, **more).collect())


def pairs(frame, key):
    return [(r[key], r["text"]) for r in frame.collect()]


def test_whole_tables_in_one_and_in_many_blocks(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    wanted = brute(pairs(docs, "doc_id"), pairs(items, "item_id"))
    assert found(docs, items) == wanted
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 17)
    monkeypatch.setattr(lexical, "ITEM_BYTES", 3000)
    assert found(docs.repartition(3), items) == wanted


def test_odd_documents_and_items(spark):
    docs = odd_documents(spark)
    rows = [
        (1, "the Cat THE dog"), (1, "the Cat THE dog"), (1, "another text"), (2, None), (3, ""), (4, "!!!"), (5, "word5 und und die"),
        (6, "ß é \U0001f600 12 t"), (7, "nowhere"), (None, "cat"),
    ]
    items = spark.createDataFrame([(i, t, 1.0, 3) for i, t in rows], "item_id long, text string, score double, doc_id int")
    wanted = brute(pairs(docs, "doc_id"), rows)
    assert found(docs, items) == wanted and wanted
    assert found(no_documents(spark), items) == [] and found(docs, items.limit(0)) == []


def test_ties_go_to_the_smaller_id(spark):
    docs = spark.createDataFrame([(i, "same words here") for i in range(200, 0, -1)] + [(500 + i, f"other {i}") for i in range(300)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "same here"), (2, "other 7 same")], "item_id long, text string")
    assert found(docs, items) == brute(pairs(docs, "doc_id"), pairs(items, "item_id"))


def test_accumulators_stop_and_survivors_stay_exact():
    rng = np.random.default_rng(3)
    for case in range(60):
        n = 300
        docs = [(i, " ".join(f"t{int(x)}" for x in rng.zipf(1.3, rng.integers(1, 60)) if x < 400)) for i in range(n)]
        split = [lexical.terms_of(t.encode()) for _, t in docs]
        vocabulary = {t: i for i, t in enumerate(sorted({t for s in split for t in s}))}
        words = [np.array([vocabulary[t] for t in s], dtype=np.int64) for s in split]
        arrays = lexical.inverted(list(range(n)), [len(s) for s in split], [np.full(len(w), i) for i, w in enumerate(words)], words)
        n_docs, n_terms = sum(bool(s) for s in split), sum(map(len, split))
        block = lexical.Block(*(a.astype(np.int64).tobytes() for a in arrays), len(vocabulary), n_docs, n_terms)
        held = np.diff(block.starts)
        terms = rng.choice(len(vocabulary), 12, replace=False)
        terms = terms[np.argsort(held[terms], kind="stable")]
        weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * held[terms] + 1))).astype(np.int64)
        exact = np.zeros(n, dtype=np.int64)
        for t, w in zip(terms, weights):
            part = slice(block.starts[t], block.starts[t + 1])
            exact[block.places[part]] += w * block.gains[part]
        floor = max(1, int(np.sort(exact)[-3])) if case % 2 else 1
        places, scores = block.search(terms, weights, 5, floor)
        assert (scores == exact[places]).all()
        edge = max(floor, int(np.sort(exact)[-5]))
        assert set(np.flatnonzero(exact >= edge)) <= set(places.tolist())


def test_oracle_terms_equal_the_split():
    text = "Don't stop_me NOW Ärger 3.14\x7f\x1cend[x]{y}~z @a:b;c `d^e"
    assert [t.decode() for t in lexical.terms_of(text.encode())] == TERM.findall(text.translate(UPPER))
