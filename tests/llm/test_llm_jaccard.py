import random
from collections import Counter

import pytest

from groundscope.llm import jaccard_join as J
from cases import no_documents, odd_documents


def brute(rows, threshold=0.8):
    """doc -> (class, links) by comparing all pairs; every text once per row."""
    sets = []
    for _, text in rows:
        w = J.WORD.findall((text or "").lower())
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else {text} if text else set())
    up, links = list(range(len(rows))), Counter()

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            either = len(sets[i] | sets[j])
            if either and len(sets[i] & sets[j]) >= threshold * either - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, least[root(i)], links[i]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("block", [1500, 3])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(J, "BLOCK", block)
    rng = random.Random(4)
    rows, n = [], 0
    for _ in range(12):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.randint(3, 90))]
        for _ in range(rng.randint(1, 9)):
            copy = [w if rng.random() > 0.02 else "changed" for w in words]
            rows.append((n, " ".join(copy)))
            n += 1
    rows += [(n + i, t) for i, t in enumerate(["!!", "!!", "?", "one two", "One, two"])]
    got = J.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == brute(rows)


def test_tables_equal_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = J.op4_jaccard_join(spark, "/root/testdata/sf0.001").collect()
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == brute(rows)


def test_depth_reaches_the_recall():
    d = J.depth()
    assert 1 - (1 - 0.8**d) ** J.TREES >= J.RECALL > 1 - (1 - 0.8 ** (d + 1)) ** J.TREES


def test_defined_results(spark):
    docs = odd_documents(spark)
    rows = J.classes(docs).collect()
    assert len(rows) == 14
    links = {r["doc_id"]: r["n_links"] for r in rows if r["doc_id"]}
    assert links[1] == links[2] == links[3] == 0 and links[4] == links[5] == 1 and links[7] == links[8] == 2
    assert {r["class_id"] for r in rows if r["doc_id"] in (7, 8)} == {7}
    left = J.one_of_each(docs)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 0, 1, 2, 3, 4, 6, 7, 9, 10, 11]
    twice = spark.createDataFrame([(1, "a b c d e f g")] * 3 + [(2, None)] * 2, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in J.one_of_each(twice).collect()) == [1, 2, 2]
    assert J.classes(no_documents(spark)).count() == 0 and J.one_of_each(no_documents(spark)).count() == 0
