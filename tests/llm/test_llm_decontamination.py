import random

from groundscope.llm import decontamination as D
from cases import no_documents, odd_documents

ITEMS = "item_id long, text string, doc_id int"


def brute(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row), row.index(min(row))


def test_myers_equals_the_table():
    rng = random.Random(1)
    for _ in range(1500):
        p = "".join(rng.choice("ab c") for _ in range(rng.randint(1, 12)))
        t = "".join(rng.choice("ab c") for _ in range(rng.randint(0, 20)))
        assert D.myers(p, t) == brute(p, t)


def test_all_matches_within_the_budget(spark):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(8, 25)))) for i in range(12)]
    docs = []
    for i in range(120):
        words = rng.choices(vocabulary, k=rng.randint(0, 60))
        if i % 2:
            leak = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, len(leak) // 8)):
                leak[rng.randrange(len(leak))] = rng.choice("xyz")
            words.insert(rng.randint(0, len(words)), "".join(leak))
        docs.append((i, " ".join(words).capitalize()))
    wanted = set()
    for d, text in docs:
        for n, item in items:
            item, t = D.normal(item), D.normal(text)
            distance = brute(item, t)[0]
            if distance <= int(len(item) * D.RATE):
                wanted.add((d, n, distance))
    got = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in got} == wanted and len(wanted) > 20
    for r in got:
        t = D.normal(dict(docs)[r["doc_id"]])[r["start"] : r["end"]]
        assert brute(D.normal(dict(items)[r["item_id"]]), t)[0] == r["distance"]


def test_defined_results(spark, monkeypatch):
    items = spark.createDataFrame(
        [(1, "the cat and the dog are in the house", 0), (1, "the cat and the dog are in the house", 0), (2, None, 0), (3, "", 0), (4, "ONE", 0), (None, "word5 und", 0)], ITEMS
    )
    docs = odd_documents(spark)
    got = sorted((r["doc_id"], r["item_id"] or 0, r["distance"]) for r in D.leaks(docs, items).collect())
    assert got == [(6, 4, 0), *[(7, 1, 0)] * 2, *[(8, 1, 0)] * 4, (9, 0, 0)]
    left = D.clean(docs, items)
    assert left.columns == docs.columns and left.count() == docs.count() - 5
    monkeypatch.setattr(D, "BLOCK_CHARS", 30)
    assert sorted((r["doc_id"], r["item_id"] or 0, r["distance"]) for r in D.leaks(docs, items).collect()) == got
    assert D.leaks(no_documents(spark), items).count() == 0 and D.leaks(docs, items.limit(0)).count() == 0
    assert D.clean(docs, items.limit(0)).count() == docs.count()
