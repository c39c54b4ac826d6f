import random
import zlib

import numpy as np
import pytest

from groundscope.llm import language, quality, toxicity
from cases import no_documents, odd_documents

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def rest(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3


def area(score, label):
    rank = np.argsort(np.argsort(score)) + 1
    n = label.sum()
    return (rank[label == 1].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


def test_language_on_held_out_rows(spark, docs):
    got = language.predict(docs, language.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got["held_out"] == got["doc_id"].map(lambda i: rest(i) == 1)).all() and got["score"].between(0, 1).all()
    held = got[got["held_out"]]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.97


def test_quality_on_held_out_rows(spark, docs, labels):
    got = quality.score(docs, quality.fit(docs, labels)).join(labels, "doc_id").toPandas()
    held = got[got["held_out"]]
    assert area(held["score"].to_numpy(), held["quality"].to_numpy()) > 0.95
    assert (got["predicted"] == (got["score"] >= 0.5)).all() and got["score"].between(0, 1).all()


def test_factorisation_identity():
    rng = np.random.default_rng(0)
    model = {"w0": 0.3, "w": rng.normal(size=9), "v": rng.normal(size=(9, 4))}
    row, cell, value = np.array([0, 0, 0, 1, 1]), np.array([1, 4, 7, 0, 4]), rng.normal(size=5)
    wanted = []
    for r in (0, 1):
        c, x = cell[row == r], value[row == r]
        pairs = sum(model["v"][c[i]] @ model["v"][c[j]] * x[i] * x[j] for i in range(len(c)) for j in range(i))
        wanted.append(model["w0"] + model["w"][c] @ x + pairs)
    assert np.allclose(quality.raw_score(model, row, cell, value)[0], wanted)


def test_toxicity_learns_stems(spark, docs):
    rng = random.Random(8)
    rows, marks = [], []
    for r in docs.select("doc_id", "text").limit(900).collect():
        bad, words = rng.random() < 0.3, r["text"].split()[:300]
        for _ in range(3 if bad else 0):
            words.insert(rng.randint(0, len(words)), "grumpf" + rng.choice(["", "ing", "ed", "er", "isch", "eux"]))
        rows.append((r["doc_id"], " ".join(words)))
        marks.append((r["doc_id"], int(bad)))
    texts, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.fit(texts, known)
    got = toxicity.score(texts, model).join(known, "doc_id").toPandas()
    held = got[got["held_out"]]
    assert (held["predicted"] == held["toxic"]).mean() > 0.95 and (got["predicted"] == (got["score"] >= 0.7)).all()
    left = toxicity.clean(texts, model)
    assert left.count() == (got["predicted"] == 0).sum()


def test_toxicity_table_of_words_equals_filters():
    rng = np.random.default_rng(1)
    words = toxicity.Words()
    numbers = [words.numbers(t) for t in ("a b c d e", "", "b", "e d c b a b c")]
    model = {"e": rng.normal(size=(toxicity.CELLS, toxicity.DIM)), "b": rng.normal(size=24)}
    for span in toxicity.SPANS:
        model[f"f{span}"] = rng.normal(size=(span, toxicity.DIM, toxicity.FILTERS))
    x = toxicity.vectors(model, words.table())
    top = toxicity.maxima(model, toxicity.word_tables(model, x), *toxicity.layout(numbers))[0]
    for text, got in zip(numbers, top):
        padded = np.vstack([x[text], np.zeros((3, toxicity.DIM))])
        wanted = np.concatenate([
            np.max([sum(padded[t + j] @ model[f"f{span}"][j] for j in range(span) if t + j < len(padded)) for t in range(len(padded))], axis=0)
            for span in toxicity.SPANS
        ])
        assert np.allclose(got, np.maximum(wanted + model["b"], 0))


def test_defined_results(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2, "x") for i in range(1, 12)] + [(3, None, 0, "x"), (None, 1, 1, "x"), (7, 0, 1, "x")], "doc_id long, quality int, toxic int, text string")
    for module, column in ((quality, "quality"), (toxicity, "toxic")):
        for model in (module.fit(docs, labels), module.fit(docs, labels.limit(0)), module.fit(no_documents(spark), labels)):
            rows = module.score(docs, model).collect()
            assert len(rows) == 14 and all(0 <= r["score"] <= 1 for r in rows)
            same = {r["score"] for r in rows if r["doc_id"] in (1, 2)}
            assert len(same) == 1
        assert module.score(no_documents(spark), module.fit(docs, labels)).count() == 0
    model = language.fit(docs)
    rows = language.predict(docs, model).collect()
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 3, 4, 5)} == {"und"} and {r["lang_pred"] for r in rows if r["doc_id"] in (6, 7)} == {"en"}
    assert {r["lang_pred"] for r in language.predict(docs, language.fit(no_documents(spark))).collect()} == {"und"}
    assert language.predict(no_documents(spark), model).count() == 0


def test_signs_and_digits_of_any_kind_are_no_letters(spark):
    docs = odd_documents(spark)
    model = language.fit(docs)
    others = spark.createDataFrame([(1, "² ½ ⑦ Ⅷ 12 ٣"), (2, "_ ∑ €"), (3, "12 ß"), (4, "½ 語")], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(others, model).collect()}
    assert got == {1: "und", 2: "und", 3: "en", 4: "en"}
