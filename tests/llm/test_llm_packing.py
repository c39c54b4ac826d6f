import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from groundscope.llm import packing
from cases import no_documents, odd_documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(text):
    return np.array([*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")


def test_encoder_equals_the_tokenizer():
    tokenizer, encoder, rng = Tokenizer.from_file(PATH), packing.Encoder(PATH), random.Random(3)
    alphabet = ["a", "B", "the", " ", "  ", "\n", ".", ",", "'s", "'", "é", "É", "́", "ß", "1", "²", "\x1c", " ", "<|endoftext|>", "<|", "Σ", "İ", "-", "_", "###", " "]
    for _ in range(1500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14)))
        assert encoder.encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(), text


def test_best_fit():
    bins, offsets = packing.best_fit(np.array([6, 5, 4, 3, 2]), 10)
    assert bins.tolist() == [0, 1, 0, 1, 1] and offsets.tolist() == [0, 0, 6, 5, 8]


def check(rows, texts):
    ids = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ids.get(r["sequence_id"], 0)
        ids[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n <= 4096 for n in ids.values())
    wanted = []
    for doc_id, text in texts:
        whole = expected(text)
        for piece, start in enumerate(range(0, len(whole), 4096)):
            part = whole[start : start + 4096]
            wanted.append((doc_id, piece, start, len(part), zlib.crc32(part.tobytes())))
    key = lambda t: (t[0] is None, *((-1, *t[1:]) if t[0] is None else t))
    assert sorted(wanted, key=key) == sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=key)
    return len(ids)


def test_defined_results(spark):
    docs = odd_documents(spark)
    rows = packing.pack_documents(docs, PATH).collect()
    check(rows, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert packing.pack_documents(no_documents(spark), PATH).count() == 0


def test_few_sequences_after_merging(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(12)
    rows = packing.pack_documents(docs, PATH).collect()
    used = check(rows, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert used <= -(-sum(r["length"] for r in rows) // 4096) + 2


def test_many_open_bins_keep_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(packing, "TASK_BINS", 5)
    docs = spark.createDataFrame([(i, "word " * 2500) for i in range(40)], "doc_id long, text string").repartition(4)
    rows = packing.pack_documents(docs, PATH).collect()
    assert len({r["sequence_id"] for r in rows}) == 40
