import corpus_pipeline
from groundscope.llm.common import shelve
from cases import no_documents, odd_documents

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns(spark):
    for docs in (odd_documents(spark), no_documents(spark)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = shelve(stage(spark, docs, SF))
            assert after.columns == docs.columns, name
            assert after.count() <= docs.count(), name
            docs = after
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        assert packed.filter("piece = 0").count() == docs.count()


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = shelve(stage(spark, docs, SF))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select(columns).collect())) == sorted(map(tuple, docs.select(columns).collect()))


def cut(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["text"] for r in corpus_pipeline.cut_repeated_passages(spark, docs, SF).orderBy("doc_id").collect()]


def test_passages_of_short_words_are_cut(spark):
    letters = " ".join("abcdefghijklmnopqrstuvwxyz"[i * i % 26] for i in range(50))
    fewer = " ".join(str(i * i % 10) for i in range(49))
    assert cut(spark, f"one={letters}=two", f"three:{letters}:four") == ["one==two", "three::four"]
    assert cut(spark, f"one={fewer}=two", f"three:{fewer}:four") == [f"one={fewer}=two", f"three:{fewer}:four"]


def test_long_passages_of_few_words_are_cut(spark):
    unspaced = "".join(chr(0x4E00 + i * i * 7 % 5000) for i in range(200))
    code = "".join("ABCDEFGHIJKLMNOP"[i * i * i % 251 % 16] for i in range(400))
    for passage in (unspaced, code):
        assert cut(spark, f"one={passage}=two", f"three:{passage}:four") == ["one==two", "three::four"]
    assert cut(spark, f"one={code[:399]}=two", f"three:{code[:399]}:four") == [f"one={code[:399]}=two", f"three:{code[:399]}:four"]
