"""Documents with nulls, empty and very long texts, ties, repeated rows and clashing extra columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, class_id long, h string, bin int"


def odd_documents(spark):
    long_text = " ".join(f"word{i % 997} und die" for i in range(9000))
    rows = [
        (1, None), (2, ""), (3, "   \n "), (4, "!!! ???"), (5, "!!! ???"), (6, "one"), (7, "The cat and the dog are in the house."),
        (8, "The cat and the dog are in the house."), (8, "The cat and the dog are in the house."), (None, "a text without an id"),
        (None, None), (9, long_text), (10, "ß é \U0001f600 Σ 12 don't <|endoftext|>"), (11, "x" * 6000),
    ]
    return spark.createDataFrame([(i, t, "en", None, None, 0.5, 7, "h", 1) for i, t in rows], SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
