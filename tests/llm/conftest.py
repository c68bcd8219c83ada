import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, row long, node long, component_id long, "
          "score double, held_out boolean, ids array<int>, kept boolean, __row long, __gone long, lines_total int")

LINES = "First shared line here.\nSecond shared line here.\nThird shared line here."
LONG = " ".join(f"word{i % 997} and{i % 13}" for i in range(30_000))


def edge_rows():
    text = [
        None, "", "   \n\t ", "one", "one", "ONE", "a b c d e f g h i j", "a b c d e f g h i j", "A  b\tc d e f\ng h i j",
        LINES, LINES + "\nOwn tail.", "Own head.\n" + LINES, "x\nx\nx\nx\nx", "\n\n\n", LONG, LONG + " tail",
        "mail a.b@c-d.example.com or +1 (555) 123-4567, 10.0.0.1, 300.1.1.1, 4111 1111 1111 1111 end",
        "Licensed under the Apache License, Version 2.0. All rights reserved. cc-by", "GNU General Public License v3 or later",
        "日本語 の テキスト 🙂 ﬁ", "12345 !!! ???", "é" * 3000, "<|endoftext|> x", "▁ mark", "p q r s t u v w x y z\x00",
    ]
    rows = [(i, t, ("en", "de", None)[i % 3], "src0", len(t or ""), 7, 7, 7, 0.5, True, [1], False, 1, 2, 3) for i, t in enumerate(text)]
    return rows + [rows[6], rows[0], (None, "one", "en", None, None, None, None, None, None, None, None, None, None, None, None),
                   (None, None, None, None, None, None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and very long texts, repeated rows and ids, and columns whose names clash with results."""
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
