"""Awkward inputs that every operator has to take."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row_id string, position string, size string, score string, print string, key string, copies string, __row string, label int"
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
ROWS = [
    (1, "Alpha beta gamma delta epsilon"),
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (5, LONG),
    (6, "ALPHA beta gamma delta epsilon"),
    (6, "ALPHA beta gamma delta epsilon"),
    (None, "a row without an id"),
    (None, None),
    (7, "naïve façade – 東京 <|endoftext|> 😀 end"),
    (8, "one"),
    (9, "x" * 5000),
]


def wide(spark, pairs):
    return spark.createDataFrame([(i, t, "en", None if i == 8 else "s", None, *["junk"] * 8, 0) for i, t in pairs], DOCS)


@pytest.fixture(scope="session")
def edge_docs(spark, tmp_path_factory):
    """As files, as operators get them."""
    path = f"file://{tmp_path_factory.mktemp('edge')}/docs"
    wide(spark, ROWS).repartition(2).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(spark, edge_docs, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('none')}/docs"
    edge_docs.limit(0).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
