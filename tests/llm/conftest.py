import pytest

#: Null, empty, blank, repeated, tied and long texts, null keys; and columns that clash with those the operators make.
EDGE_ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank", "en", "a"),
    (3, None, None, None),
    (4, "", "en", "b"),
    (5, " \n\t ", "de", "b"),
    (None, "Ein Text ohne Nummer, aber mit Wörtern", "de", None),
    (7, "word " * 30_000, "en", "a"),
    (8, "12345 !!! 67", "fr", "c"),
    (-9, "é" * 3, "fr", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
CLASHING = "size int, shard int, score double, bin int, block int, key string, maybe boolean, fp long, held_out string, wide string, words string, quality int, at int"


@pytest.fixture
def edge_docs(spark):
    docs = spark.createDataFrame(EDGE_ROWS, SCHEMA)
    return docs.selectExpr("*", *[f"cast(null as {x.split()[1]}) as {x.split()[0]}" for x in CLASHING.split(", ")])


@pytest.fixture
def no_docs(edge_docs):
    return edge_docs.limit(0)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
