import pytest

EDGE = [
    (1, "The the  quick brown\tfox.\nThe the  quick brown\tfox."),
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (5, "Ünï ΣΑΣ İx ﬁ é <|endoftext|> a<|startoftext|>b it's we'll 1234 ---  x y z\x1cq \x85w"),
    (5, "same id, other text"),
    (7, "same row"),
    (7, "same row"),
    (None, "no id"),
    (None, None),
    (9, "x" * 3000 + " " + "=-" * 200 + " " + "word " * 3000),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Null and repeated ids and texts, empty and long texts, and columns that clash with the operators' own."""
    rows = [(i, t, "clash", 1, "clash") for i, t in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string, size int, shard string").repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")
