import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash with the operators' own."""
    rows = [
        (1, "plain words of a first text", "x", 7), (1, "plain words of a first text", "x", 7), (2, None, "x", None), (3, "", None, 1),
        (None, "a row without a key but with words in it", "y", 2), (4, "word " * 30_000, "y", 3), (5, " \n\t ", "z", 4), (6, "é 日本語 ß <|endoftext|>\nline\nline", "z", 5),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, score int")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}
