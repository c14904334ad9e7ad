import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """A small ``documents`` table of (doc_id, text) rows, with the other columns and one that clashes with operator columns."""
    def make(texts, ids=None):
        ids = range(len(texts)) if ids is None else ids
        rows = [(i, t, None, "s", None if t is None else len(t), "kept") for i, t in zip(ids, texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rid string")

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empty and blank texts, ties and repeats, a very long text and one that repeats a word."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(40_000))
    return [None, "", " \n\t ", "one", "one", "Ünï cödé 😀 word", long, long + " tail", "again " * 500, None]

