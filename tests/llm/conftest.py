import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts; ids count from 0."""
    def make(texts, lang="en"):
        return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t in enumerate(texts)], DOCS)
    return make


@pytest.fixture(scope="session")
def read(spark, sf):
    def table(name):
        return spark.read.parquet(f"{sf}/{name}.parquet")
    return table


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, white space, one word, repeats, wide characters, something long."""
    return [None, "", " \n\t ", "word", "same text here", "same text here", "日本語 😀 ünï é́ \x00  ", "a" * 20000, "the quick brown fox " * 3000,
            "Line one\nLine one\n\nLine two  end ", "UPPER lower Upper"]
