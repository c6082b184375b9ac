import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, h string, h2 long"


@pytest.fixture
def docs(spark):
    """docs(texts, ids=None): a documents table with extra columns whose names clash with inner ones."""

    def make(texts, ids=None, langs=None):
        ids = list(range(len(texts))) if ids is None else ids
        langs = langs or ["en"] * len(texts)
        rows = [(i, t, lang, "s", None if t is None else len(t), "x", "y", 1) for i, t, lang in zip(ids, texts, langs, strict=True)]
        return spark.createDataFrame(rows, SCHEMA).repartition(3)

    return make


#: Null, empty and odd texts that every operator takes.
ODD = [None, "", " \n\t", "a", "!!! ???", "é", "\u0000x", "日本語のテキスト", "word " * 5_000, "🙂🙂 <|endoftext|>", "same text here", "same text here"]


@pytest.fixture
def odd():
    return list(ODD)
