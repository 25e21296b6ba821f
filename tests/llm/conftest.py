import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, g int, ids string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text[, lang]) rows, with extra columns whose names operators use inside."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", None, None, "x", 1, None) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def odd(docs_of):
    """Nulls, empty and long texts, ties, repeated rows and repeated ids."""
    long = " ".join(f"word{i % 977} thing{i % 31}" for i in range(30_000))
    return docs_of([(1, None, None), (2, "", "en"), (None, "a text without an id", "en"), (3, "same row", "en"), (3, "same row", "en"), (3, "other text, same id", "fr"),
                    (4, long, "en"), (5, long, None), (6, " \n\t ", "en"), (7, "1234 5678 !!", "en"), (8, "éß 中文 \U0001f600", "de")])
