import pytest

DOCS = "text string, doc_id long, lang string, source string, n_chars long, kept boolean, _key string, words string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Rows (doc_id, text, ...) with further columns whose names clash with the operators' own."""

    def make(rows):
        full = [(t, i, *(list(rest) + ["en", "s"][len(rest) :]), len(t or ""), True, "k", "w") for i, t, *rest in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def awkward(docs_of):
    """Nulls, empty and blank texts, one long text, repeated rows, and several texts under one id."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, long), (5, "one two"), (5, "one two"), (6, "a b c d e f g"), (6, "other text here"), (None, "no id"), (None, None), (7, "É ß 中文 😀 !!!")]
    return docs_of(rows)


@pytest.fixture(scope="session")
def nothing(docs_of, spark):
    return docs_of([(1, "x")]).where("doc_id = 2")
