import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, blanks, repeated rows, a long text, and columns whose names clash with results."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    texts = [
        (1, "the quick brown fox jumps over the lazy dog and runs far away from home"),
        (2, "the quick brown fox jumps over the lazy dog and runs far away from home"),
        (2, "the quick brown fox jumps over the lazy dog and runs far away from home"),
        (3, None), (4, ""), (5, " \n\t "), (None, "no id here"), (6, long), (7, "a b c"), (8, "12 34 !!"),
    ]
    rows = [(i, t, "en", "s", len(t or ""), "mine", 0.25, True) for i, t in texts]
    return spark.createDataFrame(
        rows,
        "doc_id long, text string, lang string, source string, n_chars long, row string, score double, kept boolean",
    )
