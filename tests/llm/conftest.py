import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside.
MORE = "key string, word string, size int, component int, _id int, held_out_ int, cell int, row int"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in any column, empty and very long texts, repeated rows, clashing extra columns."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    texts = [
        (1, "The cat sat on the mat and then it slept. You are an idiot!", "en", "a"),
        (1, "The cat sat on the mat and then it slept. You are an idiot!", "en", "a"),
        (2, None, "en", "a"),
        (3, "", None, "b"),
        (4, " \t\n", "fr", None),
        (None, "le chat est sur la table", "fr", "b"),
        (None, None, None, None),
        (5, long, "en", "b"),
        (6, "x" * 50_000, None, None),
        (7, 'token = "abcdefghijkl0123" \U0001f600 İ \x00 ﬁ', "de", "c"),
        (8, long + " end", "en", "c"),
        (9, "12345 !!! 678", "en", "c"),
        (10, long, "en", "d"),
    ]
    rows = [(i, t, g, s, len(t) if t is not None else None, "k", "w", 1, 2, 3, 4, 5, 6) for i, t, g, s in texts]
    return spark.createDataFrame(rows, f"{DOCUMENTS}, {MORE}")


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)
