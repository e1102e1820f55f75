import pytest

WORDS = "the of and river stone cloud maple amber quiet orbit lantern copper meadow signal harbor velvet".split()


def sentence(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7919 + i * i * 31 + i * seed) % len(WORDS)] + str((seed * 31 + i * 17) % 97) for i in range(n))


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, and columns whose names clash with the operators' own."""
    long_text = " ".join(sentence(i, 50) for i in range(600))
    rows = [
        (1, "Alpha beta gamma delta epsilon.", "en", "a", 30), (2, "Alpha beta gamma delta epsilon.", "en", "a", 30), (3, "", None, "a", 0), (4, None, "en", None, None),
        (5, long_text, "en", "b", len(long_text)), (6, long_text + " extra", "en", "b", 1), (7, sentence(3, 40), "de", "a", -5), (7, sentence(3, 40), "de", "a", -5),
        (None, sentence(4, 30), None, None, None), (8, "  \n\t ", "en", "a", 4), (9, "Released under the MIT License. cc by Cc-By", "en", "a", 2**40), (10, "ünï\u2581cødé 🎉 <s>\u0000x", "xx", "c", 3),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    clash = "digest key rep n sig row_ id_ score hash_ bucket slot component".split()
    df = spark.createDataFrame(rows, schema)
    return df.selectExpr("*", *(f"'x' as {c}" for c in clash))


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)
