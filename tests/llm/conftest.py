import pytest

DATA = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977} x{i % 13}" for i in range(60_000))


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows, and columns with names that operators use themselves."""
    texts = [(1, "one two three four"), (2, None), (3, ""), (4, " \t\n"), (5, LONG), (5, LONG), (None, "one two three four"), (7, "ONE Two three\x0bfour"), (8, LONG + " end"), (9, "é ü \U0001f600")]
    names = "text, lang, source, n_chars, size, h, hb, score, ids, base, spans, digest, tree, comp, kept, n, taken, copies"
    rows = [(i, t, "en", None if i == 2 else "s", 1, *([7] * 14)) for i, t in texts]
    schema = "doc_id long, " + ", ".join(f"{c} {'string' if c in ('text', 'lang', 'source') else 'int'}" for c in names.split(", "))
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def no_docs(spark, odd_docs):
    return spark.createDataFrame([], odd_docs.schema)
