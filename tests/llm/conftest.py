import pytest

LONG = "lorem " * 30_000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls everywhere, empty and long texts, repeated rows, columns with clashing names."""
    rows = [
        (1, "Plain words stand here, just like anywhere else.", "en", "a", 47),
        (1, "Plain words stand here, just like anywhere else.", "en", "a", 47),
        (2, "Plain words stand here, just like anywhere else.", "en", "a", 47),
        (3, "", "en", "b", 0),
        (4, None, None, None, None),
        (None, "a text whose key is missing", "en", "b", None),
        (None, None, None, None, None),
        (5, LONG, "xx", None, len(LONG)),
        (6, "x" * 5_000, "de", "c", 5_000),
        (7, " \t\n ", "de", "c", 4),
        (8, "ünïcödé 日本 🧿\ttab\n\nlines", "fr", "c", 24),
    ]
    clash = ("ids", "score", "row", "key", "h", "bucket", "salt", "fp", "base_spans", "held")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    schema += "".join(f", {c} string" for c in clash)
    return spark.createDataFrame([(*r, *["x"] * len(clash)) for r in rows], schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
