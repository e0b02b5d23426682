import pytest

ODD = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, "x", "en", None), (4, "a b c d", "en", "b"), (5, "a b c d", "en", "b"), (5, "a b c d", "en", "b"), (None, "null id é\U0001f600 text here and more", None, "a"),
    (6, "word " * 30000, "en", "a"), (7, " \n\t ", "de", "a"), (8, "Mail me: a.b@c-d.example or +1 (743) 555-3824, card 4532 0151 1283 0366, ip 10.0.0.255.", "en", "c"), (9, "  two  spaces\n\nlines ", "fr", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, _doc string, _h string, id long, shard string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, repeated rows, ties, empty and long texts, and extra columns with clashing names."""
    return spark.createDataFrame([(i, t, l, s, len(t or ""), 7, "d", "h", 1, "s") for i, t, l, s in ODD], SCHEMA).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
