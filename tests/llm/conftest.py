import pytest

from visitlake.llm.tokens import vocabulary_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: texts that every operator must take: NULL, empty, white space, one word, repeated rows, a very long one
ODD_TEXTS = [None, "", " \t\n", "word", "same text here twice over", "same text here twice over", "long " * 60_000]


@pytest.fixture
def odd_docs(spark):
    rows = [(i, t, None if i == 3 else "en", None if i == 4 else "src0", 0) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[4], (None, "text without an id but many words in it", "en", "src1", 0)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture
def clashing(odd_docs):
    """The same documents with columns named as operators name theirs."""
    from pyspark.sql import functions as F

    names = ("key", "hash", "token", "node", "grp", "n", "epoch", "epochs", "cut", "rest", "score", "accepted", "lang_pred", "pii", "row", "length", "piece")
    return odd_docs.withColumns({c: F.lit("clash") for c in names})


@pytest.fixture(scope="session")
def vocabulary():
    return vocabulary_path()
