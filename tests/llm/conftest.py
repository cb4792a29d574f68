import pytest

#: Texts that every operator must take.
ODD = [None, "", " ", "\n\n", "word", "é漢字 🎉", "a\x00b", "x" * 30_000, "same words again and again " * 3000, "tab\tand  two blanks ", "A B C d e f g h i j k l m n o p"]
#: Columns with names that operators might use themselves.
CLASH = "id long, code long, text string, label string, bucket long, hash long, place int, row long, score double, places string, segment string, x string, kept string, doc_id long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Rows with nulls, odd texts, repeats of ids and of rows, and columns with clashing names."""
    rows = [(None, 1, t, None, 2, None, 3, 4, 0.5, "p", None, "x", "k", i if i != 4 else None) for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[4], rows[7], (*rows[5][:2], "other text of the same id", *rows[5][3:])], CLASH)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
