import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, Length long, piece int, fp string, KEY string, ids string, label string, epoch int, start string"
EXTRA = (7, 3, "fp", "key", "ids", "label", 9, "start")  # extra columns whose names clash with those used inside

LONG = "A long line of words that goes on. " * 4000 + "\nZ" + "x" * 6000

EDGE_TEXTS = [
    (1, "The first document has a few words."),
    (2, None),
    (3, ""),
    (4, " \t\n\r\n "),
    (5, "12 345 !?"),
    (6, LONG),
    (7, "The first document has a few words."),
    (7, "The first document has a few words."),  # a repeated row
    (None, "A document without an id, but with words."),
    (None, None),
    (8, "Ünïcode \U0001f642 中文 text’s “quotes” <|endoftext|> it's'll 's"),
    (9, "\0 control \x0b and \x1f marks  and\u0085 ends"),
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    rows = [(i, t, "en" if i != 5 else None, None if i == 3 else "src", len(t or ""), *EXTRA) for i, t in EDGE_TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
