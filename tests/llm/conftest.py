"""Documents with nulls, empty and very long texts, ties, repeats and columns whose names clash."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = "score double, label int, held_out boolean, fp long, spans string, n_words long, __id long, __gone long, shard long, bin string"


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang) rows, with every clashing column."""

    def make(rows):
        made = [(row[0], row[1], row[2] if len(row) > 2 else "en", "s", len(row[1] or "")) for row in rows]
        docs = spark.createDataFrame(made, DOCS)
        for column in CLASHES.split(", "):
            name, kind = column.split()
            docs = docs.selectExpr("*", f"cast(null as {kind}) as {name}")
        return docs

    return make


ODD = [
    (None, "no id here but some words to read"),
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one"),
    (5, "two words"),
    (5, "two words"),
    (6, "long " * 60_000 + "end"),
    (7, "ÉÀ ünï 日本   x"),
    (8, "1234 !!! ..."),
]


@pytest.fixture(scope="session")
def odd(frame):
    return frame(ODD)


@pytest.fixture(scope="session")
def no_docs(frame):
    return frame(ODD).limit(0)
