import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, kept string, node long"


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) pairs, with columns whose names clash with the operators' own."""

    def make(rows):
        return spark.createDataFrame([(d, t, "en", "src0", 1, "x", "y", 1) for d, t in rows], SCHEMA)

    return make


#: Nulls, empty, blanks, repeated rows and ids, ties and a very long text.
WORDS = [f"w{i}" for i in range(60)]
TEXT = " ".join(WORDS)
HARD = [
    (1, TEXT),
    (2, TEXT),
    (2, TEXT),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (None, TEXT),
    (None, None),
    (6, "one two"),
    (7, "ONE two"),
    (8, " ".join(WORDS[:30] + ["x"] + WORDS[31:])),
    (9, "word " * 30000),
    (10, "línea única\n" * 3 + "x" * 50),
    (2, "another text under an id that repeats"),
]


@pytest.fixture
def hard():
    return HARD
