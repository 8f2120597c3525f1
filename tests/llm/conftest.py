import pytest

LONG = "lorem ipsum dolor sit amet " * 4000
WORDS = [f"w{i}" for i in range(400)]
COPY = " ".join(WORDS[:120])
NEAR = " ".join([*WORDS[:118], "other", "ending"])
FAR = " ".join(WORDS[:60] + WORDS[200:260])

#: (doc_id, text, lang, source): null and empty fields, a very long text, ties, repeated rows
ODD_DOCS = [
    (1, COPY, "en", "a"), (2, COPY, "en", "a"), (3, NEAR, "en", "b"), (4, FAR, None, "b"), (5, None, "en", "a"),
    (6, "", "en", None), (7, " \n\t ", None, None), (8, "one two", "de", "b"), (9, "one two", "de", "a"), (10, LONG, "en", "a"),
    (11, "ONE Two", "fr", "c"), (12, "Zeile eins\nZeile eins\n\nZeile eins", "de", "c"), (12, "Zeile eins\nZeile eins\n\nZeile eins", "de", "c"),
    (13, "…éß 漢字 don't <|endoftext|> ♡", "fr", "é"), (None, "no id here", "en", "a"), (14, "%%% ### | x", "en", "c"),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [(*r, None if r[1] is None else len(r[1]), i, "x", "y", i) for i, r in enumerate(ODD_DOCS)]
    # columns of names that operators use themselves must not disturb them
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long, `key` string, class_id string, least long").cache()


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
