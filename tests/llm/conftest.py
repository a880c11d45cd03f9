import pytest

PASSAGE = "".join(f"w{i * 7919 % 1000} " for i in range(80))


@pytest.fixture(scope="session")
def hard_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    rows = [
        (
            1, "One two three four five six seven.", "en", "s"
        ), (2, "One two three four five six seven.", "en", "s"), (2, "One two three four five six seven.", "en", "s"),
        (3, None, None, None), (4, "", "en", None), (None, "no id here", None, "s"), (5, "x" * 50_000, "de", "s"), (6, PASSAGE + "left", "fr", "s"), (
            7, "right " + PASSAGE, "fr", "s"
        ),
        (8, " \t\n ", "en", "s"), (9, "42 % !", "en", "s"), (
            10, "é" * 300 + "日本語 <|endoftext|> 😀", "es", "s"
        ), (11, "ab" * 400, "es", "s"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    return df.selectExpr(
        "doc_id", "text", "lang", "source", "length(text) AS n_chars", "1 AS rid", "'x' AS score", "2 AS fp", "3 AS _at"
    )


@pytest.fixture(scope="session")
def no_docs(hard_docs):
    return hard_docs.limit(0)
