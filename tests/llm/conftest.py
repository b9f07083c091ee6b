import pytest

CLASHES = "id string, n long, key int, size int, cell int, words string, label string, _key int, kept int, removed int"


@pytest.fixture(scope="session")
def odd(spark):
    """Rows of a documents table: nulls, empty and long texts, repeats, ties, names that clash with the operators' own."""
    line = "Some words that stand in a line of their own and go on for a while"
    rows = [
        (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "a"), (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "b"), (3, None, "a"), (4, "", None), (5, " \n\t ", None),
        (6, (line + "\n") * 40 + "the end", "a"), (7, "x" * 20_000, "b"), (8, "café 日本 \U0001f600 a▁b <s> \x00 end.", None), (9, "one", "c"), (10, "two words", "c"), (10, "two words", "c"), (None, "no id at all", "a"),
        (11, "\n".join(f"{line} {i % 7}" for i in range(300)), "a"), (12, "ALPHA beta gamma delta epsilon zeta eta theta iota kappa", None),
    ]
    df = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for part in CLASHES.split(", "):
        name, kind = part.split()
        df = df.selectExpr("*", f"cast('7' AS {kind}) AS `{name}`")
    return df


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")
