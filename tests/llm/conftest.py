import pytest

LONG = "long " * 30_000 + "tail"
#: Names that the operators use for columns of their own.
CLASHING = "row chunk band a b c node component shard kept held_out size _row _removed _lower bucket".split()


def passage(k, n=20):
    return " ".join(f"p{k}w{i}" for i in range(n))


ROWS = [
    (1, "The quick brown fox jumps over the lazy dog again and again\nSecond line of the first text", "s0"),
    (2, "The quick brown fox jumps over the lazy dog again and again\nSecond line of the first text", "s0"),
    (3, None, "s0"),
    (4, "", None),
    (5, "   \n\t ", "s1"),
    (6, LONG, "s0"),
    (7, f"start {passage(1)} middle {passage(2)} end", "s1"),
    (8, f"{passage(2)} {passage(1)}", "s0"),
    (9, "one two", "s2"),
    (9, "one two", "s2"),
    (9, "another text under the same id", None),
    (None, "a text without an id", "s0"),
    (None, None, None),
    (10, "Café ÜBER naïve 日本語 😀\r\nx\x0by z ▁ odd", "s1"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in ROWS], "doc_id long, text string, source string, n_chars long")
    return docs.selectExpr("*", *[f"'x' AS `{c}`" for c in CLASHING]).repartition(3)


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.where("false")
