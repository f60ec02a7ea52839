import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Columns of names that operators use inside.
CLASHING = ["fp", "key", "part", "at", "ids", "block", "start", "print", "edge", "kept", "_row", "_fp", "before", "toxic", "value"]


def words(seed, n, vocabulary=400):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(n))


EDGE_TEXTS = [
    None,
    "",
    " \t\n ",
    "one",
    "Don't SHOUT!! it's 1,234.5 naïve café ÀÉ",
    "日本語 テキスト 🙂👍🏽 Здравствуй мир",
    "<s></s>[INST] <|endoftext|> \\ \x00 \x1c \x85   ▁▁ a  b",
    "İstanbul ΣΑΣ ﬁ ẞ é ́x",
    "x" * 5000,
    words(1, 40_000),
    words(2, 300),
    words(2, 300),
    words(2, 299) + " other",
]


@pytest.fixture(scope="session")
def edge_rows():
    """Documents of every odd kind; ids with a gap, a tie, a null and a whole repeated row."""
    rows = [(3 * k, text, "en" if k % 2 else None, None, None) for k, text in enumerate(EDGE_TEXTS)]
    rows += [(6, "same id, another text", "de", "s", 1), (None, "no id", "en", None, None), (None, None, None, None, None)]
    return [*rows, rows[10], rows[10]]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def clashing_docs(edge_docs):
    for name in CLASHING:
        edge_docs = edge_docs.withColumn(name, F.lit("x"))
    return edge_docs


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
