"""Documents with every awkward case, and brute-force helpers."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_h long, size long, hash string, bucket long, pos int, drops string, score string"


def docs(spark, pairs, lang=None):
    """Rows (doc_id, text) with columns whose names clash with those that operators use inside."""
    rows = [(d, t, lang, "s", len(t or ""), 1, 2, "h", 3, 4, "x", "y") for d, t in pairs]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


LONG = " ".join(f"word{k % 977} and{k % 31}" for k in range(60_000))
BASE = " ".join(f"tok{k}" for k in range(120))

EDGES = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one two three"), (6, BASE), (7, BASE), (8, BASE.replace("tok60", "other")), (9, LONG), (10, LONG + " end"),
    (11, "Ünïcode ǅ 日本語 𠮷𠮷 🙂 text with bytes \x00 and a nul"), (12, "a" * 20_000), (None, "no id " + BASE), (None, None), (14, "one"), (15, "x\n" * 3000), (16, "One\r\nTwo\r\n"), (4, "one"), (17, "ONE"),
]


@pytest.fixture(scope="session")
def edges(spark):
    return docs(spark, EDGES).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return docs(spark, [])


@pytest.fixture(scope="session")
def corpus(spark):
    """The smallest driver table, as pairs."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    return [(r.doc_id, r.text) for r in rows]
