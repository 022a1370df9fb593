import pytest

#: Columns whose names clash with those that operators use inside.
EXTRA = "n long, key string, rep long, ids string, n_tokens string, hashes string, gone string, h long, data string, score string"
LONG = " ".join(f"word{i % 977} {i}" for i in range(60_000)) + "\n" + "x" * 30_000


def frame(spark, rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
    full = [(i, t, "en", "s", len(t or ""), *([None] * 10)) for i, t in rows]
    return spark.createDataFrame(full, f"{schema}, {EXTRA}")


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and blank texts, one very long text, ties and repeated rows."""
    body = "\n".join(f"this is line number {i} of a text that repeats itself elsewhere" for i in range(12))
    return [
        (1, body), (2, body), (2, body), (3, body + "\nand one more line that only this text has at its end"), (4, None), (5, ""), (6, "  \n\t "),
        (None, body), (None, None), (7, LONG), (8, LONG), (9, "short one"), (10, "short one"), (11, "été ünï 中文 \U0001f600 " * 30), (2**53 + 1, "a large id"),
    ]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return frame(spark, edge_rows).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").cache()
