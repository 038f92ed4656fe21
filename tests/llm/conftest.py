import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = {"row_key": "1", "_text": "2", "score": "3", "digest": "4", "position": "5", "fingerprint": "6", "ids": "7", "part": "8", "size": "9", "chunk": "10", "mix_size": "11", "_rate": "12", "block": "13"}
EN = "the cat and the dog are in the house with that other thing which was there "
DE = "der hund und die katze sind nicht in dem haus mit dem anderen ding das dort war "


def edge_rows():
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    rows = [(1, EN * 3, "en", "a", 10), (2, DE * 3, "de", "b", 10), (3, None, "en", "a", None), (4, "", None, None, 0), (5, " \t\n ", "en", "a", 4),
            (6, EN * 900, "en", "a", 10), (7, "x" * 40_000, "en", "b", 40_000), (7, "x" * 40_000, "en", "b", 40_000), (8, EN * 3, "en", "a", 10),
            (None, EN * 3, "en", None, 10), (None, None, None, None, None), (9, "naïve 😀 日本 ▁ 12½ 'll <|endoftext|> a b\r\nc", "de", "b", 3), (10, "!!! 123", "de", "b", 7)]
    return rows + [(20 + i, f"{(EN if i % 2 else DE)} number{i} " + EN[: i * 3], "en" if i % 2 else "de", "abc"[i % 3], 5) for i in range(20)]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def clashing(edge):
    from pyspark.sql import functions as F

    return edge.withColumns({k: F.lit(v) for k, v in CLASHING.items()})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
