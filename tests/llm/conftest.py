import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, lines string, quality int, n int, key string, x double, print string, node long, block long, quality_ string, gone long, lost_key long, row string, __print long, __h long, __group long"
LONG = " ".join(f"word{i % 5000}" for i in range(120_000))
PROSE = "the quick brown fox jumps over the lazy dog and then it sleeps in the warm sun all day long."


def doc(doc_id, text, lang="en", source="s"):
    """A row with columns whose names clash with those that operators use inside."""
    return (doc_id, text, lang, source, len(text or ""), "extra", 7, 1, "k", 0.5, "p", 3, 4, "q", 5, 6, "r", 7, 8, 9)


@pytest.fixture(scope="session")
def odd_rows():
    return [
        doc(1, PROSE), doc(2, PROSE), doc(2, PROSE), doc(3, PROSE + " Indeed."), doc(4, None), doc(5, ""), doc(6, " \t\n "), doc(None, PROSE), doc(None, None),
        doc(7, LONG, None, None), doc(8, "Ünïcödé tèxt ñ\n\nÜnïcödé tèxt ñ", "fr"), doc(9, "12345 !!! ...", "de"), doc(10, "one"), doc(11, "one two"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOC).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
