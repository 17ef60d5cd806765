import pytest

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
ODD = [None, "", " \n\t ", "one", "Same text here. It repeats.", "Same text here. It repeats.", "émigré 🎯 漢字 <|endoftext|>", LONG]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, names that clash with operators' own."""
    rows = [(i if i != 4 else 5, t, "en" if i % 2 else None, None if i % 3 == 0 else "s1", i, "extra", i, 1.0) for i, t in enumerate(ODD)]
    rows += [(None, "Text without an id, told apart by its words alone.", None, None, None, None, None, None), (3, "one", "en", "s1", 3, "extra", 3, 1.0), (3, "one", "en", "s1", 3, "extra", 3, 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, payload string, node long, score double")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
