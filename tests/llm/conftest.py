import pytest

LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(6000))
PROSE = "The river ran past the old mill and the miller counted his sacks of grain before the rain came down again over the valley"
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard string, ids int, term string, possible boolean"


def rows_of(texts):
    return [(i, t, "en", "s", len(t or ""), "x", 1, "t", None) for i, t in texts]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty, blank and very long texts, repeated rows, equal texts, and columns of clashing names."""
    near = PROSE.replace("again", "soon")
    texts = [
        (5, None),
        (6, ""),
        (7, " \n\t "),
        (8, LONG),
        (9, "x" * 70_000),
        (10, PROSE),
        (11, PROSE),
        (12, PROSE),
        (12, PROSE),
        (13, near),
        (None, PROSE),
        (None, None),
        (14, "one two"),
        (15, "one two"),
        (16, "ONE two"),
        (17, "naïve café 東京 😀 \x1c \x85 don't"),
        (50, LONG + " end"),
    ]
    return spark.createDataFrame(rows_of(texts), COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)
