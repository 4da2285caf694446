import pytest

#: A table with the cases that every operator must survive: nulls, empties, ties, repeated rows, clashing extra columns.
ODD = [
    (1, "one two three four five six seven eight nine ten", "x", 1),
    (1, "one two three four five six seven eight nine ten", "x", 1),
    (2, None, None, None),
    (3, "", "x", 0),
    (None, "one two three four five six seven eight nine ten", "y", 3),
    (4, "one two three four five six seven eight nine ten", None, 5),
    (5, " \t\n ", "x", 2),
    (6, "<|endoftext|> é́ \x01 \x02, a,  b \n\n c.\n" * 3, "z", 9),
]
SCHEMA = "doc_id long, text string, text_key string, bucket long"


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)
