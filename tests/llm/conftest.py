import pytest
from pyspark.sql import functions as F

LONG = "lorem ipsum dolor " * 9000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empties, a very long text, ties, repeated rows and clashing extra columns."""
    rows = [
        (5, "one two three four five six seven", "en", 1),
        (3, None, None, None),
        (1, "", "en", 2),
        (9, LONG, "fr", 3),
        (9, LONG, "fr", 3),
        (4, "one two three four five six seven", "en", 1),
        (None, "no id here", "en", 1),
        (7, "naïve café — 日本語 🙂 ▁ <|endoftext|>\x1c\x85 end", "de", 4),
        (2, " \t\n ", "es", 0),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long").withColumns(
        {c: F.lit(c) for c in ("shard", "piece", "start", "length", "score", "key", "component_id", "fingerprint", "host", "words", "quality", "n_entities")}
    )


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
