import pytest

ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today", "en", "s0", 1),
    (2, None, None, None, None),
    (3, "", "en", None, 0),
    (4, "The quick brown fox jumps over the lazy dog near the old river bank today", "en", "s0", 1),
    (4, "The quick brown fox jumps over the lazy dog near the old river bank today", "en", "s0", 1),
    (None, "Der schnelle braune Fuchs springt über den faulen Hund am alten Fluss entlang", "de", "s1", 1),
    (6, "\n\n \t", "de", "s1", 3),
    (7, "word " * 30_000, "en", "s1", 150_000),
    (8, "x" * 20_000, "en", "s1", 20_000),
    (9, "Ünïcode Σίσυφος 数据 <|endoftext|> İ 🙂 á", "xx", "s2", 5),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties and repeated rows."""
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """Columns whose names the operators use inside."""
    names = "doc keys label node bucket hub word row text_ k1 k2 shard slot w p q b digest place n words item n_hit start stop lang_found size".split()
    from pyspark.sql import functions as F

    return odd.select("*", *[F.lit(1).alias(n) for n in names])
