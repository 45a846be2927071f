import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sig string, n string, token string, pos string, content string, size string, key string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, a shared id, and columns whose names clash with inner ones."""
    rng = random.Random(7)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long = prose(30_000) + "\n" + "x" * 20_000
    texts = [(1, prose(60)), (2, None), (3, ""), (4, " \n\t "), (5, long), (6, "All rights reserved.\n" + prose(40)), (6, "All rights reserved.\n" + prose(40)), (7, "ßΩ 中文 — ##"), (None, prose(30)), (None, None), (8, "a")]
    twice = (9, prose(50))
    rows = [(*t, "en", "s1", 5, "x", "y", "z", "p", "c", "0", "k") for t in [*texts, twice, twice]] + [(10, texts[0][1], None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
