import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def rough(spark):
    """Documents with nulls, empty and long texts, copies, repeated rows and a hot source."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeéßx") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    rows = []
    for i in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 5, 19, 20, 21, 80, 200]))]
        text = rng.choice([" ", "\n", "\t\r\n", "  "]).join(words)
        if i % 9 == 0:
            text = f"{text} {passage} {rng.choice(vocabulary)}"
        rows.append((i, text, rng.choice(["en", "de"]), "hot" if i % 3 else f"s{i % 7}", len(text)))
    rows += [(200 + i, rows[30 + i % 3][1].upper() if i % 4 == 0 else rows[30 + i % 3][1], "en", "hot", 1) for i in range(12)]
    rows += [(300, None, None, None, None), (301, "", "en", "s", 0), (302, "  \n ", "de", "s", 3), (303, "word " * 4000, "en", "s", 1),
             (304, "He " * 50, "en", "s", 1), (305, "x" * 9000, "en", None, 1), (306, "12 34", "en", "s", 5)]
    rows += [rows[3], rows[3], rows[9], (None, "no id here " * 9, "en", "s", 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing():
    """Adds columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    def add(df):
        return df.withColumns({c: F.lit("theirs") for c in (
            "hash", "block", "bin", "label", "n_words", "_id", "_hash", "_text", "_words", "held_out", "score")})

    return add


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
