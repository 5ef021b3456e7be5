import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

WORDS = "the of and to in is was that with for on are as by this from have not which their alpha beta gamma delta river stone cloud winter market garden letter number silver orange copper marble".split()


@pytest.fixture
def prose():
    """Seeded invented text of n words."""

    def make(seed: int, n: int) -> str:
        rng = random.Random(seed)
        return " ".join(rng.choice(WORDS) + (rng.choice("aeiou") + rng.choice(WORDS) if rng.random() < 0.6 else "") for _ in range(n))

    return make


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Rows (doc_id, text) as a documents table with all its columns."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)

    return make


#: Nulls, empty and blank texts, repeated rows, odd characters.
ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (4, "one"), (None, "no id here at all"), (6, "日本語 😀 naïve text\r\nand <|endoftext|> more"), (7, "a" * 5000), (8, "word " * 3000)]


@pytest.fixture
def odd(documents):
    return documents(ODD)
