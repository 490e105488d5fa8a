import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

CLASHING = "score double, held_out string, node long, n long, key string, text_id long, `first` long, component_id long, n_lines string"


@pytest.fixture(scope="session")
def documents(spark):
    """Rows of (doc_id, text) with further columns whose names the operators use themselves."""

    def make(rows):
        wide = [(i, t, 0.5, "x", 1, 2, "k", 3, 4, 5, "y") for i, t in rows]
        return spark.createDataFrame(wide, f"doc_id long, text string, {CLASHING}").repartition(3)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank and very long texts, ties, repeated rows, a null id."""
    rng = random.Random(3)
    vocabulary = ["alpha", "Beta", "gamma", "delta", "eps", "zeta,", "eta", "théta", "ioτa", "kappa."]
    long = " ".join(rng.choice(vocabulary) for _ in range(20_000))
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, "ONE  two"), (7, long), (8, long + " tail"), (9, "same line\nother"),
            (10, "same line\nother"), (10, "same line\nother"), (None, "same line\nother"), (12, "x" * 50_000), (13, "\n\n\n"), (14, "a b c d e f g h i j k l m n o p q r s t")]
