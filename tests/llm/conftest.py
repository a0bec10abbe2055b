import random

import pytest

WORDS = "alder birch cedar dogwood elm fir gum hazel ivy juniper kauri larch maple nutmeg oak pine".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

# Columns of the operators' own frames; an input may have any of them too.
CLASHING = (
    "row size end begin fp root key node least copies tag start bands shard target place bucket turn next_text score "
    "rejected lang_pred id x query part before ids base words n_words passes cell led head_value digest kind"
).split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def messy_rows():
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    rng = random.Random(5)
    shared, long = prose(rng, 70), prose(rng, 30_000)
    rows = [
        (1, f"{prose(rng, 40)} {shared} {prose(rng, 20)}", "en", "b", 1),
        (2, f"{shared}\n\n{prose(rng, 60)}", "en", "a", 2),
        (3, None, "en", "a", None),
        (4, "", None, None, 0),
        (5, " \t\n \n", "en", None, 5),
        (6, long, "en", "b", 6),
        (7, long + " last", "en", "c", 7),
        (8, "one", "en", "c", 3),
        (9, "one", "en", "c", 3),
        (9, "one", "en", "c", 3),
        (10, f"{shared}", None, "a", 3),
        (None, f"{shared} nobody", "en", "a", 3),
        (None, None, None, None, None),
        (11, "Ünïcode — “quotes” and spaces \U0001f600 <|endoftext|> it's", "de", "d", 9),
        (11, "another text under a used id", "de", "d", 9),
        (-12, f"{prose(rng, 10)}\r\n{prose(rng, 10)}\n{prose(rng, 10)}", "de", "", 9),
    ]
    return rows


@pytest.fixture
def messy(spark, messy_rows):
    """The rows as a frame, with ``extra`` columns whose names the operators use themselves."""

    def build(extra=CLASHING):
        from pyspark.sql import functions as F

        return spark.createDataFrame(messy_rows, SCHEMA).select("*", *[F.lit(f"own {c}").alias(c) for c in extra])

    return build


@pytest.fixture
def documents(spark):
    """A frame from ``(doc_id, text)`` pairs."""

    def build(pairs):
        return spark.createDataFrame([(i, t, "en", "s", None) for i, t in pairs], SCHEMA)

    return build
