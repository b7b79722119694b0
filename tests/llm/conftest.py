import random

import pytest

from postwatch.llm import common

#: Columns beside the table's own, with names the operators use inside.
CLASHING = "id long, x string, cls string, part int, m long, row long, bands string, held_out string, root long, `N` long"


@pytest.fixture(autouse=True)
def configured(spark):
    common.configure(spark)


@pytest.fixture()
def frame(spark):
    """Documents from (doc_id, text) pairs, with extra columns."""

    def make(pairs, partitions=3):
        schema = "doc_id long, text string, lang string, source string, n_chars long, " + CLASHING
        rows = [(k, t, "en", "s", len(t or ""), 1, "x", "c", 2, 3, 4, "b", "h", 5, 6) for k, t in pairs]
        return spark.createDataFrame(rows, schema).repartition(partitions)

    return make


def prose(rng, n, letters="abcdefgé"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture()
def odd():
    """Nulls, empty, blank and long texts, one-word texts, repeated rows, one id for two texts."""
    rng = random.Random(9)
    long = prose(rng, 30_000)
    passage = prose(rng, 120)
    pairs = [(k, prose(rng, rng.randint(0, 90))) for k in range(25)]
    pairs += [(30 + k, prose(rng, 15) + " " + passage + " " + prose(rng, 9)) for k in range(6)]
    pairs += [(None, "no id " + passage), (None, None), (40, None), (41, ""), (42, " \t\n\r "), (43, "word"), (44, long), (45, long[:5000])]
    pairs += [(46, "e" * 3000), (47, passage), (47, passage), (48, "one id"), (48, "for two"), (49, "a b c d e"), (50, "a b c d e")]
    return pairs
