import random

import pytest

#: Columns whose names the operators use themselves.
CLASH = ["n_shingles", "score", "tile", "rep", "component", "toxic_score", "toxic_predicted", "lang_pred", "lang_score", "lang_rejected", "failed_mask", "kept", "a", "b", "grp", "bucket", "file", "start", "ids", "keys", "f1", "f2", "m", "good", "h1", "h2"]

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ",", ".", ".\n"]) for _ in range(n))


def odd_documents() -> list[tuple]:
    """(doc_id, text, lang, source): nulls, empty and blank texts, copies, near copies, repeated rows, a very long text."""
    base = prose(1, 120)
    rows = [
        (None, prose(2, 40), "xx", "s"),
        (1, None, "xx", "s"),
        (2, "", None, None),
        (3, " \n\t\x0b ", "xx", "s"),
        (4, base, "xx", "s"),
        (5, base, "yy", "s"),
        (6, base.upper(), "xx", None),
        (7, base + " tail", "xx", "s"),
        (8, base.replace("alpha", "other", 1), "xx", "s"),
        (9, "one", "xx", "s"),
        (10, "one", "xx", "s"),
        (11, "one two", "xx", "s"),
        (12, prose(3, 30_000), "xx", "s"),
        (13, "x" * 300_000, "yy", "s"),
        (14, "\u00df \u00e9 \u6f22\u5b57 \U0001f642 <|endoftext|> \u00a0 \u2028 na\u00efve", "yy", "s"),
        (15, "###$$$ ***", "yy", "s"),
        (15, "###$$$ ***", "yy", "s"),
        (16, "12345 67890", None, "s"),
    ]
    return rows + [(20 + k, prose(50 + k, 60), "xx" if k % 2 else "yy", "s") for k in range(12)]


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_documents(), "doc_id long, text string, lang string, source string")
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASH]).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture
def work(spark):
    from tessera.llm.common import shared_dir

    return shared_dir(spark)
