import random

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "block int, bucket int, n string, sig string, ids string, score string, row_id string, grp int, "
          "spans int, kept int, id int, key string, a string, toxic string")


def row(doc_id, text, lang="en"):
    clash = (7, 7, "x", "x", "x", "x", "x", 7, 7, 7, 7, "x", "x", "x")
    return (doc_id, text, lang, "src", len(text or ""), *clash)


def words(rng, n, base="alpha beta gamma delta omega kappa sigma theta zeta iota".split()):
    return " ".join(rng.choice(base) + str(rng.randrange(50)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows."""
    rng = random.Random(7)
    shared, long = words(rng, 60), words(rng, 40_000)
    near = words(rng, 200).split()
    changed = [*near[:150], "other", *near[151:]]
    rows = [
        row(1, "plain text of one kind"), row(2, None), row(3, ""), row(4, " \t\n "), row(5, "12 34 ... !!"),
        row(6, "plain text\nof  one kind"), row(7, "Plain text of one kind"), row(8, "plain text of one kind", None),
        row(None, "plain text of one kind"), row(None, None, None),
        row(9, words(rng, 30) + " " + shared), row(10, shared + " " + words(rng, 30)), row(11, words(rng, 50)),
        row(12, " ".join(near)), row(13, " ".join(changed)), row(14, long), row(15, "w" * 30_000),
        row(16, "mail a.b@c.example.org now"), row(17, "é漢字 𝔘 ▁ x"), row(18, "one two three"), row(19, "ONE two\tthree"),
        row(20, "twice the same row here"), row(20, "twice the same row here"), row(21, long),
        (22, "nulls elsewhere", *[None] * 17),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
