import random

import pytest

WORDS = "the of and river stone bright under walking seven carry window slowly green market paper quiet morning letter bridge silver".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


#: (doc_id, text, lang, source, n_chars, text_len): nulls in every column, empty and blank texts, a very
#: long text, exact copies, near copies, repeated ids, and a further column.
def rows():
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    return [
        (1, base, "en", "a", len(base), 7),
        (2, base, "en", "a", len(base), 7),
        (3, " ".join(near), None, "b", 10, None),
        (4, prose(4, 30000), "de", None, None, 1),
        (5, "", "en", "b", 0, 1),
        (6, None, "en", "b", None, 1),
        (7, " \t\n ", "en", "a", 4, 1),
        (8, "word", "en", "c", 4, 1),
        (9, prose(9, 80), "en", "a", 4, 1),
        (9, prose(9, 80), "en", "a", 4, 1),
        (None, prose(10, 60), None, None, 4, 1),
        (None, prose(11, 60), None, "a", 4, 1),
        (12, "ünïcode 😀 tëxt mit Ümlauten " * 10, "de", "c", 4, 1),
    ]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_len int"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
