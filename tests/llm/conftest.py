import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size int, kept boolean, id long"
EN = "the and of to in that was with from this which have would there their been people because about into".split()
DE = "der die und das nicht mit von auf eine ist sich für dem den auch werden über schön größe straße".split()


def prose(r, words, n):
    return " ".join(r.choice(words) + r.choice(["", "", "er", "ing", "en"]) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Nulls in every column, empty and white texts, ties, repeated rows, one long text, near copies."""
    r = random.Random(5)
    out = []
    for n in range(40):
        lang = "en" if n % 3 else "de"
        out.append((n, prose(r, EN if lang == "en" else DE, r.randint(5, 60)), lang if n % 7 else None, f"s{n % 5}" if n % 11 else None))
    base = prose(r, EN, 80).split()
    for n in range(100, 106):
        w = list(base)
        w[n - 90] = "changed"
        out.append((n, " ".join(w), "en", "near"))
    out += [(n, "One exact copy of a text, with Several words.", "en", "s0") for n in (200, 201, 205)]
    out += [(300, None, None, None), (301, "", "en", "s1"), (302, " \t\n ", None, "s1"), (303, "word", "en", None), (304, "12345 67890", "en", "s2")]
    out += [(None, "a row without an id but with text", "en", "s3"), (400, prose(r, EN, 30_000), "en", "long"), (400, "the same id again", "en", "s1")]
    out += [(500, "a repeated row of text to keep", "en", "s2")] * 2
    return [(i, t, a, s, None if t is None else len(t), "k", 1, False, 9) for i, t, a, s in out]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
