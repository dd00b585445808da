import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, k string"


def words(r, n):
    return [r.choice("stone river market garden winter signal engine paper window bridge forest letter music harbour silver valley planet teacher orange copper".split()) + r.choice(["", "s", "ing", "ed", "er"]) for _ in range(n)]


@pytest.fixture(scope="session")
def rows():
    """Copies, edited copies, shared passages, nulls, empty and long texts, repeated rows, and columns named like inner ones."""
    r = random.Random(3)
    shared = " ".join(words(r, 60))
    out = []
    for i in range(60):
        lines = [" ".join(words(r, r.randint(3, 40))) for _ in range(r.randint(1, 6))]
        if i % 3 == 0:
            lines.insert(0, f"Page {i} of 60 printed by user{i}")
        if i % 10 == 0:
            lines.append(shared)
        out.append((i, "\n".join(lines)))
    base = " ".join(words(r, 150))
    out += [(100 + i, base) for i in range(4)]
    for i in range(6):
        w = base.split()
        w[10 + 20 * i] = f"edit{i}"
        out.append((110 + i, " ".join(w)))
    out += [(200, None), (201, ""), (202, " \n\t "), (203, "one"), (204, "é漢字🙂 " * 30), (205, " ".join(words(r, 4000))), (206, "x" * 49), (207, "x" * 50), (208, "x" * 51), (300, "same row again"), (300, "same row again")]
    return [(i, t, "en", [None, "b", "a", "c"][n % 4], 0 if t is None else len(t), 7, "clash") for n, (i, t) in enumerate(out)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
