"""Small tables with the cases that every operator has to stand."""

import random

#: Extra columns whose names operators use inside.
EXTRA = "score double, kept boolean, k long, id long, key string, h string, n long, norm string, label int, component_id long, piece int, words string, at int"


def documents(spark, rows):
    """documents with clashing extra columns, from (doc_id, text)."""
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
    return spark.createDataFrame([(i, t, None, "s", None, *([None] * 13)) for i, t in rows], schema)


def prose(n, seed=0, vocabulary=400):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeiou") for _ in range(rng.randint(2, 7))) for _ in range(vocabulary)]
    return " ".join(rng.choice(words) for _ in range(n))


def hard_rows():
    """Nulls, empty, blank and very long texts, ties, repeated rows, and near copies."""
    base = prose(120, 1)
    words = base.split()
    near = [" ".join([*words[:i], "changed", *words[i + 1 :]]) for i in (3, 50, 90)]
    far = " ".join(w if i % 4 else "other" for i, w in enumerate(words))
    return [(1, base), (2, base), (3, base.upper()), (4, near[0]), (5, near[1]), (6, near[2]), (7, far), (8, None), (9, ""), (10, " \t\n"), (11, "one two"), (12, "one  two"), (13, prose(30_000, 2)), (14, prose(30_000, 2) + " end"), (15, prose(80, 3)), (15, prose(80, 3)), (None, prose(40, 4)), (17, "ünï çödé 漢字 \U0001f600 " * 30)]
