"""Small awkward tables: nulls, empty and long texts, ties, repeated rows, and columns whose names clash."""

import random

CLASH = "label string, k1 long, ids string, size long, copies string, rank int, n long"


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "théta"]) + str(rng.randint(0, 40)) for _ in range(n))


def awkward(spark):
    """doc_id, text, lang, source, n_chars and clashing extra columns."""
    rng = random.Random(3)
    base = [words(rng, 60) + "\n" + words(rng, 20) for _ in range(6)]
    edited = [b.replace(b.split()[30], "changed", 1) for b in base[:3]]
    long = words(rng, 5000)
    texts = [*base, *edited, base[0], base[0], None, "", " \n\t", "one two", "one two", long, long + " end", "x" * 20000]
    rows = [(i, t, "en", ["a", None, "b"][i % 3], None, "x", 1, "y", 2, "z", 3, 4) for i, t in enumerate(texts)]
    rows += [rows[0], (None, base[1], None, None, 5, None, None, None, None, None, None, None), (None, None, "en", "a", 0, *[None] * 7)]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}").repartition(3)


def plain(row):
    return tuple(row)
