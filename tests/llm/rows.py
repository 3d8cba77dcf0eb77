"""Small tables with the awkward cases that every corpus operator must bear."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = [a + b for a in "ba ce di fo gu ha je ki lo mu".split() for b in ("n", "rt", "s", "lo", "ve", "mi", "tar", "")]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) + r.choice(VOCABULARY) for _ in range(n))


def awkward():
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows."""
    long = prose(1, 40_000)
    rows = [(i, prose(i + 10, 60 + i), "en", f"s{i % 3}", None) for i in range(12)]
    rows += [(100, None, None, None, None), (101, "", "en", "s0", 0), (102, " \n\t ", "en", "s1", 3), (103, long, "en", "s1", len(long)),
             (None, prose(99, 80), "en", "s2", 1), (None, None, None, None, None), (3, prose(13, 63), "en", "s0", None), (3, prose(13, 63), "en", "s0", None),
             (3, prose(77, 70), "de", "s1", 5), (104, "one", "en", "s0", 3), (105, "one", "en", "s0", 3), (106, prose(10, 60), "fr", None, 9),
             (107, "é" * 3000, "fr", "s2", 3000), (108, "a\x00b\u2028c " * 30, "xx", "s2", 1)]
    return rows


def extra(df, *names):
    """The table with columns of the given names added."""
    from pyspark.sql import functions as F

    for n in names:
        df = df.withColumn(n, F.lit(f"own {n}"))
    return df
