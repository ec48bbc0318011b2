"""Small tables with every awkward case, and brute-force versions to hold results against."""

from __future__ import annotations

import random

from pyspark.sql import types as T

DOCS = T.StructType().add("doc_id", "long").add("text", "string").add("lang", "string").add("source", "string").add("n_chars", "long")
#: Names that operators might use themselves.
CLASHING = ["kept", "n_words", "chunk", "token", "ids", "decoded", "host", "class", "count", "expected_grade", "component_id", "share", "text2"]


def prose(rng: random.Random, n: int, width: int = 400) -> list[str]:
    return [f"w{rng.randrange(width)}" for _ in range(n)]


def awkward(spark, seed: int = 3, copies: int = 40):
    """Nulls in every column, empty and blank texts, long texts, exact and near copies, repeated rows, shared passages."""
    rng = random.Random(seed)
    rows, base, passage = [], prose(rng, 120), prose(rng, 60)
    for k in range(60):
        words = prose(rng, rng.randrange(1, 200))
        if k % 4 == 0:
            at = rng.randrange(len(words) + 1)
            words[at:at] = passage
        rows.append((k, " ".join(words), "en", f"s{k % 3}", 7))
    for k in range(copies):
        words = list(base)
        for _ in range(rng.randrange(0, 7)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((100 + k, " ".join(words), "de", "s0", None))
    rows += [(200 + k, rows[k][1], None, None, 1) for k in range(0, 20, 5)]
    rows += [(300, "", "en", "s1", 0), (301, None, "en", "s1", None), (302, " \n\t ", None, "s1", 3), (303, "one two", "fr", None, 7), (304, "one two", "fr", "s2", 7)]
    rows += [(None, "no id here", "en", "s0", 10), (None, None, None, None, None)]
    rows += [(305, " ".join(prose(rng, 20_000, 5000)) + " ü 日本 😀", "es", "s2", 1), (306, "Ünï cödé\x0bTab\tline\r\nend ÀB", "fr", "s0", 1)]
    rows += [rows[4], rows[5], rows[4]]
    return spark.createDataFrame(rows, DOCS)


def nothing(spark):
    return spark.createDataFrame([], DOCS)


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit(f"own {n}") for n in CLASHING})


def components(nodes, links):
    root = {n: n for n in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {n: top(n) for n in nodes}
