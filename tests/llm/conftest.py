import random

import pytest

EXTRA = ["lang", "source", "n_chars", "key", "n", "row", "words", "p", "score", "kept", "bucket", "hits", "line", "first", "segs", "item_id", "text_sha256", "__id", "norm"]


def frame(spark, rows):
    """documents with more columns, whose names operators use inside."""
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return df.selectExpr("*", *[f"'x' AS `{c}`" for c in EXTRA if c != "n_chars"], "CAST(length(text) AS BIGINT) AS n_chars")


def prose(seed: int, n: int, words: int = 400) -> list[str]:
    r = random.Random(seed)
    pool = ["".join(r.choice(["an", "er", "on", "the", "st", "ré", "ing", "ou"]) for _ in range(r.randint(1, 4))) for _ in range(words)]
    return [" ".join(r.choice(pool) for _ in range(r.randint(5, 60))) + "." for _ in range(n)]


@pytest.fixture(scope="session")
def awkward():
    """Nulls, empty and long texts, ties, repeated rows, copies that differ in case, near copies."""
    p = prose(1, 30)
    long = " ".join(prose(2, 400)) + "\n" + p[3]
    rows = [(i, t) for i, t in enumerate(p)] + [(100, p[0]), (101, p[0].upper()), (101, p[0]), (7, p[7]), (7, p[7]), (None, p[4]), (None, None), (102, None), (103, ""), (104, " \n\t "), (105, long), (106, long + " x"), (107, "Éa É"), (108, "éa é")]
    lines = [p[10] + "\n" + p[11] + "\n" + p[12], p[12] + "\n\n" + p[11].replace(" ", " zz ", 1) + "\n" + p[13], p[11].split(" ", 1)[1], "ok\nok\nok"]
    return rows + [(200 + i, t) for i, t in enumerate(lines)]
