"""Texts that are a benchmark item with words missing, against all windows."""

from gridloom.llm import decontamination
from gridloom.llm.words import words_of

from .conftest import frame, prose


def all_windows(rows, bench):
    found = []
    for d, t in rows:
        w = words_of(t)
        for i, text in bench:
            q = words_of(text)
            if not q or not w:
                continue
            k, size, best = min(5, len(q)), min(len(q), len(w)), None
            item = decontamination.shingles(q, k)
            for s in range(len(w) - size + 1):
                x = decontamination.similarity(decontamination.shingles(w[s : s + size], k), item)
                if x >= 0.8 and (best is None or x > best[0]):
                    best = x, s
            if best:
                found.append((d, i, *best, size))
    return sorted(found, key=str)


def test_item_with_words_missing(spark, awkward):
    bench = list(enumerate(t for t in prose(40, 10) if len(t.split()) >= 15)) + [(90, "a b c d e f g h i j k l m n o"), (91, "one two three"), (92, None)]
    rows = [(d, t) for d, t in awkward if len(t or "") < 3000]
    for i, t in bench[:-2]:
        w = t.split()
        for cut in (1, 2, 3, 5):
            rows += [(1000 * cut + i, " ".join(w[cut:])), (1000 * cut + 100 + i, " ".join(w[:-cut])), (1000 * cut + 200 + i, " ".join(w[: len(w) // 3] + w[len(w) // 3 + cut :]))]
    rows += [(9001, "a b c d e f g h i j k l m n"), (9002, "one two"), (9003, "a b c d")]
    df, b = frame(spark, rows), spark.createDataFrame(bench, "item_id bigint, text string")
    found = decontamination.decontaminate(df, b).collect()
    want = all_windows(rows, bench)
    assert sorted(((r["doc_id"], r["item_id"], r["similarity"], r["first_word"], r["n_words"]) for r in found), key=str) == want
    assert (9001, 90, 10 / 11, 0, 14) in want
    assert decontamination.without_leaks(df, b).count() == len(rows) - sum(d in {x[0] for x in want} for d, _ in rows)
