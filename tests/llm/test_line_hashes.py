"""Line dedup with hashes so narrow that nearly all of them collide gives what wide ones give."""

import pytest

from gridloom.llm import line_dedup

from .conftest import frame, prose


@pytest.fixture(scope="module")
def lines(awkward):
    rows, more = list(awkward), prose(50, 40)
    for i, t in enumerate(more):
        w = t.split()
        rows.append((500 + i, "\n".join([t, " ".join(w[1:]), " ".join(["new", *w]), more[i - 1], " ".join([*w[:2], "other", *w[3:]])])))
    rows += [(600, "ha " * 300), (601, "ha " * 301 + "\nha ha ha ha ha"), (602, "ha ha ha he ha ha"), (603, "ha ha ha ha ha ha\tha \r\n \f"), (604, "a b c d e\n a  b c d f \n\n \nb c d e")]
    return rows


def findings(spark, rows):
    names = ("doc_id", "n_lines", "n_equal", "n_near", "removed", "kept_text")
    return sorted((tuple(map(str, (r[n] for n in names))) for r in line_dedup.line_dedup(frame(spark, rows)).collect()))


@pytest.mark.parametrize("name", ["_BITS", "_KEY_BITS"])
def test_narrow_hashes_lose_no_link(spark, lines, name, monkeypatch):
    want = findings(spark, lines)
    assert sum(int(r[3]) for r in want) > 80
    monkeypatch.setattr(line_dedup, name, 4)
    assert findings(spark, lines) == want


def test_small_shares_of_a_group(spark, lines, monkeypatch):
    rows = [*lines, *[(700 + i, f"one line of a form letter for {i} with care") for i in range(60)]]
    want = findings(spark, rows)
    monkeypatch.setattr(line_dedup, "_SHARE", 7)
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 3)
    assert findings(spark, rows) == want
    assert sum(int(r[3]) for r in want if int(r[0] or 0 if r[0] != "None" else 0) >= 700) == 59
