"""Secret scan: base patterns, and a linear-chain conditional random field over tokens.

A token is a run of [A-Za-z0-9+/_.=-] or another single character that isn't white space. Tags are outside, begin and
inside. Features are the token's shape, words and signs beside it, and what the file is like. The field is trained
here: on windows of tokens around base matches, tagged by them, and on one window of each document without. The sample is
bounded: about SAMPLE_DOCS rows, those with the smallest hash of id and text, and of their windows the MAX_WINDOWS with
the smallest hash, half of them with base matches. Tags are decoded by Viterbi over whole texts.

Tokens that aren't "open" (no digit, or under 8 characters) share a few feature vectors. Where the trained weights
prove that such a token is outside on every best path (its margin is over anything that transitions can give back),
Viterbi runs over the stretches between such tokens only; else over all tokens. Both give the same tags.

Spans of the field that touch no base span are added with kind "field". Null text is empty: no spans. A null id stays
null; repeated rows are scanned one by one. Empty input gives an empty result; without base matches to learn from,
there are only base spans.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, documents, materialize

KINDS = ("assign", "access", "hex", "field")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")

TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]+|[^\sA-Za-z0-9+/_.=-]")
OPEN = re.compile(r"(?=[A-Za-z+/_.=-]*[0-9])[A-Za-z0-9+/_.=-]{8,}")
WORD = re.compile(r"password|passwd|secret|token|api_?key|auth|bearer|credential|private", re.IGNORECASE | re.ASCII)
O, B, I = 0, 1, 2  # noqa: E741

WINDOW = 12
MAX_WINDOWS = 4000
SAMPLE_DOCS = 65_536
SHAPES = ("plain", "open", "hex", "upper_digits", "mixed_case", "base64_signs", "dotted", "dashed", "digits", "len12", "len16", "len20", "len32", "len40", "varied", "even", "camel_word")
NEAR = ("word_before", "sign_before", "quote_before", "quote_after", "at_near", "slash_near")
FILE = ("file_word", "file_short", "bias")
NAMES = SHAPES + NEAR + FILE
_SLOT = {n: i for i, n in enumerate(NAMES)}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches, sorted."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def file_features(text: str) -> list[int]:
    return [_SLOT["bias"], *([_SLOT["file_word"]] * bool(WORD.search(text))), *([_SLOT["file_short"]] * (len(text) < 500))]


def is_open(token: str) -> bool:
    return len(token) >= 8 and any("0" <= c <= "9" for c in token)


def shape(token: str) -> list[int]:
    if not is_open(token):
        return [_SLOT["plain"]]
    found = ["open"]
    digits, uppers, lowers = sum(c.isdigit() for c in token), sum(c.isupper() for c in token), sum(c.islower() for c in token)
    found += [n for n, yes in (
        ("hex", all(c in "0123456789abcdef" for c in token)), ("upper_digits", uppers and digits and digits + uppers == len(token)), ("mixed_case", uppers > 1 and lowers > 1 and digits),
        ("base64_signs", any(c in "+/=" for c in token)), ("dotted", "." in token), ("dashed", "-" in token or "_" in token), ("digits", digits and not uppers and not lowers), ("len12", len(token) >= 12), ("len16", len(token) >= 16), ("len20", len(token) >= 20),
        ("len32", len(token) >= 32), ("len40", len(token) >= 40), ("camel_word", digits <= 2 and lowers > 6),
    ) if yes]
    p = np.array(list(Counter(token).values())) / len(token)
    found.append("varied" if -(p * np.log2(p)).sum() > 3.0 else "even")
    return [_SLOT[n] for n in found]


def near(text: str, start: int, end: int) -> list[int]:
    """What stands beside a token: words in 32 characters before it, signs in 4, and the next character."""
    before, close, after = text[max(0, start - 32) : start], text[max(0, start - 4) : start], text[end : end + 1]
    yes = (WORD.search(before), ":" in close or "=" in close, '"' in close or "'" in close, after in ('"', "'") and after, "@" in close or after == "@", "/" in close)
    return [_SLOT[n] for n, y in zip(NEAR, yes, strict=True) if y]


def window_rows(text: str, spans) -> list[tuple[int, list[list[int]], list[int]]]:
    """(place, features, tags) of windows of tokens around base spans, or of one window if there are none."""
    whole = file_features(text)
    if spans:
        places = [s for s, _, _ in spans]
    else:
        first = OPEN.search(text)
        places = [first.start() if first else len(text) // 2]
    rows, done = [], -1
    for place in places:
        if place < done:
            continue
        lo, hi = max(0, place - 400), min(len(text), place + 400)
        tokens = [m.span() for m in TOKEN.finditer(text, lo, hi)]
        at = next((i for i, (_, e) in enumerate(tokens) if e > place), 0)
        tokens = tokens[max(0, at - WINDOW) : at + WINDOW]
        if not tokens:
            continue
        tags, last = [], None
        for s, e in tokens:
            # The value is secret, not the name before it.
            over = next((k for k, (a, kind, z) in enumerate(spans) if a < e and s < z and (kind or is_open(text[s:e]))), None)
            tags.append(O if over is None else I if over == last else B)
            last = over
        done = tokens[-1][1]
        rows.append((place, [shape(text[s:e]) + near(text, s, e) + whole for s, e in tokens], tags))
    return rows


class Field:
    """Weights of the field: emit[feature, tag], move[tag, tag]."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move
        inward, outward = move.max(0), move.max(1)
        self.swing = np.array([0.0, *(inward[y] + outward[y] - move[:, O].min() - move[O, :].min() for y in (B, I))])
        self.plain_is_outside = self._proved()

    def _proved(self) -> bool:
        """Whether a plain token is outside on every best path, whatever stands beside it and in whatever file."""
        w = self.emit
        lead = w[:, [O]] - w  # of outside over each tag
        rest = [_SLOT[n] for n in NEAR + ("file_word", "file_short")]
        least = lead[_SLOT["plain"]] + lead[_SLOT["bias"]] + np.minimum(lead[rest], 0).sum(0)
        return bool((least[1:] > self.swing[1:]).all())

    def scores(self, features: list[list[int]]) -> np.ndarray:
        return np.array([self.emit[f].sum(0) for f in features])

    def viterbi(self, scores: np.ndarray, edges: bool = False) -> list[int]:
        """The best tags; edges: an outside token stands on both sides."""
        best, back = scores[0] + (self.move[O] if edges else 0), []
        for s in scores[1:]:
            to = best[:, None] + self.move
            back.append(to.argmax(0))
            best = to.max(0) + s
        tags = [int((best + (self.move[:, O] if edges else 0)).argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]

    def spans(self, text: str) -> list[tuple[int, int]]:
        if not self.emit.any():
            return []
        whole = file_features(text)
        if self.plain_is_outside:
            tokens = [m.span() for m in OPEN.finditer(text)]
            gap = [bool(text[a:b].strip()) for (_, a), (b, _) in zip(tokens, tokens[1:], strict=False)]
            cuts = [0, *(i + 1 for i, g in enumerate(gap) if g), len(tokens)]
        else:
            tokens = [m.span() for m in TOKEN.finditer(text)]
            cuts = [0, len(tokens)]
        found: list[list[int]] = []
        starts, ends = len(text) - len(text.lstrip()), len(text.rstrip())
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if lo == hi:
                continue
            part = tokens[lo:hi]
            # In a stretch of open tokens the ends of the text are as good as an outside token: both are settled below.
            scores = self.scores([shape(text[s:e]) + near(text, s, e) + whole for s, e in part])
            left = self.plain_is_outside and part[0][0] > starts
            right = self.plain_is_outside and part[-1][1] < ends
            scores[0] += self.move[O] * left
            scores[-1] += self.move[:, O] * right
            last = O
            for (s, e), tag in zip(part, self.viterbi(scores), strict=True):
                if tag == B or tag == I and last == O:
                    found.append([s, e])
                elif tag == I:
                    found[-1][1] = e
                last = tag
        return [(s, e) for s, e in found]


def train(rows: list[tuple[list[list[int]], list[int]]], steps: int = 150, rate: float = 0.2, ridge: float = 1e-3) -> Field:
    """Gradient ascent (Adam) on the mean log-likelihood of the windows; forward and backward sums over all at once."""
    k, n = 3, len(rows)
    emit, move = np.zeros((len(NAMES), k)), np.zeros((k, k))
    if not any(t != O for _, tags in rows for t in tags):
        return Field(emit, move)
    most = max(len(t) for _, t in rows)
    x, y, on = np.zeros((n, most, len(NAMES))), np.zeros((n, most), int), np.zeros((n, most), bool)
    for i, (features, tags) in enumerate(rows):
        for t, f in enumerate(features):
            x[i, t, f] = 1
        y[i, : len(tags)], on[i, : len(tags)] = tags, True
    one = np.eye(k)[y] * on[:, :, None]
    pair = on[:, 1:] & on[:, :-1]
    flat = x.reshape(-1, len(NAMES))
    seen_emit = flat.T @ one.reshape(-1, k)
    seen_move = np.einsum("itj,itk,it->jk", one[:, :-1], one[:, 1:], pair.astype(float))

    def lse(a, axis):
        m = a.max(axis, keepdims=True)
        return (m + np.log(np.exp(a - m).sum(axis, keepdims=True))).squeeze(axis)

    state = [np.zeros_like(emit), np.zeros_like(move), np.zeros_like(emit), np.zeros_like(move)]
    for step in range(1, steps + 1):
        s = x @ emit
        a, b = np.zeros((n, most, k)), np.zeros((n, most, k))
        a[:, 0] = s[:, 0]
        for t in range(1, most):
            a[:, t] = np.where(on[:, t, None], lse(a[:, t - 1, :, None] + move, 1) + s[:, t], a[:, t - 1])
        z = lse(a[:, -1], 1)
        for t in range(most - 2, -1, -1):
            b[:, t] = np.where(on[:, t + 1, None], lse(move + (s[:, t + 1] + b[:, t + 1])[:, None, :], 2), b[:, t + 1])
        p = np.exp(a + b - z[:, None, None]) * on[:, :, None]
        q = np.exp(a[:, :-1, :, None] + move + (s + b)[:, 1:, None, :] - z[:, None, None, None]) * pair[:, :, None, None]
        grads = [(seen_emit - flat.T @ p.reshape(-1, k)) / n - ridge * emit, (seen_move - q.sum((0, 1))) / n - ridge * move]
        for j, (w, g) in enumerate(zip((emit, move), grads, strict=True)):
            state[j] = 0.9 * state[j] + 0.1 * g
            state[j + 2] = 0.99 * state[j + 2] + 0.01 * g * g
            w += rate * (state[j] / (1 - 0.9**step)) / (np.sqrt(state[j + 2] / (1 - 0.99**step)) + 1e-8)
    return Field(emit, move)


def fit(docs: DataFrame, max_windows: int = MAX_WINDOWS, sample_docs: int = SAMPLE_DOCS) -> Field:
    """docs: doc_id, text. Features and tags of at most max_windows windows come to the driver, no text."""
    total = docs.count()
    seed = F.xxhash64("doc_id", "text")
    picked = docs.select(seed.alias("seed"), "text")
    if total > sample_docs:
        picked = picked.where(F.shiftrightunsigned("seed", 1) < int((1 << 63) * (sample_docs / total)))

    def sample(batches):
        for batch in batches:
            out = []
            for seed, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                spans = base_spans(text)
                for place, features, tags in window_rows(text, spans):
                    out.append((bool(spans), xxhash.xxh64_intdigest(f"{place}", seed % (1 << 64)) >> 1, features, tags))
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.list_(pa.int32()))), pa.array(cols[3], pa.list_(pa.int32()))], names=["found", "at", "features", "tags"])

    rows = materialize(picked.mapInArrow(sample, "found boolean, at bigint, features array<array<int>>, tags array<int>"), "secret-windows")
    # Each task keeps its first ones, then these meet.
    chosen = [rows.where(F.col("found") == side).orderBy("at", "tags", "features").limit(max_windows // 2).collect() for side in (False, True)]
    discard(rows)
    return train(sorted((list(map(list, r["features"])), list(r["tags"])) for part in chosen for r in part))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_windows: int = MAX_WINDOWS, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """One row for each row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, comma-joined)."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    field = fit(own, max_windows, sample_docs)

    def scan(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                base = base_spans(text)
                more = [(s, 3, e) for s, e in field.spans(text) if not any(a < e and s < z for a, _, z in base)]
                say = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
                for column, v in zip(out, (doc, *(sum(k == j for _, k, _ in base) for j in range(3)), hashlib.sha256(say(base).encode()).hexdigest(), say(sorted(base + more))), strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out[:4]] + [pa.array(c, pa.string()) for c in out[4:]], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return own.mapInArrow(scan, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def query(spark, sf_dir):
    return secret_scan(documents(spark, sf_dir))
