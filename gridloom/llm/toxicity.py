"""Toxicity scores of texts after a noisy-channel decoding of disguised words.

1. A character language model: trigrams of letters and gaps, counted over all documents.
2. A channel: a letter may be written as a look-alike, stretched, masked by a star, or set apart from the next one by
   signs or spaces. Passages that look so are turned into lattices, which Viterbi decodes under the model.
3. A logistic regression over words and their beginnings, of the text as written and as restored. These are those that tell most
   about the label in the labelled rows that may be learnt from; it is fitted on at most MAX_TRAIN of them, the ones
   with the smallest hash, half of each label if there are enough. MAX_TRAIN bounds what reaches the driver.

Rows whose crc32(doc_id as text) modulo 3 is 1 are held out. Null and empty texts have no words and get the score of
the intercept. Without labelled rows the score is 0 for all. A null id isn't held out and can't be learnt from; repeated rows are
scored one by one, and of several texts with one id the one with the smallest hash is learnt from. A null label isn't used. Empty input gives an empty result.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, documents, materialize
from .words import words_of

MAX_TRAIN = 20_000
THRESHOLD = 0.7
#: Standard errors by which a word's log odds differ from 0.
MIN_TELLS = 3.0
#: What a task holds at a time: symbols that are counted, texts, and words that are counted before they go out.
_BLOCK = 1 << 18
_SLICE = 128
_WORDS = 1 << 15

# Symbols of the language model: gap, a-z, any other letter.
SIZE = 28
_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[128:] = 27

#: What a written character may stand for besides itself.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
LETTERS = "abcdefghijklmnopqrstuvwxyz"
_SIGN = re.escape("".join(LOOKALIKES))
_SET_APART = r"[ .\-_*~]"
_APART = rf"(?:[a-z{_SIGN}]{_SET_APART}++){{3,}}[a-z{_SIGN}]"
APART = re.compile(_APART)
#: Letters set apart, or a run of letters, look-alikes and stars. Runs are taken whole, however long, and never tried twice.
_RUN = re.compile(rf"(?P<apart>(?<![a-z{_SIGN}]){_APART}(?![a-z{_SIGN}]))|[a-z{_SIGN}][a-z{_SIGN}*]*+|\*++")
_ALIKE, _MASKED, _TRIPLE, _LETTER = re.compile(rf"[{_SIGN}]"), re.compile(r"[a-z]\*++[a-z]"), re.compile(r"([a-z])\1\1"), re.compile("[a-z]")
COST = {"same": 0.0, "alike": 0.5, "star": 4.0, "drop": 0.2, "repeat": 0.3}


def is_disguised(run: str) -> bool:
    """A run with look-alikes or stars among its letters, or with a letter three times or more."""
    if len(run) < 3 or not _LETTER.search(run):
        return False
    return bool(_ALIKE.search(run) or _MASKED.search(run) or _TRIPLE.search(run))


def passages(text: str):
    """(start, end) of the disguised passages of a text in lower case."""
    for m in _RUN.finditer(text):
        if m["apart"] or is_disguised(m[0]):
            yield m.span()


def trigram_counts(texts: list[str]) -> np.ndarray:
    data = "\n\n".join(t for t in texts if t).encode()
    every = _SYMBOL[np.frombuffer(b"\n\n" + data + b"\n", np.uint8)]
    total = np.zeros(SIZE**3, np.int64)
    for at in range(0, len(every) - 2, _BLOCK):  # codes take 8 bytes a symbol
        s = every[at : at + _BLOCK + 2].astype(np.int64)
        total += np.bincount((s[:-2] * SIZE + s[1:-1]) * SIZE + s[2:], minlength=SIZE**3)
    return total


class Decoder:
    """Viterbi over lattices of a passage; log_p[a, b, c]: of symbol c after a and b."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(SIZE, SIZE, SIZE).astype(float)
        two, one = c.sum(0), c.sum((0, 1))
        p1 = (one + 1) / (one.sum() + SIZE)
        p2 = (two + 10 * p1) / (two.sum(1, keepdims=True) + 10)
        self.log_p = np.log((c + 5 * p2) / (c.sum(2, keepdims=True) + 5)).tolist()
        # Not a method of self: that would be a cycle, and a worker would keep decoders of ended tasks until it is searched for.
        self._cached = functools.lru_cache(maxsize=50_000)(functools.partial(Decoder._decode, self.log_p))

    def decode(self, passage: str) -> str:
        return self._cached(passage) if len(passage) <= 64 else self._decode(self.log_p, passage)

    @staticmethod
    def lattice(passage: str) -> list[list[tuple[str, float]]]:
        """For each run of a character: (what it may stand for, cost). Nothing stands for a run left out."""
        apart = bool(APART.fullmatch(passage))
        steps = []
        for m in re.finditer(r"(.)\1*", passage, re.DOTALL):
            c, n = m[1], len(m[0])
            if c in LETTERS:
                ways = [(c, COST["same"])] + [(c * 2, COST["same"] if n == 2 else COST["repeat"])] * (n > 1)
            elif c == "*" and not apart and m.start() and m.end() < len(passage):
                ways = [(x, COST["star"]) for x in LETTERS] + [("", COST["drop"])]
            elif c in LOOKALIKES:
                ways = [(x, COST["alike"]) for x in LOOKALIKES[c]] + [(x * 2, COST["alike"]) for x in LOOKALIKES[c]] * (n > 1)
                ways += [("", COST["drop"] + 1.0)] * (m.end() == len(passage))
            else:
                ways = [("", COST["drop"])]
            steps.append(ways)
        return steps

    @staticmethod
    def _decode(log_p: list, passage: str) -> str:
        states, back = {(0, 0): 0.0}, []
        for ways in Decoder.lattice(passage):
            to: dict = {}
            came: dict = {}
            for (a, b), cost in states.items():
                for letters, more in ways:
                    x, y, total = a, b, cost + more
                    for c in letters:
                        s = ord(c) - 96
                        total -= log_p[x][y][s]
                        x, y = y, s
                    if (x, y) not in to or total < to[x, y]:
                        to[x, y], came[x, y] = total, ((a, b), letters)
            states = to
            back.append(came)
        _, at = min((cost - log_p[a][b][0], (a, b)) for (a, b), cost in states.items())
        found = []
        for came in reversed(back):
            at, letters = came[at]
            found.append(letters)
        return "".join(reversed(found))

    def restore(self, text: str) -> str:
        text, out, done = text.lower(), [], 0
        for a, b in passages(text):
            out += [text[done:a], self.decode(text[a:b])]
            done = b
        return "".join([*out, text[done:]])


def both_words(text: str | None, decoder: Decoder) -> set[bytes]:
    """The words of a text, as written and as restored."""
    if not text:
        return set()
    found = set(words_of(text))
    low = text.lower()
    for a, b in passages(low):
        found.update(words_of(decoder.decode(low[a:b])))
    return found


def with_beginnings(words: set[bytes]) -> set[bytes]:
    """Words and their beginnings of 4, 5 and 6 bytes (marked by a dot)."""
    return words | {b"." + w[:n] for n in (4, 5, 6) for w in words if len(w) > n}


def features(text: str | None, decoder: Decoder) -> set[bytes]:
    return with_beginnings(both_words(text, decoder))


def language_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Trigram counts over all docs; a row for each task and trigram is summed by Spark, at most SIZE**3 come back."""

    def count(batches):
        total = np.zeros(SIZE**3, np.int64)
        for batch in batches:
            for i in range(0, len(batch), _SLICE):
                total += trigram_counts(batch.column(0).slice(i, _SLICE).to_pylist())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])

    counts = np.zeros(SIZE**3, np.int64)
    for r in docs.select(text_col).mapInArrow(count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        counts[r["gram"]] = r["n"]
    return counts


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def word_counts(rows):
    """Batches of word, pos, neg: in how many of rows (label, words as an Arrow scalar) it is, by label. A word may come in several batches."""
    counts: dict[bytes, list[int]] = {}

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), *(pa.array([n[side] for n in counts.values()], pa.int64()) for side in (1, 0))], names=["word", "pos", "neg"])

    for label, words in rows:
        for w in with_beginnings(set(words.as_py().split())):
            counts.setdefault(w, [0, 0])[label] += 1
        if len(counts) >= _WORDS:
            yield batch()
            counts = {}
    if counts:
        yield batch()


def train(docs: DataFrame, labels: DataFrame, decoder_of, max_train: int = MAX_TRAIN) -> tuple[dict[bytes, float], float] | None:
    """Weights of words, and the intercept. docs: doc_id, text; labels: doc_id, label. decoder_of() gives the decoder on an executor."""
    usable = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").where(~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("label").alias("label"))
    sides = []
    for side in (0, 1):
        part = usable.where(F.col("label") == side).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train // 2)
        sides.append([r["doc_id"] for r in part.select("doc_id").collect()])
    if not all(sides):
        return None
    spark = docs.sparkSession
    picked = spark.createDataFrame([(d, s) for s, ids in enumerate(sides) for d in ids], "doc_id long, label int")

    # Only words are kept, joined by spaces (which no word has): features are several times the text, so they are made one text at a time.
    def words(batches):
        decoder = decoder_of()
        for batch in batches:
            for at in range(0, len(batch), _SLICE):
                part = batch.slice(at, _SLICE)
                found = [b" ".join(sorted(both_words(t.as_py(), decoder))) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(2).cast(pa.int32()), pa.array(found, pa.binary())], names=["doc_id", "label", "words"])

    def seen_in(batches):
        return (x for batch in batches for x in word_counts(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)))

    # Of rows with one id, the text with the smallest hash counts.
    text = F.coalesce("text", F.lit(""))
    rows = docs.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64(text).alias("hash"), text.alias("text"))).alias("t"))
    rows = materialize(rows.select("doc_id", "t.text", "label").mapInArrow(words, "doc_id bigint, label int, words binary"), "toxicity-rows")
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    p1, p0 = max(n.get(1, 0), 1), max(n.get(0, 0), 1)
    seen = rows.select("label", "words").mapInArrow(seen_in, "word binary, pos bigint, neg bigint").groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    a, b = (F.col("pos") + 0.5) / p1, (F.col("neg") + 0.5) / p0
    tells = F.abs(F.log(a / b)) / F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    # All words of the sample that tell something about the label; their number is bounded by the sample.
    slot = {bytes(w): i for i, w in enumerate(sorted(r["word"] for r in seen.where(tells >= MIN_TELLS).select("word").collect()))}

    def encode(batches):
        for batch in batches:
            found = [np.array(sorted(slot[w] for w in with_beginnings(set(words.as_py().split())) if w in slot), np.int32).tobytes() for words in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["doc_id", "label", "slots"])

    # Slots of words come back, packed; the words themselves stay where they are.
    data = rows.mapInArrow(encode, "doc_id bigint, label int, slots binary").toArrow().sort_by("doc_id")
    discard(rows)
    slots = [np.frombuffer(x.as_py(), np.int32) for x in data.column("slots")]
    if not slots:  # no text has a label
        return None
    weights = logistic(slots, data.column("label").to_numpy().astype(float), len(slot))
    return {w: float(weights[i]) for w, i in slot.items()}, float(weights[-1])


def logistic(rows: list[np.ndarray], y: np.ndarray, n: int, ridge: float = 0.1, steps: int = 500) -> np.ndarray:
    """Ridge logistic regression by accelerated gradient steps; both labels weigh the same.

    rows: the numbers of the features (of n) that each row has. The intercept comes last and isn't shrunk.
    """
    at = np.concatenate([np.append(r, n) for r in rows])
    size = np.array([len(r) + 1 for r in rows])
    first = np.cumsum(size) - size
    of = np.repeat(np.arange(len(rows)), size)
    forth = lambda w: np.add.reduceat(w[at], first)
    back = lambda v: np.bincount(at, v[of], n + 1)
    share = min(max(float(y.mean()), 1e-9), 1 - 1e-9)
    weigh = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    w = z = np.zeros(n + 1)
    shrink = np.full(n + 1, ridge)
    shrink[-1] = 0
    v = np.ones(len(rows))
    for _ in range(20):  # the largest eigenvalue bounds the step
        v = forth(back(v))
        v /= np.linalg.norm(v) or 1
    step = 1 / (0.25 * float(weigh.max()) * float(v @ forth(back(v))) + ridge)
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-forth(z)))
        new = z - step * (back(weigh * (p - y)) + shrink * z)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w


def scorer(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN):
    """A function from a column of texts to scores, learnt from docs and labels."""
    spark = docs.sparkSession
    counts = spark.sparkContext.broadcast(language_model(docs, text_col))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    made: list[Decoder] = []

    def decoder_of() -> Decoder:
        if not made:
            made.append(Decoder(counts.value))
        return made[0]

    model = train(own, marks, decoder_of, max_train)
    held = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        if held.value is None:
            return pa.array(np.zeros(len(texts)))
        weights, intercept = held.value
        decoder = decoder_of()
        known = weights.keys()
        return pa.array([1 / (1 + np.exp(-(intercept + sum(sorted(weights[w] for w in known & features(t.as_py(), decoder)))))) for t in texts], pa.float64())

    return score


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **options) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted."""
    score = scorer(docs, labels, id_col, text_col, **options)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), score(F.col(text_col)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def query(spark, sf_dir):
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
