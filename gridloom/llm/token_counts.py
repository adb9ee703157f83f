"""Token counts of fields and sections from one encoding of the whole document.

The fields of a document are put together and encoded once. The lengths of the tokens in bytes give their spans in
characters; a token that holds a part of a character spans that character. Sections are the fields, cut after each
newline. Tokens are joined to sections by a binary search of their spans. A token across a boundary is counted by a
rule: "first" gives it to the section of its first character, "last" to that of its last one, "most" to the one with
most of its characters (the earliest of several). So the counts of a document add up to its tokens.

A null field is empty. An empty field is one empty section without tokens. A null id stays null; repeated rows are
counted one by one. Empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokenizer
from .common import documents

RULES = ("first", "last", "most")
_ROWS = 50_000


def token_spans(data: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last character of each token; lengths: of the tokens, in bytes of data."""
    char = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80) - 1
    ends = np.cumsum(lengths)
    return char[ends - lengths], char[ends - 1]


def attribute(first: np.ndarray, last: np.ndarray, starts: np.ndarray, rule: str) -> np.ndarray:
    """The number of tokens of each section; starts: first character of each section, not decreasing (of equal ones the last has the characters)."""
    a, b = np.searchsorted(starts, first, "right") - 1, np.searchsorted(starts, last, "right") - 1
    own = b if rule == "last" else a
    if rule == "most":
        own = own.copy()
        for t in np.flatnonzero(a != b):
            edges = np.clip(np.append(starts[a[t] : b[t] + 1], last[t] + 1), first[t], None)
            own[t] = a[t] + int(np.argmax(np.diff(edges)))
    return np.bincount(own, minlength=len(starts))


def sections(texts: Sequence[str]) -> tuple[list[int], list[int]]:
    """The field and the first character of each section."""
    fields, starts, at = [], [], 0
    for field, text in enumerate(texts):
        fields.append(field)
        starts.append(at)
        i = text.find("\n") + 1
        while 0 < i < len(text):
            fields.append(field)
            starts.append(at + i)
            i = text.find("\n", i) + 1
        at += len(text)
    return fields, starts


def token_counts(docs: DataFrame, fields: Sequence[str] = ("text",), tokenizer_path: str | None = None, id_col: str = "doc_id", rule: str = "first") -> DataFrame:
    """One row for each section: doc_id, field, section (from 0 in the document), start, end (characters of all fields), n_tokens."""
    assert rule in RULES
    path, names = tokenizer_path or tokenizer.default_path(), list(fields)
    kinds = [("doc_id", pa.int64()), ("field", pa.string()), ("section", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("n_tokens", pa.int64())]
    schema = pa.schema(kinds)

    def count(batches):
        bpe = tokenizer.load(path)
        out: list[list] = [[] for _ in kinds]
        for batch in batches:
            for i, doc in enumerate(batch.column(0).to_pylist()):
                texts = [batch.column(k + 1)[i].as_py() or "" for k in range(len(names))]
                text = "".join(texts)
                at, starts = sections(texts)
                n = np.zeros(len(starts), np.int64)
                if text:
                    lengths = bpe.n_bytes[np.asarray(bpe.encode(text))]
                    n = attribute(*token_spans(text.encode(), lengths), np.asarray(starts), rule)
                for column, values in zip(out, ([doc] * len(at), [names[k] for k in at], range(len(at)), starts, [*starts[1:], len(text)], n.tolist()), strict=True):
                    column.extend(values)
                if len(out[0]) >= _ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(out, kinds, strict=True)], schema=schema)
                    out = [[] for _ in kinds]
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(out, kinds, strict=True)], schema=schema)

    columns = [F.col(id_col).cast("long").alias("doc_id"), *[F.col(n).cast("string").alias(f"f{k}") for k, n in enumerate(names)]]
    return docs.select(*columns).mapInArrow(count, "doc_id bigint, field string, section bigint, start bigint, `end` bigint, n_tokens bigint")


def query(spark, sf_dir):
    return token_counts(documents(spark, sf_dir))
