"""Token counts (operator 2): offset-mapped attribution of tokens to sections.

A document is encoded once, whole.  The byte length of each token gives its span, and sorted spans are joined with
sorted section spans by binary search (an interval join inside the row, so nothing is shuffled).  A token that
crosses a boundary is allocated by an explicit rule:
  first     to the section of its first byte,
  last      to the section of its last byte,
  majority  to the section with most of its bytes, the earlier one in a tie.
Sections may come in any order; counts are returned in the order given.  Bytes between sections are a gap, and a token
that the rule gives to a gap is counted as outside.

Without given sections a document's sections are its lines, each with the \\n that ends it; fields() takes named columns
as the sections of one document.  Spans are code points.

Defined results: a null or empty text has no tokens; lines are then one empty section (null: none); bounds beyond the text
are cut to it; a section that is null, has a null bound or ends before it begins is empty; where sections overlap, the one
that begins first (of equals: is given first) has the bytes, and the later one begins behind it; repeated rows are
counted each.  Other columns are not looked at.  The tokenizer's vocabulary file is a parameter; executors need it at
the same path, as they need the library.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import as_bytes, map_arrow, source

VOCABULARY = "byte_bpe_50k.tiktoken"
_encoders: dict[str, tuple] = {}


def encoder(name: str):
    """The encoding and the byte length of each token; loaded once for each Python worker."""
    if name not in _encoders:
        import public_tokenizers
        import tiktoken

        path = name if "/" in name else public_tokenizers.path(name)
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, k in ranks.items():
            sizes[k] = len(token)
        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        _encoders[name] = (own, sizes)
    return _encoders[name]


def allocate(ends: np.ndarray, begins: np.ndarray, borders: np.ndarray, rule: str) -> np.ndarray:
    """For each token [begins, ends) the interval it goes to: k if borders[k-1] <= byte < borders[k]."""
    first = np.searchsorted(borders, begins, "right")
    if rule == "first":
        return first
    last = np.searchsorted(borders, ends - 1, "right")
    if rule == "last":
        return last
    if rule != "majority":
        raise ValueError(f"unknown rule {rule}")
    out = first.copy()
    for t in np.flatnonzero(first != last):
        cuts = np.concatenate(([begins[t]], borders[first[t] : last[t]], [ends[t]]))
        out[t] = first[t] + int(np.argmax(np.diff(cuts)))
    return out


def section_tokens(raw: bytes, spans: list[tuple[int, int]] | None, rule: str, name: str) -> tuple[int, int, int, np.ndarray]:
    """Tokens in all, tokens that cross a border, tokens outside, tokens of each section; spans in bytes, None for lines."""
    encoding, sizes = encoder(name)
    tokens = encoding.encode_to_numpy(raw.decode()) if raw else np.zeros(0, np.uint32)
    ends = np.cumsum(sizes[tokens])
    begins = ends - sizes[tokens]
    if spans is None:
        stops = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
        borders = np.concatenate(([0], stops, [len(raw)])) if not len(stops) or stops[-1] < len(raw) else np.concatenate(([0], stops))
        owner = np.arange(len(borders) + 1) - 1  # the interval before the first border is outside
        n = len(borders) - 1
    else:
        borders = np.array([x for s in spans for x in s], np.int64)
        owner = np.array([(k - 1) // 2 if k % 2 else -1 for k in range(len(borders) + 1)])
        n = len(spans)
    if len(raw) == 0 and spans is None:
        return 0, 0, 0, np.zeros(1, np.int64)
    where = owner[np.minimum(allocate(ends, begins, borders, rule), len(owner) - 1)]
    where = np.where(where >= n, -1, where)
    crossing = int((np.searchsorted(borders, begins, "right") != np.searchsorted(borders, ends - 1, "right")).sum())
    return len(tokens), crossing, int((where < 0).sum()), np.bincount(where[where >= 0], minlength=n)


def ordered_spans(raw: bytes, spans: list[dict | None]) -> tuple[list[int], list[tuple[int, int]]]:
    """Sections in the order of their places: their numbers, and their spans in bytes, which do not overlap."""
    starts = np.append(np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80), len(raw))
    points = []
    for s in spans:
        begin, end = (None, None) if s is None else (s["begin"], s["end"])
        empty = begin is None or end is None or end < begin
        points.append((0, 0) if empty else tuple(int(starts[min(max(x, 0), len(starts) - 1)]) for x in (begin, end)))
    order = sorted(range(len(points)), key=lambda k: (points[k][0], k))
    out, behind = [], 0
    for k in order:
        begin = max(points[k][0], behind)
        behind = max(begin, points[k][1])
        out.append((begin, behind))
    return order, out


SCHEMA = "doc_id long, n_tokens long, n_crossing long, n_outside long, section_tokens array<long>"


def attribute(docs: DataFrame, rule: str = "first", vocabulary: str = VOCABULARY, sections: str | None = None) -> DataFrame:
    """sections: a column array<struct<begin:int,end:int>> of code points; None for lines."""
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text")] + ([F.col(sections)] if sections else [])

    def step(batch: pa.RecordBatch) -> list:
        out: list[list] = [[], [], [], []]
        given = batch.column(2).to_pylist() if sections else [None] * batch.num_rows
        for raw, spans in zip(as_bytes(batch.column(1)), given, strict=True):
            if raw is None:
                found: tuple = (0, 0, 0, np.zeros(len(spans or []), np.int64))
            else:
                order: list[int] = []
                if sections:
                    order, spans = ordered_spans(raw, spans or [])
                found = section_tokens(raw, spans, rule, vocabulary)
                if sections:
                    counts = np.zeros(len(order), np.int64)
                    counts[order] = found[3]
                    found = (*found[:3], counts)
            for column, value in zip(out, found, strict=True):
                column.append(value)
        return [batch.column(0), *out]

    return map_arrow(docs.select(*columns), step, SCHEMA)


def fields(docs: DataFrame, columns: tuple[str, ...], rule: str = "first", vocabulary: str = VOCABULARY, separator: str = "\n") -> DataFrame:
    """Named columns of strings, joined by the separator and encoded as one document: section_tokens has a count for each.

    A null column is an empty field, and its separator stays; separators are outside of all fields.
    """
    parts = [F.coalesce(F.col(c), F.lit("")) for c in columns]
    text = F.concat(*(x for k, part in enumerate(parts) for x in ([F.lit(separator)] if k else []) + [part]))
    spans, at = [], F.lit(0)
    for part in parts:
        spans.append(F.struct(at.cast("int").alias("begin"), (at + F.length(part)).cast("int").alias("end")))
        at = at + F.length(part) + len(separator)
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.array(*spans).alias("sections"))
    return attribute(whole, rule, vocabulary, "sections")


def query(spark, sf_dir: str) -> DataFrame:
    return attribute(source(spark, sf_dir, "documents"))
