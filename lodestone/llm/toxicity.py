"""Toxicity (operator 8): cumulative-link ordinal regression over sparse text features.

P(grade >= k | text) = sigmoid(w . x - theta_k) with one weight vector for all ordered thresholds
theta_1 < theta_2 < ...; the expected severity is the sum of these probabilities.

Features: a word ([^\\x20\\x09-\\x0D]+, A-Z lower-cased, punctuation of ASCII stripped at its ends) counts for itself and for
its first three, four and five characters, hashed to 2^22 places.  Each place has two features: that it is there, and
log2(1 + its share of the words in percent).

Grades: those of a column severity of the labels, if they have one.  Else labels only tell toxic from not: then a
first fit with one threshold scores the toxic rows, those up to their median get grade 1 and the others grade 2, and
the ordinal fit is to grades 0, 1 and 2, over the features to which the first gave weight.  A grade without rows is held by a prior on the gap between thresholds.

Fit: on at most max_fit_rows labelled rows (a documented bound; the rows with the smallest hash of their doc_id), by
proximal AdaGrad with L1, on the driver.  Score: all documents, whole texts; only weights that are not zero are
broadcast, at most 2^23 of them.

Defined results: null and empty texts have no features and get the score of the bare thresholds; labels with a null
doc_id, or null toxic, are not used; of several labels of a document each is a row of
the fit; without labelled rows of both kinds every document gets severity 0.  Extra columns stay as they are.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import as_bytes, bounded_batches, map_arrow, source

PLACES = 1 << 22
MAX_FIT_ROWS = 4000
GRADES = 3
STEPS = 300
#: A share of words is taken of so many words at least.
LEAST_WORDS = 30
RATE, L1 = 0.3, 2e-3
PREFIXES = (3, 4, 5)
_PUNCTUATION = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum())
#: Words that a Python worker remembers; some 400 bytes each.
_CACHE = 100_000


def word_places(word: bytes) -> list[int]:
    bare = word.strip(_PUNCTUATION)
    if not bare:
        return []
    return [xxhash.xxh64_intdigest(bare) % PLACES, *prefix_places(bare.decode())]


def prefix_places(text: str) -> list[int]:
    return [xxhash.xxh64_intdigest(text[:k].encode(), k) % PLACES for k in PREFIXES if len(text) >= k]


class _Places(dict):
    def __missing__(self, word: bytes) -> list[int]:
        if len(self) > _CACHE:
            self.clear()
        self[word] = found = word_places(word)
        return found


Features = tuple[np.ndarray, np.ndarray]


def valued(counts: dict[int, int], n_words: int) -> Features:
    """Places (those of shares are behind the others) and values."""
    at = np.array(sorted(counts), np.int32)
    share = 100 * np.array([counts[p] for p in at.tolist()]) / max(n_words, LEAST_WORDS)
    return np.concatenate((at, at + PLACES)).astype(np.int32), np.concatenate((np.ones(len(at)), np.log2(1 + share))).astype(np.float32)


def features(raw: bytes | None, cache: _Places) -> Features:
    words = Counter((raw or b"").lower().split())
    counts: Counter = Counter()
    for word, n in words.items():
        for p in cache[word]:
            counts[p] += n
    return valued(counts, words.total())


@dataclass
class Ordinal:
    """weights: place to weight, for those that are not zero."""

    weights: dict[int, float]
    thresholds: list[float]

    def severities(self, score: np.ndarray) -> np.ndarray:
        """(n, grades - 1): P(grade >= 1), P(grade >= 2), ..."""
        return 1 / (1 + np.exp(-np.clip(np.asarray(score)[:, None] - np.array(self.thresholds), -60, 60)))


def fit(rows: list[Features], grades: np.ndarray, n_grades: int = GRADES, steps: int = STEPS, rate: float = RATE, l1: float = L1) -> Ordinal:
    """rows: places and values of each row's features; grades 0 .. n_grades - 1."""
    grades = np.asarray(grades)
    if not len(grades) or grades.min() == grades.max():
        return Ordinal({}, [50.0 + k for k in range(n_grades - 1)])
    places = np.concatenate([r[0] for r in rows])
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[0]) for r in rows])
    used = np.flatnonzero(np.bincount(places, minlength=2 * PLACES) >= 3)
    number = np.full(2 * PLACES, -1, np.int32)
    number[used] = np.arange(len(used))
    flat = number[places]
    keep = flat >= 0
    flat, owner, values = flat[keep], owner[keep], np.concatenate([r[1] for r in rows])[keep]
    del places, number, keep
    w, g2 = np.zeros(len(used)), np.full(len(used), 1e-8)
    # theta_1 and the logs of the gaps; both with AdaGrad
    share = np.array([(grades >= k).mean() for k in range(1, n_grades)])
    theta = np.concatenate(([-np.log(max(share[0], 1e-3) / (1 - min(share[0], 1 - 1e-3)))], np.zeros(n_grades - 2)))
    t2 = np.full(len(theta), 1e-8)
    balance = np.where(grades > 0, 0.5 / max(1, (grades > 0).sum()), 0.5 / max(1, (grades == 0).sum()))
    for _ in range(steps):
        score = np.bincount(owner, w.astype(np.float32)[flat] * values, minlength=len(rows))
        cuts = theta[0] + np.concatenate(([0.0], np.cumsum(np.exp(theta[1:]))))
        # -log P(grade): P(grade = k) = S(score - cut_k) - S(score - cut_k+1)
        s = 1 / (1 + np.exp(-np.clip(score[:, None] - cuts, -40, 40)))
        upper = np.concatenate((np.ones((len(rows), 1)), s), 1)[np.arange(len(rows)), grades]
        lower = np.concatenate((s, np.zeros((len(rows), 1))), 1)[np.arange(len(rows)), grades]
        p = np.maximum(upper - lower, 1e-12)
        d_upper, d_lower = upper * (1 - upper) / p, lower * (1 - lower) / p
        d_score = -(d_upper - d_lower) * balance
        grad = np.bincount(flat, d_score.astype(np.float32)[owner] * values, minlength=len(w))
        d_cuts = np.zeros(n_grades - 1)
        for k in range(n_grades - 1):
            d_cuts[k] = ((d_upper * (grades == k + 1) - d_lower * (grades == k)) * balance).sum()
        d_theta = np.array([d_cuts.sum()] + [np.exp(theta[k]) * d_cuts[k:].sum() for k in range(1, n_grades - 1)])
        d_theta[1:] += 1e-3 * theta[1:]  # holds the gap below a grade without rows
        g2 += grad**2
        t2 += d_theta**2
        scale = rate / np.sqrt(g2)
        w = w - scale * grad
        w = np.sign(w) * np.maximum(np.abs(w) - scale * l1, 0)
        theta = theta - rate / np.sqrt(t2) * d_theta
    cuts = theta[0] + np.concatenate(([0.0], np.cumsum(np.exp(theta[1:]))))
    on = np.flatnonzero(w)
    return Ordinal(dict(zip(used[on].tolist(), w[on].tolist(), strict=True)), cuts.tolist())


def fit_toxic(rows: list[Features], toxic: np.ndarray) -> Ordinal:
    """toxic: 0 or 1.  Grades of the toxic rows by a first fit; see above."""
    first = fit(rows, toxic, 2, STEPS // 2)
    scored = np.array([score(r, first) for r in rows])
    if not toxic.any():
        return first
    middle = np.median(scored[toxic == 1])
    kept = np.zeros(2 * PLACES, bool)
    kept[list(first.weights)] = True
    rows = [(p[on], v[on]) for p, v in rows for on in [kept[p]]]
    return fit(rows, toxic + ((toxic == 1) & (scored > middle)), GRADES)


def train(docs: DataFrame, labels: DataFrame, max_fit_rows: int = MAX_FIT_ROWS) -> Ordinal:
    graded = "severity" in labels.columns
    grade = F.col("severity") if graded else (F.col("toxic") != 0)
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & grade.isNotNull())
        .select(F.col("doc_id").cast("long").alias("doc_id"), grade.cast("int").alias("grade"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "grade")
        .limit(max_fit_rows)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")

    def step(batch: pa.RecordBatch) -> list:
        cache = _Places()
        rows = [features(raw, cache) for raw in as_bytes(batch.column(1))]
        return [batch.column(0), batch.column(2), [r[0] for r in rows], [r[1] for r in rows]]

    got = map_arrow(texts, step, "doc_id long, grade int, places array<int>, vals array<float>").toArrow()
    order = np.lexsort((got["grade"].to_numpy(), got["doc_id"].to_numpy()))
    places, values = (got[c].combine_chunks() for c in ("places", "vals"))
    rows = [(places[int(k)].values.to_numpy(), values[int(k)].values.to_numpy()) for k in order]
    grades = got["grade"].to_numpy()[order]
    return fit(rows, grades, max(GRADES, int(grades.max(initial=0)) + 1)) if graded else fit_toxic(rows, grades)


class _Prefixes(dict):
    """Of the first characters of a word, as many as the longest prefix has, the weighted places of its prefixes."""

    def __init__(self, places: set[int]):
        super().__init__()
        self.places = places

    def __missing__(self, start: bytes) -> tuple:
        if len(self) > _CACHE:
            self.clear()
        self[start] = found = tuple(p for p in prefix_places(start.decode()) if p in self.places)
        return found


class _Weights(dict):
    """Of a word, its weighted places.  Few words have any, and many share a start, so a new word costs one hash mostly."""

    def __init__(self, weights: dict[int, float]):
        super().__init__()
        self.places = {p % PLACES for p in weights}
        self.prefixes = _Prefixes(self.places)

    def __missing__(self, word: bytes) -> tuple:
        if len(self) > _CACHE:
            self.clear()
        bare, found = word.strip(_PUNCTUATION), ()
        if bare:
            found = self.prefixes[bare[: PREFIXES[-1]] if bare.isascii() else bare.decode()[: PREFIXES[-1]].encode()]
            if (own := xxhash.xxh64_intdigest(bare) % PLACES) in self.places:
                found = (own, *found)
        self[word] = found
        return found


def scores(raws: list[bytes | None], model: Ordinal, cache: _Weights) -> np.ndarray:
    out = []
    for raw in raws:
        words = (raw or b"").lower().split()
        counts = Counter(chain.from_iterable(filter(None, map(cache.__getitem__, words))))
        out.append(score(valued(counts, len(words)), model))
    return np.array(out, float)


def score(row: Features, model: Ordinal) -> float:
    return sum(model.weights.get(p, 0.0) * v for p, v in zip(row[0].tolist(), row[1].tolist(), strict=True))


def assess(docs: DataFrame, model: Ordinal) -> DataFrame:
    """doc_id, expected_severity, severity (the most likely grade), p_toxic, toxic (p_toxic >= 0.5)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def step(batch: pa.RecordBatch) -> list:
        model = shared.value
        above = model.severities(scores(as_bytes(batch.column(1)), model, _cache_of(model)))
        edges = np.concatenate((np.ones((len(above), 1)), above, np.zeros((len(above), 1))), 1)
        likely = np.argmax(edges[:, :-1] - edges[:, 1:], 1)
        return [batch.column(0), above.sum(1), likely.astype(np.int32), above[:, 0], above[:, 0] >= 0.5]

    schema = "doc_id long, expected_severity double, severity int, p_toxic double, toxic boolean"
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), step, schema)


_caches: dict[int, tuple] = {}


def _cache_of(model: Ordinal) -> _Weights:
    if id(model) not in _caches:
        _caches.clear()
        _caches[id(model)] = (_Weights(model.weights), model)
    return _caches[id(model)][0]


def drop_toxic(docs: DataFrame, model: Ordinal) -> DataFrame:
    """docs, with all their columns, without those whose p_toxic is 0.5 or more."""
    bounded_batches(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def step(batches):
        model = shared.value
        for batch in batches:
            above = model.severities(scores(as_bytes(batch.column(at)), model, _cache_of(model)))
            yield batch.filter(pa.array(above[:, 0] < 0.5, pa.bool_()))

    return docs.mapInArrow(step, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = source(spark, sf_dir, "documents")
    return assess(docs, train(docs, source(spark, sf_dir, "labels")))
