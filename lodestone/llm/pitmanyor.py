"""LM scoring (operator 5): a hierarchical Pitman-Yor model of words.

Tokens: the words [^\\x20\\x09-\\x0D]+ of a text with A-Z lower-cased, then one end.  Every distinct previous word (the
start of a text is one too) is a context with a restaurant of its own; all of them share the root as parent, whose base
is uniform over the V known tokens and one unknown.  A token's probability is

    p_u(w) = (c_uw - d t_uw) / (theta + c_u) + (theta + d T_u) / (theta + c_u) * p_root(w)

with customers c and tables t; a table of a context is a customer of the root, which has the same formula over its base.
Contexts and counts are those of the whole corpus and grow with it; nothing is cut, capped or folded.

Seating is sampled by blocked Gibbs: given the totals of its restaurant and its parent's probability, the tables of
one word in one restaurant are independent of all other words', so a sweep draws them anew, for the contexts, then for
the root.  With a = (theta + d T) p_parent, t tables have weight a^t S_d(c, t), with generalised Stirling numbers.  The
same draw is made for every c: the numbers are looked up where c is small and computed (a series, or a saddle point) where
it is not.  After BURN_IN sweeps the samples' predictive probabilities are averaged, and their logarithms are the score.
Discounts and concentration are fixed (DISCOUNTS, THETA).

How it runs.  Documents become chunks of about CHUNK tokens.  A chunk counts its distinct (context, word) pairs and
sends them to shards of contexts, so that a shard has all of a context's words and its totals need no messages; a shard
merges them to rows (context, word, customers).  A context with more tokens than a shard should have is split over
several by its words; only its two totals are then added up (at most 2,000 contexts can be that frequent).  The root's
rows are dealt to root shards by word.  In a sweep each shard sends the root, for each of its words, the tables of all
its contexts added up, and gets back the root's counts of these words.  In the end shards answer the chunks with
averaged probabilities, and a chunk adds up its documents.

What moves grows with the distinct pairs of a chunk and the distinct words of a shard; what stays (a chunk's tokens, a
shard's rows) is written once.  Words are 64-bit hashes.  Seeds are fixed by shard and sweep, so that a task which
runs again gives the same answer.

Defined results: null and empty texts have one token, the end; a document with a null doc_id is learned from;
repeated rows are learned from and scored each; if no document is learned from, every token has the base probability
(1 / (V + 1) = 1); an empty table gives an empty result.  Other columns are not looked at.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_schema, as_bytes, bounded_batches, discard, source, table

CHUNK = 3 << 19
SHARD = 1 << 20
#: Shards of contexts for each shard of the root.
ROOT_SHARE = 4
BURN_IN, SAMPLES = 1, 3
#: Up to so many customers the Stirling numbers are looked up, beyond that they are computed.
TABLE = 512
#: Discounts of the root and of contexts; the concentration is the same for both.
DISCOUNTS = (0.65, 0.8)
THETA = 1.0
END, START = b"\n", b"\r"  # no word holds a line break
FOLDS, HELD_OUT = 7, 2
#: A context is looked at as frequent if it has this share of all tokens; so at most 1 / FREQUENT are.
FREQUENT = 1 / 2000


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


def pack(x) -> bytes:
    """Dicts, lists and tuples of arrays; integers and floats go by planes of bytes, which compress far better."""

    def planes(v):
        if isinstance(v, np.ndarray) and v.dtype.kind in "iuf":
            return "planes", v.dtype.str, v.view(np.uint8).reshape(len(v), v.dtype.itemsize).T.tobytes()
        if isinstance(v, dict):
            return {k: planes(y) for k, y in v.items()}
        return type(v)(map(planes, v)) if isinstance(v, (list, tuple)) else v

    raw = pickle.dumps(planes(x), protocol=5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(packed: bytes):
    def whole(v):
        if isinstance(v, tuple) and len(v) == 3 and isinstance(v[0], str) and v[0] == "planes":
            kind = np.dtype(v[1])
            return np.frombuffer(np.frombuffer(v[2], np.uint8).reshape(kind.itemsize, len(v[2]) // kind.itemsize).T.tobytes(), kind)
        if isinstance(v, dict):
            return {k: whole(y) for k, y in v.items()}
        return type(v)(map(whole, v)) if isinstance(v, (list, tuple)) else v

    return whole(pickle.loads(pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)))


def small(x: np.ndarray) -> np.ndarray:
    """Numbers that are not negative, in as few bytes as the largest needs."""
    top = int(x.max(initial=0))
    return x.astype(np.uint8 if top < 256 else np.uint16 if top < 65_536 else np.uint32 if top < 1 << 32 else np.int64)


def steps(x: np.ndarray) -> np.ndarray:
    """Sorted numbers by their differences."""
    return small(np.diff(x, prepend=0))


def squeezed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, nearly all of them small, as a byte each; from 255 on they are listed by place."""
    large = np.flatnonzero(x >= 255)
    return np.minimum(x, 255).astype(np.uint8), large.astype(np.uint32), x[large].astype(np.int64)


def spread(x: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    out = x[0].astype(float)
    out[x[1]] = x[2]
    return out


# --- seating ----------------------------------------------------------------------------------------------------------


@cache
def log_stirling(d: float) -> np.ndarray:
    """Logs of the generalised Stirling numbers S_d(c, t) for c up to TABLE: the weight of all seatings with t tables."""
    out = np.full((TABLE + 1, TABLE + 2), -np.inf)
    out[0, 0] = 0
    with np.errstate(divide="ignore", invalid="ignore"):
        for n in range(TABLE):
            stay = np.log(np.maximum(n - d * np.arange(TABLE + 2), 0)) + out[n]
            out[n + 1, 1:] = np.logaddexp(out[n, :-1], stay[1:])
    return out


_log_gamma = np.frompyfunc(math.lgamma, 1, 1)


def log_gamma(x: np.ndarray) -> np.ndarray:
    return _log_gamma(x).astype(float)


@cache
def _saddle(d: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By log(t / c), ascending: log f and the log of the second cumulant at the saddle point of f(x)^t / x^c, f = 1 - (1 - x)^d."""
    ly = np.concatenate((np.linspace(-16 / (1 - d), -2, 30_000)[:-1], np.linspace(-2, -1e-6, 30_000)))  # of 1 - x
    y, x = np.exp(ly), -np.expm1(ly)
    lf = np.log(-np.expm1(d * ly))
    k1 = np.exp(np.log(x) + np.log(d) + (d - 1) * ly - lf)
    return -np.log(k1), lf, np.log(k1 * (1 + (1 - d) * x / y - k1))


def log_weights(c: int, t: np.ndarray, a: float, d: float) -> np.ndarray:
    """The logs of a^t S_d(c, t) for consecutive t, but for a constant.

    S_d(c, t) is c! / (t! d^t) times the coefficient of x^c in f(x)^t.  While t is small against c^d its series in
    c^-d converges at once; beyond that, where many tables share the customers, the saddle point gives its steps.
    """
    near = t <= max(1.0, 1.5 * float(c) ** d)
    n = int(near.sum())
    out = np.empty(len(t))
    if n:
        own = t[:n].astype(float)
        ratio = own[-1] * float(c) ** -d
        j = np.arange(1, 12 + int(12 * ratio), dtype=float)
        j = j[j * d < c]
        fixed = log_gamma(j * d + 1) + log_gamma(c - j * d) - math.lgamma(c) - log_gamma(j + 1)
        falling = np.cumsum(np.log(np.maximum(own[:, None] - j + 1, 1e-300)), 1)  # t (t - 1) ... (t - j + 1)
        sign = np.where(j % 2 == 1, 1, -1) * np.sin(np.pi * j * d) * (j <= own[:, None])
        total = (sign * np.exp(fixed + falling)).sum(1)
        out[:n] = own * np.log(a / d) - log_gamma(own + 1) + np.log(np.maximum(total, 1e-300))
    if n < len(t):
        lr, lf, lk = _saddle(d)
        at = t[max(n, 1) - 1 :].astype(float)  # from the last one known
        middle = np.interp(np.log(np.minimum((at[:-1] + 0.5) / c, 1)), lr, lf)
        spread_ = np.log(at) + np.interp(np.log(at / c), lr, lk)
        grown = np.cumsum(np.log(a / d) - np.log(at[1:]) + middle - np.diff(spread_) / 2)
        if not n:
            out[0] = 0
        out[max(n, 1) :] = out[max(n, 1) - 1] + grown
    return out


def likely_tables(c: int, a: float, d: float) -> np.ndarray:
    """The t that hold all but some 1e-12 of the weight: t - 1 is at most Poisson with mean a / d, and less if c is small against it."""
    high = int(min(c, 1 + a / d + 9 * math.sqrt(a / d) + 16))
    if high <= 4096:
        return np.arange(1, high + 1)
    low, top = 1, high  # the weights' logs are concave: the mode by halving
    while low < top:
        t = (low + top) // 2
        step = np.diff(log_weights(c, np.array([t, t + 1]), a, d))[0]
        low, top = (t + 1, top) if step > 0 else (low, t)
    reach = int(9 * math.sqrt(low) + 16)
    return np.arange(max(1, low - reach), min(c, low + reach) + 1)


def seat(c: np.ndarray, a: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables for c customers of one word in one restaurant, drawn by their weights a^t S_d(c, t); no customers, no tables."""
    tables = np.minimum(c, 1).astype(float)
    a = np.maximum(a, 1e-12)
    stirling = log_stirling(d)
    several = np.flatnonzero(c > 1)
    several = several[np.argsort(c[several], kind="stable")]
    sizes, begins = np.unique(c[several], return_index=True)
    for n, at in zip(sizes.astype(np.int64).tolist(), np.split(several, begins[1:]), strict=False):
        if n > TABLE:
            break
        t = np.arange(1, n + 1)
        for part in np.array_split(at, len(at) * n // 2_000_000 + 1):  # bounds the matrix
            noise = rng.gumbel(size=(len(part), n))
            tables[part] = 1 + np.argmax(np.log(a[part])[:, None] * t + stirling[n, 1 : n + 1] + noise, 1)
    for k in np.flatnonzero(c > TABLE).tolist():
        t = likely_tables(int(c[k]), float(a[k]), d)
        tables[k] = t[np.argmax(log_weights(int(c[k]), t, float(a[k]), d) + rng.gumbel(size=len(t)))]
    return tables


def predict(c, t, c_all, t_all, d: float, parent):
    return (c - d * t) / (THETA + c_all) + (THETA + d * t_all) / (THETA + c_all) * parent


# --- chunks -----------------------------------------------------------------------------------------------------------


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        return found


def build_chunk(docs: list[tuple[int | None, bytes | None]]) -> bytes:
    """Words are numbered in the order of their hashes, so that the words of a shard are neighbours."""
    ids = _Ids()
    end, start = ids[END], ids[START]
    parts, sizes = [], []
    for _, raw in docs:
        words = (raw or b"").lower().split()
        own = np.fromiter(map(ids.__getitem__, words), np.int32, len(words))
        parts += [own, np.array([end], np.int32)]
        sizes.append(len(words) + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, ids), np.uint64, len(ids))
    order = np.argsort(hashes, kind="stable")
    tokens = np.concatenate(parts)
    often = np.argsort(-np.bincount(tokens, minlength=len(ids)), kind="stable")  # frequent words get small numbers
    by_count, rank = np.empty((2, len(order)), np.int32)
    by_count[often] = rank[order] = np.arange(len(order), dtype=np.int32)
    return pack(
        {
            "doc_ids": [d for d, _ in docs], "held": np.array([is_held_out(d) for d, _ in docs], bool), "start": int(rank[start]),
            "sizes": np.array(sizes, np.int64), "tokens": by_count[tokens], "ranks": rank[often], "hashes": hashes[order],
        }
    )


def open_chunk(packed: bytes) -> dict:
    own = unpack(packed)
    own["tokens"] = own["ranks"][own["tokens"]]
    own["starts"] = np.concatenate(([0], np.cumsum(own["sizes"])[:-1]))
    before = np.empty(len(own["tokens"]), np.int64)
    before[1:] = own["tokens"][:-1]
    before[own["starts"]] = own["start"]
    before <<= 32
    before |= own["tokens"]
    own["codes"] = before
    own["learned"] = ~np.repeat(own["held"], own["sizes"])
    return own


def frequent_contexts(own: dict) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the contexts with FREQUENT of the chunk's tokens or more: 1 / FREQUENT at most."""
    n = np.bincount(own["codes"] >> 32, minlength=len(own["hashes"]))
    on = np.flatnonzero(n >= max(1, FREQUENT * n.sum()))
    return own["hashes"][on], n[on]


def chunks(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """chunk, payload, n_tokens, and frequent: a struct array of contexts."""
    schema = "chunk long, payload binary, n_tokens long, frequent array<struct<hash:long,n:long>>"
    arrow = arrow_schema(schema)

    def run(batches):
        from pyspark import TaskContext

        base, k = TaskContext.get().partitionId() << 32, 0
        held: list[tuple] = []
        weight = 0
        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                held.append((doc, raw))
                weight += len(raw or b"") // 6 + 1
                if weight >= chunk:
                    yield row(base + k, held)
                    held, weight, k = [], 0, k + 1
        if held:
            yield row(base + k, held)

    def row(number: int, held: list[tuple]) -> pa.RecordBatch:
        payload = build_chunk(held)
        own = open_chunk(payload)
        hashes, n = frequent_contexts(own)
        frequent = [{"hash": h, "n": m} for h, m in zip(hashes.view(np.int64).tolist(), n.tolist(), strict=True)]
        values = ([number], [payload], [len(own["tokens"])], [frequent])
        return pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(values, arrow, strict=True)], schema=arrow)

    bounded_batches(docs.sparkSession)
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return columns.mapInArrow(run, schema)


def place_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Ranges of hashes to n places."""
    return (((hashes >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def edges_of(hashes: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(place_of(hashes, n), np.arange(n + 1))


def pairs_by_shard(own: dict, n_shards: int, split: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs (context << 32 | word) by shard, context and word; their shards, the shards' edges, and for each token its pair.

    split: hash of a context to the number of shards that it is dealt to, by its words.
    """
    pairs, inverse = np.unique(own["codes"], return_inverse=True)
    context = pairs >> 32
    base = place_of(own["hashes"], n_shards)
    shard = base[context]
    if split:
        known = np.array(sorted(split), np.uint64)
        at = np.minimum(np.searchsorted(known, own["hashes"]), len(known) - 1)
        parts = np.where(known[at] == own["hashes"], np.array([split[int(k)] for k in known])[at], 1)
        hot = np.flatnonzero(parts[context] > 1)
        turn = (own["hashes"][pairs[hot] & 0xFFFFFFFF] % parts[context[hot]].astype(np.uint64)).astype(np.int64)
        shard[hot] = (shard[hot] + turn) % n_shards
    order = np.argsort(shard, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return pairs[order], shard[order], np.searchsorted(shard[order], np.arange(n_shards + 1)), rank[inverse]


def questions(packed: bytes, n_shards: int, split: dict[int, int]) -> list[tuple[int, bytes]]:
    """For each shard the chunk's pairs of that shard, with the counts to learn from."""
    own = open_chunk(packed)
    pairs, _, edges, of_token = pairs_by_shard(own, n_shards, split)
    customers = np.bincount(of_token[own["learned"]], minlength=len(pairs))
    out = []
    for s in np.flatnonzero(np.diff(edges)):
        mine = slice(edges[s], edges[s + 1])
        contexts, per = np.unique(pairs[mine] >> 32, return_counts=True)
        words, w = np.unique(pairs[mine] & 0xFFFFFFFF, return_inverse=True)
        asked = {
            "contexts": own["hashes"][contexts], "per": small(per), "words": own["hashes"][words], "w": small(w),
            "customers": squeezed(customers[mine]),
        }
        out.append((int(s), pack(asked)))
    return out


# --- rows that move ---------------------------------------------------------------------------------------------------

#: place: the shard or root shard (or, for ANSWER, chunk) that a row goes to; sender: who sends it.  The numbers are parts of totals.
BLOB = "place long, kind int, sender long, payload binary, c double, t double, n long, v long"
ROWS, ASKED, TABLES, UP, WORDS, DOWN, SEEN, SPLIT, ANSWER, TEXT = range(10)
SAMPLE = 100


def row_of(place: int, kind: int, sender: int, payload: bytes, c: float = 0, t: float = 0, n: int = 0, v: int = 0) -> tuple:
    return place, kind, sender, payload, c, t, n, v


class Shard:
    """Rows (context, word) of a shard, sorted by context; c are customers, t tables."""

    def __init__(self, static: dict):
        self.contexts, self.words = static["contexts"], static["words"]
        self.at = np.repeat(np.arange(len(self.contexts)), static["per"])
        self.w = static["w"].astype(np.int64)
        self.c = spread(static["customers"])

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, values, minlength=len(self.contexts))

    def by_word(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.w, values, minlength=len(self.words))

    def totals(self, t: np.ndarray, split: dict[int, tuple[float, float]]) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables of contexts; of those that are split over shards the sums of all parts are given."""
        c_all, t_all = self.sums(self.c), self.sums(t)
        for key, (c, t_) in split.items():
            k = int(np.searchsorted(self.contexts, np.uint64(key)))
            if k < len(self.contexts) and int(self.contexts[k]) == key:
                c_all[k], t_all[k] = c, t_
        return c_all[self.at], t_all[self.at]

    def parent(self, down: list[bytes], root: dict) -> np.ndarray:
        """p_root of each word; down: the root's counts, in the order of root shards, which is that of words."""
        got = [unpack(x) for x in down]
        c, t = (np.concatenate([spread(x[k]) for x in got]) for k in ("c", "t"))
        return predict(c, t, root["c"], root["t"], DISCOUNTS[0], 1 / (root["v"] + 1))


def up_rows(shard: int, own: Shard, t: np.ndarray, n_roots: int, first: bool) -> list[tuple]:
    """The tables of each word, all contexts added up, to the root shards; first also names the words and the tokens learned from."""
    tables = own.by_word(t)
    seen = own.by_word(own.c) if first else None
    edges = edges_of(own.words, n_roots)
    out = []
    for r in np.flatnonzero(np.diff(edges)):
        a, b = edges[r], edges[r + 1]
        asked = {"t": squeezed(tables[a:b])}
        if first:
            asked |= {"words": own.words[a:b], "seen": squeezed(seen[a:b])}
        out.append(row_of(int(r), UP, shard, pack(asked)))
    return out


def split_rows(shard: int, own: Shard, t: np.ndarray, split: dict[int, int]) -> list[tuple]:
    if not split:
        return []
    on = np.flatnonzero(np.isin(own.contexts, np.array(sorted(split), np.uint64)))
    c_all, t_all = own.sums(own.c), own.sums(t)
    return [row_of(int(own.contexts[k].view(np.int64)), SPLIT, shard, b"", float(c_all[k]), float(t_all[k])) for k in on]


def merge_shard(shard: int, asked: list[tuple[int, bytes]], n_roots: int, split: dict[int, int]) -> list[tuple]:
    """asked: (chunk, question).  The shard's rows, first tables (one each), and for each chunk the places of its pairs."""
    got = [unpack(x) for _, x in asked]
    contexts = np.unique(np.concatenate([x["contexts"] for x in got]))
    words = np.unique(np.concatenate([x["words"] for x in got]))
    codes = [
        np.repeat(np.searchsorted(contexts, x["contexts"]), x["per"]) << 32 | np.searchsorted(words, x["words"])[x["w"]] for x in got
    ]
    pairs, inverse = np.unique(np.concatenate(codes), return_inverse=True)
    customers = np.bincount(inverse, np.concatenate([spread(x["customers"]) for x in got]), minlength=len(pairs))
    per = np.bincount(pairs >> 32, minlength=len(contexts))
    static = {"contexts": contexts, "per": small(per), "words": words, "w": small(pairs & 0xFFFFFFFF), "customers": squeezed(customers)}
    own = Shard(static)
    t = np.minimum(own.c, 1)
    out = [row_of(shard, ROWS, -1, pack(static)), row_of(shard, TABLES, -1, pack({"t": squeezed(t), "kept": []}))]
    for (chunk, _), x, code in zip(asked, got, codes, strict=True):
        answer = {"at": steps(np.searchsorted(pairs, code)), "words": steps(np.searchsorted(words, x["words"]))}
        out.append(row_of(shard, ASKED, chunk, pack(answer)))
    return out + up_rows(shard, own, t, n_roots, True) + split_rows(shard, own, t, split)


def merge_root(place: int, asked: list[tuple[int, bytes]]) -> list[tuple]:
    """The root's words, first counts (one table each), and how often each word is learned from."""
    got = [(s, unpack(x)) for s, x in asked]
    words = np.unique(np.concatenate([x["words"] for _, x in got]))
    at = [np.searchsorted(words, x["words"]) for _, x in got]
    every = np.concatenate(at)
    seen = np.bincount(every, np.concatenate([spread(x["seen"]) for _, x in got]), minlength=len(words))
    c = np.bincount(every, np.concatenate([spread(x["t"]) for _, x in got]), minlength=len(words))
    places = {"senders": np.array([s for s, _ in got]), "sizes": np.array([len(x) for x in at]), "at": [steps(x) for x in at], "n": len(words)}
    first = row_of(place, WORDS, -1, pack(places), float(c.sum()), float((c > 0).sum()), int(seen.sum()), int((seen > 0).sum()))
    out = [first]
    for (s, _), x in zip(got, at, strict=True):
        out.append(row_of(s, SEEN, place, pack({"seen": squeezed(seen[x])})))
    return out + down_rows(place, places, c, np.minimum(c, 1))


def down_rows(place: int, places: dict, c: np.ndarray, t: np.ndarray) -> list[tuple]:
    out = []
    for s, own in zip(places["senders"].tolist(), places["at"], strict=True):
        at = np.cumsum(own.astype(np.int64))
        out.append(row_of(s, DOWN, place, pack({"c": squeezed(c[at]), "t": squeezed(t[at])})))
    return out


def sweep_root(place: int, packed: bytes, asked: dict[int, bytes], root: dict, sweep: int) -> list[tuple]:
    places = unpack(packed)
    c = np.zeros(places["n"])
    for s, own in zip(places["senders"].tolist(), places["at"], strict=True):
        c[np.cumsum(own.astype(np.int64))] += spread(unpack(asked[s])["t"])
    a = (THETA + DISCOUNTS[0] * root["t"]) / (root["v"] + 1)
    t = seat(c, np.full(len(c), a), DISCOUNTS[0], np.random.default_rng((1, place, sweep)))
    total = row_of(place, WORDS, -1, b"", float(c.sum()), float(t.sum()))
    return [total, *down_rows(place, places, c, t)]


def sweep_shard(shard: int, static: bytes, tables: bytes, down: list[bytes], root: dict, sums: dict, split: dict, sweep: int, n_roots: int) -> list[tuple]:
    """Draws the tables anew; those of samples are kept."""
    own, old = Shard(unpack(static)), unpack(tables)
    _, t_all = own.totals(spread(old["t"]), sums)
    t = seat(own.c, (THETA + DISCOUNTS[1] * t_all) * own.parent(down, root)[own.w], DISCOUNTS[1], np.random.default_rng((0, shard, sweep)))
    new = squeezed(t)
    out = [row_of(shard, TABLES, -1, pack({"t": new, "kept": [*old["kept"], new] if sweep > BURN_IN else []}))]
    return out + up_rows(shard, own, t, n_roots, False) + split_rows(shard, own, t, split)


def average_shard(shard: int, static: bytes, tables: bytes, downs: list[list[bytes]], roots: list[dict], sums: list[dict]) -> tuple:
    """The samples' probabilities of all rows, averaged."""
    own, kept = Shard(unpack(static)), unpack(tables)["kept"]
    mean = np.zeros(len(own.c))
    for packed, down, root, split in zip(kept, downs, roots, sums, strict=True):
        t = spread(packed)
        mean += predict(own.c, t, *own.totals(t, split), DISCOUNTS[1], own.parent(down, root)[own.w]) / SAMPLES
    return row_of(shard, TABLES, -1, pack({"p": np.log10(mean).astype(np.float32)}))


def answer_shard(shard: int, averages: bytes, seen: list[bytes], asked: list[tuple[int, bytes]]) -> Iterator[tuple]:
    """To each chunk the averaged probabilities of its pairs, and how often each of its words is learned from."""
    p = unpack(averages)["p"]
    counts = np.concatenate([spread(unpack(x)["seen"]) for x in seen])
    for chunk, raw in asked:
        x = unpack(raw)
        at, words = (np.cumsum(x[k].astype(np.int64)) for k in ("at", "words"))
        yield row_of(chunk, ANSWER, shard, pack({"p": p[at], "seen": squeezed(counts[words])}))


def score_chunk(packed: bytes, answers: dict[int, bytes], n_shards: int, split: dict, root: dict) -> list:
    own = open_chunk(packed)
    pairs, _, edges, of_token = pairs_by_shard(own, n_shards, split)
    p, seen = np.empty(len(pairs)), np.zeros(len(own["hashes"]))
    for s in np.flatnonzero(np.diff(edges)):
        mine, got = slice(edges[s], edges[s + 1]), unpack(answers[int(s)])
        p[mine] = got["p"]
        seen[np.unique(pairs[mine] & 0xFFFFFFFF)] = spread(got["seen"])
    c = seen[own["tokens"]]
    add_one = np.log10((c + 1) / (root["n"] + root["v"] + 1))
    sums = lambda x: np.add.reduceat(x, own["starts"])
    n = len(own["sizes"])
    return [
        own["doc_ids"], own["held"], own["sizes"], sums((c > 0).astype(np.int64)), np.full(n, root["n"]),
        sums(add_one), sums(p[of_token]),
    ]


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def runs_of(batches):
    """The rows of one place, (kind, sender, payload) each; the input is sorted by place, kind and sender."""
    place, held = None, []
    for batch in batches:
        columns = (batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), as_bytes(batch.column(3)))
        for p, *row in zip(*columns, strict=True):
            if held and p != place:
                yield place, held
                held = []
            place = p
            held.append(row)
    if held:
        yield place, held


def of_kind(rows: list, kind: int) -> list[tuple[int, bytes]]:
    return [(s, x) for k, s, x in rows if k == kind]


def one(rows: list, kind: int) -> bytes:
    return next(x for k, _, x in rows if k == kind)


def by_place(parts: list[DataFrame], n: int, fn) -> DataFrame:
    """fn: (place, its rows) to rows."""
    arrow = arrow_schema(BLOB)

    def run(batches):
        for place, rows in runs_of(batches):
            for found in fn(place, rows):
                yield pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(found, arrow, strict=True)], schema=arrow)

    rows = reduce(DataFrame.unionByName, [x.select("place", "kind", "sender", "payload") for x in parts])
    return rows.repartitionById(n, F.col("place").cast("int")).sortWithinPartitions("place", "kind", "sender").mapInArrow(run, BLOB)


def score(docs: DataFrame, chunk: int = CHUNK, shard: int = SHARD) -> DataFrame:
    cut = table(chunks(docs, chunk), "lm-chunks")
    n_tokens, n_chunks = cut.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.count(F.lit(1))).first()
    n_shards = max(1, -(-n_tokens // shard))
    n_roots = max(1, -(-n_shards // ROOT_SHARE))
    split = split_contexts(cut, n_tokens, n_shards)

    sent = arrow_schema("place long, kind int, sender long, payload binary")

    def ask(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                rows = questions(batch.column(1)[k].as_py(), n_shards, split)
                columns = ([s for s, _ in rows], [ASKED] * len(rows), [batch.column(0)[k].as_py()] * len(rows), [x for _, x in rows])
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, sent, strict=True)], schema=sent)

    of = lambda df, *kinds: df.where(F.col("kind").isin(*kinds))
    asked = cut.select("chunk", "payload").mapInArrow(ask, "place long, kind int, sender long, payload binary")
    merged = table(by_place([asked], n_shards, lambda s, rows: merge_shard(s, of_kind(rows, ASKED), n_roots, split)), "lm-shards", ("kind",))
    roots = table(by_place([of(merged, UP)], n_roots, lambda r, rows: merge_root(r, of_kind(rows, UP))), "lm-roots", ("kind",))
    shards, down, sums, root = merged, roots, split_sums(merged, split), root_totals(roots)
    discard(merged, f"kind={UP}")
    samples: list[tuple] = []  # of each the root's answers, its totals, and the sums of split contexts

    for sweep in range(1, BURN_IN + SAMPLES + 1):

        def sweep_one(s, rows, root=root, sums=sums, sweep=sweep):
            return sweep_shard(s, one(rows, ROWS), one(rows, TABLES), [x for _, x in of_kind(rows, DOWN)], root, sums, split, sweep, n_roots)

        def sweep_up(r, rows, root=root, sweep=sweep):
            return sweep_root(r, one(rows, WORDS), dict(of_kind(rows, UP)), root, sweep)

        old = [shards] if shards is not merged else []
        old += [down] if down is not roots and all(down is not x[0] for x in samples) else []
        shards = table(by_place([of(merged, ROWS), of(shards, TABLES), of(down, DOWN)], n_shards, sweep_one), "lm-tables", ("kind",))
        down = table(by_place([of(roots, WORDS), of(shards, UP)], n_roots, sweep_up), "lm-counts", ("kind",))
        for x in old:
            discard(x)
        sums, root = split_sums(shards, split), root | root_totals(down, ("c", "t"))
        if sweep > BURN_IN:
            samples.append((down, root, sums))

    downs, totals, parts = zip(*samples, strict=True)

    def average(s, rows):
        found = [[x for _, x in of_kind(rows, SAMPLE + k)] for k in range(SAMPLES)]
        return [average_shard(s, one(rows, ROWS), one(rows, TABLES), found, totals, parts)]

    def answer(s, rows):
        return answer_shard(s, one(rows, TABLES), [x for _, x in of_kind(rows, SEEN)], of_kind(rows, ASKED))

    told = [of(x, DOWN).withColumn("kind", F.lit(SAMPLE + k)) for k, x in enumerate(downs)]
    averages = table(by_place([of(merged, ROWS), of(shards, TABLES), *told], n_shards, average), "lm-averages")
    for x in (shards, *downs):
        discard(x)
    discard(merged, f"kind={ROWS}")
    answers = table(by_place([of(merged, ASKED), averages, of(roots, SEEN)], n_shards, answer), "lm-answers")
    for x in (merged, roots, averages):
        discard(x)
    texts = cut.select(F.col("chunk").alias("place"), F.lit(TEXT).alias("kind"), F.lit(-1).cast("long").alias("sender"), "payload")
    both = answers.select("place", "kind", "sender", "payload").unionByName(texts)
    both = both.repartition(max(1, n_chunks), "place").sortWithinPartitions("place", "kind", "sender")
    arrow = arrow_schema(SCHEMA)

    def finish(batches):
        for _, rows in runs_of(batches):
            columns = score_chunk(one(rows, TEXT), dict(of_kind(rows, ANSWER)), n_shards, split, root)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return both.mapInArrow(finish, SCHEMA)


def split_contexts(cut: DataFrame, n_tokens: int, n_shards: int) -> dict[int, int]:
    """Contexts that have more tokens than a shard, and over how many shards each is dealt: 1 / FREQUENT at most.

    A chunk names the contexts with FREQUENT of its tokens; so a context with twice that share of all tokens is found
    with half its count or more.
    """
    per_shard = max(1, -(-n_tokens // n_shards))
    found = cut.select(F.explode("frequent").alias("f")).groupBy("f.hash").agg(F.sum("f.n").alias("n"))
    found = found.where((F.col("n") > per_shard) & (F.col("n") >= FREQUENT * n_tokens)).collect()
    return {r["hash"] % (1 << 64): min(n_shards, -(-r["n"] // per_shard)) for r in found}


def split_sums(shards: DataFrame, split: dict) -> dict[int, tuple[float, float]]:
    """Customers and tables of the contexts that are split over shards: a row each."""
    if not split:
        return {}
    rows = shards.where(F.col("kind") == SPLIT).groupBy("place").agg(F.sum("c").alias("c"), F.sum("t").alias("t"))
    return {r.place % (1 << 64): (r.c, r.t) for r in rows.collect()}


def root_totals(down: DataFrame, names: tuple[str, ...] = ("c", "t", "n", "v")) -> dict:
    """Customers, tables, tokens learned from and known words of the root: one row."""
    row = down.where(F.col("kind") == WORDS).agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in names)).first()
    return row.asDict()


def query(spark, sf_dir: str) -> DataFrame:
    return score(source(spark, sf_dir, "documents"))
