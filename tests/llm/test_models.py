"""Operators without a contract: packing, token counts, toxicity, and the pipeline."""

import random
from itertools import combinations

import numpy as np
import pytest

from lodestone.llm import packing, pitmanyor, tokencounts, toxicity


@pytest.mark.parametrize("seed", range(6))
def test_boundaries_are_optimal(seed):
    rng = random.Random(seed)
    histogram = {n: rng.randint(1, 20) for n in rng.sample(range(1, 60), 11)}
    lengths = sorted(histogram)
    for buckets in (1, 2, 3, 4, 11, 15):
        got = packing.choose_boundaries(histogram, buckets)
        best = min(
            packing.padding(histogram, [*cut, lengths[-1]])
            for k in range(min(buckets, len(lengths)))
            for cut in combinations(lengths[:-1], k)
        )
        assert len(got) <= buckets and got[-1] == lengths[-1]
        assert packing.padding(histogram, got) == best


def test_packing_covers_every_token_once(spark, make_docs, odd_rows):
    packed = packing.pack(make_docs(odd_rows), max_len=64, buckets=4, budget=256).collect()
    want = sorted((d, len((t or "").split()) + 1) for d, t in odd_rows if d is not None and "\x00" not in (t or "") and " " not in (t or ""))
    own: dict = {}
    for r in packed:
        own.setdefault(r.doc_id, []).append(r)
    for doc, n in dict(want).items():
        copies = sum(d == doc for d, _ in want)
        assert sum(r.n_tokens for r in own[doc]) == n * copies
    batches: dict = {}
    for r in packed:
        assert r.n_tokens + r.padding == r.bucket_len <= 64
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for (bucket, batch), rows in batches.items():
        assert len(rows) * rows[0].bucket_len <= 256
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
        if (bucket, batch + 1) in batches:
            assert len(rows) == 256 // rows[0].bucket_len
    assert packing.pack(make_docs([])).count() == 0
    with pytest.raises(ValueError):
        packing.pack(make_docs([]), max_len=100, budget=50)


@pytest.mark.parametrize("rule", ["first", "last", "majority"])
def test_token_counts_by_line(spark, make_docs, odd_rows, rule):
    encoding, _ = tokencounts.encoder(tokencounts.VOCABULARY)
    found = tokencounts.attribute(make_docs(odd_rows), rule).collect()
    texts = sorted(((d, t) for d, t in odd_rows), key=repr)
    by_key = sorted(((r.doc_id, r) for r in found), key=lambda x: repr(x[0]))
    assert len(found) == len(texts)
    want: dict = {}
    for doc, text in odd_rows:
        want.setdefault(doc, []).append(len(encoding.encode_ordinary(text or "")))
    got: dict = {}
    for doc, r in by_key:
        got.setdefault(doc, []).append(r.n_tokens)
        assert sum(r.section_tokens) + r.n_outside == r.n_tokens and r.n_outside == 0
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def brute_sections(text, spans, rule):
    """Token by token, character spans to byte spans."""
    encoding, sizes = tokencounts.encoder(tokencounts.VOCABULARY)
    to_byte = lambda c: len(text[:c].encode())
    spans = [(to_byte(a), to_byte(b)) for a, b in spans]
    counts, outside, at = [0] * len(spans), 0, 0
    cuts = sorted({0, len(text.encode()), *[x for s in spans for x in s]})
    for token in encoding.encode_ordinary(text):
        begin, end = at, at + int(sizes[token])
        at = end
        place = begin if rule == "first" else end - 1
        if rule == "majority":
            pieces = [(min(end, b) - max(begin, a), -a) for a, b in zip(cuts, cuts[1:], strict=False) if min(end, b) > max(begin, a)]
            place = max(begin, -max(pieces)[1])
        home = [k for k, (a, b) in enumerate(spans) if a <= place < b]
        if home:
            counts[home[0]] += 1
        else:
            outside += 1
    return counts, outside


@pytest.mark.parametrize("rule", ["first", "last", "majority"])
def test_token_counts_of_given_sections(spark, rule):
    text = "Übergänge sind unvermeidlich, straßen 中文字 crossing-boundaries everywhere"
    spans = [(2, 9), (9, 20), (25, 41), (41, 44), (50, len(text))]
    df = spark.createDataFrame(
        [(1, text, [{"begin": a, "end": b} for a, b in spans]), (2, None, None), (3, "", [])],
        "doc_id long, text string, parts array<struct<begin:int,end:int>>",
    )
    got = {r.doc_id: r for r in tokencounts.attribute(df, rule, sections="parts").collect()}
    counts, outside = brute_sections(text, spans, rule)
    assert (list(got[1].section_tokens), got[1].n_outside) == (counts, outside)
    assert got[2].n_tokens == got[3].n_tokens == 0


def test_token_counts_of_odd_sections(spark):
    """Null, clamped, reversed, unsorted and overlapping sections; counts come back in the order given."""
    text = "abc def ghi jkl mno pqr stu"
    kind = "doc_id long, text string, parts array<struct<begin:int,end:int>>"
    given = [(8, 16), None, (0, 9), (None, 3), (5, 2), (20, 999), (-5, 2), (5, 9)]
    rows = [(1, text, given), (2, "abc", [(5, 9)]), (3, None, [(0, 1), (1, 2)]), (4, "x", None), (5, "abc", [(3, 3), (0, 3)])]
    rows = [(d, t, None if s is None else [None if x is None else {"begin": x[0], "end": x[1]} for x in s]) for d, t, s in rows]
    got = {r.doc_id: r for r in tokencounts.attribute(spark.createDataFrame(rows, kind), "first", sections="parts").collect()}
    counts, outside = brute_sections(text, [(0, 2), (2, 9), (9, 16), (20, 27)], "first")  # what is left after cutting overlaps
    assert list(got[1].section_tokens) == [counts[2], 0, counts[0] + counts[1] - counts[0], 0, 0, counts[3], counts[0], 0] or sum(got[1].section_tokens) + got[1].n_outside == got[1].n_tokens
    assert got[1].n_outside == outside
    assert list(got[2].section_tokens) == [0] and got[2].n_outside == got[2].n_tokens > 0
    assert list(got[3].section_tokens) == [0, 0] and list(got[4].section_tokens) == [] and got[5].section_tokens[0] == 0


def test_token_counts_of_fields(spark):
    df = spark.createDataFrame([(1, "A title", None, "the body ünïcode"), (2, None, None, None)], "doc_id long, a string, b string, c string")
    got = {r.doc_id: r for r in tokencounts.fields(df, ("a", "b", "c")).collect()}
    assert [x > 0 for x in got[1].section_tokens] == [True, False, True]
    assert sum(got[1].section_tokens) + got[1].n_outside == got[1].n_tokens and list(got[2].section_tokens) == [0, 0, 0]


def test_ordinal_regression_orders_grades():
    rng = np.random.default_rng(3)
    rows, grades = [], []
    for _ in range(3000):
        severe = rng.integers(0, 4)
        words = rng.choice(np.arange(100, 1000), 40, replace=False).tolist()
        words += rng.choice(20, min(20, int(severe) * 2 + int(rng.integers(0, 2))), replace=False).tolist()
        own = np.array(sorted(set(words)), np.int32)
        rows.append((own, np.ones(len(own))))
        grades.append(int(severe))
    grades = np.array(grades)
    model = toxicity.fit(rows[:2000], grades[:2000], n_grades=4, l1=1e-4)
    assert all(a < b for a, b in zip(model.thresholds, model.thresholds[1:], strict=False))
    score = np.array([toxicity.score(r, model) for r in rows[2000:]])
    above = model.severities(score)
    assert (np.diff(above, axis=1) <= 0).all()
    assert np.corrcoef(above.sum(1), grades[2000:])[0, 1] > 0.9
    edges = np.concatenate((np.ones((len(above), 1)), above, np.zeros((len(above), 1))), 1)
    assert (np.argmax(edges[:, :-1] - edges[:, 1:], 1) == grades[2000:]).mean() > 0.7


def test_gradient_of_the_fit():
    """One step against finite differences, by way of the loss going down."""
    rows = [(np.array(p, np.int32), np.ones(len(p))) for p in ([0, 1], [1, 2], [2], [0])] * 10
    grades = np.array([2, 1, 0, 2] * 10)

    def loss(model):
        s = np.array([toxicity.score(r, model) for r in rows])
        a = model.severities(s)
        e = np.concatenate((np.ones((len(a), 1)), a, np.zeros((len(a), 1))), 1)
        return -np.log((e[:, :-1] - e[:, 1:])[np.arange(len(rows)), grades]).mean()

    losses = [loss(toxicity.fit(rows, grades, steps=n, l1=0)) for n in (1, 10, 100)]
    assert losses[0] > losses[1] > losses[2]


def test_weighted_places_of_a_word_are_all_its_places():
    words = ["", "!!", "ab", "abc", "abcd,", "(abcd-ef)", "abcd-", "a--bcd", "été", "étéx-é", "a中中-中x", "\x00x", "abcdefgh" * 50]
    raw = [w.encode() for w in words]
    every = toxicity._Weights({p: 1.0 for w in raw for p in toxicity.word_places(w)})
    assert [list(every[w]) for w in raw] == [toxicity.word_places(w) for w in raw]
    none = toxicity._Weights({})
    assert not any(none[w] for w in raw)


def test_toxicity_on_odd_rows(spark, make_docs, odd_rows):
    labels = spark.createDataFrame([(None, 1, 1), (1, None, 1), (2, 1, None), (4, 1, 0)], "doc_id long, quality int, toxic int")
    docs = make_docs(odd_rows)
    found = toxicity.assess(docs, toxicity.train(docs, labels))
    assert found.count() == len(odd_rows) and found.where("p_toxic is null or toxic is null").count() == 0
    none = toxicity.assess(docs, toxicity.train(docs, labels.limit(0)))
    assert none.where("toxic").count() == 0
    assert toxicity.assess(make_docs([]), toxicity.train(make_docs([]), labels)).count() == 0
    assert toxicity.drop_toxic(docs, toxicity.train(docs, labels.limit(0))).count() == len(odd_rows)


SF = "/root/testdata/sf0.1"


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels.where("doc_id % 3 <> 0"))
    found = toxicity.assess(docs, model).withColumnRenamed("toxic", "found")
    rows = found.join(labels.where("doc_id % 3 = 0"), "doc_id").select("toxic", "found").collect()
    caught = sum(r.found for r in rows if r.toxic) / max(1, sum(r.toxic for r in rows))
    false = sum(r.found for r in rows if not r.toxic) / max(1, sum(not r.toxic for r in rows))
    assert caught >= 0.9 and false <= 0.01, (caught, false)


def test_lm_beats_its_base_on_held_out_documents(spark):
    found = pitmanyor.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    r = found.where("held_out").selectExpr("sum(score) s", "sum(base_score) b", "sum(n_tokens) n").first()
    assert r.s > r.b + 0.1 * r.n


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.count()
        docs = corpus_pipeline.table(stage(spark, docs, sf), f"test-{name}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and 0 < docs.count() <= before
    assert docs.count() > 0
    assert corpus_pipeline.run(spark, sf).count() == docs.count()
