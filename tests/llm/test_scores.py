"""Quality rules, toxicity, the mix and the search next to brute force."""

import os
import random
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from conftest import corpus, frame, labels_for, sentence

from postmill.llm import kd_search, mixing, quality, toxicity


def test_quality(spark, odd):
    rows, df = odd
    labels = labels_for(spark, rows, quality=lambda d: int(d % 10 != 7))
    trusted = {d for d, _ in rows if d is not None and d % 10 != 7}
    good = brute.kept_by_ratio(rows, trusted, quality.BINS, quality.SMOOTHING, quality.LEAST_RATIO)
    wanted = []
    for (d, t), keep in zip(rows, good):
        counts = brute.quality_counts(t)
        failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
        wanted.append((d, *counts, failed, keep and not failed))
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    got = [tuple(r[n] for n in names) for r in quality.judge(df, labels).collect()]
    assert sorted(map(str, got)) == sorted(map(str, wanted))


def test_quality_counts_all_trusted_texts(spark):
    """If all texts are labelled as good, the target is the corpus and every ratio is 0, however many they are."""
    docs = spark.range(21_000).selectExpr("id AS doc_id", "concat('word', id % 50, ' text') AS text")
    labels = docs.selectExpr("doc_id", "1 AS quality", "0 AS toxic")
    assert {r._units for r in quality.gram_ratios(docs, labels).collect()} == {0}


def test_quality_of_the_table(tables):
    docs, labels = tables("documents", "/root/testdata/sf0.01"), tables("labels", "/root/testdata/sf0.01")
    good = {r.doc_id: r.quality for r in labels.collect()}
    judged = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    for r in docs.collect():
        mine = judged[r.doc_id]
        assert (mine.n_words, mine.word_chars, mine.n_symbols, mine.n_dup_lines, mine.n_repeat_words) == brute.quality_counts(r.text)
    clean = [judged[d] for d, q in good.items() if q and not judged[d].base_failed]
    junk = [judged[d] for d, q in good.items() if not q and not judged[d].base_failed]
    assert all(r.kept for r in clean) and sum(r.kept for r in junk) <= 0.05 * len(junk)


def test_quality_without_rows_or_labels(spark, none, odd):
    rows, df = odd
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.judge(none, no_labels).collect() == []
    assert {r.kept for r in quality.judge(df, no_labels).collect() if not r.base_failed} == {True}


def toxic_corpus(n=600):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        text = " ".join(sentence(rng, rng.randint(4, 12)) for _ in range(rng.randint(2, 8)))
        if i % 5 == 0:
            parts = text.split(" ")
            for bad in ("zqxidiot", "wkvmoron", "zqxtrash"):
                parts.insert(rng.randrange(len(parts)), bad)
            text = " ".join(parts)
        rows.append((i, text))
    return rows


def test_toxicity_on_the_held_out_fold(spark):
    rows = toxic_corpus() + [(9000, None), (9001, ""), (None, "zqxidiot wkvmoron"), (9002, "zqxidiot " * 20000)]
    df = frame(spark, rows)
    labels = labels_for(spark, rows, toxic=lambda d: int(d % 5 == 0 and d < 9000))
    got = toxicity.report(df, labels).collect()
    assert len(got) == len(rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    fold = [r for r in got if r.held_out and r.doc_id < 9000]
    assert sum(r.predicted == int(r.doc_id % 5 == 0) for r in fold) >= 0.97 * len(fold)
    kept = toxicity.drop_toxic(df, labels)
    assert kept.columns == df.columns and 400 < kept.count() < 520


def test_toxicity_without_rows_or_labels(spark, none, odd):
    rows, df = odd
    assert toxicity.report(none, labels_for(spark, rows)).collect() == []
    assert {r.predicted for r in toxicity.report(df, labels_for(spark, rows)).collect()} == {0}


def test_score_of_a_text_is_the_sum_of_its_bins(spark):
    rows = toxic_corpus(80)
    weights, intercept = toxicity.fit([t for _, t in rows], np.array([d % 5 == 0 for d, _ in rows]))
    for r in toxicity.score(frame(spark, rows), (weights, intercept), "p").collect():
        z = sum(float(weights[b]) for b in set(toxicity.bins_of(r.text).tolist())) + intercept
        assert abs(r.p - 1 / (1 + np.exp(-z))) < 1e-6


def test_long_labelled_texts_are_learned_from(spark):
    """Every labelled text is long; the classes are separable all the same."""
    rng = random.Random(2)
    rows = [(i, " ".join(sentence(rng, 11) for _ in range(450)) + " zqxidiot wkvmoron" * (60 if i % 3 == 0 else 0)) for i in range(60)]
    df, labels = frame(spark, rows), labels_for(spark, rows, toxic=lambda d: int(d % 3 == 0))
    assert min(len(t) for _, t in rows) > 20_000
    got = toxicity.report(df, labels).collect()
    assert sum(r.predicted == int(r.doc_id % 3 == 0) for r in got) >= 57


def test_the_sample_is_fitted_in_a_task(spark, monkeypatch):
    """The driver fits nothing, and gets the weights of the same rows in the same order as a fit of the whole sample."""
    rows = toxic_corpus(80)
    df, labels = frame(spark, rows), labels_for(spark, rows, toxic=lambda d: int(d % 5 == 0))
    used = [r.doc_id for r in labels.where(~toxicity.held_out(labels.doc_id)).orderBy("doc_id").collect() if r.doc_id in dict(rows)]
    order = {r.doc_id: r.h for r in labels.selectExpr("doc_id", "xxhash64(cast(doc_id as bigint)) h").collect()}
    used.sort(key=lambda d: (d % 5 != 0, order[d]))
    want, at = toxicity.fit([dict(rows)[d] for d in used], np.array([d % 5 == 0 for d in used]))

    here = os.getpid()
    real = toxicity.fit_bins

    def elsewhere(rows, *rest, **options):
        assert os.getpid() != here
        return real(rows, *rest, **options)

    monkeypatch.setattr(toxicity, "fit_bins", elsewhere)
    weights, intercept = toxicity.train(df, labels)
    assert np.array_equal(weights, want) and intercept == at


def test_labels_that_contradict_and_features_that_do_not_fit(spark, monkeypatch):
    rows = toxic_corpus(200)
    df = frame(spark, rows)
    labels = labels_for(spark, rows, toxic=lambda d: int(d % 5 == 0)).unionByName(labels_for(spark, rows[:50], toxic=lambda d: 0))
    whole = sorted((r.doc_id, r.score) for r in toxicity.report(df, labels.repartition(3)).collect())
    assert whole == sorted((r.doc_id, r.score) for r in toxicity.report(df, labels.repartition(7)).collect())
    monkeypatch.setattr(toxicity, "TRAIN_FEATURES", 20_000)
    few = toxicity.report(df, labels).collect()
    assert len(few) == len(rows) and all(0 <= r.score <= 1 for r in few)


def test_fit_is_the_dense_classifier():
    """The same classifier on a dense matrix of unhashed n-grams, with every step written out."""
    rows = toxic_corpus(48)
    toxic = np.array([d % 5 == 0 for d, _ in rows])
    grams = [{(n, t[i : i + n]) for n in (2, 3, 4, 5) for i in range(len(t) - n + 1)} for t in (t.lower() for _, t in rows)]
    names = sorted(set().union(*grams))
    x = np.array([[g in own for g in names] for own in grams], dtype=float)
    p, q = 1 + x[toxic].sum(axis=0), 1 + x[~toxic].sum(axis=0)
    ratio = np.log((p / (1 + toxic.sum())) / (q / (1 + (~toxic).sum())))
    scaled, y = x * ratio, toxic.astype(float)
    weight = np.where(toxic, 0.5 / toxic.sum(), 0.5 / (~toxic).sum())
    rate = 4 / (scaled**2).sum(axis=1).mean()
    w, b = np.zeros(len(names)), 0.0
    v, vb = np.zeros(len(names)), 0.0
    for _ in range(60):
        aw, ab = w + 0.9 * v, b + 0.9 * vb
        miss = (1 / (1 + np.exp(-(scaled @ aw + ab))) - y) * weight
        v, vb = 0.9 * v - rate * (scaled.T @ miss + 1e-3 * aw), 0.9 * vb - rate * miss.sum()
        w, b = w + v, b + vb
    w = 0.1 * np.abs(w).mean() + 0.9 * w
    z = scaled @ w

    def loss(c):
        return (weight * np.logaddexp(0, np.where(toxic, c - z, z - c))).sum()

    c = min(np.linspace(np.quantile(z, 0.01), np.quantile(z, 0.99), 201), key=loss)
    weights, intercept = toxicity.fit([t for _, t in rows], toxic)
    for (_, text), score in zip(rows, z):
        mine = float(weights[np.unique(toxicity.bins_of(text))].sum(dtype=np.float64)) + intercept
        # Bins hold two n-grams now and then.
        assert abs(mine - (score - c)) < 0.1 * max(1, abs(score - c))


def names(i):
    return [None, "b", "a", "", "é"][i % 5]


@pytest.mark.parametrize("cap", [2, 1.6])
def test_targets(spark, odd, cap):
    rows, _ = odd
    df = frame(spark, rows, names)
    sizes = {}
    for i, (_, t) in enumerate(rows):
        sizes[names(i)] = sizes.get(names(i), 0) + len(brute.words(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = dict(zip(order, brute.fill([sizes[s] for s in order], cap=cap)))
    got = mixing.mix(df, cap=cap).collect()
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        assert r._size == len(brute.words(r.text)) and r._source_size == sizes[r.source]
        assert abs(r._target - targets[r.source]) < 1e-6 and 0 <= r._taken <= 2 * r._size
        taken[r.source] = taken.get(r.source, 0) + r._taken
    assert all(targets[s] - 3 <= taken[s] <= targets[s] for s in taken)


def test_mix_without_words(spark, none):
    assert mixing.report(none).collect() == []
    empty = frame(spark, [(1, None), (2, ""), (3, " ")])
    assert {(r.size, r.taken) for r in mixing.report(empty).collect()} == {(0, 0)}


def test_mixed_documents(spark, odd):
    rows, _ = odd
    df = frame(spark, rows, names)
    many = mixing.repeat_documents(df)
    assert many.columns == df.columns
    times = Counter(r.score for r in many.collect())
    for r in mixing.mix(df).collect():
        assert times[r.score] == (int(r._taken / r._size + 0.5) if r._size else 0)


def vectors():
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(400)]
    rows += [(1000 + i, [0.5, 0.25, 0.0, -0.5, 1.0, 0.1]) for i in range(60)]
    rows += [(2000, None), (2050, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2100, [float("nan")] * 6), (2150, [float("inf")] * 6), (None, [1.0] * 6),
             (2200, []), (2250, [1.0, 2.0]), (2251, [3.0, -1.0]), (50, [9.0] * 6), (2300, [4e9] * 6), (2301, [4e9] * 6)]
    return rows


def test_search(spark, monkeypatch):
    for name, value in (("SHARD_ROWS", 60), ("LEAF_ROWS", 8), ("BLOCK_QUERIES", 4)):
        monkeypatch.setattr(kd_search, name, value)
    rows = vectors()
    # Scores beyond 64 bits are left out of the comparison.
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, shard string")
    got = [tuple(r) for r in kd_search.search(df).collect()]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    wanted = [w for w in brute.best(rows) if abs(w[3]) < 1 << 62]
    assert sorted(g for g in got if abs(g[3]) < 1 << 62 and g[0] != 2300) == sorted(w for w in wanted if w[0] != 2300)


def test_search_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert kd_search.search(empty).collect() == []
    one = spark.createDataFrame([(50, [1.0])], "vec_id long, embedding array<float>")
    assert kd_search.search(one).collect() == []


def test_a_pruned_walk_is_exact():
    rng = np.random.default_rng(2)
    ids, data = np.arange(3000), rng.integers(-200, 200, (3000, 3))
    tree = kd_search.grow_tree(ids, data, 32)
    queries = rng.integers(-200, 200, (20, 3))
    for floors in (np.full(20, -(1 << 63)), np.sort(queries @ data.T, axis=1)[:, -8]):
        found = kd_search.search_tree(tree, np.full(20, -1), queries, floors, 5)
        for q in range(20):
            scores = queries[q] @ data.T
            wanted = sorted(((-int(s), int(i)) for s, i in zip(scores, ids)))[:5]
            assert sorted((-s, i) for n, i, s in found if n == q) == wanted
