"""Suffix arrays, MinHash and sentence spans next to brute force."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from conftest import corpus, frame, same

from postmill.llm import near_dedup, sentence_spans, suffix_dedup


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_suffix_dedup(odd):
    rows, df = odd
    same(rows_of(suffix_dedup.report(df)), brute.repeats(rows))


def test_suffix_dedup_empty(none):
    assert rows_of(suffix_dedup.report(none)) == []


def test_suffix_dedup_over_many_blocks(spark, monkeypatch):
    """One passage in a third of all texts, cut into many blocks, groups and shards."""
    for name, value in (("BLOCK_BYTES", 3000), ("BUCKET_BYTES", 5000), ("GROUP_BYTES", 4000)):
        monkeypatch.setattr(suffix_dedup, name, value)
    rows = corpus(seed=11, n=40)
    rows += [(2000 + i, f"{i} start. {rows[6][1]} end {i}") for i in range(20)]
    same(rows_of(suffix_dedup.report(frame(spark, rows))), brute.repeats(rows))


@pytest.mark.parametrize("shard", [3, 50])
def test_windows_of_shards_are_merged(shard):
    rng = random.Random(3)
    runs = list({bytes(rng.choice(b"ab") for _ in range(2)) * 25 + bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 32))) for _ in range(60)})
    least = np.array([rng.randint(0, 9) for _ in runs])
    got, count = suffix_dedup.least_ids(pa.array(runs, pa.binary()), least, shard)
    wanted = {}
    for run, d in zip(runs, least):
        for i in range(len(run) - 49):
            wanted[run[i : i + 50]] = min(wanted.get(run[i : i + 50], 99), d)
    for run, ids, n in zip(runs, got, count):
        assert [int(x) for x in ids[:n]] == [wanted[run[i : i + 50]] for i in range(len(run) - 49)]


def test_equal_windows_have_equal_anchors():
    rng = random.Random(5)
    shared = bytes(rng.choice(b"abc ") for _ in range(90))
    anchors = {}
    for _ in range(30):
        text = bytes(rng.choice(b"abc ") for _ in range(rng.randint(0, 70))) + shared + bytes(rng.choice(b"ab") for _ in range(30))
        starts, stops, h = suffix_dedup.anchor_runs(np.array([0, len(text)]), np.frombuffer(text, np.uint8))
        assert [w for a, b in zip(starts, stops) for w in range(a, b)] == list(range(len(text) - 49))
        for a, b, key in zip(starts, stops, h):
            for w in range(a, b):
                assert anchors.setdefault(text[w : w + 50], key) == key


def test_near_dedup(odd):
    rows, df = odd
    wanted = [r if r[0] is not None else (None, r[1], None, True) for r in brute.near(rows)]
    same(rows_of(near_dedup.components(df)), wanted)


def test_near_dedup_empty(none):
    assert rows_of(near_dedup.components(none)) == []
    assert near_dedup.keep_first(none).columns == none.columns


def test_near_dedup_chain_and_crowd(spark):
    """Links that only lead on over other texts, and a large group of near copies that all differ."""
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    rows = []
    for i in range(12):
        chain = list(base)
        chain[: 6 * i] = [f"c{j}" for j in range(6 * i)]
        rows.append((500 - i, " ".join(chain)))
    other = [f"v{rng.randint(0, 10**6)}" for _ in range(150)]
    for i in range(150):
        copy = list(other)
        copy[rng.randrange(150)] = f"x{i}"
        rows.append((1000 + i, " ".join(copy)))
    rows += [(3000 + i, " ".join(base[:40] + [f"t{i}_{j}" for j in range(80)])) for i in range(40)]
    same(rows_of(near_dedup.components(frame(spark, rows))), brute.near(rows))


def test_near_dedup_two_of_a_hot_passage(spark):
    """Two documents are near copies by a passage that many documents have, none of which is near to another."""
    passage = " ".join(f"p{i}" for i in range(304))
    rows = [(i, passage + "".join(f" t{i}_{j}" for j in range(45 if i in (611, 742) else 112 + i % 9))) for i in range(900)]
    got = {r.doc_id: r.component_id for r in near_dedup.components(frame(spark, rows)).collect()}
    assert got == {i: 611 if i == 742 else i for i in range(900)}


def meeting(crowds, n=100):
    """Postings of one shingle: (crowd, label or null)."""
    return [("s", 9, c, n, 0, True, float(i), one) for i, (c, one) in enumerate(crowds)]


def test_near_dedup_pairs_grow_with_the_postings(spark):
    """Crowds of one label meet no longer, all others do, and a hub meets each crowd once."""
    crowds = [(f"m{i:03}", 1) for i in range(300)] + [("a", 2), ("b", 3), ("c", None), ("d", None)]
    schema = "shingle string, often long, crowd string, n int, place int, index boolean, weight double, one long"
    postings = spark.createDataFrame(meeting(crowds), schema)
    hubs = {(r.x, r.y) for r in near_dedup._with_hubs(postings).collect()}
    assert hubs == {("d", c) for c, _ in crowds if c != "d"}
    pairs = [(r.x, r.y) for r in near_dedup._first_meetings(postings).collect()]
    wanted = {tuple(sorted((a, b))) for a, p in crowds for b, q in crowds if a != b and (p is None or q is None or p != q)}
    assert len(pairs) == len(set(pairs)) and set(pairs) == wanted
    assert near_dedup._first_meetings(spark.createDataFrame(meeting(crowds[:300]), schema)).collect() == []


def test_near_dedup_crowd_around_a_hub(spark, monkeypatch):
    """Near copies of one text that are rarely near to each other: most of them are joined by hubs, not pair by pair."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 160):
        copy = list(base)
        for k in rng.sample(range(200), 4 + i % 3):
            copy[k] = f"x{rng.randrange(3)}"
        rows.append((i, " ".join(copy)))
    rows += [(1000 + i, " ".join(base[: 120 + i % 7] + [f"t{i % 5}_{j}" for j in range(80)])) for i in range(30)]
    compared, meet = [], near_dedup._first_meetings

    def counted(postings):
        compared.append((postings.count(), (pairs := meet(postings)).count()))
        return pairs

    monkeypatch.setattr(near_dedup, "_first_meetings", counted)
    same(rows_of(near_dedup.components(frame(spark, rows))), brute.near(rows))
    assert all(pairs <= postings for postings, pairs in compared) and sum(p for p, _ in compared)


def test_kept_documents(odd):
    rows, df = odd
    kept = near_dedup.keep_first(df)
    assert kept.columns == df.columns
    wanted = [r[0] for r in brute.near(rows) if r[0] is None or r[3]]
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, wanted))


def test_sentence_spans(odd):
    rows, df = odd
    same(rows_of(sentence_spans.report(df)), brute.spans(rows))


def test_sentence_spans_inside_long_sentences(spark):
    """A passage of 60 words without a mark is removed wherever it starts, but for a few words at its ends."""
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join(f"a{i}_{j}" for j in range(i)) + f" {passage} " + " ".join(f"z{i}_{j}" for j in range(30))) for i in range(26)]
    got = {r.doc_id: r for r in sentence_spans.report(frame(spark, rows)).collect()}
    assert got[0].text == rows[0][1] and got[0].n_removed == 0
    for i, text in rows[1:]:
        left = brute.words(got[i].text)
        assert [w for w in left if w[0] != "p"] == [w for w in brute.words(text) if w[0] != "p"]
        assert sum(w[0] == "p" for w in left) <= 20 and got[i].n_removed > 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sentence_spans_of_the_table(tables, sf):
    df = tables("documents", f"/root/testdata/{sf}")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    same(rows_of(sentence_spans.report(df)), brute.spans(rows))


def test_shortened_documents(odd, none):
    rows, df = odd
    short = sentence_spans.shorten_documents(df)
    assert short.dtypes == df.dtypes
    got = [(r.doc_id, r.text, r.n_chars) for r in short.collect()]
    same(got, [(d, t, None if t is None else len(t)) for d, _, _, t in brute.spans(rows)])
    assert sentence_spans.shorten_documents(none).collect() == []
