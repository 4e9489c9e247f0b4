"""Lexical search next to scoring every document."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from conftest import frame, same

from postmill.llm import lexical

COLUMNS = ("item_id", "rank", "doc_id", "score")


def rows_of(df):
    return [tuple(r[c] for c in COLUMNS) for r in df.collect()]


def corpus(seed, n):
    rng = random.Random(seed)
    known = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5))) for _ in range(300)] + ["É", "中文", "x9"]
    weights = [1 / (k + 1) for k in range(len(known))]
    rows = []
    for i in range(n):
        text = rng.choice([" ", "-", "\x00", "\n"]).join(rng.choices(known, weights, k=rng.randint(0, 80)))
        rows.append((i if i % 50 else None, None if i % 31 == 0 else text.upper() if i % 3 else text))
    return rows + rows[5:9], [(i % 12 if i % 12 else None, " ".join(rng.choices(known, weights, k=rng.randint(0, 25)))) for i in range(15)]


def items_of(spark, items):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, term int, times string")


@pytest.mark.parametrize("seed, shard, block", [(1, 16 << 20, 128), (2, 3000, 4), (3, 800, 2)])
def test_search(spark, monkeypatch, seed, shard, block):
    monkeypatch.setattr(lexical, "SHARD_BYTES", shard)
    monkeypatch.setattr(lexical, "BLOCK", block)
    rows, items = corpus(seed, 700)
    same(rows_of(lexical.report(frame(spark, rows).repartition(3), items_of(spark, items))), brute.ranked(rows, items))


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(lexical, "QUERY_ROWS", 30)
    rows, items = corpus(4, 300)
    same(rows_of(lexical.report(frame(spark, rows), items_of(spark, items), k=5)), brute.ranked(rows, items, k=5))


def test_odd_rows(odd, none, spark):
    rows, df = odd
    items = [(1, rows[0][1]), (2, None), (3, ""), (4, "Ünïcödé 中文 one ONE two"), (4, "same"), (5, "nowhere9999"), (None, "x y")]
    same(rows_of(lexical.report(df, items_of(spark, items))), brute.ranked(rows, items))
    assert rows_of(lexical.report(none, items_of(spark, items))) == []
    assert rows_of(lexical.report(df, items_of(spark, []))) == []
    assert rows_of(lexical.report(frame(spark, [(1, None), (2, "...")]), items_of(spark, items))) == []


def test_equal_scores_go_by_id(spark):
    rows = [(i, "the same words") for i in range(3000, 0, -1)] + [(None, "the same words"), (7000, "others here")]
    items = [(1, "same words"), (2, "others")]
    same(rows_of(lexical.report(frame(spark, rows).repartition(6), items_of(spark, items))), brute.ranked(rows, items))


def test_the_given_documents(tables):
    docs, items = tables("documents"), tables("benchmark")
    plain = brute.ranked([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    same(rows_of(lexical.report(docs, items)), plain)


def test_blocks_are_skipped():
    """A frequent term beside a rare one: only blocks that hold a candidate are unpacked."""
    rng = random.Random(1)
    texts = ["rare " * 5 + "often" if i in (700, 9000) else "often " + "filler " * rng.randint(1, 30) for i in range(20_000)]
    row = lexical.index_shard(pa.array(range(len(texts)), pa.int64()), pa.array(texts))
    corpus = lexical.Corpus(len(texts), sum(len(t.split()) for t in texts))
    shard = lexical.Shard(row, corpus)
    names = lexical._terms(row).to_pylist()
    lists = []
    for term, df in ((b"rare", 2), (b"often", len(texts))):
        place = names.index(term)
        weight = corpus.weight(df)
        a, b = shard.first_block[place : place + 2]
        lists.append((weight * int(shard.block_best[a:b].max()), weight, place))
    floor = lists[1][0] + 1
    docs, scores = shard.search(lists, floor)
    assert docs.tolist() == [700, 9000] and shard.unpacked <= 3
    every, all_scores = lexical.Shard(row, corpus).search(lists, 0)
    assert dict(zip(docs.tolist(), scores.tolist())).items() <= dict(zip(every.tolist(), all_scores.tolist())).items()
    assert np.all(np.sort(all_scores)[-2:] == np.sort(scores))
