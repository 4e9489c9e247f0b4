"""Collocations next to counting every phrase."""

import random
from collections import Counter

import brute
import numpy as np
import pytest
from conftest import frame, same

from postmill.llm import collocations as C

COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def texts(seed, n, words=40):
    """Texts with frequent words, passages that repeat, marks and odd blanks."""
    rng = random.Random(seed)
    known = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 4))) for _ in range(words)] + ["É", "中文", "x\x01y", "ÀB"]
    passage = " ".join(rng.choices(known, k=9))
    out = []
    for i in range(n):
        parts = rng.choices(known, weights=[1 / (k + 1) for k in range(len(known))], k=rng.randint(0, 60))
        text = "".join(p + rng.choice([" ", "  ", "\t", ". ", " \n", ", "] + [" "] * 9) for p in parts)
        lang = rng.choice(["en", "en", "de", None, "und", ""])
        out.append((lang, None if i % 17 == 0 else text + (passage.upper() if i % 5 == 0 else "")))
    return out


def docs_of(spark, rows):
    data = [(i, t, lang, 1, "x", 2) for i, (lang, t) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, n int, phrase string, part int")


def rows_of(df):
    return [tuple(r[c] for c in COLUMNS) for r in df.collect()]


@pytest.mark.parametrize("seed, part_words", [(1, 1 << 20), (2, 700), (3, 150)])
def test_collocations(spark, monkeypatch, seed, part_words):
    """With few words a task, leading words are hot and phrases of hot words are spread."""
    monkeypatch.setattr(C, "PART_WORDS", part_words)
    rows = texts(seed, 400)
    found = rows_of(C.collocations(docs_of(spark, rows).repartition(5)))
    same(found, brute.collocations(rows))
    assert found


def test_limits(spark):
    rows = texts(4, 200)
    docs = docs_of(spark, rows)
    same(rows_of(C.collocations(docs, least=3, top=7)), brute.collocations(rows, least=3, top=7))


def test_a_crowd_of_copies(spark):
    """One passage in every document, and one word over and over."""
    rows = [("en", "one and the same line of words in all of them\n" + "again " * (i % 9)) for i in range(1500)]
    same(rows_of(C.collocations(docs_of(spark, rows).repartition(9))), brute.collocations(rows))


def test_odd_rows(odd, none, spark):
    rows, df = odd
    same(rows_of(C.collocations(df, least=2)), brute.collocations([("en", t) for _, t in rows], least=2))
    assert rows_of(C.collocations(none)) == []
    assert rows_of(C.collocations(frame(spark, [(1, None), (2, ""), (3, " . ")]))) == []


def test_one_very_long_text(spark):
    rows = [("en", "so it goes on and on " * 30_000)]
    same(rows_of(C.collocations(docs_of(spark, rows))), brute.collocations(rows))


@pytest.mark.parametrize("seed", range(20))
def test_sort_finds_frequent_prefixes(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 400))
    windows = rng.integers(0, rng.integers(2, 9), (4, n))
    ends = rng.integers(2, 5, n)
    windows[np.arange(4)[:, None] >= ends] = -1
    times, hot = rng.integers(1, 4, n), rng.random(9) < 0.3
    counts = Counter()
    for i in range(n):
        for k in range(2, int(ends[i]) + 1):
            counts[tuple(windows[:k, i].tolist())] += int(times[i])
    found = {tuple(windows[:k, row].tolist()): c for row, k, c in C.frequent_prefixes(windows, times, hot, 8)}
    assert all(counts[p] == c for p, c in found.items())
    wanted = {p for p, c in counts.items() if c >= 8 or (len(p) < 4 and hot[list(p)].all())}
    assert set(found) == wanted


def test_the_given_documents(tables):
    docs = tables("documents")
    same(rows_of(C.collocations(docs)), brute.collocations([(r.lang, r.text) for r in docs.collect()]))
