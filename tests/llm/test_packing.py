"""Best-fit packing next to a plain best fit over the documents."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from conftest import frame
from tokenizers import Tokenizer

from postmill.llm import packing

BYTE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def best_fit(lengths, limit):
    """Number of sequences of best fit, longest first, one piece at a time."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fitting = [r for r in rooms if r >= n]
        if fitting:
            rooms[rooms.index(min(fitting))] -= n
        else:
            rooms.append(limit - n)
    return len(rooms)


def lay_out(runs):
    """{sequence: [(offset, length)]} of a plan."""
    found = defaultdict(list)
    for length, first, after, sequence, each, offset in runs:
        for step in range(after - first):
            found[sequence + step // each].append((offset + step % each * length, length))
    return found


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_best_fit(seed):
    rng = random.Random(seed)
    limit = rng.choice([7, 16, 50, 200])
    lengths = [min(limit, max(1, int(rng.paretovariate(0.8)))) for _ in range(rng.randint(1, 600))]
    runs = packing.plan_lengths(Counter(lengths), limit)
    found = lay_out(runs)
    assert Counter(n for places in found.values() for _, n in places) == Counter(lengths)
    for places in found.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= limit
    assert len(found) == best_fit(lengths, limit)


def test_plan_grows_with_lengths_only():
    """A billion pieces of each length: the plan stays small."""
    runs = packing.plan_lengths({n: 10**9 + n for n in range(1, 2049)})
    assert len(runs) < 70_000
    assert packing.plan_lengths({}) == []


def check(rows, got, limit):
    docs = Counter()
    at = defaultdict(list)
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        at[r.sequence_id].append((r.offset, r.length))
    for d, t in rows:
        ids = [*BYTE.encode(t or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % limit + 1
        start, n, k = 0, first, 0
        while start < len(ids):
            docs[d, k, start, n, zlib.crc32(np.array(ids[start : start + n], dtype="<u4").tobytes())] += 1
            start, n, k = start + n, limit, k + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == docs
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= limit
    assert len(at) == best_fit([r.length for r in got], limit)


def test_packed_documents(odd, none, monkeypatch):
    rows, df = odd
    monkeypatch.setattr(packing, "CELL", 4)
    check(rows, packing.report(df.repartition(5), limit=64).collect(), 64)
    check(rows, packing.report(df).collect(), 2048)
    assert packing.report(none).collect() == []


def test_a_hot_length(spark):
    rows = [(i, None if i % 3 else "a few words of text " * (i % 7)) for i in range(3000)]
    check(rows, packing.report(frame(spark, rows).repartition(7)).collect(), 2048)


def test_the_given_documents(tables):
    docs = tables("documents")
    check([tuple(r) for r in docs.select("doc_id", "text").collect()], packing.report(docs).collect(), 2048)
