"""Whole-text copies in the suffix-array dedup, next to brute force."""

import random

import brute
from conftest import frame, same, sentence

from postmill.llm import suffix_dedup


def test_copies_among_null_and_repeated_ids(spark):
    """A copied text of a null id or of a repeated id does not take the other texts of that id with it."""
    rng = random.Random(4)
    one, two, three, four = (" ".join(sentence(rng, 12) for _ in range(4)) for _ in range(4))
    rows = [(3, one), (7, one), (7, two), (8, two + " End."), (None, one), (None, three), (None, four), (None, four), (9, "Start. " + three)]
    got = [tuple(r) for r in suffix_dedup.report(frame(spark, rows)).collect()]
    same(got, brute.repeats(rows))
