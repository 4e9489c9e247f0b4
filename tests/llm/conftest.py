import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, kept string, score int, size string, block string, "
    "label string, id long, run double, row string, _toxicity string, _near_id long, _sp_text string, _key int, _size int, "
    "toxic int, `a.b` string"
)


def frame(spark, rows, source=lambda i: f"s{i % 3}"):
    """Documents with columns whose names the operators use themselves."""
    data = [
        (d, t, "en", source(i), None if t is None else len(t), "k", i, "s", "b", None, i, 0.5, "r", "t", -i, "p", i, -7, i, "d")
        for i, (d, t) in enumerate(rows)
    ]
    return spark.createDataFrame(data, SCHEMA)


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n)).capitalize() + "."


def corpus(seed=7, n=60):
    """Texts with copies, near copies, shared passages, junk, nulls, empty and long texts, and repeated rows."""
    rng = random.Random(seed)
    passage = " ".join(sentence(rng, 11) for _ in range(6))
    rows = []
    for i in range(n):
        text = " ".join(sentence(rng, rng.randint(3, 14)) for _ in range(rng.randint(1, 14)))
        kind = i % 10
        if kind == 3 and rows[-2][1]:
            text = rows[-2][1]
        elif kind == 4 and rows[-2][1]:
            parts = rows[-2][1].split(" ")
            parts[len(parts) // 2] = "changed"
            text = " ".join(parts)
        elif kind == 6:
            text = f"{text}\n{passage}\n{text[:40]}"
        elif kind == 7:
            text = "Ünïcödé 中文 😀 " + text.upper() + " $$$ ### | |"
        rows.append((i, text))
    rows += [
        (1000, None), (1001, ""), (1002, " \n\t "), (1003, "one two"), (1004, "one two"), (1005, "ONE  two"),
        (1006, "a" * 400), (1007, "ab" * 300), (1008, "same line here\n" * 30), (1009, "x\x00y " * 40),
        (1010, " ".join(sentence(rng, 9) for _ in range(900))), (None, rows[0][1]), (None, None), rows[5], rows[5],
        (1011, "<|endoftext|>it's<|endoftext|> 'll o'clock <|startoftext|>"),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    rows = corpus()
    return rows, frame(spark, rows)


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def tables(spark):
    def read(name, sf="/root/testdata/sf0.001"):
        return spark.read.parquet(f"{sf}/{name}.parquet")

    return read


def labels_for(spark, rows, toxic=lambda d: 0, quality=lambda d: 1):
    ids = sorted({d for d, _ in rows if d is not None})
    return spark.createDataFrame(
        [(d, quality(d), toxic(d)) for d in ids] + [(None, 1, 1), (99999, None, None)], "doc_id long, quality int, toxic int"
    )


def pairs(df, *names):
    return sorted(map(str, (tuple(r[n] for n in names) for r in df.collect())))


def same(found, wanted):
    assert sorted(map(str, found)) == sorted(map(str, wanted))
