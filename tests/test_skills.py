import random

import numpy as np
from pyspark.sql import functions as F

from postmill.operators import skills as K
from postmill.operators.phrases import PhraseTrie, Tokens


def _vocab(spark, *groups):
    return K.vocabulary(*[
        spark.createDataFrame([(s, i) for i, s in enumerate(group)], "skill string, line long") for group in groups
    ])


def _extract(spark, vocab, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return {r["id"]: r["skills"] for r in K.extract_skills(docs, vocab, **options).collect()}


def test_fixture_cases(spark):
    vocab = _vocab(spark, ["Python", "Atlassian JIRA", "Python", " ", "C++", "C#", "C"], ["BitBake", "JSON", "python"])
    got = _extract(spark, vocab, [
        "Experience with Python and Atlassian JIRA and Python preferred",
        "BitBake and JSON experience required",
        "   ",
        "Knows c++, C# and (C).",
        "pythonic jsonx",
    ])
    assert got == {0: ["Python", "Atlassian JIRA"], 1: ["BitBake", "JSON"], 2: [], 3: ["C++", "C#", "C"], 4: []}


def test_lemma_stage(spark):
    vocab = _vocab(spark, ["Software Engineer", "Python"])
    got = _extract(spark, vocab, ["Software Engineers build Python systems"], lemmas=True)
    assert got[0] == ["Python", "Software Engineer"]


def test_first_spelling_wins(spark):
    rows = _vocab(spark, ["Json", "Go"], ["JSON", "Rust"]).collect()
    assert {r["skill"] for r in rows} == {"Json", "Go", "Rust"}


def test_large_vocabulary_path_gives_the_same(spark, monkeypatch):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    skills = sorted({" ".join(rng.choices(words, k=rng.choice([1, 2, 3]))) for _ in range(80)})
    texts = [" ".join(rng.choices(words, k=200)) for _ in range(20)]
    vocab = _vocab(spark, skills)
    small = _extract(spark, vocab, texts)
    monkeypatch.setattr(K, "is_small", lambda df: False)
    assert _extract(spark, vocab, texts) == small
    wanted = {}
    for i, text in enumerate(texts):
        tokens = text.split()
        seen = {}
        for at in range(len(tokens)):
            for size in (1, 2, 3):
                phrase = " ".join(tokens[at:at + size])
                if phrase in skills and at + size <= len(tokens):
                    seen.setdefault(phrase, (at, size))
        wanted[i] = sorted(seen, key=seen.get)
    assert small == wanted


def test_read_vocabulary(spark, tmp_path):
    technical = tmp_path / "technical.csv"
    technical.write_text("﻿Example,Skill Name\n,Python\nGo,x\n", encoding="utf-8")
    keywords = tmp_path / "keywords.csv"
    keywords.write_text("python\nJSON\n\n")
    got = {r["skill"] for r in K.read_vocabulary(spark, str(technical), str(keywords)).collect()}
    assert got == {"Python", "Go", "JSON"}
    assert K.read_vocabulary(spark, str(technical), str(tmp_path / "none.csv")).count() == 2


def test_tokens_are_those_of_the_pattern(spark):
    rng = random.Random(3)
    parts = list("ab1_ \t\n.+#'&/-!,éßΣ中😀\x0b\x1c") + ["c++", "c#", "node.js", "ci/cd", "a--", "x+#.y", " "]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(3000)] + ["", "a" * 5000, "+" * 500, "a+" * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    wanted = {r["id"]: r["w"] for r in df.select("id", K.phrase_tokens(F.col("text")).alias("w")).collect()}
    found = Tokens([t.lower() for t in texts])
    names = found.distinct.to_pylist()
    for i in range(len(texts)):
        assert [names[c] for c in found.codes[found.bounds[i]:found.bounds[i + 1]]] == wanted[i], texts[i]


def test_lemma_of_is_the_lemma_expression(spark):
    words = ["a", "is", "cities", "class", "bus", "this", "boxes", "churches", "wishes", "glasses", "cats", "cat", "ies", "sses",
             "séries", "éxes", "axes", "s", "sss", "ss", "tries"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(K.lemma(F.col("w"))).collect()] == [K.lemma_of(w) for w in words]


def test_trie_finds_every_phrase():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(12)]
    phrases = [tuple(rng.choices(words, k=rng.randint(1, 4))) for _ in range(150)]
    trie = PhraseTrie([list(p) for p in phrases])
    texts = [" ".join(rng.choices([*words, "other"], k=rng.randint(0, 40))) for _ in range(80)]
    tokens = Tokens(texts)
    text, place, size, phrase = trie.walk(trie.places(tokens.distinct)[tokens.codes], tokens.bounds)
    wanted = sorted(
        (i, at, len(p), k) for i, t in enumerate(texts) for k, p in enumerate(phrases) for at in range(len(t.split()))
        if tuple(t.split()[at:at + len(p)]) == p
    )
    assert sorted(zip(text.tolist(), place.tolist(), size.tolist(), phrase.tolist())) == wanted
    assert PhraseTrie([]).walk(np.array([-1, -1]), np.array([0, 2]))[0].size == 0


def test_parts_and_salts_of_a_large_vocabulary_give_the_same(spark, monkeypatch):
    """A first word in a third of all places, many parts, several salts, both stages."""
    rng = random.Random(5)
    words = ["hot"] * 20 + [f"word{i}s" for i in range(40)] + ["glasses", "c++"]
    skills = sorted({" ".join(rng.choices(words, k=rng.choice([1, 2, 3]))) for _ in range(120)}) + ["Glass", "word3"]
    texts = [" ".join(rng.choices(words, k=150)) for _ in range(25)] + ["", None]
    vocab = _vocab(spark, skills)
    small = _extract(spark, vocab, texts, lemmas=True)
    monkeypatch.setattr(K, "is_small", lambda df: False)
    monkeypatch.setattr(K, "PART_KEYS", 13)
    monkeypatch.setattr(K, "PART_PLACES", 100)
    assert _extract(spark, vocab, texts, lemmas=True) == small


def test_matching_small_vocabularies_has_no_exchange(spark):
    docs = spark.createDataFrame([(1, "Python and Go")], "id int, text string")
    plan = K.extract_skills(docs, _vocab(spark, ["Python"]))._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_lines_follow_the_names_of_files(spark, tmp_path):
    folder = tmp_path / "technical"
    folder.mkdir()
    for name, size in (("a", 2000), ("b", 3), ("c", 900)):
        rows = "".join(f"{name.upper()}Skill{i}\n" for i in range(size))
        (folder / f"{name}.csv").write_text(f"Example\n{name}First\n{rows}{'SAME' if name == 'a' else 'Same'}\n")
    got = {r["skill"] for r in K.read_vocabulary(spark, str(folder)).collect()}
    assert "SAME" in got and "Same" not in got
