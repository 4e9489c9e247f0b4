"""The pipeline, stage by stage next to plain versions on the rows that its predecessor kept."""

import hashlib

import brute
import numpy as np
import public_tokenizers
from conftest import frame
from tokenizers import Tokenizer

import corpus_pipeline
from postmill.llm import mixing, toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "minhash_near_dedup", "sentence_span_dedup", "source_mix", "bpe_encoding"]

    def step(name, df):
        stages[name](spark, df, SF).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    weights, intercept = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {
        r.doc_id for r in docs.collect()
        if sum(float(weights[b]) for b in set(toxicity.bins_of(r.text).tolist())) + intercept < 0
    }
    docs = step("toxicity", docs)
    assert docs.columns == columns and {r.doc_id for r in docs.collect()} == want and 150 < len(want) < 200

    want = {r[0] for r in brute.near([(r.doc_id, r.text) for r in docs.collect()]) if r[3]}
    docs = step("minhash_near_dedup", docs)
    assert docs.columns == columns and {r.doc_id for r in docs.collect()} == want

    want = {(d, t, len(t)) for d, _, _, t in brute.spans([(r.doc_id, r.text) for r in docs.collect()])}
    docs = step("sentence_span_dedup", docs)
    assert docs.columns == columns and {(r.doc_id, r.text, r.n_chars) for r in docs.collect()} == want

    rows = docs.collect()
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + len(brute.words(r.text))
    order = sorted(sizes)
    targets = dict(zip(order, brute.fill([sizes[s] for s in order])))
    want = []
    for source in order:
        whole, rest = divmod(int(targets[source]), sizes[source])
        mine = sorted((r for r in rows if r.source == source), key=lambda r: hashlib.md5(f"{mixing.SEED}:{r.doc_id}".encode()).hexdigest())
        for r in mine:
            size = len(brute.words(r.text))
            part = min(size, max(rest, 0))
            rest -= size
            want += [r.doc_id] * (int(((whole * size + part) * 2 + size) // (size * 2)) if size else 0)
    docs = step("source_mix", docs)
    assert docs.columns == columns and sorted(r.doc_id for r in docs.collect()) == sorted(want)

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for r in docs.collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()))
    docs = step("bpe_encoding", docs)
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in docs.collect()) == sorted(want)


def test_stages_take_odd_rows(spark, odd, none):
    rows, df = odd
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, df, SF)
        assert result.count() > 0 and (name == "bpe_encoding" or result.columns == df.columns)
        assert stage(spark, none, SF).count() == 0


def test_the_whole_run(spark):
    result = corpus_pipeline.run(spark, SF)
    assert result.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and result.count() > 100
    assert np.array([r.n_tokens for r in result.collect()]).min() > 0
