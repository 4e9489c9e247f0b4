"""Token counts, encoding and id files next to the library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from postmill.llm import bpe, id_files, pieces, token_counts

BYTE, WORD = (Tokenizer.from_file(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def texts(n=3000):
    rng = random.Random(5)
    parts = list("abstreveeeeaaaa'  .,!!0123éßΣΑİ中\n\t\x1c") + [
        "<|endoftext|>", "<|startoftext|>", "the", "ing", "x" * 40, "ab" * 60, "=-" * 30, "'s", "'re", "　", "한국", "😀"
    ]
    return ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(n)] + ["a" * 5000, "ab" * 4000, "é" * 2000, "-" * 3000]


def test_pieces_are_the_library_s():
    plain = [t for t in texts() if "<|" not in t]
    found = pieces.cut(plain, (), True, False, True)
    for i, text in enumerate(plain):
        mine = [found.distinct[c] for c in found.codes[found.bounds[i] : found.bounds[i + 1]]]
        assert mine == [text[a:b] for _, (a, b) in BYTE.pre_tokenizer.pre_tokenize_str(text)]


def test_counts_of_every_prefix():
    counter = token_counts.PrefixCounter(public_tokenizers.path("byte_bpe_50k.json"))
    merges = Tokenizer(BYTE.model)
    for piece in ("understandable", " internationalization", "aaaaaaaaaaaaaaaaa", " été", "12345678", "中文"):
        spelled = counter.words.spell(piece)
        counts = counter.counts(spelled)
        assert counts == [len(merges.encode(spelled[:n], add_special_tokens=False).ids) for n in range(len(spelled) + 1)]


def test_token_counts(odd, none):
    rows, df = odd
    got = sorted(str(tuple(r)[:4]) for r in token_counts.count_tokens(df).collect())
    wanted = []
    for d, t in rows:
        n = len(BYTE.encode(t or "", add_special_tokens=False).ids)
        wanted.append(str((d, len((t or "").encode()), n, n > 512)))
    assert got == sorted(wanted)
    assert token_counts.count_tokens(none).collect() == []


def test_longest_prefix_within_the_limit(odd):
    rows, df = odd
    by_text = {r[0]: r for r in rows if r[0] is not None}
    for r in token_counts.count_tokens(df, limit=40).collect():
        if r.doc_id is None or r.n_tokens <= 40:
            continue
        data = (by_text[r.doc_id][1] or "").encode()
        assert len(BYTE.encode(data[: r.fit_bytes].decode(), add_special_tokens=False).ids) <= 40 and r.fit_bytes > 0


def test_whole_texts_by_the_library():
    counter = token_counts.PrefixCounter(public_tokenizers.path("byte_bpe_50k.json"))
    encode = id_files.PieceIds(public_tokenizers.path("byte_bpe_50k.json"))
    all_texts = texts()
    found = pieces.cut(all_texts, counter.words.specials, True, False, True)
    totals = counter.totals_of(found.distinct)
    ids, counts = encode(all_texts)
    at = 0
    for i, want in enumerate(BYTE.encode_batch(all_texts, add_special_tokens=False)):
        assert int(totals[found.codes[found.bounds[i] : found.bounds[i + 1]]].sum()) == len(want.ids)
        assert ids[at : at + counts[i]].tolist() == [*want.ids, id_files.END_ID]
        at += counts[i]


@pytest.mark.parametrize("leaf", [4, 16, 64])
def test_tree_encoding(leaf):
    encoder = bpe.TreeEncoder(public_tokenizers.path("word_bpe_49k.json"), leaf=leaf, window=1)
    all_texts = texts()
    found = pieces.cut([encoder.prepare(t) for t in all_texts], encoder.words.specials, False, True, False)
    table = encoder.encode(found.distinct)
    for i, want in enumerate(WORD.encode_batch(all_texts, add_special_tokens=False)):
        mine = [table[c] for c in found.codes[found.bounds[i] : found.bounds[i + 1]]]
        assert b" ".join(m[1] for m in mine).decode() == " ".join(map(str, want.ids))
        assert b" ".join(m[2] for m in mine).decode() == WORD.decode(want.ids, skip_special_tokens=False)


def test_encoded_documents(odd, none):
    rows, df = odd
    wanted = []
    for d, t in rows:
        ids = WORD.encode(t or "", add_special_tokens=False).ids
        hashes = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), WORD.decode(ids, skip_special_tokens=False))]
        wanted.append(str((d, len(ids), *hashes)))
    assert sorted(str(tuple(r)) for r in bpe.encode_documents(df).collect()) == sorted(wanted)
    assert bpe.encode_documents(none).collect() == []


@pytest.mark.parametrize("block", [1, 7, 256, 2048])
def test_round_trip_of_blocks(block):
    rng = np.random.default_rng(1)
    for ids in (np.array([0]), np.array([5, 5, 5]), rng.integers(0, 50257, 700), np.zeros(900, int), rng.integers(0, 9, 513),
                rng.integers(0, 1 << 24, 300), (rng.pareto(0.7, 4000) * 10).astype(int) % 50257):
        classes, blocks = id_files.encode_ids(ids, block)
        assert (id_files.decode_ids(classes, blocks) == ids).all()
    # Repetition and low ids cost little.
    assert sum(len(p) for _, p in id_files.encode_ids(np.tile(rng.integers(0, 50257, 20), 200), 2048)[1]) < 4000


def test_known_pieces_need_no_room():
    encode = id_files.PieceIds(public_tokenizers.path("byte_bpe_50k.json"))
    encode.known = pieces.Bounded(10)
    asked, library = [], encode._encode
    encode._encode = lambda new: asked.extend(new) or library(new)
    text = "one two three four five six seven"
    for _ in range(2):
        assert encode([text])[0].tolist() == [*BYTE.encode(text, add_special_tokens=False).ids, id_files.END_ID]
    assert sorted(asked) == sorted(set(asked))
    # Unknown ones that do not fit start the cache again, with what is known of them.
    more = text + " eight nine ten eleven"
    assert encode([more])[0].tolist() == [*BYTE.encode(more, add_special_tokens=False).ids, id_files.END_ID]


def test_a_usual_shard_is_one_file():
    # Ids of usual texts are 0.42 a byte; a small second file costs a task nearly as many steps as the first.
    assert id_files.FILE_IDS >= 0.45 * id_files.SHARD_BYTES


def test_damaged_files_are_noticed():
    ids = np.arange(3000) % 977
    data = id_files.write_file([4, None], np.array([2000, 1000]), ids)
    docs, lengths, back = id_files.read_file(data)
    assert (docs, lengths.tolist()) == ([4, None], [2000, 1000]) and (back == ids).all()
    for place in (0, 9, 30, len(data) // 2, len(data) - 1):
        broken = data[:place] + bytes([data[place] ^ 1]) + data[place + 1 :]
        with pytest.raises(ValueError):
            id_files.read_file(broken)
    with pytest.raises(ValueError):
        id_files.read_file(data[:10])


def test_id_files(odd, none, monkeypatch):
    rows, df = odd
    monkeypatch.setattr(id_files, "SHARD_BYTES", 9000)
    got = sorted(id_files.report(df).collect(), key=lambda r: r.start)
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))
    start = 0
    for r, (d, t) in zip(got, ordered):
        ids = [*BYTE.encode(t or "", add_special_tokens=False).ids, id_files.END_ID]
        assert (r.doc_id, r.start, r.n_tokens) == (d, start, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        start += len(ids)
    assert len(got) == len(ordered)
    assert id_files.report(none).collect() == []
