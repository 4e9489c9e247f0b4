"""Pre-tokenization: texts cut into pieces that a tokenizer encodes independently, as whole-array operations.

Both public tokenizer files use one family of patterns: a contraction, a run of letters, of numbers, of anything else, or
of white space. Piece starts follow from the classes of neighbouring characters, so a batch of texts is cut by a few
array comparisons; equal pieces are then found by Arrow's dictionary encoding and handled once.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from tokenizers.pre_tokenizers import ByteLevel

from .arrow import process_cache

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
# White_Space of the Unicode character database.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# The contractions of the patterns.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def _classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(0x110000))
    for name, kind in (("L", LETTER), ("N", NUMBER)):
        for run in regex.finditer(rf"\p{{{name}}}+", every):
            table[run.start() : run.end()] = kind
    # Letters and numbers that Python's older tables lack: the library's own tables decide.
    split = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    for c in np.flatnonzero(table != OTHER).tolist():
        if unicodedata.category(chr(c)) == "Cn":
            sample = "a" if table[c] == LETTER else "1"
            if len(split(sample + chr(c))) > 1:
                table[c] = OTHER
    table[WHITE_SPACE] = SPACE
    return table


def char_classes() -> np.ndarray:
    return process_cache("char_classes", _classes)


def piece_starts(codes: np.ndarray, first: np.ndarray, attach_space: bool, single_numbers: bool):
    """(starts, classes): where pieces start in the code points of many texts; ``first`` marks each text's first one.

    With ``attach_space`` a space goes with the piece after it, and the rest of a run of white space is a piece.
    """
    kind = char_classes()[codes]
    starts = first.copy()
    starts[1:] |= kind[1:] != kind[:-1]
    if single_numbers:
        starts |= kind == NUMBER
    if attach_space:
        # The last white space before something else in the same text.
        last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first[1:])
        starts[last] = True
        starts[last + 1] = codes[last] != 0x20
    n = len(codes)
    marks = np.flatnonzero((codes[:-1] == 0x27) & (kind[1:] == LETTER) & ~first[1:]) if n > 1 else np.zeros(0, dtype=np.int64)
    # A lone mark at the start of a piece.
    marks = marks[starts[marks]]
    for tail in CONTRACTIONS:
        end = marks + 1 + len(tail)
        hit = end <= n
        for k, letter in enumerate(tail):
            at = np.minimum(marks + 1 + k, n - 1)
            hit &= (codes[at] == ord(letter)) & ((not k) | ~first[at])
        starts[marks[hit] + 1] = False
        stop = end[hit]
        starts[stop[stop < n]] = True
        marks, end = marks[~hit], None
    return starts, kind


class Cut:
    """The pieces of a batch of texts: ``codes[bounds[i]:bounds[i + 1]]`` index ``distinct`` for text i."""

    def __init__(self, codes, bounds, distinct):
        self.codes, self.bounds, self.distinct = codes, bounds, distinct


def cut(texts: list[str], specials: tuple[str, ...], attach_space: bool, single_numbers: bool, keep_space: bool) -> Cut:
    """Cut texts into pieces; a special string is a piece of its own."""
    parts, owners, special = [], [], []
    finder = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None
    for i, text in enumerate(texts):
        found = finder.split(text) if finder and any(s in text for s in specials) else [text]
        for k, part in enumerate(found):
            if part:
                parts.append(part)
                owners.append(i)
                special.append(bool(k % 2))
    joined = "".join(parts)
    if not joined:
        return Cut(np.zeros(0, dtype=np.int64), np.zeros(len(texts) + 1, dtype=np.int64), [])
    data = joined.encode("utf-8", "surrogatepass")
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    ends = np.cumsum(lengths)
    first = np.zeros(len(codes), dtype=bool)
    first[ends - lengths] = True
    starts, kind = piece_starts(codes, first, attach_space, single_numbers)
    for k in np.flatnonzero(special):
        starts[ends[k] - lengths[k] + 1 : ends[k]] = False
    at = np.flatnonzero(starts)
    raw = np.frombuffer(data, dtype=np.uint8)
    byte_at = at if len(data) == len(codes) else np.flatnonzero((raw & 0xC0) != 0x80)[at]
    offsets = np.append(byte_at, len(data)).astype(np.int32)
    pieces = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data))
    stops = np.append(at[1:], len(codes))
    owner_of = np.asarray(owners, dtype=np.int64)[np.searchsorted(ends, at, side="right")]
    if not keep_space:
        wanted = kind[at] != SPACE
        pieces, owner_of, at, stops = pieces.filter(pa.array(wanted)), owner_of[wanted], at[wanted], stops[wanted]
    coded = pieces.dictionary_encode()
    found = coded.indices.to_numpy(zero_copy_only=False)
    bounds = np.searchsorted(owner_of, np.arange(len(texts) + 1))
    # A place of each distinct piece, to take it out of the joined text.
    place = np.zeros(len(coded.dictionary), dtype=np.int64)
    place[found] = np.arange(len(found))
    distinct = [joined[a:b] for a, b in zip(at[place].tolist(), stops[place].tolist())]
    return Cut(found, bounds, distinct)


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Vocabulary of a tokenizer file: ids by token text, texts by id, and the special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        self.ids = content["model"]["vocab"]
        self.special_ids = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.tokens = {i: t for t, i in {**self.ids, **self.special_ids}.items()}
        self.specials = tuple(self.special_ids)
        self.letters = dict(enumerate(byte_letters()))

    def spell(self, piece: str) -> str:
        """A piece in byte letters."""
        if piece.isascii():
            return piece.translate(self.letters)
        return piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)


class Bounded(dict):
    """A cache that starts again when it is full, so a worker's memory stays bounded."""

    def __init__(self, most: int):
        self.most = most

    def make_room(self, n: int) -> bool:
        """Whether everything was forgotten to make room for ``n`` entries."""
        if len(self) + n <= self.most:
            return False
        self.clear()
        return True
