"""Many phrases in many texts at once: tokens by character classes, and a trie of phrases walked from all places together.

A trie is built once from a vocabulary. It is a handful of arrays (words, edges, ends), so a task walks it for all places of a
batch of texts step by step: the places that are still on a path of the trie shrink from word to word, and no row or string is
ever made for a run of words that is not in the vocabulary. Each text is read once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

_WORD, _PLUS, _JOIN, _SPACE, _OTHER = range(5)
CHUNK_BYTES = 4 << 20
_classes = {}


def _char_classes() -> np.ndarray:
    """A class for each code point: letters, numbers and _ make words, some marks join them, white space parts tokens."""
    if "table" not in _classes:
        table = np.full(0x110000, _OTHER, dtype=np.uint8)
        every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(0x110000))
        for run in regex.finditer(r"[\p{L}\p{N}_]+", every):
            table[run.start() : run.end()] = _WORD
        for marks, kind in (("+#", _PLUS), (".&'/-", _JOIN), (" \t\n\x0b\f\r", _SPACE)):
            table[[ord(c) for c in marks]] = kind
        _classes["table"] = table
    return _classes["table"]


class Tokens:
    """The tokens of many texts: ``codes[i]`` is token i's place in ``distinct``, ``bounds`` the first token of each text.

    A word may hold + # . ' & / - inside and + # at its end; any other mark is a token of its own.
    """

    def __init__(self, texts: list[str]):
        joined = "".join(texts)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        ends = np.cumsum(sizes)
        n = len(joined)
        if not n:
            self.codes, self.bounds = np.zeros(0, dtype=np.int64), np.zeros(len(texts) + 1, dtype=np.int64)
            self.distinct = pa.array([], pa.string())
            return
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kind = _char_classes()[points]
        first = np.zeros(n + 1, dtype=bool)
        first[ends - sizes] = True
        first[n] = True
        first = first[:n]
        owner = np.searchsorted(ends, np.arange(n), side="right").astype(np.int32)
        word = kind == _WORD
        joins = (kind == _PLUS) | (kind == _JOIN)
        # The characters around each run of joining marks, in the same text.
        here = np.arange(n)
        before = np.maximum.accumulate(np.where(joins, -1, here))
        behind = np.minimum.accumulate(np.where(joins, n, here)[::-1])[::-1]
        left = joins & (before >= 0)
        left[left] = word[before[left]] & (owner[before[left]] == owner[left])
        right = joins & (behind < n)
        right[right] = word[behind[right]] & (owner[behind[right]] == owner[right])
        plain = np.maximum.accumulate(np.where(kind == _PLUS, -1, here))
        member = word | (left & right) | (left & ~right & (kind == _PLUS) & (plain == before))
        single = ~member & (kind != _SPACE)
        inside = member | single
        starts = single | (member & (first | np.append(True, ~member[:-1])))
        at = np.flatnonzero(starts)
        data = joined.encode("utf-8", "surrogatepass")
        raw = np.frombuffer(data, dtype=np.uint8)
        if len(data) == n:
            kept, sizes_of = raw[inside], inside.astype(np.int64)
        else:
            lead = np.flatnonzero((raw & 0xC0) != 0x80)
            widths = np.diff(np.append(lead, len(data)))
            kept, sizes_of = raw[np.repeat(inside, widths)], widths * inside
        upto = np.append(0, np.cumsum(sizes_of))
        offsets = np.append(upto[at], upto[-1])
        words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(kept)))
        coded = words.dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.distinct = coded.dictionary.cast(pa.string())
        self.bounds = np.searchsorted(at, np.append(0, ends))


class PhraseTrie:
    """A trie over the words of phrases; equal phrases share an end."""

    def __init__(self, phrases: list[list[str]]):
        known = sorted({w for phrase in phrases for w in phrase})
        place = {w: i for i, w in enumerate(known)}
        self.words = pa.array(known, pa.string())
        self.longest = max(map(len, phrases), default=0)
        coded = [[place[w] for w in phrase] for phrase in phrases]
        node = np.zeros(len(phrases), dtype=np.int64)
        sizes = np.array([len(c) for c in coded], dtype=np.int64)
        edges, nodes, width = [], 1, max(1, len(known))
        ends = np.full(len(phrases), -1, dtype=np.int64)
        for depth in range(self.longest):
            on = np.flatnonzero(sizes > depth)
            keys = node[on] * width + np.array([coded[i][depth] for i in on], dtype=np.int64)
            distinct, where = np.unique(keys, return_inverse=True)
            node[on] = nodes + where
            edges.append(distinct)
            nodes += len(distinct)
            done = on[sizes[on] == depth + 1]
            ends[done] = node[done]
        # Nodes are numbered level by level, and so are their keys within each level.
        self.edges, self.width = np.concatenate(edges) if edges else np.zeros(0, dtype=np.int64), width
        self.level = np.cumsum([0] + [len(e) for e in edges])
        # The phrases that end at each node.
        whole = np.flatnonzero(ends >= 0)
        order = whole[np.argsort(ends[whole], kind="stable")]
        self.phrases = order
        self.first = np.searchsorted(ends[order], np.arange(nodes + 1))

    def walk(self, codes: np.ndarray, bounds: np.ndarray):
        """(text, place in the text, number of words, phrase) of all matches; ``codes`` are places in ``words``, or -1."""
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        at = np.flatnonzero(codes >= 0)
        node = np.zeros(len(at), dtype=np.int64)
        found = []
        for depth in range(self.longest):
            inside = at + depth < len(codes)
            at, node = at[inside], node[inside]
            next_code = codes[at + depth]
            alive = (next_code >= 0) & (owner[at + depth] == owner[at])
            at, node, next_code = at[alive], node[alive], next_code[alive]
            a, b = self.level[depth], self.level[depth + 1]
            keys = node * self.width + next_code
            step = np.minimum(np.searchsorted(self.edges[a:b], keys), max(0, b - a - 1))
            hit = self.edges[a:b][step] == keys if b > a else np.zeros(len(keys), dtype=bool)
            at, node = at[hit], a + step[hit] + 1
            if not len(at):
                break
            count = self.first[node + 1] - self.first[node]
            rows = np.repeat(np.arange(len(at)), count)
            place = self.first[node][rows] + np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
            found.append((owner[at][rows], (at - bounds[owner[at]])[rows], np.full(len(rows), depth + 1), self.phrases[place]))
        if not found:
            return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
        return tuple(np.concatenate(x) for x in zip(*found))

    def places(self, distinct) -> np.ndarray:
        """The place in ``words`` of each of some words, -1 for others."""
        return pc.fill_null(pc.index_in(distinct, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def first_matches(self, codes: np.ndarray, bounds: np.ndarray):
        """(text, phrase, place, number of words): the first match of each phrase in each text, shorter ones first."""
        text, place, size, phrase = self.walk(codes, bounds)
        order = np.lexsort((size, place, phrase, text))
        text, place, size, phrase = text[order], place[order], size[order], phrase[order]
        new = np.append(True, (text[1:] != text[:-1]) | (phrase[1:] != phrase[:-1])) if len(text) else np.zeros(0, dtype=bool)
        return text[new], phrase[new], place[new], size[new]


def chunks(batches, column: str = "text", max_bytes: int = CHUNK_BYTES):
    """Record batches cut to at most ``max_bytes`` of text, one row at least."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
