"""Byte pair encoding by tree concatenation, and decoding.

A long piece that the pre-tokenizer leaves unsplit is cut into halves down to ``LEAF`` letters. All leaves of a batch are
encoded side by side; then neighbours are joined level by level. At a
join, a window of a few tokens on both sides is encoded again and grows until it has a token in common (same place, same
id) with the left half and, behind it, one in common with the right half; there the three sequences are spliced. Every
two neighbours of the spliced sequence are neighbours in an encoding, which makes it the encoding of the whole.
Windows that reach both outer ends hold the whole piece, so the growth always ends.

Defined results: a null text is empty and has no tokens; repeated rows and null ids are encoded like any other row; a very
long text is encoded whole; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .arrow import forget_caches, library_in_one_thread, process_cache, slices, strings
from .pieces import Bounded, Vocabulary, cut

TOKENIZER = "word_bpe_49k.json"
# Letters of a leaf, and tokens on each side of a join that are encoded again at first.
LEAF = 16
WINDOW = 2
# What a worker keeps of earlier texts: pieces and their letters.
CACHED_PIECES, CACHED_LETTERS = 100_000, 4 << 20
# Text of one step.
CHUNK_BYTES = 2 << 20
WORD_END = "</w>"
# Composed Latin text: composition changes nothing here and lower case has no context.
_NOT_PLAIN = regex.compile("[ɐ-\U0010ffff]")


class TreeEncoder:
    def __init__(self, path: str, leaf: int = LEAF, window: int = WINDOW):
        library_in_one_thread()
        self.words = Vocabulary(path)
        library = Tokenizer.from_file(path)
        self.normalizer = library.normalizer
        # The merges alone, without normalizer and pre-tokenizer.
        self.merges = library.model
        self.sizes = {i: len(t) for i, t in self.words.tokens.items()}
        self.leaf, self.window = leaf, window
        self.known = Bounded(CACHED_PIECES)
        self.letters = 0

    def normalize(self, text: str) -> str:
        if _NOT_PLAIN.search(text) is None:
            return text.lower()
        return self.normalizer.normalize_str(text)

    def prepare(self, text: str) -> str:
        """A normalized text; special strings stay as they are."""
        for special in self.words.specials:
            if special in text:
                return special.join(self.prepare(part) for part in text.split(special))
        return self.normalize(text)

    def _ids(self, spelled: list[str]) -> list[list[int]]:
        """Ids of texts in byte letters, each by the library's merges."""
        tokenize = self.merges.tokenize
        return [[t.id for t in tokenize(text)] for text in spelled]

    def _encode(self, spelled: list[str]) -> list[tuple[list[int], list[int]]]:
        """(ids, start of each token) of texts in byte letters."""
        out = []
        for text, ids in zip(spelled, self._ids(spelled)):
            starts, at = [], 0
            for token in ids:
                starts.append(at)
                at += self.sizes[token]
            # Only the last token carries the mark of a word's end.
            if at - len(WORD_END) != len(text):
                raise ValueError("a letter is not in the vocabulary")
            out.append((ids, starts))
        return out

    def encode_pieces(self, spelled: list[str]) -> list[list[int]]:
        """Ids of pieces in byte letters."""
        out = [None] * len(spelled)
        short = [i for i, text in enumerate(spelled) if len(text) <= self.leaf]
        for i, ids in zip(short, self._ids([spelled[i] for i in short])):
            out[i] = ids
        nodes = []  # (piece, first letter, end) of the leaves of longer pieces, in order
        for i, text in enumerate(spelled):
            if out[i] is not None:
                continue
            stack = [(0, len(text))]
            while stack:
                start, end = stack.pop()
                if end - start <= self.leaf:
                    nodes.append((i, start, end))
                else:
                    middle = (start + end) // 2
                    stack += [(middle, end), (start, middle)]
        encoded = self._encode([spelled[i][a:b] for i, a, b in nodes])
        level = [(i, a, b, ids, [a + s for s in starts]) for (i, a, b), (ids, starts) in zip(nodes, encoded)]
        while True:
            merged, joins = [], []
            k = 0
            while k < len(level):
                if k + 1 < len(level) and level[k][0] == level[k + 1][0]:
                    joins.append((len(merged), level[k], level[k + 1]))
                    merged.append(None)
                    k += 2
                else:
                    merged.append(level[k])
                    k += 1
            if not joins:
                break
            self._join(spelled, joins, merged)
            level = merged
        for node in level:
            out[node[0]] = node[3]
        return out

    def _join(self, spelled, joins, merged) -> None:
        """Splice neighbours; all windows of a round are encoded together."""
        grown = self.window
        while joins:
            windows = []
            for _, left, right in joins:
                a = left[4][max(0, len(left[4]) - grown)]
                b = right[4][grown] if grown < len(right[4]) else right[2]
                windows.append((a, b))
            texts = [spelled[left[0]][a:b] for (_, left, _), (a, b) in zip(joins, windows)]
            again = []
            for (place, left, right), (a, b), (ids, starts) in zip(joins, windows, self._encode(texts)):
                starts = [a + s for s in starts]
                spliced = _splice(left, right, ids, starts, a, b)
                if spliced is None:
                    again.append((place, left, right))
                else:
                    merged[place] = (left[0], left[1], right[2], *spliced)
            joins, grown = again, grown * 2

    def encode(self, pieces: list[str]) -> list[tuple[int, bytes, bytes]]:
        """(number of tokens, decimal ids, token texts), each joined by spaces, of normalized pieces."""
        known = self.known
        out = [known.get(p) for p in pieces]
        fresh = [i for i, v in enumerate(out) if v is None]
        if known.make_room(len(fresh)) or self.letters > CACHED_LETTERS:
            known.clear()
            self.letters = 0
        self.letters += sum(len(pieces[i]) for i in fresh)
        special = self.words.special_ids
        plain = [i for i in fresh if pieces[i] not in special]
        for i, ids in zip(plain, self.encode_pieces([self.words.spell(pieces[i]) for i in plain])):
            out[i] = known[pieces[i]] = (len(ids), " ".join(map(str, ids)).encode(), self.decode(ids).encode())
        for i in fresh:
            if out[i] is None:
                ids = [special[pieces[i]]]
                out[i] = known[pieces[i]] = (1, str(ids[0]).encode(), self.decode(ids).encode())
        return out

    def decode(self, ids: list[int]) -> str:
        """The file has no decoder: token texts joined by spaces, special tokens kept."""
        tokens = self.words.tokens
        return " ".join([tokens[i] for i in ids])


def _splice(left, right, ids, starts, a, b):
    """(ids, starts) of both halves around the window [a, b), or None if the window has to grow."""
    left_ids, left_starts = left[3], left[4]
    right_ids, right_starts = right[3], right[4]
    begins = dict(zip(starts, range(len(starts))))
    ends = [*starts[1:], b]
    # The window's first token that the left half has too; the last token of each half may miss letters.
    if a == left[1]:
        head, own = 0, 0
    else:
        head = None
        left_ends = [*left_starts[1:], left[2]]
        for k in range(max(0, np.searchsorted(left_starts, a)), len(left_starts) - 1):
            w = begins.get(left_starts[k])
            if w is not None and ids[w] == left_ids[k] and ends[w] == left_ends[k]:
                head, own = k, w
                break
        if head is None:
            return None
    if b == right[2]:
        return left_ids[:head] + ids[own:], left_starts[:head] + starts[own:]
    right_ends = [*right_starts[1:], right[2]]
    for k in range(len(right_starts) - 1):
        if right_starts[k] >= b:
            break
        w = begins.get(right_starts[k])
        if w is not None and w >= own and ids[w] == right_ids[k] and ends[w] == right_ends[k]:
            return left_ids[:head] + ids[own:w] + right_ids[k:], left_starts[:head] + starts[own:w] + right_starts[k:]
    return None


def encode_documents(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, n_tokens, and the hashes of the ids and of the decoded text, one row per row of ``docs``."""
    path = public_tokenizers.path(tokenizer)

    def run(batches):
        # Earlier operators of a worker may have left their caches.
        forget_caches(f"tree_encoder_{tokenizer}", "char_classes")
        pa.default_memory_pool().release_unused()
        encoder = process_cache(f"tree_encoder_{tokenizer}", lambda: TreeEncoder(path))
        for part in slices(batches, max_bytes=CHUNK_BYTES):
            texts = [encoder.prepare(t) for t in strings(part.column("text"))]
            found = cut(texts, encoder.words.specials, False, True, False)
            table = encoder.encode(found.distinct)
            counts = np.array([t[0] for t in table], dtype=np.int64)
            ids, tokens = [t[1] for t in table], [t[2] for t in table]
            n_tokens, id_hashes, text_hashes = [], [], []
            for i in range(len(texts)):
                codes = found.codes[found.bounds[i] : found.bounds[i + 1]]
                n_tokens.append(int(counts[codes].sum()) if len(codes) else 0)
                codes = codes.tolist()
                id_hashes.append(hashlib.sha256(b" ".join([ids[c] for c in codes])).hexdigest())
                text_hashes.append(hashlib.sha256(b" ".join([tokens[c] for c in codes])).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n_tokens, pa.int64()), pa.array(id_hashes, pa.string()),
                 pa.array(text_hashes, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    return docs.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
