"""Token counts by prefix dynamic programming.

A piece's byte pair encoding is the one chain of vocabulary tokens in which every two neighbours are the encoding of
their own concatenation. So the last token of each prefix follows from the last tokens of shorter prefixes, and one pass
over a piece stores the exact number of tokens of every prefix. Totals, budgets and truncation points are read from these
numbers; nothing is encoded again.

Pieces are distinct per batch, and their totals are kept per worker in a bounded cache.

Defined results: a null text is empty, with 0 tokens; repeated rows and null ids are counted like any other row.
Special strings in a text are one token, as the library does by default.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .arrow import process_cache, slices, strings
from .pieces import LETTER, Bounded, Vocabulary, char_classes, cut

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
CACHED_PIECES = 500_000
CACHED_PAIRS = 500_000


class PrefixCounter:
    """Exact token counts at every prefix of a piece."""

    def __init__(self, path: str):
        self.words = Vocabulary(path)
        self.model = Tokenizer.from_file(path).model
        self.pairs = Bounded(CACHED_PAIRS)
        self.totals = Bounded(CACHED_PIECES)

    def neighbours(self, left: int, right: int) -> bool:
        """Whether the two tokens are the encoding of their concatenation."""
        key = left << 20 | right
        known = self.pairs.get(key)
        if known is None:
            tokens = self.words.tokens
            found = self.model.tokenize(tokens[left] + tokens[right])
            known = len(found) == 2 and found[0].id == left and found[1].id == right
            self.pairs.make_room(1)
            self.pairs[key] = known
        return known

    def counts(self, spelled: str) -> list[int]:
        """Tokens of each prefix of a piece in byte letters, the empty prefix first."""
        ids, pairs, n = self.words.ids, self.pairs, len(spelled)
        last, count = [-1] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            # The one token that ends this prefix; short ones are tried first.
            for start in range(end - 1, -1, -1):
                token = ids.get(spelled[start:end])
                if token is None:
                    continue
                if start:
                    fits = pairs.get(last[start] << 20 | token)
                    if not (self.neighbours(last[start], token) if fits is None else fits):
                        continue
                last[end], count[end] = token, count[start] + 1
                break
        return count

    def total(self, piece: str) -> int:
        if piece in self.words.special_ids:
            return 1
        return self.counts(self.words.spell(piece))[-1]

    def totals_of(self, pieces: list[str]) -> np.ndarray:
        known = self.totals
        out = [known.get(p) for p in pieces]
        fresh = [i for i, v in enumerate(out) if v is None]
        known.make_room(len(fresh))
        for i in fresh:
            out[i] = known[pieces[i]] = self.total(pieces[i])
        return np.array(out, dtype=np.int64)


def fitting_bytes(counter: PrefixCounter, pieces: list[str], totals: np.ndarray, limit: int) -> int:
    """Bytes of a text's longest prefix with at most ``limit`` tokens that ends with a piece or inside a run of letters.

    A prefix may not end in white space, whose pieces depend on what follows.
    """
    upto = np.cumsum(totals)
    whole = int(np.searchsorted(upto, limit, side="right"))
    left = limit - (int(upto[whole - 1]) if whole else 0)
    size = sum(len(p.encode("utf-8", "surrogatepass")) for p in pieces[:whole])
    if whole < len(pieces):
        piece = pieces[whole]
        if char_classes()[ord(piece.lstrip(" ")[:1] or " ")] == LETTER:
            counts = counter.counts(counter.words.spell(piece))
            ends = np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in piece])
            fits = [int(e) for c, e in zip(piece, ends) if counts[e] <= left and c != " "]
            if fits:
                return size + max(fits)
    elif whole == len(pieces):
        return size
    while whole and not pieces[whole - 1].strip():
        whole -= 1
        size -= len(pieces[whole].encode("utf-8"))
    return size


def count_tokens(docs: DataFrame, limit: int = LIMIT, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and fit_bytes (bytes of the longest prefix within the limit) of each text."""
    path = public_tokenizers.path(tokenizer)

    def run(batches):
        counter = process_cache(f"prefix_counter_{tokenizer}", lambda: PrefixCounter(path))
        for part in slices(batches):
            texts = strings(part.column("text"))
            found = cut(texts, counter.words.specials, True, False, True)
            totals = counter.totals_of(found.distinct)
            each = totals[found.codes] if len(found.codes) else np.zeros(0, dtype=np.int64)
            upto = np.append(0, np.cumsum(each))
            counts = upto[found.bounds[1:]] - upto[found.bounds[:-1]]
            sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            fits = list(sizes)
            for i in np.flatnonzero(counts > limit):
                a, b = found.bounds[i], found.bounds[i + 1]
                # The prefix lies in the first pieces: each has a token at least.
                b = min(b, a + limit + 1)
                fits[i] = fitting_bytes(counter, [found.distinct[c] for c in found.codes[a:b]], each[a:b], limit)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()),
                 pa.array(counts > limit), pa.array(fits, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_bytes"],
            )

    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    return docs.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean, fit_bytes bigint")
