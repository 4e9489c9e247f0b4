"""Plain versions of the operators, over lists of (doc_id, text) in one process."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = 1 << 63


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def shingles(text):
    w = words(lower(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near(rows):
    """One (doc_id, n_shingles, component_id, kept) per row."""
    sets = [shingles(t) for _, t in rows]
    linked = [i for i, (d, _) in enumerate(rows) if d is not None and sets[i]]
    parent = {rows[i][0]: rows[i][0] for i in linked}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, i in enumerate(linked):
        for j in linked[:k]:
            common = len(sets[i] & sets[j])
            if 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                a, b = root(rows[i][0]), root(rows[j][0])
                parent[max(a, b)] = min(a, b)
    out = []
    for (d, _), s in zip(rows, sets):
        component = root(d) if d in parent and s else d
        out.append((d, len(s), component, d == component))
    return out


def repeats(rows, length=50):
    """One (doc_id, n_bytes, n_removed, n_spans, kept_sha256) per row."""
    data = [(LAST if d is None else d, d, (t or "").encode()) for d, t in rows]
    least = {}
    for d, _, b in data:
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            least[s] = min(least.get(s, d), d)
    out = []
    for d, name, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if least[b[i : i + length]] < d:
                gone[i : i + length] = b"\x01" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((name, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


SENTENCE = re.compile(r"[^.!?\n]*[.!?\n][.!?\x20\x09-\x0D]*|[^.!?\n]+")


def pieces(text, most=25, reach=3):
    """Sentences; a long one is cut before words whose hash with the next word is least among its neighbours."""
    out = []
    for part in SENTENCE.findall(text or ""):
        found = list(WORD.finditer(part))
        if len(found) <= most:
            out.append(part)
            continue
        keys = [xxhash.xxh3_64_intdigest(w.group().encode()) for w in found]
        mixed = [((a ^ (b >> 7)) * 0x9E3779B97F4A7C15) % (1 << 64) for a, b in zip(keys, keys[1:])]
        mixed = [m ^ (m >> 32) for m in mixed]
        begins, last = [], 0
        for i in range(1, len(found)):
            around = [mixed[j] for j in range(max(0, i - reach), min(len(mixed), i + reach + 1)) if j != i]
            if i < len(mixed) and all(mixed[i] < m for m in around):
                begins.append(i)
                last = i
            elif mixed and i == last + most:
                begins.append(i)
                last = i
        at = 0
        for i in begins:
            out.append(part[at : found[i].start()])
            at = found[i].start()
        out.append(part[at:])
    return out


def spans(rows, least=2, least_words=20):
    """One (doc_id, n_sentences, n_removed, text) per row."""
    cut = [pieces(t) for _, t in rows]
    runs = []
    names = []
    for d, t in rows:
        mark = xxhash.xxh64_intdigest((t or "").encode(), 42)
        names.append((LAST if d is None else d, mark - (1 << 64) if mark >= 1 << 63 else mark))
    for k in range(len(rows)):
        spoken = [i for i, p in enumerate(cut[k]) if words(p)]
        n = len(spoken)
        found = set()
        for i in range(n):
            for direction in (1, -1):
                part, total = [], 0
                j = i
                while 0 <= j < n and (len(part) < least or total < least_words):
                    part.append(j)
                    total += len(words(cut[k][spoken[j]]))
                    j += direction
                if len(part) >= least and total >= least_words:
                    found.add((min(part), max(part)))
        for a, b in found:
            text = tuple(tuple(words(cut[k][spoken[i]])) for i in range(a, b + 1))
            runs.append((text, names[k], spoken[a], spoken[b] + 1))
    first = {}
    for text, d, a, _ in runs:
        first[text] = min(first.get(text, (d, a)), (d, a))
    gone = defaultdict(set)
    for text, d, a, b in runs:
        if first[text] != (d, a):
            gone[d].update(range(a, b))
    out = []
    for (d, t), name, parts in zip(rows, names, cut):
        mine = gone[name]
        kept = [p for i, p in enumerate(parts) if i not in mine]
        out.append((d, len(parts), len(parts) - len(kept), t if len(kept) == len(parts) else "".join(kept)))
    return out


def quality_counts(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = text or ""
    w = words(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    times = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def token_bins(text, bins):
    import regex

    def signed(x):
        return x - (1 << 64) if x >= 1 << 63 else x

    def of_long(value, seed):
        return xxhash.xxh64_intdigest((value & (1 << 64) - 1).to_bytes(8, "little"), seed)

    tokens = regex.findall(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]+", text or "")
    hashes = [signed(xxhash.xxh64_intdigest(t.encode(), 42)) for t in tokens]
    pairs = [signed(of_long(b, of_long(a, 42))) for a, b in zip(hashes, hashes[1:])]
    return [h % bins for h in hashes] + [p % bins + bins for p in pairs]


def kept_by_ratio(rows, trusted, bins, smoothing, least, unit=1_000_000):
    grams = [token_bins(t, bins) for _, t in rows]
    raw, target = Counter(), Counter()
    for (d, _), g in zip(rows, grams):
        raw.update(g)
        if d in trusted:
            target.update(g)
    r, t, added = sum(raw.values()), sum(target.values()), smoothing * 2 * bins
    units = {
        b: round((math.log((target[b] + smoothing) / (t + added)) - math.log((raw[b] + smoothing) / (r + added))) * unit) if t else 0
        for b in raw
    }
    return [bool(g) and sum(units[b] for b in g) >= len(g) * int(least * unit) for g in grams]


def fill(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    """Targets of sources by clamping and sharing again until none is above; ``sizes`` in the order of the sources."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    amount, clamped = share * sum(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in clamped]
        rest = amount - sum(cap * sizes[i] for i in clamped)
        total = sum(weight[i] for i in free)
        targets = [cap * s if i in clamped else rest * weight[i] / total for i, s in enumerate(sizes)]
        above = {i for i in free if targets[i] > cap * sizes[i]}
        if not above:
            return targets
        clamped |= above


def best(vectors, k=5, step=50):
    """Rows (query_id, rank, vec_id, score) over (vec_id, components or None)."""
    valid = [
        (i, [math.floor(256 * x) for x in v]) for i, v in vectors
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    # Rows with one id are one query: the best over all of them.
    scored = defaultdict(list)
    for q, a in valid:
        if q % step == 0:
            scored[q] += [(-sum(x * y for x, y in zip(a, b)), i) for i, b in valid if i != q and len(a) == len(b)]
    return [(q, r + 1, i, -s) for q, found in scored.items() for r, (s, i) in enumerate(sorted(found)[:k])]


def collocations(rows, least=30, top=2000, cover=80):
    """Rows (lang, rank, phrase, a, l, r, n, score) over (lang, text)."""
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in range(1, 5):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, found in counts.items():
        candidates = {p: a for p, a in found.items() if len(p) > 1 and a >= least}
        longest = Counter()
        for p, a in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longest[p[i : i + k]] = max(longest[p[i : i + k]], a)
        kept = []
        for p, a in candidates.items():
            if 100 * longest[p] >= cover * a:
                continue
            score, _, left, right = min(
                (2_000_000 * a // (found[p[:k]] + found[p[k:]]), k, found[p[:k]], found[p[k:]]) for k in range(1, len(p))
            )
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        out += [
            (lang, i + 1, p.decode(), -a, left, right, totals[lang], -score)
            for i, (score, a, p, left, right) in enumerate(sorted(kept)[:top])
        ]
    return out


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text))


def ranked(rows, items, k=20):
    """Rows (item_id, rank, doc_id, score) over (doc_id, text) and (item_id, text)."""
    docs = [(d, Counter(terms(t))) for d, t in rows]
    docs = [(d, c, sum(c.values())) for d, c in docs if c]
    many, words = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    needs = defaultdict(Counter)
    for item, text in items:
        needs[item].update(terms(text))
    out = []
    for item, wanted in needs.items():
        found = []
        for d, c, n in docs:
            m = 100 - 25 + (25 * n * many) // words
            score = sum(
                times * math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                for t, times in wanted.items() if t in c
            )
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(found)[:k])]
    return out
