"""Plain versions of the operators, one document after another."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def fingerprint(text, n=3):
    w = words(lower(text))
    if not w:
        return 0
    runs = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_duplicates(docs, radius=2):
    """{row: (fingerprint, component)} of [(doc_id, text)]."""
    fps = [fingerprint(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return [(d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(docs)]


def quality_counts(text):
    text = text or ""
    w = words(text)
    wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    many = Counter(wins)
    hit = set()
    for i, x in enumerate(wins):
        if many[x] > 1:
            hit.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if words(x)]
    n_sym = sum(c in "#*$%&|<>" for c in text)
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return len(w), sum(map(len, w)), n_sym, len(lines) - len(set(lines)), len(hit), failed


def repeats(docs, width=50):
    """{doc_id: (n_bytes, n_removed, n_spans, sha256)} of [(doc_id, text)] with distinct ids."""
    first = {}
    for d, t in sorted((d, (t or "").encode()) for d, t in docs if d is not None):
        for i in range(len(t) - width + 1):
            first.setdefault(t[i : i + width], d)
    out = {}
    for d, t in docs:
        t = (t or "").encode()
        hit = np.zeros(len(t), bool)
        if d is not None:
            for i in range(len(t) - width + 1):
                if first[t[i : i + width]] < d:
                    hit[i : i + width] = True
        spans = int(hit[:1].sum()) + int((hit[1:] & ~hit[:-1]).sum())
        out[d] = (len(t), int(hit.sum()), spans, hashlib.sha256(bytes(b for b, h in zip(t, hit) if not h)).hexdigest())
    return out


def base_scores(docs):
    """{doc_id: (held_out, n_tokens, n_known, train_tokens, base)}"""
    end = object()
    toks = {d: [*words(lower(t)), end] for d, t in docs}
    held = {d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0 for d in toks}
    c = Counter(x for d, t in toks.items() if not held[d] for x in t)
    n, v = sum(c.values()), len(c)
    return {d: (held[d], len(t), sum(c[x] > 0 for x in t), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t)) for d, t in toks.items()}


def bigram_scores(docs, base, mu):
    """{doc_id: log10 probability} with exact counts, each replaced by the middle of its level."""
    begin, end = object(), object()
    toks = {d: [*words(lower(t)), end] for d, t in docs}
    train = [t for d, t in toks.items() if zlib.crc32(("" if d is None else str(d)).encode()) % 10]
    one, two = Counter(x for t in train for x in t), Counter(x for t in train for x in zip([begin, *t], t))
    n, v = sum(one.values()), len(one)
    one[begin] = len(train)

    def middle(c):
        if not c:
            return 0.0
        level = 0
        while math.ceil(base ** (level + 1) - 1e-9) <= c:
            level += 1
        low = math.ceil(base**level - 1e-9)
        return (low + max(low, math.ceil(base ** (level + 1) - 1e-9) - 1)) / 2

    def p(a, b):
        before, single = middle(one[a]), (middle(one[b]) + 0.1) / (n + 0.1 * (v + 1))
        return (min(middle(two[a, b]), before) + mu * single) / (before + mu)

    return {d: sum(math.log10(p(a, b)) for a, b in zip([begin, *t], t)) for d, t in toks.items()}


def top_k(rows, k=5):
    """[(query_id, rank, vec_id, score)] for [(vec_id, vector)]."""
    ok = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % 50 == 0:
            far = (1 << 63) - 1  # scores are held at the ends of a long
            s = sorted((-max(-far, min(far, sum(x * y for x, y in zip(a, b)))), i) for i, b in ok if i != q and len(a) == len(b))
            out += [(q, r, i, -x) for r, (x, i) in enumerate(s[:k], 1)]
    return out


def pieces_ok(pieces, ids, length=2048):
    """Checks packed pieces [(doc, start, length, crc, doc_tokens, seq, offset)] against {doc: ids}; returns the padding."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p[0]].append(p)
        by_seq[p[5]].append((p[6], p[2]))
        x = ids[p[0]]
        assert p[4] == len(x) and zlib.crc32(np.array(x[p[1] : p[1] + p[2]], "<u4").tobytes()) == p[3]
    assert by_doc.keys() == ids.keys()
    for d, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p[1]):
            assert p[1] == at and p[2] > 0
            at += p[2]
        assert at == len(ids[d])
    pad = 0
    for own in by_seq.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= length
        pad += 0 if at & (at - 1) == 0 else length - at
    assert sorted(by_seq) == list(range(len(by_seq)))
    return pad
