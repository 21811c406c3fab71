"""Phrases against counting every phrase of every piece."""

from __future__ import annotations

import random
import re
from collections import Counter

import brute
import numpy as np
import pytest

from tickloom.llm import collocations


def plain(rows, least, longest=4, keep=2000, share=80):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", brute.lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f.update((lang, *w[i : i + m]) for i in range(len(w) - m + 1))
    candidates = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    dropped = set()
    for p, a in candidates.items():
        for m in range(2, len(p) - 1):
            for i in range(1, len(p) - m + 1):
                q = (p[0], *p[i : i + m])
                if 100 * a >= share * candidates[q]:
                    dropped.add(q)
    out = {}
    for p, a in candidates.items():
        if p not in dropped:
            cuts = []
            for k in range(2, len(p)):
                x, y = f[p[:k]], f[(p[0], *p[k:])]
                cuts.append((2_000_000 * a // (x + y), k - 1, x, y))
            score, cut, x, y = min(cuts)
            out.setdefault(p[0], []).append((-score, -a, " ".join(p[1:]).encode(), x, y, cut))
    return sorted((lang, r, q.decode(), -a, x, y, n[lang], -s, cut) for lang, found in out.items() for r, (s, a, q, x, y, cut) in enumerate(sorted(found)[:keep], 1))


def corpus(seed, n=300):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["Été", "naïve", "don't", "x-y", "\x1c"]
    fixed = [["new", "york", "city", "hall"], ["la", "la", "la"], ["A", "b"], ["one", "two", "three", "four", "five"]]
    rows = []
    for _ in range(n):
        parts = []
        for _ in range(rnd.randrange(30)):
            parts.append(" ".join(rnd.choice(fixed)) if rnd.random() < 0.3 else vocab[min(int(rnd.expovariate(0.15)), len(vocab) - 1)])
            parts.append(rnd.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", ";", " ?! "]))
        rows.append((rnd.choice(["en", "en", "en", "de", None, "und"]), "".join(parts)))
    return [*rows, ("en", None), ("fr", ""), ("fr", "..."), (None, "a b a b a b a b a b"), rows[0], rows[0], ("de", "tick tock " * 300)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, la, "clash", 1) for i, (la, t) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, n int").repartition(3)


COLS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut")


def found(df):
    return sorted(tuple(r) for r in df.select(*COLS).collect())


@pytest.mark.parametrize("small", [False, True])
def test_phrases(spark, monkeypatch, small):
    """With small limits: many chunks, bands and sorted tiles."""
    if small:
        monkeypatch.setattr(collocations, "CHUNK", 300)
        monkeypatch.setattr(collocations, "RANKS", 4)
        monkeypatch.setattr(collocations, "DENSE", 16)
        monkeypatch.setattr(collocations, "WAITING", 5)
        spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        rows = corpus(3)
        assert found(collocations.phrases(frame(spark, rows), least=6)) == plain(rows, 6)
        assert len(plain(rows, 6)) > 30
        assert found(collocations.phrases(frame(spark, rows), least=4, longest=3, keep=7, share=95)) == plain(rows, 4, 3, 7, 95)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_no_phrases(spark):
    df = frame(spark, corpus(1, 5))
    assert collocations.phrases(df.where("false")).count() == 0
    assert collocations.phrases(df, least=10**6).count() == 0
    assert collocations.phrases(df.where("lang = 'fr'"), least=1).count() == 0


def test_products_beyond_64_bits(spark):
    a, x = 7 * 10**17 + 3, 9 * 10**17 + 1
    df = spark.createDataFrame([(a, x)], "a long, x long")
    assert df.select(collocations.whole_quotient(df.a, df.x, 2_000_000)).first()[0] == 2_000_000 * a // x


def test_tiles():
    rnd = np.random.default_rng(0)
    u, v = (rnd.integers(0, 1 << rnd.integers(1, 31, 3000)) for _ in "uv")
    for slots in (1, 7):
        tile, cell = collocations.tile_of(u, v, slots)
        assert len(set(zip(tile.tolist(), cell.tolist()))) == len(set(zip(u.tolist(), v.tolist())))
        for t in np.unique(tile).tolist():
            own = tile == t
            assert cell[own].max() < collocations.tile_cells(t, slots)
            x, y = collocations.tile_pairs(t, cell[own], slots)
            assert (x == u[own]).all() and (y == v[own]).all()
    with pytest.raises(OverflowError):
        collocations.tile_of(u << 20, v << 20, 1)
