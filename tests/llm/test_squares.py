"""Periodic runs against a search over all periods."""

from __future__ import annotations

import hashlib
import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import catalog, squares


def all_runs(w, least=12):
    """(start, length, smallest period), one period after another."""
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                out.setdefault((i, j + q - i), q)
            i = j
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def changed(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    g, n, w = h // 10, len(w), list(w)
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def digest(doc_id, text):
    w = changed(doc_id, brute.words(text))
    runs = all_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), best[0], best[1], best[2], milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def sequences():
    rnd = random.Random(4)
    out = [[], [1], [1] * 11, [1] * 12, [1] * 500, [1, 2] * 100, [1, 2, 3] * 5 + [9] + [1, 2, 3] * 5, list(range(300)) * 2]
    out += [[rnd.randrange(k) for _ in range(n)] for k in (2, 3, 5) for n in (30, 100, 257, 400)]
    fib = [0], [1, 0]
    for _ in range(11):
        fib = fib[1], fib[1] + fib[0]
    morse = [bin(i).count("1") & 1 for i in range(512)]
    for _ in range(30):
        w = []
        while len(w) < 300:
            part = [rnd.randrange(50) for _ in range(rnd.randrange(1, 40))]
            w += (part * rnd.randrange(1, 6))[: rnd.randrange(5, 120)]
        out.append(w)
    return [*out, fib[1], morse, morse + morse]


def test_catchers_find_all_runs():
    for w in sequences():
        c = squares.Catchers()
        c.append(np.array(w, np.int64))
        assert [(s, e - s, q) for s, e, q in c.runs().tolist()] == all_runs(w)
    together = squares.runs_of([[b"%d" % x for x in w] for w in sequences()], 12)
    assert [[(s, e - s, q) for s, e, q in r.tolist()] for r in together] == [all_runs(w) for w in sequences()]


def test_pieces_do_not_show():
    rnd = random.Random(1)
    for w in sequences():
        whole, c, i = squares.Catchers(), squares.Catchers(), 0
        n = whole.append(np.array(w, np.int64))
        found = 0
        while i < len(w):
            k = rnd.choice([1, 1, 2, 7, 60])
            found += c.append(np.array(w[i : i + k], np.int64))
            i += k
        assert found == n and (c.runs() == whole.runs()).all()


def test_equal_names_are_noticed(monkeypatch):
    w = [1, 2, 3, 4, 5, 6, 7] * 4 + list(range(100, 160))
    real = squares.common.mix
    monkeypatch.setattr(squares.common, "mix", lambda x: real(x) & np.uint64(15))
    c = squares.Catchers()
    c.append(np.array(w, np.int64))
    monkeypatch.setattr(squares.common, "mix", real)
    assert [(s, e - s, q) for s, e, q in c.runs().tolist()] == all_runs(w)


def test_collapse(spark, monkeypatch):
    monkeypatch.setattr(squares, "TOGETHER", 700)
    texts = [" ".join(f"w{x}" for x in w) for w in sequences()] + ["", " \t\n", None, "a  b c\x0bd " * 9, "é ü " * 10, "x\x1cy " * 20]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "la " * 30), (3, texts[5]), (3, texts[5])]
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id long, text string, runs string, start int").repartition(3)
    out = squares.collapse(df, edit=squares.looped).select("doc_id", F.expr("transform(runs, r -> concat_ws(',', r.start, r.length, r.period))").alias("r"), "collapsed").collect()
    want = []
    for d, t in rows:
        w = changed(d, brute.words(t))
        runs = all_runs(w)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        want.append((d, [f"{s},{n},{q}" for s, n, q in runs], " ".join(x for i, x in enumerate(w) if i not in gone)))
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)
    assert squares.collapse(df.where("false")).count() == 0


def test_a_very_long_text():
    rnd = np.random.default_rng(0)
    w = rnd.integers(0, 1 << 40, 400_000)
    w[50_000:250_000] = np.tile(w[50_000:150_000], 2)
    c = squares.Catchers()
    c.append(w)
    found = c.runs().tolist()
    assert len(found) == 1 and found[0][2] == 100_000 and found[0][1] - found[0][0] == 200_000


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    short = [(d, t) for d, t in docs if len(t or "") < 4000]
    want = {x[0]: x for x in (digest(d, t) for d, t in short)}
    cols = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    out = {r.doc_id: tuple(r) for r in catalog.QUERIES["op13_runs"](spark, sf).select(*cols).collect()}
    assert len(out) == len(docs) and all(out[d] == x for d, x in want.items()) and sum(x[1] for x in want.values()) > 5
