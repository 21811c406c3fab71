"""Licence rules: the gate loses nothing, overlaps are resolved as by comparing all pairs, base places are exact."""

from __future__ import annotations

import random
import re
from re import _parser

import pytest
from pyspark.sql import functions as F

from tickloom.llm import catalog, licenses, signatures

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCANNER = licenses.Scanner()


def fold(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def sample(tree, rnd):
    """A text that a pattern matches."""
    out = ""
    for op, arg in tree:
        op = str(op)
        if op == "LITERAL":
            out += chr(arg)
        elif op == "NOT_LITERAL":
            out += "z"
        elif op == "IN":
            kind, x = rnd.choice(arg)
            out += "z" if str(kind) == "NEGATE" or any(str(k) == "NEGATE" for k, _ in arg) else chr(x if str(kind) == "LITERAL" else rnd.randint(*x))
        elif op == "MAX_REPEAT":
            low, high, item = arg
            out += "".join(sample(item, rnd) for _ in range(rnd.randint(low, min(high, low + 2))))
        elif op == "SUBPATTERN":
            out += sample(arg[3], rnd)
        elif op == "BRANCH":
            out += sample(rnd.choice(arg[1]), rnd)
        elif op not in ("ASSERT", "ASSERT_NOT"):
            raise ValueError(op)
    return out


def examples(rule, n=6):
    rnd = random.Random(rule.name)
    return [sample(_parser.parse(rule.pattern.pattern.decode()), rnd) for _ in range(n)]


def all_pairs(found):
    """Detections by strength; one goes if its words contain, or lie within, those of one that stays, a clue if it meets one."""
    stay = []
    for d in sorted(found, key=lambda d: (-d[0].priority, d[1] - d[2], d[1], d[0].name)):
        if d[0].priority == 1 and any(r.priority > 1 and a < d[2] and d[1] < b for r, a, b in stay):
            continue
        if not any((a <= d[1] and d[2] <= b) or (d[1] <= a and b <= d[2]) for _, a, b in stay):
            stay.append(d)
    return sorted(stay, key=lambda d: (d[1], d[2]))


def plain(text):
    """Words, base places and detections, every pattern tried on every text."""
    w = fold(text)
    line = " " + " ".join(w) + " "
    base = [(i, label) for p, label in signatures.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    raw = line.encode()
    found = []
    for r in SCANNER.rules:
        for m in r.pattern.finditer(raw):
            found.append((r, raw[: m.start()].count(b" ") - 1, raw[: m.end()].count(b" ")))
    return w, base, all_pairs(found)


def mixture(seed, n=120):
    rnd = random.Random(seed)
    noise = ["the", "software", "license", "cc", "by", "gpl", "gnu", "general", "public", "2", "0", "mit", "apache", "all", "rights", "reserved", "été", "you"]
    out = []
    for _ in range(n):
        parts = [" ".join(rnd.choice(noise) for _ in range(rnd.randrange(8))) for _ in range(4)]
        parts += [examples(rnd.choice(SCANNER.rules), 1)[0].upper() for _ in range(rnd.randrange(4))]
        rnd.shuffle(parts)
        out.append(rnd.choice([" ", ", ", "\n", " -- "]).join(parts))
    return out


def test_hundreds_of_rules_whose_keywords_every_match_holds():
    assert len(SCANNER.rules) > 300 and len({r.label for r in SCANNER.rules}) > 100
    for r in SCANNER.rules:
        for text in examples(r):
            assert r.pattern.fullmatch(f" {text} ".encode(), 1, len(text.encode()) + 1) or r.pattern.search(f" {text} ".encode()), (r.label, text)
            assert r.keywords <= {w.encode() for w in text.split()}, (r.label, r.pattern.pattern, text)


def test_scan_equals_all_rules_on_all_texts():
    for text in mixture(1) + ["", "CC BY", "cc by cc by", "All rights reserved. ALL RIGHTS RESERVED", "x" * 5000, "license " * 500]:
        w, base, stay = plain(text)
        n, places, found = SCANNER.scan(text.encode())
        assert n == len(w) and sorted(places) == sorted(base) and [(r.name, a, b) for r, a, b in found] == [(r.name, a, b) for r, a, b in stay]


def test_containment_against_all_pairs():
    rnd = random.Random(3)
    rules = SCANNER.rules
    for _ in range(300):
        found = []
        for _ in range(rnd.randrange(30)):
            lo = rnd.randrange(20)
            found.append((rnd.choice(rules), lo, lo + rnd.randrange(1, 8)))
        assert licenses.resolved(found) == all_pairs(found)


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Released under the MIT License.", {"mit"}),
        ("Licensed under the Apache License, Version 2.0.", {"apache-2.0"}),
        ("This work is licensed under the GNU General Public License, version 3.", {"gpl-3.0"}),
        ("Licensed under CC BY-NC 4.0.", {"cc-by-nc-4.0"}),
        ("SPDX-License-Identifier: GPL-2.0-or-later", {"gpl-2.0-or-later"}),
        ("Licensed under the GNU Lesser General Public License, version 2.1 of the License, or (at your option) any later version", {"lgpl-2.1-or-later"}),
        ("https://creativecommons.org/licenses/by-sa/4.0/", {"cc-by-sa-4.0"}),
        ("Copyright (c) 2019 Someone. Confidential and proprietary.", {"copyright", "proprietary"}),
        ("licensed under the strange license", {"unknown-reference"}),
        ("a text about permission, software and public parks", set()),
    ],
)
def test_labels(text, labels):
    assert {r.label for r, _, _ in SCANNER.scan(text.encode())[2]} == labels


def test_query(spark, tmp_path):
    texts = [*mixture(7, 80), None, "", "  ", "CC BY-SA 4.0 " * 3000, "été—license", "cc\tby"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "all rights reserved"), (5, texts[5]), (5, texts[5])]
    df = spark.createDataFrame([(d, t, "clash", 0.5, "x") for d, t in rows], "doc_id long, text string, labels string, score double, places string").repartition(3)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    out = catalog.QUERIES["op12_licenses"](spark, str(tmp_path))
    got = [tuple(r) for r in out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", F.expr("score >= 0 and score < 1 and (score > 0) = (labels <> '')")).collect()]
    want = []
    for d, t in rows:
        w, base, stay = plain(t)
        at = [i for i, _ in base]
        own = {x for _, x in base}
        want.append((d, len(w), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(own)), ",".join(sorted(own | {r.label for r, _, _ in stay})), True))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert licenses.scan(df.where("false")).count() == 0
