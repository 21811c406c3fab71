"""Licence statements in texts: ordered signature rules behind a keyword gate, overlaps resolved by priority and containment."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import signatures

#: Priority and weight of each kind of rule.
KINDS = {"t": (5, 0.95), "x": (4, 0.9), "n": (3, 0.8), "m": (2, 0.5), "c": (1, 0.2)}
BASE_WEIGHT = 0.5
#: ASCII letters and digits are kept in lower case, other ASCII characters part words; all else belongs to words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


@dataclass(frozen=True)
class Rule:
    name: int
    label: str
    priority: int
    weight: float
    keywords: frozenset[bytes]
    pattern: re.Pattern[bytes]


def parse(table: str) -> list[Rule]:
    """Rules of a table as described in ``signatures``, in its order."""
    out, label = [], ""
    for line in filter(None, map(str.strip, table.split("\n"))):
        if line[0] == "[":
            label = line[1:-1]
            continue
        head, pattern = line.split(": ", 1)
        kind, words = head.split(" ")
        source = re.sub(r"<(\d+)>", r"(?: [^ ]+){0,\1}", pattern)
        priority, weight = KINDS[kind]
        out.append(Rule(len(out), label, priority, weight, frozenset(w.encode() for w in words.split(",")), re.compile(f"(?<= )(?:{source})(?= )".encode())))
    return out


class Scanner:
    """All rules, each filed under one of its keywords."""

    def __init__(self, table: str = signatures.RULES, base: dict[str, str] = signatures.BASE) -> None:
        self.rules = parse(table)
        uses: dict[bytes, int] = {}
        for r in self.rules:
            for w in r.keywords:
                uses[w] = uses.get(w, 0) + 1
        self.filed: dict[bytes, list[Rule]] = {}
        for r in self.rules:
            self.filed.setdefault(min(r.keywords, key=lambda w: (uses[w], -len(w), w)), []).append(r)
        self.gate = frozenset(self.filed)
        self.base = [(re.compile(f"(?= {p} )".encode()), frozenset(p.encode().split()), label) for p, label in base.items()]
        self.base_gate = frozenset(p.encode().split()[-1] for p in base)

    @staticmethod
    def words(text: bytes) -> list[bytes]:
        return text.translate(_FOLD).split()

    def places(self, words: list[bytes], present: frozenset[bytes], line: bytes) -> list[tuple[int, str]]:
        """Word number and label of every base phrase."""
        found = [(m.start(), label) for pattern, keys, label in self.base if keys <= present for m in pattern.finditer(line)]
        return list(zip(_word_numbers(line, [x for x, _ in found]), (label for _, label in found)))

    def detections(self, present: frozenset[bytes], line: bytes) -> list[tuple[Rule, int, int]]:
        """Rule, first word and word behind the last of every match of a rule whose keywords are all there."""
        hits = [(r, m.start() - 1, m.end()) for w in present & self.gate for r in self.filed[w] if r.keywords <= present for m in r.pattern.finditer(line)]
        starts, stops = (_word_numbers(line, [h[c] for h in hits]) for c in (1, 2))
        return list(zip((h[0] for h in hits), starts, stops))

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, str]], list[tuple[Rule, int, int]]]:
        """Number of words, base places and the detections that stay."""
        words = self.words(text)
        if self.gate.isdisjoint(words) and self.base_gate.isdisjoint(words):
            return len(words), [], []
        present, line = frozenset(words), b" " + b" ".join(words) + b" "
        return len(words), self.places(words, present, line), resolved(self.detections(present, line))


def _word_numbers(line: bytes, at: list[int]) -> list[int]:
    """Number of the word that begins behind each of these spaces."""
    out, n, last = {}, 0, 0
    for x in sorted(set(at)):
        n += line.count(b" ", last, x)
        out[x], last = n, x
    return [out[x] for x in at]


def resolved(found: list[tuple[Rule, int, int]]) -> list[tuple[Rule, int, int]]:
    """Where the words of one detection contain those of another, only the stronger stays: the higher priority, then the longer,
    then the earlier, then the rule that stands first. So those that stay have rising starts and rising ends, and a look at
    two of them judges each candidate. A clue also goes if it shares a word with something stronger; other detections that
    merely overlap all stay."""
    starts: list[tuple[int, int]] = []
    strong: list[tuple[int, int]] | None = None
    stay = []
    for rule, lo, hi in sorted(found, key=lambda d: (-d[0].priority, d[1] - d[2], d[1], d[0].name)):
        k = bisect_right(starts, (lo, 1 << 62))
        j = bisect_left(starts, (lo, -1))
        if (k and starts[k - 1][1] >= hi) or (j < len(starts) and starts[j][1] <= hi):
            continue
        if rule.priority == KINDS["c"][0]:
            strong = list(starts) if strong is None else strong
            if (k := bisect_left(strong, (hi, -1))) and strong[k - 1][1] > lo:
                continue
        insort(starts, (lo, hi))
        stay.append((rule, lo, hi))
    return sorted(stay, key=lambda d: (d[1], d[2]))


def scan(docs: DataFrame, table: str = signatures.RULES, base: dict[str, str] = signatures.BASE) -> DataFrame:
    """``doc_id``, ``n_words``, ``places`` (array of word number and label: every place of a base phrase), ``detections``
    (array of rule, label, priority, first word, word behind the last) and ``score``.

    Words are runs of ASCII letters and digits and of all characters beyond ASCII; A-Z is lower-cased. The score is 1 minus the
    product of (1 - weight) over the distinct labels, each with the weight of its strongest evidence: 0 without any, below 1.
    Whole texts are read, one row for each row, nothing is shuffled; null and empty texts have no words, null ids stay null,
    other columns are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(table, base)
        place = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
        kind = pa.list_(pa.struct([("rule", pa.int32()), ("label", pa.string()), ("priority", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            n, places, found, score = [], [], [], []
            for text in batch.column("text"):
                words, base_hits, hits = scanner.scan(text.as_py() or b"")
                best = dict.fromkeys((label for _, label in base_hits), BASE_WEIGHT)
                for r, _, _ in hits:
                    best[r.label] = max(best.get(r.label, 0.0), r.weight)
                n.append(words)
                places.append([{"word": w, "label": x} for w, x in base_hits])
                found.append([{"rule": r.name, "label": r.label, "priority": r.priority, "start": lo, "stop": hi} for r, lo, hi in hits])
                score.append(float(1 - np.prod([1 - best[x] for x in sorted(best)])))
            cells = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(places, place), pa.array(found, kind), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(cells, ["doc_id", "n_words", "places", "detections", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    detection = "struct<rule: int, label: string, priority: int, start: long, stop: long>"
    return rows.mapInArrow(run, f"doc_id long, n_words long, places array<struct<word: long, label: string>>, detections array<{detection}>, score double")
