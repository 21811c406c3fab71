"""Quality rules: a decision list learned by sequential covering, applied as one ordered Spark expression."""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.session import cut_lineage

from . import common

WORD_BREAK = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: What conditions may test; each is a ratio, so that long and short texts compare.
FEATURES = ("mean_word", "symbols_per_word", "marks_per_word", "upper_per_char", "repeat_share", "dup_line_share", "distinct_share")


def _pairs(a: Column, size: Column, gap: int) -> Column:
    """Names of runs of twice the length: hashes of two neighbouring names ``gap`` apart."""
    n = F.greatest(size, F.lit(0))
    return F.zip_with(F.slice(a, 1, n), F.slice(a, gap + 1, n), lambda x, y: F.xxhash64(x, y))


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words`` and the ratios of ``FEATURES``.

    Works inside each row, without a shuffle. An 8-word window is named by a 64-bit hash built by doubling (1, 2, 4, 8
    words); only texts in which a name repeats are sorted to find which words the repeated windows cover. A null or empty
    text has no words; every ratio is then 0. Working columns begin with ``_q`` (``_qrow``, of no meaning, is left to filters);
    given columns of the new names are replaced.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *FEATURES]
    keep = [c for c in docs.columns if c not in names]
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    df = docs.withColumn("_qt", t).withColumn("_qb", F.btrim(F.col("_qt"), F.lit(common.SPACE)))
    df = df.withColumn("_qw", F.when(F.col("_qb") == "", F.array().cast("array<string>")).otherwise(F.split("_qb", WORD_BREAK)))
    df = df.withColumn("_ql", F.filter(F.split("_qt", "\n"), lambda x: F.btrim(x, F.lit(common.SPACE)) != ""))
    df = df.withColumn("_q1", F.transform("_qw", lambda x: F.xxhash64(x))).withColumn("_qn", F.size("_qw"))
    for name, of, gap, less in (("_q2", "_q1", 1, 1), ("_q4", "_q2", 2, 3), ("_q8", "_q4", 4, 7)):
        df = df.withColumn(name, _pairs(F.col(of), F.col("_qn") - less, gap))
    df = df.withColumn("_qs", F.when(F.size(F.array_distinct("_q8")) < F.size("_q8"), F.array_sort(F.transform("_q8", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    less = F.greatest(F.size("_qs") - 1, F.lit(0))
    same = F.zip_with(F.slice("_qs", 1, less), F.slice("_qs", 2, less), lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"])).otherwise(F.array().cast("array<int>")))
    df = df.withColumn("_qp", F.when(F.col("_qs").isNotNull(), F.array_sort(F.array_distinct(F.flatten(same)))))
    less = F.greatest(F.size("_qp") - 1, F.lit(0))
    steps = F.zip_with(F.slice("_qp", 1, less), F.slice("_qp", 2, less), lambda x, y: F.least(y - x, F.lit(8)))
    covered = F.when(F.size("_qp") > 0, F.aggregate(steps, F.lit(8), lambda s, x: s + x)).otherwise(0)
    df = df.select(
        *keep,
        F.col("_qn").cast("long").alias("n_words"),
        F.char_length(F.array_join("_qw", "")).cast("long").alias("word_chars"),
        F.regexp_count("_qt", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_ql") - F.size(F.array_distinct("_ql"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size("_ql").alias("_qlines"),
        F.regexp_count("_qt", F.lit(r"\p{Lu}")).alias("_qupper"),
        F.regexp_count("_qt", F.lit("[!?]")).alias("_qmarks"),
        F.size(F.array_distinct("_q1")).alias("_qdistinct"),
    )
    share = lambda x, of: F.when(F.col(of) > 0, F.col(x) / F.col(of)).otherwise(0.0)
    ratios = (("word_chars", "n_words"), ("n_symbols", "n_words"), ("_qmarks", "n_words"), ("_qupper", "word_chars"), ("n_repeat_words", "n_words"), ("n_dup_lines", "_qlines"), ("_qdistinct", "n_words"))
    # the optimizer would move a later filter below all this and compute it several times over; it never passes by a
    # non-deterministic column that the filter needs
    return df.select(*keep, *names[:5], *[share(*r).alias(f) for f, r in zip(FEATURES, ratios)], F.spark_partition_id().alias("_qrow"))


def base_failed() -> Column:
    return ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))) & (F.col("_qrow") >= 0)


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    limit: float

    def column(self) -> Column:
        return F.col(self.feature) > self.limit if self.above else F.col(self.feature) <= self.limit


def _all(tests: list[Test]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t.column()
    return out


def _binned(rows: DataFrame, bins: int) -> DataFrame:
    """Adds ``bins``: for each feature the number of its quantiles that the value reaches."""
    at = [i / bins for i in range(1, bins)]
    cuts = rows.agg(*[F.percentile_approx(f, at, 10_000).alias(f) for f in FEATURES]).first()
    number = lambda f: F.size(F.filter(F.array(*[F.lit(float(c)) for c in sorted(set(cuts[f] or [0.0]))]), lambda c: c < F.col(f)))
    return rows.withColumn("bins", F.array(*[F.struct(F.lit(f).alias("f"), number(f).alias("bin"), F.col(f).alias("v")) for f in FEATURES]))


def _best_test(rows: DataFrame) -> tuple[int, int, Test | None]:
    """Good and bad rows, and the condition of highest FOIL gain, from counts for each feature and bin."""
    stats = rows.select("bad", F.explode("bins").alias("b")).groupBy("b.f", "b.bin").agg(F.sum("bad").alias("p"), F.count("*").alias("n"), F.min("b.v").alias("lo"), F.max("b.v").alias("hi")).collect()
    good, bad, best = 0, 0, (0.0, None)
    for f in FEATURES:
        by_bin = sorted((r.bin, r.p, r.n - r.p, r.lo, r.hi) for r in stats if r.f == f)
        p_all, n_all = sum(r[1] for r in by_bin), sum(r[2] for r in by_bin)
        good, bad = n_all, p_all
        p_low = n_low = 0
        for (_, p, n, _, hi), (_, _, _, lo, _) in zip(by_bin, by_bin[1:]):
            p_low, n_low = p_low + p, n_low + n
            for above, pos, neg in ((False, p_low, n_low), (True, p_all - p_low, n_all - n_low)):
                if pos:
                    gain = pos * (log2(pos / (pos + neg)) - log2(p_all / (p_all + n_all)))
                    best = max(best, (gain, Test(f, above, (lo + hi) / 2)), key=lambda x: x[0])
    return good, bad, best[1]


def learn(labelled: DataFrame, max_rules: int = 8, max_tests: int = 4, bins: int = 64, precision: float = 0.95, support: int = 10) -> list[list[Test]]:
    """Conjunctions that pick out bad rows, in order; ``labelled`` has ``FEATURES``, ``bad`` (1 or 0) and ``grow`` (boolean).

    Each rule grows on two thirds of the rows, one condition at a time, until it picks no good row or nothing gains; it is
    then cut back to the beginning that is worth most on the other third. A rule must pick ``support`` rows there, at
    least ``precision`` of them bad, or learning ends; what a rule picks is taken away before the next. Only counts for
    each feature and bin come to the driver."""
    rest, rules = cut_lineage(_binned(labelled, bins)), []
    while len(rules) < max_rules:
        tests: list[Test] = []
        while len(tests) < max_tests:
            good, bad, test = _best_test(rest.where(F.col("grow") & _all(tests)))
            if not bad or tests and not good or test is None:
                break
            tests.append(test)
        if not tests:
            break
        prefix = [tests[: i + 1] for i in range(len(tests))]
        sums = [x for t in prefix for x in (F.count_if(_all(t) & (F.col("bad") == 1)), F.count_if(_all(t) & (F.col("bad") == 0)))]
        found = rest.where(~F.col("grow")).agg(*sums).first()
        worth = [(found[2 * i], found[2 * i + 1]) for i in range(len(prefix))]
        k = max(range(len(worth)), key=lambda i: ((worth[i][0] - worth[i][1]) / max(1, sum(worth[i])), worth[i][0]))
        p, n = worth[k]
        if p + n < support or p < precision * (p + n):
            break
        rules.append(prefix[k])
        rest = rest.where(~_all(prefix[k]))
    return rules


def decision(rules: list[list[Test]]) -> Column:
    """Number of the first rule that holds (from 1), else 0; one conditional expression."""
    out = F.lit(0)
    for i, tests in reversed(list(enumerate(rules, 1))):
        out = F.when(_all(tests), i).otherwise(out)
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> list[list[Test]]:
    """Rules from at most ``sample`` labelled documents, those with the smallest hash of doc_id; quality 0 is bad.

    The sample's size is fixed, so its ids and labels may be broadcast. Labels without an id or a quality don't count, of
    an id with several labels the lowest does. Documents that fail the base rule teach nothing. No labels, no rules."""
    picked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("_qid"), F.col("quality").alias("_quality"))
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_qid"))
    rows = cut_lineage(counts(rows).drop("doc_id", "text")).where(~base_failed()).coalesce(8)  # a bounded sample
    return learn(rows.select(*FEATURES, (F.col("_quality") == 0).cast("int").alias("bad"), (F.pmod(F.xxhash64("_qid", F.lit(1)), F.lit(3)) > 0).alias("grow")))


def judged(docs: DataFrame, rules: list[list[Test]]) -> DataFrame:
    """All columns, the counts and ratios, ``base_failed``, ``rule`` (first that holds, 0: none) and ``kept``."""
    df = counts(docs).withColumn("base_failed", base_failed()).withColumn("rule", decision(rules))
    return df.withColumn("kept", (F.col("_qrow") >= 0) & ~F.col("base_failed") & (F.col("rule") == 0)).drop("_qrow")
