"""Mixing to target weights with soft membership: rates for documents whose expected token totals by domain meet targets."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.session import cut_lineage

from . import common

#: Domains of the labelled table, in order: toxic ones whatever their quality, else by quality.
DOMAINS = ("good", "poor", "toxic")
BUCKETS = 1 << 16
#: Weight of the rates' distance from 1 beside the residual.
EPSILON = 1e-6


def domain_of(quality: str = "quality", toxic: str = "toxic") -> Column:
    """Number of the domain of a label row; null where it can't be told."""
    return F.when(F.col(toxic) == 1, 2).when(F.col(quality) == 0, 1).when((F.col(quality) == 1) & F.coalesce(F.col(toxic) == 0, F.lit(True)), 0)


def _features(docs: DataFrame) -> DataFrame:
    """Adds ``_qx``: which words (A-Z lower-cased, runs of letters) and other marks the text has, hashed."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.lit(r"\p{L}+|[^\p{L}\s]"), 0)
    return HashingTF(numFeatures=BUCKETS, binary=True, inputCol="_qt", outputCol="_qx").transform(docs.withColumn("_qt", F.array_distinct(words))).drop("_qt")


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> LogisticRegressionModel | None:
    """Multinomial classifier from at most ``sample`` labelled documents, those with the smallest hash of doc_id.

    Of an id with several labels the worst counts (toxic, then poor). Needs two domains among them, else there is none."""
    ranked = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(domain_of()).alias("_qy")).where("_qy is not null")
    picked = ranked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("_qid"), F.col("_qy").cast("double").alias("_qy"))
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_qid"))
    rows = cut_lineage(_features(rows).select("_qx", "_qy"))
    if rows.select("_qy").distinct().count() < 2:
        return None
    # a row without words for each domain keeps the classes at three where the sample lacks one
    empty = _features(docs.sparkSession.createDataFrame([("", float(i)) for i in range(len(DOMAINS))], "text string, _qy double").coalesce(1)).select("_qx", "_qy")
    taught = rows.union(empty).coalesce(2)  # a bounded sample: each part sends the driver a whole gradient in every iteration
    return LogisticRegression(family="multinomial", regParam=1e-3, maxIter=40, standardization=False, featuresCol="_qx", labelCol="_qy", probabilityCol="_qp", rawPredictionCol="_qr", predictionCol="_qc").fit(taught)


def posteriors(docs: DataFrame, model: LogisticRegressionModel | None) -> DataFrame:
    """Adds ``tokens`` (words of the whole text) and ``p`` (a posterior for each domain; without a model all good)."""
    b = F.btrim(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(common.SPACE))
    tokens = F.when(b == "", 0).otherwise(F.size(F.split(b, r"[\x20\x09-\x0D]+"))).cast("long")
    df = docs.withColumn("tokens", tokens)
    if model is None:
        return df.withColumn("p", F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)))
    return model.transform(_features(df)).withColumn("p", vector_to_array("_qp")).drop("_qx", "_qr", "_qp", "_qc")


def _dot(p: Column, g: Column) -> Column:
    return F.aggregate(F.zip_with(p, g, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def rate_column(steps: list[list[float]]) -> Column:
    """Rate of a row from its posteriors ``p`` and the steps taken so far: from 1, each step goes down by p . g, to 0 at least."""
    if not steps:
        return F.lit(1.0)
    all_steps = F.array(*[F.array(*map(F.lit, g)) for g in steps])
    return F.aggregate(all_steps, F.lit(1.0), lambda r, g: F.greatest(F.lit(0.0), r - _dot(F.col("p"), g)))


def solve(rows: DataFrame, targets: list[float], tolerance: float = 1e-6, rounds: int = 60) -> tuple[list[list[float]], list[float]]:
    """Rates r >= 0 for min |A r - targets|, where A has tokens * p of each row of ``rows``; of the best ones those nearest to 1.

    The unknowns, one for each document, never leave the table. Residuals are weighed by the inverse of the Gram matrix G of A
    (tokens as the metric of the rates), and EPSILON times the squared distance from 1 is added. Then the best rates are
    max(0, 1 - p . x) with a number x for each domain, and x is the least of a convex function of as many unknowns:
    sum tokens * rate^2 / 2 + x . targets + EPSILON * x G x / 2. Newton's steps, halved until it falls, find it; a round is one
    sum over the table and only domain totals and products come back. Its slope, A r - targets - EPSILON * G x, is the
    condition for the best: the search ends when no domain's is over ``tolerance`` of the sum of targets, or when rounding
    lets nothing fall. Returns x as one step (none if 1 is the answer) and the totals reached."""
    k = len(targets)
    p = [F.element_at("p", i + 1) for i in range(k)]
    goal, scale = np.array(targets, float), max(sum(targets), 1.0)
    upper = [(i, j) for i in range(k) for j in range(i, k)]

    def at(x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Half of the sum of tokens * rate^2, domain totals, and products of the rows that have a rate."""
        rated = rows.withColumn("rate", rate_column([x.tolist()]))
        live = F.when(F.col("rate") > 0, F.col("tokens"))
        sums = [F.sum(F.col("tokens") * F.col("rate") * F.col("rate") / 2), *[F.sum(F.col("tokens") * y * F.col("rate")) for y in p], *[F.sum(live * p[i] * p[j]) for i, j in upper]]
        half, *rest = [y or 0.0 for y in rated.agg(*sums).first()]
        products = np.zeros((k, k))
        for (i, j), y in zip(upper, rest[k:]):
            products[i, j] = products[j, i] = y
        return half, np.array(rest[:k]), products

    x = np.zeros(k)
    half, totals, products = at(x)
    ridge = EPSILON * products
    live = np.flatnonzero(np.diag(products) > 1e-12 * np.trace(products))  # a domain that no row has can't be met
    value = half
    for _ in range(rounds):
        slope = (goal - totals + ridge @ x)[live]
        if not len(live) or np.abs(slope).max() <= tolerance * scale:
            break
        step = np.zeros(k)
        step[live] = np.linalg.lstsq((products + ridge)[np.ix_(live, live)], -slope, rcond=None)[0]
        while True:
            tried = x + step
            half, now, found = at(tried)
            new = half + goal @ tried + tried @ ridge @ tried / 2
            if new < value or np.abs(step).max() <= 1e-9 * max(1.0, np.abs(x).max()):
                break
            step /= 2
        if new >= value:
            break
        x, value, totals, products = tried, new, now, found
    return ([x.tolist()] if x.any() else []), totals.tolist()


def natural(rows: DataFrame) -> list[float]:
    """Expected tokens of each domain as the table is."""
    return [x or 0.0 for x in rows.agg(*[F.sum(F.col("tokens") * F.element_at("p", i + 1)) for i in range(len(DOMAINS))]).first()]


def without_toxic(rows: DataFrame) -> list[float]:
    """Good and poor tokens as they are; of toxic ones what the posteriors of documents imply that are likelier not toxic.

    A target of zero can't be met while clean documents have any toxic posterior, and would push down all of them."""
    clean = F.element_at("p", 3) < F.greatest(F.element_at("p", 1), F.element_at("p", 2))
    floor = rows.where(clean).agg(F.sum(F.col("tokens") * F.element_at("p", 3))).first()[0]
    return [*natural(rows)[:2], floor or 0.0]


def rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, seed: int = 0) -> DataFrame:
    """``doc_id``, ``h`` (hash of doc_id and text), ``tokens``, ``p``, ``rate`` and ``copies`` (long) of every document.

    ``weights`` are shares of the tokens of the table that each domain shall have; by default good and poor stay as they are
    and toxic tokens go as far as they can (:func:`without_toxic`). ``rate`` is how often a document is to be seen on average; ``copies`` is that number rounded up or
    down by a hash of doc_id, so the expected totals meet the targets as well as the rates do. A null or empty text has no
    tokens. Equal rows get equal answers; an empty table gives none. Other columns are not used."""
    key = F.xxhash64("doc_id", "text")
    small = common.written(posteriors(docs.select("doc_id", "text", key.alias("h")), fit(docs, labels)).select("doc_id", "h", "tokens", "p"))
    total = sum(natural(small))
    goal = [total * weights.get(d, 0.0) for d in DOMAINS] if weights else without_toxic(small)
    steps, _ = solve(small, goal)
    u = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return small.withColumn("rate", rate_column(steps)).withColumn("copies", F.floor(F.col("rate") + u))


def mixed(docs: DataFrame, rated: DataFrame, times: Column) -> DataFrame:
    """Documents as often as ``times`` of their row in ``rated`` says, with their own columns; at 0 they go."""
    names = docs.columns
    many = rated.select(F.col("h").alias("_qh"), times.cast("int").alias("_qn")).dropDuplicates(["_qh"]).where("_qn > 0")
    joined = docs.join(many, F.xxhash64("doc_id", "text") == F.col("_qh"))
    return joined.withColumn("_qi", F.explode(F.sequence(F.lit(1), F.col("_qn")))).select(names)
