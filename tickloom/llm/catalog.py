"""Queries of this subpackage over the given tables, and their SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloomlm, collocations, common, curvepack, feistel, licenses, mixture, pagediff, refine, rules, simhash, squares, tokenfile, topk
from .tokens import public_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op1_top_k",
    """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    ), s AS (
        SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
        FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
    ), r AS (
        SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s
    )
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
)
def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk.top_k(rows.where("vec_id % 50 = 0"), rows, "vec_id", "embedding", k=5, scale=256.0)


@query("op2_page_text")
def op2_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagediff.extract(table(spark, sf_dir, "pages"))


@query("op3_mixing")
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixture.rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), {"good": 0.85, "poor": 0.15})
    p = [F.element_at("p", i + 1).alias(f"p_{d}") for i, d in enumerate(mixture.DOMAINS)]
    return out.select("doc_id", "tokens", *p, "rate", "copies")


@query("op4_lm_scores")
def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloomlm.score(table(spark, sf_dir, "documents"))


@query("op5_near_duplicates")
def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=2, shingle=3)


@query("op6_quality_rules")
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learned = rules.fit(docs, table(spark, sf_dir, "labels"))
    return rules.judged(docs, learned).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


@query("op7_packing")
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = curvepack.pack(table(spark, sf_dir, "documents"), public_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op8_sharding")
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = feistel.shard_rows(rows, "doc_id", ["text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


@query("op9_token_file")
def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.shared_folder(spark)
    tokenfile.write_token_file(table(spark, sf_dir, "documents"), path, public_path())
    return tokenfile.read_token_file(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query(
    "op10_repeats",
    """
    WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
    w AS (SELECT doc_id, b, unnest(range(0, octet_length(b) - 49)) AS i FROM d),
    s AS (SELECT doc_id, i, b[i + 1 : i + 50] AS s FROM w),
    m AS (SELECT s, min(doc_id) AS f FROM s GROUP BY s),
    g AS (SELECT s.doc_id, s.i FROM s JOIN m USING (s) WHERE m.f < s.doc_id),
    p AS (SELECT doc_id, b, unnest(range(0, octet_length(b))) AS p FROM d),
    c AS (SELECT p.doc_id, p.p, coalesce(max(g.i) OVER (PARTITION BY p.doc_id ORDER BY p.p) > p.p - 50, false) AS gone FROM p LEFT JOIN g ON g.doc_id = p.doc_id AND g.i = p.p),
    e AS (SELECT *, gone <> coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), NOT gone) AS turns FROM c),
    r AS (SELECT doc_id, p AS lo, gone, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS hi FROM e WHERE turns),
    k AS (SELECT r.doc_id, sum(coalesce(hi, octet_length(b)) - lo) FILTER (gone) AS n_removed, count(*) FILTER (gone) AS n_spans,
      string_agg(hex(b[lo + 1 : coalesce(hi, octet_length(b))]), '' ORDER BY lo) FILTER (NOT gone) AS kept FROM r JOIN d USING (doc_id) GROUP BY r.doc_id)
    SELECT d.doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
    FROM d LEFT JOIN k USING (doc_id)
    """,
)
def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = refine.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), width=50)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op13_runs")
def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = squares.collapse(table(spark, sf_dir, "documents"), least=12, edit=squares.looped)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("q"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    out = out.withColumn("best", best)
    start, length, period = -F.col("best.s"), F.col("best.length"), -F.col("best.q")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.expr("(1000 * best.length) div (-best.q)").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query("op12_licenses")
def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(table(spark, sf_dir, "documents"))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return out.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places.word").alias("first_word"), F.array_max("places.word").alias("last_word"),
        joined(F.col("places.label")).alias("base_labels"), joined(F.concat("places.label", "detections.label")).alias("labels"), "score", F.size("detections").cast("long").alias("n_detections"),
    )


@query(
    "op11_phrases",
    r"""
    WITH d AS (
        SELECT coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces
        FROM documents
    ), p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(pieces) AS piece FROM d)
    ), t AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p
    ), g AS (SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase FROM t, (VALUES (1), (2), (3), (4)) AS s(m) WHERE i + m - 1 <= len(w)
    ), f AS (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL
    ), n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang
    ), c AS (SELECT lang, m, phrase, string_split(phrase, ' ') AS w, a FROM f WHERE m > 1 AND a >= 30
    ), k AS (SELECT *, unnest(range(1, m)) AS cut FROM c
    ), s AS (
        SELECT k.lang, k.phrase, k.a, cut, x.a AS l, y.a AS r, ((2000000::HUGEINT * k.a) // (x.a + y.a))::BIGINT AS score
        FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(k.w[: cut], ' ') AND x.m = cut
        JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(k.w[cut + 1 :], ' ') AND y.m = k.m - cut
    ), b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS o FROM s
    ), h AS (
        SELECT lang, array_to_string(w[i : i + z - 1], ' ') AS phrase, max(a) AS above
        FROM (SELECT lang, w, a, m, unnest(range(1, m)) AS i FROM c WHERE m > 2), (VALUES (2), (3)) AS q(z) WHERE z < m AND i + z - 1 <= m GROUP BY ALL
    ), v AS (
        SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
        FROM b LEFT JOIN h ON h.lang = b.lang AND h.phrase = b.phrase WHERE o = 1 AND (above IS NULL OR 100 * above < 80 * a)
    )
    SELECT v.lang, rank, phrase, a, l, r, n, score, cut FROM v JOIN n ON n.lang = v.lang WHERE rank <= 2000
    """,
)
def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.phrases(table(spark, sf_dir, "documents"), least=30, longest=4, keep=2000, share=80)
