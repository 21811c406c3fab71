"""Operators of tickloom.llm against plain versions, on small tables with nulls, empties, ties, copies and clashing columns."""

from __future__ import annotations

import math
import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import bloomlm, components, curvepack, feistel, minhash, mixture, pagediff, refine, rules, simhash, tokenfile, tokens, topk

SMALLEST = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i * 7919 % 100003}" for i in range(9000))


def texts(seed: int = 5, n: int = 60) -> list[tuple[int | None, str | None]]:
    """Random texts, near and exact copies, shared passages, repeated windows, odd white space, junk, empty, null, very long."""
    rnd = random.Random(seed)
    vocab = ["the", "of", "and", "Straße", "été", "naïve", *(f"k{i}" for i in range(300))]
    say = lambda k: " ".join(rnd.choice(vocab) for _ in range(k))
    out = [say(rnd.randrange(30, 200)) for _ in range(n)]
    passage = say(60)
    for i in range(0, n, 4):
        out[i] = out[i][:80] + " " + passage + " " + out[i][80:]
    for i in range(1, n, 6):
        w = out[i].split(" ")
        w[len(w) // 2] = "changed"
        out.append(" ".join(w))
    out += [out[2]] * 5 + [say(12) + "\n" + " ".join([say(9)] * 6), "one", "two words", "", "   \t\n ", "a\tb  c d \n\n e", "ab" * 400, "#$%& " * 30, LONG, LONG + " tail", "é" * 60, "xé" + "é" * 60]
    rows = list(enumerate(out)) + [(len(out), None)]
    rnd.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return texts()


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, part string, h int").repartition(3)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, part string, h int")


def got(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


def test_near_duplicates(spark, rows):
    odd = [*rows, (None, "nameless text of a few words"), rows[0]]
    assert got(simhash.near_duplicates(frame(spark, odd)), "doc_id", "fingerprint", "component_id") == sorted(brute.near_duplicates(odd), key=str)
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_links_cover_radius(spark):
    rnd = random.Random(1)
    base = [rnd.getrandbits(64) for _ in range(20)]
    fps = sorted({b ^ sum(1 << x for x in rnd.sample(range(64), rnd.randrange(5))) for b in base for _ in range(40)} | set(base))
    signed = [simhash._signed(x) for x in fps]
    root = {r.node: r.root for r in components.components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")), "a", "b").collect()}
    find = {x: x for x in signed}

    def top(x):
        while find[x] != x:
            x = find[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 2:
                find[top(simhash._signed(a))] = top(simhash._signed(b))
    want = {}
    for x in signed:
        want.setdefault(top(x), []).append(x)
    assert {x: root.get(x, x) for x in signed} == {x: min(g) for g in want.values() for x in g}
    masks = simhash.covering_masks(2)
    for radius in range(1, 7):
        weights = [m.bit_count() for m in simhash.covering_masks(radius)]
        assert len(weights) == 2 ** (radius + 1) - 1 and min(weights) >= 30
    wide = simhash.covering_masks(6)
    assert all(any(not m & d for m in wide) for d in (sum(1 << x for x in rnd.sample(range(64), 6)) for _ in range(300)))
    assert len(masks) == 7 and all(any(not (m >> i | m >> j) & 1 for m in masks) for i in range(64) for j in range(64))


def test_links_of_a_wide_radius(spark):
    rnd = random.Random(8)
    base = [rnd.getrandbits(64) for _ in range(30)]
    fps = {b: b for b in base} | {b ^ sum(1 << x for x in rnd.sample(range(64), rnd.randrange(1, 7))): b for b in base for _ in range(20)}
    signed = {simhash._signed(x): simhash._signed(b) for x, b in fps.items()}
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 6)
    assert found.where("bit_count(a ^ b) > 6").count() == 0
    root = {r.node: r.root for r in components.components(found, "a", "b").collect()}
    same = sum(root.get(x) == root.get(b) for x, b in signed.items())
    assert same >= 0.93 * len(signed)  # a star of twenty copies each up to six bits away is the hard case


def test_near_duplicate_stage_against_all_pairs(spark, monkeypatch):
    """Stars of copies with a few changed words, similarities around 0.8: the kept ids equal those of comparing every pair."""
    import corpus_pipeline

    monkeypatch.setattr(minhash, "BLOCK", 4)
    rnd = random.Random(6)
    docs = []
    for _ in range(12):
        base = [f"v{rnd.randrange(3000)}" for _ in range(200)]
        for c in range(20):
            w = list(base)
            for at in rnd.sample(range(200), c % 8):
                w[at] = f"new{rnd.randrange(10**6)}"
            docs.append(" ".join(w))
    docs += [docs[0], docs[0].upper(), "one", "", " ", "two words"]
    rnd.shuffle(docs)
    sets = [minhash.shingles(t, 5) for t in docs]
    root = list(range(len(docs)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(np.intersect1d(a, b))
            if both >= 0.8 * (len(a) + len(b) - both):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    want = {top(i) for i in range(len(docs))}
    assert 20 < len(want) < 150
    df = spark.createDataFrame([*enumerate(docs), (None, docs[3])], "doc_id long, text string")
    out = corpus_pipeline.near_duplicates(spark, df, SMALLEST)
    assert sorted(r.doc_id for r in out.where("doc_id is not null").collect()) == sorted(want)
    assert out.where("doc_id is null").count() == 1
    assert minhash.kept_ids(empty(spark)).count() == 0


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000)]
    out = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    assert out == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(300)}}


def test_quality_counts(spark, rows):
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    out = rules.judged(frame(spark, rows), [])
    assert {"part", "h", "kept"} <= set(out.columns)
    assert got(out, *cols) == sorted([(d, *brute.quality_counts(t)) for d, t in rows], key=str)
    assert rules.judged(empty(spark), []).count() == 0


def test_rules_are_learned_and_kept_native(spark):
    rnd = random.Random(3)
    say = lambda: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(40))
    docs = [(i, say() if i % 5 else say().replace(" ", "% ")) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(0, 400, 2)] + [(None, 1, 0), (3, None, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    df = frame(spark, docs)
    out = rules.judged(df, rules.fit(df, labels))
    assert {r.doc_id for r in out.where("not kept").collect()} == {i for i in range(400) if i % 5 == 0}
    assert "Python" not in out._jdf.queryExecution().toString()
    assert rules.fit(df, labels.where("false")) == [] and rules.fit(empty(spark), labels) == []


def test_repeats(spark, rows):
    odd = [*rows, (None, rows[3][1])]
    out = got(refine.remove_repeats(frame(spark, odd)).withColumn("s", F.sha2("kept", 256)), "doc_id", "n_bytes", "n_removed", "n_spans", "s")
    assert out == sorted([(d, *x) for d, x in brute.repeats(odd).items()], key=str)
    assert refine.remove_repeats(empty(spark)).count() == 0
    text = refine.remove_repeats(frame(spark, odd), as_text=True).where("n_removed = 0 and text is not null")
    assert text.where("text <> kept").count() == 0


def test_repeats_with_dealt_out_buckets(spark, rows, monkeypatch):
    """A bucket is hot from three rows on, and tasks send rows on after a few texts."""
    monkeypatch.setattr(refine, "HOT", 3)
    monkeypatch.setattr(refine, "HELD", 500)
    monkeypatch.setattr(refine, "CHUNK", 700)
    out = got(refine.remove_repeats(frame(spark, rows)).withColumn("s", F.sha2("kept", 256)), "doc_id", "n_bytes", "n_removed", "n_spans", "s")
    assert out == sorted([(d, *x) for d, x in brute.repeats(rows).items()], key=str)


def test_language_model(spark, rows):
    out = {r.doc_id: r for r in bloomlm.score(frame(spark, [*rows, rows[0]]).withColumn("held_out", F.lit("clash"))).collect()}
    want = brute.base_scores(rows)
    assert out.keys() == want.keys()
    # the repeated row counts twice in training
    want = {r.doc_id: r for r in bloomlm.score(frame(spark, rows)).collect()}
    base = brute.base_scores(rows)
    for d, (held, n, known, train, score) in base.items():
        r = want[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, train)
        assert math.isclose(r.base_score, score, rel_tol=1e-9) and r.score < 0
    assert bloomlm.score(empty(spark)).count() == 0


def test_language_model_in_several_passes(spark, rows, monkeypatch):
    one = {r.doc_id: r.score for r in bloomlm.score(frame(spark, rows)).collect()}
    # limits that still hold the largest segment: words alone in one pass, pairs in several; then both in several
    for limit in (0.024, 0.012):
        monkeypatch.setattr(bloomlm, "MAX_MB", limit)
        many = {r.doc_id: r.score for r in bloomlm.score(frame(spark, [*rows, rows[3], rows[3]])).collect()}
        again = {r.doc_id: r.score for r in bloomlm.score(frame(spark, rows)).collect()}
        assert one.keys() == many.keys() == again.keys()
        assert all(math.isclose(one[d], again[d], rel_tol=1e-9) for d in one), limit


def test_language_model_against_exact_counts(spark, rows):
    """Scores of the filter against the same smoothing on exact counts, rounded to levels alike."""
    want = brute.bigram_scores(rows, bloomlm.BASE, bloomlm.MU)
    out = {r.doc_id: r.score for r in bloomlm.score(frame(spark, rows)).collect()}
    assert out.keys() == want.keys()
    near = sum(abs(out[d] - want[d]) <= 0.01 * abs(want[d]) for d in want)
    assert near >= 0.99 * len(want) and all(abs(out[d] - want[d]) <= 0.05 * abs(want[d]) for d in want)


def test_log_filter():
    key = bloomlm.common.mix(np.arange(5000, dtype=np.uint64))
    level = bloomlm.levels(np.arange(5000) % 40 + 1)
    size = int(level.sum() * bloomlm.HASHES / math.log(2)) + 1
    f = bloomlm.LogFilter({2: bloomlm.fill_segment(key, level, size)}, size)
    seen = f.level(key, np.full(5000, 2))
    assert (seen >= level).all() and (seen == level).mean() > 0.9
    assert (f.level(key, np.full(5000, 1)) == -1).all()
    new = f.level(bloomlm.common.mix(np.arange(10**6, 10**6 + 5000, dtype=np.uint64)), np.full(5000, 2))
    assert (new > 0).mean() < 0.08


def test_top_k(spark):
    rnd = random.Random(2)
    data = [(i, [rnd.choice([-0.5, 0.25, 0.1]) for _ in range(4)]) for i in range(300)]  # many ties
    data += [(300, None), (350, [1.0, None, 0.0, 0.0]), (400, [float("nan")] * 4), (401, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4), (450, [0.5, 0.5]), (451, [0.1, 0.2]), (500, []), (550, [3e30, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in data], "vec_id long, embedding array<float>, score int, block string")
    data = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in data]
    want = sorted(brute.top_k(data))
    assert sorted(got(topk.top_k(df.where("vec_id % 50 = 0"), df, "vec_id", "embedding"), "query_id", "rank", "vec_id", "score")) == want
    none = df.where("false")
    assert topk.top_k(none, none, "vec_id", "embedding").count() == 0


def test_top_k_tiles(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 16)
    monkeypatch.setattr(topk, "BLOCK", 5)
    monkeypatch.setattr(topk, "FAN", 3)
    rnd = random.Random(4)
    data = [(i, [rnd.uniform(-1, 1) for _ in range(8)]) for i in range(700)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    assert sorted(got(topk.top_k(df.where("vec_id % 50 = 0"), df, "vec_id", "embedding"), "query_id", "rank", "vec_id", "score")) == sorted(brute.top_k(data))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
<nav><ul><li><a href=/a>Menu</a></li></ul></nav><!-- <p>hidden</p> --><div class="ad">Buy %d</div><header>Site</header>
<article><h1>Head &amp; line</h1><p>First  <b>bold</b> &#233;t&eacute;<br>more<p>Second%s</p><aside>side</aside><div class="comments"><p>nice post</p></div>
<form>name <input name=x></form></article><div id="cookie-notice">ok?</div><footer>&copy; all</footer></body>"""


def test_page_text(spark):
    rows = [(i, f"http://a.org/x/{i}", PAGE % (i, i), 1) for i in range(30)]
    plain = "<body><div>Top</div><div>Links</div><p>Story {0} of the day</p><p>More {0} &lt;b&gt;</p><div>Bottom</div></body>"
    rows += [(100 + i, f"https://b.org/{i}", plain.format(i), 1) for i in range(4)]
    rows += [(200, None, None, 1), (201, "http://c.org/", "", 1), (202, "http://d.org/y", "<p>alone", 1), (None, "http://d.org", "no tags at all", 1)]
    out = {r.page_id: r for r in pagediff.extract(spark.createDataFrame(rows, "page_id long, url string, html string, part int"), sample=3).collect()}
    assert len(out) == len(rows)
    for i in range(30):
        assert out[i].text == f"Head & line\n\nFirst bold été more\n\nSecond{i}"
    for i in range(4):
        assert out[100 + i].text == f"Story {i} of the day\n\nMore {i} <b>"
    assert [out[i].text for i in (200, 201, 202, None)] == ["", "", "alone", "no tags at all"]
    assert all(r.n_chars == len(r.text) for r in out.values())
    assert pagediff.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_template_lines_in_an_article_go(spark):
    """Adverts and notices without a telling class; a quote of two neighbours and an article under several URLs stay."""
    story = lambda i: " ".join(f"s{i}w{k}" for k in range(30))
    body = "<body><article><h1>Title {0}</h1><p>Buy our kettle today</p><p>{1}</p>{2}<p>Tell your friends</p></article></body>"
    rows = [(i, f"http://a.org/x/{i:02d}", body.format(i, story(i), "<p>A famous quote</p>" if i in (4, 5) else "")) for i in range(12)]
    rows += [(50 + i, f"http://b.org/{i}", f"<main><p>{story(99)}</p><p>Copy {i}</p></main>") for i in range(3)]
    out = {r.page_id: r.text for r in pagediff.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), sample=3).collect()}
    for i in range(12):
        assert out[i].split("\n\n") == [f"Title {i}", story(i), *(["A famous quote"] if i in (4, 5) else [])]
    assert all(out[50 + i] == f"{story(99)}\n\nCopy {i}" for i in range(3))


def test_copies_without_an_article_stay():
    """Equal and nearly equal pages with no article keep their text; other neighbours still take the template out."""
    story = [f"<p>{' '.join(f's{i}w{k}' for k in range(40))}</p>" for i in range(4)]
    page = lambda *body: pagediff.lines("<body><div>Top line</div>" + "".join(body) + "<div>Bottom line</div></body>")
    a, b, c = page(*story[:3]), page(*story[:3], "<p>Printed</p>"), page(story[3])
    whole = "\n\n".join(x for x, _ in a)
    told = "\n\n".join(x for x, _ in a[1:-1])
    assert pagediff.main_text(a, [a]) == pagediff.main_text(a, [a, b]) == whole
    assert pagediff.main_text(a, [c]) == pagediff.main_text(a, [a, c]) == told
    assert pagediff.main_text(b, [a, c]) == told + "\n\nPrinted"
    assert pagediff.main_text([], [a]) == pagediff.main_text([], []) == ""


def test_broken_pages_take_linear_time():
    """Tags, quotes and elements that never close; 1 MB each. Defined results on small ones."""
    import time

    end = "</body>"
    for unit in ("<a ", '<a x="', "<a x='\">", "<", "<i>", "<i><p>", "<!", "<p", "&", "<div x=\"'>"):
        for tail in ("", end, '"' + end):
            t = time.process_time()
            pagediff.lines(unit * (1_000_000 // len(unit)) + tail)
            assert time.process_time() - t < 20, (unit, tail)
    t = time.process_time()
    pagediff.lines("<i>" * 100_000 + "<p>x</p>" * 50_000 + "</i>" * 100_000)
    assert time.process_time() - t < 20
    text = lambda x: [line for line, _ in pagediff.lines(x)]
    assert text("<p>one<p>two <a ") == ["one", "two <a"]
    assert text('<p>one<a href="x>two</a><p>three') == ["onetwo", "three"]
    assert text('<p title="a > b">one</p>a < b') == ["one", "a < b"]


def test_shared_lines_are_a_longest_common_subsequence():
    def length(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = row[:]
            for j, y in enumerate(b):
                row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
        return row[-1]

    rnd = random.Random(7)
    for _ in range(400):
        a, b = ([rnd.randrange(6) for _ in range(rnd.randrange(16))] for _ in range(2))
        for cells in (1 << 24, 4):
            at = pagediff.shared(a, b, cells)
            rest = iter(b)
            assert len(at) == length(a, b) and at == sorted(set(at)) and all(a[i] in rest for i in at)


def test_mixing_meets_targets(spark):
    rnd = random.Random(9)
    good, bad, rude = ([f"{p}{i}" for i in range(30)] for p in ("good", "poor", "rude"))
    docs = [(i, " ".join(rnd.choice((good, bad, rude)[i % 3]) for _ in range(20 + i % 50))) for i in range(600)] + [(1000, None), (1001, ""), (None, "good1 good2")]
    labels = spark.createDataFrame([(i, int(i % 3 != 1), int(i % 3 == 2)) for i in range(0, 600, 4)] + [(None, 0, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    df = frame(spark, docs)
    out = {r.doc_id: r for r in mixture.rates(df, labels, {"good": 0.7, "poor": 0.3}).collect()}
    assert len(out) == len(docs)
    held = [i for i in range(600) if i % 4]
    right = sum(max(range(3), key=lambda k: out[i].p[k]) == (0, 1, 2)[i % 3] for i in held)
    assert right > 0.95 * len(held)
    total = sum(r.tokens for r in out.values())
    made = [sum(r.tokens * r.p[k] * r.rate for r in out.values()) for k in range(3)]
    assert abs(made[0] - 0.7 * total) < 0.02 * total and abs(made[1] - 0.3 * total) < 0.02 * total and made[2] < 0.03 * total
    assert all(r.rate >= 0 and abs(r.copies - r.rate) < 1 for r in out.values())
    copies = mixture.mixed(df, mixture.rates(df, labels), F.floor(F.col("rate") + 0.5))
    kept = {r.doc_id for r in copies.collect()}
    assert copies.columns == df.columns and {i for i in range(600) if i % 3 == 0} <= kept and sum(i in kept for i in range(2, 600, 3)) < 10
    assert mixture.rates(empty(spark), labels).count() == 0
    assert {r.rate for r in mixture.rates(df, labels.where("false")).collect()} == {1.0}


def test_mixing_stage_keeps_clean_documents(spark, tmp_path):
    """Clean documents use a few rude words, toxic ones many: posteriors are soft. Counted on documents without a label, too."""
    import corpus_pipeline

    rnd = random.Random(12)
    good, bad, rude = ([f"{p}{chr(97 + i % 20)}{chr(97 + i // 20)}" for i in range(40)] for p in ("good", "poor", "rude"))  # words are letters
    say = lambda own, share: " ".join(rnd.choice(rude if rnd.random() < share else own) for _ in range(40))
    docs = [(i, say((good, bad, good)[i % 3], 0.7 if i % 3 == 2 else rnd.uniform(0, 0.45))) for i in range(1200)]
    spark.createDataFrame([(i, int(i % 3 != 1), int(i % 3 == 2)) for i in range(0, 1200, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r.doc_id for r in corpus_pipeline.mixing(spark, frame(spark, docs), str(tmp_path)).collect()}
    for odd in (0, 1):  # labelled, not labelled
        clean, toxic = ([i for i in range(odd, 1200, 2) if (i % 3 == 2) == t] for t in (False, True))
        assert sum(i in kept for i in clean) >= 0.95 * len(clean)
        assert sum(i in kept for i in toxic) <= 0.1 * len(toxic)


def test_steps_solve_least_squares(spark):
    rnd = np.random.default_rng(0)
    p = rnd.dirichlet([0.5, 0.5, 0.2], 300)
    t = rnd.integers(10, 500, 300)
    rows = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(t, p)], "tokens long, p array<double>")
    now = (t[:, None] * p).sum(0)
    goal = [now[0] * 1.5, now[1] * 0.4, now[2] * 0.3]
    steps, reached = mixture.solve(rows, goal)
    assert np.abs(np.array(reached) - goal).max() < 1e-3 * sum(goal)
    rates = np.array([r[0] for r in rows.select(mixture.rate_column(steps)).collect()])
    assert (rates >= 0).all() and np.allclose((t[:, None] * p * rates[:, None]).sum(0), reached)


def test_steps_at_a_target_on_the_border(spark):
    """No toxic tokens wanted where every row has some: as good as a long run of an accelerated gradient over all rates."""
    rnd = np.random.default_rng(3)
    p = rnd.dirichlet([2.0, 0.6, 0.3], 400) * 0.97 + 0.01
    t = rnd.integers(10, 500, 400)
    a = (t[:, None] * p).T
    goal = np.array([0.85, 0.15, 0.0]) * t.sum()
    weight = np.linalg.inv(a @ p)
    loss = lambda r: float((a @ r - goal) @ weight @ (a @ r - goal)) / t.sum()
    r, y, m = np.ones(400), np.ones(400), 1.0
    for _ in range(40_000):
        new = np.maximum(0, y - p @ (weight @ (a @ y - goal)))
        n = (1 + (1 + 4 * m * m) ** 0.5) / 2
        r, y, m = new, new + (m - 1) / n * (new - r), n
    rows = spark.createDataFrame([(int(x), b.tolist()) for x, b in zip(t, p)], "tokens long, p array<double>")
    steps, reached = mixture.solve(rows, goal.tolist())
    found = np.array([x[0] for x in rows.select(mixture.rate_column(steps)).collect()])
    assert np.allclose(a @ found, reached) and loss(found) <= loss(r) * 1.02 + 1e-5


@pytest.fixture(scope="module")
def ids(rows):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokens.public_path())
    return {d: lib.encode(t or "", add_special_tokens=False).ids for d, t in rows}


def test_encoder(rows, ids):
    enc = tokens.Encoder(tokens.public_path(), keep=50)
    more = ["don't  stop", " lead", "tail ", "a\n\nb", "x<|endoftext|>y z", "a b c", "１２ ½ ٣", "\x1c a", "word " * 3 + "end"]
    for _ in range(2):
        for t, raw in zip([t or "" for _, t in rows], enc.encode([t or "" for _, t in rows])):
            assert np.frombuffer(raw, enc.kind).tolist() == enc.lib.encode(t, add_special_tokens=False).ids
        for t, raw in zip(more, enc.encode(more)):
            assert np.frombuffer(raw, enc.kind).tolist() == enc.lib.encode(t, add_special_tokens=False).ids


def test_token_file(spark, rows, ids, tmp_path):
    tokenfile.write_token_file(frame(spark, [*rows, (None, "no id")]), f"{tmp_path}/t", tokens.public_path(), block_ids=500)
    out = sorted(tokenfile.read_token_file(spark, f"{tmp_path}/t").collect(), key=lambda r: r.start)
    assert out[0].doc_id is None and [r.doc_id for r in out[1:]] == sorted(ids)
    at = 0
    for r in out:
        x = np.frombuffer(r.ids, "<u4").tolist()
        assert (r.start, r.n_tokens) == (at, len(x)) and (r.doc_id is None or x == [*ids[r.doc_id], 2])
        at += len(x)
    block = spark.read.parquet(f"{tmp_path}/t").where("n_docs > 2").first()
    for i, d in enumerate(block.doc_ids):
        assert d is None or tokenfile.read_document(bytes(block.data), i).tolist() == [*ids[d], 2]
    tokenfile.write_token_file(empty(spark), f"{tmp_path}/e", tokens.public_path())
    assert tokenfile.read_token_file(spark, f"{tmp_path}/e").count() == 0


@pytest.mark.parametrize("bits", [1, 5, 8, 11, 16, 17, 31, 32])
def test_bit_packing(bits):
    x = np.random.default_rng(bits).integers(0, 1 << bits, 1003).astype(np.uint32)
    data = tokenfile.pack_bits(x, bits)
    assert len(data) == (1003 * bits + 7) // 8
    for s, e in ((0, 1003), (0, 0), (1, 2), (17, 900), (1000, 1003)):
        assert (tokenfile.unpack_bits(data, bits, s, e) == x[s:e]).all()


def test_packing(spark, rows, ids):
    out = curvepack.pack(frame(spark, rows), tokens.public_path()).withColumn("crc", F.crc32("ids"))
    cols = ("doc_id", "start", "length", "crc", "doc_tokens", "sequence_id", "offset")
    pad = brute.pieces_ok(got(out, *cols), {d: [*x, 1] for d, x in ids.items()})
    assert pad == 0
    assert curvepack.pack(empty(spark), tokens.public_path()).count() == 0
    assert curvepack.pack(frame(spark, [(None, None), (1, "a"), (1, "a")]), tokens.public_path()).count() >= 3


def test_hilbert_curve_visits_each_cell_once_in_single_steps():
    side = np.arange(8)
    cells = np.stack(np.meshgrid(side, side, side, indexing="ij"), -1).reshape(-1, 3)
    key = curvepack.hilbert_key(cells, 3)
    assert sorted(key.tolist()) == list(range(512))
    path = cells[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("n", [1, 2, 3, 10, 255, 256, 257, 5000])
def test_permutation(n):
    p = feistel.Permutation(n, seed=11)
    place = p.place(np.arange(n))
    assert sorted(place.tolist()) == list(range(n)) and (p.row(place) == np.arange(n)).all()


def test_sharding(spark, rows):
    df = frame(spark, [*rows, (None, "n"), rows[0]]).select("doc_id", F.crc32(F.coalesce("text", F.lit(""))).alias("c"), F.lit(1).alias("key"))
    out = feistel.shard_rows(df, "doc_id", ["c"], shards=7, seed=3).collect()
    sizes = [sum(r.shard == s for r in out) for s in range(7)]
    assert len(out) == len(rows) + 2 and max(sizes) - min(sizes) <= 1
    for s in range(7):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sizes[s]))
    perm = feistel.Permutation(len(out), 3)
    for i, r in enumerate(sorted(out, key=lambda r: r.row_number)):
        assert r.row_number == i and int(perm.place(np.array([i]))[0]) == r.place == r.slot * 7 + r.shard
    named = [r.doc_id for r in sorted(out, key=lambda r: r.row_number)]
    assert named[0] is None and named[1:] == sorted(named[1:])
    assert feistel.shard_rows(df.where("false"), "doc_id", ["c"]).count() == 0
    assert zlib.crc32(b"") == 0


def test_pipeline_on_the_smallest_table(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALLEST}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, SMALLEST)
        assert out.columns == docs.columns, name
        n, before = out.count(), kept.count()
        assert 0 < n <= before, name
        kept = corpus_pipeline.common.written(out)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "repeats", "mixing", "packing"]
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SMALLEST)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in kept.collect()}
    want = brute.repeats([(r.doc_id, r.text) for r in kept.collect()])
    assert all(x[1] == 0 or x[0] > 0 for x in want.values())


def test_no_pairs_of_unlike_rows_leave_a_tile(spark, monkeypatch):
    """600 texts that all share half of their words (similarity about 0.7, so bands meet but nothing links), and a chain of near
    copies among them: the kept ids equal those of all pairs, and no step of the plan makes rows by the square."""
    rnd = random.Random(21)
    base = [f"b{i}" for i in range(200)]
    docs = []
    for i in range(600):
        w = list(base)
        for at in rnd.sample(range(40), 8):  # clustered changes: similarity about 0.7 between most
            w[at * 5] = f"c{i}x{at}"
        docs.append(" ".join(w))
    for i in range(0, 60, 2):
        docs.append(docs[i].replace(" b199", f" tail{i}"))
    sets = [set(minhash.shingles(t, 5).tolist()) for t in docs]
    root = list(range(len(docs)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    want = {top(i) for i in range(len(docs))}
    made = []
    real = minhash._other_links
    monkeypatch.setattr(minhash, "_other_links", lambda *a: made.append(minhash.common.written(real(*a))) or made[-1])
    kept = {r.doc_id for r in minhash.kept_ids(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    assert kept == want and len(want) > 300
    assert made[0].count() <= len(docs) * minhash.BANDS / 4


def test_near_duplicate_stage_finds_by_fingerprints_too():
    """Without its bands a pair whose fingerprints differ in two bits or fewer still shares a bucket, and only such masks agree."""
    rnd = random.Random(8)
    shared = 0
    for _ in range(40):
        words = [f"w{rnd.randrange(5000)}" for _ in range(1500)]
        other = [*words[:-1], "changed"]
        sets = [minhash.shingles(" ".join(x), 5) for x in (words, other)]
        fps = [simhash.majority(simhash.bit_counts(g), len(g)) for g in sets]
        keys = [minhash.sketch(g)[0][minhash.BANDS :] for g in sets]
        agree = [(fps[0] ^ fps[1]) & m == 0 for m in simhash.covering_masks(2)]
        assert [x == y for x, y in zip(*keys)] == agree and len(agree) == 7
        if (fps[0] ^ fps[1]).bit_count() <= 2:
            assert any(agree)
            shared += 1
    assert shared > 20


def test_encoders_are_given_back_by_stages_that_do_not_encode():
    kept = tokens.encoder(tokens.public_path())
    assert tokens.encoder(tokens.public_path()) is kept
    tokens.forget()
    assert tokens.encoder(tokens.public_path()) is not kept


def test_ranges_of_the_curve_hold_like_token_totals(spark):
    rnd = random.Random(2)
    rows = [(rnd.randrange(1 << 60), 20_000 if i % 97 == 0 else rnd.randrange(1, 400)) for i in range(4000)]
    cuts, totals = curvepack.token_ranges(spark.createDataFrame(rows, "place long, n_tokens long"), 8)
    want = [0] * (len(cuts) + 1)
    for place, n in rows:
        want[int(np.searchsorted(cuts, place, side="right"))] += n
    assert [totals[p] for p in range(len(want))] == want and max(want) < 1.35 * sum(want) / 8
    assert curvepack.token_ranges(spark.createDataFrame([], "place long, n_tokens long"), 8)[1] == {0: 0}
