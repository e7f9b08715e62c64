"""Operators of answerloom.llm against brute force, round trips and their defined corner cases."""

import collections
import hashlib
import os
import random
import re
import zlib
from array import array

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from answerloom.llm import (
    fingerprints,
    html_text,
    language,
    line_dedup,
    linking,
    lm_score,
    ngram_join,
    packing,
    pieces,
    quality,
    toxicity,
)
from answerloom.session import stage

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, id string, bucket string, row string, key string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lines_text(seed, n, words=12):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    return "\n".join(" ".join(rng.choice(vocabulary) for _ in range(words)) for _ in range(n))


def odd_texts():
    base = lines_text(1, 8)
    near = base.replace(base.split()[5], "zzzzzzz", 1)
    return [
        None,
        "",
        "   \n\t ",
        "one",
        "two words",
        "123 456 !!!",
        base,
        base,
        near,
        base + "\nx",
        "Häuser ΑΣ. naïve  日本語 🎉 <|endoftext|>",
        "a" * 5000,
        lines_text(2, 400, 30),
        "spam and eggs " * 60,
    ]


def frame(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en" if k % 3 else None, None if k % 5 == 0 else f"h{k % 2}", None, "s", "i", "b", "r", "k") for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Corner cases, with a null id, a repeated id and a repeated row."""
    texts = odd_texts()
    ids = [*range(len(texts)), None, 3, 6]
    return frame(spark, [*texts, "null id text of some words", "another text under id three", texts[6]], ids)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, []).limit(0)


def shingles(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[k : k + n]) for k in range(len(w) - n + 1)])


# 1 packing


def check_packed(df, texts, capacity):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.public_tokenizer())
    got = df.toPandas().sort_values(["sequence_id", "offset"])
    for _, rows in got.groupby("sequence_id"):
        at = 0
        for r in rows.itertuples():
            assert r.offset == at
            at += r.length
        assert at <= capacity
    want = collections.Counter()
    for doc_id, text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for n, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            want[doc_id, n, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    have = collections.Counter(
        (None if r.doc_id != r.doc_id else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()
    )
    assert have == want
    return got.sequence_id.nunique(), got.length.sum()


def test_packing_places_every_piece_once(spark, odd):
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    for capacity in (64, 2048):
        packed = packing.pack(stage(packing.pieces(odd, capacity), "pieces"), capacity)
        check_packed(packed, texts, capacity)


def test_packing_is_tight(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    packed = packing.pack(stage(packing.pieces(docs), "pieces"))
    used, tokens = check_packed(packed, [(r.doc_id, r.text) for r in docs.collect()], 2048)
    assert used <= -(-tokens // 2048) * 1.02 + 1


def test_packing_of_nothing(empty):
    assert packing.pack(stage(packing.pieces(empty), "pieces")).count() == 0


def test_configurations_hold_each_piece_once():
    rng = random.Random(5)
    for _ in range(5):
        histogram = {rng.randint(1, 100): rng.randint(1, 60) for _ in range(40)}
        use = packing.configurations(histogram, 100)
        held = collections.Counter()
        for key, n in use.items():
            assert sum(x * a for x, a in key) <= 100
            for x, a in key:
                held[x] += a * n
        assert held == histogram
        bins = []
        for x in sorted((x for x, n in histogram.items() for _ in range(n)), reverse=True):
            k = min((k for k, r in enumerate(bins) if r >= x), key=lambda k: bins[k], default=None)
            if k is None:
                bins.append(100 - x)
            else:
                bins[k] -= x
        assert sum(packing.best_fit(histogram, 100).values()) == len(bins)
        assert sum(use.values()) <= len(bins) * 1.03 + 1


def test_configurations_never_above_best_fit():
    rng = random.Random(6)
    spread = [(300, 1400, 300), (600, 1500, 150), (10, 2048, 400), (400, 900, 600), (1, 2048, 50), (1025, 2048, 60)]
    for low, high, n in spread:
        histogram = dict(collections.Counter(rng.randint(low, high) for _ in range(n)))
        plain = packing.best_fit(histogram, 2048)
        use = packing.configurations(histogram)
        _, bound = packing.solve(histogram, first=plain)
        assert packing.threshold_bound(histogram, 2048) <= bound + 1e-9
        assert bound - 1e-6 <= sum(use.values()) <= sum(plain.values())
        held = collections.Counter()
        for key, k in use.items():
            assert sum(x * a for x, a in key) <= 2048
            for x, a in key:
                held[x] += a * k
        assert held == histogram
    assert packing.configurations({}) == {}


def fewest_sequences(sizes, capacity):
    """Fewest sequences by trying every place for every piece."""
    best = len(sizes)

    def put(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for r in {r for r in rooms if r >= sizes[k]}:
            at = rooms.index(r)
            put(k + 1, [*rooms[:at], r - sizes[k], *rooms[at + 1 :]])
        put(k + 1, [*rooms, capacity - sizes[k]])

    put(0, [])
    return best


def test_bound_is_below_the_optimum():
    rng = random.Random(7)
    for _ in range(60):
        sizes = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 9))), reverse=True)
        histogram = dict(collections.Counter(sizes))
        fewest = fewest_sequences(sizes, 20)
        _, bound = packing.solve(histogram, 20)
        assert bound <= fewest + 1e-6
        assert fewest <= sum(packing.configurations(histogram, 20).values())


# 2 language ID


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd_id = F.col("doc_id") % 4 == 2
    model = language.fit(docs.where(~odd_id))
    got = language.predict(docs.where(odd_id), model).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_matches_dense_product(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs)
    texts = [r.text for r in docs.limit(20).collect()]
    got = language.log_likelihoods(texts, model)
    for text, row in zip(texts, got):
        counts = np.zeros(language.BUCKETS)
        for order in language.ORDERS:
            np.add.at(counts, language.ngram_buckets(language.code_points(text), order), 1)
        assert np.allclose(counts @ model.log_prob.astype(float), row, rtol=1e-6, atol=1e-3)


def test_language_corner_cases(odd, empty):
    model = language.fit(odd)
    got = {(r.doc_id, r.text): r for r in language.predict(odd, model).collect()}
    for text in (None, "", "   \n\t ", "123 456 !!!"):
        r = next(v for (_, t), v in got.items() if t == text)
        assert (r.lang_pred, r.score) == ("und", 0.0)
    assert got[3, "one"].lang_pred == "en"
    kept = language.confident(odd, model)
    assert kept.columns == odd.columns and {r.score for r in kept.collect()} == {"s"}
    assert language.predict(empty, language.fit(empty)).count() == 0
    assert {r.lang_pred for r in language.predict(odd, language.fit(empty)).collect()} == {"und"}


# 3 toxicity


def test_toxicity_held_out(spark):
    bad = ["vileword", "nastyhead", "grotbag"]
    rng = random.Random(3)
    rows, labels = [], []
    for k in range(600):
        w = lines_text(k % 50 + 10, 3).split()
        toxic = k % 4 == 0
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(bad) + rng.choice(["", "s", ","])
        rows.append((k, " ".join(w)))
        labels.append((k, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    held = F.col("doc_id") % 3 == 1
    model = toxicity.fit(docs, labels.where(~held))
    got = toxicity.score(docs.withColumn("held_out", held), model).where("held_out").collect()
    assert all(r.predicted == (r.doc_id % 4 == 0) for r in got)


def test_toxicity_corner_cases(spark, odd, empty):
    labels = spark.createDataFrame([(6, 1), (8, 0), (None, 1), (12, None), (6, 0), (99, 1)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    got = toxicity.score(odd.withColumn("held_out", F.lit(True)), model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(empty.withColumn("held_out", F.lit(True)), toxicity.fit(empty, labels)).count() == 0
    assert toxicity.score(odd.withColumn("held_out", F.lit(True)), toxicity.fit(odd, labels.limit(0))).where("score > 0.01").count() == 0


# 4 HTML extraction


def test_html_labelled_articles(spark):
    import html

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in html_text.main_text(pages, html_text.fit(pages)).collect()}
    for r in pages.collect():
        inner = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        inner = re.sub("</?b>", "", re.sub("<br>", " ", re.sub("</?(p|h1)>", "\n", inner)))
        blocks = (" ".join(html.unescape(x).split()) for x in inner.split("\n"))
        assert got[r.page_id].text == "\n".join(x for x in blocks if x)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


PAGE = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><header><h1>Site name</h1></header>
<nav><ul><li>Home<li>News</ul></nav><div class="cookie-notice">We set cookies on this page</div>
<div id=content><h2>Head &amp; line</h2><p>First   one<br>more <i>in</i>side a&lt;b.<div class='ad'>Buy this now</div><p>Short.
<form><label>Mail me</label><input name=x></form><ul><li>one<li>two</ul></div>
<aside>At the side</aside><section class="comments"><p>A reader says this is nice</section><footer>End</footer>"""


def test_html_corner_cases(spark):
    weights = html_text.fit(spark.read.parquet(f"{SF}/pages.parquet"))
    for w in (weights, html_text.Weights({})):
        assert html_text.extract(PAGE, w) == "Head & line\nFirst one more inside a<b.\nShort.\none\ntwo"
        assert html_text.extract("", w) == ""
        assert html_text.extract("<nav>only menu</nav><!-- open", w) == ""
        assert html_text.extract("a < b <p>c", w) == "a < b\nc"
        assert html_text.extract("<p>x" + " y" * 50000, w) == "x" + " y" * 50000
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>text</p>"), (None, "u", "<p>text</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = sorted((r.text, r.n_chars) for r in html_text.main_text(pages, weights).collect())
    assert got == [("", 0), ("", 0), ("text", 4), ("text", 4)]
    assert html_text.main_text(pages.limit(0), html_text.fit(pages.limit(0))).count() == 0


def test_html_names_of_wrappers_drop_nothing(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    weights = html_text.fit(pages)
    for r in pages.collect():
        plain = html_text.extract(r.html, weights)
        assert plain
        for old, new in (
            ("<body", '<body class="has-sidebar"'),
            ("<article", '<article class="post no-comments"'),
            ("<article", '<article data-id="ad-1"'),
            ("<article", '<article class="sidebar"'),
            ("<article>", '<div class="hidden"><article>'),
            ("<article>", "<form><article>"),
            ("<article>", '<article><svg width="1" /><iframe src="x"/>'),
        ):
            assert old in r.html
            assert html_text.extract(r.html.replace(old, new, 1), weights) == plain
        left, inner = r.html.split("<article>", 1)
        inner, right = inner.split("</article>", 1)
        legal = inner.replace("<p>", '<p class="legal-text">')
        assert html_text.extract(f"{left}<article>{legal}</article>{right}", weights) == plain


def test_html_words_of_classes():
    w = html_text.Weights({})
    text = "one two three four five six seven eight nine ten"
    side = '<div class="sidebar">links to other pages</div>'
    assert html_text.extract(f"{side}<div><p>{text}</p></div>{side}", w) == text
    assert html_text.extract(f'<div class="sidebar"><p>{text}</p></div>', w) == text
    assert html_text.extract(f'<form><p>{text}</p></form><aside>{text} {text} {text}</aside>', w) == text
    legal = f'<p class="legal">{text}</p>'
    assert html_text.extract(legal * 3, w) == "\n".join([text] * 3)
    assert html_text.extract(legal + f"<p>{text}</p>" * 3, w) == "\n".join([text] * 3)
    seen = html_text.Weights({".legal": (20, 0), ".extra": (0, 200)})
    assert html_text.extract(legal + f"<p>{text}</p>" * 3, seen) == "\n".join([text] * 4)
    assert html_text.extract(f'<p>{text}</p><div class="extra"><p>{text} {text}</p></div>', seen) == text
    assert html_text.extract(f'<div class="extra"><p>{text}</p></div>', seen) == text


def test_html_weights_count_places():
    import collections

    totals = {"in": collections.Counter(), "out": collections.Counter()}
    page = '<body class=b><nav><i class=x>m</i></nav><div id=w><article class=a><p class=t>k</p></article></div><p class=t>z</p>'
    html_text.count_features(page, totals)
    assert totals["in"] == {".b": 1, ".w": 1, ".a": 1, ".t": 1, "<p": 1}
    assert totals["out"] == {"<body": 1, "<nav": 1, "nav": 1, "<div": 1, "<article": 1, "<p": 1, ".t": 1}
    html_text.count_features(page + "<main>", totals)
    assert totals["in"][".a"] == 1


def test_best_region_is_the_best():
    rng = random.Random(4)
    for _ in range(300):
        x = [rng.randint(-4, 4) for _ in range(rng.randint(0, 12))]
        a, b = html_text.best_region(x)
        best = max([0] + [sum(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1)])
        assert sum(x[a:b]) == best


# 5 line dedup


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        k = rng.randint(0, len(out))
        kind = rng.random()
        if kind < 0.3 and k < len(out):
            out[k] = rng.choice("abc")
        elif kind < 0.6:
            out.insert(k, rng.choice("abc"))
        elif k < len(out):
            del out[k]
    return "".join(out)


def test_banded_distance_and_segments():
    rng = random.Random(6)
    for _ in range(3000):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 14)))
        b = edited(rng, a, rng.randint(0, 4))
        d = edit_distance(a, b)
        for limit in (1, 2, 3):
            assert line_dedup.edit_distance_within(a, b, limit) == (d if d <= limit else None)
            if d <= limit and min(len(a), len(b)) > limit:
                found = [{(n, k, x[s : s + z]) for n, k, s, z in line_dedup.probes(len(x), limit)[0]} for x in (a, b)]
                own = [{(n, k, x[s : s + z]) for n, k, s, z in line_dedup.probes(len(x), limit)[0][: limit + 1]} for x in (a, b)]
                assert found[0] & own[1] or found[1] & own[0]


def deduped(rows, distance=2, min_chars=10):
    """Brute force over (doc_id, text) in order of doc_id."""
    spaces = " \t\n\x0b\x0c\r"
    lines = sorted({s for _, t in rows for x in (t or "").split("\n") if (s := x.strip(spaces))})
    root = {x: x for x in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(lines):
        for b in lines[i + 1 :]:
            if min(len(a), len(b)) >= min_chars and abs(len(a) - len(b)) <= distance and edit_distance(a, b) <= distance:
                root[find(b)] = find(a)
    seen, out = set(), []
    for doc_id, text in rows:
        kept = []
        for x in (text or "").split("\n"):
            s = x.strip(spaces)
            if s and find(s) in seen:
                continue
            if s:
                seen.add(find(s))
            kept.append(x)
        out.append((doc_id, None if text is None else "\n".join(kept)))
    return out


def test_line_dedup_brute_force(spark):
    rng = random.Random(8)
    bases = ["".join(rng.choice("abcd ") for _ in range(rng.randint(3, 40))) for _ in range(12)]
    rows = []
    for k in range(40):
        rows.append((k, "\n".join(edited(rng, rng.choice(bases), rng.randint(0, 3)) for _ in range(rng.randint(0, 6)))))
    rows.append((40, None))
    rows.append((41, "\n\n  \n" + bases[0] + "\n" + bases[0]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((r.doc_id, r.text) for r in line_dedup.dedup_lines(docs).collect())
    assert got == deduped(rows)


def test_line_dedup_hot_line(spark):
    """One line in every document and a thousand variants of another: no all pairs, whole results."""
    rows = [(k, f"the line that all documents of this host hold\nvariant number {k:06d} of a long and common text") for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert got == dict(deduped_chain(rows))


def deduped_chain(rows):
    """Variants whose numbers differ in two digits at most are near, so all of them are one class."""
    return [(k, t if k == 0 else "") for k, t in rows]


def test_line_dedup_corner_cases(odd, empty):
    got = line_dedup.dedup_lines(odd)
    assert got.columns == odd.columns and got.count() == odd.count()
    texts = [r.text for r in got.where("doc_id = 6").collect()]
    assert texts == [odd_texts()[6]] * 2  # equal rows are one document
    assert got.where("doc_id = 7").first().text == "" and got.where("doc_id = 0").first().text is None
    assert line_dedup.dedup_lines(empty).count() == 0


# 6 quality rules


def test_quality_corner_cases(odd, empty):
    got = quality.verdicts(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got if r.doc_id in (0, 1, 2, 4, 13)}
    assert all(by[k].n_words == 0 and by[k].base_failed and not by[k].kept for k in (0, 1, 2))
    assert by[4].n_words == 2 and by[4].word_chars == 8
    assert by[13].n_repeat_words == by[13].n_words == 180 and by[13].base_failed
    kept = quality.filter_quality(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 6").count() == 2
    assert quality.verdicts(empty).count() == 0 and quality.filter_quality(empty).count() == 0


def test_quality_frequent_lines(spark):
    common = "all rights reserved by this host and its many owners forever and ever again"
    rows = [(k, common + ("" if k % 2 else "\n" + lines_text(k, 4)), "host") for k in range(40)]
    rows += [(k, lines_text(k, 3) + "\n" + common, "other") for k in range(40, 49)]
    got = {r.doc_id: r for r in quality.verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[k].removed_words == 14 and got[k].kept == (k % 2 == 0) for k in range(40))
    assert all(got[k].removed_words == 0 and got[k].kept for k in range(40, 49))


def test_quality_limits_either_suffices(spark):
    shared = "read more of this on our other pages today and every day"
    rows = [(k, lines_text(k, 6) + ("\n" + shared + "\n\n" + lines_text(k + 500, 1) if k < 12 else ""), "big") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    lost = lambda **limits: {r.doc_id for r in quality.verdicts(docs, **limits).collect() if r.removed_words}
    assert lost() == set()
    assert lost(max_documents=12) == set(range(12))
    assert lost(max_documents=13) == set()
    assert lost(host_percent=5) == set(range(12))
    assert lost(host_percent=5, min_documents=13) == set()
    left = {r.doc_id: r.text for r in quality.filter_quality(docs, max_documents=12).collect()}
    assert left == {k: t.replace(shared + "\n", "") for k, t, _ in rows}


# 7 LM scoring


def test_lm_scores_match_counts(spark):
    rows = [(0, "a b a b a c", True), (1, "b c d b", False), (2, "", False), (3, None, True), (4, "a b", False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, target boolean").repartition(3)
    got = {r.doc_id: r for r in lm_score.score(docs, lm_score.fit(docs)).collect()}
    losses = {}
    for name, chosen in (("target", [r for r in rows if r[2]]), ("whole", rows)):
        word, context, pair = collections.Counter(), collections.Counter(), collections.Counter()
        for _, text, _ in chosen:
            w = (text or "").split()
            word.update(w)
            context.update(["^", *w[:-1]] if w else [])
            pair.update(zip(["^", *w[:-1]], w))
        total = sum(word.values())
        for doc_id, text, _ in rows:
            w = (text or "").split()
            loss = [
                -np.log((pair[v, x] + 4 * (word[x] + 1) / (total + 4)) / (context[v] + 4))
                for v, x in zip(["^", *w[:-1]], w)
            ]
            losses[name, doc_id] = np.mean(loss) if loss else None
    for doc_id, r in got.items():
        if losses["whole", doc_id] is None:
            assert r.score is None and r.n_tokens == 0
        else:
            assert r.target_loss == pytest.approx(losses["target", doc_id], rel=1e-5)
            assert r.background_loss == pytest.approx(losses["whole", doc_id], rel=1e-5)


def test_lm_corner_cases(spark, odd, empty):
    labels = spark.createDataFrame([(6, 1, 0), (None, 1, 1), (6, 1, 1), (7, None, 0)], "doc_id long, quality int, toxic int")
    rows = lm_score.with_target(odd, labels)
    assert rows.count() == odd.count()
    assert lm_score.score(odd, lm_score.fit(rows)).count() == odd.count()
    nothing = lm_score.with_target(empty, labels.limit(0))
    assert lm_score.score(odd, lm_score.fit(nothing)).where("score is null").count() == 3


# 8 fingerprints


def test_fingerprints_brute_force(odd):
    rows = [(r.doc_id, r.text or "") for r in odd.where("doc_id is not null").dropDuplicates(["doc_id"]).collect()]
    spark = odd.sparkSession
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in fingerprints.with_next(docs).collect()}
    assert len(got) == len(rows)
    rows.sort(reverse=True)
    for k, (doc_id, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)]
        third = len(text) // 3
        new = text[: len(text) - third] + following[1][:third]
        r = got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        sig, other, after = (
            fingerprints.signature(fingerprints.least(fingerprints.shingles_of(x.encode()))) for x in (text, new, following[1])
        )
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprints.text_hex(sig), fingerprints.text_hex(other))
        assert (r.near_edited, r.near_next) == (fingerprints.likeness(sig, other), fingerprints.likeness(sig, after))


def test_fingerprints_corner_cases(spark, odd, empty):
    assert fingerprints.with_next(odd).count() == odd.count()
    assert fingerprints.with_next(empty).count() == 0
    one = fingerprints.with_next(spark.createDataFrame([(5, "just one text here and no other")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    same = spark.createDataFrame([(1, "x y z")] * 5, "doc_id long, text string")
    assert [r.near_next for r in fingerprints.with_next(same).collect()] == [1.0] * 5


def test_near_duplicates(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r.component_id for r in fingerprints.near_duplicates(docs).collect()}
    assert got == brute_components([(r.doc_id, r.text) for r in docs.collect()], 5, 80)


# 9 n-gram Jaccard join


def brute_components(rows, n, percent):
    sets = {i: shingles(t, n) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                continue
            if 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in sets}


def test_ngram_join_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for base in range(12):
        text = lines_text(base + 100, 6).split()
        for _ in range(12):
            w = list(text)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                w[rng.randrange(len(w))] = rng.choice(["alpha", "beta", "gamma"])
            rows.append(" ".join(w))
    rows += ["", None, "a b", "A B", "a", "x y z", "x y z x y z"]
    rows = [(k, t) for k, t in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: r for r in ngram_join.components_of(docs).collect()}
    assert {k: r.component_id for k, r in got.items()} == brute_components(rows, 3, 90)
    assert all(got[k].n_shingles == len(shingles(t, 3)) for k, t in rows)


def test_ngram_join_corner_cases(odd, empty):
    got = ngram_join.components_of(odd)
    assert got.count() == odd.count()
    assert {r.component_id for r in got.where("doc_id in (6, 7)").collect()} == {6}
    assert got.where("doc_id is null").first().component_id is None
    kept = ngram_join.one_of_each(odd)
    assert kept.columns == odd.columns
    assert kept.where("doc_id in (6, 7)").count() == 1
    assert kept.where("doc_id in (0, 1, 2)").count() == 3
    assert ngram_join.components_of(empty).count() == 0 and ngram_join.one_of_each(empty).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    chain = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 160)] + [(159, 60)]
    edges = spark.createDataFrame([(b, a) if a % 2 else (a, b) for a, b in chain] + [(500, 500)], "a long, b long")
    got = {r.id: r.component for r in linking.components(edges).collect()}
    assert got == {k: 0 for k in [*range(61), *range(100, 160)]}


# 10 SentencePiece


def test_pieces_match_the_library(spark, odd):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.public_model())
    rng = random.Random(10)
    texts = [r.text or "" for r in odd.collect()] + ["", " ", " a  b\n\tc ", "a▁b", " " * 100, "x" * 3000, "a\0b", "ﬁ①é"]
    texts += ["".join(rng.choice("ab the\n▁ é") for _ in range(rng.randint(0, 40))) for _ in range(500)]
    docs = frame(spark, texts).withColumn("ids", F.lit("clash"))
    got = {r.doc_id: r for r in pieces.decode(pieces.encode(docs)).collect()}
    for k, text in enumerate(texts):
        ids = library.encode(text)
        assert (got[k].ids, got[k].decoded) == (ids, library.decode(ids))
    plain = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    model = pieces.piece_model(pieces.public_model())
    assert [list(array("i", x)) for x in model.encode(plain)] == library.encode(plain)
    ids = library.encode(plain)
    assert model.decode(np.array(sum(ids, [])), np.cumsum([0, *map(len, ids)])) == plain


def test_pieces_corner_cases(spark, empty):
    rows = spark.createDataFrame([([None, 5, 99999999, -1],), (None,)], "ids array<int>")
    assert [r.decoded is not None for r in pieces.decode(rows).collect()] == [True, True]
    assert pieces.decode(pieces.encode(empty)).count() == 0


# Pipeline


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    kept = docs
    seen = {}
    for name, apply in corpus_pipeline.STAGES:
        kept = stage(apply(spark, kept, SF), name)
        if name != "best_fit_packing":
            assert kept.columns == docs.columns
        seen[name] = kept
    after = {n: {r.doc_id: r.text for r in df.collect()} for n, df in seen.items() if n != "best_fit_packing"}
    hits = {}
    for r in quality.frequent_hits(seen["language_id"]).join(
        seen["language_id"].select("doc_id", quality.row_hash().alias("row")), "row"
    ).collect():
        hits.setdefault(r.doc_id, set()).add(r.pos)
    for k, t in after["quality_rules"].items():
        assert t == "\n".join(x for i, x in enumerate(rows[k].split("\n")) if i not in hits.get(k, ()))
    first = [(k, after["quality_rules"][k]) for k in sorted(after["quality_rules"])]
    lines = {k: t for k, t in deduped_fast(first) if WORD.search(t)}
    assert after["line_dedup"] == lines
    named = brute_components(sorted(lines.items()), corpus_pipeline.NEAR_WORDS, corpus_pipeline.NEAR_PERCENT)
    assert after["ngram_jaccard_join"] == {k: t for k, t in lines.items() if named[k] == k}
    check_packed(seen["best_fit_packing"], sorted(after["ngram_jaccard_join"].items()), 2048)


def deduped_fast(rows):
    """As ``deduped``, with the distance taken by the banded form tested above."""
    global edit_distance
    plain = edit_distance
    try:
        edit_distance = lambda a, b: 99 if line_dedup.edit_distance_within(a, b, 2) is None else 0
        return deduped(rows)
    finally:
        edit_distance = plain


def test_pipeline_on_corner_cases(spark, odd, empty, tmp_path):
    for name, docs in (("odd", odd), ("none", empty)):
        folder = os.path.join(tmp_path, name)
        docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
        out = corpus_pipeline.run(spark, folder)
        assert (out.count() > 0) == (name == "odd")
