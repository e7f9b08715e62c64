"""What the corpus operators once left out."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from answerloom.functions import skew
from answerloom.llm import lm_score, ngram_join, quality


def vocabulary_text(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(n)]


def windows(words, n):
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}


def jaccard(a, b, n):
    x, y = windows(a, n), windows(b, n)
    return len(x & y) / len(x | y)


def test_near_copies_between_the_limits_go(spark):
    rng = random.Random(1)
    base = vocabulary_text(rng, 200)
    close, far = list(base), list(base)
    for k in (20, 60, 90, 160):
        close[k] = f"close{k}"
    for k in range(10, 200, 20):
        far[k] = f"far{k}"
    assert jaccard(base, close, 5) >= 0.8 and jaccard(base, close, 3) < 0.9 and jaccard(base, far, 5) < 0.8
    texts = [base, close, far, vocabulary_text(rng, 200)]
    docs = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(texts)], "doc_id long, text string")
    kept = corpus_pipeline.keep_one_of_each(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3]


def test_lm_counts_are_exact_however_many_pairs(spark):
    rng = random.Random(2)
    texts = [" ".join(["the", "of"] * 20 + [f"w{rng.randrange(400_000)}" for _ in range(4000)]) for _ in range(100)]
    texts += [texts[0], "the of the of"]
    rows = [(k, x, k % 3 == 0) for k, x in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, target boolean").repartition(5)
    models = lm_score.fit(docs)
    assert len(models.counts.words) and len(models.counts.pairs)
    words, context, pairs = [[collections.Counter(), collections.Counter()] for _ in range(3)]
    for _, x, target in rows:
        w = x.split()
        for k in (0, 1) if target else (1,):
            words[k].update(w)
            context[k].update(["^", *w[:-1]])
            pairs[k].update(zip(["^", *w[:-1]], w))
    assert len(pairs[1]) > 1 << 18
    different = len(words[1])
    assert models.counts.vocabulary == pytest.approx(different, rel=0.06)
    plain = {r.doc_id: r for r in lm_score.score(docs, models).collect()}
    apart = {r.doc_id: r for r in lm_score.score(docs.select("doc_id", "text"), models).collect()}
    assert len(plain) == len(apart) == len(rows)
    for doc_id, x, _ in rows:
        w = x.split()
        want = []
        for k in (0, 1):
            total = sum(words[k].values()) + models.counts.vocabulary
            p = [pairs[k][v, y] + 4 * (words[k][y] + 1) / total for v, y in zip(["^", *w[:-1]], w)]
            want.append(np.mean([-np.log(a / (context[k][v] + 4)) for a, v in zip(p, ["^", *w[:-1]])]))
        for r in (plain[doc_id], apart[doc_id]):
            assert r.n_tokens == len(w)
            assert [r.target_loss, r.background_loss] == pytest.approx(want, rel=1e-6)


def test_quality_takes_frequent_lines_out(spark):
    rng = random.Random(3)
    own = ["\n".join(" ".join(vocabulary_text(rng, 12)) for _ in range(3)) for _ in range(20)]
    rows = [(k, x.replace("\n", "\n All  Rights reserved\n", 1), "en", "host", 0) for k, x in enumerate(own)]
    rows += [(20, own[0] + "\nall rights reserved", "en", "other", 7), (21, "all rights reserved", "en", "host", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.apply_quality_rules(spark, docs, "").collect()}
    want = {k: (x, len(x)) for k, x in enumerate(own)} | {20: (rows[20][1], 7)}
    assert got == want
    kept = quality.filter_quality(docs)
    assert kept.columns == docs.columns and {r.doc_id: r.text for r in kept.collect()} == {k: v[0] for k, v in want.items()}


def test_stages_keep_columns_named_like_their_own(spark):
    rng = random.Random(5)
    texts = [" ".join(vocabulary_text(rng, 60)) for _ in range(12)]
    rows = [(k, x + "\nsame line in all of them", "en", "host", len(x), f"g{k}", f"b{k}", f"l{k}", f"i{k}", f"h{k}") for k, x in enumerate(texts)]
    names = "doc_id long, text string, lang string, source string, n_chars long, _gone string, _before string, _lid_lang string, _id string, _hash string"
    docs = spark.createDataFrame(rows, names)
    for stage in (corpus_pipeline.identify_language, corpus_pipeline.apply_quality_rules, corpus_pipeline.keep_one_of_each):
        got = stage(spark, docs, "")
        assert got.columns == docs.columns
        assert sorted(tuple(r)[5:] for r in got.collect()) == sorted(r[5:] for r in rows)


def test_one_of_each_drops_copies_and_repeated_rows_only(spark):
    rng = random.Random(6)
    a, b = (" ".join(vocabulary_text(rng, 50)) for _ in range(2))
    rows = [(3, a), (1, a), (1, a), (None, a), (2, b), (2, b), (None, b), (None, None), (4, None), (4, ""), (4, ""), (5, b + " x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = ngram_join.one_of_each(docs, 5, 80).collect()
    want = [(1, a), (2, b), (None, None), (4, None), (4, ""), (4, "")]
    assert collections.Counter(map(tuple, kept)) == collections.Counter(want)


def test_places_of_tokens_take_two_bytes_in_bounded_batches():
    """op7: four bytes a token were shuffled for a number below a thousand."""
    import numpy as np

    from answerloom.llm import lm_score

    for texts, width in ((500, 2), (40_000, 4)):
        word = np.arange(texts, dtype=np.uint64)
        part = word, word + np.uint64(7), np.arange(texts), np.arange(texts) % 2 == 0
        made = lm_score._packed(0, np.arange(texts), np.zeros(texts, bool), part, None)
        assert len(made[5]) == width * texts
        row = dict(zip(("bucket", "texts", "target", "word", "before", "place", "sums"), made), counted=True, scored=True)
        none = lm_score.Counts(*[np.zeros(0, np.uint64)] * 2, word=np.zeros((0, 2)), total=np.ones(2), vocabulary=1.0)
        assert list(lm_score._bucket_sums([row], none)[0]) == list(range(texts))


def test_lm_sums_go_back_by_blocks_of_texts():
    """op7: each task sent one row per text back, texts times tasks in all, and every token took some 13 bytes."""
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    rng = random.Random(7)
    pool = [x for x in vocabulary_text(rng, 3000)]
    texts = [" ".join(rng.choice(pool) for _ in range(200)) for _ in range(500)]
    counts = lm_score.Counts(
        *[np.zeros(0, np.uint64)] * 2, *[np.zeros((0, 2))] * 3, start=np.ones((1, 2)), total=np.ones(2), vocabulary=1.0
    )
    shared = SimpleNamespace(value=counts)
    ids = pa.array(np.arange(len(texts)))
    columns = {"row": ids, "text_hash": ids, "text": pa.array(texts), "target": pa.array([False] * len(texts))}
    sent = list(lm_score._send([pa.record_batch(columns)], shared, 20, True, True))
    assert sum(x.nbytes for x in sent) < 10.5 * 200 * len(texts)
    rows = [[y for y in pa.Table.from_batches(sent).to_pylist() if y["bucket"] % 5 == task] for task in range(5)]
    back = []
    for part in rows:
        batch = pa.RecordBatch.from_pylist(sorted(part, key=lambda y: y["bucket"]), sent[0].schema)
        made = list(lm_score._add_up([batch], shared))
        assert sum(x.num_rows for x in made) <= 2
        back += made
    whole = pa.Table.from_batches(lm_score._whole(back))
    assert sorted(whole["text_hash"].to_pylist()) == list(range(len(texts)))
    assert set(whole["n"].to_pylist()) == {200.0}


def test_copies_of_a_salted_join_are_not_broadcast(spark):
    """copies of a table for every salt were sized like the table itself, and sent to the driver."""
    big = spark.range(2000).select((F.col("id") % 7).alias("k"), "id")
    small = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left", "left_semi"):
        joined = skew.salted_join(big, small, ["k"], ["id"], 32, how)
        assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == (2000 if how == "left" else sum(k % 7 < 5 for k in range(2000)))


def test_texts_compared_are_not_broadcast(spark, monkeypatch):
    """neither exploded prefixes nor sets of hashes may be taken for small tables."""
    planned = []
    kept = ngram_join.stage

    def stage(df, name):
        planned.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return kept(df, name)

    monkeypatch.setattr(ngram_join, "stage", stage)
    words = vocabulary_text(random.Random(3), 60)
    rows = [(k, " ".join([*words[k:], *words[:k], f"w{k}"] if k % 3 else words)) for k in range(30)] + [(None, "x y"), (40, "x y"), (41, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = ngram_join.components_of(docs)
    assert {r.doc_id: r.component_id for r in got.where("doc_id % 3 = 0").collect()} == {k: 0 for k in range(0, 30, 3)}
    assert all("BroadcastHashJoin [bucket" not in plan for name, plan in planned if name == "shared-tokens")
    assert sorted((r.doc_id is None, r.component_id) for r in got.where("doc_id is null or doc_id = 40").collect()) == [(False, 40), (True, 40)]
