"""Published figures as golden values, and invariants."""

import random

import pytest
from pyspark.sql import functions as F

from answerloom.operators import labels, reader_metrics, retriever_metrics, scopes

HITS = {**{q: 1 for q in range(17)}, **{q: 2 for q in range(17, 25)}, 25: 3, 26: 3, 27: 5}


def golden(spark, extra):
    rows = [(q, r, int(HITS.get(q) == r or (q, r) in extra)) for q in range(35) for r in range(1, 6)]
    scores = retriever_metrics.query_scores(spark.createDataFrame(rows, "q int, rank int, rel int"))
    names = ["recall_single_hit", "mrr", "precision", "map"]
    return scores.agg(*[F.avg(n).alias(n) for n in names]).first().asDict()


def test_context_scope_figures(spark):
    got = golden(spark, set())
    assert got == pytest.approx(
        {"recall_single_hit": 0.8, "mrr": 0.6247619047619047, "precision": 0.16, "map": 0.6247619047619047}
    )


def test_default_scope_figures(spark):
    got = golden(spark, {(25, 5)})
    assert got == pytest.approx(
        {"recall_single_hit": 0.8, "mrr": 0.6247619047619047, "precision": 29 / 175, "map": 0.6257142857142857}
    )


def test_metrics_against_plain_python(spark):
    rng = random.Random(3)
    rel = {q: [rng.randint(0, 1) for _ in range(5)] for q in range(40)}
    rows = [(q, i + 1, r) for q, rs in rel.items() for i, r in enumerate(rs)]
    got = {
        r["q"]: r
        for r in retriever_metrics.query_scores(spark.createDataFrame(rows, "q int, rank int, rel int")).collect()
    }
    for q, rs in rel.items():
        ranks = [i + 1 for i, r in enumerate(rs) if r]
        assert got[q]["mrr"] == pytest.approx(1 / ranks[0] if ranks else 0)
        assert got[q]["map"] == pytest.approx(sum((i + 1) / r for i, r in enumerate(ranks)) / len(ranks) if ranks else 0)
        assert got[q]["precision"] == pytest.approx(len(ranks) / 5)
        assert 0 <= got[q]["map"] <= got[q]["recall_single_hit"] <= 1


def test_answer_overlap(spark):
    read = spark.createDataFrame(
        [(1, 1, "The blue, blue house"), (1, 2, "a house"), (2, 1, None), (3, 1, "word")], "q int, rank int, answer string"
    )
    gold = spark.createDataFrame([(1, "blue house"), (2, ""), (3, "")], "q int, answer string")
    scored = reader_metrics.prediction_scores(reader_metrics.overlap_f1(reader_metrics.answer_pairs(read, gold)))
    got = {(r["q"], r["rank"]): (r["em"], round(r["f1"], 6)) for r in scored.collect()}
    assert got == {(1, 1): (0.0, 0.8), (1, 2): (0.0, 0.666667), (2, 1): (1.0, 1.0), (3, 1): (0.0, 0.0)}


def test_f1_is_at_least_em_and_top_n_at_least_top_1(spark):
    rng = random.Random(5)
    text = lambda: " ".join(rng.choice("ab cd ef gh".split()) for _ in range(rng.randint(1, 3)))
    read = spark.createDataFrame([(q, r, text()) for q in range(20) for r in range(1, 5)], "q int, rank int, answer string")
    gold = spark.createDataFrame([(q, text() if q % 5 else "") for q in range(20)], "q int, answer string")
    scored = reader_metrics.prediction_scores(reader_metrics.overlap_f1(reader_metrics.answer_pairs(read, gold)))
    assert scored.where(F.col("f1") < F.col("em")).count() == 0
    values = {r["metric"]: r["value"] for r in reader_metrics.reader_eval(scored, gold).collect()}
    assert values["top_n_accuracy"] >= values["f1"] >= values["EM"]
    assert values["top_n_f1_text_answer"] >= values["top_n_EM_text_answer"]


def test_document_scopes_nest(spark):
    rows = [(1, 1, g, i, c, h) for g, (i, c, h) in enumerate((i, c, h) for i in (True, False) for c in (True, False) for h in (True, False))]
    pairs = spark.createDataFrame(rows, "q int, rank int, gold_key int, same_id boolean, same_context boolean, contains boolean")
    rel = {(r[0], r[1], r[4]): r[5] for r in scopes.scoped_relevance(pairs).collect()}
    assert len(rel) == 24 * 8
    for a in scopes.ANSWER_SCOPES:
        for g in range(8):
            both, either = rel[a, "document_id_and_context", g], rel[a, "document_id_or_context", g]
            assert both <= rel[a, "document_id", g] <= either and both <= rel[a, "context", g] <= either
            assert rel[a, "answer", g] <= rel["any", "answer", g]


def test_missing_keys_never_match(spark):
    row = spark.range(1).select(
        scopes.id_match(F.lit(None).cast("string"), F.lit(None).cast("string")).alias("i"),
        scopes.context_match(F.lit("a b c"), F.lit(None).cast("string")).alias("c"),
    ).first()
    assert not row["i"] and not row["c"]


def test_labels_are_merged_per_query_and_document(spark):
    rows = [(1, "x", "b", "u", True), (1, "x", "a", "u", True), (1, "x", "a", "u", True), (1, "x", "a", "v", True),
            (1, "x", "z", "u", False), (2, "y", "", None, True)]
    df = spark.createDataFrame(rows, "q int, query string, answer string, uid string, is_correct_answer boolean")
    got = sorted((r["q"], r["uid"], r["answers"], r["n_labels"]) for r in labels.labels_aggregated(df).collect())
    assert got == [(1, "u", ["a", "b"], 3), (1, "v", ["a"], 1)]
    assert labels.labels_aggregated(df, drop_no_answers=False).count() == 3


def test_verbatim_search_finds_short_and_long_items(spark):
    units = {"u1": "One two  three four five", "u2": "prefixed xtwo threey", "u3": "two three and more", "u4": "nothing"}
    items = {1: "two", 2: "two three", 3: "o three", 4: "two three and", 5: "e", 6: "absent here now"}
    got = labels.find_verbatim(
        spark.createDataFrame(list(items.items()), "q int, answer string"),
        spark.createDataFrame(list(units.items()), "uid string, content string"),
    )
    want = sorted((q, u) for q, a in items.items() for u, t in units.items() if a in t)
    assert sorted(map(tuple, got.collect())) == want
