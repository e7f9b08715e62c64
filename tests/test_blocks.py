"""Searches by blocks: the same rows as scoring every pair, without making a row of every pair."""

import random

import pytest
from pyspark.sql import functions as F

from answerloom.functions.ranking import top_k
from answerloom.operators import blocks, sparse, training

RANDOM = random.Random(5)
TERMS = [f"w{i}" for i in range(40)]


def _text(n):
    return " ".join(RANDOM.choices(TERMS, weights=range(40, 0, -1), k=n))


def _tables(spark):
    rows = [(f"u{i}", _text(RANDOM.randint(1, 12))) for i in range(150)] + [("empty", ""), ("null", None), ("odd", "zebra")]
    rows += [("u3", rows[3][1]), ("u4", "w1 w2 w2"), (None, "w0 w5"), (None, "w7 w5 w5"), ("copy", rows[9][1])]
    asked = [(i, _text(6)) for i in range(30)] + [(4, "w3 w30"), (None, "w1 w9"), (99, "unknown"), (98, None)]
    return (
        spark.createDataFrame(asked, "q bigint, query string").repartition(3),
        spark.createDataFrame(rows, "uid string, content string").repartition(5),
    )


def _rows(df):
    return sorted(map(repr, df.select("q", "uid", F.round("score", 5).alias("score"), "rank").collect()))


def _of_all_pairs(queries, units, k):
    return top_k(sparse.bm25_scores(queries, units), ["q"], [F.desc("score"), F.asc("uid")], k)


@pytest.mark.parametrize("dealt", [False, True])
def test_topk_by_blocks_is_that_of_all_pairs(spark, monkeypatch, dealt):
    queries, units = _tables(spark)
    if dealt:
        monkeypatch.setattr(blocks, "QUERIES", 4)
        monkeypatch.setattr(blocks, "HELD", 2)
        monkeypatch.setattr(blocks, "GROUP", 2)
    assert _rows(sparse.bm25_topk(queries, units, 4)) == _rows(_of_all_pairs(queries, units, 4))


def test_stored_topk_by_blocks_is_that_of_all_pairs(spark, tmp_path):
    queries, units = _tables(spark)
    sparse.write_postings(units, str(tmp_path))
    assert _rows(sparse.bm25_topk_stored(queries, str(tmp_path), 4)) == _rows(_of_all_pairs(queries, units, 4))


def test_pairs_of_queries_and_units_are_no_rows(spark, monkeypatch):
    """F1, F8 to F21: a row per query and unit with a common term went through an aggregation."""
    passed = []
    ranked = blocks.top_k
    monkeypatch.setattr(blocks, "top_k", lambda df, *rest: passed.append(df) or ranked(df, *rest))
    queries = spark.createDataFrame([(i, f"w0 w{i % 40}") for i in range(50)], "q bigint, query string")
    units = spark.createDataFrame([(i, f"w0 {_text(5)}") for i in range(400)], "uid bigint, content string").repartition(2)
    found = sparse.bm25_topk(queries, units, 2)
    assert found.count() == 100
    tasks = passed[0].rdd.getNumPartitions()
    assert passed[0].count() <= 2 * 50 * tasks < 50 * 400


def test_pseudo_labels_score_only_the_sources_beside_the_best(spark):
    queries, units = _tables(spark)
    asked = spark.createDataFrame(
        [("a", "u1", "w1 w2"), ("a", "u2", "w1 w2"), ("b", "odd", "zebra"), ("c", "u5", "nowhere")], "q string, uid string, query string"
    )
    scores = sparse.bm25_scores(asked.select("q", "query").distinct(), units)
    want = {(r.q, r.uid): round(r.score, 5) for r in scores.join(asked, ["q", "uid"]).collect()}
    got = training.pseudo_labels(asked, units).collect()
    assert {(r.q, r.pos_uid): round(r.pos_score, 5) for r in got} == want
    assert [r.neg_uid for r in got if r.q == "b"] == [None]


def test_one_retrieval_serves_both_nodes(spark, monkeypatch, tmp_path):
    """what is read was retrieved a second time."""
    from answerloom.plans import queries

    spark.createDataFrame(
        [(i, f"{_text(6)}. {_text(8)}.", "en", "s") for i in range(20)], "doc_id bigint, text string, lang string, source string"
    ).withColumn("n_chars", F.lit(1).cast("bigint")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "w1 w2 w3"), (2, "w4 w5")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    calls, retrieve = [], queries._passage_hits
    monkeypatch.setattr(queries, "_passage_hits", lambda *args: calls.append(1) or retrieve(*args))
    assert queries.join_answers(spark, str(tmp_path)).count() > 0
    assert len(calls) == 1


def test_vectors_take_dimensions_from_frequencies(spark):
    """the dimension was hashed for every row; terms the frequencies do not know are still hashed."""
    from answerloom.operators import embed

    known = embed.with_dimensions(spark.createDataFrame([("a", 1), ("b", 2)], "t string, df bigint"))
    weights = spark.createDataFrame([("x", "a", 0.5), ("x", "b", 2.0), ("x", "new", 1.0), (None, "a", 3.0)], "uid string, t string, w double")
    vectors = lambda rows: {r.uid: list(r.emb) for r in embed.dense_vectors(embed.hashed_components(rows, "uid"), "uid").collect()}
    got = vectors(weights.join(known.drop("df"), "t", "left"))
    assert got == vectors(weights) and set(got) == {"x", None}
    assert all(len(v) == embed.DIMENSIONS for v in got.values()) and sum(map(abs, got["x"])) == 3.5


def test_float_vectors_are_stored_as_floats_and_lists_are_dealt_whole(spark, monkeypatch):
    """vectors of floats travelled as doubles, each query list eight times."""
    from answerloom.operators import dense

    rows = [(i, [RANDOM.uniform(-1, 1) for _ in range(8)]) for i in range(300)]
    units = spark.createDataFrame(rows, "uid bigint, emb array<float>").repartition(6)
    block = dense.packed(units, "uid").first()
    assert len(block.u_vectors) == 4 * 8 * len(block.u_ids)
    asked = units.withColumnRenamed("uid", "q")
    small = sorted(map(tuple, dense.dense_topk_ann(asked, units, 3).collect()))
    monkeypatch.setattr(dense, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(dense, "GROUP", 2)
    assert sorted(map(tuple, dense.dense_topk_ann(asked, units, 3).collect())) == small
    assert dense.candidate_pairs(asked, units).first()[0] > 0


def test_spans_leave_the_text_of_their_passage_behind(spark, monkeypatch):
    """the whole passage was shuffled with each of its sentences."""
    from answerloom.operators import read

    sent, join = [], read.salted_join
    monkeypatch.setattr(read, "salted_join", lambda big, *rest, **more: sent.append(big.columns) or join(big, *rest, **more))
    retrieved = spark.createDataFrame([(1, "u", "One w1. Two w2 w2. None."), (1, None, "w1"), (2, "u", None)], "q bigint, uid string, content string")
    idf = spark.createDataFrame([(1, [("w1", 2.0), ("w2", 1.0)])], "q bigint, terms array<struct<t: string, idf: double>>")
    got = sorted((r.q, r.uid or "", r.sent, r.answer, r.start, r.score) for r in read.candidate_spans(retrieved, idf).collect())
    assert got == [(1, "", 0, "w1", 0, 2.0), (1, "u", 0, "One w1.", 0, 1.414214), (1, "u", 1, "Two w2 w2.", 8, 0.57735)]
    assert all("content" not in columns for columns in sent)


def test_questions_on_few_passages_count_only_their_terms(spark):
    """the frequencies of all words of the corpus were counted, shuffled and sorted."""
    from answerloom.operators import generate

    docs = spark.createDataFrame([(i, _text(8)) for i in range(60)] + [(99, None)], "doc_id bigint, text string")
    passages = spark.createDataFrame([(1, 0, ["w1 what word", "w2 w3 zebra w3"]), (2, 0, ["w4 w5"])], "doc_id bigint, split_id int, sentences array<string>")
    few = generate.statistics_for(passages, docs)
    assert {r.t for r in few[0].collect()} <= {"w1", "w2", "w3", "what", "word", "zebra"}
    rows = lambda stats: sorted(map(tuple, generate.generate_questions(passages, stats).collect()))
    assert rows(few) == rows(docs) and len(rows(few)) == 2


@pytest.mark.parametrize("limit", [0, 64 << 20])
def test_no_row_is_made_of_two_blocks_of_vectors(spark, monkeypatch, limit):
    """a row of a pair of blocks held both, and what a task kept of a block held the batch it came in."""
    from answerloom.operators import dense

    rows = [(i, [RANDOM.uniform(-1, 1) for _ in range(8)]) for i in range(400)]
    units = spark.createDataFrame(rows, "uid bigint, emb array<float>").repartition(4)
    asked = units.withColumnRenamed("uid", "q")
    whole = sorted(map(tuple, dense.dense_topk_exact(asked, units, 3).collect()))
    seen, ranked = [], dense.top_k
    monkeypatch.setattr(dense, "top_k", lambda df, *rest: seen.append(df) or ranked(df, *rest))
    for name, value in (("BROADCAST_BYTES", limit), ("BLOCK", 16), ("GROUP", 3), ("HELD_BLOCKS", 4)):
        monkeypatch.setattr(dense, name, value)
    assert sorted(map(tuple, dense.dense_topk_exact(asked, units, 3).collect())) == whole
    assert len(dense.dense_topk_ann(asked, units, 3).collect()) == 3 * 400
    plans = [str(df._jdf.queryExecution().optimizedPlan()) for df in seen]
    assert len(plans) == 2 and not any("u_vectors" in line and "q_vectors" in line for plan in plans for line in plan.splitlines() if "MapInArrow" in line)
    read = dense.Block.read(next(iter(dense.packed(units, "uid").toArrow().to_batches())), 0, "u", "u_ids", True)
    assert read.vectors.flags.owndata and read.ids.offset == 0 and read.ids.buffers()[1].size <= 64 * len(read.ids)


@pytest.mark.parametrize("few", [True, False])
def test_cosines_by_blocks_are_those_of_all_pairs(spark, monkeypatch, tmp_path, few):
    """every query met every unit with a common term as a row, and every count was shuffled twice."""
    from answerloom.operators import tfidf_store

    monkeypatch.setattr(sparse, "fits_broadcast", lambda df, *rest: few)
    queries, units = _tables(spark)
    every = sparse.tfidf_scores(queries, units)
    passed, ranked = [], blocks.top_k
    monkeypatch.setattr(blocks, "top_k", lambda df, *rest: passed.append(df) or ranked(df, *rest))
    assert _rows(sparse.tfidf_topk(queries, units, 4)) == _rows(top_k(every, ["q"], [F.desc("score"), F.asc("uid")], 4))
    store = tfidf_store.TfidfStore.create(units, str(tmp_path / "s"))
    named = top_k(every.where("uid is not null"), ["q"], [F.desc("score"), F.asc("uid")], 4)
    assert _rows(store.topk(queries, 4)) == _rows(named)
    assert len(passed) == 2 and all(df.count() < every.count() / 4 for df in passed)
    wanted = lambda df: sorted((str(r.q), r.uid, round(r.score, 5)) for r in df.collect())
    pairs = named.where("rank < 3").select("q", "uid").where("q is not null")
    asked = store.scores(queries, pairs=pairs)
    assert wanted(asked) == wanted(every.join(pairs, ["q", "uid"]).select("q", "uid", "score"))
    assert _rows(sparse.rerank(queries, units, 8, 3, scores=lambda p: store.scores(queries, pairs=p)).drop("first_rank")) == _rows(
        sparse.rerank(queries, units, 8, 3, scores=store.scores(queries)).drop("first_rank")
    )
