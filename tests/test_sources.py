"""Readers, writers, logs, streams and pipelines."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from answerloom.operators import branches, dense, embed, generate, sparse, split, training
from answerloom.plans.pipeline import Pipeline
from answerloom.sources import index, results, runlog, squad, tabular
from answerloom.streaming import upload


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


SQUAD = {
    "version": "v2.0",
    "data": [
        {
            "title": "t",
            "paragraphs": [
                {
                    "context": "one  two three\nfour five six",
                    "qas": [
                        {"id": "a", "question": "q1", "is_impossible": False, "answers": [
                            {"text": "two", "answer_start": 5}, {"text": "three\nfour", "answer_start": 9}]},
                        {"id": "b", "question": "q2", "is_impossible": True, "answers": []},
                    ],
                }
            ],
        }
    ],
}


def test_squad_file_to_passages_and_labels(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps(SQUAD, indent=1))
    read = squad.read_squad(spark, str(tmp_path / "s.json"), multi_line=True)
    assert [(r["id"], r["answer"], r["is_impossible"]) for r in read.orderBy("id", "answer_start").collect()] == [
        ("a", "two", False), ("a", "three\nfour", False), ("b", None, True)]
    passages = squad.squad_passages(read, 3)
    assert [(r["split_id"], r["content"], r["first_char"]) for r in passages.orderBy("split_id").collect()] == [
        (0, "one two three", 0), (1, "four five six", 14)]
    got = {r["answer"]: (r["split_id"], r["start"]) for r in squad.squad_labels(read, passages).collect()}
    assert got == {"two": (0, 4), "three four": (None, None)}


def test_squad_round_trip_cuts_crowded_contexts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(squad, "QUESTIONS_PER_PARAGRAPH", 3)
    pairs = spark.createDataFrame(
        [("t", "ctx one", f"i{n}", f"q{n}", "one" if n % 4 else None, 4 if n % 4 else None) for n in range(20)],
        "title string, context string, id string, question string, answer string, answer_start int",
    )
    squad.write_squad(pairs, str(tmp_path / "out"))
    back = squad.read_squad(spark, str(tmp_path / "out"))
    assert rows(back.select(*pairs.columns)) == rows(pairs)
    assert spark.read.json(str(tmp_path / "out")).count() > 1


def test_question_list_with_bom_commas_and_quotes(spark, tmp_path):
    (tmp_path / "q.csv").write_bytes('﻿question\r\nWhat, and why?\r\n"Said ""x"", then?"\r\n\r\nPlain?\r\n'.encode())
    assert rows(results.read_questions(spark, str(tmp_path / "q.csv"))) == [
        ('Plain?',), ('Said "x", then?',), ("What, and why?",)]


LOG = """        0it [00:00, ?it/s]

 * Generating questions and answers for document 0: A preview
over two lines ...


Inferencing Samples:   0%|          | 0/1 [00:00<?, ? Batches/s]
Inferencing Samples: 100%|##########| 1/1 [00:00<00:00, 19.01 Batches/s]
1it [00:01,  1.25s/it]

Generated pairs:
 - Q: What is ""it""?
      A: first line
second line

after a blank line
      A: second answer
 - Q: No answer here.
---

 * Generating questions and answers for document 1: Next ...


Inferencing Samples: 100%|##########| 1/1 [00:00<00:00,  9.50 Batches/s]
2it [00:02,  2.00it/s]

Generated pairs:
 - Q: what is  ""it""?
      A: x
---
        """


def test_log_corner_cases(spark, tmp_path):
    (tmp_path / "log.txt").write_text(LOG)
    blocks = runlog.read_blocks(spark, str(tmp_path / "log.txt"))
    pairs = runlog.parse_pairs(blocks)
    assert [tuple(r) for r in pairs.orderBy("doc", "pos").collect()] == [
        (0, 0, 'What is ""it""?', ["first line\nsecond line\n\nafter a blank line", "second answer"]),
        (0, 1, "No answer here.", []),
        (1, 0, 'what is  ""it""?', ["x"]),
    ]
    assert rows(runlog.throughput(blocks)) == [(0, 1.25, 19.01), (1, 0.5, 9.5)]
    assert runlog.count_pairs(spark.read.text(str(tmp_path / "log.txt"))).first()["n"] == 3
    flags = [tuple(r)[2:] for r in runlog.pair_quality(pairs).orderBy("doc", "pos").collect()]
    assert flags == [(False, False, True, False), (True, True, False, False), (False, False, False, True)]


def test_log_round_trip(spark, tmp_path):
    blocks = spark.createDataFrame(
        [(i, f"text {i}\nmore", [(f"Q{i}?", [f"A{i}\n\nb", "c"]), ("N", [])], 150 + i, "s/it", 1234) for i in range(5)],
        "doc bigint, content string, pairs array<struct<question string, answers array<string>>>, rate int, unit string, batches int",
    )
    results.export(runlog.render_log(blocks), str(tmp_path / "log"), "txt")
    back = runlog.parse_pairs(runlog.read_blocks(spark, str(tmp_path / "log")))
    want = blocks.select("doc", F.posexplode("pairs").alias("pos", "p")).select("doc", "pos", "p.question", "p.answers")
    assert rows(back) == rows(want)


def test_corpus_of_text_files_and_stream(spark, tmp_path):
    folder = tmp_path / "up"
    folder.mkdir()
    for n in range(3):
        (folder / f"f{n}.txt").write_text(f"Text {n}.\nSecond line.")
    batch = index.load_corpus(spark, str(folder), {"lang": "en"})
    assert rows(batch.select("name", "content"))[0] == ("f0.txt", "Text 0.\nSecond line.")
    assert batch.select("meta").first()[0] == {"lang": "en"}
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    step = lambda s: s.withColumn("n", F.length("content"))
    first = upload.process_available(upload.uploaded_texts(spark, str(folder)), step, out, ckpt)
    assert rows(first) == rows(step(batch.select("name", "content")))
    (folder / "f3.txt").write_text("late")
    second = upload.process_available(upload.uploaded_texts(spark, str(folder)), step, out, ckpt)
    assert second.count() == 4
    upload.pairs_per_batch(
        upload.uploaded_texts(spark, str(folder)), lambda b: b.groupBy("name").count(), str(tmp_path / "b"), str(tmp_path / "bc")
    )
    assert spark.read.parquet(str(tmp_path / "b")).count() == 4


def test_index_life_cycle(spark, tmp_path):
    path = str(tmp_path / "docs")
    old = spark.createDataFrame([("a", "1", [1.0]), ("b", "2", [2.0])], "id string, content string, emb array<double>")
    index.write_index(old, path)
    assert index.scan(spark, path).columns == ["id", "content"]
    new = spark.createDataFrame([("b", "9", [3.0]), ("c", "3", [4.0])], old.schema)
    assert rows(index.upsert(spark.read.parquet(path), new).select("id", "content")) == [("a", "1"), ("b", "9"), ("c", "3")]
    assert rows(index.remaining(spark.read.parquet(path), F.col("id") == "a").select("id")) == [("b",)]
    assert index.first_document(spark.read.parquet(path)).first()["id"] == "a"
    index.delete_documents(spark, path)
    assert spark.read.parquet(path).count() == 0 and spark.read.parquet(path).columns == old.columns


def test_exports_survive_awkward_text(spark, tmp_path):
    df = spark.createDataFrame([(1, ' a "quoted", line\nnext '), (2, "")], "id int, text string")
    for kind in ("csv", "json"):
        results.export(df, str(tmp_path / kind), kind)
    assert rows(results.read_csv(spark, str(tmp_path / "csv"), "id int, text string")) == rows(df)
    assert rows(spark.read.schema(df.schema).json(str(tmp_path / "json"))) == rows(df)
    with pytest.raises(ValueError):
        results.export(df, str(tmp_path / "x"), "xls")


def test_tabular(spark, tmp_path):
    (tmp_path / "e.csv").write_text("Date/Time,Lat\n2024-01-01 17:05:00,1\nbad,2\n2024-01-02 03:00:00,3\n")
    df = tabular.lowercase_columns(tabular.read_limited(spark, str(tmp_path / "e.csv"), 3))
    assert df.columns == ["date/time", "lat"]
    ts = df.withColumn("date/time", tabular.parse_timestamp(F.col("date/time")))
    ts = tabular.keep_loaded(ts)
    hist = {r["hour"]: r["n"] for r in tabular.hour_histogram(ts, "`date/time`").collect()}
    assert len(hist) == 24 and hist[17] == 1 and hist[3] == 1 and sum(hist.values()) == 2
    assert tabular.filter_hour(ts, "`date/time`").count() == 1
    ts.unpersist()


@pytest.mark.parametrize("limit", [0, 64 << 20])
def test_dense_search_against_brute_force(spark, monkeypatch, tmp_path, limit):
    for name, value in (("BLOCK", 7), ("GROUP", 2), ("HELD_BLOCKS", 2), ("BROADCAST_BYTES", limit)):
        monkeypatch.setattr(dense, name, value)
    rng = np.random.default_rng(0)
    u, q = rng.normal(size=(60, 8)), rng.normal(size=(20, 8))
    u[10:40] = u[10]  # a group of copies: ties go by uid
    units = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(u)], "uid int, emb array<double>").repartition(3)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "q int, emb array<double>")
    scores = np.floor(q @ u.T * 1e6 + 0.5) / 1e6
    keys = [dense.band_keys(x, dense.hyperplanes(6, 8), 2) for x in (q, u)]
    listed = (keys[0][:, None] == keys[1][None]).any(2)

    def want(allowed):
        rows = [(i, j) for i in range(20) for j in sorted(range(60), key=lambda j: (-scores[i, j], j)) if allowed[i, j]]
        return {(i, r + 1): j for i in range(20) for r, j in enumerate([b for a, b in rows if a == i][:4])}

    def found(df):
        return {(r["q"], r["rank"]): r["uid"] for r in df.collect()}

    assert found(dense.dense_topk_exact(queries, units, 4)) == want(np.ones_like(listed))
    assert found(dense.dense_topk_ann(queries, units, 4, 2, 3)) == want(listed)
    dense.write_inverted(units, str(tmp_path / "lists"), 2, 3)
    assert found(dense.dense_topk_stored(queries, str(tmp_path / "lists"), 4, 2, 3)) == want(listed)
    # each pair that shares a list is scored once, and no other
    assert dense.candidate_pairs(queries, units, 2, 3).first()[0] == listed.sum()
    assert dense.dense_topk_exact(queries.limit(0), units, 4).count() == 0
    assert dense.dense_topk_ann(queries, units.limit(0), 4).count() == 0


def test_hyperplane_recall_on_the_given_vectors(spark):
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("uid"), F.col("embedding").alias("emb"))
    q = v.withColumnRenamed("uid", "q")
    assert dense.recall_at_k(dense.dense_topk_exact(q, v), dense.dense_topk_ann(q, v)).first()["recall"] >= 0.9


def test_only_missing_vectors_are_encoded(spark):
    df = spark.createDataFrame([("a", "x", [1.0]), ("b", "yy", None)], "uid string, content string, emb array<double>")
    encode = embed.model_encoder(lambda texts: [[float(len(t))] for t in texts], 16)
    assert rows(embed.update_embeddings(df, encode)) == [("a", "x", [1.0]), ("b", "yy", [2.0])]


def test_join_answers_puts_missing_scores_last(spark):
    a = spark.createDataFrame([(1, "a", 0.5, 1), (1, "b", 0.9, 2)], "q int, answer string, score double, rank int")
    b = spark.createDataFrame([(1, "g", None, 1)], a.schema)
    order = lambda df: [r["answer"] for r in df.orderBy("position").collect()]
    assert order(branches.join_answers([b, a])) == ["b", "a", "g"]
    assert order(branches.join_answers([b, a], sort_by_score=False)) == ["g", "a", "b"]


def test_training_helpers(spark):
    pairs = spark.createDataFrame([("1", "q", "old"), ("2", "q", "ok")], "id string, question string, answer string")
    fixes = spark.createDataFrame([("1", "new"), ("2", "ok")], "id string, answer string")
    assert rows(training.hard_pairs(pairs, fixes)) == [("1", "q", "old", "new")]
    labels = spark.createDataFrame([(f"query {n % 50}",) for n in range(200)], "query string")
    parts = training.split_train_eval(labels).groupBy("query").agg(F.countDistinct("part").alias("n"))
    assert parts.where("n > 1").count() == 0


def test_pipeline_routes_and_keeps_every_result(spark):
    df = spark.createDataFrame([("what?",), ("word",)], "query string")
    p = Pipeline().add_input("Query", df).add_branches("Router", branches.route_queries, "Query")
    p.add_node("Both", lambda a, b: a.unionByName(b), ["Router.output_1", "Router.output_2"])
    assert rows(p["Router.output_2"]) == [("what?",)] and p["Both"].count() == 2
    with pytest.raises(KeyError):
        p.add_node("X", lambda a: a, ["Nope"])
    with pytest.raises(ValueError):
        p.add_input("Query", df)


def test_pseudo_labels_of_copies_against_brute_force(spark):
    texts = {"a": "red fox runs", "b": "red fox runs", "c": "red dog sleeps", "d": "blue whale swims", "e": "red fox"}
    units = spark.createDataFrame(list(texts.items()), "uid string, content string")
    made = [("q1", "a", "red fox what?"), ("q1", "b", "red fox what?"), ("q2", "d", "blue whale what?")]
    asked = spark.createDataFrame(made, "q string, uid string, query string")
    scores = {(r["q"], r["uid"]): r["score"] for r in sparse.bm25_scores(asked.select("q", "query").distinct(), units).collect()}
    got = {(r["q"], r["pos_uid"]): (r["pos_score"], r["neg_uid"], r["neg_score"]) for r in training.pseudo_labels(asked, units).collect()}
    assert len(got) == 3
    for q, uid, _ in made:
        others = sorted((-s, u) for (x, u), s in scores.items() if x == q and u != uid)
        assert got[q, uid] == (scores[q, uid], *((others[0][1], -others[0][0]) if others else (None, None)))


def test_stored_postings_rank_as_the_texts_do(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    units = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("uid"), F.col("text").alias("content"))
    queries = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("q"), F.col("text").alias("query"))
    sparse.write_postings(units, str(tmp_path / "p"))
    assert rows(sparse.bm25_topk_stored(queries, str(tmp_path / "p"))) == rows(sparse.bm25_topk(queries, units))


def test_upsert_last_write_wins(spark):
    base = spark.createDataFrame([("a", "old", 0), ("b", "kept", 0)], "id string, content string, v int")
    new = spark.createDataFrame([("a", "first", 1), ("a", "last", 2), ("c", "z", 1), ("c", "y", 1)], "id string, content string, v int")
    got = sorted(tuple(r) for r in index.upsert(base, new, order="v").collect())
    assert got == [("a", "last", 2), ("b", "kept", 0), ("c", "z", 1)]


def test_report_keeps_queries_without_results(spark):
    from answerloom.operators import reports

    scores = spark.createDataFrame([(1, 0.0), (2, 0.5), (3, 1.0)], "q int, f1 double")
    found = spark.createDataFrame([(2, 1, "x"), (2, 2, "y"), (3, 1, "z")], "q int, rank int, answer string")
    got = reports.worst_queries(scores, found, "f1", 2).orderBy("q", "rank").collect()
    assert [(r.q, r.answer) for r in got] == [(1, None), (2, "x"), (2, "y")]


def test_question_named_like_the_header(spark, tmp_path):
    (tmp_path / "q.txt").write_bytes("\ufeffquestion\r\nwhat is it\r\nquestion\r\n\r\n".encode())
    got = [r.question for r in results.read_questions(spark, str(tmp_path)).collect()]
    assert got == ["what is it", "question"]


def test_stream_of_a_file_and_of_a_folder(spark, tmp_path):
    schema = "doc_id long, text string"
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    one, many = str(tmp_path / "one.parquet"), str(tmp_path / "many.parquet")
    table.repartition(5).write.parquet(many)
    table.toPandas().to_parquet(one)
    got = []
    for name, path in (("one", one), ("many", many)):
        stream = upload.uploaded_tables(spark, path, schema)
        out = upload.process_available(stream, lambda s: s.where("doc_id % 2 = 0"), str(tmp_path / name), str(tmp_path / f"{name}-c"))
        got.append(sorted(r.doc_id for r in out.collect()))
    assert got[0] == got[1] == [k for k in range(200) if k % 2 == 0]


def test_squad_distractors_and_impossible_questions(spark, tmp_path):
    paragraphs = [
        {"context": "The river Alm is short.", "qas": [
            {"id": "1", "question": "Which river?", "is_impossible": False, "answers": [{"text": "river Alm", "answer_start": 4}]},
            {"id": "2", "question": "How deep?", "is_impossible": True, "answers": []},
        ]},
        {"context": "Nobody asks about this one.", "qas": []},
    ]
    (tmp_path / "s.json").write_text(json.dumps({"version": "v2.0", "data": [{"title": "t", "paragraphs": paragraphs}]}))
    read = squad.read_squad(spark, str(tmp_path / "s.json"), multi_line=True)
    passages = squad.squad_passages(read, 50)
    assert {r.content for r in passages.collect()} == {p["context"] for p in paragraphs}
    labels = {r.q: r for r in squad.evaluation_labels(read, passages).collect()}
    assert labels["1"].answer == "river Alm" and labels["1"].start == 4 and labels["1"].uid.endswith("-0")
    assert labels["2"].answer == "" and labels["2"].uid is None
    squad.write_squad(read, str(tmp_path / "out"))
    back = squad.read_squad(spark, str(tmp_path / "out"))
    assert back.select("context").distinct().count() == 2 and back.where("id is not null").count() == 2


def test_answers_of_one_long_context_are_placed_in_linear_time(spark):
    words = [f"w{k}" + "  " * (k % 3 == 0) for k in range(30_000)]
    starts, text = [], "  "
    for w in words:
        starts.append(len(text))
        text += w + " "
    picked = [(k, 2) for k in range(0, 29_997, 4)]
    qas = [
        (f"i{k}", f"q{k}", False, [{"text": text[starts[k] : starts[k + n]].rstrip(), "answer_start": starts[k]}]) for k, n in picked
    ]
    schema = "title string, document_id bigint, context_id string, context string, qas array<struct<id string, question string, is_impossible boolean, answers array<struct<text string, answer_start int>>>>"
    rows = spark.createDataFrame([("t", 1, "c", text, qas)], schema)
    cut = squad.squad_passages(rows, 3)
    plain = " ".join(text.split())
    for r in cut.orderBy("split_id").limit(50).collect():
        assert r.raw == text[r.raw_start :][: len(r.raw)] and plain[r.first_char :].startswith(r.content)
    got = {r.id: (r.split_id, r.start, r.answer) for r in squad.squad_labels(squad.answers(rows), cut).collect()}
    assert len(got) == len(picked)
    for k, n in picked:
        answer = " ".join(w.strip() for w in words[k : k + n])
        split, at = k // 3, k % 3
        inside = at + n <= 3
        want = (split, len(" ".join(w.strip() for w in words[3 * split : k])) + (at > 0), answer) if inside else (None, None, answer)
        assert got[f"i{k}"] == want


def test_uploaded_texts_become_pairs_once(spark, tmp_path):
    folder, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "c")
    folder.mkdir()
    texts = {f"{k}.txt": f"The quiet harbour number{k} holds seven wooden boats today. Nobody counted them{k} before noon." for k in range(4)}
    for name in list(texts)[:3]:
        (folder / name).write_text(texts[name])
    docs = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    store = upload.StatisticsStore(spark, str(tmp_path / "s"))
    statistics = store.statistics(store.take(docs))

    def step(rows):
        named = rows.select(F.col("name").alias("doc_id"), F.col("content").alias("text"))
        return generate.generate_pairs(split.split_sentences(named, 100, keep_sentences=True), statistics)

    def pairs():
        upload.pairs_per_batch(upload.uploaded_texts(spark, str(folder)), step, out, checkpoint)
        return sorted(map(tuple, upload.read_batches(spark, out).select("doc_id", "sent", "question", "answer").collect()))

    chunks = split.split_sentences(docs, 100, keep_sentences=True)
    whole = sorted(map(tuple, generate.generate_pairs(chunks, docs).select("doc_id", "sent", "question", "answer").collect()))
    first = pairs()
    assert first == [r for r in whole if r[0] != "3.txt"] and len(first) == 6
    assert pairs() == first
    (folder / "3.txt").write_text(texts["3.txt"])
    store.take(docs.limit(1))  # a later snapshot changes nothing for this stream
    assert pairs() == whole
    assert store.statistics(0)[1] == 4 and store.statistics()[1] == 1
