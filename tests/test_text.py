"""Splitting, cleaning, term lookups."""

import pytest
from pyspark.sql import functions as F

from answerloom.functions import skew
from answerloom.functions.text import normal_answer, sentences, word_terms, words
from answerloom.operators import clean, generate, sparse, split, terms

SF = "/root/testdata/sf0.001"


def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")


def total_words(df, column):
    return df.agg(F.sum(F.size(words(F.col(column))))).first()[0]


def test_splitters_keep_every_word(spark):
    d = docs(spark)
    n = total_words(d, "text")
    assert total_words(split.split_words(d, 200), "content") == n
    assert total_words(split.split_sentences(d, 100), "content") == n
    assert total_words(split.split_sentences(d, 100, hard_max=True), "content") == n


def test_sentence_groups_are_short_unless_one_sentence(spark):
    groups = split.split_sentences(docs(spark), 100, keep_sentences=True)
    size = F.size(words(F.array_join("sentences", " ")))
    assert groups.where((size > 100) & (F.size("sentences") > 1)).count() == 0


def test_overlap_windows(spark):
    df = spark.createDataFrame([("a b c d e f g",), ("a b",), ("",), ("a b c",)], "text string")
    got = [r["content"] for r in split.split_words(df, 3, 1).collect()]
    assert got == ["a b c", "c d e", "e f g", "a b", "a b c"]
    with pytest.raises(ValueError):
        split.word_windows(F.col("text"), 3, 3)


def test_cleaning(spark):
    text = "  Title \n\n\n\n 12 3.5 77 \nwords 1 and more\n"
    row = spark.createDataFrame([(text,)], "t string").select(
        clean.clean_whitespace(F.col("t")), clean.clean_empty_lines(F.col("t")), clean.drop_numeric_lines(F.col("t"))
    ).first()
    assert row[0] == "Title\n\n\n\n12 3.5 77\nwords 1 and more\n"
    assert row[1] == "  Title \n\n 12 3.5 77 \nwords 1 and more\n"
    assert "77" not in row[2] and "words 1" in row[2]


def test_header_footer(spark):
    rows = [(i, f"Head\nbody {i}\nFoot" if i < 3 else f"Other\nbody {i}\nEnd {i}", "s") for i in range(4)]
    rows += [(9, "Head\nalone", "t")]
    got = clean.clean_header_footer(spark.createDataFrame(rows, "doc_id int, text string, source string"))
    texts = {r["doc_id"]: r["text"] for r in got.collect()}
    assert texts[0] == "body 0" and texts[3] == "Other\nbody 3\nEnd 3" and texts[9] == "Head\nalone"


def test_long_sentences_are_asked(spark):
    """One sentence of 5000 words gives a question per window, and no word is left out."""
    rows = [(1, " ".join(f"word{k:04d}" for k in range(5000)) + "."), (2, "Just three words."), (3, "One.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = generate.generate_questions(split.split_sentences(docs, 100, keep_sentences=True), docs).collect()
    assert sorted((r["doc_id"], r["sent"]) for r in asked) == [(1, k) for k in range(84)] + [(2, 0)]
    assert sum(len(r["question"].split()) for r in asked if r["doc_id"] == 1) == 5000


def test_sentences_and_terms(spark):
    row = spark.createDataFrame([("One, two!  Three? x.y Four",)], "t string").select(
        sentences(F.col("t")).alias("s"), word_terms(F.col("t")).alias("w"), normal_answer(F.lit("The  A-b, an c")).alias("n")
    ).first()
    assert row["s"] == ["One, two!", "Three?", "x.y Four"]
    assert row["w"] == ["one", "two", "three", "xy", "four"]
    assert row["n"] == "ab c"


@pytest.mark.parametrize("share", [0.0001, 0.2, 2.0])
def test_frequency_lookup_is_the_same_for_any_share_of_hot_terms(spark, share):
    posts = spark.createDataFrame([(u, t) for u in range(10) for t in "abcde"[: u % 5 + 1] + "z"], "uid int, t string")
    dfs = posts.where("t <> 'z'").groupBy("t").agg(F.count("*").alias("df"))
    got = skew.lookup_document_frequency(posts, dfs, F.lit(10), share)
    want = posts.join(dfs, "t", "left").select("uid", "t", F.coalesce("df", F.lit(0)).alias("df"))
    assert sorted(map(tuple, got.select("uid", "t", "df").collect())) == sorted(map(tuple, want.collect()))


def test_bm25_is_the_same_with_and_without_broadcast(spark, monkeypatch):
    units = docs(spark).select(F.col("doc_id").alias("uid"), F.col("text").alias("content"))
    queries = spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id").alias("q"), F.col("text").alias("query"))
    small = sorted(map(tuple, sparse.bm25_topk(queries, units).collect()))
    cosine = sorted(map(tuple, sparse.tfidf_topk(queries, units).collect()))
    monkeypatch.setattr(sparse, "fits_broadcast", lambda df: False)
    assert sorted(map(tuple, sparse.bm25_topk(queries, units).collect())) == small
    assert sorted(map(tuple, sparse.tfidf_topk(queries, units).collect())) == cosine


def test_tfidf_vectors_have_length_one(spark):
    units = docs(spark).select(F.col("doc_id").alias("uid"), F.col("text").alias("content"))
    lengths = terms.tfidf_weights(units, ["uid"], "content").groupBy("uid").agg(F.sum(F.col("w") * F.col("w")).alias("l"))
    assert lengths.where(F.abs(F.col("l") - 1) > 1e-9).count() == 0


def test_pairs_answer_with_their_own_sentence(spark):
    d = docs(spark)
    chunks = split.split_sentences(d.select("doc_id", "text"), 100, keep_sentences=True)
    pairs = generate.generate_pairs(chunks, d)
    row = pairs.agg(F.avg((F.col("sent") == F.col("answer_sent")).cast("int")), F.min(F.col("question").endswith("?"))).first()
    assert row[0] >= 0.99 and row[1]
    offsets = pairs.join(chunks, ["doc_id", "split_id"]).where(
        F.substring(F.array_join("sentences", " "), F.col("answer_start") + 1, F.length("answer")) != F.col("answer")
    )
    assert offsets.count() == 0


def test_terms_never_seen_are_the_rarest(spark):
    corpus = spark.createDataFrame([(1, "alpha beta gamma delta epsilon")], "doc_id int, text string")
    passage = spark.createDataFrame([("p", 0, ["alpha beta gamma unseen epsilon."])], "doc_id string, split_id int, sentences array<string>")
    row = generate.generate_questions(passage, corpus).first()
    assert row["question"] == "alpha beta gamma what epsilon?" and row["answer"] == "unseen"
