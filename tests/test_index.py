"""Stored indexes: bounded postings, written changes and vectors."""

import random

import pytest
from pyspark.sql import functions as F

from answerloom.operators import embed, postings, sparse, terms, tfidf_store
from answerloom.sources import changes, manifest, vectors


def test_pruned_search_ranks_as_the_whole_one(spark, tmp_path):
    rng = random.Random(3)
    common, rare = [f"c{k}" for k in range(20)], [f"r{k}" for k in range(300)]
    texts = [" ".join(rng.choices(common, k=30) + rng.choices(rare, k=rng.randint(0, 3))) for _ in range(400)]
    texts += texts[:40] + [None, "", "c0"]  # copies tie
    units = spark.createDataFrame(list(enumerate(texts)), "uid int, content string").repartition(4)
    asked = [" ".join(rng.choices(common, k=2) + rng.choices(rare, k=2)) for _ in range(30)] + ["c0 c1", "nowhere", "", texts[0], "C0! r5"]
    queries = spark.createDataFrame(list(enumerate(asked)), "q int, query string")
    path = str(tmp_path / "p")
    postings.write_blocks(units, path, per_block=16)
    whole = sorted(map(tuple, sparse.bm25_topk(queries, units, 4).select("q", "uid", "score", "rank").collect()))
    for seed in (1, 4):
        found = postings.search(queries, path, 4, seed)
        assert sorted(map(tuple, found.hits.select("q", "uid", "score", "rank").collect())) == whole
    blocks, read = postings.postings_read(found).first()
    assert read < 0.6 * blocks
    assert postings.bm25_topk_pruned(queries.limit(0), path).count() == 0
    postings.write_blocks(units.limit(0), str(tmp_path / "none"))
    assert postings.bm25_topk_pruned(queries, str(tmp_path / "none")).count() == 0


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_written_changes_are_merged_on_read(spark, tmp_path):
    base = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (3, "c", 3.0), (None, "n", 0.0)], "id int, content string, x double")
    index = changes.WrittenIndex.create(base, str(tmp_path / "i"), "id")
    new = spark.createDataFrame([(2, "b2", 1), (2, "b3", 2), (4, "d", 1), (None, "m", 1)], "id int, content string, at int")
    index.upsert(new, order="at")
    want = [(1, "a", 1.0), (2, "b3", None), (3, "c", 3.0), (4, "d", None), (None, "m", None)]
    assert rows_of(index.read()) == sorted(want, key=str)
    index.delete((F.col("content") == "a") | F.col("id").isNull())
    index.upsert(spark.createDataFrame([(3, "c9", 9.0)], "id int, content string, x double"))
    left = [(2, "b3", None), (3, "c9", 9.0), (4, "d", None)]
    assert rows_of(index.read()) == left
    # a deleted key can come back, and versions before stay readable
    index.upsert(spark.createDataFrame([(1, "again", 1.0)], "id int, content string, x double"))
    assert rows_of(index.read()) == [(1, "again", 1.0), *left]
    index.compact()
    assert index.manifest()["changes"] == [] and rows_of(index.read()) == [(1, "again", 1.0), *left]
    assert rows_of(index.read(1)) == sorted(want, key=str)
    index.clear()
    assert index.read().count() == 0 and index.read().schema == base.schema
    assert index.versions() == list(range(7))


def test_failed_and_concurrent_changes_leave_the_state(spark, tmp_path):
    base = spark.createDataFrame([(1, "a")], "id int, content string")
    index = changes.WrittenIndex.create(base, str(tmp_path / "i"), "id")
    broken = base.select("id", F.raise_error(F.lit("no")).cast("string").alias("content"))
    with pytest.raises(Exception):
        index.upsert(broken)
    with pytest.raises(Exception):
        index.delete(F.raise_error(F.lit("no")).cast("boolean"))
    assert index.versions() == [0] and rows_of(index.read()) == [(1, "a")]
    other = changes.WrittenIndex(spark, str(tmp_path / "i"))
    before = other.manifest()
    index.upsert(spark.createDataFrame([(2, "b")], "id int, content string"))
    with pytest.raises(manifest.ConcurrentChange):
        other._commit(before, 0)
    assert rows_of(other.read()) == [(1, "a"), (2, "b")]


def corpus(rng, n):
    return [" ".join(rng.choices([f"w{k}" for k in range(60)], k=rng.randint(1, 25))) for _ in range(n)]


def test_stored_weights_follow_additions_without_rewriting(spark, tmp_path):
    rng = random.Random(8)
    texts = corpus(rng, 90) + [None, "", "w1 w1"]
    units = spark.createDataFrame(list(enumerate(texts)), "uid int, content string")
    queries = spark.createDataFrame(list(enumerate(corpus(rng, 12) + ["nowhere", ""])), "q int, query string")
    store = tfidf_store.TfidfStore.create(units.where("uid < 40"), str(tmp_path / "s"))
    first = store.manifest()
    one = rows_of(store.topk(queries, 4))
    assert one == rows_of(sparse.tfidf_topk(queries, units.where("uid < 40"), 4).select("q", "uid", "score", "rank"))
    store.add(units.where("uid >= 40"))
    assert rows_of(store.topk(queries, 4)) == rows_of(sparse.tfidf_topk(queries, units, 4).select("q", "uid", "score", "rank"))
    assert store.manifest()["counts"][:1] == first["counts"]  # what was written of old units stands
    with pytest.raises(Exception):
        store.add(units.select(F.col("uid") + 500, F.raise_error(F.lit("no")).cast("string").alias("content")).toDF("uid", "content"))
    assert store.versions() == [0, 1]
    assert rows_of(store.topk(queries, 4, version=0)) == one


def test_vectors_are_encoded_once_per_content_and_version(spark, tmp_path):
    rng = random.Random(9)
    texts = corpus(rng, 20)
    units = spark.createDataFrame([*enumerate(texts), (50, texts[0]), (51, None)], "uid int, content string")
    counts = terms.term_counts(units, ["uid"], "content")
    encode = embed.frozen_encoder(terms.document_frequency(counts), 22)
    store = vectors.VectorStore(spark, str(tmp_path / "v"))
    assert store.missing(units, "one").count() == len(set(texts))
    store.fill(units, encode, "one")
    assert store.missing(units, "one").count() == 0

    def never(df):
        raise AssertionError("encoded again")

    store.fill(units, never, "one")
    got = {r.uid: r.emb for r in store.vectors(units, "one").collect()}
    want = {r.uid: r.emb for r in encode(units).collect()}
    assert set(got) == set(range(20)) | {50} and got[50] == got[0]
    assert all(got[k] == pytest.approx(want[k]) for k in range(20))
    # a changed text is found, and only that; another version starts anew
    changed = units.withColumn("content", F.when(F.col("uid") == 3, "quite new words").otherwise(F.col("content")))
    assert [r.content for r in store.missing(changed, "one").collect()] == ["quite new words"]
    store.fill(changed, encode, "one")
    assert store.vectors(changed, "one").count() == 21 and store.missing(changed, "two").count() == 20


def test_blocks_are_stored_whole_and_shared_keys_bounded_together(spark, tmp_path):
    """every posting was a row of three shuffles; a key with units of several lengths could score above its bound."""
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choices([f"w{k}" for k in range(30)], k=rng.randint(3, 12)))) for i in range(200)]
    rows += [(7, "z1 z1 z2"), (7, "z1 z3"), (7, "z1"), (None, "z1 w1"), (None, "w2"), *((300 + i, "z1 z1 z1 z2") for i in range(40))]
    units = spark.createDataFrame(rows, "uid int, content string").repartition(3)
    queries = spark.createDataFrame([(1, "z1"), (1, "z2 w3"), (2, "w1 w2 z1"), (3, "z2 z3")], "q int, query string")
    path = str(tmp_path / "p")
    postings.write_blocks(units, path, per_block=8)
    assert spark.read.parquet(f"{path}/blocks").count() < len(rows) / 2
    whole = rows_of(sparse.bm25_topk(queries, units, 1).select("q", "uid", "score", "rank"))
    assert rows_of(postings.search(queries, path, 1, 1).hits.select("q", "uid", "score", "rank")) == whole
