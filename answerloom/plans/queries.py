"""Registered queries: name to (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerloom.functions import ranking as R
from answerloom.functions import text as X
from answerloom.functions.skew import fits_broadcast, salted_join
from answerloom.operators import (
    branches,
    clean,
    dense,
    embed,
    generate,
    labels,
    postings,
    read,
    reader_metrics,
    reports,
    retriever_metrics,
    scopes,
    similarity,
    sparse,
    split,
    terms,
    tfidf_store,
    training,
)
from answerloom.plans import tables as T
from answerloom.plans.pipeline import Pipeline
from answerloom.session import stage, staged_path
from answerloom.sources import changes, index, results, runlog, squad, tabular, vectors
from answerloom.streaming import upload

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


# --- cleaning and splitting -------------------------------------------------------------------------


def _cleaned(spark, d, fn):
    return T.documents(spark, d).select("doc_id", fn(F.col("text")).alias("text"))


@query
def clean_whitespace(spark, d):
    return _cleaned(spark, d, clean.clean_whitespace)


@query
def clean_empty_lines(spark, d):
    return _cleaned(spark, d, clean.clean_empty_lines)


@query
def clean_header_footer(spark, d):
    return clean.clean_header_footer(T.documents(spark, d)).select("doc_id", "text")


@query
def drop_numeric_lines(spark, d):
    return _cleaned(spark, d, clean.drop_numeric_lines)


@query
def split_words(spark, d):
    return T.passages(spark, d).select("doc_id", "split_id", "content")


@query
def split_overlap(spark, d):
    docs = T.documents(spark, d).select("doc_id", "text")
    return split.split_words(docs, 200, 50).select("doc_id", "split_id", "content")


@query
def split_sentences(spark, d):
    docs = T.documents(spark, d).select("doc_id", "text")
    return split.split_sentences(docs, 100).select("doc_id", "split_id", "content")


@query
def split_sentences_hard_max(spark, d):
    docs = T.documents(spark, d).select("doc_id", "text")
    return split.split_sentences(docs, 100, hard_max=True).select("doc_id", "split_id", "content")


@query
def filter_language(spark, d):
    docs = clean.filter_language(T.documents(spark, d), ["en"])
    share = R.round6(clean.stop_word_share(F.col("text"), "en"))
    return docs.select("doc_id", "lang", share.alias("stop_word_share"))


@query
def chunk_id(spark, d):
    docs = T.documents(spark, d).select("doc_id", "text", F.col("text").alias("parent"))
    cut = split.split_words(docs, 200)
    return cut.select("doc_id", "split_id", split.chunk_id(F.col("parent"), F.col("split_id")).alias("id"))


@query
def truncate_tokens(spark, d):
    queries = T.items(spark, d).select(
        F.lit("query").alias("kind"), F.col("q").cast("string").alias("uid"),
        clean.truncate_tokens(F.col("query"), 64).alias("content"),
    )
    passages = T.documents(spark, d).select(
        F.lit("passage").alias("kind"), F.col("doc_id").cast("string").alias("uid"),
        clean.truncate_tokens(F.col("text"), 256).alias("content"),
    )
    return queries.unionByName(passages)


@query
def embed_title(spark, d):
    passages = T.passages(spark, d)
    return passages.select("uid", clean.embed_title(F.col("source"), F.col("content")).alias("content"))


@query
def embed_page_title(spark, d):
    pages = T.table(spark, d, "pages")
    text = F.trim(F.regexp_replace(F.regexp_replace("html", r"<[^>]*>", " "), r"\s+", " "))
    return pages.select("page_id", clean.embed_title(clean.html_title(F.col("html")), text).alias("content"))


@query
def preview(spark, d):
    return T.passages(spark, d).select("uid", clean.preview(F.col("content")).alias("preview"))


# --- index statistics -------------------------------------------------------------------------------


@query
def term_stats(spark, d):
    counts = terms.term_counts(T.document_units(spark, d), ["uid"], "content")
    return counts.groupBy("t").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query
def corpus_size(spark, d):
    size = terms.corpus_size(T.document_units(spark, d), "content")
    return size.select("n", R.round6(F.col("avgdl")).alias("avgdl"))


@query
def tfidf_vectors(spark, d):
    weights = terms.tfidf_weights(T.document_units(spark, d), ["uid"], "content")
    return weights.select("uid", "t", R.round6(F.col("w")).alias("w"))


@query
def keywords(spark, d):
    weights = terms.tfidf_weights(T.document_units(spark, d), ["uid"], "content")
    return terms.keywords(weights, ["uid"], 10)


# --- retrieval --------------------------------------------------------------------------------------


@query
def bm25_topk(spark, d):
    return sparse.bm25_topk(T.items(spark, d), T.document_units(spark, d), 5)


@query
def bm25_topk_stored(spark, d):
    path = staged_path(spark, "terms")
    sparse.write_postings(T.document_units(spark, d), path)
    return sparse.bm25_topk_stored(T.items(spark, d), path, 5)


@query
def bm25_topk_pruned(spark, d):
    """Stored postings again, reading only blocks whose score bound can still reach the best five."""
    path = staged_path(spark, "blocks")
    postings.write_blocks(T.document_units(spark, d), path)
    return postings.bm25_topk_pruned(T.items(spark, d), path, 5)


def _tfidf_store(spark, d):
    return tfidf_store.TfidfStore.create(T.document_units(spark, d), staged_path(spark, "counts"))


@query
def tfidf_topk(spark, d):
    return _tfidf_store(spark, d).topk(T.items(spark, d), 5)


@query
def tfidf_topk_added(spark, d):
    """The same corpus stored in two additions: first what is English, then the rest."""
    docs, english = T.documents(spark, d), F.col("lang").eqNullSafe("en")
    units = lambda rows: rows.select(F.col("doc_id").alias("uid"), F.col("text").alias("content"))
    store = tfidf_store.TfidfStore.create(units(docs.where(english)), staged_path(spark, "counts"))
    store.add(units(docs.where(~english)))
    return store.topk(T.items(spark, d), 5)


@query
def rerank(spark, d):
    queries = T.items(spark, d)
    store = _tfidf_store(spark, d)
    return sparse.rerank(queries, T.document_units(spark, d), scores=lambda pairs: store.scores(queries, pairs=pairs))


def _passage_hits(spark, d, k=5):
    return sparse.bm25_topk(T.items(spark, d), T.passage_units(spark, d), k)


def _retrieved(spark, d, k=5):
    """(q, query, uid, score, rank, doc_id, source, content) of the best passages.

    Predictions are computed once and stored, at most k rows per query; metrics read them any number of times.
    The hits are stored before the texts are added: from their size Catalyst sees whether to send the hits to
    the passages or to shuffle both.
    """
    hits = stage(_passage_hits(spark, d, k), "hits")
    queries = T.items(spark, d).select("q", "query")
    passages = T.passages(spark, d).select("uid", "doc_id", "source", "content")
    return stage(hits.join(passages, "uid").join(queries, "q"), "retrieved")


@query
def document_search(spark, d):
    return _retrieved(spark, d).select("q", "query", "rank", "score", "uid", "content")


# --- generation and reading -------------------------------------------------------------------------


@query
def generate_questions(spark, d):
    return generate.generate_questions(T.chunks(spark, d), T.documents(spark, d))


@query
def qa_generation(spark, d):
    return generate.generate_pairs(T.chunks(spark, d), T.documents(spark, d))


def _labels(spark, d):
    return stage(T.passage_labels(spark, d), "labels")


def _gold(spark, d):
    return stage(T.gold_passages(spark, d), "gold")


def _read(spark, d, retrieved=None):
    """Answers of what was retrieved; a query that needs the passages as well retrieves them once and hands them over."""
    idf = read.query_idf(T.items(spark, d), T.documents(spark, d))
    return stage(read.extract_answers(_retrieved(spark, d) if retrieved is None else retrieved, idf), "read")


@query
def extract_answers(spark, d):
    return _read(spark, d)


# --- labels and evaluation --------------------------------------------------------------------------


@query
def labels_aggregated(spark, d):
    grouped = labels.labels_aggregated(T.passage_labels(spark, d))
    return grouped.select("q", "query", "uid", F.array_join("answers", "|").alias("answers"), "n_labels")


@query
def retriever_eval(spark, d):
    return retriever_metrics.mark_relevant(_retrieved(spark, d), T.passage_labels(spark, d))


@query
def query_scores(spark, d):
    rel = retriever_metrics.mark_relevant(_retrieved(spark, d), _labels(spark, d))
    scores = retriever_metrics.query_scores(rel)
    names = ["recall_single_hit", "mrr", "precision", "map"]
    return scores.select("q", *[R.round6(F.col(n)).alias(n) for n in names])


def _retriever_metrics(hits, retrieved, gold):
    """(metric, value) over the queries that have a gold document."""
    answered = gold.where(F.col("answer") != "")
    rel = retriever_metrics.mark_relevant(retrieved, answered)
    single = retriever_metrics.mean_scores(
        retriever_metrics.query_scores(rel), ["recall_single_hit", "mrr", "precision", "map"]
    )
    multi = retriever_metrics.recall_multi_hit(retriever_metrics.gold_document_hits(hits, answered))
    return single.unionByName(retriever_metrics.mean_scores(multi, ["recall_multi_hit"]))


@query
def retriever_metrics_all(spark, d):
    retrieved = _retrieved(spark, d)
    return _retriever_metrics(retrieved.select("q", "uid", "rank"), retrieved, _labels(spark, d))


def _scored_predictions(predictions, gold):
    return reader_metrics.prediction_scores(reader_metrics.overlap_f1(reader_metrics.answer_pairs(predictions, gold)))


@query
def answer_scores(spark, d):
    scored = _scored_predictions(_read(spark, d), _labels(spark, d))
    return scored.select("q", "rank", "em", R.round6(F.col("f1")).alias("f1"))


def _reader_metrics(predictions, gold):
    answered = gold.where(F.col("answer") != "")
    scores = reader_metrics.query_answer_scores(_scored_predictions(predictions, answered), answered)
    return reader_metrics.pipeline_reader_metrics(scores)


@query
def reader_metrics_all(spark, d):
    return _reader_metrics(_read(spark, d), _labels(spark, d))


NO_ANSWER_SCORE = 6.0


def _read_or_none(spark, d):
    idf = read.query_idf(T.items(spark, d), T.documents(spark, d))
    spans = read.candidate_spans(_retrieved(spark, d), idf)
    return stage(read.with_no_answer(spans, T.items(spark, d).select("q"), NO_ANSWER_SCORE, 0.5), "read")


@query
def no_answer(spark, d):
    return _read_or_none(spark, d)


@query
def extractive_qa(spark, d):
    answers = _read_or_none(spark, d).select("q", "rank", "uid", "answer", "score")
    return answers.join(T.items(spark, d).select("q", "query"), "q")


@query
def reader_eval(spark, d):
    gold = _labels(spark, d)
    return reader_metrics.reader_eval(_scored_predictions(_read_or_none(spark, d), gold), gold)


@query
def retrieve_then_generate(spark, d):
    """Questions on the passages that queries retrieve; a passage retrieved by many is read once."""
    found = _retrieved(spark, d).select("q", "rank", "uid", "content")
    once = found.groupBy("uid").agg(F.first("content").alias("content")).select(
        F.col("uid").alias("doc_id"), F.lit(0).alias("split_id"), X.sentences(F.col("content")).alias("sentences")
    )
    asked = generate.generate_questions(once, generate.statistics_for(once, T.documents(spark, d)))
    return found.select("q", "rank", "uid").join(asked.withColumnRenamed("doc_id", "uid"), "uid").select(
        "q", "rank", "uid", "sent", "question", "answer"
    )


@query
def pseudo_labels(spark, d):
    """Questions on the passages that queries retrieve, each with the best passage it was not made from."""
    made = retrieve_then_generate(spark, d).select(
        F.md5(F.col("question").cast("binary")).alias("q"), "uid", F.col("question").alias("query")
    )
    asked = stage(made.distinct(), "asked")
    rows = training.pseudo_labels(asked, T.passage_units(spark, d))
    return rows.withColumn("q", F.concat_ws(":", "pos_uid", "q"))


@query
def hard_pairs(spark, d):
    """Generated answers corrected by the sentence their question was made from."""
    pairs = generate.generate_pairs(T.chunks(spark, d), T.documents(spark, d)).select(
        F.concat_ws("-", "doc_id", "split_id", "sent").alias("id"), "question", "answer"
    )
    asked = X.each(
        generate.bounded_sentences(T.chunks(spark, d)), ["doc_id", "split_id"], F.col("sentences"), "answer", "sent"
    ).select(F.concat_ws("-", "doc_id", "split_id", "sent").alias("id"), "answer")
    return training.hard_pairs(pairs, asked)


@query
def split_train_eval(spark, d):
    return training.split_train_eval(T.dialogue_pairs(spark, d), "question").select("conv_id", "turn", "part")


@query
def context_match(spark, d):
    gold = _gold(spark, d).where(F.col("answer") != "").select("q", "uid", "gold_context")
    shares = scopes.context_shares(_retrieved(spark, d).select("q", "rank", "content"), gold)
    return shares.select(
        "q", "rank", "uid", R.round6(F.col("share")).alias("containment"), (F.col("share") >= scopes.CONTAINMENT).alias("matched")
    )


def _scoped(spark, d, key):
    retrieved = _retrieved(spark, d).withColumn("doc_key", F.col(key))
    gold = _gold(spark, d).withColumn("gold_key", F.col(key))
    return scopes.scoped_relevance(scopes.scoped_pairs(retrieved, gold))


def _scope_metrics(relevance):
    by = ("answer_scope", "document_scope")
    per_row = relevance.groupBy(*by, "q", "rank").agg(F.max("rel").alias("rel"))
    single = retriever_metrics.mean_scores(
        retriever_metrics.query_scores(per_row, by), ["recall_single_hit", "mrr", "precision", "map"], by
    )
    per_gold = relevance.groupBy(*by, "q", "gold_key").agg(F.max("rel").alias("hit"))
    multi = retriever_metrics.recall_multi_hit(per_gold, by)
    return single.unionByName(retriever_metrics.mean_scores(multi, ["recall_multi_hit"], by))


@query
def scope_metrics(spark, d):
    return _scope_metrics(_scoped(spark, d, "uid"))


@query
def custom_document_id(spark, d):
    """File level: the source name takes the place of the document id."""
    rows = _scope_metrics(_scoped(spark, d, "source"))
    return rows.where((F.col("answer_scope") == "any") & (F.col("document_scope") == "document_id"))


@query
def scoped_reader_metrics(spark, d):
    """Exact match and F1 per answer scope: an answer from the wrong place scores nothing."""
    gold = _gold(spark, d).where(F.col("answer") != "")
    context = T.passages(spark, d).select("uid", "content")
    found = _read(spark, d).join(context, "uid").select("q", "rank", F.col("uid").alias("doc_key"), "answer", "content")
    gold_rows = gold.select("q", F.col("answer").alias("gold_answer"), F.col("uid").alias("gold_key"), "gold_context")
    pairs = salted_join(gold_rows, found, ["q"], ["gold_answer", "gold_key"]).select(
        "q", "rank", "gold_key",
        X.normal_answer(F.col("answer")).alias("pred"), X.normal_answer(F.col("gold_answer")).alias("gold"),
        scopes.id_match(F.col("doc_key"), F.col("gold_key")).alias("same_id"),
        scopes.context_match(F.col("content"), F.col("gold_context")).alias("same_context"),
    )
    scored = reader_metrics.overlap_f1(pairs, ("gold_key",))
    cases = F.array(*[
        F.struct(
            F.lit(a).alias("answer_scope"),
            scopes.answer_scope(a, F.col("same_id"), F.col("same_context")).cast("int").alias("ok"),
        )
        for a in scopes.ANSWER_SCOPES
    ])
    best = scored.select("q", "em", "f1", F.explode(cases).alias("c")).groupBy("c.answer_scope", "q").agg(
        F.max(F.col("em") * F.col("c.ok")).alias("em"), F.max(F.col("f1") * F.col("c.ok")).alias("f1")
    )
    asked = gold.select("q").distinct().agg(F.count("*")).scalar()
    return best.groupBy("answer_scope").agg(
        F.sum("em").alias("em"), F.sum("f1").alias("f1")
    ).select(
        "answer_scope", R.round6(F.col("em") / asked).alias("exact_match"), R.round6(F.col("f1") / asked).alias("f1")
    )


@query
def eval_isolated(spark, d):
    """The reader on retrieved and on gold passages."""
    gold = _labels(spark, d)
    integrated = _reader_metrics(_read(spark, d), gold)
    idf = read.query_idf(T.items(spark, d), T.documents(spark, d))
    given = gold.where(F.col("answer") != "").select("q", "query", "uid").join(T.passage_units(spark, d), "uid")
    isolated = _reader_metrics(read.extract_answers(given, idf), gold)
    return reports.isolated_gap(integrated, isolated)


@query
def lexical_similarity(spark, d):
    gold = _labels(spark, d).where(F.col("answer") != "").select("q", F.col("answer").alias("b")).distinct()
    read_answers = _read(spark, d).select("q", "rank", F.col("answer").alias("a"))
    pairs = salted_join(gold, read_answers, ["q"], ["b"]).select(
        F.concat_ws("-", "q", "rank").alias("key"), "a", "b"
    )
    units = T.document_units(spark, d)
    dfs = terms.document_frequency(terms.term_counts(units, ["uid"], "content"))
    return similarity.lexical_similarity(pairs, dfs, units.agg(F.count("*")).scalar())


@query
def eval_report(spark, d):
    gold = _labels(spark, d).where(F.col("answer") != "")
    predictions = _read(spark, d)
    scores = reader_metrics.query_answer_scores(_scored_predictions(predictions, gold), gold).select(
        "q", R.round6(F.col("f1")).alias("f1")
    )
    return reports.worst_queries(scores, predictions.select("q", "rank", "answer"), "f1", 5)


def _metric_runs(spark, d):
    """Reader with one answer per query ("before") and with four ("after")."""
    gold = _labels(spark, d)
    answers = _read(spark, d)
    runs = {"before": answers.where(F.col("rank") == 1), "after": answers}
    tables = [
        _reader_metrics(rows, gold).select(F.lit(run).alias("run"), F.lit("Reader").alias("node"), "metric", "value")
        for run, rows in runs.items()
    ]
    return tables[0].unionByName(tables[1])


@query
def compare_runs(spark, d):
    return reports.compare_runs(_metric_runs(spark, d), "before", "after")


@query
def score_table(spark, d):
    return reports.score_table(_reader_metrics(_read(spark, d), _labels(spark, d)))


# --- dense retrieval, routing and merging -----------------------------------------------------------


def _vectors(spark, d):
    return T.spread(T.table(spark, d, "embeddings")).select(F.col("vec_id").alias("uid"), F.col("embedding").alias("emb"))


@query
def dense_topk_exact(spark, d):
    units = _vectors(spark, d)
    return dense.dense_topk_exact(units.withColumnRenamed("uid", "q"), units)


@query
def dense_topk_ann(spark, d):
    units = _vectors(spark, d)
    return dense.dense_topk_ann(units.withColumnRenamed("uid", "q"), units)


@query
def dense_topk_stored(spark, d):
    """The approximate search from stored lists."""
    units = _vectors(spark, d)
    path = staged_path(spark, "inverted")
    dense.write_inverted(units, path)
    return dense.dense_topk_stored(units.withColumnRenamed("uid", "q"), path)


@query
def ann_recall(spark, d):
    """Recall beside the share of all pairs that were scored for it."""
    units = _vectors(spark, d)
    found = dense.recall_at_k(dense_topk_exact(spark, d), dense_topk_ann(spark, d))
    scored = dense.candidate_pairs(units.withColumnRenamed("uid", "q"), units)
    everything = units.agg((F.count("*") * F.count("*")).alias("all_pairs"))
    return found.join(scored, F.lit(True)).join(everything, F.lit(True))


def _titled_passages(spark, d):
    """Passages with their title in front."""
    return T.passages(spark, d).select("uid", clean.embed_title(F.col("source"), F.col("content")).alias("content"))


def _encode(units):
    weights = terms.tfidf_weights(units, ["uid"], "content", embed.with_dimensions)
    return embed.dense_vectors(embed.hashed_components(weights, "uid"), "uid")


@query
def update_embeddings(spark, d):
    """Vectors of titled passages, non-zero dimensions only."""
    index_rows = _titled_passages(spark, d).withColumn("emb", F.lit(None).cast("array<double>"))
    filled = embed.update_embeddings(index_rows, _encode)
    return filled.select("uid", F.posexplode("emb").alias("dim", "value")).select(
        "uid", "dim", R.round6(F.col("value")).alias("value")
    ).where(F.col("value") != 0)


@query
def dense_topk_dual(spark, d):
    """Queries and passages have encoders of their own: passages carry a title and are encoded once, into a store; queries
    take the passages' weights."""
    passages = _titled_passages(spark, d)
    queries = T.items(spark, d).select("q", "query")
    frequencies = stage(terms.document_frequency(terms.term_counts(passages, ["uid"], "content")), "frequencies")
    n = passages.count()
    store = vectors.VectorStore(spark, staged_path(spark, "vectors"))
    version = f"tfidf-{embed.DIMENSIONS}-{n}-{frequencies.agg(F.bit_xor(F.xxhash64('t', 'df'))).first()[0]}"
    store.fill(passages, embed.frozen_encoder(frequencies, n), version)
    asked = sparse.query_tfidf(queries, n, frequencies, fits_broadcast(sparse.query_terms(queries)))
    q_vectors = embed.dense_vectors(embed.hashed_components(asked, "q", "wq"), "q")
    return dense.dense_topk_exact(q_vectors, store.vectors(passages, version))


@query
def route_queries(spark, d):
    pages = T.table(spark, d, "pages").select("page_id", F.col("url").alias("query"))
    keyword, natural = branches.route_queries(pages)
    one, two = keyword.withColumn("branch", F.lit(1)), natural.withColumn("branch", F.lit(2))
    return one.unionByName(two).select("page_id", "branch")


@query
def custom_node(spark, d):
    """The same routing as a user's batch function."""
    pages = T.table(spark, d, "pages").select("page_id", F.col("url").alias("query"))

    def run_batch(frames):
        for frame in frames:
            yield frame[["page_id"]].assign(branch=frame["query"].str.contains("?", regex=False).astype("int32") + 1)

    return generate.apply_model(pages, run_batch, "page_id bigint, branch int")


def _two_branches(spark, d):
    queries, units = T.items(spark, d), T.document_units(spark, d)
    return sparse.bm25_topk(queries, units), _tfidf_store(spark, d).topk(queries)


@query
def merge_by_score(spark, d):
    return branches.merge_by_score(list(_two_branches(spark, d)))


@query
def merge_by_rank(spark, d):
    return branches.merge_by_rank(list(_two_branches(spark, d)), k=5)


@query
def join_answers(spark, d):
    """Extracted answers with scores beside shown passages without."""
    retrieved = _retrieved(spark, d)
    extracted = _read(spark, d, retrieved).select("q", "answer", "score", "rank")
    shown = retrieved.select(
        "q", clean.preview(F.col("content")).alias("answer"), F.lit(None).cast("double").alias("score"), "rank"
    )
    by_score = branches.join_answers([extracted, shown]).withColumn("sorted", F.lit(True))
    in_order = branches.join_answers([extracted, shown], sort_by_score=False).withColumn("sorted", F.lit(False))
    return by_score.unionByName(in_order)


@query
def filter_query(spark, d):
    """Everything retrieved for the alphabetically first query."""
    first = T.items(spark, d).agg(F.min("query")).scalar()
    return _retrieved(spark, d).where(F.col("query") == first).select("q", "rank", "uid", "score")


@query
def head(spark, d):
    return branches.head(_retrieved(spark, d).select("q", "rank", "uid", "score"))


@query
def pipeline_classifier(spark, d):
    """Keyword queries go to BM25 and questions to TF-IDF retrieval; one reader takes what both return."""
    items = T.items(spark, d)
    as_passages = items.select(F.col("q").alias("doc_id"), F.lit(0).alias("split_id"), X.sentences(F.col("query")).alias("sentences"))
    asked = generate.generate_questions(as_passages, T.documents(spark, d))
    queries = items.select(F.col("q").cast("string").alias("q"), "query").unionByName(
        asked.select(F.concat_ws("-", "doc_id", "sent").alias("q"), F.col("question").alias("query"))
    )
    units = T.passage_units(spark, d)
    p = Pipeline().add_input("Query", stage(queries, "queries"))
    p.add_branches("QueryClassifier", branches.route_queries, "Query")
    p.add_node("SparseRetriever", lambda x: sparse.bm25_topk(x, units), ["QueryClassifier.output_1"])
    p.add_node("CosineRetriever", lambda x: sparse.tfidf_topk(x, units), ["QueryClassifier.output_2"])
    p.add_node("Merge", lambda a, b: branches.merge_by_score([a, b]), ["SparseRetriever", "CosineRetriever"])
    p.add_node(
        "Reader",
        lambda hits, x: read.extract_answers(hits.join(units, "uid"), read.query_idf(x, T.documents(spark, d)), 1),
        ["Merge", "Query"],
    )
    return p["Reader"].select("q", "uid", "answer", "score")


# --- sources and sinks ------------------------------------------------------------------------------


@query
def corpus_load(spark, d):
    docs = T.documents(spark, d)
    return docs.select(
        split.chunk_id(F.col("text"), F.lit(0)).alias("id"), "doc_id", F.col("text").alias("content"),
        F.lit("text").alias("content_type"), F.col("source").alias("name"),
        F.create_map(F.lit("lang"), "lang")["lang"].alias("meta_lang"),
    )


@query
def gold_labels(spark, d):
    return T.document_labels(spark, d).select("q", "uid", "is_correct_document", "origin")


def _squad(spark, d):
    path = staged_path(spark, "squad")
    squad.write_squad(T.squad_pairs(spark, d), path)
    return squad.read_squad(spark, path)


@query
def squad_roundtrip(spark, d):
    return _squad(spark, d).select("title", "context", "id", "question", "is_impossible", "answer", "answer_start")


@query
def squad_passages(spark, d):
    return squad.squad_passages(_squad(spark, d), 50).drop("raw", "raw_start")


@query
def squad_labels(spark, d):
    rows = _squad(spark, d)
    return squad.squad_labels(rows, squad.squad_passages(rows, 50))


def _squad_gold(spark, d):
    """(labels, passages) of the written file: contexts cut to 50 words, answers placed in them."""
    path = staged_path(spark, "squad")
    squad.write_squad(T.squad_pairs(spark, d), path)
    rows = squad.paragraphs(spark, path)
    cut = stage(squad.squad_passages(rows, 50), "squad-passages")
    units = cut.select(F.concat_ws("-", "context_id", "split_id").alias("uid"), "content")
    return stage(squad.evaluation_labels(squad.answers(rows), cut), "squad-gold"), units


def _squad_idf(queries, units):
    return read.query_idf(queries, units.select(F.col("uid").alias("doc_id"), F.col("content").alias("text")))


@query
def squad_eval(spark, d):
    """A SQuAD file end to end: passages and labels from it, its questions asked, both nodes scored."""
    gold, units = _squad_gold(spark, d)
    queries = gold.select("q", "query").distinct()
    hits = stage(sparse.bm25_topk(queries, units), "hits")
    retrieved = stage(hits.join(units, "uid").join(queries, "q"), "retrieved")
    answers = stage(read.extract_answers(retrieved, _squad_idf(queries, units)), "read")
    node = lambda name, rows: rows.select(F.lit(name).alias("node"), "metric", "value")
    retriever = _retriever_metrics(hits.select("q", "uid", "rank"), retrieved, gold)
    return node("Retriever", retriever).unionByName(node("Reader", _reader_metrics(answers, gold)))


@query
def squad_reader_eval(spark, d):
    """The reader alone on a SQuAD file: it reads the passage of each label; questions without one have no answer."""
    gold, units = _squad_gold(spark, d)
    queries = gold.select("q", "query").distinct()
    given = stage(gold.select("q", "query", "uid").distinct().join(units, "uid"), "given")
    spans = read.candidate_spans(given, _squad_idf(queries, units))
    answers = stage(read.with_no_answer(spans, queries.select("q"), NO_ANSWER_SCORE, 0.5), "read")
    return reader_metrics.reader_eval(_scored_predictions(answers, gold), gold)


@query
def question_list(spark, d):
    path = staged_path(spark, "questions")
    asked = T.dialogue_pairs(spark, d).select(F.array_join(X.words(F.col("question")), " ").alias("value"))
    header = spark.range(1).select(F.lit("\ufeffquestion\r").alias("value"))
    results.export(asked.unionByName(header), path, "txt")
    return results.read_questions(spark, path)


def _log(spark, d):
    path = staged_path(spark, "log")
    results.export(runlog.render_log(T.log_blocks(spark, d)), path, "txt")
    return path


@query
def qa_log_parse(spark, d):
    pairs = runlog.parse_pairs(runlog.read_blocks(spark, _log(spark, d)))
    return pairs.select("doc", "pos", "question", F.array_join("answers", "|").alias("answers"), F.size("answers").alias("n"))


@query
def count_pairs(spark, d):
    return runlog.count_pairs(spark.read.text(_log(spark, d)))


@query
def log_throughput(spark, d):
    figures = runlog.throughput(runlog.read_blocks(spark, _log(spark, d)))
    return figures.select("doc", R.round6(F.col("seconds_per_item")).alias("seconds_per_item"), "batches_per_second")


@query
def log_throughput_summary(spark, d):
    figures = runlog.throughput(runlog.read_blocks(spark, _log(spark, d)))
    b = F.col("batches_per_second")
    return figures.agg(
        F.count("*").alias("blocks"), F.min(b).alias("slowest"), R.round6(F.avg(b)).alias("mean"), F.max(b).alias("fastest"),
        R.round6(F.sum("seconds_per_item")).alias("total_seconds"),
    )


@query
def pair_quality(spark, d):
    return runlog.pair_quality(runlog.parse_pairs(runlog.read_blocks(spark, _log(spark, d))))


@query
def index_write(spark, d):
    path = staged_path(spark, "docs")
    index.write_index(T.passages(spark, d).select(F.col("uid").alias("id"), "content"), path)
    return index.scan(spark, path)


@query
def index_upsert(spark, d):
    """Passages of 200 words, overwritten where English by their first 100 characters, read back as written."""
    rows = T.passages(spark, d)
    docs = changes.WrittenIndex.create(rows.select(F.col("uid").alias("id"), "content"), staged_path(spark, "docs"), "id")
    docs.upsert(rows.where(F.col("lang") == "en").select(F.col("uid").alias("id"), clean.preview(F.col("content")).alias("content")))
    return docs.read()


@query
def index_delete(spark, d):
    """One index without its German documents, one cleared; both read back as written, the first also compacted."""
    rows = T.documents(spark, d).select("doc_id", "lang")
    docs, cleared = (changes.WrittenIndex.create(rows, staged_path(spark, "docs"), "doc_id") for _ in range(2))
    docs.delete(F.col("lang") == "de")
    docs.compact()
    cleared.clear()
    return docs.read().unionByName(cleared.read())


@query
def index_scan(spark, d):
    path = staged_path(spark, "embeddings")
    index.write_index(T.table(spark, d, "embeddings"), path)
    return index.scan(spark, path, ("embedding",))


@query
def index_first(spark, d):
    rows = T.passages(spark, d).select(F.col("uid").alias("id"), "content")
    return index.first_document(rows).withColumn("n", rows.agg(F.count("*")).scalar())


@query
def export_csv(spark, d):
    path = staged_path(spark, "export")
    results.export(T.dialogue_pairs(spark, d), path, "csv")
    return results.read_csv(spark, path, "conv_id bigint, turn bigint, question string, reply string")


@query
def export_json(spark, d):
    path = staged_path(spark, "export")
    rows = T.dialogue_pairs(spark, d)
    results.export(rows, path, "json")
    return spark.read.schema(rows.schema).json(path)


@query
def eval_save_load(spark, d):
    path = staged_path(spark, "eval")
    rel = retriever_metrics.mark_relevant(_retrieved(spark, d), _labels(spark, d))
    results.save_eval({"Retriever": rel}, path)
    saved = results.load_eval(spark, path, ["Retriever"])["Retriever"]
    return retriever_metrics.mean_scores(
        retriever_metrics.query_scores(saved), ["recall_single_hit", "mrr", "precision", "map"]
    )


@query
def eval_rescored(spark, d):
    """Both nodes saved as CSV, loaded and scored under other scopes; nothing is predicted again."""
    path, retrieved = staged_path(spark, "eval"), _retrieved(spark, d)
    saved = {
        "Retriever": ("q bigint, rank int, uid string, content string", retrieved),
        "Reader": ("q bigint, rank int, uid string, answer string, score double", _read(spark, d, retrieved)),
    }
    names = {node: [c.split()[0] for c in schema.split(", ")] for node, (schema, _) in saved.items()}
    results.save_eval({node: rows.select(*names[node]) for node, (_, rows) in saved.items()}, path, "csv")
    nodes = results.load_eval(spark, path, list(saved), {node: schema for node, (schema, _) in saved.items()})
    gold = _gold(spark, d)
    pairs = scopes.scoped_pairs(nodes["Retriever"].withColumn("doc_key", F.col("uid")), gold.withColumn("gold_key", F.col("uid")))
    wanted = F.col("document_scope").isin("document_id", "context") & (F.col("answer_scope") == "any")
    retriever = _scope_metrics(scopes.scoped_relevance(pairs).where(wanted))
    reader = _reader_metrics(nodes["Reader"], gold)
    return retriever.select(F.lit("Retriever").alias("node"), F.col("document_scope").alias("scope"), "metric", "value").unionByName(
        reader.select(F.lit("Reader").alias("node"), F.lit("any").alias("scope"), "metric", "value")
    )


# --- tabular analytics and streams ------------------------------------------------------------------


@query
def read_limited(spark, d):
    return tabular.first_rows(T.table(spark, d, "events").select("event_id", "ts", "value"), "event_id", 10_000)


@query
def read_limited_csv(spark, d):
    """At most 5000 rows of the events as CSV: how many came, and how many of them are events."""
    path, events = staged_path(spark, "events"), T.table(spark, d, "events").select("event_id", "value")
    results.export(events, path, "csv")
    rows = tabular.read_limited(spark, path, 5000, "event_id bigint, value double")
    known = stage(rows, "limited").join(events.withColumnRenamed("value", "known"), "event_id", "left")
    agrees = F.when(F.col("known").eqNullSafe(F.col("value")), 1)
    return known.agg(F.count("*").alias("n_rows"), F.count(agrees).alias("n_known"))


@query
def lowercase_columns(spark, d):
    events = T.table(spark, d, "events").select(F.col("event_id").alias("Event_ID"), F.col("value").alias("VALUE"))
    return tabular.lowercase_columns(events)


@query
def parse_timestamp(spark, d):
    """Times rendered as text, some of them followed by a word, and read back."""
    events = T.table(spark, d, "events")
    text = F.when(F.col("event_type") == "error", F.concat("event_type", F.lit(" "), F.col("ts").cast("string"))).otherwise(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    )
    parsed = tabular.parse_timestamp(text, "yyyy-MM-dd HH:mm:ss")
    return events.select("event_id", F.date_format(parsed, "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query
def hour_histogram(spark, d):
    return tabular.hour_histogram(T.table(spark, d, "events"), "ts")


@query
def filter_hour(spark, d):
    return tabular.filter_hour(T.table(spark, d, "events"), "ts", 17).select("event_id", "event_type")


@query
def upload_pairs(spark, d):
    """The corpus arriving as files, turned into question/answer pairs batch by batch, with the statistics of one snapshot."""
    snapshots = upload.StatisticsStore(spark, staged_path(spark, "statistics"))
    statistics = snapshots.statistics(snapshots.take(T.documents(spark, d).select("doc_id", "text")))
    out = staged_path(spark, "pairs")
    upload.pairs_per_batch(
        upload.uploaded_tables(spark, f"{d}/documents.parquet", T.SCHEMAS["documents"]),
        lambda rows: generate.generate_pairs(
            split.split_sentences(rows.select("doc_id", "text"), 100, keep_sentences=True), statistics
        ),
        out,
        staged_path(spark, "pairs-checkpoint"),
    )
    return upload.read_batches(spark, out)


@query
def upload_stream(spark, d):
    """The corpus arriving as files, split into sentence groups on the way to an index."""
    stream = upload.uploaded_tables(spark, f"{d}/documents.parquet", T.SCHEMAS["documents"])
    return upload.process_available(
        stream,
        lambda s: split.split_sentences(s.select("doc_id", "text"), 100),
        staged_path(spark, "stream"),
        staged_path(spark, "stream-checkpoint"),
    )
