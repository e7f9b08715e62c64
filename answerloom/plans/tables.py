"""The given tables in the roles the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerloom.functions.text import sentences, words
from answerloom.operators.labels import find_verbatim, label_rows
from answerloom.operators.split import split_sentences, split_words
from answerloom.session import spread, stage


SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "benchmark": "item_id bigint, text string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "pages": "page_id bigint, url string, html string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


def items(spark: SparkSession, sf_dir: str, squeeze: bool = True) -> DataFrame:
    """Benchmark passages as (q, query, answer): the whole text asks for itself.

    Passages are cut by words and joined with single spaces, so the text is spaced the same way;
    ``squeeze=False`` keeps it as it is, to be compared with whole documents.
    """
    b = table(spark, sf_dir, "benchmark")
    text = F.array_join(words(F.col("text")), " ") if squeeze else F.col("text")
    return b.select(F.col("item_id").alias("q"), text.alias("query"), text.alias("answer"))


def document_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(F.col("doc_id").alias("uid"), F.col("text").alias("content"))


def passages(spark: SparkSession, sf_dir: str, length: int = 200) -> DataFrame:
    """(doc_id, lang, source, split_id, content, uid): windows of words."""
    cut = split_words(documents(spark, sf_dir), length)
    return cut.withColumn("uid", F.concat_ws("-", "doc_id", "split_id"))


def passage_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(spark, sf_dir).select("uid", "content")


def chunks(spark: SparkSession, sf_dir: str, length: int = 100) -> DataFrame:
    """(doc_id, split_id, sentences): groups of whole sentences."""
    return split_sentences(documents(spark, sf_dir).select("doc_id", "text"), length, keep_sentences=True)


def passage_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    its = items(spark, sf_dir)
    return label_rows(its, find_verbatim(its.select("q", "answer"), passage_units(spark, sf_dir)))


def dialogue_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, question, reply): each user turn with the assistant turn right after it."""
    c = table(spark, sf_dir, "conversations")
    asked = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    replies = c.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply")
    )
    return asked.join(replies, ["conv_id", "turn"])


def document_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    its = items(spark, sf_dir, squeeze=False)
    return label_rows(its, find_verbatim(its.select("q", "answer"), document_units(spark, sf_dir)))


def gold_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with the fields scopes compare: (q, query, answer, uid, source, gold_context).

    The labels are stored first: their size is then known, and if small they travel to the passages.
    """
    labels = stage(passage_labels(spark, sf_dir), "labels")
    cut = passages(spark, sf_dir).select("uid", "source", F.col("content").alias("gold_context"))
    return labels.join(cut.join(labels.select("uid").distinct(), "uid", "left_semi"), "uid", "left")


def squad_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialogue pairs as SQuAD rows: the reply is the context, its longest sentence the answer.

    Replies of at most three words have no answer.
    """
    longest = F.array_max(
        F.transform(sentences(F.col("reply")), lambda s, i: F.struct(F.length(s).alias("n"), (-i).alias("back"), s.alias("s")))
    )["s"]
    return dialogue_pairs(spark, sf_dir).select(
        F.concat(F.lit("conv-"), "conv_id").alias("title"),
        F.col("reply").alias("context"),
        F.concat_ws("-", "conv_id", "turn").alias("id"),
        "question",
        F.when(F.size(words(F.col("reply"))) > 3, longest).alias("answer"),
    ).withColumn("answer_start", F.instr(F.col("context"), F.col("answer")) - 1)


def log_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialogue pairs as blocks of a run log, with progress figures taken from the text lengths.

    Long replies give two answers, their first sentence and the whole; replies of one sentence give one, and
    replies shorter than the question none.
    """
    reply = F.col("reply")
    answers = (
        F.when(F.length(reply) < F.length("question"), F.array().cast("array<string>"))
        .when(F.size(sentences(reply)) > 1, F.array(F.trim(sentences(reply)[0]), reply))
        .otherwise(F.array(reply))
    )
    return dialogue_pairs(spark, sf_dir).select(
        (F.col("conv_id") * 1_000_000 + F.col("turn")).alias("doc"),
        reply.alias("content"),
        F.array(F.struct("question", answers.alias("answers"))).alias("pairs"),
        (F.length(reply) + 1).alias("rate"),
        F.when(F.length("question") * 4 > F.length(reply), "it/s").otherwise("s/it").alias("unit"),
        (F.length("question") * 10).alias("batches"),
    )
