"""SQuAD files: reading into passages and labels, writing training sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from answerloom.functions.skew import salted_join
from answerloom.functions.text import each, let, words

SCHEMA = """
  version string,
  data array<struct<title: string, paragraphs: array<struct<
    context: string, document_id: bigint,
    qas: array<struct<id: string, question: string, is_impossible: boolean,
      answers: array<struct<text: string, answer_start: int>>>>>>>>
"""

# Questions written under one paragraph; a context with more gets further paragraphs.
QUESTIONS_PER_PARAGRAPH = 1000

# Characters of a context that are one key of the join of answers with passages.
BIN = 1024


def read_squad(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """(title, document_id, context, id, question, is_impossible, answer, answer_start), one row per answer.

    A question without answer has one row with a null answer, a paragraph without questions one with a null id: its
    context belongs to the corpus that is searched.

    ``multi_line`` reads files that hold one indented JSON object; files with one object per line need
    none and are splittable.
    """
    raw = spark.read.schema(SCHEMA).option("multiLine", multi_line).json(path)
    paragraphs = raw.select(F.explode("data").alias("d")).select("d.title", F.explode("d.paragraphs").alias("p"))
    questions = paragraphs.select("title", "p.document_id", "p.context", F.explode_outer("p.qas").alias("q"))
    return questions.select(
        "title", "document_id", "context", "q.id", "q.question", "q.is_impossible", F.explode_outer("q.answers").alias("a")
    ).select(
        "title", "document_id", "context", "id", "question",
        F.coalesce("is_impossible", F.lit(False)).alias("is_impossible"),
        F.col("a.text").alias("answer"), F.col("a.answer_start").alias("answer_start"),
    )


def paragraphs(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """(title, document_id, context_id, context, qas), one row per paragraph: a context is read and hashed once, however many
    questions are asked on it."""
    raw = spark.read.schema(SCHEMA).option("multiLine", multi_line).json(path)
    rows = raw.select(F.explode("data").alias("d")).select("d.title", F.explode("d.paragraphs").alias("p"))
    return rows.select("title", "p.document_id", F.md5(F.col("p.context").cast("binary")).alias("context_id"), "p.context", "p.qas")


def answers(rows: DataFrame) -> DataFrame:
    """(context_id, id, question, answer, answer_start) of ``paragraphs``; a null answer where there is none. Contexts do
    not travel with the answers."""
    asked = rows.select("context_id", F.explode("qas").alias("q"))
    flat = asked.select("context_id", "q.id", "q.question", F.explode_outer("q.answers").alias("a"))
    return flat.select("context_id", "id", "question", F.col("a.text").alias("answer"), F.col("a.answer_start").alias("answer_start"))


def squad_passages(squad: DataFrame, length: int = 200) -> DataFrame:
    """(context_id, title, split_id, content, first_char, raw, raw_start): the docs index, contexts cut by words.

    ``first_char`` is where a passage starts in its context once runs of white space count as one space; ``raw`` is the passage
    as it stands in the context, from character ``raw_start`` on, with the white space behind it.
    """
    key = F.col("context_id") if "context_id" in squad.columns else F.md5(F.col("context").cast("binary"))
    contexts = squad.groupBy(key.alias("context_id")).agg(F.min("title").alias("title"), F.first("context").alias("text"))
    body = F.regexp_replace("text", r"^\s+", "")
    # A word with the white space behind it is one token, so tokens add up to the text.
    pieces = let(
        F.filter(F.split(body, r"(?<=\s)(?=\S)"), lambda t: t != ""),
        lambda ts: F.transform(
            F.sequence(F.lit(0), F.greatest(F.ceil(F.size(ts) / length), F.lit(1)) - 1),
            lambda p: F.array_join(F.slice(ts, (p * length + 1).cast("int"), F.lit(length)), ""),
        ),
    )
    cut = each(
        contexts.withColumn("lead", F.length("text") - F.length(body)), ["context_id", "title", "lead"], pieces, "raw", "split_id"
    ).where(F.col("raw") != "")
    cut = cut.withColumn("content", F.array_join(words(F.col("raw")), " "))
    earlier = Window.partitionBy("context_id").orderBy("split_id").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda size: F.coalesce(F.sum(size).over(earlier), F.lit(0)).cast("int")
    return cut.select(
        "context_id", "title", "split_id", "content", before(F.length("content") + 1).alias("first_char"), "raw",
        (F.col("lead") + before(F.length("raw"))).alias("raw_start"),
    )


def spaced_offset(context: Column, start: Column) -> Column:
    """Offset of a character once runs of white space in the context count as one space."""
    before = F.substring(context, F.lit(1), start)
    return let(
        F.array_join(words(before), " "),
        lambda p: F.length(p) + F.when(before.rlike(r"\s$") & (p != ""), 1).otherwise(0),
    )


def place_answers(answers: DataFrame, passages: DataFrame) -> DataFrame:
    """(context_id, id, question, answer, split_id, start): the passage that holds an answer as a whole, and where.

    An interval join: passages are listed under the stretches of ``BIN`` characters that they touch, an answer under the one it
    starts in. So an answer meets the few passages around it, and a context with very many of both takes time in
    proportion. An answer cut by a passage border gets no passage and no offset.
    """
    text = F.array_join(words(F.col("answer")), " ")
    at = F.col("answer_start") + F.length("answer") - F.length(F.regexp_replace("answer", r"^\s+", ""))
    found = answers.where(F.col("answer").isNotNull()).select(
        "context_id", "id", "question", text.alias("answer"), at.cast("int").alias("at")
    ).distinct()
    found = found.withColumn("bin", F.floor(F.col("at") / BIN).cast("int"))
    last = F.col("raw_start") + F.length("raw") - 1
    listed = passages.select(
        "context_id", "split_id", "raw", "raw_start",
        F.explode(F.sequence(F.floor(F.col("raw_start") / BIN).cast("int"), F.floor(last / BIN).cast("int"))).alias("bin"),
    )
    met = salted_join(found, listed, ["context_id", "bin"], ["id", "at"], how="left")
    here = F.col("at") - F.col("raw_start")
    start = spaced_offset(F.col("raw"), here)
    inside = (here >= 0) & (here < F.length("raw")) & (start + F.length("answer") <= F.length(F.array_join(words(F.col("raw")), " ")))
    hit = F.min(F.when(inside, F.struct("split_id", start.alias("start"))))
    keys = ["context_id", "id", "question", "answer"]
    return met.groupBy(*keys, "at").agg(hit.alias("h")).select(*keys, "h.split_id", "h.start")


def squad_labels(squad: DataFrame, passages: DataFrame) -> DataFrame:
    """(id, question, answer, context_id, split_id, start): answers with offsets in their passage."""
    if "context_id" not in squad.columns:
        squad = squad.withColumn("context_id", F.md5(F.col("context").cast("binary")))
    placed = place_answers(squad.where("id is not null"), passages)
    return placed.select("id", "question", "answer", "context_id", "split_id", "start")


def evaluation_labels(squad: DataFrame, passages: DataFrame) -> DataFrame:
    """(q, query, answer, uid, start): labels as retrieval and reading are scored by them, over passages named
    ``context_id-split_id``. A question without answer has one label with the answer "" and no passage; an answer
    that a passage border cuts has no passage."""
    placed = squad_labels(squad, passages).select(
        F.col("id").alias("q"), F.col("question").alias("query"), "answer",
        F.when(F.col("split_id").isNotNull(), F.concat_ws("-", "context_id", "split_id")).alias("uid"), "start",
    )
    answered = F.max(F.col("answer").isNotNull())
    none = squad.where("id is not null").groupBy("id", "question").agg(answered.alias("some")).where(~F.col("some"))
    return placed.unionByName(
        none.select(
            F.col("id").alias("q"), F.col("question").alias("query"), F.lit("").alias("answer"),
            F.lit(None).cast("string").alias("uid"), F.lit(None).cast("int").alias("start"),
        )
    )


def squad_records(pairs: DataFrame) -> DataFrame:
    """Nested records from (title, context, id, question, answer, answer_start); a null answer is impossible.

    One record per context, each a complete SQuAD object. Answers of one question lie in one context, so that
    list is bounded by its length; a context with very many questions is cut into paragraphs by a hash of
    the question.
    """
    answer = F.when(
        F.col("answer").isNotNull(), F.struct(F.col("answer").alias("text"), F.col("answer_start").cast("int").alias("answer_start"))
    )
    keyed = pairs.withColumn("context_id", F.md5(F.col("context").cast("binary")))
    questions = keyed.groupBy("title", "context_id", "id", "question").agg(
        F.first("context").alias("context"), F.sort_array(F.collect_set(answer)).alias("answers")
    )
    crowded = (
        questions.groupBy("title", "context_id").agg(F.count("*").alias("n"))
        .where(F.col("n") > QUESTIONS_PER_PARAGRAPH)
        .select("title", "context_id", F.ceil(F.col("n") / QUESTIONS_PER_PARAGRAPH).alias("parts"))
    )
    parted = salted_join(questions, crowded, ["title", "context_id"], ["id"], how="left").withColumn(
        "part", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1)))
    )
    qa = F.when(
        F.col("id").isNotNull(), F.struct("id", "question", (F.size("answers") == 0).alias("is_impossible"), "answers")
    )
    paragraphs = parted.groupBy("title", "context_id", "part").agg(
        F.first("context").alias("context"), F.sort_array(F.collect_list(qa)).alias("qas")
    )
    return paragraphs.select(
        F.lit("v2.0").alias("version"),
        F.array(F.struct("title", F.array(F.struct("context", "qas")).alias("paragraphs"))).alias("data"),
    )


def write_squad(pairs: DataFrame, path: str) -> None:
    squad_records(pairs).write.mode("overwrite").json(path)
