"""The printed log of a generation run: rendering, parsing and figures read from it.

A block is

     * Generating questions and answers for document <n>: <preview>...
    <progress lines>
    Generated pairs:
     - Q: <question>
          A: <answer>
    ---

Texts may span lines and hold blank lines; only the markers at the start of a line delimit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answerloom.functions.skew import salted_join

# The markers of the format.
BLOCK = "\n * Generating questions and answers for document "
PAIRS = "Generated pairs:"
QUESTION = " - Q: "
ANSWER = "      A: "
END = "---"


def _hundredths(n: Column) -> Column:
    return F.concat((n / 100).cast("bigint").cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))


def render_log(blocks: DataFrame) -> DataFrame:
    """(value) from (doc, content, pairs array<struct<question, answers>>, rate, unit, batches).

    ``rate`` and ``batches`` are in hundredths; a block holds the pairs of one passage.
    """
    answers = lambda p: F.array_join(F.transform(p["answers"], lambda a: F.concat(F.lit("\n" + ANSWER), a)), "")
    pairs = F.array_join(
        F.transform("pairs", lambda p: F.concat(F.lit("\n" + QUESTION), p["question"], answers(p))), ""
    )
    return blocks.select(
        F.concat(
            F.lit(BLOCK), F.col("doc").cast("string"), F.lit(": "), F.substring("content", 1, 100), F.lit("...\n\n\n"),
            F.lit("Inferencing Samples: 100%|##########| 1/1 [00:00<00:00, "), _hundredths(F.col("batches")),
            F.lit(" Batches/s]\n1it [00:01,  "), _hundredths(F.col("rate")), F.col("unit"), F.lit("]\n\n"),
            F.lit(PAIRS), pairs, F.lit("\n" + END + "\n"),
        ).alias("value")
    )


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(doc, body): one row per block. Splitting on the block marker keeps large logs splittable."""
    records = spark.read.option("lineSep", BLOCK).text(path)
    doc = F.regexp_extract("value", r"^(\d+): ", 1)
    return records.where(doc != "").select(doc.cast("bigint").alias("doc"), F.col("value").alias("body"))


def _clean(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _after_first(items: Column) -> Column:
    return F.slice(items, 2, F.size(items))


def parse_pairs(blocks: DataFrame) -> DataFrame:
    """(doc, pos, question, answers)."""
    closed = F.regexp_replace("body", r"(?s)\n---\s*$", "")
    listed = _after_first(F.split(closed, r"(?m)^ - Q: "))
    rows = blocks.select("doc", F.posexplode(listed).alias("pos", "text"))
    parts = F.split("text", r"(?m)^      A: ")
    return rows.select(
        "doc",
        "pos",
        _clean(parts[0]).alias("question"),
        F.transform(_after_first(parts), _clean).alias("answers"),
    )


def throughput(blocks: DataFrame) -> DataFrame:
    """(doc, seconds_per_item, batches_per_second) from the last progress lines of each block."""
    rate = F.regexp_extract("body", r"\d+it \[[^\]]*?([\d.]+)(?:s/it|it/s)\]", 1)
    unit = F.regexp_extract("body", r"\d+it \[[^\]]*?[\d.]+(s/it|it/s)\]", 1)
    batches = F.regexp_extract("body", r"100%[^\n]*?([\d.]+) Batches/s\]", 1)
    value = F.expr("nullif(r, '')").cast("double")
    return blocks.select("doc", rate.alias("r"), unit.alias("u"), batches.alias("b")).select(
        "doc",
        F.when((F.col("u") == "it/s") & (value > 0), 1.0 / value).when(F.col("u") == "s/it", value).alias("seconds_per_item"),
        F.expr("nullif(b, '')").cast("double").alias("batches_per_second"),
    )


def count_pairs(lines: DataFrame) -> DataFrame:
    """One row (n): tokens equal to "Q:" in a text, the count shown beside it."""
    return lines.select(
        F.size(F.filter(F.split("value", r"\s+"), lambda t: t == "Q:")).cast("bigint").alias("n")
    ).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def pair_quality(pairs: DataFrame) -> DataFrame:
    """Pairs with flags: no_question_mark, no_answer, many_answers, repeated.

    All but the first pair with the same question (case and spacing aside) are repeats; the first is found by
    a minimum that combines map-side, so a question asked very often gathers in no task.
    """
    key = F.lower(F.regexp_replace(F.trim("question"), r"\s+", " "))
    keyed = pairs.withColumn("key", F.md5(key.cast("binary")))
    place = F.struct("doc", "pos")
    firsts = keyed.groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    repeats = firsts.where(F.col("n") > 1).select("key", "first")
    return salted_join(keyed, repeats, ["key"], ["doc", "pos"], how="left").select(
        "doc",
        "pos",
        (~F.col("question").endswith("?")).alias("no_question_mark"),
        (F.size("answers") == 0).alias("no_answer"),
        (F.size("answers") > 1).alias("many_answers"),
        F.coalesce(place != F.col("first"), F.lit(False)).alias("repeated"),
    )
