"""Question generation and question/answer pairs per passage.

The defaults are column expressions; a model plugs in as a batch function (see ``apply_model``).

Passages are (doc_id, split_id, sentences): groups of whole sentences. A sentence of more than 60 words is cut into
windows of 60, each of which counts as a sentence, so no text goes unasked and no question is longer. A sentence of three
words or more gives one question: its rarest word of four or more characters becomes "what". The answer to a question
is the sentence of its passage that shares the most informative terms with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.functions.ranking import ln_ratio
from answerloom.functions.skew import fits_broadcast, lookup_document_frequency
from answerloom.functions.text import BREAK, aligned_terms, bare_word, each, let, word_terms, words
from answerloom.session import stage

# Which sentences give a question, how long one may be, and which words may be asked for.
MIN_WORDS = 3
WINDOW_WORDS = 60
MIN_TERM_CHARS = 4

PASSAGE = ["doc_id", "split_id"]


def asks(n_words: Column) -> Column:
    return n_words >= MIN_WORDS


# (t, df) of word terms, and the number of documents.
Statistics = tuple[DataFrame, int]


def bounded_sentences(passages: DataFrame) -> DataFrame:
    """Passages whose sentences have at most ``WINDOW_WORDS`` words; longer ones become windows.

    A window keeps its white space but for the last character behind it, for which the single space between
    sentences stands, so offsets stay those of the passage.
    """
    mark = rf"((?:\S+\s+){{{WINDOW_WORDS - 1}}}\S+\s*)\s"
    cut = F.transform(
        "sentences",
        lambda s: F.when(F.size(words(s)) <= WINDOW_WORDS, F.array(s)).otherwise(
            F.filter(F.split(F.regexp_replace(s, mark, "$1" + BREAK), BREAK), lambda x: F.trim(x) != "")
        ),
    )
    return passages.withColumn("sentences", F.flatten(cut))


def word_document_frequency(documents: DataFrame, text: str = "text", of: DataFrame | None = None) -> DataFrame:
    """(t, df) over the word terms of documents; distinct per document before the shuffle. Of the few terms ``of``, if given:
    others are dropped where they are read."""
    listed = each(documents, [], F.array_distinct(word_terms(F.col(text))), "t")
    if of is not None:
        listed = listed.join(F.broadcast(of), "t", "left_semi")
    return listed.groupBy("t").agg(F.count("*").alias("df"))


def asking_terms(passages: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, t): the distinct terms per passage of the sentences that give questions."""
    asking = F.filter("sentences", lambda s: asks(F.size(words(s))))
    return each(passages, keep, F.array_distinct(word_terms(F.array_join(asking, " "))), "t")


def passage_frequencies(passages: DataFrame, frequencies: DataFrame, n_docs: int) -> DataFrame:
    """(doc_id, split_id, stats): (t, df, idf) of the terms in the sentences of a passage that give questions.

    Only these terms are looked up: a passage holds few of them, whatever the length of its other sentences.
    """
    postings = asking_terms(passages, PASSAGE)
    known = lookup_document_frequency(postings, frequencies, n_docs)
    return known.withColumn("idf", ln_ratio(F.lit(n_docs + 1), F.col("df") + 1)).groupBy(*PASSAGE).agg(
        F.collect_list(F.struct("t", "df", "idf")).alias("stats")
    )


def statistics_of(documents: DataFrame) -> Statistics:
    return word_document_frequency(documents), documents.count()


def statistics_for(passages: DataFrame, documents: DataFrame) -> Statistics:
    """As ``statistics_of``, of no more terms than the passages ask for if these are few."""
    asked = stage(asking_terms(bounded_sentences(passages), []).distinct(), "asking-terms")
    return word_document_frequency(documents, of=asked if fits_broadcast(asked) else None), documents.count()


def with_frequencies(passages: DataFrame, documents: DataFrame | Statistics) -> DataFrame:
    """Passages with the document frequencies their questions need, of ``documents`` or of a corpus whose statistics are
    given. Passages without questions drop out."""
    passages = bounded_sentences(passages)
    frequencies, n_docs = documents if isinstance(documents, tuple) else statistics_of(documents)
    stats = passage_frequencies(passages, frequencies, n_docs)
    return passages.join(stats, PASSAGE)


def prepare(sentences: Column, stats: Column) -> Column:
    """Per sentence (n, words, ids): the number, the words and, for each word, the place of its term in ``stats``.

    0 stands for terms that no question of the passage uses. From here on terms are small numbers.
    """
    return let(
        stats["t"],
        lambda keys: F.transform(
            sentences,
            lambda s: let(
                words(s),
                lambda w: F.struct(
                    F.size(w).alias("n"),
                    w.alias("words"),
                    F.transform(aligned_terms(w), lambda t: F.array_position(keys, t).cast("int")).alias("ids"),
                ),
            ),
        ),
    )


def cloze(sentence: Column, stats: Column) -> Column:
    """Struct (answer, question, ids) of a prepared sentence; null where no word may be asked for."""
    picks = F.transform(
        sentence["ids"],
        lambda t, i: F.when(
            t > 0,
            F.when(
                F.length(F.element_at(stats, t)["t"]) >= MIN_TERM_CHARS,
                F.struct(F.element_at(stats, t)["df"].alias("df"), i.alias("pos")),
            ),
        ),
    )

    def build(pick: Column) -> Column:
        kept = F.transform(sentence["words"], lambda w, i: F.when(i == pick["pos"], "what").otherwise(w))
        others = F.filter(sentence["ids"], lambda t, i: (i != pick["pos"]) & (t > 0))
        return F.when(
            pick.isNotNull(),
            F.struct(
                bare_word(F.element_at(sentence["words"], pick["pos"] + 1)).alias("answer"),
                F.concat(F.regexp_replace(F.array_join(kept, " "), r"[.!?]+$", ""), F.lit("?")).alias("question"),
                F.array_distinct(others).alias("ids"),
            ),
        )

    return let(F.array_min(F.filter(picks, lambda p: p.isNotNull())), build)


def questions_of(prepared: Column, stats: Column) -> Column:
    """Array of (sent, answer, question, ids), one per sentence that gives a question."""

    def of_sentence(s: Column, i: Column) -> Column:
        def placed(c: Column) -> Column:
            fields = [c[name].alias(name) for name in ("answer", "question", "ids")]
            return F.when(c.isNotNull(), F.struct(i.alias("sent"), *fields))

        return F.when(asks(s["n"]), let(cloze(s, stats), placed))

    return F.filter(F.transform(prepared, of_sentence), lambda q: q.isNotNull())


def generate_questions(passages: DataFrame, documents: DataFrame | Statistics) -> DataFrame:
    """(doc_id, split_id, sent, question, answer)."""
    ready = with_frequencies(passages, documents)
    asked = let(prepare(F.col("sentences"), F.col("stats")), lambda p: questions_of(p, F.col("stats")))
    return each(ready, PASSAGE, asked, "x").select(*PASSAGE, "x.sent", "x.question", "x.answer")


def best_sentence(ids: Column, prepared: Column, stats: Column) -> Column:
    """(score, back): the sentence sharing the most informative terms; score in millionths, first wins ties."""
    scored = F.transform(
        prepared,
        lambda s, j: F.struct(
            F.floor(
                F.aggregate(
                    F.array_intersect(ids, s["ids"]), F.lit(0.0), lambda a, t: a + F.element_at(stats, t)["idf"]
                )
                / F.sqrt(s["n"].cast("double"))
                * 1e6
                + 0.5
            ).alias("score"),
            (-j).alias("back"),
        ),
    )
    return F.array_max(scored)


def generate_pairs(passages: DataFrame, documents: DataFrame | Statistics) -> DataFrame:
    """(doc_id, split_id, sent, question, cloze_answer, answer, answer_sent, answer_start, score).

    Everything after the frequency lookup happens inside the row of a passage.
    """
    ready = with_frequencies(passages, documents)
    answered = let(
        prepare(F.col("sentences"), F.col("stats")),
        lambda p: F.transform(
            questions_of(p, F.col("stats")),
            lambda q: F.struct(
                q["sent"].alias("sent"),
                q["question"].alias("question"),
                q["answer"].alias("cloze_answer"),
                best_sentence(q["ids"], p, F.col("stats")).alias("best"),
            ),
        ),
    )
    pairs = each(ready, [*PASSAGE, "sentences"], answered, "x")
    before = F.slice("sentences", 1, F.col("answer_sent"))
    return (
        pairs.select(
            *PASSAGE,
            "sentences",
            "x.sent",
            "x.question",
            "x.cloze_answer",
            (-F.col("x.best.back")).alias("answer_sent"),
            (F.col("x.best.score") / F.lit(1e6)).alias("score"),
        )
        .withColumn("answer", F.element_at("sentences", F.col("answer_sent") + 1))
        .withColumn(
            "answer_start",
            F.aggregate(before, F.lit(0), lambda a, s: a + F.length(s) + 1),
        )
        .drop("sentences")
    )


def apply_model(df: DataFrame, fn, schema: str) -> DataFrame:
    """Run a user's batch function (iterator of pandas frames to iterator of pandas frames) over a table.

    Put filters and projections before it: nothing is pushed through.
    """
    return df.mapInPandas(fn, schema)
