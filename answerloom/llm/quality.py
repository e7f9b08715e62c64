r"""Quality rules by cross-document line frequency; DataFrame functions only.

Lines are normalised (lower case, runs of white space as one space, trimmed) and hashed. For each host the number
of distinct documents per line is counted. A line is frequent by its share of the host (over ``host_percent`` of its
documents, and at least ``min_documents`` of them, so that small hosts keep their lines) or by number alone
(``max_documents``, however large the host); either suffices. Frequent lines are taken out of the documents of that
host, and a document is rejected when too little of it is left. Words are ``[^\x20\x09-\x0D]+``; lines end at \n.

Defined cases: null and empty texts have no words and are rejected by the base rule; a null host is a host of its
own; rows with a null doc_id count as one document; equal rows count as one document and share their verdict; lines
without a word are never counted or removed; ties do not arise, as every limit is a comparison with a count.
Only the named columns are read; columns other than ``text`` come back untouched from ``filter_quality``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.functions.skew import fits_broadcast, salted_join
from answerloom.llm.texts import free_name, table
from answerloom.session import stage

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MIN_DOCUMENTS = 10
MAX_HOST_PERCENT = 10
MAX_DOCUMENTS = 1000
MIN_LEFT_PERCENT = 30
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
SALTS = 32
BROADCAST_ROWS = 200_000  # of two numbers: some 20 MB


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def _repeated(words: Column) -> Column:
    """Words inside windows whose hash occurs twice or more; O(n log n) by sorting (hash, position)."""
    n = F.size(words)

    def covered(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        starts = _let(
            placed,
            lambda s: F.array_sort(
                F.transform(
                    F.filter(
                        s,
                        lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"]))
                        | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)),
                    ),
                    lambda x: x["i"],
                )
            ),
        )
        gaps = _let(
            starts,
            lambda p: F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))),
        )
        total = F.aggregate(gaps, F.lit(0), lambda a, x: a + x)
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(total)

    window_hash = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])
    hashes = F.transform(F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))), window_hash)
    return F.when(n > WINDOW, _let(hashes, covered)).otherwise(F.lit(0))


def word_stats(docs: DataFrame) -> DataFrame:
    """Input columns and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed of ``text``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    worded = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    long = lambda c: c.cast("bigint")
    # The word list is bound once: as a column of its own it would be built again by each function that reads it.
    counted = _let(
        _words(text),
        lambda w: F.struct(
            long(F.size(w)).alias("n_words"),
            long(F.length(F.array_join(w, ""))).alias("word_chars"),
            long(_repeated(w)).alias("n_repeat_words"),
        ),
    )
    dup = _let(worded, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    kept = [c for c in docs.columns]
    made = docs.select(
        *kept,
        counted.alias("_counted"),
        long(F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).alias("n_symbols"),
        long(dup).alias("n_dup_lines"),
    )
    n_words, repeat = F.col("_counted.n_words"), F.col("_counted.n_repeat_words")
    return made.select(
        *kept,
        n_words.alias("n_words"),
        F.col("_counted.word_chars").alias("word_chars"),
        "n_symbols",
        "n_dup_lines",
        repeat.alias("n_repeat_words"),
        ((n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n_words)).alias("base_failed"),
    )


def row_hash() -> Column:
    """Hash of the row as the rules see it; equal rows have equal hashes."""
    return F.xxhash64(F.isnull("doc_id"), "doc_id", F.isnull("source"), "source", F.isnull("text"), "text")


def document_lines(docs: DataFrame) -> DataFrame:
    """(row, id, host, pos, line, words) per line with a word; ``line`` is a hash of the normalised line."""
    lower = F.lower(F.coalesce(F.col("text"), F.lit("")))
    normal = F.transform(F.split(lower, "\n"), lambda x: F.trim(F.regexp_replace(x, SPACES, " ")))
    lines = docs.select(
        row_hash().alias("row"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 62))).alias("id"),
        F.coalesce(F.xxhash64("source"), F.lit(0)).alias("host"),
        F.posexplode_outer(normal).alias("pos", "normal"),
    ).where(F.col("normal") != "")
    size = F.length("normal") - F.length(F.replace(F.col("normal"), F.lit(" "), F.lit(""))) + 1
    return lines.select("row", "id", "host", "pos", F.xxhash64("normal").alias("line"), size.alias("words"))


def frequent_lines(
    lines: DataFrame,
    min_documents: int = MIN_DOCUMENTS,
    host_percent: int = MAX_HOST_PERCENT,
    max_documents: int = MAX_DOCUMENTS,
) -> DataFrame:
    """(host, line) above a limit: in more than ``host_percent`` of the host's documents that have a line, and at least
    ``min_documents`` of them, or in ``max_documents`` of them or more.

    Counting distinct documents merges rows in each task first and shuffles by (host, line, document), so
    neither a host nor a line is hot.
    """
    per_line = lines.groupBy("host", "line").agg(F.count_distinct("id").alias("n"))
    per_host = stage(lines.groupBy("host").agg(F.count_distinct("id").alias("n_host")), "hosts")
    candidates = per_line.where(F.col("n") >= min(min_documents, max_documents))
    if fits_broadcast(per_host, BROADCAST_ROWS):
        per_host = F.broadcast(per_host)
    n = F.col("n")
    by_share = (n >= min_documents) & (100 * n > host_percent * F.col("n_host"))
    return candidates.join(per_host, "host").where(by_share | (n >= max_documents)).select("host", "line")


def frequent_hits(docs: DataFrame, **limits) -> DataFrame:
    """(row, pos, words) of every line that the limits take out; equal rows make one row."""
    # Only hashes and counts are stored, not texts; hosts, lines and the removal read them again.
    lines = stage(document_lines(docs), "document-lines")
    frequent = stage(frequent_lines(lines, **limits), "frequent-lines")
    fits = fits_broadcast(frequent, BROADCAST_ROWS)
    hit = salted_join(lines, frequent, ["host", "line"], ["row"], SALTS, fits=fits)
    return hit.groupBy("row", "pos").agg(F.first("words").alias("words"))


def _sum_words(hits: DataFrame) -> DataFrame:
    return hits.groupBy("row").agg(F.sum("words").cast("bigint").alias("removed"))


def removed_words(docs: DataFrame, **limits) -> DataFrame:
    """(row, removed) of the documents that lose words to frequent lines; equal rows make one row."""
    return _sum_words(frequent_hits(docs, **limits))


def without_lines(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """``docs`` with the lines ``hits`` (row, pos) taken out of ``text``; all columns and all rows stay."""
    name = free_name(docs, "_gone")
    gone = stage(hits.groupBy("row").agg(F.collect_set("pos").alias(name)), "gone-lines")
    numbers = gone.agg(F.sum(F.size(name))).first()[0] or 0
    if numbers <= BROADCAST_ROWS and fits_broadcast(gone, BROADCAST_ROWS):
        gone = F.broadcast(gone)
    joined = docs.join(gone, row_hash() == gone["row"], "left").drop(gone["row"])
    kept = _let(
        F.split("text", "\n"),
        lambda lines: F.array_join(
            F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), name), lambda k: F.get(lines, k)), "\n"
        ),
    )
    text = F.when(F.col(name).isNull(), F.col("text")).otherwise(kept)
    return joined.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns])


def verdicts(docs: DataFrame, left_percent: int = MIN_LEFT_PERCENT, **limits) -> DataFrame:
    """(row, doc_id, counts of ``word_stats``, removed_words, kept) per row of ``docs``."""
    narrow = docs.select("doc_id", "source", "text")
    return _verdicts(narrow, removed_words(narrow, **limits), left_percent)


def _verdicts(narrow: DataFrame, lost: DataFrame, left_percent: int) -> DataFrame:
    stats = word_stats(narrow.withColumn("row", row_hash())).drop("source", "text")
    joined = stats.join(lost, "row", "left")
    removed = F.coalesce("removed", F.lit(0).cast("bigint"))
    kept = ~F.col("base_failed") & (100 * (F.col("n_words") - removed) >= left_percent * F.col("n_words"))
    return joined.withColumn("removed_words", removed).withColumn("kept", kept).drop("removed")


def filter_quality(docs: DataFrame, left_percent: int = MIN_LEFT_PERCENT, **limits) -> DataFrame:
    """The rows the rules keep, with all their columns; frequent lines are taken out of their texts. Only hashes and
    line numbers travel to the texts."""
    narrow = docs.select("doc_id", "source", "text")
    hits = stage(frequent_hits(narrow, **limits), "frequent-hits")
    rejected = _verdicts(narrow, _sum_words(hits), left_percent).where(~F.col("kept"))
    rejected = stage(rejected.select("row").distinct(), "rejected")
    hits = hits.join(rejected, "row", "left_anti")
    if fits_broadcast(rejected, BROADCAST_ROWS):
        rejected = F.broadcast(rejected)
    return without_lines(docs.join(rejected, row_hash() == rejected["row"], "left_anti"), hits)


def op6_quality_rules(spark, sf_dir):
    return verdicts(table(spark, sf_dir, "documents")).drop("row")


# Lines and words as above, without hashes; counts come from joins and windows instead of arrays.
SQL = rf"""
with d as (select doc_id, coalesce(source, chr(0)) as host, coalesce(text, '') as text from documents),
ws as (select doc_id, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from d),
w as (select doc_id, unnest(w) as word, unnest(range(len(w))) as pos from ws),
v as (select doc_id, pos, word || ' ' || lead(word, 1) over o || ' ' || lead(word, 2) over o || ' ' ||
        lead(word, 3) over o || ' ' || lead(word, 4) over o as g from w window o as (partition by doc_id order by pos)),
twice as (select doc_id, pos, lead(pos) over (partition by doc_id order by pos) - pos as gap
  from (select doc_id, pos, count(*) over (partition by doc_id, g) as n from v where g is not null) where n > 1),
rep as (select doc_id, sum(least({WINDOW}, coalesce(gap, {WINDOW}))) as n_repeat_words from twice group by doc_id),
wn as (select doc_id, count(*) as n_words, sum(length(word)) as word_chars from w group by doc_id),
ls as (select doc_id, host, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from d),
lw as (select doc_id, host, line, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) as normal from ls
  where regexp_matches(line, '[^\x20\x09-\x0D]')),
du as (select doc_id, count(*) - count(distinct line) as n_dup_lines from lw group by doc_id),
hosts as (select host, count(distinct doc_id) as n_host from lw group by host),
freq as (select host, normal from (select host, normal, count(distinct doc_id) as n from lw group by all) join hosts using (host)
  where n >= {MIN_DOCUMENTS} and 100 * n > {MAX_HOST_PERCENT} * n_host or n >= {MAX_DOCUMENTS}),
lost as (select doc_id, sum(len(string_split(normal, ' '))) as removed from lw join freq using (host, normal) group by doc_id),
c as (select doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(word_chars, 0)::bigint as word_chars,
  (length(text) - length(regexp_replace(text, '{SYMBOLS}', '', 'g')))::bigint as n_symbols,
  coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
  coalesce(removed, 0)::bigint as removed_words
  from d left join wn using (doc_id) left join du using (doc_id) left join rep using (doc_id) left join lost using (doc_id)),
b as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed from c)
select *, not base_failed and 100 * (n_words - removed_words) >= {MIN_LEFT_PERCENT} * n_words as kept from b
"""
