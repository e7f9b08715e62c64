"""SQL twins of the registered queries, for DuckDB on the same tables.

Common table expressions are written once below and put together per query.
"""

from __future__ import annotations

import re

from answerloom.operators.clean import STOP_WORDS

ORACLE: dict[str, str] = {}


def words(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '\s+'), lambda w: w <> '')"


def squeeze(x: str) -> str:
    return f"array_to_string({words(x)}, ' ')"


def tokens(x: str) -> str:
    return rf"list_filter(string_split_regex(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


def term(x: str) -> str:
    return rf"lower(regexp_replace({x}, '[^\p{{L}}\p{{N}}]+', '', 'g'))"


def sentences(x: str) -> str:
    marked = rf"regexp_replace({x}, '([.!?])\s+', '\1' || chr(1), 'g')"
    return f"list_filter(string_split({marked}, chr(1)), lambda s: trim(s) <> '')"


def round6(x: str) -> str:
    return f"(floor(({x}) * 1e6 + 0.5) / 1e6)"


def windows(length: int, overlap: int = 0) -> str:
    """CTE ``passages`` (doc_id, lang, source, text, split_id, content, uid)."""
    step = length - overlap
    return f"""
      cut_words as (select doc_id, lang, source, text, {words('text')} as ws from documents),
      cut_at as (
        select *, unnest(range(0, greatest(ceil((len(ws) - {overlap}) / {step}.0)::bigint, 1))) as p
        from cut_words where len(ws) > 0),
      passages as (
        select doc_id, lang, source, text, p::int as split_id, doc_id || '-' || p as uid,
               array_to_string(ws[p * {step} + 1 : p * {step} + {length}], ' ') as content
        from cut_at)"""


def groups(length: int = 100) -> str:
    """CTEs ``sents`` (doc_id, sent, s, n) and ``packed`` (doc_id, sent, chunk): greedy packing."""
    return f"""
      listed as (select doc_id, {sentences('text')} as ss from documents),
      sents as (
        select doc_id, sent, s, len({words('s')}) as n
        from (select doc_id, unnest(ss) as s, generate_subscripts(ss, 1) as sent from listed)),
      packed(doc_id, sent, chunk, total) as (
        select doc_id, sent, 0, n from sents where sent = 1
        union all
        select p.doc_id, s.sent,
               case when p.total + s.n <= {length} then p.chunk else p.chunk + 1 end,
               case when p.total + s.n <= {length} then p.total + s.n else s.n end
        from packed p join sents s on s.doc_id = p.doc_id and s.sent = p.sent + 1)"""


DOC_UNITS = "units as (select doc_id as uid, text as content from documents)"
PASSAGE_UNITS = windows(200) + ", units as (select uid, content from passages)"
ITEMS = f"items as (select item_id as q, {squeeze('text')} as query, {squeeze('text')} as answer from benchmark)"
RAW_ITEMS = "items as (select item_id as q, text as query, text as answer from benchmark)"

TOKENS = f"toks as (select uid, unnest({tokens('content')}) as t from units)"
COUNTS = """
  sizes as (select uid, len(ts) as dl from (select uid, {ts} as ts from units)),
  tfs as (select uid, t, count(*) as tf from toks group by all),
  dfs as (select t, count(*) as df from tfs group by t),
  corpus as (select count(*) as n, avg(dl) as avgdl from sizes)""".replace("{ts}", tokens("content"))
TFIDF = """
  raw as (
    select uid, t, tf * (ln((n + 1)::double / (df + 1)::double) + 1) as raw
    from tfs join dfs using (t), corpus),
  weights as (select uid, t, raw / sqrt(sum(raw * raw) over (partition by uid)) as w from raw)"""
def bm25(source: str = "items", out: str = "bm") -> str:
    """CTE ``out`` (q, uid, score) of the queries in ``source``."""
    return f"""
  asked_{out} as (select q, unnest(list_distinct({tokens('query')})) as t from {source}),
  tw_{out} as materialized (
    select uid, t, ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double
      / (tf + 1.2::double * (0.25::double + 0.75::double * dl / avgdl)) as part
    from tfs join dfs using (t) join sizes using (uid), corpus where t in (select t from asked_{out})),
  {out} as (select q, uid, {round6('sum(part)')} as score from asked_{out} join tw_{out} using (t) group by q, uid)"""


BM25 = bm25()


def query_weights(source: str) -> str:
    """CTE ``qw`` (q, t, wq)."""
    return f"""
  qraw as (
    select q, t, count(*) * (ln((any_value(n) + 1)::double / (any_value(df) + 1)::double) + 1) as raw
    from (select q, unnest({tokens('query')}) as t from {source}) join dfs using (t), corpus group by q, t),
  qw as (select q, t, raw / sqrt(sum(raw * raw) over (partition by q)) as wq from qraw)"""


def cosine(source: str = "items") -> str:
    """CTE ``cosine`` (q, uid, score)."""
    return f"""{query_weights(source)},
  cosine as (select q, uid, {round6('sum(w * wq)')} as score from qw join weights using (t) group by q, uid)"""


TFIDF_SCORES = cosine()


def ranked(source: str, k: int, name: str) -> str:
    return f"""{name} as (
      select * from (select *, row_number() over (partition by q order by score desc, uid)::int as rank from {source})
      where rank <= {k})"""


INDEX = f"{TOKENS}, {COUNTS}"
DOC_INDEX = f"{DOC_UNITS}, {INDEX}"
PASSAGE_INDEX = f"{PASSAGE_UNITS}, {INDEX}"
DOC_BM25 = f"{ITEMS}, {DOC_INDEX}, {BM25}, {ranked('bm', 5, 'hits')}"
PASSAGE_BM25 = f"{ITEMS}, {PASSAGE_INDEX}, {BM25}, {ranked('bm', 5, 'hits')}"
RETRIEVED = f"""{PASSAGE_BM25},
  retrieved as (
    select hits.*, doc_id, source, content, query
    from hits join passages using (uid) join items using (q))"""

LABELS = """
  gold_pairs as (select q, uid from items join units on contains(content, answer)),
  labels_ as (
    select q, query, case when uid is null then '' else answer end as answer, uid
    from items left join gold_pairs using (q))"""

# --- cleaning and splitting -------------------------------------------------------------------------

LINES = r"string_split(text, chr(10))"

ORACLE["clean_whitespace"] = f"""
  select doc_id, array_to_string(list_transform({LINES}, lambda l: trim(l)), chr(10)) as text from documents"""
ORACLE["clean_empty_lines"] = r"""
  select doc_id, regexp_replace(text, '\n\n+', chr(10) || chr(10), 'g') as text from documents"""
ORACLE["clean_header_footer"] = f"""
  with d as (select doc_id, source, {LINES} as ls from documents),
  totals as (select source, count(*) as n from d group by 1),
  h as (select source, ls[1] as header from d join totals using (source) where ls[1] <> ''
        group by source, ls[1] having count(*) > any_value(n) * 0.5 and count(*) > 1),
  f as (select source, ls[-1] as footer from d join totals using (source) where ls[-1] <> ''
        group by source, ls[-1] having count(*) > any_value(n) * 0.5 and count(*) > 1),
  m as (select doc_id, ls, case when ls[1] = header then 1 else 0 end as a, footer
        from d left join h using (source) left join f using (source))
  select doc_id, array_to_string(ls[a + 1 : len(ls) - case when len(ls) > a and ls[-1] = footer then 1 else 0 end],
                                 chr(10)) as text
  from m"""
ORACLE["drop_numeric_lines"] = f"""
  select doc_id, array_to_string(list_filter({LINES}, lambda l:
      len(list_filter({words('l')}, lambda x: regexp_matches(x, '[0-9]'))) / greatest(len({words('l')}), 1) <= 0.4
    ), chr(10)) as text
  from documents"""
ORACLE["split_words"] = f"with {windows(200)} select doc_id, split_id, content from passages"
ORACLE["split_overlap"] = f"with {windows(200, 50)} select doc_id, split_id, content from passages"
ORACLE["split_sentences"] = f"""
  with recursive {groups()}
  select doc_id, chunk::int as split_id, string_agg(s, ' ' order by sent) as content
  from packed join sents using (doc_id, sent) group by doc_id, chunk"""
ORACLE["split_sentences_hard_max"] = f"""
  with recursive {groups()},
  big as (
    select doc_id, chunk, string_agg(s, ' ' order by sent) as content
    from packed join sents using (doc_id, sent) group by doc_id, chunk),
  cut as (select *, {words('content')} as ws from big),
  pieces as (select *, unnest(range(0, ceil(len(ws) / 100.0)::bigint)) as p from cut)
  select doc_id, (row_number() over (partition by doc_id order by chunk, p) - 1)::int as split_id,
         array_to_string(ws[p * 100 + 1 : p * 100 + 100], ' ') as content
  from pieces"""
STOP = ", ".join(f"'{w}'" for w in STOP_WORDS["en"])
ORACLE["filter_language"] = f"""
  select doc_id, lang, {round6(f"len(list_filter(ts, lambda t: t in ({STOP}))) / greatest(len(ts), 1)")}
    as stop_word_share
  from (select doc_id, lang, list_distinct({tokens('text')}) as ts from documents where lang in ('en'))"""
ORACLE["chunk_id"] = f"""
  with {windows(200)} select doc_id, split_id, md5(text) || '-' || split_id as id from passages"""
ORACLE["truncate_tokens"] = f"""
  select 'query' as kind, item_id::varchar as uid, array_to_string(({words('text')})[1:64], ' ') as content
  from benchmark
  union all
  select 'passage', doc_id::varchar, array_to_string(({words('text')})[1:256], ' ') from documents"""
ORACLE["embed_title"] = f"with {windows(200)} select uid, source || ' ' || content as content from passages"
ORACLE["embed_page_title"] = r"""
  select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) || ' ' ||
    trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) as content
  from pages"""
ORACLE["preview"] = f"with {windows(200)} select uid, substring(content, 1, 100) as preview from passages"

# --- index statistics -------------------------------------------------------------------------------

ORACLE["term_stats"] = f"""
  with {DOC_INDEX} select t, count(*) as df, sum(tf)::bigint as cf from tfs group by t"""
ORACLE["corpus_size"] = f"with {DOC_INDEX} select n, {round6('avgdl')} as avgdl from corpus"
ORACLE["tfidf_vectors"] = f"with {DOC_INDEX}, {TFIDF} select uid, t, {round6('w')} as w from weights"
ORACLE["keywords"] = f"""
  with {DOC_INDEX}, {TFIDF},
  r as (select uid, t, {round6('w')} as w from weights)
  select * from (select *, row_number() over (partition by uid order by w desc, t)::int as rank from r)
  where rank <= 10"""

# --- retrieval --------------------------------------------------------------------------------------

ORACLE["bm25_topk"] = f"with {DOC_BM25} select q, uid, score, rank from hits"
ORACLE["bm25_topk_stored"] = ORACLE["bm25_topk"]
ORACLE["bm25_topk_pruned"] = ORACLE["bm25_topk"]
ORACLE["tfidf_topk"] = f"""
  with {ITEMS}, {DOC_INDEX}, {TFIDF}, {TFIDF_SCORES}, {ranked('cosine', 5, 'hits')}
  select q, uid, score, rank from hits"""
ORACLE["tfidf_topk_added"] = ORACLE["tfidf_topk"]
ORACLE["rerank"] = f"""
  with {ITEMS}, {DOC_INDEX}, {BM25}, {ranked('bm', 50, 'pool')}, {TFIDF}, {TFIDF_SCORES},
  both_ as (select cosine.*, pool.rank as first_rank from cosine join pool using (q, uid)),
  {ranked('both_', 5, 'hits')}
  select q, uid, score, first_rank, rank from hits"""
ORACLE["document_search"] = f"with {RETRIEVED} select q, query, rank, score, uid, content from retrieved"

# --- generation and reading -------------------------------------------------------------------------

WORD_DF = f"""
  seen as (select distinct doc_id, t from (select doc_id, {term('w')} as t
    from (select doc_id, unnest({words('text')}) as w from documents)) where t <> ''),
  wdf as (select t, count(*) as df from seen group by t),
  docs_n as (select count(*) as n_docs from documents)"""
PLACED = f"""{groups()},
  {WORD_DF},
  whole as (select doc_id, chunk, s, n, sent - first_sent as sent
    from (select *, min(sent) over (partition by doc_id, chunk) as first_sent
          from packed join sents using (doc_id, sent)))"""
ASKED = rf"""
  placed as (
    select doc_id, chunk, s, len({words('s')}) as n,
      row_number() over (partition by doc_id, chunk order by sent, k) - 1 as sent
    from (select doc_id, chunk, sent, unnest(parts) as s, generate_subscripts(parts, 1) as k from (
      select doc_id, chunk, sent, case when n <= 60 then [s] else list_filter(string_split(regexp_replace(s,
          '((?:\S+\s+){{59}}\S+\s*)\s', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') end as parts
      from whole))),
  ws as (select doc_id, chunk, sent, n, w, {term('w')} as t, pos
    from (select *, unnest(wl) as w, generate_subscripts(wl, 1) as pos
          from (select *, {words('s')} as wl from placed))),
  picks as (select doc_id, chunk, sent, pos, w from (
      select ws.*, row_number() over (partition by doc_id, chunk, sent order by coalesce(df, 0), pos) as r
      from ws left join wdf using (t) where n >= 3 and length(t) >= 4)
    where r = 1),
  questions as (
    select p.doc_id, p.chunk, p.sent,
      regexp_replace(string_agg(case when ws.pos = p.pos then 'what' else ws.w end, ' ' order by ws.pos),
                     '[.!?]+$', '') || '?' as question,
      regexp_replace(any_value(p.w), '[^\p{{L}}\p{{N}}]+', '', 'g') as answer
    from picks p join ws using (doc_id, chunk, sent) group by p.doc_id, p.chunk, p.sent)"""
QUESTIONS = f"{PLACED}, {ASKED}"
PAIRS = f"""{QUESTIONS},
  qterms as (select distinct p.doc_id, p.chunk, p.sent, ws.t from picks p join ws using (doc_id, chunk, sent)
    where ws.pos <> p.pos and ws.t <> ''),
  sterms as (select distinct doc_id, chunk, sent, t from ws where t <> ''),
  shared as (
    select q.doc_id, q.chunk, q.sent, s.sent as answer_sent, sum(ln((n_docs + 1)::double / (df + 1)::double)) as total
    from qterms q join sterms s on q.doc_id = s.doc_id and q.chunk = s.chunk and q.t = s.t
      join wdf on wdf.t = q.t, docs_n group by all),
  scored as (
    select q.doc_id, q.chunk, q.sent, b.sent as answer_sent, b.s as answer,
      floor(coalesce(total, 0) / sqrt(b.n::double) * 1e6 + 0.5) as score
    from questions q join placed b using (doc_id, chunk)
      left join shared on shared.doc_id = q.doc_id and shared.chunk = q.chunk and shared.sent = q.sent
        and shared.answer_sent = b.sent),
  pairs as (
    select q.doc_id, q.chunk::int as split_id, q.sent::int as sent, question, q.answer as cloze_answer,
      z.answer, z.answer_sent::int as answer_sent, z.score / 1e6 as score,
      (select coalesce(sum(length(b.s) + 1), 0) from placed b
        where b.doc_id = q.doc_id and b.chunk = q.chunk and b.sent < z.answer_sent)::int as answer_start
    from questions q join (
      select *, row_number() over (partition by doc_id, chunk, sent order by score desc, answer_sent) as r
      from scored) z on z.doc_id = q.doc_id and z.chunk = q.chunk and z.sent = q.sent and z.r = 1)"""
ORACLE["generate_questions"] = f"""
  with recursive {QUESTIONS}
  select doc_id, chunk::int as split_id, sent::int as sent, question, answer from questions"""
ORACLE["qa_generation"] = f"with recursive {PAIRS} select * from pairs"


def spans(source: str = "retrieved", queries: str = "items", suffix: str = "") -> str:
    """CTEs ``spans`` and ``read_`` (q, uid, sent, answer, start, score, rank). Needs WORD_DF."""
    n_words = "len(" + words("any_value(c.answer)") + ")"
    return f"""
  qidf{suffix} as (
    select q, t, ln((n_docs + 1)::double / (coalesce(df, 0) + 1)::double) as idf
    from (select distinct q, {term('w')} as t from (select q, unnest({words('query')}) as w from {queries}))
      left join wdf using (t), docs_n where t <> ''),
  cand{suffix} as (select q, uid, content, unnest(ss) as answer, generate_subscripts(ss, 1) - 1 as sent
    from (select q, uid, content, {sentences('content')} as ss from {source})),
  cterms{suffix} as (select distinct q, uid, sent, {term('w')} as t
    from (select q, uid, sent, unnest({words('answer')}) as w from cand{suffix})),
  spans{suffix} as (select * from (
    select c.q, c.uid, c.sent::int as sent, any_value(c.answer) as answer,
      (instr(any_value(c.content), any_value(c.answer)) - 1)::int as start,
      {round6(f"sum(idf) / sqrt(greatest({n_words}, 1)::double)")} as score
    from cand{suffix} c join cterms{suffix} x on x.q = c.q and x.uid = c.uid and x.sent = c.sent
      join qidf{suffix} i on i.q = c.q and i.t = x.t
    group by c.q, c.uid, c.sent) where score > 0),
  read_{suffix} as (select * from (
      select *, row_number() over (partition by q order by score desc, uid, sent)::int as rank
      from spans{suffix}) where rank <= 4)"""


READ = f"{RETRIEVED}, {WORD_DF}, {spans()}"
ORACLE["extract_answers"] = f"with {READ} select q, uid, sent, answer, start, score, rank from read_"

# --- labels and evaluation --------------------------------------------------------------------------

PASSAGE_LABELS = f"{ITEMS}, {PASSAGE_UNITS}, {LABELS}"
ORACLE["labels_aggregated"] = f"""
  with {PASSAGE_LABELS},
  u as (select q, query, uid, answer, count(*) as copies from labels_ where answer <> '' group by all)
  select q, query, uid, string_agg(answer, '|' order by answer) as answers, sum(copies)::bigint as n_labels
  from u group by q, query, uid"""
REL = f"""{RETRIEVED}, {LABELS},
  rel as (
    select r.q, r.rank, coalesce(max(case when l.answer <> '' and contains(r.content, l.answer) then 1 else 0 end), 0)::int
      as rel
    from retrieved r join labels_ l using (q) group by r.q, r.rank)"""
ORACLE["retriever_eval"] = f"with {REL} select q, rank, rel from rel"

ANSWERED = f"{LABELS}, answered as (select * from labels_ where answer <> '')"
PER_QUERY = """
  numbered as (select *, sum(rel) over (partition by {by}q order by rank) as hit_no from {rel}),
  per_query as (
    select {by}q, max(rel)::double as recall_single_hit,
      coalesce(1::double / min(case when rel = 1 then rank end), 0) as mrr,
      sum(rel) / count(*) as precision,
      coalesce(avg(case when rel = 1 then hit_no / rank end), 0) as map
    from numbered group by {by}q)"""
FOUR = ["recall_single_hit", "mrr", "precision", "map"]


def per_query(rel: str = "rel", by: str = "") -> str:
    return PER_QUERY.replace("{by}", by).replace("{rel}", rel)


def long_metrics(source: str, metrics: list[str], by: str = "") -> str:
    group = f"group by {by.rstrip(', ')}" if by else ""
    return " union all ".join(
        f"select {by}'{m}' as metric, {round6(f'avg({m})')} as value from {source} {group}" for m in metrics
    )


ORACLE["query_scores"] = f"""
  with {REL}, {per_query()}
  select q, {', '.join(f"{round6(m)} as {m}" for m in FOUR)} from per_query"""
REL_ANSWERED = f"""{RETRIEVED}, {ANSWERED},
  rel as (
    select r.q, r.rank, max(case when contains(r.content, l.answer) then 1 else 0 end) as rel
    from retrieved r join answered l using (q) group by r.q, r.rank)"""
ORACLE["retriever_metrics_all"] = f"""
  with {REL_ANSWERED}, {per_query()},
  gold as (select distinct q, uid from answered),
  multi as (
    select q, avg(case when (q, uid) in (select (q, uid) from hits) then 1.0::double else 0 end) as recall_multi_hit
    from gold group by q)
  {long_metrics('per_query', FOUR)} union all {long_metrics('multi', ['recall_multi_hit'])}"""


def norm(x: str) -> str:
    plain = f"regexp_replace(lower(coalesce({x}, '')), '[!-/:-@\\[-`{{-~]', '', 'g')"
    return f"array_to_string(list_filter({words(plain)}, lambda w: w not in ('a', 'an', 'the')), ' ')"


def overlap(predictions: str, gold: str, out: str = "scored", extra: str = "") -> str:
    """CTE ``out`` (q, rank, em, f1): best over gold answers; ``extra`` adds columns of both sides to the pairs."""
    return f"""
  pair_{out} as (
    select distinct r.q, r.rank, {norm('r.answer')} as pred, g.gold
    from {predictions} r join (select distinct q, {norm('answer')} as gold from {gold}) g using (q)),
  ptok_{out} as (select q, rank, gold, tok, count(*) as c
    from (select q, rank, gold, unnest({words('pred')}) as tok from pair_{out}) group by all),
  gtok_{out} as (select q, rank, gold, tok, count(*) as c
    from (select q, rank, gold, unnest({words('gold')}) as tok from pair_{out}) group by all),
  common_{out} as (select q, rank, gold, sum(least(p.c, g.c)) as common
    from ptok_{out} p join gtok_{out} g using (q, rank, gold, tok) group by all),
  full_{out} as (
    select q, rank, gold, (pred = gold)::int::double as em,
      case when len({words('pred')}) = 0 or len({words('gold')}) = 0 then (pred = gold)::int::double
        else 2 * coalesce(common, 0)::double / (len({words('pred')}) + len({words('gold')})) end as f1
    from pair_{out} left join common_{out} using (q, rank, gold)),
  {out} as (select q, rank, max(em) as em, max(f1) as f1 from full_{out} group by q, rank)"""


def best(scored: str, gold: str, out: str, n: int | None = None) -> str:
    where = "" if n is None else f"where rank <= {n}"
    return f"""
  {out} as (
    select q, coalesce(em, 0) as em, coalesce(f1, 0) as f1
    from (select distinct q from {gold})
      left join (select q, max(em) as em, max(f1) as f1 from {scored} {where} group by q) using (q))"""


def reader_values(source: str) -> str:
    return f"""
  select 'exact_match' as metric, {round6('avg(em)')} as value from {source}
  union all select 'f1', {round6('avg(f1)')} from {source}"""


ORACLE["answer_scores"] = f"""
  with {READ}, {LABELS}, {overlap('read_', 'labels_')} select q, rank, em, {round6('f1')} as f1 from scored"""
SCORED = f"{READ}, {ANSWERED}, {overlap('read_', 'answered')}, {best('scored', 'answered', 'best')}"
ORACLE["reader_metrics_all"] = f"with {SCORED} {reader_values('best')}"
NONE_READ = f"""{READ},
  with_none as (
    select q, uid, sent, answer, start, score from spans
    union all select q, null, null, null, null, 6.5::double from items),
  none_read as (select * from (
      select *, row_number() over (partition by q order by score desc, uid nulls last, sent nulls last)::int as rank
      from with_none) where rank <= 4)"""
ORACLE["no_answer"] = f"with {NONE_READ} select * from none_read"
ORACLE["extractive_qa"] = f"""
  with {NONE_READ} select q, rank, uid, none_read.answer, score, query from none_read join items using (q)"""
READER_EVAL = f"""{overlap('none_read', 'labels_')},
  {best('scored', 'labels_', 'top1', 1)}, {best('scored', 'labels_', 'top4', 4)},
  kinds as (select q, max((answer <> '')::int) as has_text from labels_ group by q),
  j as (select q, has_text, top4.em, top4.f1, top1.em as em1, top1.f1 as f11
        from kinds join top4 using (q) join top1 using (q)),
  m as (select avg((f1 > 0)::int) as a, avg(em1) as b, avg(f11) as c,
      avg((f1 > 0)::int) filter (has_text = 1) as d, avg(em) filter (has_text = 1) as e,
      avg(f1) filter (has_text = 1) as f from j)
  {" union all ".join(f"select '{name}' as metric, {round6(col + ' * 100')} as value from m" for name, col in [
      ("top_n_accuracy", "a"), ("EM", "b"), ("f1", "c"), ("top_n_accuracy_text_answer", "d"),
      ("top_n_EM_text_answer", "e"), ("top_n_f1_text_answer", "f")])}"""
ORACLE["reader_eval"] = f"with {NONE_READ}, {LABELS}, {READER_EVAL}"
FROM_RETRIEVED = f"""{RETRIEVED}, {WORD_DF},
  once as (select uid, any_value(content) as content from retrieved group by uid),
  whole as (
    select uid as doc_id, 0 as chunk, s, len({words('s')}) as n, sent
    from (select uid, unnest(ss) as s, generate_subscripts(ss, 1) - 1 as sent
          from (select uid, {sentences('content')} as ss from once))), {ASKED}"""
ORACLE["retrieve_then_generate"] = f"""
  with {FROM_RETRIEVED}
  select q, rank, uid, x.sent::int as sent, x.question, x.answer
  from retrieved join questions x on x.doc_id = uid"""
SHARED_TWICE = ("passages tfs dfs sizes corpus hits retrieved once placed ws picks questions qs bq wdf asked_bq").split()


def computed_once(sql: str, names: list[str]) -> str:
    """The same SQL with these CTEs materialised."""
    return re.sub(rf"\b({'|'.join(names)}) as \(", r"\1 as materialized (", sql)


# Numbers stand for questions and units while scores are summed, and only the two best of a question are kept.
ORACLE["pseudo_labels"] = computed_once(f"""
  with {FROM_RETRIEVED},
  qs as (select distinct doc_id || ':' || md5(question) as q, doc_id as made_from, question as query from questions),
  qn as (select row_number() over (order by query) as qi, query from (select distinct query from qs)),
  un as (select row_number() over (order by uid) as ui, uid from units),
  qt as (select qi, unnest(list_distinct({tokens('query')})) as t from qn),
  parts as (
    select t, list(ui) as uis, list(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double
      / (tf + 1.2::double * (0.25::double + 0.75::double * dl / avgdl))) as parts
    from tfs join dfs using (t) join sizes using (uid) join un using (uid), corpus where t in (select t from qt) group by t),
  bq as (select qi, ui, {round6('sum(part)')} as score
    from (select qi, unnest(uis) as ui, unnest(parts) as part from qt join parts using (t)) group by qi, ui),
  two as (select qi, max({{'s': score, 'u': -ui}}, 2) as best from bq group by qi),
  pos as (select q, qi, made_from as pos_uid, ui as pos_ui, score as pos_score
    from qs join qn using (query) join un on un.uid = made_from join bq using (qi, ui)),
  neg as (select q, list_filter(best, lambda b: -b.u <> pos_ui)[1] as b from pos join two using (qi))
  select q, pos_uid, pos_score, uid as neg_uid, b.s as neg_score, {round6('pos_score - coalesce(b.s, 0)')} as margin
  from pos left join neg using (q) left join un on un.ui = -b.u""", SHARED_TWICE)
ORACLE["hard_pairs"] = f"""
  with recursive {PAIRS}
  select pairs.doc_id || '-' || split_id || '-' || pairs.sent as id, question, pairs.answer as wrong_answer, b.s as answer
  from pairs join placed b on b.doc_id = pairs.doc_id and b.chunk = pairs.split_id and b.sent = pairs.sent
  where b.s <> pairs.answer"""
DIALOGUE = """
  dialogue as (
    select u.conv_id, u.turn, u.text as question, a.text as reply
    from conversations u join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1
    where u.role = 'user' and a.role = 'assistant')"""
ORACLE["split_train_eval"] = f"""
  with {DIALOGUE}
  select conv_id, turn, case when ('0x' || substr(md5(question), 1, 6))::bigint % 100 < 20 then 'eval' else 'train' end
    as part
  from dialogue"""


def ngrams(x: str) -> str:
    return f"""list_distinct(case when len({x}) >= 3
      then list_transform(range(1, len({x}) - 1), lambda i: array_to_string({x}[i : i + 2], ' '))
      else [array_to_string({x}, ' ')] end)"""


GOLD = f"""{RETRIEVED}, {ANSWERED},
  gold as (select a.*, p.source, p.content as gold_context from answered a join passages p using (uid)),
  context_pairs as (
    select r.q, r.rank, r.uid as r_uid, r.source as r_source, r.content, g.uid, g.source, g.answer,
      {ngrams('string_split(r.content, chr(32))')} as x, {ngrams('string_split(g.gold_context, chr(32))')} as y
    from retrieved r join gold g using (q)),
  matched as (
    select *, len(list_intersect(x, y)) / greatest(least(len(x), len(y)), 1) as share from context_pairs)"""
ORACLE["context_match"] = f"""
  with {GOLD} select q, rank, uid, {round6('share')} as containment, share >= 0.65 as matched from matched"""
ANSWER_SCOPES = {"any": "true", "context": "c", "document_id": "i", "document_id_and_context": "i and c"}
DOCUMENT_SCOPES = {
    "document_id": "i", "context": "c", "document_id_and_context": "i and c", "document_id_or_context": "i or c",
    "answer": "h and ({a})", "document_id_or_answer": "i or (h and ({a}))",
}


def scoped(key: str) -> str:
    cases = " union all ".join(
        f"select '{an}' as answer_scope, '{dn}' as document_scope, q, rank, gold_key, ({de.replace('{a}', ae)})::int as rel"
        " from flags"
        for an, ae in ANSWER_SCOPES.items() for dn, de in DOCUMENT_SCOPES.items()
    )
    by = "answer_scope, document_scope, "
    return f"""{GOLD},
  flags as (select q, rank, {key} as gold_key, r_{key} = {key} as i, share >= 0.65 as c, contains(content, answer) as h
    from matched),
  cases as ({cases}),
  rows_ as (select answer_scope, document_scope, q, rank, max(rel) as rel from cases group by all),
  {per_query('rows_', by)},
  multi as (select answer_scope, document_scope, q, avg(hit) as recall_multi_hit
    from (select answer_scope, document_scope, q, gold_key, max(rel) as hit from cases group by all) group by all),
  metrics as ({long_metrics('per_query', FOUR, by)} union all {long_metrics('multi', ['recall_multi_hit'], by)})"""


ORACLE["scope_metrics"] = f"with {scoped('uid')} select * from metrics"
ORACLE["custom_document_id"] = f"""
  with {scoped('source')} select * from metrics where answer_scope = 'any' and document_scope = 'document_id'"""
ORACLE["scoped_reader_metrics"] = f"""
  with {GOLD}, {WORD_DF}, {spans()}, {overlap('read_', 'answered')},
  flags as (
    select f.q, f.em, f.f1, m.r_uid = m.uid as i, m.share >= 0.65 as c
    from full_scored f join read_ r using (q, rank)
      join (select distinct q, r_uid, uid, answer, share from matched) m
        on m.q = f.q and m.r_uid = r.uid and {norm('m.answer')} = f.gold),
  cases as ({" union all ".join(
      f"select '{n}' as answer_scope, q, em * ({e})::int as em, f1 * ({e})::int as f1 from flags"
      for n, e in ANSWER_SCOPES.items())}),
  b as (select answer_scope, q, max(em) as em, max(f1) as f1 from cases group by all)
  select answer_scope, {round6("sum(em) / (select count(distinct q) from answered)")} as exact_match,
    {round6("sum(f1) / (select count(distinct q) from answered)")} as f1
  from b group by answer_scope"""
ORACLE["eval_isolated"] = f"""
  with {SCORED},
  given as (select a.q, a.uid, u.content from answered a join units u using (uid)),
  {spans('given', 'items', '2')}, {overlap('read_2', 'answered', 'scored2')}, {best('scored2', 'answered', 'best2')},
  a as ({reader_values('best')}), b as ({reader_values('best2')})
  select metric, a.value as integrated, b.value as isolated, {round6('b.value - a.value')} as gap
  from a join b using (metric)"""
ORACLE["lexical_similarity"] = f"""
  with {READ}, {ANSWERED},
  ddf as (select t, count(*) as df from (select distinct doc_id, t from
    (select doc_id, unnest({tokens('text')}) as t from documents)) group by t),
  sim_pairs as (select r.q || '-' || r.rank as key, r.answer as a, g.b
    from read_ r join (select distinct q, answer as b from answered) g using (q)),
  sides as (select key, 'a' as side, unnest({tokens('a')}) as t from sim_pairs
    union all select key, 'b', unnest({tokens('b')}) from sim_pairs),
  sw as (select key, side, t, count(*) * (ln((any_value(n_docs) + 1)::double / (coalesce(any_value(df), 0) + 1)::double) + 1)
      as w from sides left join ddf using (t), docs_n group by key, side, t),
  sn as (select key, side, t, w / sqrt(sum(w * w) over (partition by key, side)) as w from sw),
  cs as (select x.key, sum(x.w * y.w) as s from sn x join sn y on x.key = y.key and x.t = y.t
    where x.side = 'a' and y.side = 'b' group by x.key)
  select key, {round6('coalesce(s, 0)')} as similarity from sim_pairs left join cs using (key)"""
ORACLE["eval_report"] = f"""
  with {SCORED}, worst as (select q, {round6('f1')} as f1 from best order by 2, q limit 5)
  select q, f1, rank, read_.answer from worst left join read_ using (q)"""
RUNS = f"""{READ}, {ANSWERED}, {overlap('read_', 'answered')}, {best('scored', 'answered', 'best1', 1)},
  {best('scored', 'answered', 'best4')}, a as ({reader_values('best1')}), b as ({reader_values('best4')})"""
ORACLE["compare_runs"] = f"""
  with {RUNS}
  select 'Reader' as node, metric, a.value as before, b.value as after, {round6('b.value - a.value')} as delta
  from a join b using (metric)"""
ORACLE["score_table"] = f"""
  with {SCORED}, m as ({reader_values('best')})
  select metric as "Metrics", {round6('value * 100')} as "Score" from m"""

# --- dense retrieval, routing and merging -----------------------------------------------------------

VECTORS = "vecs as (select vec_id, embedding::double[] as v from embeddings)"
EXACT = f"""{VECTORS},
  dots as (select a.vec_id as q, b.vec_id as uid, {round6('list_dot_product(a.v, b.v)')} as score from vecs a, vecs b),
  {ranked('dots', 5, 'exact')}"""
ANN = """
  planes as (
    select p, list(case when substr(md5('plane-' || p || '-' || i), 1, 1) <= '7' then 1.0::double else -1.0 end
                   order by i) as s
    from range(64) x(p), range((select max(len(v)) from vecs)) y(i) group by p),
  keys as (
    select vec_id, p // 4 as band, sum(case when list_dot_product(v, s) >= 0 then 2 ** (p % 4) else 0 end) as k
    from vecs, planes group by all),
  near as (select distinct a.vec_id as q, b.vec_id as uid from keys a join keys b using (band, k)),
  near_dots as (select * from dots semi join near using (q, uid))"""
ORACLE["dense_topk_exact"] = f"with {EXACT} select * from exact"
ORACLE["dense_topk_ann"] = f"with {EXACT}, {ANN}, {ranked('near_dots', 5, 'approx')} select * from approx"
ORACLE["ann_recall"] = f"""
  with {EXACT}, {ANN}, {ranked('near_dots', 5, 'approx')},
  j as (select exact.q, approx.uid as hit from exact left join approx using (q, uid))
  select count(*) as pairs, count(hit) as found, {round6('count(hit) / count(*)')} as recall,
    (select count(*) from near) as candidates, (select count(*) * count(*) from vecs) as all_pairs from j"""
ORACLE["dense_topk_stored"] = ORACLE["dense_topk_ann"]
TITLED = f"""{windows(200)},
  units as (select uid, source || ' ' || content as content from passages)"""
DIM = "('0x' || substr(md5(t), 1, 2))::int"
SIGN = "case when substr(md5(t), 3, 1) <= '7' then 1.0::double else -1.0 end"
COMPONENTS = f"""{TITLED}, {INDEX}, {TFIDF},
  comps as (select uid, {DIM} as dim, sum(w * {SIGN}) as v from weights group by all)"""
ORACLE["update_embeddings"] = f"""
  with {COMPONENTS} select * from (select uid, dim, {round6('v')} as value from comps) where value <> 0"""
ORACLE["dense_topk_dual"] = f"""
  with {ITEMS}, {COMPONENTS}, {query_weights('items')},
  qcomps as (select q, {DIM} as dim, sum(wq * {SIGN}) as v from qw group by all),
  dots as (select q, uid, {round6('sum(qcomps.v * comps.v)')} as score from qcomps join comps using (dim) group by q, uid),
  {ranked('dots', 5, 'hits')}
  select q, uid, score, rank from hits"""
ORACLE["route_queries"] = "select page_id, case when contains(url, '?') then 2 else 1 end as branch from pages"
ORACLE["custom_node"] = ORACLE["route_queries"]
BRANCHES = f"""{ITEMS}, {DOC_INDEX}, {BM25}, {ranked('bm', 5, 'one')}, {TFIDF}, {TFIDF_SCORES}, {ranked('cosine', 5, 'two')},
  both_ as (select q, uid, score, rank from one union all select q, uid, score, rank from two)"""
ORACLE["merge_by_score"] = f"with {BRANCHES} select q, uid, max(score) as score from both_ group by q, uid"
ORACLE["merge_by_rank"] = f"""
  with {BRANCHES},
  fused as (select q, uid, {round6('sum(1::double / (rank + 60))')} as score from both_ group by q, uid),
  {ranked('fused', 5, 'hits')}
  select * from hits"""
ORACLE["join_answers"] = f"""
  with {READ},
  both_ as (
    select q, answer, score, rank, 0 as branch from read_
    union all select q, substring(content, 1, 100), null, rank, 1 from retrieved)
  select *, row_number() over (partition by q order by score desc nulls last, branch, rank)::int as position, true as sorted
  from both_
  union all
  select *, row_number() over (partition by q order by branch, rank)::int as position, false as sorted from both_"""
ORACLE["filter_query"] = f"""
  with {RETRIEVED} select q, rank, uid, score from retrieved where query = (select min(query) from items)"""
ORACLE["head"] = f"with {RETRIEVED} select q, rank, uid, score from retrieved order by q, rank limit 5"
ORACLE["pipeline_classifier"] = f"""
  with {ITEMS}, {WORD_DF}, {PASSAGE_INDEX}, {TFIDF},
  whole as (
    select q as doc_id, 0 as chunk, s, len({words('s')}) as n, sent
    from (select q, unnest(ss) as s, generate_subscripts(ss, 1) - 1 as sent
          from (select q, {sentences('query')} as ss from items))), {ASKED},
  queries as (select q::varchar as q, query from items
    union all select doc_id || '-' || sent, question from questions),
  plain as (select * from queries where not contains(query, '?')),
  asking as (select * from queries where contains(query, '?')),
  {bm25('plain', 'bm')}, {ranked('bm', 5, 'one')}, {cosine('asking')}, {ranked('cosine', 5, 'two')},
  retrieved as (select h.q, h.uid, u.content
    from (select q, uid from one union all select q, uid from two) h join units u using (uid)),
  {spans('retrieved', 'queries')}
  select q, uid, answer, score from read_ where rank = 1"""

# --- sources and sinks ------------------------------------------------------------------------------

ORACLE["corpus_load"] = """
  select md5(text) || '-0' as id, doc_id, text as content, 'text' as content_type, source as name, lang as meta_lang
  from documents"""
ORACLE["gold_labels"] = f"""
  with {RAW_ITEMS}, {DOC_UNITS}, {LABELS}
  select q, uid, uid is not null as is_correct_document, 'gold-label' as origin from labels_"""
SQUAD = f"""{DIALOGUE},
  sq as (
    select 'conv-' || conv_id as title, reply as context, conv_id || '-' || turn as id, question,
      case when len({words('reply')}) > 3 then (
        select s from (select unnest({sentences('reply')}) as s, generate_subscripts({sentences('reply')}, 1) as i)
        order by length(s) desc, i limit 1) end as answer
    from dialogue)"""
ORACLE["squad_roundtrip"] = f"""
  with {SQUAD}
  select *, answer is null as is_impossible, (instr(context, answer) - 1)::int as answer_start from sq"""
SQUAD_PASSAGES = f"""{SQUAD},
  ctx as (select md5(context) as context_id, min(title) as title, any_value({words('context')}) as ws from sq group by 1),
  sqp as (
    select context_id, title, p::int as split_id, array_to_string(ws[p * 50 + 1 : p * 50 + 50], ' ') as content,
      case when p = 0 then 0 else length(array_to_string(ws[1 : p * 50], ' ')) + 1 end::int as first_char
    from (select *, unnest(range(0, ceil(len(ws) / 50.0)::bigint)) as p from ctx))"""
ORACLE["squad_passages"] = f"with {SQUAD_PASSAGES} select * from sqp"
ORACLE["squad_labels"] = f"""
  with {SQUAD_PASSAGES},
  lab as (
    select id, question, md5(context) as context_id, {squeeze('answer')} as answer,
      length({squeeze('before')}) + case when regexp_matches(before, '\\s$') and {squeeze('before')} <> '' then 1 else 0 end as at
    from (select *, substring(context, 1, instr(context, answer) - 1) as before from sq where answer is not null)),
  hit as (
    select l.id, p.split_id, l.at - p.first_char as start from lab l join sqp p using (context_id)
    where l.at >= p.first_char and l.at + length(l.answer) <= p.first_char + length(p.content))
  select id, question, answer, context_id, split_id, start::int as start from lab left join hit using (id)"""
SQUAD_GOLD = f"""{SQUAD_PASSAGES},
  lab as (
    select id, question, md5(context) as context_id, {squeeze('answer')} as answer,
      length({squeeze('before')}) + case when regexp_matches(before, '\\s$') and {squeeze('before')} <> '' then 1 else 0 end as at
    from (select *, substring(context, 1, instr(context, answer) - 1) as before from sq where answer is not null)),
  placed_ as (
    select l.id, p.context_id || '-' || p.split_id as uid from lab l join sqp p using (context_id)
    where l.at >= p.first_char and l.at + length(l.answer) <= p.first_char + length(p.content)),
  labels_ as (
    select id as q, question as query, answer, uid from lab left join placed_ using (id)
    union all select id, question, '', null from sq where answer is null),
  items as (select distinct q, query from labels_),
  units as (select context_id || '-' || split_id as uid, content from sqp),
  sqdocs as (select uid as doc_id, content as text from units),
  {WORD_DF.replace("from documents", "from sqdocs")}"""
ORACLE["squad_eval"] = f"""
  with {SQUAD_GOLD}, {INDEX}, {BM25}, {ranked('bm', 5, 'hits')},
  retrieved as (select hits.*, content, query from hits join units using (uid) join items using (q)),
  {spans()}, answered as (select * from labels_ where answer <> ''),
  rel as (
    select r.q, r.rank, max(case when contains(r.content, l.answer) then 1 else 0 end) as rel
    from retrieved r join answered l using (q) group by r.q, r.rank), {per_query()},
  gold as (select distinct q, uid from answered where uid is not null),
  multi as (
    select q, avg(case when (q, uid) in (select (q, uid) from hits) then 1.0::double else 0 end) as recall_multi_hit
    from gold group by q),
  {overlap('read_', 'answered')}, {best('scored', 'answered', 'best')}
  select 'Retriever' as node, * from ({long_metrics('per_query', FOUR)} union all {long_metrics('multi', ['recall_multi_hit'])})
  union all select 'Reader', * from ({reader_values('best')})"""
ORACLE["squad_reader_eval"] = f"""
  with {SQUAD_GOLD},
  given as (select distinct q, query, uid, content from labels_ join units using (uid)),
  {spans('given')},
  with_none as (
    select q, uid, sent, answer, start, score from spans
    union all select q, null, null, null, null, 6.5::double from items),
  none_read as (select * from (
      select *, row_number() over (partition by q order by score desc, uid nulls last, sent nulls last)::int as rank
      from with_none) where rank <= 4),
  {READER_EVAL}"""
ORACLE["question_list"] = f"with {DIALOGUE} select {squeeze('question')} as question from dialogue"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


LOG = f"""{DIALOGUE},
  logged as (
    select conv_id * 1000000 + turn as doc, {strip('question')} as question,
      list_transform(case when length(reply) < length(question) then []
        when len({sentences('reply')}) > 1 then [trim(({sentences('reply')})[1]), reply]
        else [reply] end, lambda a: {strip('a')}) as answers,
      case when length(question) * 4 > length(reply) then 100::double / (length(reply) + 1)
        else (length(reply) + 1) / 100 end as spi,
      length(question) / 10 as bps
    from dialogue)"""
ORACLE["qa_log_parse"] = f"""
  with {LOG} select doc, 0 as pos, question, array_to_string(answers, '|') as answers, len(answers)::int as n from logged"""
ORACLE["count_pairs"] = f"with {DIALOGUE} select count(*) as n from dialogue"
ORACLE["log_throughput"] = f"""
  with {LOG} select doc, {round6('spi')} as seconds_per_item, bps as batches_per_second from logged"""
ORACLE["log_throughput_summary"] = f"""
  with {LOG} select count(*) as blocks, min(bps) as slowest, {round6('avg(bps)')} as mean, max(bps) as fastest,
    {round6('sum(spi)')} as total_seconds from logged"""
ORACLE["pair_quality"] = f"""
  with {LOG}
  select doc, 0 as pos, question not like '%?' as no_question_mark, len(answers) = 0 as no_answer,
    len(answers) > 1 as many_answers,
    row_number() over (partition by lower(regexp_replace(trim(question), '\\s+', ' ', 'g')) order by doc) > 1 as repeated
  from logged"""
ORACLE["index_write"] = f"with {windows(200)} select uid as id, content from passages"
ORACLE["index_upsert"] = f"""
  with {windows(200)}
  select uid as id, case when lang = 'en' then substring(content, 1, 100) else content end as content from passages"""
ORACLE["index_delete"] = "select doc_id, lang from documents where lang <> 'de'"
ORACLE["index_scan"] = "select vec_id, label from embeddings"
ORACLE["index_first"] = f"""
  with {windows(200)}
  select uid as id, content, (select count(*) from passages) as n from passages order by uid limit 1"""
ORACLE["export_csv"] = f"with {DIALOGUE} select * from dialogue"
ORACLE["export_json"] = ORACLE["export_csv"]
ORACLE["eval_save_load"] = f"with {REL}, {per_query()} {long_metrics('per_query', FOUR)}"
ORACLE["eval_rescored"] = f"""
  with {scoped('uid').replace(GOLD, f"{GOLD}, {WORD_DF}, {spans()}, {overlap('read_', 'answered')}, {best('scored', 'answered', 'best')}")}
  select 'Retriever' as node, 'document_id' as scope, metric, value from metrics
  where answer_scope = 'any' and document_scope = 'document_id'
  union all select 'Retriever', 'context', metric, value from metrics
  where answer_scope = 'any' and document_scope = 'context'
  union all select 'Reader', 'any', metric, value from ({reader_values('best')})"""

# --- tabular analytics and streams ------------------------------------------------------------------

ORACLE["read_limited"] = "select event_id, ts, value from events order by event_id limit 10000"
ORACLE["read_limited_csv"] = """
  select least(5000, count(*))::bigint as n_rows, least(5000, count(*))::bigint as n_known from events"""
ORACLE["lowercase_columns"] = "select event_id, value from events"
ORACLE["parse_timestamp"] = """
  select event_id, case when event_type <> 'error' then strftime(ts, '%Y-%m-%d %H:%M:%S') end as parsed from events"""
ORACLE["hour_histogram"] = """
  select h::int as hour, count(event_id) as n from range(24) r(h) left join events on hour(ts) = h group by h"""
ORACLE["filter_hour"] = "select event_id, event_type from events where hour(ts) = 17"
ORACLE["upload_stream"] = ORACLE["split_sentences"]
ORACLE["upload_pairs"] = ORACLE["qa_generation"]
