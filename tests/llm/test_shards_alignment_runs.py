"""Sharding, tokenizer alignment and periodic runs against brute force and in their corner cases."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from answerloom.llm import alignment, runs, sharding

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids, null, empty, long and repeated texts, columns with clashing names."""
    words = " ".join(random.Random(k).choice(["alpha", "beta", "gamma", "don't", "12,5"]) for k in range(4000))
    texts = [None, "", "  \n\t ", "one", "the the the the the the", "ab cd " * 9, words, words, "日本語 ſ x\x85y z ", "<|endoftext|> <s>", "▁odd", "q" * 9000]
    rows = [(k, x, "c", "c", "c", 1, "c") for k, x in enumerate(texts)]
    rows += [(None, "null id a b a b a b a b", "c", "c", "c", 1, "c"), (6, words, "c", "c", "c", 1, "c"), (3, "other", "c", "c", "c", 1, "c")]
    names = "doc_id long, text string, row string, runs string, shard string, size int, groups string"
    return spark.createDataFrame(rows, names).repartition(3)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


# sharding


def checked(rows, shards):
    """Sizes of the shards, once slots are known to be gapless."""
    sizes = [0] * shards
    for shard in range(shards):
        own = [r for r in rows if r.shard == shard]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        sizes[shard] = sum(r["size"] for r in own)
    return sizes


def test_shards_hold_every_row_once_and_alike(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sharding.assign(docs, 8, keep=["doc_id"]).collect()
    want = {r.doc_id: len((r.text or "").encode()) + 1 for r in docs.collect()}
    assert {r.doc_id: r["size"] for r in rows} == want and len(rows) == len(want)
    sizes = checked(rows, 8)
    assert max(sizes) - min(sizes) < 0.01 * np.mean(sizes)


def test_one_more_shard_moves_few_rows(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 90).cast("int")).alias("text"))
    before, after = ({r.doc_id: r.shard for r in sharding.assign(docs, n, keep=["doc_id"]).collect()} for n in (8, 9))
    moved = sum(before[k] != after[k] for k in before)
    assert sum(s == 8 for s in after.values()) > 1500
    assert moved < 0.3 * len(before)  # a remainder of hashes would move eight ninths


def test_hot_key_runs_over(spark):
    docs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.lit("same text").alias("text"))
    rows = sharding.assign(docs.withColumn("doc_id", F.when(F.col("doc_id") != 8, F.col("doc_id"))), 8).collect()
    sizes = checked(rows, 8)
    assert len(rows) == 3000 and max(sizes) - min(sizes) <= 4 * 10
    assert len({r.shard for r in rows if r.doc_id == 7}) >= 3


def test_ring_places_by_hand():
    points = [(10, 0), (20, 1), (30, 2)]
    # shard 0 is full after its own 4 of 12 bytes; the rest of arc 0 goes on to shard 1, then 2
    assert sharding.plan([(2, 0, 9), (1, 1, 2), (1, 2, 1)], points, 3, 0.0) == [(2, 0, 0, 0), (2, 0, 4, 1), (2, 0, 8, 2), (1, 1, 0, 2), (1, 2, 0, 2)]
    assert len({p for p, _ in sharding.ring(9)}) == 9 * sharding.NODES
    kept = [x for x in sharding.ring(9) if x[1] < 8]
    assert kept == sharding.ring(8)


def test_shards_of_odd_rows(odd, empty, tmp_path):
    rows = sharding.assign(odd, 4).collect()
    assert collections.Counter((r.doc_id, r["size"], r.groups, r.row) for r in rows) == collections.Counter(
        (r.doc_id, len((r.text or "").encode()) + 1, "c", "c") for r in odd.collect()
    )
    checked(rows, 4)
    assert sharding.assign(empty, 4).count() == 0
    sharding.write_shards(odd.drop("shard", "size"), str(tmp_path / "out"), 4)
    back = odd.sparkSession.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, back.select("doc_id", "text").collect())) == sorted(map(str, odd.select("doc_id", "text").collect()))


# alignment


@pytest.fixture(scope="module")
def model():
    return alignment.aligner(*alignment.public_paths())


def aligned_by_hand(model, text):
    """(ids of A, ids of B, groups, links) of a whole text; None if it has no tokens."""
    if not text:
        return None
    data = (" " + text).encode()
    a, b = model.a.encode(" " + text, add_special_tokens=False).ids, model.b.encode(text)
    if b"".join(model.raw_a[i] for i in a) != data or b"".join(model.raw_b[i] for i in b) != data:
        return None
    ends = [np.cumsum([len(raw[i]) for i in ids]).tolist() for raw, ids in ((model.raw_a, a), (model.raw_b, b))]
    groups, links, x, y = [], [], 0, 0
    for e in sorted(set(ends[0]) & set(ends[1])):
        i, k = ends[0].index(e, x) + 1, ends[1].index(e, y) + 1
        groups.append(f"{','.join(map(str, a[x:i]))}|{','.join(map(str, b[y:k]))}")
        links.append((a[i - 1], b[k - 1]))
        x, y = i, k
    return a, b, ";".join(groups), links


def by_ranges(model, text, size):
    data = (" " + text).encode()
    fragments, codes, counts = [], b"", 0
    for begin, low, high, stop in alignment.ranges(data, size):
        ok, made, c, n = alignment.range_fragment(model, data[begin:stop], low - begin, high - begin)
        if not ok:
            return None
        fragments.append(made)
        codes, counts = codes + c, counts + n
    return fragments, np.frombuffer(codes, model.code).astype(np.int64), counts


def folded(fragments, rng):
    """Composed in any order of neighbours."""
    while len(fragments) > 1:
        k = rng.randrange(len(fragments) - 1)
        fragments[k : k + 2] = [fragments[k].then(fragments[k + 1])]
    return fragments[0].groups().decode()


def test_ranges_compose_to_the_whole(model, monkeypatch):
    rng = random.Random(3)
    letters = list("abc  \n\t.,;'ſ日本é🎉 　\x00\x1c\x85\r012<>|") + ["<|endoftext|>", "<s>", " the", " dog's", "\n\n", "   ", "ing", "▁"]
    for _ in range(600):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 60)))
        want = aligned_by_hand(model, text)
        monkeypatch.setattr(alignment, "LONG_WORD", rng.choice([3, 8, 30]))
        for size in (7, 20, 1000):
            got = by_ranges(model, text, size)
            assert (got is None) == (want is None)
            if want:
                fragments, codes, counts = got
                assert (counts & alignment.COUNTS, counts >> 32) == (len(want[0]), len(want[1]))
                assert [(c // model.size_b, c % model.size_b) for c in codes.tolist()] == want[3]
                assert folded(fragments, rng) == want[2]


def check_aligned(spark, model, docs, monkeypatch=None, **sizes):
    found = alignment.align(docs, keep_groups=True, **sizes)
    pairs = alignment.pair_counts(found)
    sums = {r.row: r for r in alignment.link_sums(found, pairs, hot=20).collect()}
    rows = docs.collect()
    want = [aligned_by_hand(model, r.text) for r in rows]
    count = collections.Counter(x for w in want if w for x in w[3])
    most = collections.Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    assert {(r.a, r.b): (r.n, r.best) for r in pairs.collect()} == {k: (n, n == most[k[1]]) for k, n in count.items()}
    expected = collections.Counter()
    for r, w in zip(rows, want):
        a, b, groups, links = w or ([], [], "", [])
        best = sum(count[x] == most[x[1]] for x in links)
        digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        expected[r.doc_id, len(a), len(b), len(links), best, sum(count[x] for x in links), groups, digest] += 1
    got = collections.Counter()
    for r in found.texts.collect():
        s = sums.get(r.row)
        got[r.doc_id, r.n_a, r.n_b, r.n_links, s.n_best if s else 0, s.count_sum if s else 0, r.groups, r.groups_sha256] += 1
    assert got == expected


def test_alignment_of_odd_texts(spark, odd, model):
    check_aligned(spark, model, odd, long=200, chunk=64)
    check_aligned(spark, model, odd)


def test_alignment_of_documents(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_aligned(spark, model, docs, long=3000, chunk=500)


def test_alignment_of_nothing(empty):
    found = alignment.align(empty)
    assert found.texts.count() == 0 and alignment.link_sums(found, alignment.pair_counts(found)).count() == 0


# periodic runs


def runs_by_hand(w):
    """(start, length, period): every stretch of each period, unless a shorter period holds it."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and not any(s <= i and e >= j + q for s, e, _ in out):
                out.append((i, j + q, q))
            i = j + 1
    return sorted(((s, e - s, q) for s, e, q in out), key=lambda r: (r[0], r[2]))


def test_runs_of_random_batches():
    rng = random.Random(1)
    for _ in range(300):
        texts = []
        for _ in range(rng.randint(1, 6)):
            w = []
            while rng.random() < 0.8:
                k, kinds = rng.choice([1, 2, 3, 5, 8]), rng.choice([1, 2, 3, 50])
                base = [rng.randrange(kinds) for _ in range(k)]
                w += [base[i % k] for i in range(rng.randint(1, k * 8))]
            texts.append(w)
        ids = np.array([x for w in texts for x in w], np.int64)
        text = np.repeat(np.arange(len(texts)), [len(w) for w in texts])
        first = np.cumsum([0, *map(len, texts)])
        got = [[] for _ in texts]
        for s, e, q in zip(*(x.tolist() for x in runs.runs_of_batch(ids, text))):
            got[text[s]].append((s - first[text[s]], e - s, q))
        assert got == [runs_by_hand(w) for w in texts]


def test_text_made_to_mislead_hashes():
    thue = [0]
    while len(thue) < 4096:
        thue += [1 - x for x in thue]
    words = thue * 2 + [0, 1, 1] * 30
    ids = np.array(words)
    start, end, q = (x.tolist() for x in runs.runs_of_batch(ids, np.zeros_like(ids)))
    assert [(s, e - s, p) for s, e, p in zip(start, end, q)] == runs_by_hand(words)


def test_grammar_symbols_are_equal_stretches():
    rng = random.Random(4)
    ids = np.array([rng.randrange(3) for _ in range(2000)])
    g = runs.Grammar(ids, np.repeat([0, 1], 1000))
    length = (g.high - g.low)[g.symbol]
    for s, at, n in zip(g.symbol.tolist(), g.at.tolist(), length.tolist()):
        assert at + n <= 2000 and (at < 1000) == (at + n <= 1000)
        assert (ids[at : at + n] == ids[g.low[s] : g.high[s]]).all()
    # every gap between words of one text is the middle of one occurrence
    assert sorted((g.at + (g.middle - g.low)[g.symbol]).tolist()) == [k for k in range(1, 2000) if k != 1000]


def test_runs_of_odd_rows(odd, empty):
    got = runs.find_runs(odd, collapse=True)
    assert [c for c in got.columns if c != "n_words"] == ["doc_id", "row", "shard", "size", "groups", "runs", "collapsed"]
    want = collections.Counter()
    for r in odd.collect():
        w = WORD.findall(r.text or "")
        found = runs_by_hand(w) if len(w) < 2000 else None
        gone = {i for s, n, q in found or [] for i in range(s + q, s + n)}
        want[r.doc_id, len(w), str(found), " ".join(x for i, x in enumerate(w) if i not in gone) if found is not None else ""] += 1
    have = collections.Counter()
    for r in got.collect():
        found = [tuple(x) for x in r.runs] if r.n_words < 2000 else None
        have[r.doc_id, r.n_words, str(found), r.collapsed if found is not None else ""] += 1
    assert have == want
    assert runs.find_runs(empty, collapse=True).count() == 0


def test_query_of_runs(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = runs.op13_periodic_runs(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        w = WORD.findall(texts[r.doc_id] or "")
        h = zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = runs_by_hand(w)
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        best = min(found, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
        assert r.n_runs == len(found)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()
