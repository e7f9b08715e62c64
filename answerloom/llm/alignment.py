r"""Alignment of two tokenizers by composing fragments.

Tokenizer A sees a space and the text, tokenizer B the text, to which it adds the space itself; so both cut the same
bytes. Byte offsets where tokens of both end close a group. A fragment is what a range of bytes knows of the groups: an
open prefix (the tokens up to its first common end), closed groups, and an open suffix (the tokens behind the last one);
a token belongs to the range that holds its end. Fragments compose: suffix and prefix that meet make one group. Composing is
associative, which serves twice. Words that both tokenizers cut off for certain are fragments without open ends; they
are aligned once and remembered. And texts of more than ``LONG`` bytes are cut into ranges of ``CHUNK`` bytes wherever
these fall; their fragments are made by different tasks and composed in a tree, ``FAN`` at a time.

A range carries the words across its borders whole, so its tokens are those of the whole text; where such a word has more than
``LONG_WORD`` bytes the border moves behind it instead. A word ends where white space other than inside a run of it
begins with a space or a line break, and in front of a mark behind Latin letters: neither tokenizer has a token across these
places (checked for B's pieces; A's splitter lets neither white space nor marks follow letters in a token).

A group's only link is between its last tokens, as only these end together. Links are counted per pair of ids over the
whole corpus: pairs with at least one of ``HOT`` of all links, of which there are at most ``HOT``, are broadcast; the links
of the other pairs are shuffled by pair, none of which is hot.

Defined cases: null and empty texts, and texts that one of the tokenizers does not give back byte by byte, have no tokens
(a text with one bad range is bad as a whole); strings of special tokens are plain text; rows that repeat are counted
each; null ids pass through; ties for a B id's highest count are all best; an empty table gives an empty result. Only
doc_id and text are read.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom.llm.texts import bounded_batches, remembers, strings, table
from answerloom.session import stage

SPACE = "▁"
CHUNK = 1 << 16
LONG = 3 << 15
LONG_WORD = 4096
FAN = 8
HOT = 1 << 19
WORDS_HELD = 150_000
WORD_BYTES = 64
COUNTED = 1 << 21
WORD = r"\s*\S+(?:[^\S \n]\s*\S*)*|\s+"
# Latin letters, and marks that may stand behind a word.
LETTERS = "a-zA-ZÀ-ÖØ-öø-ÿ"
MARKS = ".,;:!?"
# A space or line break behind a character that is no white space. The UTF-8 forms of Unicode's white space.
BORDER = re.compile(
    rb"(?<=[!-~\x80-\xbf])(?<!\xc2[\x85\xa0])(?<!\xe1\x9a\x80)(?<!\xe2\x80[\x80-\x8a\xa8\xa9\xaf])(?<!\xe2\x81\x9f)"
    rb"(?<!\xe3\x80\x80)[ \n]"
)


def public_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write a byte as a character: printable Latin ones as themselves, others from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters = {chr(b): b for b in shown}
    hidden = [b for b in range(256) if b not in set(shown)]
    return letters | {chr(256 + k): b for k, b in enumerate(hidden)}


def group(a: list[int], b: list[int]) -> bytes:
    return f"{','.join(map(str, a))}|{','.join(map(str, b))}".encode()


@dataclass(frozen=True)
class Fragment:
    """``head``: ids of A and B up to the first common end, or all if there is none (``closed`` false). An empty head
    of a closed fragment tells that the fragment begins at a common end."""

    closed: bool = False
    head: tuple[tuple[int, ...], tuple[int, ...]] = ((), ())
    body: bytes = b""
    tail: tuple[tuple[int, ...], tuple[int, ...]] = ((), ())

    def then(self, other: Fragment) -> Fragment:
        join = lambda x, y: (x[0] + y[0], x[1] + y[1])
        if not self.closed:
            return Fragment(other.closed, join(self.head, other.head), other.body, other.tail)
        if not other.closed:
            return Fragment(True, self.head, self.body, join(self.tail, other.head))
        middle = join(self.tail, other.head)
        parts = [self.body, group(*middle) if middle != ((), ()) else b"", other.body]
        return Fragment(True, self.head, b";".join(p for p in parts if p), other.tail)

    def groups(self) -> bytes:
        """All groups, for a fragment of a whole text."""
        ends = [group(*x) if x != ((), ()) else b"" for x in (self.head, self.tail)]
        return b";".join(p for p in (ends[0], self.body, ends[1]) if p)


def fragment(a: list[int], a_ends: list[int], b: list[int], b_ends: list[int]) -> tuple[Fragment, list[int]]:
    """The fragment of tokens that end in one range, and the places (in ``a``, then in ``b``) of the linked ones."""
    at = {e: k for k, e in enumerate(b_ends)}
    linked = [(i, at[e]) for i, e in enumerate(a_ends) if e in at]
    if not linked:
        return Fragment(False, (tuple(a), tuple(b))), []
    (i, k), (m, n) = linked[0], linked[-1]
    body = b";".join(group(a[x + 1 : p + 1], b[y + 1 : q + 1]) for (x, y), (p, q) in zip(linked, linked[1:]))
    made = Fragment(True, (tuple(a[: i + 1]), tuple(b[: k + 1])), body, (tuple(a[m + 1 :]), tuple(b[n + 1 :])))
    return made, linked


class Aligner:
    """Two tokenizers and the words aligned so far: up to ``WORDS_HELD``, and as many of those used before."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = byte_letters()
        entries = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.size_a = max(entries) + 1
        self.size_b = self.b.get_piece_size()
        self.raw_a = [bytes(letters.get(c, 0) for c in entries.get(i, "")) for i in range(self.size_a)]
        texts = [self.b.id_to_piece(i) for i in range(self.size_b)]
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in texts):
            raise ValueError("a piece goes on behind white space or holds a line break; words are not independent in this model")
        free = re.escape("".join(m for m in MARKS if not any(re.search(f"[{LETTERS}]{re.escape(m)}", p) for p in texts)))
        self.word = re.compile((rf"\s*[{LETTERS}]++(?=[{free}])|" if free else "") + WORD)
        self.raw_b = [
            bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(texts)
        ]
        self.length_a = np.array([len(x) for x in self.raw_a], np.int64)
        self.length_b = np.array([len(x) for x in self.raw_b], np.int64)
        self.name_a = [str(i) for i in range(self.size_a)]
        self.name_b = [str(i) for i in range(self.size_b)]
        self.code = code_type(self.size_a, self.size_b)
        self.known: dict[str, tuple | None] = {}
        self.before: dict[str, tuple | None] = {}

    def tokens(self, words: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and B of whole words, each as it is cut in a text: B writes its own space for the one in front."""
        a = [e.ids for e in self.a.encode_batch_fast(words, add_special_tokens=False)]
        # Behind a line break nothing is added; B's own space in front of the break, and the break, are pieces of their own.
        own = [w[0] == " " and len(w) > 1 for w in words]
        b = self.b.encode([w[1:] if x else "\n" + w for w, x in zip(words, own)], num_threads=1)
        return a, [ids if x else ids[2:] for x, ids in zip(own, b)]

    def intact(self, word: bytes, a: list[int], b: list[int]) -> bool:
        return b"".join(map(self.raw_a.__getitem__, a)) == word == b"".join(map(self.raw_b.__getitem__, b))

    def align_words(self, words: list[str]) -> dict[str, tuple | None]:
        """(groups, codes of the links, tokens of A and (above 32 bits) of B) of each word; None for those not given back."""
        if not words:
            return {}
        a, b = self.tokens(words)
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        good = [self.intact(w, x, y) for w, x, y in zip(raw, a, b)]
        out: dict[str, tuple | None] = {w: None for w, g in zip(words, good) if not g}
        words, a, b = ([x for x, g in zip(part, good) if g] for part in (words, a, b))
        if not words:
            return out
        ids_a = np.array([i for x in a for i in x], np.int64)
        ids_b = np.array([i for x in b for i in x], np.int64)
        ends_a, ends_b = np.cumsum(self.length_a[ids_a]), np.cumsum(self.length_b[ids_b])
        common, at_a, at_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        codes = (ids_a[at_a] * self.size_b + ids_b[at_b]).astype(self.code)
        # One piece of text for each token: its id and what separates it from the next.
        closes_a, closes_b = np.zeros(len(ids_a), bool), np.zeros(len(ids_b), bool)
        closes_a[at_a], closes_b[at_b] = True, True
        name_a, name_b = self.name_a, self.name_b
        text_a = [name_a[i] + ("|" if c else ",") for i, c in zip(ids_a.tolist(), closes_a.tolist())]
        text_b = [name_b[i] + (";" if c else ",") for i, c in zip(ids_b.tolist(), closes_b.tolist())]
        place_a = np.searchsorted(common, ends_a) * 2
        place_b = np.searchsorted(common, ends_b) * 2 + 1
        order = np.argsort(np.concatenate([place_a, place_b]), kind="stable").tolist()
        both = text_a + text_b
        ordered = [both[k] for k in order]
        last_a, last_b = np.cumsum([len(x) for x in a]), np.cumsum([len(x) for x in b])
        links = (np.searchsorted(common, ends_a[last_a - 1]) + 1).tolist()
        tokens = (last_a + last_b).tolist()
        data, width, t, k = codes.tobytes(), codes.itemsize, 0, 0
        for word, x, y, to, link in zip(words, a, b, tokens, links):
            body = "".join(ordered[t:to])[:-1].encode()
            out[word] = (body, data[k * width : link * width], len(x) | len(y) << 32)
            t, k = to, link
        return out

    def aligned(self, parts: set[str]) -> dict[str, tuple | None]:
        """What is known of words, after those not seen before were aligned."""
        if len(self.known) > WORDS_HELD:
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        new = parts.difference(known)
        again = new.intersection(before)
        known.update((w, before[w]) for w in again)
        made = self.align_words(list(new - again))
        long = {w: x for w, x in made.items() if len(w) > WORD_BYTES}
        known.update((w, x) for w, x in made.items() if len(w) <= WORD_BYTES)
        return {**known, **long} if long else known

    def partial(self, word: str, start: int, low: int, high: int):
        """(fragment, codes, tokens) of the tokens of a word at ``start`` that end in (low, high]; None if it is bad."""
        (a,), (b,) = self.tokens([word])
        if not self.intact(word.encode("utf-8", "surrogatepass"), a, b):
            return None
        own = []
        for ids, length in ((a, self.length_a), (b, self.length_b)):
            ends = start + np.cumsum(length[ids])
            mine = (ends > low) & (ends <= high)
            own += [np.array(ids)[mine].tolist(), ends[mine].tolist()]
        made, linked = fragment(*own)
        codes = np.array([own[0][i] * self.size_b + own[2][k] for i, k in linked], self.code)
        return made, codes.tobytes(), len(own[0]) | len(own[2]) << 32


def code_type(size_a: int, size_b: int) -> str:
    """Numbers that hold a pair of ids."""
    return "<u4" if size_a * size_b < 1 << 32 else "<u8"


@functools.cache
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


remembers(aligner.cache_clear)


COUNTS = (1 << 32) - 1


def _whole(batches, paths, keep_groups: bool):
    model = aligner(*paths)
    for batch in batches:
        split = [model.word.findall(" " + x) if x else [] for x in strings(batch["text"])]
        known = model.aligned(set().union(*split))
        n_a, n_b, codes, digests, groups = [], [], [], [], []
        for parts in split:
            found = [known[w] for w in parts]
            if not found or None in found:
                found = []
            text = b";".join([x[0] for x in found])
            counts = sum([x[2] for x in found])
            n_a.append(counts & COUNTS)
            n_b.append(counts >> 32)
            codes.append(b"".join([x[1] for x in found]))
            digests.append(hashlib.sha256(text).hexdigest() if found else "")
            if keep_groups:
                groups.append(text.decode())
        made = [pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array(codes, pa.binary()), pa.array(digests)]
        made += [pa.array(groups, pa.string())] * keep_groups
        names = ["row", "doc_id", "n_a", "n_b", "codes", "groups_sha256"] + ["groups"] * keep_groups
        yield pa.record_batch([batch["row"], batch["doc_id"], *made], names=names)


def ranges(data: bytes, size: int) -> list[tuple[int, int, int, int]]:
    """(begin, low, high, stop): the range (low, high], and the words across its borders, which begin and stop there."""
    borders = [(0, 0, 0)]  # (begin of the word across, border, end of that word)
    at = size
    while at < len(data):
        near = [m.start() for m in BORDER.finditer(data, max(at - LONG_WORD, 0), at + 1)]
        next_one = BORDER.search(data, at)
        end = next_one.start() if next_one else len(data)
        if not near or end - at > LONG_WORD:
            at, begin = end, end
        else:
            begin = near[-1]
        if at < len(data):
            borders.append((begin, at, end))
        at = (at // size + 1) * size
    borders.append((len(data), len(data), len(data)))
    return [(x[0], x[1], y[1], y[2]) for x, y in zip(borders, borders[1:])]


def _cut(batches, size: int):
    for batch in batches:
        for row, doc_id, text in zip(batch["row"], batch["doc_id"], strings(batch["text"])):
            data = b" " + text.encode()
            for k, (begin, low, high, stop) in enumerate(ranges(data, size)):
                columns = [pa.array([row.as_py()], pa.int64()), pa.array([doc_id.as_py()], doc_id.type), pa.array([k], pa.int64())]
                columns += [pa.array([data[begin:stop]], pa.binary()), pa.array([low - begin], pa.int64()), pa.array([high - begin], pa.int64())]
                yield pa.record_batch(columns, names=["row", "doc_id", "chunk", "data", "low", "high"])


FRAGMENT = "ok boolean, closed boolean, head_a array<int>, head_b array<int>, body binary, tail_a array<int>, tail_b array<int>, n_a long, n_b long, n_links long"
PARTS = pa.list_(pa.int32())


def _columns(ok: bool, x: Fragment, counts: int, links: int) -> list[pa.Array]:
    values = [
        pa.array([ok]), pa.array([x.closed]), pa.array([x.head[0]], PARTS), pa.array([x.head[1]], PARTS),
        pa.array([x.body], pa.binary()), pa.array([x.tail[0]], PARTS), pa.array([x.tail[1]], PARTS),
    ]
    return values + [pa.array([n], pa.int64()) for n in (counts & COUNTS, counts >> 32, links)]


FRAGMENT_NAMES = [x.split()[0] for x in FRAGMENT.split(", ")]


def range_fragment(model: Aligner, data: bytes, low: int, high: int):
    """(whether all is given back, fragment, codes, tokens) of the tokens that end in (low, high] of ``data``."""
    parts = model.word.findall(data.decode())
    sizes = [len(w.encode()) for w in parts]
    ends = np.cumsum(sizes)
    inside = {w for w, n, e in zip(parts, sizes, ends.tolist()) if e - n >= low and e <= high}
    known = model.aligned(inside)
    total, codes, counts, run = Fragment(), [], 0, []

    def closed():
        return Fragment(True, body=b";".join(run)) if run else Fragment()

    for w, n, e in zip(parts, sizes, ends.tolist()):
        if e <= low or e - n >= high:
            continue
        if e - n >= low and e <= high:
            if known[w] is None:
                return False, Fragment(), b"", 0
            run.append(known[w][0])
            codes.append(known[w][1])
            counts += known[w][2]
        else:
            made = model.partial(w, e - n, low, high)
            if made is None:
                return False, Fragment(), b"", 0
            total, run = total.then(closed()).then(made[0]), []
            codes.append(made[1])
            counts += made[2]
    return True, total.then(closed()), b"".join(codes), counts


def _fragments(batches, paths):
    model = aligner(*paths)
    width = np.dtype(model.code).itemsize
    for batch in batches:
        for k in range(batch.num_rows):
            data, low, high = (batch[c][k].as_py() for c in ("data", "low", "high"))
            ok, made, codes, counts = range_fragment(model, data, low, high)
            columns = [batch[c].slice(k, 1) for c in ("row", "doc_id", "chunk")] + _columns(ok, made, counts, len(codes) // width)
            yield pa.record_batch([*columns, pa.array([codes], pa.binary())], names=["row", "doc_id", "chunk", *FRAGMENT_NAMES, "codes"])


def _composed(rows: pa.Table) -> pa.Table:
    """One fragment of up to ``FAN`` that follow each other."""
    rows = rows.sort_by("chunk")
    total, ok, counts, links = Fragment(), True, 0, 0
    for r in rows.select(["ok", *FRAGMENT_NAMES[1:]]).to_pylist():
        ok &= r["ok"]
        heads, tails = ((tuple(r[f"{c}_a"]), tuple(r[f"{c}_b"])) for c in ("head", "tail"))
        total = total.then(Fragment(r["closed"], heads, r["body"], tails))
        counts += r["n_a"] | r["n_b"] << 32
        links += r["n_links"]
    first = rows.slice(0, 1)
    columns = [first["row"], first["doc_id"], pa.array([rows["chunk"][0].as_py() // FAN], pa.int64())]
    return pa.table(columns + _columns(ok, total, counts, links), names=["row", "doc_id", "chunk", *FRAGMENT_NAMES])


def _finished(batches, keep_groups: bool):
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            whole = Fragment(r["closed"], (tuple(r["head_a"]), tuple(r["head_b"])), r["body"], (tuple(r["tail_a"]), tuple(r["tail_b"])))
            text = whole.groups() if r["ok"] else b""
            out.append((r["n_a"] * r["ok"], r["n_b"] * r["ok"], r["n_links"] * r["ok"], hashlib.sha256(text).hexdigest() if text else "", text.decode()))
        n_a, n_b, links, digests, groups = zip(*out) if out else ((),) * 5
        columns = [pa.array(x, pa.int64()) for x in (n_a, n_b, links)] + [pa.array(digests, pa.string())]
        columns += [pa.array(groups, pa.string())] * keep_groups
        names = ["row", "doc_id", "n_a", "n_b", "n_links", "groups_sha256"] + ["groups"] * keep_groups
        yield pa.record_batch([batch["row"], batch["doc_id"], *columns], names=names)


def compose(fragments: DataFrame, kind: str) -> DataFrame:
    """One fragment per row id, composed ``FAN`` at a time; ``fragments`` is stored."""
    schema = f"row long, doc_id {kind}, chunk long, {FRAGMENT}"
    left = fragments.agg(F.max("chunk")).first()[0] or 0
    current = fragments.select("row", "doc_id", "chunk", *FRAGMENT_NAMES)
    while left > 0:
        current = current.groupBy("row", F.expr(f"chunk div {FAN}").alias("part")).applyInArrow(_composed, schema)
        left //= FAN
    return current


@dataclass
class Aligned:
    """``texts``: row, doc_id, n_a, n_b, n_links, groups_sha256 and, if kept, groups. ``links``: row, codes; a text may
    have several rows there. Both are stored. ``code`` is the type of the numbers in codes, a * ``size_b`` + b."""

    texts: DataFrame
    links: DataFrame
    size_a: int
    size_b: int

    @property
    def code(self) -> str:
        return code_type(self.size_a, self.size_b)


def align(
    docs: DataFrame, paths: tuple[str, str] | None = None, keep_groups: bool = False, long: int = LONG, chunk: int = CHUNK
) -> Aligned:
    """Tokens, groups and links of every text of ``docs`` (doc_id, text)."""
    import sentencepiece
    from tokenizers import Tokenizer

    paths = paths or public_paths()
    size_a = max(Tokenizer.from_file(paths[0]).get_vocab(with_added_tokens=True).values()) + 1
    size_b = sentencepiece.SentencePieceProcessor(model_file=paths[1]).get_piece_size()
    width = np.dtype(code_type(size_a, size_b)).itemsize
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    is_long = F.coalesce(F.octet_length("text"), F.lit(0)) > long
    extra, named = ", groups string" * keep_groups, ["groups"] * keep_groups
    short = stage(
        rows.where(~is_long).mapInArrow(
            functools.partial(_whole, paths=paths, keep_groups=keep_groups),
            f"row long, doc_id {kind}, n_a long, n_b long, codes binary, groups_sha256 string" + extra,
        ),
        "aligned",
    )
    cut = rows.where(is_long).mapInArrow(
        functools.partial(_cut, size=chunk), f"row long, doc_id {kind}, chunk long, data binary, low long, high long"
    )
    spread = cut.repartition(docs.sparkSession.sparkContext.defaultParallelism * 4, "row", "chunk")
    fragments = stage(
        spread.mapInArrow(
            functools.partial(_fragments, paths=paths), f"row long, doc_id {kind}, chunk long, {FRAGMENT}, codes binary"
        ),
        "fragments",
    )
    finished = stage(
        compose(fragments, kind).mapInArrow(
            functools.partial(_finished, keep_groups=keep_groups),
            f"row long, doc_id {kind}, n_a long, n_b long, n_links long, groups_sha256 string" + extra,
        ),
        "composed",
    )
    links = F.expr(f"cast(octet_length(codes) div {width} as bigint)").alias("n_links")
    columns = ["row", "doc_id", "n_a", "n_b", "n_links", "groups_sha256", *named]
    texts = short.select("row", "doc_id", "n_a", "n_b", links, "groups_sha256", *named).unionByName(finished.select(*columns))
    good = finished.where("n_links > 0").select("row")
    of_long = fragments.select("row", "codes").join(good, "row", "left_semi")
    return Aligned(texts, short.select("row", "codes").where("octet_length(codes) > 0").unionByName(of_long), size_a, size_b)


def _counted(batches, code: str):
    """Links per pair, summed until some ``COUNTED`` are held."""
    held, n = [], 0

    def out():
        codes, counts = np.unique(np.concatenate(held), return_counts=True)
        return pa.record_batch([pa.array(codes.astype(np.int64)), pa.array(counts.astype(np.int64))], names=["code", "n"])

    for batch in batches:
        x = np.frombuffer(b"".join(batch["codes"].to_pylist()), code)
        held.append(x)
        n += len(x)
        if n >= COUNTED:
            yield out()
            held, n = [], 0
    if n:
        yield out()


def pair_counts(aligned: Aligned) -> DataFrame:
    """(code, a, b, n, best): how many links hold each pair of ids, and whether that is the most for its b; stored."""
    parts = aligned.links.select("codes").mapInArrow(functools.partial(_counted, code=aligned.code), "code long, n long")
    sums = parts.groupBy("code").agg(F.sum("n").alias("n"))
    size = F.lit(aligned.size_b)
    sums = stage(sums.select("code", F.expr(f"code div {aligned.size_b}").alias("a"), (F.col("code") % size).alias("b"), "n"), "pairs")
    # At most as many rows as B has ids.
    most = F.broadcast(sums.groupBy("b").agg(F.max("n").alias("most")))
    return stage(sums.join(most, "b").select("code", "a", "b", "n", (F.col("n") == F.col("most")).alias("best")), "pair-counts")


def _summed(batches, shared, code: str):
    hot, counts, best = shared.value
    for batch in batches:
        data = batch["codes"].to_pylist()
        x = np.frombuffer(b"".join(data), code).astype(np.int64)
        ends = np.cumsum([0, *(len(d) // np.dtype(code).itemsize for d in data)])
        at = np.minimum(np.searchsorted(hot, x), max(len(hot) - 1, 0))
        found = hot[at] == x if len(hot) else np.zeros(len(x), bool)
        sums = []
        for values in (counts, best):
            total = np.concatenate([[0], np.cumsum(np.where(found, values[at], 0) if len(hot) else np.zeros(len(x), np.int64))])
            sums.append(pa.array(total[ends[1:]] - total[ends[:-1]], pa.int64()))
        left = np.concatenate([[0], np.cumsum(~found)])[ends].astype(np.int32)
        cold = pa.ListArray.from_arrays(pa.array(left), pa.array(x[~found]))
        yield pa.record_batch([batch["row"], *sums, cold], names=["row", "count_sum", "n_best", "cold"])


def link_sums(aligned: Aligned, pairs: DataFrame, hot: int = HOT) -> DataFrame:
    """(row, count_sum, n_best): over each text's links, the sum of their pairs' counts and how many are their b's best."""
    spark = pairs.sparkSession
    limit = -(-(pairs.agg(F.sum("n")).first()[0] or 0) // hot)
    found = pairs.where(F.col("n") >= max(limit, 1)).select("code", "n", F.col("best").cast("long").alias("best")).toArrow()
    found = found.sort_by("code")
    shared = spark.sparkContext.broadcast(tuple(found[c].to_numpy().astype(np.int64) for c in ("code", "n", "best")))
    sums = stage(
        aligned.links.mapInArrow(
            functools.partial(_summed, shared=shared, code=aligned.code), "row long, count_sum long, n_best long, cold array<long>"
        ),
        "link-sums",
    )
    rare = sums.select("row", F.explode("cold").alias("code")).join(pairs.select("code", "n", "best"), "code")
    rare = rare.select("row", F.col("n").alias("count_sum"), F.col("best").cast("long").alias("n_best"))
    both = sums.select("row", "count_sum", "n_best").unionByName(rare)
    return both.groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))


def op12_tokenizer_alignment(spark, sf_dir):
    found = align(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sums = link_sums(found, pair_counts(found))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return found.texts.join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", zero("n_best"), zero("count_sum"), "groups_sha256"
    )
