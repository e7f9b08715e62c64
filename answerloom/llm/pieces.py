"""SentencePiece encoding and decoding by suffix-array matching.

The new words of a batch are put into one text. Its suffixes are sorted (as far as the longest piece reaches), every
piece of the vocabulary is found by binary search, and the ranges found are the edges of a graph over the text's
positions. Sorted by position they are relaxed: a piece extends the encoding of what stands before it if the model
itself would leave the two side by side. For merges by score exactly one piece can end the encoding of any prefix, so the
result is that of the library, also for byte-pair models, whose encoding is not the path of the best sum.

White space is a part of pieces, and no piece goes on behind it, nor holds a line break, nor (as is checked for each
mark) a letter with a mark behind. Words cut at such places are independent, and those seen before are remembered, up to
``WORDS_HELD``.

Defined cases: null text is empty and has no ids; characters without a piece become the ids of their UTF-8 bytes; ties in score
go to the left; text of any length is one chain of words; rows that repeat are encoded each; ``decode`` drops null and
unknown ids' text, and ids of broken byte sequences give the replacement character. Other columns pass through
``encode`` and ``decode``; a column named like the output is replaced.
"""

from __future__ import annotations

import functools
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerloom.llm.texts import bounded_batches, remembers, strings, table

SPACE = "▁"
WORDS_HELD = 400_000
PAIRS_HELD = 600_000
LONG_WORD = 64
SEPARATOR, UNKNOWN, FIRST_CODE = 1, 2, 3
# Latin letters, and marks that may stand behind a word.
LETTERS = "a-zA-ZÀ-ÖØ-öø-ÿ"
MARKS = ".,;:!?"


def public_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceModel:
    """The vocabulary of a SentencePiece byte-pair model, with what matching needs of it."""

    def __init__(self, path: str):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        size = processor.get_piece_size()
        special = [
            processor.is_byte(i) or processor.is_control(i) or processor.is_unknown(i) or processor.is_unused(i)
            for i in range(size)
        ]
        self.text = [processor.id_to_piece(i) for i in range(size)]
        self.id = {p: i for i, p in enumerate(self.text) if not special[i]}
        self.score = {p: processor.get_score(i) for p, i in self.id.items()}
        self.byte_id = {int(self.text[i][1:-1], 16): i for i in range(size) if processor.is_byte(i)}
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("a piece goes on behind white space; words are not independent in this model")
        if len(self.byte_id) != 256:
            raise ValueError("the model has no byte pieces to fall back on")
        free = [m for m in MARKS if not any(re.search(f"[{LETTERS}]{re.escape(m)}", p) for p in self.id)]
        marked = f"{SPACE}*[{LETTERS}]++(?=[{re.escape(''.join(free))}])|" if free else ""
        if any("\n" in p for p in self.id):
            raise ValueError("a piece holds a line break; lines are not independent in this model")
        self.word = re.compile(f"{marked}{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n+")
        self.raw = [b"" if special[i] else self.text[i].replace(SPACE, " ").encode() for i in range(size)]
        for value, i in self.byte_id.items():
            self.raw[i] = bytes([value])
        self.raw_bytes = np.frombuffer(b"".join(self.raw), np.uint8)
        self.raw_size = np.array([len(x) for x in self.raw], np.int64)
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size
        letters = sorted({c for p in self.id for c in p})
        self.codes = np.full(0x110000, UNKNOWN, np.uint16)
        self.codes[[ord(c) for c in letters]] = np.arange(FIRST_CODE, FIRST_CODE + len(letters))
        # Pieces that the model's own merges never make are no edges.
        known = [p for p in self.id if len(p) == 1 or self.merged(p) == [p]]
        self.width = max(map(len, known)) + 1  # so that even the longest piece has a bound above it
        rows = np.zeros((len(known), self.width), ">u2")
        sizes = np.array([len(p) for p in known])
        points = np.frombuffer("".join(known).encode("utf-32-le"), np.uint32)
        inside = np.arange(self.width) < sizes[:, None]
        rows[inside] = self.codes[points]
        self.low = rows.view(f"S{2 * self.width}").ravel()
        self.high = np.where(inside, rows, 0xFFFF).astype(">u2").view(f"S{2 * self.width}").ravel()
        self.sizes, self.ids = sizes, np.array([self.id[p] for p in known])
        self.words: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.side_by_side: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """What merging by score makes of a short text: the best pair first, the left one of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = max(
                ((self.score[p], -k) for k in range(len(parts) - 1) if (p := parts[k] + parts[k + 1]) in self.score),
                default=(None, 0),
            )
            if best is None:
                break
            parts[-at : 2 - at] = [parts[-at] + parts[1 - at]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        key = left << 32 | right
        found = self.side_by_side.get(key)
        if found is None:
            if len(self.side_by_side) > PAIRS_HELD:
                self.side_by_side.clear()
            pair = [self.text[left], self.text[right]]
            found = self.side_by_side[key] = self.merged("".join(pair)) == pair
        return found

    def edges(self, codes: np.ndarray) -> tuple[list[int], list[int], list[int]]:
        """(end, start, piece) of every occurrence of a piece, by end, longest first."""
        padded = np.concatenate([codes, np.full(self.width, SEPARATOR, codes.dtype)]).astype(">u2")
        windows = np.lib.stride_tricks.sliding_window_view(padded, self.width)[: len(codes)]
        suffixes = np.ascontiguousarray(windows).view(f"S{2 * self.width}").ravel()
        order = np.argsort(suffixes, kind="stable")
        suffixes = suffixes[order]
        left, right = np.searchsorted(suffixes, self.low), np.searchsorted(suffixes, self.high)
        count = right - left
        which = np.repeat(np.arange(len(count)), count)
        place = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(left, count)
        start = order[place]
        size = self.sizes[which]
        end = start + size
        by = np.argsort(end * (self.width + 1) - size, kind="stable")
        return end[by].tolist(), start[by].tolist(), self.ids[which][by].tolist()

    def encode_words(self, new: list[str]) -> dict[str, bytes]:
        """Ids of words, the white space they start with included."""
        if not new:
            return {}
        joined = "".join(f"{w}\n" for w in new)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = self.codes[points]
        sizes = np.array([len(w) + 1 for w in new])
        stops = np.cumsum(sizes) - 1
        codes[stops] = SEPARATOR
        n = len(codes)
        last, back = [-1] * (n + 1), [0] * (n + 1)
        begins = bytearray(n + 1)
        for k in (stops - sizes + 1).tolist():
            begins[k] = 1
        odd = iter(np.flatnonzero(codes == UNKNOWN).tolist())
        gap = next(odd, n)  # characters without a piece are edges of their own: id -2
        known, compatible = self.side_by_side, self.compatible

        def relax_gaps(until: int) -> None:
            nonlocal gap
            while gap < until:
                last[gap + 1], back[gap + 1] = -2, gap
                gap = next(odd, n)

        for end, start, piece in zip(*self.edges(codes)):
            if gap < end:
                relax_gaps(end)
            if last[end] != -1:
                continue
            before = last[start]
            if begins[start] or before == -2:
                last[end], back[end] = piece, start
            elif before >= 0:
                fits = known.get(before << 32 | piece)
                if fits is None:
                    fits = compatible(before, piece)
                if fits:
                    last[end], back[end] = piece, start
        relax_gaps(n)
        out, byte_id = {}, self.byte_id
        for word, stop, size in zip(new, stops.tolist(), sizes.tolist()):
            ids, at, first = [], stop, stop - size + 1
            while at > first:
                if last[at] >= 0:
                    ids.append(last[at])
                else:
                    ids.extend(byte_id[x] for x in reversed(joined[at - 1].encode("utf-8", "replace")))
                at = back[at]
            ids.reverse()
            out[word] = array("i", ids).tobytes()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as 32-bit numbers in machine order."""
        split = [self.word.findall(SPACE + x.replace(" ", SPACE)) if x else [] for x in texts]
        if len(self.words) > WORDS_HELD:
            self.words, self.before = {}, self.words
        words, before = self.words, self.before
        new = set()
        for parts in split:
            new.update(parts)
        new.difference_update(words)
        again = new.intersection(before)
        words.update((w, before[w]) for w in again)
        new = list(new - again)
        words.update(self.encode_words(new))
        out = [b"".join(map(words.__getitem__, parts)) for parts in split]
        for w in new:
            if len(w) > LONG_WORD:
                del words[w]
        return out

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of the rows that ``offsets`` cut ``ids`` into; unknown ids have no text."""
        ids = np.where((ids >= 0) & (ids < len(self.raw)), ids, 0)
        size = self.raw_size[ids]
        ends = np.cumsum(size)
        shift = self.raw_start[ids] - (ends - size)
        data = self.raw_bytes[np.repeat(shift, size) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        cuts = np.concatenate([[0], ends])[offsets].tolist()
        rows = (data[x:y] for x, y in zip(cuts[:-1], cuts[1:]))
        return [(x[1:] if x[:1] == b" " else x).decode("utf-8", "replace") for x in rows]


@functools.cache
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


remembers(piece_model.cache_clear)


def _replaced(batch: pa.RecordBatch, kept: list[int], name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.record_batch(
        [*(batch.column(k) for k in kept), values], names=[*(batch.schema.names[k] for k in kept), name]
    )


def _encode(batches, path, position, kept):
    model = piece_model(path or public_model())
    for batch in batches:
        ids = model.encode(strings(batch.column(position)))
        offsets = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
        values = pa.array(np.frombuffer(b"".join(ids), np.int32))
        yield _replaced(batch, kept, "ids", pa.ListArray.from_arrays(pa.array(offsets), values))


def _decode(batches, path, position, kept):
    model = piece_model(path or public_model())
    for batch in batches:
        rows = batch.column(position)
        sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
        ids = pc.fill_null(pc.list_flatten(rows), -1).to_numpy(zero_copy_only=False)
        texts = model.decode(ids, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))
        yield _replaced(batch, kept, "decoded", pa.array(texts, pa.string()))


def _mapped(df: DataFrame, fn, source: str, name: str, kind: T.DataType, model: str | None) -> DataFrame:
    bounded_batches(df.sparkSession)
    kept = [k for k, c in enumerate(df.columns) if c.lower() != name]
    schema = T.StructType([df.schema[k] for k in kept] + [T.StructField(name, kind)])
    position = df.columns.index(source)
    return df.mapInArrow(functools.partial(fn, path=model, position=position, kept=kept), schema)


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """``docs`` with ``ids``, the piece ids of the whole ``text``."""
    return _mapped(docs, _encode, "text", "ids", T.ArrayType(T.IntegerType()), model)


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """``encoded`` with ``decoded``, the text of ``ids``."""
    return _mapped(encoded, _decode, "ids", "decoded", T.StringType(), model)


def op10_sentencepiece(spark, sf_dir):
    """Per document the ids' number and hash, and the hash of the text that they decode to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = decode(encode(docs).select("doc_id", "ids"))
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.xxhash64("ids").alias("ids_hash"),
        F.length("decoded").cast("long").alias("n_chars_decoded"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
