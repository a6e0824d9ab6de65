"""Token ids in binary segments: ids one after another, document boundaries in Elias-Fano code."""

from __future__ import annotations

import codecs
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shared_dir, slices, tidy

#: Ids in a segment, at least; a segment ends with the document that reaches this number.
SEGMENT_IDS = 1 << 20
#: Pieces of text whose ids a worker remembers, bytes of text that it encodes at once, and places that are looked up at once.
CACHE_PIECES, ENCODED_BYTES, SELECTED = 1_400_000, 6 << 20, 4096
MAGIC, HEAD = b"EFTOK\x02", "<BQQQqQQ"


class EliasFano:
    """A sequence of n integers, 0 <= v[0] <= ... <= v[n-1] <= top < 2^64, in about 2 + log2(top / n) bits each.

    The low bits stand side by side; the high bits are unary counts, a one for each value. select(i) finds the i-th one by
    the number of ones before each 512-bit block, kept in 32 bits, and by one look into a block. No table of values is made.
    """

    BLOCK = 512

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        padded = np.zeros(-(-len(high) * 8 // self.BLOCK) * self.BLOCK // 8, dtype=np.uint8)
        padded[: len(high)] = high
        self._bits = padded.reshape(-1, self.BLOCK // 8)
        ones = np.unpackbits(self._bits, axis=1).sum(axis=1, dtype=np.uint32)
        self._before = np.concatenate((np.zeros(1, np.uint32), np.cumsum(ones, dtype=np.uint32)))

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        if (values[1:] < values[:-1]).any():
            raise ValueError("values must not fall")
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        high = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(high[-1]) + 1) if n else 0, dtype=np.uint8)
        bits[high] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"))

    def select(self, i: int) -> int:
        """The i-th value."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        return int(self.select_many(np.array([i]))[0])

    def select_many(self, i: np.ndarray) -> np.ndarray:
        """The values at these places, as unsigned 64-bit integers: each by a look into its block."""
        if not len(i):
            return np.empty(0, dtype=np.uint64)
        block = np.searchsorted(self._before, i, side="right") - 1
        own, row = np.unique(block, return_inverse=True)
        ones = np.flatnonzero(np.unpackbits(self._bits[own], axis=1, bitorder="little"))
        held = self._before[own + 1].astype(np.int64) - self._before[own]
        inside = ones[(np.cumsum(held) - held)[row] + (i - self._before[block])] % self.BLOCK
        high = (block * self.BLOCK + inside - i).astype(np.uint64) << np.uint64(self.low_bits)
        if not self.low_bits:
            return high
        start = np.asarray(i, dtype=np.int64) * self.low_bits
        at = (start // 8)[:, None] + np.arange(9)
        raw = np.where(at < len(self.low), self.low[np.minimum(at, len(self.low) - 1)], 0).astype(np.uint8)
        shift = (start % 8).astype(np.uint64)
        value = np.ascontiguousarray(raw[:, :8]).view("<u8")[:, 0] >> shift
        value |= np.where(shift > 0, raw[:, 8].astype(np.uint64) << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
        return high | value & np.uint64((1 << self.low_bits) - 1)

    def values(self) -> np.ndarray:
        """All values, by select."""
        return np.concatenate([np.empty(0, np.int64), *(self.select_many(np.arange(k, min(k + SELECTED, self.n))).astype(np.int64) for k in range(0, self.n, SELECTED))])

    def dumps(self) -> bytes:
        return struct.pack("<QBQQ", self.n, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def loads(cls, data: bytes) -> EliasFano:
        n, low_bits, a, b = struct.unpack_from("<QBQQ", data)
        at = struct.calcsize("<QBQQ")
        return cls(n, low_bits, np.frombuffer(data, np.uint8, a, at), np.frombuffer(data, np.uint8, b, at + a))


def pack(ids: np.ndarray, ends: np.ndarray, doc_ids: list[int | None] | None = None) -> bytes:
    """A segment: magic, bytes of an id, documents, ids, rows without a doc_id, least doc_id, lengths of the two codes, the codes, the ids.

    ids are unsigned integers of two or four bytes, those of all documents one after another; ends counts the ids up to the end
    of each document. The codes are Elias-Fano: of the ends, and of the doc_ids less the least one. doc_ids ascend, nulls first.
    """
    known = [i for i in doc_ids or () if i is not None]
    least = known[0] if known else 0
    nulls = len(ends) - len(known)
    named = EliasFano.of(np.array([i - least for i in known], dtype=np.uint64)).dumps()
    bounds = EliasFano.of(ends).dumps()
    return MAGIC + struct.pack(HEAD, ids.dtype.itemsize, len(ends), len(ids), nulls, least, len(bounds), len(named)) + bounds + named + ids.tobytes()


class Segment:
    """A segment that was packed: documents by number, without decoding the others."""

    def __init__(self, data: bytes) -> None:
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token segment")
        width, self.docs, self.ids, self.nulls, self.least, a, b = struct.unpack_from(HEAD, data, len(MAGIC))
        at = len(MAGIC) + struct.calcsize(HEAD)
        self.ends, self.named = EliasFano.loads(data[at : at + a]), EliasFano.loads(data[at + a : at + a + b])
        self.data = np.frombuffer(data, f"<u{width}", self.ids, at + a + b)

    def bounds(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def doc_id(self, i: int) -> int | None:
        return self.least + self.named.select(i - self.nulls) if i >= self.nulls else None

    def doc_ids(self, first: int, end: int) -> list[int | None]:
        """Those of the documents [first, end), by select."""
        n = min(max(0, self.nulls - first), end - first)
        return [None] * n + [self.least + v for v in self.named.select_many(np.arange(first + n, end) - self.nulls).tolist()]

    def __getitem__(self, i: int) -> np.ndarray:
        a, b = self.bounds(i)
        return self.data[a:b]


#: Punctuation that may stand after the letters of a plain piece; the first letter that isn't Latin.
_MARKS, _NOT_LATIN = re.compile(r"[!-&(-/:-@\[-`{-~]"), "\u0250"
_ENDING = frozenset(c for c in map(chr, range(128)) if _MARKS.match(c))
# byte-level vocabularies write printable bytes as their Latin-1 characters and the others, in order, as those from 256 on
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_OTHERS = [b for b in range(256) if b not in _PRINTED]
_BYTES = "".join("\n" if b == 10 else chr(b) if b in _PRINTED else chr(256 + _OTHERS.index(b)) for b in range(256))


def is_plain(piece: str) -> bool:
    """Whether a piece is Latin letters, with one punctuation mark after them or none."""
    if not piece.isalpha() and not (piece[:-1].isalpha() and piece[-1] in _ENDING):
        return False
    return piece.isascii() or max(piece) < _NOT_LATIN


def byte_level(text: str) -> str:
    """The text with the characters by which byte-level vocabularies write its bytes, line feeds left alone."""
    return codecs.charmap_decode(text.encode(), "strict", _BYTES)[0]


class Pieces(dict):
    """Numbers of pieces of text; those met for the first time wait in `new`. Pieces that can't stand alone are 0."""

    def __init__(self, owner: Encoder, after_space: bool) -> None:
        self.owner, self.after_space, self.new = owner, after_space, []

    def __missing__(self, piece: str) -> int:
        if self.after_space and (not piece or piece[0].isspace() or piece[-1].isspace()):
            number = 0
        else:
            number = self.owner.known
            self.owner.known += 1
            self.new.append(piece)
        self[piece] = number
        return number


class Encoder:
    """Ids of whole texts, as the tokenizers library gives them without special tokens added.

    Byte-level tokenizers cut a text before any space that has no other white space beside it, and encode what lies between
    independently; such pieces are encoded once and remembered, in one array, and texts are put together by their numbers. New
    pieces are encoded as one text, whose ids are dealt to the pieces by the bytes that each id stands for; those of Latin
    letters are cut by white space for that, not by the tokenizer's pattern, which cuts them alike but takes longer. Texts with
    a space beside other white space, and all texts under other tokenizers, are encoded whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        added = {t["id"]: t for t in spec.get("added_tokens", [])}
        self.piecewise = not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and all(" " not in t["content"] and not t["lstrip"] and not t["rstrip"] and not t["single_word"] for t in added.values())
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if max(vocabulary.values(), default=0) < 1 << 16 else "<u4")
        # a character of a byte-level token stands for a byte
        self.lengths = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.lengths[i] = len(token.encode()) if i in added else len(token)
        # whether white space cuts plain pieces as the pre-tokenizer does
        probe = " a b, cé"
        self.cuts_alike = self.piecewise and [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(probe)] == byte_level(probe.replace(" ", "\n ").replace(",", "\n,")).split()
        self.forget()

    def forget(self, hits: int | None = None) -> None:
        """Drops all remembered pieces, or those met fewer times. Number 0 stands for what can't stand alone, 1 for no text, 2 for the end id."""
        old = (self.inner, self.outer, self.tokens, self.first, self.count, self.hits) if hits else None
        self.known = 3
        self.inner, self.outer = Pieces(self, True), Pieces(self, False)
        self.outer[""] = 1
        self.tokens, self.used = np.zeros(1 << 16, dtype=self.dtype), 1
        self.first, self.count, self.hits = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int32), np.zeros(1 << 16, dtype=np.int32)
        self.count[2] = 1
        if old:
            for before, now in ((old[0], self.inner), (old[1], self.outer)):
                kept = [(p, n) for p, n in before.items() if n > 2 and old[5][n] >= hits]
                now.update(zip((p for p, _ in kept), range(self.known, self.known + len(kept)), strict=True))
                at = np.array([n for _, n in kept], dtype=np.int64)
                count = old[4][at].astype(np.int64)
                ids = old[2][np.repeat(old[3][at] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]
                numbers = np.arange(self.known, self.known + len(kept))
                self.known += len(kept)
                self._keep(numbers, ids, count)

    def _encode(self, texts: list[str], tokenizer: Tokenizer | None = None) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.dtype) for e in (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, pieces: list[str], plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces and how many each has; the pieces start with a space and have no other white space at an end."""
        joined = "".join(pieces)
        if plain:
            # the same cuts by white space: before the characters that stand for spaces, and before punctuation
            ids = self._encode([byte_level(_MARKS.sub(r"\n\g<0>", joined.replace(" ", "\n ")))], self.plain)[0]
        else:
            ids = self._encode([joined])[0]
        raw = np.frombuffer(joined.encode("utf-8", "replace"), dtype=np.uint8)
        bounds = np.append(np.flatnonzero(raw == 32)[1:], len(raw))  # no piece has another space
        reached = np.cumsum(self.lengths[ids])
        at = np.searchsorted(reached, bounds)
        if not len(ids) or at[-1] != len(ids) - 1 or (reached[np.minimum(at, len(ids) - 1)] != bounds).any():
            return self._one_by_one(pieces)  # a vocabulary whose tokens don't say how many bytes they are
        return ids, np.diff(at, prepend=-1)

    def _one_by_one(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = self._encode(pieces)
        return np.concatenate([np.empty(0, self.dtype), *each]), np.array([len(x) for x in each], dtype=np.int64)

    def _keep(self, number: np.ndarray, ids: np.ndarray, count: np.ndarray, more: int = 0) -> None:
        """Remembers the ids of the pieces of these numbers, in this order, `more` of which are numbers not counted yet."""
        self.known += more
        if self.known > len(self.first):
            self.first, self.count, self.hits = (np.concatenate([x, np.zeros(max(len(x), self.known - len(x)), x.dtype)]) for x in (self.first, self.count, self.hits))
        if self.used + len(ids) > len(self.tokens):
            self.tokens = np.concatenate([self.tokens, np.zeros(max(len(self.tokens), len(ids)), self.dtype)])
        self.first[number], self.count[number] = self.used + np.cumsum(count) - count, count
        self.tokens[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _learn(self) -> None:
        for pieces, space in ((self.inner, " "), (self.outer, "")):
            new, pieces.new = pieces.new, []
            numbers = np.arange(len(new)) + (pieces[new[0]] if new else 0)  # they were met in a row
            plain = np.fromiter(map(is_plain, new), bool, len(new)) if self.cuts_alike and space else np.zeros(len(new), bool)
            for alike in (True, False):
                own = np.flatnonzero(plain == alike)
                for k in range(0, len(own), 20_000):
                    at = own[k : k + 20_000]
                    part = [space + new[i] for i in at.tolist()]
                    self._keep(numbers[at], *(self._together(part, alike) if space else self._one_by_one(part)))

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (no nulls) one after another, each with the end id, if one is given; and the end of each text's ids."""
        if self.known > CACHE_PIECES:
            self.forget(2)
            if 2 * self.known > CACHE_PIECES:
                self.forget()
        self.tokens[0] = end_id or 0  # number 2 begins at 0
        n = len(texts)
        if self.piecewise:
            split = pa.compute.split_pattern(texts, " ")
            begin = split.offsets.to_numpy()[:n].astype(np.int64) - split.offsets[0].as_py()
            end = split.offsets.to_numpy()[1:].astype(np.int64) - split.offsets[0].as_py()
            named = split.flatten().dictionary_encode()
            pieces = named.dictionary.to_pylist()
            index = named.indices.to_numpy()
            number = np.fromiter(map(self.inner.__getitem__, pieces), np.int64, len(pieces))[index]
            bad = np.zeros(n, bool)
            for i, (a, b) in enumerate(zip(begin.tolist(), (end - 1).tolist(), strict=True)):
                first, last = pieces[index[a]], pieces[index[b]]
                number[a] = self.outer[first]
                if a < b:
                    bad[i] = first[-1:].isspace()
                    if not number[b] and last and not last[0].isspace():
                        number[b] = self.outer[" " + last]  # white space at the end of a text is beside no space
            bad |= np.logical_or.reduceat(number == 0, begin) if n else False
        else:
            begin, end = np.arange(n), np.arange(1, n + 1)
            number, bad = np.ones(n, dtype=np.int64), np.ones(n, bool)
        whole = np.flatnonzero(bad)
        if len(whole):
            self._keep(np.arange(self.known, self.known + len(whole)), *self._one_by_one(texts.take(pa.array(whole)).to_pylist()), len(whole))
            number[begin[whole]] = np.arange(self.known - len(whole), self.known)
        self._learn()
        self.hits[: self.known] += np.bincount(number, minlength=self.known).astype(np.int32)
        size = np.where(bad, 1, end - begin)
        kept = np.ones(len(number), bool)
        if len(whole):
            kept = np.repeat(~bad, end - begin)
            kept[begin] = True
        if end_id is not None:
            out = np.full(int(size.sum()) + n, 2, dtype=np.int64)
            out[np.arange(int(size.sum())) + np.repeat(np.arange(n), size)] = number[kept]
            number, size = out, size + 1
        else:
            number = number[kept]
        count = self.count[number].astype(np.int64)
        reached = np.cumsum(count)
        total = int(reached[-1]) if len(reached) else 0
        ids = self.tokens[np.repeat(self.first[number] - (reached - count), count) + np.arange(total)]
        return ids, np.concatenate(([0], reached))[np.cumsum(size)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        ids, ends = self.encode(pa.array(texts, pa.string()))
        return [x.tobytes() for x in np.split(ids, ends[:-1])] if len(texts) else []


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of a tokenizer file, loaded once by a Python process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def write_tokens(docs: DataFrame, to: str, tokenizer: str, end_id: int = 2, segment_ids: int = SEGMENT_IDS) -> None:
    """Writes the ids of all texts of docs(doc_id, text) to the folder `to`, in ascending order of doc_id.

    Each row of the Parquet files is a segment: part and seq, which order the segments, n_docs, n_ids, and the payload, which is
    a segment in the form of pack(). A null text counts as empty; each document ends with `end_id`. Null ids come first; rows
    of the same id are ordered by the XXH64 of their texts, then by text. No rows: no segments. Ids that don't fit in two bytes
    take four.
    """
    # an id that many rows share is cut by the hash of its text
    mark = F.xxhash64("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = rows.withColumn("mark", mark).repartitionByRange("doc_id", "mark").sortWithinPartitions("doc_id", "mark", "text").drop("mark")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, seq = encoder(tokenizer), TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        ids: list[np.ndarray] = []
        ends: list[np.ndarray] = []
        size = 0

        def segment() -> pa.RecordBatch:
            payload = pack(np.concatenate(ids), np.concatenate(ends), names)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([len(names)], pa.int64()), pa.array([size], pa.int64()), pa.array([payload], pa.binary())], ["part", "seq", "n_docs", "n_ids", "payload"])

        for batch in slices(batches, "text", ENCODED_BYTES):
            found, reached = encode.encode(batch.column("text"), end_id)
            doc_ids, at, begin = batch.column("doc_id").to_pylist(), 0, 0
            while at < len(doc_ids):
                # documents up to the one with which the segment is full
                to = min(int(np.searchsorted(reached, begin + segment_ids - size)) + 1, len(doc_ids))
                names += doc_ids[at:to]
                ends.append(reached[at:to] - begin + size)
                ids.append(found[begin : reached[to - 1]])
                size += int(reached[to - 1]) - begin
                at, begin = to, int(reached[to - 1])
                if size >= segment_ids:
                    yield segment()
                    seq, names, ids, ends, size = seq + 1, [], [], [], 0
        if names:
            yield segment()

    found = ordered.mapInArrow(tidy(run), "part int, seq long, n_docs long, n_ids long, payload binary")
    found.write.option("compression", "zstd").parquet(to)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, part, seq, nth) of every document in the files that write_tokens wrote.

    start is the number of ids of all documents before; ids_crc32 is over the ids as little-endian unsigned 32-bit integers;
    part, seq and nth say which document of which segment it is. Offsets and doc_ids come from the select structures.
    """
    segments = spark.read.parquet(path)
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition that was written
    parts = parts.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    before = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = segments.select("part", "seq", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("offset")).join(parts, "part").select("part", "seq", (F.col("offset") + F.col("base")).alias("offset"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                s = Segment(batch.column("payload")[row].as_py())
                part, seq, begin = batch.column("part")[row].as_py(), batch.column("seq")[row].as_py(), 0
                for k in range(0, s.docs, SELECTED):
                    to = min(k + SELECTED, s.docs)
                    n = to - k
                    ends = s.ends.select_many(np.arange(k, to)).astype(np.int64)
                    begins = np.concatenate(([begin], ends[:-1]))
                    wide = memoryview(np.ascontiguousarray(s.data[begin : ends[-1]].astype("<u4"))).cast("B")
                    crc = [zlib.crc32(wide[4 * (a - begin) : 4 * (b - begin)]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(s.doc_ids(k, to), pa.int64()), pa.array(begins, pa.int64()), pa.array(ends - begins, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(n, part, "i4")), pa.array(np.full(n, seq, "i8")), pa.array(np.arange(k, to, dtype="i8"))],
                        ["doc_id", "begin", "n_tokens", "ids_crc32", "part", "seq", "nth"],
                    )
                    begin = int(ends[-1])

    docs = segments.select("part", "seq", "payload").mapInArrow(tidy(run), "doc_id long, begin long, n_tokens long, ids_crc32 long, part int, seq long, nth long")
    return docs.join(starts, ["part", "seq"]).select("doc_id", (F.col("begin") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", "part", "seq", "nth")


def encode_and_read_back(docs: DataFrame, tokenizer: str, end_id: int = 2, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """read_tokens of what write_tokens has written, to a new folder in the shared one."""
    to = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, to, tokenizer, end_id, segment_ids)
    return read_tokens(docs.sparkSession, to)
