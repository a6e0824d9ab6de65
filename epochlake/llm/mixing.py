"""Mixing sources to target weights by fixed-length blocks, multinomial draws and pseudorandom index permutations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import attach, fresh, parts_of, persist, running, tidy

#: Words in a block at most, slots in an output shard, weights of the sources in order, share of all words, times that a word may be taken.
BLOCK, SHARD_SLOTS, WEIGHTS, SHARE, MOST = 64, 65_536, (3, 1, 2), 1.5, 2
#: The driver holds one number of words for each source; more sources than this are an error.
MOST_SOURCES = 1_000_000
#: Rows of one source that are summed by one task. A source has as many blocks at least, or one for each word.
BUCKET_ROWS, LEAST_BLOCKS = 20_000, 64


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, mark): words of each text, null 0, and a hash that orders repeated ids."""
    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(text).alias("mark"),
    )


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> list[float]:
    """Words to take from each source, in the given order: by weight, at most `most` times its size, the excess reshared."""
    total = share * sum(n for _, n in sizes)
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    out = [0.0] * len(sizes)
    free = list(range(len(sizes)))
    left = total
    while free:
        level = left / sum(weight[i] for i in free)
        over = [i for i in free if level * weight[i] > most * sizes[i][1]]
        if not over:
            for i in free:
                out[i] = level * weight[i]
            break
        for i in over:
            out[i] = float(most * sizes[i][1])
            left -= out[i]
        free = [i for i in free if i not in set(over)]
        left = max(left, 0.0)
    return out


def share_out(quotas: np.ndarray, slots: int, seed: list[int]) -> np.ndarray:
    """A multinomial draw of so many slots from what the sources have; what exceeds a source's quota is drawn again among the others."""
    rng, out = np.random.default_rng(seed), np.zeros_like(quotas)
    while slots:
        room = quotas - out
        got = np.minimum(rng.multinomial(slots, room / room.sum()), room)
        out += got
        slots -= int(got.sum())
    return out


def draw(quotas: list[int] | np.ndarray, shard_slots: int, seed: int, first: int = 0, end: int | None = None) -> list[tuple[int, int, int, int]]:
    """(shard, source, first slot, slots) of the output shards from `first` to before `end`: multinomial counts that meet all quotas exactly.

    The shards are halved again and again, and the slots of the left half are drawn from what the whole has; so a task draws its
    own shards without those before them, in a number of draws that is the logarithm of all shards.
    """
    quotas = np.asarray(quotas, dtype=np.int64)
    shards = -(-int(quotas.sum()) // shard_slots)
    out: list[tuple[int, int, int, int]] = []
    todo = [(0, shards, quotas, np.zeros_like(quotas))]
    while todo:
        lo, hi, have, done = todo.pop()
        if hi <= first or end is not None and lo >= end or lo >= hi:
            continue
        if hi - lo == 1:
            out += [(lo, int(s), int(done[s]), int(have[s])) for s in np.flatnonzero(have)]
            continue
        mid = (lo + hi) // 2
        left = share_out(have, (mid - lo) * shard_slots, [seed, lo, hi])
        todo += [(mid, hi, have - left, done + left), (lo, mid, left, done)]
    return out


def permuted(index: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A pseudorandom permutation of 0..size-1 at each index: a Feistel network, walked until it falls inside."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng([seed, 77]).integers(0, 2**63, 6, dtype=np.uint64) | np.uint64(1)
    out = index.astype(np.uint64)
    todo = np.ones(len(out), dtype=bool)
    while todo.any():
        x = out[todo]
        a, b = x >> np.uint64(half), x & mask
        for key in keys:
            f = (b + np.uint64(0x9E3779B97F4A7C15)) * key
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, a ^ ((f >> np.uint64(32)) & mask)
        out[todo] = a << np.uint64(half) | b
        todo &= out >= np.uint64(size)
    return out.astype(np.int64)


def mix_plan(docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The placed documents, the sources and the slots of a mix.

    Documents (doc_id, source, size, mark, source_id, block_words, start): `start` is where a document's words begin among its
    source's. Sources (source_id, source_size, target, block_words). Slots (shard, source_id, slot, block): each output
    shard's blocks by index; slot counts a source's blocks through all shards, and passes through its blocks in permuted order.

    Words of a source, in the order of hashed documents, are packed into blocks of `block` words, or of fewer if that makes
    less than LEAST_BLOCKS of them; the last may be shorter. Sources are ordered by code point, null last. A source's slots are
    target / size of its blocks, to the nearest; so no block is taken more than twice, and what is taken is within one block
    of the target. The draws depend on sizes and the seed alone, so reruns agree. Sources of no words take no part.
    """
    rows = persist(sized(docs))
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    found = sums.limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    found.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
    wanted = targets([(r.source, r.source_size) for r in found], weights, share)
    lengths = [max(1, min(block, r.source_size // LEAST_BLOCKS)) for r in found]
    blocks = [-(-r.source_size // n) for r, n in zip(found, lengths, strict=True)]
    quotas = [min(MOST * b, round(b * t / r.source_size)) if b else 0 for r, b, t in zip(found, blocks, wanted, strict=True)]
    spark = docs.sparkSession
    sources = spark.createDataFrame(
        [(r.source, i, r.source_size, t, n) for i, (r, t, n) in enumerate(zip(found, wanted, lengths, strict=True))],
        "source string, source_id int, source_size long, target double, block_words long",
    )
    sent = spark.sparkContext.broadcast((np.array(quotas, dtype=np.int64), np.array(blocks, dtype=np.int64)))
    shards = -(-sum(quotas) // shard_slots)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quotas, blocks = sent.value
        for batch in batches:
            for shard in batch.column("id").to_pylist():
                for _, source, first, n in draw(quotas, shard_slots, seed, shard, shard + 1):
                    slot = np.arange(first, first + n)
                    at = permuted(slot % blocks[source], int(blocks[source]), seed * 1_000_003 + source)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard, "i4")), pa.array(np.full(n, source, "i4")), pa.array(slot), pa.array(at)], ["shard", "source_id", "slot", "block"])

    buckets = max(512, -(-max([r.n for r in found], default=0) // BUCKET_ROWS))
    placed = running(rows, "source", ["doc_id", "mark"], "size", "start", buckets)
    named = sources.select(F.col("source").alias("_source"), "source_id", "block_words")
    placed = placed.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    # the shards are drawn where they are laid out, a few by each task
    spread = spark.range(0, shards, 1, max(1, min(shards, max(parts_of(spark), shards // 16))))
    return persist(placed), sources, spread.mapInArrow(tidy(slots), "shard int, source_id int, slot long, block long")


def taken_pieces(placed: DataFrame, slots: DataFrame) -> DataFrame:
    """(doc_id, source, source_id, start, size, mark, block, at, words, uses): each document's words in each block, where they begin in it, and how often the mix takes them."""
    uses = slots.groupBy("source_id", "block").agg(F.count("*").alias("uses"))
    n = F.col("block_words")
    held = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / n).cast("long"), F.floor((F.col("start") + F.col("size") - 1) / n).cast("long"))))
    held = held.withColumn("at", F.greatest(F.col("block") * n, F.col("start")) - F.col("start"))
    held = held.withColumn("words", F.least((F.col("block") + 1) * n, F.col("start") + F.col("size")) - F.col("start") - F.col("at")).drop("block_words")
    # slots look small to Spark, which made them from a range, but are as many as the words that are taken
    return held.join(uses.hint("merge"), ["source_id", "block"], "left").withColumn("uses", F.coalesce("uses", F.lit(0)))


def mix_sizes(docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, seed: int = 0) -> DataFrame:
    """(doc_id, size, source_size, target, taken): what the mix takes of each document, in words, repeats counted.

    Null and empty texts have size 0, and 0 words are taken. Null ids and repeated rows each keep their row. Columns of docs
    other than doc_id, text and source are ignored. No rows: no rows.
    """
    placed, sources, slots = mix_plan(docs, block, shard_slots, weights, share, seed)
    each = taken_pieces(placed, slots).groupBy("source_id", "start", "doc_id", "size").agg(F.sum(F.col("words") * F.col("uses")).alias("taken"))
    none = placed.filter("size = 0").select("source_id", "start", "doc_id", "size", F.lit(0).cast("long").alias("taken"))
    return each.unionByName(none).join(sources.drop("source"), "source_id").select("doc_id", "size", "source_size", "target", "taken")


def mix(docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, seed: int = 0) -> DataFrame:
    """The mix as documents, with the columns of docs: a row for each time that words of a document are taken.

    The first row of a document holds its words in blocks that are taken at all, the second those that are taken twice; a
    whole document keeps its text as it is, parts keep the white space inside them. n_chars, if docs has it, is the length of
    the row's text. Documents of which nothing is taken, so all without words, have no row. Repeated rows of docs count each;
    those alike in doc_id, text and source share out what is taken of them in the order of the hashes of all their columns.
    Other columns stay, whatever their names. No rows: no rows.
    """
    placed, _, slots = mix_plan(docs, block, shard_slots, weights, share, seed)
    used = taken_pieces(placed, slots).filter("uses > 0")
    each = used.groupBy("source", "start", "doc_id", "mark", "size").agg(F.sort_array(F.collect_list(F.struct("at", "words", "uses"))).alias("cuts"))
    rows = persist(each.select("doc_id", "mark", "source", F.struct("start", "size", "cuts").alias("payload")))
    keys = {"doc_id": F.col("doc_id").cast("long"), "mark": F.xxhash64(F.col("text").cast("string")), "source": F.col("source").cast("string")}
    many = placed.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    cuts, words = fresh(docs, "_cuts", "_words")
    flat = attach(docs, rows, keys, many).select("row.*", F.col("payload.cuts").alias(cuts), F.col("payload.size").alias(words))
    schema = T.StructType(docs.schema.fields)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        word = re.compile(r"[^\x20\x09-\x0D]+")
        for batch in batches:
            source_row, texts = [], []
            for i, (text, pieces, size) in enumerate(zip(batch.column("text").to_pylist(), batch.column(cuts).to_pylist(), batch.column(words).to_pylist(), strict=True)):
                spans = None
                for time in range(1, max(c["uses"] for c in pieces) + 1):
                    own = [c for c in pieces if c["uses"] >= time]
                    if sum(c["words"] for c in own) == size:
                        piece = text
                    else:
                        spans = spans or [m.span() for m in word.finditer(text)]
                        runs: list[list[int]] = []
                        for c in own:
                            if runs and runs[-1][1] == c["at"]:
                                runs[-1][1] += c["words"]
                            else:
                                runs.append([c["at"], c["at"] + c["words"]])
                        piece = "\n".join(text[spans[a][0] : spans[b - 1][1]] for a, b in runs)
                    source_row.append(i)
                    texts.append(piece)
            rows = batch.take(pa.array(source_row, pa.int64()))
            columns = [rows.column(c) for c in names]
            columns[names.index("text")] = pa.array(texts, rows.column("text").type)
            if "n_chars" in names:
                columns[names.index("n_chars")] = pa.array([len(t) for t in texts], rows.column("n_chars").type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return flat.mapInArrow(tidy(run), schema)
