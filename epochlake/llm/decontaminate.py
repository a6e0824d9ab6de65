"""Benchmark items inside documents: MinHash containment search over partitions by size, then exact containment."""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CACHE_WORDS, shingle_hashes, slices, texts_of, tidy

#: Words in a shingle, least share of an item's shingles that a document must hold, and hash functions.
SHINGLE, CONTAINMENT, HASHES = 5, 0.8, 48
#: Bytes of item texts that are sent to the executors at once; more items are searched in several passes.
BLOCK_BYTES = 8 << 20

_OTHER = regex.compile(r"[^\p{L}\p{N}]")
_BITS = 20


def normal_words(text: bytes) -> list[str]:
    """Words between ASCII white space, A-Z lowered, letters and numbers only; empty ones are left out."""
    return [w for w in (_OTHER.sub("", x.decode("utf-8", "replace")) for x in text.lower().split()) if w]


def shingles(words: list[str], width: int) -> set[str]:
    """Distinct shingles; fewer words than `width` make one shingle, none make none."""
    if len(words) < width:
        return {" ".join(words)} if words else set()
    return {" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}


class NormalHashes(dict):
    """Hashes of words as they stand in a text, after normalization; 0 for those that vanish."""

    def __missing__(self, raw: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        word = _OTHER.sub("", raw.decode("utf-8", "replace"))
        value = self[raw] = (xxhash.xxh64_intdigest(word) or 1) if word else 0
        return value


def _constants(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240229)
    return r.integers(0, 2**32, hashes, dtype=np.uint32), r.integers(0, 2**31, hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def build_index(items: list[tuple[int | None, str | None]], width: int, threshold: float, hashes: int) -> SimpleNamespace:
    """Items of one block: their exact shingles and, by size class, the keys (hash function << 32 | value) of their signatures
    in order, the items that these belong to, and a table of the keys' bits."""
    exact = [shingles(normal_words((t or "").encode()), width) for _, t in items]
    index = SimpleNamespace(ids=[i for i, _ in items], exact=exact, width=width, threshold=threshold, hashes=hashes, hashed=[], classes={})
    xor, mult = _constants(hashes)
    by_class: dict[int, list[int]] = {}
    cache = NormalHashes()
    for k, (_, text) in enumerate(items):
        words = np.array([cache[w.encode()] for w in normal_words((text or "").encode())], dtype=np.uint64)
        found, _n = shingle_hashes(words, np.array([len(words)]), width)
        index.hashed.append(np.unique(found))
        if len(exact[k]):
            by_class.setdefault((len(exact[k]) - 1).bit_length(), []).append(k)
    for c, members in by_class.items():
        keys, owners = [], []
        for k in members:
            x = (index.hashed[k] >> np.uint64(32)).astype(np.uint32)
            keys.append(((x[None, :] ^ xor[:, None]) * mult[:, None]).min(axis=1).astype(np.uint64) | (np.arange(hashes, dtype=np.uint64) << np.uint64(32)))
            owners.append(np.full(hashes, k))
        key, owner = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(key, kind="stable")
        table = np.zeros(1 << _BITS, dtype=bool)
        table[_slot(key.astype(np.uint32), (key >> np.uint64(32)).astype(np.uint32))] = True
        index.classes[c] = key[order], owner[order], table
    return index


def _slot(value: np.ndarray, i: np.ndarray | np.uint32) -> np.ndarray:
    return (value * np.uint32(2654435761) ^ (i * np.uint32(40503) << np.uint32(4))) >> np.uint32(32 - _BITS)


def search(texts: list[bytes], index: SimpleNamespace, cache: dict) -> list[tuple[int, int, int]]:
    """(text, item, shingles found) of every item that a text contains, by their positions.

    An item of q shingles, 2^(c-1) < q <= 2^c, is searched in the texts' windows of 2^c shingles, side by side. A window
    that holds k of the item's shingles has its minimum with probability k / (2^c + q - k) at least, and the sum over the
    windows of a text that holds 80% of them is over 0.26 however they are spread; so 48 hash functions all miss with a
    probability under 4e-6. Each candidate is then verified on all shingles of the text, as strings.
    """
    if not index.classes:
        return []
    parts = [t.lower().split() for t in texts]
    counts = np.array([len(p) for p in parts])
    words = np.fromiter((h for p in parts for h in map(cache.__getitem__, p)), dtype=np.uint64, count=int(counts.sum()))
    kept = words != 0
    if not kept.all():
        total = np.concatenate(([0], np.cumsum(kept)))
        ends = np.cumsum(counts)
        counts = total[ends] - total[ends - counts]
        words = words[kept]
    hashed, n = shingle_hashes(words, counts, index.width)
    if not len(hashed):
        return []
    first, last = min(index.classes), max(index.classes)
    starts = np.cumsum(n) - n
    windows = -(-n // (1 << first))  # of each text
    text_of = np.repeat(np.arange(len(texts)), windows)
    nth = np.arange(len(text_of)) - np.repeat(np.cumsum(windows) - windows, windows)
    cut = starts[text_of] + (nth << first)
    levels = {first: (None, text_of)}
    for c in range(first + 1, last + 1):
        pairs = np.flatnonzero(nth & 1 == 0)
        levels[c] = (pairs, text_of := text_of[pairs])
        nth = nth[pairs] >> 1
    x = (hashed >> np.uint64(32)).astype(np.uint32)
    xor, mult = _constants(index.hashes)
    found: list[np.ndarray] = []
    for i in range(index.hashes):
        least = np.minimum.reduceat((x ^ xor[i]) * mult[i], cut)
        for c in range(first, last + 1):
            pairs, owner = levels[c]
            if pairs is not None:
                least = np.minimum.reduceat(least, pairs)
            if c not in index.classes:
                continue
            keys, items, table = index.classes[c]
            maybe = np.flatnonzero(table[_slot(least, np.uint32(i))])
            if not len(maybe):
                continue
            wanted = least[maybe].astype(np.uint64) | np.uint64(i << 32)
            a, b = np.searchsorted(keys, wanted), np.searchsorted(keys, wanted, side="right")
            hit = np.flatnonzero(b > a)
            if len(hit):
                reps = (b - a)[hit]
                at = np.repeat(a[hit], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
                found.append(np.repeat(owner[maybe[hit]], reps) * len(index.ids) + items[at])
    if not found:
        return []
    out: list[tuple[int, int, int]] = []
    seen, whole, have = -1, set(), np.empty(0, dtype=np.uint64)
    for t, k in (divmod(v, len(index.ids)) for v in np.unique(np.concatenate(found)).tolist()):
        if t != seen:
            seen, whole, have = t, set(), np.unique(hashed[starts[t] : starts[t] + n[t]])
        least_found = index.threshold * len(index.exact[k]) - 1e-9
        at = np.minimum(np.searchsorted(have, index.hashed[k]), len(have) - 1)
        if (have[at] == index.hashed[k]).sum() >= least_found:
            whole = whole or shingles(normal_words(texts[t]), index.width)
            both = len(whole & index.exact[k])
            if both >= least_found:
                out.append((t, k, both))
    return out


def _blocks(benchmark: DataFrame, width: int, threshold: float, hashes: int) -> Iterator:
    """The items as broadcast indexes of bounded size."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        yield benchmark.sparkSession.sparkContext.broadcast(build_index([(r.item_id, r.text) for r in part], width, threshold, hashes))


def contained_items(docs: DataFrame, benchmark: DataFrame, threshold: float = CONTAINMENT, width: int = SHINGLE, hashes: int = HASHES) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment): every item of which a document holds `threshold` of the shingles.

    Shingles are `width` words that follow each other, as sets. Items without words, null or empty, are in no document; an
    item of fewer words is one shingle and only in a document of just these words. Null and empty documents hold nothing.
    Repeated rows of either table each give their own rows; null ids are kept. Other columns are ignored. The documents are
    read once for each 8 MB of items and never shuffled.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, n_shingles long, n_found long, containment double"
    result = None
    for sent in _blocks(benchmark, width, threshold, hashes):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            cache, index = NormalHashes(), sent.value
            for part in slices(batches, "text"):
                hits = search(texts_of(part, "text"), index, cache)
                if hits:
                    ids = part.column("doc_id").to_pylist()
                    q = [len(index.exact[k]) for _, k, _ in hits]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([ids[t] for t, _, _ in hits], pa.int64()),
                            pa.array([index.ids[k] for _, k, _ in hits], pa.int64()),
                            pa.array(q, pa.int64()),
                            pa.array([f for _, _, f in hits], pa.int64()),
                            pa.array([f / n for (_, _, f), n in zip(hits, q, strict=True)], pa.float64()),
                        ],
                        ["doc_id", "item_id", "n_shingles", "n_found", "containment"],
                    )

        found = rows.mapInArrow(tidy(run), schema)
        result = found if result is None else result.unionByName(found)
    return result


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = CONTAINMENT, width: int = SHINGLE, hashes: int = HASHES) -> DataFrame:
    """The rows of docs that hold no item, with all their columns; see contained_items for what holding means."""
    schema = T.StructType(docs.schema.fields)
    for sent in _blocks(benchmark, width, threshold, hashes):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            cache, index = NormalHashes(), sent.value
            for part in slices(batches, "text"):
                clean = np.ones(part.num_rows, dtype=bool)
                clean[[t for t, _, _ in search(texts_of(part, "text"), index, cache)]] = False
                yield part if clean.all() else part.filter(pa.array(clean))

        docs = docs.mapInArrow(tidy(run), schema)
    return docs


ORACLE = r"""
WITH d AS (SELECT doc_id AS id, list_filter(list_transform(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: regexp_replace(x, '[^\p{L}\p{N}]', '', 'g')), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id AS id, list_filter(list_transform(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: regexp_replace(x, '[^\p{L}\p{N}]', '', 'g')), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT id AS doc_id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM d),
bs AS (SELECT id AS item_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS l FROM b),
bu AS (SELECT item_id, len(l) AS n, unnest(l) AS s FROM bs)
SELECT doc_id, item_id, CAST(n AS BIGINT) AS n_shingles, count(*) AS n_found, CAST(count(*) AS DOUBLE) / n AS containment
FROM ds JOIN bu USING (s) GROUP BY doc_id, item_id, n HAVING count(*) >= 0.8 * n - 1e-9
"""
