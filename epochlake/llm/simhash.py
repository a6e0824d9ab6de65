"""Near-duplicate documents by SimHash fingerprints and BK-trees."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import column, fresh, join_hot, persist, slices, texts_of, tidy
from .graph import components

#: Words in a shingle, and bits in which linked fingerprints may differ.
SHINGLE, RADIUS = 4, 4
#: Fingerprint bits are cut into so many blocks; a shard is a choice of BLOCKS - RADIUS blocks with their values.
BLOCKS = 6


def fingerprints_of(texts: list[bytes], shingle: int = SHINGLE, seed: int = 42) -> np.ndarray:
    """64-bit fingerprints; texts are UTF-8. Text without words: 0."""
    hashed: list[int] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        words = text.lower().split()  # on bytes: lowers A-Z only, splits at \x20 and \x09-\x0D only
        if len(words) > shingle:
            words = [b" ".join(x) for x in zip(*(words[j:] for j in range(shingle)), strict=False)]
        elif words:
            words = [b" ".join(words)]
        counts[i] = len(words)
        hashed.extend([digest(x, seed) for x in words])
    out = np.zeros(len(texts), dtype=np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        h = np.array(hashed, dtype=np.uint64)
        starts = np.cumsum(counts) - counts
        starts, half = starts[full], counts[full]
        bits = np.zeros(len(full), dtype=np.uint64)
        for b in range(64):
            ones = np.add.reduceat(((h >> np.uint64(b)) & np.uint64(1)).astype(np.int32), starts)
            bits |= (2 * ones > half).astype(np.uint64) << np.uint64(b)
        out[full] = bits
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long): the fingerprint of every row's whole text; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fingerprints_of(texts_of(part, "text"), shingle).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, fp long")


class BKTree:
    """Values at nodes; a child's key is its integer Hamming distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """The node's number; a value that is in the tree already gives its node."""
        if not self.values:
            self.values, self.children = [value], [{}]
            return 0
        at = 0
        while d := (self.values[at] ^ value).bit_count():
            down = self.children[at].get(d)
            if down is None:
                self.children[at][d] = len(self.values)
                self.values.append(value)
                self.children.append({})
                return len(self.values) - 1
            at = down
        return at

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Numbers of the nodes at most `radius` away; only edges that can lead to one are followed."""
        todo = [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                yield at
            for key, child in self.children[at].items():
                if d - radius <= key <= d + radius:
                    todo.append(child)


def shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the values of one shard, as pairs of positions: no more links than values."""
    parent = list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    tree, out = BKTree(), []
    for i, v in enumerate(values):
        for j in tree.within(v, radius):
            a, b = root(i), root(j)
            if a != b:
                parent[a] = b
                out.append((i, j))
        tree.add(v)
    return out


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(a, b): links that connect exactly the fingerprints of distinct(fp) that chains of steps of `radius` bits connect.

    Two fingerprints that differ in at most `radius` bits agree in at least blocks - radius of the blocks, so they meet in
    the shard of these blocks and values. A shard's tree stays with the task that holds its fingerprints, which are also its
    queries; no tree of all fingerprints is built or sent. A value is in a shard once, so no text's copies enlarge a tree.
    """
    if not radius < blocks <= 64:
        raise ValueError("blocks must be over radius, 64 at most")
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), blocks - radius):
        mask = 0
        for k in chosen:
            mask |= ((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1)
        masks.append(mask - (1 << 64) if mask >= 1 << 63 else mask)
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("mask", "value"))
    dealt = keyed.repartition("mask", "value").sortWithinPartitions("mask", "value", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        last = None

        def links(rows: np.ndarray) -> tuple[list[int], list[int]]:
            cut = np.flatnonzero((rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])) + 1
            starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(rows)]))
            a: list[int] = []
            b: list[int] = []
            for k in np.flatnonzero(ends - starts > 1):
                fp = rows[starts[k] : ends[k], 2]
                for i, j in shard_links(fp.view(np.uint64).tolist(), radius):
                    a.append(int(fp[i]))
                    b.append(int(fp[j]))
            return a, b

        def flush(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            a, b = links(rows)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("mask", "value", "fp")], axis=1)
            if last is not None and tuple(rows[0, :2]) == last and tuple(rows[-1, :2]) == last:
                held.append(rows)
                continue
            # the last group of the batch may go on in the next one
            same = (rows[:, 0] == rows[-1, 0]) & (rows[:, 1] == rows[-1, 1])
            k = int(np.argmax(same))
            ready = np.concatenate([*held, rows[:k]])
            held, last = [rows[k:]], tuple(rows[-1, :2])
            if len(ready):
                yield from flush(ready)
        if held:
            yield from flush(np.concatenate(held))

    return dealt.mapInArrow(tidy(run), "a long, b long")


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, fp, component_id): the SimHash of every document and the smallest doc_id that chains of links reach.

    Equal fingerprints are one node, so copies of a text are neither compared nor expanded into pairs. Null and empty texts,
    and texts of white space alone, have fingerprint 0, which links like any other. Rows with a null doc_id keep their row;
    they count for links, and their component_id is the smallest doc_id that isn't null (null if there is none). Repeated
    rows are kept. Other columns are ignored. No rows: no rows.
    """
    found = persist(fingerprints(docs, shingle))
    nodes = persist(found.groupBy("fp").agg(F.min("doc_id").alias("least")))
    return label_groups(found, nodes, fingerprint_links(nodes.select("fp"), radius, blocks))


def label_groups(found: DataFrame, nodes: DataFrame, links: DataFrame, driver_edges: int = 0) -> DataFrame:
    """found(doc_id, fp) with component_id: the smallest `least` of nodes(fp, least) that chains of links(a, b) of fps reach."""
    linked = persist(nodes.join(components(links, driver_edges=driver_edges).withColumnRenamed("node", "fp"), "fp"))
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    within = join_hot(linked, least, "component").select("fp", "component_id")
    alone = nodes.join(linked.select("fp"), "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    return join_hot(found, within.unionByName(alone), "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of docs, one of each group of near-duplicates: that with the smallest doc_id. All columns are kept; see group_heads."""
    return group_heads(docs, simhash_groups(docs, shingle, radius), lambda rows: with_fingerprint(rows, shingle), "_simhash")


def group_heads(docs: DataFrame, groups: DataFrame, marked: Callable[[DataFrame], DataFrame], mark: str) -> DataFrame:
    """The rows of docs that head a group of groups(doc_id, fp, component_id); marked adds a row's fp as the column `mark`.

    Where that id is repeated inside the group, the row with the smallest fingerprint, then text, then hash of all columns,
    stays. Rows without a doc_id can't be told apart and all stay; so do, of a repeated doc_id, rows of other groups that it
    heads. All columns of docs are kept, whatever their names.
    """
    heads = groups.groupBy("doc_id", "component_id").agg(F.min("fp").alias("fp"), F.count("*").alias("n"))
    each = Window.partitionBy("doc_id")
    heads = persist(heads.filter("doc_id is not null").withColumn("n", F.sum("n").over(each)).filter("doc_id = component_id"))
    (other,) = fresh(docs, "_id")
    known = F.col("doc_id").cast("long")
    kept = docs.join(heads.filter("n = 1").select(F.col("doc_id").alias(other)), known == F.col(other), "left_semi").unionByName(docs.filter(known.isNull()))
    odd = heads.filter("n > 1").select(F.col("doc_id").alias("_id"), F.col("fp").alias("_fp"))
    if odd.isEmpty():
        return kept
    packed = docs.select(F.struct(*map(column, docs.columns)).alias("row"), known.alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = marked(packed.join(odd.select("_id"), F.col("doc_id") == F.col("_id"), "left_semi"))
    picked = rows.join(odd, (F.col("doc_id") == F.col("_id")) & (F.col(mark) == F.col("_fp")))
    # one row of each id is left, by an aggregation: repeated rows meet no window
    first = picked.groupBy("doc_id").agg(F.min_by("row", F.struct("text", F.xxhash64("row"))).alias("row"))
    return kept.unionByName(first.select("row.*"))


def with_fingerprint(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """docs with one more column, _simhash: the fingerprint of the row's text as a signed long."""
    schema = T.StructType([*docs.schema.fields, T.StructField("_simhash", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(fingerprints_of(texts_of(part, "text"), shingle).view(np.int64))], [*part.schema.names, "_simhash"])

    return docs.mapInArrow(tidy(run), schema)
