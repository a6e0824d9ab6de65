"""Near-duplicate embeddings: random-hyperplane sign hashing in several tables, exact cosine, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, persist, tidy
from .graph import components

#: Least cosine of a link, and probability that all tables miss a link of exactly this cosine.
COSINE, MISS = 0.98, 1e-6
#: Sign bits of a table's code: so many more than the logarithm of the vectors of the largest label, between two bounds.
SPARE_BITS, LEAST_BITS, MOST_BITS = 3, 12, 24
#: Rows of a bucket that one task compares at once; larger buckets are cut into blocks, and each pair of blocks is a task's work.
BLOCK_ROWS = 2048


def tables_for(cosine: float = COSINE, bits: int = LEAST_BITS, miss: float = MISS) -> int:
    """Tables after which a pair of this cosine has shared no bucket with probability `miss` at most."""
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return max(1, math.ceil(math.log(miss) / math.log1p(-same)))


def sign_codes(vectors: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Codes of normalized vectors: the signs at random hyperplanes, the same for all vectors of a length."""
    planes = np.random.default_rng([vectors.shape[1], 971]).standard_normal((vectors.shape[1], bits * tables))
    signs = (vectors @ planes > 0).reshape(len(vectors), tables, bits)
    return (signs @ (1 << np.arange(bits))).astype(np.int32)


def normalized(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def usable() -> Column:
    """Whether a row's vector can link."""
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    other = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0)
    return F.coalesce(other & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))


def bits_for(vectors: int) -> int:
    """Bits by which unlike vectors, this many of a label, seldom share a bucket."""
    return min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(vectors, 1))) + SPARE_BITS))


def compare(rows: dict[str, np.ndarray], starts: np.ndarray, ends: np.ndarray, cosine: float) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """Numbers of links by cid, and a spanning forest of the links, of the groups of rows [start, end)."""
    v, codes, table, cid, n, block, side = (rows[k] for k in ("v", "codes", "table", "cid", "n", "block", "side"))
    links: dict[int, int] = {}
    parent: dict[int, int] = {}
    forest: list[tuple[int, int]] = []

    def root(i: int) -> int:
        while (p := parent.setdefault(i, i)) != i:
            parent[i] = parent[p]
            i = p
        return i

    def take(i: np.ndarray, j: np.ndarray) -> None:
        """Of pairs of rows, keep those that are across the blocks, not met in an earlier table, and close."""
        fresh = ((block[i] < 0) | (side[i] != side[j])) & (cid[i] != cid[j])
        i, j = i[fresh], j[fresh]
        near = np.einsum("ij,ij->i", v[i], v[j]) >= cosine
        i, j = i[near], j[near]
        if not len(i):
            return
        earlier = np.arange(codes.shape[1])[None, :] < table[i][:, None]
        first = ~((codes[i] == codes[j]) & earlier).any(axis=1)
        for a, b, na, nb in zip(cid[i[first]].tolist(), cid[j[first]].tolist(), n[i[first]].tolist(), n[j[first]].tolist(), strict=True):
            links[a] = links.get(a, 0) + nb
            links[b] = links.get(b, 0) + na
            x, y = root(a), root(b)
            if x != y:
                parent[x] = y
                forest.append((a, b))

    small = ends - starts <= 32
    size = np.zeros(len(cid), dtype=np.int64)
    for s, e in zip(starts[small], ends[small], strict=True):
        size[s:e] = np.arange(e - s, 0, -1)  # rows of the group from here on
    for step in range(1, int(size.max(initial=1))):
        i = np.flatnonzero(size > step)
        take(i, i + step)
    for s, e in zip(starts[~small], ends[~small], strict=True):
        for a in range(s, e, 256):
            b = min(a + 256, e)
            i, j = np.nonzero(v[a:b] @ v[s:e].T >= cosine - 1e-9)
            i, j = i + a, j + s
            keep = j > i
            for k in range(0, int(keep.sum()), 100_000):
                take(i[keep][k : k + 100_000], j[keep][k : k + 100_000])
    return links, forest


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, bits: int | None = None, miss: float = MISS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors(vec_id, embedding, label).

    Vectors of equal labels link at a cosine of `cosine` or more, in double precision. Vectors that are null, empty, zero or
    hold null or non-finite components, and those with a null label or vec_id, link with nothing: no links, their own id as
    component. Vectors of other lengths don't meet. Equal vectors, by two 64-bit hashes, are compared once and counted each,
    repeated rows too; a vec_id that stands on several different vectors counts as one. kept: the row's id is its component's
    smallest. Other columns are ignored. No rows: no rows.

    Pairs that share a code in one of the tables are compared, in the first such table only; links are counted where they are
    found and only a spanning forest of each bucket is emitted. Codes have `bits` bits, or as many as bits_for the largest
    label; the tables follow from them. Codes are dealt without their vectors, which go only where a bucket has several. A
    pair at the least cosine escapes with probability `miss`.
    """
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding"))
    identity = ["label", "h", "h2"]
    rows = vectors.filter(usable()).withColumns({"h": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), "embedding")})
    distinct = rows.groupBy(*identity).agg(F.min("vec_id").alias("cid"), F.count("*").alias("n"), F.first("embedding").alias("embedding"))
    kind = dict(vectors.dtypes)
    if bits is None:
        bits = bits_for(rows.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1)
    tables = tables_for(cosine, bits, miss)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column("embedding")
            lengths = pa.compute.list_value_length(flat).to_numpy(zero_copy_only=False)
            out = np.empty((batch.num_rows, tables), dtype=np.int32)
            for d in np.unique(lengths):
                at = np.flatnonzero(lengths == d)
                block = pa.compute.list_flatten(flat.take(pa.array(at))).to_numpy(zero_copy_only=False).reshape(len(at), d)
                out[at] = sign_codes(normalized(block), bits, tables)
            codes = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, tables, dtype=np.int32)), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, codes], [*batch.schema.names, "codes"])

    schema = f"label {kind['label']}, h long, h2 long, embedding {kind['embedding']}, cid long, n long, codes array<int>"
    hashed = persist(distinct.select(*identity, "embedding", "cid", "n").mapInArrow(tidy(coded), schema))
    key = ["label", "dim", "table", "code"]
    keyed = hashed.select("h", "h2", "label", F.size("embedding").alias("dim"), F.posexplode("codes").alias("table", "code"))
    shared = keyed.groupBy(*key).agg(F.count("*").alias("rows")).filter("rows > 1").select(*key, F.when(F.col("rows") > BLOCK_ROWS, F.ceil(F.col("rows") / BLOCK_ROWS)).cast("int").alias("blocks"))
    cut = keyed.join(shared, key).withColumn("side", F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.col("h"), F.col("blocks"))).cast("int"))
    # a row of side s goes to the blocks (s, t) for all t; both sides of (s, s) are the same
    other = F.when(F.col("blocks").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    cut = cut.withColumn("other", F.explode(other))
    number = F.when(F.col("other") < 0, -1).otherwise(F.greatest("side", "other") * 100_000 + F.least("side", "other")).cast("int")
    cut = cut.withColumn("block", number).drop("blocks", "other").join(hashed, identity)
    dealt = cut.select(*key, "block", "side", "cid", "n", "embedding", "codes").repartition(*key, "block").sortWithinPartitions(*key, "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
            rows = table.num_rows
            columns = {c: table.column(c).to_numpy() for c in ("dim", "table", "code", "cid", "n", "block", "side")}
            label = pa.compute.dictionary_encode(table.column("label")).combine_chunks()
            columns["label"] = (label.chunk(0) if isinstance(label, pa.ChunkedArray) else label).indices.to_numpy()
            change = np.zeros(rows, dtype=bool)
            for c in ("label", "dim", "table", "code", "block"):
                change[1:] |= columns[c][1:] != columns[c][:-1]
            starts = np.concatenate(([0], np.flatnonzero(change)))
            ends = np.concatenate((starts[1:], [rows]))
            more = ends - starts > 1
            starts, ends = starts[more], ends[more]
            for d in np.unique(columns["dim"][starts]):
                own = columns["dim"][starts] == d
                s, e = starts[own], ends[own]
                # rows in these groups only, renumbered
                length = e - s
                at = np.repeat(s - (np.cumsum(length) - length), length) + np.arange(length.sum())
                part = table.take(pa.array(at))
                r = {c: x[at] for c, x in columns.items()}
                r["v"] = normalized(pa.compute.list_flatten(part.column("embedding").combine_chunks()).to_numpy(zero_copy_only=False).reshape(len(at), d))
                r["codes"] = pa.compute.list_flatten(part.column("codes").combine_chunks()).to_numpy(zero_copy_only=False).reshape(len(at), tables)
                # inside a block (s, s) every pair counts, between two blocks only pairs across
                within = (r["block"] >= 0) & (r["block"] // 100_000 == r["block"] % 100_000)
                r["block"] = np.where(within, -1, r["block"])
                b = np.cumsum(length)
                links, forest = compare(r, b - length, b, cosine)
                if links:
                    a = [*links, *(x for x, _ in forest)]
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array([None] * len(links) + [y for _, y in forest], pa.int64()), pa.array([*links.values()] + [None] * len(forest), pa.int64())], ["a", "b", "links"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            names = ["label", "dim", "table", "code", "block"]
            at = lambda b, i: [b.column(c)[i].as_py() for c in names]
            last = at(batch, batch.num_rows - 1)
            if held and at(held[-1], held[-1].num_rows - 1) == last:
                held.append(batch)
                continue
            k = batch.num_rows - 1
            while k and at(batch, k - 1) == last:
                k -= 1
            if held or k:
                yield from found(pa.Table.from_batches([*held, batch.slice(0, k)]).combine_chunks())
            held = [batch.slice(k)]
        if held:
            yield from found(pa.Table.from_batches(held).combine_chunks())

    out = persist(dealt.mapInArrow(tidy(run), "a long, b long, links long"))
    counts = out.filter("links is not null").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    linked = components(out.filter("b is not null").select("a", "b")).withColumnRenamed("node", "cid")
    known = hashed.select(*identity, "cid", "n").join(counts, "cid", "left").join(linked, "cid", "left")
    same = F.struct(*identity).alias("same")
    known = known.select(same, (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "cid").alias("component_id"))
    good = join_hot(persist(rows.select("vec_id", same)), known, "same").select("vec_id", "n_links", "component_id")
    bad = vectors.filter(~usable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(bad).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (SELECT vec_id, label, e FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = len(e) AND list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c USING (vec_id) LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a) USING (vec_id)
"""
