"""Near-duplicate passages inside documents: compact windows from Cartesian trees over min-hashes, an interval join, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WordHashes, join_hot, mix64, persist, shingle_hashes, slices, sweep, texts_of, tidy
from .pairs import paired_texts

#: Words of a passage, words in a shingle, least similarity, and hash functions.
PASSAGE, SHINGLE, SIMILARITY, HASHES = 50, 5, 0.8, 4
#: Shingles by which the places of two passages may be shifted against each other through inserted words.
SLACK = 5
#: Rows that are broadcast to tell copies from firsts; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def _constants(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(60411)
    return r.integers(0, 2**64, hashes + 1, dtype=np.uint64), r.integers(0, 2**63, hashes + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _least(packed: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of `width` values, by doubling."""
    out, have = packed, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def compact_windows(values: np.ndarray, counts: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, high, centre) of the Cartesian trees' nodes that cover `span` values or more, texts of counts[i] values one after another.

    A tree's root is the (first) least value of a text; left and right of it stand the trees of what comes before and after. A
    node c over values l to r is the least of every run inside l to r that holds c. Of these, the runs of `span` values start
    at low = max(l, c - span + 1) up to high = min(c, r - span + 1). So all runs of one node share its min-hash, every run
    has one node, and a random text has about 2 / span nodes for each value. Smaller subtrees are never built: the nodes are
    those values that are the least of some run, which sliding minima find.
    """
    total = len(values)
    if total < span:
        return (np.empty(0, np.int64),) * 3
    packed = values.astype(np.uint64) << np.uint64(32) | np.arange(total, dtype=np.uint64)
    centre = (_least(packed, span) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    ends = np.cumsum(counts)
    inside = np.arange(len(centre)) + span <= np.repeat(ends, counts)[: len(centre)]
    start = np.flatnonzero(inside)
    if not len(start):
        return (np.empty(0, np.int64),) * 3
    centre = centre[start]
    new = np.flatnonzero(np.concatenate(([True], (centre[1:] != centre[:-1]) | (start[1:] != start[:-1] + 1))))
    return start[new], start[np.append(new[1:], len(start)) - 1], centre[new]


def window_keys(hashed: np.ndarray, counts: np.ndarray, span: int, hashes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, second, place, text) of the compact windows of texts' shingles.

    A window has a key for each side of its centre: its min-hash with the least value, under a function of its own, among the
    next span // 2 shingles on that side; `second` is the other side's least value, zero where the text ends before. Two
    passages of `span` shingles that are equal share a key for each function, for one of the sides lies inside the passage.
    place packs the centre, counted in its text, and how far back from it the runs start.
    """
    xor, mult = _constants(hashes)
    side = span // 2
    begins = np.cumsum(counts) - counts
    text_of = np.repeat(np.arange(len(counts)), counts)
    ends = begins + counts
    near = _least(((hashed ^ xor[-1]) * mult[-1]) >> np.uint64(32), side) if len(hashed) >= side else np.empty(0, np.uint64)
    keys, seconds, places, owners = [], [], [], []
    for k in range(hashes):
        v = ((hashed ^ xor[k]) * mult[k]) >> np.uint64(32)
        low, high, c = compact_windows(v, counts, span)
        if not len(c):
            continue
        text = text_of[c]
        place = (c - begins[text]) << 24 | (c - low) << 12 | (c - high)
        own = mix64(hashed[c] ^ xor[k])
        has_left, has_right = c - side >= begins[text], c + side < ends[text]
        left, right = np.zeros(len(c), np.uint64), np.zeros(len(c), np.uint64)
        left[has_left] = near[c[has_left] - side]
        right[has_right] = near[c[has_right] + 1]
        for has, mine, other, salt in ((has_left, left, right, 11), (has_right, right, left, 23)):
            keys.append(mix64(own[has] + (mine[has] << np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)))
            seconds.append(other[has])
            places.append(place[has])
            owners.append(text[has])
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(keys), np.concatenate(seconds), np.concatenate(places), np.concatenate(owners)


def meet(a: np.ndarray, b: np.ndarray, slack: int = SLACK) -> np.ndarray:
    """Whether windows at the places a and b, centre laid on centre, hold runs that start at most `slack` apart."""
    mask = 4095
    return np.maximum(a & mask, b & mask) <= np.minimum(a >> 12 & mask, b >> 12 & mask) + slack


def _pair_rows(a: np.ndarray, b: np.ndarray, at: np.ndarray, bt: np.ndarray) -> pa.RecordBatch | None:
    keep = np.flatnonzero((a != b) & meet(at, bt))
    if not len(keep):
        return None
    a, b, at, bt = a[keep], b[keep], at[keep] >> 24, bt[keep] >> 24
    swap = a > b
    return pa.RecordBatch.from_arrays([pa.array(np.where(swap, b, a)), pa.array(np.where(swap, a, b)), pa.array(np.where(swap, at - bt, bt - at))], ["a", "b", "shift"])


def text_key() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def shared_windows(texts: DataFrame, passage: int, shingle: int, hashes: int) -> DataFrame:
    """(a, b, shift): texts, by key, that share a window's key, with the second's place less the first's; repeated.

    Each window of a key is paired with that of the smallest text, and with another that also agrees on the other side where
    the first doesn't. Windows alike in key and second are reduced to one in each task before they are shuffled, and the
    others are paired with that one: what very many texts share reaches the key's task once for each task before.
    """
    span = passage - shingle + 1
    if not 2 <= span < 4096:
        raise ValueError("a passage must hold from 2 to 4095 shingles")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        hot_key, hot_text, hot_place = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        for part in slices(batches, "text"):
            split = [t.lower().split() for t in texts_of(part, "text")]
            counts = np.array([len(w) for w in split])
            words = np.fromiter((h for w in split for h in map(cache.__getitem__, w)), dtype=np.uint64, count=int(counts.sum()))
            hashed, n = shingle_hashes(words, counts, shingle)
            key, second, place, owner = window_keys(hashed, n, span, hashes)
            if not len(key):
                continue
            ids = part.column("key").to_numpy(zero_copy_only=False)[owner]
            whole = mix64(key ^ (second * np.uint64(0xBF58476D1CE4E5B9)))
            order = np.lexsort((ids, whole))
            first = np.concatenate(([True], whole[order][1:] != whole[order][:-1]))
            lead = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
            lead_id, lead_place = ids[lead], place[lead]
            if len(hot_key):
                at = np.minimum(np.searchsorted(hot_key, whole[order]), len(hot_key) - 1)
                known = hot_key[at] == whole[order]
                lead_id, lead_place = np.where(known, hot_text[at], lead_id), np.where(known, hot_place[at], lead_place)
                first &= ~known
            again = ~first & (ids[order] != lead_id)
            out = order[first]
            columns = [key[out].view(np.int64), second[out].astype(np.int64), ids[out], place[out]]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.nulls(len(out), pa.int64()), pa.nulls(len(out), pa.int64())], names)
            if again.any():
                out = order[again]
                columns = [key[out].view(np.int64), second[out].astype(np.int64), ids[out], place[out], lead_id[again], lead_place[again]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], names)
                new = np.unique(whole[out])
                fresh = new[~np.isin(new, hot_key)] if len(hot_key) else new
                if len(fresh):
                    of = order[first]
                    of = of[np.isin(whole[of], fresh)]
                    merged = np.concatenate([hot_key, whole[of]])
                    by = np.argsort(merged)
                    hot_key, hot_text, hot_place = merged[by], np.concatenate([hot_text, ids[of]])[by], np.concatenate([hot_place, place[of]])[by]

    names = ["key", "second", "text", "place", "other", "other_place"]
    rows = texts.select("key", F.col("text").cast("string").alias("text")).mapInArrow(tidy(windows), "key long, second long, text long, place long, other long, other_place long")
    # what is paired already needs no meeting with others; it is dealt by the text
    dealt = F.when(F.col("other").isNull(), F.col("key")).otherwise(F.xxhash64("text"))
    rows = rows.withColumn("key", dealt).repartition("key").sortWithinPartitions("key", "text", "place")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = None  # key, text, place and second of the group that the last batch ended with
        for batch in batches:
            if not batch.num_rows:
                continue
            paired = batch.column("other").is_valid().to_numpy(zero_copy_only=False)
            if paired.any():
                done = batch.filter(pa.array(paired))
                found = _pair_rows(*(done.column(c).to_numpy() for c in ("text", "other", "place", "other_place")))
                if found:
                    yield found
                batch = batch.filter(pa.array(~paired))
                if not batch.num_rows:
                    continue
            key, second, text, place = (batch.column(c).to_numpy() for c in ("key", "second", "text", "place"))
            first = np.concatenate(([True], key[1:] != key[:-1]))
            at = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
            lead_text, lead_place, lead_second = text[at], place[at], second[at]
            if lead is not None and lead[0] == key[0]:
                own = at == 0
                lead_text, lead_place, lead_second = (np.where(own, v, x) for v, x in zip(lead[1:], (lead_text, lead_place, lead_second), strict=True))
            lead = key[-1], lead_text[-1], lead_place[-1], lead_second[-1]
            found = _pair_rows(lead_text, text, lead_place, place)
            if found:
                yield found
            rest = np.flatnonzero((second != lead_second) & (second != 0) & (text != lead_text))
            if len(rest) > 1:
                order = rest[np.lexsort((text[rest], second[rest], key[rest]))]
                same = (key[order][1:] == key[order][:-1]) & (second[order][1:] == second[order][:-1])
                head = order[np.maximum.accumulate(np.where(np.concatenate(([True], ~same)), np.arange(len(order)), 0))]
                found = _pair_rows(text[head], text[order], place[head], place[order])
                if found:
                    yield found

    return rows.mapInArrow(tidy(pairs), "a long, b long, shift long")


def _distinct_counts(place: np.ndarray, before: np.ndarray, span: int, runs: int) -> np.ndarray:
    """How many different values each run of `span` values holds: values at `place`, whose last equal one before is at `before`."""
    return _covering(np.maximum(before, place - span) + 1, place + 1, runs)


def _covering(begin: np.ndarray, end: np.ndarray, runs: int) -> np.ndarray:
    """How many of the intervals [begin, end) hold each of the places 0 to runs - 1."""
    begin, end = np.maximum(begin, 0), np.minimum(end, runs)
    ok = begin < end
    return np.cumsum(np.bincount(begin[ok], minlength=runs + 1) - np.bincount(end[ok], minlength=runs + 1))[:runs]


def _previous(values: np.ndarray) -> np.ndarray:
    order = np.argsort(values, kind="stable")
    out = np.full(len(values), -1, np.int64)
    same = values[order][1:] == values[order][:-1]
    out[order[1:][same]] = order[:-1][same]
    return out


def similar_runs(a: np.ndarray, b: np.ndarray, shifts: list[int], span: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Starts of runs of `span` shingles in a and b, laid on each other by the shifts, whose sets are as similar as that.

    A run of a starting at s is compared with that of b starting at s + shift: exactly, but for a value that b has several
    times, of which only the one nearest to its place in a is looked at; so nothing is found that isn't similar.
    """
    runs_a, runs_b = len(a) - span + 1, len(b) - span + 1
    if runs_a < 1 or runs_b < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    prev_a = _previous(a)
    size_a = _distinct_counts(np.arange(len(a)), prev_a, span, runs_a)
    size_b = _distinct_counts(np.arange(len(b)), _previous(b), span, runs_b)
    order = np.lexsort((np.arange(len(b)), b))
    sorted_b = b[order]
    lo, hi = np.searchsorted(sorted_b, a), np.searchsorted(sorted_b, a, side="right")
    held = np.flatnonzero(hi > lo)
    once = (hi - lo)[held] == 1
    values, many = np.unique(sorted_b, return_inverse=True)
    rank = many.astype(np.int64) * (len(b) + 1) + order  # ascending: by value, then place
    value_of = many[lo[held]].astype(np.int64) * (len(b) + 1) if len(held) else np.empty(0, np.int64)
    out_a, out_b = [], []
    for shift in shifts:
        first, last = max(0, -shift), min(runs_a, runs_b - shift)
        if first >= last or not len(held):
            continue
        want = held + shift
        if once.all():
            place = order[lo[held]]
        else:
            up = np.clip(np.searchsorted(rank, value_of + np.clip(want, 0, len(b))), lo[held], hi[held] - 1)
            down = np.maximum(up - 1, lo[held])
            place = np.where(np.abs(order[up] - want) <= np.abs(order[down] - want), order[up], order[down])
        there = place - shift
        begin = np.maximum(np.maximum(held, there) - span, prev_a[held]) + 1
        end = np.minimum(held, there) + 1
        both = _covering(begin, end, runs_a)[first:last]
        either = size_a[first:last] + size_b[first + shift : last + shift] - both
        good = np.flatnonzero(both >= similarity * either - 1e-9) + first
        out_a.append(good)
        out_b.append(good + shift)
    if not out_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.unique(np.concatenate(out_a)), np.unique(np.concatenate(out_b))


def spans_of(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """[start, end) of what runs of `length` words at the given starts, ascending, cover; runs that meet or overlap are one."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.concatenate(([0], cut + 1))].tolist(), (starts[np.append(cut, len(starts) - 1)] + length).tolist(), strict=True))


def verified_spans(texts: DataFrame, pairs: DataFrame, passage: int, shingle: int, similarity: float) -> DataFrame:
    """(text, start, end, other): words of a text in passages that are similar to one of another text; both sides of each pair."""
    span = passage - shingle + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, np.ndarray] = (None, np.empty(0, np.uint64))

        def hashed(text: bytes) -> np.ndarray:
            # Python's own 64-bit hashes serve here, as both texts are in one process
            words = text.lower().split()
            return shingle_hashes(np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64), np.array([len(words)]), shingle)[0]

        for part in slices(batches, "text_a"):
            out: list[tuple[int, int, int, int]] = []
            for a, b, shifts, x, y in zip(part.column("a").to_pylist(), part.column("b").to_pylist(), part.column("shifts").to_pylist(), texts_of(part, "text_a"), texts_of(part, "text_b"), strict=True):
                if a != last[0]:
                    last = a, hashed(x)
                in_a, in_b = similar_runs(last[1], hashed(y), shifts, span, similarity)
                out += [(a, s, e, b) for s, e in spans_of(in_a, passage)]
                out += [(b, s, e, a) for s, e in spans_of(in_b, passage)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["text", "start", "end", "other"])

    both = paired_texts(texts, pairs)
    return both.select("a", "b", "shifts", "text_a", "text_b").mapInArrow(tidy(run), "text long, start long, end long, other long")


def repeated_passages(docs: DataFrame, passage: int = PASSAGE, shingle: int = SHINGLE, similarity: float = SIMILARITY, hashes: int = HASHES) -> DataFrame:
    """(doc_id, copy_of, n_passages, repeated_words, passages) of every document that shares a passage with another one.

    A passage is a run of `passage` words; two are near-duplicates if their sets of `shingle`-word shingles (A-Z lowered, split
    at ASCII white space) have a Jaccard similarity of `similarity` or more. passages lists the spans of words, counted from 0,
    end excluded, that such passages cover, with `other`, the smallest doc_id among the texts they were verified against.
    Documents of equal text are one text: copy_of is the smallest doc_id among them, and where there are several, the whole
    text is repeated, with copy_of as `other`. A passage that only its own document repeats doesn't count. Shorter texts, null
    and empty ones have none, and documents without a repeated passage have no row. Null ids keep their rows (with `other`
    null if no id is known); repeated rows are copies of each other and keep a row each. Other columns are ignored. No rows:
    no rows.

    Passages that many documents share are verified against one of them, not all against all.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null").withColumn("key", text_key())
    found = persist(rows.select("doc_id", "key"))
    classes = persist(found.groupBy("key").agg(F.min("doc_id").alias("copy_of"), F.count("*").alias("n")))
    copies = classes.filter("n > 1").select("key", "copy_of")
    small = F.broadcast if copies.count() <= BROADCAST_ROWS else lambda x: x
    # of equal texts only the first is searched; rows without an id can't be told apart and are all searched
    known = small(copies.filter("copy_of is not null").withColumnRenamed("key", "_key"))
    firsts = rows.join(known, (F.col("key") == F.col("_key")) & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("copy_of"))), "left_anti").select("key", "text")
    pairs = persist(shared_windows(firsts, passage, shingle, hashes).groupBy("a", "b").agg(F.collect_set("shift").alias("shifts")))
    sweep(docs.sparkSession)  # the windows' shuffle, the largest, before texts are dealt
    spans = persist(verified_spans(firsts, pairs, passage, shingle, similarity))
    sweep(docs.sparkSession)
    # a text's spans: at most one for each of its words, whatever number of others they were verified against
    smallest = classes.select(F.col("key").alias("other"), F.col("copy_of").alias("other_id"))
    spans = persist(join_hot(spans, smallest, "other").groupBy("text", "start").agg(F.max("end").alias("end"), F.min("other_id").alias("other_id")))
    before = Window.partitionBy("text").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("text").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    islands = spans.withColumn("new", F.coalesce(F.col("start") > F.max("end").over(before), F.lit(True)).cast("int")).withColumn("island", F.sum("new").over(upto))
    islands = islands.groupBy("text", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("other_id").alias("other"))
    listed = F.sort_array(F.collect_list(F.struct("start", "end", "other")))
    partial = islands.groupBy(F.col("text").alias("key")).agg(listed.alias("passages"), F.sum(F.col("end") - F.col("start")).alias("repeated_words"))
    sizes = firsts.join(small(copies.select("key")), "key", "left_semi").groupBy("key").agg(F.max(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).cast("long").alias("n_words")).filter(F.col("n_words") >= passage)
    whole = classes.join(sizes, "key").select("key", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end"), F.col("copy_of").alias("other"))).alias("passages"), F.col("n_words").alias("repeated_words"))
    every = persist(whole.unionByName(partial.join(whole, "key", "left_anti")).join(classes, "key").select("key", "copy_of", "n", "passages", "repeated_words"))
    return join_hot(found, every, "key").select("doc_id", "copy_of", F.size("passages").alias("n_passages"), "repeated_words", "passages")


def cut_passages(docs: DataFrame, passage: int = PASSAGE, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, start, end, other, text) of each repeated passage, with its words as they stand in the text, joined by spaces."""
    found = repeated_passages(docs, passage, shingle, similarity)
    each = found.filter("doc_id is not null").select(F.col("doc_id").alias("_id"), F.explode("passages").alias("_p")).distinct()
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    joined = docs.join(each, F.col("doc_id").cast("long") == F.col("_id"))
    return joined.select(F.col("_id").alias("doc_id"), F.col("_p.start").alias("start"), F.col("_p.end").alias("end"), F.col("_p.other").alias("other"), F.array_join(F.slice(words, F.col("_p.start").cast("int") + 1, (F.col("_p.end") - F.col("_p.start")).cast("int")), " ").alias("text"))
