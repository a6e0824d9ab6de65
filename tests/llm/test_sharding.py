import random
import zlib
from collections import Counter

import pytest

from epochlake.llm import sharding as s

SCHEMA = "doc_id long, text string, shard string"


def corpus():
    r = random.Random(9)
    rows = [(i, f"text {i} " + "x" * r.randrange(200), "old") for i in range(400)]
    for g in range(40):
        rows += [(1000 + 10 * g + k, f"group {g} é", "old") for k in range(r.randrange(2, 6))]
    rows += [(5000 + k, "hot", "old") for k in range(300)]
    return [*rows, (None, "hot", "n"), (9000, None, "n"), (9001, "", "n"), (7, rows[7][1], "again"), (7, "other text", "again")]


def test_contract(spark):
    rows = corpus()
    got = s.assign(spark.createDataFrame(rows, SCHEMA)).collect()
    text = lambda t: (t or "").encode()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len(text(t)) + 8, zlib.crc32(text(t))) for i, t, _ in rows)
    counts = Counter(r["shard"] for r in got)
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    for k in counts:
        assert sorted(r.slot for r in got if r["shard"] == k) == list(range(counts[k]))
    groups = {}
    for r in got:
        groups.setdefault(r.text_crc32, []).append(r["shard"])
    together = [len(set(v)) == 1 for v in groups.values() if 1 < len(v) < 10]
    assert len(together) == 42 and sum(together) >= 0.9 * len(together)
    hot = Counter(groups[zlib.crc32(b"hot")])
    assert hot.most_common(1)[0][1] >= 0.7 * min(counts.values())


def test_propagation_on_a_chain_keeps_counts(spark):
    nodes = spark.range(100).select("id").withColumnRenamed("id", "node")
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 20)] + [(3, 3)], "a long, b long")
    start = Counter(i % 7 for i in range(100))
    got = s.propagate(nodes, links, 7, 4).collect()
    assert Counter(r["shard"] for r in got) == start and len({r.node for r in got}) == 100
    where = {r.node: r["shard"] for r in got}
    assert sum(where[i] == where[i + 1] for i in range(20)) > 2


def test_rows_keep_their_columns(spark):
    rows = corpus()
    got = s.shard(spark.createDataFrame(rows, SCHEMA + "").withColumnRenamed("shard", "lang")).collect()
    assert Counter((r.doc_id, r.text, r.lang) for r in got) == Counter(rows)
    assert len({(r["shard"], r.slot) for r in got}) == len(rows)


@pytest.mark.parametrize("n", [0, 3])
def test_few_rows(spark, n):
    df = spark.createDataFrame([(i, "same", None) for i in range(n)], SCHEMA)
    assert len(s.assign(df).collect()) == n


def cut(rows):
    """Links to the first of its group that a row has in another shard than most of the group."""
    groups = {}
    for r in rows:
        groups.setdefault(r.text_crc32, []).append(r["shard"])
    return sum(len(v) - max(Counter(v).values()) for v in groups.values() if len(v) < 50)


@pytest.mark.parametrize("hot", [0, 800])
def test_groups_stay_together_if_every_text_has_copies(spark, hot):
    rows = [(i, f"text {i // 2}", "") for i in range(2400 - hot)] + [(5000 + i, "hot", "") for i in range(hot)]
    got = s.assign(spark.createDataFrame(rows, SCHEMA)).collect()
    counts = Counter(r["shard"] for r in got)
    assert len(got) == 2400 and set(counts.values()) == {100} and cut(got) == 0
    assert len({r["shard"] for r in got if r.doc_id >= 5000}) == hot // 100


def test_packing_is_even_and_splits_few_groups():
    r = random.Random(3)
    for _ in range(300):
        counts = {n: r.randrange(1, 40) for n in r.sample(range(1, 30), r.randrange(1, 6))} | ({r.randrange(100, 900): 1} if r.random() < 0.5 else {})
        held, seen, whole = Counter(), Counter(), Counter()
        for n, first, end, shard, start, until in s.pack(counts, 8):
            assert 0 <= first < end <= counts[n] and 0 <= start < until <= n
            held[shard] += (end - first) * (until - start)
            seen[n] += (end - first) * (until - start)
            whole[n] += (end - first) * (until - start == n)
        assert seen == {n: n * c for n, c in counts.items()}
        sizes = [held[k] for k in range(8)]
        assert max(sizes) - min(sizes) <= 1
        assert sum(c - whole[n] for n, c in counts.items() if n <= max(sizes)) <= 8


def test_linked_nodes_change_places():
    grant = s.exchange({(0, 1): 5, (1, 0): 3, (1, 2): 2, (2, 0): 4}, [0, 0, 0])
    assert sum(grant.values()) == 10 or grant[0, 1] == grant[1, 0] + grant[1, 2]
    assert s.exchange({(0, 1): 5, (2, 0): 4}, [0, 2, 0]) == {(0, 1): 2, (2, 0): 2}
    assert s.exchange({(0, 1): 5}, [0, 0]) == {}


def test_propagation_swaps_nodes_that_all_have_links(spark):
    r = random.Random(8)
    nodes = list(range(480))
    r.shuffle(nodes)
    pairs = list(zip(nodes[::2], nodes[1::2], strict=True))
    got = s.propagate(spark.range(480).withColumnRenamed("id", "node"), spark.createDataFrame(pairs, "a long, b long"), 6, 4).collect()
    where = {x.node: x["shard"] for x in got}
    assert Counter(where.values()) == {k: 80 for k in range(6)}
    assert sum(where[a] == where[b] for a, b in pairs) >= 0.8 * len(pairs)


@pytest.mark.parametrize("unique", [0, 48, 480])
def test_pairs_stay_whole_whatever_the_share_of_unique_texts(spark, unique):
    rows = [(i, f"pair {i % 480}", "") for i in range(960)] + [(2000 + i, f"alone {i}", "") for i in range(unique)]
    got = s.assign(spark.createDataFrame(rows, SCHEMA)).collect()
    counts = Counter(r["shard"] for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and cut(got) == 0


def test_clashing_columns_and_ties(spark):
    rows = [(1 if i % 2 else None, "same", i, bytes([i]), i) for i in range(60)] + [(5, "x" * 3_000_000, 99, b"c", 99)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _mark int, slot binary, row int")
    first = s.shard(df, 4).collect()
    assert sorted((x._mark, x.row) for x in first) == sorted((r[2], r[4]) for r in rows)
    assert len({(x["shard"], x.slot) for x in first}) == len(rows)
    again = s.shard(df.repartition(5), 4).collect()
    assert sorted((x._mark, x["shard"], x.slot) for x in first) == sorted((x._mark, x["shard"], x.slot) for x in again)
