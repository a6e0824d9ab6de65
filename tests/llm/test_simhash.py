import random

import pytest
import xxhash
from pyspark.sql import types as T

from epochlake.llm import simhash
from epochlake.llm.simhash import deduplicate
from epochlake.llm.graph import components

SCHEMA = "doc_id long, text string"


def brute_fp(text, shingle=4):
    words = (text or "").encode().lower().split()
    parts = [words[i : i + shingle] for i in range(len(words) - shingle + 1)] or ([words] if words else [])
    h = [xxhash.xxh64_intdigest(b" ".join(p), 42) for p in parts]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def brute_components(fps, radius=4):
    ids = sorted(fps)
    comp = {i: i for i in ids}
    for i in ids:
        for j in ids:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= radius and comp[i] != comp[j]:
                a, b = sorted((comp[i], comp[j]))
                comp = {k: a if v == b else v for k, v in comp.items()}
    return comp


def corpus(n=60):
    r = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(r.choice(words) for _ in range(r.choice([1, 3, 4, 40, 400]))) for _ in range(n)]
    near = [t.replace(" ", "  ", 1) for t in base[:20]] + [t + " extra" for t in base[:40]] + [t.upper() for t in base[:10]]
    return dict(enumerate([*base, *near, "", None, " \t\n ", base[0], "é É A"]))


def test_matches_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame(list(docs.items()), SCHEMA)
    fps = {k: brute_fp(t) for k, t in docs.items()}
    want = brute_components(fps)
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.simhash_groups(df).collect()}
    assert got == {k: (fps[k], want[k]) for k in docs}
    assert len(set(want.values())) < len(docs)


def test_links_of_close_fingerprints(spark):
    r = random.Random(3)
    values = [r.getrandbits(64) for _ in range(200)]
    for v in values[:150]:
        for _ in range(r.randrange(6)):
            v ^= 1 << r.randrange(64)
        values.append(v)
    values += [v ^ 1 for v in values[:20]]
    values = list(dict.fromkeys(values))
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    links = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in signed], "fp long"))
    got = {r.node: r.component for r in components(links).collect()}
    want = brute_components(dict(zip(signed, values, strict=True)))
    groups = lambda comp: {frozenset(k for k in signed if comp.get(k, k) == c) for c in {comp.get(k, k) for k in signed}}
    assert groups(got) == groups(want)


def test_bk_tree_is_exact():
    r = random.Random(1)
    values = [r.getrandbits(12) for _ in range(500)]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    assert len(tree.values) == len(set(values))
    for q in values[:50]:
        assert sorted(tree.values[i] for i in tree.within(q, 2)) == sorted(v for v in set(values) if (v ^ q).bit_count() <= 2)


def test_deduplicate_keeps_one_of_each_group(spark):
    rows = [(3, "a b c d e", "x"), (1, "A b  c d e", "y"), (2, "something quite different in here", "z"), (None, "a b c d e", "n"), (7, "", "e"), (8, None, "e"), (2, "something quite different in here", "zz"), (9, "q r s t u v", "k"), (9, "a b c d e", "k2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted(((r.doc_id is None, r.doc_id, r.component_id) for r in simhash.deduplicate(df).collect()), key=str)
    assert sorted((i, c) for n, i, c in got if not n and i != 2) == [(1, "y"), (7, "e"), (9, "k")]
    assert [c for n, i, c in got if n] == ["n"]
    assert len([1 for n, i, c in got if i == 2]) == 1


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert simhash.simhash_groups(df).collect() == []
    assert simhash.deduplicate(df).collect() == []


def test_bad_blocks(spark):
    with pytest.raises(ValueError):
        simhash.fingerprint_links(spark.createDataFrame([], "fp long"), 4, 4)


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1080)] + [(5, 5), (None, 3)]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))).collect()}
    comp = {}
    good = [(a, b) for a, b in edges if a is not None and a != b]
    nodes = {x for e in good for x in e}
    comp = {n: n for n in nodes}
    for _ in range(100):
        for a, b in good:
            comp[a] = comp[b] = min(comp[a], comp[b])
    assert got == comp


def test_clashing_columns_stay(spark):
    r = random.Random(1)
    texts = [" ".join(r.choice("abcdefghij") for _ in range(30)) for _ in range(3)]
    rows = [(i % 4, texts[i % 3], i, i, i, "r") for i in range(12)] + [(None, texts[0], 50, 50, 50, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _simhash int, _nth int, _id int, row string")
    kept = deduplicate(docs).collect()
    assert [x for x in kept if x.doc_id is None] and all(x._simhash == x._nth == x._id for x in kept)
    assert {tuple(x) for x in kept} <= set(rows) and len({x.doc_id for x in kept if x.doc_id is not None}) == len([x for x in kept if x.doc_id is not None])
    from epochlake.llm import jaccard

    again = jaccard.deduplicate(docs.withColumnRenamed("_nth", "_key")).collect()
    assert all(x._simhash == x._key == x._id for x in again) and len(again) == len(kept)
