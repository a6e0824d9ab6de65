import random

from epochlake.llm import decontaminate as d

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def brute(docs, items, width=5, least=0.8):
    out = set()
    for i, t in docs:
        s = d.shingles(d.normal_words((t or "").encode()), width)
        for k, q in items:
            w = d.shingles(d.normal_words((q or "").encode()), width)
            if w and len(s & w) >= least * len(w) - 1e-9:
                out.add((i, k, len(w), len(s & w)))
    return out


def data():
    r = random.Random(11)
    words = [f"tok{i}" for i in range(400)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(i, text(r.choice([1, 4, 5, 6, 9, 14, 30, 59, 200]))) for i in range(60)] + [(100, None), (101, ""), (102, "..."), (7, text(20))]
    docs = []
    for i in range(120):
        own = text(r.choice([0, 3, 50, 900])).split(" ")
        if i % 2:
            item = r.choice(items)[1] or ""
            own.insert(r.randrange(len(own) + 1), item.upper() if i % 3 else item.replace(" ", ", "))
        if i % 5 == 0:
            item = (r.choice(items[:60])[1]).split(" ")
            for k in range(0, len(item), 12):  # scattered through the text
                own.insert(r.randrange(len(own) + 1), " ".join(item[k : k + 16]))
        docs.append((i, "\n".join(own)))
    return [*docs, (500, None), (501, ""), (None, items[3][1]), (502, items[3][1]), (502, items[3][1])], items


def test_matches_brute_force(spark):
    docs, items = data()
    got = [tuple(r)[:4] for r in d.contained_items(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()]
    want = brute(docs, items)
    assert set(got) == want and len(want) > 40
    assert len([g for g in got if g[0] == 502]) == 2 * len([w for w in want if w[0] == 502])


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    docs, items = data()
    a = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    want = sorted(map(str, d.contained_items(*a).collect()))
    monkeypatch.setattr(d, "BLOCK_BYTES", 3000)
    assert sorted(map(str, d.contained_items(*a).collect())) == want
    kept = {r.doc_id for r in d.decontaminate(*a).collect()}
    assert kept == {i for i, _ in docs} - {i for i, *_ in brute(docs, items)}


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 5)], DOCS + ", item_id long")
    none = spark.createDataFrame([], ITEMS)
    assert d.contained_items(docs, none).collect() == []
    assert [tuple(r) for r in d.decontaminate(docs, none).collect()] == [(1, "a b c d e f", 5)]
    some = spark.createDataFrame([(1, "b c d e f", "x")], ITEMS + ", doc_id string")
    assert d.contained_items(spark.createDataFrame([], DOCS), some).collect() == []
    assert d.decontaminate(docs, some).collect() == []
