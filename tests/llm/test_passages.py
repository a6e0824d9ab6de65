import random

import numpy as np
from epochlake.llm import pairs, passages as p
from epochlake.llm.jaccard import similarity_of

SCHEMA = "doc_id long, text string"


def tree_nodes(values, span):
    """(low, high, centre) by building the whole Cartesian tree."""
    out, todo = [], [(0, len(values) - 1)]
    while todo:
        l, r = todo.pop()
        if r - l + 1 < span:
            continue
        c = min(range(l, r + 1), key=lambda i: (values[i], i))
        out.append((max(l, c - span + 1), min(c, r - span + 1), c))
        todo += [(l, c - 1), (c + 1, r)]
    return sorted(out)


def test_compact_windows_are_the_nodes_of_cartesian_trees():
    r = np.random.default_rng(3)
    for span in (2, 5, 16):
        texts = [r.integers(0, top, n).astype(np.uint64) for n, top in ((1, 9), (40, 1000), (0, 2), (77, 6), (16, 3), (5, 1), (60, 1))]
        low, high, centre = p.compact_windows(np.concatenate(texts), np.array([len(t) for t in texts]), span)
        want, base = [], 0
        for t in texts:
            want += [(a + base, b + base, c + base) for a, b, c in tree_nodes(t.tolist(), span)]
            base += len(t)
        assert sorted(zip(low.tolist(), high.tolist(), centre.tolist(), strict=True)) == sorted(want)


def runs(text, passage=p.PASSAGE):
    words = (text or "").encode().lower().split()
    return [{b" ".join(words[k : k + p.SHINGLE]) for k in range(i, i + passage - p.SHINGLE + 1)} for i in range(len(words) - passage + 1)]


def brute(rows):
    """For each text, the starts of its runs that are similar to a run of another text, by comparing all with all."""
    texts = sorted({t for _, t in rows if t is not None})
    each = {t: runs(t) for t in texts}
    out = {t: set() for t in texts}
    for a in texts:
        for b in texts:
            if a < b:
                for i, x in enumerate(each[a]):
                    for j, y in enumerate(each[b]):
                        if not x.isdisjoint(y) and similarity_of(x, y) >= p.SIMILARITY:
                            out[a].add(i)
                            out[b].add(j)
    return out


def corpus():
    r = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    draw = lambda n: [r.choice(words) for _ in range(n)]
    texts = [draw(r.choice([3, 50, 90, 140])) for _ in range(24)]
    shared = [draw(n) for n in (50, 55, 60, 80)]
    for k in range(16):  # exact and edited passages inside other words
        piece = list(shared[k % 4])
        if k >= 8:
            at = r.randrange(len(piece))
            piece[at : at + (k % 2)] = [f"new{k}"]
        texts.append([*draw(r.randrange(40)), *piece, *draw(r.randrange(40))])
    line = draw(12)
    texts += [[*draw(40), *line, *draw(30)] for _ in range(10)]  # a line alone isn't a passage
    texts += [["from"] * 70, ["FROM"] * 60]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rows += [(100, rows[24][1]), (101, rows[3][1]), (101, rows[3][1]), (None, rows[2][1]), (102, None), (103, ""), (104, " \n"), (105, "short text"), (106, "short text")]
    return rows


def covered(starts):
    return {w for s in starts for w in range(s, s + p.PASSAGE)}


def test_repeated_passages_against_brute_force(spark):
    rows = corpus()
    got = p.repeated_passages(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    want = brute(rows)
    copies = {}
    for i, t in rows:
        copies.setdefault(t, []).append(i)
    expected = {(i, t) for t, ids in copies.items() if t for i in ids if want[t] or len(ids) > 1 and len(t.split()) >= p.PASSAGE}
    text_of = {}
    for i, t in rows:
        text_of.setdefault(i, t)
    found = {(g.doc_id, text_of[g.doc_id]) for g in got}
    assert found <= expected and len(found) >= 0.9 * len(expected)
    assert {i for i in range(24, 32)} | {100, 101} <= {i for i, _ in found}  # exact ones are never missed
    caught = every = 0
    for g in got:
        t = text_of[g.doc_id]
        spans = {w for s in g.passages for w in range(s.start, s.end)}
        assert g.repeated_words == len(spans) and g.n_passages == len(g.passages)
        if len(copies[t]) > 1:
            assert spans == set(range(len(t.split()))) and g.copy_of == min(x for x in copies[t] if x is not None)
        else:
            assert spans <= covered(want[t])  # nothing is reported that isn't similar
            caught += len(spans)
            every += len(covered(want[t]))
    assert caught >= 0.9 * every
    assert sum(g.doc_id == 101 for g in got) == 2


def test_hot_passages_and_unbounded_sizes(spark, monkeypatch):
    r = random.Random(9)
    words = [f"w{i}" for i in range(20000)]
    hot = [r.choice(words) for _ in range(60)]
    line = [r.choice(words) for _ in range(30)]
    rows = [(i, " ".join([r.choice(words) for _ in range(r.randrange(60))] + hot + [r.choice(words) for _ in range(20)])) for i in range(120)]
    rows += [(200 + i, " ".join([r.choice(words) for _ in range(40)] + line + [r.choice(words) for _ in range(40)])) for i in range(120)]
    rows += [(500, " ".join(r.choice(words) for _ in range(60000)) + " " + " ".join(hot))]  # a very long text
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert {g.doc_id for g in p.repeated_passages(docs).collect()} == {*range(120), 500}
    pairs_made = p.shared_windows(docs.withColumn("key", p.text_key()), p.PASSAGE, p.SHINGLE, p.HASHES)
    assert pairs_made.select("a", "b").distinct().count() < 12 * len(rows)
    monkeypatch.setattr(p, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(pairs, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(pairs, "HUB_PAIRS", 7)
    again = p.repeated_passages(docs).collect()
    assert {g.doc_id for g in again} == {*range(120), 500}


def test_empty_table_and_other_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert p.repeated_passages(empty).count() == 0
    text = " ".join(f"w{i}" for i in range(60))
    clash = spark.createDataFrame([(1, text, 1, "x", 2, "p"), (2, text, 3, "y", 4, "q")], "doc_id long, text string, key int, passages string, n long, copy_of string")
    got = p.repeated_passages(clash).orderBy("doc_id").collect()
    assert [(g.doc_id, g.copy_of, g.repeated_words) for g in got] == [(1, 1, 60), (2, 1, 60)]
    cut = p.cut_passages(clash.select("doc_id", "text")).collect()
    assert [c.text for c in cut] == [text, text]
