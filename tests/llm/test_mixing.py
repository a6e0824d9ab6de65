import random
from collections import Counter, defaultdict

import numpy as np

from epochlake.llm import mixing as m

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)


def corpus():
    r = random.Random(4)
    rows = []
    for i in range(300):
        s = r.choice(["a", "a", "a", "b", "é", None, "tiny"]) if i else "tiny"
        if s == "tiny" and i > 20:
            s = "a"
        rows.append((i, " ".join(f"w{r.randrange(99)}" for _ in range(r.choice([0, 1, 30, 300]))), s))
    return [*rows, (900, None, "b"), (901, " \n", "zero"), (5, rows[5][1], rows[5][2]), (None, "x y z", "a")]


def test_targets():
    got = m.targets([("a", 100), ("b", 100), (None, 100)])
    assert abs(sum(got) - 450) < 1e-9 and got[0] == 200 and all(g <= 200 for g in got)
    assert m.targets([]) == [] and m.targets([("a", 0)]) == [0.0]
    assert abs(m.targets([("a", 10)])[0] - 15) < 1e-9


def test_permutation():
    for n in (1, 2, 3, 10, 1000, 4097):
        assert sorted(m.permuted(np.arange(n), n, 5).tolist()) == list(range(n))


def test_draws_meet_quotas():
    rows = m.draw([1000, 0, 37, 5], 100, 3)
    assert {s: sum(n for _, t, _, n in rows if t == s) for s in (0, 2, 3)} == {0: 1000, 2: 37, 3: 5}
    per = Counter()
    for k, _, _, n in rows:
        per[k] += n
    assert all(v == 100 for k, v in per.items() if k < max(per))


def test_contract(spark):
    rows = corpus()
    df = docs(spark, rows)
    got = m.mix_sizes(df).collect()
    assert len(got) == len(rows)
    size = lambda t: len((t or "").encode().split())
    per = defaultdict(int)
    for _, t, s in rows:
        per[s] += size(t)
    order = sorted(per, key=lambda s: (s is None, (s or "").encode()))
    want = dict(zip(order, m.targets([(s, per[s]) for s in order]), strict=True))
    assert sorted((str(r.doc_id), r.size, r.source_size, r.target) for r in got) == sorted((str(i), size(t), per[s], want[s]) for i, t, s in rows)
    assert all(r.taken <= 2 * r.size for r in got)
    taken = defaultdict(int)
    for r in got:
        taken[r.target, r.source_size] += r.taken
    for s in order:
        assert abs(taken[want[s], per[s]] - want[s]) <= m.BLOCK, s
    assert sorted(map(str, got)) == sorted(map(str, m.mix_sizes(df).collect()))


def test_mix_as_documents(spark):
    rows = corpus()
    df = docs(spark, rows)
    sizes = {(r.doc_id, r.size): r.taken for r in m.mix_sizes(df).collect()}
    out = m.mix(df).collect()
    got = Counter()
    for r in out:
        got[r.doc_id] += len(r.text.encode().split())
        assert r.n_chars == len(r.text)
    want = Counter()
    for r in m.mix_sizes(df).collect():
        want[r.doc_id] += r.taken
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
    by = {i: t for i, t, _ in rows}
    for r in out:
        words = by[r.doc_id].split()
        part = r.text.split()
        assert all(w in words for w in part)
    assert sizes


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert m.mix_sizes(df).collect() == [] and m.mix(df).collect() == []


def test_clashing_columns_ties_and_long_texts_stay(spark):
    rows = [(i % 5, f"same text {i % 3} " + "w " * 200, "en", "a", 1, i, i, i) for i in range(40)] + [(100, "w " * 300_000, "en", "b", 2, 7, 7, 7), (None, "x " * 100, None, None, None, 8, 8, 8)]
    df = spark.createDataFrame(rows, SCHEMA + ", _mark int, _cuts int, row int")
    out = m.mix(df).collect()
    assert all(r._mark == r._cuts == r.row for r in out) and {r._mark for r in out} >= {7, 8}
    assert all(r.n_chars == len(r.text) for r in out)
    assert sorted(map(str, out)) == sorted(map(str, m.mix(df.repartition(7)).collect()))
    taken = sum(len(r.text.split()) for r in out)
    assert taken == sum(r.taken for r in m.mix_sizes(df).collect())


def test_targets_of_small_sources_are_met_within_a_sixty_fourth(spark):
    rows = [(i, "w " * n, s) for i, (n, s) in enumerate([(10, "a"), (40, "b"), (100, "c"), (700, "d"), (90_000, "e")])]
    for r in m.mix_sizes(docs(spark, rows)).collect():
        assert abs(r.taken - r.target) <= max(1, r.source_size / 64), r


def test_shards_can_be_drawn_apart():
    quotas = [500, 0, 12345, 7, 90_000]
    whole = m.draw(quotas, 128, 5)
    parts = [row for k in range(0, 900, 100) for row in m.draw(quotas, 128, 5, k, k + 100)]
    assert sorted(whole) == sorted(parts)
    seen = {}
    for _, s, first, n in sorted(whole):  # a source's slots have no gaps
        assert first == seen.get(s, 0)
        seen[s] = first + n
    assert seen == {s: q for s, q in enumerate(quotas) if q}


def brute_targets(sizes):
    """What each source gives, by handing out words a little at a time to those that may still take them."""
    weights = [m.WEIGHTS[i % 3] for i in range(len(sizes))]
    left, out = m.SHARE * sum(sizes), [0.0] * len(sizes)
    while left > 1e-6:
        free = [i for i, n in enumerate(sizes) if out[i] < 2 * n - 1e-9]
        if not free:
            break
        step = min([left / sum(weights[i] for i in free)] + [(2 * sizes[i] - out[i]) / weights[i] for i in free])
        for i in free:
            out[i] += step * weights[i]
            left -= step * weights[i]
    return out


def test_targets_against_brute_force():
    r = random.Random(6)
    for _ in range(200):
        sizes = [r.choice([0, 1, 50, 1000, 10**6]) for _ in range(r.randrange(1, 9))]
        want = brute_targets(sizes)
        got = m.targets([(str(i), n) for i, n in enumerate(sizes)])
        assert all(abs(a - b) <= 1e-6 * max(1, b) for a, b in zip(got, want, strict=True)), (sizes, got, want)
