import math
import random
from collections import Counter

import numpy as np

from epochlake.llm import embeddings as e

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    ok = [(i, np.array(v, dtype=np.float32).astype(float), lab) for i, v, lab in rows if i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, comp = Counter(), {i: i for i, *_ in rows}
    for x in range(len(ok)):
        for y in range(x):
            (i, a, la), (j, b, lb) = ok[x], ok[y]
            if la == lb and len(a) == len(b) and a @ b / math.sqrt((a @ a) * (b @ b)) >= 0.98:
                links[i] += 1
                links[j] += 1
                p, q = sorted((comp[i], comp[j]))
                comp = {k: p if c == q else c for k, c in comp.items()}
    return {i: (links[i], comp[i], comp[i] == i) for i, *_ in rows}


def corpus():
    r = np.random.default_rng(2)
    rows = []
    for i in range(150):
        v = r.standard_normal(16)
        for _ in range(random.Random(i).choice([1, 1, 2, 5])):
            rows.append((v + r.standard_normal(16) * r.choice([0.01, 0.1, 0.2])).tolist())
    dense = r.standard_normal(16)
    rows += [(dense + r.standard_normal(16) * 0.05).tolist() for _ in range(90)]
    rows += [rows[-1]] * 40
    out = [(i, v, int(i % 2)) for i, v in enumerate(rows)]
    n = len(out)
    return [*out, (n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] * 16, 1), (n + 3, [None] + [1.0] * 15, 1), (n + 4, rows[0], None), (n + 5, [], 1), (n + 6, [1.0, 2.0], 1), (n + 7, [2.0, 4.0], 1), (n + 8, [float("inf")] * 16, 1)]


def test_matches_brute_force(spark, monkeypatch):
    rows = corpus()
    want = brute(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    get = lambda: {r.vec_id: (r.n_links, r.component_id, r.kept) for r in e.near_duplicates(df).collect()}
    assert get() == want
    monkeypatch.setattr(e, "BLOCK_ROWS", 25)  # hot buckets in blocks
    assert get() == want


def test_edge_cases(spark):
    assert e.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (2, [2.0, 0.0], 1)]
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in e.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [("2", 2, 2, True), ("3", 2, 2, False), ("3", 2, 2, False), ("None", 0, None, False)]


def test_tables():
    assert e.tables_for(0.98, 12, 1e-6) == math.ceil(math.log(1e-6) / math.log(1 - (1 - math.acos(0.98) / math.pi) ** 12))
