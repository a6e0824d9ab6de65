import random
import zlib

import numpy as np

from epochlake.llm import toxicity as x


def corpus(n=500):
    r = random.Random(8)
    part = ["ka", "lo", "mi", "tu", "re", "sa", "ne", "po"]
    word = lambda: "".join(r.choice(part) for _ in range(r.randrange(1, 4)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(r.choice([3, 40, 200, 500]))]
        toxic = int(r.random() < 0.3)
        if toxic:
            for _ in range(1 + len(words) // 60):
                words.insert(r.randrange(len(words) + 1), r.choice(["zonkhead", "Blarg!", "grumf" + word()]))
        rows.append((i, " ".join(words), toxic))
    return rows


def test_gradients():
    r = np.random.default_rng(0)
    n = x.HIDDEN
    p = {"x": r.standard_normal((3, 6 * n)), "b": r.standard_normal(6 * n), "u": r.standard_normal((2, n, 3 * n)), "c": r.standard_normal((2, 3 * n)), "v": r.standard_normal(2 * n), "w": r.standard_normal(2 * n), "bias": r.standard_normal(1)}
    features = r.standard_normal((5, 3))
    index = r.integers(0, 5, (4, 6))
    mask = (np.arange(6) < np.array([6, 4, 1, 6])[:, None]).astype(float)
    d = r.standard_normal(4)
    loss = lambda: float(x.forward(p, features @ p["x"] + p["b"], index, mask) @ d)
    _, kept = x.forward(p, features @ p["x"] + p["b"], index, mask, True)
    grad, dinputs = x.backward(p, kept, index, mask, d, 5)
    grad["x"], grad["b"] = features.T @ dinputs, dinputs.sum(axis=0)
    for name, g in grad.items():
        for k in r.integers(0, p[name].size, 6):
            old = p[name].flat[k]
            p[name].flat[k] = old + 1e-5
            up = loss()
            p[name].flat[k] = old - 1e-5
            down = loss()
            p[name].flat[k] = old
            assert abs((up - down) / 2e-5 - np.asarray(g).flat[k]) < 1e-4 * max(1, abs(np.asarray(g).flat[k])), name


def test_windows_cover_every_word():
    counts = np.array([0, 1, 63, 64, 65, 111, 112, 113, 1000, 0])
    text, start, end = x.windows_of(counts)
    base = np.cumsum(counts) - counts
    for k, n in enumerate(counts):
        own = text == k
        assert set(np.concatenate([np.arange(a, b) for a, b in zip(start[own], end[own], strict=True)] or [[]]).astype(int)) == set(range(base[k], base[k] + n))
        assert (end[own] - start[own] <= x.WINDOW).all()


def test_held_out_accuracy_and_contract(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows] + [(9000, None, "s"), (9001, "", "s"), (None, "zonkhead", "s"), (5, rows[5][1], "s")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, 1, t) for i, _, t in rows] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    model = x.train(docs, labels)
    got = x.score(docs, model).collect()
    assert len(got) == len(rows) + 4 and all(0 <= r.toxic_score <= 1 for r in got) and {r.toxic for r in got} == {"s"}
    truth = {i: t for i, _, t in rows}
    out = [(r.toxic_score >= 0.5) == truth[r.doc_id] for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(out) > 50 and np.mean(out) > 0.95
    assert {r.doc_id for r in got if r.text in (None, "") and r.toxic_score >= 0.5} == set()
    # labels of held-out rows change nothing
    other = spark.createDataFrame([(i, 1, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, _, t in rows], "doc_id long, quality int, toxic int")
    again = {r.doc_id: r.toxic_score for r in x.score(docs, x.train(docs, other)).collect()}
    assert again == {r.doc_id: r.toxic_score for r in got}
    kept = x.detoxify(docs, labels)
    assert kept.columns == docs.columns and kept.count() == len([r for r in got if r.toxic_score < 0.5])


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.toxic_score for r in x.score(docs, x.train(docs, none)).collect()] == [0.0, 0.0]
    assert x.score(spark.createDataFrame([], "doc_id long, text string"), {"constant": 0.0, "id": "x"}).collect() == []


def test_scores_do_not_depend_on_neighbours():
    rows = corpus(200)
    model = x.fit([t for _, t, _ in rows], [t for *_, t in rows])
    texts = [t.encode() for _, t, _ in rows]
    together = x.scores(model, texts)
    alone = np.array([x.scores(model, [t])[0] for t in texts[:40]])
    assert np.allclose(together[:40], alone, atol=1e-5)


def plain_score(m, text):
    """The score of a text, word by word and window by window, in plain Python."""
    import math

    import xxhash

    sigmoid = lambda v: 1 / (1 + math.exp(-v))
    own = dict(zip(m["words"][0].tolist(), m["words"][1].tolist(), strict=True))
    runs = dict(zip(m["runs"][0].tolist(), m["runs"][1].tolist(), strict=True))

    def run_hash(piece):
        h = 0
        for byte in piece:
            h = (h * 0x100000001B3 + byte + 1) % 2**64
        h = (h ^ h >> 29) * 0x9E3779B97F4A7C15 % 2**64
        return h ^ h >> 32

    def inputs(word):
        marked = b"<" + word + b">"
        out = [own.get(xxhash.xxh64_intdigest(word), 0.0)]
        for n in x.RUNS:
            out.append(max((runs.get(run_hash(marked[i : i + n]), 0.0) for i in range(len(marked) - n + 1)), default=-1.0))
        return out

    words = [w for w in ("".join(c for c in w if c.isalnum()).lower().encode() for w in text.split()) if w]
    if not words:
        return m["empty"]
    n, best = x.HIDDEN, -math.inf
    for start in range(0, max(1, len(words) - x.WINDOW + x.STEP), x.STEP):
        window = [inputs(w) for w in words[start : start + x.WINDOW]]
        states = []
        for d in (0, 1):
            h, each = [0.0] * n, []
            for features in window if d == 0 else window[::-1]:
                gate = [sum(f * m["x"][k][3 * n * d + j] for k, f in enumerate(features)) + m["b"][3 * n * d + j] for j in range(3 * n)]
                a = [sum(h[k] * m["u"][d][k][j] for k in range(n)) + m["c"][d][j] for j in range(3 * n)]
                z, r = [[sigmoid(gate[o + j] + a[o + j]) for j in range(n)] for o in (0, n)]
                new = [math.tanh(gate[2 * n + j] + r[j] * a[2 * n + j]) for j in range(n)]
                h = [z[j] * h[j] + (1 - z[j]) * new[j] for j in range(n)]
                each.append(h)
            states.append(each if d == 0 else each[::-1])
        both = [f + b for f, b in zip(*states, strict=True)]
        e = [math.exp(sum(v * s for v, s in zip(m["v"], state, strict=True))) for state in both]
        pooled = [sum(w * state[j] for w, state in zip(e, both, strict=True)) / sum(e) for j in range(2 * n)]
        best = max(best, sum(w * v for w, v in zip(m["w"], pooled, strict=True)) + m["bias"][0])
    a, b = m["scale"]
    return sigmoid(a * best + b)


def test_scores_against_plain_python():
    rows = corpus(160)
    m = x.fit([t for _, t, _ in rows], [y for *_, y in rows])
    texts = ["", " .. ", "zonkhead", "one two Blarg! three", *(t for _, t, _ in rows[:12]), "ka lo, mi " * 90]
    got = x.scores(m, [t.encode() for t in texts])
    assert np.abs(got - [plain_score(m, t) for t in texts]).max() < 1e-3
