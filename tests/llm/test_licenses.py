import math
import random
from collections import Counter

from epochlake.llm import licenses as m

TEXTS = [("MIT", "Released under the MIT License"), ("Apache-2.0", "Licensed under the Apache License, Version 2.0"), ("GPL-3.0", "licensed under the GNU General Public License, version 3"), ("GPL-2.0", "licensed under the GNU General Public License, version 2")]
SCHEMA = "path string, text string"


def words(text):
    return ["".join(g) for g in __import__("re").findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))]


def brute(files, texts, least=m.COSINE):
    """The best cosine of every run of words to every template: path -> (license, cosine)."""
    known = {w for _, t in texts for w in words(t)}
    docs = [words(t) for _, t in files]
    df = Counter(w for d in docs for w in set(d))
    idf = lambda w: 1 + math.log((1 + len(docs)) / (1 + (df[w] if w in known else 0)))

    def cosine(run, template):
        a, b = Counter(run), Counter(template)
        norm = sum((n if w in known else math.sqrt(n)) ** 2 * idf(w) ** 2 for w, n in a.items())
        return sum(a[w] * b[w] * idf(w) ** 2 for w in b) / math.sqrt(norm * sum((n * idf(w)) ** 2 for w, n in b.items()))

    out = []
    for d in docs:
        best = (0.0, 0, None)
        for name, t in texts:
            t = words(t)
            for s in range(max(1, len(d) - len(t) + 1) if d else 0):
                c = round(cosine(d[s : s + len(t)], t), 9)
                if c >= least and (c, len(t)) > best[:2]:
                    best = (c, len(t), name)
        out.append((best[2], best[0] if best[2] else None))
    return out


def test_notices_against_brute_force(spark):
    r = random.Random(2)
    common = ["the", "of", "license", "under", "version", "prose", "mit", "work", "été", "x9"]
    rows = []
    for k in range(120):
        body = [r.choice(common) for _ in range(r.choice([0, 1, 6, 40]))]
        if k % 3 == 0:
            notice = r.choice(TEXTS)[1].split()
            if k % 2:
                notice[r.randrange(len(notice))] = r.choice(["the", "other", "(the)"])
            at = r.randrange(len(body) + 1)
            body[at:at] = [("// " if k % 4 else "") + w for w in notice]
        rows.append((f"a/{k}", " ".join(body)))
    rows += [("n", None), ("e", ""), ("p", " -- "), ("up", "LICENSED UNDER THE APACHE LICENSE VERSION 2.0!"), ("long", "prose " * 50000 + TEXTS[0][1])]
    got = {g.path: g for g in m.scan(spark.createDataFrame(rows, SCHEMA).repartition(3), TEXTS).collect()}
    want = brute(rows, TEXTS)
    assert len(got) == len(rows) and sum(n is not None for n, _ in want) > 30
    for (path, _), (name, score) in zip(rows, want, strict=True):
        assert got[path].license == name, (path, want)
        assert (got[path].score is None) == (score is None) and (score is None or abs(got[path].score - score) < 1e-8)
    assert (got["long"].license, got["long"].first_word) == ("MIT", 50000)


def test_nearest_ancestor_gives_its_licence(spark, monkeypatch):
    mit, apache = TEXTS[0][1], TEXTS[1][1]
    rows = [
        ("LICENSE", mit), ("a.py", "code"), ("lib/x/y/b.py", "code"), ("lib/COPYING.txt", apache + " and a lot of other words that follow it here"),
        ("lib/own.py", "code " * 30 + mit), ("./lib//x/c.py", ""), ("lib/x/terms", mit), ("lib/x/y/LICENSE", "no template says this"), ("other/d.py", None), (None, "code"), ("lib/x/c.py", ""), ("lib/x/c.py", ""),
    ]
    for limit in (m.BROADCAST_DIRS, 0):
        monkeypatch.setattr(m, "BROADCAST_DIRS", limit)
        got = sorted(((g.path or "", g.license, g.inherited, g.inherited_from, g.is_license_file) for g in m.scan(spark.createDataFrame(rows, SCHEMA), TEXTS).collect()), key=str)
        assert got == sorted([
            ("LICENSE", "MIT", None, None, True), ("a.py", None, "MIT", "LICENSE", False), ("lib/x/y/b.py", None, "MIT", "lib/x/terms", False), ("lib/COPYING.txt", "Apache-2.0", None, None, True),
            ("lib/own.py", "MIT", None, None, False), ("./lib//x/c.py", None, "MIT", "lib/x/terms", False), ("lib/x/terms", "MIT", None, None, True), ("lib/x/y/LICENSE", None, "MIT", "lib/x/terms", True),
            ("other/d.py", None, "MIT", "LICENSE", False), ("", None, None, None, False), ("lib/x/c.py", None, "MIT", "lib/x/terms", False), ("lib/x/c.py", None, "MIT", "lib/x/terms", False),
        ], key=str), got


def test_empty_table_and_other_columns(spark, monkeypatch):
    assert m.scan(spark.createDataFrame([], SCHEMA)).count() == 0
    clash = spark.createDataFrame([("a/b", TEXTS[0][1], "x", 1, "_")], "path string, text string, license string, directory int, _salt string")
    for limit in (m.BROADCAST_DIRS, 0):
        monkeypatch.setattr(m, "BROADCAST_DIRS", limit)
        got = m.scan(clash).collect()[0]
        assert (got.license, got.directory, got._salt) == ("MIT", "a", "_")


def test_every_template_finds_itself(spark):
    texts = m.templates()
    rows = [(str(k), f"some words before it {t} and some after") for k, (_, t) in enumerate(texts)]
    got = {int(g.path): g for g in m.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    for k, (name, _) in enumerate(texts):
        assert name in got[k].licenses or name in ("BSD-2-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0"), (name, got[k])
        assert got[k].score > 0.999
