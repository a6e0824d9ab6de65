import random
import zlib
from collections import Counter

import corpus_pipeline as p
from epochlake.llm import decontaminate as d
from tests.llm.test_simhash import brute_components, brute_fp


def test_stages_against_brute_force(spark, tmp_path):
    r = random.Random(12)
    vocabulary = [f"{a}{b}{c}" for a in "kltr" for b in ("a", "o", "ui") for c in ("n", "s", "ta", "mir", "q")]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(25)) for i in range(8)]
    rows, toxic = [], {}
    for i in range(420):
        t, bad = text(r.choice([30, 90, 300])), i % 4 == 1
        if bad:
            t = t.replace(" ", " zonkhead ", 1) + " you zonkhead " + t
        if i % 20 == 3:
            t += " " + r.choice(items)[1]
        rows.append((i, t, "en", f"s{i % 3}" if i % 2 else None, len(t)))
        toxic[i] = int(bad)
    for i in range(420, 480):
        of = rows[r.randrange(400)]
        rows.append((i, of[1].upper() if i % 2 else of[1], *of[2:]))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in p.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out-{name}")
        docs = spark.read.parquet(f"{tmp_path}/out-{name}")
        seen[name] = docs.collect()
        assert docs.columns[:5] == p.COLUMNS
    text_of = {i: t for i, t, *_ in rows}

    first = {x.doc_id for x in seen["toxicity"]}
    right = [(i in first) == ("zonkhead" not in t.lower()) for i, t in text_of.items()]
    assert sum(right) >= 0.99 * len(right)
    second = {x.doc_id for x in seen["simhash_near_dedup"]}
    assert second == set(brute_components({i: brute_fp(text_of[i]) for i in first}).values())
    sets = [d.shingles(d.normal_words(q.encode()), 5) for _, q in items]
    held = lambda t: any(len(d.shingles(d.normal_words(t.encode()), 5) & s) >= 0.8 * len(s) for s in sets)
    third = {x.doc_id for x in seen["benchmark_decontamination"]}
    assert third == {i for i in second if not held(text_of[i])} and third < second
    words = Counter()
    for x in seen["source_mixing"]:
        words[x.doc_id] += len(x.text.split())
        assert set(x.text.split()) <= set(text_of[x.doc_id].split())
    assert set(words) <= third and all(n <= 2 * len(text_of[i].split()) for i, n in words.items())
    total = sum(len(text_of[i].split()) for i in third)
    assert abs(sum(words.values()) - 1.5 * total) <= 64 * 4
    last = seen["balanced_sharding"]
    assert Counter((x.doc_id, zlib.crc32(x.text.encode())) for x in last) == Counter((x.doc_id, zlib.crc32(x.text.encode())) for x in seen["source_mixing"])
    sizes = Counter(x["shard"] for x in last)
    assert len(sizes) == 24 and max(sizes.values()) - min(sizes.values()) <= 1


def test_stages_on_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long = "one two three four five six seven " * 60_000
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n", "en", "a", 2), (None, "plain words", "en", None, 11), (None, "plain words", "en", None, 11), (4, long, "en", "b", len(long)), (5, "same text here " * 9, "en", "b", 0), (5, "same text here " * 9, "en", "b", 0), (6, "same text here " * 9, None, "a", 0)]
    extra = [(*r, i, "k", b"m") for i, r in enumerate(rows)]
    for name, docs in (("rows", spark.createDataFrame(extra, schema + ", _key int, shard string, mark binary")), ("none", spark.createDataFrame([], schema))):
        d = f"{tmp_path}/{name}"
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        seen = {}
        for stage, function in p.STAGES:
            function(spark, docs, d).write.parquet(f"{d}/{stage}")
            docs = spark.read.parquet(f"{d}/{stage}")
            assert docs.columns[:5] == p.COLUMNS
            seen[stage] = docs.collect()
        if name == "none":
            assert not any(seen.values())
            continue
        assert len(seen["toxicity"]) == len(rows)
        kept = Counter(x.doc_id for x in seen["simhash_near_dedup"])
        assert kept == {1: 1, None: 2, 4: 1, 5: 1}
        assert seen["benchmark_decontamination"] and len(seen["benchmark_decontamination"]) == 5
        assert {x.doc_id for x in seen["source_mixing"]} == {None, 4, 5}
        assert len(seen["balanced_sharding"]) == len(seen["source_mixing"])


def test_run_leaves_one_folder(spark, tmp_path, sf_dir):
    from pathlib import Path
    from urllib.parse import urlparse

    from epochlake.llm.common import shared_dir

    where = Path(urlparse(shared_dir(spark)).path)
    before = set(where.glob("pipeline-*"))
    assert p.run(spark, sf_dir).count()
    assert len(set(where.glob("pipeline-*")) - before) == 1
