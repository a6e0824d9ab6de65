"""Toxicity of documents: a bidirectional gated recurrent network with attention pooling, trained in numpy."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, slices, texts_of, tidy

#: Labelled documents of each class that the network is fitted on, at most, and bytes of a text among them, at most.
TRAIN_TOXIC, TRAIN_CLEAN, TRAIN_BYTES = 1500, 2500, 12_000
#: Words of a window, words from one window's start to the next, hidden units of each direction.
WINDOW, STEP, HIDDEN = 64, 48, 8
#: Bytes in a character run.
RUNS = (3, 4, 5, 6)
#: Steps of the fit, steps after which the windows that stand for the texts are chosen anew, windows in a step, first rate.
STEPS, ROUND, BATCH, RATE = 320, 80, 128, 0.01
#: Share of toxic texts that scores are calibrated to, whatever share the labelled ones have.
PRIOR = 0.25
#: Words whose inputs a task remembers.
CACHE_TYPES = 400_000

_OTHER = regex.compile(r"[^\p{L}\p{N}]")


def _normal(raw: bytes) -> bytes:
    return _OTHER.sub("", raw.decode("utf-8", "replace").lower()).encode()


def runs_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the character runs of words with their bounds, how many each word has, and which of RUNS each run's length is."""
    joined = np.frombuffer(b"".join(b"<" + w + b">" for w in words), dtype=np.uint8).astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words])
    word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
    left = (np.repeat(np.cumsum(lengths), lengths) - np.arange(len(joined))).astype(np.int32)  # bytes of the word from here on
    hashes, owners, kinds = [], [], []
    h = np.zeros(len(joined), dtype=np.uint64)
    for n in range(1, max(RUNS) + 1):
        h = h[: len(joined) - n + 1] * np.uint64(0x100000001B3) + joined[n - 1 :] + np.uint64(1)
        if n in RUNS:
            at = np.flatnonzero(left[: len(h)] >= n)
            x = (h[at] ^ (h[at] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
            hashes.append(x ^ (x >> np.uint64(32)))
            owners.append(word[at])
            kinds.append(np.full(len(at), RUNS.index(n), dtype=np.int8))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(hashes)[order], np.bincount(owner, minlength=len(words)), np.concatenate(kinds)[order]


def word_inputs(own: np.ndarray, runs: np.ndarray, counts: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """A word's inputs: its own value, and the largest value among its runs of each length."""
    starts = np.cumsum(counts) - counts
    most = [np.maximum.reduceat(np.where(kinds == k, runs, np.float32(-1)), starts) for k in range(len(RUNS))]
    return np.stack([own, *most], axis=1).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def forward(p: dict, inputs: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Logits of windows: index (B, T) chooses rows of `inputs`, the words' shares of all gates; mask says which words exist.

    Both directions read every window; attention weighs their states, and the weighted mean gives the logit.
    """
    b, t = index.shape
    n = HIDDEN
    states = np.zeros((2, t + 1, b, n), dtype=inputs.dtype)
    cache = []
    for d in (0, 1):
        u, c = p["u"][d], p["c"][d]
        h = states[d, 0]
        for s in range(t):
            at = s if d == 0 else t - 1 - s
            g = inputs[index[:, at], 3 * n * d : 3 * n * (d + 1)]
            a = h @ u + c
            zr = _sigmoid(g[:, : 2 * n] + a[:, : 2 * n])
            z, r = zr[:, :n], zr[:, n:]
            m = np.tanh(g[:, 2 * n :] + r * a[:, 2 * n :])
            k = mask[:, at, None]
            new = h + k * ((1 - z) * (m - h))
            if keep:
                cache.append((h, a[:, 2 * n :], z, r, m, k))
            states[d, s + 1] = h = new
    both = np.concatenate([states[0, 1:], states[1, :0:-1]], axis=2)  # (T, B, 2n)
    e = np.where(mask.T > 0, both @ p["v"], np.float32(-1e9))
    e = np.exp(e - e.max(axis=0))
    e *= mask.T
    weight = e / np.maximum(e.sum(axis=0), np.float32(1e-9))
    pooled = np.einsum("tb,tbn->bn", weight, both)
    logits = pooled @ p["w"] + p["bias"][0]
    return (logits, (both, weight, pooled, cache)) if keep else logits


def backward(p: dict, kept, index: np.ndarray, mask: np.ndarray, dlogits: np.ndarray, rows: int) -> tuple[dict, np.ndarray]:
    """Gradients of the parameters and of `inputs`, given those of the logits."""
    both, weight, pooled, cache = kept
    b, t = index.shape
    n = HIDDEN
    grad = {"w": pooled.T @ dlogits, "bias": np.array([dlogits.sum()]), "u": np.zeros_like(p["u"]), "c": np.zeros_like(p["c"])}
    dpooled = dlogits[:, None] * p["w"]
    dweight = np.einsum("bn,tbn->tb", dpooled, both)
    de = weight * (dweight - (weight * dweight).sum(axis=0))
    grad["v"] = np.einsum("tb,tbn->n", de, both)
    dboth = weight[:, :, None] * dpooled + de[:, :, None] * p["v"]
    gates = np.zeros((b, t, 6 * n), dtype=both.dtype)
    for d in (0, 1):
        u = p["u"][d]
        dh = np.zeros((b, n), dtype=both.dtype)
        for s in range(t - 1, -1, -1):
            at = s if d == 0 else t - 1 - s
            h, am, z, r, m, k = cache[d * t + s]
            dh = dh + dboth[at, :, n * d : n * (d + 1)]
            dm = dh * k * (1 - z) * (1 - m * m)
            dz = -dh * k * (m - h) * z * (1 - z)
            dr = dm * am * r * (1 - r)
            da = np.concatenate([dz, dr, dm * r], axis=1)
            gates[:, at, 3 * n * d : 3 * n * (d + 1)] = np.concatenate([dz, dr, dm], axis=1)
            grad["u"][d] += h.T @ da
            grad["c"][d] += da.sum(axis=0)
            dh = dh * (1 - k * (1 - z)) + da @ u.T
    flat = index.ravel()
    order = np.argsort(flat, kind="stable")
    first = np.flatnonzero(np.diff(flat[order], prepend=-1))
    dinputs = np.zeros((rows, 6 * n), dtype=both.dtype)
    dinputs[flat[order][first]] = np.add.reduceat(gates.reshape(-1, 6 * n)[order], first)
    return grad, dinputs


def windows_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of all windows of texts of so many words, places counted through all texts; every word is in one."""
    per = np.where(counts > 0, np.maximum(1, -(-(counts - WINDOW) // STEP) + 1), 0)
    text = np.repeat(np.arange(len(counts)), per)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    base = np.cumsum(counts) - counts
    start = base[text] + nth * STEP
    return text, start, np.minimum(start + WINDOW, (base + counts)[text])


def _grid(words: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = start[:, None] + np.arange(WINDOW)
    mask = at < end[:, None]
    return words[np.minimum(at, len(words) - 1)].astype(np.int32), mask.astype(np.float32)


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and the number of each value among them; as np.unique, in half the memory."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    distinct = ordered[new]
    del ordered
    number = np.empty(len(values), dtype=np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - 1
    return distinct, number


def fit(texts: list[str], labels: list[int], seed: int = 0) -> dict:
    """The network, fitted on whole texts and their labels (1 toxic); a plain dictionary of arrays.

    A word's inputs are its own log odds among the labelled texts and, for each length of character runs, the largest log odds
    of its runs. While the network is fitted, the log odds of a text's words come from the other half of the texts. With
    labels of one class only, or none, the model gives every text the share of toxic ones.
    """
    share = sum(labels) / len(labels) if labels else 0.0
    if share in (0.0, 1.0):
        return {"constant": share}
    rng = np.random.default_rng(seed)
    y = np.array(labels)
    types: dict[bytes, int] = {}
    raw_types: dict[bytes, int] = {}
    docs = []
    for text in texts:
        own = []
        for raw in text.encode().lower().split():
            t = raw_types.get(raw)
            if t is None:
                word = _normal(raw)
                t = raw_types[raw] = types.setdefault(word, len(types)) if word else -1
            if t >= 0:
                own.append(t)
        docs.append(np.array(own, dtype=np.int64))
    if not types:
        return {"constant": share}
    spelled = list(types)
    parts = [runs_of(spelled[k : k + 20_000]) for k in range(0, len(spelled), 20_000)]
    run_counts, lengths = (np.concatenate([p[k] for p in parts]) for k in (1, 2))
    runs = np.concatenate([p[0] for p in parts])
    del parts
    run_starts = np.cumsum(run_counts) - run_counts
    word_keys = np.fromiter(map(xxhash.xxh64_intdigest, spelled), np.uint64, len(spelled))
    run_ids, run_of = _numbered(runs)
    del runs
    fold = rng.permutation(len(docs)) % 2
    # in how many texts of each half and class each word and each run is
    held = [np.zeros((2, 2, size), dtype=np.int32) for size in (len(types), len(run_ids))]
    for f, label, own in zip(fold.tolist(), labels, map(np.unique, docs), strict=True):
        n = run_counts[own]
        at = np.repeat(run_starts[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        held[0][f, label][own] += 1
        held[1][f, label][np.unique(run_of[at])] += 1
    texts_in = np.array([[((fold == f) & (y == label)).sum() for label in (0, 1)] for f in (0, 1)])

    def odds(halves: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of each word and of each run among the texts of some halves, nearer to zero by about what chance explains."""
        out = []
        for counts in held:
            n0, n1 = counts[halves].sum(axis=0)
            log_odds = np.log((n1 + 2) / (texts_in[halves, 1].sum() + 4)) - np.log((n0 + 2) / (texts_in[halves, 0].sum() + 4))
            out.append((np.sign(log_odds) * np.maximum(0, np.abs(log_odds) - np.sqrt(1 / (n1 + 1) + 1 / (n0 + 1)))).astype(np.float32))
        return out[0], out[1]

    whole = odds([0, 1])
    crossed = []
    for f in (0, 1):
        by_type, by_run = odds([1 - f])
        crossed.append(word_inputs(by_type, by_run[run_of], run_counts, lengths))
    del held

    words = np.concatenate(docs)
    text, start, end = windows_of(np.array([len(d) for d in docs]))
    index, mask = _grid(words, start, end)
    # how much a window seems to hold: before the network can tell, its largest input
    hint = np.empty(len(text))
    for f in (0, 1):
        own = fold[text] == f
        hint[own] = np.where(mask[own] > 0, crossed[f].max(axis=1)[index[own]], -9).max(axis=1)

    def leading(value: np.ndarray, most: int) -> np.ndarray:
        """The windows with each text's largest values."""
        order = np.lexsort((-value, text))
        first = np.flatnonzero(np.diff(text[order], prepend=-1))
        nth = np.arange(len(text)) - np.repeat(first, np.diff(np.append(first, len(text))))
        return order[nth < most]

    f32 = np.float32
    inner = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[-2])).astype(f32)
    p = {"x": inner(1 + len(RUNS), 6 * HIDDEN), "b": np.zeros(6 * HIDDEN, f32), "u": inner(2, HIDDEN, 3 * HIDDEN), "c": np.zeros((2, 3 * HIDDEN), f32), "v": inner(2 * HIDDEN, 1)[:, 0], "w": inner(2 * HIDDEN, 1)[:, 0], "bias": np.zeros(1, f32)}
    moments = {k: (np.zeros_like(a), np.zeros_like(a)) for k, a in p.items()}

    def logits_of(which: np.ndarray) -> np.ndarray:
        out = np.empty(len(which), f32)
        for f in (0, 1):
            inputs = crossed[f] @ p["x"] + p["b"]
            own = np.flatnonzero(fold[text[which]] == f)
            for k in range(0, len(own), 2048):
                part = which[own[k : k + 2048]]
                out[own[k : k + 2048]] = forward(p, inputs, index[part], mask[part])
        return out

    everything = np.arange(len(text))
    for count in range(STEPS):
        if count % ROUND == 0:
            # each text's leading windows stand for it, those of clean texts with others at random
            value = hint if not count else logits_of(everything)
            lead = leading(value, 3)
            positive = leading(value, 1)
            positive = positive[y[text[positive]] == 1]
            lead = lead[y[text[lead]] == 0]
            other = everything[y[text] == 0]
        f = count % 2
        half = BATCH // 2
        draw = lambda pool, n: rng.choice(pool, n) if len(pool) else pool
        mine = [pool[fold[text[pool]] == f] for pool in (positive, lead, other)]
        part = np.concatenate([draw(mine[0], half), draw(mine[1], half // 2), draw(mine[2], half // 2)])
        if not len(part):
            continue
        which, local = np.unique(index[part], return_inverse=True)
        local = local.reshape(index[part].shape)
        x = crossed[f][which]
        logits, kept = forward(p, x @ p["x"] + p["b"], local, mask[part], True)
        dlogits = ((_sigmoid(logits) - y[text[part]]) / len(part)).astype(f32)
        grad, dinputs = backward(p, kept, local, mask[part], dlogits, len(which))
        grad["x"], grad["b"] = x.T @ dinputs, dinputs.sum(axis=0)
        rate = RATE * (1 - count / STEPS) + 0.0005
        for name, g in grad.items():
            m, v = moments[name]
            g = g.astype(f32) + 1e-4 * p[name]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p[name] -= (rate * (m / (1 - 0.9 ** (count + 1))) / (np.sqrt(v / (1 - 0.999 ** (count + 1))) + 1e-8)).astype(f32)

    # the largest logit of a text's windows, to a probability
    top = np.full(len(docs), -np.inf)
    np.maximum.at(top, text, logits_of(everything))
    full = np.isfinite(top)
    a, b = 1.0, 0.0
    each = np.where(y == 1, PRIOR / share, (1 - PRIOR) / (1 - share))[full]
    for _ in range(50):  # Newton steps of a logistic fit, held back a little
        q = np.clip(_sigmoid(a * top[full] + b), 1e-6, 1 - 1e-6)
        err, wt = each * (q - y[full]), each * q * (1 - q)
        g = np.array([(err * top[full]).sum() + 0.1 * (a - 1), err.sum() + 0.1 * b])
        h = np.array([[(wt * top[full] ** 2).sum() + 0.1, (wt * top[full]).sum()], [(wt * top[full]).sum(), wt.sum() + 0.1]])
        step = np.linalg.solve(h, g)
        a, b = max(0.05, a - float(np.clip(step[0], -1, 1))), b - float(np.clip(step[1], -1, 1))

    def vocabulary(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep = np.flatnonzero(values)
        order = keep[np.argsort(keys[keep])]
        return keys[order], values[order]

    return p | {"words": vocabulary(word_keys, whole[0]), "runs": vocabulary(run_ids, whole[1]), "scale": (a, b), "empty": PRIOR}


class Vocabulary:
    """Values by 64-bit keys; a table of the keys' leading bits spares most keys that aren't there the search."""

    BITS = 21

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.keys, self.values = keys, values
        self.there = np.zeros(1 << self.BITS, dtype=bool)
        self.there[keys >> np.uint64(64 - self.BITS)] = True

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        """The values of the wanted keys; zero for keys that aren't there."""
        out = np.zeros(len(wanted), dtype=np.float32)
        maybe = np.flatnonzero(self.there[wanted >> np.uint64(64 - self.BITS)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.keys, wanted[maybe]), len(self.keys) - 1)
            found = self.keys[at] == wanted[maybe]
            out[maybe[found]] = self.values[at[found]]
        return out


class Words(dict):
    """Numbers of the words as they stand in a text; -1 for those without letters or digits. `inputs` has the words' inputs."""

    def __init__(self, model: dict) -> None:
        self.words, self.runs = Vocabulary(*model["words"]), Vocabulary(*model["runs"])
        self.new: list[bytes] = []
        self.used = 0
        self.inputs = np.zeros((0, 1 + len(RUNS)), dtype=np.float32)

    def __missing__(self, raw: bytes) -> int:
        word = _normal(raw)
        if word:
            row = self.used + len(self.new)
            self.new.append(word)
        else:
            row = -1
        self[raw] = row
        return row

    def ready(self) -> np.ndarray:
        """The inputs of all words met so far."""
        if self.new:
            runs, n, lengths = runs_of(self.new)
            own = self.words(np.fromiter(map(xxhash.xxh64_intdigest, self.new), np.uint64, len(self.new)))
            x = word_inputs(own, self.runs(runs), n, lengths)
            if self.used + len(x) > len(self.inputs):
                self.inputs = np.concatenate([self.inputs[: self.used], np.zeros((max(self.used, len(x), 50_000), x.shape[1]), np.float32)])
            self.inputs[self.used : self.used + len(x)] = x
            self.used += len(x)
            self.new = []
        inputs = self.inputs
        if self.used > CACHE_TYPES:
            self.clear()
            self.used, self.inputs = 0, np.zeros((0, inputs.shape[1]), dtype=np.float32)
        return inputs


def scores(model: dict, texts: list[bytes], cache: Words | None = None) -> np.ndarray:
    """Scores from 0 to 1 of whole texts: the largest over all their windows. Texts without words score PRIOR."""
    if "constant" in model:
        return np.full(len(texts), float(model["constant"]))
    cache = cache if cache is not None else Words(model)
    parts = [t.lower().split() for t in texts]
    counts = np.array([len(p) for p in parts], dtype=np.int64)
    words = np.fromiter((r for p in parts for r in map(cache.__getitem__, p)), dtype=np.int64, count=int(counts.sum()))
    inputs = cache.ready()
    kept = words >= 0
    if not kept.all():
        total = np.concatenate(([0], np.cumsum(kept)))
        ends = np.cumsum(counts)
        counts = total[ends] - total[ends - counts]
        words = words[kept]
    # the gates' shares of the words that are here
    here = np.zeros(len(inputs), dtype=bool)
    here[words] = True
    words = (np.cumsum(here) - 1)[words]
    inputs = inputs[here] @ model["x"] + model["b"]
    text, start, end = windows_of(counts)
    top = np.full(len(texts), -np.inf)
    for k in range(0, len(text), 2048):
        index, mask = _grid(words, start[k : k + 2048], end[k : k + 2048])
        np.maximum.at(top, text[k : k + 2048], forward(model, inputs, index, mask))
    a, b = model["scale"]
    return np.where(counts > 0, _sigmoid(a * np.where(np.isfinite(top), top, 0.0) + b), model["empty"])


def held_out(doc_id: Column) -> Column:
    """Whether a row's labels are never learned from: crc32 of the id as text divides by five."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, seed: int = 0) -> dict:
    """The model for docs(doc_id, text), from labels(doc_id, toxic) of rows that aren't held out.

    The fit is one task's work. Its sample is bounded: TRAIN_TOXIC and TRAIN_CLEAN documents, those whose ids hash lowest, of texts of at most TRAIN_BYTES
    bytes. An id with both labels counts as toxic; null labels, ids and texts are left out.
    """
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    named = named.filter(~held_out(F.col("doc_id")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.octet_length("text") <= TRAIN_BYTES)
    usable = texts.select("doc_id").distinct().join(named, "doc_id")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = usable.filter("toxic = 1").orderBy(*order).limit(TRAIN_TOXIC).unionByName(usable.filter("toxic = 0").orderBy(*order).limit(TRAIN_CLEAN))
    rows = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = sorted((tuple(r.values()) for b in batches for r in b.to_pylist()), key=lambda r: r[0])
        model = fit([text for _, text, _ in sample], [toxic for _, _, toxic in sample], seed)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    # one task has the bounded sample, so that the driver needs no memory for the fit
    found = rows.select("doc_id", "text", "toxic").repartition(1).mapInArrow(tidy(run), "model binary").collect()
    return pickle.loads(found[0].model) if found else fit([], [], seed)


def score(docs: DataFrame, model: dict, out: str = "toxic_score") -> DataFrame:
    """docs with a column `out`; see scores. Null texts count as empty. Every row keeps its place, and its columns but one of that name."""
    docs = docs.drop(out)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        cache = None if "constant" in model else Words(model)
        for part in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores(model, texts_of(part, "text"), cache), pa.float64())], [*part.schema.names, out])

    return docs.mapInArrow(tidy(run), schema)


def detoxify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns."""
    (out,) = fresh(docs, "toxic_score")
    return score(docs, train(docs, labels), out).filter(F.col(out) < threshold).drop(out)
