"""Licences of files: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, persist, slices, texts_of, tidy
from .license_texts import templates

#: Least cosine of a match, and share of a file's words that its notices cover if the file is a licence file by its text.
COSINE, COVERED = 0.8, 0.5
#: Directories that are broadcast; more are joined by a shuffle in which each directory is dealt to SALTS tasks.
BROADCAST_DIRS, SALTS = 200_000, 64
#: Names of licence files, without regard to case.
FILE_NAMES = r"(?i)^(un)?licen[cs]es?([-._].*)?$|^copying([-._].*)?$|^copyright([-._].*)?$|^notice([-._].*)?$"

# words are runs of ASCII letters and digits, A-Z lowered, and of characters that aren't ASCII
_TABLE = bytes(c if c >= 128 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(256))
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def split_words(text: Column) -> Column:
    """As words_of, with empty strings at the ends."""
    return F.split(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), _BETWEEN)


class Templates:
    """Template texts as sparse TF-IDF vectors, given in how many of `total` files each of their words is.

    A word's weight is its count times 1 + ln((1 + total) / (1 + files that hold it)). Words that no template has weigh as if
    no file held them, and each counts once.
    """

    def __init__(self, texts: list[tuple[str, str]], frequency: dict[str, int], total: int) -> None:
        self.names = [n for n, _ in texts]
        split = [words_of(t.encode()) for _, t in texts]
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for s in split for w in s}))}
        self.other = len(self.vocabulary)
        idf = [1 + math.log((1 + total) / (1 + frequency.get(w.decode(), 0))) for w in self.vocabulary]
        self.square = np.array([*idf, 1 + math.log(1 + total)]) ** 2
        self.lengths = [len(s) for s in split]
        self.counts = [np.bincount([self.vocabulary[w] for w in s], minlength=self.other + 1) for s in split]
        self.norms = [math.sqrt((c * c * self.square).sum()) for c in self.counts]

    def cosine(self, k: int, ids: np.ndarray) -> float:
        """The cosine of the k-th template and words that are given by their numbers."""
        n = np.bincount(ids, minlength=self.other + 1)
        norm = (n * n * self.square)[:-1].sum() + n[-1] * self.square[-1]
        return float((n * self.counts[k] * self.square).sum() / (self.norms[k] * math.sqrt(norm))) if norm else 0.0

    def matches(self, texts: list[bytes], least: float = COSINE) -> list[list[tuple[float, int, int, int]]]:
        """For each text, the notices in it: (cosine, template, first word, words), the best first, none over another.

        A template is compared with every run of words of its own length, or with the whole text if that is shorter. Sums of
        weights bound the cosine from above; what can reach the least is computed exactly. Of equal cosines the longer
        template comes first, then the earlier one, then the earlier place.
        """
        split = [words_of(t) for t in texts]
        n = np.array([len(s) for s in split], dtype=np.int64)
        get = self.vocabulary.get
        ids = np.fromiter((i for s in split for i in map(get, s, repeat(self.other))), dtype=np.int32, count=int(n.sum()))
        ends = np.cumsum(n)
        begins = ends - n
        text_of = np.repeat(np.arange(len(texts)), n)
        weight = np.concatenate(([0.0], np.cumsum(self.square[ids])))
        lightest, shortest = float(self.square.min()), int(n[n > 0].min(initial=1 << 30))
        found: dict[int, list[tuple[float, int, int, int]]] = {}
        for k, m in enumerate(self.lengths):
            if not m or not len(ids):
                continue
            dot = np.concatenate(([0.0], np.cumsum((self.counts[k] * self.square)[ids])))
            # runs of the template's length inside a text, and whole shorter texts
            start = np.arange(len(ids))
            high = dot[np.minimum(start + m, len(ids))] - dot[:-1]
            start = np.flatnonzero(high >= least * self.norms[k] * math.sqrt(lightest * min(m, shortest)) - 1e-6)
            start = start[start <= np.maximum(begins, ends - m)[text_of[start]]]
            end = np.minimum(start + m, ends[text_of[start]])
            near = np.flatnonzero(dot[end] - dot[start] >= least * self.norms[k] * np.sqrt(weight[end] - weight[start]) - 1e-6)
            for s, e in zip(start[near].tolist(), end[near].tolist(), strict=True):
                c = self.cosine(k, ids[s:e])
                if c >= least - 1e-9:
                    t = int(text_of[s])
                    found.setdefault(t, []).append((round(c, 9), k, s - int(begins[t]), e - s))
        out: list[list[tuple[float, int, int, int]]] = []
        for t in range(len(texts)):
            taken: list[tuple[float, int, int, int]] = []
            for c, k, s, w in sorted(found.get(t, ()), key=lambda x: (-x[0], -self.lengths[x[1]], x[1], x[2])):
                if all(s >= b + v or s + w <= b for _, _, b, v in taken):
                    taken.append((c, k, s, w))
            out.append(taken)
        return out


def document_frequency(texts: DataFrame, vocabulary: list[str]) -> tuple[dict[str, int], int]:
    """In how many of all rows of texts(text) each word is, and how many rows there are."""
    known = F.array(*map(F.lit, vocabulary))
    each = texts.select(F.explode(F.array_intersect(split_words(F.col("text")), known)).alias("word"))
    return {r.word: r.n for r in each.groupBy("word").agg(F.count("*").alias("n")).collect()}, texts.count()


def notices(files: DataFrame, texts: list[tuple[str, str]] | None = None, least: float = COSINE) -> DataFrame:
    """files without text, but with license, score, first_word, n_words (of the best notice), licenses (all, sorted) and covered.

    covered is the share of the text's words that notices cover. Files without a notice, and null and empty texts, have
    nulls, no licenses, and 0. Columns of files by these names give way.
    """
    texts = texts or templates()
    added = {"license": "string", "score": "double", "first_word": "long", "n_words": "long", "licenses": "array<string>", "covered": "double"}
    files = files.drop(*added)
    narrow = files.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    vocabulary = sorted({w.decode() for _, t in texts for w in words_of(t.encode())})
    sent = files.sparkSession.sparkContext.broadcast(Templates(texts, *document_frequency(narrow, vocabulary)))
    names = [c for c in files.columns if c != "text"]
    schema = files.select(*names, *(F.lit(None).cast(t).alias(c) for c, t in added.items())).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for part in slices(batches, "text"):
            raw = texts_of(part, "text")
            best, named, covered = [], [], []
            for text, hits in zip(raw, model.matches(raw, least), strict=True):
                best.append((model.names[hits[0][1]], hits[0][0], hits[0][2], hits[0][3]) if hits else (None,) * 4)
                named.append(sorted({model.names[k] for _, k, _, _ in hits}))
                covered.append(sum(w for *_, w in hits) / len(words_of(text)) if hits else 0.0)
            a, b, c, d = zip(*best, strict=True)
            columns = [pa.array(a, pa.string()), pa.array(b, pa.float64()), pa.array(c, pa.int64()), pa.array(d, pa.int64()), pa.array(named, pa.list_(pa.string())), pa.array(covered, pa.float64())]
            yield pa.RecordBatch.from_arrays([*(part.column(x) for x in names), *columns], [*names, *added])

    return files.withColumn("text", F.col("text").cast("string")).mapInArrow(tidy(run), schema)


def inherited(files: DataFrame) -> DataFrame:
    """(directory, inherited, inherited_from) of the directories of files(directory, path, license, score, is_license_file) under a licence file.

    A directory takes the licence of its nearest ancestor, itself included, that holds a licence file with a known licence; of
    several such files in one directory that with the best score counts, then that with the smallest path. Only directories
    that hold a file without a licence are looked up.
    """
    given = files.filter("is_license_file and license is not null and directory is not null")
    order = F.struct((-F.col("score")).alias("minus"), "path", "license")
    given = persist(given.groupBy("directory").agg(F.min(order).alias("best")).select(F.col("directory").alias("_ancestor"), F.col("best.license").alias("license"), F.col("best.path").alias("path")))
    asked = files.filter("license is null and directory is not null").select("directory").distinct()
    parts = F.filter(F.split("directory", "/"), lambda x: x != "")
    up = asked.select("directory", F.posexplode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("depth", "_ancestor"))
    if given.count() <= BROADCAST_DIRS:
        given = F.broadcast(given)
    near = up.join(given, "_ancestor").groupBy("directory").agg(F.max(F.struct("depth", "license", "path")).alias("near"))
    return near.select("directory", F.col("near.license").alias("inherited"), F.col("near.path").alias("inherited_from"))


def scan(files: DataFrame, texts: list[tuple[str, str]] | None = None, least: float = COSINE) -> DataFrame:
    """files(path, text, ...) without text, but with license, score, first_word, n_words, licenses, directory, is_license_file, inherited, inherited_from.

    license is the file's own, of the notice in its whole text whose TF-IDF cosine to a template is highest, `least` or more;
    licenses lists all that are found. A file is a licence file if its name says so or if notices cover half of its words. A
    file without a licence of its own inherits that of the nearest directory above it with a licence file. Steps '.' and
    doubled slashes of a path are dropped. Null paths inherit nothing; null and empty texts have no licence of their own, but
    inherit. Repeated rows keep a row each. Other columns stay, those of the names above give way. No rows: no rows.
    """
    files = files.drop("directory", "is_license_file", "inherited", "inherited_from")
    path = F.col("path").cast("string")
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    by_name = F.coalesce(F.try_element_at(parts, F.lit(-1)).rlike(FILE_NAMES), F.lit(False))
    found = notices(files, texts, least).withColumn("is_license_file", by_name | (F.col("covered") >= COVERED)).drop("covered")
    found = persist(found.withColumn("directory", F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), "/")))
    other, own, salt = fresh(found, "_dir", "_own", "_salt")
    near = persist(inherited(found)).withColumnRenamed("directory", other)
    lacks = (F.col("directory") == F.col(other)) & F.col("license").isNull()
    if near.count() <= BROADCAST_DIRS:
        return found.join(F.broadcast(near), lacks, "left").drop(other)
    # a directory may hold any share of the files
    spread = near.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = found.withColumn(own, F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int"))
    return salted.join(spread, lacks & (F.col(own) == F.col(salt)), "left").drop(other, own, salt)
