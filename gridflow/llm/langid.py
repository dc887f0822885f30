"""Language identification by nearest centroids.

A text is a vector of hashed letter grams (one to three bytes of its letters, words
set off by blanks), weighted by log counts and inverse document frequency, at
length 1. Each language has several centroids, found by spherical k-means on a
bounded sample of its training texts and then set to the mean direction of all
training texts that are nearest to them. A text belongs to the language of
the centroid with the largest cosine. It is rejected (an extra column; the language stays
named) if it lies farther from that centroid than all but a small share of the
centroid's own training texts.

Document frequencies, centroids and the distances that reject come from all training
texts; only where k-means starts from is sampled. What is gathered is a sum per
gram bucket and centroid, which grows with the number of languages alone. Sums are
of whole numbers, so reruns agree.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096
LENGTHS = (1, 2, 3)         # bytes of a gram
CENTROIDS = 4               # per language
SAMPLE = 512                # distinct training texts of a language that k-means starts from, about
ROUNDS = 10                 # of k-means on the sample
REJECT_SHARE = 0.005        # share of a centroid's training texts that its distance limit leaves out
BINS = 200                  # of cosines from 0 to 1, to find that limit
UNKNOWN = "und"
CHUNK = 1 << 21             # bytes of a text whose grams are counted at once
ROWS = 256                  # texts scored at once
SCALE = 1 << 24             # sums of vectors are kept in whole units of 1 / SCALE

_LETTER = re.compile(r"[^\W\d_]")
# a-z and all bytes of letters beyond ASCII stay, anything else parts words
_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_FACTOR = 0x9E3779B1


def gram_counts(text: str) -> np.ndarray:
    """Number of grams per bucket; none if the text has no letter."""
    out = np.zeros(BUCKETS, np.int64)
    if not _LETTER.search(text):
        return out
    a = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS).split()) + b" "
    for n in LENGTHS:
        for at in range(0, len(a) - n + 1, CHUNK):
            part = np.frombuffer(a, np.uint8, min(CHUNK + n - 1, len(a) - at), at).astype(np.uint32)
            g = np.full(len(part) - n + 1, n, np.uint32)
            for j in range(n):
                g = (g << np.uint32(8)) | part[j:j + len(g)]
            g *= np.uint32(_FACTOR)
            out += np.bincount(g >> np.uint32(32 - BUCKETS.bit_length() + 1), minlength=BUCKETS)
    return out


def unit_vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of log-weighted counts times ``idf`` at length 1 (rows without grams: zero)."""
    v = np.log1p(counts) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def _matrices(batch: pa.RecordBatch, column: int):
    """(first row, gram counts of the next rows) over a batch's texts."""
    for i in range(0, batch.num_rows, ROWS):
        yield i, np.stack([gram_counts(t.as_py() or "") for t in batch.column(column)[i:i + ROWS]])


def k_means(v: np.ndarray, k: int = CENTROIDS, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of unit rows: the first the row nearest to the mean, each next the row
    farthest from all so far, then ``rounds`` of assignment and mean direction."""
    at = [int((v @ v.sum(0)).argmax())]
    near = v @ v[at[0]]
    while len(at) < k and near.min() < 1 - 1e-9:
        at.append(int(near.argmin()))
        near = np.maximum(near, v @ v[at[-1]])
    c = v[at]
    for _ in range(rounds):
        own = (v @ c.T).argmax(1)
        c = np.stack([v[own == j].sum(0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.linalg.norm(c, axis=1, keepdims=True)
    return c


@dataclass
class Model:
    """``langs[i]`` is the language of row i of ``centroids``, whose texts reach down to cosine ``limits[i]``."""

    idf: np.ndarray
    langs: list[str]
    centroids: np.ndarray
    limits: np.ndarray

    def predict(self, counts: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, cosine, lead over the next language, rejected: of each row of gram counts."""
        n = len(counts)
        if not self.langs:
            return [UNKNOWN] * n, np.zeros(n), np.zeros(n), np.ones(n, bool)
        s = np.clip(unit_vectors(counts, self.idf) @ self.centroids.T, 0.0, 1.0)
        best = s.argmax(1)          # ties: the first by language
        score = s[np.arange(n), best]
        names = np.array(self.langs, object)
        other = np.where(names[None, :] == names[best][:, None], 0.0, s).max(1)
        none = counts.sum(1) == 0
        langs = [UNKNOWN if z else x for z, x in zip(none, names[best])]
        return langs, np.where(none, 0.0, score), np.where(none, 0.0, score - other), none | (score < self.limits[best])


def _document_frequencies(train: DataFrame) -> tuple[np.ndarray, dict[str, int]]:
    """Training texts that hold each bucket, and their number by language."""
    def run(batches):
        df, langs = np.zeros(BUCKETS, np.int64), {}
        for b in batches:
            names = b.column(0).to_pylist()
            for i, counts in _matrices(b, 1):
                df += (counts > 0).sum(0)
                for name, any_gram in zip(names[i:], counts.any(1)):
                    langs[name] = langs.get(name, 0) + int(any_gram)
        yield pa.RecordBatch.from_arrays([pa.array([None] * BUCKETS + list(langs), pa.string()),
                                          pa.array([*range(BUCKETS)] + [-1] * len(langs), pa.int32()),
                                          pa.array([*df.tolist(), *langs.values()], pa.int64())], ["lang", "bucket", "n"])
    t = train.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(BUCKETS, np.int64)
    for r in t:
        if r["bucket"] >= 0:
            df[r["bucket"]] = r["n"]
    return df, {r["lang"]: r["n"] for r in t if r["bucket"] < 0 and r["n"]}


def _start_centroids(train: DataFrame, idf: np.ndarray, per_lang: dict[str, int]) -> dict[str, np.ndarray]:
    """k-means centroids of about ``SAMPLE`` distinct texts of every language: those
    whose hash is low enough for the language's number of texts. Copies are one."""
    spark = train.sparkSession
    span = 1 << 30
    limits = spark.createDataFrame([(x, min(span, -(-span * SAMPLE // n))) for x, n in per_lang.items()], "__lang string, __limit long")
    d = train.select("lang", "text", F.xxhash64("text").alias("h"))
    d = d.join(F.broadcast(limits), F.col("lang") == F.col("__lang")).where(F.pmod("h", F.lit(span)) < F.col("__limit"))
    d = d.groupBy("lang", "h").agg(F.first("text").alias("text"))

    def vectors(batches):
        for b in batches:
            for i, counts in _matrices(b, 2):
                v = unit_vectors(counts, idf).astype(np.float32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, len(v)), b.column(1).slice(i, len(v)),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * BUCKETS, pa.int32()), pa.array(v.ravel()))],
                    ["lang", "h", "v"])

    def cluster(frame):
        import pandas as pd
        v = np.stack(frame.sort_values("h")["v"].to_list()).astype(np.float64)
        v = v[v.any(1)]
        c = k_means(v) if len(v) else np.zeros((0, BUCKETS))
        return pd.DataFrame({"lang": [frame["lang"].iloc[0]] * len(c), "v": [*map(np.ndarray.tolist, c)]})
    d = d.mapInArrow(vectors, "lang string, h long, v array<float>")
    out: dict[str, list] = {}
    for r in d.groupBy("lang").applyInPandas(cluster, "lang string, v array<double>").collect():   # CENTROIDS rows a language
        out.setdefault(r["lang"], []).append(r["v"])
    return {x: np.array(sorted(v)) for x, v in out.items()}


def _mean_centroids(train: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """For every centroid the sum of the unit vectors of its language's training texts that
    are nearest to it, and the histogram of their cosines."""
    shared = train.sparkSession.sparkContext.broadcast(model)
    rows = {x: [i for i, y in enumerate(model.langs) if y == x] for x in model.langs}

    def run(batches):
        m = shared.value
        total = np.zeros((len(m.langs), BUCKETS + BINS), np.int64)
        for b in batches:
            names = b.column(0).to_pylist()
            for i, counts in _matrices(b, 1):
                v = unit_vectors(counts, m.idf)
                s = v @ m.centroids.T
                units = np.rint(v * SCALE).astype(np.int64)
                for j, name in enumerate(names[i:i + len(v)]):
                    own = rows.get(name)
                    if own and counts[j].any():
                        c = own[int(s[j, own].argmax())]
                        total[c, :BUCKETS] += units[j]
                        total[c, BUCKETS + min(BINS - 1, max(0, int(s[j, c] * BINS)))] += 1
        c, at = np.nonzero(total)
        for i in range(0, len(c), 1 << 16):
            j = slice(i, i + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(c[j].astype(np.int32)), pa.array(at[j].astype(np.int32)),
                                              pa.array(total[c[j], at[j]])], ["c", "at", "n"])
    t = train.mapInArrow(run, "c int, at int, n long").groupBy("c", "at").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros((len(model.langs), BUCKETS + BINS), np.int64)
    total[t["c"].to_numpy(), t["at"].to_numpy()] = t["n"].to_numpy()
    return total[:, :BUCKETS], total[:, BUCKETS:]


def fit_languages(train: DataFrame, text: str = "text", lang: str = "lang", reject_share: float = REJECT_SHARE) -> Model:
    """The model of all rows of ``train`` whose ``lang`` is not null and whose text has a letter."""
    d = train.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    df, per_lang = _document_frequencies(d)
    idf = np.log((1 + sum(per_lang.values())) / (1 + df)) + 1
    if not per_lang:
        return Model(idf, [], np.zeros((0, BUCKETS)), np.zeros(0))
    start = _start_centroids(d, idf, per_lang)
    # a language whose sample is empty (few distinct texts, unlucky hashes) starts from its overall mean
    names = [x for x in sorted(per_lang) for _ in range(len(start.get(x, [0])))]
    first = np.concatenate([start[x] if x in start else np.full((1, BUCKETS), BUCKETS ** -0.5) for x in sorted(per_lang)])
    sums, cosines = _mean_centroids(d, Model(idf, names, first, np.zeros(len(names))))
    used = sums.any(1)
    sums, cosines = sums[used].astype(np.float64), cosines[used]
    below = np.cumsum(cosines, axis=1)
    limits = (below > reject_share * below[:, -1:]).argmax(1) / BINS
    return Model(idf, [x for x, u in zip(names, used) if u], sums / np.linalg.norm(sums, axis=1, keepdims=True), limits)


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, lang_pred, score, lead, rejected`` of every row of ``docs``.

    ``score`` is the cosine with the nearest centroid (0 to 1), ``lead`` what the
    nearest of another language falls short of it, ``rejected`` whether the text lies outside
    that centroid's distance. Null, empty and letterless texts are ``und`` with score
    0, rejected; so is every text if nothing was learned. Equal cosines go to the
    first language by code point. Equal texts get equal results; other columns are ignored; an
    empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)     # CENTROIDS rows a language

    def run(batches):
        m = shared.value
        for b in batches:
            for i, counts in _matrices(b, 1):
                langs, score, lead, rejected = m.predict(counts)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(counts)), pa.array(langs, pa.string()), pa.array(score),
                                                  pa.array(lead), pa.array(rejected)], [key, "lang_pred", "score", "lead", "rejected"])
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double, lead double, rejected boolean")
