"""Nearest-centroid language identification: grams and scores against brute force, held-out accuracy, odd input."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridflow.llm import langid, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, score string, rejected long"


def brute_counts(text):
    """Gram counts, byte by byte."""
    letters = any(c.isalpha() for c in text)
    raw = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in text.lower().encode())
    a = b" " + b" ".join(raw.split()) + b" "
    out = collections.Counter()
    for n in (1, 2, 3) if letters else ():
        for i in range(len(a) - n + 1):
            g = n
            for c in a[i:i + n]:
                g = (g << 8 | c) & 0xFFFFFFFF
            out[(g * 0x9E3779B1 & 0xFFFFFFFF) >> 20] += 1
    return out


def texts(lang, n, seed):
    rng = random.Random(f"{lang}{seed}")
    words = {"aa": ["the", "of", "and", "house", "shine"], "bb": ["der", "und", "haus", "schön", "nicht"],
             "cc": ["中文", "日本", "你好", "世界"]}[lang]
    return [" ".join(rng.choices(words, k=rng.randint(3, 40))) for _ in range(n)]


def corpus():
    return [(t, x) for x in ("aa", "bb", "cc") for t in texts(x, 30, 1)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, x, "clash", 7) for i, (t, x) in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize("text", ["", "12 !?", "a", "The House; the END.", "schön\n\tund  ñ", "中文 x9y", "x" * 500, "İstanbul ǅ"])
def test_gram_counts(text, monkeypatch):
    want = brute_counts(text)
    for chunk in (1 << 21, 7, 1):
        monkeypatch.setattr(langid, "CHUNK", chunk)
        got = langid.gram_counts(text)
        assert {int(i): int(got[i]) for i in np.flatnonzero(got)} == dict(want)


def test_model_and_scores_equal_brute_force(spark):
    rows = corpus() + [(None, "aa"), ("", "bb"), ("123", "cc"), ("no language", None), (texts("aa", 1, 1)[0], "aa")]
    train = frame(spark, rows).repartition(3)
    model = langid.fit_languages(train)
    used = [(brute_counts(t), x) for t, x in rows if t and x and any(c.isalpha() for c in t)]
    df = collections.Counter(b for c, _ in used for b in c)
    idf = [math.log((1 + len(used)) / (1 + df[b])) + 1 for b in range(langid.BUCKETS)]
    assert np.allclose(model.idf, idf)

    def vector(c):
        v = np.zeros(langid.BUCKETS)
        for b, n in c.items():
            v[b] = math.log1p(n) * idf[b]
        return v / (np.linalg.norm(v) or 1)
    assert set(model.langs) == {"aa", "bb", "cc"} and model.langs == sorted(model.langs)
    assert np.allclose(np.linalg.norm(model.centroids, axis=1), 1)
    assert 1 < model.langs.count("aa") <= langid.CENTROIDS
    # every training text weighs in: the centroids of a language add up to the mean of parts of its texts
    for x in ("aa", "bb", "cc"):
        own = np.stack([vector(c) for c, y in used if y == x])
        c = model.centroids[[i for i, y in enumerate(model.langs) if y == x]]
        fit = np.linalg.lstsq(c.T, own.sum(0), rcond=None)
        assert np.linalg.norm(c.T @ fit[0] - own.sum(0)) < 1e-4 * np.linalg.norm(own.sum(0)) and (fit[0] > 0).all()
    asked = [t for x in ("aa", "bb", "cc") for t in texts(x, 10, 2)] + ["der the", "zzz", "x"]
    got = langid.identify(frame(spark, [(t, None) for t in asked]), model).orderBy("doc_id").collect()
    for t, r in zip(asked, got):
        s = model.centroids @ vector(brute_counts(t))
        best = int(s.argmax())
        assert r["score"] == pytest.approx(s[best], abs=1e-12) and r["lang_pred"] == model.langs[best]
        rest = [v for v, x in zip(s, model.langs) if x != model.langs[best]]
        assert r["lead"] == pytest.approx(s[best] - max(rest), abs=1e-9)
        assert r["rejected"] == (s[best] < model.limits[best])
    assert [r["lang_pred"] for r in got[:30]] == [x for x in ("aa", "bb", "cc") for _ in range(10)]
    assert got[31]["rejected"]                                   # zzz is like nothing learned


def test_odd_rows(spark):
    model = langid.fit_languages(frame(spark, corpus()))
    rows = [(None, "aa"), ("", None), (" \n", "x"), ("12 34 %", "aa"), ("the house", None), ("the house", "bb"),
            ("der " * 700_000 + "the", None)]
    d = frame(spark, rows).withColumn("doc_id", F.when(F.col("doc_id") != 5, F.col("doc_id")))
    got = langid.identify(d, model).collect()
    by_id = {r["doc_id"]: r for r in got}
    assert got[0].asDict().keys() == {"doc_id", "lang_pred", "score", "lead", "rejected"} and len(got) == len(rows)
    for i in range(4):
        assert (by_id[i]["lang_pred"], by_id[i]["score"], by_id[i]["rejected"]) == ("und", 0.0, True)
    assert by_id[4]["lang_pred"] == "aa" and by_id[None][1:] == by_id[4][1:]      # equal texts, a null id
    assert by_id[6]["lang_pred"] == "bb"
    assert all(0 <= r["score"] <= 1 for r in got)
    assert langid.identify(d.limit(0), model).collect() == []
    for nothing in (frame(spark, corpus()).limit(0), frame(spark, [(None, "aa"), ("!", "bb"), ("word", None)])):
        empty = langid.fit_languages(nothing)
        got = langid.identify(d, empty).collect()
        assert {(r["lang_pred"], r["score"], r["rejected"]) for r in got} == {("und", 0.0, True)}


def test_sample_leaves_no_language_out(spark, monkeypatch):
    """Centroids come from all texts even where the sample of a language is one text or none."""
    monkeypatch.setattr(langid, "SAMPLE", 1)
    model = langid.fit_languages(frame(spark, corpus()))
    assert set(model.langs) == {"aa", "bb", "cc"}
    got = langid.identify(frame(spark, [(t, x) for x in ("aa", "bb", "cc") for t in texts(x, 10, 3)]), model).orderBy("doc_id")
    assert [r["lang_pred"] for r in got.collect()] == [x for x in ("aa", "bb", "cc") for _ in range(10)]


def test_k_means_parts_clear_groups():
    rng = np.random.default_rng(0)
    base = np.eye(6)[:3]
    v = np.concatenate([b + 0.05 * rng.random((20, 6)) for b in base])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    c = langid.k_means(v, 3)
    assert len({int((v[i] @ c.T).argmax()) for i in (0, 20, 40)}) == 3
    assert len(langid.k_means(np.repeat(base[:1], 9, 0), 4)) == 1         # equal rows: one centroid


def test_registered_query_is_right_on_held_out_documents(spark):
    got = {r["doc_id"]: r for r in queries.QUERIES["op13_language"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    right = []
    for d in docs:
        r = got[d["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 3 == 1)
        if r["held_out"] and d["lang"] is not None:
            right.append(r["lang_pred"] == d["lang"])
    assert len(right) > 30 and sum(right) >= 0.98 * len(right)
