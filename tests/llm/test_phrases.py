"""Toivonen mining of phrases against brute force, and odd input."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridflow.llm import phrases

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, rank long, n string"


def occurrences(rows):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(zip(*[w[i:] for i in range(k)]))
    return f, n


def brute(rows, least=10, top=2000, share=50):
    counts, n = occurrences(rows)
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {q for p, a in found.items() if len(p) == 3 for q in (p[:2], p[1:]) if 100 * a >= share * f[q]}
        scored = []
        for p, a in found.items():
            if p not in inside:
                s, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-s, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for i, (s, a, p, x, y) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, i, p.decode(), -a, x, y, n[lang], -s))
    return sorted(out)


def made_up(seed=1, docs=300):
    rng = random.Random(seed)
    words = [f"W{i}" for i in range(60)] + ["É", "ñu", "中文", "x y", "nul\x00l"]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = []
    for i in range(docs):
        body = rng.choices(words, weights, k=rng.randint(0, 60))
        text = "".join(w + rng.choice([" ", "  ", "\t", ", ", ".\n", " ", " ", "\r\n", "!"]) for w in body)
        rows.append((i, text + rng.choice(["", "new york city ", "New  York\tCity hall"]), rng.choice(["en", "en", "de", None, "und"])))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, 5, "clash") for i, t, g in rows], SCHEMA)


def test_phrases_equal_brute_force(spark):
    rows = made_up()
    got = phrases.mine_phrases(frame(spark, rows).repartition(3))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute([(g, t) for _, t, g in rows])


def test_top_is_cut_by_rank(spark):
    rows = made_up(2)
    got = phrases.mine_phrases(frame(spark, rows), top=7, min_count=4)
    want = brute([(g, t) for _, t, g in rows], least=4, top=7)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert max(r[1] for r in want) == 7


@pytest.mark.parametrize("sample_shares, sample_min, passes", [(1, 1, 1), (1 << 40, 1, 2), (3, 2, None)])
def test_counts_are_whole_whatever_the_sample_proposes(spark, sample_shares, sample_min, passes):
    """A sample of everything needs one pass; one of nothing fails on the whole border and expands."""
    rows = made_up(3)
    d = frame(spark, rows).select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    frequent, totals, n = phrases.frequent_phrases(d, 10, sample_shares, sample_min)
    f, total = occurrences([(g, t) for _, t, g in rows])
    want = {(lang, " ".join(p)): a for lang in f for p, a in f[lang].items() if a >= 10}
    got = frequent.collect()
    assert {(r["lang"], r["phrase"]): r["n"] for r in got} == want and len(got) == len(want)
    assert {r["lang"]: r["n"] for r in totals.collect()} == dict(total)
    assert passes is None or n == passes


def test_stretches_and_text_parts_run_on(spark, monkeypatch):
    """Phrases over the seams of stretches, parts of a text and renumbered words are counted once."""
    rng = random.Random(5)
    text = " ".join(rng.choice(["aa", "bb", "cc", "d"]) + rng.choice(["", "", "."]) for _ in range(3000))
    data = [("en", text), ("de", text[:500]), ("en", "aa bb cc"), ("fr", "x" * 700 + " aa " + "y" * 300)]
    everything = phrases.Filter(np.full(1024, 2 ** 64 - 1, np.uint64))
    for stretch, held, part in ((7, 10**6, 11), (64, 40, 1000), (1, 1, 1), (10**6, 10**6, 10**6)):
        monkeypatch.setattr(phrases, "STRETCH", stretch)
        monkeypatch.setattr(phrases, "TEXT_PART", part)
        f, _ = occurrences(data)
        for lang in f:
            c = phrases._Counter(lang.encode(), phrases.Wanted(everything, everything))
            got = collections.Counter()
            for i, (g, t) in enumerate(data):
                if g != lang:
                    continue
                found = list(c.add(t.encode()))
                if held == 40 and i % 2:
                    found += list(c.finish())
                for _, p, n in found:
                    got.update(dict(zip(p.tolist(), n.tolist()))) if len(set(p.tolist())) == len(p) else 1 / 0
            for _, p, n in c.finish():
                for x, m in zip(p.tolist(), n.tolist()):
                    got[x] += m
            total = got.pop(b"")
            assert got == {" ".join(p).encode(): n for p, n in f[lang].items()}
            assert total == sum(n for p, n in f[lang].items() if len(p) == 1)


def test_scores_are_exact_beyond_64_bits(spark):
    a, l, r = 3_000_000_019, 3_000_000_121, 3_000_000_737
    rows = [("en", 1, "x", l), ("en", 1, "y", r), ("en", 2, "x y", a), ("en", 1, "z", 20), ("en", 2, "y z", 12), ("en", 3, "x y z", 12)]
    frequent = spark.createDataFrame(rows, "lang string, words int, phrase string, n long")
    got = {x["phrase"]: x for x in phrases.score_phrases(frequent).collect()}
    assert got["x y"]["score"] == 1000000 * a * a // (l * r)
    assert "y z" not in got                                # inside x y z
    assert (got["x y z"]["l"], got["x y z"]["r"], got["x y z"]["score"]) == (l, 12, 1000000 * 144 // (l * 12))


def test_odd_rows(spark):
    long = "tick tock " * 150_000                          # one text of 1.5 MB
    rows = [(1, None, "en"), (2, "", "en"), (3, " \t\n.,", "de"), (None, long, None), (4, "tie a. tie b. " * 10, "en"),
            (4, "tie a. tie b. " * 10, "en")]
    got = [tuple(r) for r in phrases.mine_phrases(frame(spark, rows)).collect()]
    assert sorted(got) == brute([(g, t) for _, t, g in rows])
    assert [g[2] for g in sorted(got) if g[0] == "en"] == ["tie a", "tie b"]          # equal but for the phrase
    assert phrases.mine_phrases(frame(spark, rows).limit(0)).collect() == []
    assert phrases.mine_phrases(frame(spark, rows[:3])).collect() == []
