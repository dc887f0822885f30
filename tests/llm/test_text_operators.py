"""Quality rules, line dedup, SimHash, mixing, importance resampling, toxicity:
brute-force comparisons and edge cases on small fixtures."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridflow.llm import importance, line_dedup, mixing, quality, simhash, toxicity
from gridflow.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 4001}" for i in range(60_000)) + "\n" + "line of words\n" * 3000


def odd_documents(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties."""
    rows = [(1, "the cat sat on the mat and the dog ran to the house " * 6, "en", "a", 5), (2, None, None, None, None),
            (3, "", "en", "a", 0), (4, LONG, "en", "b", 1), (5, "  \t\n ", "xx", "b", 2),
            (None, "no id here at all", None, "a", 3), (6, "é ü ñ 中文 word", "fr", None, 4),
            (1, "the cat sat on the mat and the dog ran to the house " * 6, "en", "a", 5),
            (7, "shared line of the sites\nown seven", "en", "s7", 1), (8, "shared line of the sites\nown eight", "en", "s8", 1)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows=((1, 1, 0), (4, 0, 1), (7, 1, 1), (None, 1, 1), (6, None, None))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


# ---- quality ----------------------------------------------------------------

def brute_counts(text):
    t = text or ""
    w = WORD.findall(t)
    tri = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if tri[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered),
            len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_quality_counts_like_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").unionByName(odd_documents(spark))
    got = quality.features(docs).select("text", *quality.COUNTS).collect()
    assert len(got) == docs.count()
    for r in got:
        assert tuple(r)[1:] == brute_counts(r["text"])


def test_quality_distance_like_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    feats = quality.features(docs)
    refs = {r["__lang"]: r for r in quality.language_references(feats).collect()}
    rows = {r["doc_id"]: r for r in feats.collect()}

    def js(p, q):
        p, q = np.array(p, float), np.array(q, float)
        p, q = p / p.sum(), q / q.sum()
        m = (p + q) / 2
        kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m) if x > 0)
        return math.sqrt(max(0, (kl(p) + kl(q)) / 2))
    seen = 0
    for r in quality.quality_report(docs).collect():
        f = rows[r["doc_id"]]
        if r["q_char_distance"] is not None:
            seen += 1
            assert r["q_char_distance"] == pytest.approx(js(f["q_chars"], refs[f["lang"]]["__ref_chars"]), abs=1e-9)
        else:
            assert r["q_n_words"] < 50
        if r["q_word_distance"] is not None:
            assert r["q_word_distance"] == pytest.approx(js(f["q_common"], refs[f["lang"]]["__ref_common"]), abs=1e-9)
    assert seen > 100


def test_quality_drops_junk_and_keeps_prose(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    lab = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    r = quality.quality_report(docs).where("q_n_words >= 50").join(lab, "doc_id").groupBy("quality").agg(
        F.avg(F.col("q_kept").cast("int"))).collect()
    kept = dict(map(tuple, r))
    assert kept[1] > 0.98 and kept[0] < 0.15


def test_quality_edges(spark):
    got = quality.judge_quality(odd_documents(spark).withColumn("q_kept", F.lit("clash")).withColumn("lines", F.lit(1)))
    assert len(got.collect()) == 10 and dict(got.dtypes)["q_kept"] == "boolean" and "lines" in got.columns
    assert quality.judge_quality(empty(spark)).count() == 0
    assert quality.quality_report(empty(spark)).count() == 0


# ---- line dedup -------------------------------------------------------------

def brute_lines(rows, min_sites):
    sites, first = collections.defaultdict(set), {}
    strip = " \t\n\x0b\x0c\r"
    for k, t, s in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        for p, line in enumerate((t or "").split("\n")):
            x = line.strip(strip)
            if x:
                if s is not None:
                    sites[x].add(s)
                first.setdefault(x, (k, p))
    out = {}
    for k, t, s in rows:
        keep = [x for p, x in enumerate((t or "").split("\n"))
                if len(sites[x.strip(strip)]) < min_sites or not x.strip(strip) or first[x.strip(strip)] == (k, p)]
        out[k] = None if t is None else "\n".join(keep)
    return out


@pytest.mark.parametrize("min_sites", [2, 8])
def test_line_dedup_like_brute_force(spark, min_sites):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute_lines([(r.doc_id, r.text, r.source) for r in docs.collect()], min_sites)
    got = {r["doc_id"]: r["text"] for r in line_dedup.remove_boilerplate(docs, min_sites=min_sites).collect()}
    assert got == want


def test_line_dedup_far_lines_need_no_exact_count(spark):
    rows = [(i, "on every site\nmine %d" % i, f"s{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = line_dedup.remove_boilerplate(docs).where("n_lines_removed = 1").count()
    assert got == 299     # all but the first carrier


def test_line_dedup_edges(spark):
    d = odd_documents(spark).withColumn("pos", F.lit(1)).withColumn("n_lines_left", F.lit("clash"))
    got = line_dedup.remove_boilerplate(d, min_sites=2)
    assert got.count() == 10 and "pos" in got.columns
    by = {(r["doc_id"], r["source"]): r for r in got.collect()}
    assert by[(2, None)]["text"] is None and by[(8, "s8")]["text"] == "own eight"
    assert by[(7, "s7")]["text"] == "shared line of the sites\nown seven"
    assert line_dedup.remove_boilerplate(empty(spark)).count() == 0


# ---- simhash ----------------------------------------------------------------

def brute_fingerprint(text, size=4):
    import xxhash
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(low)
    if not w:
        return 0
    s = [" ".join(w)] if len(w) < size else [" ".join(w[i:i + size]) for i in range(len(w) - size + 1)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius):
    root = {i: i for i in range(len(fps))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash_like_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(150).unionByName(
        odd_documents(spark).where("doc_id is not null").withColumn("doc_id", F.col("doc_id") + 10_000))
    rows = docs.collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    comp = brute_components(fps, 4)
    low = {}
    for r, c in zip(rows, comp):
        low[c] = min(low.get(c, r.doc_id), r.doc_id)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_components(docs).collect()}
    assert got == {r.doc_id: (f"{f:016x}", low[c]) for r, f, c in zip(rows, fps, comp)}


def test_links_are_exact_in_hot_cells(spark):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    near = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for _ in range(700)}
    fps = sorted(near | {rng.getrandbits(64) for _ in range(700)})
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    d = spark.createDataFrame(signed, "fp long")
    links = simhash.fingerprint_links(d, 4, cell_rows=64)
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    want = brute_components(fps, 4)
    groups, mine = collections.defaultdict(set), collections.defaultdict(set)
    for (s,), c in zip(signed, want):
        groups[c].add(s)
        mine[roots.get(s, s)].add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_pivot_discards_lose_no_pair():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 64, 400, np.uint64)
    fps = np.concatenate([fps, fps[:200] ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64))])
    found = {tuple(sorted(p)) for i, j in simhash.links_within(fps, 4, simhash.pivots(), pairs_at_once=1000)
             for p in zip(i.tolist(), j.tolist())}
    want = {(i, j) for i in range(600) for j in range(i + 1, 600) if bin(int(fps[i] ^ fps[j])).count("1") <= 4}
    assert found == want
    for n in (10, 10**7, 10**10):    # every choice of blocks holds all pairs within the radius
        masks = simhash.block_masks(n, 4)
        for _ in range(50):
            diff = sum(1 << b for b in rng.choice(64, 4, replace=False).tolist())
            assert any(diff & m == 0 for m in masks)


def test_simhash_edges(spark):
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in
           simhash.simhash_components(odd_documents(spark).withColumn("fp", F.lit(1))).collect()}
    zero = "0" * 16
    assert got[(2, zero)] == got[(3, zero)] == got[(5, zero)] == 2
    assert simhash.simhash_components(empty(spark)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(300, 340)] + [(5, 5), (None, 3), (7, 300)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {7: 7} | {i: 7 for i in range(300, 340)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- mixing -----------------------------------------------------------------

def brute_targets(sizes, weights, share, epochs):
    """Clamp and redistribute until no target is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    t, budget, free = dict.fromkeys(names, 0.0), share * sum(sizes.values()), {s for s in names if sizes[s]}
    while free:
        level = budget / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > epochs * sizes[s]}
        if not over:
            t.update({s: level * w[s] for s in free})
            break
        for s in over:
            t[s] = epochs * sizes[s]
            budget -= t[s]
        free -= over
    return t


@pytest.mark.parametrize("share", [0.3, 1.5, 2.5])
def test_mix_targets_and_taken(spark, share):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), f"s{min(rng.randint(0, 9), rng.randint(0, 9))}" if i % 11 else None)
            for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = brute_targets(sizes, [3, 1, 2], share, 2.0)
    got = mixing.mix_sources(docs, [3, 1, 2], share).collect()
    taken = collections.Counter()
    for r in got:
        assert r["mix_target"] == pytest.approx(want[r["source"]]) and r["mix_source_size"] == sizes[r["source"]]
        assert 0 <= r["mix_copies"] <= 2
        taken[r["source"]] += r["mix_copies"] * len(r["text"].split())
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 30      # half the longest document
    again = {r["doc_id"]: r["mix_copies"] for r in mixing.mix_sources(docs.repartition(7), [3, 1, 2], share).collect()}
    assert again == {r["doc_id"]: r["mix_copies"] for r in got}


def test_mix_edges(spark):
    d = odd_documents(spark).withColumn("mix_copies", F.lit("clash")).withColumn("size", F.lit("x"))
    got = mixing.mix_sources(d, [3, 1, 2], 1.5)
    assert got.count() == 10 and "size" in got.columns
    again = mixing.repeat_documents(got)
    assert again.count() == got.agg(F.sum("mix_copies")).first()[0]
    assert mixing.mix_sources(empty(spark), [3, 1, 2], 1.5).count() == 0
    nothing = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert {r["mix_target"] for r in mixing.mix_sources(nothing, [1], 1.5).collect()} == {0.0}


# ---- importance resampling --------------------------------------------------

@pytest.mark.parametrize("k", [0, 1, 37, 500, 999, 1000, 2000])
def test_top_k_like_sorting(spark, k):
    rng = random.Random(1)
    rows = [(i, rng.choice([rng.randint(-10**12, 10**12), rng.randint(0, 5)])) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, v long")
    got = importance.top_k(df, "v", ["id"], k).collect()
    kept = [r["v"] for r in got if r["kept"]]
    assert sorted(kept) == sorted(v for _, v in rows)[max(0, 1000 - k):]
    assert {r["id"] for r in got if r["kept"]} == {r["id"] for r in importance.top_k(
        df.repartition(5), "v", ["id"], k).collect() if r["kept"]}


def test_importance_tells_junk_from_prose(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    lab = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = importance.resample(docs, lab.select("doc_id", F.col("quality").alias("good")))
    kept = dict(map(tuple, got.join(lab, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect()))
    assert kept[1] > 0.97 and kept[0] < 0.2
    share = lab.agg(F.avg("quality")).first()[0]
    assert got.where("kept").count() == round(share * docs.count())


def test_importance_log_ratio_like_brute_force(spark):
    rows = [(1, "a b a"), (2, "c d"), (3, "A b"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    good = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, good int")
    got = {r["doc_id"]: r for r in importance.resample(docs, good).collect()}
    raw, target = collections.Counter(), collections.Counter()

    def grams(t):
        w = (t or "").lower().split()
        return w + list(zip(w, w[1:]))
    for i, t in rows:
        raw.update(grams(t))
        if i == 1:
            target.update(grams(t))
    n, m = sum(raw.values()), sum(target.values())
    for i, t in rows:
        want = [math.log((target[g] + raw[g] / n) / (m + 1) / (raw[g] / n)) for g in grams(t)]
        assert got[i]["mean_log_ratio"] == pytest.approx(sum(want) / len(want) if want else 0, abs=1e-4)


def test_importance_weight_is_the_whole_log_ratio(spark):
    ratios = np.random.default_rng(8).standard_normal(importance.BUCKETS)
    text = " ".join(f"w{i}" for i in range(2000))
    docs = spark.createDataFrame([(1, text), (2, "a b"), (3, None)], "doc_id long, text string")
    want = {i: float(ratios[importance._hashed((t or "").encode(), len(ratios)).astype(int)].sum()) for i, t in [(1, text), (2, "a b"), (3, None)]}
    got = {r["doc_id"]: r for r in importance.importance(docs, ratios, "doc_id", "text").collect()}
    assert got[1]["n_grams"] == 3999
    for i in want:
        assert got[i]["log_weight"] == pytest.approx(want[i], abs=1e-6)
    capped = {r["doc_id"]: r for r in importance.importance(docs, ratios, "doc_id", "text", evidence=200).collect()}
    assert capped[1]["log_weight"] == pytest.approx(got[1]["mean_log_ratio"] * 200)


def test_importance_edges(spark):
    lab = labels(spark).select("doc_id", F.col("quality").alias("good"))
    got = importance.resample(odd_documents(spark).withColumn("good", F.lit(3)), lab)
    assert got.count() == 10
    assert importance.resample(empty(spark), lab).count() == 0
    none = importance.resample(odd_documents(spark), lab.limit(0))
    assert none.where("kept").count() == 10       # no labels: nothing to tell documents apart by


def test_sides_are_sent_by_their_bytes(spark, monkeypatch):
    from gridflow.llm.common import bounded_side
    text = "\n".join(f"line number {i} of all sites" for i in range(500))
    docs = spark.createDataFrame([(i, text, f"s{i}") for i in range(9)], "doc_id long, text string, source string")
    hinted = lambda d: "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    want = sorted(map(tuple, line_dedup.remove_boilerplate(docs).collect()))
    assert hinted(line_dedup.remove_boilerplate(docs))
    # 8 rows of 500 positions each: few rows, many bytes
    monkeypatch.setattr(line_dedup, "bounded_side", lambda df, row_bytes: bounded_side(df, row_bytes, 8 * 1000))
    got = line_dedup.remove_boilerplate(docs)
    assert not hinted(got) and sorted(map(tuple, got.collect())) == want
    assert not hinted(bounded_side(docs, 10, 89)) and hinted(bounded_side(docs, 10, 90)) and hinted(bounded_side(docs.limit(0), 10, 0))


# ---- toxicity ---------------------------------------------------------------

def test_model_is_a_distribution_and_matches_brute_force():
    train = (collections.Counter({"abc": 5, "abd": 3, "xyz": 2}), collections.Counter({"abx": 4, "abc": 1}))
    words = sorted(train[0].keys() | train[1].keys())
    g, sizes = toxicity._grams(words)
    u, at = np.unique(g, return_inverse=True)
    counts = np.stack([np.bincount(at, np.repeat([n[w] for w in words], sizes), len(u)).astype(np.int64) for n in train])
    model = toxicity.Model(u, counts)
    n, bits, d = toxicity.ORDER, toxicity.BITS, toxicity.DISCOUNT

    # brute force over tuples of letter classes
    def grams(w):
        c = [toxicity.EDGE] * (n - 1) + toxicity.letter_classes(w) + [toxicity.EDGE]
        return [tuple(c[i:i + n]) for i in range(len(c) - n + 1)]
    top = [collections.Counter() for _ in train]
    for c, t in zip(top, train):
        for w, k in t.items():
            for x in grams(w):
                c[x] += k
    orders = {n: top}
    types = set(top[0]) | set(top[1])
    for k in range(n - 1, 0, -1):
        c = collections.Counter(x[1:] for x in types)
        orders[k] = [c, c]
        types = set(c)

    def p(cls, x):
        if not x:
            return 1 / (1 << bits)
        c = {y: m for y, m in orders[len(x)][cls].items() if y[:-1] == x[:-1]}
        low = p(cls, x[1:])
        if not sum(c.values()):
            return low
        return (max(c.get(x, 0) - d, 0) + d * sum(m > 0 for m in c.values()) * low) / sum(c.values())
    for w in ["abc", "abx", "q", "abcabd", "é"]:
        got = model.log_likelihoods([w, "abd"])
        for cls in (0, 1):
            assert got[cls][0] == pytest.approx(sum(math.log(p(cls, x)) for x in grams(w)), abs=1e-9)
    for cls in (0, 1):      # the probabilities of all next letters add up to 1
        assert sum(p(cls, (0,) * (n - 3) + (1, 2) + (x,)) for x in range(1 << bits)) == pytest.approx(1)


def test_toxicity_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    lab = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    from gridflow.llm.queries import held_out
    got = toxicity.score_toxicity(docs, lab.where(~held_out(F.col("doc_id"))).select("doc_id", "toxic"))
    r = got.join(lab, "doc_id").where(held_out(F.col("doc_id"))).select("score", "toxic").collect()
    hit = sum(x.score >= 0.7 and x.toxic == 1 for x in r)
    said, there = sum(x.score >= 0.7 for x in r), sum(x.toxic == 1 for x in r)
    assert hit / said > 0.85 and hit / there > 0.7
    assert all(0 <= x.score <= 1 for x in r)


def test_toxicity_edges(spark):
    lab = labels(spark).select("doc_id", "toxic")
    got = toxicity.score_toxicity(odd_documents(spark).withColumn("toxic", F.lit("clash")), lab)
    r = {x["doc_id"]: x["score"] for x in got.collect()}
    assert got.count() == 10 and r[2] == r[3] == r[5] == 0.0
    assert toxicity.score_toxicity(empty(spark), lab).count() == 0
    assert {x["score"] for x in toxicity.score_toxicity(odd_documents(spark), lab.limit(0)).collect()} == {0.0}


def test_toxicity_is_the_same_with_a_joined_gram_table(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").unionByName(odd_documents(spark))
    lab = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", "toxic").unionByName(
        spark.createDataFrame([(4, 1), (6, 0)], "doc_id long, toxic int"))
    run = lambda d, y: sorted(map(tuple, toxicity.score_toxicity(d, y).collect()), key=lambda r: (r[0] or 0, r[5], r[1]))
    sent = run(docs, lab)
    monkeypatch.setattr(toxicity, "MAX_GRAMS", 50)      # far fewer than there are
    joined = run(docs, lab)
    assert len(sent) == len(joined) == docs.count() and any(r[1] > 0.01 for r in sent)
    for a, b in zip(sent, joined):
        assert a[0] == b[0] and a[5] == b[5] and a[1:5] == pytest.approx(b[1:5], rel=1e-6, abs=1e-9)
    assert {r[1] for r in run(odd_documents(spark), lab.limit(0))} == {0.0}
    assert run(empty(spark), lab) == []


def test_toxicity_document_scores_equal_brute_force(spark):
    """Scores from letter counts by plain loops: Kneser-Ney probabilities of every letter, the floor at the margin, the mean over words."""
    rows = [(1, "calm words flow on", 0), (2, "grumf zorx calm", 1), (3, "Zorx zorx, words", 1), (4, "the flow of words", 0), (5, "grumf-calm é zorx", 1)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9, "zorx calm unseen"), (10, ""), (11, None)], "doc_id long, text string")
    lab = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    n, d, margin, half = toxicity.ORDER, toxicity.DISCOUNT, 1.5, 0.2
    top = [collections.Counter(), collections.Counter()]

    def letters(w):
        return [toxicity.EDGE] * (n - 1) + toxicity.letter_classes(w) + [toxicity.EDGE]

    def words(t):
        return re.findall(r"[^\W\d_]+", t.lower())
    for _, t, y in rows:
        for w in words(t):
            c = letters(w)
            top[y].update(tuple(c[i - n + 1:i + 1]) for i in range(n - 1, len(c)))
    types = set(top[0]) | set(top[1])
    lower = {}
    for k in range(n - 1, 0, -1):
        lower[k] = collections.Counter(g[1:] for g in types)
        types = set(lower[k])

    def interpolated(counts, g, below):
        total = sum(v for x, v in counts.items() if x[:-1] == g[:-1])
        if not total:
            return below
        kinds = sum(1 for x in counts if x[:-1] == g[:-1])
        return (max(counts[g] - d, 0) + d * kinds * below) / total

    def likelihood(w, y):
        c, out = letters(w), 0.0
        for i in range(n - 1, len(c)):
            p = 1 / (1 << toxicity.BITS)
            for k in range(1, n):
                p = interpolated(lower[k], tuple(c[i - k + 1:i + 1]), p)
            out += math.log(interpolated(top[y], tuple(c[i - n + 1:i + 1]), p))
        return out
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, lab, half=half, margin=margin).collect()}
    for i, t in [(i, t) for i, t, _ in rows] + [(9, "zorx calm unseen")]:
        ws = words(t)
        e = sum(math.log1p(math.exp(likelihood(w, 1) - likelihood(w, 0) - margin)) for w in ws) / len(ws)
        assert got[i]["evidence"] == pytest.approx(e, rel=1e-9) and got[i]["score"] == pytest.approx(e / (e + half), rel=1e-9)
        long = sum(len(w) + 1 for w in ws)
        assert got[i]["ordinary_ll"] == pytest.approx(sum(likelihood(w, 0) for w in ws) / long, rel=1e-9)
        assert got[i]["toxic_ll"] == pytest.approx(sum(likelihood(w, 1) for w in ws) / long, rel=1e-9)
    assert got[10]["score"] == got[11]["score"] == 0.0 and got[2]["score"] > got[1]["score"]


def test_toxicity_limit_is_fitted_on_texts_held_back():
    toxic = np.array([1, 1, 1, 0, 0, 0, 0])
    evidence = np.array([[.9, .5], [.2, .4], [.1, .3], [.8, .03], [.3, .02], [.2, .02], [0, 0]])
    margin, half = toxicity.fit_limit(evidence, toxic, (2.0, 5.0), decision=0.7)
    assert margin == 5.0                              # the first margin cannot part them
    score = lambda e: e / (e + half)
    assert score(.3) > 0.7 > score(.03)
    assert toxicity.fit_limit(evidence, toxic * 0, (2.0, 5.0)) == toxicity.UNFITTED
    assert toxicity.fit_limit(evidence[:0], toxic[:0]) == toxicity.UNFITTED
    tied = np.full((4, 1), .5)                        # equal values fall on one side
    m, h = toxicity.fit_limit(tied, np.array([1, 0, 0, 1]), (3.0,))
    assert .5 / (.5 + h) > 0.7


def test_toxicity_scorer_adds_up_over_parts(monkeypatch):
    words = ["aa", "bb", "ccc"]
    g, _ = toxicity._grams(words)
    model = toxicity.Model(np.unique(g), np.ones((2, len(np.unique(g))), np.int64))
    texts = ["aa bb", "", "ccc " * 50 + "aa", "!", "bb"]
    whole = toxicity.Scorer(model, (2.0, 3.0))(texts)
    monkeypatch.setattr(toxicity.Scorer, "WORDS", 3)
    monkeypatch.setattr(toxicity.Scorer, "CACHE", 2)
    assert np.allclose(toxicity.Scorer(model, (2.0, 3.0))(texts), whole)
    assert whole[:, 0].tolist() == [2, 0, 51, 0, 1] and whole[:, 1].tolist() == [4, 0, 152, 0, 2]
