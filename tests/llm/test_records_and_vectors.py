"""WARC archives, embeddings, packing, URL reputation and the pipeline."""

import base64
import collections
import gzip
import hashlib
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridflow.llm import embed_dedup, packing, queries, simhash, urlrep, warc

PAGES = "page_id long, url string, html string"


# ---- WARC -------------------------------------------------------------------

def test_round_trip(spark):
    rng = random.Random(2)
    big = "".join(rng.choice("añ中 \r\n<>") for _ in range(50_000))
    rows = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (3, "http://a/3", big), (4, None, None), (5, "u\nv", ""),
            (6, "http://b", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n"), (7, "http://c", big), (None, "x", "solo"),
            (2, "http://a/2", "same")]
    pages = spark.createDataFrame(rows, PAGES).withColumn("segment", F.lit("clash"))
    got = warc.archive_round_trip(pages, segment_bytes=1000, chunk_bytes=77).collect()
    assert len(got) == len(rows) and all(r["problem"] is None for r in got)
    top = {}
    for p, _, h in rows:
        top[h or ""] = max(top.get(h or "", -1), p if p is not None else -1)
    want = []
    for p, u, h in rows:
        body = (h or "").encode()
        again = top[h or ""] not in (p, -1)
        want.append((None if p is None else str(p), "revisit" if again else "response", str(top[h or ""]) if again else None,
                     len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()))
    key = lambda x: tuple(map(str, x))
    assert sorted(((r["page_id"], r["type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in got), key=key) \
        == sorted(want, key=key)


def test_payload_bytes_come_back(spark, tmp_path):
    rows = [(i, f"http://h/{i}", "é" * i * 100) for i in range(1, 9)]
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame(rows, PAGES), path, segment_bytes=333)
    kinds = collections.Counter(r["type"] for r in warc.read_records(spark, path).collect())
    assert kinds["response"] == 8 and kinds["continuation"] > 8
    got = {int(r["page_id"]): bytes(r["payload"]) for r in warc.read_payloads(spark, path).collect()}
    assert got == {i: h.encode() for i, _, h in rows}


def archive(path, records):
    """An archive of per-record members, as other writers make them."""
    with open(path, "wb") as f:
        for head, block in records:
            lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
            f.write(gzip.compress(f"WARC/1.0\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"))


def test_damaged_segments_are_told(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "VERSION", b"WARC/1.0")
    http = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    body = http + b"3;x=y\r\nabc\r\n2\r\nde\r\n0\r\nTrailer: 1\r\n\r\n"

    def segments(rid, parts, total, numbers=None):
        out = []
        for n, part in enumerate(parts, 1):
            head = {"WARC-Segment-Number": (numbers or range(1, 99))[n - 1]}
            if n == 1:
                head |= {"WARC-Type": "response", "WARC-Record-ID": rid, "WARC-Page-ID": rid}
            else:
                head |= {"WARC-Type": "continuation", "WARC-Record-ID": f"{rid}-{n}", "WARC-Segment-Origin-ID": rid}
            if n == len(parts):
                head["WARC-Segment-Total-Length"] = total
            out.append((head, part))
        return out
    cut = [body[:20], body[20:50], body[50:]]
    whole = {"WARC-Type": "response", "WARC-Record-ID": "plain", "WARC-Page-ID": "plain"}
    records = [(whole, body), (dict(whole, **{"WARC-Page-ID": "bad-chunk"}), http + b"9\r\nabc\r\n0\r\n\r\n"),
               (dict(whole, **{"WARC-Page-ID": "no-size"}), http + b"zz\r\n"),
               (dict(whole, **{"WARC-Page-ID": "digest", "WARC-Payload-Digest": "sha1:AAAA"}), body)]
    records += list(reversed(segments("good", cut, len(body))))
    records += segments("short", cut, len(body) + 1) + segments("gap", [cut[0], cut[2]], len(body), [1, 3])
    records += segments("orphan", cut, len(body))[1:]
    (tmp_path / "w").mkdir()
    archive(tmp_path / "w" / "a.warc.gz", records)
    got = {r["page_id"] or "orphan": (r["payload"] and bytes(r["payload"]), r["problem"])
           for r in warc.read_payloads(spark, str(tmp_path / "w")).collect()}
    assert got["plain"] == (b"abcde", None) and got["good"] == (b"abcde", None)
    assert "framing" in got["bad-chunk"][1] and "framing" in got["no-size"][1] and "digest" in got["digest"][1]
    assert got["short"][1] == "total length differs" and got["gap"][1] == "segments missing or repeated"
    assert got["orphan"][1] == "first segment missing"


def test_warc_empty_table(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], PAGES)).count() == 0


# ---- embeddings -------------------------------------------------------------

def brute_links(rows, threshold=0.9):
    fine = [(k, np.array(v, float)) for k, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n = {i: 0 for i in range(len(rows))}
    ok = [i for i, (k, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    root = {i: i for i in range(len(rows))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, i in enumerate(ok):
        for b in range(a):
            j = ok[b]
            x, y = fine[a][1], fine[b][1]
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                n[i] += 1
                n[j] += 1
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    low = {}
    for i, (k, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), k), k)
    return {k: (n[i], low[find(i)], low[find(i)] == k) for i, (k, _) in enumerate(rows)}


def test_embeddings_like_brute_force(spark):
    rng = np.random.default_rng(4)
    rows, k = [], 0
    for size in [1] * 150 + [2] * 30 + [40, 120]:
        base = rng.standard_normal(16)
        for _ in range(size):
            rows.append((k, (base + 0.08 * rng.standard_normal(16)).tolist()))
            k += 1
    rows += [(k + i, rows[-1][1]) for i in range(30)]          # exact copies
    rows += [(k + 30, None), (k + 31, [0.0] * 16), (k + 32, [1.0, None] + [0.0] * 14), (k + 33, [float("nan")] * 16),
             (k + 34, [float("inf")] + [1.0] * 15), (k + 35, []), (k + 36, [1.0, 2.0]), (k + 37, [2.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit("clash"))
    want = brute_links(rows)
    # short windows and blocks, so that runs, seams and chunks all matter
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in
           embed_dedup.dedup_embeddings(df, window=8).collect()}
    links = sum(x[0] for x in want.values())
    assert sum(x[0] for x in got.values()) >= 0.99 * links
    assert all(got[i][0] <= want[i][0] for i in got)
    assert sum(got[i] == want[i] for i in got) >= 0.97 * len(rows)
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in
            embed_dedup.dedup_embeddings(df).collect()} == want


def test_embeddings_in_a_dense_cone(spark):
    # a third of the rows in a cone of pairwise cosine 0.8, far more of them under a key prefix than a window holds
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    wide, cone, pairs, dim = 8000, 3800, 100, 64
    centre = unit(rng.standard_normal(dim))
    off = rng.standard_normal((cone, dim))
    off = unit(off - np.outer(off @ centre, centre))
    v = np.sqrt(0.8) * centre + np.sqrt(0.2) * off
    mate = rng.standard_normal((pairs, dim))
    mate -= (mate @ centre)[:, None] * centre
    mate = unit(mate - (mate * off[:pairs]).sum(1, keepdims=True) * off[:pairs])
    twin = np.sqrt(0.8) * centre + np.sqrt(0.2) * (0.53 * off[:pairs] + np.sqrt(1 - 0.53 ** 2) * mate)   # cosine 0.906
    m = unit(np.concatenate([unit(rng.standard_normal((wide, dim))), v, twin]))
    s = m @ m.T >= 0.9
    want = {i: int(x) - 1 for i, x in enumerate(s.sum(1))}
    assert sum(want.values()) >= 2 * pairs
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "vec_id long, embedding array<double>")
    # short windows: as many rows a window as in a table of some 50,000 rows with the usual one
    got = {r["vec_id"]: r["n_links"] for r in embed_dedup.dedup_embeddings(df, window=32).collect()}
    assert all(got[i] <= want[i] for i in got)
    assert sum(got.values()) >= 0.99 * sum(want.values())


def test_measured_chance_of_a_miss():
    rng = np.random.default_rng(6)
    keys = np.sort(np.concatenate([rng.integers(0, 1 << 63, 500), (1 << 61) + rng.integers(0, 1 << 20, 500), np.full(40, 77)]))
    bits = [format(k, "063b") for k in keys.tolist()]
    common = lambda x, y: len(os.path.commonprefix([x, y]))
    for first, last in ((False, False), (True, True)):
        got = embed_dedup._log_miss(keys, 10, 0.85, first, last)
        for i in range(0, len(keys), 7):
            after = common(bits[i], bits[min(i + 11, len(keys) - 1)]) if i + 11 < len(keys) or last else -1
            before = common(bits[i], bits[max(i - 11, 0)]) if i >= 11 or first else -1
            hit = sum(0.85 ** b * 0.15 for b in range(63) if b > (before if bits[i][b] == "1" else after))
            hit += 0.85 ** 63 if max(after, before) < 63 else 0
            assert got[i] == pytest.approx(np.log1p(-min(hit, 1 - 1e-12)), rel=1e-6, abs=1e-9)


def test_more_passes_for_more_vectors():
    few, many = embed_dedup.passes_needed(1000, 128, 0.9), embed_dedup.passes_needed(10**9, 128, 0.9)
    assert 1 <= few < many
    assert embed_dedup.passes_needed(10**6, 128, 0.99) < embed_dedup.passes_needed(10**6, 128, 0.9)


def test_embeddings_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert embed_dedup.dedup_embeddings(spark.createDataFrame([], schema)).count() == 0
    got = embed_dedup.dedup_embeddings(spark.createDataFrame([(5, [1.0, 0.0]), (5, [1.0, 0.0]), (None, [1.0, 0.0])], schema)).collect()
    assert [r["n_links"] for r in got] == [2, 2, 2] and {r["component_id"] for r in got} == {5}


# ---- packing ----------------------------------------------------------------

def test_ids_are_those_of_whole_texts(spark):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(queries.vocabulary())
    mine = packing.Tokens(queries.vocabulary())
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += ["", " \t\n", "It's we'll don't <|endoftext|> x<|startoftext|>y", "a\x1cb\x85c\xa0d\u2003e", "中文 日本\n\x0b\x0c x",
              "é e\u0301 ﬁ Ⅷ İ", "12 345.67 $%&", "a" * 5000]
    for t in texts:
        assert np.frombuffer(mine.packed(t.encode()), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def check_packing(rows, capacity):
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def test_packing_of_documents(spark):
    import zlib
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(queries.vocabulary())
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(900, None), (901, ""), (902, "word " * 5000), (None, "x")], "doc_id long, text string")
    docs = docs.unionByName(odd).withColumn("length", F.lit("clash"))
    rows = packing.pack_documents(docs, queries.vocabulary()).collect()
    n = check_packing(rows, 2048)
    assert n == -(-sum(r["length"] for r in rows) // 2048)      # as few as can be
    by = collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    for d in docs.collect():
        ids = tok.encode(d.text or "", add_special_tokens=False).ids + [0]
        parts = sorted(by[d.doc_id], key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(-(-len(ids) // 2048)))
        for r in parts:
            part = np.array(ids[r["start"]:r["start"] + r["length"]], "<u4").tobytes()
            assert r["start"] == 2048 * r["piece"] and r["ids_crc32"] == zlib.crc32(part)
        assert sum(r["length"] for r in parts) == len(ids)
    assert packing.pack_documents(docs.limit(0), queries.vocabulary()).count() == 0


def squares(bins):
    return sum(n * sum(b) ** 2 for b, n in bins.items())


def pieces_of(bins):
    out = collections.Counter()
    for b, n in bins.items():
        for x in b:
            out[x] += n
    return out


@pytest.mark.parametrize("seed", range(6))
def test_local_search_keeps_pieces_and_gains(seed):
    rng = random.Random(seed)
    sizes = collections.Counter(rng.choice([rng.randint(1, 40), rng.randint(30, 60)]) for _ in range(300))
    # a poor start: one bin for every two pieces
    flat, start = list(sizes.elements()), collections.Counter()
    for i in range(0, len(flat), 2):
        pair = flat[i:i + 2]
        for b in ([tuple(sorted(pair, reverse=True))] if sum(pair) <= 100 else [(x,) for x in pair]):
            start[b] += 1
    end = packing.local_search(start, 100)
    assert pieces_of(end) == sizes and all(sum(b) <= 100 for b in end)
    assert squares(end) > squares(start) and sum(end.values()) < sum(start.values())
    fit = packing.best_fit(dict(sizes), 100)
    assert pieces_of(fit) == sizes and all(sum(b) <= 100 for b in fit)
    done = packing.local_search(fit, 100)
    assert pieces_of(done) == sizes and sum(done.values()) <= sum(fit.values())


def test_local_search_exchanges_two_for_one():
    # 6+6, 4+4+... cannot be emptied by moves alone
    bins = collections.Counter({(50, 20): 1, (25, 25, 20): 1, (30,): 1})
    end = packing.local_search(bins, 100)
    assert pieces_of(end) == pieces_of(bins) and sum(end.values()) == 2


# ---- URL reputation ---------------------------------------------------------

RULES = queries.RULES
URLS = [("HTTP://WWW.Example.NET/en/x?q#f", "www.example.net", "/en/x", "example.net/en/", "allow"),
        ("http://example.net", "example.net", "", None, None), ("http://example.net/", "example.net", "/", "net/", "block"),
        ("x://badexample.net/en/", "badexample.net", "/en/", "net/", "block"), ("no scheme", "", "", None, None),
        (None, "", "", None, None), ("http://a.example.com/de/1", "a.example.com", "/de/1", "example.com/de/", "block"),
        ("http://b.org/fr/?x", "b.org", "/fr/", "org/fr/", "allow"), ("http://b.org/frx", "b.org", "/frx", None, None),
        ("a://b://c/d", "b:", "//c/d", None, None), ("http://É.ORG#x", "É.org", "", None, None), ("://?x", "", "", None, None)]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u[0]) for i, u in enumerate(URLS)], "page_id long, url string").withColumn("rule", F.lit(1))
    none = spark.createDataFrame([], "page_id long, good int")
    for r in urlrep.judge_urls(pages, none, RULES).collect():
        _, host, path, rule, verdict = URLS[r["page_id"]]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or "allow")
    assert urlrep.judge_urls(pages.limit(0), none, RULES).count() == 0


def test_bad_hosts_are_blocked_and_thin_evidence_is_shrunk(spark):
    rows, lab = [], []

    def add(host, good, bad, unlabelled=0):
        for i in range(good + bad + unlabelled):
            k = len(rows)
            rows.append((k, f"http://{host}/{i}"))
            if i < good + bad:
                lab.append((k, 1 if i < good else 0))
    for i in range(30):
        add(f"fine{i}.com", 18, 2)
    add("spam.com", 2, 60, 5)
    add("thin.com", 0, 1)          # one bad page does not damn a host
    add("a.co.uk", 3, 0)
    add("never.io", 0, 0, 4)
    got = urlrep.judge_urls(spark.createDataFrame(rows, "page_id long, url string"),
                            spark.createDataFrame(lab, "page_id long, good int"), []).select("host", "verdict", "rate").distinct().collect()
    by = {r["host"]: r for r in got}
    assert by["spam.com"]["verdict"] == "block" and by["spam.com"]["rate"] < 0.2
    assert by["thin.com"]["verdict"] == "allow" and by["thin.com"]["rate"] > 0.3
    assert all(r["verdict"] == "allow" for h, r in by.items() if h != "spam.com")
    rep = urlrep.host_reputation(spark.createDataFrame([("x.a.co.uk", 1), ("y.org", None)], "host string, good int"))
    assert all(r["lower"] <= r["rate"] <= r["upper"] for r in rep.collect())


def test_domains(spark):
    hosts = ["a.b.co.uk", "co.uk", "x.example.org", "org", "", "a.b.c.d"]
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    got = [tuple(r) for r in df.select(urlrep.domain_of(F.col("h")), urlrep.suffix_of(F.col("h"))).collect()]
    assert got == [("b.co.uk", "co.uk"), ("co.uk", "co.uk"), ("example.org", "org"), ("org", "org"), ("", ""), ("c.d", "d")]


# ---- pipeline ---------------------------------------------------------------

def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (10**6, "", "en", "src0", 0),
                                 (10**6 + 1, "the word is on the line " * 20, None, None, 3)], docs.schema)
    docs = docs.unionByName(odd)
    from gridflow.session import land
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(land(stage(spark, seen[-1], sf), f"test-{name}"))
    first, kept, lines, unique, mixed, packed = seen
    for d in seen[1:5]:
        assert d.dtypes == docs.dtypes
    from gridflow.llm import quality
    want = {r["doc_id"] for r in quality.judge_quality(docs).where("q_kept").collect()}
    assert {r["doc_id"] for r in kept.collect()} == want and kept.count() < docs.count()
    assert lines.count() <= kept.count() and lines.agg(F.sum("n_chars")).first()[0] < kept.agg(F.sum("n_chars")).first()[0]
    groups = simhash.simhash_components(lines).collect()
    assert {r["doc_id"] for r in unique.collect()} == {r["component_id"] for r in groups}
    copies = collections.Counter(r["doc_id"] for r in mixed.collect())
    assert max(copies.values()) == 2 and set(copies) <= {r["doc_id"] for r in unique.collect()}
    rows = packed.collect()
    check_packing(rows, 2048)
    starts = collections.Counter(r["doc_id"] for r in rows if r["piece"] == 0)
    assert starts == copies
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_run_equals_its_stages(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert got.count() > 100 and os.path.isdir("/root/testdata/sf0.001")


def test_suffixes_from_a_table(spark):
    rules = spark.createDataFrame([("com",), ("Com.SG",), ("*.ck",), ("!www.ck",), ("ck",), ("k12.ma.us",), (None,)], "suffix string")
    hosts = {"a.shop.com.sg": ("com.sg", "shop.com.sg"), "x.y.com": ("com", "y.com"), "p.q.r.ck": ("r.ck", "q.r.ck"),
             "a.www.ck": ("ck", "www.ck"), "s.b.k12.ma.us": ("k12.ma.us", "b.k12.ma.us"), "lone": ("lone", "lone"),
             "com.sg": ("com.sg", "com.sg"), "": ("", ""), "a.b.unknown": ("unknown", "b.unknown")}
    got = urlrep.named(spark.createDataFrame([(h,) for h in hosts], "host string"), rules).collect()
    assert {r["host"]: (r["suffix"], r["domain"]) for r in got} == hosts
    # a bad host under a suffix of two labels says nothing about another site there
    rows = [("bad.com.sg", 0)] * 400 + [("clean.com.sg", None)] + [(f"h{i}.net", 1) for i in range(300) for _ in range(5)]
    pages = spark.createDataFrame([(i, f"http://{h}/") for i, (h, _) in enumerate(rows)], "page_id long, url string")
    lab = spark.createDataFrame([(i, g) for i, (_, g) in enumerate(rows) if g is not None], "page_id long, good int")
    rep = {r["host"]: r for r in urlrep.judge_urls(pages, lab, [], suffixes=rules).collect()}
    assert rep["bad.com.sg"]["verdict"] == "block"
    alone = {r["host"]: r for r in urlrep.judge_urls(pages, lab, []).collect()}
    assert rep["clean.com.sg"]["rate"] > alone["clean.com.sg"]["rate"]


def test_local_search_looks_at_all_sums_of_two():
    a = tuple(sorted(random.Random(3).sample(range(1000, 100_000), 45), reverse=True))
    assert len({x + y for i, x in enumerate(a) for y in a[i + 1:]}) > 512
    least = a[-1] + a[-2]                     # only this pair fits, for the first piece of b
    b, capacity = (10**7 - least, least - 1), 10**7
    offers = packing._Offers(capacity)
    offers.put(b, 1)
    partner, out, back, kind = offers.best(a)
    assert partner == b and out == (a[-1], a[-2])
    assert packing._exchanged(a, b, out, back, kind)[1] == (10**7 - least, a[-2], a[-1])


def test_local_search_takes_two_for_one():
    offers = packing._Offers(100)
    b = (40, 25, 20, 11)                      # 4 free: 49 may come in for 25 and 20
    offers.put(b, 1)
    partner, out, back, kind = offers.best((49,))
    assert (partner, out, back) == (b, (49,), 45)
    assert packing._exchanged((49,), b, out, back, kind) == ((25, 20), (49, 40, 11))


def test_lower_bound_holds():
    for seed in range(40):
        rng = random.Random(seed)
        sizes = collections.Counter(rng.randint(1, rng.choice([40, 60, 100])) for _ in range(rng.randint(1, 60)))
        sizes = dict(sizes)
        least = packing.lower_bound(sizes, 100)
        end = packing.local_search(packing.best_fit(sizes, 100), 100)
        assert pieces_of(end) == collections.Counter(sizes)
        assert -(-sum(s * n for s, n in sizes.items()) // 100) <= least <= sum(end.values())
    assert packing.lower_bound({}, 100) == 0 and packing.lower_bound({60: 5}, 100) == 5
    assert packing.lower_bound({60: 2, 50: 3}, 100) == 4


@pytest.mark.parametrize("times", [1, 30])
def test_local_search_ends_soon_on_lengths_of_the_pipeline(times):
    # lengths as the pipeline has them: long tails, no short documents, the bound out of best fit's reach
    rng = np.random.default_rng(7)
    sizes = collections.Counter(rng.integers(60, 900, 9000).tolist() + np.minimum(rng.lognormal(6.6, .6, 5000), 2047)
                                .astype(int).tolist() + [2048] * 800)
    sizes = {s: n * times for s, n in sizes.items()}
    fit = packing.best_fit(sizes, 2048)
    start = time.process_time()
    end = packing.local_search(fit, 2048)
    assert time.process_time() - start < 15
    assert pieces_of(end) == collections.Counter(sizes) and all(sum(b) <= 2048 for b in end)
    assert packing.lower_bound(sizes, 2048) <= sum(end.values()) <= sum(fit.values())


def test_suffixes_are_derived_from_hosts(spark):
    hosts = ([f"n{i}.co.xy" for i in range(12)] + [f"www.n{i}.co.xy" for i in range(12)] + [f"h{i}.one.com" for i in range(9)]
             + ["a.b.c.d", "com", "", "n1.co.xy", None])
    d = spark.createDataFrame([(h,) for h in hosts], "host string")
    assert [r[0] for r in urlrep.derived_suffixes(d).collect()] == ["co.xy"]         # one.com has nine names, not ten
    assert {r[0] for r in urlrep.derived_suffixes(d, 9).collect()} == {"co.xy", "one.com"}
    got = {r["host"]: (r["suffix"], r["domain"]) for r in urlrep.named(d.where("host is not null").distinct(), urlrep.derived_suffixes(d)).collect()}
    assert got["www.n3.co.xy"] == ("co.xy", "n3.co.xy") and got["h1.one.com"] == ("com", "one.com") and got["com"] == ("com", "com")
    assert urlrep.derived_suffixes(d.limit(0)).collect() == []


def test_url_odd_rows(spark):
    """Null and repeated keys, repeated rows, very long urls, no labels at all."""
    long = "http://" + "a." * 30_000 + "net/" + "x" * 1_000_000
    rows = [(None, "http://a.com/x"), (1, "http://a.com/x"), (1, "http://a.com/x"), (2, long), (3, None), (4, "http:///p")]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in rows], "page_id long, url string, host string")
    lab = spark.createDataFrame([(1, 0), (None, 1), (7, None)], "page_id long, good int")
    got = urlrep.judge_urls(pages, lab, RULES, suffixes=urlrep.derived_suffixes(pages.select(urlrep.host_of(F.col("url")).alias("host")))).collect()
    assert len(got) == len(rows)
    assert sorted(str(r["page_id"]) for r in got) == ["1", "1", "2", "3", "4", "None"]
    assert {r["rule"] for r in got if r["page_id"] == 2} == {"net/"} and {r["host"] for r in got if r["page_id"] in (3, 4)} == {""}
    assert len({(r["verdict"], r["rate"]) for r in got if r["host"] == "a.com"}) == 1
    none = urlrep.judge_urls(pages, lab.limit(0), RULES).collect()
    assert {r["rate"] for r in none} == {0.5}


def test_vectors_of_tiny_and_huge_parts_link_by_direction(spark):
    rows = [(1, [1e-200, 2e-200]), (2, [1e200, 2e200]), (3, [1.0, 2.0]), (4, [2e-200, -1e-200]), (5, [5e-324, 0.0]), (6, [1e308, 1e308])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.dedup_embeddings(d).collect()}
    # cosine of (1, 2) and (1, 1) is 0.949, of (1, 1) and (1, 0) 0.707
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 6: (3, 1), 4: (0, 4), 5: (0, 5)}
    assert np.allclose(np.linalg.norm(embed_dedup._unit(np.array([r[1] for r in rows])), axis=1), 1)
