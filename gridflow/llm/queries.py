"""Registered queries of the pipeline operators, with SQL where SQL can say it.

Every query applies its operator with production parameters to its whole table
and derives digest columns from the operator's real output.
"""

from __future__ import annotations

import importlib.util
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embed_dedup, importance, langid, line_dedup, mixing, packing, phrases, quality, simhash, toxicity, urlrep, warc, whitening
from .common import table

MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS = [3, 1, 2], 1.5, 2.0
TOXIC_FROM = 0.7
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"),
         ("allow", "org", "/fr/")]


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public tokenizer file; the package that brings them is on every machine."""
    if importlib.util.find_spec("public_tokenizers"):
        import public_tokenizers
        return public_tokenizers.path(name)
    return os.path.join("/opt/tokenizers", name)


def held_out(key):
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = mixing.mix_sources(table(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS)
    size = mixing.word_count(F.col("text"))
    return d.select("doc_id", size.alias("size"), F.col("mix_source_size").alias("source_size"),
                    F.col("mix_target").alias("target"), (size * F.col("mix_copies")).alias("taken"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    d = toxicity.score_toxicity(table(spark, sf_dir, "documents"), labels.select("doc_id", "toxic"))
    return d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                    (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"), "ordinary_ll", "toxic_ll")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    d = warc.archive_round_trip(pages)
    return d.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest",
                    F.col("type").alias("record_type"), F.col("refers_to").cast(kind).alias("refers_to"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = line_dedup.remove_boilerplate(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_lines_removed", "n_lines_left", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.dedup_embeddings(table(spark, sf_dir, "embeddings"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary())


def op8_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("good"))
    return importance.resample(table(spark, sf_dir, "documents"), labels)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality.quality_report(table(spark, sf_dir, "documents"))
    return d.select("doc_id", *[F.col(f"q_{c}").alias(c) for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labelled page is good if its quality is and it is not toxic; page ids are document ids."""
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), good.cast("int").alias("good"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    suffixes = urlrep.derived_suffixes(pages.select(urlrep.host_of(F.col("url")).alias("host")))
    d = urlrep.judge_urls(pages, page_labels(spark, sf_dir), RULES, suffixes=suffixes)
    return d.select("page_id", "host", "path", "rule", "verdict")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine_phrases(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit_languages(docs.where(~held_out(F.col("doc_id"))))
    d = langid.identify(docs, model)
    return d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "lead", "rejected")


QUERIES = {f.__name__: f for f in (op1_mix, op2_toxicity, op3_warc, op4_line_dedup, op5_simhash, op6_embeddings,
                                   op7_packing, op8_importance, op9_quality, op10_urls, op11_phrases,
                                   op12_whitening, op13_language)}

_W = r"[^\x20\x09-\x0D]+"
_TRIM = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"

_OP1 = rf"""
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_W}'))::BIGINT AS size,
                  md5('{mixing.SEED}|' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))) AS k FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS size FROM s GROUP BY source),
w AS (SELECT *, ([3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE])[((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]
             AS weight FROM src),
f AS (SELECT source, weight, 2.0::DOUBLE * size AS cap, 1.5::DOUBLE * (SELECT sum(size)::DOUBLE FROM src) AS budget FROM w WHERE size > 0),
l AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS clamped,
             sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS remaining FROM f),
lev AS (SELECT (budget - clamped) / remaining AS lv FROM l WHERE (budget - clamped) / remaining * weight <= cap
        ORDER BY cap / weight, source IS NULL, source LIMIT 1),
t AS (SELECT source, size, CASE WHEN size > 0 THEN least(2.0::DOUBLE * size, coalesce((SELECT lv FROM lev) * weight, 2.0::DOUBLE * size))
             ELSE 0.0::DOUBLE END AS target FROM w),
n AS (SELECT *, CASE WHEN size > 0 THEN floor(target / size)::BIGINT ELSE 0 END AS copies FROM t),
g AS (SELECT source, k, sum(size) AS s FROM s WHERE size > 0 GROUP BY source, k),
c AS (SELECT source, k, sum(s) OVER (PARTITION BY source ORDER BY k) - s / 2.0 AS mid FROM g)
SELECT s.doc_id, s.size, n.size AS source_size, n.target,
       (s.size * (n.copies + CASE WHEN c.mid <= n.target - n.copies * n.size AND n.target - n.copies * n.size > 0 THEN 1 ELSE 0 END))::BIGINT AS taken
FROM s JOIN n ON s.source IS NOT DISTINCT FROM n.source
LEFT JOIN c ON c.source IS NOT DISTINCT FROM s.source AND c.k = s.k
"""

_OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS s, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (((('0x' || substr(s, (5 * (j // 4) + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (j % 4))::BIGINT) & 31) + 1)::BIGINT, 1) FOR j IN range(32)], '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM q
"""

_OP4 = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT doc_id, source, unnest(l) AS raw, unnest(range(len(l))) AS pos FROM d),
y AS (SELECT *, regexp_replace(raw, '{_TRIM}', '', 'g') AS line FROM x),
bad AS (SELECT line FROM y WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= {line_dedup.MIN_SITES}),
z AS (SELECT *, line <> '' AND line IN (SELECT line FROM bad)
        AND row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) > 1 AS gone FROM y)
SELECT doc_id, count(*) FILTER (gone)::INTEGER AS n_lines_removed, count(*) FILTER (NOT gone AND line <> '')::INTEGER AS n_lines_left,
       md5(coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS text_md5
FROM z GROUP BY doc_id
"""

_OP6 = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b
          WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(low.b, vec_id)) AS component_id,
       vec_id <= coalesce(low.b, vec_id) AS kept
FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN low ON low.a = vec_id
"""


def _op9() -> str:
    def js(p, q):   # Jensen-Shannon terms of one class
        m = f"(({p}) + ({q}))"
        return "(" + " + ".join(f"CASE WHEN ({a}) > 0 THEN ({a}) * log2(2 * ({a}) / {m}) ELSE 0 END" for a in (p, q)) + ")"
    codes = "['" + "','".join(quality.COMMON_WORDS) + "']"
    lists = "CASE lang " + " ".join(
        f"WHEN '{k}' THEN ['" + "','".join(v) + "']" for k, v in quality.COMMON_WORDS.items()) + " END"
    nc, nw = quality.N_CHARS, quality.N_COMMON
    q = quality
    char = " + ".join(js(f"c[{i}] / length", f"rc[{i}]") for i in range(1, nc + 1))
    word = " + ".join(js(f"h[{i}] / n_words", f"rh[{i}]") for i in range(1, nw + 1))
    sums_c = ", ".join(f"sum(c[{i}])" for i in range(1, nc + 1))
    sums_h = ", ".join(f"sum(h[{i}])" for i in range(1, nw + 1))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(lang, '') AS lg, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '{_W}') AS w,
                  regexp_replace(coalesce(text, ''), '[a-z\x20\x09-\x0D]+', '', 'g') AS rest,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
                  {lists} AS words FROM documents),
a AS (SELECT *, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(text)::DOUBLE AS length,
             len(regexp_extract_all(rest, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             len(regexp_extract_all(rest, '\p{{Lu}}')) AS up, len(regexp_extract_all(rest, '\p{{Nd}}')) AS dg,
             len(regexp_extract_all(rest, '[\p{{P}}\p{{S}}]')) AS pu FROM d),
i AS (SELECT r, n_words, w, unnest(range(1, n_words + 1)) AS i FROM a),
t AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM i WHERE i <= n_words - 2),
cov AS (SELECT r, count(DISTINCT p)::BIGINT AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM t WHERE n > 1) GROUP BY r),
b AS (SELECT a.*, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             n_words < {q.MIN_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {q.MAX_REPEAT_PCT} * n_words AS base_failed FROM a LEFT JOIN cov USING (r)),
k AS (SELECT r, list_position(words, CASE WHEN list_contains(words, w[i]) THEN w[i] ELSE lower(w[i]) END) AS k
      FROM i JOIN (SELECT r, words FROM a) USING (r)
      WHERE list_contains(words, w[i]) OR list_contains([upper(x[1]) || x[2:] FOR x IN words], w[i])),
kc AS (SELECT r, k, count(*) AS n FROM k GROUP BY r, k),
km AS (SELECT r, map_from_entries(list((k, n))) AS m, sum(n) AS hits FROM kc GROUP BY r),
f AS (SELECT b.*, [up::DOUBLE, dg, length - word_chars, n_symbols, pu - n_symbols, length - up - dg - (length - word_chars) - pu] AS c,
             [{", ".join(f"coalesce(m[{j}], 0)::DOUBLE" for j in range(1, nw))}, n_words - coalesce(hits, 0)] AS h FROM b LEFT JOIN km USING (r)),
sums AS (SELECT lg, [{sums_c}] AS sc, [{sums_h}] AS sh FROM f
         WHERE n_words >= {q.MIN_COMPARE_WORDS} AND NOT base_failed AND n_symbols * 100 < length AND c[1] * 5 < length GROUP BY lg),
refs AS (SELECT lg, [x / list_sum(sc) FOR x IN sc] AS rc, [x / list_sum(sh) FOR x IN sh] AS rh FROM sums),
j AS (SELECT f.*, rc, rh, n_words * (1 - rh[{nw}]) AS e FROM f LEFT JOIN refs USING (lg)),
v AS (SELECT *, CASE WHEN n_words >= {q.MIN_COMPARE_WORDS} THEN sqrt(greatest(0, ({char}) / 2)) END AS cd,
             CASE WHEN n_words >= {q.MIN_COMPARE_WORDS} AND e >= {q.MIN_COMMON_WORDS} THEN sqrt(greatest(0, ({word}) / 2)) END AS wd FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(cd > {q.MAX_CHAR_DISTANCE} * (1 + sqrt({q.SAMPLING} / n_words)), false)
       AND NOT coalesce(wd > {q.MAX_WORD_DISTANCE} * (1 + sqrt({q.SAMPLING} / e)), false) AS kept FROM v
"""


def _op10() -> str:
    u = urlrep
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)

    def shrink(name, groups, parent, on):
        join = f"JOIN {parent} p USING ({on})" if on else f"CROSS JOIN {parent} p"
        return f"""
{name}_j AS (SELECT g.*, p.n AS up_n, p.good AS up_good, p.rate AS prior FROM {groups} g {join}),
{name}_k AS (SELECT greatest({u.MIN_STRENGTH}, least({u.MAX_STRENGTH}, CASE WHEN vn > 0 AND s > v THEN vn / (s - v) - 1 ELSE {u.MAX_STRENGTH} END)) AS k
  FROM (SELECT sum(n * pow(good / n - m, 2)) AS s, sum(m * (1 - m)) AS v, sum(m * (1 - m) * (n - 1)) AS vn
        FROM (SELECT *, up_good / up_n AS m FROM {name}_j WHERE n > 0))),
{name} AS (SELECT *, (coalesce(k, {u.MAX_STRENGTH}) * prior + good) / (coalesce(k, {u.MAX_STRENGTH}) + n) AS rate,
                  coalesce(k, {u.MAX_STRENGTH}) + n AS total FROM {name}_j CROSS JOIN {name}_k)"""
    return rf"""
WITH p0 AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{u.UPPER}', '{u.LOWER}') AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
lab AS (SELECT doc_id, min(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS good FROM labels GROUP BY doc_id),
h0 AS (SELECT host, count(good)::DOUBLE AS n, coalesce(sum(good), 0)::DOUBLE AS good FROM p0 LEFT JOIN lab ON doc_id = page_id GROUP BY host),
tails AS (SELECT host, string_split(host, '.') AS l, unnest(range(1, len(string_split(host, '.')) + 1)) AS j FROM h0),
many AS (SELECT parent FROM (SELECT DISTINCT array_to_string(list_slice(l, -j, -1), '.') AS parent, l[len(l) - j] AS child FROM tails WHERE j > 1 AND j < len(l) AND length(host) <= {u.LONGEST_HOST})
         GROUP BY parent HAVING count(*) >= {u.MIN_CHILDREN}),
cut AS (SELECT host, coalesce(max(j) FILTER (WHERE j > 1 AND array_to_string(list_slice(l, -j, -1), '.') IN (SELECT parent FROM many)), 1) AS j FROM tails GROUP BY host),
h1 AS (SELECT h0.*, array_to_string(list_slice(string_split(host, '.'), -j, -1), '.') AS suffix,
              array_to_string(list_slice(string_split(host, '.'), -j - 1, -1), '.') AS domain FROM h0 JOIN cut USING (host)),
d1 AS (SELECT suffix, domain, sum(n) AS n, sum(good) AS good FROM h1 GROUP BY suffix, domain),
s1 AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM d1 GROUP BY suffix),
g AS (SELECT sum(n) AS n, sum(good) AS good, CASE WHEN sum(n) > 0 THEN sum(good) / sum(n) ELSE 0.5 END AS rate FROM s1),
{shrink("s", "s1", "g", "")}, {shrink("d", "d1", "s", "suffix")}, {shrink("h", "h1", "d", "suffix, domain")},
rep AS (SELECT host, least(1.0, rate + {u.Z} * sqrt(rate * (1 - rate) / (total + 1))) AS upper FROM h),
r AS (SELECT * FROM (VALUES {rules}) AS r(verdict, rh, rp)),
fit AS (SELECT page_id, max_by(rh || rp, length(rh || rp)) AS rule, max_by(verdict, length(rh || rp)) AS verdict
        FROM p0 JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT p0.page_id, p0.host, p0.path, fit.rule, coalesce(fit.verdict, CASE WHEN upper < {u.MIN_GOOD} THEN 'block' ELSE 'allow' END) AS verdict
FROM p0 LEFT JOIN rep USING (host) LEFT JOIN fit USING (page_id)
"""


_OP11 = f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{urlrep.UPPER}', '{urlrep.LOWER}') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS phrase
      FROM w, (VALUES (1), (2), (3)) AS k(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY lang, k, phrase HAVING count(*) >= {phrases.MIN_COUNT}),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cut AS (SELECT lang, phrase, k, a, w, unnest(range(1, k)) AS j FROM c),
s AS (SELECT cut.lang, cut.phrase, cut.k, cut.a, cut.j, l.a AS l, r.a AS r,
             (1000000::HUGEINT * cut.a * cut.a // (l.a::HUGEINT * r.a))::BIGINT AS score
      FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = array_to_string(cut.w[1:j], ' ')
               JOIN f r ON r.lang = cut.lang AND r.phrase = array_to_string(cut.w[j + 1:], ' ')),
low AS (SELECT lang, phrase, k, a, arg_min({{'l': l, 'r': r}}, score * 10 + j) AS lr, min(score) AS score FROM s GROUP BY lang, phrase, k, a),
up AS (SELECT lang, part, max(a) AS a FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part
       FROM c WHERE k = 3) GROUP BY lang, part),
kept AS (SELECT low.* FROM low LEFT JOIN up ON up.lang = low.lang AND up.part = low.phrase AND low.k = 2
         WHERE up.a IS NULL OR 100 * up.a < 50 * low.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, lr.l AS l, lr.r AS r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""

ORACLE = {"op1_mix": _OP1, "op3_warc": _OP3, "op4_line_dedup": _OP4, "op6_embeddings": _OP6, "op9_quality": _op9(),
          "op10_urls": _op10(), "op11_phrases": _OP11}
