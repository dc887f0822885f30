"""Quality rules: distribution divergence [DataFrame functions only].

A document's histogram of character classes and its histogram of common words
are compared with those of its language by the Jensen-Shannon distance. The
language references are sums over every document of the corpus that is long
enough to be compared; documents under the minimum length are never judged by
divergence. Two base rules (too few words, too much repeated wording) come
first.

Work per document happens inside the row (sorting its own word windows), so
nothing is shuffled but one partial histogram per task and language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridflow.session import land

from .common import WS, words_expr

# Frequent function words by language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "was", "on", "are", "as", "with", "be", "by",
           "this", "or", "an"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem",
           "nicht", "ein", "eine", "als"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "a", "par",
           "plus", "pas", "au"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su",
           "para", "es", "al"],
}
SYMBOLS = r"[#*$%&|<>]"
CODES = "bcdefghijklmnopqrstuvwxyz"     # one letter per common word, in list order

COUNTS = ["q_n_words", "q_word_chars", "q_n_symbols", "q_n_dup_lines", "q_n_repeat_words", "q_base_failed"]
HISTOGRAMS = ["q_chars", "q_common", "q_row"]
VERDICT = ["q_char_distance", "q_word_distance", "q_kept"]
N_CHARS, N_COMMON = 6, 21   # classes of the two histograms

MIN_WORDS = 50            # base rule: shorter documents fail
MAX_REPEAT_PCT = 50       # base rule: more repeated wording than this fails
MIN_COMPARE_WORDS = 50    # divergence is not measured on fewer words
MIN_COMMON_WORDS = 20     # nor on fewer common words than this would be expected
MAX_CHAR_DISTANCE = 0.18  # Jensen-Shannon distance (base 2, 0 to 1) of character classes
MAX_WORD_DISTANCE = 0.22  # of common-word shares
SAMPLING = 1.5            # both limits are raised by this over the number of words or common words


def _windows(words: Column) -> Column:
    """Hash of every 3-word window (64 bits; compared only inside a text)."""
    return F.when(F.size(words) >= 3, F.transform(
        F.sequence(F.lit(1), F.size(words) - 2),
        lambda i: F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2)))
    ).otherwise(F.array().cast("array<bigint>"))


def _repeated_starts(sorted_windows: Column) -> Column:
    """Sorted start positions of windows that occur twice or more;
    ``sorted_windows`` is a stored array of (hash, position), sorted."""
    n = F.size(sorted_windows)

    def repeated(x, j):
        before = F.when(j > 0, F.get(sorted_windows, j - 1)["h"] == x["h"]).otherwise(False)
        after = F.when(j < n - 1, F.get(sorted_windows, j + 1)["h"] == x["h"]).otherwise(False)
        return before | after
    return F.array_sort(F.transform(F.filter(sorted_windows, repeated), lambda x: x["i"]))


def _covered(starts: Column) -> Column:
    """Words under the union of 3-word windows at the sorted ``starts``."""
    zero = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(starts, zero, lambda a, p: F.struct(
        p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")))["n"]


def features(docs: DataFrame, text: str = "text", lang: str = "lang", min_words: int = MIN_WORDS,
             max_repeat_pct: int = MAX_REPEAT_PCT) -> DataFrame:
    """``docs`` with the base counts, the base verdict and both histograms.

    ``q_chars``: upper-case letters, digits, white space, symbols, other
    punctuation, the rest. ``q_common``: occurrences of each common word of
    the document's language (as listed or capitalised), then all other words.
    """
    own = [c for c in docs.columns if c.lower() not in COUNTS + HISTOGRAMS + VERDICT]
    body = F.coalesce(F.col(text), F.lit(""))
    lists = F.lit("")
    for k, v in COMMON_WORDS.items():   # "the,The,of,Of,...": position 2i-1 or 2i is word i
        lists = F.when(F.col(lang) == k, F.lit(",".join(x for w in v for x in (w, w.capitalize())))).otherwise(lists)
    d = docs.select(*own).withColumns({
        "__w": words_expr(F.col(text)),
        "__lines": F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        # what is left without plain lower case and white space: a few per cent of the text
        "__rest": F.regexp_replace(body, r"[a-z\x20\x09-\x0D]+", ""),
        "__list": lists, "__len": F.length(body)})
    d = d.withColumns({
        "q_n_words": F.size("__w").cast("long"),
        "q_word_chars": F.length(F.array_join("__w", "")).cast("long"),
        "q_n_symbols": F.regexp_count("__rest", F.lit(SYMBOLS)).cast("long"),
        "q_n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "__win": _windows(F.col("__w")),
        "__hits": F.filter(F.transform("__w", lambda w: F.find_in_set(w, F.col("__list"))), lambda i: i > 0),
        "__upper": F.regexp_count("__rest", F.lit(r"\p{Lu}")).cast("long"),
        "__digit": F.regexp_count("__rest", F.lit(r"\p{Nd}")).cast("long"),
        "__punct": F.regexp_count("__rest", F.lit(r"[\p{P}\p{S}]")).cast("long")})
    # only texts that repeat some window pay for the sort
    repeats = F.size(F.array_distinct("__win")) < F.size("__win")
    pairs = F.transform("__win", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    d = d.withColumns({
        "__sorted": F.when(repeats, F.array_sort(pairs)).otherwise(none),
        # one letter per common word, so that counting one is a length difference
        "__codes": F.array_join(F.transform("__hits", lambda i: F.substring(
            F.lit(CODES), ((i + 1) / 2).cast("int"), F.lit(1))), "")})
    d = d.withColumns({"__starts": _repeated_starts(F.col("__sorted")), "__ncodes": F.length("__codes")})
    d = d.withColumn("q_n_repeat_words", _covered(F.col("__starts")).cast("long"))
    spaces = F.col("__len") - F.col("q_word_chars")
    other = F.col("__punct") - F.col("q_n_symbols")
    per_word = [(F.col("__ncodes") - F.length(F.replace(F.col("__codes"), F.lit(c)))).cast("long")
                for c in CODES[:N_COMMON - 1]]
    d = d.withColumns({
        "q_base_failed": (F.col("q_n_words") < min_words)
        | (100 * F.col("q_n_repeat_words") > max_repeat_pct * F.col("q_n_words")),
        "q_chars": F.array(F.col("__upper"), F.col("__digit"), spaces, F.col("q_n_symbols"), other,
                           F.col("__len") - F.col("__upper") - F.col("__digit") - spaces - F.col("__punct")),
        "q_common": F.array(*per_word, F.col("q_n_words") - F.col("__ncodes")),
        # Filters on the counts also ask for this column, so that they stay above it:
        # pushed down, each layer of expressions would be copied into them several
        # times over, and planning would not end.
        "q_row": F.monotonically_increasing_id()})
    return d.select(*own, *COUNTS, *HISTOGRAMS)


def language_references(feats: DataFrame, lang: str = "lang", min_words: int = MIN_COMPARE_WORDS) -> DataFrame:
    """``__lang, __ref_chars, __ref_common``: class shares per language.

    Sums over every document that has ``min_words``, passes the base rules
    and is plain prose at first sight (symbols under 1 % and capitals under
    20 % of its characters), so that junk does not bend what it is compared
    with. Each task sends one partial row per language.
    """
    chars = [F.col("q_chars")[i] for i in range(N_CHARS)]
    length = sum(chars[1:], chars[0])
    d = feats.where((F.col("q_n_words") >= min_words) & ~F.col("q_base_failed")
                    & (F.col("q_n_symbols") * 100 < length) & (chars[0] * 5 < length) & (F.col("q_row") >= 0))
    sums = [F.sum(F.col("q_chars")[i]).alias(f"c{i}") for i in range(N_CHARS)]
    sums += [F.sum(F.col("q_common")[i]).alias(f"w{i}") for i in range(N_COMMON)]
    g = d.groupBy(F.coalesce(F.col(lang), F.lit("")).alias("__lang")).agg(*sums)

    def shares(prefix, n):
        total = sum((F.col(f"{prefix}{i}") for i in range(1, n)), F.col(f"{prefix}0"))
        return F.array(*[F.col(f"{prefix}{i}") / total for i in range(n)])
    return g.select("__lang", shares("c", N_CHARS).alias("__ref_chars"), shares("w", N_COMMON).alias("__ref_common"))


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two stored arrays of shares."""
    def half(a, b):   # one class's part of KL(a || (a+b)/2)
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    terms = F.zip_with(p, q, lambda a, b: half(a, b) + half(b, a))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2))


def verdicts(feats: DataFrame, refs: DataFrame, lang: str = "lang", min_compare_words: int = MIN_COMPARE_WORDS,
             min_common_words: int = MIN_COMMON_WORDS, max_char_distance: float = MAX_CHAR_DISTANCE,
             max_word_distance: float = MAX_WORD_DISTANCE, sampling: float = SAMPLING) -> DataFrame:
    """``feats`` with ``q_char_distance``, ``q_word_distance`` and ``q_kept``.

    ``refs`` has a row per language, landed by the caller, so Spark sees its
    size and chooses the join. A distance is null (and rejects nothing) where
    the text is under its minimum length. Sampling noise of a distance falls
    with the square root of the sample, so each limit is raised by
    ``sqrt(sampling / n)`` times itself, n being the words compared.
    """
    own = [c for c in feats.columns if c.lower() not in VERDICT + HISTOGRAMS]
    d = feats.withColumn("__lang", F.coalesce(F.col(lang), F.lit(""))).join(refs, "__lang", "left")
    n, length = F.col("q_n_words"), F.aggregate("q_chars", F.lit(0).cast("long"), lambda s, x: s + x)
    expected = n * (1 - F.col("__ref_common")[N_COMMON - 1])
    d = d.withColumns({"__p": F.transform("q_chars", lambda x: x / F.greatest(length, F.lit(1))),
                       "__w": F.transform("q_common", lambda x: x / F.greatest(n, F.lit(1))), "__e": expected})
    d = d.withColumns({
        "q_char_distance": F.when(n >= min_compare_words, _distance(F.col("__p"), F.col("__ref_chars"))),
        "q_word_distance": F.when((n >= min_compare_words) & (F.col("__e") >= min_common_words),
                                  _distance(F.col("__w"), F.col("__ref_common"))),
        "__row": F.monotonically_increasing_id()})   # see features
    far = [F.coalesce(F.col(c) > lim * (1 + F.sqrt(sampling / F.greatest(m.cast("double"), F.lit(1.0)))), F.lit(False)) for c, lim, m in (
        ("q_char_distance", max_char_distance, n), ("q_word_distance", max_word_distance, F.col("__e")))]
    kept = ~F.col("q_base_failed") & ~far[0] & ~far[1] & (F.col("__row") >= 0)
    return d.withColumn("q_kept", kept).select(*own, *VERDICT)


def judge_quality(docs: DataFrame, text: str = "text", lang: str = "lang", **limits) -> DataFrame:
    """Every row of ``docs`` with its base counts, distances and verdict.

    Adds the columns ``COUNTS`` and ``VERDICT`` (a clashing input column is
    replaced; all others are kept). Null text counts as empty, which the base
    rules fail. Null and unknown languages share one reference without common
    words, so only their character classes are compared. Rows are judged one
    by one, so repeated rows get equal verdicts; an empty table gives an
    empty result. The texts are read twice: for the references, then for the
    verdicts (see ``quality_report`` for one reading without texts).
    """
    refs = land(language_references(features(docs.select(text, lang), text, lang), lang), "quality-ref")
    return verdicts(features(docs, text, lang), refs, lang, **limits)


def quality_report(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
                   **limits) -> DataFrame:
    """``key``, counts and verdict of every row, reading the texts once: the
    counts and histograms are landed without them."""
    feats = land(features(docs.select(key, text, lang), text, lang).drop(text), "quality-feat")
    refs = land(language_references(feats, lang), "quality-ref")
    return verdicts(feats, refs, lang, **limits).drop(lang)
