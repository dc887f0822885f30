"""Toxicity by class-conditional Kneser-Ney models.

Toxic and ordinary training text are each modelled by interpolated Kneser-Ney
over the letters of their words. The two models share every lower order:
continuation counts come from both classes together, so that a rare expression
with little evidence of its own gets the same back-off probability in both,
and only what a class really has seen more often counts against it.

A word's evidence is the log ratio of its two likelihoods, smoothly floored at
a margin, so that only expressions clearly likelier in toxic text add up. A
document's evidence is the mean over its words (length-normalised); its score
is that mean on a scale from 0 to 1. (Without the floor, the plain difference of the two
length-normalised log likelihoods, which is returned as well, tells far less: ordinary words,
of which most of a toxic document consists, drown the few that are not.)

Margin and scale are fitted in every run, on training rows alone: a bounded share of them is kept out of a
first pair of models, which are then tried on it.

Training is two aggregates: words of labelled documents per class, then
letter grams of the distinct words. The model is a table of grams of six
letters, a few hundred thousand rows; its size is checked before it is sent to
the tasks, with all orders ready made. Scoring touches no other rows. In training, texts are joined with the
labels; they are shuffled for that only if the labels are too many to send.

A table too large to send stays in Spark: the grams of all distinct words are
joined with it order by order, and each document's word counts with the words'
evidence. The model is the same, letter for letter.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Sequence
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridflow.session import land, release

from .common import bounded_side

ORDER = 6                   # letters of the longest grams
BITS = 6                    # per letter class: grams of ORDER letters are ORDER * BITS bits
MAX_GRAMS = 4_000_000       # about 90 bytes each with all orders: what may be sent to the tasks; beyond it is joined
SMALL_ORDER = 3             # grams of so many letters are at most 2 ** 18: always sent
DISCOUNT = 0.75
MARGINS = (2.0, 3.0, 4.0, 5.0, 6.0, 7.0)   # log likelihood ratios from which a word may count as evidence
HELD_BACK = 6000            # distinct training texts, about, that margin and scale are fitted on (half of them at most)
DECISION = 0.7              # score of the fitted limit between the classes
UNFITTED = (4.0, 0.01)      # margin and scale where the texts held back are all of one class
EDGE = 0                    # letter class of word boundaries
SPLIT_SEED = 5

_LETTERS = re.compile(r"[^\W\d_]+")


def letter_classes(word: str) -> list[int]:
    """a-z are 1 to 26; all other letters share 27 to 63 by code point."""
    return [c - 96 if 97 <= c <= 122 else 27 + c % 37 for c in map(ord, word)]


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Grams of all words in a row, and the number of grams of each word. Every
    letter and the end of the word close a gram that reaches back ORDER - 1 letters."""
    codes, sizes = [], np.empty(len(words), np.int64)
    for i, w in enumerate(words):
        codes += [EDGE] * (ORDER - 1)
        c = letter_classes(w)
        codes += c
        codes.append(EDGE)
        sizes[i] = len(c) + 1
    a = np.array(codes, np.int64)
    g = np.zeros(max(0, len(a) - ORDER + 1), np.int64)
    for j in range(ORDER):
        g = (g << BITS) | a[j:j + len(g)]
    keep = np.ones(len(g), bool)      # drop grams that run over into the next word
    if len(words) > 1:
        starts = np.cumsum(sizes + ORDER - 1)[:-1]
        for k in range(1, ORDER):
            keep[starts - k] = False
    return g[keep], sizes


class Model:
    """Both classes' probabilities from one table of grams and class counts."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        """``grams`` ascending and distinct; ``counts``: (2, n), ordinary and toxic."""
        self.top = [self._order(grams, c) for c in counts]
        self.shared = []
        types, k = grams, ORDER - 1
        while k >= 1:
            # N1+(. g): distinct grams one letter longer that end in g
            low, n = np.unique(types & ((1 << BITS * k) - 1), return_counts=True)
            self.shared.append(self._order(low, n))
            types, k = low, k - 1
        self.shared.reverse()

    @staticmethod
    def _order(grams: np.ndarray, counts: np.ndarray):
        """Grams, discounted counts, then per context: total and freed mass."""
        seen = counts > 0
        g, c = grams[seen], counts[seen].astype(np.float64)
        ctx, first, types = np.unique(g >> BITS, return_index=True, return_counts=True)
        total = np.add.reduceat(c, first) if len(g) else c
        return g, np.maximum(c - DISCOUNT, 0), ctx, total, DISCOUNT * types

    @staticmethod
    def _interpolate(order, g: np.ndarray, below: np.ndarray) -> np.ndarray:
        grams, disc, ctx, total, freed = order
        if not len(grams):
            return below
        at = np.minimum(np.searchsorted(grams, g), len(grams) - 1)
        num = np.where(grams[at] == g, disc[at], 0.0)
        h = g >> BITS
        cat = np.minimum(np.searchsorted(ctx, h), len(ctx) - 1)
        known = ctx[cat] == h
        return np.where(known, (num + freed[cat] * below) / total[cat], below)

    def log_likelihoods(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihood of each word under the ordinary and the toxic model."""
        if not words:
            return np.zeros(0), np.zeros(0)
        g, sizes = _grams(words)
        g, at = np.unique(g, return_inverse=True)      # each gram once, and in order, which is how the tables lie
        p = np.full(len(g), 1.0 / (1 << BITS))
        for k, order in enumerate(self.shared, 1):
            p = self._interpolate(order, g & ((1 << BITS * k) - 1), p)
        ends = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        return tuple(np.add.reduceat(np.log(self._interpolate(t, g, p))[at], ends) for t in self.top)


COUNTS = ["ordinary", "toxic", "ordinary_back", "toxic_back"]


def training_words(marked: DataFrame, text: str, toxic: str, back: str) -> DataFrame:
    """``word`` and its ``COUNTS``: occurrences in training documents per class, those of texts
    held back apart. Rows whose ``toxic`` is null are no training documents."""
    def run(batches):
        n = [Counter() for _ in COUNTS]
        for b in batches:
            for t, y, h in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()):
                n[bool(y) + 2 * bool(h)].update(_LETTERS.findall((t.as_py() or "").lower()))
            if sum(map(len, n)) > 300_000:      # bounded memory; equal words meet later
                yield from _word_batches(n)
                n = [Counter() for _ in COUNTS]
        yield from _word_batches(n)
    part = marked.where(F.col(toxic).isNotNull()).select(text, toxic, back).mapInArrow(
        run, "word string, " + ", ".join(f"{c} long" for c in COUNTS))
    return part.groupBy("word").agg(*[F.sum(c).alias(c) for c in COUNTS])


def _word_batches(n):
    words = list(set().union(*n))
    for i in range(0, len(words), 50_000):
        w = words[i:i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(w)] + [pa.array([c[x] for x in w], pa.int64()) for c in n], ["word", *COUNTS])


def gram_table(words: DataFrame) -> DataFrame:
    """``gram`` and its ``COUNTS`` summed over the word table."""
    def run(batches):
        for b in batches:
            w = b.column(0).to_pylist()
            if not w:
                continue
            g, sizes = _grams(w)
            u, at = np.unique(g, return_inverse=True)
            sums = [np.bincount(at, np.repeat(b.column(c).to_numpy(), sizes), len(u)).astype(np.int64) for c in COUNTS]
            yield pa.RecordBatch.from_arrays([pa.array(u), *map(pa.array, sums)], ["gram", *COUNTS])
    return words.select("word", *COUNTS).mapInArrow(run, "gram long, " + ", ".join(f"{c} long" for c in COUNTS)).groupBy("gram").agg(
        *[F.sum(c).alias(c) for c in COUNTS])


def fit(grams: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A gram table as arrays, grams ascending: at most ``MAX_GRAMS`` rows."""
    t = grams.toArrow().sort_by("gram")
    return t["gram"].to_numpy(), np.stack([t["ordinary"].to_numpy(), t["toxic"].to_numpy()])


def _low(gram, letters: int):
    return gram.bitwiseAND(F.lit((1 << BITS * letters) - 1))


def _interpolated(d: DataFrame, order: DataFrame, letters: int, p: str, below: str) -> DataFrame:
    """``d`` with the probability ``p`` of its ``gram``'s last ``letters`` letters from
    ``order(g, c)``, as in ``Model``; ``below`` is the next lower order's."""
    side = F.broadcast if letters <= SMALL_ORDER else lambda x: x
    ctx = order.groupBy(F.shiftright("g", BITS).alias("__h")).agg(
        F.sum("c").alias("__total"), (DISCOUNT * F.count("*")).alias("__freed"))
    own = order.select(F.col("g").alias("__g"), F.greatest(F.col("c") - DISCOUNT, F.lit(0.0)).alias("__disc"))
    low = _low(F.col("gram"), letters)
    d = d.withColumns({"__low": low, "__ctx": F.shiftright(low, BITS)})
    d = d.join(side(own), F.col("__low") == F.col("__g"), "left").join(side(ctx), F.col("__ctx") == F.col("__h"), "left")
    value = (F.coalesce("__disc", F.lit(0.0)) + F.col("__freed") * F.col(below)) / F.col("__total")
    d = d.withColumn(p, F.when(F.col("__total").isNotNull(), value).otherwise(F.col(below)))
    return d.drop("__low", "__ctx", "__g", "__disc", "__h", "__total", "__freed")


def gram_likelihoods(grams: DataFrame, wanted: DataFrame) -> DataFrame:
    """``gram, ordinary, toxic``: log probabilities of the ``wanted(gram)`` (distinct) in
    both classes by the model of the gram table ``grams`` (landed), without gathering either."""
    shared, types = {}, grams.select(F.col("gram").alias("g"))
    for k in range(ORDER - 1, 0, -1):
        types = land(types.groupBy(_low(F.col("g"), k).alias("g")).agg(F.count("*").alias("c")), "tox-order")
        shared[k], types = types, types.select("g")
    d = wanted.select("gram", F.lit(1.0 / (1 << BITS)).alias("__p"))
    for k in range(1, ORDER):
        d = _interpolated(d, shared[k], k, "__p", "__p")
    for c in ("ordinary", "toxic"):
        d = _interpolated(d, grams.where(F.col(c) > 0).select(F.col("gram").alias("g"), F.col(c).alias("c")), ORDER, c, "__p")
    return d.select("gram", F.log("ordinary").alias("ordinary"), F.log("toxic").alias("toxic"))


def word_evidence(words: DataFrame, grams: DataFrame, margins: Sequence[float]) -> DataFrame:
    """``word, letters, ordinary, toxic, e0, e1, ...`` of the distinct ``words(word)``, joined with the gram table; a
    column of evidence for each margin."""
    def run(batches):
        for b in batches:
            w = b.column(0).to_pylist()
            for i in range(0, len(w), 10_000):
                part = w[i:i + 10_000]
                g, sizes = _grams(part)
                yield pa.RecordBatch.from_arrays([pa.array(part).take(pa.array(np.repeat(np.arange(len(part)), sizes))),
                                                  pa.array(g)], ["word", "gram"])
    parts = land(words.select("word").mapInArrow(run, "word string, gram long"), "tox-words")
    known = land(gram_likelihoods(grams, parts.select("gram").distinct()), "tox-likelihoods")
    d = parts.join(known, "gram").groupBy("word").agg(
        (F.count("*") - 1).alias("letters"), F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))
    d = land(d, "tox-words")
    release(parts, known)
    x = [F.col("toxic") - F.col("ordinary") - m for m in margins]
    return d.select("*", *[(F.greatest(v, F.lit(0.0)) + F.log1p(F.exp(-F.abs(v)))).alias(f"e{i}") for i, v in enumerate(x)])


def _sums(n: int) -> list[str]:
    """What is summed over the words of a text, for ``n`` margins."""
    return ["letters", "ordinary", "toxic", *[f"e{i}" for i in range(n)]]


def _joined_sums(docs: DataFrame, grams: DataFrame, key: str, text: str, margins: Sequence[float]) -> DataFrame:
    """``key, n_words`` and ``_sums`` of every row by a gram table that is not sent to the tasks: every row's distinct words
    with their counts meet the words' evidence in a join."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows, words, n = [], [], []
            for i, t in enumerate(b.column(2)):
                c = Counter(_LETTERS.findall((t.as_py() or "").lower())) or {None: 0}
                rows += [i] * len(c)
                words += c.keys()
                n += c.values()
                if len(rows) > 200_000 or i == len(b) - 1:
                    at = pa.array(rows, pa.int64())
                    yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(words, pa.string()),
                                                      pa.array(n, pa.int64())], ["__row", key, "__word", "__n"])
                    rows, words, n = [], [], []
    # row numbers hold from here on: the words are read twice
    d = land(docs.select(F.monotonically_increasing_id().alias("__row"), key, text).mapInArrow(
        run, f"__row long, `{key}` {kind}, __word string, __n long"), "tox-counts")
    known = word_evidence(d.where("__word is not null").select(F.col("__word").alias("word")).distinct(), grams, margins)
    known = land(known.select(*[F.col(c).alias(f"__{c}") for c in known.columns]), "tox-evidence")
    total = [F.coalesce(F.sum(F.col("__n") * F.col(f"__{c}")), F.lit(0.0)).alias(c) for c in _sums(len(margins))]
    return d.join(known, "__word", "left").groupBy("__row", key).agg(F.sum("__n").alias("n_words"), *total).drop("__row")


class Scorer:
    """Sums over the words of texts, keeping a bounded cache of what each word adds."""

    CACHE = 300_000
    WORDS = 1 << 18       # words summed at once

    def __init__(self, model: Model, margins: Sequence[float]):
        self.model, self.margins = model, np.array(margins)
        self._forget()

    def _forget(self):
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, 3 + len(self.margins)))

    def _learn(self, words: set[str]):
        new = list(words.difference(self.known))
        if not new:
            return
        if self.known and len(self.known) + len(new) > self.CACHE:
            self._forget()
            new = list(words)
        at, n = len(self.known), len(self.known) + len(new)
        if n > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((2 * n - len(self.table), self.table.shape[1]))])
        self.known.update(zip(new, range(at, n)))
        o, t = self.model.log_likelihoods(new)
        rows = self.table[at:n]
        rows[:, 0], rows[:, 1], rows[:, 2] = [len(w) for w in new], o, t
        rows[:, 3:] = np.logaddexp(0.0, (t - o)[:, None] - self.margins)

    def __call__(self, texts: Iterable[str]) -> np.ndarray:
        """Per text: words, letters, ordinary and toxic log likelihood, evidence for each margin."""
        out, found, held = [], [], 0
        for t in texts:
            found.append(_LETTERS.findall(t.lower()))
            held += len(found[-1])
            if held >= self.WORDS:
                out.append(self._add_up(found))
                found, held = [], 0
        return np.concatenate([*out, self._add_up(found)])

    def _add_up(self, found: list[list[str]]) -> np.ndarray:
        sizes = np.array([len(f) for f in found], np.int64)
        out = np.zeros((len(found), 1 + self.table.shape[1]))
        out[:, 0] = sizes
        row = np.repeat(np.arange(len(found)), sizes)
        words = chain.from_iterable(found)
        for i in range(0, len(row), self.WORDS):
            part = list(islice(words, self.WORDS))
            self._learn(set(part))
            at = np.fromiter(map(self.known.__getitem__, part), np.int64, len(part))
            own = row[i:i + self.WORDS]
            first = own[0]
            for j in range(self.table.shape[1]):
                s = np.bincount(own - first, self.table[at, j])
                out[first:first + len(s), 1 + j] += s
        return out


def _sent_sums(docs: DataFrame, model: Model, key: str, text: str, margins: Sequence[float]) -> DataFrame:
    """``key, n_words`` and ``_sums`` of every row by a model that is sent to the tasks."""
    shared = docs.sparkSession.sparkContext.broadcast(model)     # at most MAX_GRAMS grams
    names = _sums(len(margins))

    def run(batches):
        score = Scorer(shared.value, margins)
        for b in batches:
            if b.num_rows:
                v = score(t.as_py() or "" for t in b.column(1))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(v[:, 0].astype(np.int64)), *[pa.array(c) for c in v[:, 1:].T]],
                                                 [key, "n_words", *names])
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_words long, " + ", ".join(f"{c} double" for c in names))


def _text_sums(docs, grams, n_grams, key, text, margins):
    """Sums by the gram table ``grams(gram, ordinary, toxic)`` (landed) of ``n_grams`` rows."""
    if n_grams > MAX_GRAMS:
        return _joined_sums(docs, grams, key, text, margins)
    return _sent_sums(docs, Model(*fit(grams)), key, text, margins)


def fit_limit(evidence: np.ndarray, toxic: np.ndarray, margins: Sequence[float] = MARGINS,
              decision: float = DECISION) -> tuple[float, float]:
    """Margin and scale by the texts held back: the margin whose best limit has the largest F1, and the scale on which
    that limit (midway to the next text) scores ``decision``. ``evidence``: a row a text, a column a margin."""
    best = (0.0, UNFITTED)
    if not 0 < toxic.sum() < len(toxic):
        return UNFITTED
    for j, m in enumerate(margins):
        order = np.argsort(-evidence[:, j], kind="stable")
        e, hit = evidence[order, j], np.cumsum(toxic[order])
        f1 = 2 * hit / (np.arange(1, len(e) + 1) + toxic.sum())
        ends = np.append(e[1:] < e[:-1], True)                 # a limit lies between different values only
        i = int(np.where(ends, f1, 0).argmax())
        limit = math.sqrt(max(e[i], 1e-12) * max(e[i + 1] if i + 1 < len(e) else e[i] / 2, 1e-12))
        if f1[i] > best[0] + 1e-12:
            best = (float(f1[i]), (m, limit * (1 - decision) / decision))
    return best[1]


def score_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
                   half: float | None = None, margin: float | None = None) -> DataFrame:
    """``key, score, evidence, ordinary_ll, toxic_ll, n_words`` of every row of ``docs``.

    ``labels(key, toxic)``: 1 or 0 for training documents; a document with
    several labels is toxic if any says so. The scores see nothing but texts.
    ``score`` is evidence / (evidence + half); ``margin`` and ``half`` are fitted on training texts unless both are
    given. Empty and null texts score 0.
    Without toxic or without ordinary training text every score is 0. Equal
    texts score alike; an empty table gives an empty result.
    """
    lab = land(labels.groupBy(F.col(key).alias("__key")).agg(F.max("toxic").cast("int").alias("__toxic")), "tox-labels")
    span, n_labels = 1 << 30, lab.where("__toxic is not null").count()
    # which texts are held back depends on the text alone, so copies stay together
    back = F.pmod(F.xxhash64(F.lit(SPLIT_SEED), text), F.lit(span)) < min(span // 2, span * HELD_BACK // max(1, n_labels))
    # labels are given by hand or by a judge, a few bytes each; beyond 64 MiB both sides are shuffled
    marked = docs.select(key, text).join(bounded_side(lab, 24), F.col(key) == F.col("__key")).withColumn("__back", back)
    table = land(gram_table(training_words(marked, text, "__toxic", "__back")), "tox-grams")
    full = [F.col(c) + F.col(f"{c}_back") for c in ("ordinary", "toxic")]
    n, n_front, *seen = table.agg(F.count("*"), F.count_if(F.col("ordinary") + F.col("toxic") > 0), *map(F.sum, full)).first()
    none = F.lit(0.0)
    if not (n and all(x for x in seen)):
        return docs.select(key, none.alias("score"), none.alias("evidence"), none.alias("ordinary_ll"), none.alias("toxic_ll"),
                           F.lit(0).cast("long").alias("n_words"))
    if margin is None or half is None:
        margin, half = _fitted(marked, table, n_front, text)
    whole = land(table.select("gram", full[0].alias("ordinary"), full[1].alias("toxic")), "tox-grams")
    d = _text_sums(docs, whole, n, key, text, (margin,))
    release(lab, table)
    words, letters = F.greatest("n_words", F.lit(1)), F.greatest(F.col("letters") + F.col("n_words"), F.lit(1.0))
    e = F.col("e0") / words
    return d.select(key, (e / (e + half)).alias("score"), e.alias("evidence"), (F.col("ordinary") / letters).alias("ordinary_ll"),
                    (F.col("toxic") / letters).alias("toxic_ll"), "n_words")


def _fitted(marked: DataFrame, table: DataFrame, n_grams: int, text: str) -> tuple[float, float]:
    """Margin and scale: models of the training texts not held back, tried on each distinct text held back."""
    front = land(table.where(F.col("ordinary") + F.col("toxic") > 0).select("gram", "ordinary", "toxic"), "tox-front")
    both = front.agg(F.sum("ordinary"), F.sum("toxic")).first()
    if not all(both):
        return UNFITTED
    tried = marked.where(F.col("__back") & F.col("__toxic").isNotNull()).groupBy(F.xxhash64(text).alias("__h")).agg(
        F.first(text).alias(text), F.max("__toxic").alias("__y"))
    tried = land(tried.select(F.struct("__h", "__y").alias("__id"), text), "tox-tried")
    rows = _text_sums(tried, front, n_grams, "__id", text, MARGINS)
    words = F.greatest("n_words", F.lit(1))
    got = rows.select(F.col("__id.__h").alias("h"), F.col("__id.__y").alias("y"),
                      *[F.col(f"e{i}") / words for i in range(len(MARGINS))]).collect()      # about HELD_BACK rows
    release(front, tried)
    got.sort(key=lambda r: r["h"])
    if not got:
        return UNFITTED
    return fit_limit(np.array([r[2:] for r in got], float), np.array([r["y"] for r in got]))
