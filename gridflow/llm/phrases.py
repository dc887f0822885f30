"""Phrase collocations by Toivonen mining.

A sample of the documents proposes which words and pairs are frequent. One pass
over all documents then counts what was proposed, triples of proposed pairs, and the negative
border: all other words, and all other pairs of proposed words. Where something on the
border turns out frequent, neither it nor the longer phrases that contain it have been counted in full: an
expansion pass counts just those. It looks ahead to triples around every pair that may turn out frequent in it, so with three words
at most its own border is counted too, and nothing is left for a further one. So the counts of all frequent phrases are exact and
complete, whatever the sample held; a poor sample only makes the expansion larger.

A phrase that counts travels as text, so no two are ever taken for one. The border, by far the larger
part, travels as 64-bit hashes: the count of a hash is that of its phrase, or more if two phrases share it,
so one under the minimum rules its phrases out, and the others are counted anew as text.
What is proposed is sent to the tasks as a bit filter of bounded size, also hashed. A filter never forgets a phrase;
where it wrongly knows one, some more phrases are counted, which changes no result. A task counts the phrases of a
stretch of text by sorting word numbers, and sends each with its count.

Phrases of two and three words score by their weakest cut; the counts of both
parts come by joins in which words with a large share of all occurrences, which
are few, are sent to the tasks, so that none of them gathers in one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridflow.session import land, release

from .common import bounded_side, text_bytes

MIN_COUNT = 10
SAMPLE_SHARES = 4            # one document in so many is in the sample
SAMPLE_MIN = 2               # occurrences in the sample that propose a word or pair
BITS_EACH = 16               # filter bits per proposed phrase ...
MAX_FILTER_BITS = 1 << 27    # ... and a filter's largest size (16 MiB), whatever the input
STRETCH = 1 << 20            # words of a language that a task counts at once
HELD = 3 << 19               # distinct words and words not yet counted that a task holds
TEXT_PART = 1 << 21          # bytes of a text that are split at once
SHARES = 16                  # parts of a language that are ranked by themselves first
HASHED = -1                  # in place of a phrase's number of words: counted as a hash
HOT_SHARE = 1024             # phrases with 1 / HOT_SHARE of all occurrences: at most as many
UNKNOWN = "und"

# ends of pieces become line feeds, tabs blanks
_ENDS = bytes.maketrans(b".,;:!?\x0b\x0c\x0d\x09", b"\x0a" * 9 + b" ")
_SPLIT = re.compile(rb"[.,;:!?\x09-\x0d ]")
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


# ---- filters ----------------------------------------------------------------

def lang_seed(lang: bytes) -> int:
    return xxhash.xxh32_intdigest(lang)


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (first ^ (first >> np.uint64(29))) * _MIX[0] + second
        x = (x ^ (x >> np.uint64(32))) * _MIX[1]
        return x ^ (x >> np.uint64(29))


@dataclass
class Filter:
    """Bits at two places per hash; ``words`` is little-endian, 64 bits each."""

    words: np.ndarray

    @property
    def size(self) -> int:
        return 64 * len(self.words)

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64(self.size - 1)
        return h & mask, (h >> np.uint64(32)) & mask

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for p in self.places(h):
            out &= (self.words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def build_filter(hashes: DataFrame, least: Filter | None = None) -> Filter:
    """A filter of ``hashes(h)`` (landed), and of all that ``least`` knows.

    The driver gets its bits, a row per 64 of them: at most ``MAX_FILTER_BITS``,
    however many phrases there are.
    """
    if least is None:
        n = hashes.count()
        size = 1 << min(MAX_FILTER_BITS.bit_length() - 1, max(16, (BITS_EACH * n).bit_length()))
        words = np.zeros(size // 64, np.uint64)
    else:
        size, words = least.size, least.words.copy()

    def run(batches):
        own = Filter(np.zeros(size // 64, np.uint64))
        for b in batches:
            for p in own.places(b.column(0).to_numpy().view(np.uint64)):
                np.bitwise_or.at(own.words, (p >> np.uint64(6)).astype(np.int64), np.uint64(1) << (p & np.uint64(63)))
        at = np.flatnonzero(own.words)
        for i in range(0, len(at), 1 << 16):
            part = at[i:i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(own.words[part].view(np.int64))], ["at", "bits"])
    bits = hashes.select("h").mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    words[bits["at"].to_numpy()] |= bits["bits"].to_numpy().view(np.uint64)
    return Filter(words)


# ---- counting ---------------------------------------------------------------

@dataclass
class Wanted:
    """What a pass counts. ``words`` and ``pairs`` know what is taken for frequent.

    As text: words and pairs that they know, pairs with a word that ``words`` has come to know, triples of all these pairs; without
    what the filters ``before`` knew. As hashes, in a first pass: all other words, and all other pairs
    of words that are known. ``sample``: words, or pairs of known words, as hashes only.
    """

    words: Filter | None = None
    pairs: Filter | None = None
    words_before: Filter | None = None
    pairs_before: Filter | None = None
    sample: bool = False

    @property
    def first(self) -> bool:
        return not self.sample and self.words_before is None


class _Numbers(dict):
    """Numbers words as they come: from 1 on; 0 ends a piece, and what is between two blanks is no word."""

    def __init__(self):
        super().__init__({b"": -1, b"\x0a": 0})
        self.names = [b"\x0a"]

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.names)
        self.names.append(word)
        return n


class _Counter:
    """Counts the phrases of one language's texts, a stretch of words at a time.

    The last two words of a stretch
    are carried into the next, for phrases that run on.
    """

    def __init__(self, lang: bytes, wanted: Wanted):
        self.seed, self.wanted = lang_seed(lang), wanted
        self.parts: list[np.ndarray] = []
        self.pending = self.carried = self.total = 0
        self._renumber()

    def _renumber(self):
        self.number = _Numbers()
        self.names = self.number.names
        self.counts, self.hashes = np.zeros(64, np.int64), np.zeros(64, np.uint64)
        self.known, self.before, self.hashed = np.zeros(64, bool), np.zeros(64, bool), 1

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        ids = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        return ids[ids >= 0]

    def add(self, text: bytes) -> Iterator[tuple]:
        """One text; yields counted phrases (length, phrases, counts) when a stretch is full."""
        at = 0
        while at < len(text):
            end = min(len(text), at + TEXT_PART)
            if end < len(text):      # never inside a word
                cut = _SPLIT.search(text, end)
                end = cut.end() if cut else len(text)
            ids = self._numbers(text[at:end].lower().translate(_ENDS).replace(b"\x0a", b" \x0a ").split(b" "))
            self.parts.append(ids)
            self.pending += len(ids)
            at = end
            if self.pending >= STRETCH:
                yield from self._stretch()
        self.parts.append(np.zeros(1, np.int64))

    def _stretch(self) -> Iterator[tuple]:
        ids = np.concatenate([np.zeros(1, np.int64), *self.parts])
        carried, n = self.carried + 1, len(self.names)
        self._grow(n)
        self.counts[:n] += np.bincount(ids[carried:], minlength=n)
        if self.wanted.words is not None:
            yield from self._phrases(ids, carried)
        self.parts = [ids[-2:]]
        self.pending, self.carried = 0, len(self.parts[0])

    def finish(self) -> Iterator[tuple]:
        """What is left; the counter starts anew."""
        yield from self._stretch()
        n, w = len(self.names), self.wanted
        self.counts[0] = 0
        there = self.counts[:n] > 0
        if w.sample:
            if w.words is None:
                yield HASHED, self.hashes[:n][there], self.counts[:n][there]
        else:
            known = self.known[:n]
            at = np.flatnonzero(there & known & ~self.before[:n])
            yield 1, pa.array([self.names[i] for i in at.tolist()], pa.binary()), self.counts[at]
            if w.first:
                yield HASHED, self.hashes[:n][there & ~known], self.counts[:n][there & ~known]
                yield 0, pa.array([b""], pa.binary()), self.counts.sum(keepdims=True)
        self.parts, self.carried = [], 0
        self._renumber()

    def _grow(self, n: int):
        for name in ("counts", "hashes", "known", "before"):
            a = getattr(self, name)
            if len(a) < n:
                setattr(self, name, np.concatenate([a, np.zeros(2 * n - len(a), a.dtype)]))
        if n > self.hashed:
            at, w, seed = slice(self.hashed, n), self.wanted, self.seed
            digest = xxhash.xxh64_intdigest
            h = np.array([digest(x, seed) for x in self.names[at]], np.uint64)
            self.hashes[at], self.hashed = h, n
            if w.words is not None:
                self.known[at] = w.words.has(h)
            if w.words_before is not None:
                self.before[at] = w.words_before.has(h)

    def _phrases(self, ids: np.ndarray, carried: int) -> Iterator[tuple]:
        w = self.wanted
        known = self.known[ids]
        at = np.flatnonzero(known[:-1] & known[1:])            # pairs of known words
        h = pair_hash(self.hashes[ids[at]], self.hashes[ids[at + 1]])
        fresh = at + 1 >= carried                              # phrases that end in a carried word have been counted
        if w.sample:
            yield HASHED, *np.unique(h[fresh], return_counts=True)
            return
        known_pair = w.pairs.has(h)
        if w.first:
            was, count = np.zeros(len(at), bool), known_pair
            yield HASHED, *np.unique(h[fresh & ~known_pair], return_counts=True)
        else:
            before = self.before[ids]
            both = before[at] & before[at + 1]
            was = both & w.pairs_before.has(h)                 # counted as text, and so were triples of two such pairs
            count = ~both | (known_pair & ~was)
            known_pair |= ~both                                # any of them may turn out frequent: their triples at once
        yield from self._counted(ids, at[fresh & count], 2)
        good, old = np.zeros(len(ids) - 1, bool), np.zeros(len(ids) - 1, bool)
        good[at], old[at] = known_pair, was
        fresh = np.arange(2, len(ids)) >= carried
        at = np.flatnonzero(good[:-1] & good[1:] & fresh & ~(old[:-1] & old[1:]))
        yield from self._counted(ids, at, 3)

    def _counted(self, ids: np.ndarray, at: np.ndarray, length: int) -> Iterator[tuple]:
        if not len(at):
            return
        parts, key = [ids[at]], ids[at]
        for k in range(1, length):       # number the phrases so far, add a word, number again
            if k > 1:
                key = np.unique(key, return_inverse=True)[1]
            parts.append(ids[at + k])
            key = (key << 32) | parts[-1]
        _, first, n = np.unique(key, return_index=True, return_counts=True)
        used, where = np.unique(np.concatenate([p[first] for p in parts]), return_inverse=True)
        words = pa.array([self.names[i] for i in used.tolist()], pa.binary())
        columns = [words.take(pa.array(w)) for w in where.reshape(length, -1)]
        yield length, pc.binary_join_element_wise(*columns, b" "), n


def count_phrases(docs: DataFrame, wanted: Wanted) -> DataFrame:
    """``lang, words, phrase, h, n`` of ``docs(lang, text)``, summed over all texts. What is counted as hashes has
    ``h`` and nothing else; a first pass has a row with ``words = 0`` for all word occurrences of a language."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)      # at most four filters of bounded size

    def run(batches):
        counters: dict[str, _Counter] = {}
        held = 0

        def rows(lang, found):
            for length, phrases, n in found:
                for i in range(0, len(n), 1 << 16):
                    part, many = phrases[i:i + (1 << 16)], pa.array(n[i:i + (1 << 16)].astype(np.int64))
                    if length == HASHED:
                        none = pa.nulls(len(part), pa.string())
                        columns = [none, pa.nulls(len(part), pa.int32()), none, pa.array(part.view(np.int64)), many]
                    else:
                        columns = [pa.array([lang], pa.string()).take(pa.array(np.zeros(len(part), np.int64))),
                                   pa.array(np.full(len(part), length, np.int32)), part.cast(pa.string()), pa.nulls(len(part), pa.int64()), many]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "words", "phrase", "h", "n"])

        def all_rows():
            for lang, c in counters.items():
                yield from rows(lang, c.finish())
            counters.clear()
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), text_bytes(b.column(1))):
                if lang not in counters:
                    counters[lang] = _Counter(lang.encode(), shared.value)
                c = counters[lang]
                held -= len(c.names) + c.pending
                yield from rows(lang, c.add(text))
                held += len(c.names) + c.pending + 1
                if held > HELD:          # bounded memory; equal phrases meet in the sum
                    yield from all_rows()
                    held = 0
        yield from all_rows()
    d = docs.mapInArrow(run, "lang string, words int, phrase string, h long, n long")
    keys = ["h"] if wanted.sample else ["lang", "words", "phrase", "h"]
    return d.groupBy(*keys).agg(F.sum("n").alias("n"))


# ---- mining -----------------------------------------------------------------

def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, sample_shares: int = SAMPLE_SHARES,
                     sample_min: int = SAMPLE_MIN) -> tuple[DataFrame, DataFrame, int]:
    """All phrases of one to three words with ``min_count`` occurrences in ``docs(lang, text)``.

    Returns ``lang, words, phrase, n`` and ``lang, n`` (all word occurrences), both from landed
    tables, and the number of passes over all documents.
    """
    chosen = docs.where(F.pmod(F.xxhash64("text"), F.lit(sample_shares)) == 0)
    proposed = land(count_phrases(chosen, Wanted(sample=True)).where(F.col("n") >= sample_min), "phrase-words")
    words = build_filter(proposed)
    release(proposed)
    proposed = land(count_phrases(chosen, Wanted(words, sample=True)).where(F.col("n") >= sample_min), "phrase-pairs")
    pairs = build_filter(proposed)
    release(proposed)

    counted = land(count_phrases(docs, Wanted(words, pairs)).where((F.col("words") == 0) | (F.col("n") >= min_count)),
                   "phrase-frequent")
    totals = counted.where("words = 0").select("lang", "n")
    frequent = counted.where("words > 0").select("lang", "words", "phrase", "n")
    failed, passes = counted.where("h is not null").select("h"), 1       # the border: what it has that is frequent
    if not failed.isEmpty():
        # words and pairs are told apart by nothing but their hash, so both filters learn all of them
        wanted = Wanted(build_filter(failed, words), build_filter(failed, pairs), words, pairs)
        new = land(count_phrases(docs, wanted).where(F.col("n") >= min_count).select("lang", "words", "phrase", "n"), "phrase-frequent")
        frequent, passes = frequent.unionByName(new), 2
    return frequent, totals, passes


def _with_part(d: DataFrame, frequent: DataFrame, hot: DataFrame, part: str, out: str) -> DataFrame:
    """``d`` with the count ``out`` of its phrase ``part``: from ``hot`` where it is there."""
    h = hot.select(F.col("lang").alias("__hl"), F.col("phrase").alias("__hp"), F.col("n").alias("__hot"))
    d = d.join(F.broadcast(h), (F.col("lang") == F.col("__hl")) & (F.col(part) == F.col("__hp")), "left").drop("__hl", "__hp")
    f = frequent.select(F.col("lang").alias("__fl"), F.col("phrase").alias("__fp"), F.col("n").alias(out))
    rest = d.where(F.col("__hot").isNull()).drop("__hot").join(
        f, (F.col("lang") == F.col("__fl")) & (F.col(part) == F.col("__fp"))).drop("__fl", "__fp")
    return rest.unionByName(d.where(F.col("__hot").isNotNull()).withColumnRenamed("__hot", out))


def score_phrases(frequent: DataFrame, min_superior_pct: int = 50) -> DataFrame:
    """``lang, words, phrase, a, l, r, score`` of the phrases of two and three words that
    no longer one with ``min_superior_pct`` per cent of their occurrences contains.

    ``frequent`` holds every part of every phrase it holds (as mining leaves it).
    Score: floor(1000000 a² / (l r)) of the cut where that is least, exact in 38 digits.
    """
    n = frequent.where("words = 1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # occurrences of words, and of pairs, sum to n at most: no more than HOT_SHARE of each are as frequent
    hot = frequent.where((F.col("words") < 3) & (F.col("n") * HOT_SHARE >= n))
    d = frequent.where("words > 1").withColumnRenamed("n", "a")
    w = F.split("phrase", " ")
    two = d.where("words = 2").select("lang", "words", "phrase", "a", F.lit(1).alias("k"), w[0].alias("x"), w[1].alias("y"))
    three = d.where("words = 3").select("lang", "words", "phrase", "a", F.explode(F.array(F.lit(1), F.lit(2))).alias("k"), w.alias("w"))
    three = three.select("lang", "words", "phrase", "a", "k",
                         F.when(F.col("k") == 1, F.col("w")[0]).otherwise(F.concat_ws(" ", F.col("w")[0], F.col("w")[1])).alias("x"),
                         F.when(F.col("k") == 2, F.col("w")[2]).otherwise(F.concat_ws(" ", F.col("w")[1], F.col("w")[2])).alias("y"))
    cuts = two.unionByName(three)
    cuts = _with_part(_with_part(cuts, frequent.where("words < 3"), hot, "x", "l"), frequent.where("words < 3"), hot, "y", "r")
    big = lambda c: F.col(c).cast("decimal(12,0)")
    cuts = cuts.withColumns({"__top": F.lit(1_000_000).cast("decimal(7,0)") * (big("a") * big("a")), "__low": big("l") * big("r")})
    cuts = cuts.withColumn("score", F.expr("__top div __low"))
    # superiors: the largest count of a triple around each pair
    around = three.select("lang", F.when(F.col("k") == 1, F.col("y")).otherwise(F.col("x")).alias("phrase"),
                          F.lit(2).alias("words"), F.lit(None).cast("long").alias("a"), F.col("a").alias("up"),
                          F.lit(None).cast("struct<score:bigint,k:int,l:bigint,r:bigint>").alias("cut"))
    own = cuts.select("lang", "phrase", "words", "a", F.lit(None).cast("long").alias("up"),
                      F.struct("score", "k", "l", "r").alias("cut"))
    g = own.unionByName(around).groupBy("lang", "words", "phrase").agg(
        F.max("a").alias("a"), F.max("up").alias("up"), F.min("cut").alias("cut"))
    g = g.where(F.col("up").isNull() | (100 * F.col("up") < min_superior_pct * F.col("a")))
    return g.select("lang", "words", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))


def mine_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, top: int | None = 2000,
                 min_superior_pct: int = 50) -> DataFrame:
    """The phrases of two and three words with ``min_count`` occurrences, by language.

    Texts are lower-cased (A-Z), cut into pieces at ``. , ; : ! ?`` and line ends, and
    pieces into words at blanks and tabs; phrases lie inside a piece and overlaps count.
    Returns ``lang, rank, phrase, a, l, r, n, score``: occurrences of the phrase, of the
    two parts of its weakest cut, of all words of the language; the ``top`` phrases of each language (None: all, without order of the rest).

    A null language is ``und``, together with rows that say so. Null and empty
    texts hold no words. Repeated rows count each. Equal scores are ordered by count and
    then by phrase, so ranks are unique; an empty table gives an empty result.
    """
    d = docs.select(F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("lang"), F.col(text).alias("text")).where("text is not null")
    frequent, totals, _ = frequent_phrases(d, min_count)
    s = score_phrases(frequent, min_superior_pct)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:      # the best of each share first, so that the best of a language come from a bounded number of rows
        share = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SHARES))).orderBy(*order)
        s = s.withColumn("__r", F.row_number().over(share)).where(F.col("__r") <= top).drop("__r")
    best = s.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    if top is not None:
        best = best.where(F.col("rank") <= top)
    t = land(totals.select(F.col("n").alias("__n"), F.col("lang").alias("__lang")), "phrase-totals")
    return best.join(bounded_side(t, 64), F.col("lang") == F.col("__lang")).select(
        "lang", "rank", "phrase", "a", "l", "r", F.col("__n").alias("n"), "score")
