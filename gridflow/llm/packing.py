"""Best-fit packing with swap-based local search.

Only lengths decide a packing, and there are at most ``capacity`` different
ones. So the packing is made on a histogram of piece lengths: bins with equal
content are one class with a multiplicity, whatever the number of documents.
Pieces are placed best-fit by descending length; local search then moves,
exchanges one for one and exchanges two for one between underfull classes
wherever that increases the sum of squared fills, as long as that empties bins. The resulting slots (length, rank range, first sequence,
offset) are handed to the tasks, and every piece finds its place by its rank
among the pieces of its length, which is counted in salted groups.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridflow.session import land

CAPACITY = 2048


# Words of these letters alone are one token run for the vocabulary's splitting rule,
# stay as they are under its normal form, and need only its merges.
_PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself
    if printable Latin-1, else the next one from 256 up."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Tokens(dict):
    """Ids of whole texts, word by word: white space parts tokens and is
    dropped by the vocabulary's own splitting, so the ids of a text are those of its
    ASCII-white-space-separated words in a row. The dictionary keeps words'
    ids (little-endian 32-bit) up to ``CACHE`` words.
    """

    CACHE = 700_000

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.merges, self.letters = self.tokenizer.model, _byte_letters()

    def __missing__(self, word: bytes) -> bytes:
        body, mark = word, b""
        if word[-1:] in (b".", b",") and word[-2:-1].isalpha():   # a mark after a letter is a token run of its own
            body, mark = word[:-1], word[-1:]
        text = body.decode("utf-8", "replace")
        low = text.lower() if text.isascii() or max(text) < "\u0100" else text
        if _PLAIN.fullmatch(low):
            run = low if low.isascii() else "".join(map(self.letters.__getitem__, low.encode()))
            ids = [t.id for t in self.merges.tokenize(run)]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        out = np.array(ids, "<u4").tobytes() + (self[mark] if mark else b"")
        self[word] = out
        return out

    def packed(self, text: bytes) -> bytes:
        """Little-endian 32-bit ids of a text."""
        if len(self) > self.CACHE:
            self.clear()
        # the vocabulary lower-cases; special strings, which it would not, are left alone
        words = (text if b"<|" in text else text.lower()).split()
        return b"".join(map(self.__getitem__, words))


_LOADED: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    if path not in _LOADED:
        _LOADED[path] = Tokens(path)
    return _LOADED[path]


def pieces(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
           end_id: int = 0) -> DataFrame:
    """``key, piece, start, length, ids_crc32`` of every document: its ids and
    ``end_id``, cut into ``capacity`` ids where longer. ``vocabulary`` is the
    path of a tokenizer file on every machine."""
    import os
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tok = tokens(vocabulary)
        for b in batches:
            k, n, s, size, crc = [], [], [], [], []
            for i, t in enumerate(b.column(1)):
                ids = tok.packed((t.as_py() or "").encode()) + tail
                for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    k.append(i), n.append(p), s.append(at // 4), size.append(len(part) // 4), crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(k, pa.int64())), pa.array(n, pa.int32()), pa.array(s, pa.int64()),
                 pa.array(size, pa.int64()), pa.array(crc, pa.int64())], [key, "piece", "start", "length", "ids_crc32"])
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(
        run, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long")


# ---- packing the histogram ------------------------------------------------

Bin = tuple[int, ...]   # lengths in a bin, descending


def best_fit(histogram: dict[int, int], capacity: int) -> Counter:
    """Best-fit decreasing over classes of equal bins: content -> number."""
    by_gap: dict[int, Counter] = {capacity: Counter()}   # gap -> contents
    gaps: list[int] = []                                  # open gaps, ascending
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            at = bisect_left(gaps, size)
            if at == len(gaps):        # new bins, as many full of this length as there are
                per = capacity // size
                for each, bins in ((per, left // per), (left % per, 1 if left % per else 0)):
                    if bins:
                        _put(by_gap, gaps, (size,) * each, capacity - size * each, bins)
                break
            gap = gaps[at]
            content, bins = by_gap[gap].popitem()
            each = min(gap // size, left)
            use = min(bins, left // each)
            if use < bins:
                by_gap[gap][content] = bins - use
            elif not by_gap[gap]:
                gaps.pop(at)
            left -= use * each
            _put(by_gap, gaps, content + (size,) * each, gap - size * each, use)
    out: Counter = Counter()
    for contents in by_gap.values():
        out.update(contents)
    return out


def _put(by_gap, gaps, content, gap, bins):
    there = by_gap.setdefault(gap, Counter())
    if not there and gap:
        insort(gaps, gap)
    there[content] += bins


def lower_bound(histogram: dict[int, int], capacity: int) -> int:
    """Bins that no packing goes below: for each size ``k`` up to half the capacity,
    pieces over ``capacity - k`` share with none of ``k`` or more, other pieces over half
    the capacity take a bin each, and pieces from ``k`` up must fit what those leave."""
    n = np.zeros(capacity + 1, np.int64)
    for size, many in histogram.items():
        n[size] += many
    if not n.any():
        return 0
    weight, half = n * np.arange(capacity + 1), capacity // 2
    many, total = np.cumsum(n), np.cumsum(weight)
    k = np.arange(half + 1)
    below = np.where(k > 0, total[np.maximum(k, 1) - 1], 0)                 # tokens in pieces smaller than k
    top = np.maximum(capacity - k, half)
    large, small = total[top] - total[half], total[half] - below            # those over half that may share; small ones
    bins = many[capacity] - many[half]
    room = (many[top] - many[half]) * capacity - large
    return int((bins + np.maximum(0, -(-(small - room) // capacity))).max())


def _sums_of_two(b: Bin) -> dict[int, tuple[int, int]]:
    """Sum -> two pieces of the bin that make it."""
    ones = sorted(Counter(b).items())
    return ({2 * p: (p, p) for p, n in ones if n > 1}
            | {p + q: (p, q) for i, (p, _) in enumerate(ones) for q, _ in ones[i + 1:]})


class _Offers:
    """What underfull bins take: a row (bin class, kind, pieces given back, gap, fill, bins)
    for a move, for each of its sizes and for each sum of two of them. Rows of
    classes that are gone get a negative gap; the table is packed when half of it is gone."""

    MOVE, ONE, TWO = 0, 1, 2

    def __init__(self, capacity: int):
        self.capacity, self.rows, self.used, self.dead = capacity, np.zeros((1024, 6), np.int64), 0, 0
        self.place: dict[Bin, tuple[int, int]] = {}
        self.names: list[Bin] = []

    def put(self, b: Bin, bins: int) -> None:
        """Class ``b`` has so many bins now."""
        fill = sum(b)
        if fill >= self.capacity:
            return
        if not bins:
            return self._drop(b)
        if b in self.place:
            i, j = self.place[b]
            self.rows[i:j, 5] = bins
            return
        ones = sorted(set(b))
        twos = sorted(_sums_of_two(b))
        back = [(self.MOVE, 0), *((self.ONE, y) for y in ones), *((self.TWO, y) for y in twos)]
        while self.used + len(back) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        at = slice(self.used, self.used + len(back))
        self.rows[at, 1:3] = back
        self.rows[at, 0], self.rows[at, 3], self.rows[at, 4], self.rows[at, 5] = len(self.names), self.capacity - fill, fill, bins
        self.names.append(b)
        self.place[b] = (at.start, at.stop)
        self.used = at.stop

    def _drop(self, b: Bin) -> None:
        i, j = self.place.pop(b)
        self.rows[i:j, 3] = -1 - self.capacity
        self.dead += j - i
        if 2 * self.dead > self.used > 4096:
            left = [(n, int(self.rows[i, 5])) for n, (i, _) in self.place.items()]
            self.rows, self.used, self.dead, self.place, self.names = np.zeros_like(self.rows), 0, 0, {}, []
            for n, bins in left:
                self.put(n, bins)

    def best(self, a: Bin, m: int = 1):
        """The exchange of ``m`` bins ``a`` with as many partners that raises the sum of squares
        most: (partner, sizes given, sum of sizes taken back, kind), or None."""
        r = self.rows[:self.used]
        kind, y, gap, fill, many = r[:, 1], r[:, 2], r[:, 3], r[:, 4], np.minimum(r[:, 5], m)
        fa = sum(a)
        pairs = _sums_of_two(a)
        found, most = None, 0
        for sums, give, which in ((sorted(set(a)), None, None), (sorted(pairs), pairs, np.flatnonzero(kind == self.ONE))):
            if not sums:
                continue
            x = np.array([-self.capacity, *sums], np.int64)
            yy, gg, ff, nn = (y, gap, fill, many) if which is None else (y[which], gap[which], fill[which], many[which])
            d = x[np.searchsorted(x, gg + yy, side="right") - 1] - yy       # the largest that fits, less what comes back
            gain = np.where((d > 0) & (gg > 0), nn * d * (ff - fa + d), 0)
            if not len(gain):
                continue
            i = int(gain.argmax())
            if gain[i] > most:
                most, row = int(gain[i]), r[i if which is None else which[i]]
                out = int(d[i] + yy[i])
                found = (self.names[row[0]], (out,) if give is None else give[out], int(row[2]), int(row[1]))
        return found


def _exchanged(a: Bin, b: Bin, out: tuple[int, ...], back: int, kind: int) -> tuple[Bin, Bin]:
    """Contents of both bins after ``a`` gives ``out`` and takes ``back``."""
    new_a, new_b = list(a), list(b)
    for s in out:
        new_a.remove(s)
        new_b.append(s)
    taken = _sums_of_two(b)[back] if kind == _Offers.TWO else (back,) if kind == _Offers.ONE else ()
    for s in taken:
        new_b.remove(s)
        new_a.append(s)
    return tuple(sorted(new_a, reverse=True)), tuple(sorted(new_b, reverse=True))


def local_search(bins: Counter, capacity: int) -> Counter:
    """Move, one-for-one and two-for-one exchanges between underfull bins, until bins empty out.

    Underfull bins take turns as donors, the emptiest first. A donor gives its
    pieces to other underfull bins, each time by the exchanges that raise the sum of
    squared fills most, until it is empty or nothing raises the sum: every
    exchange leaves it smaller, so a turn has at most as many exchanges as the donor has
    tokens. Equal bins go through a turn together, as many as may still vanish. Rounds
    of turns repeat as long as one of them has emptied a bin, and end at the
    lower bound at the latest; so there are no more rounds than bins above it.
    """
    bins = Counter({b: n for b, n in bins.items() if n > 0 and b})
    sizes: Counter = Counter()
    for b, n in bins.items():
        for s in b:
            sizes[s] += n
    spare = sum(bins.values()) - lower_bound(sizes, capacity)
    offers = _Offers(capacity)
    for b, n in bins.items():
        offers.put(b, n)

    def change(b: Bin, n: int) -> None:
        if not b or not n:
            return
        bins[b] += n
        offers.put(b, bins[b])
        if not bins[b]:
            del bins[b]

    emptied = True
    while emptied and spare > 0:
        emptied = False
        for a in sorted((b for b in bins if sum(b) < capacity), key=lambda b: (sum(b), b)):
            if bins[a] <= 0 or spare <= 0:
                continue
            m = min(spare, max(1, bins[a] // 2))
            change(a, -m)                              # a donor is no partner of its own
            while a:
                step = offers.best(a, m)
                if step is None:
                    break
                b, out, back, kind = step
                n = min(m, bins[b])
                new_a, new_b = _exchanged(a, b, out, back, kind)
                change(b, -n)
                change(a, m - n)                       # those without a partner stay as they are
                change(new_b, n)
                a, m = new_a, n
            if a:
                change(a, m)
            else:
                spare, emptied = spare - m, True
    return bins


def slots(bins: Counter) -> np.ndarray:
    """Rows (length, first rank, first sequence, bins, offset): the pieces of a
    length, in order of rank, fill slot after slot; rank - first rank counts the bins of a slot."""
    rows, rank, first = [], Counter(), 0
    for content, n in sorted(bins.items(), reverse=True):
        at = 0
        for size in content:
            rows.append((size, rank[size], first, n, at))
            rank[size] += n
            at += size
        first += n
    rows.sort()
    return np.array(rows, np.int64).reshape(-1, 5)


def pack(pieces_df: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces_df`` (landed, with ``length`` from 1 to ``capacity``) plus
    ``sequence_id`` and ``offset``. Sequences are gapless from offset 0. Which of
    two pieces of one length goes where is arbitrary."""
    # rank among equal lengths: salted groups, so that a hot length is many groups
    salts = max(1, pieces_df.count() // 4096)
    d = pieces_df.withColumn("__salt", F.pmod(F.xxhash64(*pieces_df.columns[:3]), F.lit(salts)))
    groups = land(d.groupBy("length", "__salt").agg(F.count("*").alias("n")), "pack-groups")
    histogram = {int(r[0]): int(r[1]) for r in groups.groupBy("length").agg(F.sum("n")).collect()}  # capacity rows
    table = slots(local_search(best_fit(histogram, capacity), capacity))
    w = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    before = groups.select("length", "__salt", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("__before"))
    ranked = d.withColumn("__r", F.row_number().over(
        Window.partitionBy("length", "__salt").orderBy(*[c for c in pieces_df.columns if c != "length"])))
    ranked = ranked.join(before, ["length", "__salt"]).withColumn("__rank", F.col("__before") + F.col("__r") - 1)
    shared = pieces_df.sparkSession.sparkContext.broadcast(table)   # its size is bounded by capacity, not by the input

    def place(batches):
        t = shared.value
        span = np.int64(1) << 44
        starts = t[:, 0] * span + t[:, 1]
        for b in batches:
            if not b.num_rows:
                continue
            size = b.column(b.schema.get_field_index("length")).to_numpy()
            rank = b.column(b.schema.get_field_index("__rank")).to_numpy()
            at = np.searchsorted(starts, size * span + rank, side="right") - 1
            rows = t[at]
            names = [n for n in b.schema.names if n != "__rank"]
            yield pa.RecordBatch.from_arrays(
                [b.column(b.schema.get_field_index(n)) for n in names]
                + [pa.array(rows[:, 2] + rank - rows[:, 1]), pa.array(rows[:, 4])], [*names, "sequence_id", "offset"])
    own = ranked.select(*pieces_df.columns, "__rank")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces_df.schema)
    return own.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text",
                   capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Every document's pieces with their places: ``key, piece, start, length,
    ids_crc32, sequence_id, offset``.

    Null texts are empty: one piece with the end id. Rows that repeat a key
    are packed each for itself; an empty table gives an empty result.
    """
    return pack(land(pieces(docs, vocabulary, key, text, capacity, end_id), "pack-pieces"), capacity)
