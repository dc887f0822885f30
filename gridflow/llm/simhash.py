"""SimHash near-dedup with pivot distance tables.

Fingerprints are 64 majority bits over the hashes of word shingles. Pairs
within a few bits are found among the distinct fingerprints:

* Blocking. The 64 bits are cut into blocks; fingerprints within ``radius``
  bits agree on all but ``radius`` of them, so some choice of the other blocks
  is equal. Each choice is a table of cells; the number of blocks grows with
  the number of fingerprints, so that cells stay small.
* Pivot tables. Inside a cell the Hamming distances of all fingerprints to many
  reference fingerprints (pivots) are computed once. By the triangle
  inequality two fingerprints within ``radius`` differ by no more than
  ``radius`` in any coordinate. The cell is sorted by the first coordinate,
  only neighbours within ``radius`` are paired, and the largest difference
  over the other coordinates discards nearly all of them.
* Survivors are verified bit by bit.

Cells over ``cell_rows`` are cut into chunks and every two chunks meet in a
task of their own, so that no near-copy group lands in one task. A cell gives
a spanning forest of its links, not all pairs. No pair within the radius is
lost: blocking and pivots are both exact.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridflow.session import land, release

from .components import components

SHINGLE, RADIUS = 4, 4
PIVOTS = 24
CELL_ROWS = 1024     # larger cells are cut up
EXPECTED = 256       # fingerprints in a cell of unrelated texts that blocking aims at
HASH_SEED = 42


# ---- fingerprints -----------------------------------------------------------

def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of every run of ``size`` words (A-Z lower-cased, space-joined), repeats included."""
    words = text.lower().split()          # bytes.lower changes A-Z only
    if not words:
        return np.empty(0, np.uint64)
    body = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(body, HASH_SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-size]]).tolist()
    ends = (ends[size - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(body[s:e], HASH_SEED) for s, e in zip(starts, ends)), np.uint64, len(ends))


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half the hashes (none: 0)."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i:i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``key, fp`` (long: the 64 bits) of every row; null texts are empty, whose fingerprint is 0."""
    def run(batches):
        for b in batches:
            fp = [majority(shingle_hashes((t.as_py() or "").encode(), shingle)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fp, np.uint64).view(np.int64))], [key, "fp"])
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, fp long")


# ---- links ------------------------------------------------------------------

def block_masks(n: int, radius: int, expected: int = EXPECTED) -> list[int]:
    """Bit masks whose equal values hold every pair within ``radius``: the fewest
    blocks for which ``n`` random fingerprints leave ``expected`` in a cell."""
    blocks = radius + 1
    while blocks < 2 * radius + 2 and n >> (64 * (blocks - radius) // blocks) > expected:
        blocks += 1
    edges = [64 * i // blocks for i in range(blocks + 1)]
    part = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(part, blocks - radius)]


def pivots(n: int = PIVOTS, seed: int = 7) -> np.ndarray:
    """Reference fingerprints: fixed random ones, the same in every task."""
    return np.random.default_rng(seed).integers(0, 1 << 64, n, np.uint64)


def links_within(fps: np.ndarray, radius: int, refs: np.ndarray, group: np.ndarray | None = None,
                 pairs_at_once: int = 1 << 21):
    """Index pairs (i, j) within ``radius`` bits, in parts, through a pivot table.

    ``group``: only pairs of one group are asked for."""
    if group is None:
        group = np.zeros(len(fps), np.int64)
    table = np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int16)
    order = np.lexsort((table[:, 0], group))
    fps, table = fps[order], table[order]
    at = group[order].astype(np.int64) * 256 + table[:, 0]
    hi = np.searchsorted(at, at + radius, side="right")     # candidates: i+1 .. hi-1
    n = hi - np.arange(len(at)) - 1
    ends = np.cumsum(n)
    first = 0
    while first < len(at):
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + pairs_at_once, side="right")))
        i = np.repeat(np.arange(first, last), n[first:last])
        j = i + 1 + np.arange(len(i)) - np.repeat(ends[first:last] - n[first:last] - base, n[first:last])
        for p in range(1, table.shape[1]):                  # largest coordinate difference
            if not len(i):
                break
            near = np.abs(table[i, p] - table[j, p]) <= radius
            i, j = i[near], j[near]
        if len(i):
            true = np.bitwise_count(fps[i] ^ fps[j]) <= radius
            yield order[i[true]], order[j[true]]
        first = last


def forest(n: int, parts) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes by the index pairs in ``parts``."""
    label = np.arange(n)
    for i, j in parts:
        while True:
            a, b = label[i], label[j]
            if (a == b).all():
                break
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(label, high, low)
            while True:                                     # shorten paths
                nxt = label[label]
                if (nxt == label).all():
                    break
                label = nxt
    return label


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, n_pivots: int = PIVOTS,
                      cell_rows: int = CELL_ROWS) -> DataFrame:
    """``distinct(fp)`` (landed, no repeats) -> ``(a, b)``: links between
    fingerprints within ``radius`` bits that connect all that are connected."""
    masks = block_masks(distinct.count(), radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("cell"))
                       for t, m in enumerate(signed)])
    rows = distinct.select("fp", F.inline(tables).alias("t", "cell"))
    big = rows.groupBy("t", "cell").agg(F.count("*").alias("n")).where(F.col("n") > cell_rows)
    big = land(big.withColumn("chunks", F.ceil(F.col("n") / cell_rows).cast("int")).drop("n"), "simhash-cells")
    d = rows.join(big, ["t", "cell"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    d = d.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    d = d.select("t", "cell", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "fp")
    cell = ["t", "cell", "x", "y"]
    d = d.repartition(*cell).sortWithinPartitions(*cell)
    refs = pivots(n_pivots)

    def run(batches):
        held = None
        for b in batches:
            k = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)])
            fp = b.column(4).to_numpy(zero_copy_only=False)
            if held is not None:
                k, fp = np.concatenate([held[0], k], axis=1), np.concatenate([held[1], fp])
            if not len(fp):
                continue
            new = np.concatenate([[True], (k[:, 1:] != k[:, :-1]).any(axis=0)])
            cut = np.flatnonzero(new)[-1]                    # the last cell may go on
            held = (k[:, cut:], fp[cut:])
            yield from _linked(fp[:cut], np.cumsum(new[:cut]), radius, refs)
        if held is not None:
            yield from _linked(held[1], np.zeros(len(held[1]), np.int64), radius, refs)
    return d.mapInArrow(run, "a long, b long")


def _linked(fp: np.ndarray, group: np.ndarray, radius: int, refs: np.ndarray):
    if len(fp) < 2:
        return
    label = forest(len(fp), links_within(fp.view(np.uint64), radius, refs, group))
    at = np.flatnonzero(label != np.arange(len(fp)))
    if len(at):
        yield pa.RecordBatch.from_arrays([pa.array(fp[at]), pa.array(fp[label[at]])], ["a", "b"])


def simhash_components(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                       radius: int = RADIUS) -> DataFrame:
    """``key, fingerprint`` (16 hex digits), ``component_id`` of every row.

    ``component_id`` is the smallest key reachable over links of ``radius``
    bits or fewer, the row's own included; equal fingerprints are linked, also
    those of empty texts. Null keys are never the smallest unless a component
    has no other. Repeated rows share a component; an empty table gives an
    empty result.
    """
    fps = land(fingerprints(docs, key, text, shingle), "simhash-fp")
    distinct = land(fps.groupBy("fp").agg(F.min(key).alias("low")), "simhash-distinct")
    roots = components(fingerprint_links(distinct.select("fp"), radius))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    found = land(named.join(lowest, "root").select("fp", "component_id"), "simhash-components")
    release(distinct)
    return fps.join(found, "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
