"""Benchmark items in documents: SimHash of item-sized windows, a multi-index, and exact verification.

A window has as many words as an item, or is the whole text if that is shorter; its features are its five-word shingles, weighted by how often
they occur.  Its 64-bit SimHash is looked up in four blocks of sixteen bits: two fingerprints within
RADIUS differ by at most RADIUS // 4 bits in some block, so a table of all block values within that
distance misses none of them (at similarity 0.8, 99.9 % of windows are within RADIUS; above it, more).  What is found is verified by the weighted similarity
sum(min counts) / sum(max counts) of the two bags of shingles, at least 0.8.

A window can only reach 0.8 if 80 % of its shingles are some item's, so the others need no fingerprint;
this leaves nothing out.  Items with fewer than five words count as one shingle.

The items are read in blocks of at most ``block`` items, each broadcast, one pass over the documents for
each block.  Null and empty texts and items match nothing; repeated rows match each for itself.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import table
from lodestone.llm.hashing import hashed_words, shingles_of

SHINGLE, RADIUS, BLOCKS = 5, 19, 4
SIMILAR = 0.8
BLOCK_ITEMS = 2_000
_LOW = np.uint64((1 << 20) - 1)
MATCH = "array<struct<item_id: long, similarity: double, first_word: int, n_words: int>>"


def _fingerprints(sums: np.ndarray) -> np.ndarray:
    """Rows of 64 bit sums -> the blocks of each."""
    return np.packbits(sums > 0, axis=1).view(np.uint16)


def _bit_rows(shingles: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(np.ascontiguousarray(shingles).view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int32) * 2 - 1


class ItemIndex:
    """The items by length, their shingles, and the multi-index of their fingerprints."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.bags, prints = [], [], []
        self.sizes: dict[int, set[int]] = defaultdict(set)  # shingle length -> word counts of items
        known: dict[int, list[np.ndarray]] = defaultdict(list)
        for (item_id, _), h in zip(items, hashed_words([text for _, text in items])):
            if not len(h):
                continue
            k = min(SHINGLE, len(h))
            shingles = shingles_of(h, k)
            known[k].append(shingles)
            self.sizes[k].add(len(h))
            self.ids.append(item_id)
            self.bags.append(Counter(shingles.tolist()))
            prints.append(_fingerprints(_bit_rows(shingles).sum(axis=0, keepdims=True))[0])
        self.prints = np.array(prints, np.uint16).reshape(-1, BLOCKS)
        self.totals = [b.total() for b in self.bags]
        self.smallest = {k: min(v) for k, v in self.sizes.items()}
        self.known = {k: np.unique(np.concatenate(v)) for k, v in known.items()}
        self.sieve = {k: np.zeros(1 << 20, bool) for k in known}
        for k, v in self.known.items():
            self.sieve[k][v & _LOW] = True
        # for each block: value -> the items that are near in it, a bit each
        values = np.arange(1 << 16, dtype=np.uint16).reshape(64, -1)
        near = lambda some, b: np.packbits(np.bitwise_count(some[:, None] ^ self.prints[:, b]) <= RADIUS // BLOCKS, axis=1)
        self.tables = [np.concatenate([near(some, b) for some in values]) for b in range(BLOCKS)]
        self.whole = self.prints.view(np.uint64).ravel()

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, distance) of the pairs within RADIUS."""
        hit = self.tables[0][prints[:, 0]]
        for b in range(1, BLOCKS):
            hit = hit | self.tables[b][prints[:, b]]
        w, i = np.nonzero(np.unpackbits(hit, axis=1, count=len(self.ids)))
        distance = np.bitwise_count(prints.view(np.uint64).ravel()[w] ^ self.whole[i])
        close = distance <= RADIUS
        return w[close], i[close], distance[close]

    def matches(self, h: np.ndarray) -> list[tuple[int, float, int, int]]:
        """(item_id, similarity, first word, words) of each item found, from word hashes.

        The window given is the closest by fingerprint of those that are similar enough, then the first.
        """
        found: dict[int, tuple[float, int, int]] = {}
        for k, known in self.known.items():
            if len(h) < k:
                continue
            shingles = shingles_of(h, k)
            hit = self.sieve[k][shingles & _LOW]
            least = SIMILAR * (self.smallest[k] - k + 1)
            if np.count_nonzero(hit) < least:
                continue
            at = np.flatnonzero(hit)
            hit[at] = known[np.minimum(np.searchsorted(known, shingles[at]), len(known) - 1)] == shingles[at]
            hits = np.concatenate([[0], np.cumsum(hit)])
            if hits[-1] < least:
                continue
            pairs = []
            for m in {min(size - k + 1, len(shingles)) for size in self.sizes[k] if SIMILAR * (size - k + 1) <= hits[-1]}:
                starts = np.flatnonzero(hits[m:] - hits[:-m] >= SIMILAR * m)
                for part in (starts[x : x + 512] for x in range(0, len(starts), 512)):
                    w, i, distance = self.candidates(self._windows(shingles, part, m))
                    pairs += zip(distance.tolist(), part[w].tolist(), [m] * len(w), i.tolist(), [m + k - 1] * len(w))
            self._verify(shingles, sorted(pairs), found)
        return [(self.ids[i], *x) for i, x in sorted(found.items())]

    @staticmethod
    def _windows(shingles: np.ndarray, starts: np.ndarray, m: int) -> np.ndarray:
        """The fingerprints of the windows of m shingles."""
        low, high = int(starts[0]), int(starts[-1]) + m
        if high - low > 20 * (m + len(starts)):  # far apart: each window for itself
            return _fingerprints(np.array([_bit_rows(shingles[s : s + m]).sum(axis=0) for s in starts]))
        run = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(_bit_rows(shingles[low:high]), axis=0, dtype=np.int32)])
        return _fingerprints(run[starts - low + m] - run[starts - low])

    def _verify(self, shingles: np.ndarray, pairs: list[tuple], found: dict) -> None:
        bags: dict[tuple[int, int], Counter] = {}
        for _, start, m, i, size in pairs:
            if i in found:
                continue
            mine, item = bags.get((start, m)) or bags.setdefault((start, m), Counter(shingles[start : start + m].tolist())), self.bags[i]
            common = sum(min(c, item[s]) for s, c in mine.items() if s in item)
            similarity = common / (m + self.totals[i] - common)
            if similarity >= SIMILAR:
                found[i] = (similarity, start, size)


def item_blocks(items: DataFrame, block: int = BLOCK_ITEMS) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ``block``, one on the driver at a time."""
    rows = items.select("item_id", "text").filter(F.length("text") > 0).distinct()
    parts = -(-rows.count() // block)
    for p in range(parts):
        yield [(r.item_id, r.text) for r in rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p).collect()]


def matches_of(spark: SparkSession, items: list[tuple[int, str]], text: Column) -> Column:
    """The items found in a text column, MATCH."""
    shared, made = spark.sparkContext.broadcast(items), {}

    @F.pandas_udf(MATCH)
    def found(texts: pd.Series) -> pd.Series:
        index = made.get(0) or made.setdefault(0, ItemIndex(shared.value))
        names = ("item_id", "similarity", "first_word", "n_words")
        return pd.Series([[dict(zip(names, m)) for m in index.matches(h)] for h in hashed_words(list(texts))])

    return found(text)


def contamination(docs: DataFrame, items: DataFrame, block: int = BLOCK_ITEMS) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words: each item found in a document, and of the
    similar windows the one with the closest fingerprint."""
    spark = docs.sparkSession
    out = spark.createDataFrame([], "doc_id long, item_id long, similarity double, first_word int, n_words int")
    for part in item_blocks(items, block):
        rows = docs.select("doc_id", F.explode(matches_of(spark, part, F.col("text"))).alias("m"))
        out = out.unionByName(rows.select("doc_id", "m.*"))
    return out


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item of ``benchmark`` found in ``documents``; documents without one give no row."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents without a benchmark item, columns as they came."""
    for part in item_blocks(table(spark, sf_dir, "benchmark")):
        found = docs.select(F.struct(*docs.columns).alias("row"), matches_of(spark, part, F.col("text")).alias("found"))
        docs = found.filter(F.size("found") == 0).select("row.*")
    return docs
