"""Language model scores by online logistic context mixing.

A text is coded bit by bit, and what several predictors say of each bit is mixed in the logistic domain.

Code: a word of the dictionary is its rank by training count, written as the class of the rank (its
number of bits, in a Huffman code) and the bits below the leading one.  A word outside the dictionary is an escape class and its bytes with a terminator, eight bits each.
The end of a text is a word too.  Every one of these bits is mixed, and nothing else counts.

Predictors of a bit:

* order 0: the training counts of all words that share the bits so far (of all rare words' bytes, when
  spelling), exact;
* the previous word, or its class if it is rare, and the classes of the previous two words, counted over
  all training texts (when spelling: the last byte, the last two bytes); beyond the first three bits of a rank
  one context, the previous word or its class, for words of up to ``TAIL_NODES`` ranks;
* hashed contexts of the text itself: the bits so far alone, with the word before, with two words before
  (bytes when spelling); they start from order 0 and learn as the text goes.

Weights are chosen by a gate (the kind of bit and how sure the counted contexts are) and follow the
gradient bit by bit; a table of refined probabilities by mixed probability adapts, too.  A text learns from
its first bit to its last; texts of about one length are coded side by side.

Counts cover all training texts and grow with them: word counts by Spark, and from them the dictionary
of at most ``TOP`` words (all that are frequent enough), which is broadcast; counts of rarer words are joined
to the texts' rare words.  The tables of counted contexts have a fixed number of slots, one for each
context, so no two contexts share one (but for pairs of bytes).

Null and empty texts are the end token alone; repeated rows score alike; without training texts all
tokens are new.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import ROWS, cut_lineage, fold, table, words_of
from lodestone.llm.hashing import RUN, hashed_words, mixed

#: First bits of a text that are coded side by side with those of others whatever their number; after them, where fewer
#: texts than ``FEW`` go on, each goes on alone, bit by bit.  Bits that are laid out at a time.
ABREAST, FEW, WINDOW = 4_096, 10, 1 << 19
#: More bits than a token has that is not spelled.
MARGIN = 64
#: Words of the dictionary at most.
TOP = 2_000_000
#: Tokens that are coded at a time (a text counts as ``TEXT`` of them more), bits after which a text's own learning starts
#: anew: more than any text has.
TOKENS, TEXT, SEGMENT = 150_000, 150, 1 << 62
#: Tokens of the texts that are scored at a time, and how many texts side by side; where one ends, the next one begins.
SCORED, LANES = 3_000_000, 1_024
#: Bytes of the texts that a task scores, and of the least that is worth a task (a text counts as ``ROW`` of them more).
DEALT, LEAST, ROW = 16 << 20, 1 << 20, 1_000
ESCAPE, CLASSES, LEADING = 31, 32, 3
#: Nodes are numbered: those of the classes, of bytes, and of ranks from here.
RANKED = CLASSES + 256
#: Previous words with contexts of their own, nodes of a code that are counted in context.
FREQUENT, NODES = 4_096, 256
#: The same for the bits of a rank beyond the leading ones, which are named by the whole rank so far.
TAIL_FREQUENT, TAIL_NODES = 32, 8_192
#: Where each table of counted contexts starts: previous word, two classes, byte orders 0, 1 and 2, previous word of later
#: bits, and the slot that counts nothing.
WORD, PAIR, BYTE, BYTE_1, BYTE_2, TAIL, EMPTY, SLOTS = np.cumsum([0, (FREQUENT + CLASSES) * NODES, CLASSES * CLASSES * NODES, 256, 65_536, 65_536, (TAIL_FREQUENT + CLASSES) * TAIL_NODES, 1]).tolist()
#: Slots of a text's own contexts, inputs, gates, buckets of refined probabilities.
OWN, INPUTS, GATES, BUCKETS = (4_096, 8_192, 8_192), 6, 12, 12
START = np.array([0.3, 0.45, 0.25, 0.3, 0.3, 0.3], np.float32)
RATE, REFINE = 0.004, 0.02
END_KEY = np.int64(xxhash.xxh64_intdigest(b"\n") - 2**63)
#: What a text has seen in one of its own contexts: up to 15 zeros and ones, recent ones count more.
_ZEROS, _ONES = np.divmod(np.arange(256), 16)
_STRETCH = np.where(_ZEROS + _ONES > 0, np.log((_ONES + 0.3) / (_ZEROS + 0.3)), 0.0).astype(np.float32)
_NEXT = np.stack([np.minimum(15, _ZEROS + 1) * 16 + np.where(_ONES > 2, (_ONES + 2) // 2, _ONES), np.where(_ZEROS > 2, (_ZEROS + 2) // 2, _ZEROS) * 16 + np.minimum(15, _ONES + 1)], axis=1).astype(np.uint8)
#: What follows a state, or a state and 256 for a one.
_FOLLOW = _NEXT.T.ravel().copy()
#: Where the slots of each of the text's own contexts start, at bits that no slot has; the slots of a text and a cache line
#: more, as equal slots of all texts would meet in few places of a cache otherwise.
_BASES, WIDTH = (16_384, 0, 8_192), 16_384 + 4_096 + 64
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def word_keys(texts: list[str | None]) -> Iterator[np.ndarray]:
    """For each text the 64-bit keys of its words and of its end; words of any length are one each."""
    for text, h in zip(texts, hashed_words([t if t is None or len(t) < RUN // 4 else None for t in texts])):
        if text is not None and len(text) >= RUN // 4:
            words = words_of(text)
            size = np.array([len(w) < RUN // 4 for w in words], bool)
            h = np.array([0 if short else xxhash.xxh64_intdigest(w) for w, short in zip(words, size.tolist())], np.uint64)
            short = [w.decode("utf-8", "surrogatepass") for w in words if len(w) < RUN // 4]
            own = [np.concatenate(list(hashed_words([" ".join(short[i : i + 1000])]))) for i in range(0, len(short), 1000)]
            h[size] = np.concatenate([np.zeros(0, np.uint64), *own])
        yield np.append(h.view(np.int64), END_KEY)


def word_counts(docs: DataFrame) -> DataFrame:
    """key, n of every word over all texts, the end once for each text."""

    def summed(keys: list, times: list) -> list:
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        return [[key], [np.bincount(at, np.concatenate(times)).astype(np.int64)]]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, times, held = [], [], 0
        emit = lambda: pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(times))], names=["key", "n"])
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                own = np.concatenate(list(word_keys(batch.column(0).slice(at, ROWS).to_pylist())))
                keys.append(own)
                times.append(np.ones(len(own), np.int64))
                held += len(own)
                if held > 2_000_000:
                    keys, times = summed(keys, times)
                    held = len(keys[0])
                    if held > 1_000_000:
                        yield emit()
                        keys, times, held = [], [], 0
        if held:
            keys, times = summed(keys, times)
            yield emit()

    return docs.select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


class Dictionary:
    """Ranks of words by key, and the counts below each rank."""

    def __init__(self, keys: np.ndarray, times: np.ndarray, tokens: int, words: int, least: int, new_mass: float):
        order = np.lexsort((keys, -times))
        rank = np.empty(len(keys), np.int32)
        rank[order] = np.arange(1, len(keys) + 1)
        at = np.argsort(keys)
        self.keys, self.rank = keys[at], rank[at]
        self.times = np.concatenate([[0], times[order]])  # by rank
        self.tokens, self.words, self.least = tokens, words, least
        below = np.concatenate([[0], np.cumsum(self.times)]).astype(np.float64)  # counts of the ranks below
        self.below = np.append(below, below[-1])
        edges = np.minimum(1 << np.arange(CLASSES), len(self.times))
        mass = np.append(np.diff(self.below[edges]), 0.0) + 0.01
        mass[ESCAPE] = max(0.5, new_mass)
        # a Huffman code of the classes: the inner nodes on the way to each class, the bits there, and what
        # share of a node's mass is behind its 1
        heap = [(float(m), c, [c]) for c, m in enumerate(mass)]
        heapq.heapify(heap)
        ways: list[list[tuple[int, int]]] = [[] for _ in range(CLASSES)]
        self.class_p = np.full(CLASSES, 0.5)
        for node in range(CLASSES - 1, 0, -1):
            zero, one = heapq.heappop(heap), heapq.heappop(heap)
            self.class_p[node] = one[0] / (zero[0] + one[0])
            for bit, side in enumerate((zero, one)):
                for c in side[2]:
                    ways[c].append((node, bit))
            heapq.heappush(heap, (zero[0] + one[0], CLASSES + node, zero[2] + one[2]))
        self.length = np.array([len(w) for w in ways])
        self.node, self.bit = np.zeros((CLASSES, CLASSES), np.int64), np.zeros((CLASSES, CLASSES), np.int64)
        for c, way in enumerate(ways):
            for k, (node, bit) in enumerate(reversed(way)):
                self.node[c, k], self.bit[c, k] = node, bit

    @cached_property
    def begins(self) -> tuple[int, np.ndarray]:
        """(bits that are left out, the first key of each run of keys that are equal in the others).  Keys are hashes, so a run
        has one or two."""
        out = 64 - max(1, len(self.keys).bit_length())
        runs = np.bincount((self.keys >> out) + (1 << 63 - out), minlength=1 << 64 - out)
        return out, (np.cumsum(runs) - runs).astype(np.int32)

    def ranks(self, keys: np.ndarray) -> np.ndarray:
        """The rank of each key, 0 for words outside."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int32)
        out, begins = self.begins
        last = len(self.keys) - 1
        at = np.minimum(begins.take((keys >> out) + (1 << 63 - out)), last)
        later = np.flatnonzero(self.keys.take(at) < keys)
        while len(later):
            at[later] += 1
            later = later[at[later] <= last]
            later = later[self.keys.take(at[later]) < keys[later]]
        at = np.minimum(at, last)
        return np.where(self.keys.take(at) == keys, self.rank.take(at), 0)

    @cached_property
    def nodes(self) -> tuple[np.ndarray, np.ndarray]:
        """Of the nodes of ranks, by 2 to the class of the rank and the bits so far with the leading one: the part of places in
        the text's own contexts, what share of the counts is behind a 1."""
        names, p, top = [np.zeros(1, np.uint64)], [np.full(1, 0.5)], len(self.below) - 1
        for of in range(int(classes_of(np.array([max(1, len(self.times) - 1)]))[0]) + 1):
            v = np.arange(1 << of)
            v[0] = 1  # stands for none
            left = of - classes_of(v) if of else np.ones(1, np.int64)
            low, half = v << left, 1 << (left - 1)
            f_low, f_mid, f_high = (self.below[np.minimum(x, top)] for x in (low, low + half, low + 2 * half))
            p.append((f_high - f_mid + 1e-3) / (f_high - f_low + 2e-3))
            name = mixed(((of << 32) + v + 64).astype(np.uint64) * _M1)
            names.append(packed(name, name, name))
        return np.concatenate(names), np.concatenate(p)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.tokens + 0.5 * (self.words + 1)))


def packed(near: np.ndarray, far: np.ndarray, alone: np.ndarray | None = None) -> np.ndarray:
    """The slots of a text's own contexts in 16 bits each: the bits so far alone, with near, with far.  What a node gives and
    what its token gives are joined by an exclusive or; a node (``alone``) also gives the place where slots start."""
    low, mid, high = (np.uint64(size - 1) for size in OWN)
    out = ((near & mid) << np.uint64(16)) | ((far & high) << np.uint64(32))
    if alone is not None:
        out |= (alone & low) | np.uint64(_BASES[0] | _BASES[1] << 16 | _BASES[2] << 32)
    return out


#: What the nodes of classes and bytes give to places in the text's own contexts.
NAMES = packed(*(mixed(np.concatenate([np.arange(CLASSES).astype(np.uint64) * _M1, np.arange(256).astype(np.uint64) * _M2 + np.uint64(77)])),) * 3)


def previous_of(before: np.ndarray, before_class: np.ndarray, frequent: int) -> np.ndarray:
    """The number of the previous word, if it is frequent, or that of its class."""
    return np.where((before > 0) & (before <= frequent), before - 1, frequent + before_class)


def classes_of(ranks: np.ndarray) -> np.ndarray:
    return np.where(ranks > 0, np.frexp(np.maximum(ranks, 1))[1] - 1, ESCAPE).astype(np.int64)


class Bits:
    """Some bits of a run of tokens: token, place there (``at``, an array or one number), bit, node of the code, slots of the
    counted contexts of the last so many of them (the others have none), packed places in the text's own contexts, kind (0
    class, 1 leading bits of a rank, 2 byte, 3 later bits of a rank); in a window of steps, instead of the place, the step of each
    bit from ``MARGIN`` before the window and the lane of its text."""

    def __init__(self, token, at, bit, node, slots, own, kind: int, step=None, lane=None):
        self.token, self.at, self.bit, self.node, self.slots, self.own, self.kind = token, at, bit, node, slots, own, kind
        self.step, self.lane = step, lane

    @property
    def names(self) -> tuple[np.ndarray, ...]:
        """The three contexts of the text's own predictors; what is over their size is the place where their slots start."""
        return tuple((self.own >> np.uint64(16 * i)) & np.uint64(0xFFFF) for i in range(3))


class Tails:
    """The bits of ranks beyond the leading ones: tokens that have some, how many (``left``), and log10 of what is coded there
    without mixing, which is nothing."""

    def __init__(self, words: Dictionary, text: np.ndarray, ranks: np.ndarray, kind: np.ndarray):
        self.token = np.flatnonzero((ranks > 0) & (kind > LEADING))
        self.left = kind[self.token] - LEADING
        self.log10 = np.zeros(len(self.token))


class Coded:
    """Tokens, and from where each reads what is known of its bits.  With the step at which a token starts in its text and
    the lane of the text, bits can be had a window of steps at a time."""

    def __init__(self, words: Dictionary, ranks: np.ndarray, before: np.ndarray, before2: np.ndarray, spelled: dict[int, bytes], start: np.ndarray | None = None, lane: np.ndarray | None = None):
        self.words, self.ranks, self.before, self.before2 = words, *(x.astype(np.int32, copy=False) for x in (ranks, before, before2))
        self.kind = classes_of(ranks).astype(np.uint8)
        self.start, self.lane = start, lane
        self.ends = None if start is None else start + (words.length + np.where(np.arange(CLASSES) == ESCAPE, 0, np.arange(CLASSES)))[self.kind]
        self.data = np.zeros(0, np.int64)
        if spelled:
            tokens = np.fromiter(spelled, np.int64, len(spelled))
            lengths = np.fromiter(map(len, spelled.values()), np.int64, len(spelled)) + 1
            self.data = np.frombuffer(b"".join(w + b" " for w in spelled.values()), np.uint8).astype(np.int64)
            self.place = np.arange(len(self.data)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            self.one, self.two = (np.where(self.place >= d, np.roll(self.data, d), 0) for d in (1, 2))
            self.two_hash = (mixed((self.one * 256 + self.two).astype(np.uint64) * _M1) >> np.uint64(56)).astype(np.int64)
            self.token = np.repeat(tokens, lengths)
            self.byte_start = None if start is None else start[self.token] + words.length[ESCAPE] + self.place * 8

    def contexts(self, some: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where the slots of tokens start: after the previous word, after two classes, those of later bits; and what the
        words before give to places in the text's own contexts."""
        before, before2 = self.before[some].astype(np.int64), self.before2[some].astype(np.int64)
        before_class = classes_of(before)
        near = mixed(before.astype(np.uint64) * _M2 + np.uint64(5))
        own = packed(near, mixed(near * _M1 + before2.astype(np.uint64)))
        return WORD + previous_of(before, before_class, FREQUENT) * NODES, PAIR + (classes_of(before2) * CLASSES + before_class) * NODES, TAIL + previous_of(before, before_class, TAIL_FREQUENT) * TAIL_NODES, own

    def bits(self, first: int = 0, last: int | None = None) -> Iterator[Bits]:
        """All bits of the tokens, place after place; with ``last`` those of the tokens and bytes that have some in the steps
        from ``first`` to there, which may lie up to a token or byte outside."""
        words, whole = self.words, last is None
        some = np.arange(len(self.kind)) if whole else np.flatnonzero((self.start < last) & (self.ends > first))
        kind = self.kind[some]
        contexts = self.contexts(some)
        steps, lanes = (np.zeros(0) if whole else x[some].astype(np.int64) for x in (self.start, self.lane))
        # tokens of long codes come first, so that those that have a bit at a place are the first so many
        length = words.length[kind].astype(np.uint8)
        order = np.argsort(np.uint8(CLASSES) - length, kind="stable")
        token, code = some[order], kind[order].astype(np.int64)
        previous, pair, _, own = (x[order] for x in contexts)
        start, lane = (None, None) if whole else (steps[order] + (MARGIN - first), lanes[order])
        longer = len(some) - np.cumsum(np.bincount(length, minlength=CLASSES))
        for k, n in enumerate(longer[longer > 0].tolist()):
            node = words.node[:, k].take(code[:n])
            yield Bits(token[:n], k, words.bit[:, k].take(code[:n]), node, (previous[:n] + node, pair[:n] + node), NAMES[:CLASSES].take(node) ^ own[:n], 0, None if whole else start[:n] + k, None if whole else lane[:n])
        key = np.where(kind == ESCAPE, 0, kind).astype(np.uint8)
        order = np.argsort(np.uint8(CLASSES) - key, kind="stable")[: np.count_nonzero(key)]
        token, of = some[order], kind[order].astype(np.int64)
        rank, top, length = self.ranks[token].astype(np.int64), 1 << of, words.length[of]
        previous, pair, later, own = (x[order] for x in contexts)
        previous, pair = previous + CLASSES + of * 8, pair + CLASSES + of * 8
        start, lane = (None, None) if whole else (steps[order] + length + (MARGIN - first), lanes[order])
        bare = np.count_nonzero(top >= TAIL_NODES)  # their later bits have no counted context
        longer = len(some) - np.cumsum(np.bincount(key, minlength=CLASSES))
        for depth, n in enumerate(longer[longer > 0].tolist()):
            open_ = rank[:n] >> (of[:n] - (depth + 1))  # bits of the rank down to this one
            v = open_ >> 1
            index = top[:n] + v
            slots = (previous[:n] + v, pair[:n] + v) if depth < LEADING else (later[bare:n] + index[bare:],)
            yield Bits(token[:n], length[:n] + depth if whole else None, open_ & 1, RANKED + index, slots, words.nodes[0].take(index) ^ own[:n], 1 if depth < LEADING else 3, None if whole else start[:n] + depth, None if whole else lane[:n])
        some = np.arange(len(self.data)) if whole or not len(self.data) else np.flatnonzero((self.byte_start < last) & (self.byte_start > first - 8))
        if len(some):
            token, data, place, one, two, two_hash = (x[some] for x in (self.token, self.data, self.place, self.one, self.two, self.two_hash))
            own = packed(mixed(one.astype(np.uint64) * _M1 + np.uint64(3)), mixed((one * 256 + two).astype(np.uint64) * _M2 + np.uint64(9)))
            for spot in range(8):
                node = (1 << spot) | (data >> (8 - spot))
                yield Bits(token, words.length[ESCAPE] + place * 8 + spot, (data >> (7 - spot)) & 1, CLASSES + node, (BYTE_1 + one * 256 + node, BYTE_2 + two_hash * 256 + node), NAMES[CLASSES:].take(node) ^ own, 2, None if whole else self.byte_start[some] + (MARGIN - first + spot), None if whole else self.lane[token].astype(np.int64))


def bits_of(words: Dictionary, text: np.ndarray, ranks: np.ndarray, before: np.ndarray, before2: np.ndarray, spelled: dict[int, bytes], byte_p: np.ndarray | None = None, tails: Tails | None = None) -> Iterator[Bits]:
    """All bits of the tokens, place after place."""
    return Coded(words, ranks, before, before2, spelled).bits()


def sizes_of(words: Dictionary, ranks: np.ndarray, spelled: dict[int, bytes], tails: Tails) -> np.ndarray:
    """The number of bits of each token."""
    kind = classes_of(ranks)
    out = words.length[kind] + np.where(ranks > 0, np.minimum(kind, LEADING), 0)
    out[tails.token] += tails.left
    if spelled:
        out[np.fromiter(spelled, np.int64, len(spelled))] += 8 * (np.fromiter(map(len, spelled.values()), np.int64, len(spelled)) + 1)
    return out


def tokens_of(words: Dictionary, texts: list[str | None], rare: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict[int, bytes]]:
    """(text, key, rank, rank before, rank two before of each token, bytes of the tokens that count less than
    ``rare``); before a text stands its end."""
    keys = list(word_keys(texts))
    sizes = np.fromiter(map(len, keys), np.int64, len(keys))
    text, key = np.repeat(np.arange(len(keys), dtype=np.int32), sizes), np.concatenate([np.zeros(0, np.int64), *keys])
    ranks, end = words.ranks(key), words.ranks(np.array([END_KEY]))[0]
    starts = np.cumsum(sizes) - sizes
    before = np.concatenate([[end], ranks])[: len(ranks)]
    before2 = np.concatenate([[end, end], ranks])[: len(ranks)]
    second = starts[sizes > 1] + 1
    before[starts], before2[starts], before2[second] = end, end, end
    spelled = {}
    wanted = np.flatnonzero((words.times[ranks] < rare) & (key != END_KEY))
    cuts = np.searchsorted(wanted, starts)
    for i in np.unique(text[wanted]).tolist():
        mine = wanted[cuts[i] : cuts[i + 1] if i + 1 < len(cuts) else None]
        own = words_of(texts[i])
        spelled.update((t, own[t - starts[i]]) for t in mine.tolist())
    return text, key, ranks, before, before2, spelled


def runs_of(texts: list[str | None], most: int = TOKENS) -> Iterator[slice]:
    """The texts in runs of about ``most`` tokens at most; a longer text is a run of its own."""
    begin = held = 0
    for i, t in enumerate(texts):
        size = len(t or "") // 6 + TEXT
        if held and held + size > most:
            yield slice(begin, i)
            begin, held = i, 0
        held += size
    if begin < len(texts):
        yield slice(begin, len(texts))


def leaves_of(coded: Coded) -> np.ndarray:
    """Where each token, and each byte of the spelled ones, is counted in its contexts: once, not at each of its bits.  A
    token's class and leading bits, a rank or a byte stands in the place of a node."""
    kind, rank = coded.kind.astype(np.int64), coded.ranks.astype(np.int64)
    leaf = kind * 8 + ((rank << LEADING >> kind) & 7)
    tail = (rank >= 1 << LEADING + 1) & (rank < TAIL_NODES)
    previous, pair, later, _ = coded.contexts()
    out = [previous + leaf, pair + leaf, later[tail] + rank[tail]]
    if len(coded.data):
        out += [BYTE_1 + coded.one * 256 + coded.data, BYTE_2 + coded.two_hash * 256 + coded.data]
    return np.concatenate(out)


def nodes_of(words: Dictionary, leaves: np.ndarray) -> np.ndarray:
    """SLOTS x 2 counts of zeros and ones at the nodes of all contexts, from the counts of their leaves."""
    out = np.zeros((SLOTS, 2))

    def below(part: np.ndarray, depth: int) -> np.ndarray:
        """Counts of what has each ``depth`` bits and a zero, and a one, after them."""
        return part.reshape(*part.shape[:-1], 1 << depth, 2, -1).sum(axis=-1)

    part, nodes = leaves[WORD:BYTE].reshape(-1, CLASSES, 8), out[WORD:BYTE].reshape(-1, NODES, 2)
    by_class = part.sum(axis=-1)
    for c in range(CLASSES):
        for k in range(int(words.length[c])):
            nodes[:, words.node[c, k], words.bit[c, k]] += by_class[:, c]
    for depth in range(LEADING):
        found = below(part, depth)
        for of in range(depth + 1, (NODES - CLASSES) // 8):
            at = CLASSES + of * 8 + (1 << depth)
            nodes[:, at : at + (1 << depth)] = found[:, of]
    part, nodes = leaves[BYTE_1:TAIL].reshape(-1, 256), out[BYTE_1:TAIL].reshape(-1, 256, 2)
    for depth in range(8):
        nodes[:, 1 << depth : 2 << depth] = below(part, depth)
    out[BYTE:BYTE_1] = nodes[:256].sum(axis=0)
    part, nodes = leaves[TAIL:EMPTY].reshape(-1, TAIL_NODES), out[TAIL:EMPTY].reshape(-1, TAIL_NODES, 2)
    top = 1
    while 2 * top <= TAIL_NODES:
        for depth in range(LEADING, top.bit_length() - 1):
            nodes[:, top + (1 << depth) : top + (2 << depth)] = below(part[:, top : 2 * top], depth)
        top *= 2
    return out.astype(np.float32)


def context_counts(docs: DataFrame, words: Dictionary) -> np.ndarray:
    """SLOTS x 2 counts of zeros and ones in the counted contexts, over all texts."""
    shared = docs.sparkSession.sparkContext.broadcast(words)
    rare = max(2, words.least)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, words = np.zeros(SLOTS, np.int64), shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                texts = batch.column(0).slice(at, ROWS).to_pylist()
                for run in runs_of(texts):
                    _, _, *coded = tokens_of(words, texts[run], rare)
                    np.add.at(sums, leaves_of(Coded(words, *coded)), 1)
        slots = np.flatnonzero(sums)
        for low in range(0, len(slots), 1 << 17):
            part = slots[low : low + (1 << 17)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(sums[part])], names=["slot", "n"])

    rows = docs.select("text").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS)
    out[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    return nodes_of(words, out)


def stretched(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6).astype(np.float32)
    return np.log(p / (1 - p))


def alone(x: list, gate: list, own: list, bits: list, states: list, weights: list, refined: list) -> list[float]:
    """What ``Model.log10`` does in a step, for one text; the lists of what it has learned are changed."""
    out, stretch, follow, exp = [], _STRETCH.tolist(), _FOLLOW.tolist(), math.exp
    for (x0, x1, x2), g, (a0, a1, a2), bit in zip(x, gate, own, bits):
        s0, s1, s2 = states[a0], states[a1], states[a2]
        x3, x4, x5 = stretch[s0], stretch[s1], stretch[s2]
        after = bit << 8
        states[a0], states[a1], states[a2] = follow[s0 + after], follow[s1 + after], follow[s2 + after]
        w0, w3, w1, w4, w2, w5 = weights[g]
        dot = w0 * x0 + w1 * x1 + w2 * x2 + w3 * x3 + w4 * x4 + w5 * x5
        mix = 1 / (1 + exp(-dot)) if dot > -80 else 0.0
        bucket = min(max(int(dot / 1.5 + BUCKETS / 2), 0), BUCKETS - 1)
        again = refined[bucket]
        out.append(mix + (again - mix) * 0.1)
        e = (bit - mix) * RATE
        weights[g] = [w0 + e * x0, w3 + e * x3, w1 + e * x1, w4 + e * x4, w2 + e * x2, w5 + e * x5]
        refined[bucket] = again + (bit - again) * REFINE
    return out


def lanes_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lane of each text, step at which it begins there, length of each lane, longest first): texts are dealt to ``LANES``
    lanes, the longest first, each to where least lies."""
    heap = [(0, i) for i in range(min(len(lengths), LANES))]
    lane, begin, held = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), np.zeros(len(heap), np.int64)
    for t in np.argsort(-lengths, kind="stable").tolist():
        begin[t], lane[t] = heap[0]
        end = int(begin[t] + lengths[t])
        heapq.heapreplace(heap, (end, int(lane[t])))
        held[lane[t]] = end
    order = np.argsort(-held, kind="stable")
    return np.argsort(order)[lane], begin, held[order]


class Model:
    """What is broadcast: the dictionary and the counted contexts."""

    def __init__(self, words: Dictionary, counts: np.ndarray):
        self.words, self.counts = words, counts
        zeros, ones = counts[BYTE:BYTE_1].T
        self.byte_p = (ones + 0.5) / (zeros + ones + 1.0)

    @cached_property
    def stretches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Stretched probabilities of order 0 by node and of the counted contexts by slot, and how sure a slot is.  All that
        they hang on is in the slot's number, so bits look them up."""
        words, ranked = self.words, self.words.nodes[1]
        # nodes of a context of all classes: those of classes, then the leading bits of each class
        of, v = np.divmod(np.arange(NODES - CLASSES), 8)
        index = (1 << of) + v
        leading = np.where((v > 0) & (v < 1 << of) & (index < len(ranked)), ranked[np.minimum(index, len(ranked) - 1)], 0.5)
        later = np.append(ranked, np.full(TAIL_NODES, 0.5))[:TAIL_NODES]
        runs = ((np.concatenate([words.class_p, leading]), FREQUENT + CLASSES + CLASSES * CLASSES), (self.byte_p, 513), (later, TAIL_FREQUENT + CLASSES), (np.full(1, 0.5), 1))
        p = np.concatenate([np.tile(np.clip(x, 1e-6, 1 - 1e-6).astype(np.float32), times) for x, times in runs])
        zeros, ones = self.counts.T
        n = zeros + ones
        q = (ones + 2 * p) / (n + 2)
        return stretched(np.concatenate([words.class_p, self.byte_p, ranked])), stretched(q), (n > 3).astype(np.uint8) + (n > 300)

    def inputs(self, bits: Bits) -> tuple[list[np.ndarray], np.ndarray | int]:
        """(stretched probabilities of order 0 and of the counted contexts, gate)."""
        of_node, of_slot, how_sure = self.stretches
        first = of_node.take(bits.node)
        out, sure = [first], np.uint8(0)
        for slots in bits.slots:
            x, s, bare = of_slot.take(slots), how_sure.take(slots), len(first) - len(slots)
            if bare:
                x, s = np.concatenate([first[:bare], x]), np.concatenate([np.zeros(bare, np.uint8), s])
            out.append(x)
            sure = np.maximum(sure, s)
        return out + [first] * (3 - len(out)), sure + np.uint8(bits.kind * 3)

    def log10(self, text: np.ndarray, texts: int, ranks: np.ndarray, before: np.ndarray, before2: np.ndarray, spelled: dict[int, bytes]) -> np.ndarray:
        """log10 probability of the bits of each text; texts are coded side by side, and where one ends another one begins."""
        tails = Tails(self.words, text, ranks, classes_of(ranks))
        sizes = sizes_of(self.words, ranks, spelled, tails)
        lengths = np.bincount(text, sizes, minlength=texts).astype(np.int64)
        lane, begin, held = lanes_of(lengths)
        start = np.cumsum(sizes) - sizes + (begin - np.cumsum(lengths) + lengths)[text]  # of a token in its lane
        del tails, sizes  # as long as all tokens, and not needed below
        order = np.argsort(begin, kind="stable")
        starts = list(zip(begin[order].tolist(), lane[order].tolist(), order.tolist()))[::-1]  # of the texts, the last ones first
        alive = np.searchsorted(-held, -np.arange(int(held.max(initial=0))), side="left")  # lanes longer than t
        begins = np.concatenate([[0], np.cumsum(alive)])
        until = max(ABREAST, int(np.searchsorted(-alive, -FEW, side="right")))  # steps that are taken side by side
        coded = Coded(self.words, ranks, before, before2, spelled, start, lane[text].astype(np.int32))
        lanes = len(held)
        states = np.zeros(lanes * WIDTH, np.uint8)
        # a gate's weights: those of a given input and of one of the text's own in turn, moved in pairs
        fresh = np.tile(START.reshape(2, 3).T.ravel(), (GATES, 1)), (1 / (1 + np.exp(-(np.arange(BUCKETS) - BUCKETS / 2 + 0.5) * 1.5))).astype(np.float32)
        weights, refined = np.tile(fresh[0], (lanes, 1)), np.tile(fresh[1], lanes)
        pairs, of_pair = weights.reshape(-1).view(np.uint64), np.arange(3)[:, None]
        found, places, current = np.zeros(texts), np.arange(lanes) * WIDTH, np.zeros(lanes, np.int64)
        most = min(max(WINDOW, lanes), int(begins[-1]))
        given, moved = np.empty(most + lanes, np.complex128), np.empty(most + lanes, np.uint64)
        first = 0
        while first < len(alive):
            last = max(first + 1, int(np.searchsorted(begins, begins[first] + WINDOW, side="right")) - 1)
            last = min(last, until) if first < until else last
            offset, total = begins[first], int(begins[last] - begins[first])
            # where the bits of a step start; those of other steps go behind the end
            where = np.full(last - first + 2 * MARGIN, total)
            where[MARGIN:-MARGIN] = begins[first:last] - offset
            for bits in coded.bits(first, last):
                to = where.take(bits.step)  # bits in the order of steps
                to += bits.lane
                inputs, gates = self.inputs(bits)
                x = np.empty((len(to), 4), np.float32)
                x[:, 0], x[:, 1], x[:, 2] = inputs
                given[to] = x.view(np.complex128)[:, 0]
                gates = (gates << 1 | bits.bit.astype(np.uint8)).astype(np.uint64)
                gates <<= np.uint64(48)
                moved[to] = np.bitwise_or(gates, bits.own, out=gates)
            x, fields = given[:total].view(np.float32).reshape(total, 4)[:, :3].T, moved[:total].view(np.uint16).reshape(total, 4).T
            ones, gate, own = fields[3] & 1, (fields[3] >> 1).astype(np.int64), fields[:3].astype(np.int64)
            # a lane's bits are those at its place of each step; of which text they are, and (step, lane) of what begins
            # after another text
            lane_of = np.arange(total) - np.repeat(begins[first:last] - offset, alive[first:last])
            owner, new = current.take(lane_of), []
            while starts and starts[-1][0] < last:
                at, i, t = starts.pop()
                owner[begins[at : min(last, held[i])] - offset + i] = current[i] = t
                if at:
                    new.append((at - first, i))
            if first < until:
                target, after, edges = ones.astype(np.float32), ones << 8, (begins[first : last + 1] - offset).tolist()
                gate = (gate + lane_of * GATES) * 3
                ahead = new[::-1]
                dots, mixes, again = (np.empty(total, np.float32) for _ in range(3))
                inputs, twice = np.empty((3, 2 * total), np.float32), np.empty(2 * lanes, np.float32)
                inputs[:, ::2] = x
                for t, (low, high) in enumerate(zip(edges, edges[1:])):
                    n = high - low
                    while ahead and ahead[-1][0] == t:
                        i = ahead.pop()[1]
                        states[i * WIDTH : (i + 1) * WIDTH], weights[i * GATES : (i + 1) * GATES] = 0, fresh[0]
                    a, g = own[:, low:high] + places[:n], gate[low:high] + of_pair
                    state = states.take(a)
                    xs, w = inputs[:, 2 * low : 2 * high], pairs.take(g).view(np.float32)
                    xs[:, 1::2] = _STRETCH.take(state)
                    states[a] = _FOLLOW.take(state + after[low:high])
                    parts = w * xs
                    dot = parts[0]
                    dot += parts[1]
                    dot += parts[2]
                    dot = np.add(dot[::2], dot[1::2], out=dots[low:high])
                    mix = np.exp(-dot)
                    mix += 1
                    np.reciprocal(mix, out=mixes[low:high])
                    e = target[low:high] - mixes[low:high]
                    e *= np.float32(RATE)
                    twice[: 2 * n : 2], twice[1 : 2 * n : 2] = e, e
                    xs *= twice[: 2 * n]
                    w += xs
                    pairs[g] = w.view(np.uint64)
                bucket = (dots * np.float32(1 / 1.5) + np.float32(BUCKETS / 2)).astype(np.int32)
                bucket, ahead = lane_of * BUCKETS + np.minimum(np.maximum(bucket, 0), BUCKETS - 1), new[::-1]
                for t, (low, high) in enumerate(zip(edges, edges[1:])):
                    while ahead and ahead[-1][0] == t:
                        i = ahead.pop()[1]
                        refined[i * BUCKETS : (i + 1) * BUCKETS] = fresh[1]
                    b = bucket[low:high]
                    r = refined.take(b, out=again[low:high], mode="clip")
                    refined[b] = r + (target[low:high] - r) * np.float32(REFINE)
                out = mixes + (again - mixes) * np.float32(0.1)
            else:
                out = np.empty(total, np.float32)
                for i in range(int(alive[first])):
                    learned = [y[i * n : (i + 1) * n] for y, n in ((states, WIDTH), (weights, GATES), (refined, BUCKETS))]
                    begun = [first + at for at, j in new if i == j]
                    cuts = sorted({first, *begun, int(min(last, held[i]))})
                    for at, end in zip(cuts, cuts[1:]):
                        if at in begun:
                            learned[0][:], learned[1][:], learned[2][:] = 0, *fresh
                        rest, lists = begins[at:end] - offset + i, [y.tolist() for y in learned]
                        out[rest] = alone(x[:, rest].T.tolist(), gate[rest].tolist(), own[:, rest].T.tolist(), ones[rest].tolist(), *lists)
                        for y, after in zip(learned, lists):
                            y[:] = after
            out -= ones == 0  # less 1 where the bit is 0: the size is the bit's probability
            found += np.bincount(owner, np.log(np.clip(np.abs(out), np.float32(1e-6), np.float32(1))), minlength=texts)
            first = last
        return found / math.log(10)


def fit(docs: DataFrame, top: int = TOP) -> tuple[Model, DataFrame | None]:
    """(model, counts of the words outside the dictionary or None if there are none) of the training texts."""
    counts = cut_lineage(word_counts(docs))
    capped = counts.groupBy(F.least("n", F.lit(1 << 16)).alias("c")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("tokens")).orderBy(F.desc("c")).collect()
    tokens, words = sum(r.tokens for r in capped), sum(r.words for r in capped)
    least, held, outside = 1, 0, 0
    for r in capped:  # from the most frequent words down
        if held + r.words > top:
            least = r.c + 1
            break
        held += r.words
    inside = counts.filter(F.col("n") >= least)
    outside = sum(r.tokens for r in capped if r.c < least)
    once = sum(r.words for r in capped if r.c == 1)
    rows = inside.toArrow()
    found = Dictionary(rows.column("key").to_numpy(), rows.column("n").to_numpy(), tokens, words, least, float(max(outside, once)))
    return Model(found, context_counts(docs, found)), counts.filter(F.col("n") < least) if least > 1 else None


def by_length(docs: DataFrame) -> DataFrame:
    """The same rows, dealt so that a task has texts of about one length and as many bytes as others: a step over many texts
    side by side costs little more than one over few.

    Lengths are told apart by the quarter of a power of two; where a length fills several tasks, rows go to them by a hash."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + ROW
    step = F.floor(4 * F.log2(size)).cast("int")
    held = {r.step: r.bytes for r in docs.groupBy(step.alias("step")).agg(F.sum(size).alias("bytes")).collect()}
    total = sum(held.values())
    tasks = max(math.ceil(total / DEALT), min(docs.sparkSession.sparkContext.defaultParallelism, math.ceil(total / LEAST)), 1)
    part, before = F.lit(0), 0
    for at, own in sorted(held.items()):
        spot = F.lit(before / total) + F.lit(own / total) * F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / (1 << 20)
        part = F.when(step == at, F.least(F.floor(spot * tasks), F.lit(tasks - 1))).otherwise(part)
        before += own
    return docs.repartitionById(tasks, part.cast("int"))


def scored(docs: DataFrame, model: Model, outside: DataFrame | None) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score, bits_per_byte of every text."""
    shared, joined = docs.sparkSession.sparkContext.broadcast(model), outside is not None

    def texts_of(texts: list[str | None]) -> list[tuple]:
        words = shared.value.words
        text, key, ranks, before, before2, spelled = tokens_of(words, texts, 1)
        n = np.bincount(text, minlength=len(texts))
        score = shared.value.log10(text, len(texts), ranks, before, before2, spelled)
        c, new = words.times[ranks], ranks == 0
        base = np.bincount(text, np.where(new & joined, 0.0, words.base(c)), minlength=len(texts))
        known = np.bincount(text, ~new, minlength=len(texts)).astype(np.int64)
        lengths = [len(t.encode("utf-8", "surrogatepass")) + 1 if t else 1 for t in texts]
        out = list(zip(n.tolist(), known.tolist(), base.tolist(), score.tolist(), (-score / math.log10(2) / np.array(lengths)).tolist()))
        if not joined:
            return [(*x, []) for x in out]
        rare: list[list] = [[] for _ in texts]
        for t, k in zip(text[new].tolist(), key[new].tolist()):
            rare[t].append(k)
        return [(*x, own) for x, own in zip(out, rare)]

    names = ["doc_id", "n_tokens", "n_known", "base_score", "score", "bits_per_byte", "rare"]
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            order = np.argsort([-len(t or "") for t in texts], kind="stable")  # as many steps as the longest has bits
            texts = [texts[i] for i in order.tolist()]
            for part in runs_of(texts, SCORED):
                rows = list(zip(*texts_of(texts[part])))
                ids = batch.column(0).take(pa.array(order[part]))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, t) for x, t in zip(rows, kinds))], names=names)

    rows = by_length(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double, bits_per_byte double, rare array<long>")
    if not joined:
        return rows.drop("rare")
    rows = cut_lineage(rows).withColumn("row", F.monotonically_increasing_id())
    words = model.words
    times = rows.select("row", F.explode("rare").alias("key")).groupBy("row", "key").agg(F.count(F.lit(1)).alias("times"))
    c = F.coalesce("n", F.lit(0))
    base = F.log10((c + 0.5) / F.lit(words.tokens + 0.5 * (words.words + 1)))
    more = times.join(outside, "key", "left").groupBy("row").agg(F.sum(F.col("times") * base).alias("more_base"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more_known"))
    full = rows.drop("rare").join(more, "row", "left")
    return full.select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), (F.col("base_score") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), "score", "bits_per_byte")


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 5) == 1
    model, outside = fit(docs.filter(~held_out))
    rows = scored(docs, model, outside)
    return rows.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.words.tokens).cast("long").alias("train_tokens"), "base_score", "score", "bits_per_byte")
