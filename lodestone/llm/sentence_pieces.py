"""SentencePiece encoding and decoding with exact N-best segmentation.

A text is a lattice of vocabulary pieces (and byte pieces for characters outside the vocabulary).  A
forward Viterbi pass gives the best score of every prefix; those scores are the exact remaining cost for
an A* search that walks back from the end, so paths leave its heap in order of their total score.

No piece crosses the start of a run of blanks or a line end, so the lattice of a text is a chain of the
lattices of its units.  Units repeat: a worker keeps their best paths (a bounded number of characters),
solves new ones of one length side by side, and merges the N best paths of a text, best first, from the
units whose second path costs least; the segmentations of these units come from A*.

Piece scores: the files at hand hold merge ranks, not log probabilities, so a piece scores
``-ln(rank + 2)`` (Zipf); a byte piece scores as the last rank less ``BYTE_PENALTY``.
"""

from __future__ import annotations

import heapq
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from lodestone.llm.common import kept, map_batches, table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
BYTE_PENALTY = 10.0
N_BEST = 4
#: Characters of the units and of their other paths that a worker keeps before it starts afresh.
CACHE = 800_000
#: Characters of the units that are solved side by side at most, and how many of one length are.
SIDE_BY_SIDE, TOGETHER = 32, 4_096
#: Bits of a hash by which pieces are found.
HEAD = 18
_STEP = 0x9E3779B97F4A7C15
_UNITS = re.compile(r" *[^ \n]+| +|\n")


def load_vocabulary(path: str) -> dict:
    """{"score": piece -> (score, id), "bytes": id of each byte piece, "surface": bytes of each id}."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.vocab_size()
    score: dict[str, tuple[float, int]] = {}
    byte_ids, surface = [0] * 256, [b""] * size
    for i in range(size):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            surface[i] = bytes([int(piece[3:5], 16)])
        elif not (model.is_control(i) or model.is_unknown(i)):
            surface[i] = piece.replace(MARK, " ").encode()
            if (model.get_score(i) > -1e8 or piece == MARK) and not re.search(r"[^▁]▁|\n", piece):
                score[piece.replace(MARK, " ")] = (-math.log(i + 2.0), i)
    return {"score": score, "bytes": byte_ids, "surface": surface, "byte_score": -math.log(size + 2.0) - BYTE_PENALTY}


class Lattice:
    """Best paths over the pieces of units, and what a worker keeps of the units it has met.

    ``row`` gives each kept unit a number; ``score``, ``gap`` (how far its second path is behind, inf if
    there is none), ``starts`` and ``sizes`` (where the pieces of the best path are in ``flat``) are by number.
    """

    def __init__(self, vocabulary: dict):
        self.bytes, self.byte_score = vocabulary["bytes"], vocabulary["byte_score"]
        self.trie: list = [{}, None]  # a node: its children and the (score, ids) of the piece that ends there
        for piece, (score, i) in vocabulary["score"].items():
            node = self.trie
            for c in piece:
                node = node[0].setdefault(c, [{}, None])
            node[1] = (score, (i,))
        self.pairs = {pair for piece in vocabulary["score"] for pair in zip(piece, piece[1:])}
        h = np.array([self._hash(piece) for piece in vocabulary["score"]], np.uint64)
        order = np.argsort(h)
        self.hashes = h[order]
        self.scores = np.array([x for x, _ in vocabulary["score"].values()])[order]
        self.ids = np.array([i for _, i in vocabulary["score"].values()], np.int32)[order]
        heads = (self.hashes >> np.uint64(64 - HEAD)).astype(np.int64)
        per_head = np.bincount(heads, minlength=1 << HEAD)
        self.first, self.filled, self.most = (np.cumsum(per_head) - per_head).astype(np.int32), per_head > 0, int(per_head.max())
        self.longest = max(map(len, vocabulary["score"]))
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.deep: dict[str, list[tuple[float, tuple[int, ...]]]] = {}
        self.score, self.gap, self.flat = np.zeros(0), np.zeros(0), np.zeros(0, np.int32)
        self.sizes, self.starts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.held = 0

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h + ord(c) + 1) * _STEP % 2**64
        return h

    def forward(self, unit: str) -> tuple[list[tuple], list[float], list]:
        """All pieces in the unit as edges (start, end, score, ids); Viterbi over them: the best score of
        each prefix and the edge it ends with."""
        n, top = len(unit), self.trie[0]
        edges, best, last = [], [0.0] + [-math.inf] * n, [None] * (n + 1)
        for i in range(n):
            here, children, single = best[i], top, False
            for j in range(i, n):
                if (node := children.get(unit[j])) is None:
                    break
                children, hit = node
                if hit:
                    single = single or j == i
                    edges.append(e := (i, j + 1, *hit))
                    if here + hit[0] > best[j + 1]:
                        best[j + 1], last[j + 1] = here + hit[0], e
            if not single:
                raw = unit[i].encode("utf-8", "surrogatepass")
                edges.append(e := (i, i + 1, s := len(raw) * self.byte_score, tuple(self.bytes[b] for b in raw)))
                if here + s > best[i + 1]:
                    best[i + 1], last[i + 1] = here + s, e
        return edges, best, last

    def paths(self, unit: str) -> Iterator[tuple[float, tuple[int, ...]]]:
        """(score, ids) of all segmentations, best first: A* from the end, the prefix scores as heuristic."""
        edges, best, _ = self.forward(unit)
        into: list[list] = [[] for _ in best]
        for e in edges:
            into[e[1]].append(e)
        # what lies behind a place is a chain of links, so that a step costs the same in long units
        heap, made = [(-best[-1], 0, len(unit), 0.0, None)], 0
        while heap:
            cost, _, j, tail, link = heapq.heappop(heap)
            if j == 0:
                ids: list[int] = []
                while link:
                    ids += link[0]
                    link = link[1]
                yield -cost, tuple(ids)
                continue
            for i, _, s, piece in into[j]:
                made += 1
                heapq.heappush(heap, (-(best[i] + s + tail), made, i, s + tail, (piece, link)))

    def chain_of(self, text: str | None) -> list[str]:
        """The units of a text, long ones cut wherever two characters stand side by side in no piece, as no
        path crosses there."""
        units = units_of(text)
        if len(text or "") < SIDE_BY_SIDE or max(map(len, units)) <= SIDE_BY_SIDE:
            return units
        out = []
        for unit in units:
            cuts = [0, *(i for i, pair in enumerate(zip(unit, unit[1:]), 1) if pair not in self.pairs), len(unit)] if len(unit) > SIDE_BY_SIDE else [0, len(unit)]
            out += [unit[i:j] for i, j in zip(cuts, cuts[1:])]
        return out

    def rows_of(self, units: list[str]) -> np.ndarray:
        """The number of each unit, new ones solved."""
        fresh = sorted(set(units).difference(self.row), key=len)
        at = 0
        while at < len(fresh):
            size = len(fresh[at])
            end = at + 1
            if size <= SIDE_BY_SIDE:
                end = min(bisect_right(fresh, size, at, key=len), at + TOGETHER)
                self._keep(fresh[at:end], *self.solve_equal(fresh[at:end]))
            else:
                total, ids, gap = self.solve(fresh[at])
                self._keep(fresh[at:end], np.array([total]), np.array([gap]), np.array([len(ids)]), np.array(ids, np.int32))
            at = end
        return np.fromiter(map(self.row.__getitem__, units), np.int64, len(units))

    def _keep(self, units: list[str], score: np.ndarray, gap: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> None:
        self.row.update(zip(units, range(len(self.row), len(self.row) + len(units))))
        self.score, self.gap = np.concatenate([self.score, score]), np.concatenate([self.gap, gap])
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes, self.flat = np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, flat])
        self.held += len(units) * len(units[0])

    def _pieces(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score or -inf, id or -1) by size - 1, start and column of all pieces in the columns of codes;
        a character that is no piece scores as its bytes, with id -2."""
        size, n = codes.shape
        most = min(self.longest, size)
        score, piece = np.full((most, size, n), -np.inf), np.full((most, size, n), -1, np.int32)
        h = np.zeros_like(codes)
        for k in range(most):
            h = (h[: size - k] + codes[k:]) * np.uint64(_STEP)
            head = (h >> np.uint64(64 - HEAD)).astype(np.int64)
            at = np.flatnonzero(self.filled[head])
            seek, place = h.ravel()[at], self.first[head.ravel()[at]]
            for _ in range(self.most):
                hit = self.hashes[place] == seek
                score[k].ravel()[at[hit]], piece[k].ravel()[at[hit]] = self.scores[place[hit]], self.ids[place[hit]]
                at, seek, place = at[~hit], seek[~hit], np.minimum(place[~hit] + 1, len(self.hashes) - 1)
        raw = piece[0] < 0
        if raw.any():
            c = codes[raw] - np.uint64(1)
            score[0][raw] = (1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)) * self.byte_score
            piece[0][raw] = -2
        return score, piece

    def solve_equal(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(score, gap, pieces of each, all pieces) of units of one length, side by side.

        Forward and backward passes give the best scores of all prefixes and suffixes; the second path has
        an edge that the best one lacks, so its score is the largest prefix + edge + suffix of those.
        """
        n, size = len(units), len(units[0])
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, size).T.astype(np.uint64) + np.uint64(1)
        score, piece = self._pieces(codes)
        used = [k for k in range(len(score)) if k == 0 or (piece[k] >= 0).any()]
        best, rest, took = np.full((size + 1, n), -np.inf), np.full((size + 1, n), -np.inf), np.zeros((size + 1, n), np.int64)
        best[0] = rest[size] = 0.0
        for j in range(1, size + 1):
            for k in reversed(used):
                if k < j:
                    s = best[j - k - 1] + score[k, j - k - 1]
                    better = s > best[j]
                    best[j] = np.where(better, s, best[j])
                    took[j][better] = k
        for i in range(size - 1, -1, -1):
            for k in used:
                if i + k < size:
                    np.maximum(rest[i], score[k, i] + rest[i + k + 1], out=rest[i])
        every, here, path = np.arange(n), np.full(n, size), np.full((size, n), -1, np.int32)
        edge = np.full((size, n), -1)
        while len(every):
            k = took[here, every]
            here = here - k - 1
            path[here, every], edge[here, every] = piece[k, here, every], k
            every, here = every[here > 0], here[here > 0]
        second = np.full(n, -np.inf)
        for k in used:
            through = best[: size - k] + score[k, : size - k] + rest[k + 1 :]
            through[edge[: size - k] == k] = -np.inf
            np.maximum(second, through.max(axis=0), out=second)
        total, path = best[size], path.T
        if (path == -2).any():  # characters that are bytes have several pieces each
            rows = [self.solve(u)[1] if (p == -2).any() else p[p >= 0] for u, p in zip(units, path)]
            return total, total - second, np.fromiter(map(len, rows), np.int64, n), np.concatenate([np.asarray(r, np.int32) for r in rows])
        return total, total - second, (path >= 0).sum(axis=1), path[path >= 0]

    def solve(self, unit: str) -> tuple[float, tuple[int, ...], float]:
        """(score, ids, gap) of one unit."""
        edges, best, last = self.forward(unit)
        j = n = len(unit)
        path = []
        while j:
            path.append(last[j])
            j = last[j][0]
        ids = tuple(chain.from_iterable(e[3] for e in reversed(path)))
        if len(edges) == len(path):
            return best[n], ids, math.inf
        rest, second, own = [-math.inf] * n + [0.0], -math.inf, set(path)
        for e in reversed(edges):
            i, j, s, _ = e
            s += rest[j]
            if s > rest[i]:
                rest[i] = s
            if s + best[i] > second and e not in own:
                second = s + best[i]
        return best[n], ids, best[n] - second

    def pieces_of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces of the best paths of the units one after the other, number of pieces of each unit)."""
        sizes = self.sizes[rows]
        return self.flat[np.repeat(self.starts[rows] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())], sizes

    def loss(self, unit: str, c: int, n: int) -> float:
        """What path c of a unit scores below its best; inf if it has fewer paths."""
        if c < 2:
            return float(self.gap[self.row[unit]]) if c else 0.0
        found = self.best_of(unit, n)
        return found[c][0] if c < len(found) else math.inf

    def best_of(self, unit: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """(score below the best, ids) of the n best paths of a unit by A*, the one that is kept first."""
        if unit not in self.deep:
            found = list(islice(self.paths(unit), n))
            first = tuple(self.pieces_of(np.array([self.row[unit]]))[0].tolist())
            others = [(found[0][0] - s, ids) for s, ids in found if ids != first]
            self.deep[unit] = [(0.0, first), *others][:n]
            self.held += n * len(unit)
        return self.deep[unit]

    def spans(self, units: list[str], sizes: np.ndarray, choice: dict[int, int], n: int) -> list[tuple[int, int, list[int]]]:
        """(first, n, ids): the pieces of the best path that a path of ``n_best`` replaces, and by what."""
        return [(int(sizes[:k].sum()), int(sizes[k]), list(self.best_of(units[k], n)[c][1])) for k, c in sorted(choice.items())]


def splice(ids: list[int], spans: list[tuple[int, int, list[int]]]) -> list[int]:
    """The pieces of a path from those of the best one and its spans."""
    out, at = [], 0
    for first, size, own in spans:
        out += [*ids[at:first], *own]
        at = first + size
    return out + list(ids[at:])


def units_of(text: str | None) -> list[str]:
    """The chain of units of a text, with the blank that SentencePiece puts in front."""
    return _UNITS.findall(f" {text}") if text else []


def n_best(lattice: Lattice, units: list[str], rows: np.ndarray, n: int) -> list[tuple[float, dict[int, int]]]:
    """The n best paths of a text: (score, {place of a unit: which of its paths}), best first.

    Only the n - 1 units with the smallest gaps can differ from their best path in the n best of all.
    Segmentations of a unit after its best one come from A*, when the merge first asks for them.
    """
    total, gaps = math.fsum(lattice.score[rows]), lattice.gap[rows]
    limit = np.partition(gaps, n - 2)[n - 2] if len(gaps) >= n > 1 else math.inf
    near = np.flatnonzero((gaps <= limit) & (gaps < math.inf)).tolist() if n > 1 else []
    places = [k for _, k in heapq.nsmallest(n - 1, zip(gaps[near].tolist(), near))]
    heap, seen, out = [(0.0, (0,) * len(places))], set(), []
    while heap:
        lost, choice = heapq.heappop(heap)
        out.append((total - lost, {places[k]: c for k, c in enumerate(choice) if c}))
        if len(out) == n:
            break
        for k, c in enumerate(choice):
            to = (*choice[:k], c + 1, *choice[k + 1 :])
            if to not in seen and (more := lattice.loss(units[places[k]], c + 1, n)) < math.inf:
                seen.add(to)
                heapq.heappush(heap, (lost - lattice.loss(units[places[k]], c, n) + more, to))
    return out


def encode(docs: DataFrame, vocabulary: dict, n: int = N_BEST, text_col: str = "text") -> DataFrame:
    """The rows with piece_ids array<int>, n_pieces long, nbest_scores array<double>, nbest_spans added (or replaced).

    piece_ids is the best segmentation of the whole text; nbest_scores are the scores of the best n, best
    first (fewer if there are fewer); nbest_spans are, for each of them, the spans of piece_ids that it replaces
    (none for the best; ``splice`` puts them in).  Null and empty texts have no pieces and one path of score 0.
    """
    docs = docs.drop("piece_ids", "n_pieces", "nbest_scores", "nbest_spans")
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    contents, place = xxhash.xxh64_intdigest(repr([vocabulary[part] for part in ("score", "bytes", "byte_score")])), docs.columns.index(text_col)
    span = StructType([StructField("first", IntegerType()), StructField("n", IntegerType()), StructField("ids", ArrayType(IntegerType()))])
    added = [StructField("piece_ids", ArrayType(IntegerType())), StructField("n_pieces", LongType()), StructField("nbest_scores", ArrayType(DoubleType())), StructField("nbest_spans", ArrayType(ArrayType(span)))]
    schema, span_type = StructType([*docs.schema, *added]), pa.struct([("first", pa.int32()), ("n", pa.int32()), ("ids", pa.list_(pa.int32()))])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lattice = kept("lattice", contents, lambda: Lattice(shared.value))
        if lattice.held > CACHE:
            lattice.clear()
        chains = [lattice.chain_of(t) for t in batch.column(place).to_pylist()]
        rows = lattice.rows_of(list(chain.from_iterable(chains)))
        ids, sizes = lattice.pieces_of(rows)
        ends = np.cumsum([0, *map(len, chains)])
        lengths = np.diff(np.concatenate([[0], np.cumsum(sizes)])[ends])
        scores, spans = [], []
        for units, low, high in zip(chains, ends, ends[1:]):
            paths = n_best(lattice, units, rows[low:high], n)
            scores.append([s for s, _ in paths])
            spans.append([[dict(zip(("first", "n", "ids"), x)) for x in lattice.spans(units, sizes[low:high], choice, n)] for _, choice in paths])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(ids))
        added = [lists, pa.array(lengths.astype(np.int64)), pa.array(scores, pa.list_(pa.float64())), pa.array(spans, pa.list_(pa.list_(span_type)))]
        return pa.RecordBatch.from_arrays([*batch.columns, *added], names=schema.names)

    return map_batches(docs, run, schema)


def decode(df: DataFrame, vocabulary: dict, ids_col: str = "piece_ids", out_col: str = "decoded") -> DataFrame:
    """Adds the text that piece ids stand for; null ids give null, ids outside the vocabulary nothing."""
    shared, made = df.sparkSession.sparkContext.broadcast(vocabulary["surface"]), {}

    @F.pandas_udf("string")
    def text_of(ids):
        surface = made or made.update(enumerate(shared.value)) or made
        get = lambda x: surface.get(x, b"")
        return ids.map(lambda x: None if x is None else b"".join(map(get, x.tolist())).decode("utf-8", "replace")[1:])

    return df.withColumn(out_col, text_of(F.col(ids_col)))


def op9_sentence_pieces(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_pieces, piece_ids, nbest_scores, nbest_spans, round_trip (decoding gives the text again)."""
    v = load_vocabulary(vocabulary)
    coded = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text"), v), v)
    return coded.select("doc_id", "n_pieces", "piece_ids", "nbest_scores", "nbest_spans", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


def encode_documents(spark: SparkSession, docs: DataFrame, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Last pipeline stage: the documents with their pieces."""
    return encode(docs, load_vocabulary(vocabulary))
