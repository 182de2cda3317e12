"""Exact n-gram Jaccard join by T-occurrence search (DivideSkip).

A document is its set of word shingles.  Two sets at the similarity share T shingles at least, T from the size of
the one that asks; so its partners are the entries that occur in T of the inverted lists of its shingles.  The
longest lists are set aside: the short ones are merged by a heap, what occurs often enough there is probed in the
long ones by binary search, and what reaches T is verified with both sizes.

The index is dealt into blocks of bounded size, in three steps:

1. Each set names its rarest shingles, so many that sets at the similarity share several of them (the share is
   that of ``Similarity.shared``).  What no other set names is forgotten, and so is a set that keeps too few to have a
   partner, until nothing changes or PRUNES rounds are over; sets that have but a passage in common go here.
2. A set's home is the block of the most frequent shingle it keeps, so copies of a template meet.  A block searches
   each set against the rest of it; sets that are linked leave the index, as components are what counts.  A template
   too large for a block has several, and a few sets of each component then meet in blocks of their own.
3. What is left to find lies between blocks and between components.  For each shingle that is kept by more than one
   component, all but the sets of its largest component visit the other blocks where it is kept.  There the lists
   hold components first (what any member has): a visitor that shares T shingles with none is done, however many
   members there are, and one link to a component is enough for all of a visitor's own component.

Every link between different components is found in step 3, whatever steps 1 and 2 have put together before; so no
step is approximate.  Sets are made of 64-bit hashes of their shingles, here and when they are confirmed.

Defined results: null, empty and wordless texts have an empty set and are linked with nothing.  Equal sets are one
class (its smallest id asks for all); rows of one id with other texts each keep their own class, and are not linked
by the id alone.  Rows without an id have a null component.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import ROWS, cut_lineage, map_batches, table
from lodestone.llm.components import components
from lodestone.llm.hashing import shingle_sets

#: Shingles of a block's sets, sets of a component that meet again, slots of the table that orders shingles by how
#: common they are (it decides speed, not results).
BLOCK, PIVOTS, COMMON = 1 << 20, 8, 1 << 20
#: Rounds in which sets without partners are left out at most (it decides speed, not results).
PRUNES = 3
#: Rows that are broadcast to the texts.
MAX_BROADCAST = 1_000_000
#: How much the length of the longest list holds back from setting lists aside.
MU = 0.01
#: Entries of short lists that are merged by a heap at most.
HEAP = 1 << 10
#: Entries that are merged in the time of one probe.
PROBE = 16


def merged(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, in how many of the ascending lists each is): by a heap, or by a merge sort where they are long."""
    if sum(map(len, lists)) > HEAP:
        return np.unique(np.concatenate(lists), return_counts=True)
    runs = [(number, sum(1 for _ in same)) for number, same in groupby(heapq.merge(*(x.tolist() for x in lists)))]
    return np.array([x for x, _ in runs], np.int64), np.array([n for _, n in runs], np.int64)


class Lists:
    """Inverted lists of sets of 64-bit shingles: the ascending numbers of the sets that hold each."""

    def __init__(self, sets: list[np.ndarray], numbers: np.ndarray):
        shingles = np.concatenate([np.zeros(0, np.uint64), *sets])
        owners = np.repeat(numbers, [len(s) for s in sets]).astype(np.int64)
        order = np.lexsort((owners, shingles))
        shingles, owners = shingles[order], owners[order]
        once = np.ones(len(shingles), bool)
        once[1:] = (shingles[1:] != shingles[:-1]) | (owners[1:] != owners[:-1])
        shingles, self.owners = shingles[once], owners[once]
        self.keys, starts = np.unique(shingles, return_index=True)
        self.edges = np.append(starts, len(shingles))

    def search(self, query: np.ndarray, need: int) -> list[tuple[int, int]]:
        """(number, how many of the query's shingles it holds) of all that hold ``need`` of them."""
        if not len(self.keys):
            return []
        at = np.minimum(np.searchsorted(self.keys, query), len(self.keys) - 1)
        at = at[self.keys[at] == query]
        if len(at) < need:
            return []
        lists = sorted((self.owners[self.edges[i] : self.edges[i + 1]] for i in at.tolist()), key=len)
        aside = min(need - 1, int(need / (MU * np.log2(len(lists[-1]) + 1) + 1)))
        short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
        found, counts = merged(short)
        found, counts = found[counts >= need - aside], counts[counts >= need - aside]
        if len(found) * PROBE >= sum(map(len, long)) > 0:  # so many candidates that merging is cheaper than probing
            counts = counts + np.bincount(np.concatenate(long), minlength=int(found.max()) + 1)[found]
            long = []
        for left, x in zip(range(len(long), 0, -1), long):
            going = counts + left >= need
            found, counts = found[going], counts[going]
            if not len(found):
                break
            place = np.minimum(np.searchsorted(x, found), len(x) - 1)
            counts = counts + (x[place] == found)
        return list(zip(found[counts >= need].tolist(), counts[counts >= need].tolist()))


class Similarity:
    """Jaccard similarity of ``numerator / denominator`` or more, in whole numbers."""

    def __init__(self, numerator: int, denominator: int):
        self.p, self.q = numerator, denominator

    def overlap(self, n: int) -> int:
        """What a set of n shingles shares at least with any partner."""
        return -(-n * self.p // self.q)

    def shared(self, n):
        """How many named shingles two sets have in common at least, if the smaller has n."""
        return 1 + n * 6 // 100

    def named(self, n: int) -> int:
        """How many of its rarest shingles a set of n must name.

        Of the shingles common to two sets, the first c in the order of rarity stand in either set before all but
        ``overlap - c`` of the others.
        """
        return min(n, n - self.overlap(n) + self.shared(n))

    def needed(self, n: Column) -> Column:
        """How many of its named shingles a set of n must share with a partner, which may be smaller."""
        return F.lit(1) + F.floor(F.ceil(n * self.p / self.q) * 6 / 100)

    def linked(self, common, n, m):
        return common * (self.p + self.q) >= (n + m) * self.p


def links_within(ids: np.ndarray, sets: list[np.ndarray], like: Similarity) -> list[tuple[int, int]]:
    """Links that hold each component of a block together; a set that is linked leaves the index."""
    out, alive, waiting = [], np.ones(len(sets), bool), list(range(len(sets) - 1, -1, -1))
    lists, indexed = Lists(sets, np.arange(len(sets))), len(sets)
    while waiting:
        first = waiting.pop()
        queue = [first] if alive[first] else []
        alive[first] = False
        while queue:
            i = queue.pop()
            left = int(alive.sum())
            if not left:
                return out
            if left * 2 < indexed:
                rest = np.flatnonzero(alive)
                lists, indexed = Lists([sets[j] for j in rest], rest), left
            for j, common in lists.search(sets[i], like.overlap(len(sets[i]))):
                if alive[j] and like.linked(common, len(sets[i]), len(sets[j])):
                    out.append((int(ids[i]), int(ids[j])))
                    alive[j] = False
                    queue.append(j)
    return out


class Block:
    """Sets at home in a block, in lists of components first."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], like: Similarity):
        order = np.argsort(labels, kind="stable")
        self.ids, self.sets, self.like = ids[order], [sets[i] for i in order], like
        self.labels, starts = np.unique(labels[order], return_index=True)
        self.edges = np.append(starts, len(ids))
        self.sizes = np.array([len(s) for s in self.sets])
        self.lists = Lists(self.sets, np.repeat(np.arange(len(self.labels)), np.diff(self.edges)))
        self.label, self.joined = None, set()

    def visit(self, rep: int, label: int, own: np.ndarray) -> list[tuple[int, int]]:
        """A link of the visitor to each component here that its own isn't linked with yet.  Visitors of one
        component come one after the other."""
        if label != self.label:
            self.label, self.joined = label, set()
        out = []
        for c, _ in self.lists.search(own, self.like.overlap(len(own))):
            if c in self.joined or self.labels[c] == label:
                continue
            a, b = self.edges[c], self.edges[c + 1]
            fits = a + np.flatnonzero(self.like.linked(np.minimum(self.sizes[a:b], len(own)), self.sizes[a:b], len(own)))
            for j in fits.tolist():
                common = len(np.intersect1d(self.sets[j], own, assume_unique=True))
                if self.like.linked(common, self.sizes[j], len(own)):
                    out.append((int(self.ids[j]), rep))
                    self.joined.add(c)
                    break
        return out


def class_key(shingles: np.ndarray) -> int:
    """A number that is equal for equal sets."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - 2**63


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, mark (a hash of the text), n_shingles, rep (equal for equal sets, null for empty ones)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, reps = [], []
        for s in shingle_sets(batch.column(2).to_pylist(), k):
            sizes.append(len(s))
            reps.append(class_key(s) if len(s) else None)
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sizes, pa.int64()), pa.array(reps, pa.int64())], names=["doc_id", "mark", "n_shingles", "rep"])

    return map_batches(docs.select("doc_id", F.xxhash64("text").alias("mark"), "text"), run, "doc_id long, mark long, n_shingles long, rep long")


def how_common(docs: DataFrame, k: int) -> np.ndarray:
    """How many texts hold a shingle, by its low bits; each task sends one table of fixed size, so there are as many as cores."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(COMMON, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                sets = list(shingle_sets(batch.column(0).slice(at, ROWS).to_pylist(), k))
                sums += np.bincount((np.concatenate(sets) & np.uint64(COMMON - 1)).astype(np.int64), minlength=COMMON)
        slots = np.flatnonzero(sums)
        for at in range(0, len(slots), 1 << 16):
            part = slots[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(sums[part])], names=["slot", "n"])

    cores = docs.sparkSession.sparkContext.defaultParallelism
    rows = docs.select("text").coalesce(cores).mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COMMON, np.int64)
    out[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    return out


def named_shingles(docs: DataFrame, k: int, like: Similarity) -> DataFrame:
    """rep, n (size of the set), tokens: the rarest shingles of each set, of which it shares some with every partner.
    Documents with equal sets each have a row."""
    shared = docs.sparkSession.sparkContext.broadcast(how_common(docs, k))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        reps, sizes, tokens = [], [], []
        for s in shingle_sets(batch.column(0).to_pylist(), k):
            if not like.linked(len(s), len(s), len(s) + 1):
                continue  # so small that only an equal set is a partner
            common = shared.value[(s & np.uint64(COMMON - 1)).astype(np.int64)]
            tokens.append(s[np.lexsort((s, common))[: like.named(len(s))]].view(np.int64))
            reps.append(class_key(s))
            sizes.append(len(s))
        return pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(sizes, pa.int64()), pa.array(tokens, pa.list_(pa.int64()))], names=["rep", "n", "tokens"])

    return map_batches(docs.filter("doc_id is not null").select("text"), run, "rep long, n long, tokens array<long>")


def each_token(named: DataFrame, *more: str) -> DataFrame:
    return named.select("rep", "n", *more, F.explode("tokens").alias("token"))


def pruned(named: DataFrame, like: Similarity) -> DataFrame:
    """rep, n, tokens, need: the named shingles that another set names, of sets that keep ``need`` of them."""
    rows, before = named, None
    for _ in range(PRUNES):
        several = each_token(rows).groupBy("token").agg(F.min("rep").alias("one"), F.max("rep").alias("other")).filter("one <> other").select("token")
        kept = each_token(rows).join(several, "token").groupBy("rep", "n").agg(F.collect_set("token").alias("tokens"))
        rows = cut_lineage(kept.withColumn("need", like.needed(F.col("n"))).filter(F.size("tokens") >= F.col("need")))
        left = rows.agg(F.sum(F.size("tokens"))).first()[0]
        if left == before:
            break
        before = left
    return rows


def homes_of(kept: DataFrame) -> DataFrame:
    """rep, block, split (whether the block's shingle has several): where each set is at home.  kept: rep, n, token.

    Shingles of a block's size or less share blocks by hash; the sets of a larger one are dealt over several.
    """
    counts = cut_lineage(kept.groupBy("token").agg(F.count(F.lit(1)).alias("c")))
    home = kept.join(counts, "token").groupBy("rep", "n").agg(F.max(F.struct("c", "token")).alias("home"))
    home = cut_lineage(home.select("rep", "n", F.col("home.token").alias("token")))
    sizes = home.groupBy("token").agg(F.sum("n").alias("size")).withColumn("parts", F.ceil(F.col("size") / BLOCK).cast("long"))
    blocks = max(1, -(-(home.agg(F.sum("n")).first()[0] or 0) // BLOCK)) * 4
    place = F.when(F.col("parts") > 1, F.xxhash64("token", F.pmod(F.xxhash64("rep"), F.col("parts")))).otherwise(F.pmod(F.xxhash64("token"), F.lit(blocks)))
    return home.join(sizes, "token").select("rep", place.alias("block"), (F.col("parts") > 1).alias("split"))


class Texts:
    """Texts by class: each class has the text of one of its documents."""

    def __init__(self, docs: DataFrame, picks: DataFrame, k: int):
        """picks: rep, doc_id, mark (of the text that stands for the class)."""
        self.docs, self.picks, self.k = docs.select("doc_id", "text"), picks, k

    def sets(self, wanted: DataFrame) -> DataFrame:
        """The rows of ``wanted`` (rep and others) with shingles: the set as bytes of sorted hashes.

        Up to MAX_BROADCAST rows are broadcast to the texts; more are joined by the documents' ids.
        """
        names = [c for c in wanted.columns if c != "rep"]
        kinds = ", ".join(f"{c} {t}" for c, t in wanted.select(*names).dtypes)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [s.tobytes() for s in shingle_sets(batch.column(batch.num_columns - 1).to_pylist(), k)]
            return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sets, pa.binary())], names=[*batch.schema.names[:-1], "shingles"])

        k, asked = self.k, cut_lineage(self.picks.join(wanted, "rep"))
        asked = F.broadcast(asked) if asked.count() <= MAX_BROADCAST else asked
        rows = self.docs.join(asked, "doc_id").filter(F.xxhash64("text") == F.col("mark"))
        return map_batches(rows.select("rep", *names, "text"), run, f"rep long, {kinds}, shingles binary")


def _sets(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint64) for b in column.to_pylist()]


def _pairs(found: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def block_links(texts: Texts, homes: DataFrame, like: Similarity) -> DataFrame:
    """a, b: links inside of each block."""

    def search(t: pa.Table) -> pa.Table:
        t = t.sort_by("rep")
        return _pairs(links_within(t.column("rep").to_numpy(), _sets(t.column("shingles")), like))

    return texts.sets(homes.select("rep", "block")).groupBy("block").applyInArrow(search, "a long, b long")


def visits_of(kept: DataFrame, placed: DataFrame, like: Similarity, searched: bool = True) -> DataFrame:
    """rep, label, block: the blocks that a set must visit.  placed: rep, block, label.  Sets visit their own block, too,
    if blocks were not ``searched`` each for itself."""
    rows = kept.join(placed, "rep")
    labels = rows.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("token").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count(F.lit(1)).alias("labels"))
    rows = cut_lineage(rows.join(labels.filter("labels > 1").drop("labels"), "token"))
    there = rows.groupBy("token", F.col("block").alias("to")).agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("label").alias("one"), F.max("label").alias("other"))
    asks = rows.filter("label <> main").select("token", "rep", "n", "label", "block", "need")
    near = (F.col("n") * like.q >= F.col("low") * like.p) & (F.col("n") * like.p <= F.col("high") * like.q)
    else_ = (F.col("one") != F.col("other")) | (F.col("one") != F.col("label"))
    met = asks.join(there, "token").filter(near & else_)
    met = met.filter(F.col("block") != F.col("to")) if searched else met
    # of the shingles that two sets share, at least one of them asks for half
    enough = met.groupBy("rep", "label", F.col("to").alias("block")).agg(F.count(F.lit(1)).alias("c"), F.first("need").alias("need")).filter("2 * c >= need")
    return enough.select("rep", "label", "block")


def visitors_links(texts: Texts, placed: DataFrame, visits: DataFrame, like: Similarity) -> DataFrame:
    """a, b: links between visitors and the blocks that they visit.  A block's sets come first and stay in memory, then
    its visitors by label."""
    hosts = placed.join(visits.select("block").distinct(), "block").select("rep", "block", "label", F.lit(0).alias("kind"))
    rows = texts.sets(hosts.unionByName(visits.select("rep", "block", "label", F.lit(1).alias("kind"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, home, block = None, [], None
        for batch in batches:
            found = []
            columns = (batch.column(c).to_pylist() for c in ("block", "kind", "rep", "label", "shingles"))
            for name, kind, rep, label, own in zip(*columns):
                if name != now:
                    now, home, block = name, [], None
                own = np.frombuffer(own, np.uint64)
                if kind == 0:
                    home.append((rep, label, own))
                    continue
                if block is None:
                    ids, labels, sets = zip(*home)
                    block, home = Block(np.array(ids), np.array(labels), list(sets), like), []
                found += block.visit(rep, label, own)
            if found:
                yield from _pairs(found).to_batches()

    dealt = rows.repartition("block").sortWithinPartitions("block", "kind", "label", "rep")
    return dealt.mapInArrow(run, "a long, b long")


def ngram_join(docs: DataFrame, k: int = 5, numerator: int = 80, denominator: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every document: those with ``denominator * common >= numerator * all``
    are linked, and component_id is the smallest doc_id reachable."""
    like = Similarity(numerator, denominator)
    signed = cut_lineage(signatures(docs, k))
    first = F.min(F.struct("doc_id", "mark")).alias("first")
    classes = cut_lineage(signed.filter("rep is not null and doc_id is not null").groupBy("rep").agg(first).select("rep", "first.doc_id", "first.mark"))
    texts = Texts(docs, classes, k)
    named = cut_lineage(named_shingles(docs, k, like))
    kept = each_token(pruned(named, like), "need")

    def labelled(links: DataFrame) -> DataFrame:
        return homes.join(components(links), F.col("rep") == F.col("node"), "left").select("rep", "block", "split", F.coalesce("component", "rep").alias("label"))

    homes = cut_lineage(homes_of(kept))
    links = cut_lineage(block_links(texts, homes, like))
    placed = cut_lineage(labelled(links))
    large = placed.filter("split")
    if not large.isEmpty():
        some = F.row_number().over(Window.partitionBy("label", "block").orderBy(F.xxhash64("rep"), "rep"))
        again = large.withColumn("place", some).filter(F.col("place") <= PIVOTS).select("rep")
        links = links.unionByName(cut_lineage(block_links(texts, homes_of(kept.join(again, "rep")), like)))
        placed = cut_lineage(labelled(links))
    visits = cut_lineage(visits_of(kept, placed.select("rep", "block", "label"), like))
    links = links.unionByName(cut_lineage(visitors_links(texts, placed, visits, like)))

    own = classes.select("rep", "doc_id").join(components(links), F.col("rep") == F.col("node"), "left").select("rep", "doc_id", F.coalesce("component", "rep").alias("component"))
    least = own.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    found = cut_lineage(own.join(least, "component").select("rep", "component_id"))
    out = signed.join(found, "rep", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-word shingles, similarity 0.85: doc_id, n_shingles, component_id of all ``documents``."""
    return ngram_join(table(spark, sf_dir, "documents"), 4, 85, 100)
