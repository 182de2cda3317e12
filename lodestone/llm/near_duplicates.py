"""Near-duplicate documents by a chosen-path set similarity join.

A document is its set of word shingles; equal sets are one class, and one member stands for it.  A set
is embedded as COORDINATES minwise tokens.  In each of several independent trees a node samples BRANCHES of
the coordinates, and a document goes down one branch for each, named by its token there: at similarity s
two documents share 3s branches of each node in the mean, over two at 0.8, so a common path hardly ever
dies out ((1 - s) ** 3 for a level: 0.8 % at 0.8, and trees are repeated).  Nodes with few
documents are compared exhaustively, larger ones branch again.  Documents that still share a node after the
last level are dealt into blocks, and the documents with the highest average similarity to the node
(estimated from the minwise tokens) join every block of it.

A node that doesn't shrink (a template with many copies) may part similar documents there.  So that no link is
missed, an exact check follows, that of ``ngram_join``: each set has a home by a rare shingle, and visits the homes of
sets of other components with which it shares enough of its rare shingles.  No pairs are made on the way, so a passage that
many documents share costs their number.  Every link is confirmed on the full sets.  Links within a group are only sought
until the group hangs together, as components are what counts.

Null, empty and wordless texts have an empty set and are linked with nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import cut_lineage, map_batches, table
from lodestone.llm.components import components
from lodestone.llm.hashing import mixed, shingle_sets
from lodestone.llm.ngram_join import Similarity, Texts, class_key, each_token, homes_of, named_shingles, pruned, visitors_links, visits_of

TREES, LEVELS, SMALL = 2, 3, 200
#: Minwise tokens of a set, and how many of them a node samples.
COORDINATES, BRANCHES = 24, 3
#: Documents per oversize node that join all of its blocks.
PIVOTS = 8


def minwise(shingles: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The least 32-bit hash of the set under each seed."""
    least = np.full(len(seeds), 2**32 - 1, np.uint64)
    for at in range(0, len(shingles), 1 << 14):
        least = np.minimum(least, (mixed(shingles[at : at + (1 << 14), None] ^ seeds) >> np.uint64(32)).min(axis=0))
    return least.astype(np.uint32).view(np.int32)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, mark (a hash of the text), n_shingles, set_key (equal for equal sets, null for empty ones), minwise array<int>."""
    seeds = np.random.default_rng(7).integers(0, 2**63, COORDINATES, dtype=np.uint64)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, keys, least = [], [], []
        for s in shingle_sets(batch.column(2).to_pylist(), k):
            sizes.append(len(s))
            keys.append(class_key(s) if len(s) else None)
            least.append(minwise(s, seeds) if len(s) else None)
        columns = [*batch.columns[:2], pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(least, pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "n_shingles", "set_key", "minwise"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    return map_batches(rows, run, "doc_id long, mark long, n_shingles long, set_key long, minwise array<int>")


def _blocks(node_rows: DataFrame, counts: DataFrame, small: int) -> DataFrame:
    """Oversize nodes dealt into blocks, their pivots in all of them: (tree, node, rep)."""
    rows = cut_lineage(node_rows.join(counts, ["tree", "node"]).withColumn("blocks", F.ceil(F.col("n") / small).cast("long")))
    if rows.isEmpty():
        return rows.select("tree", "node", "rep")
    places = rows.select("tree", "node", "rep", F.posexplode("minwise").alias("place", "value"))
    shared = cut_lineage(places.groupBy("tree", "node", "place", "value").agg(F.count(F.lit(1)).alias("c")))
    closeness = places.join(shared, ["tree", "node", "place", "value"]).groupBy("tree", "node", "rep").agg(F.sum("c").alias("close"))
    best = closeness.groupBy("tree", "node", F.pmod(F.xxhash64("rep"), F.lit(PIVOTS)).alias("part")).agg(F.max_by("rep", F.struct("close", "rep")).alias("rep"))
    pivots = best.join(counts, ["tree", "node"]).select("tree", "node", "rep", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / small).cast("long") - 1)).alias("block"))
    own = rows.select("tree", "node", "rep", F.pmod(F.xxhash64("rep", "tree"), F.col("blocks")).alias("block"))
    return own.unionByName(pivots).distinct().select("tree", F.xxhash64("node", "block").alias("node"), "rep")


def small_groups(reps: DataFrame, trees: int = TREES, levels: int = LEVELS, small: int = SMALL) -> DataFrame:
    """gid, rep: the groups that are compared exhaustively.  reps: rep, minwise.

    The same group found in several trees is given once.
    """
    spark = reps.sparkSession
    at = reps.select("rep", "minwise", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), F.lit(0).cast("long").alias("node"))
    share = COORDINATES // BRANCHES
    sampled = [F.lit(j * share) + F.pmod(F.xxhash64("tree", "node", F.lit(j)), F.lit(share)).cast("int") for j in range(BRANCHES)]
    branches = F.explode(F.array(*(F.xxhash64("node", i, F.get("minwise", i)) for i in sampled))).alias("node")
    leaves = spark.createDataFrame([], "tree int, node long, rep long")
    for level in range(levels):
        at = at.select("rep", "minwise", "tree", branches)
        counts = cut_lineage(at.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
        leaves = leaves.unionByName(at.join(counts.filter(F.col("n") <= small), ["tree", "node"]).select("tree", "node", "rep"))
        large = counts.filter(F.col("n") > small)
        if level + 1 < levels:
            # only what stays in large nodes is joined with its minwise tokens again
            at = cut_lineage(at.select("rep", "tree", "node").join(large.drop("n"), ["tree", "node"]).join(reps, "rep").select(*at.columns))
            if at.isEmpty():
                break
        else:
            leaves = leaves.unionByName(_blocks(at, large, small))
    groups = leaves.groupBy("tree", "node").agg(F.sort_array(F.collect_set("rep")).alias("members")).filter(F.size("members") > 1)
    return groups.select("members").distinct().select(F.xxhash64("members").alias("gid"), F.explode("members").alias("rep"))


def by_group(rows: DataFrame, fn: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``fn`` on many whole groups (gid) at a time, their rows by gid and rep; most groups are too small to be passed alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            got = pa.Table.from_batches([batch])
            got = got if held is None else pa.concat_tables([held, got])
            gid = got.column("gid").to_numpy()
            cut = int(np.searchsorted(gid, gid[-1])) if len(gid) else 0
            if cut:
                yield from fn(got.slice(0, cut))
            held = got.slice(cut)
        if held is not None and held.num_rows:
            yield from fn(held)

    return rows.repartition("gid").sortWithinPartitions("gid", "rep").mapInArrow(run, schema)


def _edges(gid: np.ndarray) -> list[tuple[int, int]]:
    starts = np.flatnonzero(np.append(True, gid[1:] != gid[:-1]))
    return list(zip(starts.tolist(), [*starts[1:].tolist(), len(gid)]))


def likely_members(groups: DataFrame, reps: DataFrame, similarity: float) -> DataFrame:
    """The rows of ``groups`` without members that are like no other one.

    Of two sets at the similarity, each minwise value agrees with that probability; members stay whose
    best partner in the group agrees in at least the mean less 6 standard deviations of the values (of 24 values at 0.85, ten: 1e-7 are lost).
    """
    least = COORDINATES * similarity - 6 * np.sqrt(COORDINATES * similarity * (1 - similarity))

    def sift(t: pa.Table) -> Iterator[pa.RecordBatch]:
        gid = t.column("gid").to_numpy()
        v = np.concatenate([c.flatten().to_numpy() for c in t.column("minwise").chunks]).reshape(len(gid), -1)
        keep = np.zeros(len(v), bool)
        for a, b in _edges(gid):
            if b - a == 2:
                keep[a:b] = (v[a] == v[a + 1]).sum() >= least
                continue
            for i in range(a, b - 1):
                like = (v[i + 1 : b] == v[i]).sum(axis=1) >= least
                keep[i] |= like.any()
                keep[i + 1 : b] |= like
        yield from t.select(["gid", "rep"]).filter(pa.array(keep)).to_batches()

    return by_group(groups.join(reps, "rep").select("gid", "rep", "minwise"), sift, "gid long, rep long")


def _spanning_links(ids: np.ndarray, sets: list[np.ndarray], like: Similarity) -> list[tuple[int, int]]:
    """Links that hold the group's components together; every pair not yet joined is compared."""
    sizes = np.array([len(s) for s in sets])
    if len(sets) == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(int(ids[0]), int(ids[1]))] if like.linked(common, *sizes.tolist()) else []
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    own = [codes[starts[i] : starts[i + 1]] for i in range(len(sets))]
    mark, rest, links = np.zeros(codes.max() + 1, np.int32), np.arange(len(sets)), []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            near = rest[np.minimum(sizes[rest], sizes[i]) * like.q >= np.maximum(sizes[rest], sizes[i]) * like.p]
            if not len(near):
                continue
            mark[own[i]] = 1
            both = np.add.reduceat(mark[np.concatenate([own[j] for j in near])], np.concatenate([[0], np.cumsum(sizes[near])[:-1]]))
            mark[own[i]] = 0
            found = near[like.linked(both, sizes[i], sizes[near])]
            links += [(int(ids[i]), int(ids[j])) for j in found]
            queue += found.tolist()
            rest = np.setdiff1d(rest, found, assume_unique=True)
    return links


def confirmed_links(texts: Texts, groups: DataFrame, like: Similarity) -> DataFrame:
    """a, b: links of each group, confirmed on the full sets of its members."""

    def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
        rep, column, links = t.column("rep").to_numpy(), t.column("shingles").to_pylist(), []
        for a, b in _edges(t.column("gid").to_numpy()):
            mine = [i for i in range(a, b) if i == a or rep[i] != rep[i - 1]]  # rows that are repeated whole count once
            if len(mine) > 1:
                links += _spanning_links(rep[mine], [np.frombuffer(column[i], np.uint64) for i in mine], like)
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["a", "b"])

    return by_group(texts.sets(groups), compare, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, numerator: int = 80, denominator: int = 100, trees: int = TREES, levels: int = LEVELS, small: int = SMALL) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document.

    Documents whose sets have ``denominator * common >= numerator * all`` are linked; component_id is the
    smallest doc_id reachable.  Equal sets are one class; rows of one id with other texts each keep their own.
    """
    like = Similarity(numerator, denominator)
    signed = cut_lineage(signatures(docs, k))
    first = F.min(F.struct("doc_id", "mark")).alias("first")
    some = signed.filter("set_key is not null and doc_id is not null")
    classes = cut_lineage(some.groupBy(F.col("set_key").alias("rep")).agg(first, F.any_value("minwise").alias("minwise")).select("rep", "first.doc_id", "first.mark", "minwise"))
    texts, reps = Texts(docs, classes.drop("minwise"), k), classes.select("rep", "minwise")
    groups = cut_lineage(likely_members(small_groups(reps, trees, levels, small), reps, numerator / denominator))
    links = cut_lineage(confirmed_links(texts, groups, like))

    # named shingles are made twice, which is cheaper than the disk that they would take
    kept = each_token(pruned(named_shingles(docs, k, like), like), "need")
    homes = homes_of(kept).drop("split").join(components(links), F.col("rep") == F.col("node"), "left")
    placed = cut_lineage(homes.select("rep", "block", F.coalesce("component", "rep").alias("label")))
    visits = cut_lineage(visits_of(kept, placed, like, searched=False))
    links = links.unionByName(cut_lineage(visitors_links(texts, placed, visits, like)))

    own = classes.select("rep", "doc_id").join(components(links), F.col("rep") == F.col("node"), "left").select("rep", "doc_id", F.coalesce("component", "rep").alias("label"))
    named = cut_lineage(own.join(own.groupBy("label").agg(F.min("doc_id").alias("component_id")), "label").select(F.col("rep").alias("set_key"), "component_id"))
    out = signed.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, similarity 0.85: doc_id, n_shingles, component_id, kept."""
    return near_duplicates(table(spark, sf_dir, "documents"), 3, 85, 100)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group (five words, 0.8), columns as they came."""
    gone = near_duplicates(docs.filter(F.col("doc_id").isNotNull()), 5, 80, 100).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
