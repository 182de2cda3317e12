"""Nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

The tree is fitted on a bounded sample; every vector is then filed in the leaf that it reaches by going
to the nearest centre at each level.  A query walks the tree through a priority queue, closest branch
first, and visits leaves until the calibrated number is reached: ``calibrate`` compares a fixed number of
queries with all vectors and widens the visits until their mean recall is ``TARGET``.

Equal vectors are one class and searched once, so a frequent vector costs no more than a rare one: of a
class only its ``k + 1`` smallest ids can be among k nearest, all its queries share one search.  Leaves that
are neighbours in the tree share a shard of bounded size, crowded leaves are dealt over several; a query is
sent once to each shard with the leaves that it visits there, and k + 1 rows of it leave a shard.

The tree grows with the table up to ``SAMPLE`` sampled vectors; beyond, leaves hold more.  How much the
traversal saves depends on the vectors: where they lie evenly in all directions, recall takes visits to
about half of all leaves, so the work is then queries times vectors.

Vectors that are null, empty, zero, or hold nulls or non-finite components take no part.  Where lengths differ,
what a vector lacks counts as zero, so the product runs over the components that both have; all are then held
at the length of the longest.  Ties go to the smaller id.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import cut_lineage, drawn, table

K = 20
#: Vectors that the tree is fitted on, branches of a node, sampled vectors of a leaf at most.
SAMPLE, BRANCHES, LEAF = 100_000, 12, 96
#: Mean recall to reach in calibration, and its queries.
TARGET, CALIBRATION = 0.95, 128
#: Vectors of a shard and queries that one task compares, queries that it compares at a time, salts of a frequent vector.
SHARD, QUERY_BLOCK, AT_A_TIME, SALTS = 16_384, 512, 64, 64


class Tree:
    """centres[node] are those of its children, children[node] their nodes; a leaf has a number."""

    def __init__(self, sample: np.ndarray, branches: int = BRANCHES, leaf: int = LEAF, seed: int = 3):
        self.centres: dict[int, np.ndarray] = {}
        self.children: dict[int, list[int]] = {}
        self.leaf_of: dict[int, int] = {}
        rng, todo, made = np.random.default_rng(seed), [(0, sample)], 1
        while todo:
            node, x = todo.pop()
            parts = self._split(x, branches, rng) if len(x) > leaf else None
            if parts is None:
                self.leaf_of[node] = len(self.leaf_of)
                continue
            self.centres[node] = np.array([x[p].mean(axis=0) for p in parts])
            self.children[node] = list(range(made, made + len(parts)))
            todo += [(made + i, x[p]) for i, p in enumerate(parts)]
            made += len(parts)
        self.leaves = len(self.leaf_of)

    @staticmethod
    def _split(x: np.ndarray, branches: int, rng: np.random.Generator) -> list[np.ndarray] | None:
        """Row numbers of the k-means clusters of x, or None if it doesn't part."""
        distinct = np.unique(x, axis=0)
        if len(distinct) < 2:
            return None
        centres = distinct[rng.choice(len(distinct), min(branches, len(distinct)), replace=False)]
        for _ in range(12):
            near = nearest(x, centres)
            centres = np.array([x[near == i].mean(axis=0) for i in range(len(centres)) if (near == i).any()])
        near = nearest(x, centres)
        parts = [np.flatnonzero(near == i) for i in range(len(centres)) if (near == i).any()]
        return parts if len(parts) > 1 else None

    def file(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out, todo = np.zeros(len(x), np.int32), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node in self.leaf_of:
                out[rows] = self.leaf_of[node]
            else:
                near = nearest(x[rows], self.centres[node])
                todo += [(c, part) for i, c in enumerate(self.children[node]) if len(part := rows[near == i])]
        return out

    def visits(self, q: np.ndarray, sizes: np.ndarray, leaves: int, least: int) -> list[int]:
        """The leaves in the order of best-bin-first, until ``leaves`` with ``least`` vectors are visited."""
        heap, out, held = [(0.0, 0)], [], 0
        while heap and (len(out) < leaves or held < least):
            _, node = heapq.heappop(heap)
            if node in self.leaf_of:
                out.append(self.leaf_of[node])
                held += int(sizes[out[-1]])
            else:
                for c, s in zip(self.children[node], (self.centres[node] @ q).tolist()):
                    heapq.heappush(heap, (-s, c))
        return out


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)


def best(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, s: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score): the k rows of x with the largest inner product with each q.

    Block products choose the candidates; the score is summed again row by row, so that it doesn't hang on
    the block.  ``s`` are the products, -inf where they aren't wanted.
    """
    s = q @ x.T if s is None else s
    limit = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
    limit = np.where(np.isfinite(limit), limit - 1e-9 * np.maximum(1, np.abs(limit)), limit)
    rows, columns = np.nonzero((s >= limit[:, None]) & (s > -np.inf))
    score = np.concatenate([(q[rows[i : i + 65536]] * x[columns[i : i + 65536]]).sum(axis=1) for i in range(0, len(rows), 65536)] or [np.zeros(0)])
    order = np.lexsort((ids[columns], -score, rows))
    rows, columns, score = rows[order], columns[order], score[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[place < k], ids[columns[place < k]], score[place < k]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v array<double>, key of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    limits = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select("vec_id", v.alias("v")).filter("vec_id is not null and v is not null").filter(limits)
    lengths = rows.agg(F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most")).first()
    if lengths.least != lengths.most:
        rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(lengths.most) - F.size("v"))))
    return rows.withColumn("key", F.xxhash64("v"))


def classes_of(rows: DataFrame, k: int) -> DataFrame:
    """key, v, cid (smallest id), ids (the k + 1 smallest ids) of each distinct vector."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    first = salted.withColumn("n", F.row_number().over(Window.partitionBy("key", "v", "salt").orderBy("vec_id"))).filter(F.col("n") <= k + 1)
    ids = F.slice(F.array_sort(F.array_distinct(F.collect_list("vec_id"))), 1, k + 1)
    return first.groupBy("key", "v").agg(ids.alias("ids")).withColumn("cid", F.element_at("ids", 1))


def exact_neighbours(points: DataFrame, queries: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """qid, cid, score, leaf: the k best of all points for a fixed number of queries, by comparison with all."""
    shared = points.sparkSession.sparkContext.broadcast((np.array([q for q, _ in queries]), np.array([v for _, v in queries])))

    def compare(batches):
        qids, q = shared.value
        for pdf in batches:
            if len(pdf):
                rows, at, score = best(q, _matrix(pdf["v"]), np.arange(len(pdf)), k)
                yield pd.DataFrame({"qid": qids[rows], "cid": pdf["cid"].to_numpy()[at], "score": score, "leaf": pdf["leaf"].to_numpy()[at]})

    found = points.select("cid", "v", "leaf").mapInPandas(compare, "qid long, cid long, score double, leaf int")
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "cid"))
    return found.withColumn("place", place).filter(F.col("place") <= k).drop("place")


def calibrate(tree: Tree, points: DataFrame, sizes: np.ndarray, queries: list[tuple[int, list[float]]], k: int, target: float = TARGET) -> int:
    """The least number of leaf visits with which the mean recall of the queries is ``target``."""
    if not queries:
        return 1
    orders = {q: {leaf: i for i, leaf in enumerate(tree.visits(np.array(v), sizes, tree.leaves, 0))} for q, v in queries}
    ranks = [orders[r.qid][r.leaf] for r in exact_neighbours(points, queries, k).select("qid", "leaf").collect()]
    found = np.cumsum(np.bincount(ranks, minlength=tree.leaves)) / max(1, len(ranks))
    return int(np.searchsorted(found, min(target, found[-1]))) + 1


def deal_out(sizes: np.ndarray, most: int = SHARD) -> tuple[np.ndarray, np.ndarray, int]:
    """(first shard, number of shards of each leaf, number of all): leaves of over ``most`` vectors have
    shards of their own, the others share one with their neighbours."""
    first, parts, shard, held = np.zeros(len(sizes), np.int64), np.maximum(1, -(-sizes // most)), 0, 0
    for leaf, size in enumerate(sizes.tolist()):
        if held and (size > most or held + size > most):
            shard, held = shard + 1, 0
        first[leaf] = shard
        if size > most:
            shard += int(parts[leaf])
        else:
            held += size
    return first, parts, shard + 1


def compare(p: pd.DataFrame, q: pd.DataFrame, k: int) -> pd.DataFrame:
    """qid, cid, score: the k best of a shard for each query, among the leaves that it visits."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    if len(p) and len(q):
        p = p.sort_values("leaf", kind="stable")
        x, ids, leaf = _matrix(p["v"]), p["cid"].to_numpy(), p["leaf"].to_numpy()
        own, starts = np.unique(leaf, return_index=True)
        ends = [*starts[1:].tolist(), len(leaf)]
        for at in range(0, len(q), AT_A_TIME):
            some = q.iloc[at : at + AT_A_TIME]
            v, s = _matrix(some["v"]), np.full((len(some), len(x)), -np.inf)
            to = np.repeat(np.arange(len(some)), some["leaves"].map(len))
            at_leaf = np.searchsorted(own, np.concatenate(some["leaves"].to_list()))
            for i, (low, high) in enumerate(zip(starts.tolist(), ends)):
                rows = to[at_leaf == i]
                s[rows, low:high] = v[rows] @ x[low:high].T
            rows, found, score = best(v, x, ids, k, s)
            out.append((some["qid"].to_numpy()[rows], found, score))
    return pd.DataFrame(dict(zip(("qid", "cid", "score"), map(np.concatenate, zip(*out)))))


def search(vectors: DataFrame, is_query, k: int = K, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest vectors found for every row where ``is_query``."""
    spark = vectors.sparkSession
    rows = usable(vectors.select("vec_id", "embedding"))
    n = rows.count()
    sample = rows.filter(drawn("tree", "vec_id") <= min(1.0, SAMPLE / max(n, 1))).select("v").toArrow().to_pandas()
    tree = Tree(_matrix(sample["v"]) if len(sample) else np.zeros((0, 1)))
    shared = spark.sparkContext.broadcast(tree)

    @F.pandas_udf("int")
    def leaf_of(v: pd.Series) -> pd.Series:
        return pd.Series(shared.value.file(_matrix(v)) if len(v) else np.zeros(0, np.int32))

    points = cut_lineage(classes_of(rows, k).withColumn("leaf", leaf_of("v")))
    sizes = np.zeros(tree.leaves, np.int64)
    for r in points.groupBy("leaf").count().collect():
        sizes[r.leaf] = r["count"]
    first, parts, _ = deal_out(sizes)
    asked = cut_lineage(rows.filter(is_query).select("key", "v").distinct().join(points.select("key", "v", "cid"), ["key", "v"]).select(F.col("cid").alias("qid"), "v"))
    trial = [(r.qid, list(r.v)) for r in asked.orderBy(F.xxhash64("qid")).limit(CALIBRATION).collect()]
    leaves = calibrate(tree, points, sizes, trial, k, target)

    def route(batches):
        for pdf in batches:
            out = []
            for qid, v in zip(pdf["qid"], pdf["v"]):
                to: dict[int, list[int]] = {}
                for leaf in shared.value.visits(v, sizes, leaves, 4 * k):
                    for shard in range(first[leaf], first[leaf] + parts[leaf]):
                        to.setdefault(shard, []).append(leaf)
                out += [(qid, v, shard, own) for shard, own in to.items()]
            yield pd.DataFrame(out, columns=["qid", "v", "shard", "leaves"])

    routed = cut_lineage(asked.mapInPandas(route, "qid long, v array<double>, shard long, leaves array<int>"))
    crowds = F.broadcast(routed.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("crowds")))  # a row for each shard
    dealt = F.broadcast(spark.createDataFrame([(leaf, int(first[leaf]), int(parts[leaf])) for leaf in range(tree.leaves)], "leaf int, first long, parts long"))
    held = points.join(dealt, "leaf").select("cid", "v", "leaf", (F.col("first") + F.pmod(F.xxhash64("cid"), F.col("parts"))).alias("shard"))
    left = held.join(crowds, "shard").select("cid", "v", "leaf", "shard", F.explode(F.sequence(F.lit(0), F.col("crowds") - 1)).alias("crowd"))
    right = routed.join(crowds, "shard").select("qid", "v", "leaves", "shard", F.pmod(F.xxhash64("qid"), F.col("crowds")).cast("int").alias("crowd"))
    keys = ("shard", "crowd")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda p, q: compare(p, q, k + 1), "qid long, cid long, score double")
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "cid"))
    top = found.withColumn("place", place).filter(F.col("place") <= k + 1).join(points.select("cid", "ids"), "cid")
    members = top.select("qid", "score", F.explode("ids").alias("vec_id"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))
    lists = members.withColumn("place", place).filter(F.col("place") <= k + 1).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("near"))
    lists = cut_lineage(lists.join(points.select(F.col("cid").alias("qid"), "key", "v"), "qid").select("key", "v", "near"))
    each = rows.filter(is_query).select(F.col("vec_id").alias("query_id"), "key", "v").join(lists, ["key", "v"])
    own = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return each.select("query_id", F.posexplode(own).alias("i", "x")).select("query_id", (F.col("i") + 1).alias("rank"), "x.vec_id", "x.score")


def op2_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 20 nearest rows of ``embeddings`` for each row whose vec_id is divisible by 20."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
