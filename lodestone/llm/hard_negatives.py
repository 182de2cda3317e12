"""Hard negatives by exact search in k-means inverted lists.

Vectors are filed in lists by their nearest centroid, and each list keeps the greatest distance of a member to
it, its radius.  No member x of a list scores outside ``q.c - |q| r <= q.x <= q.c + |q| r`` (Cauchy-Schwarz), so a
query visits the lists by falling upper bound, skips those that lie outside the window of scores it asks for, and
stops when the bound falls strictly below its k-th best score; a tie is still visited, as the smaller id wins.  The
result is exact for any centroids: they decide speed only, and are fitted on a bounded sample.

Lists are dealt into shards of bounded bytes.  A shard's vectors are sorted to the front of their partition and
stay in memory while the queries that need it stream past, so a vector is moved once a pass and a query once for
each shard that may hold a result.  A query starts with the k-th best score among the sample, which spares it most
shards where the vectors allow it; where they lie evenly in all directions, it goes to nearly all, and the work is
queries times vectors.

There are two passes: the positives of each anchor, then for each different score of a positive its negatives.
Rows with equal vectors and labels are one class, searched once: of its ids only the smallest can be among the
first, and all its anchors share one search.

Defined results: rows without an id take no part; a row that is repeated as it is counts once; rows of one id with
other vectors or labels are rows of their own, except that none is a positive of an anchor of its id.  Vectors of
different lengths have no inner product and are searched apart.  Scores are exact whole numbers; one that doesn't
fit 64 bits is an error.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import cut_lineage, drawn, table

#: Bytes of the sample that the centroids are fitted on (of which the first score of a query is taken, too), lists
#: for each length of vectors at most.
SAMPLE_BYTES, LISTS = 16 << 20, 512
#: Vectors of a shard at least, its bytes at most, and how many shards a small table is dealt into.
LEAST_SHARD, SHARD_BYTES, SHARDS = 4_096, 64 << 20, 64
#: Queries that are compared at a time, salts of a frequent class.
AT_A_TIME, SALTS = 256, 64
LOWEST, HIGHEST = -(2**63), 2**63 - 1
_QUERY = "pid long, d int, label long, v array<long>, lo array<long>, hi array<long>"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v array<long> (256 times each component, rounded down), d (length) of rows that take part."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select("vec_id", F.col("label").cast("long").alias("label"), x.alias("x")).filter("vec_id is not null and label is not null and x is not null").filter(fine)
    return rows.select("vec_id", "label", F.transform("x", lambda c: F.floor(c * 256)).alias("v"), F.size("x").alias("d"))


def classes_of(rows: DataFrame, k: int) -> DataFrame:
    """label, v, d, ids (the k smallest) of each distinct pair of label and vector."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    place = F.row_number().over(Window.partitionBy("label", "v", "d", "salt").orderBy("vec_id"))
    first = salted.withColumn("place", place).filter(F.col("place") <= k)
    return first.groupBy("label", "v", "d").agg(F.slice(F.sort_array(F.collect_set("vec_id")), 1, k).alias("ids"))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """The vectors of an Arrow column of lists, all of length d."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), d)


def centroids_of(x: np.ndarray, lists: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """k-means centroids of the rows of x."""
    distinct = np.unique(x, axis=0).astype(np.float64)
    centres = distinct[np.random.default_rng(seed).choice(len(distinct), min(lists, len(distinct)), replace=False)]
    for _ in range(rounds if len(distinct) > lists else 0):
        near, _ = nearest(distinct, centres)
        centres = np.array([distinct[near == i].mean(axis=0) for i in range(len(centres)) if (near == i).any()])
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, and how far it is."""
    near, far = np.zeros(len(x), np.int64), np.zeros(len(x))
    for at in range(0, len(x), 4096):
        part = x[at : at + 4096].astype(np.float64)
        own = (part @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
        near[at : at + 4096], far[at : at + 4096] = own, np.sqrt(((part - centres[own]) ** 2).sum(axis=1))
    return near, far


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: in doubles where they can't round, else in Python's integers."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1]) < 2**53:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    wide = q.astype(object) @ x.T.astype(object)
    return np.array([[_within(s) for s in row] for row in wide], np.int64).reshape(wide.shape)


def _within(score: int) -> int:
    if not LOWEST <= score <= HIGHEST:
        raise OverflowError("an inner product does not fit 64 bits")
    return score


def bounds(q: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bound of the scores of each query with the members of each list, with room for rounding."""
    q = q.astype(np.float64)
    length = np.sqrt((q**2).sum(axis=1))[:, None]
    middle, spread = q @ centres.T, length * radii
    spread = spread + 1e-9 * (length * (np.sqrt((centres**2).sum(axis=1)) + radii) + 1)
    if (middle - spread > HIGHEST).any() or (middle + spread < LOWEST).any():
        raise OverflowError("an inner product does not fit 64 bits")
    return middle - spread, middle + spread


class Shard:
    """Vectors in lists, with their labels and ids; ``first`` (the smallest id) orders equal scores."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, first: np.ndarray, lists: np.ndarray, centres: np.ndarray):
        order = np.lexsort((first, lists))
        self.x, self.labels, self.first, self.order = x[order], labels[order], first[order], order
        own, starts = np.unique(lists[order], return_index=True)
        self.spans = list(zip(starts.tolist(), [*starts[1:].tolist(), len(order)]))
        self.centres = centres[own]
        far = [np.sqrt(((self.x[a:b] - c) ** 2).sum(axis=1)).max() for (a, b), c in zip(self.spans, self.centres)]
        self.radii = np.array(far)

    def search(self, q: np.ndarray, labels: np.ndarray, to: np.ndarray, lo: np.ndarray, hi: np.ndarray, same: bool, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, row of the shard, score): for each window the k best scores from lo to hi, best first.

        Window w asks for query ``to[w]``; ``same``: members of the query's label, else of the others.
        """
        lower, upper = bounds(q, self.centres, self.radii)
        visits = np.argsort(-upper, axis=1, kind="stable")
        least = lo.copy()
        found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        for turn in range(len(self.spans)):
            at = visits[to, turn]
            going = upper[to, at] >= least  # bounds only fall, so the others are done
            if not going.any():
                break
            going &= lower[to, at] <= hi
            new = [found]
            for i in np.unique(at[going]).tolist():
                windows, (a, b) = np.flatnonzero(going & (at == i)), self.spans[i]
                asked, inverse = np.unique(to[windows], return_inverse=True)
                s = products(q[asked], self.x[a:b])[inverse]
                fits = (s >= least[windows, None]) & (s <= hi[windows, None]) & ((self.labels[a:b] == labels[to[windows], None]) == same)
                w, c = np.nonzero(fits)
                new.append((windows[w], c + a, s[w, c]))
            w, rows, score = map(np.concatenate, zip(*new))
            order = np.lexsort((self.first[rows], -score, w))
            w, rows, score = w[order], rows[order], score[order]
            place = np.arange(len(w)) - np.searchsorted(w, w)
            found = w[place < k], rows[place < k], score[place < k]
            full = place == k - 1
            least[w[full]] = score[full]
        return found


class Index:
    """Centroids by length of vectors, radius and shards of each list, and the sample; bounded, sent to all tasks."""

    def __init__(self, samples: dict[int, tuple[np.ndarray, np.ndarray]], n: dict[int, int]):
        self.samples, self.n = samples, n
        self.centres = {d: centroids_of(x, min(LISTS, int(np.ceil(np.sqrt(n[d]))))) for d, (x, _) in samples.items()}
        self.radii = {d: np.zeros(len(c)) for d, c in self.centres.items()}
        self.first: dict[int, np.ndarray] = {}
        self.parts: dict[int, np.ndarray] = {}
        self.shards = 0

    def deal(self, d: int, sizes: np.ndarray, radii: np.ndarray) -> None:
        """Gives the lists of a length their shards: neighbours share one, large lists have several."""
        most = max(LEAST_SHARD, min(SHARD_BYTES // (8 * max(1, d)), -(-int(sizes.sum()) // SHARDS)))
        self.radii[d], self.parts[d], self.first[d] = radii, np.maximum(1, -(-sizes // most)), np.zeros(len(sizes), np.int64)
        held = 0
        for i, size in enumerate(sizes.tolist()):
            if held and held + size > most:
                self.shards, held = self.shards + 1, 0
            self.first[d][i] = self.shards
            if size > most:
                self.shards += int(self.parts[d][i])
            else:
                held += size
        self.shards += 1

    def sampled(self, d: int) -> Shard:
        x, labels = self.samples[d]
        return Shard(x, labels, np.arange(len(x)), nearest(x, self.centres[d])[0], self.centres[d])


def _lists_of(points: DataFrame, shared) -> DataFrame:
    """points with list and far (distance to its centroid)."""

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, v = batch.column("d").to_numpy(), batch.column("v")
            near, far = np.zeros(len(size), np.int32), np.zeros(len(size))
            for d in np.unique(size).tolist():
                rows = np.flatnonzero(size == d)
                near[rows], far[rows] = nearest(matrix(v.take(pa.array(rows)), d), shared.value.centres[d])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near), pa.array(far)], names=[*batch.schema.names, "list", "far"])

    return points.mapInArrow(file, "label long, v array<long>, d int, ids array<long>, list int, far double")


def build_index(classes: DataFrame) -> tuple[DataFrame, object]:
    """(points: pid, label, v, d, ids, list, shard; the index as a broadcast)."""
    spark = classes.sparkSession
    rows = cut_lineage(classes)
    n = {r.d: r["count"] for r in rows.groupBy("d").count().collect()}
    samples = {}
    for d, count in n.items():
        share = min(1.0, SAMPLE_BYTES / (8 * max(1, d)) / count)
        taken = rows.filter((F.col("d") == d) & ((drawn("lists", "label", "v") <= share) | (F.lit(count) <= 64))).select("v", "label").toArrow()
        if not taken.num_rows:
            taken = rows.filter(F.col("d") == d).select("v", "label").limit(64).toArrow()
        samples[d] = (matrix(taken.column("v"), d), taken.column("label").to_numpy())
    index = Index(samples, n)
    filed = cut_lineage(_lists_of(rows, spark.sparkContext.broadcast(index)).withColumn("pid", F.monotonically_increasing_id()))
    stats = {(r.d, r.list): (r.n, r.radius) for r in filed.groupBy("d", "list").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).collect()}
    dealt = []
    for d, centres in index.centres.items():
        own = [stats.get((d, i), (0, 0.0)) for i in range(len(centres))]
        index.deal(d, np.array([s[0] for s in own]), np.array([s[1] for s in own]))
        dealt += [(d, i, int(index.first[d][i]), int(index.parts[d][i])) for i in range(len(centres))]
    places = F.broadcast(spark.createDataFrame(dealt, "d int, list int, first long, parts long"))  # LISTS rows for each length
    shard = F.col("first") + F.pmod(F.xxhash64("pid"), F.col("parts"))
    return filed.join(places, ["d", "list"]).select("pid", "label", "v", "d", "ids", "list", shard.alias("shard")), spark.sparkContext.broadcast(index)


def _windows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, lo, hi) of the windows that the rows of a batch ask for."""
    lo, hi = batch.column("lo"), batch.column("hi")
    counts = lo.value_lengths().to_numpy()
    return np.repeat(np.arange(len(counts)), counts), lo.flatten().to_numpy(), hi.flatten().to_numpy()


def _route(asked: DataFrame, shared, same: bool, k: int) -> DataFrame:
    """The queries of ``asked`` (_QUERY), once for each shard that may hold a result, with raised lower ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, known = shared.value, {}
        for batch in (b.slice(at, AT_A_TIME) for b in batches for at in range(0, b.num_rows, AT_A_TIME)):
            size = batch.column("d").to_numpy()
            for d in np.unique(size).tolist():
                some = batch.take(pa.array(np.flatnonzero(size == d)))
                known[d] = known.get(d) or index.sampled(d)
                q, (to, lo, hi) = matrix(some.column("v"), d), _windows(some)
                w, _, score = known[d].search(q, some.column("label").to_numpy(), to, lo, hi, same, k)
                place = np.arange(len(w)) - np.searchsorted(w, w)
                lo = lo.copy()
                lo[w[place == k - 1]] = score[place == k - 1]  # the k-th best of some is no better than that of all
                lower, upper = bounds(q, index.centres[d], index.radii[d])
                visits = (upper[to] >= lo[:, None]) & (lower[to] <= hi[:, None])
                goes = np.zeros((len(q), index.shards), bool)
                for i, (first, parts) in enumerate(zip(index.first[d].tolist(), index.parts[d].tolist())):
                    goes[to[visits[:, i]], first : first + parts] = True
                rows, shards = np.nonzero(goes)
                offsets = np.concatenate([[0], np.cumsum(np.bincount(to, minlength=len(q)))]).astype(np.int32)
                raised = pa.ListArray.from_arrays(pa.array(offsets), pa.array(lo))
                columns = {**dict(zip(some.schema.names, some.columns)), "lo": raised}
                out = pa.RecordBatch.from_pydict({n: columns[n] for n in some.schema.names}).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(shards, pa.int64())], names=[*out.schema.names, "shard"])

    return asked.mapInArrow(run, f"{_QUERY}, shard long")


def _search(points: DataFrame, asked: DataFrame, shared, same: bool, k: int) -> DataFrame:
    """pid, window (its number), score, ids: what each shard has for each window, k rows at most."""
    kind, nothing = F.lit(0).alias("kind"), F.lit(None).cast("array<long>")
    held = points.select("shard", kind, "pid", "d", "label", "v", nothing.alias("lo"), nothing.alias("hi"), "ids", "list")
    routed = _route(asked, shared, same, k).select("shard", F.lit(1).alias("kind"), "pid", "d", "label", "v", "lo", "hi", nothing.alias("ids"), F.lit(None).cast("int").alias("list"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, shard, ids = None, [], None, None
        for whole in batches:
            cuts = np.flatnonzero(np.diff(whole.column("shard").to_numpy()) | np.diff(whole.column("kind").to_numpy())) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), whole.num_rows]):
                batch = whole.slice(a, b - a)
                name, is_query = batch.column("shard")[0].as_py(), batch.column("kind")[0].as_py()
                if name != now:
                    now, parts, shard = name, [], None
                if not is_query:
                    parts.append(batch)
                    continue
                if shard is None and not parts:
                    continue  # only lists without members lie here
                if shard is None:
                    t = pa.Table.from_batches(parts)
                    ids = t.column("ids").combine_chunks()
                    d, parts = t.column("d")[0].as_py(), []
                    first = ids.flatten().to_numpy()[ids.offsets.to_numpy()[:-1] - ids.offsets.to_numpy()[0]]
                    shard = Shard(matrix(t.column("v"), d), t.column("label").to_numpy(), first, t.column("list").to_numpy(), shared.value.centres[d])
                for at in range(0, batch.num_rows, AT_A_TIME):
                    some = batch.slice(at, AT_A_TIME)
                    to, lo, hi = _windows(some)
                    w, rows, score = shard.search(matrix(some.column("v"), d), some.column("label").to_numpy(), to, lo, hi, same, k)
                    number = np.arange(len(to)) - np.searchsorted(to, to)
                    out = [pa.array(some.column("pid").to_numpy()[to[w]]), pa.array(number[w].astype(np.int32)), pa.array(score), ids.take(pa.array(shard.order[rows]))]
                    yield pa.RecordBatch.from_arrays(out, names=["pid", "window", "score", "ids"])

    dealt = held.unionByName(routed).repartition("shard").sortWithinPartitions("shard", "kind")
    return dealt.mapInArrow(run, "pid long, window int, score long, ids array<long>")


def _first(found: DataFrame, k: int) -> DataFrame:
    """pid, window, best array<struct<place, score, vec_id>>: the k best members over all shards."""
    by = Window.partitionBy("pid", "window")
    some = found.withColumn("place", F.row_number().over(by.orderBy(F.desc("score"), F.col("ids")[0]))).filter(F.col("place") <= k)
    each = some.select("pid", "window", "score", F.explode("ids").alias("vec_id"))
    top = each.withColumn("place", F.row_number().over(by.orderBy(F.desc("score"), "vec_id"))).filter(F.col("place") <= k)
    return top.groupBy("pid", "window").agg(F.array_sort(F.collect_list(F.struct("place", "score", "vec_id"))).alias("best"))


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, least: int = 80) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: vec_id, label, embedding.  A positive is one of the first ``positives`` other rows of the anchor's label;
    its negatives are the first ``negatives`` rows of other labels that score at most as high as it and at least
    ``least`` percent of that.  Positives without negatives have no rows.
    """
    rows = usable(vectors)
    points, shared = build_index(classes_of(rows, max(positives + 1, negatives)))
    same = [F.col("label"), F.col("v"), F.col("d")]
    anchors = rows.filter(is_anchor).distinct().join(points.select("pid", *same), ["label", "v", "d"])
    anchors = cut_lineage(anchors.select(F.col("vec_id").alias("anchor_id"), "pid", *same))
    asked = anchors.select("pid", "d", "label", "v").dropDuplicates(["pid"])
    every = asked.select("*", F.array(F.lit(LOWEST)).alias("lo"), F.array(F.lit(HIGHEST)).alias("hi"))
    best = cut_lineage(_first(_search(points, every, shared, True, positives + 1), positives + 1).select("pid", F.col("best").alias("positives")))

    scores = F.array_distinct(F.transform("positives", lambda x: x["score"]))
    ends = asked.join(best, "pid").withColumn("hi", scores)
    ends = ends.withColumn("lo", F.transform("hi", lambda p: _share(p, least)))
    found = _first(_search(points, ends.select("pid", "d", "label", "v", "lo", "hi"), shared, False, negatives), negatives)
    given = found.groupBy("pid").agg(F.map_from_entries(F.collect_list(F.struct("window", "best"))).alias("negatives"))

    each = anchors.select("anchor_id", "pid").join(best.join(given, "pid").select("pid", "positives", scores.alias("scores"), "negatives"), "pid")
    own = F.slice(F.filter("positives", lambda x: x["vec_id"] != F.col("anchor_id")), 1, positives)
    each = each.select("anchor_id", F.explode(own).alias("p"), "scores", "negatives")
    window = (F.array_position("scores", F.col("p.score")) - 1).cast("int")
    each = each.select("anchor_id", "p", F.posexplode(F.try_element_at("negatives", window)).alias("at", "n"))
    return each.select(
        "anchor_id", F.col("p.vec_id").alias("positive_id"), (F.col("at") + 1).alias("rank"), F.col("n.vec_id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("n.score").alias("negative_score")
    )


def _share(score: Column, percent: int) -> Column:
    """The least whole number that is ``percent`` of the score or more; decimals, as doubles would round."""
    exact = score.cast("decimal(20,0)") * F.lit(percent).cast("decimal(5,0)") / F.lit(100).cast("decimal(3,0)")
    return F.ceil(exact).cast("long")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows of ``embeddings`` whose vec_id is divisible by 100, searched against all rows; where it is
    divisible by 7, the label is raised by one modulo 10 first."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)
