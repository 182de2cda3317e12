"""Merkle manifest of a dataset: a root hash over all rows, and for each row the proof that it is in it.

Rows are leaves.  The leaves of a group ascend by the key and are numbered; ``fanout`` consecutive nodes (index
divided by the fanout) become their parent, level by level, until one is left, the group's subroot.  The subroots,
in the order of the groups, become the root in the same way.

A level is a DataFrame of runs (group, index, sorted array of children), written to the shared folder; the number
of levels is the logarithm of the largest group.  Siblings are joined from the root downwards: a run is joined with
the path of its own node, which its children then extend by what stands left and right of them.  So a join has at
most one row of a path for each run, and no row that is moved holds the proof of one leaf only.

A group may hold any part of the rows: rows are numbered inside ranges of (group, key), and a range starts at the
count of the group's rows in the ranges before it.  Texts are hashed where they are read; only digests are moved.

Defined results: null values hash as ``-``; null keys come first, null groups form one group that comes first.
Rows with equal keys are ordered by their leaf; rows with equal leaves can't be told apart, each has a place and a
proof of its own.  An empty table gives no rows.  Other columns take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import cut_lineage, lower_ascii, table

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lower-case hexadecimal sha256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value so that no two rows read the same: its bytes' count, a colon and itself; ``-`` for null."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """rows with i (place in the group, from 0) and n (size of the group), without a task for a whole group.

    ``rows`` should be cheap to read twice; ``group`` and ``order`` hold no nulls that matter: they sort first.
    """
    # equal rows can be anywhere among each other, so a group of copies is spread, too
    ranged = cut_lineage(rows.withColumn("spread", F.rand(5)).repartitionByRange(group, *order, "spread").drop("spread").withColumn("part", F.spark_partition_id()))
    counts = ranged.groupBy(group, "part").agg(F.count(F.lit(1)).alias("own"))
    parts = Window.partitionBy(group).orderBy("part")
    starts = counts.select(group, "part", (F.sum("own").over(parts) - F.col("own")).alias("start"), F.sum("own").over(Window.partitionBy(group)).alias("n"))
    place = F.row_number().over(Window.partitionBy(group, "part").orderBy(*order))
    return ranged.withColumn("place", place).join(starts, [group, "part"]).withColumn("i", F.col("start") + F.col("place") - 1).drop("place", "start", "part")


def levels_of(nodes: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """The runs of each level, from the leaves upwards: grp, i, h (of the run as a node), n (nodes of that level),
    many (whether the children are several or one that stands for itself), children array<struct<i, h, ...>>.

    nodes: grp, i, n, h and what goes with a leaf.
    """
    most, out, level, reach = nodes.agg(F.max("n")).first()[0] or 0, [], nodes, 1
    payload = [c for c in nodes.columns if c not in ("grp", "i", "n", "h")]
    while True:
        children = F.array_sort(F.collect_list(F.struct("i", "h", *payload)))
        runs = level.groupBy("grp", F.floor(F.col("i") / fanout).cast("long").alias("run")).agg(F.first("n").alias("below"), children.alias("children"))
        h = F.when(F.col("below") == 1, F.col("children")[0]["h"]).otherwise(digest(F.array_join("children.h", "")))
        n = F.ceil(F.col("below") / fanout).cast("long")
        out.append(cut_lineage(runs.select("grp", F.col("run").alias("i"), h.alias("h"), n.alias("n"), (F.col("below") > 1).alias("many"), "children")))
        reach *= fanout
        if reach >= most:
            return out
        level, payload = out[-1].filter("n > 1").select("grp", "i", "n", "h"), []


def tops_of(levels: list[DataFrame]) -> DataFrame:
    """grp, h, level: the node that is left of each group, and the level whose run it is."""
    tops = [runs.filter("n = 1").select("grp", "h", F.lit(k).alias("level")) for k, runs in enumerate(levels)]
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return out


def with_siblings(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The leaves with path array<struct<l, r>>: the digests left and right of each node on the way up.

    tops: grp, level, path (what is above the top), and columns that every leaf of the group gets.
    """
    given = [c for c in tops.columns if c not in ("grp", "level", "path")]
    above: DataFrame | None = None
    for k in range(len(levels) - 1, -1, -1):
        ending = tops.filter(F.col("level") == k).select("grp", F.lit(0).cast("long").alias("i"), "path", *given)
        above = ending if above is None else above.select("grp", F.col("child.i").alias("i"), "path", *given).unionByName(ending)
        each = levels[k].select("grp", "i", "many", "children", F.posexplode("children").alias("at", "child")).select(
            "grp", "i", "many", "child",
            F.array_join(F.slice(F.col("children.h"), F.lit(1), F.col("at")), "").alias("l"),
            F.array_join(F.slice(F.col("children.h"), F.col("at") + 2, F.size("children")), "").alias("r"),
        )
        own = F.when(F.col("many"), F.concat(F.array(F.struct("l", "r")), F.col("path"))).otherwise(F.col("path"))
        above = each.join(above, ["grp", "i"]).select("grp", "child", own.alias("path"), *given)
    return above


def merkle_manifest(docs: DataFrame, key: str = "doc_id", group: str = "source", fields: tuple[str, ...] = FIELDS, tampered: dict[str, Column] | None = None, fanout: int = FANOUT) -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, folded_root, verified of each row.

    ``tampered`` are fields as they are found later: folded_root is the root that their leaf and the row's siblings
    give, and ``verified`` says whether it still is the root.
    """
    now = {f: F.col(f) for f in fields} | (tampered or {})
    name = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    leaf, later = digest(*(field(F.col(f)) for f in fields)), digest(*(field(now[f]) for f in fields))
    leaves = cut_lineage(docs.select(F.col(key).alias("id"), name.alias("grp"), leaf.alias("h"), later.alias("later")))
    levels = levels_of(numbered(leaves, "grp", "id", "h"), fanout)
    tops = cut_lineage(tops_of(levels))

    ordered = numbered(tops.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "h", "level"), "grp", "name")
    upper = levels_of(ordered.withColumnRenamed("level", "ended"), fanout)
    empty = F.array().cast("array<struct<l: string, r: string>>")
    paths = with_siblings(upper, tops_of(upper).select("grp", "level", empty.alias("path"), F.col("h").alias("root")))
    paths = cut_lineage(paths.select(F.col("child.name").alias("grp"), F.col("child.ended").alias("level"), "path", F.col("child.h").alias("subroot"), "root"))

    out = with_siblings(levels, paths)
    folded = F.aggregate("path", F.col("child.later"), lambda h, s: digest(s["l"], h, s["r"]))
    proof = digest(F.array_join(F.transform("path", lambda s: F.concat(s["l"], s["r"])), ""))
    return out.select(
        F.col("child.id").alias(key), F.col("child.h").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of all ``documents``; a fifth of them (crc32
    of the id divisible by 5; never rows without an id) is found with A-Z of the text in lower case."""
    docs = table(spark, sf_dir, "documents")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return merkle_manifest(docs, tampered={"text": F.when(hit, lower_ascii(F.col("text"))).otherwise(F.col("text"))})
