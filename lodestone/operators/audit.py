"""Audit of a chunk table: invariants, coverage of its sections, statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.text import count_tokens, fence_lines

REQUIRED = ("chunk_id", "chunk_index", "document_title", "source_url", "section_ids", "heading_path", "block_types", "token_count", "text")
#: Upper bounds of the histogram.
BUCKETS = (50, 100, 200, 300, 400, 500, 600, 700, 800)


def missing_fields(chunks: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """chunk_id, check, detail of rows that lack a value (or the table a column)."""
    lacking = [F.when(F.col(c).isNull() if c in chunks.columns else F.lit(True), F.lit(c)) for c in required]
    names = F.array_compact(F.array(*lacking))
    return chunks.select("chunk_id", F.lit("missing fields").alias("check"), F.array_join(names, ", ").alias("detail")).filter("detail <> ''")


def duplicate_chunk_ids(chunks: DataFrame) -> DataFrame:
    """chunk_id and how many rows it has too many."""
    return chunks.groupBy("chunk_id").agg((F.count(F.lit(1)) - 1).alias("extra")).filter("extra > 0")


def row_checks(chunks: DataFrame, url_prefix: str = "http", max_tokens: int = 800, recount: bool = True) -> DataFrame:
    """chunk_id, check, detail: what is wrong with single chunks, in one pass."""
    last = F.trim(F.element_at(F.split(F.regexp_replace("text", r"\s+\z", ""), r"\R"), -1))
    empty = F.trim(F.translate("text", "\t\r\n", "   ")) == ""

    def check(when, name, detail):
        return F.when(when, F.struct(F.lit(name).alias("check"), detail.cast("string").alias("detail")))

    found = F.array_compact(
        F.array(
            check(~F.col("source_url").startswith(url_prefix), "invalid source_url", F.col("source_url")),
            check(empty, "empty text", F.lit(None)),
            check(F.lit(recount) & (count_tokens(F.col("text")) != F.col("token_count")), "token_count mismatch", F.col("token_count")),
            check(F.col("token_count") > max_tokens, "over the maximum", F.col("token_count")),
            check(fence_lines(F.col("text")) % 2 == 1, "unbalanced code fence", F.lit(None)),
            check(~empty & last.endswith(":") & ~last.rlike(r"^[-|]"), "ends with a lead-in", F.substr(last, F.lit(1), F.lit(80))),
            check(~empty & last.startswith("## "), "ends with a heading", F.substr(last, F.lit(1), F.lit(80))),
        )
    )
    return chunks.select("chunk_id", F.inline(found))


def problem_summary(problems: DataFrame, examples: int = 5, salts: int = 64) -> DataFrame:
    """check, n, examples: the first chunk ids of each check.

    There are few checks, and one may hold most rows: each of ``salts`` parts of a check gives its own count and first
    ids, and only those meet.
    """
    rows = problems.withColumn("salt", F.pmod(F.xxhash64("chunk_id"), F.lit(salts)))
    counts = rows.groupBy("check", "salt").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("check", "salt").orderBy("chunk_id"))
    first = rows.withColumn("place", place).filter(F.col("place") <= examples).groupBy("check", "salt").agg(F.collect_list("chunk_id").alias("ids"))
    met = counts.join(first, ["check", "salt"]).groupBy("check")
    return met.agg(F.sum("n").alias("n"), F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, examples).alias("examples"))


def uncovered_sections(sections: DataFrame, chunks: DataFrame) -> DataFrame:
    held = chunks.select(F.explode("section_ids").alias("section_id")).distinct()
    return sections.join(held, "section_id", "left_anti").select("section_id")


def _words(text: str) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)\w+"), F.lit(0))


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, kind, section_id, words, by key and kind: a chunk (0), sections that lie in it alone (1), whose missing words
    come out, and others that it holds a part of (2), for which its own words come out."""
    key, inside = None, Counter()
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            rows, out = batch.slice(start, 256), []
            for at, kind, section, words in zip(*(c.to_pylist() for c in rows.columns)):
                own = Counter(words or ()) if kind < 2 else None
                if kind == 0:
                    key, inside = at, own
                    continue
                here = inside if at == key else Counter()
                if kind == 1:
                    out += [(section, w, n, here[w]) for w, n in own.items() if n > here[w]]
                else:
                    out += [(section, w, 0, n) for w, n in here.items()]
            if out:
                ids, *rest = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("section_id").type), *(pa.array(c, t) for c, t in zip(rest, (pa.string(), pa.int64(), pa.int64())))], ["section_id", "word", "n_section", "n_chunks"])


def missing_words(sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """section_id, word, n_section, n_chunks: words that occur less often in a section's chunks than in it.

    A section that lies in one chunk is dealt to where that is, and their rows are compared there.  Only of sections in
    several chunks (or of several rows) the words themselves are dealt, with those of the chunks.
    """
    kind = sections.schema["section_id"].dataType.simpleString()
    key, none = F.md5(F.to_json(F.struct("chunk_id", "section_ids", "text"))), lambda t: F.lit(None).cast(t)
    held = chunks.select(key.alias("key"), F.explode("section_ids").alias("section_id")).filter("section_id is not null")
    both = held.select("section_id", "key", F.lit(0).alias("own")).unionByName(sections.select("section_id", none("string").alias("key"), F.lit(1).alias("own")))
    about = both.groupBy("section_id").agg(F.sum("own").alias("rows"), F.count("key").alias("holders"), F.min("key").alias("key")).filter("rows > 0")
    single = (F.col("rows") == 1) & (F.col("holders") <= 1)
    about = about.select("section_id", single.alias("single"), F.coalesce("key", F.md5(F.col("section_id").cast("string")), F.lit("")).alias("key"))
    placed = sections.select("section_id", "content").alias("s").join(about.alias("a"), F.expr("s.section_id <=> a.section_id")).select("s.section_id", "content", "single", "key")

    texts = chunks.select(key.alias("key"), F.lit(0).alias("kind"), none(kind).alias("section_id"), "text")
    asked = placed.filter("single").select("key", F.lit(1).alias("kind"), "section_id", F.col("content").alias("text"))
    parts = held.join(about.filter("not single").select("section_id"), "section_id").select("key", F.lit(2).alias("kind"), "section_id", none("string").alias("text"))
    dealt = texts.unionByName(asked).unionByName(parts).repartition("key").sortWithinPartitions("key", "kind")
    found = dealt.select("key", "kind", "section_id", _words("text").alias("words")).mapInArrow(_compared, f"section_id {kind}, word string, n_section bigint, n_chunks bigint")
    several = placed.filter("not single").select("section_id", F.explode(_words("content")).alias("word"), F.lit(1).cast("long").alias("n_section"), F.lit(0).cast("long").alias("n_chunks"))
    sums = found.unionByName(several).groupBy("section_id", "word").agg(F.sum("n_section").alias("n_section"), F.sum("n_chunks").alias("n_chunks"))
    return sums.filter("n_section > n_chunks")


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """One row: chunks, documents, tokens in all, least, median, 90th percentile (an element, not interpolated), most."""
    counts = chunks.groupBy("token_count").agg(F.count(F.lit(1)).alias("n"))
    below = F.sum("n").over(Window.orderBy("token_count").rowsBetween(Window.unboundedPreceding, 0))  # one row a distinct count
    total = counts.agg(F.sum("n").alias("total"))
    p90 = counts.withColumn("below", below).join(F.broadcast(total)).filter(F.col("below") > F.floor(0.9 * F.col("total"))).agg(F.min("token_count").alias("p90"))
    stats = chunks.agg(
        F.count(F.lit(1)).alias("chunks"),
        F.countDistinct("source_url").alias("documents"),
        F.sum("token_count").alias("tokens"),
        F.min("token_count").alias("least"),
        F.median("token_count").alias("median"),
        F.max("token_count").alias("most"),
    )
    return stats.join(F.broadcast(p90))


def token_histogram(chunks: DataFrame, bounds: tuple[int, ...] = BUCKETS) -> DataFrame:
    """lower, upper (null: none), n of the buckets (lower, upper], empty ones included."""
    edges = [(0, bounds[0]), *zip(bounds, bounds[1:]), (bounds[-1], None)]
    lower = F.coalesce(*(F.when(F.col("token_count") <= u, F.lit(lo)) for lo, u in edges if u is not None), F.lit(bounds[-1]))
    counted = chunks.groupBy(lower.alias("lower")).agg(F.count(F.lit(1)).alias("n"))
    table = chunks.sparkSession.createDataFrame(edges, "lower int, upper int")
    return F.broadcast(table).join(counted, "lower", "left").select("lower", "upper", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def block_type_counts(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.explode("block_types").alias("block_type")).groupBy("block_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "block_type")


def merged_chunk_count(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count(F.when(F.size("section_ids") > 1, 1)).alias("merged"))


def extreme_chunks(chunks: DataFrame, n: int = 5) -> DataFrame:
    """end (smallest, largest), chunk_id, token_count of the n chunks at either end; ties to the smaller id."""
    pick = lambda order, name: chunks.orderBy(order, "chunk_id").limit(n).select(F.lit(name).alias("end"), "chunk_id", "token_count")
    return pick(F.asc("token_count"), "smallest").unionByName(pick(F.desc("token_count"), "largest"))


def documents_with_most_chunks(chunks: DataFrame, n: int = 5) -> DataFrame:
    return chunks.groupBy("source_url").agg(F.count(F.lit(1)).alias("chunks")).orderBy(F.desc("chunks"), "source_url").limit(n)


def sample_chunks(chunks: DataFrame, n: int, seed: int) -> DataFrame:
    """n chunks by a hash of seed and id: the same ones for any partitioning."""
    return chunks.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("chunk_id").cast("string"))), "chunk_id").limit(n)


def chunks_of(chunks: DataFrame, text: str, preview: int = 200) -> DataFrame:
    """Chunks whose URL contains a text, with the start of theirs."""
    start = F.when(F.length("text") > preview, F.concat(F.substring("text", 1, preview), F.lit("..."))).otherwise(F.col("text"))
    return chunks.filter(F.col("source_url").contains(text)).select("chunk_id", "source_url", "token_count", start.alias("preview"))
