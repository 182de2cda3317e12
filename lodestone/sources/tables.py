"""Reading and writing the library's tables, with declared schemas."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SECTIONS = (
    "section_id string, document_title string, source_file string, source_url string, breadcrumb array<string>, heading string, "
    "heading_path array<string>, block_types array<string>, content string, section_no int"
)
CHUNKS = (
    "chunk_id string, chunk_index int, document_title string, source_url string, breadcrumb array<string>, section_ids array<string>, "
    "heading_path array<string>, block_types array<string>, token_count int, text string"
)
USAGE = "struct<input_tokens: bigint, output_tokens: bigint, cached_input_tokens: bigint, reasoning_tokens: bigint>"
GOLDEN = (
    "id string, type string, question string, expected_answer string, evidence array<struct<quote: string, chunk_ids: array<string>>>, "
    "source_urls array<string>, required_terms array<string>, answerable boolean, notes string"
)


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back, for steps that build on themselves.

    The folder is the cluster's ``spark.checkpoint.dir``; one next to the warehouse is made only where none is set.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors and the driver share."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_checkpoints"))
    return context.getCheckpointDir()


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """rows with place (in the group, from 0) and n (size of the group), without a task for a whole group.

    Rows are dealt by ranges of (group, order); a range starts where the group's rows of the ranges before it end.
    """
    ranged = cut_lineage(rows.withColumn("_any", F.rand(3)).repartitionByRange(group, *order, "_any").drop("_any").withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_own"))
    before = F.sum("_own").over(Window.partitionBy(group).orderBy("_part")) - F.col("_own")
    starts = counts.select(group, "_part", before.alias("_start"), F.sum("_own").over(Window.partitionBy(group)).alias("n"))
    own = F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order))
    out = ranged.withColumn("_own", own).join(starts, [group, "_part"])
    return out.withColumn("place", F.col("_start") + F.col("_own") - 1).drop("_own", "_start", "_part")


def write_page_tree(pages: DataFrame, root: str, *folders: str) -> None:
    """A file for each page (text) in folders below folders, named by columns."""
    pages.select(*folders, "text").write.mode("overwrite").option("maxRecordsPerFile", 1).option("lineSep", "\x00").partitionBy(*folders).text(root)


def read_page_tree(spark: SparkSession, root: str, glob: str = "*.md") -> DataFrame:
    """path, text of all files of a kind below a folder."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record a line; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def read_url_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def write_table(df: DataFrame, path: str, form: str = "parquet", by: list[str] | None = None) -> None:
    """Writes all rows anew; no row of an earlier write survives."""
    writer = df.write.mode("overwrite").format(form)
    (writer.partitionBy(*by) if by else writer).save(path)


def rebuild_table(df: DataFrame, path: str) -> int:
    """Writes all rows as a new version and returns its number.

    The version counts only once its row in ``commits`` is written, after all of its data: a reader sees the old rows
    or the new ones, never both or a half.  A rebuild that was broken off leaves a folder that nobody reads and the next
    one overwrites.  One rebuild of a table runs at a time.
    """
    version = current_version(df.sparkSession, path) + 1
    df.write.mode("overwrite").parquet(f"{path}/versions/{version}")
    df.sparkSession.range(1).select(F.lit(version).alias("version")).coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return version


def current_version(spark: SparkSession, path: str) -> int:
    """The last version of a rebuilt table that is whole; 0 if there is none."""
    try:
        commits = spark.read.schema("version int").parquet(f"{path}/commits")
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return 0
    return commits.agg(F.max("version")).first()[0] or 0


def read_rebuilt(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the last whole version."""
    version = current_version(spark, path)
    if not version:
        raise ValueError(f"{path} holds no whole version")
    return spark.read.parquet(f"{path}/versions/{version}")


def checksum(df: DataFrame, columns: list[str]) -> DataFrame:
    """n_rows and a checksum that doesn't hang on the order of rows or partitions."""
    row = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns)), 256)
    halves = [F.conv(F.substring("row", start, 8), 16, 10).cast("decimal(20,0)") for start in (1, 9, 17, 25)]
    sums = [F.coalesce(F.sum(h).cast("decimal(38,0)"), F.lit(0)).cast("string") for h in halves]
    return df.select(row.alias("row")).agg(F.count(F.lit(1)).alias("n_rows"), F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *sums), 256).alias("checksum"))


def index_manifest(documents: DataFrame, embeddings: DataFrame, collection: str, model: str, distance: str = "cosine") -> DataFrame:
    """One row about a built index: when, what, how many, which model and dimension."""
    size = embeddings.agg(F.max(F.size("embedding")).alias("embedding_dimension"))
    about = checksum(documents, ["id", "page_content"]).withColumnRenamed("n_rows", "documents").withColumnRenamed("checksum", "chunks_sha256")
    return about.join(F.broadcast(size)).withColumns({"created_at": F.current_timestamp(), "collection": F.lit(collection), "embedding_model": F.lit(model), "distance": F.lit(distance)})
