"""The embedding table: documents with flat fields, a cache by content hash, checks of a built index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.retrieval import embed

LISTS = ("breadcrumb", "heading_path", "section_ids", "block_types")


def chunk_to_document(chunks: DataFrame) -> DataFrame:
    """id, page_content and flat fields; lists become JSON text."""
    flat = [F.to_json(c).alias(c) if c in LISTS else F.col(c) for c in chunks.columns if c != "text"]
    return chunks.select(F.col("chunk_id").alias("id"), F.col("text").alias("page_content"), *flat)


def document_to_chunk(documents: DataFrame) -> DataFrame:
    lists = [F.from_json(c, "array<string>").alias(c) if c in LISTS else F.col(c) for c in documents.columns if c not in ("id", "page_content")]
    return documents.select(*lists, F.col("page_content").alias("text"))


def check_documents(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """id, check: duplicate ids, missing or null fields, and chunks that don't come back the same."""
    twice = documents.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id", F.lit("duplicate id").alias("check"))
    null = documents.filter(" or ".join(f"`{c}` is null" for c in documents.columns)).select("id", F.lit("null field").alias("check"))
    row = lambda df: df.select("chunk_id", F.struct(*chunks.columns).alias("row"))
    both = row(chunks).alias("a").join(row(document_to_chunk(documents)).alias("b"), "chunk_id", "full_outer")
    changed = both.filter(~F.col("a.row").eqNullSafe(F.col("b.row"))).select(F.col("chunk_id").alias("id"), F.lit("not the same again").alias("check"))
    return twice.unionByName(null).unionByName(changed)


def embedding_keys(texts: DataFrame, model: str) -> DataFrame:
    return texts.withColumns({"model": F.lit(model), "key": F.sha2("text", 256)})


def embedding_cache_misses(texts: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """model, key, text: each distinct text without a stored vector of the model, once."""
    wanted = embedding_keys(texts.select("text").filter("text is not null").distinct(), model)
    return wanted.join(cache.select("model", "key"), ["model", "key"], "left_anti").select("model", "key", "text")


def cache_counts(texts: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """One row: distinct texts, cached and new ones."""
    keys = embedding_keys(texts.select("text").filter("text is not null").distinct(), model).select("model", "key")
    seen = keys.join(cache.select("model", "key", F.lit(1).alias("hit")).distinct(), ["model", "key"], "left")
    return seen.agg(F.count(F.lit(1)).alias("texts"), F.count("hit").alias("cached"), (F.count(F.lit(1)) - F.count("hit")).alias("new"))


def embed_with_cache(chunks: DataFrame, cache: DataFrame, model: str, embedder: Callable) -> tuple[DataFrame, DataFrame]:
    """(chunks with their vectors, the cache with the new ones)."""
    fresh = embed(embedding_cache_misses(chunks, cache, model), embedder).select("model", "key", "embedding")
    full = cache.select("model", "key", "embedding").unionByName(fresh)
    vectors = full.filter(F.col("model") == model).select("key", "embedding")
    return embedding_keys(chunks, model).join(vectors, "key", "left").drop("key", "model"), full


def verify_index(documents: DataFrame, vectors: DataFrame) -> DataFrame:
    """id, problem: documents without a vector, vectors without a document, vectors of another dimension than most."""
    both = documents.select("id", F.lit(True).alias("has_text")).join(vectors.select("id", "embedding"), "id", "full_outer")
    usual = vectors.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).select("d")
    problem = F.when(F.col("has_text").isNull(), "no document").when(F.col("embedding").isNull(), "no vector").when(F.size("embedding") != F.col("d"), "other dimension")
    return both.join(F.broadcast(usual), F.lit(True), "left").select("id", problem.alias("problem")).filter("problem is not null")
