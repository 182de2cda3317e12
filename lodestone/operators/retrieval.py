"""Exact top-k retrieval by cosine for batches of questions, and what is read off it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.sources.tables import cut_lineage

#: Questions that are broadcast at a time (of 1536 doubles: 25 MB).
QUERY_BLOCK = 2_000
#: Questions whose scores with a batch of chunks are held at a time.
TILE = 256


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Which of a query's scores can be among its first k by score to 12 places, then id: those k, and scores that lie so
    near to a half of the last place that only the JVM's rounding tells."""
    scaled = scores * 1e12 + 0.5
    low, high = np.floor(scaled - 1e-3), np.floor(scaled + 1e-3)
    if len(ids) <= k:
        return np.arange(len(ids))
    least = np.partition(low, -k)[-k]
    some = np.nonzero(high >= least)[0]
    some = some[np.lexsort((ids[some], -low[some]))]
    last = some[k - 1]
    return some[(np.arange(len(some)) < k) | (high[some] > low[last]) | ((high[some] == low[last]) & (ids[some] <= ids[last]))]


def _nearest(q: np.ndarray, batches: Iterator[tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, chunk ids, scores): what can be among the first k of all batches (ids, unit vectors); k are carried along."""
    held: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(q)
    least = np.full(len(q), -np.inf)
    for ids, x in batches:
        for start in range(0, len(q), TILE):
            scores = q[start : start + TILE] @ x.T
            for i in np.nonzero(scores.max(axis=1) >= least[start : start + TILE] - 2e-12)[0]:
                n = start + i
                some = np.nonzero(scores[i] >= least[n] - 2e-12)[0]
                own, at = scores[i][some], ids[some]
                if held[n] is not None:
                    at, own = np.concatenate([held[n][0], at]), np.concatenate([held[n][1], own])
                best = _best(own, at, k)
                held[n] = (at[best], own[best])
                if len(best) >= k:
                    least[n] = np.partition(own[best], -k)[-k]
    for n, pair in enumerate(held):
        if pair is not None:
            yield n, *pair


def vector_topk(queries: DataFrame, chunks: DataFrame, k: int = 5, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, chunk_id, score: the k chunks most similar to each query; ties to the smaller chunk_id.

    queries: query_id, embedding; chunks: chunk_id, embedding.  Blocks of queries are broadcast, chunks stay
    where they are, and only k rows for each query and partition are shuffled, ties among them left out.
    """
    spark, kinds = chunks.sparkSession, {**dict(queries.dtypes), **dict(chunks.dtypes)}
    queries = queries.select("query_id", "embedding").filter("embedding is not null")
    count = queries.count()
    parts = max(1, -(-count // block))
    if parts > 1:  # each block reads both: vectors are worked out once
        queries, chunks = cut_lineage(queries), cut_lineage(chunks.select("chunk_id", "embedding"))
    found = None
    for part in range(parts):
        mine = queries if parts == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)
        rows = mine.toArrow().to_pandas()
        shared = spark.sparkContext.broadcast((rows["query_id"].to_numpy(), _unit(rows["embedding"]) if len(rows) else None))

        def compare(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, q = shared.value
            if len(ids):
                out: list[tuple[int, np.ndarray, np.ndarray]] = list(_nearest(q, ((pdf["chunk_id"].to_numpy(), _unit(pdf["embedding"])) for pdf in batches if len(pdf)), k))
                if out:
                    places = np.repeat([n for n, *_ in out], [len(at) for _, at, _ in out])
                    yield pd.DataFrame({"query_id": ids[places], "chunk_id": np.concatenate([at for _, at, _ in out]), "score": np.concatenate([own for *_, own in out])})

        out = chunks.select("chunk_id", "embedding").filter("embedding is not null").mapInPandas(compare, f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, score double")
        found = out if found is None else found.unionByName(out)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "chunk_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")


def retrieval_summary(retrieved: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, rank, score to four places, chunk_id, source_url, header (the first line of the text)."""
    about = chunks.select("chunk_id", "source_url", F.substring_index("text", "\n", 1).alias("header"))
    return retrieved.join(about, "chunk_id").select("query_id", "rank", F.bround("score", 4).alias("score"), "chunk_id", "source_url", "header")


def embed(texts: DataFrame, embedder: Callable[[list[str]], list[list[float]]], text_col: str = "text") -> DataFrame:
    """Adds ``embedding`` by a batch function, called on the executors."""

    @F.pandas_udf("array<float>")
    def vectors(column: pd.Series) -> pd.Series:
        return pd.Series([list(map(float, v)) for v in embedder(column.tolist())], index=column.index, dtype=object)

    return texts.withColumn("embedding", vectors(F.col(text_col)))


def retrieve(questions: DataFrame, chunks: DataFrame, embedder: Callable, k: int = 5) -> DataFrame:
    """The whole job: question texts to vectors (never cached), then the k nearest chunks with their summary."""
    asked = embed(questions.select(F.col("id").alias("query_id"), F.col("question").alias("text")), embedder)
    return retrieval_summary(vector_topk(asked, chunks, k), chunks)


def expected_page_check(retrieved: DataFrame, expected: DataFrame) -> DataFrame:
    """query_id, expected, found_rank: the first result whose URL contains the expected text, or null."""
    hit = F.min(F.when(F.col("source_url").contains(F.col("expected")), F.col("rank"))).alias("found_rank")
    return expected.join(retrieved, "query_id", "left").groupBy("query_id", "expected").agg(hit)
