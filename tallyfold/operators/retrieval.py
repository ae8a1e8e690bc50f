"""Nearest vectors by cosine, and their re-ranking by recency."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest(vectors: DataFrame, queries: DataFrame, k: int, block: int = 2000) -> DataFrame:
    """(query_id, vec_id, score): the `k` vectors nearest to each query by cosine, the query itself left out.

    The queries are a stated set: they are sent in blocks of bounded size, and every task keeps its `k` best for each
    of a block's queries, which one aggregation brings together.  Vectors that are null, all zero or of another width
    than the query have no score.
    """
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").where("embedding is not null")
    out, ids, mats = None, [], []

    def scored(ids: list[int], mats: list[list[float]]) -> DataFrame:
        q = np.array(mats, dtype=np.float64)
        held = vectors.sparkSession.sparkContext.broadcast((np.array(ids), q / np.linalg.norm(q, axis=1, keepdims=True)))  # one block

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, q = held.value
            for batch in batches:
                batch = batch[[len(v) == q.shape[1] for v in batch["embedding"]]]
                if batch.empty:
                    continue
                m = np.array(batch["embedding"].tolist(), dtype=np.float64)
                norm = np.linalg.norm(m, axis=1)
                vec = batch["vec_id"].to_numpy()[norm > 0]
                if not len(vec):
                    continue
                s = np.round(q @ (m[norm > 0] / norm[norm > 0, None]).T, 9)
                s[names[:, None] == vec[None, :]] = -np.inf
                take = min(k, len(vec))
                least = np.partition(s, len(vec) - take, axis=1)[:, len(vec) - take]
                of, at = np.nonzero((s >= least[:, None]) & np.isfinite(s))
                order = np.lexsort((vec[at], -s[of, at], of))
                of, at = of[order], at[order]
                kept = np.arange(len(of)) - np.searchsorted(of, of) < take  # ties at the end are cut by id
                yield pd.DataFrame({"query_id": names[of[kept]], "vec_id": vec[at[kept]], "score": s[of[kept], at[kept]]})

        return rows.mapInPandas(run, "query_id bigint, vec_id bigint, score double")

    for r in queries.select("vec_id", "embedding").where("embedding is not null").toLocalIterator():
        if any(r.embedding):
            ids.append(r.vec_id)
            mats.append(r.embedding)
        if len(ids) == block:
            part = scored(ids, mats)
            out, ids, mats = part if out is None else out.unionByName(part), [], []
    if ids:
        part = scored(ids, mats)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, vec_id bigint, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("query_id", "vec_id", F.bround("score", 6).alias("score"), "place")


def reranked(hits: DataFrame, weight: float, k: int) -> DataFrame:
    """Hits (query_id, place, score, filed_at) by score and recency among the query's hits, `k` of each."""
    by = Window.partitionBy("query_id")
    age, span = F.datediff("filed_at", F.min("filed_at").over(by)), F.datediff(F.max("filed_at").over(by), F.min("filed_at").over(by))
    recency = F.when(span > 0, age / span).otherwise(1.0)
    rows = hits.withColumn("blended", F.bround(F.col("score") * (1 - weight) + F.coalesce(recency, F.lit(0.0)) * weight, 6))
    w = by.orderBy(F.desc("blended"), "place")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "vec_id", "blended", "rank")


def hashed_embedding(width: int):
    """A column function: text -> unit vector of signed word counts by hash; zeros for no words."""
    import hashlib

    from pyspark.sql.types import ArrayType, FloatType

    def one(text: str) -> list[float]:
        v = np.zeros(width)
        for token in text.lower().split():
            h = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "big")
            v[h % width] += 1.0 if h >> 63 else -1.0
        n = np.linalg.norm(v)
        return (v / n if n else v).tolist()

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one, na_action="ignore")

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, ArrayType(FloatType()))
