"""Vectors: embedding texts, exact top-k in blocks, an inverted-file index, fusion of rankings."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metascope.functions.text import stems
from metascope.operators.skew import first_rows

#: Rows of points and of queries in one block; a task holds one block of each.
POINT_BLOCK, QUERY_BLOCK = 8192, 1024


def hash_embedding(text: str | None, dims: int = 64) -> list[float]:
    """A deterministic embedding of the stems of a text by feature hashing, of length 1 (zeros for no stems)."""
    v = np.zeros(dims)
    for t in stems(text):
        h = int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little")
        v[h % dims] += 1.0 if h >> 63 else -1.0
    n = np.linalg.norm(v)
    return (v / n if n else v).tolist()


def embed(texts: DataFrame, column: str, dims: int = 64, embedder=hash_embedding) -> DataFrame:
    """`texts` with an embedding (array<float>) of `column`; in Arrow batches. embedder: text and dims to a list."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: embedder(t, dims))

    return texts.withColumn("embedding", run(F.col(column)))


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two array columns in doubles; 0 if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, z: acc + z)
    n = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def _blocks(df: DataFrame, ident: str, vector: str, rows: int) -> DataFrame:
    """Rows gathered by a hash of their id into blocks of about `rows`, so a block's size is bounded at any input size."""
    n = max(1, -(-df.count() // rows))
    return df.select(F.col(ident).alias("i"), F.col(vector).alias("v")).filter("i is not null and v is not null").groupBy(F.pmod(F.xxhash64("i"), F.lit(n)).alias("b")).agg(F.collect_list("i").alias("ids"), F.collect_list("v").alias("vs"))


def _unit(vectors) -> np.ndarray:
    m = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _best(q_ids, ids, scores: np.ndarray, k: int, digits: int) -> pd.DataFrame:
    """The k best of each row of `scores`, ties by the smaller id."""
    scores = np.round(scores, digits)
    ids = np.asarray(ids)
    order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :k]
    return pd.DataFrame({"query_id": np.repeat(np.asarray(q_ids), order.shape[1]), "id": ids[order].ravel(), "score": np.take_along_axis(scores, order, 1).ravel()})


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    """The k best of each query; ties by id."""
    return first_rows(rows, ["query_id"], [F.desc("score"), F.asc("id")], k).select("query_id", "id", "score", "place")


def topk(points: DataFrame, queries: DataFrame, k: int, ident: str = "vec_id", vector: str = "embedding", digits: int = 5) -> DataFrame:
    """For each query the k points of greatest cosine: query_id, id, score (rounded), place; ties by id.

    Exact. A stated query set is compared with all points in blocks: each task multiplies one block of queries with one of
    points and passes on k rows a query. Nothing is collected; rows without id or vector take no part; repeated points
    count once. Ids may be numbers or text."""
    p = _blocks(points.select(ident, vector).dropDuplicates([ident]), ident, vector, POINT_BLOCK).select("ids", "vs")
    q = _blocks(queries.select(ident, vector).dropDuplicates([ident]), ident, vector, QUERY_BLOCK).select(F.col("ids").alias("q_ids"), F.col("vs").alias("q_vs"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                yield _best(r.q_ids, r.ids, _unit(r.q_vs) @ _unit(r.vs).T, k, digits)

    kind = points.schema[ident].dataType.simpleString()
    pairs = p.crossJoin(q)  # of blocks: (rows / POINT_BLOCK) x (queries / QUERY_BLOCK)
    return _ranked(pairs.mapInPandas(run, f"query_id {queries.schema[ident].dataType.simpleString()}, id {kind}, score double"), k)


def best_per_key(rows: DataFrame, key: str = "id") -> DataFrame:
    """Of each key its best score over all queries, and the query that gave it (ties: the smaller)."""
    return rows.groupBy(key).agg(F.max(F.struct("score", (-F.col("query_id")).alias("q"))).alias("m")).select(key, F.col("m.score").alias("score"), (-F.col("m.q")).alias("query_id"))


class VectorIndex:
    """An inverted file. Centroids are fitted on a bounded sample (sample_rows, a parameter); every row is assigned to
    its nearest cell. probes, the number of cells that a query reads, is the least that finds `recall` of the sample's own
    nearest neighbours, so it follows the data."""

    def __init__(self, centroids: np.ndarray, probes: int):
        self.centroids, self.probes = centroids, probes

    @classmethod
    def fit(cls, points: DataFrame, ident: str = "vec_id", vector: str = "embedding", sample_rows: int = 4096, cells: int | None = None, recall: float = 0.97, k: int = 10, seed: int = 7) -> VectorIndex:
        rows = points.select(ident, vector).filter(F.col(vector).isNotNull()).orderBy(F.xxhash64(ident, F.lit(seed)), ident).limit(sample_rows).collect()  # bounded by sample_rows
        x = _unit([r[1] for r in rows]) if rows else np.zeros((0, 1))
        n = cells or max(1, min(256, round(len(x) ** 0.5)))
        rng = np.random.default_rng(seed)
        c = x[rng.permutation(len(x))[:n]].copy() if len(x) else x
        for _ in range(12):
            if not len(c):
                break
            near = (x @ c.T).argmax(axis=1)
            for i in range(len(c)):
                if (near == i).any():
                    c[i] = x[near == i].mean(axis=0)
            c = _unit(c)
        probes = 1
        if len(x) > k:
            test = x[:256]
            true = np.argsort(-(test @ x.T), axis=1)[:, :k]
            cell, rank = (x @ c.T).argmax(axis=1), np.argsort(np.argsort(-(test @ c.T), axis=1), axis=1)
            need = np.take_along_axis(rank, cell[true], 1) + 1
            probes = next((p for p in range(1, len(c) + 1) if (need <= p).mean() >= recall), len(c))
        return cls(c, probes)

    def assign(self, df: DataFrame, ident: str = "vec_id", vector: str = "embedding", cells: int = 1) -> DataFrame:
        """cell, i, v of every row: its `cells` nearest cells, one row each."""
        c = self.centroids

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if not len(b):
                    continue
                near = np.argsort(-(_unit(b["v"]) @ c.T), axis=1, kind="stable")[:, :cells]
                yield pd.DataFrame({"cell": near.ravel(), "i": np.repeat(b["i"].to_numpy(), near.shape[1]), "v": [v for v in b["v"] for _ in range(near.shape[1])]})

        return df.select(F.col(ident).alias("i"), F.col(vector).alias("v")).filter("i is not null and v is not null").mapInPandas(run, "cell int, i bigint, v array<float>")

    def search(self, points: DataFrame, queries: DataFrame, k: int, ident: str = "vec_id", vector: str = "embedding", digits: int = 5) -> DataFrame:
        """As topk, over the cells that the queries probe: query_id, id, score, place. Cells are split into blocks of bounded
        size, so a full cell is no task of its own."""
        if not len(self.centroids):
            return topk(points, queries, k, ident, vector, digits)
        n = max(1, -(-points.count() // (POINT_BLOCK * len(self.centroids))))

        def packed(df: DataFrame, parts: int, prefix: str) -> DataFrame:
            return df.groupBy("cell", F.pmod(F.xxhash64("i"), F.lit(parts)).alias("b")).agg(F.collect_list("i").alias(f"{prefix}ids"), F.collect_list("v").alias(f"{prefix}vs")).drop("b")

        p = packed(self.assign(points.select(ident, vector).dropDuplicates([ident]), ident, vector), 4 * n, "")
        m = max(1, -(-queries.count() * self.probes // (QUERY_BLOCK * len(self.centroids))))
        q = packed(self.assign(queries.select(ident, vector).dropDuplicates([ident]), ident, vector, self.probes), m, "q_")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for r in b.itertuples(index=False):
                    yield _best(r.q_ids, r.ids, _unit(r.q_vs) @ _unit(r.vs).T, k, digits)

        return _ranked(p.join(q, "cell").select("ids", "vs", "q_ids", "q_vs").mapInPandas(run, "query_id bigint, id bigint, score double"), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: hits, wanted and recall of the exact neighbours."""
    hits = exact.select("query_id", "id").join(found.select("query_id", "id"), ["query_id", "id"], "left_semi").agg(F.count(F.lit(1)).alias("hits"))
    return hits.crossJoin(exact.agg(F.count(F.lit(1)).alias("wanted"))).withColumn("recall", F.round(F.col("hits") / F.col("wanted"), 4))  # two tables of one row


def fuse(rankings: dict[str, DataFrame], keys: list[str], score: str = "score") -> DataFrame:
    """of each key its greatest score over all rankings; of equal scores that of the ranking named first. Adds source
    and sources (all, sorted). max over a struct is combined before the shuffle."""
    parts = [df.withColumns({"source": F.lit(name), "_order": F.lit(-i)}) for i, (name, df) in enumerate(rankings.items())]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    rest = [c for c in rows.columns if c not in (*keys, score, "_order")]
    m = rows.groupBy(*keys).agg(F.max(F.struct(score, "_order", *rest)).alias("m"), F.sort_array(F.collect_set("source")).alias("sources"))
    return m.select(*keys, F.col(f"m.{score}").alias(score), *[F.col(f"m.{c}").alias(c) for c in rest], "sources")
