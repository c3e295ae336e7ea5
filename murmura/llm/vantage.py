"""Nearest neighbours by cosine with vantage-point trees, one tree per shard.

On unit vectors the chord |a - b| is a metric and falls as the cosine rises.
A tree node splits its vectors at the median distance from a vantage point; a
search skips a side when the triangle inequality, relaxed by ``factor``, rules
it out: ``|d(query, vantage) - median| > factor * (distance of the k-th found)``.
Factor 1 restores exact search, smaller factors skip more.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmura.scratch import materialize, small_batches

SHARD_ROWS = 8192
QUERY_ROWS = 2048
LEAF_ROWS = 128
#: Room for rounding in a pruning test; it only makes the search visit more.
SLACK = 1e-9
#: Digits of a cosine in a tree; beyond them lies rounding.
DIGITS = 12


class Tree:
    """A vantage-point tree over unit vectors, in flat arrays.

    Rows are permuted so that each leaf is a slice.  Node i of the heap order
    has children 2i+1 (near) and 2i+2 (far).
    """

    def __init__(self, unit: np.ndarray, ids: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.order = np.argsort(ids, kind="stable")
        levels = 0
        while len(ids) > leaf_rows << levels:
            levels += 1
        self.levels = levels
        self.vantage = np.zeros(((1 << levels) - 1, unit.shape[1]))
        self.median = np.zeros((1 << levels) - 1)
        spans = [(0, len(ids))]
        for level in range(levels):
            below = []
            for k, (a, b) in enumerate(spans):
                node, m = (1 << level) - 1 + k, (a + b) // 2
                part = self.order[a:b]
                if b > a:
                    # the row farthest from the mean stands at the rim and splits best
                    rows = unit[part]
                    self.vantage[node] = rows[np.argmin(rows @ rows.mean(0))]
                    d = chord(rows @ self.vantage[node])
                    by = np.argsort(d, kind="stable")
                    self.order[a:b] = part[by]
                    self.median[node] = d[by[min(m - a, b - a - 1)]]
                below += [(a, m), (m, b)]
            spans = below
        self.spans = np.array(spans, np.int64)
        self.unit, self.ids = unit[self.order], ids[self.order]

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, levels=self.levels, vantage=self.vantage, median=self.median, spans=self.spans, unit=self.unit, ids=self.ids)
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Tree:
        tree = cls.__new__(cls)
        with np.load(io.BytesIO(raw)) as z:
            tree.levels, tree.vantage, tree.median, tree.spans, tree.unit, tree.ids = int(z["levels"]), z["vantage"], z["median"], z["spans"], z["unit"], z["ids"]
        return tree

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """The best k ids and cosines of each unit query, its own id left out.

        All queries go down together; each visits its near side first.  Missing
        places have the cosine -inf.  Cosines are rounded to ``DIGITS``, so that
        equal vectors tie whatever a product's rounding, and ties go to the
        smaller id.
        """
        best = np.full((len(queries), k), -np.inf)
        found = np.full((len(queries), k), np.iinfo(np.int64).max)

        def visit(node: int, level: int, who: np.ndarray) -> None:
            if not len(who):
                return
            if level == self.levels:
                a, b = self.spans[node - ((1 << level) - 1)]
                if b > a:
                    cos = np.round(queries[who] @ self.unit[a:b].T, DIGITS)
                    cos[own[who][:, None] == self.ids[None, a:b]] = -np.inf
                    ids = np.where(np.isneginf(cos), np.iinfo(np.int64).max, self.ids[None, a:b])
                    best[who], found[who] = top_k(np.hstack([best[who], cos]), np.hstack([found[who], ids]), k)
                return
            d = chord(queries[who] @ self.vantage[node])
            gap = d - self.median[node]
            near = gap < 0
            visit(2 * node + 1, level + 1, who[near])
            visit(2 * node + 2, level + 1, who[~near])
            reach = factor * chord(best[who, k - 1])
            again = np.abs(gap) <= reach + SLACK
            visit(2 * node + 2, level + 1, who[near & again])
            visit(2 * node + 1, level + 1, who[~near & again])

        visit(0, 0, np.arange(len(queries)))
        return found, best


def chord(cos: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cos))


def top_k(cos: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.lexsort((ids, -cos), axis=1)[:, :k]
    return np.take_along_axis(cos, at, 1), np.take_along_axis(ids, at, 1)


def usable(vectors: DataFrame) -> DataFrame:
    """Rows with an id and a vector that is not null, zero or holding null, NaN or infinity."""
    v = F.col("_v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("_v")).where("vec_id is not null").where(F.coalesce(fine, F.lit(False)))


def matrix(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, and their norms, without overflow for huge components."""
    x = np.stack(column.to_numpy()).astype(float)
    scale = np.abs(x).max(1, keepdims=True)
    return x, (scale * np.sqrt(((x / scale) ** 2).sum(1, keepdims=True)))[:, 0]


def unit_rows(column: pd.Series) -> np.ndarray:
    x, norm = matrix(column)
    return x / norm[:, None]


def build(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The index: dim, shard and the serialised tree of each shard; every usable row is in one.

    Vectors of another length than a query's are no candidates for it.
    """
    rows = vectors.withColumn("_dim", F.size("_v"))
    shards = {r[0]: max(1, -(-r[1] // shard_rows)) for r in rows.groupBy("_dim").count().collect()}
    count = F.lit(1)
    for dim, n in shards.items():
        count = F.when(F.col("_dim") == dim, F.lit(n)).otherwise(count)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = Tree(unit_rows(pdf["_v"]), pdf["vec_id"].to_numpy(np.int64))
        return pd.DataFrame({"dim": [int(pdf["_dim"].iloc[0])], "shard": [int(pdf["_shard"].iloc[0])], "tree": [tree.dump()]})

    dealt = rows.withColumn("_shard", F.pmod(F.xxhash64("vec_id"), count).cast("int"))
    return materialize(dealt.groupBy("_dim", "_shard").applyInPandas(grow, "dim int, shard int, tree binary"), "vantage-trees")


def search(index: DataFrame, queries: DataFrame, k: int, factor: float, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, vec_id and cosine of the k best rows that the trees give for each query.

    Queries are packed into blocks, and every block goes to every shard of its
    length.  A task reads a shard's tree once and then its blocks one by one, so
    it holds one tree and one block, and a tree travels once whatever the number
    of blocks.
    """
    n = queries.count()
    blocks = max(1, -(-n // query_rows))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        np.savez(out, ids=pdf["vec_id"].to_numpy(np.int64), unit=unit_rows(pdf["_v"]))
        return pd.DataFrame({"dim": [int(pdf["_dim"].iloc[0])], "part": [int(pdf["_block"].iloc[0])], "body": [out.getvalue()]})

    packed = (
        queries.withColumn("_dim", F.size("_v"))
        .withColumn("_block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
        .groupBy("_dim", "_block")
        .applyInPandas(pack, "dim int, part int, body binary")
    )
    shards = index.groupBy("dim").agg(F.max("shard").alias("_last"))  # one row for each length
    sent = packed.join(shards, "dim").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("_last"))))
    # a shard's tree comes before its blocks
    rows = index.select("dim", "shard", F.lit(-1).alias("part"), F.col("tree").alias("body")).unionByName(sent.select("dim", "shard", "part", "body"))
    places = max(1, index.count())
    rows = rows.repartition(min(places, 4096), "dim", "shard").sortWithinPartitions("dim", "shard", "part")

    def run(batches):
        tree = None
        for b in batches:
            for part, body in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if part < 0:
                    tree = Tree.load(body.as_py())
                    continue
                with np.load(io.BytesIO(body.as_py())) as z:
                    ids, unit = z["ids"], z["unit"]
                found, best = tree.search(unit, ids, k, factor)
                keep = np.isfinite(best)
                yield pa.record_batch([pa.array(np.repeat(ids, k)[keep.ravel()]), pa.array(found[keep]), pa.array(best[keep])], ["query_id", "vec_id", "near"])

    got = rows.select("part", "body").transform(small_batches).mapInArrow(run, "query_id long, vec_id long, near double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("near"), "vec_id"))
    return got.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, factor: float = 0.2, spare: int = 3, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score of the k best for each row whose id ``every`` divides.

    A query's own row (and rows that share its id) is no candidate.  The trees
    give ``k + spare`` candidates, whose cosines are then taken on the original
    vectors in double precision; ties go to the smaller id.  Rows with a null id
    or an unusable vector take no part, repeated ids count once (the vector that
    sorts first), empty tables give an empty result, and other columns are
    ignored.
    """
    rows = usable(vectors).groupBy("vec_id").agg(F.min("_v").alias("_v"))
    rows = materialize(rows, "vantage-rows")
    queries = rows.where(F.col("vec_id") % every == 0)
    found = search(build(rows, shard_rows), queries, k + spare, factor, query_rows)
    pairs = found.join(queries.select(F.col("vec_id").alias("query_id"), F.col("_v").alias("_q")), "query_id").join(rows, "vec_id").select("query_id", "vec_id", "_q", "_v")

    def exact(batches):
        for pdf in batches:
            if len(pdf):
                score = np.empty(len(pdf))
                for dim, at in pdf.groupby(pdf["_v"].map(len)).indices.items():
                    (a, na), (b, nb) = matrix(pdf["_q"].iloc[at]), matrix(pdf["_v"].iloc[at])
                    score[at] = ((a / na[:, None]) * (b / nb[:, None])).sum(1)
                yield pd.DataFrame({"query_id": pdf["query_id"], "vec_id": pdf["vec_id"], "score": score})

    scored = pairs.mapInPandas(exact, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
