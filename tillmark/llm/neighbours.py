"""Approximate nearest neighbours by inner product: stable projections, kd-trees and a chi-square stop.

Vectors get one more coordinate so that the largest inner product is the smallest Euclidean distance. A Gaussian
(2-stable) matrix maps them to a few dimensions: there, the squared distance of two points divided by their true
squared distance is chi-square distributed. Points are visited by growing projected distance and verified with
their original vectors until a point as near as the worst kept one would, with the given confidence, have been met.

The top of the kd-tree deals the rows to cells, each cell's rows sit in chunks of bounded size with a kd-tree of their
own. A query visits its home cell first; the distance it finds there decides which other cells it still has to visit.
The split values of the top come from a bounded sample; every row is indexed.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillmark.llm.common import cut


def chi_square_quantile(p: float, dims: int) -> float:
    """Quantile for an even number of degrees of freedom, by bisection of the closed form."""
    if dims % 2 or dims <= 0:
        raise ValueError("the number of projected dimensions must be even and positive")

    def below(x):
        term = total = 1.0
        for i in range(1, dims // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 10.0 * dims + 200
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return high


def usable(vector: str) -> Column:
    """Rows that take part: a vector without null or non-finite components that is not zero."""
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~bad & F.exists(F.col(vector), lambda x: x != 0)


def top_splits(points: np.ndarray, cells: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Half-open boxes that cover the space: the fullest box is halved at the median of its widest dimension."""
    dims = points.shape[1]
    boxes = [(np.full(dims, -np.inf), np.full(dims, np.inf), points)]
    while len(boxes) < cells:
        boxes.sort(key=lambda b: len(b[2]))
        low, high, inside = boxes.pop()
        spread = np.ptp(inside, axis=0) if len(inside) else np.zeros(dims)
        axis = int(spread.argmax())
        at = float(np.median(inside[:, axis])) if len(inside) else 0.0
        if not spread[axis] or not (inside[:, axis] < at).any():
            boxes.append((low, high, inside))
            break
        left_high, right_low = high.copy(), low.copy()
        left_high[axis] = right_low[axis] = at
        boxes += [(low, left_high, inside[inside[:, axis] < at]), (right_low, high, inside[inside[:, axis] >= at])]
    return [(low, high) for low, high, _ in boxes]


def leaves_of(points: np.ndarray, size: int) -> list[np.ndarray]:
    """Row numbers of the kd-tree's leaves."""
    done, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            done.append(rows)
            continue
        axis = int(np.ptp(points[rows], axis=0).argmax())
        order = np.argpartition(points[rows, axis], len(rows) // 2)
        todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return done


def gap_squared(point: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of one point to many boxes."""
    out = np.maximum(np.maximum(low - point, point - high), 0.0)
    return (out * out).sum(axis=1)


def nearest_in_chunk(ids, vectors, points, queries, k, reach, norm2, leaf_rows):
    """Best candidates of one chunk for each query: (query id, candidate id, inner product)."""
    leaves = leaves_of(points, leaf_rows)
    low = np.stack([points[rows].min(axis=0) for rows in leaves])
    high = np.stack([points[rows].max(axis=0) for rows in leaves])
    order = np.concatenate(leaves)
    ids, vectors = ids[order], vectors[order]
    ends = np.cumsum([len(rows) for rows in leaves])
    starts = ends - [len(rows) for rows in leaves]
    out = []
    for query, vector, point, scale, worst in queries:
        gaps = gap_squared(point, low, high)
        kept_ids, kept = np.empty(0, np.int64), np.empty(0)
        passed, least = -1.0, -np.inf
        for at in np.argsort(gaps, kind="stable"):
            # distances are those of the query scaled to the largest norm
            if gaps[at] > passed and gaps[at] > reach * worst:
                break
            passed = gaps[at]
            scores = vectors[starts[at] : ends[at]] @ vector
            fit = np.flatnonzero(scores >= least)
            fit = fit[ids[starts[at] + fit] != query]
            if not len(fit):
                continue
            kept_ids = np.concatenate([kept_ids, ids[starts[at] + fit]])
            kept = np.concatenate([kept, scores[fit]])
            if len(kept) > k:
                best = np.lexsort((kept_ids, -kept))[:k]
                kept_ids, kept = kept_ids[best], kept[best]
            if len(kept) == k:
                least = kept.min()
                worst = min(worst, max(0.0, 2 * norm2 - 2 * scale * least))
        out.append((np.full(len(kept), query), kept_ids, kept))
    asked, near, scores = (np.concatenate(column) for column in zip(*out, strict=True))
    return pd.DataFrame({"query_id": asked, "vec_id": near, "score": scores})


def nearest(
    rows: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20, dims: int = 12,
    confidence: float = 0.97, cell_rows: int = 8192, query_rows: int = 1024, leaf_rows: int = 128,
    sample_rows: int = 16384, seed: int = 11,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the largest inner product found for each query row.

    A query is no candidate of its own. Ties go to the smaller id; with fewer than k candidates all are returned.
    Rows whose id is null or whose vector is null, zero, holds null or non-finite components, or has not the most
    common length (the longer on a tie) take no part. Rows that repeat an id count once, with the smallest vector.
    `sample_rows` bounds the rows that fit the splits of the tree's top; an empty table gives no rows.
    """
    spark = rows.sparkSession
    shape = "query_id long, vec_id long, score double"
    clean = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"),
                        is_query.alias("asks")).where(F.col("vec_id").isNotNull() & usable("v"))
    sizes = clean.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    clean = clean.where(F.size("v") == sizes["n"]).groupBy("vec_id").agg(
        F.min("v").alias("v"), F.max("asks").alias("asks"))
    facts = clean.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m"))
    n, norm2 = facts.first()
    matrix = np.random.default_rng(seed).standard_normal((sizes["n"] + 1, dims))
    reach = chi_square_quantile(confidence, dims)

    def lifted(v: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0.0, norm2 - (v * v).sum(axis=1)))
        return np.column_stack([v, rest]) @ matrix

    share = min(1.0, sample_rows / n)
    sampled = clean.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 20)) <= int(share * (1 << 20)))
    sample = np.array([r[0] for r in sampled.select("v").limit(sample_rows).collect()] or np.zeros((1, sizes["n"])))
    boxes = top_splits(lifted(sample), math.ceil(n / cell_rows))
    low, high = np.stack([b[0] for b in boxes]), np.stack([b[1] for b in boxes])

    def deal(batches):
        for batch in batches:
            if len(batch):
                points = lifted(np.stack(batch["v"].to_numpy()))
                home = [int(((p >= low) & (p < high)).all(axis=1).argmax()) for p in points]
                yield batch.assign(p=list(points), cell=home)

    dealt = cut(clean.mapInPandas(deal, "vec_id long, v array<double>, asks boolean, p array<double>, cell int"))
    chunks = dealt.groupBy("cell").agg(F.ceil(F.count("*") / cell_rows).cast("int").alias("chunks"))

    def aimed(batches):
        for batch in batches:
            if len(batch):
                v = np.stack(batch["v"].to_numpy())
                scale = math.sqrt(norm2) / np.linalg.norm(v, axis=1)
                points = np.column_stack([v * scale[:, None], np.zeros(len(v))]) @ matrix
                home = [int(((p >= low) & (p < high)).all(axis=1).argmax()) for p in points]
                yield pd.DataFrame({"query_id": batch["vec_id"], "v": batch["v"], "p": list(points), "scale": scale,
                                    "home": home, "worst": np.inf})

    query_shape = "query_id long, v array<double>, p array<double>, scale double, home int, worst double"
    asked = cut(dealt.where("asks").select("vec_id", "v").mapInPandas(aimed, query_shape))

    def visit(queries: DataFrame) -> DataFrame:
        """queries: with a column `cell`, a row for each cell to visit."""
        blocks = queries.groupBy("cell").agg(F.ceil(F.count("*") / query_rows).cast("int").alias("blocks"))
        plan = chunks.join(blocks, "cell")
        left = (dealt.drop("asks").join(plan, "cell")
                .withColumn("chunk", F.pmod(F.xxhash64("vec_id"), "chunks").cast("int"))
                .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
        right = (queries.join(plan, "cell")
                 .withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks").cast("int"))
                 .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))))
        left = left.select("cell", "chunk", "block", "vec_id", "v", "p")
        right = right.select("cell", "chunk", "block", "query_id", "v", "p", "scale", "worst")

        def search(_, have: pd.DataFrame, want: pd.DataFrame) -> pd.DataFrame:
            if not len(have) or not len(want):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
            return nearest_in_chunk(
                have["vec_id"].to_numpy(), np.stack(have["v"].to_numpy()), np.stack(have["p"].to_numpy()),
                zip(want["query_id"], want["v"], want["p"], want["scale"], want["worst"], strict=True),
                k, reach, norm2, leaf_rows)

        by = ["cell", "chunk", "block"]
        return left.groupBy(by).cogroup(right.groupBy(by)).applyInPandas(search, shape)

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    first = cut(best(visit(asked.withColumn("cell", F.col("home")))))
    bounds = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))

    def further(batches):
        for batch in batches:
            cells = []
            for point, home, worst in zip(batch["p"], batch["home"], batch["worst"], strict=True):
                near = np.flatnonzero(gap_squared(point, low, high) <= reach * worst)
                cells.append([int(c) for c in near if c != home])
            yield batch.assign(cells=cells)

    again = asked.drop("worst").join(bounds, "query_id", "left").withColumn(
        "worst", F.coalesce(F.greatest(F.lit(0.0), 2 * norm2 - 2 * F.col("scale") * F.col("bound")), F.lit(math.inf))
    ).drop("bound").select("query_id", "v", "p", "scale", "home", "worst")
    again = again.mapInPandas(further, query_shape + ", cells array<int>")
    second = visit(again.withColumn("cell", F.explode("cells")).drop("cells"))
    return best(first.drop("rank").unionByName(second)).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
