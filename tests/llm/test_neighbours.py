import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillmark.llm.neighbours import chi_square_quantile, nearest


def brute(ids, vectors, asks, k):
    out = []
    for i in np.flatnonzero(asks):
        scores = vectors @ vectors[i]
        order = [j for j in np.lexsort((ids, -scores)) if ids[j] != ids[i]][:k]
        out += [(int(ids[i]), r + 1, int(ids[j]), scores[j]) for r, j in enumerate(order)]
    return out


@pytest.mark.parametrize("cells", [10_000, 200])
def test_recall_against_brute_force(spark, cells):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((8, 24))
    vectors = np.concatenate([centres[rng.integers(0, 8, 900)] + 0.2 * rng.standard_normal((900, 24)),
                              rng.standard_normal((300, 24)) * rng.uniform(0.1, 3, (300, 1))]).astype(np.float32).astype(float)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    got = nearest(rows, F.col("vec_id") % 20 == 0, k=10, cell_rows=cells, query_rows=16, leaf_rows=32).collect()
    want = brute(np.arange(1200), vectors, np.arange(1200) % 20 == 0, 10)
    have = {(r["query_id"], r["vec_id"]) for r in got}
    assert len(have & {(q, v) for q, _, v, _ in want}) / len(want) >= 0.9
    for r in got:
        assert math.isclose(r["score"], float(vectors[r["query_id"]] @ vectors[r["vec_id"]]), rel_tol=1e-12)


def test_ties_copies_and_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]),
            (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (20, [0.5, 0.5])]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, cell string")
    got = sorted(tuple(r) for r in nearest(df, F.col("vec_id") % 20 == 0, k=3).collect())
    assert [r[:3] for r in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 20), (20, 1, 0), (20, 2, 1), (20, 3, 2)]
    few = sorted(tuple(r)[:3] for r in nearest(df, F.col("vec_id") % 20 == 0, k=50).collect())
    assert [r[2] for r in few if r[0] == 0] == [1, 2, 20, 3]


def test_empty_table_and_a_query_alone(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest(none, F.col("vec_id") % 20 == 0).count() == 0
    alone = spark.createDataFrame([(0, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert nearest(alone, F.col("vec_id") % 20 == 0).count() == 0


def test_chi_square_quantiles():
    assert math.isclose(chi_square_quantile(0.95, 2), 5.991464547, rel_tol=1e-8)
    assert math.isclose(chi_square_quantile(0.99, 10), 23.20925116, rel_tol=1e-8)
