import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import topk

SCHEMA = "vec_id long, embedding array<double>, label int, rank int, score long, shard int"


def plain(rows, step, k):
    vectors = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
               if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in vectors if i % step == 0}):
        mine = min(v for i, v in vectors if i == q)
        scores = sorted((-sum(a * b for a, b in zip(mine, v)), i) for i, v in vectors if i != q and len(v) == len(mine))
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scores[:k], 1)]
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2, 3) for i, v in rows], SCHEMA)


def found(df, **options):
    rows = topk.top_k(df, F.col("vec_id") % 5 == 0, **options).orderBy("query_id", "rank").collect()
    return [(r.query_id, r["rank"], r.vec_id, r.score) for r in rows]


@pytest.mark.parametrize("sizes", [{}, {"query_block": 2, "shard": 3}])
def test_agrees_with_all_pairs(spark, sizes):
    rng = random.Random(4)
    rows = [(i, [rng.choice((-0.01, 0.004, 0.5)) for _ in range(3)]) for i in range(80)]
    rows += [(200, None), (205, [None, 0.1, 0.2]), (210, [math.nan, 0.1, 0.2]), (215, [math.inf, 0.1, 0.2]), (None, [0.1, 0.1, 0.1]), (220, [0.5, 0.5]), (221, [0.5, 0.25]),
             (225, []), (226, []), (3, [0.5, 0.5, 0.5]), (3, [0.5, 0.5, 0.5]), (10, [0.4, 0.4, 0.4])]
    assert found(table(spark, rows), k=5, **sizes) == plain(rows, 5, 5)


def test_few_and_no_rows(spark):
    assert found(table(spark, [(0, [1.0]), (1, [2.0])])) == [(0, 1, 1, 256 * 512)]
    assert found(table(spark, [(0, [1.0])])) == [] and found(table(spark, [])) == []


def test_wide_numbers_stay_exact():
    q, v = np.array([[2**40, 3]]), np.array([[2**20, 1], [2**20, 2], [2**22, 5]])
    assert topk._products(q, v).tolist() == [[2**60 + 3, 2**60 + 6, 2**62 + 15]]
    assert topk._products(np.array([[2**40], [-(2**40)]]), np.array([[2**40]])).tolist() == [[2**63 - 1], [1 - 2**63]]
    rng = np.random.default_rng(5)
    for bits, kind in ((8, np.int16), (15, np.int16), (25, np.int32), (40, np.int64)):
        q, v = (rng.integers(-(2**bits), 2**bits, (5, 9)).astype(kind) for _ in range(2))
        want = q.astype(object) @ v.T.astype(object)
        assert (topk._products(q, v) == np.clip(want, 1 - 2**63, 2**63 - 1).astype(np.int64)).all()


def test_wide_components_are_a_result(spark):
    """Finite components of any size: what does not fit a long counts as the nearest one, and no row ends the query."""
    rows = [(0, [1e18, 1.0]), (1, [1.0, 1.0]), (2, [-1e300, 0.0]), (3, [1e308, 0.0]), (4, [0.0, 2.0])]
    top = 2**63 - 1
    assert found(table(spark, rows)) == [(0, 1, 1, top), (0, 2, 3, top), (0, 3, 4, 256 * 512), (0, 4, 2, -top)]


def test_one_row_repeated_is_spread(spark):
    """A third of all rows are copies of one, a query; each is a candidate of all other queries."""
    rows = [(5, [0.5, 0.5])] * 40 + [(i, [0.01 * i, 0.5]) for i in range(6, 86)]
    assert found(table(spark, rows), query_block=3, shard=7) == plain(rows, 5, 5)


def test_vectors_are_shuffled_once(spark):
    """No exchange of vectors but the one that deals them over tasks, however many tiles of queries there are."""
    df = topk.top_k(table(spark, [(i, [0.1 * i, 0.5]) for i in range(200)]), F.col("vec_id") % 5 == 0, query_block=4)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") == 1 and "Generate" not in plan and "Cogroup" not in plan


def test_ties_at_the_edge():
    scores = np.array([[5, 7, 5, 5, 7, 1], [1, 1, 1, 1, 1, 1]])
    assert topk._best(scores, np.arange(6), 4).tolist() == [[1, 4, 0, 2], [0, 1, 2, 3]]
