import random

import numpy as np
import pytest
from brute import hard_negatives
from pyspark.sql import functions as F

from fluxtrace.llm.hard_negatives import MiningParams, best, mine_hard_negatives, product

SCHEMA = "vec_id long, label int, embedding array<float>"


def mined(spark, table, schema=SCHEMA, every=3, **params):
    frame = spark.createDataFrame(table, schema)
    return sorted(map(tuple, mine_hard_negatives(frame, F.col("vec_id") % every == 0, MiningParams(**params)).collect()))


def vectors(n, width=7, seed=1, labels=3):
    rng = random.Random(seed)
    return [(i, rng.randrange(labels), [rng.choice([-0.5, 0.25, 0.1, 0.3, 0.51]) for _ in range(width)]) for i in range(n)]


@pytest.mark.parametrize("tiles", [{}, {"rows": 5, "anchors": 4, "chunk": 3}, {"rows": 1, "anchors": 1, "chunk": 1}])
def test_tiles_of_any_size_give_what_brute_force_gives(spark, tiles):
    rows = vectors(40)
    assert mined(spark, rows, **tiles) == hard_negatives(rows, 3)


def test_ties_go_to_the_lesser_id(spark):
    rows = [(i, i % 2, [0.5, 0.5]) for i in range(40)]
    found = mined(spark, rows, rows=4, anchors=3, chunk=1, every=10)
    assert found == hard_negatives(rows, 10)
    assert [r[3] for r in found if r[0] == 0 and r[1] == 2] == [1, 3, 5, 7, 9]


def test_nulls_odd_components_lengths_and_columns(spark):
    rows = [(0, 1, [1.0, 2.0]), (1, 1, [1.0]), (2, 2, [0.9, 2.0, 5.0]), (3, None, [1.0]), (4, 1, None), (5, 2, [None, 1.0]), (6, 2, [float("nan")]), (7, 2, [float("inf")]), (None, 2, [1.0]), (9, 2, []), (10, 2, [0.5, 0.5]), (12, 1, [])]
    kept = [r for r in rows if r[0] in (0, 1, 2, 9, 10, 12)]
    assert mined(spark, rows) == hard_negatives(kept, 3)
    named = [(*r, 7, "x") for r in rows]
    assert mined(spark, named, SCHEMA + ", score long, block string") == hard_negatives(kept, 3)


def test_large_components_are_exact(spark):
    rng = random.Random(2)
    rows = [(i, i % 2, [float(np.float32(rng.uniform(-3e6, 3e6))) for _ in range(5)]) for i in range(30)]
    assert mined(spark, rows, chunk=2) == hard_negatives(rows, 3)
    most = 2**63 - 1  # where components stop; its square is 1 in 64 bits
    assert most**2 % 2**64 == 1 and mined(spark, [(0, 0, [1e30]), (1, 0, [1e30]), (2, 1, [1e30])]) == [(0, 1, 1, 2, 1, 1)]


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [(0, 1, [1.0]), (0, 1, [1.0]), (1, 2, [0.9])]
    assert mined(spark, rows) == [(0, 0, 1, 1, 65536, 58880)] * 2


def test_empty_tables_and_single_rows(spark):
    assert mined(spark, []) == [] == mined(spark, [(0, 1, [1.0])]) == mined(spark, [(1, 1, [1.0]), (2, 1, [1.0])])


def test_a_label_with_most_rows(spark):
    rows = [(i, 0 if i % 10 else 1, [((i * 7) % 23) / 23, ((i * 5) % 19) / 19]) for i in range(300)]
    assert mined(spark, rows, rows=32, anchors=16, every=25) == hard_negatives(rows, 25)


def test_products_and_choices():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-(2**40), 2**40, (3, 4)), rng.integers(-(2**20), 2**20, (5, 4))
    assert product(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a]
    scores, allowed = rng.integers(0, 5, (6, 50)), rng.random((6, 50)) < 0.5
    row, at = best(scores, allowed, 3)
    for r in range(6):
        assert at[row == r].tolist() == sorted(np.flatnonzero(allowed[r]), key=lambda c: (-scores[r, c], c))[:3]
