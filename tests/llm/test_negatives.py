"""Hard negatives against all scores."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orogen.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<float>"


def plain(rows, is_anchor, positives=5, count=10, low=30, high=90):
    usable = [
        (i, c, [math.floor(256 * float(np.float32(x))) for x in v]) for i, c, v in rows
        if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for i, c, v in usable:
        if not is_anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, d) for j, d, w in usable if j != i)
        for p, j, _ in [x for x in scored if x[2] == c][:positives]:
            fit = [(s, k) for s, k, d in scored if d != c and 100 * s <= low * p and 100 * s >= high * p] if p <= 0 else []
            out += [(i, j, rank, k, -p, -s) for rank, (s, k) in enumerate(fit[:count], 1)]
    return sorted(out)


def got(df):
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    centres = [[r.gauss(0.1, 0.2) for _ in range(20)] for _ in range(4)]
    out = [(k, r.randrange(4), [x + r.gauss(0, 0.15) for x in centres[r.randrange(4)]]) for k in range(600)]
    out += [(600 + k, k % 4, out[k % 5][2]) for k in range(40)]  # ties
    return out


@pytest.mark.parametrize("band_bytes", [1, negatives.BAND_BYTES])
def test_windows_equal_a_full_search(spark, rows, band_bytes):
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    near = negatives.hard_negatives(table, F.col("vec_id") % 100 == 0, band_bytes=band_bytes)
    want = plain(rows, lambda i: i % 100 == 0)
    assert len(want) > 200 and got(near) == want


def test_odd_rows(spark, rows):
    odd = rows[:200] + [(None, 1, [0.5] * 20), (700, None, [0.5] * 20), (701, 1, None), (702, 1, [None] * 20), (703, 1, [math.nan] * 20), (704, 1, [math.inf] + [0.0] * 19)]
    odd += [(800, 1, []), (801, 1, [0.3] * 25), (802, 2, [0.3] * 3), (900, 0, [0.0] * 20), rows[7], (7, 3, rows[8][2])]
    table = spark.createDataFrame(odd, SCHEMA).withColumn("number", F.lit("clash")).withColumn("rank", F.lit(1))
    assert got(negatives.hard_negatives(table, F.col("vec_id") % 50 == 0)) == plain(odd, lambda i: i % 50 == 0)
    assert negatives.hard_negatives(table.where("false"), F.col("vec_id") % 50 == 0).count() == 0
    assert negatives.hard_negatives(table, F.col("vec_id") < 0).count() == 0


def test_repeated_anchors_and_large_components(spark):
    rows = [(0, 0, [1e30, 1.0])] * 2 + [(k, k % 2, [float(k % 7), float(k % 3)]) for k in range(1, 40)] + [(50, 1, [-1e30, 2.0])]
    table = spark.createDataFrame(rows, SCHEMA)
    found = got(negatives.hard_negatives(table, F.col("vec_id") == 0))
    assert found and found[::2] == found[1::2]


def test_candidates_leave_before_all_dimensions_are_read(rows):
    """The bounds do shrink the bitmap: later looks see fewer candidates, and what stays has its exact score."""
    m = np.array([[math.floor(256 * x) for x in v] for *_, v in rows], np.int32).T
    block = negatives.Block(len(rows), np.arange(len(rows)).tobytes(), np.zeros(len(rows), np.int64).tobytes(), m.tobytes())
    sizes = []

    def useful(lower, upper):
        sizes.append(len(lower))
        return upper >= negatives._kth(lower, 5)

    live, scores = negatives._scan(block, m[:, 0].astype(np.int64), np.ones(len(rows), bool), useful)
    exact = m.T.astype(np.int64) @ m[:, 0]
    assert sizes[-1] < sizes[0] and (scores == exact[live]).all() and set(np.argsort(-exact, kind="stable")[:5]) <= set(live)
