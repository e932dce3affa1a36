"""Exact ranks against numpy, with limits so low that several rounds are needed."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthline.operators import selection

rng = np.random.default_rng(5)
VALUES = {
    "distinct": rng.permutation(4001).astype(float),
    "skewed": np.exp(rng.normal(size=3000) * 30),
    "tied": rng.integers(0, 3, 5000).astype(float),
    "one": np.array([7.0] * 900),
    "pair": np.array([1.0, 2.0]),
    "single": np.array([-3.5]),
    "half": np.concatenate([np.full(500, 1.0), np.full(500, 2.0)]),
}


@pytest.fixture(scope="module")
def rows(spark):
    data = [(k, float(v)) for k, vs in VALUES.items() for v in vs] + [(None, 4.0), (None, 9.0), ("nulls", None), ("one", None)]
    return spark.createDataFrame(data, "k string, v double").repartition(5)


@pytest.mark.parametrize("most", [1, 20, 10_000])
def test_medians(rows, most):
    got = {r["k"]: (r["n"], r["median"]) for r in selection.median(rows, F.col("v"), ["k"], most).collect()}
    assert got == {k: (len(v), float(np.median(v))) for k, v in VALUES.items()} | {None: (2, 6.5)}
    upper = {r["k"]: r["median"] for r in selection.upper_median(rows, F.col("v"), ["k"], most).collect()}
    assert upper == {k: float(np.sort(v)[len(v) // 2]) for k, v in VALUES.items()} | {None: 9.0}


@pytest.mark.parametrize("q", [0.0, 0.1, 0.99])
def test_other_ranks(rows, q):
    found = selection.at_rank(rows.where("k is not null"), F.col("v"), ["k"], F.floor(q * (F.col("n") - 1)), 5)
    for r in found.collect():
        vs = np.sort(VALUES[r["k"]])
        at = int(q * (len(vs) - 1))
        assert (r["value"], r["next"]) == (vs[at], vs[at + 1] if at + 1 < len(vs) else None), r["k"]


def test_whole_table_and_none(rows):
    every = np.concatenate([*VALUES.values(), [4.0, 9.0]])
    assert selection.median(rows, F.col("v"), most=50).first()["median"] == float(np.median(every))
    assert selection.median(rows.limit(0), F.col("v")).count() == 0


def test_no_task_sorts_more_than_the_limit(rows, monkeypatch):
    """What is gathered as an array is what the last range holds."""
    seen = []
    real = F.collect_list
    monkeypatch.setattr(selection.F, "collect_list", lambda c: (seen.append(c), real(c))[1])
    found = selection.at_rank(rows.where("k = 'distinct'"), F.col("v"), ["k"], F.floor(F.col("n") / 2), 40)
    assert found.first()["value"] == 2000.0 and len(seen) == 1
    sizes = [r["n"] for r in found.collect()]
    assert sizes == [4001]
