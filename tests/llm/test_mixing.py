import random
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from hearthline.llm import mixing
from tests.rows import same


def test_water_fill():
    got = mixing.water_fill([100, 10, 1000], [3, 1, 2], 1.5 * 1110, 2)
    assert got[:2] == [200.0, 20.0] and got[2] == pytest.approx(1445.0)
    assert mixing.water_fill([0, 0], [3, 1], 0.0, 2) == [0.0, 0.0]
    assert sum(mixing.water_fill([5, 7, 11, 300, 2], [3, 1, 2, 3, 1], 1.5 * 325, 2)) == pytest.approx(487.5)


def test_flow_repeats_as_little_as_it_can():
    # "ab" can serve both; a alone has 10 words, so b gets the shared words and nothing is taken twice
    flow = mixing.min_cost_flow({("a",): 10, ("a", "b"): 10}, {"a": 10, "b": 10}, {("a",): ("a",), ("a", "b"): ("a", "b")}, 2)
    assert flow == {(("a",), "a"): 10, (("a", "b"), "b"): 10}
    flow = mixing.min_cost_flow({("a",): 10}, {"a": 25}, {("a",): ("a",)}, 2)
    assert flow == {(("a",), "a"): 20}


def slow_flow(supply, demand, arcs, repeats):
    """Cost and size of the best flow, a word at a time over shortest paths."""
    edges = []
    for p, n in supply.items():
        edges += [["s", p, n, k * k] for k in range(1, repeats + 1)] + [[p, ("d", d), 10**6, 0] for d in arcs[p]]
    edges += [[("d", d), "t", n, 0] for d, n in demand.items()]
    flow, cost, sent = [0] * len(edges), 0, 0
    while True:
        far, via = {"s": 0}, {}
        for _ in range(len(supply) + len(demand) + 2):
            for i, (a, b, n, c) in enumerate(edges):
                for x, y, room, w, sign in ((a, b, n - flow[i], c, 1), (b, a, flow[i], -c, -1)):
                    if room > 0 and x in far and far[x] + w < far.get(y, 10**9):
                        far[y], via[y] = far[x] + w, (x, i, sign)
        if "t" not in far:
            return sent, cost
        cost, sent, y = cost + far["t"], sent + 1, "t"
        while y != "s":
            y, i, sign = via[y]
            flow[i] += sign


def test_flow_against_slow_one():
    rng = random.Random(9)
    for _ in range(40):
        sources = "abcd"[: rng.randrange(1, 5)]
        patterns = {p for _ in range(rng.randrange(1, 7)) if (p := tuple(sorted(set(rng.choices(sources, k=rng.randrange(1, 4))))))}
        supply, demand = {p: rng.randrange(0, 7) for p in patterns}, {s: rng.randrange(0, 12) for s in sources}
        got = mixing.min_cost_flow(supply, demand, {p: p for p in patterns}, 2)
        out = {p: sum(v for (q, _), v in got.items() if q == p) for p in patterns}
        assert all(sum(v for (_, t), v in got.items() if t == s) <= demand[s] for s in sources)
        cost = sum(min(n, supply[p]) + 4 * max(0, n - supply[p]) for p, n in out.items())
        assert all(n <= 2 * supply[p] for p, n in out.items()) and (sum(out.values()), cost) == slow_flow(supply, demand, {p: p for p in patterns}, 2)


def test_flow_of_many_patterns():
    """Overlaps of 14 sources, 16 thousand patterns."""
    names = [f"s{k:02}" for k in range(14)]
    supply = {tuple(n for j, n in enumerate(names) if k >> j & 1): 1 + k % 50 for k in range(1, 1 << 14)}
    demand = {n: sum(supply.values()) // (8 + j) for j, n in enumerate(names)}
    start = time.process_time()
    got = mixing.min_cost_flow(supply, demand, {p: p for p in supply}, 2)
    assert sum(got.values()) == min(sum(demand.values()), 2 * sum(supply.values()))
    assert time.process_time() - start < 60


def brute(rows, plan_of):
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    for s, own in by.items():
        yield s, sum(r["taken"] for r in own), plan_of[s]


def test_query(spark, sf, duck):
    same(mixing.op1_mix_sources(spark, sf).drop("source"), duck, f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.OP1_SQL})")
    rows = mixing.op1_mix_sources(spark, sf).collect()
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    for _, taken, target in brute(rows, {r["source"]: r["target"] for r in rows}):
        assert abs(taken - target) <= 1


def test_edges_and_overlap(spark):
    docs = spark.createDataFrame(
        [(1, ["a"], 10, "x"), (1, ["a"], 10, "x"), (2, ["a", "b"], 30, "y"), (3, None, 5, None), (None, ["b"], 7, None), (4, [None], 9, None), (5, ["b"], None, None), (6, [], 3, None)],
        "doc_id long, members array<string>, size long, taken string",
    )
    out = mixing.mix_sources(docs, id_col="doc_id", size_col="size", members_col="members", weights=(1, 1, 1), budget_ratio=1.0, max_repeats=2)
    rows = out.collect()
    assert len(rows) == 8 and out.columns == ["doc_id", "members", "size", "taken", "drawn"]
    assert all(r["taken"] == sum(d["words"] for d in r["drawn"]) for r in rows)
    assert all(r["taken"] <= 2 * (r["size"] or 0) for r in rows)
    assert {r["taken"] for r in rows if not r["members"]} == {0}
    assert mixing.mix_sources(docs.limit(0), id_col="doc_id", size_col="size", members_col="members", weights=(1,), budget_ratio=1.0).count() == 0


def test_reruns_agree(spark, sf):
    a, b = (mixing.op1_mix_sources(spark, sf).agg(F.sum(F.xxhash64("doc_id", "taken").cast("decimal(38,0)"))).first()[0] for _ in range(2))
    assert a == b
