"""The trie against plain Python, over conversations that cross partitions, hot prefixes and edge cases."""

import hashlib
import math
import random
import re
import zlib

import pytest

from hearthline.llm import tries
from tests.rows import same


def rebuilt(by_conv):
    out = {}
    for c, own in by_conv.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = by_conv.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:]  # as in SQL, what is left has the sign of c
    return out


def by_conversation(rows):
    convs = {}
    for c, t, r, x in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        convs.setdefault(c, []).append((r or "", x or ""))
    return convs


def brute(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = {}
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        leaves = [q for q in below if not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in nodes)]
        saved = sum((len(nodes[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in members if len(convs[c]) == len(p))))
        out[min(members), len(p)] = (
            min(nodes[p[:-1]]) if p else None, len(members), sum(len(q) == len(p) + 1 for q in below), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest(), len(below),
        )
    return out


def got(df):
    rows = [r.asDict() for r in df.collect()]
    assert sorted(r["first"] for r in rows) == list(range(len(rows)))  # preorder has no gaps
    return {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"], r["last"] - r["first"] + 1) for r in rows}


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, depth int").repartition(3)


EDGES = [
    (0, 1, "user", "hi there"), (0, 2, "bot", "hello you"), (0, 2, "bot", "hello you"), (0, None, "user", "first of all"), (1, 1, None, None), (2, 1, "", ""), (3, 5, "user", "hi there"), (3, 7, None, "x"),
    (40, 1, "a", "b c"), (41, 1, "ab", " c"), (45, 9, "user", "long " * 5000), (45, 10, "user", "tail"), (-3, 1, "user", "negative"), (None, 1, "user", "nobody"), (61, 1, "user", "no base"), (62, 1, "u", "x"), (62, 2, "u", "y"), (62, 3, "u", "z"), (62, 4, "u", "q"),
]


def random_rows(seed):
    """Few texts, so that prefixes are shared; one conversation has a third of all turns, and a copy."""
    r = random.Random(seed)
    rows = [(c, t, r.choice(["user", "bot"]), r.choice(["a", "b b", "c c c"])) for c in range(0, 130) for t in range(r.randrange(1, 7))]
    deep = [(t, r.choice(["user", "bot"]), r.choice(["a", "b b"])) for t in range(150)]
    return rows + [(c, t, role, text) for c in (500, 501) for t, role, text in deep]


@pytest.mark.parametrize("rows", [EDGES, random_rows(1), random_rows(2)], ids=["edges", "random1", "random2"])
@pytest.mark.parametrize("batch", [3, 10_000])
def test_equals_brute_force(spark, rows, batch):
    """Arrow batches of a few rows cut conversations within partitions too."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        convs = by_conversation(rows)
        assert got(tries.conversation_trie(frame(spark, rows), rebuild=True)) == brute(rebuilt(convs))
        if batch > 3:
            assert got(tries.conversation_trie(frame(spark, rows))) == brute(convs)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_no_conversations(spark):
    assert tries.conversation_trie(frame(spark, EDGES).limit(0), rebuild=True).count() == 0
    assert tries.conversation_trie(frame(spark, [(None, 1, "user", "x")])).count() == 0


def test_query_equals_sql(spark, sf, duck):
    assert same(tries.op12_conversation_trie(spark, sf).drop("first", "last"), duck, tries.OP12_SQL) > 0


def test_query_has_the_columns_of_its_sql(spark, sf, duck):
    assert same(tries.op12_conversation_trie(spark, sf), duck, tries.OP12_SQL) > 0
