"""The audit against plain Python: all orders, edge cases, and classes that hold several texts."""

import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from hearthline.llm import audit
from hearthline.llm.common import cut
from tests.rows import same

LONG = "word " * 30_000
ROWS = [
    (1, None, "a"), (2, "", "a"), (3, "Hello WORLD #1", None), (4, "same text here", "b"), (5, "same text here", ""), (6, "same text here", "b"), (6, "same text here", "b"), (7, LONG, "a"), (8, LONG, "b"),
    (9, LONG + "x", "a"), (None, "same text here", "a"), (None, "same text here", "a"), (10, " ".join(f"w{i}" for i in range(80)), "a"), (10, "A" * 70, "a"), (11, "A" * 70, "c"), (12, "a b " * 60, "c"), (13, "é" * 65, "c"), (14, "é" * 64 + "e", "c"), (15, "é" * 65, "a"),
]
LABELS = [(1, 1, 0), (4, 1, 1), (6, 0, 1), (6, 1, 0), (8, 1, None), (13, None, 1), (None, 1, 1), (99, 1, 1)]


def brute(rows, labels):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    docs = []
    for i, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > least[t]}
        docs.append((s or "", {f for f in bad if bad[f]}, any(k == i and q == 1 for k, q, _ in labels if i is not None), any(k == i and x == 1 for k, _, x in labels if i is not None)))
    out = {}
    for part in {d[0] for d in docs}:
        own = [d[1:] for d in docs if d[0] == part]
        for order in permutations("ABCDE"):
            alive = list(own)
            for step, f in enumerate(order, 1):
                gone = [d for d in alive if f in d[0]]
                out[part, "".join(order), step] = [
                    len(alive) - len(gone), len(gone), sum(f in d[0] and bool(d[0] & set(order[: step - 1])) for d in own), sum(d[0] == {f} for d in own), sum(d[1] for d in gone), sum(d[2] for d in gone),
                ]
                alive = [d for d in alive if f not in d[0]]
    total = {}
    for (part, order, step), row in out.items():
        total[part, order[step - 1]] = total.get((part, order[step - 1]), 0) + row[1]
    return {k: [*row, total[k[0], k[1][k[2] - 1]]] for k, row in out.items()}


def frames(spark, rows=ROWS, labels=LABELS):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, mask string").repartition(3)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_equals_brute_force(spark):
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in COLUMNS] for r in audit.audit_filters(*frames(spark)).collect()}
    assert got == brute(ROWS, LABELS)


def test_empty_tables(spark):
    docs, labels = frames(spark)
    assert audit.audit_filters(docs.limit(0), labels).count() == 0
    assert audit.audit_filters(docs, labels.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


@pytest.mark.parametrize("few", [0, 500_000])
def test_classes_of_several_texts(spark, monkeypatch, few):
    """Hashes that say nothing leave all texts of a length in one class; comparing them whole still tells them apart."""
    monkeypatch.setattr(audit, "MOST_BROADCAST", few)
    weak = lambda *parts: F.lit(0).cast("long")
    docs, _ = frames(spark)
    text = F.coalesce("text", F.lit(""))
    rows = cut(docs.select("doc_id", text.alias("said"), audit.block_chain(text, weak).alias("chain"), audit.marked(text).alias("mark")))
    found = sorted((r["doc_id"], r["said"][:5]) for r in audit.copies(docs, rows, hashed=weak).collect())
    assert found == [(2, ""), (5, "same "), (6, "same "), (6, "same "), (8, "word "), (11, "AAAAA"), (15, "ééééé")]


def test_refinement_drops_what_is_alone(spark):
    docs, _ = frames(spark)
    text = F.coalesce("text", F.lit(""))
    rows = cut(docs.where("doc_id is not null").select("doc_id", audit.block_chain(text).alias("chain")))
    assert sorted(r["doc_id"] for r in audit.refine(rows).collect()) == [1, 2, 4, 5, 6, 6, 7, 8, 10, 11, 13, 15]


def test_query_equals_sql(spark, sf, duck):
    assert same(audit.op11_filter_audit(spark, sf), duck, audit.OP11_SQL) > 0


def test_rounds_keep_the_number_of_partitions(spark):
    docs, _ = frames(spark)
    text = F.coalesce("text", F.lit(""))
    rows = cut(docs.where("doc_id is not null").select("doc_id", audit.block_chain(text).alias("chain")).repartition(5))
    assert audit.refine(rows).rdd.getNumPartitions() <= 5
