"""Repeats against plain Python over bytes: several batches and levels, hot passages, texts cut in chunks."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from hearthline.llm import suffixes


def brute(rows, length=100):
    """By (id, text): n_bytes, n_removed, n_spans, kept. rows: (id, text), null ids last, equal rows once."""
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    docs = {}
    for (i, text), h in rows:
        docs[i, text or ""] = (i, (text or "").encode(), h)
    seen, out = set(), {}
    for (i, text), doc in sorted(docs.items(), key=lambda kv: key(kv[1])):
        b = doc[1]
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if s in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(s)
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(b)))
        out[i, text] = (len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return out


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, doc int").repartition(3)
    hashes = {(r["doc_id"], r["text"]): r["h"] for r in df.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    counts = {}
    for r in suffixes.remove_repeats(df, **more).collect():
        counts.setdefault(r["doc_id"], []).append((r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])))
    want = {}
    facts = brute([(r, hashes[r]) for r in rows], more.get("length", 100))
    for i, text in rows:
        want.setdefault(i, []).append(facts[i, text or ""])
    assert {k: sorted(v) for k, v in counts.items()} == {k: sorted(v) for k, v in want.items()}
    return counts


def prose(r, n):
    return " ".join("".join(r.choice("abcdefghijé") for _ in range(r.randrange(2, 8))) for _ in range(n))


def corpus(seed):
    """Copies, shared passages at all places, edits, periodic texts, short, empty and long ones."""
    r = random.Random(seed)
    hot, passages = prose(r, 30), [prose(r, 40) for _ in range(5)]
    rows = [(i, prose(r, r.randrange(1, 60))) for i in range(20)]
    rows += [(20 + i, prose(r, 5) + r.choice(passages)[r.randrange(60) : r.randrange(100, 240)] + prose(r, 5) + hot) for i in range(40)]
    rows += [(60 + i, rows[20 + i % 3][1]) for i in range(9)]
    edited = list(rows[30][1])
    edited[len(edited) // 2] = "#"
    return rows + [(70, "".join(edited)), (71, None), (72, ""), (73, "x" * 700), (74, "ab" * 400), (75, "x" * 350), (76, passages[0] * 3), (77, prose(r, 900)), (-5, passages[1])]


@pytest.mark.parametrize("seed,batches,chunk,most", [(1, 4, 1 << 19, 8192), (2, 7, 300, 4), (3, 1, 4096, 2)])
def test_equals_brute_force(spark, seed, batches, chunk, most):
    """Also where chunks are shorter than texts, and nearly all entries count as frequent."""
    counts = run(spark, corpus(seed), least_batches=batches, chunk=chunk, most_of_gram=most)
    assert sum(r[1] for rows in counts.values() for r in rows) > 5000


def test_ties_and_nulls(spark):
    r = random.Random(9)
    a, b = prose(r, 60), prose(r, 60)
    run(spark, [(1, a), (1, a), (1, b + a), (None, b), (None, b), (None, a + b), (2, b), (3, a[:150] + b[:150])], least_batches=2)


def test_other_lengths_and_empty_table(spark):
    run(spark, corpus(4)[15:50], length=70, least_batches=3)
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.remove_repeats(df).count() == 0


def test_levels_are_geometric_and_tables_go(spark):
    r = random.Random(5)
    family = suffixes.SuffixFamily(spark)
    shapes = []
    try:
        for k in range(5):
            docs = spark.createDataFrame([(10 * k + i, 0, prose(r, 200)) for i in range(6)], "doc long, th long, text string")
            family.add(docs)
            shapes.append(len(family.levels))
        assert shapes == [1, 2, 2, 3, 2] or max(shapes) <= 3
        assert family.levels[0][1] > family.levels[-1][1]
        assert spark.sql("show tables").where(F.col("tableName").startswith(family.name)).count() > 0
    finally:
        family.close()
    assert spark.sql("show tables").where(F.col("tableName").startswith(family.name)).count() == 0


def test_settings_are_put_back(spark):
    before = {k: spark.conf.get(k) for k in suffixes.MERGE_SCANS}
    with pytest.raises(ZeroDivisionError), suffixes.configured(spark, suffixes.MERGE_SCANS):
        raise ZeroDivisionError
    assert {k: spark.conf.get(k) for k in suffixes.MERGE_SCANS} == before


def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = brute([(r, 0) for r in rows])
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.op13_suffix_dedup(spark, sf).collect()}
    assert got == {i: (*want[i, t or ""][:3], hashlib.sha256(want[i, t or ""][3]).hexdigest()) for i, t in rows}
