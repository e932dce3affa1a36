"""The pipeline on sf0.001 against plain Python for each stage."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from hearthline.llm import quality
from tests.llm.test_decontamination import brute as leaks
from tests.llm.test_jaccard import brute as classes
from tests.llm.test_quality import brute as stats
from tests.llm.test_secrets import spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def keeps(text):
    n, chars, symbols, dup, repeats = stats(text)
    return not (n < 10 or 10 * symbols > 3 * n or 2 * len(re.findall("[A-Z]", text)) > len(text) or 2 * dup > len(text.split("\n")) or chars < 2 * n or chars > 15 * n or 100 * repeats > 20 * n)


@pytest.fixture(scope="module")
def result(spark, sf):
    return {r["doc_id"]: r for r in cp.run(spark, sf).collect()}


def test_run(spark, sf, result):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    alive = {d: r["text"] for d, r in docs.items() if keeps(r["text"] or "")}
    alive = {d: alive[d] for d, c, _ in classes(sorted(alive.items())) if d == c}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    found = {d for d, _ in leaks(sorted(alive.items()), items)}
    alive = {d: t for d, t in alive.items() if d not in found}

    def clean(t):
        out, at = "", 0
        for a, _, b in spans(t):
            if a >= at:
                out += t[at:a] + "[SECRET]"
            at = max(at, b)
        return out + t[at:]

    alive = {d: clean(t) for d, t in alive.items()}
    assert set(result) <= set(alive) and {d: r["text"] for d, r in result.items()} == {d: alive[d] for d in result}
    sizes = {d: len(WORD.findall(t)) for d, t in alive.items()}
    assert all(0 < r["taken"] <= 2 * sizes[d] for d, r in result.items())
    assert abs(sum(r["taken"] for r in result.values()) - 1.5 * sum(sizes.values())) < 20
    assert all(r["n_chars"] == len(r["text"]) for d, r in result.items() if "[SECRET]" in r["text"])


def test_rows_of_repeated_and_null_ids(spark, sf):
    """Row by row: copies go, other rows of the same id stay, no row is multiplied."""
    prose = lambda k, n=30: " ".join(f"word{k}x{j}" for j in range(n))
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    rows = [
        (1, prose("a"), "en", "s", 1), (2, prose("a"), "en", "s", 1), (2, prose("b"), "en", "s", 1), (5, prose("g"), "en", "t", 1), (5, prose("g"), "en", "t", 1), (5, prose("h"), "en", None, 1),
        (None, prose("n"), "en", "s", 1), (None, prose("n"), "en", "t", 1), (None, prose("a") + " more", "en", "t", 1), (None, None, None, None, None), (7, f"{prose('i')} {item} {prose('j')}", "en", "s", 1),
        (7, prose("k") + " password=abcdefghijklmnop", "en", "s", 1), (8, "too short", "en", "s", 1), (9, prose("long", 20_000), "en", "u", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    at, seen = docs, []
    for name, stage in cp.STAGES:
        at = stage(spark, at, sf)
        seen.append(sorted(((r["doc_id"], (r["text"] or "")[:12]) for r in at.collect()), key=repr))
    key = lambda *xs: sorted(((d, t[:12]) for d, t in xs), key=repr)
    full = [(d, t or "") for d, t, *_ in rows if t and t != "too short"]
    assert seen[0] == key(*full)
    one = [(1, prose("a")), (2, prose("b")), (5, prose("g")), (5, prose("h")), (None, prose("n")), (7, prose("i")), (7, prose("k")), (9, prose("long"))]
    assert seen[1] == key(*one)
    assert seen[2] == seen[3] == key(*(x for x in one if x[1] != prose("i")))
    assert len(seen[4]) == len(set(seen[4])) and set(seen[4]) <= set(seen[3])
    mixed = at.collect()
    assert all(0 < r["taken"] <= 2 * len(WORD.findall(r["text"])) for r in mixed) and any(r["doc_id"] is None for r in mixed)
    assert [r["text"].endswith("[SECRET]") for r in mixed if r["doc_id"] == 7] == [True] * sum(r["doc_id"] == 7 for r in mixed)


def test_stages_keep_columns_and_live_with_edges(spark, sf):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "the quick brown fox jumps over one lazy dog and then sleeps well", "en", None, 60), (3, "the quick brown fox jumps over one lazy dog and then sleeps well", "en", None, 60), (None, "another small text that has enough words to be kept by every rule", "en", "s", 66)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for start in (docs, docs.limit(0)):
        at = start
        for name, stage in cp.STAGES[:-1]:
            at = stage(spark, at, sf)
            assert tuple(at.columns) == cp.COLUMNS, name
        assert cp.STAGES[-1][1](spark, at, sf).columns[:5] == list(cp.COLUMNS)
    assert quality.quality_filter(docs).where(F.col("doc_id") == 3).count() == 2
