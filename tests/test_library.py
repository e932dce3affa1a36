"""Entities, stored orders and stored caches."""

import html
import html.entities
import random
import shutil

from pyspark.sql import functions as F

from hearthline.functions import text
from hearthline.operators import dashboard, units as ops
from hearthline.sources import portals, raw
from hearthline.sources.paged import PagedSource


def test_entities_equal_the_standard_library(spark):
    r = random.Random(3)
    names = list(html.entities.html5)
    rows = [f"a &{n} b" for n in names] + [f"&{n.rstrip(';')}" for n in names] + [f"&{n.rstrip(';')}x{n}" for n in names[::7]] + [f"&#{n};" for n in (*range(0, 300), 0xD800, 0xFDD0, 0xFFFE, 0xFFFF, 0x1F600, 0x10FFFF, 0x110000, 10**30)]
    rows += [f"&#x{n:X}" for n in range(100, 200)] + ["&", "&&", "&;", "&#;", "&#x;", "&amp;lt;", "& amp;", "&ampamp;", "&notit;", "&notin;", "AT&T &co", "&" + "x" * 50 + ";", "", "é &eacute;&Eacute &#233"]
    rows += ["".join(r.choice(["&", "amp", ";", "lt", "not", "#", "38", " ", "in", "x"]) for _ in range(9)) for _ in range(300)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").select("i", "t", text.unescape(F.col("t")).alias("u")).collect()
    assert [(x["t"], x["u"]) for x in got if x["u"] != html.unescape(x["t"])] == []


def test_page_of_stored_order_reads_no_other_block(spark, tmp_path):
    units = spark.range(1000).select(F.col("id").alias("pos"), (F.col("id") % 37).cast("double").alias("rent"))
    dashboard.store_order(units, "rent-asc", ["pos"], str(tmp_path / "o"), block=100)
    want = sorted(range(1000), key=lambda i: (i % 37, i))
    for gone in (tmp_path / "o").glob("block=*"):
        if gone.name not in ("block=4", "block=5"):
            shutil.rmtree(gone)
    page = lambda **k: [r["pos"] for r in dashboard.stored_page(spark, str(tmp_path / "o"), block=100, **k).collect()]
    assert page(page=9) == want[450:500] and page(size=30, page=16) == want[480:510] and page(page=12) == []


def exchanges_over(plan: str, table: str) -> list[str]:
    """Exchanges on the way from the plan's top to the scan of a table."""
    lines = plan.splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    at = next(i for i, line in enumerate(lines) if f"FileScan parquet" in line and table in line)
    out, level = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if line.strip() and depth(line) < level:
            level = depth(line)
            out += [line] if "Exchange" in line else []
    return out


def test_stored_cache_is_not_shuffled(spark):
    cache = spark.createDataFrame([(f"u{i}", "none") for i in range(50)] + [("", "cats_only")], "url string, pets string")
    units = spark.createDataFrame([(f"u{i % 70}", None, i) for i in range(200)] + [(None, None, 200), ("u1", "allowed", 201)], "url string, pets string, pos int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    stored = raw.store_by_url(cache, "stored_cache_test", buckets=4)
    try:
        filled = ops.fill(units, stored, ("pets",))
        assert sorted((r["pos"], r["pets"]) for r in filled.collect()) == sorted((r["pos"], r["pets"]) for r in ops.fill(units, cache, ("pets",)).collect())
        with_url = units.where("url <> ''").join(stored, "url", "left")
        plan = with_url._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1 and exchanges_over(plan, "stored_cache_test") == []
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE stored_cache_test")


def test_paged_source(spark, tmp_path):
    """Pages of files: full, short, empty, broken and missing ones; ranges of pages are tasks of their own."""
    spark.dataSource.register(PagedSource)

    def read(**bodies):
        folder = tmp_path / str(len(list(tmp_path.iterdir())))
        folder.mkdir()
        for page, body in bodies.items():
            (folder / f"{page}.json").write_text(body)
        pages = spark.read.format("hearthline_pages").option("url", f"{folder.as_uri()}/p{{page}}.json").option("pages", 9).option("pages_a_task", 2).option("per_page", 3).load()
        pages = pages.withColumn("source", F.lit("s")).cache()
        stopped = portals.until_stop(pages, per_page=3, most=9)
        return sorted(r["page"] for r in stopped.collect()), portals.failed_sources(spark.createDataFrame([("s",)], "source string"), pages).count(), pages.where("error is not null").count()

    full = "[1,2,3]"
    assert read(p1=full, p2=full, p3="[1]", p4=full) == ([1, 2, 3], 0, 3)
    assert read(p1=full, p2="[]", p3=full)[:2] == ([1], 0)
    assert read(p1=full, p2=full, p3="{broken", p4=full)[:2] == ([1, 2], 0)
    assert read(p2=full)[:2] == ([], 1)
    assert read(p1="[]")[:2] == ([], 0)
    assert read(**{f"p{k}": full for k in range(1, 12)})[:2] == (list(range(1, 10)), 0)


def test_stored_order_lists_no_other_block(spark, tmp_path):
    """Folders that aren't a page's don't count, even one that Spark couldn't take for a block."""
    units = spark.range(300).select(F.col("id").alias("pos"), F.col("id").cast("double").alias("rent"))
    dashboard.store_order(units, "rent-asc", ["pos"], str(tmp_path / "o"), block=100)
    (tmp_path / "o" / "other=1" / "block=x").mkdir(parents=True)
    (tmp_path / "o" / "other=1" / "block=x" / "a.parquet").write_bytes(b"no parquet")
    page = lambda n: [r["pos"] for r in dashboard.stored_page(spark, str(tmp_path / "o"), page=n, block=100).collect()]
    assert page(3) == list(range(150, 200))
