"""Resumable extraction: each page is asked for once, whatever dies."""

import collections
import os
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from hearthline.sources import extractor, portals, raw
from hearthline.sources.published import PublishedByKey


def reader(calls: str, dies_at: str | None = None):
    """Notes each page that it is asked for in a file, and kills its Python worker once at one of them, before it has an answer."""

    def read(pages: pd.DataFrame) -> pd.DataFrame:
        for url in pages["url"]:
            if url == dies_at and not Path(calls, "died").exists():
                Path(calls, "died").touch()
                os._exit(1)
            with open(Path(calls, "calls"), "a") as f:
                f.write(f"{url}\n")
        return pages[["url"]].assign(pets="none", method="llm", observed=[{"bedrooms": 2.0, "city": "Zürich"}] * len(pages), evidence=[{"pets": "no \"pets\""}] * len(pages))

    return read


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(f"u{i % 40}", f"text {i}") for i in range(60)], "url string, text string").repartition(3)


def asked(folder) -> collections.Counter:
    return collections.Counter(Path(folder, "calls").read_text().split()) if Path(folder, "calls").exists() else collections.Counter()


def test_killed_once_asks_each_page_once(spark, pages, tmp_path):
    """Local mode gives a failed task no second try, so the run fails; the next one goes on where it was."""
    journal = extractor.Journal((tmp_path / "journal").as_uri(), 4)
    extract = extractor.resumable(reader(str(tmp_path), "u17"), journal)
    with pytest.raises(Exception):
        extract(pages).collect()
    first = asked(tmp_path)
    assert 0 <= len(first) < 40 and (tmp_path / "died").exists()
    rows = extract(pages).collect()
    assert len(rows) == 40 and {r["pets"] for r in rows} == {"none"} and rows[0]["observed"]["city"] == "Zürich" and rows[0]["evidence"] == {"pets": 'no "pets"'}
    assert asked(tmp_path) == collections.Counter({f"u{i}": 1 for i in range(40)})
    found = extract(pages)
    assert found.count() == 40 and found.where("method = 'llm'").count() == 40  # two more actions
    assert sum(asked(tmp_path).values()) == 40


def test_answers_become_the_cache(spark, pages, tmp_path):
    journal = extractor.Journal((tmp_path / "journal").as_uri(), 4)
    cache = PublishedByKey(spark, str(tmp_path / "cache"), extractor.RESULT, "url", 4)
    assert extractor.absorb(spark, journal, cache) == 0
    extract = extractor.resumable(reader(str(tmp_path)), journal, chunk=7)
    extractor.read_pages(pages.where("url < 'u2'"), cache.read(), extract).collect()
    assert extractor.absorb(spark, journal, cache) == 1
    n = len(asked(tmp_path))
    rows = extractor.read_pages(pages, cache.read(), extract).collect()
    assert len(rows) == 40 and 0 < n < 40 and set(asked(tmp_path).values()) == {1}
    assert extractor.absorb(spark, journal, cache) == 2 and cache.read().count() == 40
    again = extractor.read_pages(pages, cache.read())
    assert again.count() == 40 and sum(asked(tmp_path).values()) == 40


def test_pages_without_answer_are_asked_again(spark, tmp_path):
    journal = extractor.Journal((tmp_path / "journal").as_uri(), 4)
    pages = spark.createDataFrame([("a", "x"), (None, "y"), ("b", None)], "url string, text string")
    some = extractor.resumable(lambda p: p[p["url"] == "a"][["url"]].assign(pets="none"), journal)
    assert [r["url"] for r in some(pages).collect()] == ["a"]
    every = extractor.resumable(lambda p: p[["url"]].assign(pets="allowed"), journal)
    assert {(r["url"], r["pets"]) for r in every(pages).collect()} == {("a", "none"), (None, "allowed"), ("b", "allowed")}
    assert every(pages.limit(0)).count() == 0
    assert raw.CACHE.startswith("url")


def test_fields_of_a_card_are_found_once(spark):
    """Later columns and filters read a field; none writes its pattern out again."""
    pages = spark.createDataFrame([("s", "M", "https://x.org", "<p>")], "source string, manager string, base_url string, html string")
    for platform, name in (("buildium", "featured-listing__title"), ("mmg", "wpl_prp_listing_location"), ("appfolio", "js-listing-address"), ("showmojo", "listing-address-header")):
        plan = portals.extract(pages, platform, F.lit("2027-03-09").cast("date"))._jdf.queryExecution().optimizedPlan().toString()
        assert 0 < plan.count(name) <= 2, platform
