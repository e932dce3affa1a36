"""Every query equals its SQL."""

import pytest
from pyspark.sql import functions as F

from hearthline.plans import catalog
from hearthline.sources import portals
from tests.rows import same


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, sf, duck, name):
    assert name in catalog.SQL, "each of these has SQL"
    same(catalog.QUERIES[name](spark, sf), duck, catalog.SQL[name])


@pytest.mark.parametrize("name,platform,column,mark", [("src04_buildium", "buildium", "html", "<h3"), ("src09_relisto", "relisto", "payload", '"id"'), ("src10_tripalink", "tripalink", "payload", '"leasePolicy"')])
def test_adapters_see_cards_without_address(spark, sf, monkeypatch, name, platform, column, mark):
    seen = []

    def kept(pages, today, real=portals.ADAPTERS[platform]):
        seen.append(pages)
        return real(pages, today)

    monkeypatch.setitem(portals.ADAPTERS, platform, kept)
    monkeypatch.setattr(portals, platform, kept)
    given = catalog.QUERIES[name](spark, sf).count()
    cards = seen[0].agg(F.sum(F.regexp_count(column, F.lit(mark)))).first()[0]
    assert cards == spark.read.parquet(f"{sf}/orders.parquet").count() > given


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
