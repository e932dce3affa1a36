"""Portals whose list comes in pages."""

from pyspark.sql import functions as F

from hearthline.plans import markup
from hearthline.sources import portals


def test_lists_are_as_long_as_they_are_however_many_orders(spark):
    orders = spark.range(20_000).withColumnRenamed("id", "o_orderkey")
    pages = markup.portal_pages(orders)
    assert pages.agg(F.max(F.length("body"))).first()[0] < 20_000
    base = spark.createDataFrame([("even", "M", "https://even.org"), ("odd", "M", "https://odd.org")], "source string, manager string, base_url string")
    ids = portals.tripalink_lists(base, pages)
    assert ids.select("source", "id").distinct().count() == ids.count() == 20_000


def test_a_list_in_one_body_and_one_in_pages(spark):
    base = spark.createDataFrame([("s", "M", "https://s.org")], "source string, manager string, base_url string")
    whole = "https://s.org" + portals.LIST_JSON.format("b")
    body = lambda *ids: '{"pageProps":{"data":{"ESProperties":{"data":[' + ",".join(f'{{"id":"{i}"}}' for i in ids) + "]}}}}"
    page = ("https://s.org" + portals.LISTING_PAGE, '<script id="__NEXT_DATA__" type="application/json">{"buildId":"b"}</script>')
    for rows in ([(whole, body(1, 2, 3))], [(whole + portals.LIST_PAGE + "1", body(1, 2)), (whole + portals.LIST_PAGE + "12", body(3)), (whole + "x", body(9))]):
        got = portals.tripalink_lists(base, spark.createDataFrame([page, *rows], "url string, body string"))
        assert sorted(r["id"] for r in got.collect()) == ["1", "2", "3"]
