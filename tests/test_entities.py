"""Queries over pages whose text breaks off inside an entity."""

from hearthline.functions import text
from hearthline.plans import catalog
from pyspark.sql import functions as F
from tests.rows import same

ROWS = [(1, "<title>Oak &amp;&amp</title> &copy; x"), (2, "a &ampb; &am &amp;amp; &middot c&middot;"), (3, "&quot;&quot &copy"), (4, "plain"), (5, "")]


def compared(spark, duck, tmp_path, name):
    spark.createDataFrame(ROWS, "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duck.cursor()
    con.execute(f"CREATE OR REPLACE TEMP VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    return same(catalog.QUERIES[name](spark, str(tmp_path)), con, catalog.SQL[name])


def test_clean_text_decodes_the_names_that_its_sql_does(spark, duck, tmp_path):
    assert compared(spark, duck, tmp_path, "str01_clean_text") == len(ROWS)


def test_detail_text_decodes_the_names_that_its_sql_does(spark, duck, tmp_path):
    assert compared(spark, duck, tmp_path, "lim04_truncate") == len(ROWS)


def test_names_without_semicolon_count_by_default(spark):
    row = spark.createDataFrame([("x &amp</b> &ampy",)], "t string").select(text.clean_text(F.col("t")).alias("own"), text.cleaned(F.col("t"), bare=False).alias("strict")).first()
    assert (row["own"], row["strict"]) == ("x & &y", "x &amp &ampy")


def test_clean_text_goes_through_lists(spark):
    assert spark.createDataFrame([(["<b>a</b>", "&amp b"],)], "t array<string>").select(F.transform("t", text.clean_text).alias("c")).first()["c"] == ["a", "& b"]
