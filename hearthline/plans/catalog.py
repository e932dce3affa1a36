"""Every query over the driver's tables, with the SQL it must equal.

Listings don't come with the driver's tables, so UNITS makes some from orders and customers: one expression that Spark
and DuckDB both read, with nulls, empty values, duplicates and ties in every column that has a rule about them.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..checkpoints import cut, ensure_checkpoint_dir
from ..functions import dates, kinds, places, text
from ..operators import dashboard, units as ops
from ..operators.publishing import publish_units
from ..sources import extractor, portals, raw
from ..sources.published import Published, PublishedByKey, part_of_source
from ..streaming import ingest

C = F.col
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TODAY = date(1998, 6, 15)

UNITS = """
SELECT o_orderkey AS pos, concat('f', CAST(o_custkey % 7 AS STRING)) AS file_name, concat('s', CAST(o_custkey % 9 AS STRING)) AS source, c_mktsegment AS manager,
  concat(CAST(o_custkey % 60 AS STRING), CASE o_orderkey % 3 WHEN 0 THEN ' Linden Street' WHEN 1 THEN ' linden St.' ELSE ' North Oak Avenue, Unit 4' END) AS address,
  CASE o_custkey % 8 WHEN 0 THEN 'Berkeley' WHEN 1 THEN 'Oakland' WHEN 2 THEN 'San Francisco' WHEN 3 THEN 'Fresno' WHEN 4 THEN 'Boston' WHEN 5 THEN 'Belmont' WHEN 6 THEN '' END AS city,
  CASE WHEN o_custkey % 8 IN (4, 5) THEN 'MA' WHEN o_custkey % 16 = 3 THEN 'TX' ELSE 'CA' END AS state,
  CASE WHEN o_orderkey % 11 > 0 THEN CAST(o_orderkey % 10 AS DOUBLE) / 2 END AS bedrooms,
  CASE WHEN o_orderkey % 13 > 0 THEN CAST(100 * (10 + o_orderkey % 37) AS DOUBLE) END AS rent,
  CASE o_orderkey % 7 WHEN 0 THEN 'room' WHEN 1 THEN 'parking' WHEN 2 THEN 'storage' WHEN 3 THEN CAST(NULL AS STRING) ELSE 'residential' END AS kind,
  CASE o_orderkey % 5 WHEN 0 THEN 'entire_place' WHEN 1 THEN 'private_room' WHEN 2 THEN 'shared_room' WHEN 3 THEN 'entire_place' END AS room_type,
  CASE o_orderkey % 6 WHEN 0 THEN 'allowed' WHEN 1 THEN 'cats_only' WHEN 2 THEN 'none' WHEN 3 THEN '' END AS pets,
  CASE o_orderkey % 4 WHEN 0 THEN 'furnished' WHEN 1 THEN 'unfurnished' END AS furnished,
  CASE o_orderkey % 8 WHEN 0 THEN 'garage' WHEN 1 THEN 'street' WHEN 2 THEN 'none' END AS parking,
  CASE o_orderkey % 9 WHEN 0 THEN 'in_unit' WHEN 1 THEN 'shared' WHEN 2 THEN 'none' WHEN 3 THEN 'hookups' END AS laundry,
  o_orderkey % 17 = 0 AS available_now,
  CASE WHEN o_orderkey % 3 > 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) END AS available_date,
  CASE WHEN o_orderkey % 4 > 0 THEN CAST(1 + o_orderkey % 3 AS DOUBLE) END AS bathrooms,
  CASE WHEN o_orderkey % 5 > 0 THEN CAST(400 + o_orderkey % 900 AS INT) END AS square_feet,
  CASE WHEN o_orderkey % 10 > 0 THEN concat('u', CAST(o_orderkey % 4001 AS STRING)) END AS url
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
"""
U = "u AS (" + UNITS.format(orders="orders", customer="customer") + ")"


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def units(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(UNITS, orders=t(spark, sf, "orders"), customer=t(spark, sf, "customer"))


def query(name: str, sql: str | None = None, on: str | None = None):
    """Registers a query. on: a table, or "units"; the function then takes that DataFrame alone."""

    def add(f):
        if on:
            QUERIES[name] = lambda spark, sf: f(units(spark, sf) if on == "units" else t(spark, sf, on))
        else:
            QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


TYPE_SQL = "CASE WHEN bedrooms < 1 THEN 'studio' WHEN bedrooms >= 3 THEN '3plus_bedroom' WHEN bedrooms IS NOT NULL THEN CAST(floor(bedrooms)::INT AS STRING) || '_bedroom' END"
ADDRESS_SQL = "array_to_string(list_filter(list_transform(string_split_regex(regexp_replace(lower(address), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+'), lambda w: CASE w WHEN 'street' THEN 'st' WHEN 'avenue' THEN 'ave' WHEN 'north' THEN 'n' WHEN 'unit' THEN '' ELSE w END), lambda w: w <> ''), ' ')"
AREAS_SQL = "a(area_state, area_city) AS (VALUES " + ", ".join(f"('{s}', '{c}')" for s in places.CITIES for c in places.CITIES[s]) + ")"
COVERED_SQL = "(coalesce(city, '') = '' OR EXISTS (SELECT 1 FROM a WHERE area_state = upper(state) AND area_city = lower(trim(city))))"
LIVABLE_SQL = "coalesce(kind, 'residential') IN ('residential', 'room')"
MERGED_SQL = f"m AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY {ADDRESS_SQL}, bedrooms, rent ORDER BY file_name, pos) AS k FROM u WHERE {LIVABLE_SQL} AND {COVERED_SQL}) WHERE k = 1)"

# sources and sinks


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4()}"


def read_back(df: DataFrame, folder: str) -> DataFrame:
    """df, computed and cut off, after which the scratch folder that it was read from goes."""
    kept = cut(df)
    at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
    return kept


def rename_parts(spark: SparkSession, folder: str, to: str, name: str) -> None:
    """Moves the files that Spark has written in folder to another one, as name0.json, name1.json and so on."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(to).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(to))
    parts = sorted(str(s.getPath()) for s in fs.listStatus(path(folder)) if s.getPath().getName().startswith("part-"))
    for i, part in enumerate(parts):
        fs.rename(path(part), path(f"{to}/{name}{i}.json"))


def document_lines(orders: DataFrame) -> DataFrame:
    """A customer's orders as a raw document, a line each: stray (it states no source) or not, and the line."""
    own = orders.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("us"))
    listed = F.transform("us", lambda x: F.struct(F.concat(x["o_orderkey"], F.lit(" Oak St")).alias("address"), x["o_totalprice"].alias("rent")))
    stray = C("o_custkey") % 7 == 0
    return own.select("o_custkey", stray.alias("stray"), F.to_json(F.struct(F.when(~stray, F.concat(F.lit("c"), "o_custkey")).alias("source"), listed.alias("units"))).alias("value"))


def raw_files(spark: SparkSession, sf: str) -> str:
    """A folder of documents of the orders, one a customer, a line each; each tenth customer's line is broken off, and documents that state no source are in files of
    their own."""
    path = scratch(spark, "raw")
    lines = document_lines(t(spark, sf, "orders")).select("stray", F.when(C("o_custkey") % 10 == 0, F.substring("value", 1, 20)).otherwise(C("value")).alias("value"))
    lines.write.partitionBy("stray").text(f"{path}/_written")
    for stray, name in (("true", "stray"), ("false", "own")):
        rename_parts(spark, f"{path}/_written/stray={stray}", path, name)
    return path


def scanned(rows: DataFrame) -> DataFrame:
    """Units of raw_files as their SQL gives them: the number of a stray document's file depends on how it was written."""
    return rows.select(F.regexp_replace("doc_source", r"^stray\d+$", "stray").alias("source"), C("pos").cast("long").alias("pos"), "address", "rent")


SCAN_SQL = "SELECT CASE WHEN o_custkey % 7 = 0 THEN 'stray' ELSE 'c' || o_custkey END AS source, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, o_orderkey || ' Oak St' AS address, o_totalprice AS rent FROM orders WHERE o_custkey % 10 <> 0"


@query("src11_scan_units", SCAN_SQL)
def _(spark, sf):
    folder = raw_files(spark, sf)
    return read_back(scanned(raw.units_of(raw.read_raw(spark, folder, lines=True))), folder)


@query(
    "stm00_stream",
    """WITH k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos FROM orders WHERE o_custkey % 7 <> 0 AND o_custkey % 10 <> 0)
    SELECT 'c' || o_custkey AS source, pos, o_orderkey || ' Oak St' AS address, CASE WHEN o_custkey % 6 = 1 THEN 1.0 ELSE o_totalprice END AS rent FROM k WHERE o_custkey % 6 <> 2 AND (o_custkey % 6 <> 1 OR pos = 0)""",
)
def _(spark, sf):
    """Three runs of a stream of files: all documents; some again with their first unit alone, at another rent; some again without any."""
    out, inbox = scratch(spark, "stream"), scratch(spark, "inbox")
    lines = document_lines(t(spark, sf, "orders").where("o_custkey % 10 <> 0")).where("not stray")
    doc = F.from_json("value", raw.RAW)
    first = F.transform(F.slice(doc["units"], 1, 1), lambda x: F.struct(x["address"].alias("address"), F.lit(1.0).alias("rent")))
    again = lines.where("o_custkey % 6 = 1").select(F.to_json(F.struct(doc["source"].alias("source"), first.alias("units"))).alias("value"))
    emptied = lines.where("o_custkey % 6 = 2").select(F.to_json(F.struct(doc["source"].alias("source"), F.array().cast("array<struct<address:string>>").alias("units"))).alias("value"))
    for k, run in enumerate((lines.select("value"), again, emptied)):
        run.write.text(f"{inbox}/run={k}")
        ingest.ingest(ingest.stream_raw(spark, inbox, 2, lines=True), f"{out}/units", f"{out}/at").awaitTermination()
    units = ingest.deduped(ingest.current(spark.read.parquet(f"{out}/units"), ["doc_source"]))
    return read_back(read_back(units.select(C("doc_source").alias("source"), C("pos").cast("long").alias("pos"), "address", "rent"), out), inbox)


@query("src12_corrupt", "SELECT count(DISTINCT o_custkey) AS broken FROM orders WHERE o_custkey % 10 = 0")
def _(spark, sf):
    folder = raw_files(spark, sf)
    return read_back(raw.broken(raw.read_raw(spark, folder, lines=True)).agg(F.count("*").alias("broken")), folder)


query("src13_missing_cache", "SELECT CAST(o_orderkey AS STRING) AS url, 'new' AS pets FROM orders")(
    lambda spark, sf: ops.upsert(raw.read_table(spark, f"{sf}/no-such-cache.json", "url string, pets string"), t(spark, sf, "orders").select(C("o_orderkey").cast("string").alias("url"), F.lit("new").alias("pets")), "url")
)


@query("src13_fresh_pages", "SELECT event_id FROM events WHERE epoch(ts) >= (SELECT max(epoch(ts)) FROM events) - 86400")
def _(spark, sf):
    e = t(spark, sf, "events").withColumn("fetched_at", F.unix_timestamp(C("ts").cast("timestamp")).cast("double") + (F.date_part(F.lit("SECOND"), "ts") % 1).cast("double"))
    last = e.agg(F.max("fetched_at")).first()[0]
    return raw.fresh_pages(e, last).select("event_id")


@query("src14_registry", "SELECT 's' || s_suppkey AS slug, s_name AS manager, CASE WHEN s_suppkey % 5 = 0 THEN 'none' ELSE 'appfolio' END AS platform FROM supplier WHERE s_suppkey % 5 <> 0", on="supplier")
def _(s):
    return raw.scrapable(s.select(F.concat(F.lit("s"), "s_suppkey").alias("slug"), C("s_name").alias("manager"), F.when(C("s_suppkey") % 5 == 0, "none").otherwise("appfolio").alias("platform")))


@query("src16_batch_results", "SELECT CAST(event_id AS STRING) AS page_id, value FROM events WHERE event_id % 3 <> 0", on="events")
def _(e):
    line = F.to_json(F.struct(C("event_id").cast("string").alias("custom_id"), F.struct(F.when(C("event_id") % 3 == 0, "errored").otherwise("succeeded").alias("type"), F.struct(F.array(F.struct(F.lit("text").alias("type"), F.to_json(F.struct("value")).alias("text"))).alias("content")).alias("message")).alias("result")))
    return raw.batch_results(e.select(line.alias("value")), "value double").select("page_id", C("result.value").alias("value"))


#: Sources of a second run: s1 and s2 have new units, s3 an invalid one, s4 and s5 none; the others were not read.
RUN_SQL = "n AS (SELECT * FROM u WHERE source IN ('s1', 's2', 's3') AND pos % 2 = 0)"
FIRST_SQL = f"SELECT min(pos) AS pos FROM {{0}} GROUP BY source, {ADDRESS_SQL}, bedrooms, rent"
RAW_ORDER_SQL = f"lower(CASE WHEN coalesce(city, '') = '' THEN '~' ELSE city END), coalesce(bedrooms, 99), coalesce(rent, 9e9), {ADDRESS_SQL}"
PUBLISHED = "source string, manager string, address string, city string, bedrooms double, rent double, pos long, unit_type string"


def two_runs(u: DataFrame, folder: str) -> tuple[Published, DataFrame]:
    """The table after a run over all sources and a second one over some, and the second one's status."""
    spark = u.sparkSession
    table = Published(spark, folder, PUBLISHED, part_of_source(C("source")))
    valid = u.withColumns({"pets": F.nullif("pets", F.lit("")), "room_type": F.when(C("kind") != "room", C("room_type"))})
    every = u.select(C("source").alias("slug"), F.lit("M").alias("manager"), F.lit("eri").alias("platform")).distinct()
    publish_units(table, every, valid)
    again = valid.where(C("source").isin("s1", "s2", "s3") & (C("pos") % 2 == 0)).withColumn("rent", F.when(C("source") == "s3", -1.0).otherwise(C("rent")))
    named = every.where(C("slug").isin("s1", "s2", "s3", "s4", "s5")).unionByName(every.limit(0).sparkSession.createDataFrame([("new", "M", "eri")], every.schema))
    return table, publish_units(table, named, again)


@query("snk01_write", f"WITH {U}, f AS ({FIRST_SQL.format('u')}) SELECT source, pos, address, bedrooms, rent, row_number() OVER (PARTITION BY source ORDER BY {RAW_ORDER_SQL}) - 1 AS place FROM u JOIN f USING (pos)", on="units")
def _(u):
    """One run, read back with the places that rows have in their source's folder."""
    folder = scratch(u.sparkSession, "units")
    table = Published(u.sparkSession, folder, PUBLISHED, part_of_source(C("source")))
    valid = u.withColumns({"pets": F.nullif("pets", F.lit("")), "room_type": F.when(C("kind") != "room", C("room_type"))})
    publish_units(table, u.select(C("source").alias("slug"), F.lit("M").alias("manager"), F.lit("eri").alias("platform")).distinct(), valid)
    rows = table.read().select("*", C("_metadata.file_path").alias("file"), C("_metadata.file_name").alias("name"), F.monotonically_increasing_id().alias("id"))
    return read_back(rows.select("source", "pos", "address", "bedrooms", "rent", (F.row_number().over(Window.partitionBy("source").orderBy("id")) - 1).cast("long").alias("place")), folder)


@query("snk02_preserve", f"WITH {U}, {RUN_SQL}, f AS ({FIRST_SQL.format('u')}), g AS ({FIRST_SQL.format('n')}) SELECT source, pos FROM u JOIN f USING (pos) WHERE source NOT IN ('s1', 's2') UNION ALL SELECT source, pos FROM u JOIN g USING (pos) WHERE source IN ('s1', 's2')", on="units")
def _(u):
    folder = scratch(u.sparkSession, "units")
    return read_back(two_runs(u, folder)[0].read().select("source", "pos"), folder)


STATUS_SQL = f"""{RUN_SQL}, f AS ({FIRST_SQL.format('u')}), g AS ({FIRST_SQL.format('n')}),
    had AS (SELECT source, count(*) AS n FROM u JOIN f USING (pos) GROUP BY 1), got AS (SELECT source, count(*) AS n FROM u JOIN g USING (pos) GROUP BY 1),
    status AS (SELECT slug, slug <> 's3' AS ok, CASE WHEN slug = 's3' THEN 0 WHEN slug IN ('s1', 's2') THEN got.n ELSE coalesce(had.n, 0) END AS units, CASE WHEN slug = 's3' THEN 'invalid: rent' END AS error, slug IN ('s4', 's5') AS preserved
      FROM (VALUES ('s1'), ('s2'), ('s3'), ('s4'), ('s5'), ('new')) AS v(slug) LEFT JOIN had ON had.source = slug LEFT JOIN got ON got.source = slug)"""


@query("snk03_status", f"WITH {U}, {STATUS_SQL} SELECT slug, ok, units, error, preserved FROM status", on="units")
def _(u):
    folder = scratch(u.sparkSession, "units")
    return read_back(raw.status_rows(two_runs(u, folder)[1]).select("slug", "ok", "units", "error", "preserved"), folder)


@query("agg21_totals", f"WITH {U}, {STATUS_SQL} SELECT count(*) FILTER (ok) AS sources_ok, count(*) FILTER (NOT ok) AS sources_failed, CAST(sum(units) AS BIGINT) AS total_units FROM status", on="units")
def _(u):
    folder = scratch(u.sparkSession, "units")
    return read_back(raw.status_totals(two_runs(u, folder)[1]), folder)


@query("snk04_upsert_contacts", "SELECT 'c' || c_custkey AS slug, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE 'old' END AS manager, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'p' || c_custkey END AS phone FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 2 = 0", on="customer")
def _(c):
    """Two published versions; a new entry replaces all of the old one."""
    folder = scratch(c.sparkSession, "contacts")
    table = PublishedByKey(c.sparkSession, folder, raw.CONTACT, "slug", 8)
    of = lambda rows, manager, phone: rows.select(F.concat(F.lit("c"), "c_custkey").alias("slug"), F.lit(manager).alias("manager"), phone.alias("phone"), F.array(F.concat("c_custkey", F.lit("@x.org"))).alias("emails"), F.lit(None).cast("string").alias("source_url"))
    table.upsert(of(c.where("c_custkey % 2 = 0"), "old", F.concat(F.lit("p"), "c_custkey")))
    table.upsert(of(c.where("c_custkey % 3 = 0"), "new", F.lit(None).cast("string")))
    return read_back(table.read().select("slug", "manager", "phone"), folder)


@query("snk05_upsert_cache", "SELECT CAST(o_orderkey AS STRING) AS url, CASE WHEN o_orderkey % 4 = 0 THEN 'none' ELSE 'allowed' END AS pets, 2 AS version FROM orders UNION ALL SELECT CAST(o_orderkey AS STRING), 'allowed', 1 FROM orders", on="orders")
def _(o):
    """Answers by url; a reader that is pinned to the first version goes on to see it."""
    folder = scratch(o.sparkSession, "cache")
    table = PublishedByKey(o.sparkSession, folder, "url string, pets string", "url", 16)
    table.upsert(o.select(C("o_orderkey").cast("string").alias("url"), F.lit("allowed").alias("pets")))
    first = table.read(1)
    table.upsert(o.where("o_orderkey % 4 = 0").select(C("o_orderkey").cast("string").alias("url"), F.lit("none").alias("pets")))
    return read_back(first.withColumn("version", F.lit(1)).unionByName(table.read().withColumn("version", F.lit(2))), folder)


# projections

query("prj01_unit_type", f"WITH {U} SELECT pos, {TYPE_SQL} AS unit_type FROM u", on="units")(lambda u: u.select("pos", kinds.unit_type(C("bedrooms")).alias("unit_type")))
query("prj03_default_room_type", f"WITH {U} SELECT pos, CASE WHEN room_type IS NULL AND kind = 'residential' THEN 'entire_place' ELSE room_type END AS room_type FROM u", on="units")(
    lambda u: u.select("pos", ops.default_room_type(C("kind"), C("room_type")).alias("room_type"))
)
query(
    "prj05_bedroom_label",
    f"WITH {U} SELECT pos, CASE WHEN bedrooms IS NULL THEN 'Unknown' WHEN bedrooms = 0 THEN 'Studio' WHEN bedrooms = floor(bedrooms) THEN CAST(CAST(bedrooms AS INT) AS STRING) || ' bed' ELSE CAST(bedrooms AS STRING) || ' bed' END AS label FROM u",
    on="units",
)(lambda u: u.select("pos", kinds.bed_label(C("bedrooms")).alias("label")))
query(
    "prj06_page_bed_label",
    f"""WITH {U}, n AS (SELECT *, CASE WHEN bedrooms = floor(bedrooms) THEN CAST(CAST(bedrooms AS INT) AS STRING) ELSE CAST(bedrooms AS STRING) END AS b FROM u)
    SELECT pos, CASE WHEN room_type = 'entire_place' THEN CASE WHEN bedrooms IS NULL THEN '—' WHEN bedrooms = 0 THEN 'Studio' ELSE b || ' bd' END
      ELSE CASE room_type WHEN 'shared_room' THEN 'Shared room' WHEN 'private_room' THEN 'Private room' ELSE 'Room' END || CASE WHEN coalesce(bedrooms, 0) <> 0 THEN ' in ' || b || ' bd' ELSE '' END END AS label FROM n""",
    on="units",
)(lambda u: u.select("pos", kinds.page_bed_label(C("bedrooms"), C("room_type")).alias("label")))
query("prj08_source_url", "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'https://' || s_name || '.appfolio.com/listings' WHEN 1 THEN 'https://' || s_name || '.managebuilding.com/Resident/public/rentals' ELSE 'https://x.org' END AS url FROM supplier", on="supplier")(
    lambda s: s.select("s_suppkey", F.when(C("s_suppkey") % 3 == 0, "appfolio").when(C("s_suppkey") % 3 == 1, "buildium").otherwise("eri").alias("platform"), C("s_name").alias("account"), F.lit("https://x.org").alias("site")).select("s_suppkey", raw.source_url().alias("url"))
)
query("prj10_address", f"WITH {U} SELECT pos, array_to_string(list_filter([address, nullif(city, ''), state], lambda x: x IS NOT NULL), ', ') AS full_address FROM u", on="units")(
    lambda u: u.select("pos", text.joined_address(C("address"), C("city"), C("state")).alias("full_address"))
)
query("prj11_stale", "SELECT event_id, epoch(TIMESTAMP '2024-01-15 00:00:00') - floor(epoch(ts)) > 172800 AS stale FROM events", on="events")(
    lambda e: e.select("event_id", dates.is_stale(C("ts").cast("string"), F.lit("2024-01-15 00:00:00")).alias("stale"))
)
query(
    "prj12_amenity_tags",
    f"""WITH {U} SELECT pos, array_to_string(list_filter([CASE laundry WHEN 'in_unit' THEN 'In-unit laundry' WHEN 'shared' THEN 'Shared laundry' WHEN 'hookups' THEN 'Laundry hookups' WHEN 'none' THEN 'No laundry' END,
      CASE parking WHEN 'garage' THEN 'Garage' WHEN 'street' THEN 'Street parking' WHEN 'none' THEN 'No parking' END, CASE furnished WHEN 'furnished' THEN 'Furnished' WHEN 'unfurnished' THEN 'Unfurnished' END,
      CASE pets WHEN 'allowed' THEN 'Pets OK' WHEN 'cats_only' THEN 'Cats OK' WHEN 'none' THEN 'No pets' END], lambda x: x IS NOT NULL), '|') AS tags FROM u""",
    on="units",
)(lambda u: u.select("pos", F.array_join(kinds.amenity_tags(), "|").alias("tags")))
def labelled_sql(column: str, labels: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.items()) + f" ELSE {column} END"


NUMBER_SQL = "CASE WHEN {0} = floor({0}) THEN CAST(CAST({0} AS BIGINT) AS STRING) ELSE CAST({0} AS STRING) END"
RECORD_SQL = {
    "Unit type": labelled_sql("unit_type", dashboard.UNIT_TYPES), "Rental type": labelled_sql("room_type", dashboard.ROOM_TYPES), "Bedrooms": f"CASE WHEN bedrooms = 0 THEN 'Studio (0)' ELSE {NUMBER_SQL.format('bedrooms')} END",
    "Bathrooms": NUMBER_SQL.format("bathrooms"), "Square feet": "format('{:,}', square_feet)", "Rent": "'$' || format('{:,}', CAST(floor(rent + 0.5) AS BIGINT))",
    "Available": "CASE WHEN available_now THEN 'Now' ELSE strftime(CAST(available_date AS DATE), '%b %-d, %Y') END", **{n.capitalize(): labelled_sql(n, kinds.AMENITIES[n]) for n in ("laundry", "parking", "furnished", "pets")},
    "City": "city", "Postal code": "CASE WHEN pos % 2 = 0 THEN '94601' END", "State": "state", "Manager": "manager", "Source": "source",
}
query("prj13_record", f"WITH {U}, v AS (SELECT *, {TYPE_SQL} AS unit_type FROM u) SELECT pos, label, coalesce(nullif(v, ''), '—') AS value FROM (" + " UNION ALL ".join(f"SELECT pos, '{k}' AS label, {v} AS v FROM v" for k, v in RECORD_SQL.items()) + ")", on="units")(
    lambda u: u.withColumns({"unit_type": kinds.unit_type(C("bedrooms")), "postal_code": F.when(C("pos") % 2 == 0, "94601")}).select("pos", F.explode(dashboard.record()).alias("r")).select("pos", "r.*")
)
query("prj14_payload", f"WITH {U} SELECT pos, " + " + ".join(f"(coalesce({f}, '') <> '')::INT" for f in ops.ASSIGNABLE) + " AS known, nullif(pets, '') AS pets FROM u", on="units")(
    lambda u: u.withColumn("summary", F.lit(None).cast("string")).withColumn("m", ops.known_fields()).select("pos", F.size("m").alias("known"), F.try_element_at("m", F.lit("pets")).alias("pets"))
)
query("prj15_reading", f"WITH {U} SELECT pos, nullif(nullif(CASE WHEN pos % 2 = 0 THEN 'unknown' ELSE pets END, 'unknown'), '') AS pets FROM u", on="units")(lambda u: u.select("pos", text.reading(F.when(C("pos") % 2 == 0, "unknown").otherwise(C("pets"))).alias("pets")))
query("prj16_cache_key", f"WITH {U} SELECT pos, coalesce(url, '') AS key FROM u", on="units")(lambda u: u.select("pos", ops.cache_key(C("url")).alias("key")))

# filters

query("flt01_livable", f"WITH {U} SELECT pos FROM u WHERE {LIVABLE_SQL}", on="units")(lambda u: u.where(ops.is_livable(C("kind"))).select("pos"))
query("flt02_covered", f"WITH {U}, {AREAS_SQL} SELECT pos FROM u WHERE {COVERED_SQL}", on="units")(lambda u: places.keep_covered(u).select("pos"))
query("flt03_enrichable", f"WITH {U}, {AREAS_SQL} SELECT pos FROM u WHERE coalesce(url, '') <> '' AND kind IN ('residential', 'room') AND {COVERED_SQL}", on="units")(lambda u: places.keep_covered(u.where(ops.is_enrichable())).select("pos"))
query(
    "flt06_quarantine",
    f"WITH {U} SELECT pos, CASE WHEN NOT coalesce(rent BETWEEN 100 AND 100000, true) THEN 'rent,' ELSE '' END || CASE WHEN square_feet <= 0 THEN 'square_feet,' ELSE '' END || CASE WHEN kind = 'room' AND room_type = 'entire_place' THEN 'room_type_of_room,' ELSE '' END || CASE WHEN pets = '' THEN 'pets,' ELSE '' END AS wrong FROM (SELECT * REPLACE (rent - 1100 AS rent, square_feet - 450 AS square_feet) FROM u) WHERE wrong <> ''",
    on="units",
)(lambda u: ops.quarantine(u.withColumns({"rent": C("rent") - 1100, "square_feet": C("square_feet") - 450, "unit_type": kinds.unit_type(C("bedrooms"))}))[1].select("pos", F.concat(F.array_join("violations", ","), F.lit(",")).alias("wrong")))
FILTERS = {
    "flt07_exact": (dashboard.Filters(exact={"pets": "allowed", "manager": "BUILDING"}), "pets = 'allowed' AND manager = 'BUILDING'"),
    "flt08_least_size": (dashboard.Filters(baths=2, sqft=700), "coalesce(bathrooms >= 2, true) AND coalesce(square_feet >= 700, true)"),
    "flt09_most_rent": (dashboard.Filters(rent=2500.0), "coalesce(rent <= 2500, true)"),
    "flt10_beds": (dashboard.Filters(beds="4plus"), "bedrooms >= 4"),
    "flt10_beds_exact": (dashboard.Filters(beds="1.5"), "bedrooms = 1.5"),
    "flt11_move_in": (dashboard.Filters(by_date=date(1996, 1, 1)), "available_now OR coalesce(available_date <= '1996-01-01', true)"),
    "flt12_whole_now": (dashboard.Filters(whole_only=True, now_only=True), "room_type = 'entire_place' AND available_now"),
}
for _name, (_filters, _where) in FILTERS.items():
    query(_name, f"WITH {U} SELECT pos FROM u WHERE {_where}", on="units")(lambda u, f=_filters: u.where(f.predicate()).select("pos"))
query("flt13_ttl", "SELECT event_id FROM events WHERE value >= 50 AND event_id % 5 > 0", on="events")(
    lambda e: raw.fresh_pages(e.withColumn("fetched_at", F.when(C("event_id") % 5 > 0, C("value") * 3600)), 74 * 3600).select("event_id")
)
@query("flt14_only", "SELECT 's' || s_suppkey AS slug, true AS known FROM supplier WHERE s_suppkey IN (1, 4) UNION ALL SELECT 'nowhere', false", on="supplier")
def _(s):
    known, unknown = ops.only_slugs(s.select(F.concat(F.lit("s"), "s_suppkey").alias("slug")), ["s1", " s4", "nowhere", ""])
    return known.withColumn("known", F.lit(True)).unionByName(unknown.withColumn("known", F.lit(False)))


CONTACTS_SQL = "k AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 > 0 THEN 'm' || (c_custkey % 50) ELSE '' END AS manager, CASE WHEN c_acctbal > 4000 THEN 'p' || c_custkey END AS phone, list_slice(['a' || c_custkey, 'b' || c_custkey, 'c' || c_custkey], 1, c_custkey % 4) AS emails FROM customer), l AS (SELECT * FROM k WHERE manager <> '' QUALIFY row_number() OVER (PARTITION BY manager ORDER BY id DESC) = 1)"


def contacts(c: DataFrame) -> DataFrame:
    k = C("c_custkey")
    emails = F.slice(F.array(*[F.concat(F.lit(x), k) for x in "abc"]), F.lit(1), (k % 4).cast("int"))
    return c.select(F.lpad(k.cast("string"), 12, "0").alias("slug"), F.when(k % 7 > 0, F.concat(F.lit("m"), k % 50)).otherwise("").alias("manager"), F.when(C("c_acctbal") > 4000, F.concat(F.lit("p"), k)).alias("phone"), F.when(k % 4 > 0, emails).alias("emails"), F.lit(None).cast("string").alias("source_url"))
query("flt15_emails", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'a' || c_custkey || '@firm.com' END AS emails FROM customer", on="customer")(
    lambda c: c.select("c_custkey", F.array_join(text.extract_contact(F.concat(F.when(C("c_custkey") % 3 == 0, "noreply@firm.com").otherwise(F.concat(F.lit("A"), "c_custkey", F.lit("@firm.com, a"), "c_custkey", F.lit("@firm.com"))), F.lit(" x@sentry.io")))["emails"], ",").alias("emails"))
)
query("flt16_has_contact", f"WITH {CONTACTS_SQL} SELECT id FROM k WHERE phone IS NOT NULL OR len(emails) > 0", on="customer")(lambda c: contacts(c).where(ops.has_contact(C("phone"), C("emails"))).select(C("slug").cast("long").alias("id")))

# joins

CACHE_SQL = "c AS (SELECT DISTINCT url, 'shared' AS laundry, 'furnished' AS furnished FROM u WHERE url IS NOT NULL AND pos % 3 = 0)"


def cache_of(u: DataFrame) -> DataFrame:
    return u.where("url is not null and pos % 3 = 0").select("url").distinct().select("url", F.lit("shared").alias("laundry"), F.lit("furnished").alias("furnished"))


query("join01_fill", f"WITH {U}, {CACHE_SQL} SELECT pos, coalesce(u.laundry, c.laundry) AS laundry, coalesce(u.furnished, c.furnished) AS furnished FROM u LEFT JOIN c ON u.url = c.url", on="units")(
    lambda u: ops.fill(u, cache_of(u), ("laundry", "furnished")).select("pos", "laundry", "furnished")
)
@query("join01_stored_cache", f"WITH {U}, {CACHE_SQL} SELECT pos, coalesce(u.laundry, c.laundry) AS laundry, coalesce(u.furnished, c.furnished) AS furnished FROM u LEFT JOIN c ON u.url = c.url", on="units")
def _(u):
    """Filled from a cache that lies bucketed by url."""
    name = f"cache_{uuid.uuid4().hex}"
    cache = raw.store_by_url(cache_of(u), name, buckets=8)
    try:
        return cut(ops.fill(u, cache, ("laundry", "furnished")).select("pos", "laundry", "furnished"))
    finally:
        u.sparkSession.sql(f"DROP TABLE {name}")


query(
    "join02_reconcile",
    f"WITH {U}, c AS (SELECT url, CAST(bedrooms + 1 AS DOUBLE) AS b FROM u WHERE url IS NOT NULL AND pos % 5 = 0 QUALIFY row_number() OVER (PARTITION BY url ORDER BY pos DESC) = 1), r AS (SELECT pos, coalesce(c.b, u.bedrooms) AS bedrooms FROM u LEFT JOIN c ON u.url = c.url) SELECT pos, bedrooms, {TYPE_SQL} AS unit_type FROM r",
    on="units",
)(
    lambda u: ops.reconcile(u, u.where("url is not null and pos % 5 = 0").select("url", F.lit("bedrooms").alias("field"), (C("bedrooms") + 1).cast("string").alias("page"), F.lit("conflict").alias("type"), C("pos").alias("ord"))).select("pos", "bedrooms", "unit_type")
)
query("join03_contacts", f"WITH {CONTACTS_SQL} SELECT o_orderkey, CASE WHEN phone IS NOT NULL OR len(emails) > 0 THEN phone END AS phone, CASE WHEN phone IS NOT NULL OR len(emails) > 0 THEN array_to_string(list_slice(emails, 1, 2), ',') END AS emails FROM orders LEFT JOIN l ON 'm' || (o_custkey % 60) = manager")(
    lambda spark, sf: ops.with_contacts(t(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("m"), C("o_custkey") % 60).alias("manager")), contacts(t(spark, sf, "customer"))).select("o_orderkey", "phone", F.when(C("emails").isNotNull(), F.array_join("emails", ",")).alias("emails"))
)
query("join04_registry", "WITH d AS (SELECT 's' || s_suppkey AS slug, CASE WHEN s_suppkey % 4 = 0 THEN s_name END AS manager FROM supplier) SELECT slug, coalesce(manager, n_name, slug) AS manager, CASE WHEN n_name IS NOT NULL THEN 'eri' END AS platform FROM d LEFT JOIN nation ON slug = 's' || n_nationkey")(
    lambda spark, sf: ops.with_registry(  # a document that states no source goes by its file's name
        t(spark, sf, "supplier").select(F.when(C("s_suppkey") % 3 == 0, F.lit(None)).when(C("s_suppkey") % 3 == 1, "").otherwise(F.concat(F.lit("s"), "s_suppkey")).alias("source"), F.concat(F.lit("s"), "s_suppkey", F.lit(".json")).alias("file_name"), F.when(C("s_suppkey") % 4 == 0, C("s_name")).otherwise("").alias("manager")).withColumn("slug", raw.slug()),
        t(spark, sf, "nation").select(F.concat(F.lit("s"), "n_nationkey").alias("slug"), C("n_name").alias("manager"), F.lit("https://x.org").alias("site"), F.lit("eri").alias("platform")),
    ).select("slug", "manager", "platform")
)
query("join05_street_city", f"WITH {U} SELECT source, address AS street, arg_min(city, pos) AS there FROM u WHERE coalesce(city, '') <> '' GROUP BY ALL", on="units")(
    lambda u: portals.street_cities(u.select("source", C("address").alias("street"), F.nullif("city", F.lit("")).alias("own"), "pos"))
)
query("join06_not_cached", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")(
    lambda spark, sf: ops.without(t(spark, sf, "orders").select("o_orderkey"), t(spark, sf, "lineitem").select(C("l_orderkey").alias("o_orderkey")), "o_orderkey")
)
query("join08_results_meta", "SELECT doc_id AS page_id, quality, lang FROM documents JOIN labels USING (doc_id)")(
    lambda spark, sf: ops.results_with_meta(t(spark, sf, "labels").select(C("doc_id").alias("page_id"), "quality"), t(spark, sf, "documents").select(C("doc_id").alias("page_id"), "lang"))
)
query("join09_single_unit", f"WITH {U}, k AS (SELECT source, url FROM u WHERE coalesce(url, '') <> '' AND kind IN ('residential', 'room') GROUP BY ALL HAVING count(*) = 1) SELECT pos FROM u JOIN k USING (source, url) WHERE kind IN ('residential', 'room')", on="units")(
    lambda u: ops.single_unit_pages(u).select("pos")
)
query("join10_missing", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")(
    lambda spark, sf: ops.without(t(spark, sf, "customer").select("c_custkey"), t(spark, sf, "orders").select(C("o_custkey").alias("c_custkey")), "c_custkey")
)

# aggregates

query("agg01_dedupe_source", f"WITH {U} SELECT min(pos) AS pos FROM u GROUP BY source, {ADDRESS_SQL}, bedrooms, rent", on="units")(
    lambda u: ops.keep_first(u.select("source", "address", "bedrooms", "rent", "pos"), ["source", text.normal_address(C("address")), "bedrooms", "rent"], ["pos"]).select("pos")
)
query("agg01_dedupe_texts", "SELECT doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS k FROM documents) WHERE k = 1", on="documents")(
    lambda d: ops.keep_first(d.select("doc_id", "n_chars", F.md5(C("text").cast("binary")).alias("h")), ["h"], ["doc_id"]).select("doc_id", "n_chars")
)
query("agg02_merge", f"WITH {U}, {AREAS_SQL}, {MERGED_SQL} SELECT file_name, pos, CASE WHEN room_type IS NULL AND kind = 'residential' THEN 'entire_place' ELSE room_type END AS room_type, {TYPE_SQL} AS unit_type FROM m", on="units")(
    lambda u: ops.merge_units(u).select("file_name", "pos", "room_type", "unit_type")
)
query("agg03_city_facet", "SELECT n_name AS value, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")(
    lambda spark, sf: dashboard.count_facet(t(spark, sf, "customer").join(t(spark, sf, "nation"), C("c_nationkey") == C("n_nationkey")), "n_name")
)
query("agg04_bedroom_facet", f"WITH {U} SELECT bedrooms, count(*) AS n FROM u GROUP BY 1", on="units")(dashboard.bedroom_facet)
query("agg05_rent_range", f"WITH {U} SELECT min(rent) AS least, max(rent) AS most FROM u", on="units")(dashboard.rent_range)
query("agg06_facets", f"WITH {U}, v AS (SELECT *, {TYPE_SQL} AS unit_type FROM u), f AS (" + " UNION ALL ".join(f"SELECT '{c}' AS facet, coalesce(nullif({c}, ''), 'unknown') AS value, pos FROM v" for c in dashboard.FACETS) + ") SELECT facet, value, count(*) AS n, min(pos) AS first FROM f GROUP BY ALL", on="units")(
    lambda u: dashboard.facets(u.withColumn("unit_type", kinds.unit_type(C("bedrooms"))), dashboard.FACETS, ["pos"]).orderBy(*dashboard.facet_order()).select("facet", "value", "n", C("first.pos").alias("first"))
)
query("agg06_facets_labels", "WITH j AS (SELECT lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)) " + " UNION ALL ".join(f"SELECT '{c}' AS facet, coalesce(CAST({c} AS STRING), 'unknown') AS value, count(*) AS n FROM j GROUP BY ALL" for c in ("lang", "quality", "toxic")))(
    lambda spark, sf: dashboard.facets(t(spark, sf, "documents").select("doc_id", "lang").join(t(spark, sf, "labels"), "doc_id", "left"), ("lang", "quality", "toxic"), ["doc_id"]).select("facet", "value", "n")
)
query("agg07_excluded", f"WITH {U} SELECT kind, count(*) AS n FROM u WHERE NOT {LIVABLE_SQL} GROUP BY 1", on="units")(ops.excluded)
query("agg08_out_of_area", f"WITH {U}, {AREAS_SQL} SELECT city || ', ' || coalesce(state, '(unknown)') AS place, count(*) AS n FROM (SELECT * REPLACE (CASE WHEN pos % 9 = 0 THEN NULL ELSE state END AS state) FROM u) WHERE NOT coalesce({COVERED_SQL}, false) GROUP BY 1 ORDER BY n DESC, place LIMIT 8", on="units")(
    lambda u: dashboard.top(places.outside(u.withColumn("state", F.when(C("pos") % 9 > 0, C("state")))), 8, "place")
)
query("agg09_per_source", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")(
    lambda spark, sf: ops.per_source(t(spark, sf, "customer").select("c_custkey"), t(spark, sf, "orders").select(C("o_custkey").alias("c_custkey")), "c_custkey")
)
#: A document for each file of the units, one that has none, and what a registry knows of some of their sources.
DOCS_SQL = """d AS (SELECT DISTINCT file_name, 'd' || file_name AS slug FROM u UNION ALL SELECT 'empty', 'dempty'),
    l AS (SELECT file_name, slug, CASE WHEN slug IN ('df1', 'df2') THEN 'Own' WHEN slug IN ('df3', 'df4') THEN 'Reg' ELSE slug END AS manager, CASE WHEN slug IN ('df2', 'df3', 'df4') THEN 'https://x.org' END AS site, CASE WHEN slug IN ('df2', 'df3', 'df4') THEN 'eri' END AS platform,
      CASE WHEN slug = 'df5' THEN 'never' ELSE '2026-07-' || CASE WHEN slug < 'df3' THEN '20' ELSE '18' END || 'T12:00:00+00:00' END AS scraped_at, slug IN ('df3', 'df4', 'df6') AS stale FROM d)"""


def listed_sources(u: DataFrame) -> DataFrame:
    docs = u.select("file_name").distinct().unionByName(u.sparkSession.createDataFrame([("empty",)], "file_name string")).withColumn("slug", F.concat(F.lit("d"), "file_name"))
    docs = docs.withColumn("manager", F.when(C("slug").isin("df1", "df2"), "Own")).withColumn("scraped_at", F.when(C("slug") == "df5", "never").when(C("slug") < "df3", "2026-07-20T12:00:00+00:00").otherwise("2026-07-18T12:00:00+00:00"))
    known = u.sparkSession.createDataFrame([(f"df{i}", "Reg", "https://x.org", "eri") for i in (2, 3, 4)], "slug string, manager string, site string, platform string")
    return ops.source_list(docs, ops.merge_units(u), known, F.lit("2026-07-20 12:00:01"))


SOURCES_SQL = "n AS (SELECT file_name, count(*) AS c FROM m GROUP BY 1), s AS (SELECT slug, manager, site, platform, coalesce(c, 0) AS unit_count, scraped_at, stale, row_number() OVER (ORDER BY coalesce(c, 0) DESC, file_name) - 1 AS place FROM l LEFT JOIN n USING (file_name))"
query("agg09_sources", f"WITH {U}, {AREAS_SQL}, {MERGED_SQL}, {DOCS_SQL}, {SOURCES_SQL} SELECT * FROM s", on="units")(
    lambda u: ops.numbered(listed_sources(u).withColumn("file_name", F.substring("slug", 2, 100)), [C("unit_count").desc(), C("file_name")], "place").drop("file_name")
)


@query(
    "agg21_run_audit",
    f"WITH {U}, {AREAS_SQL} SELECT unnest([{{'name': 'seen', 'n': count(*)}}, " + ", ".join(f"{{'name': 'excluded_{k}', 'n': count(*) FILTER (kind = '{k}')}}" for k in ("parking", "storage", "commercial", "application"))
    + f", {{'name': 'excluded_other', 'n': 0}}, {{'name': 'out_of_area', 'n': count(*) FILTER ({LIVABLE_SQL} AND NOT {COVERED_SQL})}}, {{'name': 'covered', 'n': count(*) FILTER ({LIVABLE_SQL} AND {COVERED_SQL})}}], recursive := true) FROM u",
    on="units",
)
def _(u):
    """What a merge has counted while its result was written."""
    counted = Observation()
    ops.merge_units(u, counted=counted).write.format("noop").mode("overwrite").save()
    return u.sparkSession.createDataFrame(list(counted.get.items()), "name string, n long")


@query("agg17_checked", f"WITH {U}, k AS (SELECT source, url FROM u WHERE coalesce(url, '') <> '' AND kind IN ('residential', 'room') GROUP BY ALL HAVING count(*) = 1), c AS (SELECT DISTINCT url FROM u WHERE url IS NOT NULL AND pos % 3 = 0), j AS (SELECT u.* FROM u JOIN k USING (source, url) JOIN c USING (url) WHERE kind IN ('residential', 'room')) SELECT (SELECT count(*) FROM j) AS checked, (SELECT count(*) FROM j WHERE bedrooms <> 2) AS conflicts, (SELECT count(*) FROM j WHERE bedrooms IS NULL) AS parser_missing", on="units")
def _(u):
    """Differences by type, and how many pages were checked, from one job."""
    counted = Observation()
    observed = F.from_json(F.lit('{"describes_one_unit": true, "bedrooms": 2.0, "listing_kind": "unknown"}'), raw.OBSERVED)
    rows = cut(ops.cross_check(u, cache_of(u).select("url", observed.alias("observed")), F.lit(TODAY), counted).groupBy().agg(F.count_if(C("type") == "conflict").alias("conflicts"), F.count_if(C("type") == "parser_missing").alias("parser_missing")))
    return rows.select(F.lit(counted.get["checked"]).cast("long").alias("checked"), "conflicts", "parser_missing")


query("agg10_headline", f"WITH {U} SELECT count(*) AS n, CAST(median(rent) FILTER (room_type = 'entire_place') AS DOUBLE) AS median_rent, count(DISTINCT nullif(city, '')) AS cities, count(DISTINCT manager) AS managers FROM u", on="units")(
    lambda u: dashboard.headline(u, C("rent"), C("room_type") == "entire_place", C("city"), C("manager"))
)
query("agg11_median", "SELECT p_brand, CAST(median(p_retailprice) AS DOUBLE) AS median FROM part GROUP BY 1", on="part")(lambda p: dashboard.median_of(p, C("p_retailprice"), "p_brand"))
query("agg12", f"WITH {U} SELECT least(CAST(floor(bedrooms) AS INT), 4)::INT AS bucket, count(*) AS n, CAST(floor(median(rent) + 0.5) AS BIGINT) AS median FROM u WHERE room_type = 'entire_place' AND rent IS NOT NULL AND bedrooms IS NOT NULL GROUP BY 1", on="units")(
    lambda u: dashboard.median_by_bucket(u, C("bedrooms"), C("rent"), C("room_type") == "entire_place")
)
query("agg12_median_by_bucket", "SELECT least(CAST(floor(p_size / 10.0) AS INT), 4)::INT AS bucket, count(*) AS n, CAST(floor(median(p_retailprice) + 0.5) AS BIGINT) AS median FROM part WHERE p_retailprice IS NOT NULL AND p_size IS NOT NULL GROUP BY 1", on="part")(
    lambda p: dashboard.median_by_bucket(p, C("p_size") / 10, C("p_retailprice"), F.lit(True))
)
query("agg13_top_cities", "SELECT n_name AS value, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY n DESC, value LIMIT 12")(
    lambda spark, sf: dashboard.top(dashboard.count_facet(t(spark, sf, "customer").join(t(spark, sf, "nation"), C("c_nationkey") == C("n_nationkey")), "n_name"), 12)
)
query("agg14_months", f"WITH {U}, l AS (SELECT left(available_date, 7) AS month, count(*) AS n FROM u WHERE NOT available_now AND available_date IS NOT NULL GROUP BY 1 ORDER BY 1 LIMIT 11) SELECT 'now' AS month, count(*) AS n FROM u WHERE available_now UNION ALL SELECT * FROM l", on="units")(
    lambda u: dashboard.by_month(u, C("available_date").cast("date"), C("available_now"))
)
query("agg14_month", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1", on="orders")(lambda o: o.groupBy(dates.month_key(C("o_orderdate")).alias("month")).agg(F.count("*").alias("n")))
query("agg15_room_types", f"WITH {U}, r AS (SELECT CASE room_type WHEN 'entire_place' THEN 0 WHEN 'private_room' THEN 1 WHEN 'shared_room' THEN 2 ELSE 3 END AS place FROM u) SELECT place, ['Entire place', 'Private room', 'Shared room', 'Undetermined'][place + 1] AS name, count(*) AS n FROM r GROUP BY ALL", on="units")(
    dashboard.room_types
)
COVERAGE_SQL = {"In-unit laundry": "laundry = 'in_unit'", "Any laundry": "laundry <> '' AND laundry <> 'none'", "Parking": "parking <> '' AND parking <> 'none'", "Furnished": "furnished = 'furnished'", "Pets OK": "pets <> '' AND pets <> 'none'"}
query(
    "agg16_coverage",
    f"WITH {U}, e AS (SELECT * REPLACE (CASE WHEN pos % 7 = 0 THEN '' ELSE laundry END AS laundry, CASE WHEN pos % 5 = 0 THEN '' ELSE parking END AS parking) FROM u), c AS ("
    + " UNION ALL ".join(f"SELECT {i} AS i, '{name}' AS name, count(*) AS n FROM e WHERE {test}" for i, (name, test) in enumerate(COVERAGE_SQL.items()))
    + ") SELECT name, n, row_number() OVER (ORDER BY n DESC, i) - 1 AS place FROM c WHERE n > 0",
    on="units",
)(
    lambda u: ops.numbered(dashboard.coverage(u.withColumns({"laundry": F.when(C("pos") % 7 == 0, "").otherwise(C("laundry")), "parking": F.when(C("pos") % 5 == 0, "").otherwise(C("parking"))}), dashboard.amenity_tests()), [C("n").desc(), F.array_position(F.array(*map(F.lit, COVERAGE_SQL)), C("name"))], "place")
)
query("agg16_count_if", "SELECT count(*) FILTER (l_returnflag = 'R') AS r, count(*) FILTER (l_linestatus = 'O') AS o, count(*) FILTER (l_discount > 0.05) AS d FROM lineitem", on="lineitem")(
    lambda x: x.agg(F.count_if(C("l_returnflag") == "R").alias("r"), F.count_if(C("l_linestatus") == "O").alias("o"), F.count_if(C("l_discount") > 0.05).alias("d"))
)
query("agg19_pages", f"WITH {U}, {CACHE_SQL} SELECT url, count(*) AS members, min(pos) AS first FROM u WHERE url IS NOT NULL AND kind IN ('residential', 'room') AND url NOT IN (SELECT url FROM c) GROUP BY 1", on="units")(
    lambda u: ops.pages_to_read(u, cache_of(u), ["pos"]).select("url", "members", C("first.pos").alias("first"))
)
query("agg20_shared_pages", f"WITH {U} SELECT pos, count(*) OVER (PARTITION BY source, url) AS members FROM u WHERE url IS NOT NULL", on="units")(lambda u: ops.with_page_members(u).select("pos", "members"))
COSTS_SQL = "k AS (SELECT count(*) AS pages, round(coalesce(sum(n_chars / 4.0 + 700), 0), 2)::DOUBLE AS tokens_in, count(*) * 220 AS tokens_out, min(n_chars) AS least, list_sort(list(n_chars))[count(*) // 2 + 1] AS median, max(n_chars) AS most FROM documents)"
query("agg22_costs", f"WITH {COSTS_SQL} SELECT * FROM k", on="documents")(lambda d: ops.token_costs(d, C("n_chars")).withColumn("tokens_in", F.round("tokens_in", 2)))
RATES = (("small", 1.0, 5.0), ("middle", 2.0, 10.0), ("large", 5.0, 25.0))
query("agg22_prices", f"WITH {COSTS_SQL}, p AS (SELECT r.model, tokens_in / 1e6 * r.i + tokens_out / 1e6 * r.o AS p FROM k, (VALUES " + ", ".join(map(str, RATES)) + ") AS r(model, i, o)) SELECT model, round(p, 2)::DOUBLE AS at_once, round(p / 2, 2)::DOUBLE AS in_batch FROM p", on="documents")(
    lambda d: ops.price_table(ops.token_costs(d, C("n_chars")), RATES)
)
query("agg11_median_of_all", "SELECT CAST(median(l_extendedprice) AS DOUBLE) AS median FROM lineitem", on="lineitem")(lambda x: dashboard.median_of(x, C("l_extendedprice")))
query("agg23_estimate", "SELECT count(*) AS n, round(count(*) * (5000 * 1.0 + 200 * 5.0) / 1e6 / 2, 2) AS cost FROM documents", on="documents")(lambda d: ops.flat_cost(d, 1.0, 5.0))
query("agg24_first_contact", "SELECT c_mktsegment AS slug, arg_min(c_name, c_custkey) AS contact FROM customer GROUP BY 1", on="customer")(lambda c: ops.first_contacts(c.select(C("c_mktsegment").alias("slug"), C("c_name").alias("contact"), "c_custkey"), ["c_custkey"]))
query("agg25_contact_coverage", f"WITH {CONTACTS_SQL} SELECT count(*) AS managers, count(phone) AS phones, count(*) FILTER (len(emails) > 0) AS emails FROM l", on="customer")(lambda c: ops.contact_coverage(contacts(c)))

# orders, limits

#: Orders over units of which some state an empty date or city, and some differ by their address alone.
EMPTIES = "e AS (SELECT * REPLACE (CASE WHEN pos % 31 = 5 THEN '' ELSE available_date END AS available_date, CASE WHEN pos % 19 = 2 THEN '' ELSE city END AS city, CASE WHEN pos % 3 = 0 THEN NULL ELSE rent END AS rent) FROM u)"
SORT_SQL = {
    "srt01_raw": ("raw", RAW_ORDER_SQL),
    "srt02_merged": ("soonest", "NOT available_now, CASE WHEN coalesce(available_date, '') = '' THEN '9999-99-99' ELSE available_date END, coalesce(rent, 9e9)"),
    "srt03_rent_asc": ("rent-asc", "coalesce(rent, 9e9)"),
    "srt03_rent_desc": ("rent-desc", "coalesce(rent, -1) DESC"),
    "srt03_beds_desc": ("beds-desc", "coalesce(bedrooms, -1) DESC"),
    # a locale puts signs, such as ~, before letters
    "srt03_city": ("city", "CASE WHEN coalesce(city, '') = '' THEN ' ' ELSE lower(city) END"),
}


def with_empties(u: DataFrame) -> DataFrame:
    return u.withColumns({"available_date": F.when(C("pos") % 31 == 5, "").otherwise(C("available_date")), "city": F.when(C("pos") % 19 == 2, "").otherwise(C("city")), "rent": F.when(C("pos") % 3 != 0, C("rent"))})


for _name, (_sort, _order) in SORT_SQL.items():
    query(_name, f"WITH {U}, {EMPTIES} SELECT pos, row_number() OVER (ORDER BY {_order}, pos) - 1 AS place FROM e", on="units")(lambda u, s=_sort: ops.numbered(with_empties(u), [*dashboard.SORTS[s](), C("pos")], "place").select("pos", "place"))
query("srt05_page_ids", f"WITH {U}, k AS (SELECT DISTINCT url FROM u WHERE url IS NOT NULL) SELECT url, 'p' || lpad(CAST(row_number() OVER (ORDER BY url) - 1 AS STRING), 5, '0') AS page_id FROM k", on="units")(
    lambda u: ops.numbered_pages(u.where("url is not null").select("url").distinct()).select("url", "page_id")
)
query("srt06_statuses", "SELECT 's' || s_suppkey AS slug, row_number() OVER (ORDER BY 's' || s_suppkey) - 1 AS place FROM supplier", on="supplier")(lambda s: ops.numbered(raw.status_rows(s.select(F.concat(F.lit("s"), "s_suppkey").alias("slug"))), ["slug"], "place"))
query("lim01_paging", f"WITH {U} SELECT pos FROM u ORDER BY coalesce(rent, -1) DESC, pos LIMIT 50 OFFSET 100", on="units")(lambda u: dashboard.page_of(u, "rent-desc", ["pos"], page=2).select("pos"))
@query("lim01_stored_order", f"WITH {U}, {EMPTIES}" + " UNION ALL ".join(f" SELECT '{s}' AS sort, pos, place FROM (SELECT pos, row_number() OVER (ORDER BY {o}, pos) - 1 AS place FROM e) WHERE place BETWEEN 1250 AND 1299" for s, o in SORT_SQL.values()), on="units")
def _(u):
    """A page of each order, read from the block of 1000 places that it lies in. The units are made once for all orders."""
    folder = scratch(u.sparkSession, "orders")
    with_empties(u).write.parquet(f"{folder}/units")
    units, found = u.sparkSession.read.parquet(f"{folder}/units"), []
    for sort, _ in SORT_SQL.values():
        dashboard.store_order(units, sort, ["pos"], f"{folder}/{sort}", block=1000)
        found.append(dashboard.stored_page(u.sparkSession, f"{folder}/{sort}", page=25, block=1000).select(F.lit(sort).alias("sort"), "pos", "place"))
    return read_back(functools.reduce(DataFrame.unionByName, found), folder)


query("lim01_pages_of_each_order", f"WITH {U}" + " UNION ALL ".join(f" SELECT '{s}' AS sort, pos FROM (SELECT pos FROM u ORDER BY {o}, pos LIMIT 50 OFFSET 50)" for s, o in SORT_SQL.values()), on="units")(
    lambda u: functools.reduce(DataFrame.unionByName, [dashboard.page_of(u, s, ["pos"], page=1).select(F.lit(s).alias("sort"), "pos") for s, _ in SORT_SQL.values()])
)
query("lim03_top_k", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 8", on="lineitem")(lambda x: dashboard.top(x.groupBy("l_partkey").agg(F.count("*").alias("n")), 8, "l_partkey"))
CLEAN_SQL = r"""trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<noscript\b.*?</noscript>|<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&amp;', '&'), '[\s\x{00A0}]+', ' ', 'g'))"""
query("lim04_truncate", f"SELECT page_id, left({CLEAN_SQL}, 200) AS head, length(left({CLEAN_SQL}, 20000)) AS n FROM pages", on="pages")(lambda p: p.select("page_id", text.detail_text(C("html"), 200, bare=False).alias("head"), F.length(text.detail_text(C("html"), bare=False)).cast("long").alias("n")))

# scalar functions

query(
    "str01_clean_text",
    """SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&amp;', '&'), '[\\s\\x{00A0}]+', ' ', 'g')) AS clean FROM pages""",
    on="pages",
)(lambda p: p.select("page_id", text.cleaned(C("html"), bare=False).alias("clean")))
query("str02_rent", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 1 THEN least(99999.99::DOUBLE, CASE WHEN o_totalprice >= 100 THEN round(o_totalprice, 2) END) WHEN o_orderkey % 4 = 3 OR o_totalprice < 100 OR o_totalprice > 100000 THEN NULL ELSE round(o_totalprice, 2) END AS rent FROM orders", on="orders")(
    lambda o: o.select("o_orderkey", text.parse_rent(F.when(C("o_orderkey") % 4 == 0, F.concat(F.lit("Rent: $"), F.format_number("o_totalprice", 2), F.lit(" / mo"))).when(C("o_orderkey") % 4 == 1, F.concat(F.lit("$"), F.format_string("%.2f", "o_totalprice"), F.lit(" - $99,999.99"))).when(C("o_orderkey") % 4 == 2, F.format_string("%.2f", "o_totalprice")).otherwise("ask us")).alias("rent"))
)
query("str03_bedrooms", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 0.0 WHEN 3 THEN NULL ELSE CASE WHEN p_size <= 20 THEN CAST(p_size AS DOUBLE) END END::DOUBLE AS beds FROM part", on="part")(
    lambda p: p.select("p_partkey", text.parse_bedrooms(F.when(C("p_partkey") % 4 == 0, "Studio / 1 ba").when(C("p_partkey") % 4 == 1, F.concat("p_size", F.lit(" Bed | 1 Bath"))).when(C("p_partkey") % 4 == 2, F.concat(F.lit(" "), "p_size", F.lit(" "))).otherwise("call us")).alias("beds"))
)
query("str04_bathrooms", "SELECT p_partkey, CASE WHEN p_size <= 20 THEN CAST(p_size AS DOUBLE) END AS baths FROM part", on="part")(lambda p: p.select("p_partkey", text.parse_bathrooms(F.concat(F.lit("2 bd / "), "p_size", F.lit(" ba"))).alias("baths")))
query("str05_square_feet", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CAST(10 + o_orderkey % 9000 AS INT) END AS area FROM orders", on="orders")(
    lambda o: o.select("o_orderkey", text.parse_square_feet(F.when(C("o_orderkey") % 2 == 0, F.concat(F.format_number(10 + C("o_orderkey") % 9000, 0), F.lit(" sq. ft."))).otherwise("750.0")).alias("area"))
)
query("dat01_available", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day, o_orderkey % 4 = 3 AS now FROM orders", on="orders")(
    lambda o: o.select("o_orderkey", dates.parse_available(F.when(C("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "'from' yyyy-MM-dd")).when(C("o_orderkey") % 4 == 1, F.date_format("o_orderdate", "'Available' MMMM d, yyyy")).when(C("o_orderkey") % 4 == 2, F.date_format("o_orderdate", "M/d/yyyy")).otherwise("Available NOW"), TODAY).alias("a")).select("o_orderkey", C("a.date").alias("day"), C("a.now").alias("now"))
)
query("dat02_infer_year", "SELECT DISTINCT month(o_orderdate)::INT AS m, day(o_orderdate)::INT AS d, CASE WHEN month(o_orderdate) = 2 AND day(o_orderdate) = 29 THEN 1998 WHEN date_diff('day', CAST('1998-' || strftime(o_orderdate, '%m-%d') AS DATE), DATE '1998-06-15') > 60 THEN 1999 ELSE 1998 END::INT AS y FROM orders", on="orders")(
    lambda o: o.select(F.month("o_orderdate").alias("m"), F.day("o_orderdate").alias("d")).distinct().withColumn("y", dates.infer_year(C("m"), C("d"), F.lit(TODAY)))
)
#: Daylight saving lasts from 10:00 UTC on the second Sunday of March to 9:00 UTC on the first of November.
SUNDAY_SQL = "make_date(year(t), {0}, {1}) + ((7 - dayofweek(make_date(year(t), {0}, {1}))) % 7)::INT"
query("dat03_epoch", f"SELECT event_id, CAST(t - CASE WHEN t >= {SUNDAY_SQL.format(3, 8)} + INTERVAL 10 HOUR AND t < {SUNDAY_SQL.format(11, 1)} + INTERVAL 9 HOUR THEN INTERVAL 7 HOUR ELSE INTERVAL 8 HOUR END AS DATE) AS day FROM (SELECT event_id, CAST(ts AS TIMESTAMP) + INTERVAL (event_id % 366) DAY AS t FROM events)", on="events")(
    lambda e: e.select("event_id", dates.pacific_date(F.unix_millis(C("ts").cast("timestamp") + F.make_dt_interval(days=(C("event_id") % 366).cast("int")))).alias("day"))
)
query("dat04_labels", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, strftime(o_orderdate, '%b %-d, %Y') AS label, strftime(o_orderdate, '%Y-%m') AS month, strftime(o_orderdate, '%b %y') AS short FROM orders", on="orders")(
    lambda o: o.select(C("o_orderdate").cast("date").alias("day")).distinct().select("day", dates.day_label(C("day")).alias("label"), dates.month_key(C("day")).alias("month"), dates.month_label(C("day")).alias("short"))
)
query("str06_city", f"WITH {U} SELECT pos, city FROM (SELECT pos, nullif(city, '') AS city FROM u)", on="units")(
    lambda u: u.select("pos", places.normal_city(F.concat(F.lit("  "), F.regexp_replace(F.upper("city"), " ", "  "), F.lit(" ,"))).alias("city"))
)
query("str07_location", f"WITH {U} SELECT pos, nullif(city, '') AS city, CASE WHEN coalesce(city, '') <> '' THEN state END AS state, CASE WHEN coalesce(city, '') <> '' THEN lpad(CAST(pos % 90000 AS STRING), 5, '0') END AS zip FROM u", on="units")(
    lambda u: u.select("pos", places.parse_location(F.concat("address", F.lit(", "), F.coalesce("city", F.lit("")), F.lit(", "), "state", F.lit(" "), F.lpad((C("pos") % 90000).cast("string"), 5, "0"))).alias("l")).select("pos", "l.city", "l.state", "l.zip")
)
query("str08_city_of_address", f"WITH {U} SELECT pos, nullif(city, '') AS city FROM u", on="units")(lambda u: u.select("pos", places.city_of_address(F.concat("address", F.lit(", "), F.coalesce("city", F.lit("")), F.lit(", "), "state")).alias("city")))
query("str09_classify", "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'application' WHEN p_partkey % 5 = 1 AND p_size < 25 THEN 'parking' WHEN p_partkey % 5 = 2 AND p_size < 25 THEN 'storage' WHEN p_partkey % 5 = 3 THEN 'room' ELSE 'residential' END AS kind FROM part", on="part")(
    lambda p: p.select("p_partkey", kinds.classify(C("p_name"), F.element_at(F.array(*map(F.lit, ("Rental Application", "Covered Parking", "Locker 4", "Private room near campus", "Sunny flat"))), (C("p_partkey") % 5 + 1).cast("int")), F.when(C("p_size") < 25, 0.0).otherwise(2.0)).alias("kind"))
)
query("str10_title_beds", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 0.0 WHEN 1 THEN CASE WHEN p_size <= 20 THEN CAST(p_size AS DOUBLE) END END::DOUBLE AS beds FROM part", on="part")(
    lambda p: p.select("p_partkey", text.bedrooms_from_title(F.when(C("p_partkey") % 3 == 0, "Corner studio with view").when(C("p_partkey") % 3 == 1, F.concat(F.lit("Sunny "), "p_size", F.lit("BR flat"))).otherwise(C("p_size").cast("string"))).alias("beds"))
)
query("str11_address", f"WITH {U} SELECT pos, {ADDRESS_SQL} AS address FROM u", on="units")(lambda u: u.select("pos", text.normal_address(C("address")).alias("address")))
query("str12_facts", "SELECT c_custkey, c_name AS name, CAST(c_nationkey AS STRING) AS nation FROM customer", on="customer")(
    lambda c: c.select("c_custkey", text.label_values(F.concat(F.lit("<dt>Name:</dt><dd>x</dd><dt>Nation</dt> <dd>"), C("c_nationkey").cast("string"), F.lit("</dd><dt>name</dt><dd><b>"), "c_name", F.lit("</b></dd>")), r"(?is)<dt[^>]*>(.*?)</dt>\s*<dd[^>]*>(.*?)</dd>").alias("m")).select("c_custkey", C("m")["name"].alias("name"), C("m")["nation"].alias("nation"))
)
query("str13_first_attr", "SELECT c_custkey, nullif(CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END, '') AS v FROM customer", on="customer")(lambda c: c.select("c_custkey", text.found(F.concat(F.lit('data-x="'), F.when(C("c_custkey") % 2 == 0, C("c_name")).otherwise(""), F.lit('"')), 'data-x="([^"]*)"').alias("v")))
query("str15_contact", "SELECT c_custkey, '(' || 100 + c_custkey % 900 || ') 555-' || 1000 + c_custkey % 9000 AS phone, 'c' || c_custkey || '@firm.com' AS email FROM customer", on="customer")(
    lambda c: c.select("c_custkey", text.extract_contact(F.concat(F.lit("<script>a@evil.com</script><!-- b@evil.com --><a href='mailto:C"), "c_custkey", F.lit("@firm.com'>write</a> "), (100 + C("c_custkey") % 900).cast("string"), F.lit("-555-"), (1000 + C("c_custkey") % 9000).cast("string"))).alias("x")).select("c_custkey", "x.phone", F.get("x.emails", F.lit(0)).alias("email"))
)
query("str16_specs", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'private_room' WHEN 1 THEN 'shared_room' END AS room_type FROM part", on="part")(lambda p: p.select("p_partkey", kinds.room_type_of_specs(F.when(C("p_partkey") % 3 == 0, "Private Room in 3 bd / 2 ba").when(C("p_partkey") % 3 == 1, "shared room in Studio").otherwise("Room in Studio")).alias("room_type")))


def policy(name: str, value) -> F.Column:
    return F.array(F.struct(F.lit("Other").alias("catalogName"), F.array(F.lit("1 tenant max per room")).alias("type")), F.struct(F.lit(name).alias("catalogName"), F.array(value).alias("type"))).cast(kinds.POLICY)


query("arr01_occupancy", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 1 AND p_size < 30 THEN 'private_room' END AS room_type FROM part", on="part")(
    lambda p: p.select("p_partkey", kinds.room_type_of_occupancy(policy("Occupancy Policy", F.concat((C("p_partkey") % 3).cast("string"), F.lit(" tenants max per room"))), C("p_size") < 30).alias("room_type"))
)
query("arr02_pets", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'cats_only' WHEN 2 THEN 'dogs_only' WHEN 3 THEN 'allowed' END AS pets FROM part", on="part")(
    lambda p: p.select("p_partkey", kinds.pets_of_policy(policy("Pet Policy", F.element_at(F.array(*map(F.lit, ("No Pets", "Cats Allowed", "Dogs OK", "Cats and dogs", "Ask"))), (C("p_partkey") % 5 + 1).cast("int")))).alias("pets"))
)
query(
    "arr03_merge",
    f"""WITH {U}, e AS (SELECT *, CASE WHEN coalesce(pets, '') <> '' OR coalesce(room_type, '') <> '' THEN 'structured' ELSE 'none' END AS a, CASE pos % 3 WHEN 0 THEN 'llm' WHEN 1 THEN 'structured' ELSE 'none' END AS b FROM u)
    SELECT pos, coalesce(pets, laundry) AS pets, CASE WHEN a = b OR b = 'none' THEN a WHEN a = 'none' THEN b ELSE a || '+' || b END AS method, CASE WHEN pos % 2 = 0 THEN 'read' END AS evidence, laundry IS NOT NULL AS complete FROM e""",
    on="units",
)(
    lambda u: u.withColumn("summary", F.lit(None).cast("string")).withColumn("e", ops.merge_enrichments(ops.structured_of(), F.struct(
        F.lit("shared_room").alias("room_type"), C("laundry").alias("pets"), F.lit("furnished").alias("furnished"), F.lit("street").alias("parking"), F.lit(None).cast("string").alias("laundry"), F.lit("Nice.").alias("summary"),
        F.when(C("pos") % 3 == 0, "llm").when(C("pos") % 3 == 1, "structured").otherwise("none").alias("method"), F.when(C("pos") % 2 == 0, F.create_map(F.lit("pets"), F.lit("read"))).alias("evidence"))))
    .select("pos", "e.pets", "e.method", F.try_element_at("e.evidence", F.lit("pets")).alias("evidence"), (F.size(ops.missing_fields(C("e"))) == 0).alias("complete"))
)
query("mth01_money", "SELECT o_orderkey, '$' || format('{:,}', CAST(floor(o_totalprice + 0.5) AS BIGINT)) AS price FROM orders", on="orders")(lambda o: o.select("o_orderkey", text.money(C("o_totalprice")).alias("price")))


def two_readings(o: DataFrame) -> tuple[dict, dict]:
    """The parser's reading of an order and a page's, apart by less and by more than each tolerance, each with nulls."""
    k = C("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    mine = {
        "bedrooms": (k % 4).cast("double"), "bathrooms": F.lit(1.0), "rent": F.when(k % 9 > 0, C("o_totalprice")), "square_feet": F.lit(1000.0), "available_date": day,
        "available_now": k % 2 == 0, "city": F.lit("Oakland"), "kind": F.lit("residential"),
    }
    page = {
        "bedrooms": F.when(k % 5 > 0, (k % 4 + (k % 3 == 0).cast("int")).cast("double")), "bathrooms": 1.0 + (k % 3) * 0.008, "rent": C("o_totalprice") + (k % 5) * 0.4, "square_feet": (1000 + k % 40).cast("double"),
        "available_date": F.date_format(F.date_add(C("o_orderdate").cast("date"), (k % 2).cast("int")), "M/d/yyyy"), "available_now": k % 3 == 0, "city": F.when(k % 2 == 0, " OAKLAND ").otherwise("Berkeley"),
        "kind": F.when(k % 3 == 0, "unknown").when(k % 3 == 1, "room").otherwise("residential"),
    }
    return mine, page


@query(
    "cmp01_tolerance",
    """SELECT o_orderkey, f AS field, y AS type FROM (SELECT o_orderkey, o_orderkey AS k, o_totalprice AS p FROM orders), LATERAL (VALUES
      ('bedrooms', CASE WHEN k % 5 > 0 AND k % 3 = 0 THEN 'conflict' END), ('bathrooms', CASE WHEN k % 3 = 2 THEN 'conflict' END),
      ('rent', CASE WHEN k % 9 = 0 THEN 'parser_missing' WHEN abs(p - (p + (k % 5) * 0.4::DOUBLE)) > 1.0 THEN 'conflict' END), ('square_feet', CASE WHEN k % 40 > 20 THEN 'conflict' END),
      ('available_date', CASE WHEN k % 2 = 1 THEN 'conflict' END), ('available_now', CASE WHEN (k % 2 = 0) <> (k % 3 = 0) THEN 'conflict' END), ('city', CASE WHEN k % 2 = 1 THEN 'conflict' END),
      ('kind', CASE WHEN k % 3 = 1 THEN 'conflict' END)) AS v(f, y) WHERE y IS NOT NULL""",
    on="orders",
)
def _(o):
    mine, page = two_readings(o)
    return ops.compare_readings(o, ["o_orderkey"], mine, page, F.lit(TODAY)).select("o_orderkey", "field", "type")


@query(
    "agg17_conflict_counts",
    """SELECT y AS type, count(*) AS n FROM (SELECT o_orderkey AS k FROM orders), LATERAL (VALUES (CASE WHEN k % 5 > 0 AND k % 3 = 0 THEN 'conflict' END), (CASE WHEN k % 3 = 2 THEN 'conflict' END),
      (CASE WHEN k % 9 = 0 THEN 'parser_missing' WHEN k % 5 > 2 THEN 'conflict' END), (CASE WHEN k % 40 > 20 THEN 'conflict' END), (CASE WHEN k % 2 = 1 THEN 'conflict' END),
      (CASE WHEN (k % 2 = 0) <> (k % 3 = 0) THEN 'conflict' END), (CASE WHEN k % 2 = 1 THEN 'conflict' END), (CASE WHEN k % 3 = 1 THEN 'conflict' END)) AS v(y) WHERE y IS NOT NULL GROUP BY 1""",
    on="orders",
)
def _(o):
    mine, page = two_readings(o)
    return ops.compare_readings(o, [], mine, page, F.lit(TODAY)).groupBy("type").agg(F.count("*").alias("n"))


@query(
    "cmp02_inline",
    """SELECT o_orderkey, f AS field FROM (SELECT o_orderkey, o_orderkey AS k, o_totalprice AS p FROM orders), LATERAL (VALUES ('bedrooms', k % 5 > 0 AND k % 3 = 0), ('rent', k % 9 > 0 AND (k % 5) * 0.4::DOUBLE / (p + (k % 5) * 0.4::DOUBLE) > 0.05), ('kind', k % 3 = 1), ('city', k % 2 = 1)) AS v(f, y) WHERE y""",
    on="orders",
)
def _(o):
    mine, page = two_readings(o)
    return o.select("o_orderkey", F.explode(ops.inline_conflicts(mine, page)).alias("c")).select("o_orderkey", "c.field")


query("agg18_applied", f"WITH {U}, c AS (SELECT url, arg_max(bedrooms + 1, pos) AS b FROM u WHERE url IS NOT NULL AND pos % 5 = 0 AND bedrooms IS NOT NULL GROUP BY url) SELECT 'bedrooms' AS field, true AS applied, count(*) AS n FROM u JOIN c USING (url) WHERE bedrooms IS DISTINCT FROM b UNION ALL SELECT 'rent', false, count(*) FROM u WHERE url IS NOT NULL AND pos % 5 = 1", on="units")(
    lambda u: ops.reconcile_counts(u, u.where("url is not null and (pos % 5 = 1 or pos % 5 = 0 and bedrooms is not null)").select("url", F.when(C("pos") % 5 == 0, "bedrooms").otherwise("rent").alias("field"), (C("bedrooms") + 1).cast("string").alias("page"), F.lit("conflict").alias("type"), C("pos").alias("ord")))
)
@query(
    "prm01_apply",
    f"WITH {U}, c AS (SELECT DISTINCT url FROM u WHERE url IS NOT NULL AND pos % 3 = 0) SELECT pos, CASE WHEN c.url IS NULL THEN pets ELSE coalesce(pets, 'none') END AS pets, CASE WHEN c.url IS NULL THEN parking ELSE coalesce(parking, 'street') END AS parking, CASE WHEN pos % 2 = 0 THEN 'Own.' WHEN c.url IS NULL THEN '' ELSE 'Nice.' END AS summary, CASE WHEN c.url IS NOT NULL AND bedrooms <> 2 THEN 'bedrooms' WHEN pos % 4 = 0 THEN 'old' END AS conflict FROM u LEFT JOIN c ON u.url = c.url",
    on="units",
)
def _(u):
    observed = F.from_json(F.lit('{"describes_one_unit": true, "bedrooms": 2.0, "listing_kind": "unknown"}'), raw.OBSERVED)
    none = F.lit(None).cast("string")
    read = cache_of(u).select("url", none.alias("room_type"), F.lit("none").alias("pets"), none.alias("furnished"), F.lit("street").alias("parking"), none.alias("laundry"), F.lit("Nice.").alias("summary"), observed.alias("observed"))
    old = F.when(C("pos") % 4 == 0, F.array(F.struct(F.lit("old").alias("field"), none.alias("parsed"), none.alias("observed"))))
    done = ops.apply_results(u.withColumns({"summary": F.when(C("pos") % 2 == 0, "Own.").otherwise(""), "conflicts": old}), read)
    return done.select("pos", "pets", "parking", "summary", F.get("conflicts", F.lit(0))["field"].alias("conflict"))
query("prm02_structured", f"WITH {U} SELECT pos, CASE WHEN coalesce(pets, '') <> '' OR room_type IS NOT NULL THEN 'structured' ELSE 'none' END AS method FROM u", on="units")(
    lambda u: u.withColumn("summary", F.lit(None).cast("string")).select("pos", ops.structured_of()["method"].alias("method"))
)
query("snk06_conflict_report", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, CASE WHEN o_orderkey % 3 > 0 THEN lpad(CAST(o_orderkey AS STRING), 12, '0') ELSE '' END, lpad(CAST(o_orderkey AS STRING), 12, '0')) - 1 AS place FROM orders WHERE o_orderstatus = 'F'", on="orders")(
    lambda o: ops.numbered(raw.conflict_report(o.select("o_orderkey", F.when(C("o_orderstatus") == "F", "conflict").otherwise("parser_missing").alias("type"), C("o_orderpriority").alias("field"), F.when(C("o_orderkey") % 3 > 0, F.lpad(C("o_orderkey").cast("string"), 12, "0")).alias("address"), F.lpad(C("o_orderkey").cast("string"), 12, "0").alias("url"))), raw.report_order(), "place").select("o_orderkey", "place")
)


def keyword_reader(pages):
    """A stand-in for a remote reader: it knows one word."""
    return pages[["url"]].assign(**{c: None for c in ("room_type", "furnished", "parking", "laundry", "summary", "evidence", "observed")}, pets=["none" if "0" in t else None for t in pages["text"]], method="llm")


query("udf02_cache_only", f"WITH {U}, {CACHE_SQL} SELECT url, laundry FROM c", on="units")(lambda u: extractor.read_pages(u.select("url"), full_cache(u)).select("url", "laundry"))
query("udf02_extractor", f"WITH {U}, {CACHE_SQL}, p AS (SELECT DISTINCT url FROM u WHERE url IS NOT NULL) SELECT p.url, CASE WHEN c.url IS NULL THEN 'llm' END AS method, CASE WHEN c.url IS NULL AND contains(p.url, '0') THEN 'none' END AS pets FROM p LEFT JOIN c ON p.url = c.url", on="units")(
    lambda u: extractor.read_pages(u.where("url is not null").select("url").distinct().withColumn("text", C("url")), full_cache(u), extractor.by_batches(keyword_reader)).select("url", "method", "pets")
)


@query("udf02_resumable", f"WITH {U}, p AS (SELECT DISTINCT url, contains(url, '0') AS said FROM u WHERE url IS NOT NULL) SELECT url, 'llm' AS method, CASE WHEN said THEN 'none' END AS pets, 2 AS version FROM p", on="units")
def _(u):
    """Half of the pages are read, then all: those of the first run come from the journal. The answers are published as a cache, which is read back."""
    folder = scratch(u.sparkSession, "answers")
    journal, cache = extractor.Journal(f"{folder}/journal", 8), PublishedByKey(u.sparkSession, f"{folder}/cache", extractor.RESULT, "url", 8)
    pages = u.where("url is not null").select("url", C("url").alias("text"))
    for some in (pages.where("url like '%1'"), pages):
        found = extractor.read_pages(some, cache.read(), extractor.resumable(keyword_reader, journal, chunk=500))
        found.write.format("noop").mode("overwrite").save()
        version = extractor.absorb(u.sparkSession, journal, cache)
    return read_back(cache.read(version).select("url", "method", "pets", F.lit(version).alias("version")), folder)


def full_cache(u: DataFrame) -> DataFrame:
    names = [x.split(" ", 1) for x in ("room_type string", "pets string", "parking string", "summary string", "method string", "evidence map<string,string>", f"observed {raw.OBSERVED}")]
    return cache_of(u).select("url", "laundry", "furnished", *[F.lit(None).cast(kind).alias(name) for name, kind in names])

from . import markup  # noqa: E402, F401  its queries register themselves here
