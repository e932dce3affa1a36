"""Queries over listing pages. The driver's tables have no listings, so cards are written from orders, a page for each 64 of
the keys, and each adapter has to read from them what went in; every tenth card lacks its address and must be dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kinds, places
from ..operators import dashboard, units as ops
from ..sources import portals, raw
from .catalog import AREAS_SQL, DOCS_SQL, LIVABLE_SQL, MERGED_SQL, SOURCES_SQL, TODAY, TYPE_SQL, C, U, listed_sources, query



def K() -> Column:  # noqa: N802  columns need a session, so they are made when a query is
    return C("o_orderkey")


def STREET() -> Column:  # noqa: N802
    return F.when(K() % 10 == 0, "").otherwise(F.concat(K().cast("string"), F.lit(" Oak St")))


def PRICE() -> Column:  # noqa: N802
    return F.format_number(1000 + K() % 500, 0)


def BEDS() -> Column:  # noqa: N802
    return (K() % 4 + 1).cast("string")


BASE = "SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 10 <> 0"


def says(*parts) -> Column:
    """Text and Columns joined."""
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def pages(orders: DataFrame, card: Column, column: str = "html") -> DataFrame:
    """Pages of a few cards each, as long as they are however many orders there are."""
    cards = orders.groupBy(F.floor(K() / 64).alias("page")).agg(F.sort_array(F.collect_list(F.struct(K().alias("k"), card.alias("c")))).alias("cs"))
    whole = F.concat(F.lit("<p>top</p>"), F.array_join(F.transform("cs", lambda x: x["c"]), "")) if column == "html" else says("[", F.array_join(F.transform("cs", lambda x: x["c"]), ","), "]")
    return cards.select(F.lit("s").alias("source"), F.lit("M").alias("manager"), F.lit("https://x.org").alias("base_url"), whole.alias(column))


def read(orders: DataFrame, platform: str, card: Column, *columns: str, column: str = "html") -> DataFrame:
    return portals.extract(pages(orders, card, column), platform, F.lit(TODAY)).select(*columns)


query("src03_appfolio", f"SELECT k || ' Oak St, Oakland, CA 94601' AS address, 'Oakland' AS city, '94601' AS postal_code, CAST(1000 + k % 500 AS DOUBLE) AS rent, CAST(k % 4 + 1 AS DOUBLE) AS bedrooms, '2098-08-01' AS available_date, 'https://x.org/listings/detail/' || k AS url FROM ({BASE})", on="orders")(
    lambda o: read(o, "appfolio", says('<div class="x js-listing-item"><span class="js-listing-address">', F.when(K() % 10 == 0, "").otherwise(says(STREET(), ", Oakland, CA 94601")), '</span><div class="js-listing-blurb-rent">$', PRICE(), '</div><span class="js-listing-blurb-bed-bath">', BEDS(), ' bd / 1 ba</span><dd class="js-listing-available">8/1/98</dd><a href="/listings/detail/', K().cast("string"), '">d</a></div>'),
                   "address", "city", "postal_code", "rent", "bedrooms", "available_date", "url")
)
query("src04_buildium", f"SELECT k || ' Oak St, Fresno, CA 93726' AS address, 'Fresno' AS city, CASE WHEN k % 2 = 0 THEN 0.0 ELSE CAST(k % 4 + 1 AS DOUBLE) END AS bedrooms, CAST(1000 + k % 500 AS DOUBLE) AS rent, true AS available_now, CAST(700 + k % 90 AS INT) AS square_feet FROM ({BASE})", on="orders")(
    lambda o: read(o, "buildium", says('<a class="featured-listing" ', F.when(K() % 2 == 0, 'data-bedrooms="0" ').otherwise(""), 'data-rent="', (1000 + K() % 500).cast("string"), '.00" data-location="Fresno,CA|93726"><h3 class="featured-listing__title">', STREET(), '</h3><p class="featured-listing__address">', F.when(K() % 10 == 0, "").otherwise("Fresno, CA 93726"), '</p><p class="featured-listing__features">', BEDS(), " Bed | 1 Bath | ", (700 + K() % 90).cast("string"), ' sqft</p><p class="featured-listing__availability">Now</p></a>'),
                   "address", "city", "bedrooms", "rent", "available_now", "square_feet")
)
query("src05_showmojo", f"SELECT k || ' Oak St, Albany, CA 94706' AS address, CAST(k % 4 + 1 AS DOUBLE) AS bedrooms, 1.5 ::DOUBLE AS bathrooms, CAST(1000 + k % 500 AS DOUBLE) AS rent, '2098-09-01' AS available_date FROM ({BASE})", on="orders")(
    lambda o: read(o, "showmojo", says("<div class='js-listing-info'><div class='listing-address-header'>", STREET(), "</div><p class='listing-city-state-zip'>Albany, CA 94706</p><div class='rent-info'><span class='price'>$", PRICE(), "</span><i>Available 9/1/98</i></div></div><div class='listing-icon-wrap'><img src='icons/bed.png'>", BEDS(), " bd</div><div class='listing-icon-wrap'><img src='icons/bath.png'>1.5 ba</div>"),
                   "address", "bedrooms", "bathrooms", "rent", "available_date")
)
query("src06_eri", f"SELECT k || ' Oak St, #2, Albany, CA' AS address, 'Albany' AS city, CAST(k % 4 + 1 AS DOUBLE) AS bedrooms, CAST(1000 + k % 500 AS DOUBLE) AS rent, true AS available_now, 'https://x.org/unit.php?id=' || k AS url FROM ({BASE})", on="orders")(
    lambda o: read(o, "eri", says('<div class="rental3"><p class="rraddr"><a href="unit.php?id=', K().cast("string"), '">', STREET(), '</a></p><p class="rrunitid">#2</p><p class="rrcity">Albany</p><p class="rr">', BEDS(), " bd / 1 ba $", PRICE(), '</p><p class="rr">Available: now</p></div>'), "address", "city", "bedrooms", "rent", "available_now", "url")
)
query("src07_mmg", f"SELECT k || ' Oak St, San Francisco, California, United States 94103' AS address, 'San Francisco' AS city, '94103' AS postal_code, CASE WHEN k % 2 = 0 THEN 0.0 ELSE CAST(k % 4 + 1 AS DOUBLE) END AS bedrooms, CAST(1000 + k % 500 AS DOUBLE) AS rent FROM ({BASE})", on="orders")(
    lambda o: read(o, "mmg", says('<div class="wpl_prp_cont"><h4 class="wpl_prp_listing_location">', F.when(K() % 10 == 0, "").otherwise(says(STREET(), ", San Francisco, California, United States 94103")), "</h4>", F.when(K() % 2 == 0, "").otherwise(says('<div class="bedroom"><span class="value">', BEDS(), "</span></div>")), '<div class="bathroom"><span class="value">1</span></div><div class="price_box"><span>$', PRICE(), "</span></div></div>"),
                   "address", "city", "postal_code", "bedrooms", "rent")
)
query("src08_boston", f"SELECT k || ' Oak St' || CASE WHEN k % 3 < 2 THEN ', Quincy, MA' ELSE '' END AS address, CASE WHEN k % 3 < 2 THEN 'Quincy' END AS city, CAST(1000 + k % 500 AS DOUBLE) AS rent FROM ({BASE})", on="orders")(
    lambda o: read(o, "boston_pm", says('<div class="ym_listing"><h4><a href="/resident_listings/', F.when(K() % 3 == 1, "oak-quincy-2").otherwise("oak-elsewhere"), '">', STREET(), F.when((K() % 3 == 0) & (K() % 10 != 0), " - Quincy").otherwise(""), "</a></h4><h5>$", PRICE(), " / ", BEDS(), " bd</h5><h5>Availability: Now</h5></div>"), "address", "city", "rent")
)
query("src09_relisto", f"SELECT k || ' Oak St #3, Oakland, CA 94601' AS address, CAST(k % 4 + 1 AS DOUBLE) AS bedrooms, CAST(1000 + k % 500 AS DOUBLE) AS rent, '1998-08-01' AS available_date FROM ({BASE}) WHERE k % 3 > 0", on="orders")(
    lambda o: read(o, "relisto", says('{"id":', K().cast("string"), ',"title":{"rendered":"x"},"meta":{"property_status":"', F.when(K() % 3 == 0, "Leased").otherwise("Current"), '","city":"Oakland","state":"CA","zip_code":"94601","street_number":"', F.when(K() % 10 == 0, "").otherwise(K().cast("string")), '","street_name":"', F.when(K() % 10 == 0, "").otherwise("Oak St"), '","unit":"', F.when(K() % 10 == 0, "").otherwise("3"), '","bedrooms":"', BEDS(), '","price":"', (1000 + K() % 500).cast("string"), '","availability_date":"1998/08/01"}}'),
                   "address", "bedrooms", "rent", "available_date", column="payload")
)
query("src10_tripalink", f"SELECT '1 Way #' || k AS address, CASE WHEN k % 2 = 0 THEN 'room' ELSE 'residential' END AS kind, CASE WHEN k % 2 = 0 THEN 'private_room' END AS room_type, 'none' AS pets, CAST(1000 + k % 500 AS DOUBLE) AS rent FROM ({BASE})")(
    lambda spark, sf: portals.tripalink(
        spark.read.parquet(f"{sf}/orders.parquet").select(F.lit("s").alias("source"), F.lit("M").alias("manager"), F.lit("https://x.org").alias("base_url"),
            says('{"address":"', F.when(K() % 10 == 0, "").otherwise("1 Way"), '","id":4,"leasePolicy":[{"catalogName":"Pet Policy","type":["No Pets"]},{"catalogName":"Occupancy Policy","type":["1 tenant max per room"]}],"availableUnits":[{"name":"', K().cast("string"), '","floorPlanBedroomNum":3,"minPrice":', (1000 + K() % 500).cast("string"), ',"rooms":[', F.when(K() % 2 == 0, '{"id":1}').otherwise('{"id":1},{"id":2}'), "]}]}").alias("payload")),
        F.lit(TODAY)).select("address", "kind", "room_type", "pets", "rent")
)
def portal_pages(orders: DataFrame) -> DataFrame:
    """url, body of two portals: listing page, list in pages as long as they are however many orders there are, and a page for each order; some of these failed,
    some are missing, some are empty."""
    spark, k = orders.sparkSession, K().cast("string")
    half = F.when(K() % 2 == 0, "https://even.org").otherwise("https://odd.org")
    build = F.when(K() % 2 == 0, "b0").otherwise("b1")
    lists = orders.groupBy(half.alias("base"), build.alias("build"), F.floor(K() / 1024).alias("page")).agg(F.collect_list(F.struct(k.alias("id"))).alias("ids"))
    listing = orders.select(half.alias("base"), build.alias("build")).distinct().select(F.concat("base", F.lit(portals.LISTING_PAGE)).alias("url"), says('<script id="__NEXT_DATA__" type="application/json">{"buildId":"', C("build"), '"}</script>').alias("body"))
    named = lists.withColumn("base_url", C("base")).select(says(portals.filled(portals.LIST_JSON, C("build")), portals.LIST_PAGE, C("page").cast("string")).alias("url"), says('{"pageProps":{"data":{"ESProperties":{"data":', F.to_json("ids"), "}}}}").alias("body"))
    detail = says('{"pageProps":{"data":{"address":"', k, ' Way","id":"', k, '","availableUnits":[{"name":"1","minPrice":', (1000 + K() % 500).cast("string"), '},{"name":"2","maxPrice":"$900"}]}}}')
    body = F.when(K() % 5 == 1, F.lit(None)).when(K() % 5 == 2, '{"pageProps":{}}').otherwise(detail)
    details = orders.where(K() % 5 > 0).withColumn("base_url", half).select(portals.filled(portals.DETAIL_JSON, build, k, k).alias("url"), body.alias("body"))
    dead = spark.createDataFrame([("https://dead.org" + portals.LISTING_PAGE, "<html>moved</html>")], "url string, body string")
    return listing.unionByName(named).unionByName(details).unionByName(dead)


@query("src10_two_hops", "SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS source, o_orderkey || ' Way #' || n AS address, CASE n WHEN 1 THEN CAST(1000 + o_orderkey % 500 AS DOUBLE) ELSE 900.0 END AS rent, 'https://' || CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END || '.org/apartments/bay-area/berkeley/' || o_orderkey AS url FROM orders, (VALUES (1), (2)) AS v(n) WHERE o_orderkey % 5 > 2", on="orders")
def _(o):
    sources = o.sparkSession.createDataFrame([(n, "M", f"https://{n}.org") for n in ("even", "odd", "dead", "gone")], "source string, manager string, base_url string")
    return portals.tripalink_scan(sources, portal_pages(o), F.lit(TODAY)).select("source", "address", "rent", "url")


def list_pages(orders: DataFrame) -> DataFrame:
    """Lists of ten records a page, a source for each customer modulo 5: all full; page 3 short; page 3 empty; page 3 failed; page 1 failed."""
    page = (F.floor(C("o_custkey") / 5) % 6 + 1).cast("int")
    rows = orders.select((C("o_custkey") % 5).cast("string").alias("source"), page.alias("page")).distinct()
    record = lambda i: says('{"meta":{"property_status":"current","city":"Oakland","map":{"address":"', C("source"), "-", C("page").cast("string"), "-", i.cast("string"), '"}}}')
    some = lambda n: says("[", F.array_join(F.transform(F.sequence(F.lit(1), n), record), ","), "]")
    third = C("page") == 3
    body = F.when((C("source") == "1") & third, some(F.lit(4))).when((C("source") == "2") & third, "[]").when((C("source") == "3") & third | (C("source") == "4") & (C("page") == 1), F.lit(None)).otherwise(some(F.lit(10)))
    return rows.select("source", F.lit("M").alias("manager"), F.lit("https://x.org").alias("base_url"), "page", body.alias("payload"))


query(
    "src09_pages",
    "WITH p AS (SELECT DISTINCT (o_custkey % 5)::VARCHAR AS source, (o_custkey // 5) % 6 + 1 AS page FROM orders) SELECT source, source || '-' || page || '-' || i AS address FROM p, range(1, 11) AS r(i) WHERE source = '0' OR source < '4' AND page < 3 OR source = '1' AND page = 3 AND i <= 4",
    on="orders",
)(lambda o: portals.relisto(portals.until_stop(list_pages(o), per_page=10), F.lit(TODAY)).select("source", "address"))
query("src09_failed_sources", "SELECT '4' AS source", on="orders")(lambda o: portals.failed_sources(o.select((C("o_custkey") % 5).cast("string").alias("source")).distinct(), list_pages(o)))
query("flt04_no_address", "SELECT count(*) AS n FROM orders WHERE o_orderkey % 10 <> 0", on="orders")(lambda o: read(o, "eri", says('<div class="rental3"><p class="rraddr">', STREET(), "</p></div>"), "address").agg(F.count("*").alias("n")))
query("prj02_recompute", f"WITH {U}, v AS (SELECT pos, bedrooms + 1 AS bedrooms FROM u) SELECT pos, CASE WHEN bedrooms < 1 THEN 'studio' WHEN bedrooms >= 3 THEN '3plus_bedroom' WHEN bedrooms IS NOT NULL THEN CAST(CAST(floor(bedrooms) AS INT) AS STRING) || '_bedroom' END AS unit_type FROM v", on="units")(
    lambda u: u.withColumn("bedrooms", C("bedrooms") + 1).select("pos", kinds.unit_type(C("bedrooms")).alias("unit_type"))
)
query("prj04_no_kind", f"WITH {U} SELECT pos, address, unnest(['pos', 'address', 'room_type']) AS name FROM u", on="units")(  # what is left of each row's names as JSON
    lambda u: ops.published(u.select("pos", "kind", "address", F.lit("x").alias("room_type"))).withColumn("row", F.to_json(F.struct("*"))).select("pos", "address", F.explode(F.json_object_keys("row")).alias("name"))
)
query("prj07_zero_stays", f"WITH {U}, c AS (SELECT DISTINCT url FROM u WHERE url IS NOT NULL AND pos % 3 = 0) SELECT pos, coalesce(bedrooms, CASE WHEN c.url IS NOT NULL THEN 9.0 END) AS bedrooms FROM u LEFT JOIN c ON u.url = c.url", on="units")(
    lambda u: ops.fill(u, u.where("url is not null and pos % 3 = 0").select("url").distinct().withColumn("bedrooms", F.lit(9.0)), ("bedrooms",)).select("pos", "bedrooms")
)
query("prj09_url", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'https://x.org/p/' || c_custkey WHEN 1 THEN 'https://o.net/' || c_custkey ELSE 'https://x.org/listings' END AS url FROM customer", on="customer")(
    lambda c: c.select("c_custkey", F.lit("https://x.org//").alias("base_url"), F.when(C("c_custkey") % 3 == 0, says("/p/", C("c_custkey"))).when(C("c_custkey") % 3 == 1, says("https://o.net/", C("c_custkey"))).alias("h")).select("c_custkey", portals.absolute(C("h"), "/listings").alias("url"))
)
query("flt05_current", "SELECT 'Map ' || o_orderkey AS address FROM orders WHERE o_orderstatus IN ('O', 'P')", on="orders")(
    lambda o: read(o, "relisto", says('{"meta":{"property_status":"', F.when(C("o_orderstatus") == "O", "current").when(C("o_orderstatus") == "P", "CURRENT").otherwise("Leased"), '","city":"Oakland","map":{"address":"Map ', K().cast("string"), '"}}}'), "address", column="payload")
)
query("jsn01_payload", "SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'Map ' || o_orderkey ELSE o_orderkey || ' Oak St, Oakland' END AS address, CASE WHEN o_orderkey % 3 = 0 THEN 4.0 WHEN o_orderkey % 3 = 1 THEN 0.0 END::DOUBLE AS bedrooms, CASE WHEN o_orderkey % 3 < 2 THEN 'Sunny ' || CASE o_orderkey % 3 WHEN 0 THEN '4BR' ELSE 'studio' END END AS title FROM orders", on="orders")(
    lambda o: read(o, "relisto", says('{"title":', F.when(K() % 3 == 0, '{"rendered":"Sunny 4BR"}').when(K() % 3 == 1, '{"rendered":"Sunny studio"}').otherwise("null"), ',"meta":{"property_status":"Current","city":"Oakland","street_number":"', K().cast("string"), '","street_name":"Oak St","map":', F.when(K() % 2 == 0, says('{"address":"Map ', K().cast("string"), '"}')).otherwise('{"address":null}'), "}}"), "address", "bedrooms", "title", column="payload")
)
query("lim02_queue", f"WITH {U}, p AS (SELECT url, count(*) AS members, row_number() OVER (ORDER BY url) AS r FROM u WHERE coalesce(url, '') <> '' AND kind IN ('residential', 'room') GROUP BY 1) SELECT r <= 100 AS queued, count(*) AS pages, CAST(sum(members) AS BIGINT) AS members FROM p GROUP BY 1", on="units")(
    lambda u: queued(*ops.queue_limit(ops.pages_to_read(u, u.select("url").limit(0), ["pos"]), 100))
)
query("join07_metro", f"WITH {U} SELECT pos FROM u WHERE city = 'Boston' AND state = 'MA' OR city = 'Fresno' AND state = 'TX' OR coalesce(city, '') = ''", on="units")(
    lambda u: places.keep_covered(u, u.sparkSession.createDataFrame([("MA", "boston"), ("TX", "fresno")], "area_state string, area_city string")).select("pos")
)
query("jsn02_response", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN value END AS value FROM events", on="events")(
    lambda e: e.select("event_id", raw.parse_response(F.when(C("event_id") % 7 > 0, F.array(F.struct(F.lit("thinking").alias("type"), F.lit("hm").alias("text")), F.struct(F.lit("text").alias("type"), F.when(C("event_id") % 2 == 0, F.to_json(F.struct("value"))).otherwise("I can't").alias("text"))))
        .otherwise(F.array(F.struct(F.lit("text").alias("type"), F.when(C("event_id") % 2 == 0, F.to_json(F.struct("value"))).alias("text")))), "value double")["value"].alias("value"))
)
query("str14_boston", f"WITH {U}, v AS (SELECT *, address || coalesce(' - ' || nullif(city, ''), '') AS title FROM u) SELECT pos, nullif(city, '') AS city, trim(lower(regexp_extract(title, '^\\s*([0-9\\-]+\\s+[A-Za-z][A-Za-z .''-]*)', 1))) AS street, string_split(lower(nullif(city, '')), ' ')[-1] AS tail FROM v", on="units")(
    lambda u: u.withColumns({"title": says(C("address"), F.coalesce(says(" - ", F.nullif("city", F.lit(""))), F.lit(""))), "link": says("https://x.org/resident_listings/12-", F.lower(F.replace(F.nullif("city", F.lit("")), F.lit(" "), F.lit("-"))), "-", (C("pos") % 5).cast("string"), "/")})
    .select("pos", portals.title_city(C("title")).alias("city"), portals.street_key(C("title")).alias("street"), portals.slug_tail(C("link")).alias("tail"))
)
LABEL_SQL = "CASE WHEN bedrooms IS NULL THEN 'Unknown' WHEN bedrooms = 0 THEN 'Studio' WHEN bedrooms = floor(bedrooms) THEN CAST(CAST(bedrooms AS INT) AS STRING) || ' bed' ELSE CAST(bedrooms AS STRING) || ' bed' END"
FACETS_SQL = (
    f"v AS (SELECT * REPLACE (CASE WHEN room_type IS NULL AND kind = 'residential' THEN 'entire_place' ELSE room_type END AS room_type), {TYPE_SQL} AS unit_type FROM m), "
    "f AS (SELECT 0 AS part, 'cities' AS facet, city AS name, NULL AS label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, city) AS i FROM v WHERE coalesce(city, '') <> '' GROUP BY city "
    f"UNION ALL SELECT 1, 'bedrooms', CAST(bedrooms AS STRING), {LABEL_SQL}, count(*), row_number() OVER (ORDER BY bedrooms NULLS LAST) FROM v GROUP BY bedrooms "
    "UNION ALL SELECT 2, 'rent', CAST(min(rent) AS STRING), 'min', NULL, 1 FROM v UNION ALL SELECT 2, 'rent', CAST(max(rent) AS STRING), 'max', NULL, 2 FROM v "
    + " ".join(f"UNION ALL SELECT {3 + i}, '{c}', coalesce(nullif({c}, ''), 'unknown') AS name, NULL, count(*), row_number() OVER (ORDER BY coalesce(nullif({c}, ''), 'unknown') = 'unknown', count(*) DESC, min(file_name || lpad(CAST(pos AS STRING), 12, '0'))) FROM v GROUP BY 3" for i, c in enumerate(dashboard.FACETS))
    + ")"
)


@query(
    "snk07_payload",
    f"""WITH {U}, {AREAS_SQL}, {MERGED_SQL}, {DOCS_SQL}, {SOURCES_SQL}, {FACETS_SQL}
    SELECT 'summary' AS section, 0 AS place, 'now' AS name, NULL AS label, count(*) AS n FROM v UNION ALL SELECT 'source', place, slug, manager, unit_count FROM s
    UNION ALL SELECT 'facet', row_number() OVER (ORDER BY part, i) - 1, facet || '=' || coalesce(name, ''), label, n FROM f
    UNION ALL SELECT 'excluded', row_number() OVER (ORDER BY kind) - 1, kind, NULL, count(*) FROM u WHERE NOT {LIVABLE_SQL} GROUP BY kind UNION ALL SELECT 'unit', NULL, address, unit_type, NULL FROM v""",
    on="units",
)
def _(u):
    merged = ops.merge_units(u)
    sections = {"summary": dashboard.summary(merged, "now"), "source": listed_sources(u), "facet": dashboard.all_facets(merged, ["file_name", "pos"]), "excluded": ops.excluded(u)}
    rows = raw.merged_payload(merged, sections)
    get = lambda *names: F.coalesce(*[F.get_json_object("value", f"$.{n}") for n in names])
    facet = says(get("facet"), "=", F.coalesce(get("name"), F.lit("")))
    name = F.when(C("section") == "facet", facet).when(C("section") == "source", get("slug")).when(C("section") == "unit", get("address")).otherwise(get("generated_at", "kind"))
    label = F.when(C("section") == "source", get("manager")).when(C("section") == "unit", get("unit_type")).otherwise(get("label"))
    count = F.when(C("section") != "unit", get("total_units", "unit_count", "count", "n").cast("long"))
    place = F.when(C("section") != "unit", F.row_number().over(Window.partitionBy("section").orderBy("place")) - 1)
    few = rows.where("section <> 'unit'").withColumn("p", place)
    return few.unionByName(rows.where("section = 'unit'").withColumn("p", F.lit(None).cast("int"))).select("section", C("p").cast("long").alias("place"), name.alias("name"), label.alias("label"), count.alias("n"))


@query("udf01_adapters", "SELECT c_name AS address, 'made_up' AS platform FROM customer", on="customer")
def _(c):
    """A platform of one's own is registered and then read like the built-in ones."""
    portals.register("made_up", lambda pages, today: portals.finish(pages.select("*", F.explode(F.split("html", ";")).alias("a")), address=C("a")))
    try:
        return portals.extract(c.select(F.lit("s").alias("source"), F.lit("M").alias("manager"), F.lit("https://x.org").alias("base_url"), says(C("c_name"), ";").alias("html")), "made_up", F.lit(TODAY)).select("address", F.lit("made_up").alias("platform"))
    finally:
        portals.ADAPTERS.pop("made_up")


def queued(first: DataFrame, over: DataFrame) -> DataFrame:
    """Pages and members of the queue, and of what waits beyond it."""
    both = first.withColumn("queued", F.lit(True)).unionByName(over.withColumn("queued", F.lit(False)))
    return both.groupBy("queued").agg(F.count("*").alias("pages"), F.sum("members").alias("members"))
