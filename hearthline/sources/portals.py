"""Listing portals: pages to units. Each adapter takes pages (source, manager, base_url, html or payload) and today.

A page is split where cards start, cards are rows, and each field is a pattern's group in its card. ADAPTERS is the
extension point: a platform's name and a function from pages to units.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions import dates, kinds, places, text

UNITS = (
    "address source manager city state postal_code kind room_type unit_type bedrooms bathrooms rent available_date available_now square_feet pets title url"
).split()
CASTS = {"bedrooms": "double", "bathrooms": "double", "rent": "double", "square_feet": "int", "available_now": "boolean"}


def cards(pages: DataFrame, marker: str) -> DataFrame:
    """page, pos and card: what follows each marker; before the first there is no card."""
    after = text.let(F.split("html", marker, -1), lambda parts: F.slice(parts, F.lit(2), F.size(parts)))
    return pages.where(F.col("html").isNotNull()).select("source", "manager", "base_url", F.posexplode(after).alias("pos", "card"))


def once(rows: DataFrame, **given: Column) -> DataFrame:
    """rows with more columns, each computed once a row: what a generator gives is not written out again where later columns or filters use it."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in given.items()]))))


def field(pattern: str, group: int = 1, block: Column | None = None) -> Column:
    """A field's cleaned text; null where the card lacks it."""
    block = F.col("card") if block is None else block
    return text.let(F.regexp_extract(block, pattern, group), lambda v: F.when((v != "") | block.rlike(pattern), text.clean_text(v)))


def classed(name: str, end: str, quote: str = '"') -> str:
    """The pattern of what an element with a class holds, up to an end tag."""
    return rf"(?is)class=[{quote}][^{quote}]*{name}[^{quote}]*[{quote}][^>]*>(.*?)</{end}>"


def some(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def finish(rows: DataFrame, **given: Column) -> DataFrame:
    """Unit columns of rows with an address; what an adapter doesn't give is null."""
    given = {"source": F.col("source"), "manager": F.col("manager"), **given}
    rows = rows.withColumns({f"_{k}": v for k, v in given.items()}).where(F.coalesce("_address", F.lit("")) != "")
    out = {c: F.col(f"_{c}") if c in given else F.lit(None) for c in UNITS}
    out["unit_type"] = kinds.unit_type(out["bedrooms"].cast("double"))
    return rows.select(*([F.col("pos")] if "pos" in rows.columns else []), *[out[c].cast(CASTS.get(c, "string")).alias(c) for c in UNITS])


def site(path: Column) -> Column:
    return F.concat(F.regexp_replace("base_url", "/+$", ""), path)


def absolute(link: Column, fallback: str) -> Column:
    """A link of a page as an address: paths belong to the site, and a card without link gets the site's fallback path."""
    return F.when(F.startswith(link, F.lit("/")), site(link)).otherwise(F.coalesce(link, site(F.lit(fallback))))


def street_cities(rows: DataFrame) -> DataFrame:
    """source, street, there: the city of the first card of each street that names one. rows: source, street, own, pos."""
    return rows.where("own is not null and street is not null").groupBy("source", "street").agg(F.min_by("own", "pos").alias("there"))


def street_key(title: Column) -> Column:
    return F.lower(text.strip(text.found(title, BOSTON_STREET)))


def title_city(title: Column) -> Column:
    """The city that a title ends with, unless it is the name of a part of a building."""
    named = text.strip(text.found(title, BOSTON_CITY))
    return F.when(~named.rlike(BOSTON_NO_CITY), places.normal_city(named))


def slug_tail(link: Column) -> Column:
    """The last word of a listing's link, without a counter behind it."""
    return some(F.element_at(F.split(F.regexp_replace(F.lower(text.found(link, BOSTON_SLUG)), r"-\d+$", ""), "-"), -1))


# Markers and fields of each portal's cards.
APPFOLIO_CARD = r'(?i)<div[^>]*class="[^"]*js-listing-item[^"]*"'
APPFOLIO_FACT = r'(?is)<dt[^>]*class="[^"]*detail-box__label[^"]*"[^>]*>(.*?)</dt>\s*<dd[^>]*class="[^"]*detail-box__value[^"]*"[^>]*>(.*?)</dd>'
APPFOLIO_TITLE = r'(?is)class="[^"]*js-listing-title[^"]*"[^>]*>\s*(?:<a[^>]*>)?(.*?)(?:</a>)?\s*</h2>'
APPFOLIO_LINK = r'(?i)href="(/listings/detail/[^"]+)"'
BUILDIUM_CARD = r'(?i)<a[^>]*class="[^"]*featured-listing[^"]*"'
BUILDIUM_LINK = r'(?i)href="(/Resident/public/rentals/[^"]+)"'
SHOWMOJO_CARD = r"(?i)<div[^>]*class=['\"][^'\"]*js-listing-info"
SHOWMOJO_RENT = r"(?is)class=['\"][^'\"]*rent-info[^'\"]*['\"][^>]*>(.*?)</div>\s*</div>"
SHOWMOJO_ICON = r"(?is)<div[^>]*class=['\"][^'\"]*listing-icon-wrap[^'\"]*['\"][^>]*>(.*?)</div>"
SHOWMOJO_LINK = r"(?i)href=['\"](https?://showmojo\.com/[^'\"]+)['\"]"
SHOWMOJO_AVAILABLE = r"(?i)(Available[^<]{0,40})"
ERI_CARD = r'(?i)<div[^>]*class="rental3'
ERI_ADDRESS = r'(?is)class="rraddr"[^>]*>\s*(?:<a[^>]*href="(unit\.php\?id=\d+)"[^>]*>)?(.*?)(?:</a>)?\s*</p>'
MMG_CARD = r'(?i)<div[^>]*class="[^"]*wpl_prp_cont'
MMG_VALUE = r'(?is)class="[^"]*%s[^"]*"[^>]*>.*?class="[^"]*\bvalue\b[^"]*"[^>]*>(.*?)</span>'
MMG_PRICE = r'(?is)class="[^"]*price_box[^"]*"[^>]*>\s*<span[^>]*>(.*?)</span>'
MMG_LINK = r'(?i)href="(https?://mmgprop\.com/properties/[^"]+)"'
BOSTON_CARD = r'(?i)<div[^>]*class="[^"]*\bym_listing\b'
BOSTON_TITLE = r'(?is)<h4[^>]*>\s*(?:<a[^>]*href="([^"]*)"[^>]*>)?(.*?)(?:</a>)?\s*</h4>'
BOSTON_CITY = r"[-–—]\s*([A-Za-z][A-Za-z .'-]{2,30})\s*$"
BOSTON_NO_CITY = r"(?i)^(?:apt|unit|suite|ste|bed|bath|studio)\.?$"
BOSTON_SLUG = r"(?i)/resident_listings/([a-z0-9\-]+)/?"
BOSTON_STREET = r"^\s*([\d\-]+\s+[A-Za-z][A-Za-z .'-]*)"
NEXT_DATA = r'(?s)<script id="__NEXT_DATA__" type="application/json"[^>]*>(.*?)</script>'


def appfolio(pages: DataFrame, today: Column) -> DataFrame:
    rows = once(cards(pages, APPFOLIO_CARD), facts=text.label_values(F.col("card"), APPFOLIO_FACT))
    fact = lambda name: some(F.try_element_at("facts", F.lit(name)))
    rows = once(
        rows, a=field(classed("js-listing-address", "span")), t=field(APPFOLIO_TITLE), size=F.coalesce(fact("bed / bath"), field(classed("js-listing-blurb-bed-bath", "span"))),
        price=F.coalesce(fact("rent"), field(classed("js-listing-blurb-rent", "div"))), when=F.coalesce(fact("available"), field(classed("js-listing-available", "(?:dd|span)"))), area=fact("square feet"),
    )
    rows = once(rows, loc=places.parse_location(F.col("a")), av=dates.parse_available(F.col("when"), today), beds=F.coalesce(text.parse_bedrooms(F.col("size")), text.bedrooms_from_title(F.col("t"))))
    link = text.found(F.col("card"), APPFOLIO_LINK)
    return finish(
        rows, address=F.col("a"), city=F.col("loc.city"), state=F.coalesce("loc.state", F.lit("CA")), postal_code=F.col("loc.zip"), kind=kinds.classify(F.col("a"), F.col("t"), F.col("beds")),
        room_type=kinds.room_type_of_specs(F.col("size")), bedrooms=F.col("beds"), bathrooms=text.parse_bathrooms(F.col("size")), rent=text.parse_rent(F.col("price")), available_date=F.col("av.date"),
        available_now=F.coalesce("av.now", F.lit(False)), square_feet=text.parse_square_feet(F.col("area")), title=F.col("t"), url=F.coalesce(site(link), F.col("base_url")),
    )


def buildium(pages: DataFrame, today: Column) -> DataFrame:
    attr = lambda name: some(text.strip(F.regexp_extract("card", rf'(?i){name}="([^"]*)"', 1)))
    part = lambda name, end="p": field(classed(f"featured-listing__{name}", end))
    rows = once(cards(pages, BUILDIUM_CARD), t=part("title", "h3"), line=part("address"), features=part("features"), price=part("price"), when=part("availability"))
    rows = once(rows, a=F.when((F.col("t") != "") & (F.col("line") != ""), F.concat_ws(", ", "t", "line")).otherwise(F.coalesce(some(F.col("t")), some(F.col("line")))))
    shown = places.parse_location(F.coalesce(some(F.col("line")), F.col("a")))
    loc = text.let(places.parse_location(attr("data-location")), lambda stated: F.when(stated["city"].isNotNull(), stated).otherwise(shown))
    rows = once(rows, loc=loc, av=dates.parse_available(F.col("when"), today), beds=F.coalesce(text.parse_bedrooms(attr("data-bedrooms")), text.parse_bedrooms(F.col("features")), text.bedrooms_from_title(F.col("t"))))
    return finish(
        rows, address=F.col("a"), city=F.col("loc.city"), state=F.coalesce("loc.state", F.lit("CA")), postal_code=F.col("loc.zip"), kind=kinds.classify(F.col("a"), F.col("t"), F.col("beds")), bedrooms=F.col("beds"),
        bathrooms=F.coalesce(text.parse_bathrooms(attr("data-bathrooms")), text.parse_bathrooms(F.col("features"))), rent=F.coalesce(text.parse_rent(attr("data-rent")), text.parse_rent(F.col("price"))),
        available_date=F.col("av.date"), available_now=F.coalesce("av.now", F.lit(False)), square_feet=F.coalesce(text.parse_square_feet(attr("data-square-feet")), text.parse_square_feet(F.col("features"))),
        title=F.col("t"), url=F.coalesce(site(text.found(F.col("card"), BUILDIUM_LINK)), F.col("base_url")),
    )


def showmojo(pages: DataFrame, today: Column) -> DataFrame:
    both = "'\""
    icon = lambda word: F.try_element_at(F.filter(F.transform(F.filter(F.regexp_extract_all("card", F.lit(SHOWMOJO_ICON), 1), lambda w: w.rlike(rf"(?i)icons?/[^'\"]*{word}")), text.clean_text), lambda t: t != ""), F.lit(1))
    rows = once(cards(pages, SHOWMOJO_CARD), street=field(classed("listing-address-header", "div", both))).where("street <> ''")
    rows = once(rows, line=text.let(field(classed("listing-city-state-zip", "p", both)), some), info=F.coalesce(text.found(F.col("card"), SHOWMOJO_RENT), F.col("card")), bed=icon("bed"), bath=icon("bath"))
    rows = rows.withColumn("a", F.concat_ws(", ", "street", "line"))
    price = F.coalesce(text.found(F.col("info"), classed("price", "span", both)), text.found(F.col("card"), classed("price", "span", both)), F.col("info"))
    when = F.coalesce(text.found(text.clean_text(F.col("info")), SHOWMOJO_AVAILABLE), text.found(text.clean_text(F.col("card")), SHOWMOJO_AVAILABLE))
    rows = once(rows, loc=places.parse_location(F.coalesce("line", "a")), av=dates.parse_available(when, today), beds=text.parse_bedrooms(F.col("bed")))
    return finish(
        rows, address=F.col("a"), city=F.col("loc.city"), state=F.coalesce("loc.state", F.lit("CA")), postal_code=F.col("loc.zip"), kind=kinds.classify(F.col("a"), F.col("street"), F.col("beds")), bedrooms=F.col("beds"),
        bathrooms=text.parse_bathrooms(F.col("bath")), rent=text.parse_rent(price), available_date=F.col("av.date"), available_now=F.coalesce("av.now", F.lit(False)), title=F.col("street"), url=F.coalesce(text.found(F.col("card"), SHOWMOJO_LINK), F.col("base_url")),
    )


def eri(pages: DataFrame, today: Column) -> DataFrame:
    part = lambda name: text.let(field(rf'(?is)class="{name}"[^>]*>(.*?)</p>'), some)
    rows = once(cards(pages, ERI_CARD), street=field(ERI_ADDRESS, 2)).where("street <> ''")
    rows = once(rows, link=text.found(F.col("card"), ERI_ADDRESS, 1), c=part("rrcity"), n=part("rrunitid"), lines=F.transform(F.regexp_extract_all("card", F.lit(r'(?is)class="rr"[^>]*>(.*?)</p>'), 1), text.clean_text))
    rows = once(rows, all=F.array_join("lines", " "))
    when = F.regexp_replace(F.coalesce(F.try_element_at(F.filter("lines", lambda t: t.rlike("(?i)avail")), F.lit(1)), F.col("all")), r"(?i)^\s*available\s*:?\s*", "")
    rows = once(rows, a=F.concat_ws(", ", "street", "n", F.col("c"), F.when(F.col("c").isNotNull(), "CA")), av=dates.parse_available(when, today), beds=text.parse_bedrooms(F.col("all")))
    return finish(
        rows, address=F.col("a"), city=F.col("c"), state=F.lit("CA"), kind=kinds.classify(F.col("a"), F.col("all"), F.col("beds")), bedrooms=F.col("beds"), bathrooms=text.parse_bathrooms(F.col("all")), rent=text.parse_rent(F.col("all")),
        available_date=F.col("av.date"), available_now=F.coalesce("av.now", F.lit(False)), url=F.coalesce(site(F.concat(F.lit("/"), F.col("link"))), site(F.lit("/rental.php"))),
    )


def mmg(pages: DataFrame, today: Column) -> DataFrame:
    rows = once(cards(pages, MMG_CARD), loc=field(classed("wpl_prp_listing_location", "h4")), t=field(classed("wpl_prp_title", "h3")))
    rows = rows.withColumn("a", F.coalesce(some(F.col("loc")), some(F.col("t")))).where("a <> ''")
    rows = once(rows, b=field(MMG_VALUE % r"\bbedroom\b"), bath=field(MMG_VALUE % r"\bbathroom\b"), area=field(MMG_VALUE % "living_area"))
    city = F.coalesce(places.normal_city(text.strip(F.get(F.split("loc", ","), F.lit(1)))), places.city_of_address(F.col("a")))
    beds = F.coalesce(text.parse_bedrooms(F.col("b")), text.bedrooms_from_title(F.col("t")), F.when(F.col("bath").isNotNull(), 0.0))  # studios have no bedroom element
    rows = once(rows, c=city, beds=beds)
    return finish(
        rows, address=F.col("a"), city=F.col("c"), state=F.lit("CA"), postal_code=text.found(F.col("loc"), r"\b(\d{5})(?:-\d{4})?\s*$"), kind=kinds.classify(F.col("a"), F.col("t"), F.col("beds")), bedrooms=F.col("beds"),
        bathrooms=text.parse_bedrooms(F.col("bath")), rent=text.parse_rent(text.found(F.col("card"), MMG_PRICE)), available_now=F.lit(False), square_feet=text.parse_square_feet(F.col("area")), title=F.col("t"),
        url=F.coalesce(text.found(F.col("card"), MMG_LINK), site(F.lit("/low-to-high/"))),
    )


def boston_pm(pages: DataFrame, today: Column) -> DataFrame:
    """A card's city is its title's; else its link's last word, if some title names that city; else that of the first card of its street."""
    rows = once(cards(pages, BOSTON_CARD), t=field(BOSTON_TITLE, 2)).where("t <> ''")
    rows = once(rows, href=text.found(F.col("card"), BOSTON_TITLE, 1), lines=F.transform(F.regexp_extract_all("card", F.lit(r"(?is)<h5[^>]*>(.*?)</h5>"), 1), text.clean_text))
    rows = rows.select("*", title_city(F.col("t")).alias("own"), slug_tail(F.col("href")).alias("tail"), street_key(F.col("t")).alias("street"), F.array_join("lines", " ").alias("all"))
    rows = cut(rows.drop("card"))  # three reads follow: cities, streets and the cards themselves
    known = rows.where("own is not null")
    words = known.select("source", F.lower("own").alias("tail")).distinct().withColumn("is_city", F.lit(True))
    streets = street_cities(rows)
    rows = rows.join(words, ["source", "tail"], "left").join(streets, ["source", "street"], "left")
    rows = rows.withColumn("c", F.coalesce("own", F.when(F.col("is_city"), places.normal_city(F.col("tail"))), "there"))
    when = F.regexp_replace(F.coalesce(F.try_element_at(F.filter("lines", lambda t: t.rlike("(?i)avail")), F.lit(1)), F.lit("")), r"(?i)^\s*availability\s*:?\s*", "")
    line = F.when(F.col("c").isNotNull(), text.strip(F.regexp_replace("t", BOSTON_CITY, ""))).otherwise(F.col("t"))
    rows = once(rows, line=line, av=dates.parse_available(when, today), beds=text.parse_bedrooms(F.col("all"))).withColumn("a", F.concat_ws(", ", "line", "c", F.when(F.col("c").isNotNull(), "MA")))
    return finish(
        rows, address=F.col("a"), city=F.col("c"), state=F.lit("MA"), kind=kinds.classify(F.col("a"), F.col("all"), F.col("beds")), bedrooms=F.col("beds"), bathrooms=text.parse_bathrooms(F.col("all")), rent=text.parse_rent(F.col("all")),
        available_date=F.col("av.date"), available_now=F.coalesce("av.now", F.lit(False)), title=F.col("line"), url=absolute(F.col("href"), "/residents/listings/"),
    )


RELISTO = (
    "array<struct<id:string,link:string,title:struct<rendered:string>,meta:struct<property_status:string,city:string,state:string,zip_code:string,street_number:string,street_name:string,unit:string,"
    "map:struct<address:string>,bedrooms:string,price:string,square_feet:string,availability_date:string>>>"
)


def relisto(pages: DataFrame, today: Column) -> DataFrame:
    """pages have payload, a JSON list, in place of html."""
    rows = pages.select("source", "manager", "base_url", F.posexplode(F.from_json("payload", RELISTO)).alias("pos", "r"))
    m = lambda name: some(text.strip(F.col(f"r.meta.{name}")))
    rows = rows.where((F.lower("r.meta.property_status") == "current") & m("city").isNotNull())
    street = some(F.concat_ws(" ", m("street_number"), m("street_name"), F.concat(F.lit("#"), m("unit"))))
    place = F.concat_ws(" ", F.concat_ws(", ", m("city"), m("state")), m("zip_code"))
    rows = rows.select("*", F.coalesce(m("map.address"), F.when(street.isNotNull(), F.concat_ws(", ", street, some(place)))).alias("a"), F.col("r.title.rendered").alias("t"))
    rows = rows.select("*", F.coalesce(text.parse_bedrooms(F.col("r.meta.bedrooms")), text.bedrooms_from_title(F.col("t"))).alias("beds"), dates.parse_available(F.translate("r.meta.availability_date", "/", "-"), today).alias("av"))
    return finish(
        rows, address=F.col("a"), city=m("city"), state=F.coalesce(m("state"), F.lit("CA")), postal_code=m("zip_code"), kind=kinds.classify(F.col("a"), F.col("t"), F.col("beds")), bedrooms=F.col("beds"), rent=text.parse_rent(F.col("r.meta.price")),
        available_date=F.col("av.date"), available_now=F.coalesce("av.now", F.lit(False)), square_feet=text.parse_square_feet(F.col("r.meta.square_feet")), title=F.col("t"), url=F.coalesce(some(F.col("r.link")), F.col("base_url")),
    )


TRIPALINK = (
    f"struct<address:string,name:string,city:string,id:string,leasePolicy:{kinds.POLICY},availableUnits:array<struct<name:string,floorPlanBedroomNum:string,floorPlanBathroomNum:string,minPrice:string,maxPrice:string,"
    "availableStartTime:double,availableContent:string,availableNow:boolean,rooms:array<struct<id:string>>,totalArea:string,unitType:string>>>"
)


def build_id(html: Column) -> Column:
    """The id in a page's embedded JSON, which names the portal's other addresses."""
    return some(F.get_json_object(F.regexp_extract(html, NEXT_DATA, 1), "$.buildId"))


def tripalink(pages: DataFrame, today: Column) -> DataFrame:
    """pages have payload, one property's JSON each; a property whose payload can't be read gives no units."""
    props = pages.select("source", "manager", "base_url", F.from_json("payload", TRIPALINK).alias("p")).withColumn("base", F.coalesce(some(F.col("p.address")), some(F.col("p.name")))).where("base is not null")
    rows = props.select("*", F.posexplode("p.availableUnits").alias("pos", "u"))
    start = F.date_format(dates.pacific_date(F.col("u.availableStartTime")), "yyyy-MM-dd")
    said = dates.parse_available(F.col("u.availableContent"), today)
    rows = rows.select("*", text.parse_bedrooms(F.col("u.floorPlanBedroomNum")).alias("beds"), F.concat(F.col("base"), F.coalesce(F.concat(F.lit(" #"), some(F.col("u.name"))), F.lit(""))).alias("a"), start.alias("start"), said.alias("said"))
    per_room = F.coalesce((F.size("u.rooms") == 1) & (F.col("beds") >= 2), F.lit(False))
    rows = rows.withColumn("k", F.when(per_room, "room").otherwise(kinds.classify(F.col("a"), F.col("u.unitType"), F.col("beds"))))
    day = F.coalesce("start", "said.date")
    return finish(
        rows, address=F.col("a"), city=F.coalesce(some(F.col("p.city")), F.lit("Berkeley")), state=F.lit("CA"), kind=F.col("k"), room_type=kinds.room_type_of_occupancy(F.col("p.leasePolicy"), F.col("k") == "room"), pets=kinds.pets_of_policy(F.col("p.leasePolicy")),
        bedrooms=F.col("beds"), bathrooms=text.parse_bathrooms(F.col("u.floorPlanBathroomNum")), rent=F.coalesce(text.parse_rent(F.col("u.minPrice")), text.parse_rent(F.col("u.maxPrice"))), available_date=day,
        available_now=day.isNull() & (F.coalesce("said.now", F.lit(False)) | F.coalesce("u.availableNow", F.lit(False))), square_feet=text.parse_square_feet(F.col("u.totalArea")), title=F.col("p.name"),
        url=F.coalesce(site(F.concat(F.lit("/apartments/bay-area/berkeley/"), some(F.col("p.id")))), F.col("base_url")),
    )


# Addresses of the portal's embedded JSON, and where the list and a property's details stand in it.
LISTING_PAGE = "/berkeley/homes-for-rent"
LIST_JSON = "/_next/data/{}/berkeley/homes-for-rent.json?urlPath=berkeley&urlPath=homes-for-rent"
LIST_PAGE = "&page="
DETAIL_JSON = "/_next/data/{}/apartments/bay-area/berkeley/{}.json?cityRoute=bay-area&areaRoute=berkeley&id={}"
LIST_DATA = "$.pageProps.data.ESProperties.data"
DETAIL_DATA = "$.pageProps.data"


def filled(address: str, *parts: Column) -> Column:
    """base_url and an address with its gaps filled."""
    texts = address.split("{}")
    return F.concat(F.col("base_url"), F.lit(texts[0]), *[x for part, after in zip(parts, texts[1:], strict=True) for x in (part, F.lit(after))])


def tripalink_lists(sources: DataFrame, pages: DataFrame) -> DataFrame:
    """The first hop: source, manager, base_url, build and id of each property in the list whose address the listing page's build id names.

    sources: source, manager, base_url, a row a portal, so both joins here broadcast it. pages: url, body; null bodies are failed fetches. A long list
    may come in pages, each fetched by the list's address with LIST_PAGE and its number after it; place is a property's place in its own page.
    """
    of = ["source", "manager", "base_url"]
    some_page = pages.where(F.col("body").isNotNull() & ~F.contains("url", F.lit("/apartments/")))  # properties' pages are most, and no part of this hop
    fetched = some_page.groupBy("url").agg(F.max("body").alias("body"))
    asked = sources.select(*of, F.concat("base_url", F.lit(LISTING_PAGE)).alias("url"))
    builds = fetched.join(F.broadcast(asked), "url").select(*of, build_id(F.col("body")).alias("build")).where("build is not null")
    named = F.broadcast(builds.select(*of, "build", filled(LIST_JSON, F.col("build")).alias("whole")))
    lists = fetched.withColumn("whole", F.regexp_replace("url", LIST_PAGE + r"\d+$", "")).join(named, "whole")
    ids = F.from_json(F.get_json_object("body", LIST_DATA), "array<struct<id:string>>")
    return lists.select(*of, "build", F.posexplode(ids).alias("place", "p")).select(*of, "build", "place", some(F.col("p.id")).alias("id")).where("id is not null")


def tripalink_scan(sources: DataFrame, pages: DataFrame, today: Column) -> DataFrame:
    """Units of portals from a table of pages: the listing page's build id names the list, the list and the build id name each property's page, and that has its
    units. Properties whose page is missing, failed or empty give none, and keep nothing else from being read."""
    props = tripalink_lists(sources, pages)
    asked = props.select("source", "manager", "base_url", filled(DETAIL_JSON, F.col("build"), F.col("id"), F.col("id")).alias("url")).distinct()
    fetched = pages.where(F.col("body").isNotNull() & F.contains("url", F.lit("/apartments/")))
    details = fetched.groupBy("url").agg(F.max("body").alias("body")).join(asked, "url").withColumn("payload", F.get_json_object("body", DETAIL_DATA))
    return tripalink(details.where("payload is not null").select("source", "manager", "base_url", "payload"), today)


# Records on a full page of the portal's list, and the most pages it is asked for.
PER_PAGE, MOST_PAGES = 100, 40


def until_stop(pages: DataFrame, per_page: int = PER_PAGE, most: int = MOST_PAGES) -> DataFrame:
    """The pages of each source up to its first one that isn't full: an empty or failed one ends the list, a short one is its last.

    pages: source, page (from 1), payload, a JSON list; a failed page has no payload or none that can be read, a missing one failed. A source whose first page failed has no
    pages here and is found by failed_sources.
    """
    size = F.coalesce(F.size(F.from_json("payload", "array<string>")), F.lit(-1))
    full = pages.where(F.col("page").between(1, most) & (size >= per_page)).groupBy("source").agg(F.collect_set("page").alias("full"))  # no more than most
    none = F.array().cast("array<int>")
    last = F.array_min(F.array_except(F.sequence(F.lit(1), F.lit(most + 1)), F.coalesce("full", none)))
    read = pages.join(full, "source", "left").withColumn("__last", last)
    return read.where((F.col("page") >= 1) & (F.col("page") <= F.least("__last", F.lit(most))) & (size > 0)).drop("full", "__last")


def failed_sources(sources: DataFrame, pages: DataFrame) -> DataFrame:
    """The sources whose first page failed: no list at all, which is an error and no end."""
    first = pages.where(F.col("page") == 1).where(F.from_json("payload", "array<string>").isNotNull())
    return sources.join(first.select("source"), "source", "left_anti")


ADAPTERS: dict[str, Callable[[DataFrame, Column], DataFrame]] = {
    "appfolio": appfolio, "buildium": buildium, "showmojo": showmojo, "eri": eri, "mmg": mmg, "boston_pm": boston_pm, "relisto": relisto, "tripalink": tripalink,
}


def register(platform: str, adapter: Callable[[DataFrame, Column], DataFrame]) -> None:
    """Adds a platform, or replaces its adapter."""
    ADAPTERS[platform] = adapter


def extract(pages: DataFrame, platform: str, today: Column) -> DataFrame:
    return ADAPTERS[platform](pages, today)
